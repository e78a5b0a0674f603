"""Plain logs: tool events, id maps, host lists, task outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskscope.functions.text import BINARY, extract_info, tail, tool_name
from taskscope.operators.ordered import running
from taskscope.session import staged
from taskscope.sources.ranges import ends, files_below, shown_end, small_lines
from taskscope.sources.trace import read_lines

# fixed values: the log line of the tool, for example
# output: [batch3:80017] [[33357,0],0] [1565343424.463101] ACTIVATE JOB [33357,0] STATE INIT_DONE AT f.c:1
_LINE = (r"\[([^\[\]]+)\] \[\[([^\[\]]+)\](,[^\[\]]*)\] \[([0-9.]+)\] ACTIVATE (JOB|PROC) "
         r"(?:NULL|\[+([^\[\]]+)\](?:,[^\[\]]*\])?) STATE (.+?) AT ")
_SEP = "\x1f"
ACTIVATE = " ACTIVATE "
IDMAP = "PRTE IDMAP:"
#: bytes of a list of files that one task reads
LIST = 64 << 20


def log_to_events(lines: DataFrame, idmap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) from log lines (pid, value) and an id map (tool_id, uid).

    A tool id without an entry stands for the pilot.
    """
    # one match per line: its groups come back in one text, which a line without a match is not
    groups = F.when(F.col("_m").startswith(_SEP), F.split("_m", _SEP))
    part = lambda i: F.get(groups, F.lit(i))
    whole = "".join(f"{_SEP}${i}" for i in (1, 2, 3, 4, 6, 7))
    found = (lines.filter(F.col("value").contains(ACTIVATE))
             .withColumn("_m", F.regexp_replace("value", f"(?s)^.*?{_LINE}.*$", whole))
             .withColumns({"node": part(1), "daemon": F.concat(part(2), part(3)),
                           "time": part(4).try_cast("double"), "tool_id": part(5), "tool_event": part(6)}).drop("_m"))
    ok = F.coalesce(F.col("time").isNotNull() & (F.col("tool_event") != ""), F.lit(False))
    named = found.filter(ok).join(
        idmap.select("tool_id", F.col("uid").alias("_uid")), "tool_id", "left")
    events = named.select(
        "time", F.concat(F.lit("prte_"), tool_name(F.col("tool_event"))).alias("event"),
        F.lit("prte.dvm").alias("comp"), F.replace("daemon", F.lit(","), F.lit(".")).alias("thread"),
        F.replace(F.coalesce("_uid", "pid"), F.lit(","), F.lit(".")).alias("uid"),
        F.lit("AGENT_EXECUTING").alias("state"), F.col("node").alias("msg"))
    rejects = found.filter(~ok).select("pid", "value", F.lit("no event in line").alias("reason"))
    return events, rejects


def log_idmap(lines: DataFrame, order=("file", "block", "pos")) -> DataFrame:
    """(tool_id, uid) from the last token of id-map lines; the last line counts."""
    token = F.regexp_extract(F.rtrim("value"), r"(\S+)$", 1)
    pair = lines.filter(F.col("value").contains(IDMAP) & token.contains(":")).select(
        F.regexp_extract(token, r"^([^:]*):(.*)$", 1).alias("tool_id"),
        F.regexp_extract(token, r"^([^:]*):(.*)$", 2).alias("uid"), *order)
    return pair.groupBy("tool_id").agg(F.max_by("uid", F.struct(*order)).alias("uid"))


def host_slots(lines: DataFrame, cpn: int | None = None, smt: int = 1) -> DataFrame:
    """(job, host, slots, pos): how often a host is listed, or `cpn`, times `smt`.

    `lines`: job, pos, value.  A line with a blank in it makes the job's whole
    list invalid, and empty.
    """
    named = lines.select("job", "pos", F.trim("value").alias("host"))
    bad = named.filter(F.col("host").contains(" ")).select("job").distinct()
    count = F.count(F.lit(1))
    each = F.lit(cpn).cast("long") if cpn else count
    return (named.groupBy("job", "host").agg((each * (smt or 1)).alias("slots"), F.min("pos").alias("pos"))
            .join(bad, "job", "left_anti"))


def host_shapes(hosts: DataFrame, gpn: int = 0, lfs: int = 0, mem: int = 0) -> DataFrame:
    """Node rows of a host list: numbered as listed, all resources free."""
    placed = running(hosts, ["job"], ["pos"], number="_n")
    free = lambda n: F.array_repeat(F.lit(0.0), n)
    return placed.select(
        "job", F.col("host").alias("name"), (F.col("_n") - 1).cast("int").alias("index"),
        free(F.col("slots").cast("int")).alias("cores"), free(F.lit(gpn)).alias("gpus"),
        F.lit(lfs).cast("long").alias("lfs"), F.lit(mem).cast("long").alias("mem"))


def first_info(lines: DataFrame, pattern: str, order=("pos",)) -> DataFrame:
    """(uid, info): last group of the first line per uid that matches."""
    info = lines.withColumn("_info", extract_info(F.col("value"), pattern)).filter("_info is not null")
    return info.groupBy("uid").agg(F.min_by("_info", F.struct(*order)).alias("info"))


def shown_text(content, stream):
    """Tail of a task's output, or a note when it is not text."""
    text = content.cast("string")
    note = F.format_string(BINARY.replace("{stream}", "%s"), stream)
    return F.when(F.is_valid_utf8(text), tail(text)).otherwise(note)


def collect_outputs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(texts, files): ends of `<uid>.out` and `<uid>.err`, and the entries of
    `<uid>.ofiles`, of all task folders below a path.

    Of an output only its last 4 KB are read, which also decide whether it is
    text.  Folders are listed by tasks; large lists of files are read in splits
    like any text, each of the others by one task.
    """
    found = staged(files_below(spark, path, "*.out|*.err|*.ofiles"), "outputs")
    name = lambda place, i: F.regexp_extract(F.element_at(F.split(place, "/"), -1), r"^(.*)\.([^.]+)$", i)
    listing = F.col("path").endswith(".ofiles")
    stream = F.when(name("path", 2) == "out", "stdout").otherwise("stderr")
    texts = ends(found.filter(~listing)).select(
        name("path", 1).alias("uid"), stream.alias("stream"), shown_end(F.col("text"), stream).alias("text"))
    lines = small_lines(found.filter(listing & (F.col("bytes") <= LIST)))
    large = [r.path for r in found.filter(listing & (F.col("bytes") > LIST)).collect()]  # few: each has LIST bytes
    if large:
        split = running(read_lines(spark, large, "*.ofiles"), ["file"], ["block", "pos"], number="_n")
        lines = lines.unionByName(split.select(F.col("file").alias("path"), (F.col("_n") - 1).cast("int").alias("pos"), "value"))
    return texts, lines.select(name("path", 1).alias("uid"), "pos", F.trim("value").alias("file"))
