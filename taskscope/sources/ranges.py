"""File sources that read parts of files: the ends of large outputs, and byte ranges of JSON.

A JSON document is no more than one split for Spark, however large it is.  Here its
bytes are cut into ranges.  Whether a range begins inside a string, and how deep, is not
known beforehand; so each range is scanned for every way it may begin (in a string or
not, after a backslash or not), which gives a small summary.  Composed in order, the
summaries tell how each range does begin, and the ranges are read again, cut at the
commas and brackets of the outermost two levels.  Fragments that reach over a range's
edge are put together.  No task holds more than a range and one entry.

Files are opened by the workers with `pyarrow.fs` (local paths, and the stores it knows).
"""

from __future__ import annotations

import fnmatch
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from taskscope.functions.text import BINARY, SHORTENED, TAIL_LENGTH

#: Bytes of a range.
RANGE = 8 << 20
#: Files whose ends are held at a time.
FILES = 256


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and place of a path or URI, also in the form file:/place."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def _fits(place: str, root: str, glob: str) -> bool:
    name = place.rsplit("/", 1)[-1]
    return name[0] not in "._" and any(
        fnmatch.fnmatch(place[len(root):].strip("/") if "/" in g else name, g) for g in glob.split("|"))


def files(path: str, glob: str) -> list[tuple[str, int]]:
    """(place, bytes) of all files below a path that fit one of the patterns, apart from hidden ones.

    Patterns are divided by `|`; one with a slash is for the place below the path, else it is for the name.
    """
    system, root = opened(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True)) \
        if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and _fits(f.path, root, glob))


class Parts(InputPartition):
    def __init__(self, parts: list):
        super().__init__(len(parts))
        self.parts = parts


# ---- ends of files

def end_of(data: bytes, whole: bool, n: int = TAIL_LENGTH) -> str | None:
    """The last n characters, marked when something was cut; `data` has 4 n bytes and 3 more, or all."""
    if not whole:
        data = data[next((i for i in range(3) if data[i] & 0xC0 != 0x80), 3):]
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if whole and len(text) <= n else SHORTENED + text[-n:]


def files_below(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, bytes): what `files` gives, as a table.

    One task lists the path itself, as a stream of names; the folders in it are dealt to
    all tasks.  The driver sees no file.
    """
    def top(batches):
        for batch in batches:
            if batch.num_rows:
                system, root = opened(path)
                at = system.get_file_info(root)
                found = system.get_file_info(fs.FileSelector(root)) if at.type == fs.FileType.Directory else [at]
                for i in range(0, len(found), 10_000):
                    part = found[i:i + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f.path for f in part], pa.string()), pa.array([f.size for f in part], pa.int64()),
                         pa.array([f.type == fs.FileType.Directory for f in part])], names=["path", "bytes", "folder"])

    def each(batches):
        system, root = opened(path)
        for batch in batches:
            found = []
            for place, size, folder in zip(*(c.to_pylist() for c in batch.columns)):
                if folder:
                    found += [(f.path, f.size) for f in system.get_file_info(fs.FileSelector(place, recursive=True)) if f.type == fs.FileType.File]
                else:
                    found.append((place, size))
            found = [(p, n) for p, n in found if _fits(p, root, glob)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())],
                                             names=["path", "bytes"])

    tasks = 4 * spark.sparkContext.defaultParallelism  # a listing is too small to be dealt by its bytes
    return (spark.range(0, 1, 1, 1).mapInArrow(top, "path string, bytes long, folder boolean").repartition(tasks, "path")
            .mapInArrow(each, "path string, bytes long"))


def ends(found: DataFrame) -> DataFrame:
    """(path, bytes, text) with the last characters of the files of `found` (path, bytes); null where the end is no UTF-8."""
    def run(batches):
        most = 4 * TAIL_LENGTH + 3
        for batch in batches:
            for i in range(0, batch.num_rows, FILES):
                part, texts = batch.slice(i, FILES), []
                for path, size in zip(*(c.to_pylist() for c in part.columns)):
                    system, place = opened(path)
                    with system.open_input_file(place) as f:
                        f.seek(max(0, size - most))
                        texts.append(end_of(f.read(most), size <= most))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["path", "bytes", "text"])

    return found.select("path", "bytes").mapInArrow(run, "path string, bytes long, text string")


def _lines(file) -> Iterator[bytes]:
    rest = b""
    while chunk := file.read(1 << 20):
        *whole, rest = (rest + chunk).splitlines(keepends=True)
        yield from whole
    yield from rest.splitlines()


def small_lines(found: DataFrame) -> DataFrame:
    """(path, pos, value): the lines of the files of `found` (path, bytes), numbered from 0; a file is read by one task."""
    def run(batches):
        for batch in batches:
            held = []
            for path in batch.column(0).to_pylist():
                system, place = opened(path)
                with system.open_input_stream(place) as f:
                    for pos, line in enumerate(_lines(f)):
                        held.append((path, pos, line.rstrip(b"\r\n")))
                        if len(held) == 10_000:
                            yield batch_of(held)
                            held = []
            yield batch_of(held)

    def batch_of(rows):
        kinds = (pa.string(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "pos", "value"])

    return found.select("path").mapInArrow(run, "path string, pos int, value binary").withColumn("value", F.col("value").cast("string"))


def read_ends(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return ends(files_below(spark, path, glob))


def shown_end(text, stream):
    """The end of a task's output, or a note when it is not text."""
    note = F.format_string(BINARY.replace("{stream}", "%s"), stream)
    return F.coalesce(text, note)


# ---- ranges of JSON

_OPEN, _CLOSE, _COMMA = (np.isin(np.arange(256), [ord(c) for c in chars]) for chars in ("{[", "}]", ","))


def structure(data: bytes, in_string: bool, escaped: bool, depth: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Places of brackets and commas outside strings, the depth before each, and how the data ends."""
    a = np.frombuffer(data, np.uint8)
    n = len(a)
    quotes = np.flatnonzero(a == 0x22)
    slash = np.concatenate([[escaped], a == 0x5C])  # one place on; what comes before the data is first
    run = np.arange(n + 1) - np.maximum.accumulate(np.where(slash, -1, np.arange(n + 1)))
    quotes = quotes[run[quotes] % 2 == 0]  # the backslashes right before a quote, in pairs or none
    parity = np.zeros(n + 1, np.int8)
    parity[quotes + 1] = 1
    inside = (np.cumsum(parity, dtype=np.int64) + in_string) % 2
    marks = np.flatnonzero((_OPEN[a] | _CLOSE[a] | _COMMA[a]) & (inside[:-1] == 0))
    step = _OPEN[a[marks]].astype(np.int64) - _CLOSE[a[marks]]
    before = depth + np.cumsum(step) - step
    return marks, before, (bool(inside[-1]), bool(run[n] % 2), depth + int(step.sum()))


def separators(data: bytes, marks: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Which marks cut the outermost two levels: what opens them, what closes them, and the commas in them."""
    c = np.frombuffer(data, np.uint8)[marks]
    return (_OPEN[c] & (before <= 1)) | (_CLOSE[c] & (before <= 2)) | (_COMMA[c] & (before <= 2))


#: Ways in which a range may begin: in a string, after a backslash.
_WAYS = ((False, False), (True, False), (True, True))


def summary(data: bytes) -> list[list]:
    """For each way to begin: how it ends, with depth counted from the begin, and the marks by kind and depth."""
    out = []
    for way in _WAYS:
        marks, before, (in_string, escaped, depth) = structure(data, *way, 0)
        c = np.frombuffer(data, np.uint8)[marks]
        kinds = np.where(_OPEN[c], 0, np.where(_CLOSE[c], 1, 2))
        low = before <= 2  # no range begins above the outermost level
        pairs, counts = np.unique(np.stack([kinds[low], before[low]], axis=1), axis=0, return_counts=True)
        out.append([in_string, escaped, depth, [[int(k), int(d), int(m)] for (k, d), m in zip(pairs, counts)]])
    return out


class JsonRanges(DataSource):
    """`json_ranges`: summaries or fragments of byte ranges, as planned in the option `ranges`."""

    @classmethod
    def name(cls) -> str:
        return "json_ranges"

    def schema(self) -> str:
        if self.options["what"] == "summaries":
            return "file string, chunk int, summary string"
        return "file string, chunk int, id long, edge boolean, depth int, sep string, data binary"

    def reader(self, schema) -> DataSourceReader:
        return JsonReader(self.options["path"], self.options["what"], json.loads(self.options["ranges"]), int(self.options["size"]))


class JsonReader(DataSourceReader):
    def __init__(self, path: str, what: str, ranges: list, size: int):
        self.path, self.what, self.ranges, self.size = path, what, ranges, size

    def partitions(self) -> list[Parts]:
        """Ranges in the order given, small ones together."""
        out, size = [], self.size
        for r in self.ranges:
            if size + r[3] - r[2] > self.size:
                out.append([])
                size = 0
            out[-1].append(r)
            size += r[3] - r[2]
        return [Parts(p) for p in out] or [Parts([])]

    def read(self, partition: Parts) -> Iterator:
        system, _ = opened(self.path)
        for file, chunk, start, stop, *state in partition.parts:
            with system.open_input_file(file) as f:
                f.seek(start)
                data = f.read(stop - start)
            if self.what == "summaries":
                yield file, chunk, json.dumps(summary(data))
            else:
                yield self.fragments(file, chunk, data, *state)

    @staticmethod
    def fragments(file: str, chunk: int, data: bytes, in_string: bool, escaped: bool, depth: int, base: int) -> pa.RecordBatch:
        marks, before, (_, _, end) = structure(data, in_string, escaped, depth)
        cuts = separators(data, marks, before)
        at, depths = marks[cuts], before[cuts]
        starts, stops = np.append(0, at + 1), np.append(at, len(data))
        n = len(starts)
        edge = np.zeros(n, bool)
        edge[[0, -1]] = True
        seps = [chr(data[i]) for i in at] + [None]
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * n), pa.array([chunk] * n, pa.int32()), pa.array(base + np.arange(n), pa.int64()), pa.array(edge),
             pa.array([*depths.tolist(), end], pa.int32()), pa.array(seps, pa.string()),
             pa.array([data[a:b] for a, b in zip(starts.tolist(), stops.tolist())], pa.binary())],
            names=["file", "chunk", "id", "edge", "depth", "sep", "data"])


def _planned(spark: SparkSession, path: str, glob: str, size: int) -> list[list]:
    """(file, chunk, start, stop, in string, escaped, depth, fragments before) of all ranges of the files."""
    ranges = [[file, k, a, min(a + size, length)] for file, length in files(path, glob)
              for k, a in enumerate(range(0, length, size))]
    several = {r[0] for r in ranges if r[1]}
    found = {}
    if several:
        asked = json.dumps([r for r in ranges if r[0] in several])
        rows = (spark.read.format("json_ranges").option("what", "summaries").option("ranges", asked)
                .option("size", size).load(path))
        found = {(r.file, r.chunk): json.loads(r.summary) for r in rows.collect()}  # one row per range, as a plan has
    out = []
    for r in ranges:
        in_string, escaped, depth, base = state if r[1] else (False, False, 0, 0)
        out.append([*r, in_string, escaped, depth, base])
        if r[0] in several:
            a, b, change, counts = found[r[0], r[1]][_WAYS.index((in_string, escaped))]
            level = Counter({(k, d): m for k, d, m in counts})
            cuts = sum(m for (k, d), m in level.items() if depth + d <= (1 if k == 0 else 2))
            state = (a, b, depth + change, base + cuts)
    return out


def json_fragments(spark: SparkSession, path: str, glob: str, size: int = RANGE) -> DataFrame:
    """(file, id, depth, sep, text): the documents of all files, cut at the brackets and commas of
    their outermost two levels; `sep` ends the fragment, `depth` is that before it."""
    spark.dataSource.register(JsonRanges)
    rows = (spark.read.format("json_ranges").option("what", "fragments")
            .option("ranges", json.dumps(_planned(spark, path, glob, size))).option("size", size).load(path))
    rows = rows.withColumn("text", F.col("data").cast("string"))
    whole = rows.filter("not edge").select("file", "id", "depth", "sep", "text")
    # the last piece of a fragment is the one with a separator
    pieces = F.array_sort(F.collect_list(F.struct("chunk", "data")))
    data = F.aggregate(pieces, F.unhex(F.lit("")), lambda a, p: F.concat(a, p["data"]))
    joined = rows.filter("edge").groupBy("file", "id").agg(
        F.max(F.when(F.col("sep").isNotNull(), F.col("depth"))).alias("depth"), F.max("sep").alias("sep"),
        data.cast("string").alias("text")).filter("sep is not null")
    return whole.unionByName(joined.select(whole.columns))


_KEY = r'^\s*"((?:[^"\\]|\\.)*)"\s*:\s*'


def json_entries(fragments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scalars, spans, entries) of documents that are maps: (file, key, value) of plain values,
    (file, key) of the maps and lists below a key, and (file, key, id, name, value) of the
    entries of these, all as JSON text."""
    key, value = F.regexp_extract("text", _KEY, 1), F.regexp_replace("text", _KEY, "")
    outer = fragments.filter("depth = 1")
    scalars = outer.filter(F.col("sep").isin(",", "}") & F.col("text").rlike(r"\S")).select("file", key.alias("key"), value.alias("value"))
    # a document has a few keys; each opens a span of ids
    spans = outer.filter("sep in ('{', '[')").select("file", F.col("id").alias("_from"), key.alias("key"), F.col("sep").alias("_sep"))
    spans = spans.withColumn("_to", F.lead("_from").over(Window.partitionBy("file").orderBy("_from")))
    inner = fragments.filter((F.col("depth") == 2) & F.col("text").rlike(r"\S"))
    # a large document would meet in one task; there is a row for each outer key of a file, and the plan knows all files
    found = inner.join(F.broadcast(spans), "file").filter("id > _from and (_to is null or id < _to)")
    is_map = F.col("_sep") == "{"
    return scalars, spans.select("file", "key"), found.select("file", "key", "id", F.when(is_map, key).alias("name"),
                                                              F.when(is_map, value).otherwise(F.col("text")).alias("value"))
