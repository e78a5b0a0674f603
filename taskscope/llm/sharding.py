"""Equal shards by histogram sort, in DataFrame and SQL functions only.

Rows are ordered by (hash of the text, doc_id), so equal texts are neighbours.  Bytes
below candidate boundaries are counted exactly over all partitions; a cell that holds
a wanted boundary, or too many rows, gets finer candidates between the least and the
greatest key it really holds: first by hash, within one text by doc_id.  When each
boundary is within `TOLERANCE` of a shard, or between two single keys, every row's
cell tells its shard and how many rows of the shard lie in earlier cells, and rows
move once, cell by cell, to be numbered.

The driver holds counts of cells, at most `CELLS` plus `FINER` for each refined one;
how many are refined is bounded by the number of shards and by `CELLS`, not by the
rows.  A text that a third of the rows repeat is cut by doc_id like any other range.

Nulls: a null text has 16 bytes and counts as one text; null ids come first.  Rows
that agree in text and id share a key: they stay together, in any order, and their
slots differ.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskscope.session import staged

SHARDS = 40
#: Candidates of the first round, and for each cell that is cut again (powers of two).
CELL_BITS, FINER_BITS = 12, 8
CELLS, FINER = 1 << CELL_BITS, 1 << FINER_BITS
#: Part of a shard's bytes that a boundary may be off.
TOLERANCE = 0.002
#: Rows of one cell over the mean of the first round's cells, before it is cut again.
CROWDED = 8
_OVERHEAD = 16


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the key: a hash of 63 bits, and doc_id without nulls.

    Ids that are no integers stand in the key as their hash.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    number = F.col("doc_id")
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        number = F.when(number.isNotNull(), F.xxhash64(number.cast("string")))
    return docs.select(
        "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + _OVERHEAD).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1)).alias("_h"),
        F.coalesce(number.cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)")).alias("_d"))


def _counted(rows: DataFrame, *cells: str) -> list:
    """Rows, bytes and key range of each cell, from all partitions."""
    return rows.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.min("_h").alias("h0"), F.max("_h").alias("h1"),
        F.min("_d").alias("d0"), F.max("_d").alias("d1")).collect()


def leaves(rows: DataFrame, shards: int) -> tuple[DataFrame, list[dict]]:
    """`rows` with the number of each row's cell, and all cells in order of their keys."""
    spark = rows.sparkSession
    rows = rows.withColumn("_cell", F.shiftright("_h", 63 - CELL_BITS).cast("long"))
    cells = {r["_cell"]: r.asDict() | {"path": (r["_cell"],)} for r in _counted(rows, "_cell")}
    total = sum(c["b"] for c in cells.values())
    share = total / shards
    crowded = CROWDED * max(1, sum(c["n"] for c in cells.values()) / CELLS)
    number = CELLS
    while True:
        ordered = sorted(cells.values(), key=lambda c: c["path"])
        below, chosen = 0, []
        for c in ordered:
            j = int(below // share) + 1
            crossed = below < j * share < below + c["b"] and j < shards
            off = min(j * share - below, below + c["b"] - j * share)
            one_key = c["h0"] == c["h1"] and c["d0"] == c["d1"]
            if not one_key and (crossed and off > TOLERANCE * share or c["n"] > crowded):
                chosen.append(c)
            below += c["b"]
        if not chosen:
            return rows, ordered
        cuts = []
        for c in chosen:
            by_hash = c["h0"] < c["h1"]
            low, high = (c["h0"], c["h1"]) if by_hash else (int(c["d0"]), int(c["d1"]))
            cuts.append((c["_cell"], by_hash, str(low), str((high - low) // FINER + 1), number))
            number += FINER
        finer = spark.createDataFrame(cuts, "_cell long, _by boolean, _low string, _width string, _first long") \
            .withColumns({k: F.col(k).cast("decimal(20,0)") for k in ("_low", "_width")})
        step = F.expr("CAST((CASE WHEN _by THEN CAST(_h AS DECIMAL(20,0)) ELSE _d END - _low) div _width AS BIGINT)")
        rows = (rows.join(F.broadcast(finer), "_cell", "left")
                .withColumn("_cell", F.when(F.col("_first").isNull(), F.col("_cell")).otherwise(F.col("_first") + step))
                .drop("_by", "_low", "_width", "_first"))
        news = rows.filter(F.col("_cell") >= F.lit(cuts[0][4]))
        of = {cut[4] + k: cells[cut[0]]["path"] + (k,) for cut in cuts for k in range(FINER)}
        for cut in cuts:
            del cells[cut[0]]
        cells |= {r["_cell"]: r.asDict() | {"path": of[r["_cell"]]} for r in _counted(news, "_cell")}


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot (from 0 without gaps), grown_shard (null)."""
    spark = docs.sparkSession
    rows, cells = leaves(staged(keyed(docs), "shard-keys"), shards)
    total = sum(c["b"] for c in cells)
    plan, below, slot, at = [], 0, 0, 0
    for c in cells:
        # a cell goes where its middle lies, so a boundary is off by half a cell at most
        now = min(int((below + c["b"] / 2) * shards // total), shards - 1)
        if now != at:
            at, slot = now, 0
        plan.append((c["_cell"], at, slot))
        below += c["b"]
        slot += c["n"]
    placed = spark.createDataFrame(plan, "_cell long, shard int, _before long")
    order = Window.partitionBy("_cell").orderBy("_h", "_d")
    return (rows.withColumn("_at", F.row_number().over(order))
            .join(F.broadcast(placed), "_cell")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("_before") + F.col("_at") - 1).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
