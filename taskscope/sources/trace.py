"""Trace files: text in, events out; Parquet for everything after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskscope import schema


def read_lines(spark: SparkSession, path, glob: str = "*") -> DataFrame:
    """Lines of all files below a path: file, block, pos, value.

    `(block, pos)` orders the lines of a file; files are split and read in
    parallel.
    """
    text = (spark.read.option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).text(path))
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        "value")


def parse_event(value: Column) -> list[Column]:
    """Seven comma-separated fields; the last one keeps its commas."""
    parts = F.split(value, ",", 7)
    text = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    names = schema.EVENT.fieldNames()
    return [F.get(parts, F.lit(0)).try_cast("double").alias("time")] + [
        text(i).alias(name) for i, name in enumerate(names) if i]


def _is_event(value: Column) -> Column:
    return ~value.startswith("#") & (F.trim(value) != "")


def read_trace(spark: SparkSession, path, glob: str = "*.prof") -> DataFrame:
    """Events of all trace files below a path, with the file they come from."""
    lines = read_lines(spark, path, glob).filter(_is_event(F.col("value")))
    return lines.select("file", "block", "pos", *parse_event(F.col("value"))) \
                .filter(F.col("time").isNotNull())


def read_trace_stream(spark: SparkSession, path, glob: str = "*.prof",
                      files_per_trigger: int | None = None) -> DataFrame:
    reader = (spark.readStream.option("recursiveFileLookup", "true")
              .option("pathGlobFilter", glob))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return (reader.text(path).filter(_is_event(F.col("value")))
            .select(*parse_event(F.col("value"))).filter(F.col("time").isNotNull()))


def write_trace_text(events: DataFrame, path: str, by: str | None = None) -> None:
    """Trace files in the text form; `by` names a column that makes folders."""
    line = F.concat_ws(",", F.format_string("%.6f", "time"),
                       *[F.coalesce(F.col(c), F.lit("")) for c in schema.EVENT.fieldNames()[1:]])
    cols = [line.alias("value")] + ([F.col(by)] if by else [])
    writer = events.select(*cols).write
    if by:
        writer = writer.partitionBy(by)
    writer.text(path)


def append_trace(events: DataFrame, path: str) -> None:
    """Append events; one folder per session, so a session is read alone."""
    writer = events.write.mode("append")
    if "sid" in events.columns:
        writer = writer.partitionBy("sid")
    writer.parquet(path)
