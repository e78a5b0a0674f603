"""Slot formats and requirement comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _occupations(column: Column, kind: T.DataType) -> Column:
    """Indexes, (index, occupation) pairs or structs to occupation structs."""
    item = kind.elementType
    if isinstance(item, T.StructType):
        index = lambda r: r["index"].cast("int")
        share = lambda r: r.occupation.cast("double")
    elif isinstance(item, T.ArrayType):
        index = lambda r: r[0].cast("int")
        share = lambda r: r[1].cast("double")
    else:
        index = lambda r: r.cast("int")
        share = lambda r: F.lit(1.0)
    return F.transform(column, lambda r: F.struct(index(r).alias("index"), share(r).alias("occupation")))


def slots_to_new(df: DataFrame, column: str = "slots") -> DataFrame:
    """Slots with occupations and version 1; a set version stays."""
    fields = {f.name: f.dataType for f in df.schema[column].dataType.elementType.fields}

    def convert(slot):
        version = F.greatest(slot.version, F.lit(1)) if "version" in fields else F.lit(1)
        return F.struct(
            _occupations(slot.cores, fields["cores"]).alias("cores"),
            _occupations(slot.gpus, fields["gpus"]).alias("gpus"),
            slot.lfs.alias("lfs"), slot.mem.alias("mem"),
            slot.node_index.alias("node_index"), slot.node_name.alias("node_name"),
            version.cast("int").alias("version"))

    return df.withColumn(column, F.transform(column, convert))


def slots_to_old(df: DataFrame, column: str = "slots") -> DataFrame:
    """Slots with one list per index, as old readers expect; no version."""
    only_index = lambda c: F.transform(c, lambda r: F.array(r["index"]))
    return df.withColumn(column, F.transform(column, lambda s: F.struct(
        only_index(s.cores).alias("cores"), only_index(s.gpus).alias("gpus"),
        F.coalesce(s.lfs, F.lit(0)).alias("lfs"), F.coalesce(s.mem, F.lit(0)).alias("mem"),
        s.node_index.alias("node_index"), s.node_name.alias("node_name"))))


#: fields of a rank requirement that are compared; NUMA settings are not
REQUIREMENT = ["n_cores", "n_gpus", "lfs", "mem", "core_occupation", "gpu_occupation"]


def compare(a: Column, b: Column) -> Column:
    """Struct(le, ge, eq): is each field of a at most, at least, equal to b's."""
    every = lambda test: reduce(lambda x, y: x & y, [test(a[f], b[f]) for f in REQUIREMENT])
    return F.struct(every(lambda x, y: x <= y).alias("le"), every(lambda x, y: x >= y).alias("ge"),
                    every(lambda x, y: x == y).alias("eq"))


def dominates(a: Column, b: Column) -> Column:
    return compare(a, b)["ge"]
