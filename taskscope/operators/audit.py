"""Bags of tasks, order and placement rules, checked on finished runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskscope.session import staged


def bag_status(tasks: DataFrame, keys=("ns",)) -> DataFrame:
    """Per bag: members, declared size, and what is wrong with it."""
    bags = tasks.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"),
                                    F.min("size").alias("size"), F.max("size").alias("_most"))
    status = (F.when(F.col("size") != F.col("_most"), F.lit("inconsistent"))
              .when(F.col("members") > F.col("size"), F.lit("over"))
              .when(F.col("members") == F.col("size"), F.lit("complete")).otherwise(F.lit("open")))
    return bags.withColumn("status", status).drop("_most")


def bag_requirement(tasks: DataFrame, keys=("ns",)) -> DataFrame:
    """Cores and gpus a bag needs at once; one core is added for the bag."""
    return tasks.groupBy(*keys).agg(
        (F.sum(F.col("ranks") * F.col("cores_per_rank")) + 1).alias("cores"),
        F.sum(F.col("ranks") * F.col("gpus_per_rank")).alias("gpus"))


def duplicate_uids(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def order_audit(tasks: DataFrame) -> DataFrame:
    """Bags that started before the bag in front of them was done.

    `tasks`: ns, bag_order, size, start, done (null when not reached).  After
    one aggregation a bag is one row and meets its predecessor by an equi join.
    """
    bags = tasks.groupBy("ns", "bag_order").agg(
        F.min("start").alias("start"), F.max("done").alias("_done"),
        F.count("done").alias("_n"), F.max("size").alias("_size"))
    front = bags.select("ns", (F.col("bag_order") + 1).alias("bag_order"),
                        F.when(F.col("_n") >= F.col("_size"), F.col("_done")).alias("front_done"),
                        F.lit(True).alias("_front"))
    joined = bags.filter("bag_order > 0 AND start IS NOT NULL").join(front, ["ns", "bag_order"], "left")
    reason = (F.when(F.col("_front").isNull(), F.lit("missing"))
              .when(F.col("front_done").isNull(), F.lit("open"))
              .when(F.col("start") < F.col("front_done"), F.lit("early")))
    return (joined.withColumn("reason", reason).filter("reason is not null")
            .select("ns", "bag_order", "start", "front_done", "reason"))


def colocation_audit(tasks: DataFrame) -> DataFrame:
    """(rule, tag, uid, node): placements that break a tag's rules.

    `tasks`: uid, tag, node, start, whole (all of the tag on one node) and
    exclusive (no other tag on its nodes).  Rules: `moved` off the nodes of the
    tag's first task, `spread` over nodes, `shared` node.  Tasks are written once, as
    each rule reads them.
    """
    tagged = staged(tasks.filter("tag is not null").select("uid", "tag", "node", "start", "whole", "exclusive"), "tagged")
    first = tagged.groupBy("tag").agg(F.min_by("uid", F.struct("start", "uid")).alias("uid"))
    home = tagged.join(first, ["tag", "uid"], "left_semi").select("tag", "node").distinct()
    moved = tagged.join(home, ["tag", "node"], "left_anti").select(
        F.lit("moved").alias("rule"), "tag", "uid", "node")
    none = F.lit(None).cast("string")
    spread = (tagged.filter("whole").groupBy("tag")
              .agg(F.min("node").alias("_a"), F.max("node").alias("_b")).filter("_a <> _b")
              .select(F.lit("spread").alias("rule"), "tag", none.alias("uid"),
                      F.lit(None).cast(tasks.schema["node"].dataType).alias("node")))
    # per node and tag one row, then the range of tags tells whether it is shared
    tags = tagged.groupBy("node", "tag").agg(F.max("exclusive").alias("exclusive"))
    several = (tags.groupBy("node").agg(F.min("tag").alias("_a"), F.max("tag").alias("_b"))
               .filter("_a <> _b").select("node"))
    shared = tags.filter("exclusive").join(several, "node", "left_semi").select(
        F.lit("shared").alias("rule"), "tag", none.alias("uid"), "node")
    return moved.unionByName(spread).unionByName(shared)
