"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.session import written


def components(links: DataFrame) -> DataFrame:
    """For links (a, b) between long ids: each linked id as ``id`` with the smallest id it can reach as ``component``.

    Alternates two steps until nothing changes: every node links its larger neighbours, then its smaller ones and itself,
    to the smallest node of its neighbourhood. The rounds grow with the logarithm of the longest path. A hub's links are
    combined before the shuffle for the minimum and split by Spark in the join, each round is a table in the shared folder.
    Loops and repeated links are allowed, null ends are left out.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v and a is not null and b is not null").distinct()
    edges = written(edges, "links")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = written(small.where("u <> v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
