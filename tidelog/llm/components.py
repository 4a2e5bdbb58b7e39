"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import durable, spread_join


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that ``links`` names; root is the smallest node reachable.

    Alternating large-star and small-star rounds: each node's neighbours are tied to the
    smallest of them, which halves path lengths. Only a minimum per node is kept, and the links
    of a hub with very many are spread over tasks. Self-links, nulls and repeated
    links are ignored. Each round is checkpointed.
    """
    edges = durable(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        least = near.select("u", F.least("u", "m").alias("m"))
        up = spread_join(both.where("v > u"), least, ["u"], ["v"], total=before[0], counts=near)
        large = durable(up.select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        joined = spread_join(large, lowest.select("hi", "m"), ["hi"], ["lo"], total=before[0], counts=lowest)
        ties = F.array(F.struct("hi", F.col("m").alias("lo")), F.when(F.col("lo") != F.col("m"), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))))
        edges = durable(joined.select(F.explode(ties).alias("tie")).where("tie IS NOT NULL").select("tie.*").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
