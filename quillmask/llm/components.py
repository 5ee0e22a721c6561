"""Connected components of an edge table by alternating large-star and small-star steps (public algorithm).

All steps are joins and grouped minima over written tables: no component is ever gathered, and the number of rounds
grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.common import dropped, written


def _stars(pairs: DataFrame, larger: bool) -> DataFrame:
    """pairs (u, v): each u links its larger (or smaller) neighbours to the least of its neighbourhood."""
    if larger:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, base: str, most_rounds: int = 60) -> DataFrame:
    """u, root for every node of ``edges`` (u, v long) that isn't its component's least node."""
    now = written(edges.where("u <> v").distinct(), base, "edges-0")
    seen = None
    for k in range(1, most_rounds + 1):
        new = written(_stars(_stars(now, True), False), base, f"edges-{k}")
        mark = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        dropped(edges.sparkSession, f"{base}/edges-{k - 1}")
        now = new
        if mark == seen:
            return now.select("u", F.col("v").alias("root"))
        seen = mark
    raise RuntimeError("components did not converge")
