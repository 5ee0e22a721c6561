"""Row numbers over a whole table without sending it to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_rank(df: DataFrame, value: str, ties: list[str], name: str, rows_of_range: int = 1 << 20) -> DataFrame:
    """``name``: 1-based rank by a numeric column and ties. Ranges come from approximate quantiles, offsets from their counts.

    There is a range for about ``rows_of_range`` rows, 64 at least."""
    buckets = max(64, df.count() // rows_of_range)
    bounds = df.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], max(10000, 10 * buckets))).first()[0]
    if not bounds:
        return df.withColumn(name, F.lit(None).cast("long"))
    edges = F.array(*[F.lit(b) for b in sorted(set(bounds))])
    held = df.withColumn("o_bucket", F.size(F.filter(edges, lambda b: b < F.col(value))))
    counts = dict(held.groupBy("o_bucket").count().collect())  # at most ``buckets`` rows
    before, total = {}, 0
    for k in sorted(counts):
        before[k], total = total, total + counts[k]
    offsets = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    local = F.row_number().over(Window.partitionBy("o_bucket").orderBy(value, *ties))
    return held.withColumn(name, (local + F.element_at(offsets, F.col("o_bucket"))).cast("long")).drop("o_bucket")


def running(df: DataFrame, value: str, ties: list[str], weight: str, name: str, rows_of_range: int = 1 << 20) -> DataFrame:
    """``name``: the sum of ``weight`` over all rows before each one, by a numeric column and ties. Read in ranges like ``with_rank``."""
    buckets = max(64, df.count() // rows_of_range)
    bounds = df.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], max(10000, 10 * buckets))).first()[0] or []
    edges = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<double>")
    held = df.withColumn("o_bucket", F.size(F.filter(edges, lambda b: b < F.col(value))))
    sums = dict(held.groupBy("o_bucket").agg(F.sum(weight)).collect())  # at most ``buckets`` rows
    before, total = {}, 0
    for k in sorted(sums):
        before[k], total = total, total + sums[k]
    offsets = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    local = F.coalesce(F.sum(weight).over(Window.partitionBy("o_bucket").orderBy(value, *ties).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn(name, local + F.element_at(offsets, F.col("o_bucket"))).drop("o_bucket")
