"""Values drawn from a column's own distribution: the inverse of its cumulative counts, over all its values.

Counts of distinct values become stretches of ranks; a row's draw is a rank, and the stretch that holds it gives the
value. Stretches are joined by bucket of ranks, about one for each distinct value, so a table of any size does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.functions.keyed import uniform, weighted_pick
from quillmask.functions.ordinals import running
from quillmask.functions.text import cell, is_missing_sentinel, numeric_token, trimmed

NUMERIC = ("INTEGER", "DECIMAL", "PERCENTAGE", "CURRENCY_LIKE")
#: Stands for the last rank in shares, which lie in [0, 1).
LAST_SHARE = 1.0 - 1e-12


@dataclass(frozen=True)
class NumberFormat:
    """How a column writes numbers, and between which it lies. ``places``: (decimal places, weight)."""

    kind: str
    places: tuple[tuple[int, float], ...] = ((0, 1.0),)
    marker: str = "$"
    marker_last: bool = False
    digits: int = 0  # of a sample with a leading zero
    low: float | None = None
    high: float | None = None

    @classmethod
    def of(cls, source: DataFrame, column: str, kind: str) -> NumberFormat:
        token = numeric_token(cell(source, column))
        t = source.select(token.alias("t"), trimmed(cell(source, column)).alias("v")).where("t is not null")
        places = t.groupBy("t.decimal_places").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "decimal_places").limit(12).collect()
        said = t.agg(F.min("t.value").alias("low"), F.max("t.value").alias("high"), F.min_by(F.struct("t.*", "v"), F.xxhash64("v")).alias("sample")).first()
        s = said["sample"]
        if s is None:
            return cls(kind)
        marker = s["currency_marker"] or "$"
        return cls(kind, ((0, 1.0),) if kind == "INTEGER" else tuple((r[0], float(r[1])) for r in places), marker, s["v"].endswith(marker), s["digit_count"] if s["leading_zero"] else 0, said["low"], said["high"])

    def written(self, x: Column, seed: int, scope: str, *row: Column, extreme: Column | None = None) -> Column:
        """x rounded half up to drawn decimal places, kept between the source's extremes, and written as the column does.

        Where ``extreme``, the source's least or greatest number keeps all its decimal places (INTEGER: is rounded as others)."""
        chosen = weighted_pick(seed, f"{scope}:places", [(str(p), w) for p, w in self.places], *row) if len(self.places) > 1 else F.lit(str(self.places[0][0]))
        out = F.lit(None).cast("string")
        for places, _ in self.places:
            out = F.when(chosen == str(places), self._core(x, places)).otherwise(out)
        if extreme is not None and self.kind != "INTEGER":
            for end in {self.low, self.high} - {None}:
                needed = max(0, -Decimal(repr(end)).normalize().as_tuple().exponent)
                for places, _ in self.places:
                    out = F.when(extreme & (x == end) & (chosen == str(places)), f"{Decimal(repr(end)):.{max(places, needed)}f}").otherwise(out)
        if self.kind == "PERCENTAGE":
            return F.concat(out, F.lit("%"))
        if self.kind == "CURRENCY_LIKE":
            return F.concat(out, F.lit(f" {self.marker}")) if self.marker_last else F.concat(F.lit(self.marker), out)
        return out

    def _core(self, x: Column, places: int) -> Column:
        step = 10.0**places
        rounded = F.floor(x * step + 0.5).cast("double")
        if self.low is not None:
            least, most = math.ceil(self.low * step - 1e-9), math.floor(self.high * step + 1e-9)
            if least <= most:
                rounded = F.least(F.greatest(rounded, F.lit(float(least))), F.lit(float(most)))
        number = (rounded.cast("decimal(38,0)") / F.lit(10**places)).cast(f"decimal(38,{places})").cast("string") if places else rounded.cast("decimal(38,0)").cast("string")
        if not self.digits or self.kind != "INTEGER":
            return number
        bare = F.regexp_replace(number, "^-", "")
        return F.concat(F.when(number.startswith("-"), "-").otherwise(""), F.lpad(bare, F.greatest(F.length(bare), F.lit(self.digits)), "0"))


def stretches(source: DataFrame, column: str, numeric: bool) -> DataFrame:
    """r_value, r_next (the next larger number), r_from, r_to: the ranks of each value. Missing marks aren't numbers."""
    v = trimmed(cell(source, column))
    counts = source.select(v.alias("r_value")).where("r_value <> ''").groupBy("r_value").agg(F.count(F.lit(1)).alias("n"))
    if not numeric:
        placed = running(counts.withColumn("o", F.xxhash64("r_value").cast("double")), "o", ["r_value"], "n", "r_from")
        return placed.select("r_value", F.lit(None).cast("double").alias("r_next"), "r_from", (F.col("r_from") + F.col("n")).alias("r_to"))
    numbers = counts.withColumn("o", numeric_token(F.col("r_value"))["value"]).where("o is not null").groupBy("o").agg(F.sum("n").alias("n"))
    placed = running(numbers, "o", [], "n", "r_from").withColumn("r_to", F.col("r_from") + F.col("n"))
    after = placed.select(F.col("r_from").alias("r_to"), F.col("o").alias("r_next"))
    return placed.join(after, "r_to", "left").select(F.col("o").alias("r_value"), F.coalesce("r_next", "o").alias("r_next"), "r_from", "r_to")


def drawn(df: DataFrame, column: str, kind: str, source: DataFrame, name: str, row: Column, seed: int, scope: str, share: Column | None = None) -> DataFrame:
    """``df`` with ``name``: a draw for each row from the values of ``source``; missing marks stay. ``share``: the draw's place in [0, 1), if given."""
    numeric = kind in NUMERIC
    u = uniform(seed, scope, row) if share is None else F.when(share >= LAST_SHARE, 1.0).otherwise(share)
    table = stretches(source, column, numeric)
    size = table.agg(F.count(F.lit(1)).alias("k"), F.max("r_to").alias("n"), F.count_if(F.lit(True)).alias("d")).first()
    if not size["n"]:
        return df.withColumn(name, trimmed(cell(df, column)))
    n, buckets = size["n"], max(64, size["k"])
    smooth = numeric and (kind != "INTEGER" or size["k"] >= 0.2 * n)
    at = u * F.lit(float(n - 1)) if smooth else F.least(F.floor(u * F.lit(float(n))), F.lit(n - 1)).cast("double")
    bucket = lambda c: F.floor(c * F.lit(buckets / n)).cast("long")
    table = table.withColumn("r_bucket", F.explode(F.sequence(bucket(F.col("r_from")), bucket(F.col("r_to")))))
    placed = df.withColumn("r_at", at).withColumn("r_rank", F.floor("r_at")).withColumn("r_spot", bucket(F.col("r_rank")))
    met = placed.join(table, (F.col("r_spot") == F.col("r_bucket")) & (F.col("r_rank") >= F.col("r_from")) & (F.col("r_rank") < F.col("r_to")), "left")
    if numeric:
        upper = F.when(F.ceil("r_at") < F.col("r_to"), F.col("r_value")).otherwise(F.col("r_next"))
        x = F.col("r_value") + (upper - F.col("r_value")) * (F.col("r_at") - F.col("r_rank"))
        extreme = None if share is None else (F.col("r_at") == 0) | (F.col("r_at") == n - 1)
        value = NumberFormat.of(source, column, kind).written(x, seed, scope, row, extreme=extreme)
    else:
        value = F.col("r_value")
    out = F.when(is_missing_sentinel(F.col(f"`{column}`")), trimmed(cell(df, column))).otherwise(value)
    return met.withColumn(name, out).drop("r_at", "r_rank", "r_spot", "r_bucket", "r_value", "r_next", "r_from", "r_to")


def coprime_stride(n: int) -> int:
    """A step near the golden section of n that visits all n strata once."""
    step = max(1, round(n * 0.6180339887498949))
    while math.gcd(step, n) != 1:
        step += 1
    return step


def stratified_share(ordinal: Column, n: int, seed: int, scope: str, extremes: bool = False) -> Column:
    """Shares for n rows such that each n-th part of [0, 1) has one; ``extremes`` puts the first at 0 and the last at 1."""
    offset = seed % n
    stratum = F.pmod(ordinal * F.lit(coprime_stride(n)) + F.lit(offset), F.lit(n))
    inside = (stratum + uniform(seed, f"{scope}:stratum", ordinal)) / F.lit(float(n))
    return F.when(stratum == 0, 0.0).when(stratum == n - 1, LAST_SHARE).otherwise(inside) if extremes else inside
