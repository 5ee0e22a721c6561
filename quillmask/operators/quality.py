"""Validation and quality checks as queries: keys, duplicates, reuse, dependencies, combination risk, distances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.functions.text import text, trimmed, value_shape

# Base tolerances of comparisons between source and output.
TOLERANCES = {"empty": 0.05, "category": 0.15, "support": 0.7, "mean": 0.08, "quantile": 0.10, "tails": 0.12}
ZONES = ("structure", "privacy", "fidelity", "relationships")


def adaptive_tolerance(base: float, n: int) -> float:
    return max(base, 3 / math.sqrt(n)) if n > 0 else base


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key, blank included, no parent has."""
    parents = parent.select(text(parent[parent_key]).alias("q_parent")).where("q_parent <> ''").distinct()
    return child.join(parents, text(child[key]) == F.col("q_parent"), "left_anti")


def cardinality_violations(child: DataFrame, key: str, parent: DataFrame, parent_key: str, low: int, high: int) -> DataFrame:
    """parent_key, children for parents (and unknown keys) with fewer or more children than allowed."""
    counts = child.groupBy(text(child[key]).alias("parent_key")).agg(F.count(F.lit(1)).alias("children"))
    parents = parent.select(text(parent[parent_key]).alias("parent_key")).distinct()
    return parents.join(counts, "parent_key", "full_outer").select("parent_key", F.coalesce("children", F.lit(0)).alias("children")).where(~F.col("children").between(low, high))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """duplicate_rows: rows beyond the first of each non-blank key."""
    k = trimmed(df[key])
    return df.where(k != "").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, filled, distinct, duplicate_rate."""
    from quillmask.operators.profile import value_counts

    counts = value_counts(df, columns).where("value <> ''").groupBy("column_name").agg(F.sum("n").alias("filled"), F.count(F.lit(1)).alias("distinct"))
    return counts.withColumn("duplicate_rate", 1 - F.col("distinct") / F.col("filled"))


def combination_risk(df: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """One row: groups of equal quasi-identifiers, those smaller than k, the rows in them, the smallest size."""
    sizes = df.groupBy(*[trimmed(df[c]).alias(f"q{i}") for i, c in enumerate(columns)]).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") < k).alias("small_groups"), F.coalesce(F.sum(F.when(F.col("n") < k, F.col("n"))), F.lit(0)).alias("small_rows"), F.min("n").alias("smallest"))


def category_distance(source: DataFrame, output: DataFrame, column: str) -> DataFrame:
    """distance: half the summed differences of relative frequencies of non-empty values, at most 1."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.select(trimmed(df[column]).alias("value")).where("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        total = counts.agg(F.sum("n").alias("total"))
        return counts.crossJoin(F.broadcast(total)).select("value", (F.col("n") / F.col("total")).alias(name))  # total is one row

    both = shares(source, "p").join(shares(output, "q"), "value", "full_outer")
    return both.agg(F.least(F.lit(1.0), F.coalesce(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))), F.lit(0.0)) / 2).alias("distance"))


def numeric_summary(df: DataFrame, column: str, prefix: str) -> DataFrame:
    x = df[column].cast("double")
    return df.agg(F.count(x).alias(f"{prefix}_n"), F.avg(x).alias(f"{prefix}_mean"), F.min(x).alias(f"{prefix}_min"), F.max(x).alias(f"{prefix}_max"), F.percentile(x, F.array(*[F.lit(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias(f"{prefix}_q"))


def numeric_comparison(source: DataFrame, output: DataFrame, column: str) -> DataFrame:
    """One row: shift of mean and of each quantile in units of the source's robust spread, and the verdict."""
    both = numeric_summary(source, column, "s").crossJoin(numeric_summary(output, column, "o"))  # one row each
    spread = F.greatest(F.abs(F.col("s_q")[4] - F.col("s_q")[0]), 0.1 * (F.col("s_max") - F.col("s_min")), 0.01 * F.abs("s_mean"), F.lit(1e-12))
    shift = F.array_max(F.zip_with("s_q", "o_q", lambda a, b: F.abs(a - b)))
    slack = lambda base: F.greatest(F.lit(base), 3 / F.sqrt(F.col("o_n")))
    out = both.select((F.abs(F.col("s_mean") - F.col("o_mean")) / spread).alias("mean_shift"), (shift / spread).alias("quantile_shift"), ((F.col("o_min") >= F.col("s_min")) & (F.col("o_max") <= F.col("s_max"))).alias("in_range"), slack(TOLERANCES["mean"]).alias("mt"), slack(TOLERANCES["quantile"]).alias("qt"))
    return out.select("mean_shift", "quantile_shift", "in_range", F.when((F.col("mean_shift") <= F.col("mt")) & (F.col("quantile_shift") <= F.col("qt")) & F.col("in_range"), "PASS").otherwise("REVIEW").alias("verdict"))


def expected_distinct(source: DataFrame, column: str, n: int) -> DataFrame:
    """expected: distinct values that n independent draws from the source's values would show."""
    counts = source.select(trimmed(source[column]).alias("value")).where("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("total"))
    p = F.col("c") / F.col("total")
    return counts.crossJoin(F.broadcast(total)).agg(F.sum(F.when(p >= 1, 1.0).otherwise(1 - F.exp(F.lit(float(n)) * F.log1p(-p)))).alias("expected"))


def source_reuse(output: DataFrame, source: DataFrame, column: str) -> DataFrame:
    """reused, output_distinct: distinct output values that the source has too."""
    values = lambda df: df.select(trimmed(df[column]).alias("value")).where("value <> ''").distinct()
    out, src = values(output), values(source)
    return out.join(src.withColumn("hit", F.lit(1)), "value", "left").agg(F.count("hit").alias("reused"), F.count(F.lit(1)).alias("output_distinct"))


def reuse_allowance(space: float, source_distinct: int, output_distinct: int) -> int:
    """Chance collisions that 99.9 % of runs stay within: the upper quantile of a Poisson count."""
    mean = output_distinct * source_distinct / space if space > 0 else 0.0
    k, term = 0, math.exp(-mean)
    total = term
    while total < 0.999 and k < 100_000:
        k += 1
        term *= mean / k
        total += term
    return k


def pattern_space(shape: str) -> float:
    """How many values a shape of A, a, L and 9 can take."""
    return float(math.prod({"A": 26, "a": 26, "L": 26, "9": 10}.get(c, 1) for c in shape))


def dependency_violations(df: DataFrame, code: str, description: str, order: Column) -> DataFrame:
    """Rows whose description differs from the first one seen with their code, and that one as first_description."""
    first = df.groupBy(df[code].alias("q_code")).agg(F.min_by(F.struct(df[description].alias("d")), order).alias("q_first"))
    met = df.join(first, df[code].eqNullSafe(F.col("q_code")))
    return met.where(~F.col("q_first.d").eqNullSafe(df[description])).select(*[df[c] for c in df.columns], F.col("q_first.d").alias("first_description"))


def date_order(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """status, n: VALID, VIOLATION, or NOT_EVALUATED where a date is missing."""
    status = F.when(start.isNull() | end.isNull(), "NOT_EVALUATED").when(start <= end, "VALID").otherwise("VIOLATION")
    return df.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def shape_conformance(output: DataFrame, column: str, shapes: list[str]) -> DataFrame:
    """conforming, checked: non-empty values with one of the expected shapes."""
    v = trimmed(output[column])
    return output.agg(F.count_if((v != "") & value_shape(v).isin(*shapes)).alias("conforming"), F.count_if(v != "").alias("checked"))


def linked_violations(child: DataFrame, fk: str, parent: DataFrame, pk: str, copied: list[tuple[str, str]], order: str | None = None, dates: list[tuple[str, str, int, int]] = ()) -> DataFrame:
    """column_name, violations of looked-up columns, and of dates that must lie from low to high days after a parent's.

    Of parents with one key the last in ``order`` counts, or else the one whose looked-up values are greatest.
    ``dates``: (child column, parent column, low, high)."""
    wanted = [p for _, p in copied] + [d[1] for d in dates]
    held = F.struct(*[text(parent[p]).alias(f"q_{i}") for i, p in enumerate(wanted)])
    parents = parent.groupBy(text(parent[pk]).alias("q_k")).agg(F.max_by(held, parent[order] if order else held).alias("q_p"))
    joined = child.join(parents, text(child[fk]) == F.col("q_k"), "left")
    bad = [(c, text(child[c]) != F.coalesce(F.col(f"q_p.q_{i}"), F.lit(""))) for i, (c, _) in enumerate(copied)]
    for i, (c, _, low, high) in enumerate(dates, len(copied)):
        days = F.datediff(F.to_date(F.try_to_timestamp(child[c])), F.to_date(F.try_to_timestamp(F.col(f"q_p.q_{i}"))))
        bad.append((c, F.coalesce(~days.between(low, high), text(child[c]) != "")))
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), b.cast("int").alias("bad")) for c, b in bad])
    return joined.select(F.explode(cells).alias("c")).groupBy("c.column_name").agg(F.sum("c.bad").alias("violations"))


def overall(zones: dict[str, str]) -> str:
    """FAIL over REVIEW over all NOT_EVALUATED over PASS."""
    said = list(zones.values())
    return "FAIL" if "FAIL" in said else "REVIEW" if "REVIEW" in said else "NOT_EVALUATED" if said and all(s == "NOT_EVALUATED" for s in said) else "PASS"


def issue_groups(issues: DataFrame, k: int = 4) -> DataFrame:
    """code, column_name, n: the most frequent kinds of issue."""
    return issues.groupBy("code", "column_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code", "column_name").limit(k)
