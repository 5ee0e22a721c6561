"""Column profiles: every column of a table in a fixed number of aggregations, whatever the number of columns.

The table is unpivoted to (column, value, count) after a map-side count per distinct value, so a column with few
values costs few rows however long the table. Distinct counts are exact, or bounded or estimated on request; the
status says which.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmask.functions.keyed import key_hash
from quillmask.functions.ordinals import running
from quillmask.functions.stored import stored
from quillmask.functions.text import case_pattern, cell, numeric_token, text, trimmed, value_shape

EXACT, SAMPLED, LOWER_BOUND, ESTIMATED, NOT_COMPUTED = "EXACT", "SAMPLED", "LOWER_BOUND", "ESTIMATED", "NOT_COMPUTED"
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@dataclass(frozen=True)
class Limits:
    top_values: int = 20
    sample_values: int = 64
    unique_values: int = 4096
    numeric_samples: int = 1024
    common_lengths: int = 24
    decimal_places: int = 12
    columns: int = 1000
    value_length: int = 512
    wide_values: int = 1_000_000  # columns with more values than this (by a sketch) are counted on their own, their quantiles by ranks
    exact_values: int | None = None  # if given, columns with more values than this (by a sketch) are profiled by sketches
    distinct: str = EXACT  # or LOWER_BOUND (count to unique_values + 1)

    def __post_init__(self):
        for name in ("top_values", "sample_values", "unique_values", "numeric_samples", "common_lengths", "decimal_places", "columns", "value_length", "wide_values", "exact_values"):
            given = getattr(self, name)
            if given is not None and given < 1:
                raise ValueError(f"{name} must be positive")


def _value(df: DataFrame, column: str):
    """A cell's trimmed text; only texts can have blanks at their ends."""
    return trimmed(df[column]) if df.schema[column].dataType.typeName() == "string" else text(cell(df, column))


def unpivoted(df: DataFrame, columns: list[str] | None = None, index: dict[str, int] | None = None) -> DataFrame:
    """column_index, column_name, value (string, trimmed, '' for null): one row per cell."""
    columns = columns or df.columns
    cells = F.array(*[F.struct(F.lit(index[c] if index else i).alias("column_index"), F.lit(c).alias("column_name"), _value(df, c).alias("value")) for i, c in enumerate(columns)])
    return df.select(F.explode(cells).alias("cell")).select("cell.*")


def value_counts(df: DataFrame, columns: list[str] | None = None, index: dict[str, int] | None = None) -> DataFrame:
    """column_index, column_name, value (trimmed), n, with blanks as ''."""
    return unpivoted(df, columns, index).groupBy("column_index", "column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def column_profiles(df: DataFrame, columns: list[str] | None = None, limits: Limits = Limits()) -> DataFrame:
    """One row per column: counts, ratios, distinct values, lengths, numbers, quantiles and cases.

    Columns beyond ``limits.columns`` aren't profiled; ``warnings`` names them. All is exact, however many values a column
    has, unless ``limits.exact_values`` is given: a column with more distinct values is then summed up where its rows are,
    and its distinct values and quantiles are ESTIMATED."""
    columns = (columns or df.columns)[: limits.columns]
    index = {c: i for i, c in enumerate(columns)}
    apart: dict[str, DataFrame] = {}
    if limits.distinct == EXACT:
        about = df.agg(*[F.approx_count_distinct(df[c]).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        for i, c in enumerate(columns):
            if limits.exact_values is not None and about[f"c{i}"] > limits.exact_values:
                apart[c] = _sketched(df, c, i)
            elif about[f"c{i}"] > limits.wide_values:
                apart[c] = _wide(df, c, i)
    out = _counted(df, [c for c in columns if c not in apart], index, limits) if len(apart) < len(columns) else None
    for part in apart.values():
        out = part if out is None else out.unionByName(part)
    out = out.withColumn("empty", F.col("observed") - F.col("non_empty")).withColumn("non_empty_ratio", F.coalesce(F.try_divide("non_empty", "observed"), F.lit(0.0)))
    return out.withColumn("unique_ratio", F.coalesce(F.try_divide("distinct", "non_empty"), F.lit(0.0)))


_CASES = ("UPPER", "LOWER", "TITLE", "MIXED", "NO_CASE")


def _cell_facts(rows: DataFrame) -> DataFrame:
    """``rows`` (value, n) with filled, x (the number), len and case, each computed once."""
    v, bare = F.col("value"), F.col("value").rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?$")  # most numbers; they need no parsing
    x = F.when(bare, v.try_cast("double")).otherwise(numeric_token(v)["value"])
    return rows.withColumns({"x": x, "filled": v != "", "len": F.length(v), "case": F.when(bare, "NO_CASE").otherwise(case_pattern(v))})


def _summed(rows, keys: list[str], distinct, quantiles) -> DataFrame:
    filled = lambda e: F.sum(F.when(F.col("filled"), e))
    count_if = lambda c: F.coalesce(F.sum(F.when(F.col("filled") & c, F.col("n"))), F.lit(0))
    return rows.groupBy(*keys).agg(
        F.sum("n").alias("observed"), F.coalesce(filled(F.col("n")), F.lit(0)).alias("non_empty"), F.coalesce(distinct, F.lit(0)).cast("long").alias("distinct"),
        F.min(F.when(F.col("filled"), F.col("len"))).alias("min_length"), F.max(F.when(F.col("filled"), F.col("len"))).alias("max_length"),
        count_if(F.col("x").isNotNull()).alias("numeric_count"), F.min("x").alias("minimum"), F.max("x").alias("maximum"),
        (F.sum(F.col("x") * F.col("n")) / F.sum(F.when(F.col("x").isNotNull(), F.col("n")))).alias("mean"), quantiles.alias("quantiles"),
        *[count_if(F.col("case") == k).alias(f"case_{k.lower()}") for k in _CASES],
    )


def _counted(df: DataFrame, columns: list[str], index: dict[str, int], limits: Limits) -> DataFrame:
    """Profiles from counts of distinct values."""
    counts = value_counts(df, columns, index)
    exact = F.percentile(F.when(F.col("filled"), F.col("x")), F.array(*[F.lit(q) for q in QUANTILES]), F.col("n"))
    out = _summed(_cell_facts(counts), ["column_index", "column_name"], F.sum(F.when(F.col("filled"), F.lit(1))), exact)
    out = out.withColumn("quantile_status", F.lit(EXACT))
    if limits.distinct == LOWER_BOUND:
        over = F.col("distinct") > limits.unique_values
        return out.withColumn("distinct_status", F.when(over, LOWER_BOUND).otherwise(EXACT)).withColumn("distinct", F.least("distinct", F.lit(limits.unique_values + 1)))
    return out.withColumn("distinct_status", F.lit(EXACT))


def _wide(df: DataFrame, column: str, index: int) -> DataFrame:
    """The exact profile of a column with very many values: no task holds them all."""
    counts = _native_counts(df, column).select(F.lit(index).alias("column_index"), F.lit(column).alias("column_name"), "value", "n")
    facts = stored(_cell_facts(counts).drop("value"))
    out = _summed(facts, ["column_index", "column_name"], F.sum(F.when(F.col("filled"), F.lit(1))), _ranked_quantiles(facts))
    return out.withColumns({"quantile_status": F.lit(EXACT), "distinct_status": F.lit(EXACT)})


def _native_counts(df: DataFrame, column: str) -> DataFrame:
    """value (trimmed), n: counted before values become text, so that each becomes text once. Zeros keep their signs."""
    kind, c = df.schema[column].dataType.typeName(), df[column]
    if kind in ("double", "float"):
        rows = df.select(F.when(c != 0, c).alias("v"), F.when(c == 0, c.cast("string")).alias("zero")).groupBy("v", "zero").agg(F.count(F.lit(1)).alias("n"))
        return rows.select(F.coalesce("zero", _value(rows, "v")).alias("value"), "n")
    if kind in ("byte", "short", "integer", "long", "decimal", "date"):
        rows = df.groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        return rows.select(_value(rows, "v").alias("value"), "n")
    return df.select(_value(df, column).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def _ranked_quantiles(facts: DataFrame):
    """The quantiles of x with n rows each, as a fixed array: the values at the two ranks around each."""
    numbers = facts.where("filled and x is not null").select("x", "n")
    total = numbers.agg(F.sum("n")).first()[0]
    if not total:
        return F.lit(None).cast("array<double>")
    places = [q * (total - 1) for q in QUANTILES]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    placed = running(numbers, "x", [], "n", "first")
    met = placed.withColumn("rank", F.explode(F.filter(F.array(*[F.lit(r).cast("long") for r in ranks]), lambda r: (r >= F.col("first")) & (r < F.col("first") + F.col("n")))))
    at = {r["rank"]: r["x"] for r in met.select("rank", "x").collect()}  # two for each quantile
    low, high = [at[math.floor(p)] for p in places], [at[math.ceil(p)] for p in places]
    cut = [a if a == b else a + (b - a) * (p - math.floor(p)) for a, b, p in zip(low, high, places)]
    return F.first(F.array(*[F.lit(x) for x in cut]))


def _sketched(df: DataFrame, column: str, index: int) -> DataFrame:
    """The profile of a column with very many values by request: one map-side aggregation with sketches, nothing shuffled by value."""
    rows = df.select(F.lit(index).alias("column_index"), F.lit(column).alias("column_name"), _value(df, column).alias("value"), F.lit(1).cast("long").alias("n"))
    about = F.percentile_approx(F.when(F.col("filled"), F.col("x")), [float(q) for q in QUANTILES], 10000)
    out = _summed(_cell_facts(rows), ["column_index", "column_name"], F.approx_count_distinct(F.when(F.col("filled"), F.col("value")), 0.01), about)
    return out.withColumns({"quantile_status": F.lit(ESTIMATED), "distinct_status": F.lit(ESTIMATED)})


def warnings(df: DataFrame, columns: list[str] | None = None, limits: Limits = Limits()) -> DataFrame:
    """code, column_name, n: what a profile leaves out. n is what was met: distinct values, shortened values, or columns."""
    columns = columns or df.columns
    seen = column_profiles(df, columns, limits).select("column_name", "distinct", "max_length")
    long_values = value_counts(df, columns[: limits.columns]).where(F.length("value") > limits.value_length).groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))
    said = seen.where(F.col("distinct") > limits.unique_values).select(F.lit("UNIQUE_TRACKING_LIMIT_REACHED").alias("code"), "column_name", F.col("distinct").alias("n"))
    said = said.unionByName(long_values.select(F.lit("PROFILE_VALUE_TRUNCATED").alias("code"), "column_name", "n"))
    rest = [("COLUMN_PROFILE_LIMIT_REACHED", c, len(columns)) for c in columns[limits.columns :]]
    return said.unionByName(df.sparkSession.createDataFrame(rest, "code string, column_name string, n long")) if rest else said


def estimated_distinct(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, distinct, distinct_status ESTIMATED from one sketch per column: one pass, no shuffle of values."""
    columns = columns or df.columns
    row = df.agg(*[F.approx_count_distinct(F.nullif(_value(df, c), F.lit("")), 0.01).alias(f"c{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("distinct"), F.lit(ESTIMATED).alias("distinct_status")) for i, c in enumerate(columns)])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def _ranked(rows: DataFrame, key: list, k: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 20) -> DataFrame:
    """column_name, value, n, rank: the k most frequent, ties by value."""
    counts = value_counts(df, columns).where("value <> ''")
    return _ranked(counts, ["column_index"], k, F.desc("n"), F.asc("value")).select("column_name", "value", "n", "rank")


def top_values_sketch(df: DataFrame, column: str, k: int = 20, tracked: int = 10000) -> DataFrame:
    """Heavy hitters from a bounded sketch, for columns whose distinct values are too many to count."""
    return df.select(F.explode(F.expr(f"approx_top_k(`{column}`, {k}, {tracked})")).alias("t")).select("t.*")


def histogram(df: DataFrame, of, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    """column_name, key, n: the k most frequent values of an expression over non-empty cells."""
    counts = value_counts(df, columns).where("value <> ''").groupBy("column_index", "column_name", of(F.col("value")).alias("key")).agg(F.sum("n").alias("n")).where("key is not null")
    return _ranked(counts, ["column_index"], k, F.desc("n"), F.asc("key")).select("column_name", "key", "n")


def common_lengths(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    return histogram(df, F.length, columns, k)


def decimal_places(df: DataFrame, columns: list[str] | None = None, k: int = 12) -> DataFrame:
    return histogram(df, lambda v: numeric_token(v)["decimal_places"], columns, k)


def shapes(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    return histogram(df, value_shape, columns, k)


def structural_groups(df: DataFrame, columns: list[str] | None = None, k: int = 8) -> DataFrame:
    """Leading letter groups of two to twelve letters that end at a digit or a separator."""
    return histogram(df, lambda v: F.nullif(F.regexp_extract(v, r"^(\p{L}{2,12})(?=[\p{N}_./#-])", 1), F.lit("")), columns, k)


def sample_values(df: DataFrame, columns: list[str] | None = None, k: int = 64, seed: int = 1) -> DataFrame:
    """column_name, value: a bounded sample of distinct values, in the order of a keyed hash."""
    counts = value_counts(df, columns).where("value <> ''")
    return _ranked(counts, ["column_index"], k, key_hash(seed, "sample", F.col("column_name"), F.col("value")), F.asc("value")).select("column_name", "value")


def reservoir(df: DataFrame, column: str, k: int = 1024, seed: int = 1) -> DataFrame:
    """A bounded, repeatable sample of a column's rows that keeps frequencies: rows with the lowest keyed hashes."""
    keyed = df.select(df[column].alias("value"), key_hash(seed, "reservoir", *[df[c] for c in df.columns]).alias("priority"))
    return keyed.orderBy("priority", "value").limit(k)
