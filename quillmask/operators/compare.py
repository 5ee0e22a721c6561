"""Source against output, column by column: rates, support, means, quantiles, tails, range and extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.functions.text import cell, number
from quillmask.operators import quality

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
# Output rows expected in a tail before tails are compared, the share of a source's values that must come
# back, and how far rates may differ.
LEAST_TAIL_ROWS, LEAST_SUPPORT, RATE = 5, 0.7, 0.05


def summary(df: DataFrame, column: str, prefix: str, exact: bool = True) -> DataFrame:
    """One row: rows, numbers, distinct numbers, mean, extremes and quantiles. Sketches where not ``exact``."""
    x = number(cell(df, column))
    at = F.percentile(F.col("x"), F.array(*[F.lit(q) for q in QUANTILES])) if exact else F.percentile_approx("x", list(QUANTILES), 10000)
    support = F.count_distinct("x") if exact else F.approx_count_distinct("x", 0.01)
    return df.select(x.alias("x")).agg(F.count(F.lit(1)).alias(f"{prefix}_rows"), F.count("x").alias(f"{prefix}_n"), support.alias(f"{prefix}_support"), F.avg("x").alias(f"{prefix}_mean"), F.min("x").alias(f"{prefix}_min"), F.max("x").alias(f"{prefix}_max"), at.alias(f"{prefix}_q"))


def numeric_checks(source: DataFrame, output: DataFrame, column: str, fidelity: str = "BALANCED", exact: bool = True) -> DataFrame:
    """One row: a check per column (null: not applicable), their measures, and the verdict PASS or REVIEW.

    Shifts are in units of the source's robust spread; tolerances widen to 3 / sqrt(n) of the smaller side."""
    both = summary(source, column, "s", exact).crossJoin(summary(output, column, "o", exact))  # one row each
    support = quality.expected_distinct(source, column, output.count()).first()["expected"] or 0.0
    spread = F.greatest(F.abs(F.col("s_q")[5] - F.col("s_q")[1]), F.abs(F.col("s_max") - F.col("s_min")) * 0.1, F.abs("s_mean") * 0.01, F.lit(2.220446049250313e-16))
    rows = both.withColumns({"spread": spread, "slack": 3 / F.sqrt(F.least("s_n", "o_n"))})
    rows = rows.withColumns({
        "rate_shift": F.col("o_n") / F.greatest(F.lit(1), "o_rows") - F.col("s_n") / F.greatest(F.lit(1), "s_rows"),
        "mean_shift": F.abs(F.col("o_mean") - F.col("s_mean")) / F.col("spread"),
        "shifts": F.zip_with("o_q", "s_q", lambda a, b: F.abs(a - b) / F.col("spread")),
        "least_support": F.greatest(F.lit(1.0), F.ceil(F.lit(support * LEAST_SUPPORT)).cast("double")),
    })
    tolerance = {k: F.greatest(F.lit(quality.TOLERANCES[k]), "slack") for k in ("mean", "quantile", "tails")}
    tails = (F.col("o_rows") * 0.01 >= LEAST_TAIL_ROWS) & (F.col("s_max") > F.col("s_min"))
    inner = F.array_max(F.slice("shifts", 2, 5))
    outer = F.greatest(F.col("shifts")[0], F.col("shifts")[6])
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(F.col(a)), F.abs(F.col(b)))
    extremes = tails & (F.col("s_rows") == F.col("o_rows")) & F.lit(fidelity == "HIGH" and exact)
    checks = {
        "rate_ok": F.abs("rate_shift") <= RATE, "support_ok": F.col("o_support") >= F.col("least_support"), "mean_ok": F.col("mean_shift") <= tolerance["mean"],
        "quantiles_ok": (inner <= tolerance["quantile"]) & (outer <= F.greatest(tolerance["quantile"], F.lit(quality.TOLERANCES["tails"]))),
        "tails_ok": F.when(tails, outer <= tolerance["tails"]), "range_ok": (F.col("o_min") >= F.col("s_min")) & (F.col("o_max") <= F.col("s_max")),
        "extremes_ok": F.when(extremes, close("o_min", "s_min") & close("o_max", "s_max")),
    }
    rows = rows.select("rate_shift", "mean_shift", inner.alias("quantile_shift"), outer.alias("tail_shift"), *[c.alias(k) for k, c in checks.items()], F.lit("EXACT" if exact else "ESTIMATED").alias("measurement"))
    passed = [F.coalesce(F.col(k), F.lit(True)) for k in checks]
    return rows.withColumn("verdict", F.when(F.forall(F.array(*passed), lambda x: x), "PASS").otherwise("REVIEW"))


def column_verdicts(source: DataFrame, output: DataFrame, policies: list, fidelity: str = "BALANCED") -> list[dict]:
    """For each column that should keep its distribution: what was measured and the verdict, or why nothing was."""
    out, n = [], output.count()
    for p in policies:
        if p.column not in output.columns or p.action in ("DROP", "CLEAR"):
            out.append({"column": p.column, "verdict": "NOT_EVALUATED", "reason": "not in the output"})
        elif p.action not in ("RESAMPLE", "KEEP"):
            out.append({"column": p.column, "verdict": "NOT_EVALUATED", "reason": f"{p.action} doesn't keep a distribution"})
        elif p.detected in ("INTEGER", "DECIMAL", "PERCENTAGE", "CURRENCY_LIKE"):
            out.append({"column": p.column} | numeric_checks(source, output, p.column, fidelity).first().asDict())
        elif p.detected in ("CATEGORY", "BOOLEAN"):
            far = quality.category_distance(source, output, p.column).first()["distance"]
            most = quality.adaptive_tolerance(quality.TOLERANCES["category"], n)
            out.append({"column": p.column, "distance": far, "tolerance": most, "verdict": "PASS" if far <= most else "REVIEW"})
        else:
            out.append({"column": p.column, "verdict": "NOT_EVALUATED", "reason": f"no measure for {p.detected}"})
    return out
