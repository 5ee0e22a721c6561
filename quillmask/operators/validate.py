"""Checks of an output against its policies, rules and schema: issues as rows, each check an aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.functions.generalise import strategy_for
from quillmask.functions.temporal import clock_seconds, layout_of
from quillmask.functions.text import BOOLEAN_FALSE, BOOLEAN_TRUE, cell, is_missing_sentinel, let, numeric_token, text, trimmed
from quillmask.operators import quality, relationships
from quillmask.operators.actions import Policy
from quillmask.operators.generate import Field

ISSUE = "code string, severity string, column_name string, n long"
#: Marks that templates carry inside a run and that no output may show.
TEMPLATE_MARK = r"\x{E000}[A-Z_]+:[^\x{E001}]*\x{E001}"
# What generalised cells look like.
BAND, GROUP, LENGTH, PREFIX = r"^(?:[^\d+-])?[+-]?\d+(?:\.\d+)?-[+-]?\d+(?:\.\d+)?%?$", r"^(?:Category|Synthetic .+) Group \d+$", r"^Text length \d+-\d+$", r"^[A-Za-z0-9]{1,3}\*+$"
_DATE_HEAD = r"^(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/. ][\dA-Za-z]{1,9}[-/., ]+\d{2,4}|[A-Za-z]{3,9}[-/. ]\d{1,2}[-/., ]+\d{2,4})"


def template(kind: str, payload: str) -> str:
    """A mark that stands for a value still to be made."""
    return f"\ue000{kind}:{payload}\ue001"


def temporal_kind(c: Column) -> Column:
    """DATE, DATETIME, TIME or null."""

    def kind(t: Column) -> Column:
        rest = F.trim(F.regexp_replace(F.regexp_replace(t, _DATE_HEAD, ""), r"^[Tt]", ""))
        dated = layout_of(t).isNotNull()
        return F.when(dated & (rest == ""), "DATE").when(dated & clock_seconds(rest).isNotNull(), "DATETIME").when(clock_seconds(t).isNotNull(), "TIME")

    return let(trimmed(c), kind)


def matches_type(c: Column, detected: str) -> Column:
    """Whether a cell looks like its column's type; blanks do, and types without a form always do."""
    t = trimmed(c)
    if detected in ("INTEGER", "NUMERIC_ID"):
        ok = t.rlike(r"^[-+]?\d+$")
    elif detected in ("DECIMAL", "PERCENTAGE", "CURRENCY_LIKE"):
        ok = numeric_token(t).isNotNull()
    elif detected == "BOOLEAN":
        ok = F.lower(t).isin(*BOOLEAN_TRUE, *BOOLEAN_FALSE)
    elif detected == "EMAIL":
        ok = t.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")
    elif detected in ("DATE", "TIME", "DATETIME"):
        ok = F.coalesce(temporal_kind(t) == detected, F.lit(False))
    else:
        return F.lit(True)
    return (t == "") | ok


def matches_generalisation(c: Column, p: Policy) -> Column:
    t, strategy = trimmed(c), p.params.get("strategy", "AUTO")
    kind = "DATE" if p.detected == "AMBIGUOUS_DATE" else p.detected
    chosen = strategy_for(p.column, p.detected, strategy)
    if chosen == "DATE_PRECISION":
        return matches_type(c, kind)
    forms = {"POSTCODE_PREFIX": (PREFIX,), "CATEGORY_GROUP": (GROUP,), "TEXT_LENGTH_BAND": (LENGTH,), "AGE_BAND": (BAND,), "NUMERIC_BAND": (BAND,)}[chosen] if strategy != "AUTO" else (BAND, GROUP, LENGTH, PREFIX)
    ok = reduce(lambda a, b: a | b, [t.rlike(f) for f in forms])
    return (t == "") | (ok | matches_type(c, kind) if strategy == "AUTO" else ok)


def conforms(output: DataFrame, p: Policy) -> Column:
    """Whether a cell may stand in the output: kept columns always may, and missing marks in numeric ones."""
    c = cell(output, p.column)
    if p.action == "KEEP":
        return F.lit(True)
    if p.action == "GENERALISE":
        return matches_generalisation(c, p)
    numeric = p.detected in ("INTEGER", "DECIMAL", "PERCENTAGE", "CURRENCY_LIKE", "NUMERIC_ID")
    return matches_type(c, p.detected) | (is_missing_sentinel(c) if numeric else F.lit(False))


def cell_issues(output: DataFrame, policies: list[Policy]) -> DataFrame:
    """INTERNAL_TEMPLATE_LEAK and OUTPUT_TYPE_MISMATCH with the cells each concerns: one pass over the output."""
    kept = [p for p in policies if p.column in output.columns]
    if not kept:
        return output.sparkSession.createDataFrame([], ISSUE)
    leak = {p.column: text(cell(output, p.column)).rlike(TEMPLATE_MARK) for p in kept}
    counts = [F.count_if(leak[p.column]).alias(f"l{i}") for i, p in enumerate(kept)] + [F.count_if(~leak[p.column] & ~conforms(output, p)).alias(f"t{i}") for i, p in enumerate(kept)]
    row = output.agg(*counts)
    cells = [F.struct(F.lit(code).alias("code"), F.lit("ERROR").alias("severity"), F.lit(p.column).alias("column_name"), F.col(f"{k}{i}").alias("n")) for k, code in (("l", "INTERNAL_TEMPLATE_LEAK"), ("t", "OUTPUT_TYPE_MISMATCH")) for i, p in enumerate(kept)]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("n > 0")


def schema_issues(output: DataFrame, columns: list[str], rows: int | None = None) -> DataFrame:
    """OUTPUT_SCHEMA_MISMATCH (n: columns too few or many) and OUTPUT_ROW_COUNT_MISMATCH (n: rows too few or many)."""
    found = []
    if list(output.columns) != list(columns):
        found.append(("OUTPUT_SCHEMA_MISMATCH", "ERROR", "", len(set(output.columns) ^ set(columns))))
    issues = output.sparkSession.createDataFrame(found, ISSUE)
    if rows is None:
        return issues
    counted = output.agg(F.abs(F.count(F.lit(1)) - F.lit(rows)).alias("n"))
    return issues.unionByName(counted.select(F.lit("OUTPUT_ROW_COUNT_MISMATCH").alias("code"), F.lit("ERROR").alias("severity"), F.lit("").alias("column_name"), "n").where("n > 0"))


RULE_CODES = {"SAME_ID": "SAME_ID_RELATIONSHIP_VIOLATION", "DATE_ORDER": "DATE_RELATIONSHIP_VIOLATION", "DATE_TIME_SHIFT_GROUP": "SHIFT_GROUP_ORDER_VIOLATION", "CODE_DESCRIPTION": "DEPENDENCY_VIOLATION", "CATEGORY_CODE_NAME": "DEPENDENCY_VIOLATION"}


def rule_issues(output: DataFrame, rules: list[relationships.Rule]) -> DataFrame:
    """Rows that break a confirmed rule; shift groups count only where they keep an order."""
    out = output.sparkSession.createDataFrame([], ISSUE)
    for r in rules:
        if not r.active or not set(r.columns) <= set(output.columns) or r.kind == "MAPPING_GROUP" or r.kind == "DATE_TIME_SHIFT_GROUP" and not r.options.get("keep_order", True):
            continue
        found = relationships.rule_violations(output, r).select(F.lit(RULE_CODES.get(r.kind, "BUSINESS_RULE_VIOLATION")).alias("code"), F.lit("ERROR").alias("severity"), F.lit(",".join(r.columns)).alias("column_name"), F.col("violations").alias("n"))
        out = out.unionByName(found.where("n > 0"))
    return out


# Headers whose small vocabularies may come back, and headers that are protected whatever the type.
BROAD_LOCATIONS = r"(^|_)(state|province|territory|country|suburb|city|town|locality|postcode|post_code|postal_code|zip|zip_code)(_|$)"
PROTECTED = r"(?i)(^|[^a-z])(email|phone|mobile|name|address|member|staff|employee|assignee|operator|worker|technician|signature)([^a-z]|$)"


def reuse_issues(output: DataFrame, source: DataFrame, policies: list[Policy]) -> DataFrame:
    """SOURCE_VALUE_REUSED: distinct output values that the source has, beyond those that chance allows."""
    import re

    from quillmask.operators.detect import DIRECT_TYPES

    out = output.sparkSession.createDataFrame([], ISSUE)
    for p in policies:
        protected = p.detected in DIRECT_TYPES or bool(re.search(PROTECTED, p.column))
        replaced = p.action in ("REPLACE", "PATTERN_REPLACE")
        if p.action == "KEEP" or p.column not in output.columns or not (protected or replaced):
            continue
        if p.action == "REPLACE" and re.search(BROAD_LOCATIONS, relationships.normalised(p.column)):
            continue
        met = quality.source_reuse(output, source, p.column).first()
        allowed = 0
        if p.action == "PATTERN_REPLACE" and met["reused"] and not protected:
            shape = output.select(F.min(quality.value_shape(trimmed(cell(output, p.column)))).alias("s")).first()["s"] or ""
            n = source.agg(F.count_distinct(trimmed(cell(source, p.column)))).first()[0]
            allowed = quality.reuse_allowance(quality.pattern_space(shape), n, met["output_distinct"])
        if met["reused"] > allowed:
            out = out.unionByName(output.sparkSession.createDataFrame([("SOURCE_VALUE_REUSED", "ERROR" if protected else "WARNING", p.column, met["reused"])], ISSUE))
    return out


def generated_issues(table: DataFrame, fields: list[Field], rows: int) -> DataFrame:
    """Generated columns against their settings: GENERATED_NULL_COUNT_MISMATCH, GENERATED_UNIQUENESS_RELAXED, GENERATED_VALUE_OUTSIDE_RULES."""
    outside, blanks, unique = {}, {}, [f for f in fields if f.settings.get("unique")]
    for f in fields:
        v, s = text(table[f.name]), f.settings
        blanks[f.name] = round(rows * f.null_rate)
        if f.generator == "integer":
            low, high = sorted((s.get("minimum", 1), s.get("maximum", 1000)))
            ok = v.rlike(r"^[+-]?\d+$") & v.try_cast("long").between(low, high)
        elif f.generator == "decimal":
            ok = v.try_cast("double").isNotNull()
        elif f.generator == "category":
            ok = v.isin(*[str(x) for x in s.get("values", [])])
        elif f.generator == "constant":
            ok = v == str(s.get("value", "Test"))
        elif f.generator == "date":
            ok = v.rlike(r"^\d{4}-\d{2}-\d{2}$") & v.between(*sorted((s.get("start", "2020-01-01"), s.get("end", "2035-12-31"))))
        else:
            continue
        outside[f.name] = (v != "") & ~F.coalesce(ok, F.lit(False))
    row = table.agg(*[F.abs(F.count_if(text(table[f.name]) == "") - F.lit(blanks[f.name])).alias(f"b{i}") for i, f in enumerate(fields)], *[F.count_if(outside[c]).alias(f"o{i}") for i, c in enumerate(outside)])
    cells = [F.struct(F.lit("GENERATED_NULL_COUNT_MISMATCH").alias("code"), F.lit("ERROR").alias("severity"), F.lit(f.name).alias("column_name"), F.col(f"b{i}").alias("n")) for i, f in enumerate(fields)]
    cells += [F.struct(F.lit("GENERATED_VALUE_OUTSIDE_RULES").alias("code"), F.lit("ERROR").alias("severity"), F.lit(c).alias("column_name"), F.col(f"o{i}").alias("n")) for i, c in enumerate(outside)]
    out = row.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("n > 0")
    for f in unique:
        out = out.unionByName(quality.duplicate_keys(table, f.name).select(F.lit("GENERATED_UNIQUENESS_RELAXED").alias("code"), F.lit("WARNING").alias("severity"), F.lit(f.name).alias("column_name"), F.col("duplicate_rows").alias("n")).where("n > 0"))
    return out


def issues(output: DataFrame, policies: list[Policy], source: DataFrame | None = None, rules: list[relationships.Rule] = (), rows: int | None = None) -> DataFrame:
    """code, severity, column_name, n: everything that is wrong with an output."""
    out = schema_issues(output, [p.column for p in policies if p.action != "DROP"], rows).unionByName(cell_issues(output, policies)).unionByName(rule_issues(output, rules))
    return out if source is None else out.unionByName(reuse_issues(output, source, policies))


def deduplicated(found: DataFrame) -> DataFrame:
    """One row for each code and column: equal warnings add up."""
    return found.groupBy("code", "severity", "column_name").agg(F.sum("n").alias("n"))


def invalid_rows(output: DataFrame, policies: list[Policy], rules: list[relationships.Rule] = ()) -> Column:
    """Whether a row has a cell or breaks a rule that ``issues`` would name as an error."""
    bad = [text(cell(output, p.column)).rlike(TEMPLATE_MARK) | ~conforms(output, p) for p in policies if p.column in output.columns]
    for r in rules:
        if r.active and set(r.columns) <= set(output.columns) and r.kind not in ("MAPPING_GROUP", "CODE_DESCRIPTION", "CATEGORY_CODE_NAME"):
            bad.append(~F.coalesce(relationships.holds(output, r), F.lit(True)))
    return reduce(lambda a, b: a | b, bad, F.lit(False))
