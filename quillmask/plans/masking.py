"""Whole runs: choose rows, mask them by policies, repair relationships, check, try again, and report."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.functions.stored import stored
from quillmask.operators import compare, coverage, detect, profile, quality, relationships, validate
from quillmask.operators.actions import Policy, shift_kind, transformed
from quillmask.operators.resample import NUMERIC, stratified_share

MOST_TRIES = 3


@dataclass(frozen=True)
class Fidelity:
    """FLEXIBLE, BALANCED or HIGH, and what each keeps."""

    level: str = "BALANCED"

    @property
    def blanks(self) -> bool:
        return self.level != "FLEXIBLE"

    @property
    def strata(self) -> bool:
        return self.level == "BALANCED"

    @property
    def ranks(self) -> bool:
        return self.level != "FLEXIBLE"

    @property
    def all_rows(self) -> bool:
        return self.level == "HIGH"


def mask(df: DataFrame, policies: list[Policy] | None = None, rules: list[relationships.Rule] = (), mode: str = "SAFE", seed: int = 1, fidelity: Fidelity = Fidelity(), columns: list[str] | None = None) -> DataFrame:
    """The masked table, row by row. Policies are recommended from the data where none are given."""
    df = df.select(*(columns or df.columns))
    policies = policies or detect.policies(detect.analysed(df), mode)
    out = transformed(df, scoped(policies, rules), seed=seed, keep_blanks=fidelity.blanks)
    return relationships.enforced(out, [r for r in rules if set(r.columns) <= set(out.columns)])


def scoped(policies: list[Policy], rules: list[relationships.Rule], seed: int = 1) -> list[Policy]:
    """Policies that draw for their mapping group, and dates of one shift group with one offset (the first column's)."""
    registry = relationships.Registry(tuple(rules))
    by_name = {p.column: p for p in policies}
    out = []
    for p in policies:
        params, lead = dict(p.params), by_name.get(registry.shift_group(p.column)[0])
        if p.action == "SHIFT" and lead is not None and lead.action == "SHIFT":
            params["offset"] = lead.params["offset"]
        out.append(Policy(p.column, p.action, p.detected, p.role, p.risk, params, p.scope or registry.scope(p.column)))
    return out


def random_offset(seed: int, scope: str, most: int = 365) -> int:
    """A shift that is drawn once for a scope: never zero, at most ``most`` either way."""
    import xxhash

    draw = xxhash.xxh64_intdigest(f"{seed}|{scope}|offset") % (2 * most)
    return draw - most if draw < most else draw - most + 1


def unique_capacity(df: DataFrame, policies: list[Policy], rows: int) -> list[str]:
    """Columns that must be unique and can't be: fewer possible values than rows."""
    out = []
    for p in (p for p in policies if p.params.get("unique")):
        shapes = profile.shapes(df, [p.column], 8).collect()
        space = sum(quality.pattern_space(r["key"]) for r in shapes) if p.action == "PATTERN_REPLACE" else 36.0**6
        if space < rows:
            out.append(p.column)
    return out


def template_rows(df: DataFrame, row_id: str, policies: list[Policy], n: int, fidelity: Fidelity = Fidelity(), seed: int = 1) -> DataFrame:
    """The source rows that n output rows are made from, each as often as ``uses`` says, with t_row, a row number.

    HIGH takes every row once, in order, and so needs as many as there are. BALANCED chooses rows such that blanks and
    minority values come as often as in the source; FLEXIBLE takes an even sample."""
    total = df.count()
    if fidelity.all_rows:
        if n != total:
            raise ValueError("HIGH fidelity needs as many output rows as the source has")
        return df.withColumn("t_row", F.col(row_id).cast("long"))
    if n < total and fidelity.strata:
        profiles = {r["column_name"]: r.asDict() for r in profile.column_profiles(df, [p.column for p in policies]).collect()}
        for r in profile.top_values(df, [p.column for p in policies]).orderBy("rank").collect():
            profiles[r["column_name"]].setdefault("top", []).append((r["value"], r["n"]))
        strata = coverage.strata_plan(profiles, policies, n, fidelity.blanks)
        pool = coverage.captured(df, row_id, strata, n, seed)
        ids = coverage.balanced_choice([(r[row_id], list(r["strata"])) for r in pool.select(row_id, "strata").orderBy(row_id).collect()], strata, n)  # a few times n rows
        chosen = df.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], f"t_id {df.schema[row_id].dataType.simpleString()}, t_row long")
        return df.join(F.broadcast(chosen) if n <= 100_000 else chosen, F.col("t_id") == df[row_id]).drop("t_id")
    rows = df if n >= total else df.orderBy(F.xxhash64(F.lit(seed), row_id), row_id).limit(n)
    from quillmask.functions.ordinals import with_rank

    ranked = with_rank(rows, row_id, [], "t_row").withColumn("t_row", F.col("t_row") - 1)
    if n <= total or not total:
        return ranked
    repeats = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.lit(n - 1) - F.col("t_row")) / F.lit(total))))
    return ranked.withColumn("t_use", repeats).withColumn("t_row", F.col("t_row") + F.col("t_use") * F.lit(total)).drop("t_use")


def generate_output(df: DataFrame, row_id: str, policies: list[Policy], n: int | None = None, rules: list[relationships.Rule] = (), fidelity: Fidelity = Fidelity(), seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(output, issues). Schedule, transform, align ranks, apply rules, validate; rows that fail are made anew, ``MOST_TRIES`` times at most."""
    columns = [p.column for p in policies]
    short = unique_capacity(df, policies, n or 0)
    if short:
        raise ValueError(f"not enough possible values to be unique: {', '.join(short)}")
    n = df.count() if n is None else n
    templates = stored(template_rows(df, row_id, policies, n, fidelity, seed))
    plan = scoped(policies, rules, seed)
    numbers = [p.column for p in plan if p.action == "RESAMPLE" and p.detected in NUMERIC]
    shares = {c: stratified_share(F.col("t_row"), n, seed, c, fidelity.all_rows) for c in numbers} if n else {}

    def made(rows: DataFrame, attempt: int) -> DataFrame:
        out = transformed(rows.select(*columns, "t_row"), [*plan, Policy("t_row")], F.col("t_row"), seed + attempt, fidelity.blanks, df, {} if attempt else shares)
        return stored(out.withColumn("t_row", F.col("t_row").cast("long")))

    output = made(templates, 0)
    if fidelity.ranks and n == templates.count():
        for c in numbers:
            output = stored(relationships.rank_aligned(templates.select("t_row", c), output, c, "t_row"))
    output = relationships.enforced(output, [r for r in rules if set(r.columns) <= set(output.columns)])
    for attempt in range(1, MOST_TRIES + 1):
        bad = stored(output.where(validate.invalid_rows(output, plan, rules)).select(F.col("t_row").alias("b_row")))
        if bad.isEmpty():
            break
        again = relationships.enforced(made(templates.join(bad, F.col("t_row") == F.col("b_row"), "left_semi"), attempt), [r for r in rules if set(r.columns) <= set(output.columns)])
        output = stored(output.join(bad, F.col("t_row") == F.col("b_row"), "left_anti").unionByName(again))
    final = output.drop("t_row")
    return final, validate.deduplicated(validate.issues(final, plan, df, list(rules), n))


def report(source: DataFrame, output: DataFrame, policies: list[Policy], rules: list[relationships.Rule] = (), fidelity: Fidelity = Fidelity()) -> dict:
    """Verdicts of four zones and overall with what was measured; every check is an aggregation."""
    n_source, n_output = source.count(), output.count()
    found = [r.asDict() for r in validate.deduplicated(validate.issues(output, policies, source, list(rules))).orderBy("code", "column_name").collect()]
    errors = lambda *codes: [x for x in found if x["severity"] == "ERROR" and x["code"] in codes]
    kept = [p for p in policies if p.column in output.columns]
    quasi = [p.column for p in kept if p.role == "QUASI_IDENTIFIER"]
    zones, metrics = {}, {}
    zones["structure"] = "FAIL" if errors("OUTPUT_SCHEMA_MISMATCH", "OUTPUT_ROW_COUNT_MISMATCH", "INTERNAL_TEMPLATE_LEAK", "OUTPUT_TYPE_MISMATCH") else "PASS" if n_source == n_output else "REVIEW"
    risk = quality.combination_risk(output, quasi).first().asDict() if len(quasi) > 1 else None
    reused = [x for x in found if x["code"] == "SOURCE_VALUE_REUSED"]
    zones["privacy"] = "FAIL" if any(x["severity"] == "ERROR" for x in reused) else "REVIEW" if reused or risk and risk["small_groups"] else "PASS"
    metrics["privacy"] = {"combination_risk": risk or "NOT_COMPUTED", "reused": reused}
    columns = compare.column_verdicts(source, output, kept, fidelity.level)
    said = [c["verdict"] for c in columns]
    zones["fidelity"] = quality.overall(dict(enumerate(v for v in said if v != "NOT_EVALUATED"))) if set(said) - {"NOT_EVALUATED"} else "NOT_EVALUATED"
    metrics["fidelity"] = columns
    judged = [r for r in rules if r.active and r.kind != "MAPPING_GROUP"]
    broken = errors(*validate.RULE_CODES.values(), "BUSINESS_RULE_VIOLATION")
    zones["relationships"] = "NOT_EVALUATED" if not judged else "FAIL" if broken else "PASS"
    metrics["relationships"] = {"rules": len(judged), "broken": broken}
    return {"rows": {"source": n_source, "output": n_output}, "zones": zones, "overall": quality.overall(zones), "metrics": metrics, "issues": found}


def report_json(said: dict) -> str:
    return json.dumps(said, indent=1, sort_keys=True, default=str)


def may_export(said: dict) -> tuple[bool, str]:
    """Whether an output may leave, and why not: one that fails may not."""
    failed = sorted(z for z, v in said["zones"].items() if v == "FAIL")
    return not failed, f"failed: {', '.join(failed)}" if failed else ""


def may_export_all(said: dict[str, dict]) -> tuple[bool, str]:
    """Whether tables that belong together may leave: there is one at least, and each may."""
    held = {name: why for name, s in sorted(said.items()) for ok, why in [may_export(s)] if not ok}
    return bool(said) and not held, "; ".join(f"{name} {why}" for name, why in held.items()) if said else "no tables"


#: What each check of a dataset finds, for one and for several.
FINDINGS = {
    "DUPLICATE_PRIMARY_KEY": ("duplicate primary-key row", "duplicate primary-key rows"), "ORPHAN_FOREIGN_KEY": ("orphan foreign key", "orphan foreign keys"),
    "CARDINALITY_VIOLATION": ("parent with too few or many children", "parents with too few or many children"), "LINKED_RULE_VIOLATION": ("linked cell that differs from its parent", "linked cells that differ from their parents"),
}


def integrity_model(
    tables: dict[str, DataFrame], keys: dict[str, str], links: list[tuple[str, str, str]], counts: list[tuple[str, str, str, int, int]] = (), linked: list[tuple[str, str, str, list[tuple[str, str]]]] = ()
) -> DataFrame:
    """check, table_name, column_name, n: repeated primary keys, orphans of each link (child, column, parent), and where asked for
    parents whose children are too few or many (child, column, parent, low, high) and linked cells that differ from their
    parent's (child, column, parent, pairs of columns)."""
    rows = [("DUPLICATE_PRIMARY_KEY", name, key, quality.duplicate_keys(tables[name], key).select(F.col("duplicate_rows").alias("n"))) for name, key in keys.items()]
    number = F.count(F.lit(1)).alias("n")
    for child, column, parent in links:
        rows.append(("ORPHAN_FOREIGN_KEY", child, column, quality.orphans(tables[child], column, tables[parent], keys[parent]).agg(number)))
    for child, column, parent, low, high in counts:
        rows.append(("CARDINALITY_VIOLATION", child, column, quality.cardinality_violations(tables[child], column, tables[parent], keys[parent], low, high).agg(number)))
    for child, column, parent, copied in linked:
        wrong = quality.linked_violations(tables[child], column, tables[parent], keys[parent], copied)
        rows.append(("LINKED_RULE_VIOLATION", child, column, wrong.agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("n"))))
    return reduce(DataFrame.unionByName, [df.select(F.lit(check).alias("check"), F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), "n") for check, name, column, df in rows])


def integrity_findings(model: DataFrame) -> list[str]:
    """What an integrity model found, one line for each check that found anything."""
    found = {r["check"]: r["n"] for r in model.groupBy("check").agg(F.sum("n").alias("n")).collect()}
    return [f"{found[check]:,} {names[found[check] != 1]}" for check, names in FINDINGS.items() if found.get(check)]


def shift_readiness(df: DataFrame, policies: list[Policy]) -> DataFrame:
    """column_name, filled, readable, ready: whether the cells of columns to be shifted can be read as their kind."""
    from quillmask.functions.temporal import as_date, clock_seconds
    from quillmask.functions.text import cell, trimmed

    out = None
    for p in (p for p in policies if p.action == "SHIFT"):
        c = trimmed(cell(df, p.column))
        read = {"TIME": clock_seconds(c).isNotNull(), "NUMBER": c.rlike(r"\d"), "DATE": as_date(c, p.params.get("layout", "YMD")).isNotNull()}[shift_kind(p)]
        row = df.agg(F.count_if(c != "").alias("filled"), F.count_if((c != "") & read).alias("readable")).select(F.lit(p.column).alias("column_name"), "filled", "readable", (F.col("filled") == F.col("readable")).alias("ready"))
        out = row if out is None else out.unionByName(row)
    return out
