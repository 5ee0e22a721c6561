"""Scenarios that a small output should show, the rows that show them, and which rows to take."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.functions.keyed import uniform
from quillmask.functions.text import boolean, business_number, is_empty, trimmed, value_shape

MOST_SCENARIOS, RESERVOIR, STRATA = 1000, 512, 24


@dataclass(frozen=True)
class Scenario:
    id: str
    kind: str
    weight: int
    column: str
    predicate: Column


def scenarios(df: DataFrame, profiles: dict[str, dict], types: dict[str, str]) -> list[Scenario]:
    """What each column asks to be shown. ``profiles``: rows of column profiles by name, with ``top`` (value, n) lists."""
    out: list[Scenario] = []

    def add(kind: str, weight: int, column: str, predicate: Column, note: str = "") -> None:
        out.append(Scenario(f"{column}:{kind}{note and ':'}{note}", kind, weight, column, predicate))

    for name, p in profiles.items():
        c, kind = df[name], types.get(name, "UNKNOWN")
        t = trimmed(c)
        if p["empty"]:
            add("NULL_VALUE", 95, name, is_empty(c))
        if p["non_empty"]:
            add("NON_EMPTY", 35, name, ~is_empty(c))
            add("MIN_LENGTH", 60, name, F.length(t) == p["min_length"])
            add("MAX_LENGTH", 70, name, F.length(t) == p["max_length"])
        if kind == "BOOLEAN":
            add("BOOLEAN_TRUE", 90, name, boolean(c))
            add("BOOLEAN_FALSE", 90, name, ~boolean(c))
        if kind == "CATEGORY":
            top = p.get("top", [])
            for i, (value, _) in enumerate(top[:3]):
                add("CATEGORY_COMMON", 65, name, t == value, str(i))
            rare = [v for v, n in top if n <= max(2, int(p["non_empty"] * 0.01))]
            for i, value in enumerate(rare[-2:]):
                add("CATEGORY_RARE_FEATURE", 92, name, t == value, str(i))
        if kind in ("INTEGER", "DECIMAL", "PERCENTAGE", "CURRENCY_LIKE") and p["minimum"] is not None:
            x = business_number(c)
            add("NUMERIC_MIN", 88, name, x == p["minimum"])
            add("NUMERIC_MAX", 88, name, x == p["maximum"])
            add("NUMERIC_COMMON_RANGE", 50, name, x.between(p["quantiles"][2], p["quantiles"][4]))
    return out[:MOST_SCENARIOS]


def matched(df: DataFrame, found: list[Scenario]) -> DataFrame:
    """``df`` with scenario_ids and scenario_weight: one projection."""
    ids = F.array_compact(F.array(*[F.when(s.predicate, F.lit(s.id)) for s in found])) if found else F.array().cast("array<string>")
    weight = sum((F.when(s.predicate, s.weight).otherwise(0) for s in found), F.lit(0))
    return df.withColumns({"scenario_ids": ids, "scenario_weight": weight})


def signature(df: DataFrame, columns: list[str]) -> Column:
    """Shapes and length buckets of a row."""
    return F.concat_ws("|", *[F.concat(F.substring(value_shape(trimmed(df[c])), 1, 24), F.lit(":"), F.floor(F.length(trimmed(df[c])) / 8).cast("string")) for c in columns])


def candidates(df: DataFrame, found: list[Scenario], row_id: str, seed: int = 1, k: int = RESERVOIR) -> DataFrame:
    """The best row of each scenario and the k rows of least keyed hash over 1 + 0.02 weight: a bounded set."""
    m = matched(df, found).withColumn("priority", uniform(seed, "candidate", F.col(row_id)) / (1 + 0.02 * F.col("scenario_weight")))
    best = m.select("*", F.explode("scenario_ids").alias("for_id"))
    w = Window.partitionBy("for_id").orderBy(F.size("scenario_ids").desc(), F.desc("scenario_weight"), "priority", row_id)
    best = best.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "for_id")
    return best.unionByName(m.orderBy("priority", row_id).limit(k)).dropDuplicates([row_id])


def cover(rows: list[tuple[object, list[str]]], weights: dict[str, int], n: int) -> list[object]:
    """Greedy weighted set cover over a bounded candidate list, then fill in order."""
    left, chosen, pool = set(weights), [], list(rows)
    while pool and len(chosen) < n and left:
        gain = [sum(weights[s] for s in set(ids) & left) for _, ids in pool]
        best = max(range(len(pool)), key=lambda i: (gain[i], -i))
        if not gain[best]:
            break
        key, ids = pool.pop(best)
        chosen.append(key)
        left -= set(ids)
    return chosen + [key for key, _ in pool[: max(0, n - len(chosen))]]


def allocated_uses(weights: list[float], total: int) -> list[int]:
    """One use each, then proportional shares by largest remainder."""
    if not weights or total < len(weights):
        return [int(i < total) for i in range(len(weights))]
    spare, whole = total - len(weights), sum(weights) or 1.0
    shares = [w / whole * spare for w in weights]
    uses = [1 + int(s) for s in shares]
    order = sorted(range(len(shares)), key=lambda i: (-(shares[i] - int(shares[i])), i))
    for i in order[: total - sum(uses)]:
        uses[i] += 1
    return uses


def scheduled(templates: DataFrame, uses: str) -> DataFrame:
    """Each template row as often as its uses say."""
    return templates.where(F.col(uses) > 0).withColumn("use", F.explode(F.sequence(F.lit(1), F.col(uses)))).drop(uses)


def systematic_indexes(rows: int, n: int, blocks: bool = False) -> list[int]:
    """n evenly spread row indexes, optionally in contiguous blocks of about sqrt(n), 4 to 24."""
    n = min(n, rows)
    if not blocks:
        return [i * rows // n for i in range(n)]
    size = max(4, min(24, int(math.sqrt(n))))
    starts = [i * rows // -(-n // size) for i in range(-(-n // size))]
    return sorted({min(rows - 1, s + j) for s in starts for j in range(size)})[:n]


def even_sample(df: DataFrame, index: str, rows: int, n: int) -> DataFrame:
    """Rows floor(i * rows / n) by a 0-based index column: a predicate, not a list."""
    if n >= rows:
        return df
    i = F.ceil(F.col(index) * F.lit(n) / F.lit(rows))
    return df.where((i < n) & (F.floor(i * F.lit(rows) / F.lit(n)) == F.col(index)))


def count_interval(source_count: int, source_rows: int, target_rows: int, deviations: float = 3.0) -> tuple[int, int]:
    """How often a value may appear among target rows drawn without replacement."""
    p = source_count / source_rows if source_rows else 0.0
    spread = deviations * math.sqrt(max(0.0, target_rows * p * (1 - p) * (source_rows - target_rows) / max(1, source_rows - 1)))
    return max(0, math.floor(target_rows * p - spread)), min(target_rows, math.ceil(target_rows * p + spread))


def stratified(df: DataFrame, stratum: str, row_id: str, per_stratum: int) -> DataFrame:
    """The first rows of each stratum in row order."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy(stratum).orderBy(row_id))).where(F.col("k") <= per_stratum).drop("k")


# Output rows that a minority category must reach, rows captured for each asked for, and the types whose
# values are strata.
LEAST_CATEGORY, CAPTURE_FACTOR, STRATUM_TYPES = 3, 3, ("CATEGORY", "BOOLEAN")


@dataclass(frozen=True)
class Stratum:
    id: str
    column: str
    value: str  # '' for blanks
    source_count: int
    target: int
    low: int
    high: int


def strata_plan(profiles: dict[str, dict], policies: list, n: int, blanks: bool = True, most: int = STRATA) -> list[Stratum]:
    """Blanks and minority values (of at most half the rows) that n output rows should show as often as the source does.

    ``profiles``: rows of column profiles with ``top`` lists of all values of columns with few."""
    rows = max((p["observed"] for p in profiles.values()), default=0)
    if rows <= 0 or n >= rows:
        return []
    found = []
    for at, p in enumerate(policies):
        profile = profiles.get(p.column)
        if profile is None or p.action in ("DROP", "CLEAR"):
            continue
        wanted = lambda count: round(count / rows * n)
        if blanks and 0 < profile["empty"] < rows and wanted(profile["empty"]):
            found.append((0, wanted(profile["empty"]), at, "", profile["empty"]))
        few = 2 <= profile["distinct"] <= min(20, max(2, math.ceil(math.sqrt(profile["non_empty"])))) and profile["unique_ratio"] <= 0.1
        top = profile.get("top", [])
        if (p.detected in STRATUM_TYPES or few) and profile["distinct"] <= len(top):
            found += [(1, wanted(count), at, value, count) for value, count in top if value and 0 < count <= rows / 2 and wanted(count) >= LEAST_CATEGORY]
    out, captured = [], 0
    for _, target, at, value, count in sorted(found):
        if len(out) < most and (not out or captured + target <= CAPTURE_FACTOR * n):
            low, high = count_interval(count, rows, n)
            out.append(Stratum(f"stratum-{len(out) + 1}", policies[at].column, value, count, target, low, high))
            captured += target
    return out


def strata_of(df: DataFrame, strata: list[Stratum]) -> Column:
    """The ids of the strata that a row is in."""
    here = [F.when(is_empty(df[s.column]) if s.value == "" else trimmed(df[s.column]) == s.value, F.lit(s.id)) for s in strata]
    return F.array_compact(F.array(*here)) if here else F.array().cast("array<string>")


def captured(df: DataFrame, row_id: str, strata: list[Stratum], n: int, seed: int = 1) -> DataFrame:
    """Rows from which n are chosen: of each stratum evenly spread ones, and the n of least keyed hash: at most
    (``CAPTURE_FACTOR`` + 1) * n rows, whatever the input."""
    held = df.withColumn("strata", strata_of(df, strata))
    few = held.orderBy(uniform(seed, "capture", F.col(row_id)), row_id).limit(n)
    if not strata:
        return few
    targets = F.create_map(*[F.lit(x) for s in strata for x in (s.id, s.target)])
    order = Window.partitionBy("stratum").orderBy(uniform(seed, "stratum", F.col(row_id)), row_id)
    taken = held.withColumn("stratum", F.explode("strata")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= F.element_at(targets, F.col("stratum")))
    return taken.drop("stratum", "k").unionByName(few).dropDuplicates([row_id])


def balanced_choice(rows: list[tuple[object, list[str]]], strata: list[Stratum], n: int, mandatory: list = (), preferred: list = ()) -> list:
    """n row ids of a bounded list (id, stratum ids): mandatory ones, strata up to their targets, preferred ones, the rest.

    Rows that would take a stratum beyond its target come only when nothing else is left."""
    inside, target = dict(rows), {s.id: s.target for s in strata}
    chosen: dict[object, None] = {}
    have = dict.fromkeys(target, 0)

    def fits(key) -> bool:
        return all(have[s] < target[s] for s in inside[key] if s in target)

    def add(key) -> None:
        if key in inside and key not in chosen and len(chosen) < n:
            chosen[key] = None
            for s in inside[key]:
                if s in have:
                    have[s] += 1

    for key in mandatory:
        add(key)
    for s in strata:
        use = lambda key: sum(have[x] < target[x] for x in inside[key] if x in target)
        mine = sorted((k for k, ids in rows if s.id in ids), key=lambda k: -use(k))
        for strict in (True, False):
            for key in mine:
                if have[s.id] < s.target and (not strict or fits(key)):
                    add(key)
    for strict in (True, False):
        for key in (*preferred, *(k for k, _ in rows)):
            if key in inside and (not strict or fits(key)):
                add(key)
    return [k for k, _ in rows if k in chosen]


@dataclass(frozen=True)
class OutputPlan:
    """What an output should show, without any of the source's values: scenario ids, kinds and weights."""

    rows: int
    mandatory: tuple[str, ...]
    scenarios: tuple[tuple[str, str, int], ...]
    covered: float

    def replanned(self, rows: int) -> OutputPlan:
        return output_plan([Scenario(i, k, w, "", F.lit(True)) for i, k, w in self.scenarios], rows)


def output_plan(found: list[Scenario], rows: int) -> OutputPlan:
    """The weightiest scenarios, one for each row asked for."""
    ranked = sorted(found, key=lambda s: (-s.weight, s.id))
    shown = ranked[:rows]
    weight = sum(s.weight for s in ranked)
    return OutputPlan(rows, tuple(s.id for s in shown), tuple((s.id, s.kind, s.weight) for s in ranked), sum(s.weight for s in shown) / weight if weight else 1.0)


def coverage_view(df: DataFrame, found: list[Scenario]) -> DataFrame:
    """scenario, kind, weight, n, status: how often an output shows each scenario."""
    rows = [(s.id, s.kind, s.weight) for s in found]
    asked = df.sparkSession.createDataFrame(rows, "scenario string, kind string, weight int")
    seen = matched(df, found).select(F.explode("scenario_ids").alias("scenario")).groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(seen, "scenario", "left").select("scenario", "kind", "weight", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, "COVERED").otherwise("MISSING").alias("status"))


def coverage_notice(plan: OutputPlan, view: DataFrame, most: int = 4) -> tuple[dict, str | None]:
    """required, covered, missing and the covered share of all weight; and a sentence where scenarios are missing.

    ``view`` is the coverage view of the output. A scenario beyond the plan's rows lacks a row; another one that is missing has
    none that could show it, so more rows won't help."""
    rows = {r["scenario"]: r for r in view.collect()}  # at most MOST_SCENARIOS
    missing = [i for i, _, _ in plan.scenarios if rows[i]["status"] == "MISSING"]
    weight = sum(w for _, _, w in plan.scenarios)
    shown = sum(w for i, _, w in plan.scenarios if i not in missing)
    said = {"required": len(plan.scenarios), "covered": len(plan.scenarios) - len(missing), "missing": len(missing), "ratio": shown / weight if weight else 1.0}
    short = [i for i in missing if i not in plan.mandatory]
    if short:
        return said, f"{plan.rows} rows are too few for {len(plan.scenarios)} scenarios; {len(short)} may be left out"
    if missing:
        return said, f"no row shows {', '.join(missing[:most])}{', ...' if len(missing) > most else ''}; more rows won't help"
    return said, None


def synthetic_rows(source: DataFrame, policies: list, n: int, seed: int = 1) -> DataFrame:
    """Rows drawn column by column from the source's distributions, for an output without any template row."""
    from quillmask.operators.resample import drawn

    out = source.sparkSession.range(n).withColumnRenamed("id", "s_row")
    for p in policies:
        if p.action != "DROP":
            out = drawn(out.withColumn(p.column, F.lit("")), p.column, p.detected, source, "s_drawn", F.col("s_row"), seed, f"synthetic:{p.column}").drop(p.column).withColumnRenamed("s_drawn", p.column)
    return out.drop("s_row")
