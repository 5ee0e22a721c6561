"""Relationships between columns: proposals from headers, evidence from rows in one pass, and their enforcement."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.functions.ordinals import with_rank
from quillmask.functions.temporal import as_date
from quillmask.functions.text import boolean, business_number, cell, text

# Parts of headers that make a column likelier to be in a business rule, and how much.
HEADER_WEIGHTS = (
    (10, "price qty quantity amount total cost stock balance count rate percent shipping".split()),
    (6, "available status active enabled".split()),
)
MAX_NUMERIC, MAX_BOOLEAN, CONFIDENCE, CLOSE = 24, 16, 0.995, 1e-8
KINDS = ("NUMERIC_EQUAL", "NUMERIC_DIFFERENCE", "NUMERIC_RATIO", "BOOLEAN_FROM_POSITIVE", "POSITIVE_FROM_BOOLEAN")


@dataclass(frozen=True)
class Rule:
    kind: str
    columns: tuple[str, ...]
    status: str = "CANDIDATE"  # CANDIDATE, CONFIRMED, INFORMATIONAL, UNSUPPORTED
    enabled: bool = False
    support: int = 0
    confidence: float = 0.0
    options: dict = field(default_factory=dict)

    @property
    def active(self) -> bool:
        return self.enabled and self.status == "CONFIRMED"

    def confirmed(self) -> Rule:
        return Rule(self.kind, self.columns, "CONFIRMED", True, self.support, self.confidence, self.options)


def normalised(header: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", header).lower()).strip("_")


def proposed(headers: list[str]) -> list[Rule]:
    """Informational pairs by name: code and description, start and end dates, equal identifiers."""
    out, names = [], {h: normalised(h) for h in headers}
    base = lambda n: re.sub(r"_(?:code|id|description|desc|name|label)$", "", n)
    for a, b in itertools.permutations(headers, 2):
        na, nb = names[a], names[b]
        if base(na) == base(nb) and re.search(r"_code$", na) and re.search(r"_(?:description|desc)$", nb):
            out.append(Rule("CODE_DESCRIPTION", (a, b), "INFORMATIONAL"))
        if base(na) == base(nb) and re.search(r"_code$", na) and re.search(r"_name$", nb):
            out.append(Rule("CATEGORY_CODE_NAME", (a, b), "INFORMATIONAL"))
        if re.sub(r"start|from|open(?:ed)?|created", "", na) == re.sub(r"end|to|closed?|completed", "", nb) and na != nb and re.search("date", na) and re.search("date", nb):
            out.append(Rule("DATE_ORDER", (a, b), "INFORMATIONAL"))
        if a < b and na == nb and re.search(r"(^|_)id$", na):
            out.append(Rule("SAME_ID", (a, b), "INFORMATIONAL"))
    return out


def by_priority(columns: list[str]) -> list[str]:
    """Numeric columns that are likeliest to take part in business rules first; equals keep their order."""
    weight = lambda c: sum(w for w, words in HEADER_WEIGHTS if any(x in c.lower() for x in words))
    return sorted(columns, key=weight, reverse=True)


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(CLOSE) * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def mined(df: DataFrame, numeric: list[str], booleans: list[str] = (), order: Column | None = None) -> list[Rule]:
    """Rules between columns that nearly all rows support: two aggregations over the table, whatever the pairs.

    Differences and ratios are held against those of the first row (by ``order``) that has both numbers.
    """
    numeric, booleans = by_priority(numeric)[:MAX_NUMERIC], list(booleans)[:MAX_BOOLEAN]
    order = order if order is not None else F.xxhash64(*[df[c] for c in df.columns])
    rows = df.select(order.alias("o"), *[business_number(cell(df, c)).alias(f"n{i}") for i, c in enumerate(numeric)], *[boolean(df[c]).alias(f"b{i}") for i, c in enumerate(booleans)])
    pairs = list(itertools.combinations(range(len(numeric)), 2))
    both = lambda i, j: F.col(f"n{i}").isNotNull() & F.col(f"n{j}").isNotNull()
    if not pairs and not (numeric and booleans):
        return []
    firsts = [F.min_by(F.struct(f"n{i}", f"n{j}"), F.when(both(i, j), F.col("o"))).alias(f"f{i}_{j}") for i, j in pairs]
    first = rows.agg(*firsts).first() if pairs else None
    tests = {}
    for i, j in pairs:
        seen = first[f"f{i}_{j}"]
        if seen is None or seen[0] is None or seen[1] is None:
            continue
        a, b = F.col(f"n{i}"), F.col(f"n{j}")
        tests["NUMERIC_EQUAL", i, j, None] = (both(i, j), _close(a, b))
        tests["NUMERIC_DIFFERENCE", i, j, seen[1] - seen[0]] = (both(i, j), _close(b - a, F.lit(seen[1] - seen[0])))
        if abs(seen[0]) > 1e-12:
            ratio = seen[1] / seen[0]
            tests["NUMERIC_RATIO", i, j, ratio] = (both(i, j) & (F.abs(a) > 1e-12), _close(F.try_divide(b, a), F.lit(ratio)))
    for i, j in itertools.product(range(len(numeric)), range(len(booleans))):
        tests["POSITIVE_FROM_BOOLEAN", i, j, None] = (F.col(f"n{i}").isNotNull() & F.col(f"b{j}").isNotNull(), F.when(F.col(f"b{j}"), F.col(f"n{i}") > 0).otherwise(F.col(f"n{i}") <= 0))
        tests["BOOLEAN_FROM_POSITIVE", i, j, None] = (F.col(f"n{i}").isNotNull() & F.col(f"b{j}").isNotNull(), (F.col(f"n{i}") > 0) == F.col(f"b{j}"))
    counted = [c for k, (seen, ok) in enumerate(tests.values()) for c in (F.count_if(seen).alias(f"s{k}"), F.count_if(seen & ok).alias(f"m{k}"))]
    if not counted:
        return []
    got, found = rows.agg(*counted).first(), []
    for k, (kind, i, j, constant) in enumerate(tests):
        n, match = got[f"s{k}"], got[f"m{k}"]
        if kind == "NUMERIC_DIFFERENCE" and constant == 0 or kind == "NUMERIC_RATIO" and constant == 1:
            continue
        if match >= max(3, min(20, -(-n // 10))) and match >= CONFIDENCE * n:
            pair = (numeric[i], booleans[j]) if kind == "BOOLEAN_FROM_POSITIVE" else (booleans[j], numeric[i]) if kind == "POSITIVE_FROM_BOOLEAN" else (numeric[i], numeric[j])
            found.append(Rule(kind, pair, "CANDIDATE", False, match, match / n, {} if constant is None else {"constant": constant}))
    best: dict[str, Rule] = {}
    for r in sorted(found, key=lambda r: (KINDS.index(r.kind), -r.confidence, -r.support, r.columns)):
        best.setdefault(r.columns[-1], r)
    return list(best.values())


def enforced(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rewrite the last column of each active rule from the first; later rules see earlier writes."""
    for r in (r for r in rules if r.active):
        a, b = r.columns[0], r.columns[-1]
        x = business_number(F.col(a))
        if r.kind == "CODE_DESCRIPTION":
            value = F.concat(F.lit("Test description for "), F.col(a).cast("string"))
        elif r.kind == "NUMERIC_EQUAL":
            value = x
        elif r.kind == "NUMERIC_DIFFERENCE":
            value = x + F.lit(r.options["constant"])
        elif r.kind == "NUMERIC_RATIO":
            value = x * F.lit(r.options["constant"])
        elif r.kind == "BOOLEAN_FROM_POSITIVE":
            value = x > 0
        else:
            continue
        df = df.withColumn(b, F.coalesce(value.cast(df.schema[b].dataType), F.col(b)))
    return df


def holds(df: DataFrame, rule: Rule) -> Column:
    """Whether a row keeps a rule: null where it can't be judged."""
    a, b = cell(df, rule.columns[0]), cell(df, rule.columns[-1])
    x, y = business_number(a), business_number(b)
    constant = F.lit(float(rule.options.get("constant", 1.0 if rule.kind == "NUMERIC_RATIO" else 0.0)))
    if rule.kind == "BOOLEAN_FROM_POSITIVE":
        return (x > 0) == boolean(b)
    if rule.kind == "POSITIVE_FROM_BOOLEAN":
        return F.when(boolean(a), y > 0).otherwise(F.when(boolean(a).isNotNull(), y <= 0))
    if rule.kind in ("NUMERIC_EQUAL", "NUMERIC_DIFFERENCE", "NUMERIC_RATIO"):
        want = x if rule.kind == "NUMERIC_EQUAL" else x + constant if rule.kind == "NUMERIC_DIFFERENCE" else x * constant
        return F.abs(want - y) <= 0.005 + CLOSE * F.abs(want)
    if rule.kind == "SAME_ID":
        same = [text(a).eqNullSafe(text(cell(df, c))) for c in rule.columns[1:]]
        return reduce(lambda p, q: p & q, same)
    if rule.kind in ("DATE_ORDER", "DATE_TIME_SHIFT_GROUP"):
        dates = [as_date(cell(df, c), rule.options.get("layout", "YMD")) for c in rule.columns]
        return reduce(lambda p, q: p & q, [p <= q for p, q in zip(dates, dates[1:], strict=False)])
    raise ValueError(f"{rule.kind} isn't a rule between the cells of a row")


def rule_violations(df: DataFrame, rule: Rule) -> DataFrame:
    """violations, checked. Codes and descriptions are held against the first description of each code."""
    if rule.kind in ("CODE_DESCRIPTION", "CATEGORY_CODE_NAME"):
        a, b = rule.columns[0], rule.columns[-1]
        pairs = df.select(text(cell(df, a)).alias("code"), text(cell(df, b)).alias("name")).groupBy("code", "name").agg(F.count(F.lit(1)).alias("n"))
        per = pairs.where("code <> ''").groupBy("code").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
        return per.agg(F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("violations"), F.coalesce(F.sum("n"), F.lit(0)).alias("checked"))
    ok = df.select(holds(df, rule).alias("ok"))
    return ok.agg(F.count_if(~F.col("ok")).alias("violations"), F.count("ok").alias("checked"))


@dataclass(frozen=True)
class Registry:
    """Confirmed rules that don't conflict: a column is written by one rule at most, and is in one mapping and one shift group."""

    rules: tuple[Rule, ...] = ()

    def conflict(self, rule: Rule) -> str | None:
        """Why a rule can't join those that are active."""
        for r in (r for r in self.rules if r.active and r != rule):
            if r.kind == rule.kind and r.columns == rule.columns:
                return "the rule is there already"
            if r.kind in KINDS and rule.kind in KINDS and r.columns[-1] == rule.columns[-1]:
                return f"{rule.columns[-1]} is already written by {r.kind}"
            if r.kind == rule.kind and r.kind in ("MAPPING_GROUP", "DATE_TIME_SHIFT_GROUP") and set(r.columns) & set(rule.columns):
                return f"{', '.join(sorted(set(r.columns) & set(rule.columns)))} is already in such a group"
        return None

    def confirm(self, rule: Rule) -> Registry:
        why = self.conflict(rule)
        if why:
            raise ValueError(why)
        return Registry((*[r for r in self.rules if (r.kind, r.columns) != (rule.kind, rule.columns)], rule.confirmed()))

    def scope(self, column: str) -> str:
        """What the replacements of a column are drawn for: its mapping group, or the column alone."""
        for r in self.rules:
            if r.active and r.kind in ("MAPPING_GROUP", "SAME_ID") and column in r.columns:
                return "group:" + "|".join(r.columns)
        return column

    def shift_group(self, column: str) -> tuple[str, ...]:
        """The columns that are shifted by one offset with this one."""
        return next((r.columns for r in self.rules if r.active and r.kind == "DATE_TIME_SHIFT_GROUP" and column in r.columns), (column,))


def mapping_group(*columns: str) -> Rule:
    """A user's rule: equal values in these columns get equal replacements."""
    if len(set(columns)) < 2:
        raise ValueError("a mapping group has two columns or more")
    return Rule("MAPPING_GROUP", tuple(columns))


def date_shift_group(*columns: str, keep_order: bool = True) -> Rule:
    """A user's rule: these dates move by one offset, and stay in this order where ``keep_order`` says so."""
    if len(set(columns)) < 2:
        raise ValueError("a shift group has two columns or more")
    return Rule("DATE_TIME_SHIFT_GROUP", tuple(columns), options={"keep_order": keep_order})


def rank_aligned(source: DataFrame, output: DataFrame, column: str, key: str) -> DataFrame:
    """``output`` with the values of ``column`` dealt out again in the order of the source's values for the same key."""
    number = lambda df: business_number(cell(df, column))
    s = source.select(source[key].alias("a_key"), number(source).alias("x")).where("x is not null")
    pairs = output.select(output[key].alias("d_key"), output[column].alias("dealt"), number(output).alias("y")).where("y is not null").join(s, F.col("d_key").eqNullSafe(F.col("a_key")))
    wanted = with_rank(pairs.select("d_key", "x"), "x", ["d_key"], "rank")
    values = with_rank(pairs.select(F.col("d_key").alias("v_key"), "dealt", "y"), "y", ["v_key"], "rank")
    dealt = wanted.join(values, "rank").select("d_key", "dealt")
    out = output.join(dealt, output[key].eqNullSafe(F.col("d_key")), "left")
    return out.select(*[F.coalesce("dealt", output[c]).alias(c) if c == column else output[c] for c in output.columns])
