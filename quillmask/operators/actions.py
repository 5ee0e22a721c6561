"""Column actions. A plan of policies becomes one projection; only stable replacement of distinct values needs a join."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.functions.generalise import generalised, label
from quillmask.functions.keyed import integer, key_hash, pick, uniform
from quillmask.functions.patterns import item_wise, masked
from quillmask.functions.temporal import shifted_date, shifted_segment, shifted_time
from quillmask.functions.text import cell, is_empty, let, sanitised, text, trimmed

ACTIONS = ("KEEP", "REPLACE", "PATTERN_REPLACE", "SHIFT", "RESAMPLE", "GENERALISE", "TEXT_SANITISE", "CLEAR", "DROP")


@dataclass(frozen=True)
class Policy:
    column: str
    action: str = "KEEP"
    detected: str = "UNKNOWN"
    role: str = "ORDINARY"
    risk: str = "UNKNOWN"
    params: dict = field(default_factory=dict)
    scope: str = ""

    def __post_init__(self):
        if self.action not in ACTIONS:
            raise ValueError(f"{self.column}: unknown action {self.action}")
        if self.action == "SHIFT" and not self.params.get("offset"):
            raise ValueError(f"{self.column}: SHIFT needs a non-zero integer offset")

    def with_action(self, action: str, **params) -> Policy:
        return Policy(self.column, action, self.detected, self.role, self.risk, params, self.scope)


def validated(columns: list[str], policies: list[Policy]) -> list[Policy]:
    """Exactly one policy for each column, in order."""
    names = [p.column for p in policies]
    if len(set(names)) != len(names):
        raise ValueError("a column has two policies")
    if names != list(columns):
        raise ValueError(f"policies and columns differ: {sorted(set(names) ^ set(columns)) or 'order'}")
    return policies


def identity(p: Policy, value: Column, row: Column) -> Column:
    """What a replacement depends on: the value (CONSISTENT, and AUTO) or the row (INDEPENDENT)."""
    return row.cast("string") if p.params.get("repeat", "AUTO") == "INDEPENDENT" else trimmed(value)


def token(seed: int, scope: str, n: int, *key: Column) -> Column:
    return F.substring(F.lower(F.concat(*[F.lpad(F.conv(key_hash(seed, f"{scope}:{i}", *key).bitwiseAND(F.lit(0x7FFFFFFFFFFF).cast("long")).cast("string"), 10, 36), 9, "0") for i in range(-(-n // 8))])), 2, n)


def replaced(p: Policy, value: Column, row: Column, seed: int) -> Column:
    key, scope, kind = identity(p, value, row), p.scope or p.column, p.detected
    mark = F.upper(token(seed, scope, 6, key))
    two = lambda lo, hi, s: F.lpad(integer(seed, f"{scope}:{s}", lo, hi, key).cast("string"), 2, "0")
    made = {
        "EMAIL": F.concat(F.lit("test_"), token(seed, scope, 8, key), F.lit("@example.invalid")),
        "NAME_LIKE": F.concat(F.lit("Test Person "), mark),
        "ADDRESS_LIKE": F.concat(integer(seed, scope, 1, 999, key).cast("string"), F.lit(" Blank Ledger Lane, Inkborough")),
        "BOOLEAN": pick(seed, scope, ["true", "false"], key),
        "INTEGER": integer(seed, scope, 1, 2_000_000_000, key).cast("string"),
        "NUMERIC_ID": integer(seed, scope, 1, 2_000_000_000, key).cast("string"),
        "DECIMAL": F.format_string("%.2f", uniform(seed, scope, key) * 1000),
        "DATE": F.concat_ws("-", integer(seed, f"{scope}:y", 2020, 2035, key).cast("string"), two(1, 12, "m"), two(1, 28, "d")),
        "TIME": F.concat(two(0, 23, "h"), F.lit(":"), two(0, 59, "i"), F.lit(":00")),
        "CATEGORY": F.concat(F.lit(f"Synthetic {label(p.column)} "), integer(seed, scope, 1, 12, key).cast("string")),
    }.get({"AMBIGUOUS_DATE": "DATE", "DATETIME": "DATE", "PERCENTAGE": "DECIMAL", "CURRENCY_LIKE": "DECIMAL"}.get(kind, kind))
    if kind == "PHONE_LIKE":
        made = pattern_replaced(p, value, row, seed)
    if p.params.get("code_shape"):  # codes of one family (their leading letters) stay one family
        family = F.regexp_extract(trimmed(value), r"^(\p{L}{2,8})(?=[\p{N}_./#-])", 1)
        made = F.concat(F.when(family != "", F.upper(token(seed, f"{scope}:family", 3, family))).otherwise(""), F.lit("-"), mark)
    return made if made is not None else F.concat(F.lit(f"Synthetic {label(p.column)} "), mark)


def pattern_replaced(p: Policy, value: Column, row: Column, seed: int) -> Column:
    """Letters and digits drawn anew, their kinds, case, separators and asked-for affixes kept.

    ``mode`` CUSTOM draws by ``mask`` instead; ``lists`` treats each item of a cell by itself, equal items alike."""
    scope = p.scope or p.column
    if p.params.get("mode") == "CUSTOM" and p.params.get("mask"):
        return masked(p.params["mask"], seed, scope, identity(p, value, row))
    if p.params.get("lists"):
        return item_wise(value, lambda x: _redrawn(p, x, x, seed, scope))
    return _redrawn(p, value, identity(p, value, row), seed, scope)


def _redrawn(p: Policy, value: Column, key: Column, seed: int, scope: str) -> Column:
    chars = F.filter(F.split(text(value), ""), lambda c: c != "")
    keep_head, keep_tail = p.params.get("keep_prefix", 0), p.params.get("keep_suffix", 0)
    if p.params.get("mode") == "REGENERATE_ALL":
        keep_head = keep_tail = 0

    def draw(c: Column, i: Column, n: Column) -> Column:
        at = lambda k: F.pmod(F.xxhash64(F.lit(f"{seed}|{scope}"), key, i), F.lit(k)).cast("int")
        letter = lambda alphabet: F.substr(F.lit(alphabet), at(26) + 1, F.lit(1))
        return (
            F.when((i < keep_head) | (i >= n - keep_tail), c).when(c.rlike(r"\p{Lu}"), letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike(r"\p{L}"), letter("abcdefghijklmnopqrstuvwxyz"))
            .when(c.rlike(r"\p{N}"), at(10).cast("string")).otherwise(c)
        )

    return let(chars, lambda cs: F.concat_ws("", F.transform(cs, lambda c, i: draw(c, i, F.size(cs)))))


def shift_kind(p: Policy) -> str:
    """DATE, TIME or NUMBER: as a SHIFT policy says, or else by what was detected."""
    return p.params.get("kind") or ("TIME" if p.detected == "TIME" else "NUMBER" if p.detected in ("INTEGER", "NUMERIC_ID", "ALPHANUMERIC_CODE") else "DATE")


def shifted(p: Policy, value: Column) -> Column:
    kind, by = shift_kind(p), p.params["offset"]
    if kind == "TIME":
        return shifted_time(value, by * (60 if p.params.get("unit") == "HOURS" else 1))
    if kind == "NUMBER":
        return shifted_segment(text(value), by, p.params.get("segment", 0), p.params.get("preserve_width", True))
    return shifted_date(text(value), by, p.params.get("layout", "YMD"))


def transformed(df: DataFrame, policies: list[Policy], row: Column | None = None, seed: int = 1, keep_blanks: bool = True, source: DataFrame | None = None, shares: dict[str, Column] | None = None) -> DataFrame:
    """The whole table through its policies: one projection, dropped columns left out, blanks kept blank.

    RESAMPLE draws from ``source`` (``df`` itself by default) by a join with its counted values; ``shares`` may place a
    column's draws (see ``resample.stratified_share``)."""
    from quillmask.operators.resample import drawn

    validated(df.columns, policies)
    row = row if row is not None else F.xxhash64(*[df[c] for c in df.columns])
    held, names = df.withColumn("m_row", row), {}
    for i, p in enumerate(policies):
        if p.action == "RESAMPLE":
            names[p.column] = f"m_{i}"
            held = drawn(held, p.column, p.detected, source if source is not None else df, f"m_{i}", F.col("m_row"), seed, p.scope or p.column, (shares or {}).get(p.column))
    out, row = [], F.col("m_row")
    for p in policies:
        c = cell(held, p.column)
        if p.action == "DROP":
            continue
        made = {
            "KEEP": lambda p, c: text(c),
            "CLEAR": lambda p, c: F.lit(""),
            "REPLACE": lambda p, c: replaced(p, c, row, seed),
            "PATTERN_REPLACE": lambda p, c: pattern_replaced(p, c, row, seed),
            "SHIFT": lambda p, c: shifted(p, c),
            "RESAMPLE": lambda p, c: F.col(names[p.column]),
            "GENERALISE": lambda p, c: generalised(c, p.column, p.detected, p.params.get("strategy", "AUTO"), p.params.get("level", "MEDIUM"), p.params.get("layout", "YMD")),
            "TEXT_SANITISE": lambda p, c: sanitised(c),
        }[p.action](p, c)
        out.append((F.when(is_empty(c), "").otherwise(made) if keep_blanks and p.action != "CLEAR" else made).alias(p.column))
    return held.select(*out)


def unique_mapping(df: DataFrame, column: str, prefix: str = "TST-", width: int = 8, seed: int = 1) -> DataFrame:
    """original, replacement: distinct values numbered in the order of a keyed hash, so replacements never collide."""
    from quillmask.functions.ordinals import with_rank

    values = df.select(trimmed(df[column]).alias("original")).where("original <> ''").distinct()
    ranked = with_rank(values.withColumn("h", uniform(seed, column, F.col("original"))), "h", ["original"], "rank")
    return ranked.select("original", F.concat(F.lit(prefix), F.lpad(F.col("rank").cast("string"), width, "0")).alias("replacement"))


def previewed(df: DataFrame, policies: list[Policy], n: int = 3, seed: int = 1) -> DataFrame:
    return transformed(df.limit(n), policies, seed=seed)
