"""Configuration: output columns, settings of any known version, names, stored field sets, and views of policies."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillmask.operators.actions import Policy, shift_kind
from quillmask.operators.generate import Field

VERSION = 3
# How input controls name delimiters.
DELIMITER_NAMES = {"comma": ",", "tab": "\t", "semicolon": ";", "pipe": "|"}


@dataclass(frozen=True)
class OutputColumn:
    id: str
    name: str
    position: int
    origin: str = "SOURCE"  # or GENERATED
    enabled: bool = True


def source_columns(names: list[str]) -> list[OutputColumn]:
    return [OutputColumn(f"source-{i + 1}", n, i) for i, n in enumerate(names)]


def combined(*groups: list[OutputColumn]) -> list[OutputColumn]:
    """All columns in a row, ids made distinct and positions renumbered."""
    out, seen = [], set()
    for c in (c for g in groups for c in g):
        name, k = c.id, 2
        while name in seen:
            name, k = f"{c.id}-{k}", k + 1
        seen.add(name)
        out.append(replace(c, id=name, position=len(out)))
    return out


def active(columns: list[OutputColumn]) -> list[OutputColumn]:
    return sorted((c for c in columns if c.enabled), key=lambda c: c.position)


def schema(columns: list[OutputColumn]) -> StructType:
    """The output as strings; two active columns with one name are an error."""
    names = [c.name for c in active(columns)]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice or not all(n.strip() for n in names):
        raise ValueError(f"output columns need distinct names: {', '.join(twice) or 'one is blank'}")
    return StructType([StructField(n, StringType(), metadata={"id": c.id, "origin": c.origin}) for n, c in zip(names, active(columns), strict=True)])


def clean_name(name: str, taken: list[str] = (), most: int = 64) -> str:
    """A table or column name without control characters and outer blanks, numbered if it is taken (whatever its case)."""
    base = re.sub(r"\s+", " ", re.sub(r"[\x00-\x1f\x7f]", " ", name)).strip()[:most] or "table"
    used, out, k = {t.lower() for t in taken}, base, 2
    while out.lower() in used:
        out, k = f"{base}_{k}", k + 1
    return out


def input_options(controls: dict) -> dict:
    """Reader arguments from input controls; unknown controls are refused."""
    known = {"delimiter", "custom_delimiter", "header", "faithful", "text"}
    if set(controls) - known:
        raise ValueError(f"unknown controls: {', '.join(sorted(set(controls) - known))}")
    name = controls.get("delimiter", "auto")
    delimiter = None if name == "auto" else controls.get("custom_delimiter") if name == "custom" else DELIMITER_NAMES[name]
    header = {"auto": None, "yes": True, "no": False}[controls.get("header", "auto")]
    return {"delimiter": delimiter, "header": header, "faithful": bool(controls.get("faithful", False))}


def upgraded(config: dict) -> dict:
    """Settings of an older version as the present one. 1 had one flat list, 2 named generators ``type`` and null rates in percent."""
    out = dict(config)
    version = out.get("version", 1)
    if not 1 <= version <= VERSION:
        raise ValueError(f"version {version} isn't known")
    if version == 1:
        out["columns"] = out.pop("generated", out.get("columns", []))
    if version <= 2:
        out["columns"] = [{("generator" if k == "type" else k): v for k, v in c.items()} for c in out.get("columns", [])]
        out["columns"] = [c | {"null_rate": c["null_rate"] / 100} if c.get("null_rate", 0) > 1 else c for c in out["columns"]]
    return out | {"version": VERSION}


def fields_of(config: dict) -> tuple[Field, ...]:
    """Generated columns of a configuration: names made distinct, steps of sequences never zero, disabled ones left out."""
    out: list[Field] = []
    for c in upgraded(config)["columns"]:
        if not c.get("enabled", True):
            continue
        settings = dict(c.get("settings", {}))
        if c["generator"] == "sequence":
            settings["step"] = settings.get("step") or 1
            settings["width"] = max(1, min(20, settings.get("width", 5)))
        out.append(Field(clean_name(c["name"], [f.name for f in out]), c["generator"], settings, min(1.0, max(0.0, c.get("null_rate", 0.0)))))
    return tuple(out)


def stored_fields(fields: tuple[Field, ...], name: str) -> str:
    """A named set of generated columns as JSON."""
    return json.dumps({"version": VERSION, "name": clean_name(name), "columns": [asdict(f) for f in fields]}, indent=1)


def restored_fields(text: str) -> tuple[str, tuple[Field, ...]]:
    said = json.loads(text)
    return said.get("name", ""), fields_of(said)


#: Columns of a set that others are made from can't be taken out of it.
def protected(fields: tuple[Field, ...]) -> set[str]:
    return {need for f in fields for need in f.needs()}


def without(fields: tuple[Field, ...], name: str) -> tuple[Field, ...]:
    if name in protected(fields):
        raise ValueError(f"{name} is needed by another column")
    return tuple(f for f in fields if f.name != name)


def policy_view(frame: DataFrame, search: str = "", risk: str | None = None, action: str | None = None, review: bool = False, page: int = 1, size: int = 12) -> DataFrame:
    """A page of an analysis: rows whose column, type or action hold the search text, by column order of the name."""
    out = frame
    if search.strip():
        wanted = search.strip().lower()
        out = out.where(F.lower(F.concat_ws(" ", "column_name", "detected_type", "action")).contains(wanted))
    if risk:
        out = out.where(F.col("risk") == risk)
    if action:
        out = out.where(F.col("action") == action)
    if review:
        out = out.where(F.col("confidence") != "HIGH")
    return out.orderBy("column_name").offset((page - 1) * size).limit(size)


#: What an action's parameters may be, with their defaults.
PARAMETERS: dict[str, dict] = {
    "REPLACE": {"repeat": "AUTO", "code_shape": False, "unique": False}, "PATTERN_REPLACE": {"repeat": "AUTO", "mode": "AUTO", "mask": "", "keep_prefix": 0, "keep_suffix": 0, "lists": False, "unique": False},
    "SHIFT": {"offset": 30, "unit": "DAYS", "layout": "YMD", "segment": 0, "preserve_width": True, "kind": None}, "GENERALISE": {"strategy": "AUTO", "level": "MEDIUM", "layout": "YMD"},
    "RESAMPLE": {}, "KEEP": {}, "CLEAR": {}, "DROP": {}, "TEXT_SANITISE": {},
}
REASONS = {
    "KEEP": "low risk", "REPLACE": "identifies someone", "PATTERN_REPLACE": "an identifier whose form matters", "SHIFT": "dates keep their distances", "RESAMPLE": "its distribution matters, its values don't",
    "GENERALISE": "a coarser value is enough", "TEXT_SANITISE": "text may hold identifiers", "CLEAR": "not understood", "DROP": "not wanted",
}


def with_defaults(p: Policy) -> tuple[Policy, list[str]]:
    """A policy with all parameters of its action, and warnings about those it doesn't take."""
    known = PARAMETERS[p.action]
    odd = sorted(set(p.params) - set(known))
    params = {k: p.params.get(k, v) for k, v in known.items() if p.params.get(k, v) is not None}
    return replace(p, params=params), [f"{p.column}: {p.action} takes no {k}" for k in odd]


def with_offsets(policies: list[Policy], days: int | None = None, minutes: int | None = None, number: int | None = None) -> list[Policy]:
    """SHIFT policies by one offset for all dates, one for all times and one for all numbers; others stay as they are.

    A kind for which no offset is given stays too. An offset of zero is refused, and so are ambiguous dates: their layout is a
    choice of its own."""
    by_kind = {"DATE": (days, "DAYS"), "TIME": (minutes, "MINUTES"), "NUMBER": (number, "INTEGER")}
    if 0 in (days, minutes, number):
        raise ValueError("offsets are integers other than zero")
    out = []
    for p in policies:
        offset, unit = by_kind[shift_kind(p)] if p.action == "SHIFT" else (None, "")
        if offset is not None and p.detected == "AMBIGUOUS_DATE":
            raise ValueError(f"{p.column}: choose DMY or MDY for it first")
        out.append(p if offset is None else p.with_action("SHIFT", **p.params | {"offset": offset, "unit": unit}))
    return out


def explained(p: Policy) -> str:
    return f"{p.column} is {p.detected.lower().replace('_', ' ')}, {p.role.lower().replace('_', ' ')}, risk {p.risk.lower()}: {p.action}, since {REASONS[p.action]}"
