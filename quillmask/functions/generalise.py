"""Generalisation: bands, prefixes, groups and coarser dates. All deterministic expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmask.functions.temporal import as_date, clock_seconds
from quillmask.functions.text import fnv1a, let, number, numeric_token, trimmed

LEVELS = ("LOW", "MEDIUM", "HIGH")
# Widths and counts for LOW, MEDIUM, HIGH.
AGE_WIDTHS, BAND_FACTORS, PREFIX_LENGTHS, GROUP_COUNTS, TEXT_WIDTHS = (5, 10, 20), (1, 5, 10), (3, 2, 1), (20, 10, 5), (10, 20, 50)
NUMERIC_TYPES = ("INTEGER", "DECIMAL", "PERCENTAGE", "CURRENCY_LIKE")
DATE_TYPES = ("DATE", "AMBIGUOUS_DATE", "DATETIME", "TIME")


def strategy_for(column: str, detected: str, strategy: str = "AUTO") -> str:
    if strategy != "AUTO":
        return strategy
    if re.search(r"\bage\b", column, re.I):
        return "AGE_BAND"
    if re.search(r"post\s*code|postal|\bzip\b", column, re.I):
        return "POSTCODE_PREFIX"
    if detected in DATE_TYPES:
        return "DATE_PRECISION"
    if detected in NUMERIC_TYPES:
        return "NUMERIC_BAND"
    if detected in ("CATEGORY", "ADDRESS_LIKE") or re.search(r"address|street|suburb|city", column, re.I):
        return "CATEGORY_GROUP"
    return "TEXT_LENGTH_BAND"


def label(column: str) -> str:
    """A column name as at most four words, for synthetic labels."""
    words = re.findall(r"[^\W_]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", column))[:4]
    return " ".join(w[:1].upper() + w[1:] for w in words)[:48].strip() or "Category"


def _band(lower: Column, upper: Column) -> Column:
    return F.concat(lower.cast("long").cast("string"), F.lit("-"), upper.cast("long").cast("string"))


def generalised(c: Column, column: str = "", detected: str = "UNKNOWN", strategy: str = "AUTO", level: str = "MEDIUM", layout: str = "YMD") -> Column:
    chosen = strategy_for(column, detected, strategy)
    numeric = chosen in ("AGE_BAND", "NUMERIC_BAND")
    return let(trimmed(c), lambda t: let(F.struct(t.alias("t"), (number(t) if numeric else F.lit(None).cast("double")).alias("x")), lambda p: _coarser(p["t"], p["x"], chosen, column, detected, level, layout)))


def _coarser(t: Column, x: Column, chosen: str, column: str, detected: str, level: str, layout: str) -> Column:
    """The coarser form of a trimmed cell ``t``, of which ``x`` is the number."""
    at = LEVELS.index(level) if level in LEVELS else 1
    width = TEXT_WIDTHS[at]
    lower = F.floor(F.greatest(F.lit(1), F.length(t) - 1) / width) * width + 1
    by_length = F.concat(F.lit("Text length "), _band(lower, lower + width - 1))
    if chosen == "AGE_BAND":
        low = F.floor(x / AGE_WIDTHS[at]) * AGE_WIDTHS[at]
        out = F.when(x.isNotNull(), _band(low, low + AGE_WIDTHS[at] - 1)).otherwise(by_length)
    elif chosen == "POSTCODE_PREFIX":
        compact, keep = F.regexp_replace(t, r"\s+", ""), PREFIX_LENGTHS[at]
        out = F.concat(F.substring(compact, 1, keep), F.repeat(F.lit("*"), F.greatest(F.lit(1), F.length(compact) - keep)))
    elif chosen == "DATE_PRECISION":
        if detected == "TIME":
            s = F.coalesce(clock_seconds(t), F.lit(0))
            hour = F.floor(s / 3600)
            hour = F.floor(hour / 8) * 8 if level == "HIGH" else hour
            minute = F.floor(s % 3600 / 60) if level == "LOW" else F.lit(0)
            out = F.format_string("%02d:%02d:00", hour.cast("int"), minute.cast("int"))
        else:
            d = as_date(t, layout)
            year = F.coalesce(F.year(d), F.lit(2000))
            year = F.when(d.isNotNull(), F.floor(year / 10) * 10).otherwise(year) if level == "HIGH" else year
            month = F.coalesce(F.month(d), F.lit(1)) if level == "LOW" else F.lit(1)
            out = F.format_string("%04d-%02d-01" + (" 00:00:00" if detected == "DATETIME" else ""), year.cast("int"), month.cast("int"))
    elif chosen == "NUMERIC_BAND":
        size = F.when(x == 0, 1.0).otherwise(F.abs(x))
        magnitude = F.pow(F.lit(10.0), F.greatest(F.lit(0.0), F.floor(F.log10(size)) - 2))
        step = magnitude * BAND_FACTORS[at]
        low = F.floor(x / step) * step
        band = _band(low, low + step - magnitude)
        if detected == "PERCENTAGE":
            band = F.concat(band, F.lit("%"))
        if detected == "CURRENCY_LIKE":
            band = F.concat(F.coalesce(numeric_token(t)["currency_marker"], F.lit("$")), band)
        out = F.when(x.isNotNull(), band).otherwise(by_length)
    elif chosen == "CATEGORY_GROUP":
        out = F.concat(F.lit(f"Synthetic {label(column)} Group "), (fnv1a(t) % GROUP_COUNTS[at] + 1).cast("string"))
    else:
        out = by_length
    return F.when(t == "", "").otherwise(out)
