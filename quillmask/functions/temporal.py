"""Dates and times kept as written: parsed into parts with their layout, shifted, and written back alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmask.functions.text import let, trimmed

_DATE = {
    "YMD": (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(.*)$", (1, 3, 4)),
    "DMY": (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})(?!\d)(.*)$", (4, 3, 1)),
    "MDY": (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})(?!\d)(.*)$", (4, 1, 3)),
    # named months: day first or month first
    "DNY": (r"^(\d{1,2})([-/. ])([A-Za-z]{3,9})[-/., ]+(\d{4}|\d{2})(?!\d)(.*)$", (4, 3, 1)),
    "NDY": (r"^([A-Za-z]{3,9})([-/. ])(\d{1,2})[-/., ]+(\d{4}|\d{2})(?!\d)(.*)$", (4, 1, 3)),
}
MONTHS = "january february march april may june july august september october november december".split()
_CLOCK = r"^(\d{1,2})([:.])(\d{2})(?:\2(\d{2}))?(\.\d+)?\s*([AaPp][Mm])?(\s*(?:Z|UTC|GMT|[+-]\d{2}:?\d{2})?)$"


def _year(digits: Column) -> Column:
    y = digits.try_cast("int")
    return F.when(F.length(digits) == 2, F.when(y <= 69, 2000 + y).otherwise(1900 + y)).otherwise(y)


def date_parts(c: Column, layout: str = "YMD") -> Column:
    """struct(year, month, day, date, separator, widths, suffix), or null where no real date stands."""
    pattern, at = _DATE[layout]

    def cut(t: Column) -> Column:
        g = lambda i: F.regexp_extract(t, pattern, i)
        between = F.regexp_extract(t, r"^\w+[-/. ]\w+([-/., ]+)\d", 1) if layout in ("DNY", "NDY") else g(2)
        return F.struct(*[g(i).alias(k) for k, i in zip(("y", "m", "d"), at, strict=True)], g(2).alias("separator"), between.alias("second"), g(5).alias("suffix"))

    def read(p: Column) -> Column:
        named = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.lower(F.substring(p["m"], 1, 3))).cast("int")
        whole = F.lower(p["m"]).isin(*MONTHS, *[m[:3] for m in MONTHS], "sept")
        month = F.when(whole, F.nullif(named, F.lit(0))) if layout in ("DNY", "NDY") else p["m"].try_cast("int")
        year, day = _year(p["y"]), p["d"].try_cast("int")
        # null where there is no such day
        date = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day)).cast("date")
        widths = [F.length(p[k]).alias(f"{name}_width") for k, name in (("y", "year"), ("m", "month"), ("d", "day"))]
        return F.struct(year.alias("year"), month.alias("month"), day.alias("day"), F.when(p["y"] != "", date).alias("date"), p["separator"].alias("separator"), p["second"].alias("second"), p["m"].alias("said"), *widths, p["suffix"].alias("suffix"))

    return let(let(let(trimmed(c), cut), read), lambda p: F.when(p["date"].isNotNull(), p))


def inferred_layout(dmy_days: int, mdy_days: int) -> str:
    """DMY or MDY from how many first and second numbers exceed 12; AMBIGUOUS if neither or both do."""
    return "DMY" if dmy_days and not mdy_days else "MDY" if mdy_days and not dmy_days else "AMBIGUOUS"


def _month_like(d: Column, said: Column) -> Column:
    """A month's name, short or whole and with capitals as the one that stood there."""
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(d))
    name = F.when((F.length(said) == 3) & (F.lower(said) != "may"), F.substring(name, 1, 3)).otherwise(name)
    return F.when(said == F.upper(said), F.upper(name)).when(said == F.lower(said), name).otherwise(F.initcap(name))


def layout_of(c: Column) -> Column:
    """The one layout by which a cell can be read, AMBIGUOUS for day and month that could be either, else null."""
    by = {k: date_parts(c, k)["date"].isNotNull() for k in _DATE}
    return F.when(by["YMD"], "YMD").when(by["DMY"] & by["MDY"], "AMBIGUOUS").when(by["DMY"], "DMY").when(by["MDY"], "MDY").when(by["DNY"], "DNY").when(by["NDY"], "NDY")


def order_key(c: Column, layout: str = "YMD") -> Column:
    """A number by which dates, or else times of day, sort: yyyymmdd, or seconds."""
    d = as_date(c, layout)
    return F.coalesce(F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d), clock_seconds(c)).cast("long")


def as_date(c: Column, layout: str = "YMD") -> Column:
    return date_parts(c, layout)["date"]


def shifted_date(c: Column, days: int | Column, layout: str = "YMD") -> Column:
    """The date ``days`` later, written with the same layout, separators, widths and trailing text; other cells as they are."""
    order = {"YMD": "ymd", "DMY": "dmy", "MDY": "mdy", "DNY": "dny", "NDY": "ndy"}[layout]

    def written(p: Column) -> Column:
        d = F.date_add(p["date"], days)
        pad = lambda v, w: F.lpad(v.cast("string"), F.greatest(F.length(v.cast("string")), w), F.lit("0"))
        year = F.when(p["year_width"] == 2, F.lpad((F.year(d) % 100).cast("string"), 2, "0")).otherwise(F.lpad(F.year(d).cast("string"), 4, "0"))
        parts = {"y": year, "m": pad(F.month(d), p["month_width"]), "d": pad(F.dayofmonth(d), p["day_width"]), "n": _month_like(d, p["said"])}
        first, second, third = (parts[k] for k in order)
        return F.when(p.isNotNull(), F.concat(first, p["separator"], second, p["second"], third, p["suffix"]))

    return F.coalesce(let(date_parts(c, layout), written), c)


def _clock(t: Column) -> Column:
    """struct of a clock's parts and its seconds of the day (null where no time stands). ``t`` is trimmed."""

    def cut(t: Column) -> Column:
        g = lambda i: F.regexp_extract(t, _CLOCK, i)
        return F.struct(g(1).alias("h"), g(2).alias("mark"), g(3).alias("m"), g(4).alias("s"), g(5).alias("fraction"), g(6).alias("half"), g(7).alias("rest"), t.rlike(r"\s[AaPp][Mm]").alias("spaced"))

    def read(p: Column) -> Column:
        h, m, s, half = p["h"].try_cast("int"), p["m"].try_cast("int"), F.coalesce(p["s"].try_cast("int"), F.lit(0)), F.upper(p["half"])
        h24 = F.when(half == "", h).when(half == "AM", h % 12).otherwise(h % 12 + 12)
        real = (h24 < 24) & (m < 60) & (s < 60) & ((half == "") | h.between(1, 12))
        return F.struct(p.alias("parts"), F.when(real, h24 * 3600 + m * 60 + s).alias("seconds"))

    return let(let(t, cut), read)


def clock_seconds(c: Column) -> Column:
    """Seconds of the day, or null."""
    return _clock(trimmed(c))["seconds"]


def shifted_time(c: Column, minutes: int) -> Column:
    """The time of day ``minutes`` later, around midnight, written as before."""

    def written(x: Column) -> Column:
        p, s = x["parts"], F.pmod(x["seconds"] + F.lit(minutes * 60), F.lit(86400))
        half, hour = p["half"], F.floor(s / 3600).cast("int")
        shown = F.when(half == "", hour).otherwise(F.pmod(hour + 11, F.lit(12)) + 1)
        two = lambda v: F.lpad(v.cast("int").cast("string"), 2, "0")
        mark = F.when(half == "", "").when(half == F.lower(half), F.when(hour < 12, "am").otherwise("pm")).otherwise(F.when(hour < 12, "AM").otherwise("PM"))
        space = F.when((half != "") & p["spaced"], " ").otherwise("")
        head = F.when(F.length(p["h"]) == 2, two(shown)).otherwise(shown.cast("string"))
        seconds = F.when(p["s"] != "", F.concat(p["mark"], two(s % 60))).otherwise("")
        return F.when(s.isNotNull(), F.concat(head, p["mark"], two(F.floor(s % 3600 / 60)), seconds, p["fraction"], space, mark, p["rest"]))

    return F.coalesce(let(_clock(trimmed(c)), written), c)


def shifted_segment(c: Column, offset: int, segment: int = 0, preserve_width: bool = True) -> Column:
    """One run of digits moved by ``offset``: null where it would turn negative or need more digits than it has."""
    pattern = rf"^((?:[^0-9]*[0-9]+){{{segment}}}[^0-9]*)([0-9]+)(.*)$"

    def moved(p: Column) -> Column:
        number = (p["digits"].try_cast("decimal(38,0)") + F.lit(offset).cast("decimal(38,0)")).cast("string")
        out = F.when(F.length(number) < F.length(p["digits"]), F.lpad(number, F.length(p["digits"]), F.lit("0"))).otherwise(number)
        ok = ~number.startswith("-") & (F.length(number) <= F.length(p["digits"]) if preserve_width else F.lit(True))
        return F.when(p["digits"] == "", p["whole"]).when(ok, F.concat(p["head"], out, p["tail"]))

    part = lambda v: F.struct(v.alias("whole"), *[F.regexp_extract(v, pattern, i).alias(k) for i, k in ((1, "head"), (2, "digits"), (3, "tail"))])
    return let(let(c, part), moved)
