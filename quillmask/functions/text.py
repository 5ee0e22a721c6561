"""String functions as column expressions. Empty, blank and null are one state; all stay inside generated code where Spark allows."""

from __future__ import annotations

from functools import reduce

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space, as trimming and emptiness understand it.
BLANK = r"[\s\p{Z}\x{FEFF}]"
# Cells that stand for a missing number; Boolean tokens; checksum weights of Australian identifiers.
MISSING_SENTINELS = ("N/A", "NA", "NULL", "NONE", "UNKNOWN", "-", "--", "NOT AVAILABLE")
BOOLEAN_TRUE, BOOLEAN_FALSE = ("true", "yes", "y", "1", "on"), ("false", "no", "n", "0", "off")
AU_WEIGHTS = {"ABN": ((10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19), 89), "ACN": ((8, 7, 6, 5, 4, 3, 2, 1), 10), "TFN": ((1, 4, 3, 7, 5, 8, 6, 9, 10), 11), "MEDICARE": ((1, 3, 7, 9, 1, 3, 7, 9), 10)}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it: keeps plans and generated code small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def plain(c: Column) -> Column:
    """A floating-point number as digits: Spark's own text has an exponent below 0.001 and from 10 million on."""

    def digits(x: Column) -> Column:
        exact = lambda kind: F.regexp_replace(F.regexp_replace(x.cast("string").cast(kind).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        long = F.when(F.abs(x) < 1e7, exact("decimal(38,30)")).when(F.abs(x) < 1e18, exact("decimal(38,18)")).when(F.abs(x) < 1e37, exact("decimal(38,0)"))
        return F.when(x.cast("string").contains("E"), F.coalesce(long, x.cast("string"))).otherwise(x.cast("string"))

    return let(c, digits)


def cell(df: DataFrame, name: str) -> Column:
    """A column as text: numbers as digits, whatever their type."""
    return plain(df[name]) if df.schema[name].dataType.typeName() in ("double", "float") else df[name]


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def trimmed(c: Column) -> Column:
    t = text(c)
    # nearly all cells begin and end with a printable ASCII character
    return F.when(t.rlike(r"^[!-~](?:.*[!-~])?$"), t).otherwise(F.regexp_replace(t, f"^{BLANK}+|{BLANK}+$", ""))


def is_empty(c: Column) -> Column:
    return trimmed(c) == ""


def case_pattern(c: Column) -> Column:
    """UPPER, LOWER, TITLE, MIXED or NO_CASE."""
    t = trimmed(c)
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    return (
        F.when(F.upper(letters) == F.lower(letters), "NO_CASE").when(letters == F.upper(letters), "UPPER").when(letters == F.lower(letters), "LOWER")
        .when(t.rlike(r"^[^\p{L}]*(?:\p{Lu}\p{Ll}*[^\p{L}]*)+$"), "TITLE").otherwise("MIXED")
    )


def fnv1a(c: Column, seed: int = 2166136261) -> Column:
    """32-bit FNV-1a over characters."""
    codes = F.transform(F.filter(F.split(text(c), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(seed).cast("long"), lambda h, k: (h.bitwiseXOR(k) * F.lit(16777619)).bitwiseAND(F.lit(4294967295).cast("long")))


def fingerprint(c: Column) -> Column:
    """16 hexadecimal digits from two seeds."""
    half = lambda seed: F.lpad(F.lower(F.hex(fnv1a(c, seed))), 8, "0")
    return F.concat(half(2166136261), half(2654435761))


def shortened(c: Column, n: int) -> Column:
    """Long values keep a prefix and a fingerprint."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, max(1, n - 18)), F.lit("…#"), fingerprint(c))).otherwise(c)


_NUMBER = r"^[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?$"


def _bare_number(c: Column) -> Column:
    """struct(digits: canonical or null, percent, marker: of a currency, or '')."""

    def parts(t: Column) -> Column:
        bare = F.regexp_replace(t, r"\s*%$", "")
        # a leading marker goes before a trailing one
        return F.struct(t.endswith("%").alias("percent"), F.regexp_extract(bare, r"^(\p{Sc}|[A-Z]{3})\s*", 1).alias("lead"), F.regexp_extract(bare, r"\s*(\p{Sc}|[A-Z]{3})$", 1).alias("tail"), bare.alias("bare"))

    def digits(p: Column) -> Column:
        body = F.when(p["lead"] != "", F.regexp_replace(p["bare"], r"^(?:\p{Sc}|[A-Z]{3})\s*", "")).when(p["tail"] != "", F.regexp_replace(p["bare"], r"\s*(?:\p{Sc}|[A-Z]{3})$", "")).otherwise(p["bare"])
        marker = F.when(p["lead"] != "", p["lead"]).otherwise(p["tail"])
        return F.struct(F.regexp_extract(body, _NUMBER, 0).alias("digits"), p["percent"].alias("percent"), marker.alias("marker"))

    return let(let(trimmed(c), parts), digits)


def numeric_token(c: Column) -> Column:
    """struct(value, kind, decimal_places, currency_marker, digit_count, leading_zero), or null where no number stands."""

    def token(p: Column) -> Column:
        digits = F.regexp_replace(p["digits"], ",", "")
        places = F.length(F.regexp_extract(digits, r"\.(\d+)$", 1))
        kind = F.when(p["marker"] != "", "CURRENCY_LIKE").when(p["percent"], "PERCENTAGE").when(places > 0, "DECIMAL").otherwise("INTEGER")
        return F.when(
            p["digits"] != "",
            F.struct(digits.try_cast("double").alias("value"), kind.alias("kind"), places.alias("decimal_places"), F.nullif(p["marker"], F.lit("")).alias("currency_marker"), F.length(F.regexp_replace(digits, r"[^0-9]", "")).alias("digit_count"), digits.rlike(r"^[-+]?0\d").alias("leading_zero")),
        )

    return let(_bare_number(c), token)


def number(c: Column) -> Column:
    return F.regexp_replace(_bare_number(c)["digits"], ",", "").try_cast("double")


def normalised_value(c: Column, most: int = 512) -> Column:
    """struct(value: trimmed and kept short, empty, length, shape_case, numeric) of a cell."""
    return let(trimmed(c), lambda t: F.struct(shortened(t, most).alias("value"), (t == "").alias("empty"), F.length(t).alias("length"), case_pattern(t).alias("shape_case"), numeric_token(t).alias("numeric")))


def business_number(c: Column) -> Column:
    """A number in business notation: parentheses are negative; currency signs, commas and percent signs don't count."""

    def read(t: Column) -> Column:
        bare = F.regexp_replace(t, r"[\p{Sc},%()\s]|^[A-Z]{3}|[A-Z]{3}$", "")
        value = F.regexp_extract(bare, r"^[+-]?\d+(?:\.\d+)?$", 0).try_cast("double")
        return F.when(t.rlike(r"^\(.*\)$"), -value).otherwise(value)

    return let(trimmed(c), read)


def boolean(c: Column) -> Column:
    t = F.lower(trimmed(c))
    return F.when(t.isin(*BOOLEAN_TRUE), True).when(t.isin(*BOOLEAN_FALSE), False)


def value_shape(c: Column) -> Column:
    """Upper letters A, lower a, other letters L, digits 9, white space ␠; the rest stands for itself."""
    steps = ((r"\p{Lu}", "\u0001"), (r"\p{Ll}", "\u0002"), (r"[\p{Lt}\p{Lm}\p{Lo}]", "\u0003"), (r"\p{N}", "9"), (r"\s", "␠"), ("\u0001", "A"), ("\u0002", "a"), ("\u0003", "L"))
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text(c))


def multi_value_tokens(c: Column, most: int = 32) -> Column:
    """Items and separators of a cell that lists values: array of struct(kind, value, shape)."""
    parts = F.regexp_extract_all(text(c), F.lit(r"([\s,;|/]+|[^\s,;|/]+)"), 1)
    return F.slice(F.transform(parts, lambda p: F.struct(F.when(p.rlike(r"^[\s,;|/]"), "SEPARATOR").otherwise("ITEM").alias("kind"), p.alias("value"), value_shape(p).alias("shape"))), 1, 2 * most - 1)


def is_missing_sentinel(c: Column) -> Column:
    return F.upper(trimmed(c)).isin(*MISSING_SENTINELS)


# What counts as an email, a phone-like number, a labelled identifier, a long number, and an ordinary
# negative amount. Masked notes and guarded cells must come out the same wherever they are made.
SANITISED = (
    ("[EMAIL]", r"(?iu)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("[PHONE_OR_NUMBER]", r"\+?\d[\d ()-]{7,}\d"),
    ("[IDENTIFIER]", r"(?iu)\b(?:ID|REF|CASE|ACCOUNT|ACCT)[- _:#]*[A-Z0-9-]{4,}\b"),
    ("[NUMBER]", r"\b\d{6,}\b"),
)
ORDINARY_NEGATIVE = r"^-(?:(?:[$€£¥₹]\s*)?\d+(?:,\d{3})*(?:\.\d+)?|\d*\.\d+)(?:%|\s*[A-Z]{3})?$"


def sanitised(c: Column) -> Column:
    """Emails, phone-like numbers, labelled identifiers and long digit runs give way to their names, in that order."""
    out = text(c)
    for name, pattern in SANITISED:
        out = F.regexp_replace(out, pattern, name)
    return out


def formula_risk(c: Column) -> Column:
    """Whether a spreadsheet could run the cell as a formula."""
    t = text(c)
    bare = F.regexp_replace(t, r"^[\x00-\x20]+", "")
    return ~t.startswith("'") & bare.rlike(r"^[=+\-@]") & ~F.trim(bare).rlike(ORDINARY_NEGATIVE)


def excel_safe(c: Column) -> Column:
    return F.when(formula_risk(c), F.concat(F.lit("'"), text(c))).otherwise(text(c))


def au_identifier_valid(c: Column, kind: str) -> Column:
    """Checksum of an Australian business, company, tax file or Medicare number; spaces and hyphens don't count."""
    digits = F.regexp_replace(text(c), r"[\s-]", "")
    weights, modulus = AU_WEIGHTS[kind]
    n = len(weights) + {"ABN": 0, "ACN": 1, "TFN": 0, "MEDICARE": 2}[kind]
    at = lambda i: F.substring(digits, i + 1, 1).try_cast("int")
    total = reduce(lambda a, b: a + b, [(at(i) - (1 if kind == "ABN" and i == 0 else 0)) * w for i, w in enumerate(weights)])
    check = total % modulus == 0
    if kind == "ACN":
        check = (F.lit(10) - total % 10) % 10 == at(8)
    if kind == "MEDICARE":
        check = (total % 10 == at(8)) & digits.rlike(r"^[2-6]")
    length = rf"^\d{{{n}}}$" if kind != "MEDICARE" else r"^\d{10,11}$"
    return F.coalesce(digits.rlike(length) & check & ~digits.rlike(r"^0+$"), F.lit(False))
