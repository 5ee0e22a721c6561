"""Semantic types, risk, roles and recommended actions: rules over the (small) profile of each column."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.functions.text import BOOLEAN_FALSE, BOOLEAN_TRUE
from quillmask.operators import profile as P
from quillmask.operators.actions import Policy
from quillmask.operators.relationships import normalised

# Header vocabularies and type sets that decide types, roles and actions.
DIRECT_TYPES = ("EMAIL", "PHONE_LIKE", "NAME_LIKE", "ADDRESS_LIKE", "AU_ABN", "AU_ACN", "AU_TFN", "AU_MEDICARE")
ID_TYPES = ("NUMERIC_ID", "ALPHANUMERIC_CODE", "AU_ABN", "AU_ACN", "AU_TFN", "AU_MEDICARE")
NUMERIC = ("INTEGER", "DECIMAL", "PERCENTAGE", "CURRENCY_LIKE")
DATES = ("DATE", "DATETIME", "TIME", "AMBIGUOUS_DATE")
SENSITIVE_WORDS = "diagnosis condition health medical medication disability religion ethnicity race salary income wage credit criminal offence biometric genetic sexual union".split()
QUASI_WORDS = "birth dob age gender sex postcode postal zip suburb city state country occupation job_title profession nationality marital".split()
PERSON_WORDS = "customer client employee patient member person user contact applicant resident".split()
DIRECT_WORDS = "identifier passport licence license medicare tfn email phone mobile account_number member_number customer_number employee_number patient_number created_by updated_by modified_by last_modified_by entered_by submitted_by assigned_to assignee record_owner".split()
NAME_RISK_WORDS = "email phone mobile name address passport ssn tax_id licence license".split()
LOCATION_WORDS = "address street_address suburb city town locality state province territory postcode post_code postal_code zip zip_code".split()
OPERATIONAL_WORDS = "status state stage region accuracy service_type warranty_term reason_code symptom_code".split()
REFERENCE_HEADER = r"(^|_)((batch|part|so)_(id|no|number)|(sales|service|work|purchase|repair)_order(_(id|no|number))?|(order|job|serial|ticket|case|request)_(id|no|number)|submission_id|(dealer|vendor|supplier)_code|file_?name|product_model|model_(no|number))(_|$)"


def has(header: str, words: list[str]) -> bool:
    return any(f"_{w}_" in f"_{header}_" for w in words)


@dataclass(frozen=True)
class Detection:
    type: str
    score: int
    confidence: str = "HIGH"
    review: bool = False
    detector: str = ""
    details: dict = field(default_factory=dict)


@dataclass
class Column:
    """What the rules look at."""

    name: str
    observed: int
    non_empty: int
    distinct: int
    unique_ratio: float
    max_length: int
    samples: list[str]
    minimum: float | None = None
    maximum: float | None = None
    mean: float | None = None
    median: float | None = None
    top: list[tuple[str, int]] = field(default_factory=list)


def shape(value: str) -> str:
    return "".join("A" if c.isupper() else "a" if c.islower() else "L" if c.isalpha() else "9" if c.isnumeric() else "␠" if c.isspace() else c for c in value)


_DATE = re.compile(r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[T ](\d{1,2}:\d{2}(?::\d{2})?\S*))?$|^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})(?:[T ](\d{1,2}:\d{2}(?::\d{2})?\S*))?$")
_NUMBER = re.compile(r"^[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?$")


def by_emptiness(c: Column) -> Detection | None:
    return Detection("EMPTY", 100, detector="basic") if not c.non_empty else None


def by_number(c: Column) -> Detection | None:
    bare = [re.sub(r"^(?:[$€£¥₹]|[A-Z]{3})\s*|\s*(?:[$€£¥₹]|[A-Z]{3})$", "", v.removesuffix("%").strip()) for v in c.samples]
    if not all(_NUMBER.match(v) for v in bare):
        return None
    kind = "PERCENTAGE" if all(v.endswith("%") for v in c.samples) else "CURRENCY_LIKE" if any(b != v.removesuffix("%").strip() for b, v in zip(bare, c.samples, strict=True)) else "DECIMAL" if any("." in b for b in bare) else "INTEGER"
    return Detection(kind, 80, detector="basic")


def by_date(c: Column) -> Detection | None:
    found = [_DATE.match(v) for v in c.samples]
    if all(re.match(r"^\d{1,2}:\d{2}(:\d{2})?(\s?[AaPp][Mm])?$", v) for v in c.samples):
        return Detection("TIME", 93, detector="temporal")
    if not all(found):
        return Detection("UNKNOWN", 90, "LOW", True, "temporal") if sum(map(bool, found)) >= 0.5 * len(found) else None
    if all(m[1] for m in found):
        return Detection("DATETIME" if all(m[4] for m in found) else "DATE", 93, detector="temporal", details={"layout": "YMD"})
    first, second = any(m[5] and int(m[5]) > 12 for m in found), any(m[6] and int(m[6]) > 12 for m in found)
    if first == second:
        return Detection("AMBIGUOUS_DATE", 99, "LOW", True, "temporal")
    return Detection("DATE", 93, detector="temporal", details={"layout": "DMY" if first else "MDY"})


def by_vocabulary(c: Column) -> Detection | None:
    if all(v.lower() in BOOLEAN_TRUE + BOOLEAN_FALSE for v in c.samples) and c.distinct <= 4:
        binary = all(v in "01" for v in c.samples)
        return Detection("BOOLEAN", 86 if binary else 96, "LOW" if binary else "HIGH", binary, "vocabulary")
    limit = max(10, min(50, -int(-2 * c.non_empty**0.5 // 1)))
    if c.distinct <= limit and c.unique_ratio <= 0.2:
        sure = c.non_empty >= 20
        return Detection("CATEGORY", 68, "HIGH" if sure else "MEDIUM", not sure, "vocabulary")
    return None


def by_header(c: Column) -> Detection | None:
    words = normalised(c.name).split("_")
    any_of = lambda said: bool(set(words) & set(said.split()))
    kind = "DATE" if "date" in words else "TIME" if "time" in words else "ALPHANUMERIC_CODE" if any_of("job work ticket case order") and any_of("number no id code reference ref") else "NAME_LIKE" if any_of("signature signed signoff member staff employee assignee operator worker technician") else ""
    return Detection(kind, 89, "LOW", True, "header") if kind else None


def by_semantics(c: Column) -> Detection | None:
    every = lambda pattern: all(re.search(pattern, v) for v in c.samples)
    words = set(normalised(c.name).split("_"))
    if every(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"):
        return Detection("EMAIL", 97, detector="semantic")
    phone = bool(words & {"phone", "telephone", "mobile", "tel"})
    if every(r"^[+()\d .-]+$") and all(7 <= len(re.sub(r"\D", "", v)) <= 15 for v in c.samples) and (phone or every(r"[+() .-]")):
        return Detection("PHONE_LIKE", 91, "HIGH" if phone else "MEDIUM", not phone, "semantic")
    street = r"(?i)^\d+[a-z]?\s+.+\s(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr)$"
    where = bool(words & {"address", "street", "road", "location"})
    if where and every(r"[^\W\d_]") or every(street):
        return Detection("ADDRESS_LIKE", 85, "HIGH" if where and every(street) else "MEDIUM", not where, "semantic")
    named = bool(words & {"name", "firstname", "lastname", "fullname"})
    if named and every(r"^[^\W\d_][^\W\d_'-]*(?:\s+[^\W\d_][\w'-]*){0,3}$"):
        return Detection("NAME_LIKE", 84, "MEDIUM", True, "semantic")
    if c.max_length >= 80 or sum(map(len, c.samples)) >= 60 * len(c.samples) or any(re.search(r"[.!?]\s|\n", v) for v in c.samples):
        return Detection("FREE_TEXT", 74, detector="semantic")
    return Detection("GENERAL_TEXT", 20, "MEDIUM", True, "semantic") if any(re.search(r"[^\W\d_]", v) for v in c.samples) else None


def by_code(c: Column) -> Detection | None:
    if all(re.match(r"^\d+$", v) for v in c.samples):
        hint, zero = bool(re.search(r"(?i)(^|[_\s-])(id|identifier|reference|ref|account|number|no)([_\s-]|$)", c.name)), any(len(v) > 1 and v[0] == "0" for v in c.samples)
        if hint or zero or c.unique_ratio >= 0.8:
            sure = hint and (zero or c.unique_ratio >= 0.8)
            return Detection("NUMERIC_ID", 92 if hint or zero else 72, "HIGH" if sure else "MEDIUM", not sure, "code")
        return None
    if all(re.match(r"^[\w./#-]+$", v) and re.search(r"[^\W\d_]", v) and re.search(r"\d", v) for v in c.samples):
        common = Counter(map(shape, c.samples)).most_common(1)[0][1] / len(c.samples)
        sure = common >= 0.8 and len(c.samples) >= 3
        return Detection("ALPHANUMERIC_CODE", 88, "HIGH" if sure else "MEDIUM", not sure, "code")
    return None


def au_valid(digits: str, kind: str) -> bool:
    from quillmask.functions.text import AU_WEIGHTS

    weights, modulus = AU_WEIGHTS[kind]
    d = [int(x) for x in digits] if digits.isdigit() else []
    if len(d) != {"ABN": 11, "ACN": 9, "TFN": 9, "MEDICARE": 10}[kind] or not any(d) or kind == "MEDICARE" and not 2 <= d[0] <= 6 or kind == "ABN" and not d[0]:
        return False
    d[0] -= kind == "ABN"
    total = sum(a * b for a, b in zip(d, weights, strict=False))
    return total % modulus == 0 if kind in ("ABN", "TFN") else (-total) % 10 == d[8] if kind == "ACN" else total % 10 == d[8]


def by_checksum(c: Column) -> Detection | None:
    for kind in ("ABN", "ACN", "TFN", "MEDICARE"):
        if all(au_valid(re.sub(r"[\s-]", "", v), kind) for v in c.samples):
            named = kind.lower() in normalised(c.name).split("_")
            if named or kind == "ABN":
                return Detection(f"AU_{kind}", 100 if named else 96, "HIGH" if named else "MEDIUM", not named, "checksum")
    return None


#: Detectors in order; of equal scores the first wins. Append to extend.
DETECTORS: list[Callable[[Column], Detection | None]] = [by_emptiness, by_checksum, by_vocabulary, by_date, by_code, by_header, by_semantics, by_number]


def detected(c: Column) -> Detection:
    found = [d for f in DETECTORS if (f is by_emptiness or c.samples) and (d := f(c))]
    return max(found, key=lambda d: d.score, default=Detection("UNKNOWN", 0, "LOW", True))


def risks(c: Column, d: Detection, date_columns: int = 0) -> list[tuple[str, str]]:
    """(rule, level) of every rule that matches."""
    header, out = normalised(c.name), []
    add = lambda rule, level, when: out.append((rule, level)) if when else None
    add("DIRECT_IDENTIFIER", "HIGH", d.type in DIRECT_TYPES or has(header, NAME_RISK_WORDS) and not has(header, ["file_name"]))
    add("HIGH_UNIQUENESS_BUSINESS_ID", "HIGH", d.type in ID_TYPES and c.unique_ratio >= 0.8)
    add("INDIRECT_IDENTIFIER", "MEDIUM", d.type in ("DATE", "DATETIME", "AMBIGUOUS_DATE"))
    add("FREE_TEXT_DISCLOSURE", "HIGH", d.type == "FREE_TEXT")
    add("RARE_CATEGORY", "MEDIUM", d.type == "CATEGORY" and bool(c.top) and min(n for _, n in c.top) <= max(2, int(c.non_empty * 0.01)))
    scale = max(abs(c.median or 0), abs(c.mean or 0), 1)
    add("NUMERIC_OUTLIER", "MEDIUM", c.median is not None and max(abs(c.minimum or 0), abs(c.maximum or 0)) > 100 * scale)
    add("DATE_COMBINATION", "MEDIUM", d.type in ("DATE", "DATETIME") and date_columns >= 2)
    add("UNKNOWN_OR_LOW_CONFIDENCE", "MEDIUM", d.confidence == "LOW" or d.review or d.type == "UNKNOWN")
    add("LOW_RISK_STATISTICAL", "LOW", not out and d.type in ("EMPTY", "BOOLEAN", "INTEGER", "DECIMAL", "PERCENTAGE", "CATEGORY"))
    return out


def risk_level(matched: list[tuple[str, str]]) -> str:
    return max((level for _, level in matched), key=("UNKNOWN", "LOW", "MEDIUM", "HIGH").index, default="UNKNOWN")


def organisation_header(header: str) -> bool:
    return has(header, ["company_name", "organisation_name", "organization_name", "business_name", "supplier_name", "vendor_name", "dealer_name", "branch_name", "clinic_name", "hospital_name"])


#: Headers that name a person by themselves where the cells are numbers, codes or short texts.
BARE_PERSONS = {"customer", "consumer", "employee", "engineer", "technician", "member", "patient", "applicant", "resident", "user"}
ROLES = {
    "DIRECT_IDENTIFIER": (
        lambda c, d, h, level: d.type in DIRECT_TYPES,
        lambda c, d, h, level: has(h, DIRECT_WORDS),
        lambda c, d, h, level: h.rpartition("_")[2] == "id" and (level == "HIGH" or has(h, PERSON_WORDS)),
        lambda c, d, h, level: h in BARE_PERSONS and d.type in ("INTEGER", "DECIMAL", "NUMERIC_ID", "ALPHANUMERIC_CODE", "GENERAL_TEXT"),
    ),
    "SENSITIVE_ATTRIBUTE": (lambda c, d, h, level: has(h, SENSITIVE_WORDS),),
    "QUASI_IDENTIFIER": (lambda c, d, h, level: has(h, QUASI_WORDS), lambda c, d, h, level: d.type in ("DATE", "DATETIME", "AMBIGUOUS_DATE") and has(h, PERSON_WORDS)),
}
ROLE_LABELS = {"DIRECT_IDENTIFIER": "Identifies someone directly", "QUASI_IDENTIFIER": "Identifies someone together with others", "SENSITIVE_ATTRIBUTE": "Says something sensitive", "ORDINARY": "Ordinary"}


def role(c: Column, d: Detection, level: str) -> str:
    """The first role of which a test applies; names of organisations are ordinary."""
    h = normalised(c.name)
    if d.type == "NAME_LIKE" and organisation_header(h):
        return "ORDINARY"
    return next((name for name, tests in ROLES.items() if any(t(c, d, h, level) for t in tests)), "ORDINARY")


def table_risk(found: list[tuple[Column, Detection]]) -> str:
    """The highest risk of any column."""
    dates = sum(d.type in ("DATE", "DATETIME") for _, d in found)
    return max((risk_level(risks(c, d, dates)) for c, d in found), key=("UNKNOWN", "LOW", "MEDIUM", "HIGH").index, default="UNKNOWN")


def recommended(c: Column, d: Detection, level: str, who: str, mode: str = "SAFE") -> str:
    """The first rule of the decision list that applies."""
    header, kind = normalised(c.name), d.type
    common = Counter(map(shape, c.samples)).most_common(1)
    strong = c.unique_ratio >= 0.5 and c.max_length <= 64 and len(c.samples) >= 20 and common and common[0][1] >= 0.8 * len(c.samples) and "9" in common[0][0]
    operational = has(header, OPERATIONAL_WORDS)
    rules = (
        (kind == "EMPTY", "KEEP"),
        (mode == "FULL_SYNTHETIC", "RESAMPLE" if kind in NUMERIC + ("CATEGORY", "BOOLEAN") else "REPLACE"),
        (kind == "ADDRESS_LIKE" or has(header, LOCATION_WORDS), "REPLACE"),
        (kind in ("EMAIL", "NAME_LIKE"), "REPLACE"),
        (who == "ORDINARY" and re.search(REFERENCE_HEADER, header) and kind in ("INTEGER", "DECIMAL", "CATEGORY", "GENERAL_TEXT", "FREE_TEXT") + ID_TYPES, "PATTERN_REPLACE"),
        (c.distinct == 1 and kind not in ID_TYPES and who in ("ORDINARY", "SENSITIVE_ATTRIBUTE"), "REPLACE"),
        (who == "ORDINARY" and operational and 2 <= c.distinct <= 12 and c.unique_ratio <= 0.75 and c.max_length <= 40, "RESAMPLE"),
        (kind == "PHONE_LIKE" or kind in ID_TYPES, "PATTERN_REPLACE"),
        (who == "ORDINARY" and kind in ("GENERAL_TEXT", "UNKNOWN") and strong, "PATTERN_REPLACE"),
        (who == "ORDINARY" and kind == "GENERAL_TEXT" and operational and c.non_empty >= 5 and c.unique_ratio <= 0.25 and c.max_length > 40, "REPLACE"),
        (kind == "FREE_TEXT", "TEXT_SANITISE"),
        (kind == "UNKNOWN" and d.detector == "temporal", "KEEP"),
        (kind == "UNKNOWN" or d.confidence == "LOW", "CLEAR"),
        (who == "DIRECT_IDENTIFIER", "PATTERN_REPLACE" if kind in ("INTEGER", "DECIMAL") else "REPLACE"),
        (who == "QUASI_IDENTIFIER", "GENERALISE" if kind in NUMERIC + DATES + ("CATEGORY", "GENERAL_TEXT") else "REPLACE"),
        (who == "SENSITIVE_ATTRIBUTE", "GENERALISE" if kind in DATES + ("CATEGORY",) else "RESAMPLE" if kind in NUMERIC + ("BOOLEAN",) else "REPLACE"),
        (kind in DATES, "REPLACE" if d.detector == "header" else "SHIFT"),
        (kind == "CATEGORY", "REPLACE" if level == "HIGH" else "RESAMPLE"),
        (kind in NUMERIC, "RESAMPLE"),
        (kind == "BOOLEAN" and level == "LOW" or mode == "ID_ONLY" and level == "LOW", "KEEP"),
    )
    return next((action for applies, action in rules if applies), "REPLACE")


def analysed(df: DataFrame, columns: list[str] | None = None) -> list[tuple[Column, Detection]]:
    """Profiles and types of all columns; what reaches the driver is bounded by the limits of a profile."""
    columns = columns or df.columns
    rows = {r["column_name"]: r for r in P.column_profiles(df, columns).collect()}
    samples: dict[str, list[str]] = {}
    for r in P.sample_values(df, columns).collect():
        samples.setdefault(r["column_name"], []).append(r["value"])
    tops: dict[str, list[tuple[str, int]]] = {}
    for r in P.top_values(df, columns).orderBy("rank").collect():
        tops.setdefault(r["column_name"], []).append((r["value"], r["n"]))
    out = []
    for name in columns:
        r = rows.get(name)
        c = Column(name, 0, 0, 0, 0.0, 0, []) if r is None else Column(name, r["observed"], r["non_empty"], r["distinct"], r["unique_ratio"], r["max_length"] or 0, samples.get(name, []), r["minimum"], r["maximum"], r["mean"], (r["quantiles"] or [None] * 4)[3], tops.get(name, []))
        out.append((c, detected(c)))
    return out


def policies(found: list[tuple[Column, Detection]], mode: str = "SAFE", shift_days: int = 30) -> list[Policy]:
    """A policy for each analysed column."""
    dates, out = sum(d.type in ("DATE", "DATETIME") for _, d in found), []
    for c, d in found:
        level = risk_level(risks(c, d, dates))
        who = role(c, d, level)
        action = recommended(c, d, level, who, mode)
        if mode == "ID_ONLY" and who != "DIRECT_IDENTIFIER":
            action = "KEEP"
        params = {"offset": shift_days, "layout": d.details.get("layout", "YMD")} if action == "SHIFT" else {"layout": d.details.get("layout", "YMD")} if d.type in DATES else {}
        out.append(Policy(c.name, action, d.type, who, level, params))
    return out


def analysis_frame(df: DataFrame, columns: list[str] | None = None, mode: str = "SAFE") -> DataFrame:
    """column_name, detected_type, confidence, risk, role, action."""
    found = analysed(df, columns)
    rows = [(c.name, d.type, d.confidence, p.risk, p.role, p.action) for (c, d), p in zip(found, policies(found, mode), strict=True)]
    return df.sparkSession.createDataFrame(rows, "column_name string, detected_type string, confidence string, risk string, role string, action string").select("*", F.lit(mode).alias("mode"))
