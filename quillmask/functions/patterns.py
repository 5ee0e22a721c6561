"""Patterns of a column's values, found on its bounded sample: affixes, variable positions, lists in cells, masks."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmask.functions.text import let, text

# Lengths of affixes and the share of values that must have one; evidence that cells hold lists.
AFFIX_LENGTHS, AFFIX_SHARE = range(2, 13), 0.6
LIST_SAMPLE_SHARE, LIST_ITEM_SHARE, LEAST_LISTS = 0.75, 0.9, 2
SEPARATOR = r"[\s,;|/]+"


def shape(value: str) -> str:
    return "".join("A" if c.isupper() else "a" if c.islower() else "L" if c.isalpha() else "9" if c.isnumeric() else "␠" if c.isspace() else c for c in value)


def common_affix(values: list[str], suffix: bool = False) -> str:
    """The longest beginning (or end) that most values share; of equals the commonest."""
    at_least, best = AFFIX_SHARE * len(values), ""
    for n in AFFIX_LENGTHS:
        parts = Counter(v[-n:] if suffix else v[:n] for v in values if len(v) > n)
        if parts and parts.most_common(1)[0][1] >= at_least:
            best = min(p for p, k in parts.items() if k == parts.most_common(1)[0][1])
    return best


def safe_affix(affix: str) -> bool:
    """Short enough to be a code's family and no part of an identity: 2 to 8 letters or digits, at most 4 with a digit."""
    return bool(re.fullmatch(r"[^\W_]{2,8}", affix)) and (len(affix) <= 4 or not re.search(r"\d", affix))


@dataclass(frozen=True)
class Patterns:
    lengths: tuple[int, int]
    shapes: tuple[tuple[str, int], ...]
    prefix: str
    suffix: str
    variable: tuple[int, ...]  # positions that differ among values of the commonest shape


def summary(values: list[str], most: int = 128) -> Patterns:
    """What the first ``most`` distinct values have in common."""
    seen = list(dict.fromkeys(v for v in values if v))[:most]
    if not seen:
        return Patterns((0, 0), (), "", "", ())
    shapes = Counter(map(shape, seen)).most_common()
    alike = [v for v in seen if shape(v) == shapes[0][0]]
    variable = tuple(i for i in range(len(alike[0])) if len({v[i] for v in alike}) > 1)
    return Patterns((min(map(len, seen)), max(map(len, seen))), tuple(shapes), common_affix(seen), common_affix(seen, True), variable)


def list_evidence(values: list[str]) -> tuple[str, float]:
    """(HIGH, LOW or NONE, share of cells that list values): cells of several like items between separators."""
    filled = [v for v in values if v.strip()]
    lists = [items for v in filled if len(items := [x for x in re.split(SEPARATOR, v.strip()) if x]) > 1]
    if not lists:
        return "NONE", 0.0
    shapes = Counter(shape(x) for items in lists for x in items)
    alike = shapes.most_common(1)[0][1] / sum(shapes.values())
    share = len(lists) / len(filled)
    return "HIGH" if len(lists) >= LEAST_LISTS and share >= LIST_SAMPLE_SHARE and alike >= LIST_ITEM_SHARE else "LOW", share


def reads_lists(setting: str, values: list[str]) -> bool:
    """AUTO follows the evidence; FORCE and OFF don't."""
    return setting == "FORCE" or setting == "AUTO" and list_evidence(values)[0] == "HIGH"


#: Characters of a mask: upper and lower letters, digits, any letter or digit. A backslash keeps the next one.
MASK_ALPHABETS = {"A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a": "abcdefghijklmnopqrstuvwxyz", "9": "0123456789", "*": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}


def masked(mask: str, seed: int, scope: str, *key: Column) -> Column:
    """A value drawn by a mask: its letters stand for alphabets, the rest for itself."""
    out, escaped = [], False
    for i, c in enumerate(mask):
        alphabet = None if escaped else MASK_ALPHABETS.get(c)
        if c == "\\" and not escaped:
            escaped = True
            continue
        escaped = False
        out.append(F.lit(c) if alphabet is None else F.substr(F.lit(alphabet), (F.pmod(F.xxhash64(F.lit(f"{seed}|{scope}|{i}"), *key), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1)))
    return F.concat(*out) if out else F.lit("")


def segments(c: Column) -> Column:
    """Runs of letters, digits and others: array of struct(kind, value)."""
    runs = F.regexp_extract_all(text(c), F.lit(r"(\p{L}+|\p{N}+|[^\p{L}\p{N}]+)"), 1)
    return F.transform(runs, lambda r: F.struct(F.when(r.rlike(r"^\p{L}"), "LETTERS").when(r.rlike(r"^\p{N}"), "DIGITS").otherwise("OTHER").alias("kind"), r.alias("value")))


def item_wise(c: Column, made) -> Column:
    """``made`` applied to each item of a cell that lists values; separators stay."""
    parts = F.regexp_extract_all(text(c), F.lit(r"([\s,;|/]+|[^\s,;|/]+)"), 1)
    return let(parts, lambda p: F.concat_ws("", F.transform(p, lambda x: F.when(x.rlike(r"^[\s,;|/]"), x).otherwise(made(x)))))
