"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

A character trigram model is counted over all documents. A token that doesn't look like a word (digits or signs
among letters, letters three times in a row, single letters in a row) is a noisy reading of one: an exact Viterbi
search over the lattice of its characters' readings (leetspeak, repetition, inserted signs) weighs channel costs against
the character model and keeps each state's best paths, and so the best ``BEST`` restorations of a token of any length.
Other tokens have one path through that lattice: themselves. Restored words and their beginnings are then looked up in
log-odds learned from labelled documents, and a logistic function of the evidence is the score.

The classifier is fitted on at most ``SAMPLE`` labelled documents outside the held-out fold, distinct by text, in
the order of a hash of doc_id; executors read them, and what reaches the driver is counts of words and two numbers for
each document. Labels, language, source and doc_id enter no score. A document with several labels counts for each.

An empty table gives an empty one. Null texts are empty and score like a text without evidence. Without usable labels
every score is 0. Repeated rows have the same score. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.common import keyed, real_id, shared_dir, tagged, text_chunks, written

SAMPLE = 6000
#: Evidence must be seen in this share of the toxic sample, and in that many documents.
LEAST_SHARE, LEAST_DOCS = 0.01, 3
#: No word is longer than this: a longer token is several words run together, which are looked for inside it.
LONGEST = 32
BEST = 3

# Readings of characters in disguised words, with their cost (natural logarithm).
READINGS = {
    "0": {"o": 0.2}, "1": {"i": 0.3, "l": 0.3}, "2": {"z": 1.0}, "3": {"e": 0.2}, "4": {"a": 0.2}, "5": {"s": 0.2}, "6": {"g": 0.7, "b": 1.0}, "7": {"t": 0.2}, "8": {"b": 0.5}, "9": {"g": 0.5},
    "@": {"a": 0.1}, "$": {"s": 0.1}, "!": {"i": 0.3, "": 1.0}, "|": {"i": 0.4, "l": 0.4, "": 1.0}, "+": {"t": 0.4, "": 1.0}, "(": {"c": 0.7, "": 1.0}, "<": {"c": 0.7, "": 1.0}, "€": {"e": 0.2}, "#": {"h": 0.8, "": 1.0},
    "*": {"": 0.5, "a": 1.5, "e": 1.5, "i": 1.5, "o": 1.5, "u": 1.5}, ".": {"": 0.1}, "-": {"": 0.1}, "_": {"": 0.1}, "~": {"": 0.1}, "'": {"": 0.1}, ",": {"": 0.1}, "/": {"": 0.3}, "`": {"": 0.1}, "^": {"": 0.3}, ":": {"": 0.3},
}
_OTHER = 27
_CODE = np.zeros(256, dtype=np.int32)
_CODE[ord("a") : ord("z") + 1] = _CODE[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CODE[128:] = _OTHER
_SPACED = re.compile(rb"(?:(?<=\s)|^)(?:[!-~]\s){3,}[!-~](?=\s|$)")
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TRIPLE = re.compile(r"(.)\1\1", re.S)
_SEPARATORS = re.compile(r"[.\-_~'`/^:,*]+")
_RUN = re.compile(r"(.)\1*", re.S)
_DISGUISED = re.compile(r"[^\W\d_].*[\d@$!|+*€<(]|[\d@$!|+*€<(].*[^\W\d_]|([^\W\d_])\1\1|[^\W\d_][.\-_~'`/^:,*]+[^\W\d_]", re.S)


def trigrams(docs: DataFrame) -> DataFrame:
    """code, n: character trigrams of all texts, letters without case; at most 28**3 rows."""

    def rows(batches):
        total = np.zeros(28**3, dtype=np.int64)
        for _, texts in text_chunks(batches):
            data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
            c = np.concatenate(([0, 0], _CODE[data[(data & 0xC0) != 0x80]], [0]))  # one code for a character of several bytes
            total += np.bincount((c[:-2] * 28 + c[1:-1]) * 28 + c[2:], minlength=28**3)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at])], names=["code", "n"])

    return keyed(docs).mapInArrow(rows, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: dict[int, int]) -> np.ndarray:
    """-log P(character | two before), interpolated with lower orders."""
    n = np.zeros(28**3)
    for k, v in counts.items():
        n[k] = v
    n = n.reshape(28, 28, 28)
    uni = n.sum((0, 1)) + 1
    uni /= uni.sum()
    bi = n.sum(0)
    bi = (bi + 5 * uni) / (bi.sum(1, keepdims=True) + 5)
    return -np.log((n + 5 * bi) / (n.sum(2, keepdims=True) + 5))


def _letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else _OTHER


def collapsed(token: str) -> tuple[str, list[int]]:
    """The token with runs cut to two characters, and the length of the run that each came from."""
    found = [m.group() for m in _RUN.finditer(token)]
    return "".join(g[:2] for g in found), [len(g) for g in found for _ in g[:2]]


class _Spellings:
    """What paths have said so far, as nodes of a trie: equal spellings are one node, and a letter more is one step."""

    def __init__(self):
        self.ids: dict[tuple[int, str], int] = {}
        self.came: list[tuple[int, str]] = [(-1, "")]

    def add(self, node: int, letter: str) -> int:
        have = self.ids.get((node, letter))
        if have is None:
            have = self.ids[node, letter] = len(self.came)
            self.came.append((node, letter))
        return have

    def read(self, node: int) -> str:
        out = []
        while node:
            node, letter = self.came[node]
            out.append(letter)
        return "".join(reversed(out))


def _best(paths: dict[int, float]) -> list[tuple[int, float]]:
    return sorted(paths.items(), key=lambda x: (x[1], x[0]))[:BEST]


def restorations(token: str, lm: np.ndarray, runs: list[int] | None = None) -> list[str]:
    """The best readings of a disguised token, cheapest first; ``runs`` are the lengths of its characters' runs.

    List Viterbi: a state is the last two characters said, and the ``BEST`` cheapest spellings that lead to each state
    are kept, so nothing that could be among the best at the end is lost."""
    token = token.lower()
    runs = runs or [len(m.group()) for m in re.finditer(r"(.)\1*", token, re.S) for _ in m.group()]
    words = _Spellings()
    states: dict[tuple[int, int, str], list[tuple[int, float]]] = {(0, 0, ""): [(0, 0.0)]}
    for c, run in zip(token, runs, strict=True):
        new: dict[tuple[int, int, str], dict[int, float]] = defaultdict(dict)
        readings = {c: 0.0} if c.isalpha() else READINGS.get(c, {"": 2.0})
        for (p, q, last), paths in states.items():
            for r, price in readings.items():
                if r:
                    k = _letter(r)
                    step, into = price + lm[p, q, k], new[q, k, r]
                    for said, cost in paths:
                        longer = words.add(said, r)
                        into[longer] = min(cost + step, into.get(longer, math.inf))
                if not r or (r == last and run > 1):
                    again, into = price if not r else price + (0.3 if run > 2 else 3.0), new[p, q, last]
                    for said, cost in paths:
                        into[said] = min(cost + again, into.get(said, math.inf))
        states = {state: _best(paths) for state, paths in new.items()}
    ends: dict[int, float] = {}
    for (p, q, _), paths in states.items():
        for said, cost in paths:
            ends[said] = min(cost + lm[p, q, 0], ends.get(said, math.inf))
    return [words.read(said) for said, _ in _best(ends)]


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(f"{word[:k]}~" for k in (4, 5, 6) if len(word) >= k)]


@dataclass
class Scorer:
    lm: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    beta: tuple[float, ...] = ()
    table: dict[bytes, tuple] = field(default_factory=dict)

    def readings(self, token: bytes) -> list[str]:
        """What a token may say: itself if it looks like a word, its restorations if it doesn't."""
        core = token.strip(_EDGES)
        whole = token.decode("utf-8", "replace")
        if len(whole) > LONGEST:
            return self.pieces(core, whole)
        word = core.decode("utf-8", "replace")
        plain = word.isalpha() and not _TRIPLE.search(word.lower())
        signed = bool(word) and whole[0] in "@$!|+€"
        if not signed and (plain or not _DISGUISED.search(whole)):
            return [word.lower()]
        seen = [word.lower()] if word.isalpha() else []
        for form in dict.fromkeys((word, whole.rstrip(".,;:?\"'"))):
            if form:
                seen += restorations(form, self.lm)
        return seen

    def pieces(self, core: bytes, whole: str) -> list[str]:
        """What a token of more than ``LONGEST`` characters may say: its parts, joined single letters, its short form."""
        if len(core.decode("utf-8", "replace")) <= LONGEST:
            return self.readings(core)
        out, letters = [], ""
        parts = _SEPARATORS.split(whole)
        for part in [*parts, "  "] if len(parts) > 1 else ():
            if len(part) == 1:
                letters += part
                continue
            if len(letters) > 1:
                out += self.readings(letters.encode())
            letters = ""
            if part.strip():
                out += self.readings(part.encode())
        short, runs = collapsed(_SEPARATORS.sub("", whole).lower())
        if short and len(short) <= LONGEST:
            out += restorations(short, self.lm, runs)
        elif short and (brief := re.sub(r"(.)\1+", r"\1", short, flags=re.S)) and len(brief) <= LONGEST:
            out += restorations(brief, self.lm)
        return list(dict.fromkeys(out))

    def inside(self, said: str) -> float:
        """The best evidence of words within a string of words run together."""
        longest = max(map(len, self.weights), default=0)
        best = 0.0
        for i in range(len(said) - 3):
            best = max(best, self.weights.get(f"{said[i : i + 6]}~", 0.0), *(self.weights.get(said[i:j], 0.0) for j in range(i + 4, min(len(said), i + longest) + 1)))
        return best

    def evidence(self, token: bytes) -> float:
        whole = token.decode("utf-8", "replace")
        best = 0.0
        if len(whole) > LONGEST:
            short, runs = collapsed(_SEPARATORS.sub("", whole).lower())
            for said in [short] if short.isalpha() and max(runs) < 3 else restorations(short, self.lm, runs):
                best = max(best, self.inside(said))
        for word in self.readings(token):
            for f in features(word):
                best = max(best, self.weights.get(f, 0.0))
        return best

    def spaced(self, text: bytes) -> list[float]:
        """Evidence in runs of single characters: each run is joined and restored as a whole."""
        out = []
        for m in _SPACED.finditer(text):
            for said in restorations(b"".join(m.group().split()).decode("utf-8", "replace"), self.lm):
                found = [w for i in range(len(said)) for f in features(said[i : i + LONGEST]) if f.endswith("~") or i == 0 if (w := self.weights.get(f, 0.0))]
                if found:
                    out += found
                    break
        return out

    def __getitem__(self, token: bytes) -> float:
        have = self.table.get(token)
        if have is None:
            if len(self.table) > 400_000:
                self.table.clear()
            have = self.table[token] = self.evidence(token)
        return have

    def inputs(self, text: bytes) -> tuple[float, float]:
        found = [w for w in map(self.__getitem__, text.split()) if w] + self.spaced(text)
        return (max(found), math.log1p(len(found))) if found else (0.0, 0.0)

    def score(self, text: bytes) -> float:
        if not self.beta:
            return 0.0
        z = self.beta[0] + sum(b * x for b, x in zip(self.beta[1:], self.inputs(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def words(self, text: bytes) -> set[str]:
        out = set()
        for token in set(text.split()):
            for word in self.readings(token):
                out.update(features(word))
        return out

    def weigh(self, counts: dict[str, tuple[int, int]], n_pos: int, n_neg: int) -> None:
        """Log-odds of telling words from the numbers of toxic and of other documents that have each."""
        for word, (pos, neg) in counts.items():
            odds = math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))
            if pos >= least(n_pos) and odds > 1.5:
                self.weights[word] = odds
        self.table.clear()

    def calibrate(self, inputs: list[tuple[float, float, int]]) -> Scorer:
        """The logistic function of the evidence (two inputs, label)."""
        x = np.array([(1.0, a, b) for a, b, _ in inputs])
        y = np.array([float(v) for *_, v in inputs])
        beta = np.zeros(3)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-2, 1e-2])
            beta += np.clip(np.linalg.solve(h, x.T @ (y - p) - np.array([1e-3, 1e-2, 1e-2]) * beta), -5, 5)
        self.beta = tuple(float(b) for b in beta)
        return self

    def fit(self, rows: list[tuple[bytes, int]]) -> Scorer:
        """Both steps from (text, label) in one place."""
        positive, negative = Counter(), Counter()
        for text, label in rows:
            (positive if label else negative).update(self.words(text))
        n_pos = sum(y for _, y in rows)
        if not n_pos or n_pos == len(rows):
            return self
        self.weigh({w: (n, negative[w]) for w, n in positive.items()}, n_pos, len(rows) - n_pos)
        return self.calibrate([(*self.inputs(t), y) for t, y in rows])


def least(n_pos: int) -> float:
    return max(LEAST_DOCS, LEAST_SHARE * n_pos)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """The character model from all documents, the classifier from a bounded sample of labelled ones."""
    spark = docs.sparkSession
    scorer = Scorer(language_model({r[0]: r[1] for r in trigrams(docs).collect()}))
    l = labels.select(labels["doc_id"].alias("l_id"), labels["toxic"].cast("int").alias("label")).where("label is not null")
    d = tagged(docs.where(docs["doc_id"].isNotNull()).select(docs["doc_id"], docs["text"]))
    d = d.where(~held_out("doc"))
    # of documents with one text and label one counts; at most ``sample`` are chosen, and only their texts are read
    keys = d.select("doc", "tag").join(l, d["doc"] == l["l_id"]).groupBy("tag", "label").agg(F.min("doc").alias("doc"))
    chosen = keys.orderBy(F.xxhash64("doc"), "label", "tag").limit(sample)
    texts = d.join(F.broadcast(chosen), ["doc", "tag"]).dropDuplicates(["tag", "label"]).select("label", "text")
    texts = written(texts, shared_dir(spark), "sample")
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos = sum(n for y, n in sizes.items() if y)
    n_neg = sum(sizes.values()) - n_pos
    if not n_pos or not n_neg:
        return scorer
    model = spark.sparkContext.broadcast(scorer)

    def seen(batches):
        for labels, texts in text_chunks(batches):
            pairs = [(w, int(bool(y[0]))) for y, t in zip(labels, texts, strict=True) for w in model.value.words(t)]
            if pairs:
                yield pa.record_batch([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int64())], names=["word", "toxic"])

    counts = texts.mapInArrow(seen, "word string, toxic long").groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    scorer.weigh({r["word"]: (r["pos"], r["neg"]) for r in counts.where(F.col("pos") >= least(n_pos)).collect()}, n_pos, n_neg)
    weighed = spark.sparkContext.broadcast(scorer)

    def inputs(batches):
        for labels, texts in text_chunks(batches):
            a, b = zip(*(weighed.value.inputs(t) for t in texts), strict=True)
            yield pa.record_batch([pa.array(a, pa.float64()), pa.array(b, pa.float64()), pa.array([int(bool(y[0])) for y in labels], pa.int64())], names=["a", "b", "label"])

    return scorer.calibrate(sorted(map(tuple, texts.mapInArrow(inputs, "a double, b double, label long").collect())))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scorer = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))

    def rows(batches):
        model = scorer.value
        for keys, texts in text_chunks(batches):
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), pa.array([model.score(t) for t in texts], pa.float64())], names=["doc", "score"])

    out = keyed(docs).mapInArrow(rows, "doc long, score double").select(real_id().alias("doc_id"), "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
