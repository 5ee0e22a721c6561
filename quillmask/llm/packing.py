"""Lexical retrieval packing: a sharded BM25 index returns unused neighbours of a seed, which greedily fill its window.

Documents become token ids, plus an end id. Each has a lexical feature, its id of least hash weighted by rarity (the
order of a byte-pair vocabulary stands for it), which like documents often share. All documents lie on a line: features
one after the other, each as long as its tokens, and a document at a place within its feature's stretch that a hash
gives. A shard is a stretch of ``SHARD_TOKENS``. So rare features share a shard, a frequent one has as many as it
needs (thousands of copies too), and that is the same at every size. A document counts ``ROW`` tokens more than it has,
so that empty ones weigh too.

In a shard an inverted index over token ids ranks by BM25 all unused documents that share ids with a window's seed: the
document whose rest opens the window, or else the first unused one. They follow in order of score until the window is
full. The last is cut, and its rest opens the next window. If none is left that shares ids, the first unused document is
the next seed in the same window: only the last sequence of a shard is padded. All ids of a seed take part; those in half
of the shard's documents or more weigh nothing by BM25's own formula. Postings of used documents are thrown out as their
number grows.

Every id lies in exactly one piece. An empty table gives an empty one. Null texts are empty and hold just the end id.
Repeated rows are packed each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.common import mix64, real_id, shared_dir, tagged, text_chunks, trimmed_memory, written
from quillmask.llm.tokens import GROUP, encoder

#: Tokens of a shard, and those that a document counts for besides its own.
SHARD_TOKENS, ROW = 1 << 21, 16
K1, B = 1.2, 0.75
_TOP = 64


def feature(ids: np.ndarray) -> int:
    """The id of least weighted hash: of two documents' ids, rarer ones are likelier to be it; -1 without ids."""
    if not len(ids):
        return -1
    u = (mix64(ids.astype(np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return int(ids[np.argmin(-np.log(u + 1e-18) / (ids + 1.0))])


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc, tag, feature, n, wide, ids (unsigned 16 bits where all fit, else 32, as ``wide`` says)."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(tokenizer), np.array([end_id], dtype="<u4")
        for keys, texts in text_chunks(batches, GROUP):
            out = []
            for (doc, tag), ids in zip(keys, words.encode(texts), strict=True):
                name, ids = feature(ids), np.concatenate((ids, end))
                wide = bool(ids.max() > 0xFFFF)
                out.append((doc, tag, name, len(ids), wide, ids.astype("<u4" if wide else "<u2").tobytes()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc", "tag", "feature", "n", "wide", "ids"])

    return tagged(docs).mapInArrow(rows, "doc long, tag long, feature long, n long, wide boolean, ids binary")


def placed(tokens: DataFrame, shard_tokens: int) -> DataFrame:
    """``tokens`` with shard. The stretches are a row for each id of the vocabulary at most."""
    stretch = tokens.groupBy("feature").agg(F.sum(F.col("n") + ROW).alias("size")).orderBy("feature").collect()
    ends = np.cumsum([r["size"] for r in stretch], dtype=np.int64) if stretch else np.zeros(0, dtype=np.int64)
    rows = [(r["feature"], int(e - r["size"]), r["size"]) for r, e in zip(stretch, ends, strict=True)]
    line = tokens.sparkSession.createDataFrame(rows, "feature long, first long, size long")
    within = F.pmod(F.xxhash64("doc", "tag"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    shard = F.floor((F.col("first") + within * F.col("size")) / F.lit(shard_tokens))
    return tokens.join(F.broadcast(line), "feature").select(shard.alias("shard"), "doc", "n", "wide", "ids")


class ShardIndex:
    """BM25 postings of a shard's documents, in arrays; used documents are passed over."""

    def __init__(self, docs: list[np.ndarray]):
        self.n = len(docs)
        lengths = np.array([len(d) for d in docs], dtype=np.float64)
        self.terms, counts = zip(*(np.unique(d, return_counts=True) for d in docs), strict=True)
        flat = np.concatenate(self.terms).astype(np.int64)
        owner, tf = np.repeat(np.arange(self.n), [len(t) for t in self.terms]), np.concatenate(counts).astype(np.float64)
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean()))
        self.vocabulary, term, df = np.unique(flat, return_inverse=True, return_counts=True)
        idf = np.maximum(0.0, np.log((self.n - df + 0.5) / (df + 0.5)))
        weight = (idf[term] * tf * (K1 + 1) / (tf + norm[owner])).astype(np.float32)
        self._file(term, owner, weight, (idf[term] > 0) & (df[term] > 1))
        self.unused = np.ones(self.n, dtype=bool)
        self.left = self.filed = self.n

    def _file(self, term: np.ndarray, owner: np.ndarray, weight: np.ndarray, keep: np.ndarray) -> None:
        term, owner, weight = term[keep], owner[keep], weight[keep]
        order = np.argsort(term, kind="stable")
        self.term, self.owner, self.weight = term[order], owner[order], weight[order]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(self.vocabulary)))))

    def use(self, doc: int) -> None:
        self.unused[doc] = False
        self.left -= 1
        if 4 * self.left <= 3 * self.filed and self.left:
            self._file(self.term, self.owner, self.weight, self.unused[self.owner])
            self.filed = self.left

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for all ids of the seed; 0 for used ones."""
        at = np.searchsorted(self.vocabulary, self.terms[seed])
        n = self.first[at + 1] - self.first[at]
        ends = np.cumsum(n)
        if not len(ends) or not ends[-1]:
            return np.zeros(self.n)
        where = np.repeat(self.first[at] - (ends - n), n) + np.arange(ends[-1])
        found = np.bincount(self.owner[where], weights=self.weight[where], minlength=self.n)
        found[~self.unused] = 0
        return found

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents that share ids with the seed, best first; of equals the first."""
        found = self.scores(seed)
        some = np.flatnonzero(found > 0)
        if len(some) > _TOP:
            top = some[found[some] >= np.partition(found[some], len(some) - _TOP)[len(some) - _TOP]]
            yield from top[np.argsort(-found[top], kind="stable")].tolist()
            some = some[found[some] < found[top].min()]
        yield from some[np.argsort(-found[some], kind="stable")].tolist()


def pack_shard(shard: int, docs: list[int], ids: list[np.ndarray], window: int) -> list[tuple]:
    """(doc, start, length, crc32, doc_tokens, sequence, offset, index of the document) of every piece."""
    index = ShardIndex([d[:-1] for d in ids])  # all documents have the end id
    out, sequence, offset, cursor, ranked, seed = [], 0, 0, 0, iter(()), -1
    for _ in range(index.n):
        now = next((i for i in ranked if index.unused[i]), -1)
        if now < 0:
            while not index.unused[cursor]:
                cursor += 1
            now = seed = cursor
        index.use(now)
        raw, start, n = ids[now].astype("<u4").tobytes(), 0, len(ids[now])
        while start < n:
            take = min(n - start, window - offset)
            out.append((docs[now], start, take, zlib.crc32(raw[4 * start : 4 * (start + take)]), n, (shard << 32) + sequence, offset, now))
            start, offset = start + take, offset + take
            if offset == window:
                sequence, offset, seed = sequence + 1, 0, now if start < n else -1
                ranked = iter(())
        if seed == now:
            ranked = index.neighbours(now)
    return out


def packed(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, with_ids: bool = False, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (binary, unsigned 32 bits)."""
    names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc", kind="stable")
        ids = [np.frombuffer(x, dtype="<u4" if w else "<u2") for x, w in zip(pdf["ids"], pdf["wide"], strict=True)]
        # equal doc_ids need an order that doesn't depend on arrival
        order = sorted(range(len(ids)), key=lambda i: (pdf["doc"].iat[i], len(ids[i]), zlib.crc32(ids[i].tobytes()))) if pdf["doc"].duplicated().any() else range(len(ids))
        owners, ids = [int(pdf["doc"].iat[i]) for i in order], [ids[i] for i in order]
        out = pd.DataFrame(pack_shard(int(key[0]), owners, ids, window), columns=[*names, "at"])
        if with_ids:
            out["ids"] = [ids[i][s : s + k].astype("<u4").tobytes() for i, s, k in zip(out["at"], out["start"], out["length"], strict=True)]
        trimmed_memory()
        return out.drop(columns="at")

    schema = ", ".join(f"{n} long" for n in names) + ", ids binary" * with_ids
    tokens = written(tokenised(docs, tokenizer, end_id), shared_dir(docs.sparkSession), "tokens")
    out = placed(tokens, shard_tokens).groupBy("shard").applyInPandas(pack, schema)
    return out.select(real_id().alias("doc_id"), *names[1:], *["ids"] * with_ids)
