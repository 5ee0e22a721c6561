"""Substring deduplication with prefix-partitioned suffix trees.

Suffixes are sampled at content-defined anchors, so that equal 50-word windows are sampled at equal places. The tree
over them is split by prefixes of variable length into groups that fit a task's memory:

1. The first prefix is the ten words at the anchor. Suffixes are counted by prefix, and by the whole stretch of text
   that their windows cover (a leaf). A prefix with one suffix has nothing repeated below it. Leaves collapse, so a
   passage in a third of all documents is one leaf with its first holder, and later holders lose all its windows.
2. A prefix with more leaves than one branches. With at most ``GROUP`` leaves it is a group: the spans of its leaves go
   to one task, where a subtree is built over all suffixes that start at a window of theirs (``Subtree``: words,
   ranked to depth 50 by prefix doubling). An internal node 50 words deep is a maximal repeat; a leaf's windows below
   one that an earlier document holds go.
3. A prefix with more leaves is extended: to the words that eight neighbouring windows share, then to a window's 50
   words, where every prefix has one leaf. The longer prefixes are counted and grouped in the same way.

So no list of a prefix's holders is longer than ``GROUP``, and a longer one costs a longer prefix. An empty table
gives an empty one. Nulls are texts without words; a null doc_id sorts first. Rows with the same doc_id don't remove
each other's words, and repeated rows have the same result each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.common import dropped, real_id, shared_dir, written
from quillmask.llm.repeats import HOLDER, Shape, block_rows, covered, judged, leaves, located, opened, runs, spot_columns, unpacked

#: Leaves of a prefix that a subtree may have, words of the subtrees built at a time, and windows of a longer prefix.
GROUP, BATCH, LONGER = 2048, 1 << 18, (8, 1)


class Subtree:
    """Suffix subtrees of several prefixes at once: ranks of all suffixes to a depth, by prefix doubling.

    Two suffixes have equal ranks where their first ``depth`` words are equal: they are below one node of that depth."""

    def __init__(self, spans: list[bytes], depth: int):
        split = pc.split_pattern(pa.array(spans, pa.large_binary()), b" ")
        self.sizes = pc.list_value_length(split).to_numpy()
        rank = split.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
        reach = 1
        while reach < depth:
            step = min(reach, depth - reach)
            later = np.append(rank[step:], np.full(min(step, len(rank)), -1)) + 1
            rank = np.unique(rank * (later.max() + 1) + later, return_inverse=True)[1]
            reach += step
        self.rank = rank

    def repeats(self, group: np.ndarray, count: np.ndarray, holder: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(span, first window, windows) that a span of the same group with a smaller holder has, from the deep nodes.

        Span i has ``count[i]`` windows and belongs to prefix ``group[i]``."""
        starts = np.cumsum(self.sizes) - self.sizes
        span = np.repeat(np.arange(len(count)), count)
        window = np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count)
        deep = self.rank[starts[span] + window]
        order = np.lexsort((holder[span], deep, group[span]))
        g, d, h = group[span][order], deep[order], holder[span][order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        first = h[np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = np.zeros(len(span), dtype=bool)
        gone[order] = first < h
        turn = gone.copy()
        turn[1:] &= ~gone[:-1] | (span[1:] != span[:-1])
        lo = np.flatnonzero(turn)
        stop = gone.copy()
        stop[:-1] &= ~gone[1:] | (span[1:] != span[:-1])
        return span[lo], window[lo], np.flatnonzero(stop) - lo + 1


def shape(width: int = 50, gram: int = 10) -> Shape:
    return Shape("word", width, min(gram, width))


def _span_rows(s: Shape):
    """node, leaf, holder, count, span: the words that each listed run (node, leaf, head_doc, at) of a text covers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for spots, z in zip(batch.column(2), batch.column(3), strict=True):
                spot = spot_columns(spots)
                start, count, _ = unpacked(spot["at"])
                for base, piece, here in located(unpack.decompress(z.as_py()), s, start, count):
                    words = piece.split()
                    spans = [b" ".join(words[a : a + c - 1 + s.width]) for a, c in zip((start[here] - base).tolist(), count[here].tolist(), strict=True)]
                    yield pa.record_batch([pa.array(spot["node"][here]), pa.array(spot["leaf"][here]), pa.array(spot["head_doc"][here]), pa.array(count[here]), pa.array(spans, pa.binary())], names=["node", "leaf", "holder", "count", "span"])

    return rows


def _tree_rows(s: Shape, most: int):
    """node, leaf, lo, windows that earlier documents hold, from spans sorted by node; a node's spans are never split."""

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        node, leaf, holder, count = (np.array(c, dtype=np.int64) for c in list(zip(*rows, strict=True))[:4])
        span, lo, n = Subtree([r[4] for r in rows], s.width).repeats(node, count, holder)
        return pa.record_batch([pa.array(x) for x in (node[span], leaf[span], lo, n)], names=["node", "leaf", "lo", "windows"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        words, now = 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if words >= most and row[0] != now:
                    yield solved(held)
                    held, words = [], 0
                held.append(row)
                now, words = row[0], words + row[3] - 1 + s.width
        if held:
            yield solved(held)

    return rows


def repeated_runs(docs: DataFrame, width: int = 50, gram: int = 10) -> tuple[DataFrame, Shape]:
    """doc, tag, at: packed runs of windows whose words also start in a document with a smaller doc_id."""
    spark, s, base = docs.sparkSession, shape(width, gram), shared_dir(docs.sparkSession)
    run_rows, found = runs(docs, s), None
    for k, size in enumerate((*LONGER, 0)):
        leaf_rows = written(leaves(run_rows), base, f"leaves-{k}")
        prefixes = leaf_rows.groupBy("node").agg(F.sum("n").alias("node_n"), F.count(F.lit(1)).alias("n_leaves")).where("node_n > 1")
        branch = written(leaf_rows.join(prefixes, "node").drop("n", "node_n"), base, f"branch-{k}")
        dropped(spark, f"{base}/leaves-{k}")
        met = run_rows.join(branch, ["node", "leaf"]).select("node", "leaf", "doc", "tag", "at", "n_leaves", "head_doc")
        # of a leaf's holders the later ones lose all; the first's windows are looked up below the prefix
        met = written(met.where((F.col("doc") > F.col("head_doc")) | (F.col("n_leaves") > 1)), base, f"met-{k}")
        first = met.where("doc = head_doc")
        flagged = met.where("doc > head_doc").select("doc", "tag", "at")
        if size:
            grouped = branch.where(F.col("n_leaves").between(2, GROUP)).selectExpr("node", "leaf", "head_doc", *HOLDER)
            spans = opened(docs, grouped).mapInArrow(_span_rows(s), "node long, leaf long, holder long, count long, span binary")
            trees = spans.repartition("node").sortWithinPartitions("node").mapInArrow(_tree_rows(s, BATCH), "node long, leaf long, lo long, windows long")
            run = F.shiftright("at", 16) + F.col("lo")
            below = first.join(trees, ["node", "leaf"]).select("doc", "tag", (F.shiftleft(run, 16) + F.shiftleft(F.col("windows") - 1, 8)).alias("at"))
            flagged = flagged.unionByName(written(below, base, f"trees-{k}"))
            longer = first.where(F.col("n_leaves") > GROUP).select("doc", "tag", "node", "at")
            run_rows = written(opened(docs, longer).mapInArrow(block_rows(s, size), run_rows.schema), base, f"longer-{k}")
        found = flagged if found is None else found.unionByName(flagged)
        dropped(spark, f"{base}/branch-{k}")
        if size and run_rows.isEmpty():
            break
    return found, s


def remove_repeats(docs: DataFrame, width: int = 50, gram: int = 10, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text: kept words joined by one space."""
    found, s = repeated_runs(docs, width, gram)

    def judge(text: bytes, at: np.ndarray) -> list:
        words = text.split()
        n = len(words)
        if len(at):
            words = [w for w, g in zip(words, covered(at, n, s.width).tolist(), strict=True) if not g]
        kept = b" ".join(words)
        return [n, n - len(words), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])]

    fields = [("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * with_text
    out = judged(docs, found, judge, "doc long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text, pa.schema(fields))
    return out.select(real_id().alias("doc_id"), *[n for n, _ in fields[1:]])


#: Windows are compared by 128 bits of MD5.
SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS k, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS MATERIALIZED (SELECT rid, k, i, md5_number(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT rid, k, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
firsts AS (SELECT g, min(k) AS first_k FROM windows GROUP BY g),
hits AS (SELECT rid, i, 1 AS hit FROM windows JOIN firsts USING (g) WHERE first_k < k),
words AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
marked AS (SELECT rid, i, word, coalesce(max(hit) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone FROM words LEFT JOIN hits USING (rid, i)),
kept AS (SELECT rid, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept_text FROM marked GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""
