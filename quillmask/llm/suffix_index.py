"""Suffix-array deduplication with a logarithmic family of indexes.

A batch of documents becomes a level: an array of its sampled suffixes (see ``repeats``: content-defined samples make
equal 200-byte strings meet at equal places, at one suffix in some 70 bytes) in suffix order, by their first four
bytes, then by a hash of their first 64. Equal suffixes with equal surroundings are one entry with a count and its
first holder. ``IndexFamily.append`` merge-scans a new level against every existing one: both are sorted by suffix, so
suffixes whose prefixes agree meet. A scan gives matches: the entries, old and new, of every prefix that the batch has
in common with a level or twice in itself. Then two levels of one rank are merged into one of the next rank, as in a
binary counter, so that an entry is rewritten log2(batches) times.

All results come from the matches. An entry that was matched with itself recurs as a whole. Of other entries of a
matched prefix, windows are compared one by one: first in blocks of 16 neighbours, then, where those branch, singly,
each named by 128 bits of its 200 bytes. An entry that no scan matched is never looked at again.

An empty table gives an empty one. Null texts are empty; a null doc_id is an ordinary one; rows with one doc_id are
separate documents; repeated rows match each other. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.llm.common import dropped, real_id, shared_dir, written
from quillmask.llm.repeats import HOLDER, Shape, block_rows, covered, judged, leaves, opened, runs

#: Windows of the blocks in which matched entries are compared, step by step.
BLOCKS = (16, 1)


def _merged(rows: list[DataFrame], count=F.sum) -> DataFrame:
    """Entries of several arrays as one each."""
    return reduce(DataFrame.unionByName, rows).groupBy("node", "leaf").agg(count("n").alias("n"), *[F.first(c).alias(c) for c in ("its_doc", "its_tag", "its_at")])


class IndexFamily:
    """Levels of sampled suffixes in suffix order, in the shared folder, and the matches between batches."""

    def __init__(self, spark: SparkSession, base: str, width: int = 200, gram: int = 64):
        self.spark, self.base = spark, base
        self.shape = Shape("byte", width, min(gram, width))
        self.levels: list[tuple[int, str, DataFrame]] = []  # rank, name, entries; ranks fall
        self.matches: list[DataFrame] = []
        self.serial = 0

    def _level(self, rank: int, rows: DataFrame) -> tuple[int, str, DataFrame]:
        self.serial += 1
        name = f"level-{self.serial}-rank-{rank}"
        return rank, name, written(rows.sortWithinPartitions("node", "leaf"), self.base, name)

    def _scan(self, new: DataFrame, turn: int) -> DataFrame:
        """The merge scan: entries of the new level and of the existing ones whose prefixes match, with their occurrences in both."""
        prefixes = new.groupBy("node").agg(F.sum("n").alias("node_n"))
        twice = prefixes.where("node_n > 1").select("node")
        if not self.levels:
            return new.join(twice, "node", "left_semi")
        there = [old.join(new.select("node"), "node", "left_semi") for _, _, old in self.levels]
        old = written(reduce(DataFrame.unionByName, there), self.base, f"met-{turn}")
        return _merged([new.join(twice.union(old.select("node")), "node", "left_semi"), old])

    def append(self, docs: DataFrame) -> DataFrame:
        """Index a batch; returns its matches with itself and with what was there before."""
        turn = len(self.matches)
        new = self._level(0, leaves(runs(docs, self.shape)).drop("head_doc"))
        hits = written(self._scan(new[2], turn), self.base, f"matches-{turn}")
        self.matches.append(hits)
        dropped(self.spark, f"{self.base}/met-{turn}")
        while self.levels and self.levels[-1][0] == new[0]:
            old = self.levels.pop()
            joined = self._level(new[0] + 1, _merged([old[2], new[2]]))
            for name in (old[1], new[1]):
                dropped(self.spark, f"{self.base}/{name}")
            new = joined
        self.levels.append(new)
        return hits

    def matched(self) -> DataFrame:
        """All entries that a scan matched: node, leaf, n (over 1: the entry itself recurs), a holder, n_leaves (entries of its prefix)."""
        # a scan counts occurrences so far, so the last one has most; an entry that comes twice is in some scan as two
        entries = _merged(self.matches, F.max)
        return entries.join(entries.groupBy("node").agg(F.count(F.lit(1)).alias("n_leaves")), "node")

    def close(self) -> None:
        """Delete the levels; matches stay."""
        for _, name, _ in self.levels:
            dropped(self.spark, f"{self.base}/{name}")
        self.levels = []


def repeated_runs(docs: DataFrame, width: int = 200, gram: int = 64, batches: int = 4) -> DataFrame:
    """doc, tag, at: packed runs of windows whose bytes also start elsewhere. Documents arrive in ``batches`` batches."""
    spark = docs.sparkSession
    family = IndexFamily(spark, shared_dir(spark), width, gram)
    base, s = family.base, family.shape
    part = F.pmod(F.xxhash64(docs["doc_id"].cast("long"), docs["text"]), F.lit(batches))
    for b in range(batches):
        family.append(docs.where(part == b))
    family.close()
    entries, run_rows, found = family.matched(), runs(docs, s), None
    for k, size in enumerate((*BLOCKS, 0)):
        branch = written(entries.select("node", "leaf", "n", "n_leaves", "its_doc", "its_tag", "its_at"), base, f"branch-{k}")
        # an entry that recurs loses all its windows; of each other one the holder's are compared, with those of all entries
        listed = written(branch.where("n_leaves > 1").selectExpr("node", *HOLDER), base, f"listed-{k}")
        met = written(run_rows.join(branch.where("n > 1").select("node", "leaf"), ["node", "leaf"], "left_semi").select("doc", "tag", "at"), base, f"met-{k}")
        dropped(spark, f"{base}/branch-{k}")
        found = met if found is None else found.unionByName(met)
        if not size:
            break
        run_rows = written(opened(docs, listed).mapInArrow(block_rows(s, size), run_rows.schema), base, f"opened-{k}")
        rows = leaves(run_rows)
        prefixes = rows.groupBy("node").agg(F.sum("n").alias("node_n"), F.count(F.lit(1)).alias("n_leaves")).where("node_n > 1")
        entries = rows.join(prefixes, "node")
    return found


def remove_repeats(docs: DataFrame, width: int = 200, gram: int = 64, batches: int = 4, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary)."""
    found = repeated_runs(docs, width, gram, batches)

    def judge(text: bytes, at: np.ndarray) -> list:
        n = len(text)
        gone = covered(at, n, width) if len(at) else np.zeros(n, dtype=bool)
        removed = int(gone.sum())
        kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if removed else text
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if removed else 0
        return [n, removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])]

    fields = [("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_text
    out = judged(docs, found, judge, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text, pa.schema(fields))
    return out.select(real_id().alias("doc_id"), *[n for n, _ in fields[1:]])


#: Bytes are pairs of hexadecimal digits; windows are compared by 128 bits of MD5.
SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS MATERIALIZED (SELECT rid, i, md5_number(substr(h, 2 * i - 1, 400)) AS g FROM (SELECT rid, h, unnest(range(1, length(h) // 2 - 198)) AS i FROM d)),
hits AS (SELECT rid, i, 1 AS hit FROM windows SEMI JOIN (SELECT g FROM windows GROUP BY g HAVING count(*) > 1) USING (g)),
bytes AS (SELECT rid, i, substr(h, 2 * i - 1, 2) AS b FROM (SELECT rid, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM d)),
marked AS (SELECT rid, i, b, coalesce(max(hit) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 0) AS gone FROM bytes LEFT JOIN hits USING (rid, i)),
edged AS (SELECT *, gone - lag(gone, 1, 0) OVER (PARTITION BY rid ORDER BY i) AS turn FROM marked),
kept AS (SELECT rid, sum(gone) AS n_removed, count(*) FILTER (turn = 1) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (gone = 0) AS kept_hex FROM edged GROUP BY rid)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept_hex, ''))) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""
