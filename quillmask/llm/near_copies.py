"""Near copies by the exact similarity of five-word shingle sets, for the pipeline.

Documents with one set of distinct shingles are a node. Candidates meet in buckets: ``BANDS`` hashes of ``ROWS``
minima of the set each (a pair of similarity 0.8 misses all of them once in some 14,000 times), and the groups of
operator 5's vantage-point tree. Only pairs whose exact similarity (shared shingles of all) is ``SIMILAR`` or more are
linked, and linked groups are connected components.

A bucket's pairs aren't listed. First its leader, the member whose buckets are the largest, is compared with the others:
thousands of copies of one text so cost about one comparison each. Buckets that then still hold several components are
dealt in chunks of about ``CHUNK`` bytes to tasks. A task compares sketches (all ``BANDS`` * ``ROWS`` minima) of every two
members of different components that meet in no earlier band, and the sets themselves where ``AGREE`` minima agree (a
pair of similarity 0.8 falls short of that once in some 7,000 times). Only links leave a task.

An empty table gives an empty one. A text of one to five words is one shingle; null texts and texts without words are
one node. A document is a row: null and equal doc_ids don't join documents. Other columns are carried along, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm import simhash
from quillmask.llm.common import mix64, shared_dir, tagged, text_chunks, written
from quillmask.llm.components import components
from quillmask.llm.windows import Sequences

SHINGLE, SIMILAR, BANDS, ROWS = 5, (4, 5), 24, 5
CHUNK, AGREE = 2 << 20, 80
_BLOCK = 1 << 11
_FLIP, _TURN = (mix64(np.arange(k, k + BANDS * ROWS, dtype=np.uint64)) >> np.uint64(32) for k in (1, 1 << 20))
_FLIP, _TURN = _FLIP.astype(np.uint32)[:, None], (_TURN.astype(np.uint32) | np.uint32(1))[:, None]


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; letters without case."""
    words = Sequences.of_words([t.lower() for t in texts])
    grams = mix64(words.first.grams(shingle)) if words.n >= shingle else np.zeros(0, dtype=np.uint64)
    out = []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        else:
            out.append(mix64(words.first.of(np.array([a]), np.array([b])) + np.uint64(b - a)) if b > a else grams[:0])
    return out


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of each of ``BANDS`` * ``ROWS`` permutations of a set's hashes."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(short), _BLOCK):
        np.minimum(least, ((short[None, at : at + _BLOCK] ^ _FLIP) * _TURN).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A bucket per band."""
    names = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        names = mix64(names * np.uint64(0x9E3779B97F4A7C15) + column)
    return names.view(np.int64)


def _node(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64)) if len(hashes) else 0


def _rows(docs: DataFrame) -> DataFrame:
    """doc, tag (a hash of the text), fp, node, bands, sketch (16 bits of each minimum)."""
    none, blank = np.zeros(0, dtype=np.int64), b""

    def rows(batches):
        for keys, texts in text_chunks(batches):
            sets = shingle_sets(texts)
            fps = np.array([simhash.fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            least = [minima(s) if len(s) else None for s in sets]
            yield pa.record_batch([
                pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(fps), pa.array([_node(s) for s in sets], pa.int64()),
                pa.array([none if x is None else bands(x) for x in least], pa.list_(pa.int64())), pa.array([blank if x is None else (x & np.uint32(0xFFFF)).astype("<u2").tobytes() for x in least], pa.binary()),
            ], names=["doc", "tag", "fp", "node", "bands", "sketch"])

    return tagged(docs).mapInArrow(rows, "doc long, tag long, fp long, node long, bands array<long>, sketch binary")


def _sets(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """node, hashes (binary) of the nodes of ``heads`` (doc, tag)."""

    def rows(batches):
        for _, texts in text_chunks(batches):
            sets = shingle_sets(texts)
            yield pa.record_batch([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "hashes"])

    return tagged(docs).join(heads, ["doc", "tag"], "left_semi").select("doc", "text").mapInArrow(rows, "node long, hashes binary").dropDuplicates(["node"])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets are similar."""
    if SIMILAR[1] * min(len(a), len(b)) < SIMILAR[0] * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * shared >= SIMILAR[0] * (len(a) + len(b) - shared)


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""

    def rows(batches):
        for batch in batches:
            good = [alike(np.frombuffer(a.as_py(), dtype=np.uint64), np.frombuffer(b.as_py(), dtype=np.uint64)) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    u, v = sets.toDF("u", "hashes_u"), sets.toDF("v", "hashes_v")
    return pairs.join(v, "v").join(u, "u").select("u", "v", "hashes_u", "hashes_v").mapInArrow(rows, "u long, v long")


def close_pairs(sketch: np.ndarray, root: np.ndarray, band: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a left and a right member of different components whose sketches agree well enough, and in no band before this one."""
    a, b, step = [left[:0]], [right[:0]], max(1, (1 << 16) // max(1, len(right)))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        same = sketch[some][:, None, :] == sketch[right][None, :, :]
        x, y = np.nonzero((same.sum(axis=2, dtype=np.int16) >= AGREE) & (root[some][:, None] != root[right][None, :]))
        earlier = same[x, y, : band * ROWS].reshape(len(x), band, ROWS).all(axis=2).any(axis=1)
        a.append(some[x[~earlier]])
        b.append(right[y[~earlier]])
    return np.concatenate(a), np.concatenate(b)


def _close(members: DataFrame) -> DataFrame:
    """u, v: similar nodes of different components that share a bucket. ``members``: bucket, band, node, root, sketch, hashes."""
    bytes_ = F.sum(F.octet_length("hashes") + F.octet_length("sketch"))
    sizes = members.groupBy("bucket").agg(F.ceil(bytes_ / CHUNK).cast("int").alias("chunks"))
    dealt = members.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "band", "own", "node", "root", "sketch", "hashes")
    dealt = dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "node")

    def links(rows: list[tuple]) -> pa.RecordBatch:
        _, low, high, band, own, node, root, sketch, sets = zip(*rows, strict=True)
        own, node, root = np.array(own), np.array(node, dtype=np.int64), np.array(root, dtype=np.int64)
        sketch = np.frombuffer(b"".join(sketch), dtype="<u2").reshape(len(rows), -1)
        u, v = close_pairs(sketch, root, band[0], np.flatnonzero(own == low[0]), np.flatnonzero(own == high[0]))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in sets]
        good = np.array([alike(sets[a], sets[b]) for a, b in zip(u.tolist(), v.tolist(), strict=True)], dtype=bool)
        u, v = node[u[good]], node[v[good]]
        return pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    def rows(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    yield links(held)
                    held = []
                held.append(row)
        if held:
            yield links(held)

    return dealt.mapInArrow(rows, "u long, v long").distinct()


def groups(docs: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``_rows``, and node, root of every node that isn't its group's root."""
    rows = written(_rows(docs), base, "rows")
    nodes = rows.where("node <> 0").groupBy("node").agg(*[F.first(c).alias(c) for c in ("bands", "sketch", "doc", "tag")])
    nodes = written(nodes, base, "nodes-similar")
    tree = simhash.groups(rows.select("doc", "fp"), base).select("fp", F.xxhash64(F.lit("tree"), "root").alias("bucket"))
    spots = nodes.select(F.posexplode("bands").alias("band", "bucket"), "node")
    spots = spots.unionByName(rows.where("node <> 0").select("fp", "node").distinct().join(tree, "fp").select(F.lit(BANDS).alias("band"), "bucket", "node").distinct())
    spots = written(spots, base, "spots")
    sizes = spots.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = spots.join(sizes, "bucket")
    members = written(sized.join(sized.groupBy("node").agg(F.sum("size").alias("weight")), "node").select("bucket", "band", "node", "weight"), base, "members")
    heads = nodes.join(members.select("node").distinct(), "node", "left_semi").select("doc", "tag")
    sets = written(_sets(docs, heads), base, "sets")
    leaders = members.groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"))
    pairs = members.join(leaders, "bucket").where("node <> leader").select(F.least("leader", "node").alias("u"), F.greatest("leader", "node").alias("v")).distinct()
    first = written(_alike(pairs, sets), base, "links-1")
    roots = components(first, f"{base}/round-1").withColumnRenamed("u", "node")
    placed = members.join(roots, "node", "left").select("bucket", "band", "node", F.coalesce("root", "node").alias("root"))
    alive = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    placed = placed.join(alive, "bucket", "left_semi").join(nodes.select("node", "sketch"), "node").join(sets, "node")
    second = written(_close(placed), base, "links-2")
    return rows, components(first.unionByName(second), f"{base}/round-2").withColumnRenamed("u", "node")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near copies: the least doc_id, then the least hash of its text."""
    rows, roots = groups(docs, shared_dir(docs.sparkSession))
    placed = rows.join(roots, "node", "left").select("doc", "tag", F.coalesce("root", "node").alias("component"))
    return simhash.representatives(docs, placed)
