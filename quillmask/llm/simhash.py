"""SimHash fingerprints and exact near-duplicate links through a vantage-point tree.

The tree splits fingerprint space by Hamming distance to vantage points. Its shape comes from a bounded sample
(``SAMPLE`` distinct fingerprints); every distinct fingerprint is then filed in one shard, and is also sent as a
query to each shard that the triangle inequality can't exclude: a point inside a ball of radius mu with distance d
can have a partner outside only if d + radius > mu. Only inside points query outwards, so no pair is asked twice.
In a shard, distances to a further vantage point give a band in which exact distances are computed. Links leave a
shard as a spanning star per group, not as pairs; global groups are connected components of the stars. A shard that
still holds more than ``FULL`` fingerprints gets a vantage point of its own and is split again, as often as it takes.

Equal fingerprints are one node, so thousands of copies cost one row. An empty table gives an empty one. A null text,
or one without words, has fingerprint zero and is linked like any other. A null doc_id sorts first. Repeated rows have
the same result each. Other columns are ignored by ``near_duplicates`` and carried along by ``one_of_each``.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.common import NULL_ID, keyed, real_id, shared_dir, tagged, text_chunks, written
from quillmask.llm.components import components

#: Distinct fingerprints that shape the first tree, those a shard should hold, and those beyond which it is split again.
SAMPLE, SHARD, FULL = 16384, 8192, 32768
_HASH = partial(xxhash.xxh64_intdigest, seed=42)
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority of the bits of all shingle hashes, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return _HASH(b" ".join(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    lo, hi = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(lo), _BLOCK):
        hashes = np.fromiter(map(_HASH, [joined[a:b] for a, b in zip(lo[at : at + _BLOCK], hi[at : at + _BLOCK], strict=True)]), dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(lo), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc, fp (the 64 bits as a long)."""

    def rows(batches):
        for keys, texts in text_chunks(batches):
            fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), pa.array(fps)], names=["doc", "fp"])

    return keyed(docs).mapInArrow(rows, "doc long, fp long")


class VantageTree:
    """Nodes (vantage, mu, inside, outside); a negative child -1 - s is shard s. Rebuilt alike from the same sample."""

    def __init__(self, sample: np.ndarray, n_shards: int):
        self.nodes: list[list[int]] = []
        self.shards = 0
        self.target = max(1, len(sample) // max(1, n_shards))
        self.root = self._build(np.unique(sample))

    def _build(self, points: np.ndarray) -> int:
        if len(points) > self.target:
            # the vantage whose distances spread most: fewest points lie near the border of its ball
            tried = points[np.linspace(0, len(points) - 1, min(8, len(points))).astype(int)]
            far = [np.bitwise_count(points ^ v).astype(np.int64) for v in tried]
            best = max(range(len(far)), key=lambda i: float(far[i].std()))
            d = far[best]
            mu = int(np.median(d))
            if not (d > mu).any():
                mu = int(d.max()) - 1
            if (d <= mu).any() and (d > mu).any():
                me = len(self.nodes)
                self.nodes.append([int(tried[best]), mu, 0, 0])
                self.nodes[me][2] = self._build(points[d <= mu])
                self.nodes[me][3] = self._build(points[d > mu])
                return me
        self.shards += 1
        return -self.shards

    def route(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into fps, shard, is query) of every copy."""
        out = []
        todo = [(self.root, np.arange(len(fps)), np.zeros(len(fps), dtype=bool))]
        while todo:
            node, at, query = todo.pop()
            if not len(at):
                continue
            if node < 0:
                out.append((at, np.full(len(at), -1 - node), query))
                continue
            vantage, mu, inside, outside = self.nodes[node]
            d = np.bitwise_count(fps[at] ^ np.uint64(vantage)).astype(np.int64)
            ins = np.where(query, d <= mu + radius, d <= mu)
            reach = d + radius > mu
            outs = np.where(query, reach, d > mu)
            crossing = ~query & (d <= mu) & reach
            todo.append((inside, at[ins], query[ins]))
            todo.append((outside, np.concatenate((at[outs], at[crossing])), np.concatenate((query[outs], np.ones(int(crossing.sum()), dtype=bool)))))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of a and b: labels become the least index of each group."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        low = np.minimum(la[apart], lb[apart])
        np.minimum.at(labels, la[apart], low)
        np.minimum.at(labels, lb[apart], low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def shard_stars(fps: np.ndarray, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least-index fingerprint of its group) over all links in a shard: home with home, query with home."""
    pivot = fps[~query][0] if (~query).any() else fps[0]
    d = np.bitwise_count(fps ^ pivot).astype(np.int64)
    order = np.lexsort((fps, d))
    fps, query, d = fps[order], query[order], d[order]
    home = np.flatnonzero(~query)
    home_d, home_fps = d[home], fps[home]
    labels = np.arange(len(fps))
    step = max(1, (1 << 20) // max(1, len(home)))
    for at in range(0, len(fps), step):
        end = min(at + step, len(fps))
        lo, hi = np.searchsorted(home_d, d[at] - radius, "left"), np.searchsorted(home_d, d[end - 1] + radius, "right")
        a, b = np.nonzero(np.bitwise_count(fps[at:end, None] ^ home_fps[None, lo:hi]) <= radius)
        a, b = a + at, home[b + lo]
        apart = labels[a] != labels[b]
        labels = _join(labels, a[apart], b[apart])
    linked = labels != np.arange(len(fps))
    return fps[linked], fps[labels[linked]]


def split_again(placed: DataFrame, base: str, radius: int) -> DataFrame:
    """``placed`` (shard, fp, query) with shards of more than ``FULL`` home fingerprints split at vantage points of their own."""
    turn = 0
    while True:
        homes = placed.where("not query")
        full = homes.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min_by("fp", F.xxhash64("fp")).alias("vantage")).where(F.col("n") > FULL)
        full = written(full.select("shard", "vantage"), base, f"full-{turn}")
        if full.isEmpty():
            return placed
        away = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))).cast("long")
        # no median beyond the second largest distance, so that both sides have points
        middle = homes.join(full, "shard").groupBy("shard", "vantage").agg(F.percentile_approx(away, 0.5).alias("mid"), F.max(away).alias("far"))
        middle = written(middle.select("shard", "vantage", F.least("mid", F.col("far") - 1).alias("mu")), base, f"middle-{turn}")
        met = placed.join(middle, "shard", "left").withColumn("d", away)
        near, reach = F.col("d") <= F.col("mu"), F.col("d") + radius > F.col("mu")
        sides = F.when(F.col("mu").isNull(), F.array(F.struct(F.col("shard").alias("shard"), F.col("query").alias("query")))).otherwise(
            F.filter(
                F.array(
                    F.struct(F.when(F.when(F.col("query"), F.col("d") <= F.col("mu") + radius).otherwise(near), F.xxhash64("shard", F.lit("in"))).alias("shard"), F.col("query").alias("query")),
                    F.struct(F.when(F.when(F.col("query"), reach).otherwise(~near | reach), F.xxhash64("shard", F.lit("out"))).alias("shard"), (F.col("query") | near).alias("query")),
                ),
                lambda x: x["shard"].isNotNull(),
            )
        )
        placed = written(met.select("fp", F.explode(sides).alias("to")).select("to.shard", "fp", "to.query"), base, f"placed-{turn + 1}")
        turn += 1


def groups(fps: DataFrame, base: str, radius: int = 2) -> DataFrame:
    """fp, root (a fingerprint that names the group), component (its least doc). ``fps``: doc, fp; read more than once."""
    spark = fps.sparkSession
    nodes = written(fps.groupBy("fp").agg(F.min("doc").alias("rep")), base, "nodes")
    n = nodes.count()
    sample = [r[0] for r in nodes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()]
    tree = VantageTree(np.array(sample, dtype=np.int64).view(np.uint64), min(max(1, len(sample) // 16), math.ceil(n / SHARD)))
    shared = spark.sparkContext.broadcast(tree)  # at most SAMPLE nodes, whatever the input

    def route(batches):
        for batch in batches:
            mine = batch.column(0).to_numpy().view(np.uint64)
            at, shard, query = shared.value.route(mine, radius)
            yield pa.record_batch([pa.array(shard, pa.int64()), pa.array(mine[at].view(np.int64)), pa.array(query)], names=["shard", "fp", "query"])

    def stars(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = shard_stars(pdf["fp"].to_numpy().view(np.uint64), pdf["query"].to_numpy(dtype=bool), radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    placed = written(nodes.select("fp").mapInArrow(route, "shard long, fp long, query boolean"), base, "placed-0")
    links = split_again(placed, base, radius).groupBy("shard").applyInPandas(stars, "u long, v long")
    roots = components(links, base).withColumnRenamed("u", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    return rooted.join(least, "root").select("fp", "root", "component")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex), component_id."""
    base = shared_dir(docs.sparkSession)
    fps = written(fingerprints(docs, shingle), base, "fingerprints")
    out = fps.join(groups(fps, base, radius), "fp")
    return out.select(real_id().alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), real_id("component").alias("component_id"))


def representatives(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """One row of ``docs`` per component of ``placed`` (doc, tag, component): ties go by doc, tag, then a hash of the row."""
    kept = placed.groupBy("component").agg(F.min(F.struct("doc", "tag")).alias("kept")).select(F.col("kept.doc").alias("kept_doc"), F.col("kept.tag").alias("kept_tag"))
    cols = [docs[c] for c in docs.columns]
    row = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("kept_doc"), F.xxhash64(docs["text"]).alias("kept_tag"), F.struct(*cols).alias("row"), F.xxhash64(*cols).alias("tie"))
    one = row.join(kept, ["kept_doc", "kept_tag"], "left_semi").groupBy("kept_doc", "kept_tag").agg(F.min_by("row", "tie").alias("row"))
    return one.select("row.*")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of ``docs`` for each group: the least doc_id, then the least hash of its text."""
    base = shared_dir(docs.sparkSession)

    def rows(batches):
        for keys, texts in text_chunks(batches):
            fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(fps)], names=["doc", "tag", "fp"])

    fps = written(tagged(docs).mapInArrow(rows, "doc long, tag long, fp long"), base, "fingerprints")
    placed = fps.join(groups(fps.select("doc", "fp"), base, radius).select("fp", "root"), "fp")
    return representatives(docs, placed.select("doc", "tag", F.col("root").alias("component")))
