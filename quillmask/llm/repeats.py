"""What the two engines for repeated text share: sampled suffixes, compressed texts, and judging documents by flags.

A suffix is sampled at the anchor of a window (see ``windows``): equal windows have equal anchors at equal places, so
windows that recur meet at a sampled suffix. A row of ``runs`` is such a suffix with the run of windows that it is the
anchor of: node (the suffix's first symbols), leaf (all symbols that the run covers; node and leaf are 128 bits), and
where it stands. About one row for 20 words, or for 70 bytes.

Rows of the input are told apart by doc and tag, a 64-bit hash of the text. Rows that share both are the same text, so
they have the same flags.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.common import tagged, text_chunks
from quillmask.llm.windows import Sequences

#: Symbols of a segment: longer texts are read in segments that overlap by all but one symbol of a window.
SEGMENT = 1 << 20
RUN = "node long, leaf long, doc long, tag long, at long"


@dataclass(frozen=True)
class Shape:
    """unit 'word' or 'byte'; window width and gram in symbols."""

    unit: str
    width: int
    gram: int


def segments(text: bytes, shape: Shape) -> Iterator[tuple[int, bytes]]:
    """(symbols before it, piece) of a text."""
    if len(text) <= SEGMENT:
        yield 0, text
    elif shape.unit == "byte":
        for lo in range(0, max(1, len(text) - shape.width + 1), SEGMENT):
            yield lo, text[lo : lo + SEGMENT + shape.width - 1]
    else:
        words, step = text.split(), SEGMENT // 8
        for lo in range(0, max(1, len(words) - shape.width + 1), step):
            yield lo, b" ".join(words[lo : lo + step + shape.width - 1])


def sequences(texts: list[bytes], shape: Shape) -> Sequences:
    return Sequences.of_words(texts) if shape.unit == "word" else Sequences.of_bytes(texts)


#: One long holds a run: 47 bits of its first window, 8 of the number of windows less one, 8 of the anchor's place.
def packed(start, count, ahead):
    return (np.asarray(start, dtype=np.int64) << 16) | ((np.asarray(count, dtype=np.int64) - 1) << 8) | np.asarray(ahead, dtype=np.int64)


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 16, ((at >> 8) & 0xFF) + 1, at & 0xFF


def _run_rows(shape: Shape) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_chunks(batches):
            pieces = [(i, base, piece) for i, text in enumerate(texts) for base, piece in segments(text, shape)]
            text, start, count, ahead, node, leaf = sequences([p[2] for p in pieces], shape).anchors(shape.width, shape.gram)
            if not len(text):
                continue
            owner, base = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces], dtype=np.int64)
            doc, tag = np.array(keys, dtype=np.int64).T
            own = owner[text]
            yield pa.record_batch([pa.array(x) for x in (node.view(np.int64), leaf.view(np.int64), doc[own], tag[own], packed(start + base[text], count, ahead))], names=["node", "leaf", "doc", "tag", "at"])

    return rows


def runs(docs: DataFrame, shape: Shape) -> DataFrame:
    return tagged(docs).mapInArrow(_run_rows(shape), RUN)


def leaves(run_rows: DataFrame) -> DataFrame:
    """One row per leaf, collapsed map-side: occurrences, the least doc of its holders, and one of them (all have the same symbols there)."""
    return run_rows.groupBy("node", "leaf").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("head_doc"), *[F.first(c).alias(f"its_{c}") for c in ("doc", "tag", "at")])


#: The columns of a leaf's holder, as those of a run.
HOLDER = [f"its_{c} AS {c}" for c in ("doc", "tag", "at")]


def zipped(docs: DataFrame) -> DataFrame:
    """doc, tag and the text compressed, for joins."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for keys, texts in text_chunks(batches):
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([pack.compress(t) for t in texts], pa.binary())], names=["doc", "tag", "z"])

    return tagged(docs).mapInArrow(rows, "doc long, tag long, z binary")


def opened(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """doc, tag, spots, z of each text for which ``listed`` (doc, tag and other columns) has rows, those as structs."""
    cols = [c for c in listed.columns if c not in ("doc", "tag")]
    spots = listed.groupBy("doc", "tag").agg(F.collect_list(F.struct(*cols)).alias("spots"))
    return zipped(docs).join(spots, ["doc", "tag"]).select("doc", "tag", "spots", "z")


def spot_columns(spots: pa.ListScalar) -> dict[str, np.ndarray]:
    """The fields of the structs that ``opened`` lists for a text."""
    kind = spots.values.type
    return {kind.field(i).name: c.to_numpy(zero_copy_only=False) for i, c in enumerate(spots.values.flatten())}


def located(text: bytes, shape: Shape, start: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(symbols before it, segment, which of the runs to read in it); each run is in one segment."""
    left = np.ones(len(start), dtype=bool)
    for base, piece in segments(text, shape):
        if not left.any():
            return
        n = len(piece) if shape.unit == "byte" else len(piece.split()) if len(text) > SEGMENT else 1 << 62
        here = left & (start >= base) & (start + count - 1 + shape.width <= base + n)
        left &= ~here
        if here.any():
            yield base, piece, here


def block_rows(shape: Shape, size: int) -> Callable:
    """The listed runs (node, at) of each text in blocks of ``size`` windows, as runs: the node names what all windows of a block share."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, tag, spots, z in zip(*(batch.column(i) for i in range(4)), strict=True):
                spot = spot_columns(spots)
                node, (start, count, ahead) = spot["node"], unpacked(spot["at"])
                for base, piece, here in located(unpack.decompress(z.as_py()), shape, start, count):
                    seq = sequences([piece], shape)
                    run, lo, n, name, leaf = seq.blocks(start[here] - base, count[here], ahead[here], node[here], shape.width, size)
                    near = (start - base + ahead)[here][run] - lo
                    same = np.full(len(lo), 1, dtype=np.int64)
                    yield pa.record_batch([pa.array(x) for x in (name.view(np.int64), leaf.view(np.int64), same * doc.as_py(), same * tag.as_py(), packed(lo + base, n, near))], names=["node", "leaf", "doc", "tag", "at"])

    return rows


def covered(at: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n symbols a flagged window covers."""
    start, count, _ = unpacked(np.asarray(at, dtype=np.int64))
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, np.minimum(start, n), 1)
    np.add.at(edge, np.minimum(start + count - 1 + width, n), -1)
    return np.cumsum(edge[:n]) > 0


def judged(docs: DataFrame, flag_rows: DataFrame, judge: Callable[[bytes, np.ndarray], list], schema: str, arrow: pa.Schema) -> DataFrame:
    """Each document with its flags (doc, tag, at) given to ``judge(text, at)``, whose values follow doc."""
    held = flag_rows.groupBy("doc", "tag").agg(F.collect_set("at").alias("ats"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc, at, z in zip(*(batch.column(i) for i in range(3)), strict=True):
                at = at.values.to_numpy() if at.is_valid else np.zeros(0, dtype=np.int64)
                out.append([doc.as_py(), *judge(unpack.decompress(z.as_py()), at)])
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)] if out else [pa.array([], f.type) for f in arrow], schema=arrow)

    return zipped(docs).join(held, ["doc", "tag"], "left").select("doc", "ats", "z").mapInArrow(rows, schema)
