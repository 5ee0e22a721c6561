"""Line dedup with a log-template tree of fixed depth.

A line's tokens that hold digits are variable (``<*>``). Level one of the tree is the token count, the next ``DEPTH``
levels are leading tokens: that path is a leaf. In a leaf a (position, token) that ``MIN_DOCS`` documents share may be
constant. As a leaf grows the values of a variable field come to be that frequent too, so a line has several possible
templates: its most shared tokens alone, then each with the next most shared added, the rest generalised. A template
must fix ``CONSTANT`` of the positions, half of them by words, and half of those beyond the leading tokens, so that
numbers and a common beginning alone are no evidence. The most general template that at least ``MIN_DOCS`` documents
hold is the line's, and the line is dropped from all documents but the template's first. A line without such a template,
and each of fewer than ``MIN_TOKENS`` tokens, is dropped in the same way if it recurs as it stands.

Lines first collapse to one row per distinct masked line with its count, first and last document, map-side, so a line
in a third of all documents is one row. The documents of a template number ``MIN_DOCS`` (2 or 3) or more if one of its
lines has that many, or if its lines' first and last documents are that many.

A document is a row; the order is by doc_id (null first), then a hash of the text. Rows alike in both count one by one
and are cut alike. An empty table gives an empty one. A null text stays null and has no lines. A template that recurs
inside one document alone is kept. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.common import NULL_ID, dropped, shared_dir, tagged, text_chunks, written
from quillmask.llm.repeats import opened

DEPTH, MIN_TOKENS, MIN_DOCS, CONSTANT = 3, 5, 3, 0.6
_DIGIT = re.compile(rb"\d")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masked(line: bytes) -> list[bytes]:
    tokens = line.split()
    return [b"<*>" if _DIGIT.search(t) else t for t in tokens] if _DIGIT.search(line) else tokens


def path_of(tokens: list[bytes], depth: int) -> int:
    return _signed(xxhash.xxh64_intdigest(b"%d " % len(tokens) + b" ".join(tokens[:depth])))


def lines(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc, tag, line, kind, leaf, content, fresh (1 for the first such content in its text), for all lines with tokens.

    kind 0 are masked lines that may have templates, kind 1 lines as they stand: short ones, and once more those with
    digits. leaf and content are 128 bits."""
    names = ["doc", "tag", "line", "kind", "leaf", "content", "fresh"]

    def rows(batches):
        digest = xxhash.xxh64_intdigest
        for keys, texts in text_chunks(batches):
            out = []
            for (doc, tag), text in zip(keys, texts, strict=True):
                seen = set()
                for i, line in enumerate(text.split(b"\n")):
                    plain = line.split()
                    if not plain:
                        continue
                    tokens, found = masked(line), []
                    if len(plain) >= min_tokens:
                        found.append((0, path_of(tokens, depth), _signed(digest(b" ".join(tokens), seed=1))))
                    if len(plain) < min_tokens or tokens != plain:
                        whole = b" ".join(plain)
                        found.append((1, _signed(digest(whole, seed=2)), _signed(digest(whole, seed=3))))
                    for name in found:
                        out.append((doc, tag, i, *name, int(name not in seen)))
                        seen.add(name)
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return tagged(docs).mapInArrow(rows, ", ".join(f"{n} long" for n in names))


def _token_rows(listed: DataFrame, docs: DataFrame) -> DataFrame:
    """leaf, content, tokens (hashes, 0 for a variable one) of listed lines (doc, tag, line, leaf, content)."""

    def rows(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for spots, z in zip(batch.column(2), batch.column(3), strict=True):
                spots, text = spots.as_py(), unpack.decompress(z.as_py()).split(b"\n")
                tokens = [[0 if t == b"<*>" else _signed(xxhash.xxh64_intdigest(t) | 1) for t in masked(text[s["line"]])] for s in spots]
                yield pa.record_batch([pa.array([s["leaf"] for s in spots]), pa.array([s["content"] for s in spots]), pa.array(tokens, pa.list_(pa.int64()))], names=["leaf", "content", "tokens"])

    return opened(docs, listed).mapInArrow(rows, "leaf long, content long, tokens array<long>").dropDuplicates(["leaf", "content"])


def _candidates(spots: DataFrame, depth: int, constant: float) -> DataFrame:
    """leaf, content, template, fixed: the templates that a line may have, from its most shared tokens alone to all its constants.

    ``spots``: leaf, content, tokens, spots (support, pos) of the constants beyond the leading tokens, which all lines of a leaf share."""

    def rows(batches):
        for batch in batches:
            out = []
            for leaf, content, tokens, spots in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                n, body, beyond = len(tokens), 0, 0
                lead = min(depth, n)
                words = sum(t != 0 for t in tokens[:lead])
                spots = sorted(((s["support"], s["pos"]) for s in spots or () if s["support"] is not None), reverse=True)
                for k, (support, pos) in enumerate(spots, 1):
                    body ^= xxhash.xxh64_intdigest(b"%d %d" % (pos, tokens[pos]))
                    beyond += tokens[pos] != 0
                    last = k == len(spots) or spots[k][0] != support
                    if last and k + lead >= constant * n and 2 * (words + beyond) >= n and 2 * beyond >= max(1, n - depth):
                        out.append((leaf, content, _signed(body), k + lead))
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["leaf", "content", "template", "fixed"])

    return spots.mapInArrow(rows, "leaf long, content long, template long, fixed long")


def dropped_lines(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """doc, tag, line of every line to drop."""
    if min_docs not in (2, 3):
        raise ValueError("min_docs is 2 or 3")
    spark, base = docs.sparkSession, shared_dir(docs.sparkSession)
    all_lines = written(lines(docs, depth, min_tokens), base, "lines")
    row = F.struct("doc", "tag")
    distinct = all_lines.groupBy("kind", "leaf", "content").agg(F.sum("fresh").alias("n_docs"), F.min(F.struct("doc", "tag", "line")).alias("head"), F.max(row).alias("last"))
    distinct = written(distinct, base, "distinct")
    first = F.struct("head.doc", "head.tag")
    leaves = distinct.where("kind = 0").groupBy("leaf").agg(F.sum("n_docs").alias("leaf_docs")).where(F.col("leaf_docs") >= min_docs).select("leaf")
    masked_lines = written(distinct.where("kind = 0").join(leaves, "leaf").select("leaf", "content", "n_docs", "head", "last"), base, "masked")
    listed = masked_lines.select("head.doc", "head.tag", "head.line", "leaf", "content")
    tokens = written(_token_rows(listed, docs).join(masked_lines.select("leaf", "content", "n_docs"), ["leaf", "content"]), base, "tokens")
    spots = tokens.select("leaf", "content", "n_docs", F.posexplode("tokens").alias("pos", "token")).where(F.col("pos") >= depth)
    constants = spots.groupBy("leaf", "pos", "token").agg(F.sum("n_docs").alias("support")).where(F.col("support") >= min_docs)
    constants = written(constants, base, "constants")
    shared = spots.join(constants, ["leaf", "pos", "token"]).groupBy("leaf", "content").agg(F.collect_list(F.struct("support", "pos")).alias("spots"))
    candidates = written(_candidates(tokens.join(shared, ["leaf", "content"]).select("leaf", "content", "tokens", "spots"), depth, constant), base, "candidates")
    ends = candidates.join(masked_lines, ["leaf", "content"]).select("leaf", "template", "n_docs", F.explode(F.array(first, "last")).alias("end"))
    ends = ends.groupBy("leaf", "template", "end").agg(F.max("n_docs").alias("n_docs"))
    recurring = ends.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("n_ends"), F.max("n_docs").alias("n_docs"), F.min("end").alias("first"))
    recurring = written(recurring.where((F.col("n_docs") >= min_docs) | (F.col("n_ends") >= min_docs)).select("leaf", "template", "first"), base, "recurring")
    best = candidates.join(recurring, ["leaf", "template"]).groupBy("leaf", "content").agg(F.min_by("first", "fixed").alias("first")).select(F.lit(0).cast("long").alias("kind"), "leaf", "content", "first")
    exact = distinct.where("kind = 1").where(F.col("n_docs") >= min_docs).select("kind", "leaf", "content", first.alias("first"))
    gone = written(best.unionByName(exact), base, "gone")
    for name in ("masked", "tokens", "constants", "candidates", "recurring", "distinct"):
        dropped(spark, f"{base}/{name}")
    met = all_lines.join(gone, ["kind", "leaf", "content"]).select("doc", "tag", "line", "kind", (row > F.col("first")).alias("late"))
    # a masked line's template goes before the line as it stands
    return met.groupBy("doc", "tag", "line").agg(F.min_by("late", "kind").alias("late")).where("late").select("doc", "tag", "line")


def without_templates(docs: DataFrame, **how) -> DataFrame:
    """The columns of ``docs`` with recurring lines gone from text (n_chars, if there, follows), and t_lines, t_dropped, t_sha256."""
    gone = dropped_lines(docs, **how).groupBy("doc", "tag").agg(F.collect_list("line").alias("gone"))
    rest = [c for c in docs.columns if c != "text"]
    full = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(docs["text"]).alias("tag"), docs["text"].isNull().alias("missing"), F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(rest)]).alias("rest"), docs["text"].alias("text"))

    def pack(batches):
        engine = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column(4).cast(pa.large_binary())
            z = pa.array([engine.compress(t.as_py() or b"") for t in texts], pa.binary())
            yield pa.record_batch([*(batch.column(i) for i in range(4)), z], names=["doc", "tag", "missing", "rest", "z"])

    kinds = full.schema["rest"].dataType.simpleString()
    held = full.mapInArrow(pack, f"doc long, tag long, missing boolean, rest {kinds}, z binary").join(gone, ["doc", "tag"], "left").select("missing", "rest", "gone", "z")

    def rows(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            texts, n_lines, n_gone, shas = [], [], [], []
            for missing, gone_here, z in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                text, drop = unpack.decompress(z.as_py()), set(gone_here.as_py() or ())
                parts = text.split(b"\n")
                kept = b"\n".join([p for i, p in enumerate(parts) if i not in drop]) if drop else text
                texts.append(None if missing.as_py() else kept.decode())
                n_lines.append(0 if missing.as_py() else len(parts))
                n_gone.append(len(drop))
                shas.append(hashlib.sha256(kept).hexdigest())
            yield pa.record_batch([batch.column(1), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(shas, pa.string())], names=["rest", "text", "t_lines", "t_dropped", "t_sha256"])

    out = held.mapInArrow(rows, f"rest {kinds}, text string, t_lines long, t_dropped long, t_sha256 string")
    where = {c: F.col(f"rest.c{i}").alias(c) for i, c in enumerate(rest)} | {"text": F.col("text")}
    if "n_chars" in where:
        where["n_chars"] = F.when(F.col("t_dropped") > 0, F.length("text")).otherwise(F.col(f"rest.c{rest.index('n_chars')}")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[where[c] for c in docs.columns], "t_lines", "t_dropped", "t_sha256")


def template_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    thin = docs.select(docs["doc_id"], docs["text"])
    return without_templates(thin, **how).select("doc_id", F.col("t_lines").alias("n_lines"), F.col("t_dropped").alias("n_dropped"), F.col("t_sha256").alias("kept_sha256"))


SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, (coalesce(doc_id, -9223372036854775808), md5(coalesce(text, ''))) AS k, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS parts FROM documents),
cut AS MATERIALIZED (SELECT rid, k, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS line FROM d),
lines AS MATERIALIZED (SELECT *, array_to_string(plain, ' ') AS raw, array_to_string(tokens, ' ') AS content, len(plain) || ' ' || array_to_string(tokens[1:{DEPTH}], ' ') AS leaf
  FROM (SELECT *, list_transform(plain, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens FROM (SELECT rid, k, i, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS plain FROM cut)) WHERE len(plain) > 0),
contents AS MATERIALIZED (SELECT leaf, content, any_value(tokens) AS tokens, count(DISTINCT rid) AS n_docs FROM lines WHERE len(tokens) >= {MIN_TOKENS} GROUP BY leaf, content),
leaves AS (SELECT leaf FROM contents GROUP BY leaf HAVING sum(n_docs) >= {MIN_DOCS}),
spots AS MATERIALIZED (SELECT leaf, content, n_docs, len(tokens) AS n, unnest(range(1, len(tokens) + 1)) AS pos, unnest(tokens) AS token FROM contents JOIN leaves USING (leaf)),
constants AS (SELECT leaf, pos, token, sum(n_docs) AS support FROM spots GROUP BY ALL HAVING sum(n_docs) >= {MIN_DOCS}),
shared AS MATERIALIZED (SELECT leaf, content, n, pos, token, support FROM spots JOIN constants USING (leaf, pos, token)),
candidates AS MATERIALIZED (SELECT s.leaf, s.content, t.support AS least, count(*) AS fixed, string_agg(pos || ' ' || token, chr(10) ORDER BY pos) AS template
  FROM shared s JOIN (SELECT DISTINCT leaf, content, support FROM shared) t ON s.leaf = t.leaf AND s.content = t.content AND s.support >= t.support GROUP BY ALL
  HAVING count(*) >= {CONSTANT}::DOUBLE * any_value(n) AND 2 * count(*) FILTER (token <> '<*>') >= any_value(n) AND 2 * count(*) FILTER (token <> '<*>' AND pos > {DEPTH}) >= greatest(1, any_value(n) - {DEPTH})),
templates AS (SELECT leaf, template, min(k) AS first FROM lines JOIN candidates USING (leaf, content) WHERE len(tokens) >= {MIN_TOKENS} GROUP BY leaf, template HAVING count(DISTINCT rid) >= {MIN_DOCS}),
best AS (SELECT leaf, content, arg_min(first, fixed) AS first FROM candidates JOIN templates USING (leaf, template) GROUP BY leaf, content),
raws AS (SELECT raw, min(k) AS first FROM lines GROUP BY raw HAVING count(DISTINCT rid) >= {MIN_DOCS}),
gone AS (SELECT rid, i, 1 AS hit FROM lines LEFT JOIN best ON len(tokens) >= {MIN_TOKENS} AND lines.leaf = best.leaf AND lines.content = best.content LEFT JOIN raws ON lines.raw = raws.raw WHERE k > coalesce(best.first, raws.first)),
kept AS (SELECT rid, count(hit) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (hit IS NULL) AS kept_text FROM cut LEFT JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(parts)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(kept_text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""
