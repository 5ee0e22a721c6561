"""Mixing sources to target weights: repetition rates per source, then floor(rate) copies plus one with the
probability of the fraction, drawn from a hash of the seed and doc_id. DataFrame functions only.

Sizes are words. Sources are weighed in code point order (null is a source, last) by a repeating list of weights
and share a multiple of all words; a target stops at a multiple of its source's words, and what is over is shared
again by weight. With caps c and weights w the fill level is the largest of (total - caps before) / (weights from
here on) along rising c / w, so one pass over the sources finds it. Ranks and sums along an order are taken range by
range, with offsets from the ranges' sums, so sources may be as many as hosts.

Words are counted before anything meets: rates are broadcast to the documents where their written table is at most
``BROADCAST`` bytes, else they are joined, and adaptive execution splits a source that holds much of the rows.

An empty table gives an empty one. Null texts have size 0. A source without words has target 0. Repeated rows draw
alike. A null doc_id draws as ''. Other columns are carried along by ``mixed``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmask.llm.common import WORD, byte_size, shared_dir, written

WEIGHTS, BROADCAST = (3, 1, 2), 8 << 20


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _along(rows: DataFrame, order: list, base: str, name: str, **sums) -> DataFrame:
    """``rows`` with the sums (name=column) of all rows before each one in ``order``, from ranges that are read in parallel."""
    ranged = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), base, name)
    totals = ranged.groupBy("range").agg(*[F.sum(c).alias(f"{k}_all") for k, c in sums.items()])
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    totals = totals.select("range", *[F.coalesce(F.sum(f"{k}_all").over(before), F.lit(0)).alias(f"{k}_all") for k in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(totals), "range")
    return placed.select(*rows.columns, *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{k}_all")).alias(k) for k, c in sums.items()])


def source_rates(sizes: DataFrame, base: str, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target, rate: one row per source, as a written table. ``sizes``: source, size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = _along(per, [F.col("source").asc_nulls_last()], base, "by-name", place=F.lit(1))
    ranked = ranked.select("source", "source_size", F.get(cycle, F.pmod(F.col("place").cast("int"), F.lit(len(weights)))).alias("weight"), (F.col("source_size") * F.lit(cap)).alias("cap"))
    ranked = ranked.withColumn("steep", F.col("cap") / F.col("weight"))
    rising = _along(ranked, [F.col("steep"), F.col("source").asc_nulls_last()], base, "by-steepness", caps=F.col("cap"), lighter=F.col("weight"))
    whole = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    level = (F.col("words") * F.lit(share) - F.col("caps")) / (F.col("weights") - F.col("lighter"))
    fill = rising.crossJoin(F.broadcast(whole)).agg(F.max(level).alias("fill"))  # one row each
    target = F.least(F.col("cap"), F.col("fill") * F.col("weight"))
    rates = ranked.crossJoin(F.broadcast(fill)).select("source", "source_size", target.alias("target"))
    return written(rates.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), base, "rates")


def draw(doc_id, seed: int):
    """Uniform in [0, 1): the first 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"mix:{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, seed: int = 7, carry: tuple[str, ...] | None = None, **how) -> DataFrame:
    """row (a struct of the columns ``carry``, c0 and so on; all by default), size, source_size, target, copies."""
    base = shared_dir(docs.sparkSession)
    carry = tuple(docs.columns) if carry is None else carry
    size = n_words(docs["text"])
    if "text" in carry:  # texts are read again rather than written: only sources and sizes are
        sizes = written(docs.select(docs["source"].alias("source"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("size")), base, "sizes")
    row = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)])
    thin = docs.select(row.alias("row"), docs["doc_id"].alias("id"), docs["source"].alias("from"), size.alias("size"))
    if "text" not in carry:
        thin = written(thin, base, "sizes")
        sizes = thin.select(F.col("from").alias("source"), "size")
    rates = source_rates(sizes, base, **how)
    few = byte_size(docs.sparkSession, f"{base}/rates") <= BROADCAST
    joined = thin.join(F.broadcast(rates) if few else rates, thin["from"].eqNullSafe(rates["source"]))
    whole = F.floor("rate")
    copies = (whole + (draw(F.col("id"), seed) < F.col("rate") - whole).cast("long")).cast("long")
    return joined.select("row", thin["size"], "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """The mix itself: each document as often as it is drawn, with the columns of ``docs``."""
    rows = with_copies(docs, seed, **how).where("copies > 0")
    rows = rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def mix_report(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    rows = with_copies(docs, seed, ("doc_id",), **how)
    return rows.select(F.col("row.c0").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM r WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, (max(level) OVER ()) * weight) AS target FROM l),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
      ('0x' || substr(md5('mix:7:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken FROM x
"""
