"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Base statistics come from each whole text. For each stratum (language) and each rule (a ratio of the statistics)
a grid of cutoffs, fixed beforehand, is tried on the labelled documents, which are all held out: nothing is fitted on
them. Of n good ones a cutoff rejects k. It is admissible if P(Binomial(n, risk) <= k) <= confidence / tests, the exact
one-sided test that its false rejection rate is below ``risk``. Cutoffs are tested from the loosest to the strictest
until one fails (a looser one rejects no more, so an admissible one has no failure before it); such a fixed sequence
needs no correction within itself, so tests are the strata times the rules (Bonferroni). The strictest admissible
cutoff rejects; a rule without one rejects nothing in that stratum.

An empty table gives an empty one; without usable labels only the base rules reject. Null texts have no words. A null
language is a stratum of its own. Labels that are null, or whose document is missing, don't count; a document labelled
twice counts twice. Repeated rows are judged alike. Other columns are carried along by ``kept``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.llm.common import WORD, byte_size, shared_dir, written

RISK, CONFIDENCE, GRID, BROADCAST = 0.02, 0.05, 20, 8 << 20
RULES = ("symbols", "dup_lines", "repeats")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more in the text."""

    def of_hashes(h: Column) -> Column:
        def of_sorted(t: Column) -> Column:
            last = F.size(t) - 1
            again = F.filter(t, lambda x, i: ((i > 0) & (F.get(t, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(t, i + 1)["h"] == x["h"])))
            return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(n < 3, F.lit(0)).otherwise(let(hashes, of_hashes))

    return let(words, of_words)


def statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """row (a struct of the columns ``carry``: c0 and so on), id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, stratum."""
    text = F.coalesce(docs["text"], F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    word_counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("again")))
    row = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)]) if carry else F.lit(None).cast("string")
    out = docs.select(
        row.alias("row"), docs["doc_id"].alias("id"), word_counts.alias("words"), F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"), line_counts.alias("lines"), F.coalesce(F.concat(F.lit("="), docs["lang"]), F.lit("")).alias("stratum"),
    )
    return out.select("row", "id", F.col("words.n").alias("n_words"), "word_chars", "n_symbols", F.col("lines.n").alias("n_lines"), F.col("lines.dup").alias("n_dup_lines"), F.col("words.again").alias("n_repeat_words"), "stratum")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"symbols": per("n_symbols", "word_chars"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words")}


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE, grid: int = GRID) -> DataFrame:
    """stratum and a cutoff (null: none) for each rule. ``stats``: what ``statistics`` gives for at least the labelled documents."""
    l = labels.select(labels["doc_id"].alias("l_id"), labels["quality"].alias("l_quality")).where("l_quality = 1")
    good = stats.where(~base_failed()).join(l, stats["id"] == F.col("l_id")).select("stratum", *[v.alias(k) for k, v in rule_values().items()])
    points = F.array(*[F.lit((g + 1) / grid) for g in range(grid)])
    values = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("value")) for k in RULES])
    counted = good.select("stratum", F.explode(values).alias("v")).select("stratum", "v.rule", F.explode(F.transform(points, lambda p: F.struct(p.alias("cutoff"), (F.col("v.value") > p).cast("long").alias("rejected")))).alias("p"))
    counted = counted.groupBy("stratum", "rule", F.col("p.cutoff").alias("cutoff")).agg(F.count(F.lit(1)).alias("n"), F.sum("p.rejected").alias("k"))
    sizes = counted.groupBy("stratum").agg(F.max("n").alias("n")).withColumn("tests", F.count(F.lit(1)).over(Window.partitionBy()) * F.lit(len(RULES)))
    # cumulative binomial probabilities in logarithms, up to the mean: no admissible count lies beyond it
    terms = sizes.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") * F.lit(risk)))))
    so_far = Window.partitionBy("stratum").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("j") > 0, F.ln((F.col("n") - F.col("j") + 1) / F.col("j"))).otherwise(F.lit(0.0))
    log_term = F.sum(step).over(so_far) + F.col("j") * F.ln(F.lit(risk)) + (F.col("n") - F.col("j")) * F.ln(F.lit(1 - risk))
    terms = terms.withColumn("term", F.exp(log_term)).withColumn("tail", F.sum("term").over(so_far))
    most = terms.where(F.col("tail") <= F.lit(confidence) / F.col("tests")).groupBy("stratum").agg(F.max("j").alias("most"))
    admitted = counted.join(most, "stratum").where("k <= most")
    return admitted.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def verdicts(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = (), **how) -> DataFrame:
    """``statistics`` with base_failed and kept. Each text is measured once: what was measured, and carried, is a written table."""
    spark, base = docs.sparkSession, shared_dir(docs.sparkSession)
    stats = written(statistics(docs, *carry), base, "measured")
    cuts = written(cutoffs(stats.drop("row"), labels, **how).withColumnRenamed("stratum", "c_stratum"), base, "cutoffs")
    cuts = F.broadcast(cuts) if byte_size(spark, f"{base}/cutoffs") <= BROADCAST else cuts  # one row a stratum
    passes = ~base_failed()
    for k, v in rule_values().items():
        passes &= F.coalesce(v <= F.col(f"cut_{k}"), F.lit(True))
    joined = stats.join(cuts, F.col("stratum") == F.col("c_stratum"), "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", passes)


def kept(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    rows = verdicts(docs, labels, tuple(docs.columns), **how).where("kept")
    return rows.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality_report(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return verdicts(docs, labels, **how).select(F.col("id").alias("doc_id"), *names)


STATS_SQL = r"""
SELECT doc_id, coalesce('=' || lang, '') AS stratum, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(again, 0)::BIGINT AS n_repeat_words
FROM (SELECT row_number() OVER () AS rid, doc_id, lang, t, w, l FROM (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents)) d
LEFT JOIN (SELECT rid2, count(DISTINCT i + o) AS again FROM (SELECT rid2, i, count(*) OVER (PARTITION BY rid2, a, b, c) AS n FROM (SELECT rid2, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM
  (SELECT rid2, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT row_number() OVER () AS rid2, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)))), (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY rid2) r ON d.rid = r.rid2
"""

SQL = f"""
WITH stats AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbols,
  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_lines, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeats FROM ({STATS_SQL})),
good AS (SELECT stratum, symbols, dup_lines, repeats FROM stats JOIN labels USING (doc_id) WHERE quality = 1 AND NOT base_failed),
long AS (SELECT stratum, 'symbols' AS rule, symbols AS value FROM good UNION ALL SELECT stratum, 'dup_lines', dup_lines FROM good UNION ALL SELECT stratum, 'repeats', repeats FROM good),
counted AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (value > cutoff) AS k FROM long, (SELECT unnest(range(1, {GRID + 1})) / {GRID}::DOUBLE AS cutoff) GROUP BY ALL),
sizes AS (SELECT stratum, max(n) AS n, count(*) OVER () * {len(RULES)} AS tests FROM counted GROUP BY stratum),
terms AS (SELECT *, sum(CASE WHEN j > 0 THEN ln((n - j + 1) / j) ELSE 0 END) OVER (PARTITION BY stratum ORDER BY j ROWS UNBOUNDED PRECEDING) + j * ln({RISK}::DOUBLE) + (n - j) * ln(1 - {RISK}::DOUBLE) AS log_term
  FROM (SELECT *, unnest(range(0, floor(n * {RISK}::DOUBLE)::BIGINT + 1)) AS j FROM sizes)),
tails AS (SELECT *, sum(exp(log_term)) OVER (PARTITION BY stratum ORDER BY j ROWS UNBOUNDED PRECEDING) AS tail FROM terms),
most AS (SELECT stratum, max(j) AS most FROM tails WHERE tail <= {CONFIDENCE}::DOUBLE / tests GROUP BY stratum),
cuts AS (SELECT stratum, min(cutoff) FILTER (rule = 'symbols') AS c1, min(cutoff) FILTER (rule = 'dup_lines') AS c2, min(cutoff) FILTER (rule = 'repeats') AS c3 FROM counted JOIN most USING (stratum) WHERE k <= most GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbols <= c1, true) AND coalesce(dup_lines <= c2, true) AND coalesce(repeats <= c3, true) AS kept
FROM stats LEFT JOIN cuts USING (stratum)
"""
