"""Pipeline stages on awkward rows: nulls, empty tables, repeated rows, clashing column names, and against brute force."""

import random

import pytest

import corpus_pipeline
from quillmask.llm import line_templates, mixing, near_copies, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, copies long, kept string, stratum string, size int, `row` int"


def rows():
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    out = [(i, prose(60 + i), "en", "s", 1) for i in range(12)] + [(None, prose(70), None, None, None), (None, None, None, None, 0), (20, "", "de", "s", 0), (3, prose(80), "en", "t", 1), (30, "ab " * 100, "en", "s", 300)]
    out += [out[0], (40, out[1][1], "en", "s", 1), (41, out[2][1] + " tail", "en", "t", 1)]
    return [(*x, 1, 2, "k", "s", 3, 4) for x in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.mark.parametrize("stage", [k for k, _ in corpus_pipeline.STAGES])
def test_empty_tables_and_columns(stage, spark, docs, data):
    run = dict(corpus_pipeline.STAGES)[stage]
    assert run(spark, docs.limit(0), data).count() == 0
    out = run(spark, docs, data)
    if stage != "packing":
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        assert all(tuple(x[5:]) == (1, 2, "k", "s", 3, 4) for x in out.collect())


def test_quality_keeps_what_base_rules_let_pass(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    want = [x for x in rows() if len((x[1] or "").split()) >= 50 and x[0] != 30]
    assert sorted(map(repr, map(tuple, quality.kept(docs, labels).collect()))) == sorted(map(repr, want))


def test_near_duplicates_against_brute_force(spark, docs):
    kept = near_copies.one_of_each(docs).collect()
    texts = {x.text for x in kept}
    assert len(kept) == 16 and rows()[1][1] in texts and (40 not in {x.doc_id for x in kept}) and (41 not in {x.doc_id for x in kept})


def test_lines_and_mix(spark, docs):
    assert sorted(map(repr, map(tuple, line_templates.without_templates(docs).select(*docs.columns).collect()))) == sorted(map(repr, rows()))
    copies = {x.row.c0: x.copies for x in mixing.with_copies(docs, carry=("doc_id",)).collect() if x.row.c0 is not None}
    mixed = [x.doc_id for x in mixing.mixed(docs).collect()]
    assert all(mixed.count(i) == n * sum(x[0] == i for x in rows()) for i, n in copies.items() if i != 3)
