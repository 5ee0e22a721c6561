"""The pipeline's line stage: templates in leaves of any size, short repeats, and content that only looks alike."""

import random

import pytest

import corpus_pipeline


def stage(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, df, "").collect()}


@pytest.mark.parametrize("n", [30, 1000])
def test_variable_fields_in_large_leaves(spark, n):
    r = random.Random(n)
    name = lambda k: "".join(chr(97 + int(c)) for c in f"{r.randrange(100):02d}") + k
    got = stage(spark, [f"Posted by user {name('n')} in the topic {name('t')} today" for _ in range(n)])
    assert sum(not t for t in got.values()) == n - 1


def test_short_lines_go_by_exact_repeats(spark):
    got = stage(spark, ["All rights reserved.\nfirst own"] + [f"All  rights reserved.\n\nown {w}\nsize {i}" for i, w in enumerate(["a", "b", "c"])])
    assert [got[i] for i in range(4)] == ["All rights reserved.\nfirst own", "\nown a\nsize 0", "\nown b\nsize 1", "\nown c\nsize 2"]


def test_distinct_content_stays(spark):
    texts = ["1990 12.5 33.1 40 51", "2001 7 8 9 10", "3 4 5 6 7", "I want to buy bread", "I want to go home", "I want to see Paris"]
    assert stage(spark, texts) == dict(enumerate(texts))
    same = ["1 2 3 4 5"] * 3 + ["Page 1 of the long book", "Page 2 of the long book", "Page 3 of the long book"]
    assert sorted(i for i, t in stage(spark, same).items() if t) == [0, 3]
