"""The pipeline's near-duplicate stage against brute force over pairs."""

import itertools
import random

import pytest

import corpus_pipeline
from quillmask.llm import near_copies


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("chunk", [2 << 20, 3000])
def test_edited_copies_are_one_group(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(900)]
    texts = [" ".join(r.choice(words) for _ in range(160)) for _ in range(12)]
    for t in texts[:8]:
        for cuts in (1, 2, 3, 4, 6):
            w = t.split()
            for i in r.sample(range(len(w)), cuts):
                w[i] = r.choice(words)
            texts.append(" ".join(w))
    texts += [None, "", "x y", "X y", "y x"]
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {find(i) for i in range(len(texts))}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [row.doc_id for row in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()]
    assert len(want) < len(texts) - 20 and sorted(got) == sorted(want)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f g"), (None, "t u v w x y z"), (7, "t u v w x y z"), (8, "c d e f"), (8, "g h i j"), (8, "g h i j")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicate_stage(spark, df, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "a b c d e f g"), (0, "t u v w x y z"), (8, "c d e f"), (8, "g h i j")]
