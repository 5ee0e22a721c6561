"""Each operator against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from quillmask.llm import line_templates, mixing, ogg, packing, quality, queries, simhash, substring_dedup, suffix_index, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, tag string"


@pytest.fixture(scope="module")
def rows():
    """Invented documents: shared passages, copies, a repeated row, a null text, an empty one, a null id, periodic and long ones."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdéß") for _ in range(r.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = prose(70)
    out = [(i, f"{prose(r.randint(0, 120))}\n{passage if i % 3 == 0 else prose(30)}\t{prose(r.randint(0, 60))}") for i in range(24)]
    out += [(24, out[3][1]), (25, out[3][1]), (3, out[3][1]), (26, None), (27, ""), (28, " \n "), (None, prose(80)), (29, "ab " * 300), (30, "a" * 700), (31, "x y"), (32, f"{passage} tail {passage}"), (33, out[5][1] + " more"), (34, prose(9000))]
    return [(i, t, ["en", None, "de"][k % 3], ["s0", "s0", "s1", None][k % 4], len(t or ""), 1, "x") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return -(1 << 63) if i is None else i


def test_substring_dedup(docs, rows):
    width, first = 50, {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for s in range(len(w) - width + 1):
            g = tuple(w[s : s + width])
            first[g] = min(first.get(g, key(i)), key(i))
    want = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < key(i):
                gone[s : s + width] = b"\1" * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    assert sorted(map(repr, map(tuple, substring_dedup.remove_repeats(docs).collect()))) == sorted(map(repr, want))


def test_suffix_index(docs, rows):
    width, seen = 200, collections.Counter()
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    for _, b in texts:
        seen.update(b[s : s + width] for s in range(len(b) - width + 1))
    want = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if seen[b[s : s + width]] > 1:
                gone[s : s + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), len(b) - len(kept), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    assert sorted(map(repr, map(tuple, suffix_index.remove_repeats(docs).collect()))) == sorted(map(repr, want))


def test_suffix_index_matches_between_batches(spark, tmp_path):
    family = suffix_index.IndexFamily(spark, f"file://{tmp_path}")
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh") for _ in range(900))
    batch = lambda i: spark.createDataFrame([(i, text[: 600 + i])], "doc_id long, text string")
    assert family.append(batch(1)).count() == 0
    assert family.append(batch(2)).count() > 0
    assert [level[0] for level in family.levels] == [1]
    level = [r.node for r in family.levels[0][2].collect()]
    lead = lambda node: ((node >> 32) + (1 << 31)).to_bytes(4, "big").decode()
    assert len(level) > 5 and all(lead(node) in text for node in level)
    assert sorted(level) == sorted(level, key=lambda n: (lead(n), n))


def test_no_flag_without_merge_scans(docs, monkeypatch):
    monkeypatch.setattr(suffix_index.IndexFamily, "_scan", lambda self, new, turn: new.limit(0))
    assert all(r.n_removed == 0 for r in suffix_index.remove_repeats(docs).collect())


@pytest.mark.parametrize("group", [2, 8])
def test_longer_prefixes_for_large_groups(docs, monkeypatch, group):
    want = sorted(map(repr, substring_dedup.remove_repeats(docs).collect()))
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "BATCH", 200)
    assert sorted(map(repr, substring_dedup.remove_repeats(docs).collect())) == want


def test_subtree_against_all_windows():
    r = random.Random(4)
    spans = [b" ".join(r.choice([b"a", b"b"]) for _ in range(r.randint(6, 30))) for _ in range(60)]
    group, holder = [r.randrange(3) for _ in spans], [r.randrange(9) for _ in spans]
    count = [len(s.split()) - 5 for s in spans]
    first = {}
    for s, g, h, c in zip(spans, group, holder, count, strict=True):
        for w in range(c):
            name = (g, tuple(s.split()[w : w + 6]))
            first[name] = min(first.get(name, h), h)
    want = {(i, w) for i, (s, g, h, c) in enumerate(zip(spans, group, holder, count, strict=True)) for w in range(c) if first[g, tuple(s.split()[w : w + 6])] < h}
    got = substring_dedup.Subtree(spans, 6).repeats(np.array(group), np.array(count), np.array(holder))
    assert {(i, w) for i, lo, n in zip(*map(np.ndarray.tolist, got), strict=True) for w in range(lo, lo + n)} == want


@pytest.mark.parametrize("operator", [substring_dedup.remove_repeats, suffix_index.remove_repeats])
def test_removal_across_segments(spark, monkeypatch, operator):
    from quillmask.llm import repeats

    r = random.Random(8)
    prose = lambda n: " ".join(f"{r.choice('abcdefg')}{r.randrange(900)}" for _ in range(n))
    shared = prose(900)
    df = spark.createDataFrame([(1, f"{prose(300)} {shared}"), (2, f"{prose(1000)} {shared} {prose(2000)}"), (3, prose(500))], "doc_id long, text string")
    whole = sorted(operator(df).collect())
    monkeypatch.setattr(repeats, "SEGMENT", 1500)
    assert sorted(operator(df).collect()) == whole and whole[1].n_removed >= 850


@pytest.mark.parametrize("ids", [None, 7])
def test_many_rows_of_one_id(spark, ids):
    r = random.Random(2)
    texts = [" ".join(f"{r.choice('abcdefg')}{r.randrange(9000)}" for _ in range(90)) for _ in range(400)]
    df = spark.createDataFrame([(ids, t) for t in texts + texts[:100]], "doc_id long, text string").repartition(4)
    assert sum(x.n_removed > 0 for x in suffix_index.remove_repeats(df).collect()) == 200
    assert sum(x.n_removed for x in substring_dedup.remove_repeats(df).collect()) == 0
    notes = spark.createDataFrame([(ids, f"own {i} line {t[:9]}\nthe same notice stands here in every one") for i, t in enumerate(texts)], "doc_id long, text string")
    assert sum(x.n_dropped for x in line_templates.template_report(notes).collect()) == 399


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, t, *_ in rows:
        want[key(i), np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes()] += 1
    got = packing.packed(docs, path, with_ids=True).collect()
    by_sequence = collections.defaultdict(list)
    for p in got:
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    # every id once
    covered = collections.Counter()
    for p in got:
        for k in range(p.length):
            covered[key(p.doc_id), p.doc_tokens, p.start + k, bytes(p.ids)[4 * k : 4 * k + 4]] += 1
    due = collections.Counter()
    for (i, b), n in want.items():
        for k in range(len(b) // 4):
            due[i, len(b) // 4, k, b[4 * k : 4 * k + 4]] += n
    assert covered == due
    assert len(by_sequence) * 4096 - sum(p.length for p in got) < 4096 * 2


def test_packing_places_and_balances(spark):
    path = queries.tokenizer_path()
    r = random.Random(3)
    topics = [[f"{a}{b}" for b in "mnop"] for a in ("whale", "tax", "piano", "violet", "engine", "harbor")]
    rows = [(i, " ".join(r.choice(topics[i % 6]) for _ in range(r.randint(5, 60)))) for i in range(600)] + [(1000 + i, "") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = packing.tokenised(df, path, 2)
    sizes = [x["s"] for x in packing.placed(tokens, 5000).groupBy("shard").agg({"n": "sum"}).withColumnRenamed("sum(n)", "s").collect()]
    assert 10 < len(sizes) and max(sizes) < 9000
    got = packing.packed(df, path, shard_tokens=5000).collect()
    assert sorted({p.doc_id for p in got}) == sorted(i for i, _ in rows) and sum(p.length for p in got) == tokens.agg({"n": "sum"}).first()[0]


def test_bm25_against_brute_force():
    r = np.random.default_rng(2)
    docs = [r.integers(0, 60, r.integers(0, 40)) for _ in range(80)]
    index, mean = packing.ShardIndex(docs), np.mean([len(d) for d in docs])
    for used in (3, 9, 40, *range(50, 79)):
        index.use(used)
    for seed in (0, 3, 17):
        want = np.zeros(len(docs))
        for t in set(docs[seed].tolist()):
            df = sum(t in d for d in docs)
            idf = max(0.0, np.log((len(docs) - df + 0.5) / (df + 0.5)))
            for i, d in enumerate(docs):
                tf = (d == t).sum()
                if df > 1 and index.unused[i]:
                    want[i] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        assert np.allclose(index.scores(seed), want, rtol=1e-4)
        order = list(index.neighbours(seed))
        assert sorted(order) == np.flatnonzero(want > 0).tolist() and all(want[a] >= want[b] - 1e-4 for a, b in zip(order, order[1:], strict=False))


def test_windows_are_filled_with_neighbours_of_their_seed():
    r = random.Random(7)
    docs = [np.array([100 * (i % 5) + r.randrange(40) for _ in range(50)] + [2]) for i in range(100)]
    pieces = packing.pack_shard(0, list(range(100)), docs, 510)
    kinds = collections.defaultdict(set)
    for p in pieces:
        kinds[p[5]].add(p[0] % 5)
    assert sum(len(k) for k in kinds.values()) <= 1.6 * len(kinds)


def test_ogg(docs, rows):
    got = {(key(r.doc_id), r.payload_sha256): r for r in ogg.media_column(docs, with_media=True).collect()}
    for i, t, *_ in rows:
        payload = ogg.padded((t or "").encode())
        r = got[key(i), hashlib.sha256(payload).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_sha256) == (len((t or "").encode()), len(payload), zlib.crc32(payload[-32:]), hashlib.sha256(r.media).hexdigest())
        assert ogg.read_payload(bytes(r.media))[0] == payload
    whole = ogg.mux(bytes(range(250)) * 2048)
    starts = [i for i in range(len(whole)) if whole[i : i + 4] == b"OggS"]
    for cut in starts[1:]:
        with pytest.raises(ogg.OggError):
            ogg.read_payload(whole[:cut])
    broken = bytearray(ogg.mux(b"x" * 576))
    broken[-1] ^= 1
    with pytest.raises(ogg.OggError):
        ogg.read_payload(bytes(broken))


def test_ogg_packets_continue_over_pages():
    w, out = ogg._Writer(7), bytearray()
    big = bytes(range(256)) * 600
    w.packet(out, b"head", 0)
    w.packet(out, big, 5)
    w.packet(out, b"", 6)
    w.flush(out, 4)
    assert [p for p, _ in ogg.demux(bytes(out))[7]] == [b"head", big, b""]


def test_simhash(docs, rows, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 4)
    monkeypatch.setattr(simhash, "FULL", 6)
    fps = [(key(i), simhash.fingerprint((t or "").encode())) for i, t, *_ in rows]
    nodes = sorted(set(f for _, f in fps))
    root = {f: f for f in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for i, f in fps:
        least[find(f)].append(i)
    want = sorted((i, f"{f:016x}", min(least[find(f)])) for i, f in fps)
    got = sorted((key(r.doc_id), r.fingerprint, key(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = {key(r.doc_id) for r in simhash.one_of_each(docs).collect()}
    assert kept == {min(v) for v in least.values()}


def test_full_shards_are_split_again(spark, monkeypatch, tmp_path):
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = base ^ (np.uint64(1) << r.integers(0, 63, 400, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 63, 400, dtype=np.uint64))
    fps = np.unique(np.concatenate((base, near))).view(np.int64).tolist()
    df = spark.createDataFrame(list(enumerate(fps)), "doc long, fp long")
    want = {x.fp: x.component for x in simhash.groups(df, f"file://{tmp_path}/a").collect()}
    assert len(set(want.values())) < 420
    for name, value in (("SAMPLE", 64), ("FULL", 20)):
        monkeypatch.setattr(simhash, name, value)
    assert {x.fp: x.component for x in simhash.groups(df, f"file://{tmp_path}/b").collect()} == want
    placed = simhash.split_again(df.selectExpr("0L AS shard", "fp", "false AS query"), f"file://{tmp_path}/c", 2)
    assert placed.where("not query").groupBy("shard").count().where("count > 20").isEmpty() and placed.where("not query").count() == len(fps)


def test_vantage_tree_misses_no_link():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base ^ (np.uint64(1) << r.integers(0, 63, 300, dtype=np.uint64))
    fps = np.unique(np.concatenate((base, near)))
    tree = simhash.VantageTree(fps, 16)
    at, shard, query = tree.route(fps, 2)
    assert tree.shards >= 8 and (np.bincount(at[~query], minlength=len(fps)) == 1).all()
    together = set()
    for s in range(tree.shards):
        home, all_ = at[(shard == s) & ~query], at[shard == s]
        d = np.bitwise_count(fps[all_][:, None] ^ fps[home][None, :]) <= 2
        together |= {frozenset((int(all_[a]), int(home[b]))) for a, b in zip(*np.nonzero(d), strict=True)}
    d = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    assert {frozenset((int(a), int(b))) for a, b in zip(*np.nonzero(d), strict=True)} <= together


def test_toxicity_restores_disguises():
    lm = toxicity.language_model({})
    scorer = toxicity.Scorer(lm).fit([(f"you {w} there".encode(), 1) for w in ["idiot", "moron", "loser"] * 8] + [(f"kind words number {i}".encode(), 0) for i in range(80)])
    for t in ["you 1d10t", "such a m0r0n", "l.o.s.e.r", "i d i o t x", "idiooooot", "LOSER!!"]:
        assert scorer.score(t.encode()) > 0.5, t
    for t in ["", "kind words", "model x86-64 costs $500", "call 555-5132"]:
        assert scorer.score(t.encode()) < 0.5, t


def test_restorations_against_all_paths():
    r = random.Random(9)
    counts = {k: r.randrange(60) for k in range(28**3)}
    lm = toxicity.language_model(counts)

    def paths(token):
        runs = [len(m.group()) for m in toxicity._RUN.finditer(token) for _ in m.group()]
        have = [(0.0, "", (0, 0))]
        for c, run in zip(token, runs, strict=True):
            new = []
            for cost, said, (p, q) in have:
                for x, price in ({c: 0.0} if c.isalpha() else toxicity.READINGS.get(c, {"": 2.0})).items():
                    if x:
                        k = toxicity._letter(x)
                        new.append((cost + price + lm[p, q, k], said + x, (q, k)))
                        if said[-1:] == x and run > 1:
                            new.append((cost + price + (0.3 if run > 2 else 3.0), said, (p, q)))
                    else:
                        new.append((cost + price, said, (p, q)))
            have = new
        best = {}
        for cost, said, (p, q) in have:
            best[said] = min(cost + lm[p, q, 0], best.get(said, 1e9))
        return [w for w, _ in sorted(best.items(), key=lambda x: x[1])[: toxicity.BEST]]

    for token in ["1d10t", "h3ll0", "a**b*", "loooser", "$h!t*", "éé1+", "|+|(#)", "****", "b!!!g"]:
        assert toxicity.restorations(token, lm) == paths(token), token
    assert len(toxicity.restorations("ab*1" * 2000, lm)) == toxicity.BEST


def test_character_model_counts_characters(spark):
    df = spark.createDataFrame([(1, "é日b"), (2, None)], "doc_id long, text string")
    n = {x.code: x.n for x in toxicity.trigrams(df).collect()}
    assert n[(27 * 28 + 27) * 28 + 2] == 1 and sum(n.values()) <= 8


def test_toxicity_fit_in_executors_equals_fit_in_one_place(spark):
    r = random.Random(1)
    rows = [(i, f"you {r.choice(['idi0t', 'moron', 'l.o.s.e.r'])} go away {i}" if i % 4 == 0 else f"kind words number {i} and more {r.random()}") for i in range(400)]
    df = spark.createDataFrame(rows + rows[:50], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i, _ in rows for _ in range(1 + (i % 9 == 0))], "doc_id long, toxic int, quality int")
    made = toxicity.fitted(df, labels)
    train = sorted({(t.encode(), int(i % 4 == 0)) for i, t in rows if zlib.crc32(str(i).encode()) % 5})
    plain = toxicity.Scorer(made.lm).fit(train)
    assert made.weights == plain.weights and np.allclose(made.beta, plain.beta)
    got = toxicity.scored(df, labels).collect()
    assert all((x.predicted == 1) == (x.doc_id % 4 == 0) for x in got if x.held_out) and sum(x.held_out for x in got) > 50


def test_toxicity_held_out(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rows = toxicity.scored(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(name, spark, data, agree):
    agree(queries.QUERIES[name](spark, data), queries.ORACLE_SQL[name])


def test_mixing(docs, rows):
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    targets = {(r.source_size, r.target) for r in got}
    total = sum(len((t or "").encode().split()) for _, t, *_ in rows)
    assert abs(sum(t for _, t in targets) - 1.5 * total) < 1e-6 and all(t <= 2 * s + 1e-9 for s, t in targets)
    assert mixing.mixed(docs).count() == sum(r.copies for r in mixing.with_copies(docs).collect())


def test_mixing_of_many_sources_with_clashing_columns(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, " ".join("w" * r.randrange(1, 9)), r.choice(["a", "b", None, *(f"s{k}" for k in range(40))]), 1, 2, 3) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rate int, size int, `row` int").repartition(4)
    whole = sorted(map(repr, mixing.mixed(df).collect()))
    report = sorted(map(repr, mixing.mix_report(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST", -1)
    assert sorted(map(repr, mixing.mixed(df).collect())) == whole and len(whole) > 600 and "rate=1, size=2, row=3" in whole[0]
    assert sorted(map(repr, mixing.mix_report(df).collect())) == report


def test_line_templates(spark):
    line = lambda n, who: f"Page {n} of the annual report by {who} was printed here today"
    texts = [f"own words number {w} in this one\n{line(i, w)}\nshort line\nthe very same notice stands in all documents" for i, w in enumerate(["ann", "bob", "cy", "dee"])]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(9, None, "y"), (10, "", "z"), (11, "row a b c d\nrow a b c d\nrow a b c d", "q")], "doc_id long, text string, tag string")
    got = {r.doc_id: r for r in line_templates.without_templates(df).collect()}
    assert [got[i].t_dropped for i in range(4)] == [0, 4, 4, 4] and got[0].text == texts[0] and got[2].text == ""
    assert got[9].text is None and got[10].text == "" and got[11].t_dropped == 0 and got[11].tag == "q"


def test_warc(spark):
    pages = spark.createDataFrame([(5, "http://a\r\nX: y", "same", 1), (2, None, "same", 1), (7, "u", "other é", 1), (9, "u", None, 1), (8, "u", "", 1), (2, "u", "same", 1), (None, "u", "solo", 1)], "page_id long, url string, html string, digest long")
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    want = [(5, 4, sha(b"same"), "revisit", 2), (2, 4, sha(b"same"), "response", None), (7, 8, sha("other é".encode()), "response", None), (9, 0, sha(b""), "revisit", 8), (8, 0, sha(b""), "response", None), (2, 4, sha(b"same"), "response", None), (None, 4, sha(b"solo"), "response", None)]
    assert sorted(map(repr, map(tuple, warc.archive_report(pages).collect()))) == sorted(map(repr, want))


def test_warc_normaliser():
    records = [warc.record(i, f"http://h/{i}", b"\r\n\r\nWARC/1.1" * i, i, base64.b32encode(hashlib.sha1(b"\r\n\r\nWARC/1.1" * i).digest()).decode()) for i in range(40)]
    out, index = warc.normalise(warc.gzip_member(b"".join(records)))
    assert [b"".join(warc.inflate(out[a : a + n])) for a, n, _ in index] == records
    assert [warc.parse(r)["page"] for r in records] == list(range(40))
    with pytest.raises(ValueError):
        list(warc.split_records(iter([records[1][:-3]])))


def test_quality_bounds(spark):
    from math import comb

    docs = [(i, " ".join(f"w{i}x{j}" for j in range(60)) + (" ####" * 40 if i % 5 == 0 else ""), "en") for i in range(1500)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(1500)], "doc_id long, quality int")
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    cut = quality.cutoffs(quality.statistics(df), labels).first()
    n, tests = 1200, 3
    tail = lambda k: sum(comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(k + 1))
    assert tail(0) <= 0.05 / tests and cut["cut_symbols"] == 0.05
    kept = {r.doc_id for r in quality.kept(df, labels).collect()}
    assert kept == {i for i in range(1500) if i % 5}
    # the bound holds on documents that chose nothing: their false rejection rate is below the risk
    fresh = spark.createDataFrame([(i, " ".join(f"v{i}x{j}" for j in range(60)) + " #" * (i % 3), "en") for i in range(1000)], "doc_id long, text string, lang string")
    judged = quality.statistics(fresh).where(quality.rule_values()["symbols"] > cut["cut_symbols"])
    assert judged.count() <= 20
    clash = df.selectExpr("*", "1 AS n_words", "2 AS stratum", "3 AS cut_symbols", "4 AS `row`")
    assert quality.kept(clash, labels).count() == 1200 and quality.kept(clash, labels).columns == clash.columns


def test_quality_agrees_with_sql_where_rules_reject(spark):
    import duckdb

    d = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL["op10_quality"])
    got = queries.op10_quality(spark, d).select(*want.columns)
    rows = want.fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    at = {c: i for i, c in enumerate(want.columns)}
    assert sum(not r[at["kept"]] and not r[at["base_failed"]] for r in rows) > 50


def test_quality_strata_of_null_and_its_name(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "(null)"), (3, "c", "")], "doc_id long, text string, lang string")
    assert quality.statistics(df).select("stratum").distinct().count() == 3


@pytest.mark.parametrize("run", [
    lambda d, s: packing.packed(d, queries.tokenizer_path()), lambda d, s: substring_dedup.remove_repeats(d), lambda d, s: ogg.media_column(d), lambda d, s: suffix_index.remove_repeats(d), lambda d, s: simhash.near_duplicates(d),
    lambda d, s: toxicity.scored(d, s.createDataFrame([], "doc_id long, quality int, toxic int")), lambda d, s: mixing.mix_report(d), lambda d, s: line_templates.template_report(d), lambda d, s: warc.archive_report(s.createDataFrame([], "page_id long, url string, html string")),
    lambda d, s: quality.quality_report(d, s.createDataFrame([], "doc_id long, quality int, toxic int")),
])
def test_empty_tables(run, empty, spark):
    assert run(empty, spark).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_give_every_row(name, spark, data):
    table = "pages" if name.startswith("op9") else "documents"
    out = queries.QUERIES[name](spark, data)
    least = spark.read.parquet(f"{data}/{table}.parquet").count()
    assert out.count() >= least


def test_operators_take_awkward_rows(docs, rows, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (3, 0, 1), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for out in (toxicity.scored(docs, labels), quality.quality_report(docs, labels), line_templates.template_report(docs)):
        assert out.count() == len(rows)


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), docs.schema)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] >= counts[3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert corpus_pipeline.run(spark, data).count() == pieces.count()


def test_one_of_each_with_null_and_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(None, a, "x"), (None, b, "x"), (None, b, "y"), (7, b, "x"), (8, "c d e f", "x"), (8, "g h i j", "x"), (8, "g h i j", "x")]
    for cut in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(cut)
        got = sorted((key(r.doc_id), r.text) for r in simhash.one_of_each(df).collect())
        assert got == sorted((key(i), t) for i, t in [(None, a), (None, b), (8, "c d e f"), (8, "g h i j")])


def test_toxicity_restores_long_tokens():
    lm = toxicity.language_model({})
    words = ["idiot", "moron", "degenerates"]
    scorer = toxicity.Scorer(lm).fit([(f"you {w} there".encode(), 1) for w in words * 8] + [(f"kind words number {i}".encode(), 0) for i in range(80)])
    for t in ["".join(c * 3 for c in "degenerates"), "i" + "d" * 20 + "i" * 9 + "o" * 9 + "t", "....".join("degenerates"), "you-are-all-such-an-idiot-and-nothing-else", "nobodywouldeverlistentoanidiotlikehim", "kindwordsnumberonekindwords" + "m0r0n" + "kindwordsnumber"]:
        assert len(t) > 32 and scorer.score(t.encode()) > 0.5, t
    for t in ["x" * 40, "-" * 50, "kind-words-number-one-and-number-two-and-three", "https://example.org/articles/2001/kind-words", "0123456789" * 5]:
        assert scorer.score(t.encode()) < 0.5, t
