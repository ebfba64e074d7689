import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dataward.llm import lm, maxscore, merkle, mixing, neardup, packing, pii, quality, urls, wordpiece
from dataward.llm.common import arrow_words, clear, discard, unused, written

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def some_texts(n=80, seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Étude", "straße", "mañana", *[rng.choice("bcdfg") + "a" * rng.randint(1, 3) + str(i % 7) for i in range(60)]]
    texts = []
    for i in range(n):
        if i % 4 == 3:
            w = texts[i - rng.randint(1, 3)].split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90))))
    return texts


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows and clashing names."""
    texts = some_texts(40)
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, len(t)) for i, t in enumerate(texts)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, "word " * 30000, "en", "s1", 150000), (103, texts[0], "en", "s1", 1), (104, "one two", "en", "s1", 7), (105, "ONE\ttwo", "en", "s2", 7), (106, " \n\t ", "de", None, 4)]
    rows += [rows[3], (None, "no id", "en", "s1", 5)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"size": F.lit("clash"), "spans": F.lit(1), "row": F.lit(2), "label": F.lit(0), "node": F.lit(0)})


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def test_arrow_words_of_slices():
    texts = pa.array(["zz À la", None, "", " A\x0bÉb\u00a0c  ", "x" * 1000])
    for start in range(5):
        distinct, at, lengths = arrow_words(texts.slice(start))
        got = iter(distinct.take(pa.array(at)).to_pylist())
        for n, text in zip(lengths, texts.slice(start).to_pylist(), strict=True):
            assert [next(got) for _ in range(n)] == brute.words(text)


# 1


def test_url_rules_and_trees(spark):
    pages = [(i, f"http{'s' * (i % 2)}://{h}/{p}/{i}?a=1") for i, (h, p) in enumerate([(h, p) for h in ("a.example.net", "EXAMPLE.com", "b.example.org", "deep.x.net", "orgs.com") for p in ("en", "de", "fr", "DE")] * 4)]
    pages += [(900, None), (901, "no scheme"), (902, "http://example.net"), (903, "x://notnet/en/"), (904, "http://a.net?x/y"), (None, "http://net/")]
    got = {(r["page_id"], r["host"], r["path"]): r for r in urls.judged(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert len(got) == len(pages)
    for (page_id, host, path), r in got.items():
        fits = [(len(rule), rule, v) for v, rule in urls.RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.partition("/")[2])]
        if fits:
            assert (r["rule"], r["verdict"]) == max(fits)[1:]
        else:
            assert r["rule"] is None and r["verdict"] in ("allow", "block")
    assert got[900, "", ""]["rule"] is None and got[902, "example.net", ""]["rule"] is None and got[904, "a.net", ""]["rule"] is None
    assert got[None, "net", "/"]["verdict"] == "block"


def test_urls_without_labels(spark):
    df = spark.createDataFrame([(1, "http://a.xyz/"), (2, "http://b.net/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judged(df).collect()} == {1: "block", 2: "block"}
    assert urls.judged(df.limit(0)).count() == 0


def test_trees_learn_held_out_urls(spark):
    """Suffix and path tell the kinds apart: most unjudged URLs that resemble blocked ones are blocked."""
    rows = [(i, f"http://www.h{i % 50}.{'example.net/fr' if i % 2 else 'example.org/fr'}/{i}{'?a=1&b=2&c=3' if i % 2 else ''}") for i in range(600)]
    rows += [(1000 + i, f"http://www.h{i}.example.edu/fr/{i}{'?a=1&b=2&c=3' if i % 2 else ''}") for i in range(100)]
    got = {r["page_id"]: r["verdict"] for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert sum((got[1000 + i] == "block") == bool(i % 2) for i in range(100)) >= 90


# 2


def test_mix_targets_and_copies(spark, odd_docs):
    texts = some_texts(300, 5)
    rows = [(i, t, "en", None if i % 11 == 0 else "big" if i % 3 == 0 else f"s{i % 7}" if i % 7 else "tiny", 0) for i, t in enumerate(texts)]
    rows += [(1000, None, "en", "empty", 0), (1001, "x " * 4000, "en", "big", 0)]
    got = mixing.mixed(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(brute.words(text))
    want, taken = brute.targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - float(want[r["source"]])) < 1e-6 * (1 + r["target"])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - float(want[s])) <= max(0.01 * float(want[s]), 60)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mixed(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    assert mixing.mixed(odd_docs).count() == odd_docs.count()
    assert mixing.mixed(odd_docs.limit(0)).count() == 0


def test_mix_repeats_rows(odd_docs):
    whole = {r["doc_id"]: r["copies"] for r in mixing.mixed(odd_docs.dropDuplicates(["doc_id"])).collect()}
    got = {r["doc_id"]: r["count"] for r in mixing.repeated(odd_docs.dropDuplicates(["doc_id"]), ).groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in whole.items() if n}



def test_mix_repeats_rows_one_by_one(spark, odd_docs):
    """Copies by row, not by doc_id: the repeats take what the plain mix takes, in all columns."""
    df = odd_docs.unionByName(odd_docs.where("doc_id < 5")).withColumns({"copies": F.lit("c"), "_mixed_id": F.lit(1), "key": F.lit(2), "hash": F.lit(3), "salt": F.lit(4), "nth": F.lit(5)})
    got, want = mixing.repeated(df), mixing.mixed(df)
    assert got.columns == df.columns and got.count() == want.agg(F.sum("copies")).first()[0]
    by_id = lambda rows: {r["doc_id"]: r["n"] for r in rows.collect() if r["n"]}
    assert by_id(got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))) == by_id(want.groupBy("doc_id").agg(F.sum("copies").alias("n")))


def test_targets_across_parts(spark):
    """Thousands of sources, numbered and filled up range by range."""
    rng = random.Random(4)
    sizes = {f"s{i:05d}": rng.choice((0, 1, 5, 100, 10_000)) for i in range(3000)} | {None: 777}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    want = brute.targets(sizes)
    assert len(got) == len(want) and all(got[s] == pytest.approx(float(want[s]), rel=1e-9) for s in want)


# 3


def test_fingerprints(spark, odd_docs, no_docs):
    texts = {i: t for i, t in enumerate(some_texts(60))} | {70: None, 71: "", 72: "A.\n\nB. C.\nD", 73: "A.\n\nB. C.\nD", 75: "é😀" * 700, 80: "x" * 50000}
    got = {r["doc_id"]: r for r in merkle.fingerprints(spark.createDataFrame([(d, t, None, None, None) for d, t in texts.items()], DOCS)).collect()}
    want, ids = brute.edited(texts), sorted(texts, reverse=True)
    for i, d in enumerate(ids):
        r, after = got[d], ids[(i + 1) % len(ids)]
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[d] or ""), brute.sha256(want[d]))
        assert (r["fingerprint"] == got[after]["fingerprint"]) == ((texts[d] or "") == (texts[after] or ""))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == ((texts[d] or "") == want[d])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        leaves = lambda f: {x for x in f.split(":")[1].split(",") if x}
        a, b = leaves(r["fingerprint"]), leaves(got[after]["fingerprint"])
        assert r["near_next"] == pytest.approx(1.0 if r["fingerprint"] == got[after]["fingerprint"] else 2 * len(a & b) / (len(a) + len(b)))
    assert got[72]["fingerprint"] == got[73]["fingerprint"] and got[73]["near_next"] == 1
    assert merkle.fingerprints(odd_docs).count() == odd_docs.count() and merkle.fingerprints(no_docs).count() == 0


def test_next_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE", 7)
    rows = [(i * i, f"t{i}", None, None, None) for i in range(100)]
    got = {r["doc_id"]: r["next_text"] for r in merkle.with_next(spark.createDataFrame(rows, DOCS).select("doc_id", "text"), ["text"]).collect()}
    assert got == {i * i: f"t{(i - 1) % 100}" for i in range(100)}


def test_tree_locates_edits(spark):
    a, b = "S1 p1.\nS1 p2.\n\nS2 p1.\nS2 p2.", "S1 p1.\nS1 p2.\n\nS2 p1.\nS2 new."
    row = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.tree(F.col("a")).alias("x"), merkle.tree(F.col("b")).alias("y"))
    row = row.select("x", "y", merkle.changed_paragraphs(F.col("x"), F.col("y")).alias("c"), merkle.changed_paragraphs(F.col("x"), F.col("x")).alias("none")).first()
    assert [c["place"] for c in row["c"]] == [3] and row["none"] == []
    assert row["x"]["sections"][0]["hash"] == row["y"]["sections"][0]["hash"] and row["x"]["root"] != row["y"]["root"]



def test_next_with_hot_ids(spark, monkeypatch):
    """A third of the rows without an id and a third with the same one spread over ranges, and every row has one next."""
    monkeypatch.setattr(merkle, "RANGE", 10)
    rng = random.Random(7)
    rows = [(None if i % 3 == 0 else 50 if i % 3 == 1 else i, f"t{rng.randrange(10**6)}", None, None, None) for i in range(600)] + [(50, "same", None, None, None)] * 5
    got = merkle.with_next(spark.createDataFrame(rows, DOCS).select("doc_id", "text"), ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    assert sorted((repr(r["next_doc_id"]), r["next_text"]) for r in got) == sorted((repr(d), t) for d, t, *_ in rows)
    key = lambda d: -(2**63) if d is None else d
    assert sum(key(r["next_doc_id"]) > key(r["doc_id"]) for r in got) == 1
    ids = sorted({d for d, *_ in rows if d is not None}, reverse=True)
    follows = {a: b for a, b in zip(ids, [*ids[1:], None], strict=True)}
    assert all(r["next_doc_id"] in (r["doc_id"], follows[r["doc_id"]]) for r in got if r["doc_id"] is not None)


def test_links_of_large_corpora_keep_salts(spark, monkeypatch):
    """More salts change which repeats are taken, not how many words."""
    texts = some_texts(200, 15)
    df = spark.createDataFrame([(i, t, "en", f"s{i % 4}", 0) for i, t in enumerate(texts)], DOCS)
    before = mixing.mixed(df).groupBy("source").agg(F.sum("taken").alias("t")).collect()
    monkeypatch.setattr(mixing, "SALTED", 2)
    assert sorted(map(tuple, before)) == sorted(map(tuple, mixing.mixed(df).groupBy("source").agg(F.sum("taken").alias("t")).collect()))


# 4


def test_lm_scores(spark, odd_docs, no_docs):
    rng = random.Random(3)
    english, german = "the of and to in is that for on was".split(), "der die und das ist von mit den ein zu".split()
    texts = [(i, " ".join(rng.choice(english if i % 2 else german) if rng.random() < 0.8 else f"{rng.choice('bcd')}{rng.randrange(400)}{'ing' if i % 2 else 'ung'}" for _ in range(rng.randint(5, 60)))) for i in range(400)]
    texts += [(900, None), (901, ""), (902, "Neverseen! und THE")]
    got = {r["doc_id"]: r for r in lm.scores(spark.createDataFrame([(d, t, None, None, None) for d, t in texts], DOCS)).collect()}
    for d, (held, n, known, total, base) in brute.base_scores(texts).items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)
    assert lm.scores(odd_docs).count() == odd_docs.count() and lm.scores(no_docs).count() == 0


@pytest.mark.parametrize("pairs", [1 << 21, 200])
def test_lm_word_probabilities_sum_to_one(spark, monkeypatch, pairs):
    """After any history, the words of the training documents, the end sign and one unknown word a class share all."""
    monkeypatch.setattr(lm, "PAIRS", pairs)
    rng = random.Random(4)
    vocabulary = [f"{c}{k}" for c in "abcdefgh" for k in range(40)]
    texts = [(i, " ".join(rng.choice(vocabulary[: 40 * (1 + i % 8)]) for _ in range(rng.randint(1, 60)))) for i in range(150)]
    model = lm.fitted(spark.createDataFrame(texts, "doc_id long, text string"))
    use = lm.prepared(*model.lookups.value)
    assert (len(model.weights.value[1][0]) > 200) == (pairs > 200) and len(model.weights.value[1][0]) > 0
    for history in ("a1", "a1 a2", "b7 unknown", "c3 h39", " ".join(vocabulary[:9])):
        _, classes, codes, docs, _, _ = lm.encoded(pa.array([f"{history} {w}" for w in use["words"][1:]] + [history]), use)
        n = np.bincount(docs)
        at = np.append(np.cumsum(n)[:-1] - 2, len(docs) - 1)  # the word after the history, or its end
        logs, kinds = lm.token_logs(use, model.weights.value, classes, codes, docs)[at], classes[at]
        places = np.append(np.arange(1, len(use["words"])), 0)
        p = np.exp(logs) * (use["n"][places] + lm.ADDED) / model.in_class[kinds]
        unknown = {}
        for w in (f"x{a}{b}" for a in "abcdefghijklmn" for b in range(40)):
            unknown.setdefault(zlib.crc32(w[-2:].encode()) % lm.SHARED + lm.OWN + 1, w)
        assert len(unknown) == lm.SHARED
        _, classes, codes, docs, _, _ = lm.encoded(pa.array([f"{history} {w}" for w in unknown.values()]), use)
        at = np.cumsum(np.bincount(docs)) - 2
        rest = np.exp(lm.token_logs(use, model.weights.value, classes, codes, docs)[at]) * lm.ADDED / model.in_class[classes[at]]
        assert p.sum() + rest.sum() == pytest.approx(1, abs=2e-3)


def test_lm_scores_by_all_pairs_however_few_are_broadcast(spark, monkeypatch):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(f"{rng.choice('abc')}{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randint(0, 40)))) for i in range(200)], "doc_id long, text string")
    want = {r["doc_id"]: r["score"] for r in lm.scores(docs).collect()}
    monkeypatch.setattr(lm, "PAIRS", 100)
    assert {r["doc_id"]: r["score"] for r in lm.scores(docs).collect()} == pytest.approx(want, rel=1e-5)
    monkeypatch.setattr(lm, "VOCABULARY", 60)
    assert {r["doc_id"]: r["score"] for r in lm.scores(docs).collect()} == pytest.approx(want, rel=1e-5)


def test_lm_leaves_no_tables_of_pairs(spark):
    """Tables of all pairs go before the result is there, to spare disk."""
    docs = spark.createDataFrame([(i, f"a b{i % 7} c{i}") for i in range(60)], "doc_id long, text string")
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    assert lm.scores(docs).count() == 60
    left = {p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before}
    assert "scored" in left and not left & {"lm-pair-counts", "lm-pair-weights"}


def test_lm_keeps_no_tokens_on_disk(spark, monkeypatch):
    """The table behind the result holds documents only, not what they ask of pairs that are not broadcast."""
    monkeypatch.setattr(lm, "PAIRS", 5)
    docs = spark.createDataFrame([(i, f"a b{i % 7} c{i}") for i in range(60)], "doc_id long, text string")
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    assert lm.scores(docs).count() == 60
    assert [spark.read.parquet(str(p)).count() for p in set(shared.iterdir()) - before if p.name.startswith("scored")] == [60]


def test_lm_packs_numbers_small_and_whole():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 300, 20_000).astype(np.uint64) << np.uint64(32) | rng.integers(0, 1 << 16, 20_000).astype(np.uint64))
    assert np.array_equal(lm.unpacked_keys(lm.packed_keys(keys)), keys) and len(lm.packed_keys(keys)) < 0.4 * keys.nbytes
    for kind in ("u1", "<u2", "<u4", "<i8", "<f4"):
        x = rng.integers(0, 200, 999).astype(kind)
        assert np.array_equal(lm.unpacked(lm.packed(x), kind), x) and len(lm.unpacked(lm.packed(x[:0]), kind)) == 0


def test_lm_class_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    weights, bias = rng.normal(size=(lm.FEATURES, lm.CLASSES)).astype(np.float32), rng.normal(size=lm.CLASSES).astype(np.float32)
    feats = lm.features(rng.integers(-1, 5000, 500), rng.integers(0, lm.CLASSES, 500), np.repeat(np.arange(5), 100))
    assert feats.max() < lm.FEATURES
    assert np.allclose(np.exp(lm.class_logs(feats, weights, bias)).sum(axis=1), 1, atol=1e-4)


# 5


def test_token_counts(spark, odd_docs, no_docs):
    automaton = wordpiece.automaton("byte_bpe_50k")
    import base64

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        vocabulary = {base64.b64decode(x.split()[0]) for x in f}
    longest = max(map(len, vocabulary))
    for text in [*some_texts(30), "internationalization antidisestablishmentarianism", "ééé😀 日本語 \x7f", "aaaaaaaaab" * 50]:
        for w in set(brute.words(text)):
            assert automaton.count(b" " + w.encode()) == brute.greedy_pieces(w, vocabulary, longest)
    rows = {r["doc_id"]: r for r in wordpiece.token_counts(odd_docs).collect()}
    assert rows[100]["n_words"] == rows[101]["n_tokens"] == rows[106]["n_tokens"] == 0 and rows[102]["n_words"] == 30000
    assert wordpiece.token_counts(no_docs).count() == 0


def test_small_automaton():
    single = [bytes([b]) for b in range(256)]
    rng = random.Random(9)
    for _ in range(60):
        pieces = {bytes(rng.choice(b"ab ") for _ in range(rng.randint(2, 5))) for _ in range(8)}
        automaton, vocabulary = wordpiece.Automaton([*single, *pieces]), {*single, *pieces}
        for _ in range(20):
            word = "".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))
            assert automaton.count(b" " + word.encode()) == brute.greedy_pieces(word, vocabulary, 5)


# 6


@pytest.mark.parametrize("shard,essential,scale", [(16384, 16, 0.2), (37, 3, 0.2), (37, 3, 1e6), (60, 1, 5e6)])
def test_top_k(spark, monkeypatch, shard, essential, scale):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    monkeypatch.setattr(maxscore, "ESSENTIAL", essential)
    monkeypatch.setattr(maxscore, "BLOCK", 4)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, scale, 12))], 0) for i in range(150)]
    rows += [(200, rows[0][1], 0), (220, rows[0][1], 1), (240, None, 0), (241, [None] * 12, 0), (242, [float("nan")] * 12, 0), (243, [float("inf")] + [0.0] * 11, 0), (260, [1.0], 0), (261, [], 0), (3, rows[3][1], 0), (None, rows[4][1], 0)]
    got = maxscore.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    vectors = {i: [int(np.floor(64 * np.float64(np.float32(x)))) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in vectors:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(vectors[q], vectors[c], strict=False)), c) for c in vectors if c != q)[:20]
            want |= {(q, n, c, -s) for n, (s, c) in enumerate(scored, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert maxscore.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    clashing = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"x": F.lit(1), "rank": F.lit(2), "shard": F.lit(3), "score": F.lit(4)})
    assert {tuple(r) for r in maxscore.top_k(clashing).collect()} == want


def test_maxscore_prunes():
    """Most products of unlikely vectors are left out, and none that count."""
    rng = np.random.default_rng(5)
    x = np.floor(64 * rng.normal(0, 0.125, (3000, 64)))
    shard, done = maxscore.Shard(np.arange(3000), x), 0
    for q in range(0, 3000, 150):
        ids, scores, n = shard.top(q, x[q], 20)
        every = x @ x[q]
        every[q] = -np.inf
        order = np.lexsort((np.arange(3000), -every))[:20]
        assert ids.tolist() == order.tolist() and scores.tolist() == every[order].tolist()
        done += n
    assert done / (20 * x.size) < 0.7


def test_scores_beyond_64_bits_fail(spark):
    rows = [(i, [9e16, 9e16]) for i in (20, 21)]
    with pytest.raises(Exception, match="OverflowError|int too|too large"):
        maxscore.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()


# 7


@pytest.mark.parametrize("words,similarity", [(3, 85), (5, 80)])
def test_near_duplicates(spark, monkeypatch, words, similarity):
    monkeypatch.setattr(neardup, "BLOCK_SETS", 8)
    texts = dict(enumerate(some_texts(140, 7)))
    base = texts[0].split(" ") * 2
    for i in range(200, 240):  # one group that spans blocks
        w = list(base)
        w[i % len(w)] = f"edit{i}"
        texts[i] = " ".join(w)
    texts |= {300: None, 301: "", 302: "a b", 303: "A  b", 304: "a b c", 305: " \t", 306: "", 307: texts[5].upper(), 308: texts[5]}
    got = {r["doc_id"]: r for r in neardup.grouped(spark.createDataFrame([(d, t, None, None, None) for d, t in texts.items()], DOCS), words, similarity).collect()}
    label, sizes = brute.groups(texts, words, similarity)
    assert {d: r["component_id"] for d, r in got.items()} == label
    assert {d: r["n_shingles"] for d, r in got.items()} == sizes
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = neardup.grouped(odd_docs).collect()
    assert len(got) == len({r["doc_id"] for r in got}) == odd_docs.select("doc_id").distinct().count() - 1
    assert neardup.grouped(no_docs).count() == 0
    kept = neardup.one_of_each(odd_docs, 5, 80)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert None in ids and len(ids) == len(set(ids)) and 103 not in ids and 105 not in ids


def test_sketch_distance_estimates_similarity():
    rng = np.random.default_rng(2)
    limit = neardup.most_bits(85)
    for _ in range(60):
        common = rng.integers(0, 2**63, 400, dtype=np.uint64)
        own = rng.integers(0, 2**63, 70, dtype=np.uint64)  # similarity 400 / 470 > 0.85
        a, b = (np.unique(x) for x in (common, np.concatenate([common, own])))
        x, y = (np.frombuffer(neardup.odd_sketch(neardup.samples(s)), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= limit
        other = np.frombuffer(neardup.odd_sketch(neardup.samples(rng.integers(0, 2**63, 400, dtype=np.uint64))), np.uint64)
        assert np.bitwise_count(x ^ other).sum() > limit



@pytest.mark.parametrize("ids", [range(499, -1, -1), range(500), random.Random(1).sample(range(10_000), 500)])
def test_components_of_chains(spark, ids):
    """A chain settles from whichever end it is numbered, and however its ties are dealt out."""
    ids = list(ids)
    ties = [*zip(ids, ids[1:], strict=False), (20_000, 20_001), (20_002, 20_001), (30_000, 30_000)]
    random.Random(2).shuffle(ties)
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(ties, "a long, b long").repartition(16)).collect()}
    assert got == dict.fromkeys(ids, min(ids)) | dict.fromkeys((20_000, 20_001, 20_002), 20_000)


def test_near_duplicates_of_a_chain(spark):
    """Each version is like the next and unlike those further off; the smallest id stands at the end."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(100)]
    texts = {}
    for i in range(160, -1, -1):
        at = rng.randrange(100)
        words[at] = f"x{i}"
        texts[i] = " ".join(words)
    got = {r["doc_id"]: r["component_id"] for r in neardup.grouped(spark.createDataFrame([(d, t, None, None, None) for d, t in texts.items()], DOCS)).collect()}
    assert got == brute.groups(texts, 3, 85)[0] and set(got.values()) == {0}


def test_one_of_each_with_clashing_names(spark, odd_docs):
    df = odd_docs.withColumns({"kept_id": F.lit(1), "_KEPT_ID": F.lit(2), "nth": F.lit(3)})
    got = neardup.one_of_each(df, 5, 80)
    assert got.columns == df.columns and {r["doc_id"] for r in got.collect()} >= {100, 101, 102, None}


def test_written_tables_go(spark):
    kept = written(spark.range(5), "kept")
    gone = written(spark.range(5), "gone")
    discard(gone)
    assert kept.count() == 5
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        gone.count()
    assert clear(spark) >= 1 and clear(spark) == 0
    assert unused(spark.createDataFrame([(1, 2)], "X int, _x int"), "x") == "__x"


# 8


def test_plain_spans_match_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(1)
    for _ in range(8000):
        t = "".join(rng.choice("ab@.+-%12345 ()0\n") for _ in range(rng.randint(0, 60)))
        digits = lambda m: sum(c.isdigit() for c in m[0])
        want = [("email", *m.span()) for m in email.finditer(t)] + [("ip", *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [("card", *m.span()) for m in card.finditer(t) if 12 <= digits(m) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
        want += [("phone", *m.span()) for m in phone.finditer(t) if 9 <= digits(m) <= 15]
        assert sorted(want) == sorted(pii.plain(t))


@pytest.mark.parametrize(
    "kind,hidden",
    [
        ("email", "john.doe [at] mail3 [dot] example [dot] com"),
        ("email", "john at mail dot example dot com"),
        ("email", "john(at)mail(dot)com"),
        ("email", "j\u043ehn@ex\u0430mple.com"),
        ("email", "user\uff20example\uff0eorg"),
        ("email", "jo\u200bhn@example.com"),
        ("phone", "plus one nine eight eight five five five two four eight five"),
        ("phone", "+1 (9O8) 555-2l85"),
        ("card", "\uff14\uff10\uff14\uff11\uff18\uff19\uff14\uff19\uff17\uff14\uff16\uff10\uff18\uff17\uff19\uff15"),
        ("card", "four zero four one eight nine four nine seven four six zero eight seven nine five"),
        ("ip", "192 [dot] 168 [dot] 1 [dot] 10"),
        ("ip", "192 dot 168 dot 1 dot 10"),
    ],
)
def test_disguises(kind, hidden):
    text = f"Étude before, {hidden} after."
    got = [(x["kind"], text[x["start"] : x["end"]], x["base"]) for x in pii.spans(text)]
    assert (kind, hidden, False) in got


@pytest.mark.parametrize(
    "kind,hidden",
    [
        ("email", "john@example . com"),
        ("email", "john@example .com"),
        ("email", "john at example . com"),
        ("phone", "+1 nine 0 8 five 5 5 two 1 8 5"),
        ("phone", "+\u0a67 \u0a68\u0a69\u0a6a\u0a6b\u0a6c\u0a6d\u0a6e\u0a6f\u0a66"),
        ("phone", "+1 n\u0131ne 0 8 \u017f\u0130x 5 5 two 1 8 5"),
    ],
)
def test_disguises_do_not_need_another_sign(kind, hidden):
    for more in ("", " and \u2013 this", " or \xa0", " or [at]", " or 3o"):
        text = f"Write {hidden}{more}"
        assert (kind, hidden, False) in [(x["kind"], text[x["start"] : x["end"]], x["base"]) for x in pii.spans(text)]


def test_spans_do_not_hang_on_the_rest_of_the_text():
    rng = random.Random(2)
    units = ["john", "example", "com", " ", " ", " ", ".", "@", " at ", " dot ", " [at] ", " (.) ", "+1", "9", "08", "one", "zwei", "s\u0131x", "f\u0130ve", "\u017fix", "O", "l", "-", "\xa0", "\u0663", "\u09e7"]
    for _ in range(4000):
        text = "".join(rng.choice(units) for _ in range(rng.randint(1, 24)))
        for more in ("\n\n\n\n|\n\n\n\n[at]", "\n\n\n\n|\n\n\n\none two three|\u2013|\xa0|3o"):
            assert [x for x in pii.spans(text + more) if x["start"] < len(text)] == pii.spans(text)


@pytest.mark.parametrize("text", ["look at example.com. The dot at.", "one two three four five", "un de un deux trois", "version 1.2.3 at 10:30", "O1 l0 I", "le point (at) sea"])
def test_clean_text(text):
    assert pii.spans(text) == []


def test_long_texts_take_linear_time():
    import time

    text = "0" * 100000 + "a" * 100000 + "@" * 50000 + ". " * 50000 + "one " * 50000 + "a at b dot " * 20000 + "+1" * 50000
    began = time.time()
    pii.spans(text)
    assert time.time() - began < 20


def test_pii_digests_and_redaction(spark, odd_docs, no_docs):
    text = "é😀 a@b.co, +1 (988) 555-2485; 42.144.35.254 or x at y dot com"
    df = spark.createDataFrame([(1, text, None, None, 0), (2, None, None, None, 0)], DOCS)
    got = {r["doc_id"]: r for r in pii.digests(df).collect()}
    spans = pii.spans(text)
    own = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["base"])
    assert (got[1]["n_email"], got[1]["n_ip"], got[1]["n_card"], got[1]["n_phone"]) == (1, 1, 0, 1)
    assert got[1]["base_sha256"] == brute.sha256(own) and got[1]["spans"].count(":") == 8
    assert got[2]["base_sha256"] == brute.sha256("") and got[2]["spans"] == ""
    assert {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()} == {1: "é😀 [EMAIL], [PHONE]; [IP] or [EMAIL]", 2: None}
    assert pii.digests(odd_docs).count() == odd_docs.count() and pii.digests(no_docs).count() == 0
    assert pii.redacted(odd_docs).columns == odd_docs.columns



@pytest.mark.parametrize("words", [5000, 200_000])
def test_redaction_of_long_texts(spark, words):
    """Time follows the length; a 1.2 MB text holds 100,000 spans."""
    text = " ".join(f"u{i}@h{i % 7}.org" if i % 2 else f"say{i}" for i in range(words))
    got = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, spans string")
    got = got.withColumns({"_spans": F.lit(1), "_text": F.lit(2)})
    out = {r["doc_id"]: r for r in pii.redacted(got).collect()}
    assert out[1]["text"] == " ".join("[EMAIL]" if i % 2 else f"say{i}" for i in range(words))
    assert (out[2]["text"], out[3]["text"], out[1]["_spans"], out[1]["_text"], out[1]["spans"]) == (None, "", 1, 2, "x") and pii.redacted(got).columns == got.columns


def test_planted_disguises():
    """Disguised identifiers among ordinary words: most are found, and little else."""
    rng = random.Random(8)
    digits = "zero one two three four five six seven eight nine".split()
    swap = str.maketrans("aeopc", "аеорс")

    def email():
        name, host = rng.choice(("ann", "bob.lee", "c_d")), rng.choice(("mail", "post-box", "web")) + str(rng.randint(1, 9))
        return rng.choice([f"{name} at {host} dot com", f"{name} [at] {host} [dot] org", f"{name}(at){host}.net", f"{name}@{host} . com", f"{name}@{host}.com".translate(swap), f"{name}＠{host}.com", f"{name}@{host}​.com"])

    def phone():
        n = [rng.randint(0, 9) for _ in range(10)]
        return rng.choice(["+" + " ".join(digits[d] for d in n), "plus " + " ".join(digits[d] for d in n), "+" + "".join(chr(0xFF10 + d) for d in n), "+1" + "".join(map(str, n[:4])) + "O" + "".join(map(str, n[4:8]))])

    found = planted = extra = 0
    for i in range(400):
        words = [rng.choice(("lorem", "ipsum", "dolor", "mit", "der", "la", "home,", "Now.", "12", "3.5")) for _ in range(30)]
        kind, what = ("email", email()) if i % 2 else ("phone", phone())
        before = " ".join(words[:15]) + " : "
        text = before + what + " ; " + " ".join(words[15:])
        got = [(s["kind"], s["start"], s["end"]) for s in pii.spans(text) if not s["base"]]
        planted += 1
        hit = [g for g in got if g[0] == kind and g[1] <= len(before) + 1 and g[2] >= len(before) + len(what) - 1]
        found += bool(hit)
        extra += len(got) - len(hit)
    assert found / planted >= 0.95 and extra / planted <= 0.02, (found, extra, planted)


def test_rewritten_text_keeps_its_sources():
    """Stretches tell the same source characters as a mapping of every single character."""
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 30)))
        way, now, spans = pii.Plain(text), text, [(i, i + 1, False) for i in range(len(text))]
        for _ in range(3):
            cuts = sorted(rng.sample(range(len(now) + 1), min(len(now) + 1, 2 * rng.randint(0, 3))))
            edits = [(s, e, "XYZ"[: rng.randint(0, 3)]) for s, e in zip(cuts[::2], cuts[1::2], strict=False)]
            for s, e, new in reversed(edits):
                spans[s:e] = [(spans[s][0], spans[e - 1][1], True)] * len(new)
                now = now[:s] + new + now[e:]
            way.rewrite(edits)
            assert way.text == now
            for s in range(len(now)):
                e = rng.randint(s + 1, len(now))
                got = [x for a, b, new in way.source(s, e) for x in ([(a, b, True)] if new else [(i, i + 1, False) for i in range(a, b)])]
                assert list(dict.fromkeys(got)) == list(dict.fromkeys(spans[s:e]))


# 9



def test_quality_model_is_a_distribution(spark):
    texts = some_texts(60, 3)
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de", None, 0) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    table, model = quality.fitted(docs, labels).value
    for lang in ("en", "de"):
        p = np.exp2(-quality.dense(model, lang).astype(np.float64)).reshape(quality.ALPHABET, quality.ALPHABET, quality.ALPHABET)
        assert np.allclose(p.sum(axis=2), 1, atol=1e-3)
    # Brute force for one language: modified Kneser-Ney from its definition.
    from collections import Counter

    c3 = Counter()
    for i in range(50):
        if i % 2:
            x = quality.codes(texts[i], table)
            c3.update(zip(*(x[k : len(x) - 2 + k].tolist() for k in range(3)), strict=True))
    levels = [c3, Counter((v, w) for _, v, w in c3), None]
    levels[2] = Counter((w,) for _, w in levels[1])

    def discounts(c):
        n = [max(1, sum(x == k for x in c.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(k - 0.01, max(0.01, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]

    def prob(level, gram):
        if level == 3:
            return 1 / quality.ALPHABET
        c, d = levels[level], discounts(levels[level])
        context = [n for g, n in c.items() if g[:-1] == gram[:-1]]
        low = prob(level + 1, gram[1:])
        if not context:
            return low
        cut = lambda n: d[min(n, 3) - 1]
        n = c.get(gram, 0)
        return (max(0, n - cut(n)) if n else 0) / sum(context) + sum(map(cut, context)) / sum(context) * low

    dense = quality.dense(model, "en")
    rng = random.Random(0)
    grams = rng.sample(sorted(c3), 20) + [tuple(rng.randrange(40) for _ in range(3)) for _ in range(20)]
    for u, v, w in grams:
        assert dense[u << 14 | v << 7 | w] == pytest.approx(-np.log2(prob(0, (u, v, w))), rel=1e-3)


def test_quality_rejects_junk(spark, odd_docs, no_docs):
    texts = some_texts(200, 8)
    rows = [(i, t, "en", None, 0) for i, t in enumerate(texts)] + [(1000 + i, "#$%! " * 40 + "XQZ " * 30, "en", None, 0) for i in range(10)] + [(2000, "whatever", "xx", None, 0), (2001, None, "en", None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)] + [(1000, 0, 0), (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judged(docs, labels).collect()}
    assert len(got) == len(rows) and not any(got[1000 + i]["kept"] for i in range(10))
    assert sum(got[i]["kept"] for i in range(200)) >= 190 and got[2000]["kept"] and got[2000]["perplexity"] is None
    kept = {r["doc_id"] for r in quality.kept(docs, labels).collect()}
    assert kept == {d for d, r in got.items() if r["kept"]}
    assert quality.judged(odd_docs, labels).count() == odd_docs.count() and quality.judged(no_docs, labels).count() == 0
    assert quality.judged(docs, labels.limit(0)).where("kept").count() == len(rows)


def test_quality_samples_each_language(spark):
    texts = some_texts(240, 9)
    langs = ["en"] * 200 + [f"x{i // 4}" for i in range(40)]
    docs = spark.createDataFrame([(i, t, lang, None, 0) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(240)], "doc_id long, quality int, toxic int")
    assert dict(quality.trusted_sample(docs, labels, 3).groupBy("lang").count().collect()) == dict.fromkeys(langs, 3)
    assert quality.judged(docs, labels, sample=5).where("perplexity IS NULL").count() == 0


def test_quality_learns_from_all_trusted_documents(spark):
    """Each of more than 20,000 documents has a character of its own, and the model knows them all."""
    docs = spark.createDataFrame([(i, chr(0x4E00 + i), "zh", None, 0) for i in range(20_900)], DOCS)
    labels = spark.range(20_900).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    chars, _, rest, _ = quality.fitted(docs, labels).value[1]["zh"][-2]
    assert {*chars.tolist(), *rest.tolist()} == {0x4E00 + i for i in range(20_900)}


def test_quality_shuffles_little_but_trusted_texts(spark):
    """A map of ids leaves out nearly all other texts before the join, which takes out the rest of them; no trusted one is lost."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("a text").alias("text"))
    docs = docs.union(spark.createDataFrame([(None, "en", "no id"), (5, "en", "again")], "doc_id long, lang string, text string"))
    for ids in (spark.range(0, 20_000, 7), spark.range(5, 6), spark.range(0)):
        want = sorted(i for (i,) in ids.collect())
        got = sorted(r["doc_id"] for r in quality.likely(docs, ids.toDF("doc_id")).collect())
        assert set(want) <= set(got) and got.count(5) == (2 if 5 in got else 0) and len(got) <= len(want) + 1 + 0.05 * 20_000
        labels = ids.select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
        trusted = quality.trusted_texts(docs, labels)
        assert sorted(r["doc_id"] for r in trusted.collect()) == sorted(want + [5] * (5 in want))
        plan = trusted._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join LeftOuter") < plan.index("getbit")  # the map's join comes first


def test_written_leaves_no_files_of_its_shuffles(spark):
    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = root.getAllBlocks().size()
    table_ = written(spark.range(1000).repartition(3, "id").groupBy(F.col("id") % 7).count(), "cleaned")
    assert len(table_.collect()) == 7
    end = time.time() + 20
    while root.getAllBlocks().size() > before and time.time() < end:
        time.sleep(0.1)
    assert root.getAllBlocks().size() <= before


def test_quality_tells_scripts_apart_beside_a_latin_majority(spark):
    rng = random.Random(10)
    scripts = {"latin": [chr(c) for c in range(0x100, 0x17D)], "ru": [chr(c) for c in range(0x430, 0x450)], "zh": [chr(c) for c in range(0x4E00, 0x4E00 + 900)]}
    rows, made = [], {}
    for lang, letters in scripts.items():
        words = ["".join(rng.choice(letters) for _ in range(3)) for _ in range(40 if lang == "ru" else 400)]
        for i in range(600 if lang == "latin" else 60):
            rows.append((len(rows), " ".join(rng.choice(words) for _ in range(120)), lang, None, 0))
        foreign = [chr(c) for c in range(0x9000, 0x9400)] if lang == "zh" else letters
        made[lang] = len(rows)
        rows.append((len(rows), " ".join("".join(rng.choice(foreign) for _ in range(3)) for _ in range(120)), lang, None, 0))
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] not in made.values()], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judged(docs, labels).collect()}
    for lang in ("ru", "zh"):
        assert got[made[lang]]["perplexity"] > 1.3 * got[made[lang]]["threshold"] and not got[made[lang]]["kept"]


def test_quality_shares_of_rare_characters_add_up():
    letters = [("zh", 1000 + i, 300 - i) for i in range(200)] + [("en", 97, 5)]
    _, own = quality.alphabets(letters)
    chars, codes, rest, bits = own["zh"]
    assert len(chars) == 125 and len(set(codes.tolist())) == 125 and codes.min() == 2 and len(rest) == 75
    share = np.exp2(-bits.astype(np.float64))
    assert share[:-1].sum() + share[-1] * (quality.UNICODE - len(rest)) == pytest.approx(1, rel=1e-4)


def test_quality_rejects_repeated_words(spark):
    words = [t.split() for t in some_texts(200, 11)]
    texts = [" ".join(b for a, b in zip(["", *w], w, strict=False) if a.lower() != b.lower()) for w in words]
    common = [x for x in ("the", "of", "mañana") for _ in range(4)]
    rows = [(i, t, "en", None, 0) for i, t in enumerate(texts)] + [(1000 + i, " ".join([w] * (20 + 40 * i)), "en", None, 0) for i, w in enumerate(common)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.judged(docs, labels).collect()}
    assert not any(got[1000 + i] for i in range(len(common))) and sum(got[i] for i in range(200)) >= 198
    assert quality.repeats("A a\nb  b b") == (3, 4) and quality.repeats(None) == (0, 0)


# 10


def test_encoder_matches_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder("byte_bpe_50k")
    rng = random.Random(2)
    texts = ["", " ", "  a", "a  b", "a \n b", "a\n\nb c", "x<|endoftext|>y z", "It's 10,000 — café\u00a0d'été 😀 \t\tq", "end ", *some_texts(20)]
    texts += ["".join(rng.choice("ab '\n\t1,é\u00a0\u2003<|>") for _ in range(40)) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing(spark, odd_docs, no_docs):
    length = 64
    texts = dict(enumerate(some_texts(150))) | {500: None, 501: "word " * 2000}
    docs = spark.createDataFrame([(d, t, None, None, 0) for d, t in texts.items()], DOCS)
    parts = packing.pieces(docs, length=length)
    rows = packing.pack(packing.written(parts, "test-pieces"), length).collect()
    own, by_doc, by_sequence = packing.encoder("byte_bpe_50k"), {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for d, t in texts.items():
        ids, at = [*np.frombuffer(own.ids(t or ""), "<u4").tolist(), 1], 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and np.frombuffer(r["ids"], "<u4").tolist() == ids[at : at + r["length"]] and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    tokens = sum(r["length"] for r in rows)
    assert tokens / (len(by_sequence) * length) > 0.9
    got = packing.packed_digests(odd_docs)
    assert got.select("doc_id").distinct().count() == odd_docs.select("doc_id").distinct().count() and packing.packed_digests(no_docs).count() == 0
    row = packing.packed_digests(docs).where("doc_id = 500").first()
    assert row["ids_crc32"] == zlib.crc32(np.array([1], "<u4").tobytes())


def test_patterns_hold_every_piece():
    rng = random.Random(6)
    for _ in range(50):
        histogram = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
        packs = packing.patterns(histogram, 100)
        found = {}
        for count, pack in packs:
            assert sum(pack) <= 100 and count > 0
            for x in pack:
                found[x] = found.get(x, 0) + count
        assert found == histogram
