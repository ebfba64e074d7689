import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from dataward.llm import packing

from . import brute
from .test_operators import DOCS, some_texts


def test_stages(spark, tmp_path):
    texts = some_texts(120, 11)
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(500 + i, "@@ ## $$ %% " * 30, "en", "s1", 360) for i in range(5)] + [(600, texts[0] + " mail a@b.co", "en", "s0", 1), (700, texts[1], "en", "s2", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "personal data", "source mix", "packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r["doc_id"] for r in seen["quality"]}
    assert not kept & {500, 501, 502, 503, 504} and len(kept & set(range(120))) >= 115
    label, _ = brute.groups({r["doc_id"]: r["text"] for r in seen["quality"]}, 5, 80)
    assert {r["doc_id"] for r in seen["near-duplicates"]} == set(label.values())
    assert not any("@" in r["text"] for r in seen["personal data"]) and all(r["n_chars"] == len(r["text"]) for r in seen["personal data"])
    sizes = {}
    for r in seen["personal data"]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    want, got = brute.targets(sizes), dict.fromkeys(sizes, 0)
    for r in seen["source mix"]:
        got[r["source"]] += len(brute.words(r["text"]))
    assert all(abs(got[s] - float(want[s])) <= 100 for s in sizes)
    own = packing.encoder("byte_bpe_50k")
    tokens = sum(len(own.ids(r["text"])) // 4 + 1 for r in seen["source mix"])
    assert sum(r["length"] for r in seen["packing"]) == tokens == sum(len(np.frombuffer(r["ids"], "<u4")) for r in seen["packing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == tokens


ODD = "doc_id long, text string, lang string, source string, n_chars long, perplexity double, kept_id long, size string, row string, spans string, `_text` int, label string"


def test_stages_with_nulls_repeats_and_clashing_names(spark, tmp_path):
    texts = some_texts(60, 21)
    extra = (0.5, 1, "s", "r", "p", 3, "l")
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 5 else None, len(t), *extra) for i, t in enumerate(texts)]
    rows += [(100, None, None, "s1", None, *extra), (101, "", None, None, 0, *extra), (None, texts[0], None, "s1", 9, *extra), (None, None, None, None, None, *[None] * 7)]
    rows += [(102, "word mail a@b.co " * 60_000, "xx", "s2", 5, *extra), rows[3], rows[3], (104, texts[4], "en", "s1", 3, *extra)]
    spark.createDataFrame(rows, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(50)] + [(51, None, None), (None, 1, 0), (3, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
        assert docs.columns == columns or k == 4
    ids = lambda name: sorted((r["doc_id"] for r in seen[name]), key=repr)
    assert {100, 101, 102, None} <= set(ids("quality")) and ids("quality").count(None) == 2
    known = [d for d in ids("near-duplicates") if d is not None]
    label, _ = brute.groups({r["doc_id"]: r["text"] for r in seen["quality"] if r["doc_id"] is not None}, 5, 80)
    assert known == sorted(set(label.values()), key=repr) and ids("near-duplicates").count(None) == 2 and 104 not in known
    long_text = next(r for r in seen["personal data"] if r["doc_id"] == 102)
    assert long_text["text"] == "word mail [EMAIL] " * 60_000 and long_text["n_chars"] == len(long_text["text"]) and long_text["_text"] == 3
    assert next(r for r in seen["personal data"] if r["doc_id"] == 100)["text"] is None
    assert not {100, 101} & set(ids("source mix")) and {r["spans"] for r in seen["source mix"]} == {"p"}
    assert {r["doc_id"] for r in seen["packing"]} == set(ids("source mix"))


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], ODD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_in_other_scripts(spark):
    """Random strings of a script beside clean text in it, and a Latin majority."""
    import random

    from dataward.llm import quality

    rng = random.Random(9)
    words = ["привет", "мир", "слово", "книга", "вода", "город", "река", "земля", "солнце", "дорога"]
    latin = ["river", "stone", "water", "house", "garden", "window"]
    clean = [(i, " ".join(rng.choice(words) for _ in range(40)), "ru") for i in range(200)] + [(1000 + i, " ".join(rng.choice(latin) for _ in range(40)), "en") for i in range(600)]
    junk = [(5000 + i, "".join(rng.choice("абвгдежзиклмнопрстуфхц ") for _ in range(240)), "ru") for i in range(40)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in clean if i % 2], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.judged(docs, labels).collect()}
    assert not any(got[i] for i, _, _ in junk) and sum(got[i] for i, _, _ in clean) >= 0.98 * len(clean)
    marked = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, None), (4, 0, 0), (None, 1, 0), (5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"] for r in quality.trusted_ids(marked).collect()} == {1, 3} and quality.trusted_ids(marked.drop("toxic")).count() == 3
