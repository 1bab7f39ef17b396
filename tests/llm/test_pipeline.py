import random

import corpus_pipeline
from pyspark.sql import functions as F

from . import cases


def corpus(spark, tmp_path):
    rng = random.Random(12)
    passage = cases.prose(rng, 55, 3000)
    texts = [cases.prose(rng, rng.randrange(60, 200), 3000) for _ in range(60)]
    texts[5], texts[6] = texts[4], None
    texts[7] = "12 ?? 99"
    for i in range(20, 30):
        texts[i] += " " + passage
    w = texts[10].split()
    w[30] = "other"
    texts[11] = " ".join(w)
    docs = spark.createDataFrame([(i, t, "en" if i % 4 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], cases.DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return texts


def test_stages_in_order(spark, tmp_path):
    texts = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: {r["doc_id"] for r in d.select("doc_id").distinct().collect()} for n, d in seen.items()}
    assert ids["language_id"] == set(range(60)) - {6, 7}
    assert ids["near_copies"] == ids["language_id"] - {5, 11}
    want = cases.without_repeats({i: cases.words(texts[i]) for i in ids["near_copies"]}, 20)
    assert {r["doc_id"]: r["text"].encode().split() for r in seen["passages"].collect()} == {i: w[3] for i, w in want.items() if w[3]}
    size = lambda d: d.select(F.sum(F.size(F.split("text", r"\s+")))).first()[0]
    assert abs(size(seen["mixture"]) - size(seen["passages"])) < 0.03 * size(seen["passages"])
    rows = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda d: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in d.collect())
    assert key(rows) == key(seen["packing"])


def test_empty_corpus(spark, tmp_path):
    cases.documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_awkward_corpus(spark, tmp_path):
    cases.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_language_stage_without_languages(spark, tmp_path):
    docs = cases.documents(spark, ["some words", None, "12 ?? 99", "andere Worte"]).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r["text"] for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()) == ["andere Worte", "some words"]
