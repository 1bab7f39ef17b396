import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tessera.llm import factors, passages, suffixes

from . import cases


def check(out, texts, window):
    got = {r["id"]: (r["n_units"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.selectExpr("row.doc_id as id", "n_units", "n_removed", "n_spans", "kept").collect()}
    want = cases.without_repeats(texts, window)
    assert got == {i: (n, gone, spans, k if isinstance(k, bytes) else b" ".join(k)) for i, (n, gone, spans, k) in want.items()}


@pytest.fixture(params=["usual", "frequent", "wide"])
def paths(request, monkeypatch):
    """The same results whether keys are ordinary, found frequent by the sample, or split because they are wide."""
    if request.param == "frequent":
        monkeypatch.setattr(passages, "FREQUENT", 2)
    if request.param == "wide":
        monkeypatch.setattr(passages, "FREQUENT", 10**9)
        monkeypatch.setattr(passages, "WIDE", 1)


def test_words_against_brute_force(spark, paths):
    docs = cases.documents(spark)
    texts = {r["doc_id"]: cases.words(r["text"]) for r in docs.collect()}
    check(passages.without_repeats(docs.select("doc_id", "text"), factors.UNIT, factors.solve_block), texts, 20)


def test_bytes_against_brute_force(spark, paths):
    docs = cases.documents(spark)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    check(passages.without_repeats(docs.select("doc_id", "text"), suffixes.UNIT, suffixes.solve_block), texts, 100)


def test_many_partitions_and_batches(spark, monkeypatch):
    rng = random.Random(5)
    lines = [cases.prose(rng, 25) for _ in range(6)]
    docs = cases.documents(spark, [" ".join([cases.prose(rng, 9), *rng.sample(lines, 3), cases.prose(rng, 9)]) for _ in range(150)])
    texts = {r["doc_id"]: cases.words(r["text"]) for r in docs.collect()}
    check(passages.without_repeats(docs.repartition(7).select("doc_id", "text"), factors.UNIT, factors.solve_block), texts, 20)
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    check(passages.without_repeats(docs.repartition(7).select("doc_id", "text"), suffixes.UNIT, suffixes.solve_block), texts, 100)


@pytest.mark.parametrize("module", [factors, suffixes])
def test_empty_repeated_rows_and_null_ids(spark, module):
    empty = passages.without_repeats(cases.documents(spark, []).select("doc_id", "text"), module.UNIT, module.solve_block)
    assert empty.count() == 0
    text = cases.prose(random.Random(1), 80)
    rows = [(1, text), (1, text), (1, text + " more"), (None, text), (2, text)]
    out = passages.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), module.UNIT, module.solve_block)
    removed = sorted((r["i"] is not None, r["i"] or 0, r["n_removed"] > 0) for r in out.selectExpr("row.doc_id as i", "n_removed").collect())
    # the null id comes first and keeps its text; all rows after it lose theirs
    assert removed == [(False, 0, False), (True, 1, True), (True, 1, True), (True, 1, True), (True, 2, True)]
    twins = passages.without_repeats(spark.createDataFrame(rows[:2], "doc_id long, text string"), module.UNIT, module.solve_block)
    assert [r["n_removed"] for r in twins.collect()] == [0, 0]


def test_stage_keeps_columns_and_clean_texts(spark):
    docs = cases.with_clashes(cases.documents(spark))
    out = factors.remove_repeated_passages(docs)
    assert out.columns == docs.columns
    want = cases.without_repeats({r["doc_id"]: cases.words(r["text"]) for r in docs.collect()}, 20)
    before = {r["doc_id"]: r for r in docs.collect()}
    after = {r["doc_id"]: r for r in out.collect()}
    assert set(after) == {i for i, w in want.items() if w[1] < w[0] or not w[0]}
    for i, r in after.items():
        assert r["row"] == "own row"
        assert r["text"] == (before[i]["text"] if not want[i][1] else b" ".join(want[i][3]).decode())
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(8, 40))
def test_suffix_order(data, depth):
    order = suffixes.suffix_order(data, depth).tolist()
    assert sorted(order) == list(range(len(data)))
    cut = [data[i : i + depth] for i in order]
    assert cut == sorted(cut)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=4, max_size=30), max_size=6))
def test_factors(texts):
    reference, seen = {}, set()
    for t in texts:
        got = factors.factor(t, reference, 4)
        want = []
        for i in range(len(t) - 3):
            want.append(tuple(t[i : i + 4]) in seen)
            seen.add(tuple(t[i : i + 4]))
        assert got == want


def test_range_hashes():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 2**63, 50).astype(np.uint64)
    both = np.concatenate([v, v])
    sums = passages.Sums(both)
    i = np.arange(40)
    assert (sums.of(i, i + 10) == sums.of(i + 50, i + 60)).all()
    assert len(np.unique(sums.of(i, i + 10))) == 40


def test_long_documents_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    part = cases.prose(rng, 300)
    docs = cases.documents(spark, [cases.prose(rng, 3000) + " " + part, part + " " + cases.prose(rng, 3000)])
    monkeypatch.setattr(passages, "PIECE", 64)
    assert passages.segments(factors.UNIT, [cases.words(part)], np.array([0]), np.empty(0, np.uint64))[2].sum() == 281
    check(passages.without_repeats(docs.select("doc_id", "text"), factors.UNIT, factors.solve_block), {r["doc_id"]: cases.words(r["text"]) for r in docs.collect()}, 20)


@pytest.mark.parametrize("name", ["op3_suffix_dedup", "op5_factor_dedup"])
def test_queries_against_sql(spark, tmp_path, name):
    """Whole queries, with their columns and names, on the awkward texts."""
    import duckdb
    from tessera.llm import registry

    cases.documents(spark).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.QUERIES[name](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = duck.execute(registry.SQL[name])
    assert [d[0] for d in cursor.description] == out.columns
    rows = cursor.fetchall()
    assert any(r[2] for r in rows) and sorted(map(tuple, out.collect())) == sorted(rows)
