import pytest
import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.words import words
from lectern.operators import search as S
from lectern.operators.chunking import pack


def one(spark, text, *cols):
    return tuple(spark.createDataFrame([(text,)], "t string").select(*cols).first())


def test_tokens_drop_stop_words_and_short_ones(spark):
    assert one(spark, "The RAG of a Paper, x2 and Ümlaut", X.tokens(F.col("t")))[0] == ["rag", "of", "x2", "mlaut"]
    assert one(spark, None, X.tokens(F.col("t")))[0] == []


def test_sentences_cut_before_capitals(spark):
    assert one(spark, "One is  1. two stays. Three!\nFour?", X.sentences(F.col("t")))[0] == ["One is 1. two stays.", "Three!", "Four?"]


def test_section_aliases(spark):
    got = [one(spark, h, X.section_of(F.col("t")))[0] for h in ("3. Related  Work:", "IV) CONCLUSIONS", "Methods & Tools", "results", "no heading")]
    assert got == ["Literature Review", "Conclusion", None, "Results", None]


def test_expansions_follow_phrase_bounds(spark):
    got = one(spark, "rag for crops in draggers", X.expansions(F.col("t")))[0]
    assert "grounded generation" in got and "agriculture" in got and one(spark, "dragging", X.expansions(F.col("t")))[0] == []


def test_occurrences_do_not_overlap(spark):
    assert one(spark, "aaaa", X.occurrences(F.col("t"), "aa"))[0] == 2


def test_words_fold_accents_and_forms():
    assert words("Kàià-Gipekugàrn. ﬁne ①") == ["kaia", "gipekugarn", "fine", "1"]
    assert words(None) == []


def test_bm25_prefers_rare_terms_and_ties_by_id(spark):
    docs = spark.createDataFrame([(1, "cloud cloud sky"), (2, "cloud rain"), (3, "cloud rain"), (4, None), (5, "")], "doc_id long, text string")
    q = spark.createDataFrame([("q", "rain cloud"), ("none", "of the")], "query_id string, query string")
    got = [(r.query_id, r.doc_id, r["rank"]) for r in S.bm25(docs, q, 10).orderBy("rank").collect()]
    assert got == [("q", 2, 1), ("q", 3, 2), ("q", 1, 3)]


def test_coverage_matches_its_formula(spark):
    docs = spark.createDataFrame([(1, "rain and rain"), (2, "sun")], "doc_id long, text string")
    q = spark.createDataFrame([("q", "rain tide")], "query_id string, query string")
    (r,) = S.coverage(docs, q, 5).collect()
    assert r.doc_id == 1 and r.score == 1.0
    long = spark.createDataFrame([(1, "rain " + "x " * 99)], "doc_id long, text string")
    assert math.isclose(S.coverage(long, q, 5).first()["score"], 1 / 100 * 30 + 0.3)


def test_feature_hashes_are_unit(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "")], "doc_id long, text string")
    got = S.feature_hashes(docs).collect()
    assert {r.doc_id for r in got} == {1} and math.isclose(sum(r.weight**2 for r in got), 1, abs_tol=1e-5)


def test_exact_nearest_matches_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(0).standard_normal((60, 8))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)] + [(99, None), (98, [0.0] * 8), (97, [1.0])], "id long, v array<double>")
    got = {}
    for r in S.exact_nearest(v, v.where("id % 7 = 0"), 3, "id", "v", block=16).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 60, 7):
        cos = np.round(unit @ unit[i], 6)
        cos[i] = -9
        assert [n for _, n in sorted(got[i])] == list(np.lexsort((np.arange(60), -cos))[:3])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ", min_size=1, max_size=30).map(lambda s: s.strip() or "x"), max_size=30))
def test_chunks_cover_all_sentences(units):
    parts = pack(units, words=12, chars=60, overlap=4, least=10)
    covered = sorted({i for a, b in parts for i in range(a, b)})
    assert covered == list(range(len(units)))
    assert all(a < b for a, b in parts) and all(x[0] < y[0] for x, y in zip(parts, parts[1:]))


def test_index_is_kept_and_agrees_with_the_plain_search(spark, tmp_path):
    from lectern.operators import indexes as I

    rows = [(1, "red fox and blue whale"), (2, "blue whale blue whale"), (3, None), (4, ""), (5, "a green fox"), (6, "fox fox fox")]
    path = f"{tmp_path}/docs"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    q = spark.createDataFrame([("a", "fox"), ("b", "blue whale"), ("c", "nothing here"), ("d", None)], "query_id string, query string")
    index = I.of(docs)
    plain = sorted(map(tuple, S.bm25(docs, q, 3).collect()))
    assert sorted(map(tuple, I.bm25(index, q, 3).collect())) == plain == sorted(map(tuple, I.bm25(index, q, 3, small=0).collect()))
    assert I.of(docs).postings.inputFiles() == index.postings.inputFiles()
    # a filter comes before the limit, and rarity stays that of all texts
    some = I.bm25(index, q, 1, among=docs.where("doc_id in (1, 5)").select("doc_id")).where("query_id = 'a'").collect()
    whole = {r.doc_id: r.score for r in I.bm25(index, q, None).where("query_id = 'a'").collect()}
    assert len(some) == 1 and some[0].score == whole[some[0].doc_id] and some[0].doc_id in (1, 5)
    # other files are another version
    spark.createDataFrame(rows[:2], "doc_id long, text string").write.mode("overwrite").parquet(path)
    fresh = I.of(spark.read.parquet(path))
    assert fresh.totals.first().docs == 2
    with pytest.raises(ValueError):
        I.load(spark, f"{tmp_path}/none")


def test_index_of_nothing(spark, tmp_path):
    from lectern.operators import indexes as I

    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none")
    q = spark.createDataFrame([("a", "fox")], "query_id string, query string")
    assert I.bm25(I.of(spark.read.parquet(f"{tmp_path}/none")), q, 3).count() == 0


def test_phrases_are_whole_tokens(spark):
    t = spark.createDataFrame([("Data-Driven  design",), ("undata driven",), ("data\ndriven!",), (None,)], "t string")
    assert [r[0] for r in t.select(X.has_phrase(F.col("t"), "data-driven")).collect()] == [True, False, True, None]
