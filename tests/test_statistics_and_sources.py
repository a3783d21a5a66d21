import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import answers as A
from lectern.operators import statistics as S
from lectern.session import cut, drop_cut, new_path
from lectern.sources import files


def test_wilson(spark):
    low, high = S.wilson(F.lit(8), F.lit(10))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert math.isclose(r.l, 0.4901624, abs_tol=1e-6) and math.isclose(r.h, 0.9433178, abs_tol=1e-6)
    low, _ = S.wilson(F.lit(0), F.lit(0))
    assert spark.range(1).select(low.alias("l")).first().l is None


def test_sign_flips_are_exact(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (0.0,)], "x double")
    r = S.sign_flip_test(df, "x").first()
    assert (r.pairs, r.statistic, r.p_value) == (3, 2.0, 0.25)
    assert S.sign_flip_test(df.limit(0), "x").first().p_value == 1.0


def test_bootstrap_brackets_the_mean_and_skips_nulls(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(200)] + [(999, None)], "u int, v double")
    r = S.bootstrap_mean(df, "u", "v", 100).first()
    assert r.n == 200 and r.low < r["mean"] == 4.5 < r.high
    assert S.bootstrap_mean(df.limit(0), "u", "v", 10).count() == 0


def test_threshold_sweep_counts(spark):
    df = spark.createDataFrame([(0.19, True), (0.25, True), (0.25, False), (0.70, True)], "s double, y boolean")
    got = {round(r.threshold, 2): (r.tp, r.fp, r.fn) for r in S.threshold_sweep(df, "s", "y").collect()}
    assert got[0.2] == (2, 1, 1) and got[0.25] == (2, 1, 1) and got[0.26] == (1, 0, 2) and got[0.6] == (1, 0, 2)


def test_points_need_every_group(spark):
    df = spark.sql("select 'Deep nets on CROPS' t, array(named_struct('point_id', 'a', 'groups', array(array('nets', 'x'), array('crops'))), named_struct('point_id', 'b', 'groups', array(array('nets'), array('sea')))) p")
    assert df.select(A.points_covered(F.col("p"), F.col("t")).alias("n")).first().n == 1


def test_json_array_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": "1", "v": 2}, 7, {"k": "2"}]')
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    (tmp_path / "l.jsonl").write_text('{"k": "1", "v": 1}\n\n{"k": "2", "v": 2}\n')
    assert files.read_json_lines(spark, str(tmp_path / "l.jsonl"), schema, "k").count() == 2
    (tmp_path / "d.jsonl").write_text('{"k": "1", "v": 1}\n{"k": "1", "v": 2}\n')
    with pytest.raises(Exception, match="repeated key"):
        files.read_json_lines(spark, str(tmp_path / "d.jsonl"), schema, "k").collect()
    (tmp_path / "m.jsonl").write_text("{not json\n")
    with pytest.raises(Exception, match="malformed line"):
        files.read_json_lines(spark, str(tmp_path / "m.jsonl"), schema, "k").collect()


def test_pages_keep_the_first_of_equal_titles_and_links(spark):
    html = "<article><h2>A  title</h2><p>X, Y</p><p>In 2019.</p><a href='u1'>Download</a></article><article><h2>a Title!</h2></article><article><h2>B</h2><a href='u1'>d</a></article><article><p>none</p></article>"
    df = spark.createDataFrame([("p", html), ("q", None)], "page string, body string")
    got = files.parse_pages(df, "page", "body").collect()
    assert [(r.title, r.authors, r.year, r.links) for r in got] == [("A title", "X, Y", 2019, ["u1"])]


def test_generation_is_checked(spark):
    root = new_path(spark, "g")
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    path = files.write_generation(df, root, "t")
    assert files.read_generation(spark, root, "t").count() == 2
    spark.createDataFrame([(3, "x")], "k int, v string").write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="does not match"):
        files.read_generation(spark, root, "t")


def test_evolve_adds_columns(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    assert files.evolve(spark.createDataFrame([(1,)], "a int"), schema, {"b": "new"}).first() == (1, "new")


def test_cut_reads_what_it_wrote(spark):
    t = cut(spark.range(5), "five")
    assert t.count() == 5
    drop_cut(t)


def test_drawn_permutations_agree_with_all_of_them(spark):
    rows = [(i, float(x)) for i, x in enumerate([3, 1, -1, 2, 4, -2, 1, 1, 2, -1, 3, 0])] + [(99, None)]
    df = spark.createDataFrame(rows, "u int, x double")
    exact, drawn = S.sign_flip_test(df, "x").first(), S.sign_flip_test(df, "x", 3, "u", 4000).first()
    assert drawn.pairs == exact.pairs == 11 and math.isclose(drawn.statistic, exact.statistic) and abs(drawn.p_value - exact.p_value) < 0.02
    with pytest.raises(ValueError):
        S.sign_flip_test(df, "x", 3)


def test_clusters_widen_a_paired_interval(spark):
    rows = [(f"{c}-{i}", f"c{c}", float(c % 3), 0.0) for c in range(30) for i in range(20)] + [("n", "c1", None, 1.0)]
    df = spark.createDataFrame(rows, "u string, c string, a double, b double")
    alone, tied = S.paired_bootstrap(df, "u", "a", "b", None, 300).first(), S.paired_bootstrap(df, "u", "a", "b", "c", 300).first()
    assert alone.n == tied.n == 600 and math.isclose(alone.mean, 1.0) and math.isclose(tied.mean, 1.0)
    assert tied.low < alone.low < 1 < alone.high < tied.high
    assert S.paired_bootstrap(df.limit(0), "u", "a", "b", None, 10).count() == 0


def test_ranked_metrics_of_known_cases(spark):
    run = spark.createDataFrame([("q1", "a", 1), ("q1", "x", 2), ("q1", "b", 3), ("q2", "x", 1), ("q2", "c", 2)], "q string, item string, rank int")
    judged = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 1), ("q2", "c", 1), ("q2", "d", 1), ("q3", "z", 1), ("q3", "x", 0)], "q string, item string, grade int")
    got = {(r.q, r.k): r for r in S.ranked_metrics(run, judged, "q", "item", (1, 3)).collect()}
    two = [got["q1", 3], got["q2", 3]]
    mean = lambda name: sum(r[name] for r in two) / 2
    assert (mean("recall"), mean("hit"), mean("precision"), mean("reciprocal_rank")) == (0.75, 1.0, 0.5, 0.75)
    assert got["q2", 1].hit == 0 and got["q2", 1].reciprocal_rank == 0 and got["q3", 3].recall == 0 == got["q3", 3].ndcg
    graded = spark.createDataFrame([("q1", "a", 2), ("q1", "b", 1)], "q string, item string, grade int")
    (r,) = S.ranked_metrics(run, graded, "q", "item", (3,)).collect()
    assert math.isclose(r.ndcg, 0.9639404333, abs_tol=1e-9)
    assert S.ranked_metrics(run.limit(0), graded, "q", "item", (3,)).first().ndcg == 0 and S.ranked_metrics(run, graded.limit(0), "q", "item").count() == 0


def test_claims_and_their_support(spark):
    text = "We measured tide gauges carefully [S1]; however small errors remained there. Rivers rose quickly again, but dams held strong waters back [2]. Short."
    df = spark.createDataFrame([("k", text, "p"), ("n", None, "p"), ("u", "Nothing known supports claims like these", "gone")], "key string, text string, cited string")
    claims = A.atomic_claims(df, "key", "text")
    assert [r.claim for r in claims.where("key = 'k'").orderBy("n").collect()] == ["We measured tide gauges carefully", "however small errors remained there", "Rivers rose quickly again", "dams held strong waters back"]
    passages = spark.createDataFrame([("p", "we measured tide gauges"), ("p", "carefully, errors remained; rivers"), (None, "dams"), ("q", "dams")], "cited string, text string")
    got = {(r.key, r.n): r.support for r in A.claim_support(claims.join(df.select("key", "cited"), "key"), passages, "key", "cited").collect()}
    assert got["k", 0] == "supported" and got["k", 2] == "unsupported" and got["u", 0] == "no_source"
