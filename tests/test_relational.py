from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import changes as C
from lectern.operators import ranking as K
from lectern.operators import relational as R


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_codes_skip_null_conditions(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "a int, b int")
    got = df.select("a", R.codes(big=F.col("b") > 3, none=F.col("b").isNull()).alias("c"))
    assert {r.a: r.c for r in got.collect()} == {1: ["none"], 2: ["big"]}


def test_value_counts_seeds_and_unknown(spark):
    df = spark.createDataFrame([("x",), ("",), (None,), ("x",)], "s string")
    assert rows(R.value_counts(df, "s", ["x", "y"])) == [("unknown", 2), ("x", 2), ("y", 0)]


def test_shared_counts_ignore_repeats(spark):
    df = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "b"), ("q", "b"), ("q", "a"), (None, "c")], "p string, e string")
    assert rows(R.shared_counts(df, "e", "p")) == [("a", "b", 2)]


def test_top_k_on_empty(spark):
    df = spark.createDataFrame([], "g string, v int")
    assert R.top_k(df, ["g"], [F.desc("v")], 2).count() == 0


def test_holm_is_monotone_and_stops(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "l string, p double")
    got = {r.l: (round(r.adjusted, 6), r.rejected) for r in K.holm(df, "p", "l").collect()}
    assert got == {"a": (0.03, True), "c": (0.06, False), "b": (0.06, False)}


def test_diversify_spreads_papers(spark):
    pool = spark.createDataFrame([("q", "p1", 0, 0.90, 1), ("q", "p1", 1, 0.89, 2), ("q", "p2", 9, 0.85, 3)], "q string, paper_id string, chunk_index int, base double, position int")
    got = [r.paper_id for r in K.diversify(pool, "q", 3).orderBy("chosen").collect()]
    assert got == ["p1", "p2", "p1"]
    plain = [r.position for r in K.diversify(pool, "q", 3, scale=0.0).orderBy("chosen").collect()]
    assert plain == [1, 2, 3]


def test_displacement_counts_absent_as_k_plus_one(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, rank int")
    b = spark.createDataFrame([("x", 2), ("z", 1)], "k string, rank int")
    assert K.displacement(a, b, "k", 2).first()["mean_displacement"] == (1 + 1 + 2) / 3


def test_classify_and_merge(spark):
    old = spark.createDataFrame([("1", "A", None), ("2", "B", "v"), ("4", "D", "w")], "k string, t string, v string")
    new = spark.createDataFrame([("1", " A ", None), ("2", "B2", None), ("3", "C", "x")], "k string, t string, v string")
    assert rows(C.classify(old, new, "k", ["t", "v"])) == [("1", "unchanged"), ("2", "changed"), ("3", "new")]
    got = {r.k: (r.t, r.v, r.state) for r in C.merge(old, new, "k", ["t", "v"], F.col("t") == "B").collect()}
    assert got["2"] == ("B", "v", "conflict") and got["3"] == ("C", "x", "inserted") and got["4"] == ("D", "w", "kept")


def test_sessions_break_at_the_gap(spark):
    df = spark.sql("select 1 u, timestamp_ntz'2024-01-01 00:00:00' t union all select 1, timestamp_ntz'2024-01-01 00:09:00' union all select 1, timestamp_ntz'2024-01-01 00:20:00'")
    assert sorted(r.n for r in K.sessions(df, "u", "t", 600).collect()) == [1, 2]


def test_scores_and_related_match_brute_force(spark):
    import random

    from lectern.operators import recommend as M

    draw = random.Random(4)
    topics, names = list("abcdef"), ["A B", "C D", "E F", "G H"]
    papers = [(f"p{i:03d}", draw.sample(topics, draw.randint(0, 3)) or None, draw.choice([None, 2001, 2004, 2005, 2020]), draw.sample(names, draw.randint(0, 2)), draw.choice([None, "v"]), draw.choice([None, "u"])) for i in range(120)]
    p = spark.createDataFrame(papers, "paper_id string, topics array<string>, pub_year int, authors array<string>, venue string, pdf_url string")
    profiles = [("x", ["a", "b", "a"], "p001"), ("y", ["c"], "p002"), ("z", [], "p003"), ("n", None, "p004"), ("w", ["q"], "p005"), ("v", ["a", "b"], "p006")]
    f = spark.createDataFrame(profiles, "profile_id string, preferred_topics array<string>, gold string")
    weights = {"topics": 0.5, "recent": 0.2, "venue": 0.1, "text": 0.2}
    want = set()
    for pid, t, _ in profiles:
        t = set(t or ())
        found = []
        for q, have, year, _, venue, url in papers:
            both = len(t & set(have or ()))
            if both:
                found.append((-round(0.5 * both / len(t) + 0.2 * max(0, min(1, ((year or 2000) - 2000) / 25)) + 0.1 * (venue is not None) + 0.2 * (url is not None), 6), q))
        want |= {(pid, q, n + 1) for n, (_, q) in enumerate(sorted(found)[:4])}
    assert {(r.profile_id, r.paper_id, r["rank"]) for r in M.score(f, p, weights, 4).collect()} == want

    got = {(r.paper_id, r.related_id): (r.score, r["rank"]) for r in M.related(p, 5).collect()}
    for a in papers:
        found = []
        for b in papers:
            if a[0] != b[0]:
                points = 3 * len(set(a[1] or ()) & set(b[1] or ())) + 2 * len(set(a[3]) & set(b[3]))
                if points:
                    found.append((-(points + (a[2] is not None and b[2] is not None and abs(a[2] - b[2]) <= 2)), b[0]))
        assert {k[1]: v for k, v in got.items() if k[0] == a[0]} == {b: (-s, n + 1) for n, (s, b) in enumerate(sorted(found)[:5])}

    wins = {r.tenths: (r.wins, r.of) for r in M.weight_wins(f, p).collect()}
    by = {q[0]: q for q in papers}
    for tenths in (0, 3, 10):
        n = m = 0
        for _, t, gold in profiles:
            t = set(t or ())
            for q in papers:
                if t and q[0] != gold and t & set(q[1] or ()):
                    value = lambda x: tenths * (len(t & set(x[1] or ())) * 1000 // len(t)) + (10 - tenths) * ((x[2] or 2000) - 2000) * 40  # noqa: B023, E731
                    n, m = n + (value(by[gold]) > value(q)), m + 1
        assert wins[tenths] == (n, m)


def test_diversity_pool_holds_all_that_can_be_chosen(spark):
    import random

    from lectern.operators import ranking as K

    draw = random.Random(7)
    rows = [("s", f"p{draw.randint(0, 9)}", i, draw.randint(0, 60) / 200) for i in range(400)]
    df = spark.createDataFrame(rows, "section string, paper_id string, chunk_index int, base double")
    whole = df.withColumn("position", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("base"), "chunk_index")))
    pick = lambda x: [(r.chunk_index, r.diversified) for r in K.diversify(x, "section", 6).orderBy("chosen").collect()]
    assert pick(K.diversity_pool(df, "section", 6)) == pick(whole)


def test_altered_rows_break_their_links(spark):
    from lectern.operators import ranking as K

    e = spark.createDataFrame([("u", i, i, f"x{i}") for i in range(6)] + [("v", 10, 10, "y")], "user string, at int, id int, what string")
    stored = K.chain(e, "user", ["at", "id"], "id", ["id", "what"])
    assert K.verify_chain(stored, e, "id", ["id", "what"]).where("not valid").count() == 0
    other = e.withColumn("what", F.when(F.col("id") == 2, "forged").otherwise(F.col("what")))
    assert sorted(r.id for r in K.verify_chain(stored, other, "id", ["id", "what"]).where("not valid").collect()) == [2, 3]
    assert sorted(r.id for r in K.verify_chain(stored, e.where("id <> 4"), "id", ["id", "what"]).where("not valid").collect()) == [4, 5]
