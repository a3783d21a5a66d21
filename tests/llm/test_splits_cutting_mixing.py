import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import components, cutting, mixing


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def edge_frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def test_components_of_random_and_long_graphs(spark):
    random = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 300, (200, 2)) if a != b]
    edges += [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5000 + i) for i in range(1, 150)]
    got = {r.node: r.root for r in components.contract(edge_frame(spark, edges + edges[:5] + [(7, 7), (None, 3)])).collect()}
    assert got == union_find(edges)
    assert components.contract(edge_frame(spark, [])) is None


def test_incremental_equals_at_once(spark):
    edges = [(1, 2), (3, 4), (5, 6), (8, 9)]
    later = [(2, 3), (6, 10), (11, 12), (4, 1)]
    known = components.update_components(None, edge_frame(spark, edges))
    now = {r.node: r.root for r in components.update_components(known, edge_frame(spark, later)).collect()}
    assert now == union_find(edges + later)


def papers(spark, rows):
    return spark.createDataFrame(rows, "paper_id string, authors array<string>")


QUESTION = "case_id string, cluster_id string, gold_locator struct<paper_id:string>, negative_evidence struct<paper_id:string>, created_at timestamp_ntz, record_id string, paper string"
PROFILE = "profile_id string, gold_paper_id string, constraint_pair string, created_at timestamp_ntz, pair string"


def test_groups_by_paper_pair_and_author(spark):
    q = spark.createDataFrame([
        ("q1", " P2 ", None, None, None, "clash", "clash"), ("q1", " P2 ", None, None, None, "clash", "clash"), ("q2", "", ("p3",), None, None, None, None), ("q3", None, None, ("zz",), None, None, None),
        ("q4", None, None, None, None, None, None), (None, "p1", None, None, None, None, None), ("q5", "p9", None, None, None, None, None),
    ], QUESTION)
    p = spark.createDataFrame([("f1", None, "Pair-A", None, None), ("f2", "p9", "pair-a", None, None), ("f3", None, None, None, None), ("f4", None, "pair-lonely", None, None)], PROFILE)
    pap = papers(spark, [("p1", ["Ann Lee", "et al."]), ("p2", ["  ánn-lee. "]), ("p3", ["A. Lee", "ET AL", "n/a", None, "-"]), ("p9", ["Click to View"]), ("p4", None)])
    got, _ = components.records_with_groups(q, p, pap)
    got = {r.record_id: r.group_key for r in got.collect()}
    assert got == {"q1": "p1", "q2": "p3", "q3": "zz", "q4": None, "q5": "p9", "f1": "p9", "f2": "p9", "f3": None, "f4": None}


def test_versions_outlive_the_session(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    q1 = spark.createDataFrame([("q1", "p1", None, None, None, None, None), ("q2", "p2", None, None, None, None, None)], QUESTION)
    none = spark.createDataFrame([], PROFILE)
    targets = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split_name string, target_share double")
    first = {r.record_id: r.split for r in components.update_splits(components.Store(spark, folder), q1, none, papers(spark, [("p1", ["A B"]), ("p2", ["C D"])]), targets).collect()}
    assert sorted(first.values()) == ["test", "train"]
    # another session knows nothing but the folder
    other = spark.newSession()
    store = components.Store(other, folder)
    assert store.versions() == [1] and store.load("components").sparkSession is other
    move = lambda df: other.createDataFrame(df.collect(), df.schema)
    q2 = q1.union(spark.createDataFrame([("q3", "p3", None, None, None, None, None)], QUESTION))
    tied = papers(spark, [("p1", ["A B"]), ("p2", ["C D"]), ("p3", ["C D"])])
    second = {r.record_id: (r.split, r.status) for r in components.update_splits(store, move(q2), move(none), move(tied), move(targets)).collect()}
    assert second == {"q1": (first["q1"], "kept"), "q2": (first["q2"], "kept"), "q3": (first["q2"], "kept")}
    merged = papers(spark, [("p1", ["A B"]), ("p2", ["C D", "A B"]), ("p3", ["C D"])])
    third = components.update_splits(store, move(q2), move(none), move(merged), move(targets)).collect()
    assert {(r.split, r.status) for r in third} == {(None, "quarantined")} and store.versions() == [1, 2, 3]
    assert {r.split for r in store.load("splits", 1).collect()} == {"test", "train"}
    # a version that was not finished does not count
    (tmp_path / "store" / "v0000004").mkdir()
    assert store.versions() == [1, 2, 3]


def test_empty_tables(spark):
    q, p = spark.createDataFrame([], QUESTION), spark.createDataFrame([], PROFILE)
    groups, table = components.records_with_groups(q, p, papers(spark, []))
    assert groups.count() == 0 and table is None


def test_splits_fill_deficits_and_keep_components_whole(spark):
    sizes = spark.createDataFrame([(i, 1 + (i % 3)) for i in range(900)] + [(5000, 400)], "root long, records long")
    targets = spark.createDataFrame([("train", 0.8), ("dev", 0.1), ("test", 0.1)], "split_name string, target_share double")
    got = components.assign_splits(sizes, targets).collect()
    total = sum(r.records for r in got)
    share = {s: sum(r.records for r in got if r.split == s) / total for s in ("train", "dev", "test")}
    assert len(got) == 901 and all(abs(share[s] - w) < 0.02 for s, w in (("train", 0.8), ("dev", 0.1), ("test", 0.1)))


def test_prior_splits_stay_and_conflicts_are_quarantined(spark):
    sizes = spark.createDataFrame([(1, 5), (2, 5), (3, 90)], "root long, records long")
    targets = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split_name string, target_share double")
    prior = spark.createDataFrame([(1, "test"), (2, "train"), (2, "test")], "root long, split string")
    got = {r.root: (r.split, r.status) for r in components.assign_splits(sizes, targets, prior).collect()}
    assert got[1] == ("test", "kept") and got[2] == (None, "quarantined") and got[3][1] == "new"


# --- cutting ----------------------------------------------------------------

texts = st.lists(st.sampled_from(["word", "a", "Ende.", "so?", "\n\n", "\n \t\n", " ", "\r\n", "x" * 60, "é" * 9]), max_size=60).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(30, 80), st.integers(0, 20))
def test_pieces_keep_the_limit_and_all_text(text, limit, overlap):
    pieces = cutting.bisect(text, limit, overlap)
    assert all(0 < len(p) <= limit for p in pieces)
    flat = "".join(text.split())
    at = 0
    for p in pieces:
        p = "".join(p.split())
        k = max((k for k in range(max(0, at - len(p)), at + 1) if flat[k : k + len(p)] == p), default=None)
        assert k is not None
        at = max(at, k + len(p))
    assert at == len(flat)


def test_strongest_boundary_near_the_middle_wins():
    text = "A" * 20 + " b" * 10 + ".\n\n" + "c " * 22
    assert cutting.bisect(text, 60, 0)[0] == "A" * 20 + " b" * 10 + "."


def test_kinds_of_boundaries():
    para, sent, word, none = "x" * 15 + "\n \n" + "y" * 15, "x" * 15 + ". " + "y" * 15, "x" * 15 + " " + "y" * 15, "x" * 31
    assert [cutting.weakest_needed(t, 20) for t in (para, sent, word, none)] == ["paragraph", "sentence", "word", "none"]
    assert cutting.weakest_needed("x" * 15 + "\r\n\r\n" + "y" * 15, 20) == "paragraph"


def test_split_long_rows(spark):
    df = spark.createDataFrame([("p", 1, "z " * 40, "clash"), ("p", 2, None, None), ("p", 3, " \n", None), ("q", 1, "short", None)], "paper_id string, page_number int, text string, piece string")
    got = cutting.split_long(df, ["paper_id", "page_number"], "text", 30, 10).collect()
    assert {(r.paper_id, r.page_number) for r in got} == {("p", 1), ("q", 1)}
    assert [r.piece_no for r in got if r.paper_id == "p"] == list(range(1, sum(r.paper_id == "p" for r in got) + 1))
    assert {r.boundary for r in got if r.paper_id == "p"} == {"word"} and {r.boundary for r in got if r.paper_id == "q"} == {None}
    assert cutting.split_long(df.limit(0), ["paper_id", "page_number"], "text").count() == 0


# --- mixing -----------------------------------------------------------------


def test_mixture_reaches_its_shares(spark):
    docs = spark.createDataFrame([(i, "big" if i % 3 else "small", 50 + i % 7) for i in range(3000)] + [(9001, None, 5), (9002, "other", 7), (9003, "big", 0), (9004, "big", None)], "doc_id long, source_name string, tokens int")
    targets = spark.createDataFrame([("big", 0.25, 2), ("small", 0.5, 3), ("none", 0.25, 9)], "source_name string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(docs, targets)
    got = {r.source_name: r for r in shares.collect()}
    assert abs(got["big"].actual_share - 1 / 3) < 0.01 and abs(got["small"].actual_share - 2 / 3) < 0.01 and got["none"].actual_share == 0
    rows = chosen.collect()
    assert len(rows) == len({r.doc_id for r in rows}) and max(r.repeats for r in rows if r.source_name == "small") <= 3
    assert sum(r.tokens * r.repeats for r in rows) == got["big"].mixed_tokens + got["small"].mixed_tokens


def test_places_interleave_the_sources_evenly(spark):
    docs = spark.createDataFrame([(i, "big" if i % 3 else "small", 50 + i % 7) for i in range(3000)], "doc_id long, source_name string, tokens int")
    targets = spark.createDataFrame([("big", 0.25, 2), ("small", 0.5, 3)], "source_name string, target_share double, max_repeats int")
    rows = mixing.mix(docs, targets, slots=600)[0].collect()
    uses = sorted((p.slot, p.offset, r.source_name, r.tokens) for r in rows for p in r.places)
    assert len(uses) == sum(r.repeats for r in rows) and len({(s, o, n) for s, o, n, _ in uses}) == len(uses)
    # every tenth of the mixture has the shares of the whole
    for lo in range(0, 600, 60):
        part = [u for u in uses if lo <= u[0] < lo + 60]
        share = sum(t for _, _, n, t in part if n == "small") / sum(t for *_, t in part)
        assert abs(share - 2 / 3) < 0.05
    # a slot holds one source
    assert len({(s, n) for s, _, n, _ in uses}) == len({s for s, *_ in uses})


def test_a_tiny_share_gets_slots_and_runs_agree(spark):
    docs = spark.createDataFrame([(i, "a", 10) for i in range(50)] + [(i, "b", 10) for i in range(50, 6000)], "doc_id long, source_name string, tokens int")
    targets = spark.createDataFrame([("a", 0.0001, 1), ("b", 0.9999, 1)], "source_name string, target_share double, max_repeats int")
    got = {r.source_name: r.mixed_tokens for r in mixing.mix(docs, targets)[1].collect()}
    assert got["a"] > 0 and got["b"] > 59_000
    whole = {tuple(r) for r in mixing.schedule(spark, [("x", 0.3), ("y", 1.0)], 1000).collect()}
    assert whole == {tuple(r) for r in mixing.schedule(spark, [("x", 0.3), ("y", 1.0)], 1000, run=64).collect()} and len(whole) == 1000


def test_mixture_never_passes_the_repeats(spark):
    docs = spark.createDataFrame([(1, "a", 10), (2, "b", 1000)], "doc_id long, source_name string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source_name string, target_share double, max_repeats int")
    rows = {r.doc_id: r.repeats for r in mixing.mix(docs, targets, total=5000)[0].collect()}
    assert rows.get(1, 0) <= 2 and rows.get(2, 0) <= 1


def test_mixture_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source_name string, tokens int")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source_name string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(docs, targets)
    assert chosen.count() == 0 and [(r.source_name, r.actual_share) for r in shares.collect()] == [("a", 0.0)]
