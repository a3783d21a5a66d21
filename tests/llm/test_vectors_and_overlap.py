import numpy as np
import pytest

from lectern.functions.words import words
from lectern.llm import hnsw, neighbours, overlap


def clustered(n, dim, clusters, seed=0):
    random = np.random.default_rng(seed)
    centres = hnsw.unit(random.standard_normal((clusters, dim)))
    tight = hnsw.unit(centres[random.integers(0, clusters, n // 2)] + 0.06 * random.standard_normal((n // 2, dim)))
    return np.concatenate([tight, hnsw.unit(random.standard_normal((n - n // 2, dim)))]).astype(np.float32)


def exact(x, k):
    s = hnsw.unit(x) @ hnsw.unit(x).T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


def test_graph_finds_what_brute_force_finds():
    x = clustered(1500, 32, 40)
    graph = hnsw.build(x, degree=16, width=64)
    near, _ = exact(x, 10)
    found, _ = hnsw.search(graph, x, width=64)
    hits = [len(set(f[f != i][:10]) & set(t)) for i, (f, t) in enumerate(zip(found, near))]
    assert np.mean(hits) / 10 >= 0.9
    assert len(graph.levels) > 1 and graph.levels[0][1].shape[1] == 32


@pytest.mark.parametrize("n", [0, 1, 2, 3, 65])
def test_graph_of_few_points(n):
    x = hnsw.unit(np.random.default_rng(1).standard_normal((n, 8)))
    graph = hnsw.build(x)
    ids, sims = hnsw.search(graph, x, width=8) if n else (np.zeros((0, 8)), None)
    assert len(ids) == n and all(i in set(row) for i, row in enumerate(ids))


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, dim int, vector array<float>, rank string, cosine string, neighbour string")


def test_pairs_match_brute_force_over_shards(spark):
    x = clustered(1200, 48, 30)
    rows = [(f"v{i:04d}", 48, [float(a) for a in v], "x", "y", "z") for i, v in enumerate(x)]
    rows += rows[:40]  # repeats
    rows += [(f"w{i}", 48, [float(a) * 3 for a in x[i]], None, None, None) for i in range(20)]  # other lengths
    v = frame(spark, rows)
    got = {(r[0], r[1]) for r in neighbours.similar_pairs(v, 0.65, shard_rows=300, sample=600).collect()}
    truth = neighbours.brute_force(v, v).where("cosine >= 0.65").collect()
    want = {(min(r.id, r.neighbour), max(r.id, r.neighbour)) for r in truth}
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95


def test_pairs_among_many_unlike_vectors_in_many_cells(spark):
    """Few vectors are alike and the samples of centroids hardly see them, as in
    large tables: a pair is often cut by the border of two cells."""
    random = np.random.default_rng(11)
    rest, one = (hnsw.unit(random.standard_normal((n, 64))) for n in (3000, 500))
    two = hnsw.unit(one + 0.5 / 8 * random.standard_normal(one.shape))
    x = np.concatenate([rest, one, two]).astype(np.float32)
    v = spark.createDataFrame([(f"v{i:04d}", 64, [float(a) for a in r]) for i, r in enumerate(x)], "id string, dim int, vector array<float>")
    got = {(r[0], r[1]) for r in neighbours.similar_pairs(v, 0.65, shard_rows=64, sample=400).collect()}
    want = {(f"v{3000 + i:04d}", f"v{3500 + i:04d}") for i in range(500)}
    assert len(got & want) >= 0.97 * len(want)


def test_packed_rows_keep_their_directions():
    random = np.random.default_rng(13)
    whole = random.integers(-127, 128, (50, 6)) / 512
    for x in (whole, random.standard_normal((50, 6)), np.concatenate([whole, random.standard_normal((50, 6))]), [[1e-40, 0, 0]], [[128, 1, -128]], np.zeros((0, 6))):
        x = np.asarray(x, dtype=np.float32)
        y = neighbours._unpack(neighbours._pack(x), x.shape[1]).astype(np.float32)
        assert np.abs(hnsw.unit(y) - hnsw.unit(x)).max(initial=0) < 1e-3
    assert {len(p) for p in neighbours._pack(whole.astype(np.float32))} == {7}


def test_hot_copies_and_dirty_vectors(spark):
    same = [1.0, 0.0, 0.0, 0.5]
    rows = [(f"c{i:03d}", 4, same, None, None, None) for i in range(300)]
    rows += [("null", 4, None, None, None, None), ("zero", 4, [0.0] * 4, None, None, None), ("short", 4, [1.0], None, None, None), ("nan", 4, [float("nan")] * 4, None, None, None), (None, 4, same, None, None, None)]
    rows += [("alone", 3, [1.0, 0.0, 0.0], None, None, None), ("empty", 0, [], None, None, None), ("far", 4, [0.0, 1.0, 0.0, 0.0], None, None, None)]
    got = {}
    for r in neighbours.most_similar(frame(spark, rows), min_cosine=0.5, shard_rows=50).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour, r.cosine))
    assert set(got) == {f"c{i:03d}" for i in range(300)}
    assert all(len(v) == 10 and all(abs(c - 1) < 1e-5 for _, _, c in v) for v in got.values())


def test_a_vector_repeated_100000_times(spark):
    """Neither ids of one vector nor repeats of one id gather in a task."""
    from pyspark.sql import functions as F

    same = F.array(*[F.lit(float(x)).cast("float") for x in (1, 2, 3, 4)])
    hot = spark.range(100_000).select(F.format_string("c%06d", "id").alias("id"), F.lit(4).alias("dim"), same.alias("vector"))
    one = spark.range(50_000).select(F.lit("one").alias("id"), F.lit(4).alias("dim"), F.transform(same, lambda x: -x).alias("vector"))
    random = np.random.default_rng(2)
    rest = spark.createDataFrame([(f"r{i}", 4, [float(a) for a in random.standard_normal(4)]) for i in range(2000)], "id string, dim int, vector array<float>")
    got = neighbours.most_similar(hot.union(one).union(rest), k=3, shard_rows=200, few=10).where("id like 'c%' or id = 'one'")
    per = got.groupBy("id").agg(F.count("*").alias("n"), F.min("cosine").alias("c"))
    assert per.count() == 100_001 and per.where("n <> 3").count() == 0 and per.where("id <> 'one' and c < 0.99999").count() == 0
    assert {r.neighbour for r in got.where("id = 'c000001'").collect()} == {"c000000", "c000002", "c000003"}


def test_cells_are_divided_and_hubs_asked_in_blocks(spark):
    """Half of the vectors in one dense cluster, shards far smaller than it."""
    random = np.random.default_rng(8)
    dense = hnsw.unit(np.ones((1, 24)) + 0.4 * random.standard_normal((1000, 24)))
    x = np.concatenate([dense, clustered(1000, 24, 20, 3)]).astype(np.float32)
    v = spark.createDataFrame([(f"v{i:04d}", 24, [float(a) for a in r]) for i, r in enumerate(x)], "id string, dim int, vector array<float>")
    rows = neighbours._sized(v)
    centres = neighbours._fit(rows, {24: np.zeros((1, 24), np.float32)}, {(24, 0): (4, 1.0)}, 2000, 1)
    assert len(centres[24]) == 4
    finer = neighbours._fit(rows, centres, {(24, 0): (5, 1.0)}, 2000, 1)
    assert len(finer[24]) == 8
    got = {(r[0], r[1]) for r in neighbours.most_similar(v, shard_rows=100, sample=600, degree=12, width=32).where("rank <= 10 and cosine >= 0.75").collect()}
    near, sims = exact(x, 10)
    want = {(f"v{i:04d}", f"v{j:04d}") for i in range(len(x)) for j in near[i] if sims[i, j] >= 0.75}
    assert len(got & want) >= 0.6 * len(want)


def test_ties_go_to_smaller_ids_within_a_shard(spark):
    rows = [(f"c{i:02d}", 2, [1.0, 1.0], None, None, None) for i in range(15)]
    got = {}
    for r in neighbours.most_similar(frame(spark, rows)).collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert sorted(got["c14"]) == [f"c{i:02d}" for i in range(10)]


def test_empty_vectors(spark):
    assert neighbours.similar_pairs(frame(spark, [])).count() == 0


# --- overlaps ---------------------------------------------------------------


def brute(rows, threshold=0.7):
    once = {(s, i): (sp.strip().lower(), t) for s, i, sp, t in rows if sp and sp.strip() and i and t is not None}
    out = set()
    for (s, i), (sp, t) in once.items():
        for (s2, j), (sp2, t2) in once.items():
            if s == s2 and sp == "train" != sp2 and len(words(t)) >= 4 and len(words(t2)) >= 4:
                a, b = set(words(t)), set(words(t2))
                if len(a & b) >= threshold * len(a | b) - 1e-9:
                    out.add((s, i, j))
    return out


def test_overlaps_match_brute_force(spark):
    random = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):
        base = list(random.choice(vocabulary, 12))
        rows.append(("t", f"a{i}", "Train ", " ".join(base)))
        for k in range(random.integers(0, 3)):
            other = list(base)
            for _ in range(random.integers(0, 4)):
                other[random.integers(0, 12)] = f"x{random.integers(0, 9999)}"
            random.shuffle(other)
            rows.append(("t" if k else "u", f"b{i}-{k}", ["dev", "TEST", None, " "][random.integers(0, 4)], ", ".join(other).upper()))
    rows += rows[:10] + [("t", "n", "dev", None), ("t", "e", "dev", ""), ("t", "s", "dev", "w1 w2"), ("t", None, "dev", "w1 w2 w3 w4"), ("t", "four", "dev", "same same same same"), ("t", "four-train", "train", "Same, same same same")]
    df = spark.createDataFrame(rows, "src string, id string, split string, text string")
    got = [(r.src, r.train_id, r.other_id) for r in overlap.cross_split_overlaps(df, frequent=3, common=40).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and ("t", "four-train", "four") in got


def test_hot_copies_expand_to_all_pairs(spark):
    rows = [("t", f"a{i}", "train", "one long question of five words") for i in range(30)] + [("t", f"b{i}", "dev", "One long QUESTION of five words!") for i in range(20)]
    df = spark.createDataFrame(rows, "src string, id string, split string, text string")
    assert overlap.cross_split_overlaps(df).count() == 600
    assert overlap.cross_split_overlaps(df.limit(0)).count() == 0


LINE = overlap.normalise("Which throughput measured parish registers across Pulanomoks and Moregevurn after 2332 samples, and what was reported for Kizivukult versus Fegopotam?")


def test_chunks_partition_the_text():
    for seed in overlap.SEEDS:
        parts = overlap.chunks(LINE, seeds=(seed,))
        assert [s for _, s, _ in parts] == [0] + [e for _, _, e in parts][:-1] and parts[-1][2] == len(LINE)
        assert 1 < len(parts) < len(LINE.split())
    assert overlap.chunks("") == [] and overlap.normalise(None) == "" == overlap.normalise("one two", 3)


def test_an_edit_moves_no_cut_outside_the_window():
    words_ = LINE.split()
    for i in range(len(words_)):
        other = " ".join([*words_[:i], "unlikely", *words_[i + 1 :]]) + " "
        at, shift = len(" ".join(words_[:i])) + (i > 0), len("unlikely") - len(words_[i])
        for seed in overlap.SEEDS:
            mine, theirs = ({e for _, _, e in overlap.chunks(x, seeds=(seed,))} for x in (LINE, other))
            after = at + len(words_[i]) + overlap.WINDOW
            assert {e for e in mine if e <= at} == {e for e in theirs if e <= at}
            assert {e + shift for e in mine if e > after} == {e for e in theirs if e > after + shift}


def test_copies_with_edits_are_found_by_chunks_alone(spark):
    """The dealt method without the finest scale: edits in place, order kept."""
    random = np.random.default_rng(9)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    name = lambda: "".join(random.choice(syllables, 4))
    rows = []
    for i in range(150):
        base = [f"what share of {random.integers(100, 9999)}", name(), "notices at", name(), "passed", name(), "checks and how did", name(), "justify clustering against", name()]
        base = " ".join(base).split()
        rows.append(("t", f"a{i}", "train", " ".join(base)))
        other = list(base)
        for at in random.choice(len(base), random.integers(0, 3), replace=False):
            other[at] = name()
        rows.append(("t", f"b{i}", "dev", " ".join(other).title()))
    df = spark.createDataFrame(rows, "src string, id string, split string, text string")
    got = {(r.src, r.train_id, r.other_id) for r in overlap.cross_split_overlaps(df, rest=False).collect()}
    want = brute(rows)
    assert got <= want and len(got) >= 0.99 * len(want) > 100


def test_fractions_are_shared_chunk_lengths(spark):
    a, b = "one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten eleven"
    df = spark.createDataFrame([("t", "a", "train", a), ("t", "b", "dev", b)], "src string, id string, split string, text string")
    (r,) = overlap.cross_split_overlaps(df).collect()
    both = sum(e - s for d, s, e in overlap.chunks(a + " ") if d in {x for x, _, _ in overlap.chunks(b + " ")})
    assert r.shared_chars == both and r.overlap_a == both / (2 * len(a + " ")) and r.overlap_b == both / (2 * len(b + " "))


@pytest.mark.parametrize("n", range(1, 40))
def test_joined_words_cover_any_allowed_overlap(n):
    text = " ".join(f"w{i}" for i in range(n)) + " "
    joined = len(overlap.first_chunks(text, {}, 1.1, rest=0.7))
    assert joined == n - int(np.ceil(0.7 * n - 1e-9)) + 1


def test_accents_and_compatibility_forms_are_folded(spark):
    rows = [("t", "a", "train", "Ein Café für ﬁne Ärzte"), ("t", "b", "dev", "ein cafe fur fine arzte")]
    df = spark.createDataFrame(rows, "src string, id string, split string, text string")
    (r,) = overlap.cross_split_overlaps(df).collect()
    assert r.similarity == 1.0 and r.overlap_a == 1.0
