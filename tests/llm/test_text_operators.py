import os

import numpy as np
import pytest

from lectern.llm import encoding, quality, scans

needs_vocabulary = pytest.mark.skipif(not os.path.exists(encoding.VOCABULARY), reason="no vocabulary")
TEXTS = [
    (1, "The interview questions can't wait.  Two  spaces\n\nand\ttabs \n"), (2, ""), (3, None), (4, "日本語 и русский café   nbsp ‫ rtl"), (5, "<|endoftext|> is text"),
    (6, "word " * 3000), (7, "   "), (8, "🎉👩‍👩‍👧 emoji 12345 x9y"), (9, "The interview questions can't wait.  Two  spaces\n\nand\ttabs \n"),
]


@needs_vocabulary
@pytest.mark.parametrize("common", [200_000, 3])
def test_encoding_equals_the_tokenizer_and_decodes(spark, common):
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in TEXTS], "doc_id long, text string, word string, ids array<int>")
    got = encoding.encode(df, common=common)
    ids = {r.doc_id: r.ids for r in got.collect()}
    own = encoding._tokenizer(encoding.VOCABULARY)
    assert ids == {i: own.encode_ordinary(t or "") for i, t in TEXTS}
    back = {r.doc_id: r.text for r in encoding.decode(got).collect()}
    assert back == {i: t or "" for i, t in TEXTS}


@needs_vocabulary
def test_encoding_of_no_rows(spark):
    assert encoding.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@needs_vocabulary
def test_encoding_takes_few_bytes_at_a_time(spark, monkeypatch, tmp_path):
    whole, folder = encoding._replace, str(tmp_path)

    def noted(common, batch):
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(f"{batch.num_rows} {batch.nbytes}")
        return whole(common, batch)

    monkeypatch.setattr(encoding, "_replace", noted)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    encoding.encode(spark.range(2000).selectExpr("id as doc_id", "repeat('some words ', 1000) as text"))
    seen = [tuple(map(int, p.read_text().split())) for p in tmp_path.iterdir()]
    assert sum(n for n, _ in seen) == 2000 and max(size for _, size in seen) < 5e6
    assert spark.conf.get(name) == before


def test_rare_words_return_to_their_places():
    import pyarrow as pa

    form = pa.list_(pa.struct([("at", pa.int32()), ("nth", pa.int32()), ("ids", pa.list_(pa.int32()))]))
    rare = [[(9, 0, [0])], [(2, 3, [7, 8]), (0, 0, [5]), (1, 2, []), (0, 1, [6])], [(0, 0, [4])], []]
    rare = pa.array([[dict(zip(("at", "nth", "ids"), r)) for r in doc] for doc in rare], form)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3]), pa.array([[3] * 9, [1, 2], [], [9]], pa.list_(pa.int32())), rare], ["key", "ids", "rare"])
    got = [r for b in encoding._insert([batch.slice(1)]) for r in b.to_pylist()]
    assert got == [{"key": 1, "ids": [5, 6, 1, 2, 7, 8]}, {"key": 2, "ids": [4]}, {"key": 3, "ids": [9]}]


def test_split_words_lose_nothing(spark):
    df = spark.createDataFrame([(i, t or "") for i, t in TEXTS], "doc_id long, text string")
    assert all("".join(r.w) == r.text for r in df.select("text", encoding.split_words(df.text).alias("w")).collect())


def test_statistics_of_plain_texts(spark):
    df = spark.createDataFrame([(1, "The cat, it sat.\n- on a mat"), (2, None), (3, " \n\t"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.statistics(df).collect()}
    r = got[1]
    assert r.word_count == 8 and abs(r.mean_word_length - 20 / 8) < 1e-9 and r.punct_line_share == 0.5 and abs(r.symbol_ratio - 3 / 20) < 1e-9 and r.list_mark_share == 0.5
    assert all(got[i].word_count == 0 and got[i].common_share == 0 for i in (2, 3, 4))


def test_rules_separate_and_become_sql(spark):
    random = np.random.default_rng(0)
    n = 120
    kind = np.array(["prose"] * 60 + ["list"] * 40 + ["junk"] * 20, dtype=object)
    table = {"common_share": np.where(kind == "prose", 0.5, 0.05) + random.random(n) * 0.1, "symbol_ratio": np.where(kind == "junk", 0.6, 0.1) + random.random(n) * 0.1}
    rules = quality.best_rules(table, kind, seeds=5, columns=("common_share", "symbol_ratio"))
    assert (quality.apply_rules(rules, table) == kind).mean() >= 0.98
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(*table.values())], "common_share double, symbol_ratio double")
    assert [r.k for r in rows.selectExpr(f"{quality.case_expression(rules)} as k").collect()] == list(quality.apply_rules(rules, table))
    assert quality.case_expression([]) == "'prose'"


def test_classification_without_labels(spark):
    df = spark.createDataFrame([(1, "Some text.", "clash"), (2, " ", "clash")], "doc_id long, text string, word_count string")
    labels = spark.createDataFrame([], "doc_id long, kind string")
    got = {r.doc_id: r.kind for r in quality.classify(df, quality.learn(df, labels)).collect()}
    assert got == {1: "prose", 2: None}


def test_held_out_accuracy_on_the_project_labels(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    from lectern.session import table

    parts = []
    for d in ("sf0.001", "sf0.01"):
        t = quality.statistics(table(spark, f"/root/testdata/{d}", "documents").join(table(spark, f"/root/testdata/{d}", "doc_kind_labels"), "doc_id")).select("kind", *quality.STATISTICS).toPandas()
        parts.append(({c: t[c].to_numpy(float) for c in quality.STATISTICS}, t["kind"].to_numpy(object)))
    rules = quality.best_rules(*parts[1])
    assert (quality.apply_rules(rules, parts[0][0]) == parts[0][1]).mean() >= 0.9


# --- scans ------------------------------------------------------------------

BODY = ["The laboratory reviewed the samples and compared", "them with the baseline of the earlier study that", "was described before. Missing values were filled", "after the samples had been measured by the labora-", "tory. A low-cost tool was preferred by volunteers."]


def pages(spark):
    rows, gold = [], []
    for p in range(24):
        for n in range(1, 4):
            lines = ["Journal of Testing" if n % 2 else f"Title of paper {p}", ""] + BODY + [f"{n + 10}"]
            text = "\n".join(lines)
            if p == 0 and n == 1:
                text = text.replace("samples had", "sarnples had")
            if n == 1:
                text = text.replace("volunteers.", "volunte-")
            if n == 2:
                text = text.replace("The laboratory reviewed", "ers who were there. The laboratory reviewed")
            rows.append((f"p{p}", n, text, 0.9, "completed", "noise"))
            if p < 6:
                gold.append((f"p{p}", n, "\n".join(BODY)))
    rows += rows[:5] + [("p0", 9, None, None, "failed", None), ("p0", 10, "  ", 2.0, "completed", None), (None, 1, "x", 0.1, "completed", None)]
    ocr = spark.createDataFrame(rows, "paper_id string, page_number int, text string, confidence double, status string, kind string")
    papers = spark.createDataFrame([(f"p{p}", f"Title of paper {p}", "Journal of Testing", ["Ann Lee"]) for p in range(24)], "paper_id string, title string, venue string, authors array<string>")
    return ocr, papers, spark.createDataFrame(gold, "paper_id string, page_number int, repaired_text string")


def test_noise_of_scans(spark):
    got = {}
    for r in scans.scan_noise(*pages(spark)).collect():
        got.setdefault((r.paper_id, r.page_number), set()).add((r.line_no, r.kind))
    assert got[("p3", 2)] == {(1, "header"), (6, "hyphen"), (8, "page_number")}
    assert got[("p3", 1)] == {(1, "header"), (6, "hyphen"), (7, "hyphen"), (8, "page_number")}
    assert (6, "misread") in got[("p0", 1)] and ("p0", 9) not in got and len(got) == 72


def test_repair_joins_over_pages(spark):
    got = {(r.paper_id, r.page_number): r.repaired_text for r in scans.repair(*pages(spark)).collect()}
    assert got[("p3", 1)].endswith("A low-cost tool was preferred by volunteers") and got[("p3", 2)].startswith("who were there. The laboratory")
    assert "samples had been measured by the laboratory." in got[("p0", 1)] and "Journal" not in got[("p0", 1)]


def test_scans_of_empty_tables(spark):
    ocr, papers, gold = pages(spark)
    assert scans.scan_noise(ocr.limit(0), papers.limit(0), gold.limit(0)).count() == 0


def test_own_hyphens_stay():
    speller = scans.Speller({"low-cost": 50, "laboratory": 50, "data-driven": 9, "driven": 3, "records": 100, "chat": 40, "that": 900})
    assert not speller.joins("low", "cost") and speller.joins("labora", "tory") and not speller.joins("data", "driven") and speller.joins("Vuzu", "tefemp")
    assert speller.fix("rec0rds") == "records" and speller.fix("recorcls") == "records" and speller.fix("records") is None and speller.fix("chat") is None
