from lectern.llm import scans
from tests.llm.test_text_operators import pages


def test_misread_words_are_judged_by_ratio_however_frequent():
    speller = scans.Speller({"its": 60_000, "lts": 1_010, "laboratory": 30_000, "laborat0ry": 300})
    assert speller.misread(["near", "lts"]) and scans._mend("lts,", speller) == "its,"
    body = [scans.BODY] * 2
    assert scans.read_page(["the labo-", "rat0ry was"], body, speller)[:2] == ([0], [1])
    assert not scans.Speller({"its": 12_000, "lts": 1_010}).misread(["lts"])


def test_words_beyond_the_bound_decide_too(spark):
    """Few words sent to all tasks, the rest joined: the same answer."""
    ocr, papers, gold = pages(spark)
    noise = lambda bound: sorted(map(tuple, scans.scan_noise(ocr, papers, gold, bound=bound).collect()))
    text = lambda bound: sorted(map(tuple, scans.repair(ocr, papers, gold, bound=bound).collect()))
    assert noise(3) == noise(200_000) and ("p0", 1, 6, "misread") in noise(3)
    assert text(3) == text(200_000)


def test_all_pages_train_the_model(spark, monkeypatch):
    ocr = spark.range(1_700).selectExpr("concat('p', id) paper_id", "1 page_number", "concat('Title\n\nbody goes on here.\n', id) text", "0.9d confidence", "'completed' status")
    papers = ocr.selectExpr("paper_id", "'Title' title", "'V' venue", "array('Ann Lee') authors")
    gold = ocr.limit(600).selectExpr("paper_id", "page_number", "'body goes on here.' repaired_text")
    seen, own = [], scans._sum
    monkeypatch.setattr(scans, "_sum", lambda counts: seen.append(own(counts)) or seen[-1])
    scans.learn(scans.prepare(ocr, papers), gold)
    starts = [sum(n for (what, _, _), n in counts.items() if what == "start") for counts in seen]
    assert starts == [600, 1_700, 1_700]
