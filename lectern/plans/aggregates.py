"""Aggregations: totals, counts with seeds, grouping sets, metrics from counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions.words import folded_words
from lectern.operators import relational as R
from lectern.plans.catalog import FINDER, PAPERS, QA, cases, documents, papers, profiles
from lectern.session import table

STATUSES = ("completed", "not_needed", "not_requested", "partial", "failed")


def totals(spark, d):
    """The dashboard's totals: each table is scanned once, one row each, joined."""
    p = papers(spark, d).agg(F.count("*").alias("papers"), F.count_if(F.col("pub_year").isNull()).alias("no_year"), F.countDistinct("venue").alias("venues"), F.count_if(F.size("topics") > 0).alias("with_topics"))
    a = papers(spark, d).select(F.explode("authors").alias("a")).agg(F.countDistinct("a").alias("authors"))
    x = documents(spark, d).agg(F.count("*").alias("passages"), F.countDistinct("paper_id").alias("papers_with_text"), F.sum(F.length("text")).cast("long").alias("characters"))
    # one row each
    return p.crossJoin(a).crossJoin(x)


def status_counts(spark, d):
    return R.value_counts(papers(spark, d), "ocr_status", STATUSES)


def source_counts(spark, d):
    return R.value_counts(documents(spark, d), "source")


def order_status_pivot(spark, d):
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return o.groupBy("year").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


def author_paper_counts(spark, d):
    named = papers(spark, d).select("paper_id", F.explode("authors").alias("name")).withColumn("author_key", folded_words("name"))
    return named.where("author_key <> ''").groupBy("author_key").agg(F.countDistinct("paper_id").alias("papers"))


def author_topics(spark, d):
    """Author by topic: papers; then each author's first three topics."""
    x = papers(spark, d).select(F.explode("authors").alias("author"), "topics", "paper_id").select("author", "paper_id", F.explode("topics").alias("topic"))
    n = x.groupBy("author", "topic").agg(F.countDistinct("paper_id").alias("papers"))
    return R.top_k(n, ["author"], [F.desc("papers"), F.col("topic")], 3)


def topic_cards(spark, d):
    """Topics of at least five papers with their first paper and author count, which
    stops at four."""
    x = papers(spark, d).select("paper_id", "title", "authors", F.explode("topics").alias("topic"))
    a = x.select("topic", F.explode("authors").alias("author")).groupBy("topic").agg(F.countDistinct("author").alias("all_authors"))
    c = x.groupBy("topic").agg(F.countDistinct("paper_id").alias("papers"), F.min("title").alias("first_title")).where("papers >= 5")
    return c.join(a, "topic").select("topic", "papers", "first_title", F.least("all_authors", F.lit(4).cast("long")).alias("author_count"), "all_authors")


def recent_papers(spark, d):
    return papers(spark, d).orderBy(F.desc("created_at"), "paper_id").limit(5).select("paper_id", "title")


def passages_by_paper(spark, d):
    """Groups of passages in order of id, with the longest and all sections."""
    x = documents(spark, d).where("paper_id is not null")
    return x.groupBy("paper_id").agg(F.count("*").alias("passages"), F.max("n_chars").alias("longest"), F.array_join(F.array_sort(F.collect_set("section")), "|").alias("sections"), F.min("doc_id").alias("first_doc"))


def case_rates(spark, d):
    """Rates by category and overall from summed counters: a grouping set."""
    q = cases(spark, d).select("category", F.col("expected_answerable").cast("int").alias("yes"), F.coalesce(F.size("answer_points"), F.lit(0)).alias("points"), F.col("gold_locator").isNotNull().cast("int").alias("located"))
    g = q.groupingSets([[F.col("category")], []], "category").agg(F.count("*").alias("cases"), F.sum("yes").alias("answerable"), F.sum("points").alias("points"), F.sum("located").alias("located"))
    return g.select(F.coalesce("category", F.lit("overall")).alias("category"), "cases", F.round(F.col("answerable") / F.col("cases"), 6).alias("answerable_rate"), F.round(F.try_divide("points", "answerable"), 6).alias("points_per_answerable"), F.round(F.try_divide("located", "cases"), 6).alias("located_rate"))


def rollup_orders(spark, d):
    o = table(spark, d, "orders")
    g = o.rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))
    return g.select(F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), F.coalesce("o_orderstatus", F.lit("all")).alias("status"), "n", "customers")


def error_code_frequency(spark, d):
    """How often each defect occurs over the questions, and on how many papers."""
    q = cases(spark, d)
    flags = R.codes(no_split=F.col("split").isNull(), no_cluster=F.trim(F.coalesce("cluster_id", F.lit(""))) == "", no_locator=F.col("gold_locator").isNull(), short_question=F.length(F.coalesce("question", F.lit(""))) < 12)
    return q.select("category", F.explode(flags).alias("code")).groupBy("code").agg(F.count("*").alias("occurrences"), F.countDistinct("category").alias("categories"))


def label_metrics(spark, d):
    """tp, fp, fn and tn of a one-feature classifier of the embeddings' labels.

    The prediction is the place of the largest of the first ten coordinates."""
    top = F.slice("embedding", 1, 10)
    e = table(spark, d, "embeddings").select("label", (F.array_position(top, F.array_max(top)) - 1).cast("int").alias("predicted"))
    labels = spark.range(10).select(F.col("id").cast("int").alias("l"))
    # ten labels: the small side is fixed
    x = e.groupBy("label", "predicted").count().join(F.broadcast(labels), F.lit(True))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0)).cast("long")
    m = x.groupBy("l").agg(
        n((F.col("label") == F.col("l")) & (F.col("predicted") == F.col("l"))).alias("tp"), n((F.col("label") != F.col("l")) & (F.col("predicted") == F.col("l"))).alias("fp"),
        n((F.col("label") == F.col("l")) & (F.col("predicted") != F.col("l"))).alias("fn"), n((F.col("label") != F.col("l")) & (F.col("predicted") != F.col("l"))).alias("tn"),
    )
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return m.select(F.col("l").alias("label"), "tp", "fp", "fn", "tn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def confusion(spark, d):
    q = cases(spark, d).where("split is not null").select(F.lower(F.trim("split")).alias("split"), "expected_answerable")
    return q.groupBy("split").pivot("expected_answerable", [True, False]).count().na.fill(0).select("split", F.col("true").alias("answerable"), F.col("false").alias("unanswerable"))


def mean_of_means(spark, d):
    """The mean over sources of the mean length of their texts."""
    m = documents(spark, d).where("source is not null").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.avg(F.length("text")).alias("m"))
    return m.agg(F.round(F.avg("m"), 6).alias("mean_of_means"), F.count("*").alias("sources"))


def slot_coverage(spark, d):
    """Pages 1 to the largest scanned one of each paper that no completed scan has."""
    o = table(spark, d, "ocr").where("page_number > 0 and status = 'completed'")
    want = o.groupBy("paper_id").agg(F.max("page_number").alias("last")).select("paper_id", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("page_number"))
    return want.join(o, ["paper_id", "page_number"], "left_anti").groupBy("paper_id").agg(F.count("*").alias("missing"), F.min("page_number").alias("first_missing"))


def repeat_agreement(spark, d):
    """Agreement of two passes over a key: repeats of a page and their confidence."""
    o = table(spark, d, "ocr").groupBy("paper_id", "page_number").agg(F.count("*").alias("n"), F.countDistinct("status").alias("kinds"), F.max("confidence").alias("hi"), F.min("confidence").alias("lo")).where("n > 1")
    return o.agg(F.count("*").alias("pairs"), F.round(F.avg((F.col("kinds") == 1).cast("double")), 6).alias("agreement"), F.round(F.avg(F.col("hi") - F.col("lo")), 6).alias("mean_difference"))


def value_percentiles(spark, d):
    """Exact linear percentiles of the event values by type."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"))


def page_classes(spark, d):
    """Class of a paper from the set of classes of its pages."""
    o = table(spark, d, "ocr").groupBy("paper_id").agg(F.collect_set("content_class").alias("c"))
    kind = F.when(F.size("c") > 1, "mixed").otherwise(F.col("c")[0])
    return o.groupBy(kind.alias("document_class")).agg(F.count("*").alias("papers"))


def corpus_fingerprint(spark, d):
    """An order-free fingerprint of each source: the sum of row hashes' low bits
    and a count, so that no group is collected."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return documents(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum(h).cast("long").alias("fingerprint"))


def profile_attributes(spark, d):
    p = profiles(spark, d)
    stacked = p.select(F.expr("stack(3, 'project_type', project_type, 'difficulty', preferred_difficulty, 'time', available_time) as (attribute, value)"))
    return stacked.groupBy("attribute", F.coalesce("value", F.lit("none")).alias("value")).agg(F.count("*").alias("n"))


def revenue_by_nation(spark, d):
    li, o, s, n, r = (table(spark, d, t) for t in ("lineitem", "orders", "supplier", "nation", "region"))
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey).join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return x.where("o_orderstatus = 'F'").groupBy("r_name", "n_name").agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def share_of_total(spark, d):
    n = documents(spark, d).where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    return n.select("lang", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


QUERIES = {
    "agg_totals": totals, "agg_status_seeded": status_counts, "agg_source_counts": source_counts, "agg_pivot_status": order_status_pivot, "agg_author_papers": author_paper_counts,
    "agg_author_topics": author_topics, "agg_topic_cards": topic_cards, "agg_recent": recent_papers, "agg_passages_by_paper": passages_by_paper, "agg_case_rates": case_rates,
    "agg_rollup_orders": rollup_orders, "agg_error_codes": error_code_frequency, "agg_label_metrics": label_metrics, "agg_confusion": confusion, "agg_mean_of_means": mean_of_means,
    "agg_slot_coverage": slot_coverage, "agg_repeat_agreement": repeat_agreement, "agg_percentiles": value_percentiles, "agg_page_classes": page_classes, "agg_corpus_fingerprint": corpus_fingerprint,
    "agg_profile_attributes": profile_attributes, "agg_revenue_by_nation": revenue_by_nation, "agg_share_of_total": share_of_total,
}

_KEY = "trim(regexp_replace(lower(strip_accents(nfc_normalize(name))), '[^a-z0-9]+', ' ', 'g'))"
SQL = {
    "agg_totals": f"""SELECT * FROM (SELECT count(*) AS papers, count(*) FILTER (WHERE pub_year IS NULL) AS no_year, count(DISTINCT venue) AS venues, count(*) FILTER (WHERE len(topics) > 0) AS with_topics FROM {PAPERS}),
        (SELECT count(DISTINCT a) AS authors FROM (SELECT unnest(authors) a FROM {PAPERS})),
        (SELECT count(*) AS passages, count(DISTINCT paper_id) AS papers_with_text, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents)""",
    "agg_status_seeded": f"""SELECT value, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN trim(coalesce(ocr_status, '')) = '' THEN 'unknown' ELSE ocr_status END value, count(*) n FROM {PAPERS} GROUP BY 1
        UNION ALL SELECT unnest(['completed', 'not_needed', 'not_requested', 'partial', 'failed']), 0) GROUP BY 1""",
    "agg_source_counts": "SELECT CASE WHEN trim(coalesce(source, '')) = '' THEN 'unknown' ELSE source END AS value, count(*) AS n FROM documents GROUP BY 1",
    "agg_pivot_status": """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""",
    "agg_author_papers": f"SELECT {_KEY} AS author_key, count(DISTINCT paper_id) AS papers FROM (SELECT paper_id, unnest(authors) name FROM {PAPERS}) WHERE {_KEY} <> '' GROUP BY 1",
    "agg_author_topics": f"""SELECT author, topic, papers, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY papers DESC, topic) AS rank FROM
        (SELECT author, topic, count(DISTINCT paper_id) papers FROM (SELECT author, paper_id, unnest(topics) topic FROM (SELECT paper_id, topics, unnest(authors) author FROM {PAPERS})) GROUP BY 1, 2)) WHERE rank <= 3""",
    "agg_topic_cards": f"""WITH x AS (SELECT paper_id, title, authors, unnest(topics) topic FROM {PAPERS}), a AS (SELECT topic, count(DISTINCT author) n FROM (SELECT topic, unnest(authors) author FROM x) GROUP BY 1)
        SELECT x.topic AS topic, count(DISTINCT paper_id) AS papers, min(title) AS first_title, least(any_value(n), 4) AS author_count, any_value(n) AS all_authors FROM x JOIN a ON a.topic = x.topic GROUP BY 1 HAVING count(DISTINCT paper_id) >= 5""",
    "agg_recent": f"SELECT paper_id, title FROM {PAPERS} ORDER BY created_at DESC, paper_id LIMIT 5",
    "agg_passages_by_paper": """SELECT paper_id, count(*) AS passages, max(n_chars) AS longest, coalesce(string_agg(DISTINCT section, '|' ORDER BY section), '') AS sections, min(doc_id) AS first_doc FROM documents WHERE paper_id IS NOT NULL GROUP BY 1""",
    "agg_case_rates": f"""SELECT coalesce(category, 'overall') AS category, count(*) AS cases, round(count(*) FILTER (WHERE expected_answerable) / count(*), 6) AS answerable_rate,
        round(sum(coalesce(len(answer_points), 0)) / nullif(count(*) FILTER (WHERE expected_answerable), 0), 6) AS points_per_answerable, round(count(*) FILTER (WHERE gold_locator IS NOT NULL) / count(*), 6) AS located_rate
        FROM {QA} GROUP BY GROUPING SETS ((category), ())""",
    "agg_rollup_orders": "SELECT coalesce(o_orderpriority, 'all') AS priority, coalesce(o_orderstatus, 'all') AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)",
    "agg_error_codes": f"""SELECT code, count(*) AS occurrences, count(DISTINCT category) AS categories FROM (SELECT category, unnest(list_filter([CASE WHEN split IS NULL THEN 'no_split' END,
        CASE WHEN trim(coalesce(cluster_id, '')) = '' THEN 'no_cluster' END, CASE WHEN gold_locator IS NULL THEN 'no_locator' END, CASE WHEN length(coalesce(question, '')) < 12 THEN 'short_question' END], lambda x: x IS NOT NULL)) code FROM {QA}) GROUP BY 1""",
    "agg_label_metrics": """WITH e AS (SELECT label, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 p FROM embeddings), m AS (SELECT l, count(*) FILTER (WHERE label = l AND p = l) tp, count(*) FILTER (WHERE label <> l AND p = l) fp,
        count(*) FILTER (WHERE label = l AND p <> l) fn, count(*) FILTER (WHERE label <> l AND p <> l) tn FROM e, (SELECT CAST(unnest(range(10)) AS INTEGER) l) GROUP BY 1), r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) pr, coalesce(tp / nullif(tp + fn, 0), 0.0) rc FROM m)
        SELECT l AS label, tp, fp, fn, tn, round(pr, 6) AS precision, round(rc, 6) AS recall, round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0.0), 6) AS f1 FROM r""",
    "agg_confusion": f"SELECT lower(trim(split)) AS split, count(*) FILTER (WHERE expected_answerable) AS answerable, count(*) FILTER (WHERE NOT expected_answerable) AS unanswerable FROM {QA} WHERE split IS NOT NULL GROUP BY 1",
    "agg_mean_of_means": "SELECT round(avg(m), 6) AS mean_of_means, count(*) AS sources FROM (SELECT lower(trim(source)), avg(length(text)) m FROM documents WHERE source IS NOT NULL GROUP BY 1)",
    "agg_slot_coverage": """WITH o AS (SELECT DISTINCT paper_id, page_number FROM ocr WHERE page_number > 0 AND status = 'completed'), w AS (SELECT paper_id, unnest(range(1, max(page_number) + 1)) page_number FROM o GROUP BY 1)
        SELECT w.paper_id AS paper_id, count(*) AS missing, CAST(min(w.page_number) AS INTEGER) AS first_missing FROM w LEFT JOIN o ON o.paper_id = w.paper_id AND o.page_number = w.page_number WHERE o.paper_id IS NULL GROUP BY 1""",
    "agg_repeat_agreement": """SELECT count(*) AS pairs, round(avg(CASE WHEN kinds = 1 THEN 1.0 ELSE 0.0 END), 6) AS agreement, round(avg(hi - lo), 6) AS mean_difference
        FROM (SELECT count(*) n, count(DISTINCT status) kinds, max(confidence) hi, min(confidence) lo FROM ocr GROUP BY paper_id, page_number HAVING count(*) > 1)""",
    "agg_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS least, max(value) AS most, count(*) AS n FROM events GROUP BY 1",
    "agg_page_classes": "SELECT CASE WHEN n > 1 THEN 'mixed' ELSE c END AS document_class, count(*) AS papers FROM (SELECT count(DISTINCT content_class) n, min(content_class) c FROM ocr GROUP BY paper_id) GROUP BY 1",
    "agg_corpus_fingerprint": "SELECT source, count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR) || '|' || coalesce(text, '')), 1, 8) AS BIGINT)) AS BIGINT) AS fingerprint FROM documents GROUP BY 1",
    "agg_profile_attributes": f"""SELECT attribute, coalesce(value, 'none') AS value, count(*) AS n FROM (SELECT 'project_type' attribute, project_type value FROM {FINDER} UNION ALL SELECT 'difficulty', preferred_difficulty FROM {FINDER}
        UNION ALL SELECT 'time', available_time FROM {FINDER}) GROUP BY 1, 2""",
    "agg_revenue_by_nation": """SELECT r_name, n_name, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F' GROUP BY 1, 2""",
    "agg_share_of_total": "SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents WHERE lang IS NOT NULL GROUP BY 1",
}
