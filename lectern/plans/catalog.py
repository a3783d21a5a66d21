"""Catalogue queries: governed views, filters, facets, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.words import folded_words
from lectern.operators import recommend as M
from lectern.operators import relational as R
from lectern.session import spread_table, table

PAPERS = "(SELECT DISTINCT paper_id, title, authors, pub_year, publication_date_raw, venue, topics, pdf_url, ocr_status, created_at FROM papers)"
QA = "(SELECT DISTINCT case_id, split, expected_answerable, category, question, cluster_id, gold_locator, negative_evidence, answer_points FROM qa_selective_response_v2)"
FINDER = "(SELECT DISTINCT profile_id, split, constraint_pair, interests, skills, available_time, project_type, preferred_difficulty, preferred_topics, gold_paper_id FROM finder_proxy_profiles_v2)"


def papers(spark, d):
    return R.once(table(spark, d, "papers"), ["paper_id"])


def cases(spark, d):
    return R.once(table(spark, d, "qa_selective_response_v2"), ["case_id"])


def profiles(spark, d):
    return R.once(table(spark, d, "finder_proxy_profiles_v2"), ["profile_id"])


def documents(spark, d):
    return table(spark, d, "documents")


def texts(spark, d):
    """The documents, dealt out to all cores, for work that reads every text."""
    return spread_table(spark, d, "documents")


def eligible_view(spark, d):
    """Passages of papers whose text is there: an inner equi-join."""
    ready = papers(spark, d).where(F.col("ocr_status").isin("completed", "not_needed")).select("paper_id", "pub_year")
    return documents(spark, d).join(ready, "paper_id").select("doc_id", "paper_id", "section", "pub_year")


def paper_blockers(spark, d):
    """Why a paper is not shown, as an array of codes."""
    has = documents(spark, d).groupBy("paper_id").agg(F.count("*").alias("passages"))
    return papers(spark, d).join(has, "paper_id", "left").select(
        "paper_id",
        F.concat_ws(",", R.codes(no_passages=F.col("passages").isNull(), no_year=F.col("pub_year").isNull(), no_venue=F.col("venue").isNull(), no_url=F.col("pdf_url").isNull(), no_authors=F.size("authors") == 0)).alias("blockers"),
    )


def publication_tier(spark, d):
    searchable = documents(spark, d).where("paper_id is not null").select("paper_id").distinct().withColumn("found", F.lit(True))
    return papers(spark, d).join(searchable, "paper_id", "left").groupBy(F.when(F.col("found"), "searchable").otherwise("metadata_only").alias("tier")).agg(F.count("*").alias("n"))


def section_year_author(spark, d):
    """Passages by section (any case), year and a part of any author's name."""
    some = papers(spark, d).where((F.col("pub_year") >= 2010) & R.any_contains("authors", "oona")).select("paper_id", "title", "pub_year")
    return documents(spark, d).where(F.lower("section") == "results").join(some, "paper_id").select("doc_id", "paper_id", "title", "pub_year")


def text_like(spark, d):
    return R.page(documents(spark, d).where(F.col("text").ilike("%random forests%")).select("doc_id", "paper_id", "section"), [F.col("paper_id").asc_nulls_first(), F.col("doc_id")], 5, 40)


def catalogue_order(spark, d):
    return R.page(papers(spark, d).select("paper_id", "title", F.coalesce("pub_year", F.lit(0)).alias("year")), [F.desc("year"), F.desc("title"), F.col("paper_id")], 0, 50)


def snippets(spark, d):
    flat = F.trim(F.regexp_replace(F.col("text"), r"[ \t\n\r\f]+", " "))
    return documents(spark, d).where("text is not null").select("doc_id", F.when(F.length(flat) > 240, F.concat(F.substring(flat, 1, 239), F.lit("…"))).otherwise(flat).alias("snippet"))


def redacted(spark, d):
    """Links with their host taken out."""
    return papers(spark, d).select("paper_id", F.regexp_replace("pdf_url", r"https?://[^/]+/", "<host>/").alias("link"))


def facets(spark, d):
    p = papers(spark, d)
    parts = [
        p.where("pub_year is not null").select(F.lit("year").alias("facet"), F.col("pub_year").cast("string").alias("value"), "paper_id"),
        p.where("venue is not null").select(F.lit("venue").alias("facet"), F.col("venue").alias("value"), "paper_id"),
        p.select(F.lit("topic").alias("facet"), F.explode("topics").alias("value"), "paper_id"),
        p.select(F.lit("author").alias("facet"), F.explode("authors").alias("value"), "paper_id"),
    ]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy("facet", "value").agg(F.countDistinct("paper_id").alias("papers"))


def client_filter(spark, d):
    p = papers(spark, d)
    whole = F.lower(F.concat_ws(" ", "title", "venue", F.array_join("authors", " "), F.array_join("topics", " ")))
    return p.where(F.array_contains("topics", "health") & F.contains(whole, F.lit("regression"))).select("paper_id", "title", "pub_year")


def review_queue(spark, d):
    """Four kinds of items under one projection, newest first, one page of them."""
    parts = [
        papers(spark, d).select(F.lit("paper").alias("kind"), F.col("paper_id").alias("item_id"), "created_at"),
        cases(spark, d).select(F.lit("question").alias("kind"), F.col("case_id").alias("item_id"), "created_at"),
        profiles(spark, d).select(F.lit("profile").alias("kind"), F.col("profile_id").alias("item_id"), "created_at"),
        documents(spark, d).select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("item_id"), "created_at"),
    ]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    return R.page(rows, [F.desc("created_at"), F.col("kind"), F.col("item_id")], 20, 100)


def missing_papers(spark, d):
    """Papers that questions cite and the catalogue lacks: an anti-join."""
    cited = cases(spark, d).select(F.col("gold_locator.paper_id").alias("paper_id")).where("paper_id is not null")
    return cited.join(papers(spark, d), "paper_id", "left_anti").groupBy("paper_id").agg(F.count("*").alias("questions"))


def cited_papers(spark, d):
    """Papers with a question on them: a semi-join."""
    cited = cases(spark, d).select(F.col("gold_locator.paper_id").alias("paper_id"))
    return papers(spark, d).join(cited, "paper_id", "left_semi").select("paper_id", "title")


def question_titles(spark, d):
    """Titles of the questions' papers, the id where there is none."""
    q = cases(spark, d).select("case_id", F.col("gold_locator.paper_id").alias("paper_id")).where("paper_id is not null")
    return R.with_fallback(q, papers(spark, d), "paper_id", "title", "paper_id", "label").select("case_id", "label")


def paper_use_full_outer(spark, d):
    """Questions and profiles of a paper side by side, zero where one lacks."""
    q = cases(spark, d).select(F.lower(F.trim("cluster_id")).alias("paper_id")).where("paper_id <> ''").groupBy("paper_id").agg(F.count("*").alias("questions"))
    f = profiles(spark, d).select(F.lower(F.trim("gold_paper_id")).alias("paper_id")).where("paper_id <> ''").groupBy("paper_id").agg(F.count("*").alias("profiles"))
    return q.join(f, "paper_id", "full").na.fill(0, ["questions", "profiles"])


def coauthors(spark, d):
    """How many papers two authors share."""
    bridge = papers(spark, d).select("paper_id", F.explode("authors").alias("author"))
    return R.shared_counts(bridge, "author", "paper_id")


def related_topics(spark, d):
    bridge = papers(spark, d).select("paper_id", F.explode("topics").alias("topic"))
    return R.shared_counts(bridge, "topic", "paper_id")


def shared_suppliers(spark, d):
    """Suppliers on the same order, at least twice."""
    return R.shared_counts(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey").where("shared >= 2")


def citation_audit(spark, d):
    """Mismatch codes of each question's locator."""
    q = cases(spark, d).where("gold_locator is not null").select("case_id", "gold_locator.*", "cluster_id")
    p = papers(spark, d).select("paper_id", F.lit(True).alias("known"))
    return q.join(p, "paper_id", "left").select("case_id", F.concat_ws(",", R.codes(
        paper_unknown=F.col("known").isNull(), page_order=F.col("page_start") > F.col("page_end"),
        foreign_chunk=~F.col("chunk_id").startswith(F.col("paper_id")), no_hash=F.coalesce(F.col("source_hash"), F.lit("")) == "",
        no_cluster=F.trim(F.coalesce("cluster_id", F.lit(""))) == "",
    )).alias("codes"))


def nested_semi(spark, d):
    """Questions of which any answer point has a group that names a word."""
    hit = F.exists("answer_points", lambda p: F.exists(p["groups"], lambda g: F.exists(g, lambda w: F.contains(F.lower(w), F.lit("sampl")))))
    return cases(spark, d).where(F.coalesce(hit, F.lit(False))).select("case_id", "category")


def related_papers(spark, d):
    """For every paper the five papers with most in common."""
    return M.related(papers(spark, d), 5)


def name_variants(spark, d):
    """Author spellings that fold to the same words."""
    names = papers(spark, d).select(F.explode("authors").alias("name"), "paper_id").where("name is not null")
    keyed = names.select("name", "paper_id").distinct().withColumn("author_key", folded_words("name"))
    return keyed.groupBy("author_key").agg(F.countDistinct("name").alias("spellings"), F.min("name").alias("canonical"), F.countDistinct("paper_id").alias("papers")).where("spellings > 1")


def symmetric_keys(spark, d):
    """Paper ids that only one of two tables has."""
    a = papers(spark, d).select("paper_id").distinct()
    b = documents(spark, d).where("paper_id is not null").select("paper_id").distinct()
    return a.exceptAll(b).withColumn("only_in", F.lit("papers")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("documents")))


def skill_jaccard(spark, d):
    """Overlap of wanted topics with the paper's topics: shared over all, 1 where
    both are empty."""
    p = papers(spark, d).select(F.col("paper_id").alias("gold_paper_id"), "topics")
    j = profiles(spark, d).join(p, "gold_paper_id").select("profile_id", F.array_distinct("preferred_topics").alias("a"), F.array_distinct("topics").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return j.select("profile_id", F.round(F.when(F.size(F.array_union("a", "b")) == 0, 1.0).otherwise(both / F.size(F.array_union("a", "b"))), 6).alias("jaccard"))


def ordered_distinct(spark, d):
    return profiles(spark, d).select("profile_id", F.array_join(F.array_distinct(F.concat("skills", "preferred_topics")), "|").alias("labels"))


def greedy_dedupe(spark, d):
    """Repeated texts: the smallest id of each stays, whatever case and spacing."""
    key = F.lower(F.trim(F.regexp_replace("text", r"[ \t\n\r\f]+", " ")))
    some = documents(spark, d).where("text is not null").select("doc_id", F.sha2(key, 256).alias("k"))
    return some.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").select("doc_id", "copies")


QUERIES = {
    "view_eligible": eligible_view, "view_blockers": paper_blockers, "view_tiers": publication_tier, "filter_section_year_author": section_year_author, "filter_ilike_page": text_like,
    "order_catalogue": catalogue_order, "project_snippets": snippets, "project_redacted": redacted, "facet_counts": facets, "filter_client": client_filter, "union_review_queue": review_queue,
    "join_anti_missing": missing_papers, "join_semi_cited": cited_papers, "join_left_fallback": question_titles, "join_full_outer": paper_use_full_outer, "join_bridge_coauthors": coauthors,
    "join_bridge_topics": related_topics, "join_bridge_suppliers": shared_suppliers, "join_citation_audit": citation_audit, "join_nested_semi": nested_semi, "join_related_papers": related_papers,
    "author_variants": name_variants, "set_symmetric_difference": symmetric_keys, "set_jaccard": skill_jaccard, "set_ordered_distinct": ordered_distinct, "set_dedupe_texts": greedy_dedupe,
}

_FLAT = r"trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))"
SQL = {
    "view_eligible": f"SELECT doc_id, d.paper_id, section, pub_year FROM documents d JOIN {PAPERS} p ON d.paper_id = p.paper_id WHERE ocr_status IN ('completed', 'not_needed')",
    "view_blockers": f"""SELECT p.paper_id, concat_ws(',', CASE WHEN n IS NULL THEN 'no_passages' END, CASE WHEN pub_year IS NULL THEN 'no_year' END, CASE WHEN venue IS NULL THEN 'no_venue' END,
        CASE WHEN pdf_url IS NULL THEN 'no_url' END, CASE WHEN len(authors) = 0 THEN 'no_authors' END) AS blockers
        FROM {PAPERS} p LEFT JOIN (SELECT paper_id, count(*) n FROM documents GROUP BY 1) x ON p.paper_id = x.paper_id""",
    "view_tiers": f"SELECT CASE WHEN paper_id IN (SELECT paper_id FROM documents WHERE paper_id IS NOT NULL) THEN 'searchable' ELSE 'metadata_only' END AS tier, count(*) AS n FROM {PAPERS} GROUP BY 1",
    "filter_section_year_author": f"""SELECT doc_id, d.paper_id, title, pub_year FROM documents d JOIN {PAPERS} p ON d.paper_id = p.paper_id
        WHERE lower(section) = 'results' AND pub_year >= 2010 AND len(list_filter(authors, lambda a: contains(lower(a), 'oona'))) > 0""",
    "filter_ilike_page": "SELECT doc_id, paper_id, section FROM documents WHERE text ILIKE '%random forests%' ORDER BY paper_id ASC NULLS FIRST, doc_id LIMIT 40 OFFSET 5",
    "order_catalogue": f"SELECT paper_id, title, coalesce(pub_year, 0) AS year FROM {PAPERS} ORDER BY year DESC, title DESC, paper_id LIMIT 50",
    "project_snippets": f"SELECT doc_id, CASE WHEN length({_FLAT}) > 240 THEN substr({_FLAT}, 1, 239) || '…' ELSE {_FLAT} END AS snippet FROM documents WHERE text IS NOT NULL",
    "project_redacted": f"SELECT paper_id, regexp_replace(pdf_url, 'https?://[^/]+/', '<host>/', 'g') AS link FROM {PAPERS}",
    "facet_counts": f"""SELECT facet, value, count(DISTINCT paper_id) AS papers FROM (
        SELECT 'year' facet, CAST(pub_year AS VARCHAR) value, paper_id FROM {PAPERS} WHERE pub_year IS NOT NULL UNION ALL SELECT 'venue', venue, paper_id FROM {PAPERS} WHERE venue IS NOT NULL
        UNION ALL SELECT 'topic', unnest(topics), paper_id FROM {PAPERS} UNION ALL SELECT 'author', unnest(authors), paper_id FROM {PAPERS}) GROUP BY 1, 2""",
    "filter_client": f"""SELECT paper_id, title, pub_year FROM {PAPERS} WHERE list_contains(topics, 'health')
        AND contains(lower(concat_ws(' ', title, venue, array_to_string(authors, ' '), array_to_string(topics, ' '))), 'regression')""",
    "union_review_queue": """SELECT kind, item_id, created_at FROM (SELECT DISTINCT 'paper' kind, paper_id item_id, created_at FROM papers UNION ALL SELECT DISTINCT 'question', case_id, created_at FROM qa_selective_response_v2
        UNION ALL SELECT DISTINCT 'profile', profile_id, created_at FROM finder_proxy_profiles_v2 UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), created_at FROM documents)
        ORDER BY created_at DESC, kind, item_id LIMIT 100 OFFSET 20""",
    "join_anti_missing": f"SELECT gold_locator.paper_id AS paper_id, count(*) AS questions FROM {QA} WHERE gold_locator.paper_id IS NOT NULL AND gold_locator.paper_id NOT IN (SELECT paper_id FROM papers) GROUP BY 1",
    "join_semi_cited": f"SELECT paper_id, title FROM {PAPERS} WHERE paper_id IN (SELECT gold_locator.paper_id FROM qa_selective_response_v2)",
    "join_left_fallback": f"SELECT case_id, coalesce(title, gold_locator.paper_id) AS label FROM {QA} q LEFT JOIN {PAPERS} p ON p.paper_id = q.gold_locator.paper_id WHERE q.gold_locator.paper_id IS NOT NULL",
    "join_full_outer": f"""SELECT coalesce(q.paper_id, f.paper_id) AS paper_id, coalesce(questions, 0) AS questions, coalesce(profiles, 0) AS profiles FROM
        (SELECT lower(trim(cluster_id)) paper_id, count(*) questions FROM {QA} WHERE trim(cluster_id) <> '' GROUP BY 1) q FULL JOIN
        (SELECT lower(trim(gold_paper_id)) paper_id, count(*) profiles FROM {FINDER} WHERE trim(gold_paper_id) <> '' GROUP BY 1) f ON q.paper_id = f.paper_id""",
    "join_bridge_coauthors": f"""WITH b AS (SELECT DISTINCT paper_id, e FROM (SELECT paper_id, unnest(authors) e FROM {PAPERS}) WHERE e IS NOT NULL)
        SELECT x.e AS a, y.e AS b, count(*) AS shared FROM b x JOIN b y ON x.paper_id = y.paper_id AND x.e < y.e GROUP BY 1, 2""",
    "join_bridge_topics": f"""WITH b AS (SELECT DISTINCT paper_id, e FROM (SELECT paper_id, unnest(topics) e FROM {PAPERS}) WHERE e IS NOT NULL)
        SELECT x.e AS a, y.e AS b, count(*) AS shared FROM b x JOIN b y ON x.paper_id = y.paper_id AND x.e < y.e GROUP BY 1, 2""",
    "join_bridge_suppliers": """WITH b AS (SELECT DISTINCT l_orderkey o, l_suppkey e FROM lineitem)
        SELECT x.e AS a, y.e AS b, count(*) AS shared FROM b x JOIN b y ON x.o = y.o AND x.e < y.e GROUP BY 1, 2 HAVING count(*) >= 2""",
    "join_citation_audit": f"""SELECT case_id, concat_ws(',', CASE WHEN p.paper_id IS NULL THEN 'paper_unknown' END, CASE WHEN gold_locator.page_start > gold_locator.page_end THEN 'page_order' END,
        CASE WHEN NOT starts_with(gold_locator.chunk_id, gold_locator.paper_id) THEN 'foreign_chunk' END, CASE WHEN coalesce(gold_locator.source_hash, '') = '' THEN 'no_hash' END,
        CASE WHEN trim(coalesce(cluster_id, '')) = '' THEN 'no_cluster' END) AS codes FROM {QA} q LEFT JOIN {PAPERS} p ON p.paper_id = q.gold_locator.paper_id WHERE gold_locator IS NOT NULL""",
    "join_nested_semi": f"""SELECT case_id, category FROM {QA} WHERE len(list_filter(answer_points, lambda p: len(list_filter(p.groups, lambda g: len(list_filter(g, lambda w: contains(lower(w), 'sampl'))) > 0)) > 0)) > 0""",
    "join_related_papers": f"""WITH b AS (SELECT DISTINCT paper_id, 2 w, e FROM (SELECT paper_id, unnest(authors) e FROM {PAPERS}) WHERE e IS NOT NULL UNION ALL SELECT DISTINCT paper_id, 3, e FROM (SELECT paper_id, unnest(topics) e FROM {PAPERS}) WHERE e IS NOT NULL),
        s AS (SELECT x.paper_id a, y.paper_id b, sum(x.w) points FROM b x JOIN b y ON x.w = y.w AND x.e = y.e AND x.paper_id <> y.paper_id GROUP BY 1, 2),
        c AS (SELECT a, b, points + CASE WHEN abs(p.pub_year - r.pub_year) <= 2 THEN 1 ELSE 0 END score FROM s JOIN {PAPERS} p ON p.paper_id = a JOIN {PAPERS} r ON r.paper_id = b)
        SELECT a AS paper_id, b AS related_id, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM c) WHERE rank <= 5""",
    "author_variants": f"""WITH n AS (SELECT DISTINCT name, paper_id, trim(regexp_replace(lower(strip_accents(nfc_normalize(name))), '[^a-z0-9]+', ' ', 'g')) k FROM (SELECT paper_id, unnest(authors) name FROM {PAPERS}) WHERE name IS NOT NULL)
        SELECT k AS author_key, count(DISTINCT name) AS spellings, min(name) AS canonical, count(DISTINCT paper_id) AS papers FROM n GROUP BY 1 HAVING count(DISTINCT name) > 1""",
    "set_symmetric_difference": """(SELECT paper_id, 'papers' AS only_in FROM (SELECT DISTINCT paper_id FROM papers EXCEPT SELECT paper_id FROM documents)) UNION ALL
        (SELECT paper_id, 'documents' FROM (SELECT DISTINCT paper_id FROM documents WHERE paper_id IS NOT NULL EXCEPT SELECT paper_id FROM papers))""",
    "set_jaccard": f"""SELECT profile_id, round(CASE WHEN len(list_distinct(list_concat(preferred_topics, topics))) = 0 THEN 1.0
        ELSE CAST(len(list_intersect(list_distinct(preferred_topics), list_distinct(topics))) AS DOUBLE) / len(list_distinct(list_concat(preferred_topics, topics))) END, 6) AS jaccard
        FROM {FINDER} f JOIN {PAPERS} p ON f.gold_paper_id = p.paper_id""",
    "set_ordered_distinct": f"""SELECT profile_id, array_to_string(list_filter(list_concat(skills, preferred_topics), lambda x, i: list_position(list_concat(skills, preferred_topics), x) = i), '|') AS labels FROM {FINDER}""",
    "set_dedupe_texts": rf"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY lower({_FLAT}) HAVING count(*) > 1",
}
