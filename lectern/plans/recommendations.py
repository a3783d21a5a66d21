"""Recommendation, identity and tuning queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.words import folded_words
from lectern.operators import answers as A
from lectern.operators import recommend as M
from lectern.operators import relational as R
from lectern.plans.catalog import FINDER, PAPERS, texts, papers, profiles
from lectern.plans.textops import _SENT
from lectern.session import table

WEIGHTS = {"topics": 0.5, "recent": 0.2, "venue": 0.1, "text": 0.2}
#: Labels of topics that are written otherwise.
SYNONYMS = {"retrieval augmented generation": "rag", "artificial intelligence": "ai", "ml": "machine learning", "internet of things": "iot", "optimisation": "optimization"}


def recommended(spark, d):
    return M.score(profiles(spark, d), papers(spark, d), WEIGHTS, 3)


def sensitivity(spark, d):
    """How often the first recommendation stays when one weight is doubled."""
    base = M.score(profiles(spark, d), papers(spark, d), WEIGHTS, 1).select("profile_id", F.col("paper_id").alias("base"))
    out = None
    for name in sorted(WEIGHTS):
        other = M.score(profiles(spark, d), papers(spark, d), {**WEIGHTS, name: WEIGHTS[name] * 2}, 1).select("profile_id", "paper_id")
        row = base.join(other, "profile_id").agg(F.count("*").alias("profiles"), F.count_if(F.col("base") == F.col("paper_id")).alias("kept")).withColumn("doubled", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def gold_rank(spark, d):
    """Share of the profile's topics that its own paper has, by difficulty."""
    p = papers(spark, d).select(F.lower("paper_id").alias("gold"), "topics")
    x = profiles(spark, d).where("size(preferred_topics) > 0").select("profile_id", F.lower(F.trim("gold_paper_id")).alias("gold"), "preferred_difficulty", F.array_distinct("preferred_topics").alias("want")).join(p, "gold")
    share = F.size(F.array_intersect("want", "topics")) / F.size("want")
    return x.groupBy(F.coalesce("preferred_difficulty", F.lit("none")).alias("difficulty")).agg(F.count("*").alias("profiles"), F.round(F.avg(share), 6).alias("share"))


def skill_cover(spark, d):
    """Skills that a project type asks for and the profile has."""
    need = F.when(F.col("project_type") == "dashboard/visualization", F.array(F.lit("SQL"), F.lit("data visualization"))).when(F.col("project_type") == "ML experiment", F.array(F.lit("Python"), F.lit("statistics"))).otherwise(F.array(F.lit("Python")))
    p = profiles(spark, d).select("profile_id", need.alias("need"), "skills")
    return p.select("profile_id", F.size(F.array_intersect("need", "skills")).alias("has"), F.array_join(F.array_except("need", "skills"), "|").alias("lacks"))


def gap_sentences(spark, d):
    """The first sentence of each text on future work or limits that
    negates nothing."""
    c = A.claims(texts(spark, d), "doc_id", "text").withColumn("low", F.lower("claim"))
    c = c.where(F.col("low").rlike("future work|limitation|remain open") & ~F.col("low").rlike(r"(^|[^a-z])(no|not|without) (future|limitation)"))
    return R.top_k(c, ["doc_id"], [F.col("n")], 1).select("doc_id", F.col("claim").alias("sentence"))


def name_pairs(spark, d):
    names = papers(spark, d).select(F.explode("authors").alias("n")).where("n is not null").distinct().select(folded_words("n").alias("name"))
    return M.identity_pairs(names)


def initials(spark, d):
    """Authors written with an initial beside authors of the same last name and
    letter: never merged, only shown."""
    return name_pairs(spark, d).where("initial").groupBy(F.substring_index("a", " ", -1).alias("last")).agg(F.count("*").alias("pairs"))


def lenient_import(spark, d):
    """Text fields read leniently: bad numbers and blanks become null."""
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "props")
    return e.select("event_id", F.expr("try_cast(k AS INT)").alias("k_int"), F.nullif(F.trim("k"), F.lit("")).alias("k_text"))


def topic_labels(spark, d):
    """Topics by their normal name and label."""
    t = F.lower(F.trim(F.regexp_replace("topic", r"[ \t_-]+", " ")))
    norm = t
    for a, b in SYNONYMS.items():
        norm = F.when(t == a, F.lit(b)).otherwise(norm)
    x = papers(spark, d).select("paper_id", F.explode("topics").alias("topic")).select("paper_id", norm.alias("normal"))
    return x.groupBy("normal", F.initcap("normal").alias("label")).agg(F.countDistinct("paper_id").alias("papers"))


def tuned_weight(spark, d):
    """The weight of topics against recency, in tenths, that ranks the profile's
    own paper above most of the papers that share a wanted topic; the smaller
    weight of equals."""
    n = M.weight_wins(profiles(spark, d).withColumn("gold", F.lower(F.trim("gold_paper_id"))), papers(spark, d))
    best = Window.partitionBy().orderBy(F.desc("wins"), "tenths")
    return n.select("tenths", "wins", "of", (F.row_number().over(best) == 1).alias("chosen"))


def fallback_passages(spark, d):
    """A paper's passages outside references and related work; where there are
    none, its first two passages."""
    x = texts(spark, d).where("paper_id is not null").select("doc_id", "paper_id", F.coalesce("section", F.lit("Unknown")).alias("section"))
    good = x.where(~F.col("section").isin("References", "Related Work", "Unknown"))
    rest = x.join(good.select("paper_id").distinct(), "paper_id", "left_anti")
    return good.withColumn("why", F.lit("section")).unionByName(R.top_k(rest, ["paper_id"], [F.col("doc_id")], 2).drop("rank").withColumn("why", F.lit("fallback")))


def heading_counts(spark, d):
    """Lines of scanned pages that are section headings, by section."""
    o = table(spark, d, "ocr").where("text is not null").dropDuplicates(["paper_id", "page_number"]).select("paper_id", F.explode(F.split("text", "\n")).alias("line"))
    return o.select(X.section_of(F.col("line")).alias("section"), "paper_id").where("section is not null").groupBy("section").agg(F.count("*").alias("lines"), F.countDistinct("paper_id").alias("papers"))


QUERIES = {
    "rec_papers": recommended, "rec_sensitivity": sensitivity, "rec_gold_share": gold_rank, "rec_skill_cover": skill_cover, "rec_gap_sentences": gap_sentences, "author_identity_pairs": name_pairs,
    "author_initials": initials, "import_lenient": lenient_import, "text_topic_labels": topic_labels, "rec_tuned_weight": tuned_weight, "view_fallback_passages": fallback_passages, "text_page_headings": heading_counts,
}

_POOL = f"pool AS (SELECT * FROM (SELECT unnest(list_distinct(topics)) topic, * FROM {PAPERS}) )"
_W = f"w AS (SELECT profile_id, list_distinct(preferred_topics) want, unnest(list_distinct(preferred_topics)) topic FROM {FINDER})"
_C = "c AS (SELECT DISTINCT profile_id, want, paper_id, topics, pub_year, venue, pdf_url FROM (SELECT profile_id, list_sort(want) want, paper_id, topics, pub_year, venue, pdf_url FROM w JOIN pool USING (topic)))"


def _score(weights):
    t = sum(weights.values())
    parts = {"topics": "len(list_intersect(want, topics)) / len(want)", "recent": "greatest(0.0::DOUBLE, least(1.0::DOUBLE, (coalesce(pub_year, 2000) - 2000) / 25.0::DOUBLE))", "venue": "CASE WHEN venue IS NULL THEN 0.0::DOUBLE ELSE 1.0 END", "text": "CASE WHEN pdf_url IS NULL THEN 0.0::DOUBLE ELSE 1.0 END"}
    return "round(" + " + ".join(f"{parts[n]} * {v / t!r}::DOUBLE" for n, v in sorted(weights.items())) + ", 6)"


_TOP = lambda weights, k: f"SELECT profile_id, paper_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT profile_id, paper_id, score, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, paper_id) rank FROM (SELECT *, {_score(weights)} score FROM c)) WHERE rank <= {k}"
_NORM = "CASE " + " ".join(f"WHEN t = '{a}' THEN '{b}'" for a, b in SYNONYMS.items()) + " ELSE t END"
SQL = {
    "rec_papers": f"WITH {_POOL}, {_W}, {_C} {_TOP(WEIGHTS, 3)}",
    "rec_sensitivity": f"WITH {_POOL}, {_W}, {_C}, b AS ({_TOP(WEIGHTS, 1)}) " + " UNION ALL ".join(f"SELECT count(*) AS profiles, count(*) FILTER (WHERE b.paper_id = o.paper_id) AS kept, '{n}' AS doubled FROM b JOIN ({_TOP({**WEIGHTS, n: WEIGHTS[n] * 2}, 1)}) o ON o.profile_id = b.profile_id" for n in sorted(WEIGHTS)),
    "rec_gold_share": f"""SELECT coalesce(preferred_difficulty, 'none') AS difficulty, count(*) AS profiles, round(avg(len(list_intersect(list_distinct(preferred_topics), topics)) / len(list_distinct(preferred_topics))), 6) AS share
        FROM {FINDER} f JOIN {PAPERS} p ON lower(trim(gold_paper_id)) = lower(p.paper_id) WHERE len(preferred_topics) > 0 GROUP BY 1""",
    "rec_skill_cover": f"""WITH n AS (SELECT profile_id, skills, CASE WHEN project_type = 'dashboard/visualization' THEN ['SQL', 'data visualization'] WHEN project_type = 'ML experiment' THEN ['Python', 'statistics'] ELSE ['Python'] END need FROM {FINDER})
        SELECT profile_id, CAST(len(list_intersect(need, skills)) AS INTEGER) AS has, array_to_string(list_filter(need, lambda x: NOT list_contains(skills, x)), '|') AS lacks FROM n""",
    "import_lenient": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k_int, nullif(trim(json_extract_string(props, '$.k')), '') AS k_text FROM events",
    "text_topic_labels": f"""SELECT normal, array_to_string(list_transform(string_split(normal, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS label, count(DISTINCT paper_id) AS papers
        FROM (SELECT paper_id, {_NORM} normal FROM (SELECT paper_id, lower(trim(regexp_replace(topic, '[ \\t_-]+', ' ', 'g'))) t FROM (SELECT paper_id, unnest(topics) topic FROM {PAPERS}))) GROUP BY 1, 2""",
    "rec_tuned_weight": f"""WITH {_POOL}, g AS (SELECT profile_id, list_sort(list_distinct(preferred_topics)) want, p.paper_id, topics, coalesce(pub_year, 2000) y FROM {FINDER} f JOIN {PAPERS} p ON p.paper_id = lower(trim(gold_paper_id)) WHERE len(preferred_topics) > 0),
        x AS (SELECT *, unnest(want) topic FROM g), c AS (SELECT DISTINCT profile_id, want, x.paper_id, x.topics, y, pool.paper_id c_id, pool.topics c_topics, coalesce(pool.pub_year, 2000) c_y FROM x JOIN pool USING (topic) WHERE pool.paper_id <> x.paper_id),
        v AS (SELECT len(list_intersect(want, topics)) * 1000 // len(want) gt, len(list_intersect(want, c_topics)) * 1000 // len(want) ct, (y - 2000) * 40 gy, (c_y - 2000) * 40 cy FROM c),
        n AS (SELECT tenths, count(*) FILTER (WHERE tenths * gt + (10 - tenths) * gy > tenths * ct + (10 - tenths) * cy) wins, count(*) al FROM v, range(11) r(tenths) GROUP BY 1) SELECT tenths, wins, al AS "of", row_number() OVER (ORDER BY wins DESC, tenths) = 1 AS chosen FROM n""",
    "view_fallback_passages": """WITH x AS (SELECT doc_id, paper_id, coalesce(section, 'Unknown') section FROM documents WHERE paper_id IS NOT NULL), g AS (SELECT * FROM x WHERE section NOT IN ('References', 'Related Work', 'Unknown'))
        SELECT doc_id, paper_id, section, 'section' AS why FROM g UNION ALL SELECT doc_id, paper_id, section, 'fallback' FROM (SELECT * FROM x WHERE paper_id NOT IN (SELECT paper_id FROM g) QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY doc_id) <= 2)""",
}


def _gaps():
    from lectern.plans.textops import _TOK

    return f"""WITH s AS (SELECT doc_id, unnest({_SENT}) claim, generate_subscripts({_SENT}, 1) n FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, claim AS sentence FROM s WHERE len({_TOK('claim')}) >= 4 AND regexp_matches(lower(claim), 'future work|limitation|remain open') AND NOT regexp_matches(lower(claim), '(^|[^a-z])(no|not|without) (future|limitation)') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) = 1"""


def _headings():
    from lectern.plans.textops import _ALIAS, _PLAIN

    return f"""WITH a(name, s) AS (VALUES {_ALIAS}), o AS (SELECT DISTINCT paper_id, page_number, text FROM ocr WHERE text IS NOT NULL), l AS (SELECT paper_id, unnest(string_split(text, chr(10))) line FROM o)
        SELECT a.s AS section, count(*) AS lines, count(DISTINCT paper_id) AS papers FROM l JOIN a ON a.name = {_PLAIN('line')} GROUP BY 1"""


SQL |= {"rec_gap_sentences": _gaps(), "text_page_headings": _headings()}
