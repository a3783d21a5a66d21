"""Search queries: lexical, vector, fused, and judged."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import indexes as I
from lectern.operators import relational as R
from lectern.operators import search as S
from lectern.plans.catalog import PAPERS, QA, cases, documents, texts, papers
from lectern.plans.textops import _TOK
from lectern.session import table

PROBES = (
    ("q1", "random forests for rainfall series"), ("q2", "which papers discuss speech recognition of creole transcripts"), ("q3", "limitations of active learning when labels are expensive"),
    ("q4", "tide gauges and storm tracks"), ("q5", "calibration error of the baseline"), ("q6", "how are missing values filled in sensor nodes"),
)


def probes(spark):
    return spark.createDataFrame(list(PROBES), "query_id string, query string")


def index(spark, d):
    """The persisted index of the documents, made at first use."""
    return I.of(table(spark, d, "documents").select("doc_id", "text"))


def search_bm25(spark, d):
    return I.bm25(index(spark, d), probes(spark), 10)


def search_unindexed(spark, d):
    """The same without an index, for tables that are searched once."""
    return S.bm25(texts(spark, d), probes(spark), 10)


def search_filtered(spark, d):
    """BM25 among passages of results and discussions of papers since 2015; the
    filter comes before the limit."""
    new = papers(spark, d).where("pub_year >= 2015").select("paper_id")
    among = documents(spark, d).where("lower(section) in ('results', 'discussion')").join(new, "paper_id", "left_semi").select("doc_id")
    return I.bm25(index(spark, d), probes(spark), 10, among)


def search_coverage(spark, d):
    return S.coverage(texts(spark, d), probes(spark), 10)


def search_fused(spark, d):
    """Both lexical scores; BM25 goes through s / (1 + s) first, so that better
    matches keep the larger score."""
    a = I.bm25(index(spark, d), probes(spark), None).withColumn("score", F.round(F.col("score") / (1 + F.col("score")), 6))
    return S.fuse(a, S.coverage(texts(spark, d), probes(spark), None), 10)


def search_hybrid(spark, d):
    """BM25 through s / (1 + s) and the cosine of hashed features, weights 0.42 and
    0.48, over all passages that either side finds."""
    a = I.bm25(index(spark, d), probes(spark), None).withColumn("score", F.round(F.col("score") / (1 + F.col("score")), 6))
    return S.fuse(a, S.hashed_nearest(S.feature_hashes(texts(spark, d)), probes(spark)), 10)


def search_reference_scores(spark, d):
    """BM25 with the inverted magnitude 1 / (1 + s), in the order of BM25."""
    return search_bm25(spark, d).select("query_id", "doc_id", "rank", F.round(1 / (1 + F.col("score")), 6).alias("score"))


def search_section_boost(spark, d):
    """The thirty best passages by the coverage score with a boost for sections
    that fit the query."""
    hits = S.coverage(texts(spark, d), probes(spark), None).join(probes(spark), "query_id").join(documents(spark, d).select("doc_id", F.lower(F.coalesce("section", F.lit(""))).alias("section")), "doc_id")
    q, s = F.lower("query"), F.col("section")
    boost = F.when(s == "", 0.0).when(q.rlike("method|approach|implementation|algorithm") & s.rlike("method|approach|implementation"), 0.08).when(q.rlike("future|extend|extension|limitation|challenge") & s.rlike("future|limitation|discussion|conclusion"), 0.08)
    boost = boost.when(q.rlike("evaluate|result|experiment|metric") & s.rlike("result|evaluation|experiment"), 0.07).when(s.rlike("abstract|introduction|conclusion"), 0.035).otherwise(0.0)
    boosted = hits.select("query_id", "doc_id", "score", F.round(boost, 6).alias("boost"), F.round(F.col("score") + boost, 6).alias("boosted"))
    return R.top_k(boosted, ["query_id"], [F.desc("boosted"), F.col("doc_id")], 30)


def search_overlap_by_paper(spark, d):
    """Largest share of the query's tokens in one passage of each paper, top five."""
    q = probes(spark).select("query_id", F.array_distinct(X.tokens(F.col("query"))).alias("want"))
    x = texts(spark, d).where("paper_id is not null").select("paper_id", F.array_distinct(X.tokens(F.col("text"))).alias("have")).crossJoin(F.broadcast(q))
    s = x.select("query_id", "paper_id", F.size(F.array_intersect("want", "have")).alias("hits"), F.size("want").alias("of"))
    best = s.groupBy("query_id", "paper_id").agg(F.max("hits").alias("hits"), F.max("of").alias("of")).where("hits > 0")
    return R.top_k(best, ["query_id"], [F.desc("hits"), F.col("paper_id")], 5)


def feature_hashing(spark, d):
    return S.feature_hashes(texts(spark, d))


def metadata_boost(spark, d):
    """Share of a question's tokens in its paper's title, venue, authors and
    topics: at most 0.12, and 0.04 more for a hit in the title."""
    p = papers(spark, d).select("paper_id", X.tokens(F.concat_ws(" ", "title", "venue", F.array_join("authors", " "), F.array_join("topics", " "))).alias("meta"), X.tokens(F.col("title")).alias("t"))
    q = cases(spark, d).select("case_id", F.col("gold_locator.paper_id").alias("paper_id"), F.array_distinct(X.tokens(F.col("question"))).alias("want")).where(F.size("want") > 0)
    share = F.size(F.array_intersect("want", F.array_distinct("meta"))) / F.size("want")
    return q.join(p, "paper_id").select("case_id", F.round(F.least(F.lit(0.16), share * 0.12 + F.when(F.arrays_overlap("want", "t"), 0.04).otherwise(0.0)), 6).alias("boost"))


def evidence_quality(spark, d):
    """Penalties and bonuses of a passage as evidence, within [-0.22, 0.08]."""
    low, t = F.lower("text"), F.col("text")
    has = lambda *w: low.rlike("|".join(w))
    p = F.when(t.contains("@"), 0.035).otherwise(0.0) + F.when(has("proceedings of", "annual conference", "conference on", " arxiv", " doi", " et al"), 0.085).otherwise(0.0)
    p = p + F.when(F.size(F.regexp_extract_all(t, F.lit(r"\[[0-9]+\]"), F.lit(0))) >= 2, 0.09).otherwise(0.0) + F.when(has("department of", "university of"), 0.025).otherwise(0.0)
    b = F.when(has("we ", "this paper", "this research", "results", "demonstrates", "proposes", "evaluat"), 0.025).otherwise(0.0) + F.when(has("future work", "limitations", "future research"), 0.12).otherwise(0.0)
    return texts(spark, d).where("text is not null").select("doc_id", F.round(F.greatest(F.lit(-0.22), F.least(F.lit(0.08), b - p)), 6).alias("quality"))


def nearest_exact(spark, d):
    """Ten nearest embeddings of every twentieth, exactly, against all."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return S.exact_nearest(e, e.where("vec_id % 20 = 0"), 10, "vec_id", "embedding")


def nearest_judged(spark, d):
    """Precision, reciprocal rank and gain of the nearest neighbours by label."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    n = nearest_exact(spark, d).join(e.withColumnRenamed("label", "own"), "vec_id").join(e.select(F.col("vec_id").alias("neighbour"), "label"), "neighbour")
    hit = (F.col("label") == F.col("own")).cast("int")
    per = n.groupBy("vec_id", "own").agg(F.sum(hit).alias("hits"), F.min(F.when(hit == 1, F.col("rank"))).alias("first"), F.sum(hit / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return per.groupBy(F.col("own").alias("label")).agg(F.count("*").alias("queries"), F.round(F.avg(F.col("hits") / 10), 6).alias("precision"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.col("dcg") / ideal), 6).alias("ndcg"))


def snippets(spark, d):
    return texts(spark, d).where("text is not null").select("doc_id", S.snippet(F.col("text"), ["clustering", "forests", "baseline"]).alias("snippet"))


def sectioned_best(spark, d):
    """The best passage of every section for each probe."""
    h = S.coverage(texts(spark, d), probes(spark), None).join(documents(spark, d).select("doc_id", "section"), "doc_id").where("section is not null")
    w = Window.partitionBy("query_id", "section").orderBy(F.desc("score"), "doc_id")
    return h.withColumn("r", F.row_number().over(w)).where("r = 1").select("query_id", "section", "doc_id", "score")


QUERIES = {
    "search_bm25": search_bm25, "search_unindexed": search_unindexed, "search_filtered": search_filtered, "search_coverage": search_coverage, "search_fused": search_fused, "search_hybrid": search_hybrid, "search_inverted_score": search_reference_scores, "search_section_boost": search_section_boost,
    "search_overlap_by_paper": search_overlap_by_paper, "search_feature_hashing": feature_hashing, "search_metadata_boost": metadata_boost, "search_evidence_quality": evidence_quality,
    "search_nearest_exact": nearest_exact, "search_nearest_judged": nearest_judged, "search_snippets": snippets, "search_best_by_section": sectioned_best,
}

_Q = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PROBES) + ") q(query_id, query)"
_QT = f"qt AS (SELECT DISTINCT query_id, unnest({_TOK('query')}) term FROM {_Q})"
_BM = f"""{_QT}, t AS (SELECT doc_id, {_TOK('text')} t FROM documents), n AS (SELECT count(*) docs, avg(len(t)) mean FROM t), tf AS (SELECT term, doc_id, size, count(*) tf FROM (SELECT doc_id, len(t) size, unnest(t) term FROM t) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3),
    df AS (SELECT term, count(*) df FROM tf GROUP BY 1), s AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * size / mean))), 6) score FROM tf JOIN df USING (term) JOIN qt USING (term), n GROUP BY 1, 2)"""
_RANK = lambda s, k, e="": f"SELECT query_id, doc_id, score{e}, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM {s}) WHERE rank <= {k}"
_COV = f"""qq AS (SELECT query_id, query, list_distinct({_TOK('query')}) terms FROM {_Q}), dd AS (SELECT doc_id, lower(coalesce(text, '')) low FROM documents),
    cx AS (SELECT query_id, doc_id, len(list_filter(regexp_split_to_array(low, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) words, len(terms) n, list_transform(terms, lambda t: (length(low) - length(replace(low, t, ''))) // length(t)) c FROM dd, qq),
    cov AS (SELECT query_id, doc_id, round(least(1.0, list_sum(c) / greatest(words, 1) * 30.0::DOUBLE + len(list_filter(c, lambda v: v > 0)) / n * 0.6::DOUBLE), 6) score FROM cx WHERE list_sum(c) > 0)"""
_NN = """c AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), nn AS (SELECT vec_id, neighbour, cosine, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, neighbour) AS INTEGER) rank FROM c QUALIFY rank <= 10)"""
_HAS = lambda *w: "regexp_matches(lower(text), '" + "|".join(w) + "')"
_FH = lambda key, text, rel: f"""(WITH t AS (SELECT {key}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+')) token FROM {rel}), h AS (SELECT {key}, sha256(token) h FROM t),
    s AS (SELECT {key}, CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) % 256 AS INTEGER) bucket, sum(CASE WHEN CAST('0x' || substr(h, 9, 2) AS INTEGER) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) v FROM h GROUP BY 1, 2)
    SELECT {key}, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY {key})), 6) AS weight FROM s WHERE v <> 0)"""  # noqa: E731
SQL = {
    "search_hybrid": f"""WITH {_BM}, a AS (SELECT query_id, doc_id, round(score / (1 + score), 6) a FROM s), fd AS {_FH('doc_id', 'text', 'documents')}, fq AS {_FH('query_id', 'query', _Q)},
        b AS (SELECT query_id, doc_id, round(sum(fd.weight * fq.weight), 6) b FROM fd JOIN fq USING (bucket) GROUP BY 1, 2 HAVING round(sum(fd.weight * fq.weight), 6) > 0),
        f AS (SELECT query_id, doc_id, coalesce(a, 0.0) a, coalesce(b, 0.0) b, round(greatest(0.0, least(1.0, coalesce(a, 0.0) * 0.42::DOUBLE + coalesce(b, 0.0) * 0.48::DOUBLE)), 6) score FROM a FULL JOIN b USING (query_id, doc_id)) """ + _RANK("f", 10, ", a, b"),
    "search_bm25": f"WITH {_BM} " + _RANK("s", 10),
    "search_unindexed": f"WITH {_BM} " + _RANK("s", 10),
    "search_filtered": f"""WITH {_BM}, ok AS (SELECT doc_id FROM documents WHERE lower(section) IN ('results', 'discussion') AND paper_id IN (SELECT paper_id FROM {PAPERS} WHERE pub_year >= 2015)), f AS (SELECT s.* FROM s JOIN ok USING (doc_id)) """ + _RANK("f", 10),
    "search_coverage": f"WITH {_COV} " + _RANK("cov", 10),
    "search_fused": f"""WITH {_BM}, {_COV}, a AS (SELECT query_id, doc_id, round(score / (1 + score), 6) a FROM s), b AS (SELECT query_id, doc_id, score b FROM cov),
        f AS (SELECT query_id, doc_id, coalesce(a, 0.0) a, coalesce(b, 0.0) b, round(greatest(0.0, least(1.0, coalesce(a, 0.0) * 0.42::DOUBLE + coalesce(b, 0.0) * 0.48::DOUBLE)), 6) score FROM a FULL JOIN b USING (query_id, doc_id)) """ + _RANK("f", 10, ", a, b"),
    "search_inverted_score": f"WITH {_BM} SELECT query_id, doc_id, rank, round(1 / (1 + score), 6) AS score FROM (" + _RANK("s", 10) + ")",
    "search_section_boost": f"""WITH {_COV}, h AS (SELECT cov.query_id, doc_id, score, lower(query) q, lower(coalesce(section, '')) s FROM cov JOIN qq USING (query_id) JOIN documents USING (doc_id)),
        b AS (SELECT *, CASE WHEN s = '' THEN 0.0 WHEN regexp_matches(q, 'method|approach|implementation|algorithm') AND regexp_matches(s, 'method|approach|implementation') THEN 0.08 WHEN regexp_matches(q, 'future|extend|extension|limitation|challenge') AND regexp_matches(s, 'future|limitation|discussion|conclusion') THEN 0.08
        WHEN regexp_matches(q, 'evaluate|result|experiment|metric') AND regexp_matches(s, 'result|evaluation|experiment') THEN 0.07 WHEN regexp_matches(s, 'abstract|introduction|conclusion') THEN 0.035 ELSE 0.0 END::DOUBLE boost FROM h) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, doc_id) AS INTEGER) AS rank FROM (SELECT query_id, doc_id, score, boost, round(score + boost, 6) AS boosted FROM b) QUALIFY rank <= 30""",
    "search_overlap_by_paper": f"""WITH qq AS (SELECT query_id, list_distinct({_TOK('query')}) want FROM {_Q}), b AS (SELECT query_id, paper_id, max(len(list_intersect(want, {_TOK('text')}))) hits, max(len(want)) n FROM documents, qq WHERE paper_id IS NOT NULL GROUP BY 1, 2)
        SELECT query_id, paper_id, CAST(hits AS INTEGER) AS hits, CAST(n AS INTEGER) AS "of", CAST(row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, paper_id) AS INTEGER) AS rank FROM b WHERE hits > 0 QUALIFY rank <= 5""",
    "search_feature_hashing": """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) token FROM documents), h AS (SELECT doc_id, sha256(token) h FROM t),
        s AS (SELECT doc_id, CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) % 256 AS INTEGER) bucket, sum(CASE WHEN CAST('0x' || substr(h, 9, 2) AS INTEGER) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) v FROM h GROUP BY 1, 2)
        SELECT doc_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS weight FROM s WHERE v <> 0""",
    "search_metadata_boost": f"""WITH p AS (SELECT paper_id, {_TOK("concat_ws(' ', title, venue, array_to_string(authors, ' '), array_to_string(topics, ' '))")} meta, {_TOK('title')} t FROM {PAPERS}),
        q AS (SELECT case_id, gold_locator.paper_id paper_id, list_distinct({_TOK('question')}) want FROM {QA})
        SELECT case_id, round(least(0.16::DOUBLE, len(list_intersect(want, meta)) / len(want) * 0.12::DOUBLE + CASE WHEN list_has_any(want, t) THEN 0.04 ELSE 0.0 END::DOUBLE), 6) AS boost FROM q JOIN p ON p.paper_id = q.paper_id WHERE len(want) > 0""",
    "search_evidence_quality": f"""SELECT doc_id, round(greatest(-0.22::DOUBLE, least(0.08::DOUBLE, (CASE WHEN {_HAS('we ', 'this paper', 'this research', 'results', 'demonstrates', 'proposes', 'evaluat')} THEN 0.025::DOUBLE ELSE 0 END + CASE WHEN {_HAS('future work', 'limitations', 'future research')} THEN 0.12::DOUBLE ELSE 0 END)
        - (CASE WHEN contains(text, '@') THEN 0.035::DOUBLE ELSE 0 END + CASE WHEN {_HAS('proceedings of', 'annual conference', 'conference on', ' arxiv', ' doi', ' et al')} THEN 0.085::DOUBLE ELSE 0 END
        + CASE WHEN len(regexp_extract_all(text, '\\[[0-9]+\\]')) >= 2 THEN 0.09::DOUBLE ELSE 0 END + CASE WHEN {_HAS('department of', 'university of')} THEN 0.025::DOUBLE ELSE 0 END))), 6) AS quality FROM documents WHERE text IS NOT NULL""",
    "search_nearest_exact": f"WITH {_NN} SELECT * FROM nn",
    "search_nearest_judged": f"""WITH {_NN}, h AS (SELECT nn.*, a.label own, CASE WHEN a.label = b.label THEN 1 ELSE 0 END hit FROM nn JOIN embeddings a ON a.vec_id = nn.vec_id JOIN embeddings b ON b.vec_id = nn.neighbour),
        per AS (SELECT vec_id, own, sum(hit) hits, min(CASE WHEN hit = 1 THEN rank END) f, sum(hit / log2(rank + 1.0::DOUBLE)) dcg FROM h GROUP BY 1, 2)
        SELECT own AS label, count(*) AS queries, round(avg(hits / 10), 6) AS precision, round(avg(coalesce(1 / f, 0.0)), 6) AS mrr, round(avg(dcg / (SELECT sum(1 / log2(i + 1.0::DOUBLE)) FROM range(1, 11) t(i))), 6) AS ndcg FROM per GROUP BY 1""",
    "search_best_by_section": f"""WITH {_COV}
        SELECT query_id, section, doc_id, score FROM cov JOIN documents USING (doc_id) WHERE section IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, section ORDER BY score DESC, doc_id) = 1""",
}
