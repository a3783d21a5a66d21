"""Answer checks and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import answers as A
from lectern.operators import search as S
from lectern.operators import statistics as T
from lectern.plans.catalog import PAPERS, QA, cases, papers, texts
from lectern.plans.retrieval import _BM, _Q, _RANK, probes, search_bm25
from lectern.plans.textops import _SENT, _TOK
from lectern.session import table


def answerable(spark, d):
    return A.answerability(search_bm25(spark, d), probes(spark), texts(spark, d))


def claim_counts(spark, d):
    c = A.claims(texts(spark, d), "doc_id", "text")
    return c.groupBy("doc_id").agg(F.count("*").alias("claims"), F.count_if(F.col("claim").rlike(r"\[[0-9]+\]")).alias("with_marker"))


def best_sentences(spark, d):
    return A.best_sentence(texts(spark, d), "doc_id", "text", ["random", "forests", "error", "labels"])


def answer_points(spark, d):
    """Answer points that the question's own words already cover."""
    q = cases(spark, d).where("question is not null and answer_points is not null")
    return q.select("case_id", F.size("answer_points").alias("points"), A.points_covered(F.col("answer_points"), F.col("question")).alias("covered"))


def atomic_claims(spark, d):
    c = A.atomic_claims(texts(spark, d), "doc_id", "text")
    return c.groupBy("doc_id").agg(F.count("*").alias("claims"), F.sum(F.length("claim")).alias("characters"))


def claim_support(spark, d):
    """Claims of every question against the passages of the paper it cites."""
    c = A.atomic_claims(cases(spark, d), "case_id", "question").join(cases(spark, d).select("case_id", F.col("gold_locator.paper_id").alias("paper_id")), "case_id")
    return A.claim_support(c, texts(spark, d).select("paper_id", "text"), "case_id", "paper_id")


def title_containment(spark, d):
    """Tokens of more than three letters that a question shares with its paper's title."""
    x = cases(spark, d).where("question is not null").select("case_id", "question", F.col("gold_locator.paper_id").alias("paper_id")).join(papers(spark, d).select("paper_id", "title"), "paper_id")
    shared, share = A.containment(x, "title", "question", 3)
    return x.select("case_id", shared.alias("shared"), F.round(share, 6).alias("share"))


def citation_support(spark, d):
    """Overlap of each sentence with the one after it: supported from 0.08."""
    s = A.claims(texts(spark, d), "doc_id", "text").withColumn("t", F.array_distinct(X.tokens(F.col("claim"))))
    nxt = F.lead("t").over(Window.partitionBy("doc_id").orderBy("n"))
    o = s.withColumn("u", nxt).where("u is not null").withColumn("overlap", F.size(F.array_intersect("t", "u")) / F.size("t"))
    return o.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("overlap") >= 0.08).alias("supported"))


def question_terms(spark, d):
    """Longer terms of the questions, how many questions have each."""
    t = cases(spark, d).select("case_id", F.explode(F.array_distinct(X.tokens(F.col("question")))).alias("term")).where(F.length("term") > 2)
    return t.groupBy("term").agg(F.count("*").alias("questions")).where("questions >= 3")


def wilson_by_category(spark, d):
    g = cases(spark, d).groupBy("category").agg(F.count_if("expected_answerable").alias("yes"), F.count("*").alias("n"))
    low, high = T.wilson(F.col("yes"), F.col("n"))
    return g.select("category", "yes", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def ranked_metrics(spark, d):
    """Recall, hits, precision and graded gain at three cutoffs of the nearest ten of
    every twentieth vector; vectors of its label are relevant, and more so if
    they are of the same tenth of ids."""
    from lectern.plans.retrieval import nearest_exact

    e = table(spark, d, "embeddings").select("vec_id", "label")
    asked = e.where("vec_id % 20 = 0").select("vec_id", "label")
    judged = asked.join(e.select(F.col("vec_id").alias("neighbour"), "label"), "label").where("vec_id <> neighbour")
    judged = judged.select("vec_id", "neighbour", F.when(F.col("vec_id") % 10 == F.col("neighbour") % 10, 2).otherwise(1).alias("grade"))
    m = T.ranked_metrics(nearest_exact(spark, d), judged, "vec_id", "neighbour")
    return m.select("vec_id", "k", *[F.round(c, 6).alias(c) for c in ("recall", "hit", "precision", "reciprocal_rank", "ndcg")])


def paired_difference(spark, d):
    """Clicks less views of each user's days, drawn by user."""
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "click").cast("double").alias("clicks"), F.count_if(F.col("event_type") == "view").cast("double").alias("views"))
    b = T.paired_bootstrap(e.withColumn("pair", F.concat_ws("|", F.col("user_id").cast("string"), F.col("day").cast("string"))), "pair", "clicks", "views", "user_id", 200)
    return b.select(F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


def permutation_users(spark, d):
    """Whether users click more than they view: signs drawn for each user."""
    e = table(spark, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "click") - F.count_if(F.col("event_type") == "view")).cast("double").alias("x"))
    return T.sign_flip_test(e, "x", 0, "user_id", 1000).select("pairs", F.round("statistic", 6).alias("statistic"), F.round("p_value", 6).alias("p_value"))


def bootstrap_users(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("v"))
    b = T.bootstrap_mean(u, "user_id", "v", 200)
    return b.select(F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


def permutation_weekdays(spark, d):
    """Clicks against views by weekday."""
    e = table(spark, d, "events").groupBy(F.dayofweek("ts").alias("dow")).agg(F.count_if(F.col("event_type") == "click").alias("a"), F.count_if(F.col("event_type") == "view").alias("b"))
    r = T.sign_flip_test(e.select((F.col("a") - F.col("b")).cast("double").alias("x")), "x")
    return r.select("pairs", F.round("statistic", 6).alias("statistic"), F.round("p_value", 6).alias("p_value"))


def centroid_sweep(spark, d):
    """F1 of "belongs to its label" by the product with the label's mean vector."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    m = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    # a mean vector a label: as many rows as labels, joined to every vector
    m = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean")).select(F.col("label").alias("of"), "mean")
    x = e.crossJoin(F.broadcast(m))
    dot = F.aggregate(F.zip_with("embedding", "mean", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, v: a + v)
    s = x.select(dot.alias("score"), (F.col("label") == F.col("of")).alias("truth"))
    return T.threshold_sweep(s, "score", "truth").select(F.round("threshold", 2).alias("threshold"), "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


def paired_runs(spark, d):
    """Two retrieval runs compared query by query; both must have every query."""
    a = search_bm25(spark, d).groupBy("query_id").agg(F.collect_set("doc_id").alias("a"))
    b = S.coverage(texts(spark, d), probes(spark), 10).groupBy("query_id").agg(F.collect_set("doc_id").alias("b"))
    j = a.join(b, "query_id", "full")
    both = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a query is missing in one run")).cast("int")).otherwise(F.size(F.array_intersect("a", "b")))
    return j.select("query_id", both.alias("shared"), F.round(both / F.size(F.array_union("a", "b")), 6).alias("jaccard"))


def latency_percentiles(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.stddev_samp("value"), 6).alias("spread"))


def majority_label(spark, d):
    """The most frequent section of every source, first in the alphabet of equals."""
    n = texts(spark, d).where("section is not null and source is not null").groupBy("source", "section").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("n"), "section")
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


QUERIES = {
    "qa_answerability": answerable, "qa_claims": claim_counts, "qa_best_sentences": best_sentences, "qa_answer_points": answer_points, "qa_support": citation_support, "qa_atomic_claims": atomic_claims, "qa_claim_support": claim_support, "qa_title_containment": title_containment, "stat_ranked_metrics": ranked_metrics,
    "qa_question_terms": question_terms,
    "stat_wilson": wilson_by_category, "stat_bootstrap": bootstrap_users, "stat_paired_bootstrap": paired_difference, "stat_permutation_drawn": permutation_users, "stat_permutation": permutation_weekdays, "stat_threshold_sweep": centroid_sweep, "stat_paired_runs": paired_runs,
    "stat_percentiles_by_user": latency_percentiles, "stat_majority": majority_label,
}

_CL = f"cl AS (SELECT * FROM (SELECT doc_id, unnest({_SENT}) claim, generate_subscripts({_SENT}, 1) n FROM documents WHERE text IS NOT NULL))"
_BARE = r"regexp_replace({x}, '[ \t\n\r\f\v]*\[[^\[\]]+\][ \t\n\r\f\v]*', ' ', 'g')"
_CLAUSES = rf"flatten(list_transform({_SENT}, lambda s: string_split(regexp_replace(regexp_replace(s, '[ ]*;[ ]+', chr(2), 'g'), ',[ ]+(but|however|whereas|although)[ ]+', chr(2), 'g'), chr(2))))"
_STRIP = r"regexp_replace(x, '^[ \-:;,.]+|[ \-:;,.]+$', '', 'g')"
_ZZ = "1.959963984540054::DOUBLE"
SQL = {
    "qa_answerability": f"""WITH {_BM}, q AS (SELECT query_id, list_distinct({_TOK('query')}) want FROM {_Q}), h AS ({_RANK('s', 10)}),
        x AS (SELECT h.query_id, want, len(list_intersect(want, {_TOK('text')})) / greatest(len(want), 1) share FROM h JOIN q USING (query_id) JOIN documents USING (doc_id)),
        p AS (SELECT query_id, max(share) best, count(*) FILTER (WHERE share >= CASE WHEN len(want) >= 4 THEN 0.25 ELSE 0.34 END) relevant FROM x GROUP BY 1)
        SELECT query_id, CAST(len(want) AS INTEGER) AS terms, round(coalesce(best, 0.0), 6) AS max_coverage, coalesce(relevant, 0) AS relevant,
        CASE WHEN best IS NULL THEN 'no_retrieved_chunks' WHEN len(want) = 0 THEN 'no_terms' WHEN relevant = 0 THEN 'low_coverage' ELSE 'answerable' END AS reason FROM q LEFT JOIN p USING (query_id)""",
    "qa_claims": f"WITH {_CL} SELECT doc_id, count(*) AS claims, count(*) FILTER (WHERE regexp_matches(claim, '\\[[0-9]+\\]')) AS with_marker FROM cl WHERE len({_TOK('claim')}) >= 4 GROUP BY 1",
    "qa_best_sentences": f"""WITH {_CL}, h AS (SELECT *, len(list_intersect(['random', 'forests', 'error', 'labels'], {_TOK('claim')})) hits FROM cl WHERE len({_TOK('claim')}) >= 1)
        SELECT doc_id, CAST(hits AS INTEGER) AS hits, claim AS sentence FROM h WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, n) = 1""",
    "qa_answer_points": f"""SELECT case_id, CAST(len(answer_points) AS INTEGER) AS points, CAST(len(list_filter(answer_points, lambda p: len(p.groups) > 0 AND len(list_filter(p.groups, lambda g: len(list_filter(g, lambda w: contains(lower(question), lower(w)))) > 0)) = len(p.groups))) AS INTEGER) AS covered
        FROM {QA} WHERE question IS NOT NULL AND answer_points IS NOT NULL""",
    "qa_support": f"""WITH {_CL}, t AS (SELECT doc_id, n, list_distinct({_TOK('claim')}) t FROM cl WHERE len({_TOK('claim')}) >= 4), u AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY n) u FROM t)
        SELECT doc_id, count(*) AS pairs, count(*) FILTER (WHERE len(list_intersect(t, u)) / len(t) >= 0.08) AS supported FROM u WHERE u IS NOT NULL GROUP BY 1""",
    "qa_question_terms": f"SELECT term, count(*) AS questions FROM (SELECT unnest(list_distinct({_TOK('question')})) term FROM {QA}) WHERE length(term) > 2 GROUP BY 1 HAVING count(*) >= 3",
    "stat_wilson": f"""WITH g AS (SELECT category, count(*) FILTER (WHERE expected_answerable) yes, count(*) n FROM {QA} GROUP BY 1), p AS (SELECT *, yes / n p FROM g)
        SELECT category, yes, n, round((p + {_ZZ} * {_ZZ} / (2 * n)) / (1 + {_ZZ} * {_ZZ} / n) - {_ZZ} * sqrt(p * (1 - p) / n + {_ZZ} * {_ZZ} / (4 * n * n)) / (1 + {_ZZ} * {_ZZ} / n), 6) AS low,
        round((p + {_ZZ} * {_ZZ} / (2 * n)) / (1 + {_ZZ} * {_ZZ} / n) + {_ZZ} * sqrt(p * (1 - p) / n + {_ZZ} * {_ZZ} / (4 * n * n)) / (1 + {_ZZ} * {_ZZ} / n), 6) AS high FROM p""",
    "stat_bootstrap": f"""WITH u AS (SELECT user_id, avg(value) v FROM events GROUP BY user_id), w AS (SELECT rep, v, CAST('0x' || substr(md5('20260712:' || rep || ':' || user_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE x FROM u, range(200) r(rep)),
        k AS (SELECT rep, v, CASE {' '.join(f'WHEN x < {p!r}::DOUBLE THEN {i}' for i, p in enumerate(T.POISSON))} ELSE {len(T.POISSON)} END w FROM w), m AS (SELECT rep, sum(w * v) / sum(w) m FROM k GROUP BY 1)
        SELECT round((SELECT avg(v) FROM u), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, (SELECT count(*) FROM u) AS n FROM m""",
    "qa_atomic_claims": f"""WITH c AS (SELECT doc_id, {_CLAUSES} cl FROM (SELECT doc_id, {_BARE.format(x='text')} AS text FROM documents WHERE text IS NOT NULL)), k AS (SELECT doc_id, {_STRIP} claim FROM (SELECT doc_id, unnest(cl) x FROM c))
        SELECT doc_id, count(*) AS claims, CAST(sum(length(claim)) AS BIGINT) AS characters FROM k WHERE len({_TOK('claim')}) >= 4 GROUP BY 1""",
    "qa_claim_support": f"""WITH q AS (SELECT case_id, gold_locator.paper_id paper_id, question FROM {QA}), c AS (SELECT case_id, paper_id, {_CLAUSES} cl FROM (SELECT case_id, paper_id, {_BARE.format(x='question')} AS text FROM q WHERE question IS NOT NULL)),
        k AS (SELECT case_id, paper_id, n, {_STRIP} claim FROM (SELECT case_id, paper_id, unnest(cl) x, generate_subscripts(cl, 1) - 1 n FROM c)), t AS (SELECT case_id, paper_id, n, list_distinct({_TOK('claim')}) t FROM k WHERE len({_TOK('claim')}) >= 4),
        h AS (SELECT DISTINCT paper_id, unnest({_TOK('text')}) token FROM documents WHERE paper_id IS NOT NULL), g AS (SELECT DISTINCT paper_id FROM documents WHERE paper_id IS NOT NULL AND text IS NOT NULL),
        s AS (SELECT case_id, n, count(*) hits FROM (SELECT case_id, n, paper_id, unnest(t) token FROM t) JOIN h USING (paper_id, token) GROUP BY 1, 2),
        r AS (SELECT t.case_id, CAST(t.n AS INTEGER) n, t.paper_id, coalesce(hits, 0) / greatest(len(t), 1) o, g.paper_id IS NOT NULL known FROM t LEFT JOIN s ON s.case_id = t.case_id AND s.n = t.n LEFT JOIN g ON g.paper_id = t.paper_id)
        SELECT case_id, n, paper_id, round(o, 6) AS overlap, CASE WHEN NOT known THEN 'no_source' WHEN o >= 0.8 THEN 'supported' WHEN o >= 0.5 THEN 'partial' ELSE 'unsupported' END AS support FROM r""",
    "qa_title_containment": f"""WITH x AS (SELECT case_id, list_filter(list_distinct({_TOK('title')}), lambda t: length(t) > 3) a, list_filter(list_distinct({_TOK('question')}), lambda t: length(t) > 3) b FROM (SELECT case_id, question, gold_locator.paper_id paper_id FROM {QA} WHERE question IS NOT NULL) JOIN {PAPERS} USING (paper_id))
        SELECT case_id, CAST(len(list_intersect(a, b)) AS INTEGER) AS shared, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0.0 END, 6) AS share FROM x""",
    "stat_paired_bootstrap": f"""WITH e AS (SELECT user_id, CAST(ts AS DATE) d, count(*) FILTER (WHERE event_type = 'click') - count(*) FILTER (WHERE event_type = 'view') x FROM events GROUP BY 1, 2), u AS (SELECT user_id, CAST(sum(x) AS DOUBLE) s, count(*) n FROM e GROUP BY 1),
        w AS (SELECT rep, s, n, CAST('0x' || substr(md5('20260712:' || rep || ':' || user_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE x FROM u, range(200) r(rep)),
        k AS (SELECT rep, s, n, CASE {' '.join(f'WHEN x < {p!r}::DOUBLE THEN {i}' for i, p in enumerate(T.POISSON))} ELSE {len(T.POISSON)} END w FROM w), m AS (SELECT rep, sum(w * s) / sum(w * n) m FROM k GROUP BY 1)
        SELECT round((SELECT sum(s) / sum(n) FROM u), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, (SELECT CAST(sum(n) AS BIGINT) FROM u) AS n FROM m""",
    "stat_permutation_drawn": """WITH e AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') - count(*) FILTER (WHERE event_type = 'view') x FROM events GROUP BY 1), g AS (SELECT * FROM e WHERE x <> 0),
        t AS (SELECT rep, abs(sum(CASE WHEN CAST('0x' || substr(md5('20260712:' || rep || ':' || user_id), 1, 8) AS BIGINT) % 2 = 0 THEN x ELSE -x END)) t FROM g, range(1000) r(rep) GROUP BY 1), s AS (SELECT count(*) n, sum(x) s FROM g)
        SELECT CAST(any_value(n) AS INTEGER) AS pairs, round(any_value(s) / any_value(n), 6) AS statistic, round((count(*) FILTER (WHERE t >= abs(s)) + 1) / 1001, 6) AS p_value FROM t, s""",
    "stat_permutation": """WITH e AS (SELECT dayofweek(ts) dow, CAST(count(*) FILTER (WHERE event_type = 'click') - count(*) FILTER (WHERE event_type = 'view') AS DOUBLE) x FROM events GROUP BY 1), d AS (SELECT row_number() OVER (ORDER BY x) - 1 i, x FROM e WHERE x <> 0),
        f AS (SELECT id, abs(sum(CASE WHEN (id >> CAST(i AS BIGINT)) & 1 = 1 THEN -x ELSE x END)) t FROM range((SELECT 1 << count(*) FROM d)) r(id), d GROUP BY 1)
        SELECT (SELECT CAST(count(*) AS INTEGER) FROM d) AS pairs, (SELECT round(avg(x), 6) FROM d) AS statistic, round(avg(CASE WHEN t >= (SELECT abs(sum(x)) FROM d) - 1e-12 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p_value FROM f""",
    "stat_threshold_sweep": """WITH x AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) x, generate_subscripts(embedding, 1) i FROM embeddings), m AS (SELECT label AS l, i, avg(x) m FROM x GROUP BY 1, 2),
        s AS (SELECT vec_id, label = l truth, sum(x * m) score FROM x JOIN m USING (i) GROUP BY 1, 2, l), t AS (SELECT unnest(range(20, 61)) b)
        SELECT round(b / 100, 2) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(p - tp AS BIGINT) AS fn, round(2 * tp / (tp + fp + p), 6) AS f1 FROM (SELECT b, count(*) FILTER (WHERE truth AND floor(score * 100 + 1e-9) >= b) tp, count(*) FILTER (WHERE NOT truth AND floor(score * 100 + 1e-9) >= b) fp, count(*) FILTER (WHERE truth) p FROM s, t GROUP BY 1)""",
    "stat_percentiles_by_user": "SELECT user_id, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_samp(value), 6) AS spread FROM events GROUP BY 1",
    "stat_majority": "SELECT source, section, n FROM (SELECT source, section, count(*) n FROM documents WHERE section IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, section) = 1",
}


def _paired():
    from lectern.plans.retrieval import _COV

    return f"""WITH {_BM}, {_COV}, a AS (SELECT query_id, doc_id FROM ({_RANK('s', 10)})), b AS (SELECT query_id, doc_id FROM ({_RANK('cov', 10)})),
        both_ AS (SELECT query_id, count(*) shared FROM a JOIN b USING (query_id, doc_id) GROUP BY 1), u AS (SELECT query_id, count(*) al FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY 1)
        SELECT query_id, CAST(coalesce(shared, 0) AS INTEGER) AS shared, round(coalesce(shared, 0) / al, 6) AS jaccard FROM u LEFT JOIN both_ USING (query_id)"""


SQL["stat_paired_runs"] = _paired()


def _ranked():
    from lectern.plans.retrieval import _NN

    cut = ", ".join(f"({k})" for k in (3, 5, 10))
    return f"""WITH {_NN}, j AS (SELECT a.vec_id, b.vec_id neighbour, CASE WHEN a.vec_id % 10 = b.vec_id % 10 THEN 2 ELSE 1 END grade FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
        o AS (SELECT vec_id, grade, row_number() OVER (PARTITION BY vec_id ORDER BY grade DESC) r FROM j), kk(k) AS (VALUES {cut}), h AS (SELECT nn.vec_id, rank r, grade FROM nn JOIN j USING (vec_id, neighbour)), q AS (SELECT vec_id, count(*) n FROM j GROUP BY 1),
        i AS (SELECT vec_id, k, sum((pow(2.0, grade) - 1) / log2(r + 1.0::DOUBLE)) v FROM o, kk WHERE r <= k GROUP BY 1, 2), g AS (SELECT vec_id, k, count(*) h, min(r) f, sum((pow(2.0, grade) - 1) / log2(r + 1.0::DOUBLE)) v FROM h, kk WHERE r <= k GROUP BY 1, 2)
        SELECT q.vec_id AS vec_id, i.k AS k, round(coalesce(h, 0) / n, 6) AS recall, CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit, round(coalesce(h, 0) / i.k, 6) AS precision, round(coalesce(1 / f, 0.0), 6) AS reciprocal_rank, round(coalesce(g.v / i.v, 0.0), 6) AS ndcg
        FROM q JOIN i ON i.vec_id = q.vec_id LEFT JOIN g ON g.vec_id = q.vec_id AND g.k = i.k"""


SQL["stat_ranked_metrics"] = _ranked()
