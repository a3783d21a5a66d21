"""Window and ranking queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import ranking as K
from lectern.operators import relational as R
from lectern.plans.catalog import documents, papers
from lectern.session import cut, table


def longest_by_source(spark, d):
    x = documents(spark, d).where("source is not null").select("doc_id", F.lower(F.trim("source")).alias("source"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    return R.top_k(x, ["source"], [F.desc("size"), F.col("doc_id")], 3)


def first_passage_rank(spark, d):
    """A paper's rank is that of its longest passage; ranks are renumbered."""
    x = documents(spark, d).where("paper_id is not null").select("doc_id", "paper_id", "lang", F.length(F.coalesce("text", F.lit(""))).alias("size")).where("lang is not null")
    best = R.top_k(x, ["lang", "paper_id"], [F.desc("size"), F.col("doc_id")], 1).drop("rank")
    return R.top_k(best, ["lang"], [F.desc("size"), F.col("doc_id")], 20)


def latest_event(spark, d):
    """The latest event of every user: one aggregate instead of a sort."""
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x"), F.count("*").alias("events")).select("user_id", "x.ts", "x.event_id", "x.event_type", "events")


def chain_gaps(spark, d):
    """Links of each user's event chain: the event before and the time since."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.lag("event_id").over(w).alias("previous_id"), F.lag("ts").over(w).alias("before"))
    return e.select("user_id", "event_id", "previous_id", F.timestamp_diff("SECOND", "before", "ts").alias("seconds"))


CHAINED = ["event_id", "event_type", "props"]


def chain_check(spark, d):
    """A stored hash chain over each user's events, verified link by link against
    the events, and against events of which every 97th was altered."""
    e = table(spark, d, "events").select("user_id", "ts", *CHAINED)
    stored = cut(K.chain(e, "user_id", ["ts", "event_id"], "event_id", CHAINED), "chain")
    altered = e.withColumn("props", F.when(F.col("event_id") % 97 == 0, F.lit("{}")).otherwise(F.col("props")))
    good = K.verify_chain(stored, e, "event_id", CHAINED).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("previous").isNull()).alias("genesis"), F.count_if("valid").alias("valid"))
    bad = K.verify_chain(stored, altered, "event_id", CHAINED).groupBy("user_id").agg(F.count_if(~F.col("valid")).alias("broken"))
    return good.join(bad, "user_id")


def sliding_limit(spark, d):
    """How many events of its user each event saw in the last hour, and whether
    a limit of two would have admitted it."""
    seen = F.expr("count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)")
    return table(spark, d, "events").select("event_id", "user_id", seen.alias("seen")).withColumn("admitted", F.col("seen") <= 2)


def tumbling_counts(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def user_sessions(spark, d):
    return K.sessions(table(spark, d, "events"), "user_id", "ts", 4 * 3600).select("user_id", F.col("session").cast("long").alias("session"), "start", "end", "n")


def forward_fill(spark, d):
    """The section in force at each passage: the last one named before it."""
    w = Window.partitionBy("paper_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return documents(spark, d).where("paper_id is not null").select("doc_id", "paper_id", F.last("section", ignorenulls=True).over(w).alias("section_in_force"))


def holm_by_day(spark, d):
    """Holm over the event types: p is the share of days on which a type had at
    least as many events as on its last day."""
    day = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    last = day.groupBy("event_type").agg(F.max(F.struct("day", "n")).alias("x")).select("event_type", F.col("x.n").alias("n_last"))
    p = day.join(last, "event_type").groupBy("event_type").agg((F.count_if(F.col("n") >= F.col("n_last")) / F.count("*")).alias("p"))
    return K.holm(p, "p", "event_type", 0.5).select("event_type", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"), "rejected")


def source_displacement(spark, d):
    """How far the ten sources with most texts and with most characters differ."""
    x = documents(spark, d).where("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("size")).withColumn("all", F.lit(1))
    a = R.top_k(x, ["all"], [F.desc("n"), F.col("source")], 10)
    b = R.top_k(x, ["all"], [F.desc("size"), F.col("source")], 10)
    return K.displacement(a, b, "source", 10).select(F.round("mean_displacement", 6).alias("mean_displacement"), "items")


def priority_passages(spark, d):
    """Four passages a paper by section priority, back in reading order."""
    weight = F.when(F.col("section") == "Conclusion", 5).when(F.col("section") == "Results", 4).when(F.col("section") == "Abstract", 3).when(F.col("section").isNotNull(), 1).otherwise(0)
    x = R.top_k(documents(spark, d).where("paper_id is not null").select("paper_id", "doc_id", "section", weight.alias("priority")), ["paper_id"], [F.desc("priority"), F.col("doc_id")], 4)
    return x.select("paper_id", "doc_id", "section", "priority", F.row_number().over(Window.partitionBy("paper_id").orderBy("doc_id")).alias("place"))


def diversified(spark, d):
    """Longest passages of each section, spread over papers."""
    x = documents(spark, d).where("section is not null and paper_id is not null").select("section", "paper_id", "doc_id", (F.length(F.coalesce("text", F.lit(""))) / 5000).alias("base"))
    pool = K.diversity_pool(x.withColumn("chunk_index", F.col("doc_id")), "section", 10)
    return K.diversify(pool, "section", 10).select("section", "doc_id", "paper_id", F.round("diversified", 6).alias("diversified"), "chosen")


def running_totals(spark, d):
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select("o_orderkey", "o_custkey", F.row_number().over(w).alias("nth"), F.count("*").over(w.rowsBetween(-2, 0)).alias("of_last_three"), F.ntile(4).over(w).alias("quarter"))


def venue_rank(spark, d):
    n = papers(spark, d).where("venue is not null and pub_year is not null").groupBy("pub_year", "venue").agg(F.count("*").alias("papers"))
    w = Window.partitionBy("pub_year").orderBy(F.desc("papers"))
    return n.select("pub_year", "venue", "papers", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense_rank"))


QUERIES = {
    "rank_longest_by_source": longest_by_source, "rank_first_passage": first_passage_rank, "rank_latest_event": latest_event, "rank_chain_gaps": chain_gaps, "rank_chain_check": chain_check,
    "rank_sliding_limit": sliding_limit, "rank_tumbling_counts": tumbling_counts, "rank_user_sessions": user_sessions, "rank_forward_fill": forward_fill, "rank_holm": holm_by_day,
    "rank_displacement": source_displacement, "rank_priority_passages": priority_passages, "rank_diversified": diversified, "rank_running": running_totals, "rank_venues": venue_rank,
}
_PRIO = "CASE WHEN section = 'Conclusion' THEN 5 WHEN section = 'Results' THEN 4 WHEN section = 'Abstract' THEN 3 WHEN section IS NOT NULL THEN 1 ELSE 0 END"
SQL = {
    "rank_longest_by_source": """SELECT doc_id, source, size, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id) AS rank FROM
        (SELECT doc_id, lower(trim(source)) source, length(coalesce(text, '')) size FROM documents WHERE source IS NOT NULL)) WHERE rank <= 3""",
    "rank_first_passage": """WITH x AS (SELECT doc_id, paper_id, lang, length(coalesce(text, '')) size FROM documents WHERE paper_id IS NOT NULL AND lang IS NOT NULL),
        b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, paper_id ORDER BY size DESC, doc_id) = 1)
        SELECT doc_id, paper_id, lang, size, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY size DESC, doc_id) AS rank FROM b) WHERE rank <= 20""",
    "rank_latest_event": "SELECT user_id, ts, event_id, event_type, events FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS events, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "rank_chain_gaps": """SELECT user_id, event_id, lag(event_id) OVER w AS previous_id, CAST(trunc((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000) AS BIGINT) AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "rank_chain_check": """WITH e AS (SELECT *, event_id % 97 = 0 AND props <> '{}' hit FROM events), l AS (SELECT *, lag(hit) OVER w before, lag(event_id) OVER w prev FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, count(*) AS n, count(*) FILTER (WHERE prev IS NULL) AS genesis, count(*) AS valid, count(*) FILTER (WHERE hit OR before) AS broken FROM l GROUP BY 1""",
    "rank_sliding_limit": """SELECT event_id, user_id, seen, seen <= 2 AS admitted FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS seen FROM events)""",
    "rank_tumbling_counts": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "rank_user_sessions": """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 14400000000 THEN 1 ELSE 0 END s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM n GROUP BY 1, 2""",
    "rank_forward_fill": "SELECT doc_id, paper_id, last_value(section IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS section_in_force FROM documents WHERE paper_id IS NOT NULL",
    "rank_holm": """WITH t AS (SELECT event_type, CAST(ts AS DATE) dd, count(*) n FROM events GROUP BY 1, 2), l AS (SELECT event_type, arg_max(n, dd) n_last FROM t GROUP BY 1),
        p AS (SELECT event_type, count(*) FILTER (WHERE n >= n_last) / count(*) p FROM t JOIN l USING (event_type) GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, event_type) i, count(*) OVER () m FROM p),
        a AS (SELECT *, least(1.0, max(p * (m - i + 1)) OVER (ORDER BY p, event_type ROWS UNBOUNDED PRECEDING)) adj FROM r) SELECT event_type, round(p, 6) AS p, round(adj, 6) AS adjusted, adj <= 0.5 AS rejected FROM a""",
    "rank_displacement": """WITH x AS (SELECT source, count(*) n, sum(length(coalesce(text, ''))) size FROM documents WHERE source IS NOT NULL GROUP BY 1), a AS (SELECT source, row_number() OVER (ORDER BY n DESC, source) r FROM x QUALIFY r <= 10),
        b AS (SELECT source, row_number() OVER (ORDER BY size DESC, source) r FROM x QUALIFY r <= 10) SELECT round(avg(abs(coalesce(a.r, 11) - coalesce(b.r, 11))), 6) AS mean_displacement, count(*) AS items FROM a FULL JOIN b ON a.source = b.source""",
    "rank_priority_passages": f"""WITH x AS (SELECT paper_id, doc_id, section, {_PRIO} priority FROM documents WHERE paper_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY {_PRIO} DESC, doc_id) <= 4)
        SELECT paper_id, doc_id, section, priority, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY doc_id) AS INTEGER) AS place FROM x""",
    "rank_running": """SELECT o_orderkey, o_custkey, CAST(row_number() OVER w AS INTEGER) AS nth, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS of_last_three,
        CAST(ntile(4) OVER w AS INTEGER) AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "rank_venues": """WITH n AS (SELECT pub_year, venue, count(DISTINCT paper_id) papers FROM papers WHERE venue IS NOT NULL AND pub_year IS NOT NULL GROUP BY 1, 2)
        SELECT pub_year, venue, papers, CAST(rank() OVER w AS INTEGER) AS rank, CAST(dense_rank() OVER w AS INTEGER) AS dense_rank FROM n WINDOW w AS (PARTITION BY pub_year ORDER BY papers DESC)""",
}
