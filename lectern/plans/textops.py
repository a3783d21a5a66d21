"""Text queries: tokens, sentences, sections, topics, ids, chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.chunking import chunk_documents
from lectern.plans.catalog import PAPERS, QA, cases, documents, texts, papers
from lectern.session import table


def token_counts(spark, d):
    t = X.tokens(F.col("text"))
    return texts(spark, d).select("doc_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("distinct_tokens"))


def word_counts(spark, d):
    w = F.filter(F.split(F.trim(F.regexp_replace("text", r"[ \t\n\r\f]+", " ")), " "), lambda x: x != "")
    return texts(spark, d).where("text is not null").select("doc_id", F.size(w).alias("words"), F.floor(F.size(w) * F.lit(1.3)).cast("long").alias("token_estimate"))


def sentence_counts(spark, d):
    s = X.sentences(F.col("text"))
    return texts(spark, d).where("text is not null").select("doc_id", F.size(s).alias("sentences"), F.coalesce(F.array_max(F.transform(s, lambda x: F.length(x))), F.lit(0)).alias("longest"))


def first_heading(spark, d):
    """The section of the first line of each passage that is a heading."""
    lines = F.transform(F.split("text", "\n"), lambda x: X.section_of(x))
    first = F.get(F.filter(lines, lambda x: x.isNotNull()), 0)
    return texts(spark, d).where("text is not null").select("doc_id", F.coalesce(first, F.lit("Unknown")).alias("inferred")).groupBy("inferred").agg(F.count("*").alias("n"))


def section_names(spark, d):
    return texts(spark, d).groupBy(F.coalesce(X.section_of(F.col("section")), F.lit("Unknown")).alias("canonical"), "section").agg(F.count("*").alias("n"))


def passage_ids(spark, d):
    """Stable ids: paper, order in the paper, and the start of the text's hash."""
    w = Window.partitionBy("paper_id").orderBy("doc_id")
    x = texts(spark, d).where("paper_id is not null and text is not null").withColumn("i", F.row_number().over(w) - 1)
    return x.select("doc_id", F.concat(F.col("paper_id"), F.lit("-chunk-"), F.lpad(F.col("i").cast("string"), 4, "0"), F.lit("-"), F.substring(F.sha1("text"), 1, 12)).alias("passage_id"), F.sha2("text", 256).alias("source_hash"))


def paper_slugs(spark, d):
    return papers(spark, d).select("paper_id", F.concat(X.slug(F.col("title"), 65), F.lit("-"), F.substring(F.sha1("title"), 1, 8)).alias("made"))


def date_years(spark, d):
    return papers(spark, d).select("paper_id", X.year_of(F.col("publication_date_raw")).alias("year"), "pub_year")


def topics_in_text(spark, d):
    """Controlled topics by texts: one scan, an array of the topics found."""
    lines = texts(spark, d).where("text is not null").select("doc_id", X.token_line(F.col("text")).alias("line"))
    return lines.select("doc_id", F.explode(X.topics_of(F.col("line"))).alias("topic"))


def topic_scores(spark, d):
    """Topics of a paper by weighted evidence: 2.4 in the title, 2.8 as its own
    topic, 0.45 for every passage that names it; kept from 1.35."""
    named = topics_in_text(spark, d).join(documents(spark, d).select("doc_id", "paper_id"), "doc_id").where("paper_id is not null").select("paper_id", "topic", F.lit(45).alias("points"))
    own = papers(spark, d).select("paper_id", F.explode("topics").alias("topic"), F.lit(280).alias("points"))
    title = papers(spark, d).select("paper_id", F.explode(X.topics_of(X.token_line(F.col("title")))).alias("topic"), F.lit(240).alias("points"))
    s = named.unionByName(own).unionByName(title).groupBy("paper_id", "topic").agg(F.sum("points").alias("points")).where("points >= 135")
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("points"), "topic"))).where("rank <= 8")


def title_on_pages(spark, d):
    """Share of the title's tokens on each of the first eight pages, best page."""
    t = papers(spark, d).select("paper_id", F.array_distinct(X.tokens(F.col("title"))).alias("want")).where(F.size("want") > 0)
    o = table(spark, d, "ocr").where("page_number between 1 and 8 and text is not null").select("paper_id", "page_number", "text").dropDuplicates(["paper_id", "page_number"])
    x = o.join(t, "paper_id").select("paper_id", "page_number", F.size(F.array_intersect("want", X.tokens(F.col("text")))).alias("hits"), F.size("want").alias("of"))
    best = x.groupBy("paper_id").agg(F.max(F.struct("hits", (-F.col("page_number")).alias("p"), "of")).alias("b"))
    return best.select("paper_id", (-F.col("b.p")).alias("page_number"), F.col("b.hits").alias("hits"), (F.col("b.hits") >= F.col("b.of") * 0.6).alias("matched"))


def spelling_distance(spark, d):
    """Edit distance of a paper's id from the slug of its title."""
    return papers(spark, d).select("paper_id", F.levenshtein(F.col("paper_id"), X.slug(F.col("title"), 65)).alias("distance"))


def cleaned_text(spark, d):
    """Links, addresses and spaces before punctuation taken out."""
    c = F.regexp_replace(F.col("text"), r"https?://[^ \n]+|[a-zA-Z0-9._-]+@[a-zA-Z0-9.-]+", "")
    c = F.regexp_replace(c, r"[ \t]+([,.;:!?])", "$1")
    return texts(spark, d).where("text is not null").select("doc_id", F.md5(c).alias("cleaned_md5"))


def query_expansion(spark, d):
    """What the questions also ask for."""
    return cases(spark, d).where("question is not null").select("case_id", F.array_join(X.expansions(F.col("question")), "|").alias("additions")).where("additions <> ''")


def term_postings(spark, d):
    """The inverted index in terms: in how many texts a term is, and how often."""
    t = texts(spark, d).select("doc_id", F.explode(X.tokens(F.col("text"))).alias("term"))
    n = t.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return n.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"), F.max("tf").alias("most")).where("df >= 2")


def chunks(spark, d):
    return chunk_documents(texts(spark, d), "doc_id", "text", words=120, chars=900, overlap=20, least=80).select("doc_id", "chunk_index", "word_count", "char_count", F.md5("text").alias("text_md5"))


QUERIES = {
    "text_tokens": token_counts, "text_words": word_counts, "text_sentences": sentence_counts, "text_first_heading": first_heading, "text_section_names": section_names, "text_passage_ids": passage_ids,
    "text_paper_slugs": paper_slugs, "text_years": date_years, "text_topics": topics_in_text, "text_topic_scores": topic_scores, "text_title_on_pages": title_on_pages, "text_edit_distance": spelling_distance,
    "text_cleaned": cleaned_text, "text_query_expansion": query_expansion, "text_postings": term_postings, "text_chunks": chunks,
}


_LINE = lambda c: f"(' ' || trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')) || ' ')"


def _has(line, terms):
    import re

    return "(" + " OR ".join(f"contains({line}, ' {' '.join(re.findall('[a-z0-9]+', t))} ')" for t in terms) + ")"


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_TOK = lambda c: f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]{{2,}}'), lambda t: t NOT IN ({_STOP}))"
_ALIAS = ", ".join(f"('{n}', '{s}')" for s, names in X.SECTION_ALIASES.items() for n in names)
_PLAIN = lambda c: (
    rf"regexp_replace(trim(regexp_replace(regexp_replace(replace(regexp_replace(lower(trim({c})), '^([0-9]+(\.[0-9]+)*|[ivxlc]+)[.)]?[ \t\n\r\f]+', ''), '&', ' and '), '[_\-—–]+', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')), '[ \t\n\r\f:.;]+$', '')"
)
_FOUND = lambda line: "list_filter([" + ", ".join(f"CASE WHEN {_has(line, v)} THEN '{k}' END" for k, v in X.TOPIC_TERMS.items()) + "], lambda x: x IS NOT NULL)"
_TOPICS = f"SELECT doc_id, unnest({_FOUND('l')}) AS topic FROM (SELECT doc_id, {_LINE('text')} l FROM documents WHERE text IS NOT NULL)"
_TITLES = f"SELECT paper_id, unnest({_FOUND('l')}) AS topic, 240 AS points FROM (SELECT paper_id, {_LINE('title')} l FROM {PAPERS})"
_SLUG = "trim(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 65))"
_WORDS = r"list_filter(string_split(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), ' '), lambda x: x <> '')"
_SENT = r"list_filter(string_split(regexp_replace(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), '([.!?]) +([A-Z0-9(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: s <> '')"


def _exp():
    parts = [f"CASE WHEN {_has('q', [p])} AND NOT {_has('q', [m])} THEN '{m}' END" for p, more in X.QUERY_EXPANSIONS.items() for m in more]
    lst = f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"
    return f"SELECT case_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS additions FROM (SELECT case_id, {lst} l FROM (SELECT case_id, {_LINE('question')} q FROM {QA} WHERE question IS NOT NULL)) WHERE len(l) > 0"


SQL = {
    "text_tokens": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS tokens, CAST(len(list_distinct(t)) AS INTEGER) AS distinct_tokens FROM (SELECT doc_id, {_TOK('text')} t FROM documents)",
    "text_words": f"SELECT doc_id, CAST(len(w) AS INTEGER) AS words, CAST(floor(len(w) * 1.3::DOUBLE) AS BIGINT) AS token_estimate FROM (SELECT doc_id, {_WORDS} w FROM documents WHERE text IS NOT NULL)",
    "text_sentences": f"SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM (SELECT doc_id, {_SENT} s FROM documents WHERE text IS NOT NULL)",
    "text_first_heading": f"""WITH a(name, section) AS (VALUES {_ALIAS}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i FROM documents WHERE text IS NOT NULL),
        h AS (SELECT doc_id, arg_min(section, i) s FROM l JOIN a ON a.name = {_PLAIN('line')} GROUP BY 1) SELECT coalesce(s, 'Unknown') AS inferred, count(*) AS n FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id WHERE text IS NOT NULL GROUP BY 1""",
    "text_section_names": f"WITH a(name, s) AS (VALUES {_ALIAS}) SELECT coalesce(a.s, 'Unknown') AS canonical, section, count(*) AS n FROM documents LEFT JOIN a ON a.name = {_PLAIN('section')} GROUP BY 1, 2",
    "text_passage_ids": """SELECT doc_id, paper_id || '-chunk-' || lpad(CAST(i AS VARCHAR), 4, '0') || '-' || substr(sha1(text), 1, 12) AS passage_id, sha256(text) AS source_hash
        FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY doc_id) - 1 i FROM documents WHERE paper_id IS NOT NULL AND text IS NOT NULL)""",
    "text_paper_slugs": f"SELECT paper_id, {_SLUG} || '-' || substr(sha1(title), 1, 8) AS made FROM {PAPERS}",
    "text_years": f"SELECT paper_id, CAST(nullif(regexp_extract(publication_date_raw, '((19|20)[0-9][0-9])', 1), '') AS INTEGER) AS year, pub_year FROM {PAPERS}",
    "text_topics": _TOPICS,
    "text_topic_scores": f"""WITH n AS (SELECT paper_id, topic, 45 points FROM ({_TOPICS}) JOIN documents USING (doc_id) WHERE paper_id IS NOT NULL), o AS (SELECT paper_id, unnest(topics) topic, 280 points FROM {PAPERS}), t AS ({_TITLES}),
        s AS (SELECT paper_id, topic, sum(points) points FROM (SELECT * FROM n UNION ALL SELECT * FROM o UNION ALL SELECT * FROM t) GROUP BY 1, 2 HAVING sum(points) >= 135)
        SELECT paper_id, topic, CAST(points AS BIGINT) AS points, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY points DESC, topic) rank FROM s) WHERE rank <= 8""",
    "text_title_on_pages": f"""WITH t AS (SELECT paper_id, list_distinct({_TOK('title')}) want FROM {PAPERS}), o AS (SELECT DISTINCT paper_id, page_number, text FROM ocr WHERE page_number BETWEEN 1 AND 8 AND text IS NOT NULL),
        x AS (SELECT o.paper_id, page_number, len(list_intersect(want, {_TOK('text')})) hits, len(want) n FROM o JOIN t ON o.paper_id = t.paper_id WHERE len(want) > 0)
        SELECT paper_id, page_number, CAST(hits AS INTEGER) AS hits, hits >= n * 0.6 AS matched FROM x QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY hits DESC, page_number) = 1""",
    "text_edit_distance": f"SELECT paper_id, levenshtein(paper_id, {_SLUG}) AS distance FROM {PAPERS}",
    "text_cleaned": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, 'https?://[^ \n]+|[a-zA-Z0-9._-]+@[a-zA-Z0-9.-]+', '', 'g'), '[ \t]+([,.;:!?])', '\1', 'g')) AS cleaned_md5 FROM documents WHERE text IS NOT NULL""",
    "text_query_expansion": _exp(),
    "text_postings": f"""SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS most FROM (SELECT term, doc_id, count(*) tf FROM (SELECT doc_id, unnest({_TOK('text')}) term FROM documents) GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 2""",
}
