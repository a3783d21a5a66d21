"""SQL for the pN_ queries that SQL can express on whole tables.

The others have none: byte-pair merges, approximate graphs and learned models
are not SQL; their tests compare them with brute force.  SQL folds accents but
not compatibility forms, which the project's questions and names do not have.
"""

#: Entries of author lists that name no person, written out here so
#: that an error in the operator's list shows.
NO_PERSON = (
    "", "anonymous", "author", "authors", "author unknown", "click here", "click to view", "download", "download pdf", "et al", "n a", "na", "none", "null", "read more", "source",
    "tba", "tbd", "unknown", "unknown author", "various", "various authors", "view", "view article", "view paper",
)

_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12)"
_LONGEST = "list_max(list_transform({units}, lambda x: length(trim(x, " + _WS + "))))"
_PARAGRAPHS = r"regexp_split_to_array(text, '\n[ \t\r\f]*\n')"
_SENTENCES = r"string_split(regexp_replace(regexp_replace(text, '\n[ \t\r\f]*\n', chr(1), 'g'), '([.!?])[ \t\r\n\f]+', '\1' || chr(1), 'g'), chr(1))"
_WORDS = r"regexp_split_to_array(text, '[ \t\r\n\f]+')"

_FOLD = "lower(strip_accents(nfc_normalize({x})))"
_CLEAN = "nullif(lower(trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '')"
_NAMES = ", ".join(f"'{n}'" for n in NO_PERSON)
_QA_PAPER = f"coalesce({_CLEAN.format(x='cluster_id')}, {_CLEAN.format(x='gold_locator.paper_id')}, {_CLEAN.format(x='negative_evidence.paper_id')})"
_GROUPS = f"""WITH RECURSIVE rec AS (SELECT DISTINCT case_id id, {_QA_PAPER} p, CAST(NULL AS VARCHAR) pair FROM qa_selective_response_v2 UNION SELECT profile_id, {_CLEAN.format(x='gold_paper_id')}, {_CLEAN.format(x='constraint_pair')} FROM finder_proxy_profiles_v2),
    au AS (SELECT DISTINCT {_CLEAN.format(x='paper_id')} p, trim(regexp_replace({_FOLD.format(x='name')}, '[^a-z0-9]+', ' ', 'g')) w FROM (SELECT paper_id, unnest(authors) name FROM papers) WHERE name IS NOT NULL),
    half AS (SELECT 'p:' || p a, 'a:' || w b FROM au WHERE w NOT IN ({_NAMES}) AND NOT starts_with(w, 'click to ') AND NOT starts_with(w, 'download ') UNION SELECT 'p:' || p, 'c:' || pair FROM rec WHERE p IS NOT NULL AND pair IS NOT NULL),
    e AS (SELECT a, b FROM half UNION SELECT b, a FROM half), s AS (SELECT coalesce('p:' || p, 'c:' || pair) n FROM rec WHERE p IS NOT NULL OR pair IS NOT NULL),
    reach(n, m) AS (SELECT n, n FROM s UNION SELECT reach.n, e.b FROM reach JOIN e ON reach.m = e.a), g AS (SELECT n, min(substr(m, 3)) k FROM reach WHERE starts_with(m, 'p:') GROUP BY 1)"""
_OVERLAP = f"""WITH r AS (SELECT DISTINCT 'qa_selective_response_v2' src, case_id id, {_CLEAN.format(x='split')} sp, question t FROM qa_selective_response_v2 UNION SELECT 'finder_proxy_profiles_v2', profile_id, {_CLEAN.format(x='split')}, interests FROM finder_proxy_profiles_v2),
    w AS (SELECT src, id, sp, list_distinct(ws) ws FROM (SELECT *, regexp_extract_all({_FOLD.format(x='t')}, '[\\p{{L}}\\p{{N}}]+') ws FROM r WHERE sp IS NOT NULL AND t IS NOT NULL) WHERE len(ws) >= 4),
    x AS (SELECT src, id, sp, len(ws) n, unnest(ws) word FROM w), j AS (SELECT a.src, a.id a, b.id b, b.sp, any_value(a.n) na, any_value(b.n) nb, count(*) k FROM x a JOIN x b ON a.src = b.src AND a.word = b.word AND a.sp = 'train' AND b.sp <> 'train' GROUP BY 1, 2, 3, 4),
    f AS (SELECT * FROM j WHERE 10 * k >= 7 * (na + nb - k))"""

ORACLES: dict[str, str] = {
    "p2_found": f"{_OVERLAP} SELECT src AS src_table, least(a, b) AS id_a, greatest(a, b) AS id_b FROM f",
    "p2_report": f"{_OVERLAP} SELECT src, sp AS other_split, count(*) AS pairs, count(DISTINCT b) AS records, count(DISTINCT a) AS train_records FROM f GROUP BY 1, 2",
    "p3_found": f"{_GROUPS} SELECT id AS record_id, k AS group_key FROM rec JOIN g ON g.n = coalesce('p:' || p, 'c:' || pair)",
    "p3_kept": f"""SELECT (SELECT count(*) FROM (SELECT DISTINCT case_id FROM qa_selective_response_v2 WHERE case_id IS NOT NULL)) + (SELECT count(*) FROM (SELECT DISTINCT profile_id FROM finder_proxy_profiles_v2 WHERE profile_id IS NOT NULL)) AS records, true AS shares_kept, CAST(0 AS BIGINT) AS groups_in_two_splits""",
    "p7_kept": f"""SELECT t.source_name AS source_name, count(d.doc_id) AS documents, true AS share_kept, true AS cap_kept FROM mix_targets t LEFT JOIN (SELECT doc_id, {_CLEAN.format(x='source')} s FROM documents WHERE length(text) > 0) d ON d.s = t.source_name GROUP BY 1""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p4_found": f"""SELECT DISTINCT paper_id, page_number, CASE WHEN {_LONGEST.format(units=_PARAGRAPHS)} <= 2000 THEN 'paragraph' WHEN {_LONGEST.format(units=_SENTENCES)} <= 2000 THEN 'sentence'
        WHEN {_LONGEST.format(units=_WORDS)} <= 2000 THEN 'word' ELSE 'none' END AS boundary FROM ocr WHERE length(trim(text, {_WS})) > 2000 AND paper_id IS NOT NULL AND page_number IS NOT NULL""",
    "p8_counts": r"""WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) flat, coalesce(text, '') t FROM documents)
        SELECT doc_id, CASE WHEN flat = '' THEN 0 ELSE length(flat) - length(replace(flat, ' ', '')) + 1 END AS word_count,
        CAST(len(list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12)) <> '')) AS BIGINT) AS line_count FROM d""",
}
