"""The pN_ queries: each problem's operator over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.words import tidy
from lectern.llm import components, cutting, encoding, mixing, neighbours, overlap, quality, scans
from lectern.session import cut, new_path, spread_table, table


def p1_found(spark, d):
    return neighbours.similar_pairs(neighbours.project_vectors(table(spark, d, "vector_store")), 0.65)


def p1_neighbours(spark, d):
    """The ten nearest of every vector, whatever their cosine, with a wide beam."""
    return neighbours.most_similar(neighbours.project_vectors(table(spark, d, "vector_store")), degree=16, width=72, expand=6, walk_dims=None, probes=4, margin=None)


def _overlaps(spark, d, rest=True):
    return overlap.cross_split_overlaps(overlap.project_records(spread_table(spark, d, "qa_selective_response_v2", "case_id", "split", "question"), spread_table(spark, d, "finder_proxy_profiles_v2", "profile_id", "split", "interests")), rest=rest)


def p2_found(spark, d):
    """By content-defined chunks alone; the two queries below also join the words
    that make them whole for any order of words."""
    return _overlaps(spark, d, rest=False).select(F.col("src").alias("src_table"), F.least("train_id", "other_id").alias("id_a"), F.greatest("train_id", "other_id").alias("id_b")).distinct()


def p2_overlaps(spark, d):
    return _overlaps(spark, d)


def p2_report(spark, d):
    return overlap.report(_overlaps(spark, d))


def _grouping(spark, d):
    return table(spark, d, "qa_selective_response_v2"), table(spark, d, "finder_proxy_profiles_v2"), table(spark, d, "papers")


def p3_found(spark, d):
    store = components.Store(spark, new_path(spark, "component-store"))
    return components.update_groups(store, *_grouping(spark, d)).where("group_key is not null").select("record_id", "group_key")


def p3_splits(spark, d):
    return components.splits(*_grouping(spark, d), table(spark, d, "split_targets"))


def p3_incremental(spark, d):
    """The same in two runs over one store: what was created before July 2025, then the rest."""
    return components.incremental_splits(*_grouping(spark, d), table(spark, d, "split_targets"), "2025-07-01")


def p3_kept(spark, d):
    """What the splits promise: records placed, groups in more than one split, and
    whether every split has its share of the records to two hundredths."""
    placed = cut(components.splits(*_grouping(spark, d), table(spark, d, "split_targets")), "placed")
    groups = components.update_groups(components.Store(spark, new_path(spark, "component-store")), *_grouping(spark, d))
    tied = placed.join(groups, ["src_table", "record_id"]).where("group_key is not null").groupBy("group_key").agg(F.countDistinct("split").alias("n"))
    got = placed.groupBy(F.col("split").alias("split_name")).agg(F.count("*").alias("n"))
    off = table(spark, d, "split_targets").join(got, "split_name", "left").crossJoin(placed.agg(F.count("*").alias("records")))
    off = off.agg(F.max("records").alias("records"), (F.max(F.abs(F.coalesce("n", F.lit(0)) / F.col("records") - F.col("target_share"))) <= 0.02).alias("shares_kept"))
    return off.crossJoin(tied.agg(F.count_if(F.col("n") > 1).alias("groups_in_two_splits")))


def _pieces(spark, d):
    pages = spread_table(spark, d, "ocr", "paper_id", "page_number", "text").where("paper_id is not null and page_number is not null and text is not null")
    return pages, ["paper_id", "page_number"]


def p4_found(spark, d):
    pages, keys = _pieces(spark, d)
    cut_ = cutting.split_long(pages.where(F.length("text") > 2000), keys, "text")
    return cut_.where("boundary is not null and piece_no = 1").select(*keys, "boundary").distinct()


def p4_pieces(spark, d):
    pages, keys = _pieces(spark, d)
    return cutting.split_long(pages.where(F.length("text") > 2000).dropDuplicates(keys), keys, "text").where("boundary is not null").select(*keys, "piece_no", "piece")


def _scans(spark, d):
    return table(spark, d, "ocr"), table(spark, d, "papers"), table(spark, d, "ocr_repaired_pages")


def p5_found(spark, d):
    return scans.scan_noise(*_scans(spark, d))


def p5_pages(spark, d):
    return scans.repair(*_scans(spark, d))


def p6_ids(spark, d):
    return encoding.encode(spread_table(spark, d, "documents", "doc_id", "text"))


def p6_decoded(spark, d):
    return encoding.decode(encoding.encode(spread_table(spark, d, "documents", "doc_id", "text")))


def _mixture(spark, d):
    docs = table(spark, d, "documents")
    tokens = encoding.encode(spread_table(spark, d, "documents", "doc_id", "text")).select("doc_id", F.size("ids").alias("tokens"))
    named = docs.select("doc_id", tidy("source").alias("source_name")).where("source_name is not null")
    return mixing.mix(tokens.where("tokens > 0").join(named, "doc_id"), table(spark, d, "mix_targets"))


def p7_mix(spark, d):
    return _mixture(spark, d)[0]


def p7_shares(spark, d):
    return _mixture(spark, d)[1]


def p7_kept(spark, d):
    """What the mixture promises of each target: the documents it could draw on, and
    whether the share is reached to a hundredth and no document used too often."""
    chosen, shares = _mixture(spark, d)
    most = chosen.groupBy("source_name").agg(F.max("repeats").alias("most"))
    there = F.col("tokens") > 0
    whole = shares.agg(F.sum(F.when(there, F.col("target_share"))).alias("whole"))
    x = shares.join(most, "source_name", "left").crossJoin(F.broadcast(whole))
    want = F.when(there, F.col("target_share") / F.col("whole")).otherwise(0.0)
    return x.select("source_name", "documents", (F.abs(F.col("actual_share") - want) <= 0.01).alias("share_kept"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("cap_kept"))


def _kinds(spark, d):
    docs = spread_table(spark, d, "documents", "doc_id", "text")
    return quality.classify(docs, quality.learn(docs, table(spark, d, "doc_kind_labels")))


def p8_found(spark, d):
    # a filter on the kind would be pushed below it and work it out twice
    return _kinds(spark, d).select("doc_id", F.explode(F.filter(F.array("kind"), lambda k: k != "prose")).alias("kind"))


def p8_statistics(spark, d):
    return _kinds(spark, d).select("doc_id", "word_count", "mean_word_length", "symbol_ratio", "punct_line_share", "common_share", "kind")


def p8_counts(spark, d):
    """The plain counts among the statistics."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.translate(x, "\t\r\f", "   ")) != "")
    return quality.statistics(spread_table(spark, d, "documents", "doc_id", "text")).select("doc_id", "word_count", F.size(lines).cast("long").alias("line_count"))


def queries():
    names = "p1_found p1_neighbours p2_found p2_overlaps p2_report p3_found p3_splits p3_incremental p3_kept p4_found p4_pieces p5_found p5_pages p6_ids p6_decoded p7_mix p7_shares p7_kept p8_found p8_statistics p8_counts"
    return {name: globals()[name] for name in names.split()}


def oracle_sql():
    from lectern.llm.sql import ORACLES

    return dict(ORACLES)
