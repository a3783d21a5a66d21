"""Problem 2: the same or nearly the same records across splits.

A record is normalised to its folded words in reading order, joined by spaces.
That text is cut into content-defined chunks: after a word, unless a rolling
hash of the last ``WINDOW`` characters meets a mask.  A cut depends on those
characters alone, so an edit moves no cut that lies further on, and the chunks
between two edits stay the same in both records.  The text is cut once for each
of ``SEEDS`` hashes; a chunk that an edit breaks under one is often whole under
another.  Digests of chunks are joined across the splits of a source, and the
lengths of the chunks that two records share, as shares of each record's length
under all hashes, are the overlap fractions.

Not every chunk needs to be joined to find all pairs whose shared chunks reach
``overlap`` of both records.  With the chunks in one order for all records, it
is enough to join each record's first chunks, until what is left is shorter
than ``overlap`` of it.  The order is rarest first (by the rarest word in a
chunk), so phrases that many records have are hardly ever joined; which counts
are known changes how many rows meet, not which pairs reach the fraction.
Candidates meet the exact comparison of their word sets last.

What these chunks can lose: a pair of similar word sets whose shared chunks do
not reach ``overlap``, if it shares none of the joined chunks by chance either
(words in another order, edits spread evenly over a short text).  The README
states the loss measured against brute force.  With ``rest`` the operator also
cuts at the finest scale, after every word, and joins what the same bound asks
of the shared words; then no pair is lost, whatever the order of words.

Records of equal normalised text are one class until the end.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.words import words
from lectern.session import cut

TRAIN = "train"
#: Characters under the rolling hash, its mask, and the seeds of the hashes.
WINDOW, MASK, SEEDS = 5, 3, (1, 2)


def chunks(text: str, window: int = WINDOW, mask: int = MASK, seeds: tuple[int, ...] = SEEDS) -> list[tuple[int, int, int]]:
    """(digest, start, end) of the content-defined chunks of a normalised text
    that ends with a space, for each seed in reading order.  The hash rolls over
    the last ``window`` characters and is looked at where a word ends."""
    import xxhash

    roll, digest = xxhash.xxh32_intdigest, xxhash.xxh64_intdigest
    ends, at = [], text.find(" ")
    while at >= 0:
        ends.append(at + 1)
        at = text.find(" ", at + 1)
    out = []
    for seed in seeds:
        start = 0
        for end in ends:
            if roll(text[end - window if end > window else 0 : end], seed) & mask or end == len(text):
                out.append((digest(text[start:end], seed) - (1 << 63), start, end))
                start = end
    return out


def normalise(text: str | None, least: int = 0) -> str:
    """The folded words, each followed by a space; "" if there are fewer than ``least``."""
    run = words(text)
    return "" if not run or len(run) < least else " ".join(run) + " "


def word_counts(records: DataFrame, least: int) -> DataFrame:
    """(word, n): the words that at least ``least`` records have."""

    def run(batches):
        from collections import Counter

        for batch in batches:
            n = Counter()
            for t in batch.column("text").to_pylist():
                n.update(set(words(t)))
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["word", "n"])

    return records.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _first(order: dict[int, tuple[int, int]], share: float) -> list[int]:
    """Of digest -> (rarity, length) the rarest, until the rest is shorter than ``share`` of all."""
    left = sum(n for _, n in order.values())
    least, out = share * left - 1e-9, []
    for digest, (_, length) in sorted(order.items(), key=lambda x: (x[1][0], x[0])):
        if left < least:
            break
        out.append(digest)
        left -= length
    return out


def first_chunks(text: str, counts: dict[str, int], overlap: float, rest: float | None = None, **cuts) -> list[int]:
    """Digests of the chunks to join, rarest first; with ``rest`` also of the
    distinct words that a share of ``rest`` in common asks for."""
    count = [counts.get(w, 0) for w in text.split(" ")]
    order: dict[int, tuple[int, int]] = {}
    word = at = 0
    for digest, start, end in chunks(text, **cuts):
        if start == 0:
            word = at = 0
        rare = count[word]
        while at < end:
            if count[word] < rare:
                rare = count[word]
            at = text.index(" ", at) + 1
            word += 1
        length = end - start + (order[digest][1] if digest in order else 0)
        order[digest] = (rare, length)
    out = _first(order, overlap)
    if rest is not None:
        import xxhash

        out += _first({xxhash.xxh64_intdigest(w) - (1 << 63): (counts.get(w, 0), 1) for w in set(text.split())}, rest)
    return out


MADE = "src string, id string, split string, train boolean, cid long, size int, bits long, joined array<long>, line string"


def classes(records: DataFrame, counts: dict[str, int], least_words: int, overlap: float, rest: float | None) -> DataFrame:
    """``records`` (src, id, split, text) with their classes: ``cid``, the number
    of distinct ``words``, their parities as 64 ``bits``, the chunks to join and
    the normalised text.  The last two are given at the first sight of a class
    in a task and null after it, so that many copies cost a task one."""
    shared = records.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        import xxhash

        count, seen = shared.value, set()
        for batch in batches:
            keep, cols = [], ([], [], [], [], [], [])
            for i, (src, split, text) in enumerate(zip(batch.column("src").to_pylist(), batch.column("split").to_pylist(), batch.column("text").to_pylist())):
                line = normalise(text, least_words)
                if not line:
                    continue
                cid = xxhash.xxh64_intdigest(f"{src}\0{split == TRAIN}\0{line}") - (1 << 63)
                distinct, bits = set(line.split()), 0
                for w in distinct:
                    bits ^= 1 << (xxhash.xxh32_intdigest(w) & 63)
                new = cid not in seen
                seen.add(cid)
                keep.append(i)
                for c, v in zip(cols, (split == TRAIN, cid, len(distinct), bits - (1 << 64) if bits >> 63 else bits, first_chunks(line, count, overlap, rest) if new else None, line if new else None)):
                    c.append(v)
            left = batch.select(["src", "id", "split"]).take(pa.array(keep, pa.int64()))
            kinds = (pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string())
            yield pa.RecordBatch.from_arrays([*left.columns, *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["src", "id", "split", "train", "cid", "size", "bits", "joined", "line"])

    return records.mapInArrow(run, MADE)


def shared_length(a: str, b: str) -> tuple[int, float, float]:
    """Summed lengths (characters, all seeds) of the chunks that two normalised
    texts share, and its shares of either text."""
    mine, yours = {}, {}
    for of, text in ((mine, a), (yours, b)):
        for digest, start, end in chunks(text):
            of[digest] = of.get(digest, 0) + end - start
    both = sum(min(n, yours[d]) for d, n in mine.items() if d in yours)
    return both, both / (len(a) * len(SEEDS)), both / (len(b) * len(SEEDS))


def _judge(threshold: float):
    """Overlap fractions of candidate pairs from their chunks, and the exact check."""

    def run(batches):
        for batch in batches:
            keep, cols = [], ([], [], [], [])
            for i, (a, b) in enumerate(zip(batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist())):
                wa, wb = set(a.split()), set(b.split())
                both = len(wa & wb)
                alike = both / (len(wa) + len(wb) - both)
                if alike >= threshold - 1e-9:
                    keep.append(i)
                    for c, v in zip(cols, (*shared_length(a, b), alike)):
                        c.append(v)
            left = batch.select(["cid_a", "cid_b"]).take(pa.array(keep, pa.int64()))
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*left.columns, *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["cid_a", "cid_b", "shared_chars", "overlap_a", "overlap_b", "similarity"])

    return run


def cross_split_overlaps(records: DataFrame, threshold: float = 0.7, least_words: int = 4, overlap: float = 0.6, rest: bool = True, common: int = 100_000, frequent: int = 20) -> DataFrame:
    """All pairs of a train record and a record of another split of one source.

    ``records`` is (src, id, split, text).  Splits count trimmed and in lower
    case.  A null or blank split, a null id and a text of fewer than
    ``least_words`` words take no part; a repeated record counts once.
    Returns src, train_id, other_id, other_split, shared_chars, overlap_a and
    overlap_b (lengths of shared chunks, also as shares of the train record and
    of the other), similarity (shared words over all words), for similarities
    of at least ``threshold``.  No pair whose shared chunks reach ``overlap`` of
    both records is lost, with ``rest`` no pair at all (up to 64-bit hashing).
    The counts of at most ``common`` words that ``frequent`` records have are
    sent to the tasks; they change speed only.
    """
    split = F.lower(F.regexp_replace("split", r"^[\s ]+|[\s ]+$", ""))
    clean = records.select("src", "id", split.alias("split"), "text").where("split <> '' and id is not null and text is not null and src is not null")
    counted = word_counts(clean, frequent).orderBy(F.desc("n"), "word").limit(common).collect()
    made = cut(classes(clean, {r[0]: r[1] for r in counted}, least_words, overlap, threshold if rest else None), "overlap-classes")
    once = made.where("joined is not null").select("src", "cid", "train", "size", "bits", "joined").dropDuplicates(["cid"])

    # a join of plain exchanges, so that adaptive execution splits a chunk that many records have
    def side(train: bool, tag: str) -> DataFrame:
        rows = once.where(F.col("train") == train).select("src", F.explode("joined").alias("chunk"), *[F.col(c).alias(f"{c}_{tag}") for c in ("cid", "size", "bits")])
        return rows.withColumn("chunk", F.xxhash64("src", "chunk")).drop("src")

    # words in one set only flip a parity each, so as many bits differ at most
    most = (F.col("size_a") + F.col("size_b")) * F.lit((1 - threshold) / (1 + threshold)) + 1e-9
    met = side(True, "a").join(side(False, "b"), "chunk").where(F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= most)
    met = met.where(F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(threshold) - 1e-9)
    candidates = met.select("cid_a", "cid_b").distinct()
    line = lambda train, tag: made.where((F.col("train") == train) & F.col("line").isNotNull()).select(F.col("cid").alias(f"cid_{tag}"), F.col("line").alias(f"line_{tag}")).dropDuplicates([f"cid_{tag}"])
    judged = candidates.join(line(True, "a"), "cid_a").join(line(False, "b"), "cid_b").select("cid_a", "cid_b", "line_a", "line_b").mapInArrow(_judge(threshold), "cid_a long, cid_b long, shared_chars long, overlap_a double, overlap_b double, similarity double")
    member = made.select("src", "id", "split", "train", "cid").distinct()
    a = member.where("train").select("src", F.col("id").alias("train_id"), F.col("cid").alias("cid_a"))
    b = member.where("not train").select(F.col("id").alias("other_id"), F.col("split").alias("other_split"), F.col("cid").alias("cid_b"))
    return judged.join(a, "cid_a").join(b, "cid_b").where("train_id <> other_id").select("src", "train_id", "other_id", "other_split", "shared_chars", "overlap_a", "overlap_b", "similarity")


def project_records(questions: DataFrame, profiles: DataFrame) -> DataFrame:
    q = questions.select(F.lit("qa_selective_response_v2").alias("src"), F.col("case_id").alias("id"), "split", F.col("question").alias("text"))
    p = profiles.select(F.lit("finder_proxy_profiles_v2").alias("src"), F.col("profile_id").alias("id"), "split", F.col("interests").alias("text"))
    return q.unionByName(p)


def report(pairs: DataFrame) -> DataFrame:
    """Per source and split: pairs, and records of the split that overlap train."""
    return pairs.groupBy("src", "other_split").agg(F.count("*").alias("pairs"), F.countDistinct("other_id").alias("records"), F.countDistinct("train_id").alias("train_records"))
