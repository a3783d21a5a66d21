"""Problem 6: encode a whole corpus with a public byte-level BPE tokenizer.

The text is split into words by the tokenizer's own pattern inside Spark, the
distinct words are counted, and each distinct word is encoded once, into a
table (word, ids).  Its ``common`` most frequent words go to every task, which
replaces the words of whole documents by ids a column at a time; words outside
that bounded part are joined by a shuffle on the word and put back at their
places.  Decoding joins the ids with the pieces of the vocabulary.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import cut, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _lines(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=2)
def _tokenizer(vocabulary: bytes | str):
    """The encoder of a vocabulary file, by its content or its path."""
    import tiktoken

    vocabulary = _lines(vocabulary) if isinstance(vocabulary, str) else vocabulary
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def split_words(text) -> F.Column:
    """The words of a text in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))


def word_table(texts: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(word, n, ids): every distinct word, how often it occurs, and its ids.
    The vocabulary is read on the driver and sent to the tasks, some 1 MB."""
    shared = texts.sparkSession.sparkContext.broadcast(_lines(vocabulary))
    counted = texts.select(F.explode(split_words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    def run(batches):
        encode = _tokenizer(shared.value).encode_ordinary
        for batch in batches:
            ids = pa.array([encode(w) for w in batch.column("word").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), ids], ["word", "n", "ids"])

    return counted.mapInArrow(run, "word string, n long, ids array<int>")


def _replace(common: tuple[pa.Array, np.ndarray, np.ndarray], batch: pa.RecordBatch) -> pa.RecordBatch:
    """Ids of the common words of each document; the others with their places."""
    known, starts, values = common
    words = batch.column("words")
    flat, offsets = words.flatten(), np.asarray(words.offsets)
    offsets = offsets - offsets[0]
    # the few words of a batch are hashed, not the many known ones
    coded = flat.dictionary_encode()
    place = np.asarray(pc.fill_null(pc.index_in(known, value_set=coded.dictionary), -1))
    hit = np.nonzero(place >= 0)[0]
    code = np.full(len(coded.dictionary), -1, np.int64)
    code[place[hit]] = hit
    found = code[np.asarray(coded.indices)]
    n = np.where(found >= 0, starts[found + 1] - starts[found], 0)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    ids = values[np.repeat(starts[found] - (ends - n), n) + np.arange(total)] if total else np.zeros(0, np.int32)
    bounds = np.concatenate([[0], ends])[offsets]
    rare = np.nonzero(found < 0)[0]
    doc = np.searchsorted(offsets, rare, side="right") - 1
    at = (np.concatenate([[0], ends])[rare] - bounds[doc]).astype(np.int32)
    rare_bounds = np.searchsorted(doc, np.arange(len(offsets)), side="left").astype(np.int32)
    struct = pa.StructArray.from_arrays([pa.array(at, pa.int32()), flat.take(pa.array(rare))], ["at", "word"])
    return pa.RecordBatch.from_arrays(
        [batch.column("key"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())), pa.ListArray.from_arrays(pa.array(rare_bounds), struct)],
        ["key", "ids", "rare"],
    )


def _insert(batches):
    """Put the ids of rare words back at their places."""
    for batch in batches:
        ids, rare = batch.column("ids"), batch.column("rare")
        bounds, sizes = np.asarray(ids.offsets) - ids.offsets[0].as_py(), np.asarray(pc.list_value_length(rare))
        at, nth, own = rare.flatten().flatten()
        doc, at = np.repeat(np.arange(len(sizes)), sizes), np.asarray(at)
        order = np.lexsort((np.asarray(nth), at, doc))
        own = own.take(pa.array(order))
        n = np.asarray(pc.list_value_length(own))
        whole = np.insert(np.asarray(ids.flatten()), np.repeat((bounds[doc] + at)[order], n), np.asarray(own.flatten()))
        more = np.bincount(doc[order], weights=n, minlength=len(sizes)).astype(np.int64)
        bounds = bounds + np.concatenate([[0], np.cumsum(more)])
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(whole, pa.int32()))], ["key", "ids"])


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, common: int = 200_000) -> DataFrame:
    """(key, ids) of every row with a key that differs from all others.

    Null and empty texts have an empty list.  No special tokens are set or
    recognised.  ``common`` bounds the part of the word table that is sent to
    every task (two hundred thousand words are some 15 MB); it changes how words
    are looked up, never the result.  Equal texts are encoded each, but their
    words only once.
    """
    spark = df.sparkSession
    texts = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    words = cut(word_table(texts, "text", vocabulary), "words")
    top = words.orderBy(F.desc("n"), "word").limit(common).select("word", "ids").toArrow().combine_chunks()
    word = top.column("word").combine_chunks() if top.num_rows else pa.array([], pa.string())
    lists = top.column("ids").combine_chunks() if top.num_rows else pa.array([], pa.list_(pa.int32()))
    starts = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))]).astype(np.int64)
    shared = spark.sparkContext.broadcast((word, np.append(starts, 0), np.asarray(lists.flatten()).astype(np.int32)))

    def run(batches):
        for batch in batches:
            yield _replace(shared.value, batch)

    form = texts.drop("text").withColumns({"ids": F.array().cast("array<int>"), "rare": F.array().cast("array<struct<at:int,word:string>>")}).schema
    with small_batches(spark):
        first = cut(texts.select("key", split_words("text").alias("words")).mapInArrow(run, form), "encoded")
    whole = first.where(F.size("rare") == 0).select("key", "ids")
    part = first.where(F.size("rare") > 0)
    rare = part.select("key", F.posexplode("rare").alias("nth", "r")).select("key", "nth", "r.at", "r.word")
    placed = rare.join(words.select("word", F.col("ids").alias("word_ids")), "word").groupBy("key").agg(F.collect_list(F.struct("at", "nth", F.col("word_ids").alias("ids"))).alias("rare"))
    mended = part.select("key", "ids").join(placed, "key").mapInArrow(_insert, whole.schema)
    return whole.unionByName(mended).withColumnRenamed("key", key)


def pieces(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece) of the vocabulary: 50,256 rows, whatever the corpus."""
    rows = [(int(b), bytearray(base64.b64decode(a))) for a, b in map(bytes.split, _lines(vocabulary).splitlines())]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """(key, text) by joining every id with its piece; empty lists give ''.

    An id that the vocabulary lacks fails the query rather than lose text.
    """
    at = encoded.select(F.col(key).alias("key"), F.posexplode_outer("ids").alias("pos", "id"))
    joined = at.join(F.broadcast(pieces(encoded.sparkSession, vocabulary)), "id", "left")
    piece = F.when(F.col("id").isNotNull() & F.col("piece").isNull(), F.raise_error(F.lit("unknown id")).cast("string")).otherwise(F.hex("piece"))
    back = joined.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", piece.alias("piece"))))).alias("p"))
    return back.select(F.col("key").alias(key), F.decode(F.unhex(F.array_join(F.col("p.piece"), "")), "UTF-8").alias("text"))
