"""Line dedup in DataFrame functions alone.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least ``min_chars`` code points
that ``min_docs`` documents or more hold lose all their lines but those of the largest doc_id.

Keys travel as two 64-bit hashes with different seeds, with the document and the line's position. They are dealt by
ranges of the hash and a salt from the document, so the rows of one very common line go to many tasks; each task
streams them in order of document. A hash is uniform, so the ranges are equal cuts of it and need no sampling. Of each salt only the rows of its three largest documents go on to a second pass
by hash alone, the others are known to be dropped. What comes back per document is a sparse bitmap: 64 lines a word,
and words in which every line stays are absent.

Edge cases: null and empty text are one empty line; documents are told apart by doc_id, so rows that repeat a doc_id
count once; rows with a null doc_id take no part and keep their lines; an empty table gives no rows; other columns
are kept as they are by ``drop_repeated_lines`` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.llm.columns import numbered, restored

MIN_CHARS = 20
MIN_DOCS = 3
SALTS = 32
#: The hashes' range is cut in so many equal parts (a power of two); tasks take parts by number.
RANGE_BITS = 20

_WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ASCII texts take the quick way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Lines that can repeat: h1, h2, doc_id, version (of the text), line."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("version"), F.posexplode(_lines(F.col("text"))).alias("line", "raw")
    )
    rows = rows.withColumn("key", F.btrim("raw", F.lit(_WHITE))).where(F.length("key") >= min_chars)
    rows = rows.withColumn("key", ascii_lower(F.col("key")))
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("tallystone"), "key").alias("h2"), "doc_id", "version", "line")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, version and keep_words (word number -> 64 keep bits) of the documents that lose lines."""
    keys = line_keys(docs, min_chars).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).withColumn("range", F.shiftright("h1", 64 - RANGE_BITS))
    within = W.partitionBy("range", "salt", "h1", "h2").orderBy(F.col("doc_id").desc())
    first = keys.repartition("range", "salt").withColumn("nth", F.dense_rank().over(within))
    over = W.partitionBy("range", "h1", "h2")
    # Every row of the first pass is kept or dropped at once: past min_docs larger documents there is nothing to learn.
    known = first.where(F.col("nth") > min_docs).select("doc_id", "version", "line")
    second = (
        first.where(F.col("nth") <= min_docs)
        .repartition("range")
        .withColumn("nth", F.dense_rank().over(over.orderBy(F.col("doc_id").desc())))
        .withColumn("documents", F.max("nth").over(over))
        .where((F.col("nth") > 1) & (F.col("documents") >= min_docs))
        .select("doc_id", "version", "line")
    )
    words = (
        known.unionAll(second)
        .groupBy("doc_id", "version", F.expr("line div 64").cast("int").alias("word"))
        .agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, line % 64)"))).alias("bits"))
    )
    return words.groupBy("doc_id", "version").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("keep_words"))


def with_kept_text(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` plus ``_lines`` (before dropping), ``_dropped`` and ``_kept`` (text), in place of any so named."""
    added = ("_lines", "_dropped", "_kept")
    rest = docs.drop(*added)
    done = _joined(numbered(rest, "doc_id", "text"), keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs))
    return restored(done, rest, "doc_id", "text", also=added)


def _joined(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs``, whose columns but doc_id and text are numbered, with ``_lines``, ``_dropped`` and ``_kept``."""
    marks = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), F.col("keep_words").alias("_words"))
    joined = docs.join(marks, (docs["doc_id"] == F.col("_doc")) & (F.xxhash64(docs["text"]) == F.col("_version")), "left")
    lines = _lines(docs["text"])
    # The map of words as an array, which finds a line's word at once.
    words = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("_words"))), lambda i: F.col("_words")[i])

    def stays(dense: Column) -> Column:
        return F.filter(lines, lambda _, i: F.getbit(F.coalesce(F.get(dense, F.floor(i / 64).cast("int")), F.lit(-1).cast("long")), F.pmod(i, F.lit(64))) == 1)

    kept = F.when(F.col("_words").isNull(), lines).otherwise(F.transform(F.array(words), stays)[0])
    return (
        joined.withColumn("_kept_lines", kept)
        .withColumn("_lines", F.size(lines).cast("long"))
        .withColumn("_dropped", (F.col("_lines") - F.size("_kept_lines")).cast("long"))
        .withColumn("_kept", F.when(F.col("_words").isNull(), F.coalesce(docs["text"], F.lit(""))).otherwise(F.array_join("_kept_lines", "\n")))
        .drop("_doc", "_version", "_words", "_kept_lines")
    )


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the remaining lines as text; a text that loses nothing stays as it is, null included."""
    done = _joined(numbered(docs, "doc_id", "text"), keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs))
    done = done.withColumn("text", F.when(F.col("_dropped") > 0, F.col("_kept")).otherwise(F.col("text")))
    return restored(done, docs, "doc_id", "text")
