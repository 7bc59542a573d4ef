"""What the operators of this package share: document keys, carried columns and bitmaps of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import settle  # noqa: F401

#: A word is a maximal run of characters other than these (ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``_id, _th, _text`` (+ ``_carry``): the columns that operators work on, under names of their own.

    ``_th`` is a 64-bit hash of the text and its length, so rows that share an id but not a text stay apart, and rows
    that are equal in both are one document that is listed more than once. Other columns are left out, or travel in
    ``_carry``, where the text is not doubled.
    """
    cols = [F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col), F.length(text_col)).alias("_th"), F.col(text_col).alias("_text")]
    if carry:
        cols.append(F.struct(*[F.col(c) for c in carry if c != text_col]).alias("_carry"))
    return docs.select(*cols)


def carried(df: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The columns that ``keyed`` was given to carry, as they were."""
    return df.select(*[(F.col("_text") if c == text_col else F.col("_carry").getField(c)).alias(c) for c in columns])


def same_key(a: DataFrame, b: DataFrame):
    """Join condition on (_id, _th), null ids included."""
    return a["_id"].eqNullSafe(b["_id"]) & (a["_th"] == b["_th"])


#: Bits of a bitmap of keys, and of the words that it is broadcast in: 2**18 rows of 16 bytes at most.
BITMAP, WORD_BITS = 24, 6


def _bit(key):
    place = F.shiftrightunsigned(key, 64 - BITMAP)
    return F.shiftright(place, WORD_BITS), place.bitwiseAND((1 << WORD_BITS) - 1).cast("int")


def row_key():
    """One long for (_id, _th), null ids included."""
    return F.xxhash64(F.coalesce("_id", F.lit(-(1 << 63))), "_th")


def bitmap(keys: DataFrame) -> DataFrame:
    """A bitmap (word, bits) of the column ``key``; its size is fixed, whatever the number of keys."""
    word, bit = _bit(F.col("key"))
    bits = keys.select(word.alias("word"), bit.alias("bit")).select("word", F.expr("shiftleft(1L, bit)").alias("b"))
    return bits.groupBy("word").agg(F.bit_or("b").alias("bits"))


def maybe(rows: DataFrame, bits: DataFrame, wanted: bool = True) -> DataFrame:
    """The rows with ``_id, _th`` that may be among the bitmap's keys (all of those are), or those that surely aren't.

    Saves shuffling whole texts for a join with few of them; where the keys are so many that every bit is set, all
    rows go through the join that follows, which is exact.
    """
    word, bit = _bit(row_key())
    marked = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits.withColumnRenamed("word", "_word")), "_word", "left")
    has = F.getbit(F.coalesce("bits", F.lit(0).cast("long")), F.col("_bit")) == 1
    return marked.filter(has if wanted else ~has).select(*rows.columns)
