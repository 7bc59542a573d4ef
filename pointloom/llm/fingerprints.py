"""Document fingerprints: one-permutation MinHash with optimal densification, in DataFrame functions only.

A text's shingles are hashed once; the hash's top bits name one of ``BINS`` bins, and each bin keeps its smallest
hash. An empty bin takes the value of a full one: every attempt of every bin draws a bin from a universal hash family,
independently of the others and alike in every document, and the first full one drawn gives its value. Where few bins
are full and no attempt hits one, the bin takes the full one with the smallest hash of (bin, full bin). Only ``BITS``
low-order bits of every bin's value, shifted by the bin, are stored, packed as one hex digit each; the likeness of two
fingerprints is the share of equal digits, corrected for the share that is equal by chance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import documents, settle

BINS_LOG2, SHINGLE, BITS = 8, 5, 4
BINS = 1 << BINS_LOG2
PRIME = (1 << 31) - 1  # of the universal hash family
TRIES = 12  # attempts before a sparse text's full bins are ranked instead
BUCKET, BUCKETS = 100_000, 1024  # documents in a bucket of the id order, and the most buckets
_LOW = (1 << (64 - BINS_LOG2)) - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_hashes(text: Column) -> Column:
    """A hash for every word of a text; a null text has none."""
    words = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, n: int = SHINGLE) -> Column:
    """Hashes of all n-word shingles; of the whole sequence where there are fewer words; none without words."""

    def of(w: Column) -> Column:
        size = F.size(w)
        grams = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(size >= n, grams).when(size > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return let(words, of)


def _family(attempt: int) -> tuple[int, int]:
    """a and b of an attempt's hash (a * bin + b) mod PRIME mod BINS: a fixed scramble of its number."""
    out = []
    for x in (2 * attempt + 1, 2 * attempt + 2):
        x = x * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        out.append((x ^ x >> 29) % (PRIME - 1) + 1)
    return out[0], out[1]


def fingerprint(text: Column, n: int = SHINGLE) -> Column:
    """``BINS`` hex digits, or an empty string for a text without words. Equal texts have equal fingerprints."""
    # a marker ends each bin: after sorting, what follows a marker is the next bin's smallest hash, or its marker
    ends = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("long"), 64 - BINS_LOG2).bitwiseOR(F.lit(_LOW)))
    is_end = lambda h: h.bitwiseAND(F.lit(_LOW)) == F.lit(_LOW)

    def smallest(s: Column) -> Column:
        return F.filter(s, lambda h, i: (i == 0) | is_end(F.get(s, i - 1)))

    def values(low: Column) -> Column:
        return F.transform(low, lambda h: F.when(~is_end(h), h))

    def digit(h: Column, i: Column) -> Column:
        # another part of the hash in each bin, so that one hash that fills many bins doesn't agree in all by chance
        return F.hex(F.call_function("shiftrightunsigned", h, (i % 13 * BITS).cast("int")).bitwiseAND(F.lit((1 << BITS) - 1)))

    def filled(d: Column) -> Column:
        def rest(full: Column) -> Column:
            def fill(own: Column, i: Column) -> Column:
                draws = [(F.pmod(i.cast("long") * a + b, F.lit(PRIME)) % BINS).cast("int") for a, b in map(_family, range(TRIES))]
                least = F.array_min(F.transform(full, lambda j: F.xxhash64(i, j).bitwiseAND(F.lit(-BINS)).bitwiseOR(j.cast("long"))))
                return digit(F.coalesce(own, *[F.get(d, j) for j in draws], F.get(d, least.bitwiseAND(F.lit(BINS - 1)).cast("int"))), i)

            return F.array_join(F.transform(d, fill), "")

        places = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(d, j).isNotNull())
        return let(places, rest)

    def of(shingles: Column) -> Column:
        ordered = F.sort_array(F.concat(shingles, ends))
        return F.when(F.size(shingles) > 0, let(values(let(ordered, smallest)), filled)).otherwise(F.lit(""))

    return let(shingle_hashes(word_hashes(text), n), of)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1; of two empty ones 1, of an empty and another 0."""
    equal = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) & (x != "")), lambda e: e))
    chance = 1.0 / (1 << BITS)
    corrected = (equal / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), corrected)))


def next_in_order(ids: DataFrame) -> DataFrame:
    """For distinct keys (_id, _th): the key after each in the order of keys, around the end, and the key before with its n.

    Keys are cut into buckets at quantiles of the id, each ordered by itself; only the buckets' ends, at most
    ``BUCKETS`` rows, are put in order together.
    """
    count = ids.agg(F.count("*").alias("n")).first()["n"]
    buckets = int(max(1, min(BUCKETS, count // BUCKET)))
    cuts: list[int] = []
    if buckets > 1:
        cuts = sorted(set(ids.agg(F.percentile_approx("_id", [k / buckets for k in range(1, buckets)], 10_000)).first()[0]))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("_id"))) if cuts else F.lit(0)
    key = F.struct("_id", "_th", "n")
    placed = ids.select("_id", "_th", "n", bucket.alias("bucket"))
    w = Window.partitionBy("bucket").orderBy("_id", "_th")
    inner = placed.select("_id", "_th", "n", "bucket", F.lead(key).over(w).alias("after"), F.lag(key).over(w).alias("before"))
    ends = placed.groupBy("bucket").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    one = Window.orderBy("bucket")
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("bucket", F.coalesce(F.lead("first").over(one), F.first("first").over(whole)).alias("next_first"), F.coalesce(F.lag("last").over(one), F.last("last").over(whole)).alias("prev_last"))
    joined = inner.join(F.broadcast(ends), "bucket")
    after, before = F.coalesce("after", "next_first"), F.coalesce("before", "prev_last")
    return joined.select("_id", "_th", after["_id"].alias("next_id"), after["_th"].alias("next_th"), before["_id"].alias("prev_id"), before["_th"].alias("prev_th"), before["n"].alias("prev_n"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of the text after an edit, and how like they are to each other.

    The edit puts the first floor(n/4) code points of the next document, in the order of ids, in the place of the
    last as many. A null text is empty. Rows that share an id are ordered by a hash of their text; equal rows are one
    document in that order and each get its row; a null id comes first. A lone document is its own next. Other
    columns are ignored; an empty table gives an empty one. Very long texts are hashed whole.
    """
    none = -(1 << 63)  # stands for a null id in the order; the hash tells it from this id itself
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(none)).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(id_col).isNull().alias("_no"))
    rows = rows.withColumn("_th", F.xxhash64("_text", "_no"))
    own = settle(rows.select("_id", "_th", "_no", F.length("_text").alias("n"), fingerprint(F.col("_text")).alias("f")).dropDuplicates(["_id", "_th"]), "fingerprints")
    order = settle(next_in_order(own.select("_id", "_th", "n")), "order")
    theirs = own.select(F.col("_id").alias("next_id"), F.col("_th").alias("next_th"), F.col("f").alias("next_f"))
    facts = own.join(order, ["_id", "_th"]).join(theirs, ["next_id", "next_th"]).select("_id", "_th", "_no", "n", "f", "next_f")
    rows = rows.drop("_no")  # both joins below read the same exchange
    head = rows.join(order.select("_id", "_th", "prev_id", "prev_th", "prev_n"), ["_id", "_th"])
    head = head.select(F.col("prev_id").alias("_id"), F.col("prev_th").alias("_th"), F.expr("left(_text, prev_n div 4)").alias("head")).dropDuplicates(["_id", "_th"])
    both = rows.join(facts, ["_id", "_th"]).join(head, ["_id", "_th"])
    edited = F.concat(F.expr("left(_text, n - n div 4)"), F.col("head"))
    made = both.select("_id", "_no", "n", "f", "next_f", F.sha2(edited, 256).alias("edited_sha256"), fingerprint(edited).alias("g"))
    return made.select(
        F.when(~F.col("_no"), F.col("_id")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        F.col("f").alias("fingerprint"),
        F.col("g").alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("g")).alias("near_edited"),
        likeness(F.col("f"), F.col("next_f")).alias("near_next"),
    )


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
