"""Language of a text, by n-gram filters that hold one bit for each language.

One bit-sliced Bloom filter serves all languages: each of its slots is a mask of languages, an n-gram sets its
language's bit in a few slots, and the AND of these slots has the bits of all languages that contain the n-gram. A text
is counted bit by bit over its n-grams; a language's count less what its own filter's fill lets through by chance
decides.

A language contains the n-grams that make up ``MIN_RATE`` of its own or more (so ``1 / MIN_RATE`` of them at most) and
are not ``RELATIVE`` times rarer in it than in another language. They are counted over all texts that are learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from ._common import documents, keyed, settle

#: Lengths of n-grams in bytes, four at most.
SIZES = (2, 3, 4)
MIN_RATE, RELATIVE = 1e-5, 5.0
#: Slots of the filter and slots for each n-gram; a slot holds 64 languages, more languages take more planes of slots.
SLOTS, HASHES, PLANE = 1 << 20, 4, 64
UNKNOWN = "und"

#: A-Z as a-z; other ASCII as a space; bytes of all other characters as they are.
_PLAIN = np.array([c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint8)


@dataclass(frozen=True)
class Filters:
    """langs, sorted; table (planes x slots) of masks; fill: share of slots with each language's bit; common: the language with most n-grams."""

    langs: list[str]
    table: np.ndarray
    fill: np.ndarray
    common: int


def grams(buf: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and code of each n-gram of a slice: n bytes of one document, without two neighbouring spaces.

    A text has a space before and after it. The code has n above the bytes.
    """
    size = len(at) - 1
    plain = np.full(len(buf) + 2 * size, 32, np.uint8)
    doc = np.repeat(np.arange(size), np.diff(at))
    plain[np.arange(len(buf)) + 2 * doc + 1] = _PLAIN[buf]
    owner = np.repeat(np.arange(size), np.diff(at) + 2)
    twice = (plain[1:] == 32) & (plain[:-1] == 32) & (owner[1:] == owner[:-1])
    plain, owner = plain[np.append(True, ~twice)], owner[np.append(True, ~twice)]
    if len(plain) < n:
        return owner[:0], plain[:0].astype(np.uint64)
    code = np.full(len(plain) - n + 1, n, np.uint64)
    for k in range(n):
        code = (code << W.U(8)) | plain[k : len(plain) - n + 1 + k]
    same = owner[: len(code)] == owner[n - 1 :]
    return owner[: len(code)][same], code[same]


def slots(code: np.ndarray) -> Iterator[np.ndarray]:
    """The slots of each n-gram, one array for each hash."""
    h = W.mix(code)
    step = (h >> W.U(32)) | W.U(1)
    for _ in range(HASHES):
        yield (h & W.U(SLOTS - 1)).astype(np.int64)
        h = h + step


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, code, n of the n-grams of all rows (lang, text), added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, at in W.slices(b.column("text"), 1 << 22):
                coded = b.column("lang").slice(lo, hi - lo).dictionary_encode()
                lang = coded.indices.to_numpy().astype(np.uint64)
                for n in SIZES:
                    doc, code = grams(buf, at, n)
                    key = np.sort((lang[doc] << W.U(36)) | code)  # a code has less than 36 bits
                    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
                    times = np.diff(np.append(first, len(key)))
                    of, code = key[first] >> W.U(36), key[first] & W.U((1 << 36) - 1)
                    yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(of.astype(np.int64))), pa.array(code.astype(np.int64)), pa.array(times)], names=["lang", "code", "n"])

    return rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, learn: Column | None = None, min_rate: float = MIN_RATE, relative: float = RELATIVE, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters of all languages of the rows that ``learn`` chooses, from their whole texts.

    Rows without text or language teach nothing. What comes to the driver is the filter, whose size is fixed, and one
    row for each language.
    """
    rows = docs if learn is None else docs.filter(learn)
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    counts = settle(gram_counts(rows), "gram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    known = {r["lang"]: r["total"] for r in totals.collect()}
    langs = sorted(known)
    table, fill = np.zeros((max(1, -(-len(langs) // PLANE)), SLOTS), np.uint64), np.zeros(len(langs))
    if langs:
        number = counts.sparkSession.createDataFrame([(x, i, known[x]) for i, x in enumerate(langs)], "lang string, l int, total long")
        rated = counts.join(F.broadcast(number), "lang").withColumn("rate", F.col("n") / F.col("total"))
        most = F.max("rate").over(Window.partitionBy("code"))
        kept = rated.withColumn("most", most).filter((F.col("rate") >= min_rate) & (F.col("rate") * relative >= F.col("most"))).select("code", "l")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                code, lang = b.column("code").to_numpy().astype(np.uint64), b.column("l").to_numpy()
                for at in slots(code):
                    yield pa.RecordBatch.from_arrays([pa.array((lang // PLANE).astype(np.int32)), pa.array(at), pa.array((W.U(1) << (lang % PLANE).astype(np.uint64)).view(np.int64))], names=["plane", "slot", "mask"])

        masks = kept.mapInArrow(place, "plane int, slot long, mask long").groupBy("plane", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
        table[masks["plane"].to_numpy(), masks["slot"].to_numpy()] = masks["mask"].to_numpy().view(np.uint64)
        for i in range(len(langs)):
            fill[i] = float(np.mean((table[i // PLANE] >> W.U(i % PLANE)) & W.U(1)))
    return Filters(langs, table, fill, max(range(len(langs)), key=lambda i: known[langs[i]], default=0))


def hits(model: Filters, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of each document, and how many of them each language contains (documents x languages)."""
    total, found = np.zeros(len(at) - 1, np.int64), np.zeros((len(at) - 1, len(model.langs)), np.int64)
    for n in SIZES:
        doc, code = grams(buf, at, n)
        edges = np.searchsorted(doc, np.arange(len(at)))
        total += np.diff(edges)
        where = list(slots(code))
        for plane, table in enumerate(model.table):
            mask = table[where[0]]
            for w in where[1:]:
                mask &= table[w]
            for i in range(plane * PLANE, min(len(model.langs), (plane + 1) * PLANE)):
                sums = np.zeros(len(mask) + 1, np.int64)
                np.cumsum((mask >> W.U(i % PLANE)) & W.U(1), out=sums[1:])
                found[:, i] += sums[edges[1:]] - sums[edges[:-1]]
    return total, found


def decide(model: Filters, total: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each document's language and its score: the share of n-grams that the language truly contains.

    Of n-grams outside the language, its fill to the power of the hashes passes by chance; equal shares go to the
    language that sorts first, none at all to the most common one.
    """
    chance = model.fill**HASHES
    share = np.clip((found / np.maximum(total, 1)[:, None] - chance) / np.maximum(1 - chance, 1e-9), 0, 1)
    best = np.where(share.max(axis=1) > 0, share.argmax(axis=1), model.common)
    return best, share[np.arange(len(best)), best]


def identify(docs: DataFrame, model: Filters, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every whole text, and ``_text, _carry`` with ``carry``.

    A text that is null or has no letter is 'und' with score 0, and so is every text if nothing was learned. Equal
    texts get equal results; equal rows each get a row; an empty table gives an empty one; other columns of any name are
    ignored unless carried. Very long texts are read whole, one at a time.
    """
    rows = keyed(docs, id_col, text_col, carry).withColumn("_letter", F.coalesce(F.col("_text").rlike(r"\p{L}"), F.lit(False)))
    schema = "doc_id long, lang_pred string, score double"
    if carry:
        schema += f", _text string, _carry {rows.schema['_carry'].dataType.simpleString()}"
    names = pa.array([*model.langs, UNKNOWN], pa.string())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, at in W.slices(b.column("_text"), 1 << 21):
                known = b.column("_letter").slice(lo, hi - lo).to_numpy(zero_copy_only=False) & bool(model.langs)
                if model.langs:
                    best, score = decide(model, *hits(model, buf, at))
                else:
                    best, score = np.zeros(hi - lo, np.int64), np.zeros(hi - lo)
                cols = [b.column("_id").slice(lo, hi - lo), names.take(pa.array(np.where(known, best, len(model.langs)))), pa.array(np.where(known, score, 0.0))]
                if carry:
                    cols += [b.column(c).slice(lo, hi - lo) for c in ("_text", "_carry")]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", *(["_text", "_carry"] if carry else [])])

    return rows.drop("_th").mapInArrow(look, schema)


def held_out(doc_id: Column) -> Column:
    """A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, ~held_out(F.col("doc_id")))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
