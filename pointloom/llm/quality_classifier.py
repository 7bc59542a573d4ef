"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of hashed terms: the shapes of its words (runs of letter, digit and sign classes), pairs of
shapes, frequent short words and signs of repetition. A bounded sample of labelled texts gives the weights (tf-idf)
and, by a singular value decomposition in numpy, the latent axes. The sample's vectors are broadcast; each document
is compared with all of them in blocks of exact cosine products, and its nearest neighbours vote by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._common import documents, keyed

#: The sample's bound: so many labelled texts at most, those with the smallest hash of their id. 4096 vectors of 48
#: numbers are under 1 MB, whatever the corpus.
SAMPLE, TERMS, AXES, NEIGHBOURS, POWER, THRESHOLD = 4096, 2048, 48, 31, 8.0, 0.3
BATCH = 512  # texts whose counts are dense at a time: 4 MB

_CLASS = np.zeros(256, np.uint8)  # letters by case, digits, other bytes of longer characters; signs as they are
_CLASS[:128] = np.arange(128)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 97


def term_counts(buf: np.ndarray, at: np.ndarray, terms: int = TERMS) -> np.ndarray:
    """Documents x terms."""
    flat = W.flatten(buf, at)
    n, total = flat.n, len(flat.start)
    out = np.zeros((n, terms), np.float32)
    if not total:
        return out
    kind = _CLASS[buf]
    keep = np.ones(len(buf), bool)  # a run of one class counts as one
    keep[1:] = kind[1:] != kind[:-1]
    keep[flat.start] = True
    squeezed = np.concatenate([[0], np.cumsum(keep)])
    sums = W.prefix(kind[keep].astype(np.uint64) + W.U(1))
    shape = W.runs(sums, squeezed[flat.start], squeezed[flat.end])
    short = np.flatnonzero(flat.end - flat.start <= 4)
    follows = np.flatnonzero(flat.left()[:-1] > 1) if total > 1 else np.zeros(0, np.int64)
    same = follows[flat.word[follows] == flat.word[follows + 1]]
    lone = W.mix(np.array([11], np.uint64))[0]
    found = [
        (flat.doc, shape),
        (flat.doc[follows], W.mix(shape[follows] * W.U(3) + shape[follows + 1])),
        (flat.doc[short], W.mix(flat.word[short] + W.U(7))),
        (flat.doc[same], np.full(len(same), lone)),
    ]
    for size, salt in ((3, 13), (5, 17)):  # words inside n-grams seen before in the text
        where, h = W.grams(flat, size)
        key = W.mix(h ^ W.mix(flat.doc[where].astype(np.uint64)))
        again = np.ones(len(key), bool)
        again[np.unique(key, return_index=True)[1]] = False
        found.append((flat.doc[where][again], np.full(int(again.sum()), W.mix(np.array([salt], np.uint64))[0])))
    doc, h = (np.concatenate(x) for x in zip(*found, strict=True))
    cell = doc.astype(np.int64) * terms + (h % W.U(terms)).astype(np.int64)
    return np.bincount(cell, minlength=n * terms).reshape(n, terms).astype(np.float32)


class Neighbours:
    """The fitted space: weights, axes, labelled unit vectors and their labels.

    ``sparse`` has each labelled text's (terms, counts). They are made dense ``BATCH`` texts at a time, so fitting
    takes little more memory than the terms x terms products.
    """

    def __init__(self, sparse: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, axes: int = AXES, terms: int = TERMS):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        seen = np.zeros(terms)
        for at, _ in sparse:
            seen[at] += 1
        self.idf = (np.log((1.0 + len(sparse)) / (1.0 + seen)) + 0.2).astype(np.float32)
        self.axes = np.zeros((terms, axes), np.float32)
        products = np.zeros((terms, terms), np.float32)
        for x in self._dense(sparse, terms):
            products += x.T @ x
        if len(sparse):
            values, vectors = np.linalg.eigh(products)
            self.axes = np.ascontiguousarray(vectors[:, np.argsort(-values, kind="stable")[:axes]])
            del values, vectors
        del products
        found = [x @ self.axes for x in self._dense(sparse, terms)]
        self.vectors = self._unit(np.concatenate(found)) if found else np.zeros((0, axes), np.float32)

    def _dense(self, sparse: list[tuple[np.ndarray, np.ndarray]], terms: int) -> Iterator[np.ndarray]:
        for lo in range(0, len(sparse), BATCH):
            part = sparse[lo : lo + BATCH]
            counts = np.zeros((len(part), terms), np.float32)
            for row, (at, n) in zip(counts, part, strict=True):
                row[at] = n
            yield self._weigh(counts)

    def _weigh(self, counts: np.ndarray) -> np.ndarray:
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return self._unit(np.sqrt(share) * self.idf)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Share of the neighbours' weight that is labelled 1; the sample's own share for a text without terms."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        k = min(k, len(self.labels))
        cos = self._unit(self._weigh(counts) @ self.axes) @ self.vectors.T
        top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cos, top, axis=1), 0) ** POWER
        total = weight.sum(axis=1)
        score = np.where(total > 0, (weight * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-12), self.prior)
        return np.clip(np.where(counts.sum(axis=1) > 0, score, self.prior), 0, 1).astype(float)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> Neighbours:
    """Learn from the labelled rows that aren't held out, at most ``sample`` of them.

    Ids with two different labels, null ids and null labels teach nothing. Of several texts with one id, the one whose
    terms come first in byte order teaches. The driver gets counts of terms, some kB a text, never texts.
    """
    known = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z"))
    known = known.filter("_id is not null and _y = _z").filter(~held_out(F.col("_id")))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample).select("_id", "_y")  # a top-k: each task sends `sample` rows at most
    texts = keyed(docs).join(F.broadcast(chosen), "_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, at in W.slices(b.column("_text"), rows=BATCH):
                rows = [np.flatnonzero(r).astype("<u2").tobytes() + r[r > 0].astype("<f4").tobytes() for r in term_counts(buf, at)]
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(lo, hi - lo), b.column("_y").slice(lo, hi - lo), pa.array(rows, pa.binary())], names=["i", "y", "c"])

    got = texts.select("_id", F.col("_y").cast("double").alias("_y"), "_text").mapInArrow(count, "i long, y double, c binary")
    rows = sorted(got.groupBy("i", "y").agg(F.min("c").alias("c")).collect(), key=lambda r: r["i"])
    cut = [len(r["c"]) // 3 for r in rows]  # two bytes for each term, four for its count
    sparse = [(np.frombuffer(r["c"][:n], "<u2"), np.frombuffer(r["c"][n:], "<f4")) for r, n in zip(rows, cut, strict=True)]
    return Neighbours(sparse, np.array([r["y"] for r in rows]))


def score(docs: DataFrame, model: Neighbours, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, score, predicted (and ``_text, _carry``, for ``carried``) for every whole text.

    One pass, no shuffle. A null or empty text gets the labelled sample's share of label 1; equal rows get equal
    scores, each its own row; other columns are ignored. With no label at all, every score is 0.5. Very long texts are
    counted whole, one at a time; an empty table gives an empty one. Of neighbours that are equally near at the end of
    the list, any may vote.
    """
    rows = keyed(docs, id_col, text_col, carry).drop("_th")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, predicted int" + (f", _text string, _carry {rows.schema['_carry'].dataType.simpleString()}" if carry else "")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo, hi, buf, at in W.slices(b.column("_text"), W.SLICE, BATCH):
                s = m.score(term_counts(buf, at))
                cols, names = [b.column("_id").slice(lo, hi - lo), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
                if carry:
                    cols, names = [*cols, *(b.column(c).slice(lo, hi - lo) for c in ("_text", "_carry"))], [*names, "_text", "_carry"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(vote, schema)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
