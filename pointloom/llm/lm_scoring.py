"""LM scoring by masked pseudo-likelihood.

A small bidirectional window network predicts every word of a text from the words on both of its sides; the sum of
the log-probabilities scores the document. The network knows the corpus's most frequent words, counted over all
documents; the others share buckets by how they end. Its output is a softmax in two steps (class, then word in the class). A
word in a bucket has the bucket's probability times its own share of the bucket, from a table of every word's count
that is joined by hash, so each word has a probability of its own, whatever the size of the corpus. The counts of the
most frequent words (a bounded number) are broadcast beside it, so that only rarer words wait for the join. Texts are
cut into words twice, to count them and to code them; training and scoring read the codes.

Training starts at the corpus's word frequencies (the output biases are their logarithms, the output weights nought), so
a fitted network adds to a table of counts what the words around tell. Documents are dealt to shards of about ``SHARD``
words by a hash of id and text, and each shard's words are walked in an order of their own, as ids of two bytes. A task
trains on one shard in numpy, and the shards' weights are averaged by the words they saw, summed as whole numbers so
that their order doesn't matter. Over the rounds every document is trained on once. The driver holds one model,
whatever the corpus. Nothing depends on how the input's files are split.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._common import documents, keyed, settle

CLASSES, MEMBERS, BUCKETS, ENDING = 32, 32, 256, 2
VOCABULARY = CLASSES * MEMBERS
SIDE, WIDTH, HIDDEN = 2, 16, 24
ROUNDS, BATCH, RATE, POWER, SEED = 3, 4096, 0.05, 1e-5, 7
STEP, BLOCK, SHARD = 2048, 1 << 16, 1 << 21  # words of a training step, of a block that is shuffled, of a shard
SLICE = 1 << 17  # bytes of text that are cut into words at once, few enough for a processor's cache
COUNTED = 1 << 19  # words that are counted before Spark gets them
FREQUENT = 1 << 16  # words at most whose counts are broadcast; the others' are joined
PARTIALS = 8  # sums of weights that reach the driver in a round
SPREAD = 5.0  # of words' numbers at the start of training
SMOOTH = 0.5  # added to the count of each word of a bucket, and of one that stands for unseen words
_SCALE, _MOST = float(1 << 20), 1024.0  # of whole numbers that stand for weights, and the largest weight
_SHAPES = {"words": (VOCABULARY + 1, WIDTH), "inner": (2 * SIDE * WIDTH, HIDDEN), "bias": (HIDDEN,), "classes": (HIDDEN, CLASSES), "class_bias": (CLASSES,), "members": (CLASSES, HIDDEN, MEMBERS), "member_bias": (CLASSES, MEMBERS)}
LARGEST = 60.0  # of a logit, so that exponentials don't overflow
_SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())
_WORDS = (VOCABULARY + 1) * WIDTH
_BOUNDS = np.arange(0, VOCABULARY + 1, MEMBERS, dtype=np.int16)
_ONES = np.ones(2, np.float32)
_HALVES = np.repeat(np.eye(2, dtype=np.float32), [CLASSES, MEMBERS], axis=0)  # sums over classes, and over a class's words
_BESIDE = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])


def _parts(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of a vector of all weights by ``_SHAPES``."""
    part, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        part[name], at = flat[at : at + n].reshape(shape), at + n
    return part


def _places(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word's class, and the word in its class, stand in its row of outputs."""
    row = np.arange(0, len(target) * (CLASSES + MEMBERS), CLASSES + MEMBERS)
    return row + target // MEMBERS, row + (CLASSES + target % MEMBERS)


class WindowNetwork:
    def __init__(self, weights: np.ndarray | None = None):
        if weights is None:
            rng = np.random.default_rng(SEED)
            weights = (rng.standard_normal(_SIZE) * 0.1).astype(np.float32)
        self.weights = weights.astype(np.float32)
        self.power = np.full(_SIZE, POWER, np.float32)  # sums of squared gradients
        self.gradient = np.zeros(_SIZE, np.float32)
        self.part, self.slope = _parts(self.weights), _parts(self.gradient)
        # a class's output weights: of all classes, then of its own words; biases stand below
        self.output = np.empty((CLASSES, HIDDEN + 1, CLASSES + MEMBERS), np.float32)

    def forward(self, context: np.ndarray, target: np.ndarray):
        """Of words sorted by class: inputs, hidden layer, it and a one, exponentials (of classes, then of words in the class), their sums, words' places there, classes' bounds, log-probabilities."""
        p, n, w = self.part, len(target), self.output
        w[:, :HIDDEN, :CLASSES], w[:, HIDDEN, :CLASSES] = p["classes"], p["class_bias"]
        w[:, :HIDDEN, CLASSES:], w[:, HIDDEN, CLASSES:] = p["members"], p["member_bias"]
        x = p["words"].take(context, axis=0).reshape(n, -1)
        h = np.ones((n, HIDDEN + 1), np.float32)
        hidden = x @ p["inner"]
        hidden += p["bias"]
        h[:, :HIDDEN] = np.tanh(hidden, out=hidden)
        bounds = np.searchsorted(target, _BOUNDS).tolist()
        out = np.empty((n, CLASSES + MEMBERS), np.float32)
        for c in range(CLASSES):
            lo, hi = bounds[c], bounds[c + 1]
            if lo < hi:
                np.matmul(h[lo:hi], w[c], out=out[lo:hi])
        np.clip(out, -LARGEST, LARGEST, out=out)
        at = _places(target)
        logs = out.take(at[0])
        logs += out.take(at[1])
        np.exp(out, out=out)
        sums = out @ _HALVES
        logs -= np.log(sums) @ _ONES[:2]
        return x, hidden, h, out, sums, at, bounds, logs

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        order = np.argsort(target.astype(np.int16, copy=False), kind="stable")
        out = np.empty(len(target), np.float32)
        out[order] = self.forward(context.take(order, axis=0), target.take(order))[-1]
        return out

    def train(self, context: np.ndarray, target: np.ndarray) -> None:
        order = np.argsort(target.astype(np.int16, copy=False), kind="stable")
        context, target = context.take(order, axis=0), target.take(order)
        n, g = len(target), self.slope
        x, hidden, h, d, sums, places, bounds, _ = self.forward(context, target)
        sums *= n
        d.reshape(n, 2, -1)[:] *= (1 / sums)[:, :, None]
        for at in places:
            d.reshape(-1)[at] -= 1.0 / n
        d_h, d_output = np.empty((n, HIDDEN), np.float32), np.zeros_like(self.output)
        for c in range(CLASSES):
            lo, hi = bounds[c], bounds[c + 1]
            if lo < hi:
                np.matmul(d[lo:hi], self.output[c, :HIDDEN].T, out=d_h[lo:hi])
                np.matmul(h[lo:hi].T, d[lo:hi], out=d_output[c])
        g["members"][:], g["member_bias"][:] = d_output[:, :HIDDEN, CLASSES:], d_output[:, HIDDEN, CLASSES:]
        of_classes = d_output[:, :, :CLASSES].sum(axis=0)
        g["classes"][:], g["class_bias"][:] = of_classes[:HIDDEN], of_classes[HIDDEN]
        hidden *= hidden
        d_h *= np.subtract(1, hidden, out=hidden)
        np.matmul(x.T, d_h, out=g["inner"])
        np.matmul(h[:, HIDDEN], d_h, out=g["bias"])
        d_x = (d_h @ self.part["inner"].T).reshape(-1, WIDTH)
        ids = context.ravel().astype(np.int16, copy=False)
        by = np.argsort(ids, kind="stable")
        line = ids.take(by)
        first = np.concatenate([[0], np.flatnonzero(line[1:] != line[:-1]) + 1])
        # numbers are added up two at a time, as a complex one
        rows, slope = line.take(first), np.add.reduceat(d_x.take(by, axis=0).view(np.complex64), first, axis=0).view(np.float32)
        speed = self.power[:_WORDS].reshape(-1, WIDTH)
        now = speed.take(rows, axis=0) + slope * slope
        speed[rows] = now
        self.part["words"][rows] -= RATE * slope / np.sqrt(now)
        slope, speed = self.gradient[_WORDS:], self.power[_WORDS:]  # of all weights behind the words' numbers
        speed += slope * slope
        self.weights[_WORDS:] -= RATE * slope / np.sqrt(speed)


def buckets(flat: W.Flat) -> np.ndarray:
    """The bucket of each word, by its last bytes (``ENDING`` at most): words that end alike are often used alike."""
    code = np.zeros(len(flat.word), np.uint64)
    for k in range(1, ENDING + 1):
        inside = flat.end - k >= flat.start
        code = (code << W.U(8)) | np.where(inside, flat.buf[np.maximum(flat.end - k, 0)], 0).astype(np.uint64)
    return (W.mix(code) % W.U(BUCKETS)).astype(np.int64)


def _find(hashes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are among sorted hashes, and where."""
    if not len(hashes):
        return np.zeros(len(word), bool), np.zeros(len(word), np.int64)
    at = np.minimum(np.searchsorted(hashes, word), len(hashes) - 1)
    return hashes.take(at) == word, at


def _ids(flat: W.Flat, vocabulary: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = VOCABULARY - BUCKETS + buckets(flat)
    found, place = _find(vocabulary, flat.word)
    out[found] = ids[place[found]]
    return out


def _spaced(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of documents that begin at ``first``, with blanks (VOCABULARY) before, between and after, and each word's place."""
    place = np.arange(len(ids))
    place += np.repeat(np.arange(SIDE, SIDE * len(first), SIDE), np.diff(first))
    line = np.full(len(ids) + SIDE * len(first), VOCABULARY, np.int16)
    line[place] = ids
    return line, place


def _beside(line: np.ndarray, place: np.ndarray) -> np.ndarray:
    return line.take(place[:, None] + _BESIDE)


def _around(ids: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words around each of the words ``at``, of documents that begin at ``first``; VOCABULARY stands for none."""
    line, place = _spaced(ids, first)
    return _beside(line, place[at])


def _windows(flat: W.Flat, ids: np.ndarray, lo: int, hi: int) -> np.ndarray:
    return _around(ids, flat.first, np.arange(lo, hi))


def train_shard(net: WindowNetwork, documents: Iterable[np.ndarray]) -> int:
    """Train on documents (ids of their words) in blocks of whole documents, whose words are shuffled; the words seen."""
    rng, held, size, seen = np.random.default_rng(SEED), [], 0, 0

    def block() -> None:
        ids, first = np.concatenate(held), np.cumsum([0, *map(len, held)])
        order = rng.permutation(len(ids))
        around, ids = _around(ids, first, order), ids[order]
        for lo in range(0, len(ids), STEP):
            net.train(around[lo : lo + STEP], ids[lo : lo + STEP])

    for d in documents:
        held.append(d)
        size += len(d)
        if size >= BLOCK:
            block()
            held, size, seen = [], 0, seen + size
    if size:
        block()
    return seen + size


def _flats(col: pa.Array) -> Iterator[tuple[int, int, W.Flat]]:
    for lo, hi, buf, at in W.slices(col, SLICE):
        yield lo, hi, W.flatten(W.lower(buf), at)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """h, bucket, n: how often each word (by hash, A-Z lowered) is in all texts, and its bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            word, bucket = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(word)
            word = word.take(order)
            new = np.ones(len(word), bool)
            new[1:] = word[1:] != word[:-1]
            first = np.flatnonzero(new)
            n = np.diff(first, append=len(word))
            return pa.RecordBatch.from_arrays([pa.array(word.take(first).view(np.int64)), pa.array(bucket.take(order.take(first)).astype(np.int32)), pa.array(n)], names=["h", "bucket", "n"])

        for b in batches:
            for _, _, flat in _flats(b.column("t")):
                held.append((flat.word, buckets(flat).astype(np.int16)))
                size += len(flat.word)
                if size >= COUNTED:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    return docs.select(F.col(text_col).alias("t")).mapInArrow(count, "h long, bucket int, n long").groupBy("h").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n"))


class Words(NamedTuple):
    hashes: np.ndarray  # sorted, of the words that have ids of their own
    ids: np.ndarray
    log_totals: np.ndarray  # of each bucket: log of its words' smoothed counts
    counts: DataFrame  # h, bucket, n of every word
    totals: np.ndarray  # of each id: smoothed count of its words
    n: int  # words in all texts
    frequent: np.ndarray  # sorted hashes of the most frequent words, FREQUENT at most
    log_counts: np.ndarray  # log of their smoothed counts


def vocabulary(counts: DataFrame) -> Words:
    """The most frequent words with ids by frequency (ties go by hash), the buckets of the others, and frequent words' counts."""
    rows = counts.orderBy(F.desc("n"), "h").limit(VOCABULARY - BUCKETS).collect()
    h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(h)
    total, distinct = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        total[r["bucket"]], distinct[r["bucket"]] = r["n"], r["words"]
    own = np.array([r["bucket"] for r in rows], np.int64)
    np.subtract.at(total, own, np.array([r["n"] for r in rows], np.int64))
    np.subtract.at(distinct, own, 1)
    known = np.array([r["n"] for r in rows] + [0] * (VOCABULARY - BUCKETS - len(rows)))
    totals = np.concatenate([known + SMOOTH, total + SMOOTH * (distinct + 1)])
    frequent, log_counts = _frequent(counts)
    return Words(h[order], order.astype(np.int64), np.log(totals[VOCABULARY - BUCKETS :]), counts, totals, int(known.sum() + total.sum()), frequent, log_counts)


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and log counts of all words that are at least so frequent that there are ``FREQUENT`` of them at most."""
    size = F.floor(F.log2("n") * 8)  # counts in steps of a tenth or less
    least, room = None, FREQUENT
    for r in sorted(counts.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["size"]
    rows = [] if least is None else counts.filter(size >= least).select("h", "n").collect()
    h, n = np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], float)
    order = np.argsort(h)
    return h[order], np.log(n[order] + SMOOTH)


def start(words: Words) -> np.ndarray:
    """Weights of a network that gives every word its frequency, whatever is around it."""
    net = WindowNetwork()
    by_class = words.totals.reshape(CLASSES, MEMBERS)
    net.part["words"][:] *= SPREAD
    net.part["inner"][:] *= 10 / np.sqrt(2 * SIDE * WIDTH)
    net.part["classes"][:] = net.part["members"][:] = 0
    net.part["class_bias"][:] = np.log(by_class.sum(axis=1) / by_class.sum())
    net.part["member_bias"][:] = np.log(by_class / by_class.sum(axis=1, keepdims=True))
    return net.weights


def encode(docs: DataFrame, words: Words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, key, doc_id, ids, known, rare of every text, as a table that training and scoring read in place of the texts.

    ids are those of its words, two bytes each. known is what can be said at once of the shares that its words have of
    their buckets: the logs of frequent words' counts, less those of all the buckets. rare lists its other words in
    buckets by hash, and how often it has them; their counts are joined. key says which rows are equal.
    """
    tables = docs.sparkSession.sparkContext.broadcast((words.hashes, words.ids, words.log_totals, words.frequent, words.log_counts))
    schema = "row long, key long, doc_id long, ids binary, known double, rare array<struct<h:bigint,c:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, own, log_totals, frequent, log_counts = tables.value
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo, hi, flat in _flats(b.column("_text")):
                ids = _ids(flat, hashes, own).astype(np.int16)
                at = np.flatnonzero(ids >= VOCABULARY - BUCKETS)
                share = -log_totals.take(ids.take(at) - (VOCABULARY - BUCKETS))
                found, place = _find(frequent, flat.word.take(at))
                share[found] += log_counts.take(place[found])
                # of no words at all, bincount gives whole numbers: the type is set below
                known = np.bincount(flat.doc.take(at), weights=share, minlength=flat.n)  # each document by itself
                bounds, h, c = _distinct(flat, at[~found])
                rare = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], names=["h", "c"]))
                coded = pa.Array.from_buffers(pa.binary(), flat.n, [None, pa.py_buffer((2 * flat.first).astype(np.int32)), pa.py_buffer(ids)])
                key, doc_id = (b.column(c).slice(lo, hi - lo) for c in ("key", "_id"))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + flat.n)), key, doc_id, coded, pa.array(known, pa.float64()), rare], names=["row", "key", "doc_id", "ids", "known", "rare"])
                row += flat.n

    return settle(keyed(docs, id_col, text_col).select(F.xxhash64("_id", "_th").alias("key"), "_id", "_text").mapInArrow(run, schema), "coded")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> tuple[np.ndarray, Words]:
    """Weights trained on every document once, and the words.

    Null and empty texts teach nothing; repeated rows are trained on each; words with equal counts are taken by hash;
    very long texts are worked on whole; other columns are ignored; an empty table gives the weights at the start and
    no words. Rows that repeat both id and text are of one shard.
    """
    words = vocabulary(settle(word_counts(docs, text_col), "words"))
    return train(encode(docs, words, id_col, text_col), words, rounds), words


def train(coded: DataFrame, words: Words, rounds: int = ROUNDS) -> np.ndarray:
    """Weights trained on all documents of a table that ``encode`` has made."""
    sc = coded.sparkSession.sparkContext
    shards = max(1, -(-words.n // (rounds * SHARD)))
    place = F.pmod("key", F.lit(shards * rounds))
    weights = start(words)
    for r in range(rounds):
        begin = sc.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net = WindowNetwork(begin.value.copy())
            seen = train_shard(net, (np.frombuffer(x.as_buffer(), np.int16) for b in batches for x in b.column("ids")))
            if seen:
                whole = np.rint(np.clip(net.weights.astype(float), -_MOST, _MOST) * _SCALE).astype(np.int64)
                # times the words seen, in two parts that stay exact in sums of a million tasks
                blob = np.stack([whole * (seen >> 20), whole * (seen & (1 << 20) - 1)])
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([blob.tobytes()], pa.binary())], names=["seen", "blob"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros(2 * _SIZE, np.int64), 0
            for b in batches:
                for n, blob in zip(b.column("seen").to_pylist(), b.column("blob").to_pylist(), strict=True):
                    total, seen = total + np.frombuffer(blob, np.int64), seen + n
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["seen", "blob"])

        share = coded.filter((F.floor(place / shards) == r) & (F.octet_length("ids") > 0)).select("key", "ids")
        share = share.repartitionById(shards, (place % shards).cast("int")).sortWithinPartitions("key", "ids")
        sums = share.select("ids").mapInArrow(run, "seen long, blob binary")
        # added up in two steps: first in as many tasks as the number of sums asks for
        for deal in ([F.xxhash64("blob")], [PARTIALS, F.xxhash64("blob")]):
            sums = sums.repartition(*deal).mapInArrow(add, "seen long, blob binary")
        sums = sums.collect()
        seen = sum(x["seen"] for x in sums)
        if seen:
            high, low = sum(np.frombuffer(x["blob"], np.int64) for x in sums).reshape(2, _SIZE).astype(float)
            weights = ((high * (1 << 20) + low) / (seen * _SCALE)).astype(np.float32)
    return weights


def _distinct(flat: W.Flat, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words at ``at``: bounds of each document's distinct ones, their hashes, and how often the document has them."""
    order = at[np.lexsort((flat.word[at], flat.doc[at]))]
    doc, word = flat.doc[order], flat.word[order]
    new = np.ones(len(order), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])
    first = np.flatnonzero(new)
    return np.searchsorted(doc[first], np.arange(flat.n + 1)), word[first], np.diff(np.append(first, len(order)))


def score(docs: DataFrame, weights: np.ndarray, words: Words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_likelihood (sum), mean_log_likelihood of every whole text.

    A null, empty or blank text has no words, a sum of 0 and a null mean. Equal texts have equal scores but for
    rounding, each row its own; other columns are ignored; an empty table gives an empty one.
    """
    return score_coded(encode(docs, words, id_col, text_col), weights, words)


def score_coded(coded: DataFrame, weights: np.ndarray, words: Words) -> DataFrame:
    """The scores of a table that ``encode`` has made: the network's sums, and words' counts that meet the rows in a shuffle."""
    model = coded.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = WindowNetwork(model.value)
        for b in batches:
            for lo, hi, buf, at in W.slices(b.column("ids"), 2 * BLOCK):
                ids, first = buf.view(np.int16), at // 2
                line, place = _spaced(ids, first)
                logs = np.zeros(len(ids))
                for s in range(0, len(ids), 2 * BATCH):
                    e = min(len(ids), s + 2 * BATCH)
                    logs[s:e] = net.log_probabilities(_beside(line, place[s:e]), ids[s:e])
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                sums = np.bincount(doc, weights=logs, minlength=hi - lo)  # each document by itself
                row, doc_id, known = (b.column(c).slice(lo, hi - lo) for c in ("row", "doc_id", "known"))
                yield pa.RecordBatch.from_arrays([row, doc_id, pa.array(np.diff(first)), pc.add(known, pa.array(sums, pa.float64()))], names=["row", "doc_id", "n_words", "net"])

    rows = coded.select("row", "doc_id", "ids", "known").mapInArrow(run, "row long, doc_id long, n_words long, net double")
    counts = words.counts.select("h", "n").hint("shuffle_hash")
    shares = coded.select("row", F.inline("rare")).join(counts, "h", "left").groupBy("row").agg(F.sum(F.col("c") * F.ln(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("share"))
    total = F.col("net") + F.coalesce("share", F.lit(0.0))
    return rows.join(shares, "row", "left").select("doc_id", "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_likelihood"))


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    words = vocabulary(settle(word_counts(docs), "words"))
    coded = encode(docs, words)
    return score_coded(coded, train(coded, words), words)
