"""Substring deduplication with suffix automata of reference shards.

The reference is the corpus itself, so it is cut into shards that hold just what could match:

1. Every window of ``threshold`` words is named by its anchor, the smallest hash among its short word runs. Equal
   windows have equal anchors, and neighbouring windows mostly share one, so a document is a short list of anchors,
   each with its context: the words of all consecutive windows that it names. Anchors are counted over all documents.
2. Of anchors found twice or more, contexts that are equal word for word are collapsed to one with a number.
3. A shard holds whole anchors. It builds a suffix automaton over its contexts, with the number of places of every
   state, and streams the contexts through it for their matching statistics: the longest run of words ending at each
   word that is found twice or more. Runs of ``threshold`` words or more are the spans to remove.
4. Spans go back to the documents that have the context, and from there to their texts.

An automaton for all documents at once would have to be broadcast and would grow with the corpus, so shards travel
to their contexts by a shuffle on the anchor instead. An anchor whose different contexts have more than ``hot`` words
never meets in one task: its windows are counted one by one, with partial sums. Either way gives the same spans; of an
anchor with a single context every window is in all its places, so its spans need no automaton.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._common import documents, keyed, settle

THRESHOLD, ANCHOR = 35, 8
HOT = 200_000  # words of the different contexts of one anchor that may meet in one task
SHARD_WORDS = 60_000  # an automaton's words, unless one anchor has more


class SuffixAutomaton:
    """Of several word sequences, each standing for so many equal ones; ``count`` is the number of places of a state."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, edges: dict, link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word) -> int:
        """The part of state q that p reaches by word, as a state of its own."""
        nxt, link = self.next, self.link
        clone = self._state(nxt[q].copy(), link[q], self.length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        return clone

    def add(self, words: list, times: int = 1) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for word in words:
            q = nxt[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, word)
            else:
                cur = self._state({}, 0, length[last] + 1)
                p = last
                while p >= 0 and word not in nxt[p]:
                    nxt[p][word] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][word]
                    link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, word)
                last = cur
            count[last] += times

    def settle(self) -> None:
        """Hand each state's places on to the shorter runs that end there too."""
        count, link = self.count, self.link
        for s in np.argsort(-np.array(self.length), kind="stable").tolist():
            if link[s] >= 0:
                count[link[s]] += count[s]

    def repeated(self, words: list, threshold: int) -> list[tuple[int, int]]:
        """Maximal spans [from, to) covered by runs of ``threshold`` words or more found in two places or more."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        spans: list[tuple[int, int]] = []
        state = matched = 0
        for i, word in enumerate(words, 1):
            to = nxt[state].get(word)
            while state and (to is None or count[to] < 2):
                state = link[state]
                matched = length[state]
                to = nxt[state].get(word)
            if to is not None and count[to] >= 2:
                state, matched = to, matched + 1
            else:
                matched = 0
            if matched >= threshold:
                lo = i - matched
                while spans and spans[-1][1] >= lo:
                    lo = min(lo, spans.pop()[0])
                spans.append((lo, i))
        return spans


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _contexts(flat: W.Flat, threshold: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, document, first word in it and number of words, for all contexts of a slice."""
    total = len(flat.word)
    none = np.zeros(0, np.int64)
    if total < threshold:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    sums = W.prefix(flat.word)
    every = np.arange(total - anchor + 1)
    gram = W.runs(sums, every, every + anchor)
    bits = W.U(total.bit_length())  # the place in the low bits: the smallest is the leftmost of equal ones
    low = _sliding_min((gram >> bits << bits) | every.astype(np.uint64), threshold - anchor + 1)
    place = (low & ((W.U(1) << bits) - W.U(1))).astype(np.int64)
    valid = flat.left()[: len(low)] >= threshold
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    at = np.flatnonzero(first)
    runs = np.cumsum(first)[valid]  # number of the context of each window
    length = np.bincount(runs - 1, minlength=len(at)) + threshold - 1
    context = W.mix(W.runs(sums, at, at + length) ^ length.astype(np.uint64))
    return gram[place[at]], context, flat.doc[at], at - flat.first[flat.doc[at]], length


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _batch(schema: str, cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])


def anchors(rows: DataFrame, threshold: int, anchor: int) -> DataFrame:
    """One row per context of every document: h (anchor), c (context), _id, _th, at, len."""
    schema = "h long, c long, _id long, _th long, at int, len int"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, at in W.slices(b.column("_text")):
                h, c, doc, start, length = _contexts(W.flatten(buf, at), threshold, anchor)
                pick = pa.array(doc + lo)
                yield _batch(schema, [_int64(h), _int64(c), b.column("_id").take(pick), b.column("_th").take(pick), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))])

    return rows.select("_id", "_th", "_text").mapInArrow(scan, schema)


def _fetch(rows: DataFrame, wanted: DataFrame, threshold: int) -> DataFrame:
    """The words of the chosen contexts; of hot anchors, the hashes of their windows instead."""
    schema = "h long, c long, n long, words binary, window long, lo int"
    per_doc = wanted.groupBy("_id", "_th").agg(F.collect_list(F.struct("h", "c", "n", "at", "len", "hot")).alias("_want"))
    per_doc = per_doc.withColumnsRenamed({"_id": "i", "_th": "t"})
    both = rows.join(per_doc, rows["_id"].eqNullSafe(per_doc["i"]) & (rows["_th"] == per_doc["t"])).select("_text", "_want")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, at in W.slices(b.column("_text")):
                flat = W.flatten(buf, at)
                raw = buf.tobytes()
                sums = None
                out: list[tuple] = []
                for d, want in enumerate(b.column("_want").slice(lo, hi - lo).to_pylist()):
                    for w in want:
                        s = int(flat.first[d]) + w["at"]
                        e = s + w["len"]
                        if not w["hot"]:
                            out.append((w["h"], w["c"], w["n"], raw[flat.start[s] : flat.end[e - 1]], 0, -1))
                            continue
                        sums = W.prefix(flat.word) if sums is None else sums
                        each = np.arange(s, e - threshold + 1)
                        out += [(w["h"], w["c"], w["n"], None, x, k) for k, x in enumerate(W.runs(sums, each, each + threshold).view(np.int64).tolist())]
                cols = list(zip(*out, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()]
                yield _batch(schema, [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)])

    return both.mapInArrow(cut, schema)


def _match(shards: DataFrame, threshold: int, shard_words: int) -> DataFrame:
    """Spans of every context, from the automaton of its shard. Rows come sorted by anchor."""
    schema = "h long, c long, lo int, hi int"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, list[bytes]]] = []
        have: set[tuple[int, int]] = set()  # repeated rows of one document bring a context more than once
        size = 0

        def flush() -> pa.RecordBatch:
            auto, out = SuffixAutomaton(), []
            for _, _, n, words in held:
                auto.add(words, n)
            auto.settle()
            for h, c, _, words in held:
                out += [(h, c, lo, hi) for lo, hi in auto.repeated(words, threshold)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            return _batch(schema, [pa.array(x, k) for x, k in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)])

        for b in batches:
            for h, c, n, text in zip(*(b.column(x).to_pylist() for x in ("h", "c", "n", "words")), strict=True):
                if size >= shard_words and held[-1][0] != h:
                    yield flush()
                    held, have, size = [], set(), 0
                if (h, c) in have:
                    continue
                have.add((h, c))
                words = text.split()
                held.append((h, c, n, words))
                size += len(words)
        if held:
            yield flush()

    return shards.mapInArrow(stream, schema)


def repeated_spans(rows: DataFrame, threshold: int = THRESHOLD, anchor: int = ANCHOR, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """_id, _th, spans: for each document with such words, word ranges [lo, hi) covered by windows found elsewhere."""
    found = anchors(rows, threshold, anchor)
    # counted with partial sums; 'mixed' anchors have contexts that differ
    counted = found.groupBy("h").agg(F.count("*").alias("k"), F.min("c").alias("a"), F.max("c").alias("b"))
    often = settle(counted.filter("k > 1").select("h", (F.col("a") != F.col("b")).alias("mixed")), "often")  # written, so that the join can split a hot anchor
    places = settle(found.join(often, "h"), "places")
    mixed = places.filter("mixed")
    one = mixed.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_th", "at", "len")).alias("r"))
    crowd = one.groupBy("h").agg(F.sum("r.len").alias("k")).select("h", (F.col("k") > hot).alias("hot"))
    wanted = one.join(crowd, "h").select("h", "c", "n", "hot", "r.*")
    cut = settle(_fetch(rows, wanted, threshold), "contexts")
    cold = cut.filter("words is not null").select("h", "c", "n", "words")
    spans = _match(cold.repartition("h").sortWithinPartitions("h"), threshold, shard_words)
    windows = cut.filter("words is null").select("h", "c", "n", "window", "lo").distinct()  # repeated rows bring them twice
    again = windows.groupBy("window").agg(F.sum("n").alias("m")).filter("m > 1").select("window")
    spans = spans.unionByName(windows.join(again, "window", "left_semi").select("h", "c", "lo", (F.col("lo") + threshold).alias("hi")))
    # written, so that the join can split a context that very many documents have
    spans = settle(spans.groupBy("h", "c").agg(F.collect_list(F.struct("lo", "hi")).alias("s")), "spans")
    some = mixed.join(spans, ["h", "c"]).select("_id", "_th", F.transform("s", lambda s: F.struct((F.col("at") + s["lo"]).alias("lo"), (F.col("at") + s["hi"]).alias("hi"))).alias("s"))
    whole = places.filter("not mixed").select("_id", "_th", F.array(F.struct(F.col("at").alias("lo"), (F.col("at") + F.col("len")).alias("hi"))).alias("s"))
    return some.unionByName(whole).groupBy("_id", "_th").agg(F.flatten(F.collect_list("s")).alias("spans"))


def substring_dedup(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, **options) -> DataFrame:
    """Remove every word that lies in a run of ``threshold`` words found anywhere else.

    Returns doc_id, n_words, n_removed, kept (its words joined by one space), text (as it was if nothing is removed, else ``kept``) and ``_carry``. All copies lose the
    run, the first too; what is left isn't looked at again. Null and empty texts have no words; a row listed twice is
    found elsewhere, in itself; rows with equal or null ids are documents of their own; other columns are ignored
    unless carried; an empty table gives an empty one. Very long texts are worked on whole.
    """
    rows = keyed(docs, id_col, text_col, carry)
    spans = repeated_spans(rows, threshold, **options).withColumnsRenamed({"_id": "i", "_th": "t"})
    extra = ["_carry"] if carry else []
    both = rows.join(spans, rows["_id"].eqNullSafe(spans["i"]) & (rows["_th"] == spans["t"]), "left").select("_id", "_text", "spans", *extra)
    schema = "doc_id long, n_words long, n_removed long, kept string, text string"
    if carry:
        schema += f", _carry {rows.schema['_carry'].dataType.simpleString()}"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, at in W.slices(b.column("_text")):
                raw, total, gone, kept, text = buf.tobytes(), [], [], [], []
                given = b.column("_text").slice(lo, hi - lo)
                for d, found in enumerate(b.column("spans").slice(lo, hi - lo).to_pylist()):
                    words = raw[at[d] : at[d + 1]].split()
                    if found:
                        stay = np.ones(len(words), bool)
                        for s in found:
                            stay[s["lo"] : s["hi"]] = False
                        left = [words[i] for i in np.flatnonzero(stay)]
                    else:
                        left = words
                    total.append(len(words))
                    gone.append(len(words) - len(left))
                    kept.append(b" ".join(left).decode())
                    text.append(kept[-1] if gone[-1] else given[d].as_py())
                cols = [b.column("_id").slice(lo, hi - lo), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(text, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept", "text"]
                if carry:
                    cols, names = [*cols, b.column("_carry").slice(lo, hi - lo)], [*names, "_carry"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return both.mapInArrow(remove, schema)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
t as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
g as (select doc_id, p, array_to_string(ws[p:p+{THRESHOLD - 1}], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - {THRESHOLD - 2})) as p from w)),
c as (select distinct doc_id, unnest(range(p, p + {THRESHOLD})) as p from (select doc_id, p, count(*) over (partition by k) as n from g) where n > 1),
k as (select t.doc_id, string_agg(word, ' ' order by t.p) as kept, count(*) as n from t anti join c on t.doc_id = c.doc_id and t.p = c.p group by t.doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k using (doc_id)
"""
