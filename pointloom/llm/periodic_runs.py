"""Periodic runs of words, found by recursive frequency splitting and a scan of lags.

A run repeats q words three times or more, so each of its words occurs three times or more inside it. A word that is
rarer within its segment therefore lies in no run and splits the segment; the parts are counted again, until nothing
splits. In the segments that survive, each lag that can be a period is scanned: runs of words are numbered exactly, by
doubling, and the next equal run of between q and 2q words lies q words on, all along a periodic stretch.

One pass, no shuffle: a document is judged by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._common import WORD, documents, keyed

#: A run has this many words at least, and this many periods.
LEAST, TIMES = 24, 3
#: Rounds of splitting. A text made to lose one word a round would take as many as it has words; what is left after so
#: many rounds is scanned as it is, which finds the same runs.
ROUNDS = 64


def _numbers(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys as numbers from 0, and how often each key occurs."""
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    return inverse, count[inverse]


def segments(ids: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that can be in runs, ascending, and each one's segment (consecutive places of one document)."""
    place, done = np.arange(len(ids)), []
    for _ in range(rounds):
        if not len(place):
            break
        new = np.ones(len(place), bool)
        new[1:] = (np.diff(place) != 1) | (doc[place[1:]] != doc[place[:-1]])
        segment = np.cumsum(new) - 1
        size = np.bincount(segment)
        keep = size[segment] >= least
        place, segment = place[keep], segment[keep]
        key, count = _numbers(segment * (ids.max() + 1) + ids[place])
        rare = count < times
        split = np.zeros(len(size), bool)
        split[segment[rare]] = True
        done.append(place[~split[segment]])
        place = place[split[segment] & ~rare]
    place = np.sort(np.concatenate([*done, place]))
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(place) != 1) | (doc[place[1:]] != doc[place[:-1]])
    return place, np.cumsum(new) - 1


def find_runs(ids: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run of equal-lag words in ``ids``, sorted by start, then period.

    ``ids`` are the words' numbers and ``doc`` the document of each, ascending; a run lies within one document.
    """
    none = np.zeros(0, np.int64)
    place, segment = segments(ids, doc, least, times, rounds)
    if not len(place):
        return none, none, none
    size = np.bincount(segment)
    after = np.cumsum(size)[segment]  # where each word's segment ends, counted in survivors
    rank, _ = _numbers(segment * (ids.max() + 1) + ids[place])
    at, m, found = np.arange(len(place)), 1, []
    while len(at):
        # the next place with the same m words
        order = np.argsort(rank[at], kind="stable")
        same = rank[at[order[1:]]] == rank[at[order[:-1]]]
        lag = np.zeros(len(at), np.int64)
        lag[order[:-1][same]] = (at[order[1:]] - at[order[:-1]])[same]
        hit = np.flatnonzero((lag > m // 2) & (lag <= m))
        if len(hit):
            i, q = at[hit], lag[hit]
            head = np.ones(len(i), bool)
            head[1:] = (np.diff(i) != 1) | (q[1:] != q[:-1]) | (segment[i[1:]] != segment[i[:-1]])
            first = np.flatnonzero(head)
            last = np.append(first[1:], len(i)) - 1
            length = i[last] - i[first] + q[first] + m
            long = length >= np.maximum(least, times * q[first])
            found.append((place[i[first]][long], length[long], q[first][long]))
        # twice as many words, where they can still be a period's; what isn't found twice isn't found again longer
        twice = np.zeros(len(at), bool)
        twice[order[:-1][same]] = twice[order[1:][same]] = True
        alive = np.zeros(len(place) + 1, bool)
        alive[at[twice]] = True
        at = at[twice]
        at = at[(at + 2 * m <= after[at]) & (times * (m + 1) <= size[segment[at]])]
        at = at[alive[at + m]]
        if len(at):
            new = np.full(len(place), -1, np.int64)
            new[at] = _numbers(rank[at] * np.int64(len(place)) + rank[at + m])[0]
            rank = new
        m *= 2
    start, length, q = (np.concatenate(x) if x else none for x in zip(*found, strict=True)) if found else (none, none, none)
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def _greater(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
    """Compares (start, length, period) by length/period, exactly; then the smaller start, then the smaller period."""
    x, y = a[1] * b[2], b[1] * a[2]
    return (x > y) - (x < y) or (b[0] > a[0]) - (b[0] < a[0]) or (b[2] > a[2]) - (b[2] < a[2])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The runs of every whole text, and the text with each run cut down to its first period.

    A run is a stretch of ``least`` words and ``times`` periods or more that no neighbouring word extends. Returns
    doc_id, n_words, runs (array of start, length, period, by start, then period), best (the run with the greatest
    length/period; ties: smallest start, then period; null without a run), collapsed (kept words joined by one space)
    and, with ``carry``, columns of the input as ``_text`` and ``_carry``. A null or empty text has no words, no runs and
    an empty result; equal rows each get a row; an empty table gives an empty one; other columns of any name are
    ignored unless carried. A very long text is worked on whole, alone, in n log n steps.
    """
    rows = keyed(docs, id_col, text_col, carry)
    run = "struct<start: bigint, length: bigint, period: bigint>"
    schema = f"doc_id long, n_words long, runs array<{run}>, best {run}, collapsed string"
    if carry:
        schema += f", _text string, _carry {rows.schema['_carry'].dataType.simpleString()}"
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, at in W.slices(b.column("_text")):
                flat = W.flatten(buf, at, hashed=False)
                ids = W.word_array(flat).dictionary_encode().indices.to_numpy().astype(np.int64)
                start, length, q = find_runs(ids, flat.doc, least, times)
                gone = np.zeros(len(ids) + 1, np.int64)
                np.add.at(gone, start + q, 1)
                np.add.at(gone, start + length, -1)
                keep = np.cumsum(gone[:-1]) == 0
                of = flat.doc[start]
                cut = np.searchsorted(of, np.arange(flat.n + 1))
                own = start - flat.first[of]
                triples = list(zip(own.tolist(), length.tolist(), q.tolist(), strict=True))
                best = [max(triples[i:j], key=cmp_to_key(_greater)) if j > i else None for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                raw, text = buf.tobytes(), []
                kept = flat.per_word_doc(keep)
                for d in range(flat.n):
                    words = raw[at[d] : at[d + 1]].split()
                    if words and kept[d] < len(words):
                        words = [words[i] for i in np.flatnonzero(keep[flat.first[d] : flat.first[d + 1]])]
                    text.append(b" ".join(words).decode())
                cols = [
                    b.column("_id").slice(lo, hi - lo), pa.array(flat.count()),
                    pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.StructArray.from_arrays([pa.array(own), pa.array(length), pa.array(q)], fields=list(kind))),
                    pa.array([x and dict(zip(("start", "length", "period"), x, strict=True)) for x in best], kind), pa.array(text, pa.string()),
                ]
                names = ["doc_id", "n_words", "runs", "best", "collapsed"]
                if carry:
                    cols, names = [*cols, *(b.column(c).slice(lo, hi - lo) for c in ("_text", "_carry"))], [*names, "_text", "_carry"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.drop("_th").mapInArrow(scan, schema)


def edited(docs: DataFrame) -> DataFrame:
    """The query's texts: in one document of ten, the words from a place on repeat the first few of them.

    With h = crc32 of the id, g = floor(h/10), n words: words i >= a = g % n become word a + (i-a) % p, where
    p = 1 + floor((n-a) / (3 + g%8)).
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w")  # null, or no words: the text stays
    words = words.withColumn("a", (F.col("g") % F.when(n > 0, n)).cast("int"))
    words = words.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = n - F.col("a")
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    again = F.slice(F.flatten(F.array_repeat(period, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")
    return words.select("doc_id", F.when(F.col("p").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    r = F.col("best")
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    milli = F.expr("cast((1000 * best.length) div best.period as long)")
    return periodic_runs(edited(documents(spark, sf_dir))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"), milli.alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: crc32 of ids, by the table of a byte's remainders; then pairs of equal words q apart, and stretches of such pairs.
CRC_SQL = """rem as (select i, 0 as k, i::bigint as c from range(256) t(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from rem where k < 8),
tab as (select list(c order by i) as v from rem where k = 8),
crc as (select doc_id, doc_id::varchar as s, 1 as k, 4294967295::bigint as c from documents union all select doc_id, s, k + 1, xor(c >> 8, v[(xor(c, ascii(s[k])) & 255) + 1]) from crc, tab where k <= length(s)),
hashed as (select doc_id, xor(c, 4294967295) as h from crc where k = length(s) + 1)"""
OP11_SQL = rf"""
with recursive {CRC_SQL},
o as (select doc_id, h, h // 10 as g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents join hashed using (doc_id)),
e as (select *, len(ws) as n, case when h % 10 = 0 and len(ws) > 0 then g % len(ws) end as a from o),
f as (select *, 1 + (n - a) // (3 + g % 8) as p from e),
t as (select doc_id, n, i, case when i >= a then ws[a + (i - a) % p + 1] else ws[i + 1] end as word from (select *, unnest(range(n)) as i from f)),
x as (select a.doc_id, a.i, b.i - a.i as q from t a join t b on a.doc_id = b.doc_id and a.word = b.word and b.i > a.i and 3 * (b.i - a.i) <= a.n),
y as (select doc_id, q, min(i) as start, count(*) + q as length from (select *, i - row_number() over (partition by doc_id, q order by i) as k from x) group by doc_id, q, k),
r as (select doc_id, start, length, min(q) as period from y where length >= greatest({LEAST}, {TIMES} * q) group by doc_id, start, length),
b as (select *, row_number() over (partition by doc_id order by length / period desc, start, period) as k from r),
l as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from r group by doc_id),
d as (select distinct doc_id, unnest(range(start + period, start + length)) as i from r),
c as (select t.doc_id, string_agg(word, ' ' order by t.i) as kept from t anti join d on t.doc_id = d.doc_id and t.i = d.i group by t.doc_id)
select o.doc_id, coalesce(n_runs, 0)::bigint as n_runs, b.start::bigint as start, b.length::bigint as length, b.period::bigint as period, (1000 * b.length // b.period)::bigint as exponent_milli,
 sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from o left join b on b.doc_id = o.doc_id and b.k = 1 left join l on l.doc_id = o.doc_id left join c on c.doc_id = o.doc_id
"""
