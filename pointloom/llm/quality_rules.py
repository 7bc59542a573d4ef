"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths mark the words that lie inside n-grams found twice or more in one text;
the verdict is the share of the text's word characters that they cover, and the share inside repeated lines.
One pass, no shuffle: a document is judged by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _words as W
from ._common import documents, keyed

#: Largest allowed share of word characters inside n-grams that occur twice or more, by n; and inside lines that repeat
#: an earlier line. Of labelled good texts that pass the base, one in a thousand has a higher share.
COVERAGE = {5: 0.20, 6: 0.19, 8: 0.18, 10: 0.17}
LINES = 0.15
MIN_WORDS, WINDOW, MAX_REPEAT = 10, 5, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeated(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which (document, hash) occur twice or more."""
    key = W.mix(h ^ W.mix(doc.astype(np.uint64) + W.U(1)))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[inverse] > 1


def _covered(n_words: int, at: np.ndarray, n: int) -> np.ndarray:
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + n, n_words), -1)
    return np.cumsum(step[:-1]) > 0


def measure(buf: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each document of a slice."""
    flat = W.flatten(buf, at)
    n_words = flat.count()
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    chars = points[flat.end] - points[flat.start]
    out = {"n_words": n_words, "word_chars": flat.per_word_doc(chars), "n_symbols": flat.per_doc(_SYMBOL[buf])}

    # lines: from a document's start or a newline to the next newline or the document's end
    full = np.flatnonzero(np.diff(at) > 0)
    newline = np.flatnonzero(buf == 10)
    begins = np.sort(np.concatenate([at[:-1][full], newline + 1]))
    owner = np.searchsorted(at, begins, "right") - 1
    keep = (owner < flat.n) & (begins < len(buf))
    begins, owner = begins[keep], owner[keep]
    begins, pick = np.unique(begins, return_index=True)
    owner = owner[pick]
    stops = np.minimum(np.searchsorted(newline, begins), len(newline))
    stops = np.where(stops < len(newline), newline[np.minimum(stops, max(0, len(newline) - 1))] if len(newline) else len(buf), len(buf))
    stops = np.minimum(stops, at[owner + 1]) if len(owner) else stops
    w0, w1 = np.searchsorted(flat.start, begins), np.searchsorted(flat.start, stops)
    worded = w1 > w0
    begins, stops, owner, w0, w1 = begins[worded], stops[worded], owner[worded], w0[worded], w1[worded]
    h = W.runs(W.prefix(buf.astype(np.uint64) + W.U(1)), begins, stops)
    key = W.mix(h ^ W.mix(owner.astype(np.uint64) + W.U(1)))
    earlier = np.ones(len(key), bool)
    earlier[np.unique(key, return_index=True)[1]] = False
    sums = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=sums[1:])
    out["n_dup_lines"] = np.bincount(owner[earlier], minlength=flat.n)
    out["dup_line_chars"] = np.bincount(owner[earlier], weights=(sums[w1] - sums[w0])[earlier], minlength=flat.n).astype(np.int64)

    # n-grams: one that is found again begins with a shorter one that is, so each length looks at what is left
    total, left, prefix = len(chars), flat.left(), W.prefix(flat.word)
    at_n = np.flatnonzero(left >= WINDOW)
    for n in sorted({WINDOW, *COVERAGE}):
        at_n = at_n[left[at_n] >= n]
        at_n = at_n[_repeated(flat.doc[at_n], W.runs(prefix, at_n, at_n + n))]
        covered = _covered(total, at_n, n)
        if n == WINDOW:
            out["n_repeat_words"] = flat.per_word_doc(covered)
        out[f"dup_{n}gram_chars"] = flat.per_word_doc(np.where(covered, chars, 0))
    return out


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT * m["n_words"])
    good = ~failed & (m["dup_line_chars"] <= LINES * m["word_chars"])
    for n, most in COVERAGE.items():
        good &= m[f"dup_{n}gram_chars"] <= most * m["word_chars"]
    return failed, good


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"dup_{n}gram_chars" for n in COVERAGE]]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Judge every whole text.

    Returns doc_id, the counts, base_failed and kept (and ``carry``, columns of the input, as ``_text`` and ``_carry`` for ``carried``).
    A null or empty text has no words and fails; equal rows each get a row; an empty table gives an empty one; other
    columns of any name are ignored unless carried. Ties don't arise: every count is exact. Very long texts are measured
    whole, one at a time.
    """
    rows = keyed(docs, id_col, text_col, carry)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"
    if carry:
        schema += f", _text string, _carry {rows.schema['_carry'].dataType.simpleString()}"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, at in W.slices(b.column("_text")):
                m = measure(buf, at)
                failed, kept = verdict(m)
                cols = [b.column("_id").slice(lo, hi - lo), *[pa.array(m[c].astype(np.int64)) for c in COUNTS], pa.array(failed), pa.array(kept)]
                names = ["doc_id", *COUNTS, "base_failed", "kept"]
                if carry:
                    cols += [b.column(c).slice(lo, hi - lo) for c in ("_text", "_carry")]
                    names += ["_text", "_carry"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.drop("_th").mapInArrow(judge, schema)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _ngram_sql(n: int) -> str:
    return f"""g{n} as (select doc_id, p, array_to_string(ws[p:p+{n - 1}], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - {n - 2})) as p from w)),
c{n} as (select distinct doc_id, unnest(range(p, p + {n})) as p from (select *, count(*) over (partition by doc_id, k) as c from g{n}) where c > 1),
d{n} as (select doc_id, count(*) as words, sum(length(word)) as chars from c{n} join t using (doc_id, p) group by doc_id)"""


OP10_SQL = rf"""
with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
t as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
b as (select doc_id, sum(length(word)) as word_chars from t group by doc_id),
l as (select doc_id, line, row_number() over (partition by doc_id, line order by i) as k from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from w) where regexp_matches(line, '[^\x20\x09-\x0D]')),
ld as (select doc_id, count(*) as n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) as chars from l where k > 1 group by doc_id),
{", ".join(_ngram_sql(n) for n in COVERAGE)},
a as (select w.doc_id, len(ws)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
 coalesce(ld.n, 0)::bigint as n_dup_lines, coalesce(ld.chars, 0) as line_chars, coalesce(d5.words, 0)::bigint as n_repeat_words, {", ".join(f"coalesce(d{n}.chars, 0) as x{n}" for n in COVERAGE)}
 from w left join b using (doc_id) left join ld using (doc_id) {" ".join(f"left join d{n} using (doc_id)" for n in COVERAGE)}),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words as base_failed from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 not base_failed and line_chars <= {LINES}e0 * word_chars and {" and ".join(f"x{n} <= {c}e0 * word_chars" for n, c in COVERAGE.items())} as kept from f
"""
