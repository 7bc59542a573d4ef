"""Token counts by a count-only Viterbi search.

An Aho-Corasick automaton over the pieces finds, in one walk over a word, every piece that ends at each place; the
search keeps just the best score and its number of pieces for each place, no paths. Each different word is searched
once for as long as a worker remembers it. One pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _words as W
from ._common import documents, keyed
from ._pieces import Pieces, default_vocabulary, marked_words

CACHE, LONG = 500_000, 256  # words that a worker remembers, and the bytes of the longest of them


class PieceCounts(dict):
    """Marked word (bytes) -> number of pieces on its best path."""

    def __init__(self, pieces: Pieces):
        import ahocorasick

        super().__init__()
        self.unknown = pieces.unknown
        self.single = {p for p in pieces.score if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, (score, _) in pieces.score.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode("utf-8", "replace")
        n, single = len(word), self.single
        best, count = [-np.inf] * (n + 1), [0] * (n + 1)
        best[0], done = 0.0, 0  # places up to `done` are final

        def close(upto: int) -> None:
            for p in range(done + 1, upto + 1):  # a character without a piece comes last and must be better
                if word[p - 1] not in single and best[p - 1] + self.unknown > best[p]:
                    best[p], count[p] = best[p - 1] + self.unknown, count[p - 1] + len(word[p - 1].encode())

        for at, (length, score) in self.automaton.iter(word):  # the longest first at each place
            end = at + 1
            if done < end - 1:
                close(end - 1)
                done = end - 1
            total = best[end - length] + score
            if total > best[end]:
                best[end], count[end] = total, count[end - length] + 1
        close(n)
        if len(raw) <= LONG:
            self[raw] = count[n]
        return count[n]

    def of(self, text: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        return sum(map(self.__getitem__, marked_words(text)))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens of every whole text.

    A null or empty text has none. Equal rows each get a row; very long texts are worked on whole; other columns are
    ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts(Pieces.load(vocabulary))
        for b in batches:
            for lo, hi, buf, at in W.slices(b.column("_text")):
                raw = buf.tobytes()
                n = [counts.of(raw[at[i] : at[i + 1]]) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(lo, hi - lo), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return keyed(docs, id_col, text_col).select("_id", "_text").mapInArrow(run, "doc_id long, n_tokens long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), default_vocabulary())
