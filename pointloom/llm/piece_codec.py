"""Encoding to and decoding from pieces by a shared-prefix Viterbi search.

The distinct marked words of a slice of documents are sorted, which walks their trie depth first: a word takes over
the forward scores of the characters it shares with the one before and goes on from there. Texts are then put
together from their words' ids. One pass, no shuffle; a worker remembers a bounded number of words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _words as W
from ._common import documents, keyed
from ._pieces import Pieces, default_vocabulary, marked_words

CACHE, LONG = 300_000, 256  # words that a worker remembers, and the bytes of the longest of them


class SharedPrefixViterbi:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.tails = {p[k:] for p in pieces.score for k in range(len(p))}  # what pieces end with
        self.known: dict[bytes, bytes] = {}
        self.long: list[bytes] = []

    def segment(self, words: list[str]) -> list[list[int]]:
        """Ids of sorted words."""
        score, tails, unknown, byte_id = self.pieces.score, self.tails, self.pieces.unknown, self.pieces.byte_id
        best, start, last = [0.0], [0], [-1]
        out, before = [], ""
        for word in words:
            shared = len(commonprefix((before, word)))
            del best[shared + 1 :], start[shared + 1 :], last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, at, piece = best[end - 1] + unknown, end - 1, -1
                single = word[end - 1] in score
                if single:
                    top = -np.inf
                j = end - 1
                while j >= 0:
                    text = word[j:end]
                    if text not in tails:
                        break
                    found = score.get(text)
                    if found is not None and best[j] + found[0] >= top:  # from the shortest: of equal ones the longest stays
                        top, at, piece = best[j] + found[0], j, found[1]
                    j -= 1
                best.append(top)
                start.append(at)
                last.append(piece)
            ids: list[int] = []
            end = len(word)
            while end:
                if last[end] >= 0:
                    ids.append(last[end])
                else:
                    ids += [byte_id[b] for b in reversed(word[end - 1].encode())]
                end = start[end]
            out.append(ids[::-1])
            before = word
        return out

    def learn(self, words: set[bytes]) -> None:
        """Segment the words that aren't known yet, all in one walk. Long ones are known until the next call."""
        if len(self.known) > CACHE:
            self.known.clear()
        for w in self.long:
            self.known.pop(w, None)
        self.long = [w for w in words if len(w) > LONG]
        new = sorted((w.decode("utf-8", "replace"), w) for w in words if w not in self.known)
        for (_, raw), ids in zip(new, self.segment([t for t, _ in new]), strict=True):
            self.known[raw] = np.array(ids, "<u4").tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, without the mark before it."""
        text = b"".join(map(self.pieces.bytes_of.__getitem__, ids.tolist()))
        return text[1:] if text.startswith(b" ") else text


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_ids, ids_crc32, round_trip (and ids, array<int>) of every whole text.

    round_trip: the text decoded from its ids is the text; false where the text has a mark, which comes back as a space.
    A null or empty text has no ids. Of equally good pieces that end at one place the longest is taken. Equal rows each get a row; other columns are ignored; an empty table gives an empty one. Very
    long texts are worked on whole.
    """
    schema = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = SharedPrefixViterbi(Pieces.load(vocabulary))
        for b in batches:
            for lo, hi, buf, at in W.slices(b.column("_text")):
                raw = buf.tobytes()
                texts = [raw[at[i] : at[i + 1]] for i in range(hi - lo)]
                words = [marked_words(t) for t in texts]
                search.learn(set().union(*words))
                made = [np.frombuffer(b"".join(map(search.known.__getitem__, w)), "<u4") for w in words]
                cols = [b.column("_id").slice(lo, hi - lo), pa.array([len(x) for x in made], pa.int64()), pa.array([zlib.crc32(x) for x in made], pa.int64())]
                cols.append(pa.array([search.decode(x) == t for x, t in zip(made, texts, strict=True)], pa.bool_()))
                if ids:
                    cols.append(pa.array([x.astype(np.int32) for x in made], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return keyed(docs, id_col, text_col).select("_id", "_text").mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of rows of ids. Null ids give a null text; bytes that aren't UTF-8 become replacement characters."""
    schema = "doc_id long, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = SharedPrefixViterbi(Pieces.load(vocabulary))
        for b in batches:
            texts = [None if x is None else search.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{ids_col}` ids").mapInArrow(run, schema)


def op2_piece_codec(spark, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), default_vocabulary(), ids=False)
