"""Best-fit packing of token sequences under several capacities.

A sequence (bin) has room for so many tokens, documents and attention cost (the sum of squared lengths). Pieces are
taken longest first; of the bins in which one fits under *every* capacity, it goes to the one whose residual vector
it matches best: smallest residual norm after placement, or largest weighted dot product with the residual.

Tokenizing is one pass over the texts that keeps 40 bytes a piece. Pieces are then dealt to shards of a fixed
expected size by a hash, and each shard is packed by itself: a shard wastes at most about one bin among thousands,
and no task or driver ever sees all pieces.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._common import documents, keyed, settle

CAPACITY, END = 4096, 1
SHARD = 16384  # pieces, as expected
CACHE, LONG = 400_000, 64  # words that a worker remembers, and the bytes of the longest of them

#: The byte-level alphabet of such vocabularies: printable bytes stand for themselves, the others for 256, 257, ...
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_SHOWN))}
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")  # words whose splits are the same under any version of Unicode
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class _PartIds(dict):
    """Part of a word (in lower case) -> its ids."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        self.id = [i.to_bytes(4, "little") for i in range(1 << 16)]

    def __missing__(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE)
        ids = self[part] = b"".join([self.id[t.id] for t in self.model.tokenize(shown)])
        return ids


class WordIds(dict):
    """Word (bytes) -> its ids, as little-endian 32-bit numbers. White space separates in this vocabulary, so a
    text's ids are its words' ids in a row. Each different word is encoded once for as long as it is remembered;
    long ones aren't."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.parts = _PartIds(self.whole.model)

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > LONG:
            return self._whole(word)
        text = word.decode("utf-8", "replace")
        stem = text.rstrip(".,;:!?")
        if _LETTERS.fullmatch(stem):  # letters are one part, and so are the signs after them
            ids = self.parts[stem.lower()]
            if len(stem) < len(text):
                ids += self.parts[text[len(stem) :]]
        elif _PLAIN.fullmatch(text) and not ("<" in text and any(s in text for s in self.special)):
            ids = b"".join(map(self.parts.__getitem__, _PIECE.findall(text.lower())))
        else:
            ids = self._whole(word)
        self[word] = ids
        return ids

    def _whole(self, word: bytes) -> bytes:
        text = unicodedata.normalize("NFC", word.decode("utf-8", "replace"))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        if len(self) > CACHE:
            self.clear()
        if len(self.parts) > CACHE:
            self.parts.clear()
        return b"".join(map(self.__getitem__, text.split()))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, row_key, piece, start, length, ids_crc32 (and ``ids``, the piece's bytes).

    A document's ids are its text's, then ``end``; only documents of more than ``capacity`` ids are cut. A null or
    empty text has just ``end``. ``row_key`` tells rows with the same id apart; equal rows each give their pieces, and
    a null id is kept. Very long texts are worked on whole; other columns are ignored. Needs a byte-level vocabulary
    that drops white space and has an end-of-word mark, such as word_bpe_49k.json.
    """
    rows = keyed(docs, id_col, text_col)
    schema = "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    tail = np.array([end], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        for b in batches:
            for lo, hi, buf, at in W.slices(b.column("_text")):
                raw, ids = buf.tobytes(), b.column("_id").slice(lo, hi - lo)
                keys = b.column("_th").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                row, piece, start, length, crc, blob = [], [], [], [], [], []
                for i in range(hi - lo):
                    data = words.encode(raw[at[i] : at[i + 1]]) + tail
                    for k, s in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[s : s + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            blob.append(part)
                out = [ids.take(pa.array(row, pa.int64())), pa.array(keys[row].astype(np.int64)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(blob, pa.binary())] * with_ids, names=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(encode, schema)


def place(lengths: np.ndarray, capacity: int = CAPACITY, max_docs: int | None = None, max_attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; every bin holds all three capacities.

    ``rule``: 'norm' takes the bin with the smallest weighted residual norm after placement, 'dot' the one with the
    largest weighted dot product of piece and residual. Ties go to the bin opened first; equal lengths are taken in
    the order given. A piece that alone breaks a capacity opens a bin of its own.
    """
    cap = np.array([capacity, max_docs or capacity, max_attention or capacity * capacity], float)
    w = np.asarray(weights, float)
    n = len(lengths)
    bins, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.zeros((3, max(1, n)))  # residuals as shares of the capacities, open bins first
    name, used = np.zeros(max(1, n), np.int64), np.zeros(max(1, n), np.int64)
    opened = live = 0
    order = np.argsort(-lengths, kind="stable")
    smallest = lengths[order[-1]] / cap[0] if n else 0
    for i in order:
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2]) / cap
        b = -1
        if live:
            rest = left[:, :live] - need[:, None]
            fits = (rest >= -1e-12).all(axis=0)
            if fits.any():
                if rule == "norm":
                    b = int(np.argmin(np.where(fits, w @ (rest * rest), np.inf)))
                else:
                    b = int(np.argmax(np.where(fits, (w * need) @ left[:, :live], -np.inf)))
        if b < 0:
            b = live
            left[:, b], name[b], used[b] = 1.0, opened, 0
            live += 1
            opened += 1
        bins[i], offset[i] = name[b], used[b]
        used[b] += lengths[i]
        left[:, b] -= need
        if left[0, b] < smallest - 1e-12 or left[1, b] < 1 / cap[1] - 1e-12:  # nothing fits any more; the rest keep their order
            left[:, b : live - 1] = left[:, b + 1 : live]
            name[b : live - 1], used[b : live - 1] = name[b + 1 : live].copy(), used[b + 1 : live].copy()
            live -= 1
    return bins, offset


def pack(parts: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_attention: int | None = None, rule: str = "norm", shard: int = SHARD) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces (doc_id, row_key, piece, length and more).

    Full pieces have a sequence of their own. The others go to shards of about ``shard`` pieces by a hash of their
    key and their place in the table, so a retried task makes the same sequences and repeated rows, which are pieces
    of their own, don't meet in one shard. ``max_docs`` and ``max_attention`` are the sequence's other capacities;
    without them only tokens bind, as ``capacity`` pieces and the square of ``capacity`` can't be exceeded. Columns
    named sequence_id or offset are replaced; others stay. Empty in, empty out.
    """
    parts = parts.drop("sequence_id", "offset")
    shards = max(1, -(-parts.count() // shard))
    to = F.pmod(F.xxhash64("doc_id", "row_key", "piece", F.monotonically_increasing_id()), F.lit(shards)).cast("long")
    dealt = parts.select(to.alias("shard"), F.struct(*parts.columns).alias("row"), "length", "doc_id", "row_key", "piece")
    schema = f"row {dealt.schema['row'].dataType.simpleString()}, sequence_id long, offset long"

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("row_key", "ascending"), ("piece", "ascending")])
        length = rows.column("length").to_numpy()
        alone = int((length >= capacity).sum())
        bins, offset = place(length[alone:], capacity, max_docs, max_attention, rule)
        # a sequence's name is its rank in the shard, times the shards, plus the shard's number
        name = np.concatenate([np.arange(alone), bins + alone]).astype(np.int64) * shards + key[0].as_py()
        return pa.table([rows.column("row"), pa.array(name), pa.array(np.concatenate([np.zeros(alone, np.int64), offset]))], names=["row", "sequence_id", "offset"])

    return dealt.groupBy("shard").applyInArrow(fill, schema).select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Tokenize, cut and pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    parts = settle(pieces(docs, tokenizer), "pieces")  # so that texts are tokenized once
    return pack(parts, **options).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), default_tokenizer())
