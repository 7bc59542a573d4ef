import re

import numpy as np
import pyarrow as pa

from pointloom.llm import _words as W

TEXTS = ["", None, "a", " a  b\tc\n", "é ☃x y", "\x0b\x0c ", "one two three one two", "x" * 500 + " y", "a\x1cb c\x85d"]


def test_words_and_hashes():
    seen = {}
    for lo, hi, buf, at in W.slices(pa.array(TEXTS), 16):
        flat = W.flatten(buf, at)
        for d in range(hi - lo):
            words = re.findall(r"[^\x20\x09-\x0D]+", TEXTS[lo + d] or "")
            s = slice(flat.first[d], flat.first[d + 1])
            assert [buf[a:b].tobytes().decode() for a, b in zip(flat.start[s], flat.end[s], strict=True)] == words
            for w, h in zip(words, flat.word[s].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_grams_stay_inside_documents():
    _, _, buf, at = next(W.slices(pa.array(["a b c d", "a b c", "d a b c d"])))
    flat = W.flatten(buf, at)
    where, h = W.grams(flat, 4)
    assert where.tolist() == [0, 7, 8] and h[0] == h[2] != h[1]
    doc, h = W.shingles(flat, 4)
    assert sorted(doc.tolist()) == [0, 1, 2, 2]
    assert len(np.unique(h)) == 3
