"""A piece vocabulary read as a unigram model, and the cut of texts into marked words.

Spaces become marks, one mark goes before a text. No piece has a mark after another character, and none has a
newline, so a best path always breaks before a mark that follows a word and around a newline: words can be segmented
one by one, each different word once, and a text's best path is its words' best paths in a row.

Rules of the best path, as in the library for such vocabularies: scores add up from the left; a path replaces one to
the same place only if it is better, and paths are tried in the order of their last piece's start, so of equal ones
the longest last piece stays; a character that no piece stands for costs 10 more than the worst piece, tried last,
and is spelled in byte pieces.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

MARK = "▁"
UNKNOWN_COST = 10.0
_WORD = re.compile(rb" +[^ \n]*|[^ \n]+|\n")
_MARK = MARK.encode()


@dataclass
class Pieces:
    score: dict[str, tuple[float, int]]  # piece -> score and id; marks are spaces here
    bytes_of: list[bytes]  # id -> what it decodes to
    byte_id: list[int]
    unknown: float
    longest: int
    prefix: bool  # a mark goes before a text

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        score: dict[str, tuple[float, int]] = {}
        bytes_of, byte_id = [], [-1] * 256
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                byte_id[b] = i
                bytes_of.append(bytes([b]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                bytes_of.append(b"")
            else:
                text = piece.replace(MARK, " ")
                if " " in text.lstrip(" ") or "\n" in text:
                    raise ValueError(f"piece {piece!r} crosses words")
                score[text] = (sp.get_score(i), i)
                bytes_of.append(text.encode())
        if min(byte_id) < 0:
            raise ValueError("the vocabulary has no byte pieces")
        return cls(score, bytes_of, byte_id, min(s for s, _ in score.values()) - UNKNOWN_COST, max(map(len, score)), True)


def marked_words(text: bytes) -> list[bytes]:
    """Words of a text in order, each with the spaces before it; together they are the text after a space."""
    if not text:
        return []
    return _WORD.findall(b" " + text.replace(_MARK, b" "))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
