"""A unigram vocabulary with scores, read from a SentencePiece model file, and how it sees a text.

A text is a space mark (U+2581) and the text with each space as such a mark; every mark begins a chunk. No piece has a mark inside
(pieces of several marks, which such files score far below any others, are left out; the mark alone has the lowest score of the others if it is scored so), so chunks are independent and each is cut by
itself, in exact arithmetic. A character that is no piece of its own may stand alone at `unknown` (10 below the lowest score) and is
written as one byte piece for each of its UTF-8 bytes.
"""

from __future__ import annotations

import functools

MARK = "▁"
#: Scores at or under this mark pieces that are never to be chosen.
NEVER = -1e6


class Lexicon:
    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int]):
        """pieces: piece to id and score; byte_ids: the ids of the 256 byte pieces."""
        if any(MARK in p[1:] for p in pieces):
            raise ValueError("a piece has a space mark inside")
        self.pieces, self.byte_ids = pieces, byte_ids
        self.unknown = min((s for _, s in pieces.values()), default=0.0) - 10
        self.longest = max(map(len, pieces), default=1)

    def raw_bytes(self) -> dict[int, bytes]:
        """What each id stands for."""
        return {i: p.replace(MARK, " ").encode() for p, (i, _) in self.pieces.items()} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}


@functools.lru_cache(maxsize=2)
def load(path: str) -> Lexicon:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and model.get_score(i) > NEVER]
    pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in plain}
    lowest = min(s for _, s in pieces.values())
    return Lexicon({MARK: (model.piece_to_id(MARK), lowest)} | pieces, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


def chunks(text: str) -> list[str]:
    """What follows each space mark; together with the marks they are the text. The empty text has none."""
    return text.replace(MARK, " ").split(" ") if text else []
