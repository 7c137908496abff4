"""A byte-fallback piece vocabulary (the sentencepiece library's BPE models), encoded by the same heap of merge ranks.

A space becomes U+2581 and one more stands before every text that isn't empty. Where no piece of the
vocabulary has U+2581 after another character, no merge can cross such a place, and a text is cut there
into units that are encoded on their own. A pair of neighbouring symbols merges if the two strings
together are a piece, pieces of higher score first; what is left of characters without a piece becomes bytes.
"""

from __future__ import annotations

import re
from itertools import chain

from slatewise.llm.bpe import REMEMBERED, REMEMBERED_LENGTH, Bpe

#: Fixed value: the character that stands for a space in pieces.
SPACE = "▁"
UNKNOWN = (1 << 20) - 1


class _Characters(dict):
    def __missing__(self, character: str) -> int:
        return UNKNOWN


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of each id of a model file; kind 0: can come from a text, 1: a byte, 2: neither. On the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: 1 if model.is_byte(i) else 2 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else 0
    pieces = [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.vocab_size())]
    probe = "Aé ﬁ　 x\t 12\r\n\U0001f642  end "
    coder = PieceBpe(pieces)
    if coder.encode(probe) != model.encode(probe) or len(coder.cut("a b")) < 2:
        raise ValueError(f"{path}: not a BPE model with byte fallback, a space before each text, texts as they are and no merges across words")
    return pieces


class PieceBpe(Bpe):
    """Encoder of one piece vocabulary. merge() is that of Bpe; its symbols are characters here, not bytes."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        usable = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 0}
        if sum(kind == 1 for _, _, kind in pieces) != 256:
            raise ValueError("every byte needs a piece")
        self.n_pieces = len(pieces)
        ids = dict(usable)
        for p in usable:
            for c in p:  # a character that is in pieces but none itself can merge and never stays
                ids.setdefault(c, len(pieces) + len(ids))
        self.first = _Characters((s, i) for s, i in ids.items() if len(s) == 1)
        rank_of_score = {score: rank for rank, score in enumerate(sorted({pieces[i][1] for i in usable.values()}, reverse=True))}
        ranks, self.made_of = {}, {}
        for p, i in usable.items():
            for cut in range(1, len(p)):
                left, right = ids.get(p[:cut]), ids.get(p[cut:])
                if left is not None and right is not None:
                    ranks[left << 20 | right] = rank_of_score[pieces[i][1]]
                    self.made_of[left << 20 | right] = i
        self.rank_of = ranks.get
        self.length = [len(p) for p, _, _ in pieces]
        self.byte_ids = [0] * 256
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 1:
                self.byte_ids[int(p[3:5], 16)] = i
        self.string = [bytes([int(p[3:5], 16)]) if kind == 1 else p.replace(SPACE, " ").encode() for p, _, kind in pieces]
        crossed = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in usable)
        self.units = re.compile("(?s).+" if crossed else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.vocabulary = usable
        self.known: dict[str, tuple[int, ...]] = {}

    def _ids(self, piece: str) -> tuple[int, ...]:
        ids = self.merge(piece)
        if max(ids) >= self.n_pieces:
            at, whole = 0, []
            for i in ids:
                if i < self.n_pieces:
                    whole.append(i)
                    at += self.length[i]
                else:
                    whole += map(self.byte_ids.__getitem__, piece[at].encode("utf-8", "replace"))
                    at += 1
            ids = whole
        ids = tuple(ids)
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def cut(self, text: str) -> list[str]:
        return self.units((" " + text).replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.known.get(u) or self._ids(u) for u in self.cut(text)))


def public_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
