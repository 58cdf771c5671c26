"""The public piece vocabulary and the splitting of texts into marked words, shared by encoding and counting."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

MARK = "▁"


def default_model() -> str:
    """Path of the public model file."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by text, the byte pieces, and what each id decodes to."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: tuple[int, ...]
    decoded: tuple[bytes, ...]
    longest: int


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Read a model file. Raises if a piece has a mark after another character or holds a newline: words would not be independent."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, decoded, byte_ids = {}, {}, [], [-1] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value] = i
            decoded.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            decoded.append(b"")
        else:
            if MARK in piece.lstrip(MARK) or "\n" in piece:
                raise ValueError(f"piece {i} joins words")
            ids[piece], scores[piece] = i, model.get_score(i)
            decoded.append(piece.replace(MARK, " ").encode())
    if min(byte_ids) < 0:
        raise ValueError("the vocabulary has no byte fallback")
    return Vocabulary(ids, scores, tuple(byte_ids), tuple(decoded), max(map(len, ids), default=1))


_WORDS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


def pieces_of(text: str | None, size: int = 1_000_000) -> Iterator[list[str]]:
    """marked_words of a text in lists that cover about size characters each, so a long text is never a list of all its words.

    A piece ends in front of a space that follows another character, where a word begins; a word without spaces that
    is longer than size stays in one piece.
    """
    text, low = text or "", 0
    while low < len(text):
        high = low + size
        while high < len(text):
            high = text.find(" ", high)
            if high < 0 or text[high - 1] not in (" ", MARK):
                break
            high += 1
        high = len(text) if high < 0 else min(high, len(text))
        yield _WORDS.findall((MARK if low == 0 else "") + text[low:high].replace(" ", MARK))
        low = high


def marked_words(text: str | None) -> list[str]:
    """The text with a mark in front and for each space, cut before marks and around newlines; empty or null: none."""
    return _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []
