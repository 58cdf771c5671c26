"""Token counts by rank-synchronous merging of ragged arrays.

Distinct marked words of a piece of text are cut where no vocabulary piece joins two characters, which no merge can
cross, and the parts are laid end to end in one symbol array. In each round every part finds its own lowest rank and
merges all its pairs of that rank at once; parts without a pair leave. What survives is counted, a character outside
the vocabulary with one token for each of its bytes.

Merging all pairs of the lowest rank at once gives what merging them one by one from the left gives, unless a merge
makes a new pair of no higher rank, which would come next; then the part's pairs behind that merge wait for the next
round. Words of any length go the same way; a part's rounds are at most the distinct ranks in it.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.llm.pieces import default_model, pieces_of, vocabulary
from arborlake.llm.texts import map_texts

LIMIT = 4096
NEVER = np.int64(2**31)
#: Symbols that are merged together, one word at least.
BATCH = 2_000_000
#: Words whose count is remembered between slices of one task.
REMEMBERED = 500_000


class Merger:
    """Counts tokens of marked words under one vocabulary."""

    def __init__(self, path: str):
        vocab = vocabulary(path)
        self.symbols = {piece: i for i, piece in enumerate(vocab.ids)}
        order = {score: rank for rank, score in enumerate(sorted(set(vocab.scores.values()), reverse=True))}
        pairs = [
            (self.symbols[piece[:cut]] * len(self.symbols) + self.symbols[piece[cut:]], order[vocab.scores[piece]], made)
            for piece, made in self.symbols.items()
            for cut in range(1, len(piece))
            if piece[:cut] in self.symbols and piece[cut:] in self.symbols
        ]
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.ranks = np.array([p[1] for p in pairs], np.int64)
        self.made = np.array([p[2] for p in pairs], np.int64)
        # pairs of characters that stand side by side in some piece; all others are borders
        inside = {self.symbols.get(x, -1) * len(self.symbols) + self.symbols.get(y, -1) for piece in self.symbols for x, y in zip(piece, piece[1:], strict=False)}
        self.inside = np.array(sorted(inside), np.int64)
        self.known: dict[str, int] = {}

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index in the pair table and rank of each pair; rank NEVER if it is none."""
        key = left * len(self.symbols) + right
        if not len(self.keys):
            return np.zeros(len(key), np.int64), np.full(len(key), NEVER)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NEVER)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether some piece has these two characters side by side."""
        if not len(self.inside):
            return np.zeros(len(left), bool)
        key = left * len(self.symbols) + right
        at = np.minimum(np.searchsorted(self.inside, key), len(self.inside) - 1)
        return (self.inside[at] == key) & (left >= 0) & (right >= 0)

    def merge(self, words: list[str]) -> np.ndarray:
        """Token count of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.fromiter((self.symbols.get(c, -1) for c in chain.from_iterable(words)), np.int64, int(lengths.sum()))
        word = np.repeat(np.arange(len(words)), lengths)
        counts = lengths.copy()
        # a character outside the vocabulary counts its bytes, and no pair has it
        if (ids < 0).any():
            odd, text = np.flatnonzero(ids < 0), "".join(words)
            np.add.at(counts, word[odd], np.fromiter((len(text[i].encode()) - 1 for i in odd.tolist()), np.int64, len(odd)))
        if len(ids) < 2:
            return counts
        border = np.r_[True, (word[1:] != word[:-1]) | ~self.joined(ids[:-1], ids[1:])]
        part = np.cumsum(border) - 1
        # parts of one symbol are done
        several = np.repeat(np.diff(np.r_[np.flatnonzero(border), len(ids)]) > 1, np.diff(np.r_[np.flatnonzero(border), len(ids)]))
        ids, word, part = ids[several], word[several], part[several]
        rank = np.full(len(ids), NEVER)
        if len(ids):
            rank[:-1] = np.where(part[:-1] == part[1:], self.find(ids[:-1], ids[1:])[1], NEVER)
        while len(ids):
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            size = np.diff(np.r_[first, len(ids)])
            low = np.minimum.reduceat(rank, first)
            if not (low < NEVER).all():
                # parts without a pair are done
                keep = np.repeat(low < NEVER, size)
                ids, word, part, rank = ids[keep], word[keep], part[keep], rank[keep]
                size, low = size[low < NEVER], low[low < NEVER]
                if not len(ids):
                    break
            low = np.repeat(low, size)
            at = np.flatnonzero(rank == low)
            # of pairs that overlap, every other one from the left
            start = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
            at = at[(at - np.repeat(at[start], np.diff(np.r_[start, len(at)]))) % 2 == 0]
            made = self.made[self.find(ids[at], ids[at + 1])[0]]
            # the symbols beside each new one: on the left after this round's merges, on the right before them
            after_merge = np.r_[False, at[1:] == at[:-1] + 2]
            has_left, has_right = np.r_[part[at] == part[at - 1]] & (at > 0), np.zeros(len(at), bool)
            inner = at + 2 < len(ids)
            has_right[inner] = part[at[inner] + 2] == part[at[inner]]
            left = np.where(after_merge, np.r_[0, made[:-1]], ids[at - 1])
            left_rank = np.where(has_left, self.find(left, made)[1], NEVER)
            right_rank = np.where(has_right, self.find(made, ids[np.minimum(at + 2, len(ids) - 1)])[1], NEVER)
            early = np.minimum(left_rank, right_rank) <= low[at]
            if early.any():
                # behind the first of them, the part's pairs wait
                ahead = np.cumsum(early) - early
                begin = np.flatnonzero(np.r_[True, part[at][1:] != part[at][:-1]])
                ahead -= np.repeat(ahead[begin], np.diff(np.r_[begin, len(at)]))
                go = ahead == 0
                at, made, left_rank, right_rank, after_merge, has_left = (x[go] for x in (at, made, left_rank, right_rank, after_merge, has_left))
            np.subtract.at(counts, word[at], 1)
            ids[at], rank[at] = made, right_rank
            rank[at[has_left] - np.where(after_merge, 2, 1)[has_left]] = left_rank[has_left]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word, part, rank = ids[keep], word[keep], part[keep], rank[keep]
        return counts

    def count(self, texts: list[str | None]) -> list[int]:
        """Token count of each text. Long texts are counted piece by piece, short ones together."""
        totals, held, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            for words in pieces_of(text):
                held.append((i, words))
                size += sum(map(len, words))
                if size >= BATCH:
                    self._add(held, totals)
                    held, size = [], 0
        self._add(held, totals)
        return totals

    def _add(self, held: list[tuple[int, list[str]]], totals: list[int]) -> None:
        used = set(chain.from_iterable(words for _, words in held))
        new = sorted((w for w in used if w not in self.known), key=len)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {w: n for w, n in self.known.items() if w in used}
        low = 0
        while low < len(new):
            high, symbols = low, 0
            while high < len(new) and (high == low or symbols + len(new[high]) <= BATCH):
                symbols += len(new[high])
                high += 1
            self.known.update(zip(new[low:high], self.merge(new[low:high]).tolist(), strict=True))
            low = high
        for i, words in held:
            totals[i] += sum(map(self.known.__getitem__, words))


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, in one pass without a shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. Special strings inside a text are ordinary text. Repeated rows
    give repeated results, other columns are not read, an empty table gives an empty result. A very long text is
    counted in pieces; memory holds it and the arrays of one piece, or of its longest word if that is longer. The
    model's path must hold the file on every executor.
    """
    path = model or default_model()

    def start():
        merger = Merger(path)

        def step(texts: list[str | None]) -> list[pa.Array]:
            sizes = [len(t.encode()) if t else 0 for t in texts]
            return [pa.array(sizes, pa.int64()), pa.array(merger.count(texts), pa.int64())]

        return step

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return map_texts(docs, ["doc_id"], fields, start).withColumn("over_limit", F.col("n_tokens") > limit)
