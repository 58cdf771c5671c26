"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut into marked words; the distinct words of a slice of texts are sorted, which lays out their trie in
depth-first order. The forward scores of a word's prefixes stand on a stack: the next word keeps those of the prefix
it shares with the last one and computes only the rest. A character outside the vocabulary costs its byte pieces.

The public vocabulary holds merge ranks and no log-probabilities, so a piece of rank r (0 is the best) is scored with
Zipf's law, log p = -log(r + OFFSET) - log(sum over all ranks). Segmentations are the best under these scores, not
the ones that merging in rank order gives; they use the same ids, and any decoder of the vocabulary reads them.
"""

from __future__ import annotations

import functools
import math
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.llm.pieces import Vocabulary, default_model, pieces_of, vocabulary
from arborlake.llm.texts import free_name, map_texts

OFFSET = 2.7
#: Score of each byte of a character outside the vocabulary.
BYTE_SCORE = -25.0
#: Words of each of two generations whose ids are remembered between slices of one task.
REMEMBERED = 100_000
#: Words whose distinct ones are sorted together, and characters of a slice of texts.
BATCH_WORDS, SLICE_CHARS = 200_000, 1_000_000
_NO_PIECE = object()


@functools.lru_cache(maxsize=4)
def scores(path: str) -> dict[str, float]:
    """Log-probability of each piece; pieces of equal rank score alike."""
    vocab = vocabulary(path)
    ranks = {s: i for i, s in enumerate(sorted(set(vocab.scores.values()), reverse=True))}
    total = math.log(sum(1 / (r + OFFSET) for r in range(len(ranks))))
    return {piece: -math.log(ranks[s] + OFFSET) - total for piece, s in vocab.scores.items()}


@functools.lru_cache(maxsize=4)
def prefixes(path: str) -> dict[str, float | None]:
    """Every prefix of a piece, with the piece's score if it is one itself."""
    found: dict[str, float | None] = {}
    for piece, score in scores(path).items():
        found[piece] = score
        for end in range(1, len(piece)):
            found.setdefault(piece[:end], None)
    return found


class Encoder:
    """Encodes texts under one vocabulary, remembering words: those of a full generation are kept until the next one is full."""

    def __init__(self, path: str):
        self.vocab: Vocabulary = vocabulary(path)
        self.prefixes = prefixes(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def solve(self, words: list[str]) -> None:
        """Ids of distinct words that are not known yet. Of equal scores, the one with the shorter last piece stays."""
        get, ids, byte_ids, known = self.prefixes.get, self.vocab.ids, self.vocab.byte_ids, self.known
        # by length of prefix: its best score, where its last piece begins, and where pieces that go on may begin
        best, back, begins, last = [0.0], [0], [()], ""
        for word in sorted(words):
            depth, most = 0, min(len(word), len(last))
            while depth < most and word[depth] == last[depth]:
                depth += 1
            del best[depth + 1 :], back[depth + 1 :], begins[depth + 1 :]
            open_ = begins[depth]
            for end in range(depth + 1, len(word) + 1):
                top, start, going = -math.inf, -1, []
                for begin in (end - 1, *open_):
                    score = get(word[begin:end], _NO_PIECE)
                    if score is not _NO_PIECE:
                        going.append(begin)
                        if score is not None and best[begin] + score > top:
                            top, start = best[begin] + score, begin
                if word[end - 1] not in ids:
                    unknown = best[end - 1] + BYTE_SCORE * len(word[end - 1].encode())
                    if unknown > top:
                        top, start = unknown, end - 1
                best.append(top)
                back.append(start)
                begins.append(going)
                open_ = going
            found, end = [], len(word)
            while end:
                begin = back[end]
                piece = ids.get(word[begin:end])
                if piece is not None:
                    found.append(piece)
                else:
                    found += [byte_ids[b] for b in reversed(word[begin:end].encode())]
                end = begin
            found.reverse()
            known[word], last = array("i", found).tobytes(), word

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as 32-bit numbers. Long texts are encoded piece by piece, short ones together."""
        out, held, size = [[] for _ in texts], [], 0
        for i, text in enumerate(texts):
            for words in pieces_of(text):
                held.append((i, words))
                size += len(words)
                if size >= BATCH_WORDS:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return [b"".join(parts) for parts in out]

    def _add(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        used = set(chain.from_iterable(words for _, words in held))
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        used.difference_update(self.known)
        again = used & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        self.solve(list(used - again))
        for i, words in held:
            out[i].append(b"".join(map(self.known.__getitem__, words)))


def decode_ids(ids: list[int], table: tuple[bytes, ...]) -> str | None:
    """The text of ids without the space that encoding puts in front; null if its bytes are not UTF-8."""
    try:
        return b"".join(map(table.__getitem__, ids)).removeprefix(b" ").decode()
    except UnicodeDecodeError:
        return None


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: str | None = None, name: str = "ids", check: str | None = None) -> DataFrame:
    """keep and the ids of each whole text, in one pass without a shuffle.

    A null text has null ids, an empty one none. With `check`, a column of that name says whether decoding the ids
    gives exactly the text back, which it does unless the text holds the mark itself, for marks decode to spaces; it
    is true for a null text. A very long text is encoded in pieces, and memory holds it and its ids. Repeated rows
    give repeated results; an empty table gives an empty result. A name that keep has already gets bars in front. The
    model's path must hold the file on every executor.
    """
    path = model or default_model()
    name = free_name(list(keep), name)
    check = check and free_name([*keep, name], check)

    def start():
        encoder = Encoder(path)

        def step(texts: list[str | None]) -> list[pa.Array]:
            found = encoder.encode(texts)
            ids = np.frombuffer(b"".join(found), np.int32)
            bounds = np.cumsum([0, *(len(x) // 4 for x in found)])
            gone = np.array([t is None for t in texts], bool)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids), mask=pa.array(gone))
            if not check:
                return [lists]
            table = encoder.vocab.decoded
            same = [t is None or decode_ids(array("i", x).tolist(), table) == t for t, x in zip(texts, found, strict=True)]
            return [lists, pa.array(same, pa.bool_())]

        return step

    fields = [T.StructField(name, T.ArrayType(T.IntegerType()))] + ([T.StructField(check, T.BooleanType())] if check else [])
    return map_texts(docs, list(keep), fields, start, SLICE_CHARS)


def decode(rows: DataFrame, model: str | None = None, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """rows with the text of their ids in a new column; null for null ids or bytes that are not UTF-8.

    A literal mark in a text comes back as the space it stands for. A name that rows have already gets bars in front.
    """
    path = model or default_model()
    name = free_name(rows.columns, name)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])
    at = rows.columns.index(ids)

    def run(batches):
        table = vocabulary(path).decoded
        for batch in batches:
            out = [None if x is None else decode_ids(x, table) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): every whole text encoded, and whether decoding gives exactly it back."""
    rows = encode(docs, check="round_trip")
    return rows.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "round_trip")
