"""Removal of repeated 50-byte strings by a common-prefix-aware distributed merge sort of suffixes.

Sorting every suffix would move each byte of the corpus fifty times. Only suffixes at anchors are sorted: an anchor is
a position whose ANCHOR-byte string has the smallest hash of some run of neighbours, so that each string of LENGTH
bytes contains one, and equal strings contain it at the same place. A string of LENGTH bytes is then an anchor's
suffix, cut at some length, together with the bytes in front of it that make up the rest.

Rows of documents are dealt to runs by doc_id, and each run's texts go through three passes over one exchange:

1. Each run sends its anchors' hashes, sorted and delta-coded, to the hash ranges; a range answers with one bit for
   each: does another run, or another text of this run, have it too? This is the duplicate filter of prefix-doubling
   string sorts; a wrong yes costs time only.
2. Each run sorts its marked suffixes and sends them front-coded, each as the length of the prefix it shares with the
   one before and the bytes after that. A range merges the runs with a loser tree that compares two suffixes only from
   the prefix they are known to share. The common-prefix lengths of the merged order, and those of the strings in front
   of the anchors, name all strings of LENGTH bytes, and the smallest doc_id of each is set against the suffix's own.
3. Each run gets LENGTH - ANCHOR + 1 bits for each of its suffixes and cuts the bytes out of its texts.

A hot anchor, such as those at the ends of a line that very many texts share, may have a different suffix in each of
them, and all would meet in one range. The strings of LENGTH bytes around hot anchors are therefore sent one by one,
each as a suffix of its own that goes to the range of its own hash, so that only equal ones meet.

Copies of a whole text are told apart first, by digest: the smallest doc_id stands for them, and the others lose
every byte. Within a run, equal suffixes are sent once, with their smallest doc_id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.session import broadcast_if_small, checkpoint

LENGTH = 50
ANCHOR = 20
#: Characters of text in a run, on average, and for each hash range. Each run sends a message to each range, so both
#: should grow with the square root of a corpus of many terabytes, as far as memory allows.
RUN_CHARS = 6_000_000
RANGE_CHARS = 4_000_000
HASH_BITS = 56
#: An anchor that stands in so many texts of one run is hot, in all runs.
HOT_TEXTS = 32
TOP = np.uint64(2**64 - 1)


def loser_tree_merge(runs: list[tuple[list[int], list[bytes]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs of byte strings. A run is (lcp with the string before, strings).

    Returns, in sorted order, each string's run, its index there, and its common prefix with the string before. The
    tree holds at each inner node the loser of that node's match, with the prefix it shares with the winner; two
    candidates of different such lengths are ordered by them, and equal ones are compared from there on only.
    """
    width = 1
    while width < len(runs):
        width *= 2
    heads: list[bytes | None] = [None] * width
    lcps, place, ends = [0] * width, [0] * width, [0] * width
    for i, (_, strings) in enumerate(runs):
        ends[i] = len(strings)
        heads[i] = strings[0] if strings else None
    losers, out_run, out_index, out_lcp = [0] * width, [], [], []

    def match(a: int, b: int) -> int:
        """The winner; the loser's lcps entry becomes its common prefix with the winner."""
        x, y = heads[a], heads[b]
        if x is None:
            return b
        if y is None:
            return a
        m, n = lcps[a], lcps[b]
        if m != n:
            return a if m > n else b
        most = min(len(x), len(y))
        while m < most and x[m] == y[m]:
            m += 1
        if m < len(y) and (m == len(x) or x[m] < y[m]) or (m == len(x) == len(y) and a < b):
            lcps[b] = m
            return a
        lcps[a] = m
        return b

    def build(node: int) -> int:
        if node >= width:
            return node - width
        a, b = build(2 * node), build(2 * node + 1)
        winner = match(a, b)
        losers[node] = b if winner == a else a
        return winner

    winner = build(1)
    while heads[winner] is not None:
        index = place[winner]
        out_run.append(winner)
        out_index.append(index)
        out_lcp.append(lcps[winner])
        index += 1
        place[winner] = index
        if index < ends[winner]:
            heads[winner], lcps[winner] = runs[winner][1][index], runs[winner][0][index]
        else:
            heads[winner] = None
        node = (winner + width) >> 1
        while node:
            other = losers[node]
            # the same match as above, written out: most nodes are settled by the lengths alone
            y = heads[other]
            if y is not None:
                x = heads[winner]
                if x is None:
                    losers[node], winner = winner, other
                else:
                    m, n = lcps[winner], lcps[other]
                    if m < n:
                        losers[node], winner = winner, other
                    elif m == n and match(winner, other) == other:
                        losers[node], winner = winner, other
            node >>= 1
    return out_run, out_index, out_lcp


def front_code(strings: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, bytes]:
    """lcp with the row before, and the remaining bytes, of sorted rows of a zero-padded byte matrix."""
    lcp = common_prefixes(strings, lengths)
    columns = np.arange(strings.shape[1])
    rest = (columns >= lcp[:, None]) & (columns < lengths[:, None])
    return lcp, strings[rest].tobytes()


def common_prefixes(strings: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before; 0 for the first."""
    lcp = np.zeros(len(strings), np.int64)
    if len(strings) > 1:
        differ = strings[1:] != strings[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
        lcp[1:] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    return lcp


def sort_order(*keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Order of rows by zero-padded byte matrices and their lengths, the first key first."""
    columns = []
    for matrix, lengths in keys:
        padded = np.zeros((len(matrix), -(-matrix.shape[1] // 8) * 8), np.uint8)
        padded[:, : matrix.shape[1]] = matrix
        words = padded.view(">u8").astype(np.uint64)
        columns += [words[:, i] for i in range(words.shape[1])] + [lengths]
    return np.lexsort(columns[::-1])


def anchors(text: np.ndarray, starts: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of texts laid end to end; starts has where each begins, and the end of all.

    Every string of `length` bytes inside one text holds at least one of its anchors' k-byte strings.
    """
    n, w = len(text), length - k + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # hashes of k bytes by doubling: a string's hash is that of its first part times a power of the base plus the rest
    base = 0x9E3779B97F4A7C15
    parts, h, size = [], text.astype(np.uint64) + np.uint64(1), 1
    while True:
        if k & size:
            parts.append((size, h))
        if 2 * size > k:
            break
        h = h[:-size] * np.uint64(pow(base, size, 2**64)) + h[size:]
        size *= 2
    at, total = 0, np.zeros(n - k + 1, np.uint64)
    for size, part in parts:
        total = total * np.uint64(pow(base, size, 2**64)) + part[at : at + n - k + 1]
        at += size
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    np.clip(total, 1, TOP - np.uint64(1), out=total)
    # strings across two texts never win, and runs of neighbours across two texts choose nothing
    ends = starts[1:]
    across = np.zeros(n + 1, np.int64)
    np.add.at(across, np.maximum(ends - k + 1, starts[:-1]), 1)
    np.add.at(across, ends, -1)
    total[np.cumsum(across)[: len(total)] > 0] = TOP
    low, size = total, 1
    while 2 * size <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    count = n - length + 1
    low = np.minimum(low[:count], low[w - size : w - size + count])
    across = np.zeros(n + 1, np.int64)
    np.add.at(across, np.maximum(ends - length + 1, starts[:-1]), 1)
    np.add.at(across, ends, -1)
    low[np.cumsum(across)[:count] > 0] = 0
    # a position is an anchor if some run of neighbours that holds it has it as smallest
    high = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    size = 1
    while 2 * size <= w:
        high = np.maximum(high[:-size], high[size:])
        size *= 2
    high = np.maximum(high[: len(total)], high[w - size : w - size + len(total)])
    found = np.flatnonzero(high == total)
    return found, total[found]


class Run:
    """The texts of a run that stand for themselves, in order of doc_id, in slices with their anchors."""

    def __init__(self, frame: pd.DataFrame, slice_bytes: int = 1 << 20):
        frame = frame.sort_values(["doc_id", "text"], kind="stable")
        self.ids = frame["doc_id"].tolist()
        self.texts = [t.encode() for t in frame["text"].tolist()]
        self.copy = frame["is_copy"].tolist()
        self.slice_bytes = slice_bytes

    def slices(self) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, bytes, starts, anchor positions, anchor hashes) of slices of about slice_bytes, one text at least."""
        rows, size = [], 0
        for i, text in enumerate(self.texts):
            if not self.copy[i] and len(text) >= LENGTH:
                rows.append(i)
                size += len(text)
                if size >= self.slice_bytes:
                    yield self._slice(rows)
                    rows, size = [], 0
        if rows:
            yield self._slice(rows)

    def _slice(self, rows: list[int]):
        raw = np.frombuffer(b"".join(self.texts[i] for i in rows), np.uint8)
        starts = np.cumsum([0, *(len(self.texts[i]) for i in rows)])
        found, hashes = anchors(raw, starts)
        # anchors have small hashes, as the smallest of many; mixed anew, they spread evenly over the ranges
        hashes *= np.uint64(0x94D049BB133111EB)
        hashes ^= hashes >> np.uint64(31)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        return list(rows), raw, starts, found, hashes >> np.uint64(64 - HASH_BITS)

    def hashes(self, hot_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The run's distinct hashes, sorted, and whether several, and whether hot_texts of its texts have them."""
        pairs = []
        for rows, _, starts, found, hashes in self.slices():
            owner = np.array(rows)[np.searchsorted(starts, found, "right") - 1]
            pairs.append(np.unique(np.stack([hashes, owner.astype(np.uint64)], axis=1), axis=0))
        if not pairs:
            return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool)
        distinct, times = np.unique(np.concatenate([p[:, 0] for p in pairs]), return_counts=True)
        return distinct, times > 1, times >= hot_texts


def _pack_hashes(hashes: np.ndarray, several: np.ndarray, hot: np.ndarray) -> bytes:
    deltas = np.diff(hashes, prepend=np.uint64(0)).astype(np.uint64)
    # byte planes: the high ones are nearly empty
    planes = np.ascontiguousarray(deltas.view(np.uint8).reshape(-1, 8).T).tobytes()
    return zstandard.compress(planes + np.packbits(np.concatenate([several, hot])).tobytes(), 1)


def _unpack_hashes(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    deltas = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    flags = np.unpackbits(raw[8 * n :], count=2 * n).astype(bool)
    return np.cumsum(deltas, dtype=np.uint64), flags[:n], flags[n:]


def _ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of each hash range in sorted hashes."""
    edges = np.array([(i << HASH_BITS) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


class Suffixes:
    """The marked anchors of a run: their suffixes and the reversed strings in front of them, sorted, equal ones once."""

    def __init__(self, run: Run, marked: np.ndarray, hot: np.ndarray):
        ahead = LENGTH - ANCHOR
        rights, lefts, right_n, left_n, docs, hashes, rows, places = ([] for _ in range(8))
        for which, raw, starts, found, found_hashes in run.slices():
            at = np.searchsorted(marked, found_hashes)
            hit = (at < len(marked)) & (marked[np.minimum(at, max(len(marked) - 1, 0))] == found_hashes) if len(marked) else np.zeros(len(found), bool)
            found, found_hashes, at = found[hit], found_hashes[hit], at[hit]
            is_hot = hot[at] if len(at) else np.zeros(0, bool)
            self._add_windows(found[is_hot], which, raw, starts, rights, lefts, right_n, left_n, hashes, rows, places)
            found, found_hashes = found[~is_hot], found_hashes[~is_hot]
            owner = np.searchsorted(starts, found, "right") - 1
            n_right = np.minimum(starts[owner + 1] - found, LENGTH)
            n_left = np.minimum(found - starts[owner], ahead)
            padded = np.concatenate([np.zeros(ahead, np.uint8), raw, np.zeros(LENGTH, np.uint8)])
            windows = np.lib.stride_tricks.sliding_window_view(padded, LENGTH + ahead)[found]
            right, left = windows[:, ahead:].copy(), windows[:, :ahead][:, ::-1].copy()
            right[np.arange(LENGTH) >= n_right[:, None]] = 0
            left[np.arange(ahead) >= n_left[:, None]] = 0
            rows.append(np.array(which)[owner])
            places.append(found - starts[owner])
            for target, value in ((rights, right), (lefts, left), (right_n, n_right), (left_n, n_left), (hashes, found_hashes)):
                target.append(value)
        join = lambda parts, kind, *shape: np.concatenate(parts) if parts else np.zeros((0, *shape), kind)
        right, left = join(rights, np.uint8, LENGTH), join(lefts, np.uint8, ahead)
        right_n, left_n, hashes = join(right_n, np.int64), join(left_n, np.int64), join(hashes, np.uint64)
        rows, places = join(rows, np.int64), join(places, np.int64)
        docs = np.array(run.ids, np.int64)[rows] if len(rows) else np.zeros(0, np.int64)
        order = np.lexsort((docs,)) if not len(docs) else sort_order((right, right_n), (left, left_n))
        right, left, right_n, left_n = right[order], left[order], right_n[order], left_n[order]
        new = np.ones(len(order), bool)
        if len(order) > 1:
            new[1:] = (right[1:] != right[:-1]).any(axis=1) | (left[1:] != left[:-1]).any(axis=1) | (right_n[1:] != right_n[:-1]) | (left_n[1:] != left_n[:-1])
        first = np.flatnonzero(new)
        self.right, self.left, self.right_n, self.left_n = right[first], left[first], right_n[first], left_n[first]
        self.hashes = hashes[order][first]
        self.docs = np.minimum.reduceat(docs[order], first) if len(first) else docs
        # for each anchor of the run: its row, its place in the text, and its string's number
        self.rows, self.places, self.number = rows[order], places[order], np.cumsum(new) - 1

    @staticmethod
    def _add_windows(found, which, raw, starts, rights, lefts, right_n, left_n, hashes, rows, places) -> None:
        """Add each string of LENGTH bytes that holds one of the anchors `found`, as a suffix with nothing in front."""
        ahead = LENGTH - ANCHOR
        begin = np.unique((found[:, None] - np.arange(ahead + 1)).ravel())
        begin = begin[(begin >= 0) & (begin + LENGTH <= len(raw))]
        owner = np.searchsorted(starts, begin, "right") - 1
        inside = begin + LENGTH <= starts[owner + 1]
        begin, owner = begin[inside], owner[inside]
        if not len(begin):
            return
        right = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)[begin].copy()
        padded = np.zeros((len(right), 56), np.uint8)
        padded[:, :LENGTH] = right
        own = np.zeros(len(right), np.uint64)
        for word in np.ascontiguousarray(padded).view("<u8").astype(np.uint64).T:
            own = (own ^ word) * np.uint64(0x9E3779B97F4A7C15)
            own ^= own >> np.uint64(29)
        for target, value in (
            (rights, right), (lefts, np.zeros((len(right), ahead), np.uint8)), (right_n, np.full(len(right), LENGTH)), (left_n, np.zeros(len(right), np.int64)),
            (hashes, own >> np.uint64(64 - HASH_BITS)), (rows, np.array(which)[owner]), (places, begin - starts[owner]),
        ):
            target.append(value)

    def parts(self, parts: int) -> np.ndarray:
        """The hash range of each string."""
        edges = np.array([(i << HASH_BITS) // parts for i in range(1, parts)], np.uint64)
        return np.searchsorted(edges, self.hashes, "right")


def _pack_suffixes(s: Suffixes, which: np.ndarray) -> bytes:
    lcp, rest = front_code(s.right[which], s.right_n[which])
    left_n = s.left_n[which]
    left = s.left[which][np.arange(s.left.shape[1]) < left_n[:, None]].tobytes()
    head = np.stack([lcp, s.right_n[which], left_n]).astype(np.uint8).tobytes()
    return zstandard.compress(head + s.docs[which].astype("<i8").tobytes() + rest + left, 1)


def _unpack_suffixes(blob: bytes, n: int):
    """(lcps, strings, lefts as a matrix, their lengths, docs)."""
    raw, ahead = zstandard.decompress(blob), LENGTH - ANCHOR
    head = np.frombuffer(raw, np.uint8, 3 * n).reshape(3, n).astype(np.int64)
    docs = np.frombuffer(raw, "<i8", n, 3 * n)
    at, last, strings, lcps, sizes = 11 * n, b"", [], head[0].tolist(), head[1].tolist()
    for lcp, size in zip(lcps, sizes, strict=True):
        last = last[:lcp] + raw[at : at + size - lcp]
        at += size - lcp
        strings.append(last)
    left = np.zeros((n, ahead), np.uint8)
    left[np.arange(ahead) < head[2][:, None]] = np.frombuffer(raw, np.uint8, int(head[2].sum()), at)
    return lcps, strings, left, head[1], head[2], docs


def smaller_elsewhere(lcp: np.ndarray, right_n: np.ndarray, left: np.ndarray, left_n: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For rows in merged order, bit t of each: a smaller doc has the string of LENGTH bytes that begins t bytes before the anchor."""
    n, bits = len(docs), np.zeros(len(docs), np.uint64)
    if not n:
        return bits
    order = sort_order((left, left_n))
    left_lcp, left_class = common_prefixes(left[order], left_n[order]), np.zeros(n, np.int64)
    for t in range(LENGTH - ANCHOR + 1):
        rows = np.flatnonzero((left_n >= t) & (right_n >= LENGTH - t))
        if len(rows) < 2:
            continue
        right_class = np.cumsum(lcp < LENGTH - t)
        left_class[order] = np.cumsum(left_lcp < t)
        key = right_class[rows] * (n + 1) + left_class[rows]
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
        least = np.repeat(np.minimum.reduceat(docs[rows[by]], first), np.diff(np.r_[first, len(by)]))
        hit = rows[by[least < docs[rows[by]]]]
        bits[hit] |= np.uint64(1) << np.uint64(t)
    return bits


def _runs(docs: DataFrame, count: int) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return docs.select(F.pmod(F.xxhash64(key), F.lit(count)).cast("int").alias("run"), key.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def cut(docs: DataFrame, run_chars: int = RUN_CHARS, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row: what is left after removing each byte
    covered by a string of LENGTH bytes that also starts in a document with a smaller doc_id.

    Texts are UTF-8 bytes; a null text is empty. kept is binary, as cuts may fall inside a character. A null doc_id
    counts as the smallest. Rows that repeat a doc_id are one document for the comparison, so they remove nothing from
    each other, and each has a result. Only doc_id and text are read. An empty table gives an empty result.
    """
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, math.ceil(size / run_chars))
    parts = max(1, math.ceil(size / min(RANGE_CHARS, run_chars)))
    rows = _runs(docs, count)
    # all texts but the smallest doc_id of equal ones; equal doc_ids keep theirs
    copies = rows.where(F.octet_length("text") >= LENGTH).select("run", "doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))
    first = copies.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = copies.join(broadcast_if_small(checkpoint(first)), "sha").where("doc_id <> first").select("run", "doc_id", "sha").distinct()
    copies = checkpoint(copies)
    by_run = rows.groupBy("run")

    def make(frame: pd.DataFrame, marks: pd.DataFrame) -> Run:
        # a repeated doc_id may be a copy in one of its texts only, so a digest decides
        known = set(zip(marks["doc_id"], marks["sha"], strict=True))
        ids = {d for d, _ in known}
        is_copy = [d in ids and (d, hashlib.sha256(t.encode()).hexdigest()) in known for d, t in zip(frame["doc_id"], frame["text"], strict=True)]
        return Run(frame.assign(is_copy=is_copy))

    def send_hashes(frame: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        hashes, several, hot = make(frame, marks).hashes(hot_texts)
        bounds = _ranges(hashes, parts)
        out = [(p, a, b) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        number = int(frame["run"].iloc[0]) if len(frame) else 0
        return pd.DataFrame({
            "part": [p for p, _, _ in out], "run": number, "n": [b - a for _, a, b in out],
            "blob": [_pack_hashes(hashes[a:b], several[a:b], hot[a:b]) for _, a, b in out],
        }).astype({"part": "int32", "run": "int32", "n": "int64"})

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("run")
        got = [_unpack_hashes(b, n) for b, n in zip(frame["blob"], frame["n"], strict=True)]
        every = np.concatenate([h for h, _, _ in got])
        distinct, inverse, times = np.unique(every, return_inverse=True, return_counts=True)
        shared = times > 1
        shared[inverse[np.concatenate([s for _, s, _ in got])]] = True
        hot = np.zeros(len(distinct), bool)
        hot[inverse[np.concatenate([h for _, _, h in got])]] = True
        blobs, at = [], 0
        for hashes, _, _ in got:
            mine = inverse[at : at + len(hashes)]
            yes, which = hashes[shared[mine]], mine[shared[mine]]
            at += len(hashes)
            blobs.append((len(yes), _pack_hashes(yes, shared[which], hot[which])))
        return pd.DataFrame({"run": frame["run"].to_numpy(), "part": frame["part"].to_numpy(), "n": [n for n, _ in blobs], "blob": [b for _, b in blobs]})

    def told(marks: pd.DataFrame, kind: int) -> pd.DataFrame:
        return marks[marks["kind"] == kind]

    def suffixes(frame: pd.DataFrame, marks: pd.DataFrame) -> tuple[Run, Suffixes]:
        run = make(frame, told(marks, 0))
        hashes = told(marks, 1).sort_values("part")
        got = [_unpack_hashes(b, n) for b, n in zip(hashes["blob"], hashes["n"], strict=True)]
        marked, hot = (np.concatenate([np.zeros(0, kind), *(x[i] for x in got)]) for i, kind in ((0, np.uint64), (2, bool)))
        return run, Suffixes(run, marked, hot)

    def send_suffixes(frame: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        _, s = suffixes(frame, marks)
        number = int(frame["run"].iloc[0]) if len(frame) else 0
        owner = s.parts(parts)
        out = [(p, which) for p in np.unique(owner).tolist() for which in [np.flatnonzero(owner == p)]]
        return pd.DataFrame({
            "part": [p for p, _ in out], "run": number, "n": [len(w) for _, w in out], "blob": [_pack_suffixes(s, w) for _, w in out],
        }).astype({"part": "int32", "run": "int32", "n": "int64"})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("run")
        got = [_unpack_suffixes(b, n) for b, n in zip(frame["blob"], frame["n"], strict=True)]
        which, index, lcp = (np.array(x, np.int64) for x in loser_tree_merge([(g[0], g[1]) for g in got]))
        offsets = np.cumsum([0, *(len(g[5]) for g in got)])
        at = offsets[which] + index
        left, right_n, left_n, docs = (np.concatenate([g[i] for g in got])[at] for i in (2, 3, 4, 5))
        bits = np.zeros(len(at), np.uint64)
        bits[at] = smaller_elsewhere(lcp, right_n, left, left_n, docs)
        blobs = [zstandard.compress(bits[a:b].astype("<u4").tobytes(), 1) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return pd.DataFrame({"run": frame["run"].to_numpy(), "part": frame["part"].to_numpy(), "n": frame["n"].to_numpy(), "blob": blobs})

    def sizes_of(run: Run, rows: np.ndarray) -> np.ndarray:
        return np.fromiter(map(len, run.texts), np.int64, len(run.texts))[rows]

    def finish(frame: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        run, s = suffixes(frame, marks)
        owner, bits = s.parts(parts), np.zeros(len(s.docs), np.uint32)
        for _, r in told(marks, 2).iterrows():
            bits[owner == r["part"]] = np.frombuffer(zstandard.decompress(r["blob"]), "<u4")
        marks_of = bits[s.number] if len(s.number) else bits
        ids = np.array(run.ids, np.int64)
        if len(s.number):
            # where several texts of the run have a string, all but the smallest doc lose it
            later = ids[s.rows] > s.docs[s.number]
            every = (np.uint64(2) << s.left_n.astype(np.uint64)) - np.uint64(1)
            marks_of = np.where(later, every.astype(np.uint32)[s.number], marks_of)
        # where a removed string begins, over the run's texts end to end; each lies inside its text
        ends = np.cumsum([0, *map(len, run.texts)])
        begins = np.zeros(int(ends[-1]) + 1, bool)
        hit = marks_of > 0
        at, place, mark = ends[s.rows[hit]], s.places[hit], marks_of[hit]
        for t in range(LENGTH - ANCHOR + 1) if len(at) else ():
            here = (mark >> np.uint32(t) & 1) == 1
            # a string that is equal in a smaller document of the run may be cut short here
            here &= (place >= t) & (place - t + LENGTH <= sizes_of(run, s.rows[hit]))
            begins[(at + place - t)[here]] = True
        count = np.cumsum(begins[:-1], dtype=np.int32)
        cover = count > 0
        cover[LENGTH:] = count[LENGTH:] > count[:-LENGTH]
        del count
        out = []
        for i, raw in enumerate(run.texts):
            mine = cover[ends[i] : ends[i + 1]]
            if run.copy[i] and len(raw) >= LENGTH:
                kept, spans = b"", 1
            elif mine.any():
                spans = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum())
                kept = np.frombuffer(raw, np.uint8)[~mine].tobytes()
            else:
                kept, spans = raw, 0
            out.append((run.ids[i], len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    sent = "part int, run int, n long, blob binary"
    told_back = "run int, part int, n long, blob binary"
    copy_marks = copies.select("run", F.lit(0).alias("kind"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"), F.lit(b"").alias("blob"), "doc_id", "sha")
    as_marks = lambda df, kind: df.select("run", F.lit(kind).alias("kind"), "part", "n", "blob", F.lit(0).cast("long").alias("doc_id"), F.lit("").alias("sha"))
    hashes = by_run.cogroup(copies.groupBy("run")).applyInPandas(send_hashes, sent)
    shared = checkpoint(hashes.groupBy("part").applyInPandas(answer, told_back))
    marks = copy_marks.unionByName(as_marks(shared, 1))
    pieces = by_run.cogroup(marks.groupBy("run")).applyInPandas(send_suffixes, sent)
    merged = checkpoint(pieces.groupBy("part").applyInPandas(merge, told_back))
    marks = marks.unionByName(as_marks(merged, 2))
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = by_run.cogroup(marks.groupBy("run")).applyInPandas(finish, result)
    back = F.when(F.col("doc_id") == -(2**63), None).otherwise(F.col("doc_id")).cast(docs.schema["doc_id"].dataType)
    return out.withColumn("doc_id", back)


def query(docs: DataFrame, run_chars: int = RUN_CHARS, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """The report without the bytes."""
    return cut(docs, run_chars, hot_texts).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
