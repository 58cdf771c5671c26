"""SimHash near-dedup with vantage-point trees.

Fingerprints of 64 bits are linked if they differ in at most `radius` bits. The distance to a vantage point splits a
set of fingerprints in two, and the triangle inequality says which branches can hold something within the radius of a
query: the near side if d <= split + r, the far side if d > split - r. Random fingerprints all lie about 32 bits from
any vantage point, so over whole fingerprints a radius of 4 overlaps almost every boundary. The trees that deal
fingerprints to shards therefore measure the Hamming distance over one block of bits: among BLOCKS blocks, two
fingerprints within the radius have one where they differ in at most radius // BLOCKS bits, so each block has its own
tree and that smaller query radius. A fingerprint lives in one leaf of each tree, and also visits each leaf whose
boundary its query radius overlaps. Inside a shard a second tree over whole fingerprints finds the exact pairs.

The trees are as deep as the number of distinct fingerprints asks for, so shards keep their size as a corpus grows. At
a query radius of 1 the bounds are sharpened: a query keeps track of which of the values within its radius are in a
branch, and visits no branch that holds none, so it visits at most one leaf for each such value (22 in 21 bits).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.llm.components import connected_components
from arborlake.llm.texts import keep_marked, map_texts
from arborlake.session import checkpoint

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCKS = 3
#: Points at which a search inside a shard splits no further.
LEAF = 16
#: Fingerprints that live in a shard, about.
SHARD_POINTS = 4096
#: Bytes of text whose shingles are held at once.
PIECE = 4_000_000
_SPACE = b" \t\n\r\x0b\x0c"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in lower case, in lists that cover about `piece` bytes each."""
    raw, low = text.encode() if text else b"", 0
    while low < len(raw):
        high = min(low + piece, len(raw))
        while high < len(raw) and raw[high] not in _SPACE:
            high += 1
        # bytes.split() splits at exactly the six ASCII white-space characters
        yield raw[low:high].translate(_LOWER).split()
        low = high


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of a text in order; fewer words than a shingle are one, no word gives none."""
    digest, tail, whole = xxhash.xxh64_intdigest, [], True
    for found in words_of(text):
        words = tail + found
        if len(words) < shingle:
            tail = words
            continue
        joined, whole = b" ".join(words), False
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts, stops = np.r_[0, ends[:-shingle]].tolist(), (ends[shingle - 1 :] - 1).tolist()
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))
        tail = words[len(words) - shingle + 1 :]
    if whole and tail:
        yield np.array([digest(b" ".join(tail), SEED)], np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of all hashes; 0 for none."""
    total, counts = 0, np.zeros(64, np.int64)
    for hashes in parts:
        total += len(hashes)
        for low in range(0, len(hashes), 65_536):
            counts += np.unpackbits(hashes[low : low + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 if it has no word."""
    return majority(shingle_hashes(text, shingle))


def _mark() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and fp, the fingerprint as a signed 64-bit number. Null and empty texts have 0."""

    def start():
        def step(texts: list[str | None]) -> list[pa.Array]:
            return [pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))]

        return step

    return map_texts(docs, list(keep), [T.StructField("fp", T.LongType())], start)


class BlockTree:
    """A vantage-point tree over the values of one block of bits, the same on every machine.

    Each level has one vantage point, and its distance splits every node of the level in two, at most `depth` times.
    """

    def __init__(self, low: int, bits: int, radius: int, depth: int):
        self.low, self.mask, self.radius = low, (1 << bits) - 1, radius
        points = np.random.default_rng(1000 * low + bits).permutation(1 << min(bits, 20))[:depth]
        self.points = [int(p) & self.mask for p in points]
        # half of all values lie within this distance of any vantage point
        self.split = (bits - 1) // 2

    def leaves(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (index, leaf, is home) of the leaves that each fingerprint's query ball overlaps; one of them is its home."""
        values = (fps >> np.uint64(self.low)) & np.uint64(self.mask)
        index, leaf, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        # for radius 1: the values of the ball in this branch, a bit for each changed bit and the highest for the value itself
        centre, every = np.uint64(1 << 63), np.uint64((1 << 63) | self.mask)
        ball = np.full(len(fps), every if self.radius == 1 else centre)
        for point in self.points:
            differ = values[index] ^ np.uint64(point)
            distance = np.bitwise_count(differ).astype(np.int64)
            inside = distance <= self.split
            near, far = distance <= self.split + self.radius, distance > self.split - self.radius
            if self.radius == 1:
                # changing a bit that differs comes nearer by one, changing another one goes farther
                here = np.where(distance < self.split, every, np.where(distance == self.split, centre | differ, np.where(distance == self.split + 1, differ, np.uint64(0))))
                inner, outer = ball & here, ball & ~here
                near, far = near & (inner > 0), far & (outer > 0)
                ball = np.concatenate([inner[near], outer[far]])
            index, leaf, home = (np.concatenate(x) for x in ((index[near], index[far]), (leaf[near] * 2, leaf[far] * 2 + 1), ((home & inside)[near], (home & ~inside)[far])))
        return index, leaf, home


def trees(radius: int = RADIUS, blocks: int = BLOCKS, points: int = 0, depth: int | None = None) -> list[BlockTree]:
    """One tree for each block; the blocks cover all 64 bits. points is how many fingerprints there are.

    A level multiplies the leaves that a query visits by less than 2, and that is bounded at radius 0 and 1 only, so
    trees of larger radius stay shallow.
    """
    wanted = max(1, math.ceil(math.log2(max(points, 1) / SHARD_POINTS))) if points else 5
    depth = depth or (min(wanted, 26) if radius // blocks < 2 else min(wanted, 6))
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [BlockTree(a, b - a, radius // blocks, depth) for a, b in zip(edges, edges[1:], strict=False)]


class Forest:
    """Union-find over 0..n-1 with arrays; the smallest member is the root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            keep = a != b
            if not keep.any():
                return
            a, b = a[keep], b[keep]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def link_within(points: np.ndarray, queries: np.ndarray, where: np.ndarray, forest: Forest, at: np.ndarray, radius: int) -> None:
    """Link every query to every point within the radius, directly or by a chain of such links.

    A vantage-point tree that is built as it is searched; at and where give the forest's number of each point and
    query, and every point is among the queries. What lies within the radius of a vantage point is linked to it, so a
    query and a point that both do are not compared: dense groups cost one comparison a member. Memory holds one path
    of the tree.
    """
    stack = [(np.arange(len(points)), np.arange(len(queries)))]
    rng = np.random.default_rng(0)
    while stack:
        mine, asked = stack.pop()
        if not len(mine) or not len(asked):
            continue
        if len(mine) > LEAF:
            chosen = mine[rng.integers(len(mine))]
            distance, away = (np.bitwise_count(x ^ points[chosen]).astype(np.int64) for x in (points[mine], queries[asked]))
            ball, close = distance <= radius, away <= radius
            forest.link(where[asked[close]], np.full(int(close.sum()), at[chosen]))
            # the ball's points are queries too, so they are linked as well; others within reach ask for them
            around = asked[~close & (away <= 2 * radius)]
            if len(around):
                stack.append((mine[ball], around)) if not ball.all() else _compare(points, queries, where, forest, at, radius, mine, around)
            mine, distance = mine[~ball], distance[~ball]
            if len(mine):
                split = int(np.median(distance))
                inside = distance <= split
                stack.append((mine[inside], asked[away <= split + radius]))
                if not inside.all():
                    stack.append((mine[~inside], asked[away > split - radius]))
            continue
        _compare(points, queries, where, forest, at, radius, mine, asked)


def _compare(points, queries, where, forest, at, radius, mine, asked) -> None:
    step = max(1, 2_000_000 // len(mine))
    for low in range(0, len(asked), step):
        some = asked[low : low + step]
        q, p = np.nonzero(np.bitwise_count(queries[some][:, None] ^ points[mine][None, :]) <= radius)
        forest.link(where[some[q]], at[mine[p]])


def shard_links(spark_rows: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, depth: int | None = None) -> DataFrame:
    """Links (a, b) between ids of rows (id, fp), fp distinct, that connect what lies within the radius.

    Each shard's result is a spanning forest of its links, so a dense group of n fingerprints gives n - 1 links and
    not their square. Rows are counted, so give it something written out.
    """
    forest_of = trees(radius, blocks, spark_rows.count(), depth)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = frame["fp"].to_numpy(np.int64).view(np.uint64)
            ids = frame["id"].to_numpy(np.int64)
            for number, tree in enumerate(forest_of):
                index, leaf, home = tree.leaves(fps)
                yield pd.DataFrame({"shard": leaf * blocks + number, "id": ids[index], "fp": fps[index].view(np.int64), "home": home})

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the rows of a task come sorted by shard; a shard is searched as soon as it is complete
        rest: list[pd.DataFrame] = []
        for frame in frames:
            shard = frame["shard"].to_numpy()
            cuts = np.r_[0, np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if rest and rest[0]["shard"].iloc[0] != shard[low]:
                    yield solve(pd.concat(rest))
                    rest = []
                rest.append(frame.iloc[low:high])
        if rest:
            yield solve(pd.concat(rest))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        """A shard's links: every fingerprint in it asks for those that live in it."""
        rows = rows.sort_values("id")
        ids, fps, home = rows["id"].to_numpy(), rows["fp"].to_numpy(np.int64).view(np.uint64), np.flatnonzero(rows["home"].to_numpy(bool))
        forest = Forest(len(ids))
        link_within(fps[home], fps, np.arange(len(ids)), forest, home, radius)
        child = np.flatnonzero(forest.root != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[child], "b": ids[forest.root[child]]})

    dealt = spark_rows.select("id", "fp").mapInPandas(deal, "shard long, id long, fp long, home boolean")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInPandas(search, "a long, b long")


def components(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the smallest doc_id reachable by links.

    doc_id must be a whole number. Rows with a null doc_id have a fingerprint and a null component, and link nothing.
    Null, empty and blank texts share the fingerprint 0 and are linked like any other. A doc_id with
    several texts has a row for each, in the component of its own fingerprint; the doc_id itself links nothing. A very
    long text is hashed in pieces. Equal fingerprints are one point of the trees. Only doc_id and text are read. An empty table gives an empty result.
    """
    return _components(docs, radius, blocks, shingle).select("doc_id", "fingerprint", "component_id")


def _components(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shingle: int = SHINGLE) -> DataFrame:
    """components() with mark, a hash of the row's text, and group, the component's smallest fingerprint."""
    prints = checkpoint(fingerprints(docs.select("doc_id", "text", _mark().alias("mark")), shingle, ("doc_id", "mark")))
    points = checkpoint(prints.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").cast("long").alias("id")))
    linked = connected_components(shard_links(points.select(F.col("fp").alias("id"), "fp"), radius, blocks))
    named = points.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "fp").alias("group"))
    # spread anew, so that joins have an exchange on both sides and a hot group's or fingerprint's rows can be split
    least = named.groupBy("group").agg(F.min("id").alias("component_id")).repartition("component_id", "group")
    named = named.join(least, "group").select("fp", "group", "component_id")
    rows = prints.join(named.repartition("component_id", "fp"), "fp", "left")
    known = F.col("doc_id").isNotNull()
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.select("doc_id", "mark", text.alias("fingerprint"), F.when(known, F.col("component_id")).alias("component_id"), F.when(known, F.col("group")).alias("group"))


def dedup(docs: DataFrame, **options) -> DataFrame:
    """One row of docs for each near-duplicate group, one with its smallest doc_id; columns are unchanged.

    Rows are told apart by doc_id and text, so each text of a doc_id with several stands for itself. Of equal rows any one stays. Rows with a null doc_id link nothing and all stay.
    """
    return keep_marked(docs, one_of_each(_components(docs, **options)), _mark())


def one_of_each(rows: DataFrame) -> DataFrame:
    """Verdicts for keep_marked on rows (doc_id, mark, group): of each group the row with the least doc_id and mark stays."""
    rows = rows.where(F.col("group").isNotNull()).groupBy("doc_id", "mark", "group").agg(F.count(F.lit(1)).alias("n"))
    best = rows.groupBy("group").agg(F.min(F.struct("doc_id", "mark")).alias("best"))
    # spread anew, so that the join has an exchange on both sides and a hot group's rows can be split
    rows = rows.join(best.repartition("best", "group"), "group").withColumn("kept", F.struct("doc_id", "mark") == F.col("best"))
    return checkpoint(rows.where("NOT kept OR n > 1").select(F.col("doc_id").alias("id"), "mark", "kept"))
