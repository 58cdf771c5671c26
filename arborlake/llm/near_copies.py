"""Near copies by exact similarity of word shingles, with SimHash links first.

Two texts are near copies if the Jaccard similarity of their sets of SHINGLE-word shingles (as 64-bit hashes) is at
least FOUR_FIFTHS. Candidates come from three sources. Each must pass a bound on the sets' difference, which no similar
pair fails, and is then confirmed on the whole sets before it links:

1. Fingerprints of operator 4 within its radius, and for each shingle of a prefix its smallest text with each other
   one. Both give a number of candidates in proportion to the rows, also in dense groups.
2. Of every prefix shingle, its texts in an order of its own, each with the next NEXT that are not yet in its component.
   Texts that are all alike get as many random partners as they share shingles, so dense groups become one component.
3. Of every prefix shingle, all pairs of texts that are not yet in one component.

Under any one order of all shingles, two sets of similarity t or more share one of the first s - ceil(t * s) + 1
shingles of each, s the set's size (prefix filter), so no pair is missed. The order puts shingles that are common last,
counted over all texts; it decides how many candidates there are and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.llm.components import connected_components
from arborlake.llm.simhash import RADIUS, SEED, _mark, majority, one_of_each, shard_links, shingle_hashes
from arborlake.llm.texts import give_back, keep_marked, map_texts
from arborlake.session import broadcast_if_small, written

SHINGLE = 5
#: The similarity as a fraction, so that all comparisons are of whole numbers.
FOUR_FIFTHS = (4, 5)
#: Shingles of so many texts at least are known as common, and at most so many shingles, the most frequent.
LEAST, COMMON = 8, 1_000_000
#: A task sends its counts on when it holds so many hashes, in parts of the hashes that hold about so many in all.
HELD, PART = 500_000, 500_000
#: So many doc_ids are broadcast, so that the texts stay where they are.
MOST = 1_000_000
#: Words of 64 bits in a set's parities.
PARITIES = 8
#: Pairs of one gram that are looked at together.
PAIRS = 250_000
#: With how many texts behind it a text is a candidate in the order of each of its shingles.
NEXT = 2


def hashes(text: str | None) -> np.ndarray:
    """The hash of each word shingle of a text; fewer words than a shingle are one, no word gives none."""
    return np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, SHINGLE)])


def distinct(found: np.ndarray) -> np.ndarray:
    """The distinct hashes in order."""
    found = np.sort(found)
    return found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found


def _parities(grams: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITIES classes of hashes, whether the set has an odd number of them.

    Sets that differ in a class's parity differ in a member of it, so they differ in at least as many members as parities.
    """
    odd = np.bincount((grams >> np.uint64(40)).astype(np.int64) % (64 * PARITIES), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _vector(grams: np.ndarray) -> np.ndarray:
    """Parities like those above, in classes whose number grows with the set: four a member at least, a power of two."""
    classes = 1 << max(9, int(4 * len(grams) - 1).bit_length()) if len(grams) else 512
    odd = np.bincount((grams >> np.uint64(40)).astype(np.int64) % classes, minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def vector_distance(x: Column, y: Column) -> Column:
    """In how many classes the parities of two sets differ, as an expression, so that nothing is held in batches.

    A vector twice as long as the other is folded, as half as many classes hold two each; sets whose vectors are farther
    apart in length are never similar, and get no distance.
    """

    def folded(v: Column, other: Column) -> Column:
        half = (F.size(v) / 2).cast("int")
        return F.when(F.size(v) > F.size(other), F.zip_with(F.slice(v, 1, half), F.slice(v, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(v)

    bits = F.zip_with(folded(x, y), folded(y, x), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(bits, F.lit(0), lambda s, n: s + n)


def similar(size_a, size_b, both):
    """Whether sets of these sizes with so many common members reach the similarity."""
    p, q = FOUR_FIFTHS
    return (p + q) * both >= p * (size_a + size_b)


def _key(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes(), SEED)).astype(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    values = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(values))


_LONGS = T.ArrayType(T.LongType())
_ODD = [f"odd{i}" for i in range(PARITIES)]


def _sets(docs: DataFrame) -> DataFrame:
    """(key, grams) of every row."""

    def start():
        def step(texts: list[str | None]) -> list[pa.Array]:
            found = [distinct(hashes(t)) for t in texts]
            return [pa.array([_key(g) for g in found], pa.int64()), _lists(found)]

        return step

    return map_texts(docs, [], [T.StructField("key", T.LongType()), T.StructField("grams", _LONGS)], start)


def _counts(docs: DataFrame, shift: int) -> DataFrame:
    """(gram, n): in how many texts a hash without its last `shift` bits is, for those of LEAST texts or more.

    Tasks count what they hold before anything moves, so a frequent shingle is one number a task and part. Above the 32
    bits that are sent, a hash names its part, which one group adds up.
    """

    def tally(held: list[np.ndarray]) -> pa.RecordBatch:
        gram, times = np.unique(np.concatenate(held), return_counts=True)
        part = (gram >> np.uint64(32)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        low, n = (np.split(x.astype(np.uint32), new[1:]) for x in (gram & np.uint64(0xFFFFFFFF), times))
        values = [pa.array(part[new], pa.int64()), *(pa.array([x.tobytes() for x in y], pa.binary()) for y in (low, n))]
        return pa.RecordBatch.from_arrays(values, names=["part", "low", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                grams = distinct(hashes(text.as_py()))
                if len(grams):
                    held.append(grams >> np.uint64(shift))
                size += len(grams)
                if size >= HELD:
                    yield tally(held)
                    held, size = [], 0
        if size:
            yield tally(held)
        held.clear()
        give_back()

    def add(key: tuple[int], frame: pd.DataFrame) -> pd.DataFrame:
        low, times = (np.concatenate([np.frombuffer(x, np.uint32) for x in frame[c]]) for c in ("low", "times"))
        order = np.argsort(low, kind="stable")
        low = low[order]
        new = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        n = np.add.reduceat(times[order].astype(np.int64), new)
        common = n >= LEAST
        return pd.DataFrame({"gram": low[new][common].astype(np.int64) + (int(key[0]) << 32), "n": n[common]})

    return docs.select("text").mapInArrow(run, "part long, low binary, times binary").groupBy("part").applyInPandas(add, "gram long, n long")


def _common(docs: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """How many last bits to leave out, the common hashes without them, sorted, and in how many texts each is.

    If more than COMMON are common, the least number of texts is higher, in steps of a quarter power of two.
    """
    shingles = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) / 6
    shift = 32 - min(24, max(0, int(np.ceil(np.log2(max(shingles, 1) / PART)))))
    counted = written(_counts(docs, shift).withColumn("level", F.floor(4 * F.log2("n"))))
    level, total = 1 << 10, 0
    for row in counted.groupBy("level").count().orderBy(F.desc("level")).collect():
        total += row["count"]
        if total > COMMON:
            break
        level = row["level"]
    rows = counted.where(F.col("level") >= level).select("gram", "n").toPandas().sort_values("gram")
    return shift, rows["gram"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64).clip(max=2**31 - 1).astype(np.int32)


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, key, fp, size, odd0.., vector, prefix): a hash of the text, then digest, size and parities of a text's set, its fingerprint and its first shingles."""
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs))
    p, q = FOUR_FIFTHS

    def start():
        shift, common, times = sent.value

        def first(grams: np.ndarray) -> np.ndarray:
            rank = np.zeros(len(grams), np.int64)
            if len(common):
                short = grams >> np.uint64(shift)
                at = np.minimum(np.searchsorted(common, short), len(common) - 1)
                rank = np.where(common[at] == short, times[at], 0)
            return grams[np.lexsort((grams, rank))[: len(grams) + p * len(grams) // -q + 1]] if len(grams) else grams

        def step(texts: list[str | None]) -> list[pa.Array]:
            every = [hashes(t) for t in texts]
            found, fps = [distinct(e) for e in every], np.array([majority([e]) for e in every], np.uint64).view(np.int64)
            odd = np.array([_parities(g) for g in found], np.int64).reshape(-1, PARITIES)
            ints = [[_key(g) for g in found], fps, [len(g) for g in found], *(np.ascontiguousarray(odd[:, i]) for i in range(PARITIES))]
            return [*(pa.array(x, pa.int64()) for x in ints), _lists([_vector(g).view(np.uint64) for g in found]), _lists([first(g) for g in found])]

        return step

    fields = [T.StructField(n, T.LongType()) for n in ("key", "fp", "size", *_ODD)] + [T.StructField("vector", _LONGS), T.StructField("prefix", _LONGS)]
    return map_texts(docs.select("doc_id", "text", _mark().alias("mark")), ["doc_id", "mark"], fields, start)


def _by_gram(rows: DataFrame, solve, schema: str) -> DataFrame:
    """solve(frame) over frames of whole groups of gram, each sorted by gram."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            rest.append(frame)
            if rest[0]["gram"].iloc[0] == frame["gram"].iloc[-1]:
                continue
            whole = pd.concat(rest, ignore_index=True)
            open_ = whole["gram"].to_numpy() == whole["gram"].iloc[-1]
            yield solve(whole[~open_])
            rest = [whole[open_]]
        if rest:
            yield solve(pd.concat(rest, ignore_index=True))
            rest.clear()
        give_back()

    return rows.repartition("gram").sortWithinPartitions("gram").mapInPandas(run, schema)


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """The rows whose gram has another key, once each, with the smallest key of the gram, and whether sizes and places leave the two similar if the gram is the first that they share."""
    frame = frame.drop_duplicates(["gram", "key"])
    frame = frame[frame["gram"].duplicated(keep=False)].sort_values(["gram", "key"], kind="stable")
    least = frame.groupby("gram")[["key", "size", "pos"]].transform("first")
    both = np.minimum(frame["size"] - frame["pos"], least["size"] - least["pos"])
    return frame.assign(first=least["key"], fit=similar(frame["size"], least["size"], both))


def _not_far(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys, once each, that sizes and parities leave possible."""
    small = broadcast_if_small(points.select("key", "size", *_ODD))

    def side(c: str) -> DataFrame:
        return small.select(F.col("key").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("size", *_ODD)])

    p, q = FOUR_FIFTHS
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    apart = sum((F.bit_count(F.col(f"a_{x}").bitwiseXOR(F.col(f"b_{x}"))) for x in _ODD), F.lit(0))
    total = F.col("a_size") + F.col("b_size")
    # similar sets have p * total <= (p + q) * both, and differ in total - 2 * both members
    near = (F.lit(p + q) * apart <= F.lit(q - p) * total) & (F.lit(q) * F.least("a_size", "b_size") >= F.lit(p) * F.greatest("a_size", "b_size"))
    pairs = both.where(near).select("a", "b")

    # longer vectors for what is left, which tell long sets apart without moving them
    x, y = (points.select(F.col("key").alias(c), F.col("vector").alias(v), F.col("size").alias(f"{c}_size")) for c, v in (("a", "x"), ("b", "y")))
    left = pairs.join(x, "a").join(y, "b")
    return left.where(F.lit(p + q) * vector_distance(F.col("x"), F.col("y")) <= F.lit(q - p) * (F.col("a_size") + F.col("b_size"))).select("a", "b")


def _alike(frame: pd.DataFrame, left: np.ndarray, right: np.ndarray, both: np.ndarray) -> pd.DataFrame:
    """The pairs (a, b) of keys at these rows that may be similar by parities and with `both` common members at most."""
    p, q = FOUR_FIFTHS
    key, size, odd = frame["key"].to_numpy(), frame["size"].to_numpy(), frame[_ODD].to_numpy(np.int64).view(np.uint64)
    fit = similar(size[left], size[right], both)
    left, right = left[fit], right[fit]
    apart = np.bitwise_count(odd[left] ^ odd[right]).sum(axis=1, dtype=np.int64)
    near = (p + q) * apart <= (q - p) * (size[left] + size[right])
    a, b = key[left[near]], key[right[near]]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _next(frame: pd.DataFrame) -> pd.DataFrame:
    """Pairs of keys of one gram and different components, NEXT for each row at most, that sizes and parities leave possible.

    Every gram orders its keys anew, so that a key's partners differ from gram to gram.
    """
    mixed = (frame["key"].to_numpy(np.int64) ^ frame["gram"].to_numpy(np.int64)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    frame = frame.assign(at=mixed ^ (mixed >> np.uint64(32))).sort_values(["gram", "at"], kind="stable")
    gram, part, size = (frame[c].to_numpy() for c in ("gram", "component", "size"))
    out = []
    for step in range(1, NEXT + 1):
        left = np.flatnonzero((gram[:-step] == gram[step:]) & (part[:-step] != part[step:]))
        out.append(_alike(frame, left, left + step, np.minimum(size[left], size[left + step])))
    return pd.concat(out, ignore_index=True).drop_duplicates()


def _across(frame: pd.DataFrame) -> pd.DataFrame:
    """All pairs of keys of one gram that are of different components and of fitting sizes, places and parities.

    A gram at place i is the first that two sets have in common only if no more than size - i members are. Parities are
    compared here, so that a passage in many texts that are no copies makes few rows.
    """
    frame = frame[frame.groupby("gram")["component"].transform("nunique") > 1].sort_values(["gram", "component"], kind="stable")
    gram, part, key, size, place = (frame[c].to_numpy() for c in ("gram", "component", "key", "size", "pos"))
    new = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1], True]) if len(gram) else np.zeros(1, np.int64)
    end = np.repeat(new[1:], np.diff(new))
    # a row meets the rows of its gram behind the last one of its own component
    cut = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1]), True]) if len(gram) else np.zeros(1, np.int64)
    begin = np.repeat(cut[1:], np.diff(cut))
    count, out = end - begin, []
    low, total = 0, np.cumsum(count)
    while low < len(count):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + PAIRS, "right")))
        n = count[low:high]
        left = np.repeat(np.arange(low, high), n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[low:high], n)
        out.append(_alike(frame, left, right, np.minimum(size[left] - place[left], size[right] - place[right])))
        low = high
    return pd.concat(out, ignore_index=True).drop_duplicates() if out else pd.DataFrame({"a": key[:0], "b": key[:0]})


def confirmed(docs: DataFrame, points: DataFrame, pairs: DataFrame, repeated: bool) -> DataFrame:
    """The pairs (a, b) of keys whose whole sets are similar. points names a row (at) for each key; repeated says whether rows are."""
    pairs = written(_not_far(points, pairs))
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = points.join(keys, "key", "left_semi").select(F.col("at.doc_id").alias("_id"), F.col("at.mark").alias("_mark")).distinct()
    wanted = broadcast_if_small(written(wanted), MOST)
    rows = docs.withColumn("mark", _mark())
    sets = _sets(rows.join(wanted, (F.col("doc_id") == F.col("_id")) & (F.col("mark") == F.col("_mark")), "left_semi"))
    sets = written(sets.dropDuplicates(["key"]) if repeated else sets)

    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("grams").alias("y")), "b")
    return written(both.where(similar(F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y")))).select("a", "b"))


def _mixed(points: DataFrame, shared: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of shared with component and parities, of the grams that several components share; only these make pairs."""
    parts = connected_components(links).withColumnRenamed("node", "key")
    grouped = shared.drop("first", "fit").join(parts.repartition("component", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    grouped = written(grouped)
    mixed = grouped.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("gram")
    return grouped.join(broadcast_if_small(written(mixed)), "gram", "left_semi").join(broadcast_if_small(points.select("key", *_ODD)), "key")


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, group) for every row with a doc_id; rows of one group are linked. mark is a hash of the row's text.

    Texts without a word are copies of each other. A doc_id with several texts has each in the group of that text.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    rows = written(prints(docs))
    points = written(rows.groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("at"), *[F.first(x).alias(x) for x in ("fp", "size", "vector", *_ODD)]))
    repeated = not rows.groupBy("doc_id", "mark").count().where("count > 1").isEmpty()
    postings = rows.select("key", "size", F.posexplode("prefix").alias("pos", "gram"))
    shared = written(_by_gram(postings, _shared, "key long, size long, pos int, gram long, first long, fit boolean"))
    # one key for each fingerprint stands for it in the trees, and is a candidate for the fingerprint's other keys
    leaders = written(points.groupBy("fp").agg(F.min("key").alias("id")))
    near = shard_links(leaders, RADIUS).unionByName(points.select("key", "fp").join(leaders.repartition("fp", "id"), "fp").select(F.col("key").alias("a"), F.col("id").alias("b")))
    pairs = near.unionByName(shared.where("fit").select(F.col("first").alias("a"), F.col("key").alias("b"))).where("a <> b")
    links = confirmed(docs, points, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), repeated)
    # first few candidates of each text, so that what is left for all pairs are hardly any texts that are alike
    for solve in (_next, _across):
        more = confirmed(docs, points, _by_gram(_mixed(points, shared, links), solve, "a long, b long"), repeated)
        links = links.unionByName(more)
    parts = written(connected_components(links)).withColumnRenamed("node", "key")
    named = points.select("key").join(parts, "key", "left").select("key", F.coalesce("component", "key").alias("group"))
    return rows.select("doc_id", "mark", "key").join(named.repartition("group", "key"), "key").select("doc_id", "mark", "group")


def dedup(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near copies, one with its smallest doc_id; columns are unchanged.

    Rows are told apart by doc_id and text. Of equal rows any one stays. Rows with a null doc_id link nothing and all
    stay. A very long text is hashed in pieces; memory holds it and its set of hashes.
    """
    return keep_marked(docs, one_of_each(components(docs)), _mark(), MOST)
