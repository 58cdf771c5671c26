"""Language identification with language-bitmask n-gram filters.

Training keeps, for each language, the n-grams (of UTF-8 bytes, lower case) that make up at least min_rate of its
n-grams and that are not much rarer there than in the language where they are most common. All languages share one
bit-sliced Bloom filter: a slot is a bitmask with a bit for each language, an n-gram sets its languages' bits in
HASHES slots, and the AND of those slots gives every language that may hold the n-gram in one lookup. A text's
n-grams are looked up, bits are counted for each language, and each count is corrected for the language's own
false-positive rate before the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.llm.texts import free_name, map_texts
from arborlake.session import checkpoint

NONE = "und"
N = 5
HASHES = 3
#: A language learns from about so many documents, chosen by hash; a language with fewer gives all.
SAMPLE_PER_LANGUAGE = 2000
#: Least share of a language's n-grams, so a language has at most 1 / MIN_RATE of them; more where there are very many languages.
MIN_RATE = 1e-5
#: Slots for each n-gram of the language that has most, and bytes of the whole filter, whatever the number of languages.
SLOTS_PER_GRAM, MAX_BYTES = 32, 1 << 26
#: Bytes of text whose n-grams are held at once.
PIECE = 1 << 20
#: Least share relative to the language where the n-gram is most common.
RELATIVE = 0.2
#: Evidence that names a language: so large a share of a text's distinct n-grams, and so many standard deviations of the
#: filter's false positives. On held-out labels of sf0.01 the least share is 0.37; with the text's language not learned,
#: the median is below 0.09 and the most 0.30.
MIN_SHARE, MIN_SIGMAS = 0.2, 5.0
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def grams(text: str, piece: int = PIECE) -> Iterator[np.ndarray]:
    """The text's n-grams as integers, one for each byte position, in arrays of at most `piece`; a text is framed by spaces."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    for low in range(0, len(raw) - N + 1, piece):
        count = min(piece, len(raw) - N + 1 - low)
        out = np.zeros(count, np.uint64)
        for i in range(N):
            out <<= np.uint64(8)
            out |= raw[low + i : low + i + count]
        yield out


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of one of Unicode's letter categories."""
    return any(map(str.isalpha, text or ""))


@dataclass
class Model:
    """languages by name, the slots (rows) by bit planes (columns of 8 languages), and each language's false-positive rate."""

    languages: list[str]
    usual: int
    slots: np.ndarray
    false_rate: np.ndarray

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Bitmasks (rows by planes) of the languages that may hold each n-gram."""
        shift = np.uint64(64 - int(len(self.slots)).bit_length() + 1)
        found = self.slots[(keys * np.uint64(_MULTIPLIERS[0])) >> shift]
        for m in _MULTIPLIERS[1:HASHES]:
            found = found & self.slots[(keys * np.uint64(m)) >> shift]
        return found

    def tally(self, keys: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language may hold."""
        masks, bits = self.lookup(keys), np.zeros(len(self.languages))
        for plane in range(masks.shape[1]):
            seen = np.bincount(masks[:, plane], minlength=256)
            for bit in range(min(8, len(self.languages) - 8 * plane)):
                bits[8 * plane + bit] = seen[_HAS[bit]].sum()
        return bits

    def counts(self, text: str) -> np.ndarray:
        """Corrected number of the text's n-grams in each language."""
        total, bits = 0, np.zeros(len(self.languages))
        for keys in grams(text):
            total += len(keys)
            bits += self.tally(keys)
        return np.maximum(bits - total * self.false_rate, 0) / (1 - self.false_rate)

    def decide(self, text: str | None) -> tuple[str, float]:
        """Language and score; ties go to the language that is first by name, no evidence to the usual one with score 0."""
        if not self.languages or not has_letter(text):
            return NONE, 0.0
        counts = self.counts(text)
        total = counts.sum()
        if total <= 0:
            return self.languages[self.usual], 0.0
        best = int(counts.argmax())
        return self.languages[best], float(counts[best] / total)

    def evident(self, text: str | None, piece: int = PIECE) -> str:
        """The language that most of the text's distinct n-grams speak for, NONE unless they do so by MIN_SHARE and MIN_SIGMAS.

        Neither depends on the number of languages, and repeating a text's n-grams does not add to them.
        """
        if not self.languages or not has_letter(text):
            return NONE
        keys = np.zeros(0, np.uint64)
        for some in grams(text, piece):
            keys = np.sort(np.concatenate([keys, some]) if len(keys) else some)
            keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
        bits = np.zeros(len(self.languages))
        for low in range(0, len(keys), piece):
            bits += self.tally(keys[low : low + piece])
        above = bits - len(keys) * self.false_rate
        net = above / (1 - self.false_rate)
        best = int(net.argmax())
        noise = np.sqrt(len(keys) * self.false_rate[best] * (1 - self.false_rate[best]))
        enough = net[best] > 0 and net[best] >= MIN_SHARE * len(keys) and above[best] >= MIN_SIGMAS * noise
        return self.languages[best] if enough else NONE


_HAS = [np.flatnonzero(np.arange(256) >> bit & 1) for bit in range(8)]


def build(languages: list[str], usual: int, keys: np.ndarray, which: np.ndarray) -> Model:
    """The filter over pairs of an n-gram and the index of one of its languages."""
    most = int(np.bincount(which, minlength=1).max()) if len(which) else 0
    size = 1 << max(10, int(SLOTS_PER_GRAM * most).bit_length())
    planes = max(1, -(-len(languages) // 8))
    while size * planes > 2 * MAX_BYTES and size > 1024:
        size //= 2
    slots = np.zeros((size, planes), np.uint8)
    shift = np.uint64(64 - size.bit_length() + 1)
    for m in _MULTIPLIERS[:HASHES]:
        np.bitwise_or.at(slots, ((keys * np.uint64(m)) >> shift, which >> 3), (1 << (which & 7)).astype(np.uint8))
    fill = np.array([(slots[:, i >> 3] >> (i & 7) & 1).mean() for i in range(len(languages))])
    return Model(languages, usual, slots, np.minimum(fill**HASHES, 0.99))


def train(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, min_rate: float = MIN_RATE, relative: float = RELATIVE) -> Model:
    """Learn from (doc_id, text, lang); rows with null text or null lang teach nothing.

    n-gram counts are summed in Spark. The driver gets two rows for each language and 16 bytes for each kept pair of
    n-gram and language. With many languages the least rate grows with their number, so that neither these pairs nor
    the filter outgrow MAX_BYTES.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return build([], 0, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    min_rate = max(min_rate, SLOTS_PER_GRAM * max(1, -(-len(languages) // 8)) / MAX_BYTES)
    spark = labelled.sparkSession
    # one short row for each language
    shares = spark.createDataFrame([(r["lang"], min(1.0, sample / r["count"])) for r in sizes], "lang string, chance double")
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) / F.lit(1_000_003.0) < F.col("chance")
    rows = labelled.join(F.broadcast(shares), "lang").where(drawn).select("lang", "text")

    def start():
        def step(texts: list[str | None]) -> list[pa.Array]:
            keys, counts, sizes = [], [], []
            for text in texts:
                found, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                for some in grams(text or ""):
                    some = np.sort(some)
                    first = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
                    both, times = np.concatenate([found, some[first]]), np.concatenate([n, np.diff(np.r_[first, len(some)])])
                    order = np.argsort(both, kind="stable")
                    both, times = both[order], times[order]
                    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
                    found, n = both[first], np.add.reduceat(times, first)
                keys.append(found.astype(np.int64))
                counts.append(n)
                sizes.append(len(found))
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts))], ["g", "n"])
            return [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pairs)]

        return step

    kind = T.ArrayType(T.StructType([T.StructField("g", T.LongType()), T.StructField("n", T.LongType())]))
    counted = map_texts(rows, ["lang"], [T.StructField("grams", kind)], start).select("lang", F.explode("grams").alias("x"))
    counted = checkpoint(counted.groupBy("lang", F.col("x.g").alias("gram")).agg(F.sum("x.n").alias("n")))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counted.where(F.col("n") > 1).join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= min_rate)
    top = F.max("rate").over(Window.partitionBy("gram"))
    kept = rated.withColumn("top", top).where(F.col("rate") >= F.col("top") * relative)
    index = spark.createDataFrame(list(enumerate(languages)), "i int, lang string")
    found = kept.join(F.broadcast(index), "lang").select("gram", "i").orderBy("gram", "i").toArrow()
    return build(languages, languages.index(sizes[0]["lang"]), found["gram"].to_numpy().view(np.uint64), found["i"].to_numpy().astype(np.int64))


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that teach nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """keep and, under `names`, the predicted language and its score for every row, from the whole text alone.

    A null text, an empty one or one without a letter is NONE with score 0, and so is everything if nothing was
    learned. A very long text is read in pieces of its bytes. Repeated rows give repeated results; an empty table
    gives an empty result. A name that keep has already gets bars in front. The broadcast model has at most
    2 * MAX_BYTES.
    """
    names = tuple(free_name(list(keep), n) for n in names)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        decide = sent.value.decide

        def step(texts: list[str | None]) -> list[pa.Array]:
            found = [decide(t) for t in texts]
            return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

        return step

    return map_texts(docs, list(keep), [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())], start)


def evident(docs: DataFrame, model: Model, keep: tuple[str, ...], name: str) -> DataFrame:
    """keep and, under `name`, the language that a row's text gives enough evidence of, else NONE."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        found = sent.value.evident
        return lambda texts: [pa.array([found(t) for t in texts], pa.string())]

    return map_texts(docs, list(keep), [T.StructField(name, T.StringType())], start)


def query(docs: DataFrame) -> DataFrame:
    """Predictions for every document by a model of the documents that are not held out."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
