"""Audit of how sources diverge within a language, by mergeable radix tries.

Each task counts the terms of its documents in one byte trie a language: a leaf has the number of documents that hold
its term, and a counter for each source. A trie is kept and sent in depth-first order, each leaf as the length of the
prefix that it shares with the leaf before and the bytes behind it, so a subtree is a run of leaves and tries merge as
sorted runs do. Tries are cut at common splitters into prefix ranges, and ranges are merged in rounds of FAN tries, so
no task holds more than FAN parts of one range however many tasks have counted, nor a counter more than once a part.

Two walks over the merged tries in UTF-8 order follow: one adds up the vocabulary, one gives each pair of sources its
divergence and each group its candidate terms, the first of equal ones in order of bytes.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlake.session import broadcast_if_small, checkpoint

#: A term is kept for a language if so many of its documents hold it.
LEAST_DOCS = 3
SCALE_STEPS, STEP = 3, 1000
#: The scale of shares: 1,000,000,000, multiplied in steps so that counts up to 9e15 stay exact.
SCALE = STEP**SCALE_STEPS
RANKS = 200
#: A task sends its tries on when its documents have had so many counters.
HELD = 1_500_000
#: Leaves of a trie that are sent as one row, at most, and counters of a prefix range, about.
LEAVES, RANGE = 4096, 100_000
#: Tries that are merged at once.
FAN = 64
#: Rows whose first keys choose the splitters, about.
SAMPLED = 100_000
#: Bytes of a text that are split at once, and cells of a table of shares.
PIECE, CELLS = 4_000_000, 1_000_000
#: Sources whose divergences from all others are added up at once.
SIDE = 256

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def terms_of(raw: bytes | None, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8 with A-Z in lower case, in lists that cover about `piece` bytes each."""
    low, raw = 0, raw or b""
    while low < len(raw):
        high = min(low + piece, len(raw))
        while high < len(raw) and _FOLD[raw[high]] != 0x20:
            high += 1
        yield raw[low:high].translate(_FOLD).split()
        low = high


class Trie:
    """The leaves of a radix trie over bytes in depth-first order, with counters.

    terms, docs (documents of the language that hold each), and the counters of leaf i at starts[i]:starts[i + 1] of
    (source, count), sources being numbers into names.
    """

    def __init__(self, terms: list[bytes], docs: np.ndarray, starts: np.ndarray, source: np.ndarray, count: np.ndarray, names: list[str]):
        self.terms, self.docs, self.starts, self.source, self.count, self.names = terms, docs, starts, source, count, names

    @classmethod
    def of(cls, terms: list[bytes], docs: np.ndarray, leaf: np.ndarray, source: np.ndarray, count: np.ndarray, names: list[str]) -> Trie:
        """From terms in any order and counters (leaf, source, count) in any order, which may repeat."""
        order = sorted(range(len(terms)), key=terms.__getitem__)
        place = np.empty(len(terms), np.int64)
        place[order] = np.arange(len(terms))
        key, at = np.unique(place[leaf] * len(names) + source, return_inverse=True) if len(leaf) else (leaf, leaf)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, count)
        starts = np.searchsorted(key, np.arange(len(terms) + 1) * len(names))
        return cls([terms[i] for i in order], docs[order], starts, key % max(len(names), 1), total, names)

    def part(self, low: int, high: int) -> Trie:
        a, b = self.starts[low], self.starts[high]
        return Trie(self.terms[low:high], self.docs[low:high], self.starts[low : high + 1] - a, self.source[a:b], self.count[a:b], self.names)

    def where(self, keep: np.ndarray) -> Trie:
        """The trie of some of the leaves."""
        sizes = np.diff(self.starts)
        held = np.repeat(keep, sizes)
        return Trie([t for t, k in zip(self.terms, keep, strict=True) if k], self.docs[keep], np.r_[0, np.cumsum(sizes[keep])], self.source[held], self.count[held], self.names)

    def pack(self) -> bytes:
        """Front-coded leaves and their counters; the names go beside it."""
        shared, before = np.zeros(len(self.terms), np.int64), b""
        rest = []
        for i, term in enumerate(self.terms):
            n, most = 0, min(len(before), len(term))
            if before[:most] == term[:most]:
                n = most
            else:
                while before[n] == term[n]:
                    n += 1
            shared[i] = n
            rest.append(term[n:])
            before = term
        arrays = [np.array([len(self.terms), len(self.source)]), shared, np.fromiter(map(len, rest), np.int64, len(rest)), self.docs, np.diff(self.starts), self.source, self.count]
        return zlib.compress(b"".join(x.astype(np.int64).tobytes() for x in arrays) + b"".join(rest), 1)

    @classmethod
    def unpack(cls, packed: bytes, names: Iterable[str]) -> Trie:
        raw = zlib.decompress(packed)
        n, m = np.frombuffer(raw, np.int64, 2).tolist()
        shared, lengths, docs, sizes, source, count = np.split(np.frombuffer(raw, np.int64, 4 * n + 2 * m, 16), np.cumsum([n, n, n, n, m]))
        at, before, terms = 8 * (2 + 4 * n + 2 * m), b"", []
        for k, length in zip(shared.tolist(), lengths.tolist(), strict=True):
            before = before[:k] + raw[at : at + length]
            terms.append(before)
            at += length
        return cls(terms, docs, np.r_[0, np.cumsum(sizes)], source, count, list(names))

    @classmethod
    def merge(cls, tries: list[Trie]) -> Trie:
        """One trie with the counters of all. Their leaves are sorted runs, so sorting them together merges the runs."""
        names = sorted({x for t in tries for x in t.names})
        number = {x: i for i, x in enumerate(names)}
        every = [term for t in tries for term in t.terms]
        order = sorted(range(len(every)), key=every.__getitem__)
        terms, leaf = [], np.empty(len(every), np.int64)
        for i in order:
            if not terms or terms[-1] != every[i]:
                terms.append(every[i])
            leaf[i] = len(terms) - 1
        docs = np.zeros(len(terms), np.int64)
        np.add.at(docs, leaf, np.concatenate([np.zeros(0, np.int64), *(t.docs for t in tries)]))
        sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(t.starts) for t in tries)])
        source = [np.array([number[x] for x in t.names], np.int64)[t.source] for t in tries]
        count = np.concatenate([np.zeros(0, np.int64), *(t.count for t in tries)])
        key = np.repeat(leaf, sizes) * max(len(names), 1) + np.concatenate([np.zeros(0, np.int64), *source])
        key, at = np.unique(key, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, count)
        return cls(terms, docs, np.searchsorted(key, np.arange(len(terms) + 1) * max(len(names), 1)), key % max(len(names), 1), total, names)


class _Numbers(dict):
    """Numbers its keys as they are asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = found = len(self)
        return found


class _Counting:
    """The terms of one language in one task, numbered as they come."""

    def __init__(self):
        self.number = _Numbers()
        self.sources: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, int]] = []

    def add(self, source: str, found: Counter) -> int:
        number, at = self.number, self.sources.setdefault(source, len(self.sources))
        leaf = np.fromiter(map(number.__getitem__, found), np.int32, len(found))
        self.parts.append((leaf, np.fromiter(found.values(), np.int64, len(found)), at))
        return len(found)

    def trie(self) -> Trie:
        docs = np.zeros(len(self.number), np.int64)
        for leaf, _, _ in self.parts:
            docs[leaf] += 1
        leaf = np.concatenate([np.zeros(0, np.int32), *(x[0] for x in self.parts)])
        count = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in self.parts)])
        source = np.repeat(np.array([x[2] for x in self.parts], np.int64), [len(x[0]) for x in self.parts])
        return Trie.of(list(self.number), docs, leaf, source, count, list(self.sources))


_TRIE = "lang string, low binary, names array<string>, leaves binary, n long"


def _rows(lang: str, trie: Trie) -> Iterator[dict]:
    for low in range(0, len(trie.terms), LEAVES):
        some = trie.part(low, min(low + LEAVES, len(trie.terms)))
        used = np.unique(some.source)
        source = np.searchsorted(used, some.source)
        some = Trie(some.terms, some.docs, some.starts, source, some.count, [some.names[i] for i in used])
        yield {"lang": lang, "low": some.terms[0], "names": some.names, "leaves": some.pack(), "n": len(some.source)}


def _batch(rows: Iterable[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(list(rows), schema=schema)


_ARROW = pa.schema([("lang", pa.string()), ("low", pa.binary()), ("names", pa.list_(pa.string())), ("leaves", pa.binary()), ("n", pa.int64())])
_CUT = pa.schema([*_ARROW, ("range", pa.int64()), ("share", pa.int64())])


def tries(docs: DataFrame) -> DataFrame:
    """Rows of LEAVES leaves at most of the tries of each task, from columns lang, source and text without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(_Counting), 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                found: Counter = Counter()
                for terms in terms_of(text.as_py()):
                    found.update(terms)
                size += held[lang.as_py()].add(source.as_py(), found)
                if size >= HELD:
                    for name, counting in held.items():
                        yield _batch(_rows(name, counting.trie()), _ARROW)
                    held, size = defaultdict(_Counting), 0
        for name, counting in held.items():
            yield _batch(_rows(name, counting.trie()), _ARROW)

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, _TRIE)


def _key(lang: str, term: bytes) -> bytes:
    """Keys of one language stand in order of terms; no term has a byte below A."""
    return lang.encode() + b"\x00" + term


def merged(docs: DataFrame) -> DataFrame:
    """Tries of prefix ranges, each term of a language in one of them only, as rows like those of tries()."""
    rows = checkpoint(tries(docs))
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if not size["rows"]:
        return rows
    # splitters: about SAMPLED rows at most, whatever the corpus, and only for balance
    some = rows if size["rows"] <= SAMPLED else rows.sample(SAMPLED / size["rows"], 0)
    keys = sorted(_key(r["lang"], bytes(r["low"])) for r in some.select("lang", "low").collect())
    wanted = min(len(keys), max(1, size["n"] // RANGE))
    splitters = sorted({keys[len(keys) * i // wanted] for i in range(1, wanted)})
    sent = docs.sparkSession.sparkContext.broadcast(splitters)
    # rows of one range at most, if each task has sent it one row or the few that its leaves take
    shares = max(1, -(-size["rows"] // (FAN * (len(splitters) + 1))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left, bisect_right

        edges = sent.value
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                trie = Trie.unpack(row["leaves"], row["names"])
                low, number = 0, bisect_right(edges, _key(row["lang"], trie.terms[0]))
                while low < len(trie.terms):
                    high = len(trie.terms)
                    if number < len(edges):
                        high = low + bisect_left([_key(row["lang"], t) for t in trie.terms[low:]], edges[number])
                    if high > low:
                        made = row if high - low == len(trie.terms) else next(iter(_rows(row["lang"], trie.part(low, high))))
                        out.append(made | {"range": number, "share": zlib.crc32(row["leaves"]) % shares})
                    low, number = high, number + 1
            yield _batch(out, _CUT)

    def join(key: tuple, table: pa.Table) -> pa.Table:
        found = Trie.merge([Trie.unpack(r["leaves"], r["names"]) for r in table.select(["leaves", "names"]).to_pylist()])
        lang, number, share = (k.as_py() for k in key)
        return pa.Table.from_pylist([r | {"range": number, "share": share} for r in _rows(lang, found)], schema=_CUT)

    schema = f"{_TRIE}, range long, share long"
    rows = rows.mapInArrow(cut, schema)
    while shares > 1:
        rows = checkpoint(rows.groupBy("lang", "range", "share").applyInArrow(join, schema))
        shares = -(-shares // FAN)
        rows = rows.withColumn("share", F.pmod(F.xxhash64("leaves"), F.lit(shares)))
    return rows.withColumn("share", F.lit(0).cast("long")).groupBy("lang", "range", "share").applyInArrow(join, schema).drop("range", "share")


def _kept(rows: DataFrame, least: int) -> DataFrame:
    """The tries without terms of fewer documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                trie = Trie.unpack(row["leaves"], row["names"])
                out += _rows(row["lang"], trie.where(trie.docs >= least))
            yield _batch(out, _ARROW)

    return rows.mapInArrow(run, _TRIE)


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * count / total) for 0 <= count <= total, by long division."""
    whole, rest = np.divmod(count, total)
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * STEP, total)
        whole = whole * STEP + digit
    return 1 + whole


def _walk(tries_: Iterator[tuple[str, Trie]], groups: dict[str, tuple[int, dict[str, tuple[int, int]], int]]) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """(lang, terms, counts and shares of each source, shares of the language) in UTF-8 order, CELLS cells at most at once."""
    for lang, trie in tries_:
        vocabulary, sources, everything = groups[lang]
        number = np.array([sources[x][0] for x in trie.names], np.int64)
        totals = np.array([n for _, n in sources.values()], np.int64) + vocabulary
        step = max(1, CELLS // len(sources))
        for low in range(0, len(trie.terms), step):
            some = trie.part(low, min(low + step, len(trie.terms)))
            counts = np.zeros((len(some.terms), len(sources)), np.int64)
            counts[np.repeat(np.arange(len(some.terms)), np.diff(some.starts)), number[some.source]] = some.count
            yield lang, some.terms, counts, shares(counts + 1, totals), shares(counts.sum(axis=1) + 1, everything + vocabulary)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) * (p - q) // q


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's divergence from the other sources, and its telling terms.

    Part `pair` has a row for each other source of the language, part `term` one for each of the first `ranks` terms
    that the group has and uses more than its language. Null text, lang and source count as empty, which is a value like
    any other; groups without terms have the shares of the smoothing. Repeated rows count each, ties go by the bytes of
    the item, and an empty table gives an empty result. A very long text is split in pieces; memory holds the text and
    its distinct terms. Only text, lang and source are read.

    Sources of a language are compared with each other, so the result itself grows with the square of their number.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    spark = docs.sparkSession
    kept = checkpoint(_kept(merged(docs), least_docs))
    sizes = _sizes(kept)
    pairs = docs.select("lang", "source").distinct()
    known = checkpoint(pairs.join(sizes.where("source IS NOT NULL"), ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")))
    words = {r["lang"]: r["n"] for r in sizes.where("source IS NULL").collect()}
    # one entry for each group: the result holds a row for every two of them in a language
    groups: dict[str, tuple[int, dict[str, tuple[int, int]], int]] = {}
    for r in known.orderBy("lang", "source").toLocalIterator():
        _, mine, _ = groups.setdefault(r["lang"], (0, {}, 0))
        mine[r["source"]] = (len(mine), r["n"])
    groups = {lang: (words.get(lang, 0), mine, sum(n for _, n in mine.values())) for lang, (_, mine, _) in groups.items()}
    sent = spark.sparkContext.broadcast(groups)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Trie]]:
        for batch in batches:
            for row in batch.to_pylist():
                yield row["lang"], Trie.unpack(row["leaves"], row["names"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums for each pair of sources, and each group's best terms so far, over the tries of a task."""
        every = sent.value
        sums: dict[str, np.ndarray] = {}
        best: dict[str, list[tuple[np.ndarray, list[bytes]]]] = {}
        for lang, terms, counts, p, q in _walk(read(batches), every):
            n = p.shape[1]
            total = sums.setdefault(lang, np.zeros((n, n), np.int64))
            for i in range(n):
                for low in range(0, n, SIDE):
                    total[i, low : low + SIDE] += divergence(p[:, i : i + 1], p[:, low : low + SIDE]).sum(axis=0)
            lists = best.setdefault(lang, [(np.zeros(0, np.int64), []) for _ in range(n)])
            _candidates(lists, terms, np.where((counts > 0) & (p > q[:, None]), divergence(p, q[:, None]), -1), ranks)
        for lang, total in sums.items():
            names = list(every[lang][1])
            for i in range(len(names)):
                yield _found([lang] * len(names), [names[i]] * len(names), "pair", names, total[i])
        for lang, lists in best.items():
            for i, (value, terms) in enumerate(lists):
                if len(value):
                    yield _found([lang] * len(value), [list(every[lang][1])[i]] * len(value), "term", [t.decode() for t in terms], value)

    found = checkpoint(kept.mapInArrow(compare, "lang string, source string, part string, item string, value long"))
    other = known.select("lang", F.col("source").alias("item"))
    sums_ = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    left = known.select("lang", "source").join(broadcast_if_small(other), "lang").where("source <> item").join(sums_, ["lang", "source", "item"], "left")
    left = left.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    out = left.unionByName(found.where("part = 'term'"))
    # a group has a row for each other source and at most `ranks` for each task
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    out = out.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= ranks))
    return out.select("lang", "source", "part", "item", "value", "rank")


def _candidates(lists: list[tuple[np.ndarray, list[bytes]]], terms: list[bytes], value: np.ndarray, ranks: int) -> None:
    """Keep for each group its `ranks` best terms, the smaller bytes among equal ones; below 0 is no candidate."""
    for i, (before, known) in enumerate(lists):
        mine = np.flatnonzero(value[:, i] >= 0)
        if not len(mine):
            continue
        every, texts = np.concatenate([before, value[mine, i]]), known + [terms[j] for j in mine.tolist()]
        if len(every) > ranks:
            # all that tie with the last one that stays compete by their bytes
            some = np.flatnonzero(every >= np.partition(every, len(every) - ranks)[len(every) - ranks]).tolist()
            order = sorted(some, key=lambda j, every=every, texts=texts: (-every[j], texts[j]))[:ranks]
            every, texts = every[order], [texts[j] for j in order]
        lists[i] = every, texts


def _found(lang: list[str], source: list[str], part: str, item: list[str], value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array([part] * len(item), pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])


def _sizes(kept: DataFrame) -> DataFrame:
    """(lang, source, n): a group's occurrences of kept terms; with source null the number of the language's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for row in batch.to_pylist():
                trie = Trie.unpack(row["leaves"], row["names"])
                total[row["lang"], None] += len(trie.terms)
                for name, n in zip(trie.names, np.bincount(trie.source, trie.count, len(trie.names)).astype(np.int64).tolist(), strict=True):
                    total[row["lang"], name] += n
        if total:
            yield pa.RecordBatch.from_pylist([{"lang": a, "source": b, "n": n} for (a, b), n in total.items()], schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("n", pa.int64())]))

    return checkpoint(kept.mapInArrow(run, "lang string, source string, n long").groupBy("lang", "source").agg(F.sum("n").alias("n")))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
size AS (SELECT lang, count(*) AS v FROM v GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN v USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
ln AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
gp AS (
  SELECT grp.lang, grp.source, v.term, coalesce(c.n, 0) AS n,
         CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(gn.total, 0)::HUGEINT + size.v) AS HUGEINT) AS p
  FROM grp JOIN v USING (lang) JOIN size USING (lang) LEFT JOIN gn ON gn.lang = grp.lang AND gn.source = grp.source
  LEFT JOIN c ON c.lang = grp.lang AND c.source = grp.source AND c.term = v.term),
lp AS (
  SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(ln.total)::HUGEINT + any_value(size.v)) AS HUGEINT) AS q
  FROM c JOIN ln USING (lang) JOIN size USING (lang) GROUP BY lang, term),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         CAST(coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM gp x JOIN gp y ON x.lang = y.lang AND x.term = y.term
                        WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
term AS (
  SELECT gp.lang, gp.source, 'term' AS part, gp.term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value
  FROM gp JOIN lp USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
