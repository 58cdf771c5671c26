"""Personal data: fixed patterns, and terms of the corpus that give the found entities away.

Four patterns find e-mail addresses, IP addresses, card numbers and phone numbers. Each distinct value is a protected
entity. A term that stands near an entity tells something about it: their pointwise mutual information, estimated over
the whole corpus, against the entity's own information. With N words in all, n_e of them near entity e, count(t) of
term t and n(e, t) of these near e,

    disclosure(e, t) = log(n(e, t) * N / (n_e * count(t))) / log(N / n_e)

is 1 if t stands nowhere but near e and 0 if it is independent of e. A term above THRESHOLD for some entity is
sanitised wherever it stands, if it stood near that entity in SUPPORT different places, copies of one passage counting
once. It is generalised to its first letters if all terms with these letters together stay below the threshold, and
removed otherwise.

All is linear in the corpus: pairs (entity, term) come from the words around found entities only, and of terms only
those near some entity are counted. A filter of a fixed size tells tasks what to count and to look for; what passes it
is joined exactly, so its errors cost rows and change nothing.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.llm.divergence import terms_of
from arborlake.llm.texts import free_name, map_texts
from arborlake.session import checkpoint

#: Kinds in order; those behind the fourth are found by the corpus.
KINDS = ("email", "ip", "card", "phone", "term")
#: Words on each side of an entity that count as near.
NEAR = 8
#: Words on each side of a term that tell its places apart.
AROUND = 2
THRESHOLD = 0.9
SUPPORT = 3
#: Letters that a generalised term keeps; a term must be longer than that.
LETTERS = 3
#: Characters on each side of an entity in which its near words are looked for.
REACH = 400
#: Slots of the filter: the least, the most, and for each term.
LEAST_SLOTS, MOST_SLOTS, SLOTS = 1 << 16, 1 << 24, 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_NUMBER = re.compile(r"[0-9]++")
_CHAIN = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Around each @: all that may stand before it since the last match, and the longest domain."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
        # what stands before this @ can be part of no later match
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)
    return out


def addresses(text: str) -> list[Span]:
    """Of numbers joined by dots every four in turn; those with a part over 255 are dropped."""
    out = []
    for chain in _DOTTED.finditer(text):
        parts = list(_NUMBER.finditer(text, *chain.span()))
        for i in range(0, len(parts) - 3, 4):
            some = parts[i : i + 4]
            if all(p.end() - p.start() <= 3 or not p.group()[:-3].strip("0") for p in some) and all(int(p.group()[-3:]) <= 255 for p in some):
                out.append((some[0].start(), some[3].end()))
    return out


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    """Digits joined by single spaces or hyphens, as far as they go: 12 to 19 that pass the check."""
    out = []
    for chain in _CHAIN.finditer(text):
        if chain.end() - chain.start() < 12 or chain.end() - chain.start() > 37:
            continue
        digits = chain.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(chain.span())
    return out


def phones(text: str) -> list[Span]:
    """9 to 15 digits behind a plus sign."""
    out = []
    for found in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in found.group()) <= 15:
            out.append(found.span())
    return out


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every entity by start and kind. Each pattern reads the text in linear time."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(a, 1, b) for a, b in addresses(text)] + [(a, 2, b) for a, b in cards(text)]
        out += [(a, 3, b) for a, b in phones(text)] if "+" in text else []
    return sorted(out)


def entity(kind: int, value: str) -> int:
    """A number for an entity, whatever its case and punctuation."""
    plain = value.lower() if kind == 0 else ".".join(str(int(p[-3:])) for p in value.split(".")) if kind == 1 else re.sub(r"[^0-9]", "", value)
    return xxhash.xxh3_64_intdigest(f"{kind}:{plain}".encode()) - (1 << 63)


def covered(spans: list[tuple[int, int, int]]) -> list[Span]:
    """What the spans cover, as spans apart from each other."""
    out: list[Span] = []
    for a, _, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _free_terms(text: str, low: int, high: int, taken: list[Span]) -> list[Span]:
    """The terms in text[low:high] that touch no taken span. A term that the window cuts is left out."""
    out, i = [], 0
    for m in _TERM.finditer(text, low, high):
        a, b = m.span()
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if not (i < len(taken) and taken[i][0] < b) and (a > low or low == 0) and (b < high or high == len(text)):
            out.append((a, b))
    return out


def near(text: str) -> Counter:
    """(entity, term, place) -> how often: the terms near each entity of a text, once for each place in it.

    place is a hash of the AROUND terms on each side.
    """
    spans, out, seen = find(text), Counter(), set()
    taken = covered(spans)
    for start, kind, end in spans:
        e = entity(kind, text[start:end])
        low, high = max(0, start - REACH), min(len(text), end + REACH)
        # only the taken spans that meet the window
        first = next((i for i, (_, b) in enumerate(taken) if b > low), len(taken)) if len(taken) < 8 else int(np.searchsorted([b for _, b in taken], low, "right"))
        terms = _free_terms(text, low, high, taken[first:])
        before = [i for i, (_, b) in enumerate(terms) if b <= start]
        after = [i for i, (a, _) in enumerate(terms) if a >= end]
        for i in before[-NEAR:] + after[:NEAR]:
            a, b = terms[i]
            if (e, a) not in seen:
                seen.add((e, a))
                words = [text[x:y].translate(_FOLD) for x, y in terms[max(0, i - AROUND) : i + AROUND + 1]]
                out[e, text[a:b].translate(_FOLD), xxhash.xxh3_64_intdigest(" ".join(words).encode()) - (1 << 63)] += 1
    return out


def _batches(docs: DataFrame, step: Callable[[list[str | None]], pa.RecordBatch], schema: str) -> DataFrame:
    """step over the texts of each task in slices; what a task returns is only grouped, never matched to rows."""

    def start():
        return lambda texts: [pa.array([step(texts)], _NEAR)]

    return map_texts(docs, [], [T.StructField("found", T.ArrayType(T._parse_datatype_string(f"struct<{schema}>")))], start).select(F.inline("found"))


_NEAR = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.string()), ("place", pa.int64()), ("n", pa.int64())]))


def nearby(docs: DataFrame) -> DataFrame:
    """(entity, term, n, places): how often each term stands near each entity, and in how many different places."""

    def step(texts: list[str | None]) -> list[dict]:
        found: Counter = Counter()
        for text in texts:
            if text:
                found.update(near(text))
        return [{"entity": e, "term": t, "place": p, "n": n} for (e, t, p), n in found.items()]

    rows = _batches(docs, step, "entity:bigint,term:string,place:bigint,n:bigint")
    # places are added up first, so that a term's many places near one entity meet as one row each
    rows = rows.groupBy("entity", "term", "place").agg(F.sum("n").alias("n"))
    return checkpoint(rows.groupBy("entity", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("places")))


def _slot(term: bytes, mask: int) -> int:
    return zlib.crc32(term) & mask


def filter_of(terms: DataFrame) -> bytes:
    """A byte for each slot, 1 if a term of the table falls in it. At most MOST_SLOTS bytes, whatever the table's size."""
    slots = LEAST_SLOTS
    while slots < MOST_SLOTS and slots < SLOTS * terms.count():
        slots *= 2
    out = bytearray(slots)
    for row in terms.select(F.crc32(F.col("term").cast("binary")).bitwiseAND(slots - 1).alias("slot")).distinct().toLocalIterator():
        out[row["slot"]] = 1
    return bytes(out)


def counts(docs: DataFrame, sieve: bytes, wide: bytes) -> DataFrame:
    """(what, term, n) over all texts: 'term' for terms that pass the filter, 'form' for the first LETTERS letters of
    longer terms if these pass the other filter, and 'all' with a null term for the number of all terms."""
    sent = docs.sparkSession.sparkContext.broadcast((sieve, wide))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, passes_too = sent.value
        mask, mask_too = len(passes) - 1, len(passes_too) - 1
        total, found, forms = 0, Counter(), Counter()

        def rows() -> pa.RecordBatch:
            what = ["term"] * len(found) + ["form"] * len(forms)
            return pa.RecordBatch.from_arrays([pa.array(what, pa.string()), pa.array([*found, *forms], pa.binary()), pa.array([*found.values(), *forms.values()], pa.int64())], names=["what", "term", "n"])

        for batch in batches:
            for text in batch.column(0):
                for terms in terms_of(text.as_py()):
                    total += len(terms)
                    for term, n in Counter(terms).items():
                        if passes[zlib.crc32(term) & mask]:
                            found[term] += n
                        if len(term) > LETTERS:
                            form = term[:LETTERS]
                            if not form.isascii():
                                word = term.decode(errors="replace")
                                if len(word) <= LETTERS:
                                    continue
                                form = word[:LETTERS].encode()
                            if passes_too[zlib.crc32(form) & mask_too]:
                                forms[form] += n
            if len(found) + len(forms) > 200_000:
                yield rows()
                found.clear()
                forms.clear()
        yield rows()
        yield pa.RecordBatch.from_arrays([pa.array(["all"]), pa.array([None], pa.binary()), pa.array([total], pa.int64())], names=["what", "term", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "what string, term binary, n long")
    return checkpoint(rows.groupBy("what", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n")))


def _letters(term: Column) -> Column:
    return F.when(F.length(term) > LETTERS, F.substring(term, 1, LETTERS))


def disclosing(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """(term, disclosure, form): the terms to sanitise; form is what a term is generalised to, null if it is removed."""
    pairs = nearby(docs)
    likely = checkpoint(pairs.where(F.col("places") >= support).select("term").distinct())
    forms = checkpoint(likely.select(_letters(F.col("term")).alias("term")).where("term IS NOT NULL").distinct())
    counted = counts(docs, filter_of(likely), filter_of(forms))
    everything = counted.where("what = 'all'").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("all")).first()["all"]
    count = counted.where("what = 'term'").select("term", F.col("n").alias("count"))
    of_form = counted.where("what = 'form'").select(F.col("term").alias("form"), F.col("n").alias("count"))
    # the sides are small, and spread by both columns so that an entity that is everywhere can be split
    size = pairs.groupBy("entity").agg(F.sum("n").alias("size")).repartition("size", "entity")

    def told(n: Column, count: Column) -> Column:
        own = F.log(F.lit(everything) / F.col("size"))
        return F.when(own > 0, F.log(n * F.lit(everything) / (F.col("size") * count)) / own)

    alone = pairs.where(F.col("places") >= support).join(count, "term").join(size, "entity").withColumn("disclosure", told(F.col("n"), F.col("count")))
    alone = checkpoint(alone.where(F.col("disclosure") >= threshold).select("entity", "term", "disclosure", _letters(F.col("term")).alias("form")))
    forms = alone.select("entity", "form").where("form IS NOT NULL").distinct()
    wide = pairs.withColumn("form", _letters(F.col("term"))).join(forms, ["entity", "form"], "left_semi").groupBy("entity", "form").agg(F.sum("n").alias("n"))
    wide = wide.join(of_form, "form").join(size, "entity").select("entity", "form", (told(F.col("n"), F.col("count")) < threshold).alias("safe"))
    out = alone.join(wide, ["entity", "form"], "left").groupBy("term").agg(F.max("disclosure").alias("disclosure"), F.every(F.coalesce("safe", F.lit(False))).alias("safe"), F.any_value("form").alias("form"))
    return checkpoint(out.select("term", "disclosure", F.when(F.col("safe"), F.concat("form", F.lit("*"))).alias("form")))


_SPAN = "array<struct<start:int,kind:int,end:int>>"
_HIT = "array<struct<term:string,start:int,end:int>>"


def scan(docs: DataFrame, keep: tuple[str, ...], terms: DataFrame) -> DataFrame:
    """keep, spans (start, kind, end of every entity) and hits (start, term, form of every term of the table), by place.

    Rows are numbered and written out, what passes the filter is joined exactly by term, and goes back by number.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(terms))

    def start():
        passes = sent.value
        mask = len(passes) - 1
        span, hit = (pa.list_(pa.struct([(a, pa.int32()), (b, t), (c, pa.int32())])) for a, b, t, c in (("start", "kind", pa.int32(), "end"), ("start", "term", pa.string(), "end")))

        def hits(text: str, taken: list[Span]) -> list[dict]:
            some = {t for terms in terms_of(text.encode()) for t in set(terms) if passes[zlib.crc32(t) & mask]}
            if not some:
                return []
            some = {t.decode() for t in some}
            places = ((a, b, text[a:b].translate(_FOLD)) for a, b in _free_terms(text, 0, len(text), taken))
            return [{"start": a, "term": t, "end": b} for a, b, t in places if t in some]

        def step(texts: list[str | None]) -> list[pa.Array]:
            found = [find(t or "") for t in texts]
            made = [hits(t or "", covered(f)) for t, f in zip(texts, found, strict=True)]
            return [pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in f] for f in found], span), pa.array(made, hit)]

        return step

    fields = [T.StructField("spans", T._parse_datatype_string(_SPAN)), T.StructField("hits", T._parse_datatype_string("array<struct<start:int,term:string,end:int>>"))]
    rows = checkpoint(map_texts(docs, list(keep), fields, start).withColumn("_row", F.monotonically_increasing_id()))
    hits = rows.select("_row", F.inline("hits")).join(terms.select("term", "form").repartition("form", "term"), "term")
    # as many places as the row has of these terms
    hits = hits.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "term", "end", "form"))).alias("hits"))
    return rows.drop("hits").join(hits, "_row", "left").drop("_row").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<start:int,term:string,end:int,form:string>>")))


def _joined(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row.

    A null text counts as empty and has no span. Repeated rows have a result each; rows with a null doc_id are scanned
    like any other. Ties in start stand in order of kinds. An empty table gives an empty result. A very long text is
    one value; patterns read it in linear time. Only doc_id and text are read.
    """
    rows = scan(docs, ("doc_id",), disclosing(docs))

    def number(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    term = F.transform("hits", lambda h: F.struct(h["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), h["end"].alias("end")))
    return rows.select("doc_id", *[number(k) for k in range(4)], F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), _joined(F.concat("spans", term)).alias("spans"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs with text sanitised: [KIND] for each entity, the form of each generalised term, nothing for a removed one.

    Columns are unchanged, and a null text stays null. Where entities overlap, one mark of the first stands for all.
    """
    columns = docs.columns
    terms = disclosing(docs.select("text"), **options)
    rows = scan(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")), ("row",), terms)

    def start():
        def edit(text: str | None, spans, hits) -> str | None:
            if text is None:
                return None
            cuts = [(a, b, f"[{KINDS[next(k for s, k, _ in spans if s == a)].upper()}]") for a, b in covered(spans)]
            cuts += [(h["start"], h["end"], h["form"] or "") for h in hits]
            out, at = [], 0
            for a, b, new in sorted(cuts):
                out += [text[at:a], new]
                at = b
            return "".join([*out, text[at:]])

        return edit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edit = start()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            spans, hits = (batch.column(i).to_pylist() for i in (len(columns), len(columns) + 1))
            made = [edit(t.as_py(), [(s["start"], s["kind"], s["end"]) for s in f], h) for t, f, h in zip(batch.column(at), spans, hits, strict=True)]
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays[at] = pa.array(made, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    own = [F.col("row").getField(c).alias(c) for c in columns]
    names = [free_name(columns, c) for c in ("spans", "hits")]
    return rows.select(*own, *[F.col(a).alias(b) for a, b in zip(("spans", "hits"), names, strict=True)]).mapInArrow(run, docs.schema)


def digest(spans: list[tuple[int, int, int]]) -> str:
    """base_sha256 of spans (start, kind, end)."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()
