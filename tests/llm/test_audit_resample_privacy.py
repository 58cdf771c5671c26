"""Operators 11 to 13 against brute force, with the edge cases that their docstrings define."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASHING = "1 AS n, 'q' AS term, 2 AS n_words, 3 AS bucket, 4 AS weight, 'w' AS `_text`, 5 AS spans, 6 AS hits, 7 AS `range`, 8 AS rank"
EDGE = [
    (1, "Mail Ann@x.org or +1 (222) 333-4444, ann again", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "", "de", "b"), (None, " \t\n", "fr", None),
    (6, "x", "en", "a"), (7, "the cat sat on the mat and then the cat sat on the mat again " * 900, "en", "a"), (8, "the cat sat on the mat and then the cat sat on the mat again " * 900, "en", "b"),
    (9, "Straße CAFÉ café ﬁne", "de", "b"), (None, "strasse café café  fine", "de", "b"), (11, "123 456 !! 1.2.3.4.5.6.7.8", "en", "c"), (12, "x", "en", "d"),
    (12, "x", "en", "d"), (-3, "éè 中文 \U0001f600 1.2.3.4", "fr", "é"), (14, "the mat was the cat", "", "z"), (15, "the mat and the cat again", "en", "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string").selectExpr("*", *CLASHING.split(", "))


def tuples(df):
    return Counter(tuple(r) for r in df.collect())


# operator 11


def brute_audit(rows, least=3, ranks=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    groups, df, counts = set(), Counter(), Counter()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = term.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        df.update((lang, t) for t in set(found))
        counts.update((lang, source, t) for t in found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in df.items() if x == lang and n >= least]
        mine = sorted(s for x, s in groups if x == lang)

        def p(count, kept=kept):
            total = sum(count(t) for t in kept)
            return {t: 1 + 10**9 * (count(t) + 1) // (total + len(kept)) for t in kept}

        shares = {s: p(lambda t, s=s, lang=lang: counts[lang, s, t]) for s in mine}
        whole = p(lambda t, lang=lang, mine=mine: sum(counts[lang, s, t] for s in mine))
        for s in mine:
            pairs = [(-sum((shares[s][t] - shares[o][t]) ** 2 // shares[o][t] for t in kept), o.encode(), o) for o in mine if o != s]
            terms = [(-((shares[s][t] - whole[t]) ** 2 // whole[t]), t.encode(), t) for t in kept if counts[lang, s, t] and shares[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, s, part, item, -value, i + 1) for i, (value, _, item) in enumerate(found)]
    return Counter(out)


def test_audit_against_brute_force(spark, docs, edge, monkeypatch):
    from arborlake.llm import divergence

    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    assert tuples(divergence.audit(docs)) == brute_audit(rows)
    assert tuples(divergence.audit(edge)) == brute_audit(EDGE)
    assert divergence.audit(edge.where("false")).collect() == []
    # many small tries, cut in many ranges and merged in several rounds, and ranks that cut ties
    for name, value in (("HELD", 300), ("LEAVES", 16), ("RANGE", 200), ("FAN", 2), ("PIECE", 40), ("CELLS", 50), ("SIDE", 2)):
        monkeypatch.setattr(divergence, name, value)
    some = docs.where("doc_id % 4 = 0").repartition(7).unionByName(docs.sparkSession.createDataFrame(EDGE, "doc_id long, text string, lang string, source string").selectExpr("*", "0 AS n_chars"), True)
    rows = [tuple(r) for r in some.select("doc_id", "text", "lang", "source").collect()]
    assert tuples(divergence.audit(some, ranks=7)) == brute_audit(rows, ranks=7)


def test_shares_are_exact_for_large_counts():
    from arborlake.llm.divergence import shares

    r = random.Random(1)
    for _ in range(200):
        total = r.randint(1, 9 * 10**15)
        count = r.randint(0, total)
        assert shares(np.array([count]), total)[0] == 1 + 10**9 * count // total


def test_tries_merge_and_pack():
    from arborlake.llm.divergence import Trie

    r = random.Random(2)
    want, tries = defaultdict(Counter), []
    for _ in range(5):
        names, counters = [f"s{i}" for i in r.sample(range(9), 4)], []
        terms = list({bytes(r.choice(b"ab\xc3") for _ in range(r.randint(1, 6))) for _ in range(40)})
        for _ in range(100):
            leaf, source, n = r.randrange(len(terms)), r.randrange(4), r.randint(1, 9)
            counters.append((leaf, source, n))
            want[terms[leaf]][names[source]] += n
        for t in terms:
            want[t][""] += 1
        made = Trie.of(terms, np.ones(len(terms), np.int64), *(np.array(x, np.int64) for x in zip(*counters)), names)
        assert made.terms == sorted(terms)
        tries.append(Trie.unpack(made.pack(), made.names))
    whole = Trie.merge(tries)
    got = {t: Counter({whole.names[s]: n for s, n in zip(whole.source[a:b], whole.count[a:b])}) + Counter({"": d}) for t, a, b, d in zip(whole.terms, whole.starts, whole.starts[1:], whole.docs)}
    assert whole.terms == sorted(want) and got == {t: +c for t, c in want.items()}


# operator 12


def brute_resample(rows, target, n=1, buckets=10_000, seed=2024, percent=10, least=20):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        runs = [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]
        return len(w), [zlib.crc32(x.encode()) % buckets for x in runs]

    found, wanted = [(d, *features(t)) for d, t in rows], Counter(b for t in target for b in features(t)[1])
    corpus = Counter(b for _, _, f in found for b in f)
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((corpus[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for doc, words, f in found:
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    drawn = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for i, x in enumerate(drawn[: percent * len(drawn) // 100]):
        x[4] = i + 1
    return Counter(tuple(x[:5]) for x in out)


def test_resampling_against_brute_force(spark, docs, edge):
    from arborlake.llm import resampling

    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = [r["text"] for r in target.collect()]
    assert tuples(resampling.query(docs, target)) == brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], texts)
    rows = [(r[0], r[1]) for r in EDGE]
    assert tuples(resampling.query(edge, target)) == brute_resample(rows, texts)
    assert resampling.query(edge.where("false"), target).collect() == []
    none = target.where("false")
    assert tuples(resampling.query(edge, none)) == brute_resample(rows, [])
    # longer runs, fewer buckets, other limits
    scored = resampling.score(edge, target, n=3, buckets=50, seed=7)
    assert tuples(resampling.draw(scored, 40, 1).select("doc_id", "n_features", "weight", "score", "rank")) == brute_resample(rows, texts, 3, 50, 7, 40, 1)


def test_resampled_rows_are_rows(docs, edge, spark):
    from arborlake.llm import resampling

    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    drawn = resampling.query(docs, target).where("rank IS NOT NULL").select("doc_id")
    out = resampling.resample(docs, target)
    assert out.columns == docs.columns and tuples(out.select("doc_id")) == tuples(drawn) and drawn.count() == 10 * docs.where(F.size(resampling.words(F.col("text"))) >= 20).count() // 100
    assert resampling.resample(edge, target, percent=100, least_words=0).count() == len(EDGE)


# operator 13

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d // 10 + d % 10
    return total % 10 == 0


def brute_find(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_patterns_against_plain_regexes():
    from arborlake.llm.personal_data import find

    r = random.Random(5)
    for letters in ("a1.@-_ é", "0123456789.", "0123 -", "+12() .-3", "a.@b-9+ ", "12345.@+ -"):
        for _ in range(6000):
            text = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
            assert find(text) == brute_find(text), text
    for _ in range(2000):
        digits = [str(r.randint(0, 9)) for _ in range(r.randint(11, 20))]
        text = "".join(d + r.choice(["", "", " ", "-"]) for d in digits) + r.choice(["", "x", " 1", "--2"])
        assert find(text) == brute_find(text), text
    for text in ("192.168.001.0001", "256.1.1.1", "1.2.3.4.5.6.7.8.9", "0000255.0.0.0", "a@b.c_d@e.f", "a@b@c.d", "x.@y.z-", "@a.b", "\U0001f600 a@b.cc"):
        assert find(text) == brute_find(text), text


def test_patterns_read_long_texts_once():
    from arborlake.llm.personal_data import find

    n = 3_000_000
    for text in ("a" * n, "1" * n, "1." * (n // 2), "1 " * (n // 2), "+1" + " " * n, "a@" * (n // 2), "." * n + "@x"):
        find(text)


def brute_near(rows):
    """(entity, term) -> times near it, places; all as the docstring says."""
    from arborlake.llm import personal_data as pd_

    n, places = Counter(), defaultdict(set)
    for text in rows:
        text = text or ""
        spans = brute_find(text)
        seen = set()
        for start, kind, end in spans:
            e = pd_.entity(kind, text[start:end])
            low, high = max(0, start - pd_.REACH), min(len(text), end + pd_.REACH)
            terms = [m.span() for m in re.finditer(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text[:high]) if m.end() > low]
            terms = [(a, b) for a, b in terms if a >= low and not (a == low and low and pd_._TERM.match(text[low - 1 : low])) and not (b == high and high < len(text))]
            terms = [(a, b) for a, b in terms if not (a == low and low) and not any(a < y and x < b for x, _, y in spans)]
            near = [i for i, (_, b) in enumerate(terms) if b <= start][-pd_.NEAR :] + [i for i, (a, _) in enumerate(terms) if a >= end][: pd_.NEAR]
            for i in near:
                if (e, terms[i][0]) in seen:
                    continue
                seen.add((e, terms[i][0]))
                word = lambda j: text[slice(*terms[j])].translate(pd_._FOLD)  # noqa: E731, B023
                n[e, word(i)] += 1
                places[e, word(i)].add(tuple(word(j) for j in range(max(0, i - pd_.AROUND), min(len(terms), i + pd_.AROUND + 1))))
    return n, {k: len(v) for k, v in places.items()}


def brute_disclosing(rows, threshold, support):
    n, places = brute_near(rows)
    count = Counter(t for text in rows for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))
    total, size = sum(count.values()), Counter()
    for (e, _), k in n.items():
        size[e] += k
    def told(e, k, c):
        own = math.log(total / size[e])
        return math.log(k * total / (size[e] * c)) / own if own > 0 else -1

    out = {}
    for (e, t), k in n.items():
        if places[e, t] < support or told(e, k, count[t]) < threshold:
            continue
        safe = False
        if len(t) > 3:
            same = [x for x in count if len(x) > 3 and x[:3] == t[:3]]
            safe = told(e, sum(v for (f, x), v in n.items() if f == e and len(x) > 3 and x[:3] == t[:3]), sum(count[x] for x in same)) < threshold
        d, before = out.get(t, (-1, True))
        out[t] = max(d, told(e, k, count[t])), before and safe
    return {t: (round(d, 9), t[:3] + "*" if safe else None) for t, (d, safe) in out.items()}


def private_texts():
    r = random.Random(8)
    plain = [f"w{''.join(r.choice('abcdefghij') for _ in range(3))}" for _ in range(150)]
    rows = []
    for i in range(300):
        words = r.choices(plain, k=r.randint(5, 40))
        if i % 6 == 0:
            # the boatman stands near one address only, stationmaster words also elsewhere
            words[r.randrange(len(words)) : 0] = ["boatman", r.choice(["kai@dock.org", "KAI@dock.org"]), "stationmaster"]
        if i % 6 == 1:
            words.insert(0, r.choice(["stationery", "stationing", "+1 (555) 010-9999"]))
        rows.append(" ".join(words))
    copies = ["lone zebraword near 10.0.0.1 here"] * 40
    return rows + copies + [None, "", "boatman alone", "É" * 50 + " kai@dock.org " + "Boatman"]


@pytest.mark.parametrize(("threshold", "support"), [(0.9, 3), (0.5, 2), (0.0, 1)])
def test_disclosing_terms_against_brute_force(spark, threshold, support):
    from arborlake.llm import personal_data

    rows = private_texts()
    table = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {r["term"]: (round(r["disclosure"], 9), r["form"]) for r in personal_data.disclosing(table, threshold, support).collect()}
    want = brute_disclosing(rows, threshold, support)
    assert got == want
    if threshold == 0.9:
        assert set(got) >= {"boatman"} and "zebraword" not in got


def test_spans_against_brute_force(spark, docs, edge):
    from arborlake.llm import personal_data

    texts = [(i, t) for i, t in enumerate(private_texts())]
    for table, threshold in ((docs.select("doc_id", "text"), 0.9), (edge, 0.9), (spark.createDataFrame(texts, "doc_id long, text string"), 0.9)):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        terms = brute_disclosing([t for _, t in rows], threshold, 3)
        want = Counter()
        for doc, text in rows:
            text = text or ""
            base = brute_find(text)
            more = [(m.start(), 4, m.end()) for m in re.finditer(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text) if m.group().translate(personal_data._FOLD) in terms and not any(m.start() < b and a < m.end() for a, _, b in base)]
            name = lambda s: ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in sorted(s))
            want[doc, *(sum(k == i for _, k, _ in base) for i in range(4)), hashlib.sha256(name(base).encode()).hexdigest(), name(base + more)] += 1
        assert tuples(personal_data.query(table)) == want
    assert personal_data.query(edge.where("false")).collect() == []


def test_sanitised_texts(spark, edge):
    from arborlake.llm import personal_data

    rows = private_texts()
    table = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").selectExpr("*", "'x' AS spans", "1 AS _hits2")
    out = personal_data.sanitise(table)
    assert out.columns == table.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[len(rows) - 4] is None and texts[len(rows) - 3] == "" and "boatman" not in texts[len(rows) - 2]
    assert all("kai@" not in (t or "").lower() and "10.0.0.1" not in (t or "") for t in texts.values())
    assert texts[300] == "lone zebraword near [IP] here"
    assert personal_data.sanitise(edge).count() == len(EDGE)


def test_a_filter_that_passes_everything_changes_nothing(spark, monkeypatch):
    from arborlake.llm import personal_data

    table = spark.createDataFrame([(i, t) for i, t in enumerate(private_texts())], "doc_id long, text string")
    want = tuples(personal_data.query(table))
    monkeypatch.setattr(personal_data, "LEAST_SLOTS", 1)
    monkeypatch.setattr(personal_data, "MOST_SLOTS", 1)
    assert tuples(personal_data.query(table)) == want
