"""Operators against brute force on small tables, with the edge cases their docstrings define."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [r.asDict() for r in docs.collect()]


EDGE = [
    (1, "the MIT License and the mit license", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "", "de", "b"), (5, " \t\n", "fr", None),
    (6, "x", "en", "a"), (7, "the cat sat on the mat and then the cat sat on the mat again " * 900, "en", "a"), (8, "the cat sat on the mat and then the cat sat on the mat again " * 900, "en", "a"),
    (9, "Straße CAFÉ café ﬁne", "de", "b"), (10, "strasse café café  fine", "de", "b"), (11, "123 456 !!", "en", "c"), (12, "x", "en", "d"),
    (12, "x", "en", "d"), (-3, "éè 中文 \U0001f600", "fr", "é"), (14, "gnu general public license version 2 or later", None, "z"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string").selectExpr(
        "*", "1 AS n_tokens", "'q' AS name", "2 AS size", "3 AS fp", "4 AS blocks", "'k' AS key", "5 AS start", "6 AS hash", "7 AS score", "8 AS shard"
    )


@pytest.fixture(scope="module")
def nothing(edge):
    return edge.where("false")


def brute_mix(rows):
    sizes = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in rows]
    by = defaultdict(list)
    for doc, source, size in sizes:
        by[source].append((int(hashlib.md5(str(doc).encode()).hexdigest()[:15], 16), doc, size))
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = {s: sum(x[2] for x in by[s]) for s in order}
    left, target, open_ = 1.5 * sum(total.values()), {}, set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
        open_ -= over
    return {s: (total[s], target[s]) for s in order}, weight


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_mixing(which, request):
    from arborlake.llm import mixing

    table = request.getfixturevalue(which)
    rows = [r.asDict() for r in table.collect()]
    expected, _ = brute_mix(rows)
    got = [r.asDict() for r in mixing.query(table).collect()]
    assert len(got) == len(rows)
    source = {r["doc_id"]: r["source"] for r in rows}
    taken, largest = Counter(), Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == expected[s][0]
        assert r["target"] == pytest.approx(expected[s][1])
        assert r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s, (_, target) in expected.items():
        assert abs(taken[s] - target) <= largest[s] / 2 + 1e-6
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in mixing.query(table).collect())


def test_mix_is_in_training_order(docs):
    from arborlake.llm import mixing

    plan = {r["doc_id"]: r for r in mixing.plan(docs).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    ids = [r["doc_id"] for r in mixed.collect()]
    assert Counter(ids) == Counter({d: len(r["positions"]) for d, r in plan.items() if r["positions"]})
    seen, last = Counter(), -1.0
    for d in ids:
        position = plan[d]["positions"][seen[d]]
        seen[d] += 1
        assert last <= position <= 1
        last = position


def test_schedule_moves_sources(spark):
    from arborlake.llm import mixing

    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "'one two three' AS text")
    plan = mixing.plan(docs).where("source = 's0'").select(F.explode("positions").alias("p"))
    early, late = plan.where("p < 0.5").count(), plan.where("p >= 0.5").count()
    # a schedule from 1.5 to 0.5 asks for 5/8 of its tokens in the first half
    assert early / (early + late) == pytest.approx(0.625, abs=0.01)


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_exact_dedup(which, request):
    from arborlake.llm import exact_dedup

    table = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"] or "") for r in table.collect()]
    by = defaultdict(list)
    for doc, text in rows:
        by[text].append(doc)
    expected = sorted((d, max(by[t]), len(by[t]), d == max(by[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows)
    for block in (16, 16_384):
        got = sorted(tuple(r) for r in exact_dedup.groups(table, block_bytes=block, salts=3).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
        assert got == expected
    kept = exact_dedup.dedup(table)
    assert kept.columns == table.columns
    assert sorted(r["text"] or "" for r in kept.select("text").distinct().collect()) == sorted(by)


def test_exact_dedup_null_ids(spark):
    from arborlake.llm import exact_dedup

    table = spark.createDataFrame([(None, "a"), (None, "b"), (1, "a"), (None, "c")], "doc_id long, text string")
    got = {(r["doc_id"], r["text_sha256"][:4], r["keep_id"], r["group_size"]) for r in exact_dedup.groups(table).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:4]
    assert got == {(None, sha("a"), 1, 2), (1, sha("a"), 1, 2), (None, sha("b"), None, 1), (None, sha("c"), None, 1)}


def brute_simhash(text):
    import xxhash

    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


@pytest.mark.parametrize("blocks", [5, 3, 2])
@pytest.mark.parametrize("which", ["docs", "edge"])
def test_simhash(which, blocks, request):
    from arborlake.llm import simhash

    table = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    fps = [(d, brute_simhash(t)) for d, t in rows]
    root = {d: d for d, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, f) in enumerate(fps):
        for b, g in fps[:i]:
            if (f ^ g).bit_count() <= 4 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.components(table, blocks=blocks).collect())
    assert got == sorted((d, f"{f:016x}", find(d)) for d, f in fps)


def test_simhash_dense_and_chained_groups(spark):
    """A chain of close fingerprints and a dense cloud, through the search alone."""
    import numpy as np

    from arborlake.llm import simhash
    from arborlake.llm.components import connected_components

    rng = np.random.default_rng(5)
    chain = [0x0123456789ABCDEF]
    for i in range(20):
        chain.append(chain[-1] ^ (0b1111 << (3 * i)))
    center = int(rng.integers(1 << 63))
    cloud = {center ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 4)), replace=False)) for _ in range(600)}
    noise = {int(x) for x in rng.integers(1 << 63, size=500)}
    fps = sorted(set(chain) | cloud | noise)
    frame = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "id long, fp long")
    for blocks in (5, 3, 1):
        got = {r["node"]: r["component"] for r in connected_components(simhash.shard_links(frame, blocks=blocks)).collect()}
        root = list(range(len(fps)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        values = np.array(fps, np.uint64)
        for i in range(len(fps)):
            for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 4).tolist():
                a, b = sorted((find(i), find(j)))
                root[b] = a
        assert [got.get(i, i) for i in range(len(fps))] == [find(i) for i in range(len(fps))]


def test_vantage_trees_keep_links_together():
    import numpy as np

    from arborlake.llm import simhash

    rng = np.random.default_rng(1)
    a = rng.integers(1 << 63, size=300).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    for blocks in (1, 2, 3, 4, 5):
        met = np.zeros(len(a), bool)
        for tree in simhash.trees(blocks=blocks, depth=6):
            ai, al, ah = tree.leaves(a)
            bi, bl, _ = tree.leaves(b)
            assert sorted(ai[ah]) == list(range(len(a)))
            homes = dict(zip(ai[ah].tolist(), al[ah].tolist(), strict=True))
            for i, leaf in zip(bi.tolist(), bl.tolist(), strict=True):
                met[i] |= homes[i] == leaf
        assert met.all()


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_token_counts(which, request):
    import public_tokenizers
    import sentencepiece

    from arborlake.llm import token_counts

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = request.getfixturevalue(which)
    expected = sorted((r["doc_id"], len((r["text"] or "").encode()), len(n := model.encode(r["text"] or "")), len(n) > 4096) for r in table.collect())
    assert sorted(tuple(r) for r in token_counts.count_tokens(table).collect()) == expected


def test_token_counts_on_odd_words():
    import random

    import public_tokenizers
    import sentencepiece

    from arborlake.llm.token_counts import Merger

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, merger, r = sentencepiece.SentencePieceProcessor(model_file=path), Merger(path), random.Random(3)
    texts = ["".join(r.choice("ab ▁\n\té中\U0001f600<s>0a'.é-ththeonion  　") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(r.choice("▁etaoinshrlu") for _ in range(r.randint(100, 400))) for _ in range(200)]
    texts += ["a" * 5000, "theonion" * 300, " " * 77 + "x", "<s></s><unk><0x0A>", "\x00"]
    assert merger.count(texts) == [len(x) for x in model.encode(texts)]


def test_language_id(docs, edge, nothing):
    from arborlake.llm import language_id

    got = {r["doc_id"]: r for r in language_id.query(docs).collect()}
    for r in docs.collect():
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= g["score"] <= 1
    held = [r for r in docs.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(edge, model).collect()}
    assert {d for d, lang in found.items() if lang == "und"} == {2, 3, 4, 5, 11}
    assert {r["lang_pred"] for r in language_id.query(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.query(nothing).collect() == []


def test_language_masks_hold_all_languages_of_an_ngram():
    import numpy as np

    from arborlake.llm import language_id

    names = [f"l{i:02d}" for i in range(11)]
    rng = np.random.default_rng(2)
    rows = [(int(k), sorted(set(rng.integers(0, 11, 3).tolist()))) for k in rng.integers(1 << 40, size=4000)]
    keys, which = np.array([k for k, w in rows for _ in w], np.uint64), np.array([i for _, w in rows for i in w])
    model = language_id.build(names, 0, keys, which)
    masks = model.lookup(np.array([r[0] for r in rows], np.uint64))
    for mask, (_, which) in zip(masks, rows, strict=True):
        assert all(mask[i >> 3] >> (i & 7) & 1 for i in which)
    fresh = model.lookup(rng.integers(1 << 41, 1 << 42, size=20_000).astype(np.uint64))
    rate = np.array([(fresh[:, i >> 3] >> (i & 7) & 1).mean() for i in range(11)])
    assert np.allclose(rate, model.false_rate, atol=0.01)


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_license_scan(which, request):
    from arborlake.llm import license_scan

    table = request.getfixturevalue(which)
    got = defaultdict(set)
    for r in license_scan.scan(table).collect():
        got[r["doc_id"]].add(tuple(r))
    for r in table.collect():
        words = re.findall(license_scan.WORD, lower(r["text"]))
        places = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        (row,) = got[r["doc_id"]]
        assert row[1:6] == (
            len(words), len(places), min((p[0] for p in places), default=None), max((p[0] for p in places), default=None), ",".join(sorted({p[1] for p in places})),
        )
        assert set(filter(None, row[5].split(","))) <= set(filter(None, row[6].split(",")))
        assert 0 <= row[7] <= 1


def test_license_rules(spark):
    from arborlake.llm import license_scan

    assert len(license_scan.rules()) >= 200
    cases = {
        "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "cc by, cc-by cc-by-sa 4.0": "cc-by,cc-by-sa-4.0",
        "GNU General Public License, version 3 or later": "gpl,gpl-3.0", "the admit license": "", "mit license mit license": "mit", "GNU Lesser General Public License v2.1": "lgpl-2.1",
        "gnué general public license": "", "the unlicense": "unlicense", "CC0 1.0": "cc0-1.0", "MIT no attribution": "mit-0", "in the public domain": "public-domain", "the accby bacc by": "",
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(rows).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def brute_licenses(words):
    """Detections (start, stop, label, priority): at each place the first rule of each keyword, then suppression."""
    from arborlake.llm import license_scan

    first = {}
    for keyword, pattern, label, priority, _ in license_scan.rules():
        if keyword in words:
            for m in re.finditer(f"(?={pattern[:-5]}(?= ))", words):
                stop = re.compile(pattern).match(words, m.start()).end()
                first.setdefault((keyword, m.start()), (m.start(), stop, label, priority))
    spans = set(first.values())
    out = set()
    for s in spans:
        inside = [o for o in spans if o != s and o[0] <= s[0] and o[1] >= s[1]]
        if not any((o[0], o[1]) != (s[0], s[1]) or (-o[3], o[2]) < (-s[3], s[2]) for o in inside):
            out.add(s)
    return out


def a_match(parsed, r):
    """A random text that a parsed regex matches."""
    out = ""
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(value)
        elif name == "NOT_LITERAL":
            out += "z"
        elif name == "IN":
            kind, x = r.choice(value)
            out += chr(x) if str(kind) == "LITERAL" else chr(r.randint(*x))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = value
            out += "".join(a_match(inner, r) for _ in range(r.randint(low, min(int(high), low + 3))))
        elif name == "SUBPATTERN":
            out += a_match(value[3], r)
        elif name == "BRANCH":
            out += a_match(r.choice(value[1]), r)
        else:
            raise ValueError(name)
    return out


def test_license_rules_against_brute_force(spark):
    """Texts made from every rule, alone and in pairs that overlap; every rule is reached by some of its own."""
    import random
    from re import _parser

    from arborlake.llm import license_scan
    from arborlake.llm.license_rules import GROUPS

    r, texts, wins = random.Random(5), [], []
    for keyword, group in GROUPS:
        for i, (label, priority, _, regex) in enumerate(group):
            made = [a_match(_parser.parse(regex), r) for _ in range(12)]
            assert all(keyword in f" {t} " for t in made), regex
            # no earlier rule of the keyword takes all of its texts
            wins.append(any(not any(re.match(f"(?:{g[3]})(?= )", t + " ") for g in group[:i]) for t in made))
            assert wins[-1], regex
            texts += [made[0], made[1].upper().replace(" ", ", "), f"the {made[2]} and {r.choice(texts or ['x'])}"]
    texts += ["Released under the MIT License. See the Apache License, Version 2.0 or CC BY-NC-SA 4.0; GNU General Public License v3 or any later version. " * 3, "spdx license identifier mit mit license " * 5]
    assert len(wins) >= 300 and len({rule[1] for rule in license_scan.rules()}) == len(wins)
    words = [" " + " ".join(re.findall(license_scan.WORD, lower(t))) + " " for t in texts]
    rows = spark.createDataFrame(list(enumerate(words)), "doc_id long, words string")
    got = defaultdict(set)
    for x in license_scan.detections(rows, ("doc_id",)).collect():
        got[x["doc_id"]].add((x["start"], x["stop"], x["label"], x["priority"]))
    expected = [brute_licenses(w) for w in words]
    assert [got[i] for i in range(len(words))] == expected
    # the gate lets each of them through
    found = {x["doc_id"]: x for x in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, spans in enumerate(expected):
        assert set(found[i]["labels"].split(",")) == {s[2] for s in spans} | set(filter(None, found[i]["base_labels"].split(","))), texts[i]


def test_license_texts_are_recognised(spark):
    """The opening of real license texts and the usual short forms."""
    from arborlake.llm import license_scan

    cases = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction": "mit",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain": "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: (...) Neither the name of the copyright holder": "bsd-3-clause",
        "GPLv3": "gpl-3.0", "GPL v2": "gpl-2.0", "LGPL 2.1": "lgpl-2.1", "Apache-2.0": "apache-2.0", "MIT licensed": "mit", "AGPL-3.0": "agpl-3.0", "MPL 2.0": "mpl-2.0", "BSD-3-Clause": "bsd-3-clause",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl,gpl-3.0",
        "# * permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
        "This is free and unencumbered software released into the public domain.": "unlicense", "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa-4.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0", "we limit licenses and permit apache helicopters in commons": "",
        "The Software shall be used for Good, not Evil.": "json", "Distributed under the Boost Software License, Version 1.0.": "boost-1.0",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.": "zlib",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {x["doc_id"]: x["labels"] for x in license_scan.scan(rows).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def brute_canonical(text):
    import unicodedata

    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text.lower()).casefold())
    return re.sub(r"\s+", " ", folded).strip()


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_fingerprints(which, request):
    from arborlake.llm import fingerprints

    table = request.getfixturevalue(which)
    rows = sorted({(r["doc_id"], r["text"] or "") for r in table.collect()})
    got = {r["doc_id"]: r for r in fingerprints.query(table).collect()}
    assert fingerprints.query(table).count() == table.count()
    by = defaultdict(set)
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        g = got[doc]
        assert g["n_chars"] == len(text)
        assert g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert g["near_edited"] == float(brute_canonical(text) == brute_canonical(edited))
        assert g["near_next"] == float(brute_canonical(text) == brute_canonical(after[1]))
        assert (g["edited_fingerprint"] == g["fingerprint"]) == bool(g["near_edited"])
        by[brute_canonical(text)].add(g["fingerprint"])
    assert all(len(x) == 1 for x in by.values())
    assert len({min(x) for x in by.values()}) == len(by)


def test_bucket_collisions_are_told_apart(spark):
    from arborlake.llm import fingerprints
    from arborlake.session import checkpoint

    keyed = spark.createDataFrame([(1, "a"), (2, "A "), (3, "b"), (4, "c")], "key long, text string")
    assert fingerprints.odd_ones(keyed, fingerprints.duplicates(fingerprints.buckets(keyed))).collect() == []
    # texts that share a bucket by force: 3 is the first, 4 differs from it
    forced = fingerprints.buckets(keyed).where("key >= 3").withColumn("bucket", F.lit("0" * 32))
    odd = fingerprints.odd_ones(keyed, checkpoint(fingerprints.duplicates(forced))).collect()
    assert [(r["key"], r["own"]) for r in odd] == [(4, "0" * 32 + "-" + hashlib.sha256(b"c").hexdigest())]


def test_sharding(edge, nothing):
    from arborlake.llm import sharding

    names = [f"s{i}" for i in range(7)]
    table = sharding.fill_table(names, 997)
    # turn by turn, from whole permutations
    order = [[(sharding._number(f"offset:{n}") + j * (sharding._number(f"stride:{n}") % 996 + 1)) % 997 for j in range(997)] for n in names]
    owner = {}
    while len(owner) < 997:
        for i in range(7):
            slot = next((s for s in order[i] if s not in owner), None)
            if slot is not None:
                owner[slot] = i
    assert table == [owner[i] for i in range(997)]
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.fill_table(names[:-1], 997)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 0.2 * 997
    got = sharding.assign(edge, names, 997).collect()
    assert len(got) == edge.count()
    assert all(r["shard"] == table[r["slot"]] and r["slot"] == sharding._number(str(r["doc_id"])) % 997 for r in got)
    assert sharding.assign(nothing, names, 997).collect() == []


def test_write_shards(edge, tmp_path):
    from arborlake.llm import sharding

    names = ["a", "b", "c"]
    sharding.write_shards(edge.drop("shard"), str(tmp_path / "out"), names, 101)
    back = edge.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == edge.count()
    assert {(r["doc_id"], r["shard"]) for r in back.collect()} == {(r["doc_id"], r["shard"]) for r in sharding.assign(edge, names, 101).collect()}


def test_empty_tables(nothing):
    from arborlake.llm import registry

    from arborlake.llm import exact_dedup, fingerprints, license_scan, mixing, simhash, token_counts

    for operator in (exact_dedup.groups, fingerprints.query, license_scan.scan, mixing.query, simhash.components, token_counts.count_tokens, mixing.mix, exact_dedup.dedup, simhash.dedup):
        assert operator(nothing).collect() == []
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_components(spark):
    from arborlake.llm.components import connected_components

    edges = [(i, i + 1) for i in range(50)] + [(100, j) for j in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{j: 100 for j in range(100, 160)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_viterbi(word, scores, ids, byte_ids):
    """Best segmentation of one word, from scratch."""
    from arborlake.llm.sentencepiece_codec import BYTE_SCORE

    best = [(0.0, ())]
    for end in range(1, len(word) + 1):
        options = []
        for begin in range(end - 1, -1, -1):
            piece = word[begin:end]
            if piece in scores:
                options.append((best[begin][0] + scores[piece], best[begin][1] + (ids[piece],)))
            elif begin == end - 1:
                raw = piece.encode()
                options.append((best[begin][0] + BYTE_SCORE * len(raw), best[begin][1] + tuple(byte_ids[b] for b in raw)))
        best.append(max(options, key=lambda o: o[0]))
    return best[-1][1]


def test_sentencepiece_is_optimal_and_round_trips(docs, edge):
    import public_tokenizers
    import sentencepiece

    from arborlake.llm import sentencepiece_codec
    from arborlake.llm.pieces import marked_words, vocabulary

    path = public_tokenizers.path("piece_bpe_32k.model")
    vocab, scores, model = vocabulary(path), sentencepiece_codec.scores(path), sentencepiece.SentencePieceProcessor(model_file=path)
    memo = {}

    def brute(text):
        out = []
        for w in marked_words(text):
            if w not in memo:
                memo[w] = brute_viterbi(w, scores, vocab.ids, vocab.byte_ids)
            out += memo[w]
        return out

    for table in (docs.limit(60), edge):
        text = {r["doc_id"]: r["text"] for r in table.collect()}
        for r in sentencepiece_codec.query(table).collect():
            assert r["round_trip"]
            if text[r["doc_id"]] is None:
                assert r["ids"] is None and r["n_tokens"] == 0
                continue
            assert r["n_tokens"] == len(r["ids"])
            assert model.decode(r["ids"]) == text[r["doc_id"]]
            if len(text[r["doc_id"]]) < 20_000:
                assert r["ids"] == brute(text[r["doc_id"]])


def test_sentencepiece_odd_texts(spark):
    import random

    from arborlake.llm import sentencepiece_codec

    r = random.Random(4)
    texts = ["".join(r.choice("ab  \n\té中\U0001f600<s>0a'.é▁x") for _ in range(r.randint(0, 50))) for _ in range(300)] + ["z" * 3000, " " * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sentencepiece_codec.query(rows).collect()
    assert len(got) == len(texts) and all(x["round_trip"] == ("▁" not in texts[x["doc_id"]]) for x in got)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(rows, ("text",))).collect()
    assert all(x["decoded"] == x["text"].replace("▁", " ") for x in back)
    assert sentencepiece_codec.decode(spark.createDataFrame([([3 + 0xFF],)], "ids array<int>")).first()["decoded"] is None


def test_pipeline(spark, tmp_path, docs, edge):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]
    for at, table in (("docs", docs), ("edge", edge.select("doc_id", "text", "lang", "source"))):
        table.write.parquet(str(tmp_path / at / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / at)).collect()
        texts = {r["doc_id"]: r["text"] for r in table.collect()}
        kept = {r["doc_id"] for r in out}
        assert kept and all(r["text"] == texts[r["doc_id"]] for r in out)
        # no two of what is left are linked, and each dropped text has a copy or a reason
        prints = {d: brute_simhash(texts[d]) for d in kept}
        assert all((prints[a] ^ prints[b]).bit_count() > 4 for a in prints for b in prints if a < b)
        for before, (name, stage) in zip([table, None, None, None], corpus_pipeline.STAGES[:3], strict=False):
            assert stage(spark, table, "").columns == table.columns
    clash = edge.withColumns({"ids": F.lit(1), "lang_pred": F.lit("x")})
    assert corpus_pipeline.identify_language(spark, clash, "").columns == clash.columns
    assert corpus_pipeline.encode_pieces(spark, clash, "").columns == [*clash.columns, "_ids"]
    assert corpus_pipeline.encode_pieces(spark, clash, "").count() == clash.count()
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == []


def brute_cut(rows):
    """Every 50-byte string by the smallest document that has it."""
    seen, out = {}, defaultdict(set)
    for doc, text in sorted(rows, key=lambda r: r[0]):
        for i in range(len(text) - 49):
            seen.setdefault(text[i : i + 50], doc)
    for doc, text in rows:
        gone, last = bytearray(len(text)), 0
        for i in range(len(text) - 49):
            if seen[text[i : i + 50]] < doc:
                for j in range(max(i, last), i + 50):
                    gone[j] = 1
                last = i + 50
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[doc].add((len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_substring_dedup(which, request):
    from arborlake.llm import substring_dedup

    table = request.getfixturevalue(which)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in table.collect()]
    expected = brute_cut(rows)
    got = substring_dedup.cut(table, 60_000, 3).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:5] in expected[r["doc_id"]]
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]


def test_substring_dedup_hard_texts(spark):
    """Periodic, short-alphabet and zero bytes, overlapping copies, repeated doc_ids and a null one."""
    import random

    from arborlake.llm import substring_dedup

    r = random.Random(11)
    words = ["".join(r.choice("ab") for _ in range(r.randint(1, 4))) for _ in range(12)]
    pool = [" ".join(r.choice(words) for _ in range(40)) for _ in range(6)]
    texts = ["a" * 120, "a" * 49, "a" * 50, "ab" * 70, "ba" * 60, "\x00" * 130, "é" * 60, "é" * 25, ""] + ["".join(r.choice(pool)[r.randint(0, 20) :] for _ in range(4)) for _ in range(60)]
    rows = [(i * 3 % 71 if i % 9 else i, t) for i, t in enumerate(texts)]
    rows += [(500, pool[0] + "x" * 60), (500, pool[1] + "y" * 60), (501, "x" * 80), (501, "x" * 80)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_cut([(d, t.encode()) for d, t in rows])
    for chars, hot in ((700, 32), (10**9, 32), (700, 2), (3000, 4), (10**9, 2)):
        got = substring_dedup.query(table, chars, hot).collect()
        assert len(got) == len(rows)
        assert all(tuple(x)[1:5] in expected[x["doc_id"]] for x in got), (chars, hot)
    with_null = spark.createDataFrame([(None, "q" * 60), (1, "q" * 60)], "doc_id long, text string")
    assert sorted((x["doc_id"] or 0, x["n_removed"]) for x in substring_dedup.query(with_null).collect()) == [(0, 0), (1, 60)]
    assert substring_dedup.query(table.where("false")).collect() == []


def test_loser_tree():
    import random

    from arborlake.llm.substring_dedup import loser_tree_merge

    r = random.Random(1)
    for _ in range(200):
        runs = []
        for _ in range(r.randint(1, 9)):
            strings = sorted(bytes(r.choice(b"ab\x00") for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 12)))
            lcps = [0] * min(1, len(strings))
            for a, b in zip(strings, strings[1:], strict=False):
                lcps.append(next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b))))
            runs.append((lcps, strings))
        which, index, lcp = loser_tree_merge(runs)
        merged = [runs[w][1][i] for w, i in zip(which, index, strict=True)]
        assert merged == sorted(s for _, x in runs for s in x)
        for a, b, n in zip(merged, merged[1:], lcp[1:], strict=False):
            assert n == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
