"""Clashing names, repeated and null ids, odd characters and very long texts in the ten operators."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_a_letter_is_a_letter_category():
    from arborlake.llm import language_id

    keys = np.concatenate(list(language_id.grams("the cat sat on the mat")))
    model = language_id.build(["en"], 0, keys, np.zeros(len(keys), np.int64))
    for text in ("½ ² ¾", "① Ⅷ", "123", "", None, " ", "_", "€"):
        assert model.decide(text) == ("und", 0.0) and model.evident(text) == "und"
    assert model.decide("the cat")[0] == "en" and model.decide("ª")[0] == "en"


def test_language_id_against_brute_force(spark):
    """The kept n-grams, the filter's answers, the correction and the decision, all recomputed."""
    from arborlake.llm import language_id as li

    r = random.Random(3)
    words = {"x": "der hund und die katze sind im haus".split(), "y": "the dog and the cat are in a house".split(), "z": "le chien et le chat dans une maison".split()}
    rows = [(i, " ".join(r.choices(words[k], k=r.randint(1, 40))), k) for i in range(120) for k in [r.choice("xyz")]] + [(200, None, "x"), (201, "", "y"), (202, "nothing", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(table, min_rate=1e-3)

    def grams(text):
        raw = f" {text.lower()} ".encode()
        return [int.from_bytes(raw[i : i + li.N], "big") for i in range(len(raw) - li.N + 1)]

    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        if text is not None and lang is not None:
            counts[lang].update(grams(text))
            totals[lang] += len(grams(text))
    assert model.languages == sorted(counts)
    rates = {lang: {g: n / totals[lang] for g, n in c.items() if n > 1 and n / totals[lang] >= 1e-3} for lang, c in counts.items()}
    kept = {lang: {g for g, v in c.items() if v >= li.RELATIVE * max(o.get(g, 0) for o in rates.values())} for lang, c in rates.items()}
    size = len(model.slots)
    bits = size.bit_length() - 1

    def slots(g):
        return [(g * m % 2**64) >> (64 - bits) for m in li._MULTIPLIERS[: li.HASHES]]

    filled = {lang: {s for g in grams_ for s in slots(g)} for lang, grams_ in kept.items()}
    for _, text, _ in [*rows, (0, "the hund et zzz", None), (0, "qqqq wwww", None)]:
        if not text or not any(c.isalpha() for c in text):
            assert model.decide(text) == ("und", 0.0)
            continue
        found = grams(text)
        corrected = []
        for lang in model.languages:
            rate = (len(filled[lang]) / size) ** li.HASHES
            hits = sum(all(s in filled[lang] for s in slots(g)) for g in found)
            corrected.append(max(hits - len(found) * rate, 0) / (1 - rate))
        lang, score = model.decide(text)
        if sum(corrected) <= 0:
            assert score == 0.0
        else:
            assert lang == model.languages[int(np.argmax(corrected))] and score == pytest.approx(max(corrected) / sum(corrected))


def test_any_number_of_languages(spark):
    from arborlake.llm import language_id

    names = [f"l{i:04d}" for i in range(1300)]
    rows = [(i, f"{n} {n} {n[::-1]} word{i} word{i}", n) for i, n in enumerate(names)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.slots.nbytes <= 2 * language_id.MAX_BYTES and model.languages == names
    assert sum(model.decide(t)[0] == n for _, t, n in rows[::50]) >= 24


def test_round_trip_is_exact(spark):
    from arborlake.llm import sentencepiece_codec as sp

    rows = [(1, "a▁b"), (2, "a b"), (3, None), (4, ""), (5, "  x \n y "), (6, "中文 text"), (7, "▁")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["round_trip"] for r in sp.query(table).collect()} == {1: False, 2: True, 3: True, 4: True, 5: True, 6: True, 7: False}
    assert sp.query(table.where("false")).collect() == []
    back = sp.decode(sp.encode(table).withColumn("decoded", F.lit(1)))
    assert back.columns == ["doc_id", "ids", "decoded", "_decoded"]
    assert {r["doc_id"]: r["_decoded"] for r in back.collect()}[1] == "a b"
    assert sp.encode(table.withColumn("ids", F.lit("q")), ("doc_id", "ids")).columns == ["doc_id", "ids", "_ids"]


def test_pieces_of_a_long_text_are_its_words():
    from arborlake.llm.pieces import marked_words, pieces_of

    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("ab  \n▁é") for _ in range(r.randint(0, 60)))
        for size in (1, 2, 7, 1000):
            assert sum(pieces_of(text, size), []) == marked_words(text)


def test_token_counts_of_words_without_spaces():
    import public_tokenizers
    import sentencepiece

    from arborlake.llm.token_counts import Merger

    path, r = public_tokenizers.path("piece_bpe_32k.model"), random.Random(4)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(r.choice(letters) for _ in range(30_000)), "the" * 9000, "ab" * 5001, "a" * 10_001, "".join(r.choice(letters + letters.upper() + "0123456789+/") for _ in range(20_000))]
    texts += ["".join(chr(r.randint(0x4E00, 0x5FFF)) for _ in range(3000)), "word " * 300_000 + "end", "x\n" * 1000]
    texts += ["".join(r.choice("aeinrst") for _ in range(r.randint(1, 80))) for _ in range(2000)]
    assert Merger(path).count(texts) == [len(model.encode(t)) for t in texts]


def test_shingles_of_a_long_text_do_not_depend_on_pieces(monkeypatch):
    from arborlake.llm import simhash

    r = random.Random(2)
    for _ in range(100):
        text = "".join(r.choice(["a", "bb", "c", " ", "  ", "\t", "D"]) for _ in range(r.randint(0, 80)))
        monkeypatch.setattr(simhash.words_of, "__defaults__", (4_000_000,))
        whole = [h for part in simhash.shingle_hashes(text, 4) for h in part.tolist()]
        for size in (1, 3, 10):
            monkeypatch.setattr(simhash.words_of, "__defaults__", (size,))
            assert [h for part in simhash.shingle_hashes(text, 4) for h in part.tolist()] == whole


def test_leaves_hold_every_value_within_the_radius():
    """Exactly the leaves that some value of the query's ball lies in, and no others at radius 1."""
    from arborlake.llm import simhash

    rng = np.random.default_rng(4)
    fps = rng.integers(1 << 63, size=50).astype(np.uint64) * np.uint64(2)
    for tree in simhash.trees(4, 3, depth=12):
        index, leaf, home = tree.leaves(fps)
        got = defaultdict(set)
        for i, x in zip(index.tolist(), leaf.tolist(), strict=True):
            assert x not in got[i]
            got[i].add(x)
        homes = dict(zip(index[home].tolist(), leaf[home].tolist(), strict=True))
        for i, fp in enumerate(fps.tolist()):
            around = [fp, *(fp ^ 1 << b for b in range(64) if tree.mask << tree.low >> b & 1)]
            k, own, at = tree.leaves(np.array(around, np.uint64))
            lives = dict(zip(k[at].tolist(), own[at].tolist(), strict=True))
            assert got[i] == set(lives.values()) and homes[i] == lives[0]


def clashing(df):
    return df.withColumns({n: F.lit(i) for i, n in enumerate(("_dropped_id", "_sha", "_mix_id", "_position", "position", "positions", "mark", "one", "two", "at", "all", "share", "shares", "id", "kept", "n", "group", "shard", "_mark", "fp", "source_key", "size", "row"))})


def test_stages_on_clashing_names(spark):
    import corpus_pipeline

    rows = [(i, f"the quick brown fox number {i // 2} jumps over the lazy dog near the river bank today", "en", "ab"[i % 2]) for i in range(40)]
    table = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    from arborlake.llm import simhash

    assert simhash.dedup(table).columns == table.columns
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, table, "")
        assert out.columns == table.columns
        assert all(r["_position"] == 3 and r["shard"] == 17 for r in out.collect())


def test_write_shards_keeps_a_column_named_shard(spark, tmp_path):
    from arborlake.llm import sharding

    table = spark.createDataFrame([(i % 5, f"t{i}", 100 + i, {"a": i}) for i in range(50)], "doc_id long, text string, shard long, m map<string,int>")
    sharding.write_shards(table, str(tmp_path / "out"), ["a", "b", "c"], 101)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["shard"] for r in back.collect()) == list(range(100, 150)) and "_shard" in back.columns


def test_dedup_by_row(spark):
    """Repeated and null ids lose no text and keep no copy."""
    from arborlake.llm import exact_dedup, near_copies, simhash

    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine"
    rows = [(0, a), (1, a), (1, b), (1, b), (None, "null id text is here and it has words"), (None, "null id text is here and it has words")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for dedup in (simhash.dedup, near_copies.dedup):
        assert sorted((r["doc_id"], r["text"]) for r in dedup(table).collect() if r["doc_id"] is not None) == [(0, a), (1, b)]
        assert dedup(table).where("doc_id IS NULL").count() == 2
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.dedup(table).collect() if r["doc_id"] is not None) == [(1, a), (1, b)]
    assert exact_dedup.dedup(table).where("doc_id IS NULL").count() == 1
    again = table.unionByName(table).unionByName(spark.createDataFrame([(3, None), (2, ""), (3, "")], "doc_id long, text string"))
    assert exact_dedup.dedup(again).count() == 4


def test_mix_by_row(spark, monkeypatch):
    """Rows that share an id follow their own plan, and equal rows are taken as often together as their plans say."""
    from arborlake.llm import mixing

    r = random.Random(6)
    rows = [(r.choice([None, 7, i]), " ".join(["w"] * r.randint(1, 9)), r.choice(["a", "b", "c"]), i % 3) for i in range(300)]
    rows += [(5, "same row in all columns", "b", 1)] * 70 + [(5, "same row in all columns", "b", 2)] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    want = Counter()
    for p in mixing.plan(table).collect():
        want[p["doc_id"], p["source"], p["size"]] += len(p["positions"])
    for hot in (4096, 8):
        monkeypatch.setattr(mixing, "HOT", hot)
        out = mixing.mix(table).collect()
        got = Counter((x["doc_id"], x["source"], len(x["text"].split(" "))) for x in out)
        assert got == +want
        assert Counter(out) == Counter(mixing.mix(table.repartition(7)).collect())


def test_long_texts_through_every_operator(spark):
    from arborlake.llm import registry

    r = random.Random(8)
    text = " ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "amet", "mit license", "é", "x" * 90]) for _ in range(400_000))
    rows = [(1, text, "en", "a"), (2, text[:1_000_000], "en", "b"), (3, "short text", "en", "a")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from arborlake.llm import exact_dedup, fingerprints, language_id, license_scan, mixing, sentencepiece_codec, sharding, simhash, substring_dedup, token_counts

    for run in (substring_dedup.query, language_id.query, mixing.query, simhash.components, sentencepiece_codec.query, fingerprints.query, exact_dedup.groups, token_counts.count_tokens, license_scan.scan, sharding.assign):
        assert run(table).count() == 3
    from arborlake.llm import divergence, personal_data, resampling

    assert resampling.query(table, table).count() == 3 and personal_data.query(table).count() == 3
    assert divergence.audit(table).where("part = 'pair'").count() == 2
    assert len(registry.queries()) == 13


def test_canonical_forms_are_unicode_normal_forms(spark):
    """Random texts of many scripts against the Unicode data of Python, with marks out of order, jamo and half-width kana."""
    import re
    import unicodedata

    from arborlake.llm import fingerprints

    r = random.Random(9)
    blocks = [(0x20, 0x7E), (0xA0, 0x24F), (0x370, 0x3FF), (0x400, 0x4FF), (0x590, 0x6FF), (0x900, 0x97F), (0xE00, 0xE7F), (0x1100, 0x11FF), (0x1E00, 0x1FFF), (0x3040, 0x30FF), (0xAC00, 0xB000), (0xFB00, 0xFDFF), (0xFF00, 0xFFEF), (0x1D400, 0x1D7FF)]
    texts = ["e\u0302\u0323", "q\u0307\u0323", "\uff76\uff9e", "\u1112\u1161\u11ab", "ẞ ß SS", "K Å µ", "İ I ı", "Σ σ ς", "ﬁ ﬀ Ⅷ ½ ²"]
    for _ in range(6000):
        some = [*r.sample(blocks, 2), (0x300, 0x345)]
        text = "".join(chr(r.randint(*r.choice(some))) for _ in range(r.randint(1, 14)))
        texts.append("".join(c for c in text if unicodedata.category(c) not in ("Cn", "Cs", "Co")))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", fingerprints.canonical(F.col("text")).alias("form"))
    got = {x["doc_id"]: x["form"] for x in rows.collect()}
    for i, text in enumerate(texts):
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        assert got[i] == re.sub(r"\s+", " ", folded).strip(), ascii(text)


def test_fingerprints_of_rows_without_ids(spark):
    from arborlake.llm import fingerprints

    texts = ["a b", "A  b", "c", "", None, "ﬁne", "FINE", "x" * 30]
    table = spark.createDataFrame([(None, t) for t in texts] + [(4, "c"), (4, "D"), (9, "d")], "doc_id long, text string")
    got = fingerprints.query(table).collect()
    assert len(got) == 11 and len({x["fingerprint"] for x in got if x["n_chars"] in (3, 4) and x["doc_id"] is None}) == 2
    assert {x["doc_id"]: x["near_next"] for x in got if x["doc_id"] == 9} == {9: 0.0}
