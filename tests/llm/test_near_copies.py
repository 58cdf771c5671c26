"""The pipeline's near-dedup stage against brute force: five-word shingles, similarity 0.8 or more."""

import random


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_keep(rows):
    """doc_ids that name their component under single links."""
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(d, grams(t)) for d, t in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if 5 * len(x & y) >= 4 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d for d in root if find(d) == d}


def test_near_copies_of_similarity_from_four_fifths_go(spark):
    import corpus_pipeline

    r = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(60):
        base = r.choices(vocab, k=r.choice((12, 60, 300)))
        rows.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            rows.append("  ".join(copy).upper())
    # one dense group whose members need not be similar to its first one, a chain, short and empty texts
    base = r.choices(vocab, k=200)
    for _ in range(60):
        at = r.randrange(190)
        rows.append(" ".join([*base[:at], *r.choices(vocab, k=4), *base[at + 4 :]]))
    rows += [" ".join(f"c{j}" for j in range(i, i + 100)) for i in range(0, 80, 8)]
    rows += ["a b", "A  b", "a c", "", " ", None, "boiler plate text of five"]
    rows = list(enumerate(rows))
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.drop_near_copies(spark, table, "").collect()
    assert sorted(x["doc_id"] for x in out) == sorted(brute_keep(rows))


def test_vectors_bound_the_difference(spark):
    """Folded parities never differ in more classes than the sets do in members, and tell most of the difference."""
    import numpy as np
    from pyspark.sql import functions as F

    from arborlake.llm import near_copies

    rng, rows = np.random.default_rng(3), []
    for n in (0, 1, 5, 100, 400, 520, 3000):
        for change in (0, 1, n // 10, n // 5):
            every = np.unique(rng.integers(1 << 63, size=n + change).astype(np.uint64))
            a, b = every[:n], every[change:]
            rows.append((near_copies._vector(a).tolist(), near_copies._vector(b).tolist(), len(np.setxor1d(a, b))))
    for x in spark.createDataFrame(rows, "x array<long>, y array<long>, apart int").withColumn("found", near_copies.vector_distance(F.col("x"), F.col("y"))).collect():
        assert x["found"] <= x["apart"] and (x["apart"] - x["found"]) % 2 == 0 and x["found"] >= 0.5 * x["apart"] - 8


def test_common_shingles_are_counted_over_all_texts(spark, monkeypatch):
    from collections import Counter

    from arborlake.llm import near_copies

    r = random.Random(5)
    passages = [" ".join(r.choices("abcdefgh", k=12)) for _ in range(6)]
    texts = [f"{' '.join(r.choices('klmnopqrstuv', k=9))} {passages[min(r.randrange(6), r.randrange(6))]}" for _ in range(300)] + ["", None, "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = Counter(int(g) for t in texts for g in near_copies.distinct(near_copies.hashes(t)))
    monkeypatch.setattr(near_copies, "HELD", 200)
    for part, most in ((1 << 20, 1 << 20), (100, 1 << 20), (100, 20)):
        monkeypatch.setattr(near_copies, "PART", part)
        monkeypatch.setattr(near_copies, "COMMON", most)
        shift, grams, times = near_copies._common(docs)
        assert (shift < 32) == (part == 100)
        assert list(grams) == sorted(grams) and len(grams) <= most
        common = {g >> shift: n for g, n in want.items() if n >= near_copies.LEAST}
        found = dict(zip(grams.tolist(), times.tolist(), strict=True))
        assert found == common if most > len(common) else found.items() <= common.items()
        assert all(n <= min(found.values(), default=1 << 30) for g, n in common.items() if g not in found)
    shift, grams, times = near_copies._common(docs.limit(0))
    assert shift == 32 and not len(grams) and not len(times)


def test_passages_that_many_texts_share_make_no_copies(spark, monkeypatch):
    """Common shingles stand last for some texts only; results are those of brute force."""
    import corpus_pipeline
    from arborlake.llm import near_copies

    monkeypatch.setattr(near_copies, "PART", 500)
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(2000)]
    passages = [r.choices(vocab, k=60) for _ in range(3)]
    rows = [" ".join(r.choices(vocab, k=r.choice((0, 4, 20, 80))) + r.choice(passages) + r.choices(vocab, k=r.choice((0, 3, 9)))) for _ in range(150)]
    rows = list(enumerate(rows))
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(x["doc_id"] for x in out) == sorted(brute_keep(rows))


def test_pairs_of_a_dense_group_are_few(spark, monkeypatch):
    """Copies that no fingerprint and no first text has linked: candidates in all follow the texts, not their square."""
    from arborlake.llm import near_copies

    n, seen, confirmed, shared = 200, [], near_copies.confirmed, near_copies._shared

    def tally(docs, points, pairs, repeated):
        pairs = near_copies.written(pairs.distinct())
        seen.append(pairs.count())
        return confirmed(docs, points, pairs, repeated)

    monkeypatch.setattr(near_copies, "confirmed", tally)
    monkeypatch.setattr(near_copies, "_shared", lambda frame: shared(frame).assign(fit=False))
    monkeypatch.setattr(near_copies, "shard_links", lambda leaders, radius: leaders.select(leaders.id.alias("a"), leaders.id.alias("b")).limit(0))
    base = " ".join(f"w{i}" for i in range(29))
    rows = [(i, f"{base} u{i}") for i in range(n)]
    found = near_copies.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == n and len({x["group"] for x in found}) == 1
    assert sum(seen) < 20 * n, seen
