"""The pipeline's language stage drops texts of no learned language, however many languages there are."""

import random

import numpy as np

import pytest

from arborlake.llm import language_id


def _texts(r, letters, n, size=120):
    words = ["".join(r.choice(letters) for _ in range(r.randint(3, 7))) for _ in range(40)]
    return [" ".join(r.choice(words) for _ in range(size)) for _ in range(n)]


@pytest.mark.parametrize("languages", [3, 25])
def test_language_stage_drops_junk_and_unlearned_languages(spark, languages):
    import corpus_pipeline

    r = random.Random(languages)
    rows = []
    for i in range(languages):
        letters = r.sample("abcdefghijklmnopqrstuvwxyz", 12)
        rows += [(t, f"l{i:02}") for t in _texts(r, letters, 24)]
    known = len(rows)
    rows += [(t, None) for t in _texts(r, "àâäãåæçèéêëìíîï", 10)]
    rows += [("".join(r.choice("bcdfghjklmnpqrstvwxz0123456789 ") for _ in range(n)), None) for n in (60, 2000, 10_000) for _ in range(10)]
    # one known word in much junk, and a text of one n-gram over and over
    rows += [(rows[i][0].split()[0] + " " + "".join(r.choice("0123456789éü") for _ in range(3000)), None) for i in range(10)]
    rows += [("qzjx" * 800, None)]
    table = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["lang"] for x in corpus_pipeline.identify_language(spark, table, "").collect()}
    assert got == {i: rows[i][1] for i in range(known)}
    assert language_id.build([], 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)).evident("abc def") == language_id.NONE
