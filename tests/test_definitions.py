"""Macro definitions against a plain choice, and listed cases."""

import random

from arborlake.operators import definitions as m

DEFS = "id long, name string, relpath string, line int, text string"


def plain(functions, defs, most=16):
    out = set()
    for target, path, names in functions:
        size = lambda n: any(x in n for x in m.SIZE_MARKS)
        chosen = []
        for name in sorted(names, key=lambda n: (not size(n), n)):
            rows = sorted((d for d in defs if d[1] == name), key=lambda d: ((d[2] or "") != path, not (d[2] or "").endswith(".h"), 10**9 if d[3] is None else d[3], d[0]))
            if rows:
                chosen.append((name, rows[0][0], False))
                other = [d for d in rows if (d[4] or "") != (rows[0][4] or "")]
                if size(name) and other:
                    chosen.append((name, other[0][0], True))
        out |= {(target, i + 1, *c) for i, c in enumerate(chosen[:most])}
    return out


def test_choice_equals_a_plain_one(spark):
    draw = random.Random(11)
    names = [f"{p}{i}" for p in ("MAX_", "ZLEN", "FLAG", "A_BUF") for i in range(4)]
    files = ["a.c", "b.c", "a.h", "b.h", None]
    defs = [(i, draw.choice([*names, None]), draw.choice(files), draw.choice([None, 1, 2, 3]), draw.choice(["x", "y", "z", None])) for i in range(150)]
    functions = [(t, draw.choice(["a.c", "b.c", "c.c", "a.h"]), draw.sample(names, draw.randint(0, 16))) for t in range(40)]
    df = spark.createDataFrame([(t, p, " + ".join(n)) for t, p, n in functions], "target int, relpath string, text string")
    got = m.macro_definitions(df, spark.createDataFrame(defs, DEFS)).collect()
    assert {(r["target"], r["place"], r["name"], r["id"], r["extra"]) for r in got} == plain(functions, defs)


def test_names_and_empty_tables(spark):
    text = 'AB ABC _X1 abc "STR \\" ING" \'CHR\' A_1; // COM\nREAL /* IN\nNER */ LAST_ /* OPEN'
    rows = spark.createDataFrame([(1, "a.c", text), (2, None, None), (3, "a.c", "")], "target int, relpath string, text string")
    got = {r["target"]: r["n"] for r in rows.select("target", m.macro_names(rows["text"]).alias("n")).collect()}
    assert got == {1: ["ABC", "_X1", "A_1", "REAL", "LAST_"], 2: [], 3: []}
    assert m.macro_definitions(rows, spark.createDataFrame([], DEFS)).count() == 0
    assert m.macro_definitions(rows.limit(0), spark.createDataFrame([(1, "ABC", None, None, None)], DEFS)).count() == 0
    assert [tuple(r) for r in m.macro_definitions(rows, spark.createDataFrame([(1, "ABC", None, None, None)], DEFS)).collect()] == [(1, 1, "ABC", 1, False)]
