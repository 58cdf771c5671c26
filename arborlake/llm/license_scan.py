"""License scans by ordered signature rules.

Rules are hand-written regexes over the words of a text (`license_rules`), in groups by a keyword that a text must hold
before its group is tried. A group is one alternation, so a text is read once for each keyword it holds; at one place
the first rule of the group that matches is the detection. A detection that lies inside a longer one, or on the same
words as one of higher priority, is suppressed. Plain phrases give base labels, which always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.license_rules import GATES, GROUPS
from arborlake.llm.texts import ascii_lower

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing, as a class of what they hold: far cheaper than a negated class.
WORD_ANY_CASE = r"[0-9A-Za-z\x80-\x{10FFFF}]++"

#: Phrases and their base labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

BASE_CONFIDENCE = 0.7


def rules() -> list[tuple[str, str, str, int, float]]:
    """(keyword, regex, label, priority, confidence) of every rule in order."""
    return [(keyword, f"(?<= ){regex}(?= )", label, priority, confidence) for keyword, group in GROUPS for label, priority, confidence, regex in group]


def _gate(lowered: Column) -> Column:
    """Whether a text may hold what some rule or base phrase matches."""
    found = F.lit(False)
    for word, regex in GATES:
        here = F.contains(lowered, F.lit(word))
        found = found | (here if regex is None else here & lowered.rlike(regex))
    return found


def _spaced(lowered: Column) -> Column:
    """The words with a space on both sides of each: ' a  b  c ', or a single space if there is none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, SEPARATOR, "  ")), F.lit(" "))


def _words_in(spaced: Column) -> Column:
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    A null text counts as empty and has no words and no labels. score is the highest confidence of what is left after
    suppression. A very long text is one value that each regex reads from end to end. Repeated rows have a result
    each, and rows with a null doc_id are scanned like any other. Only doc_id and text are read, each text once. An
    empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.regexp_count(text, F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"), ascii_lower(text).alias("lowered"))
    rows = rows.select("doc_id", "row", "n_words", F.when(_gate(F.col("lowered")), _spaced(F.col("lowered"))).alias("spaced"))
    counts, firsts, lasts, names = [], [], [], []
    for phrase, label in BASE:
        words = phrase.split(" ")
        needle = " " + "  ".join(words) + " "
        removed = F.length("spaced") - F.length(F.replace(F.col("spaced"), F.lit(needle), F.lit("")))
        count = F.coalesce((removed / len(needle)).cast("long"), F.lit(0))
        counts.append(count)
        firsts.append(F.when(count > 0, _words_in(F.substring_index("spaced", needle, 1))))
        lasts.append(F.when(count > 0, F.col("n_words") - _words_in(F.substring_index("spaced", needle, -1)) - len(words)))
        names.append(F.when(count > 0, F.lit(label)))
    base = F.struct(
        "doc_id", "n_words", sum(counts[1:], counts[0]).alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*names))).alias("base"),
    )
    # one row for each text without a place that some rule matches, else one for each such place
    found = rows.select("row", base.alias("kept"), F.replace("spaced", F.lit("  "), F.lit(" ")).alias("words"))
    found = detections(found, ("row",), ("kept",))
    out = found.groupBy("row").agg(F.any_value("kept", ignoreNulls=True).alias("kept"), F.array_sort(F.collect_set("label")).alias("more"), F.max("confidence").alias("top"))
    out = out.select("kept.*", "more", "top")
    labels = F.array_sort(F.array_union("base", "more"))
    score = F.greatest(F.coalesce("top", F.lit(0.0)), F.when(F.size("base") > 0, BASE_CONFIDENCE).otherwise(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def _places(words: Column, number: int) -> Column:
    """Where rules of a group match: (group, the characters since the last such place, the words matched), then the rest."""
    keyword, group = GROUPS[number]
    at = "(?<= )(?=(" + "|".join(f"(?:{regex})" for *_, regex in group) + ")(?= ))"
    # nothing is consumed, so the text splits where it is matched
    both = F.arrays_zip(F.split(words, at, -1).alias("gap"), F.regexp_extract_all(words, F.lit(at), F.lit(1)).alias("hit"))
    made = F.transform(both, lambda x: F.struct(F.lit(number).alias("group"), F.length(x["gap"]).alias("gap"), x["hit"].alias("hit")))
    return F.when(F.contains(words, F.lit(keyword)), F.filter(made, lambda x: x["hit"].isNotNull()))


def detections(rows: DataFrame, keys: tuple[str, ...], carried: tuple[str, ...] = ()) -> DataFrame:
    """(keys, carried, label, priority, confidence, start, stop) left after suppression, from rows of (keys, carried, words).

    words has one space around each word; start and stop are character offsets into it. A row without a detection has
    one row with nulls; one whose detections are partly suppressed keeps carried in each row that is left. keys tell
    the rows apart.
    """
    empty = F.array().cast("array<struct<group:int,gap:int,hit:string>>")
    places = F.concat(*[F.coalesce(_places(F.col("words"), i), empty) for i in range(len(GROUPS))])
    found = rows.select(*keys, *carried, F.posexplode_outer(places).alias("i", "x")).repartition(*keys)
    # the first gap of a group runs up to the space in front of its first hit, the next ones from hit to hit
    so_far = Window.partitionBy(*keys, "x.group").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("start", F.sum("x.gap").over(so_far)).withColumn("stop", F.col("start") + F.length("x.hit"))
    table = F.array(*[F.array(*[F.struct(F.lit(f"^(?:{regex})$").alias("regex"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(c).alias("confidence")) for label, p, c, regex in group]) for _, group in GROUPS])
    rule = F.element_at(F.filter(F.element_at(table, F.col("x.group") + 1), lambda r: F.rlike(F.col("x.hit"), r["regex"])), 1)
    found = found.select(*keys, *carried, "start", "stop", F.when(F.col("x").isNotNull(), rule).alias("rule"))
    sweep = Window.partitionBy(*keys).orderBy("start", F.desc("stop"), F.desc("rule.priority"), "rule.label")
    reach = F.max("stop").over(sweep.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("stop") > F.col("reach")))
    return found.select(*keys, *carried, "rule.label", "rule.priority", "rule.confidence", "start", "stop")
