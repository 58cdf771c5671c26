"""Document fingerprints: a canonical exact digest.

A text is normalised, case-folded and stripped of differences in white space; two 64-bit xxhashes of that form are its
fingerprint. Documents that share a bucket are compared byte by byte with its first document, and one that differs
gets a fingerprint of its own, so equal fingerprints mean equal canonical texts.

The form is NFKC of the full case folding of NFKC, with white space folded and trimmed. Spark has no function for normal
forms, but its `reflect` function calls static methods of the ICU library that Spark itself brings for collations; it
runs inside the JVM, row by row, like any other expression. Texts of ASCII and small Latin-1 letters, which lower()
leaves in that form, take lower() alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.session import broadcast_if_small, checkpoint

SPACE = "[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
#: Characters that lower() leaves in normal form: ASCII and the small letters of Latin-1 with the sharp s done apart.
PLAIN = "^[\\x00-\\x7F\\u00E0-\\u00F6\\u00F8-\\u00FF]*$"


def nfkc(text: Column) -> Column:
    """Unicode normal form KC."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def case_folded(text: Column) -> Column:
    """Unicode full case folding."""
    return F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))


def canonical(text: Column) -> Column:
    """The canonical form of a text; null counts as empty. Spark takes reflect for indeterminate and works it out wherever
    it stands, so give the form a name in a select of its own before it is used more than once."""
    text = F.coalesce(text, F.lit(""))
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    folded = F.when(low.rlike(PLAIN), low).otherwise(nfkc(case_folded(nfkc(text))))
    return F.trim(F.regexp_replace(folded, SPACE, " "))


def digest(form: Column) -> Column:
    """128 bits as 32 hex digits."""
    return F.concat(*[F.lower(F.lpad(F.hex(h), 16, "0")) for h in (F.xxhash64(form), F.xxhash64(F.lit("second"), form))])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def follow(docs: DataFrame) -> DataFrame:
    """(key, before, need, times): each key's predecessor in ascending order, round the end, and how many code points it needs.

    Ranges of keys are numbered by themselves; only one row for each range meets in one place.
    """
    sizes = _keyed(docs).groupBy("key").agg(F.max(F.char_length("text")).alias("n"), F.count(F.lit(1)).alias("times"))
    parts = checkpoint(sizes.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("key")
    lagged = parts.withColumn("before", F.lag(F.struct("key", "n")).over(inside))
    ends = parts.groupBy("part").agg(F.max(F.struct("key", "n")).alias("end"))
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("end").over(Window.orderBy("part")), F.last("end").over(everything)).alias("round"))
    # a part has one row without a predecessor
    first = lagged.where(F.col("before").isNull()).drop("before").join(ends, "part").select("key", F.col("round").alias("before"), "times")
    rows = lagged.where(F.col("before").isNotNull()).select("key", "before", "times").unionByName(first)
    return rows.select("key", F.col("before.key").alias("before"), F.floor(F.col("before.n") / 2).cast("int").alias("need"), "times")


def _hash_is(th: Column) -> Column:
    # no plain equality: a join would take it for a key and deal out the texts anew
    return th.bitwiseXOR(F.xxhash64("text")) == 0


def duplicates(bucketed: DataFrame) -> DataFrame:
    """(key, th, bucket, leads) for rows whose bucket holds several documents; leads marks the smallest key in it."""
    first = bucketed.groupBy("bucket").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return bucketed.join(broadcast_if_small(checkpoint(first)), "bucket").select("key", "th", "bucket", (F.col("key") == F.col("first")).alias("leads")).distinct()


def odd_ones(keyed: DataFrame, members: DataFrame) -> DataFrame:
    """(key, th, bucket, own) for rows that differ, byte by byte, from the first document of their bucket: own is a fingerprint of their own."""
    forms = keyed.join(members, "key").where(_hash_is(F.col("th"))).select("key", "th", "bucket", "leads", canonical(F.col("text")).alias("form"))
    reps = forms.where("leads").groupBy("bucket").agg(F.min("form").alias("rep"))
    compared = forms.select("key", "th", "bucket", "form").join(reps.repartition("rep"), "bucket").where(~F.col("form").eqNullSafe(F.col("rep")))
    own = compared.select("key", "th", "bucket", F.concat_ws("-", "bucket", F.sha2(F.encode("form", "UTF-8"), 256)).alias("own"))
    # dealt anew before copies go: else that would rest on the join's partitions, which then could not be split
    return own.repartition("key").distinct()


def buckets(keyed: DataFrame) -> DataFrame:
    """(key, th, bucket) of each row: its digest, and a hash of its text that tells rows of one key apart."""
    forms = keyed.select("key", F.xxhash64("text").alias("th"), canonical(F.col("text")).alias("form"))
    return forms.select("key", "th", digest(F.col("form")).alias("bucket"))


def query(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness: 1 if the canonical texts are equal, else 0.

    Null texts are empty; a very long text is one value of a column, as any other. A null doc_id stands before all others. Rows that repeat a doc_id have a result each; to
    their predecessor they are one document with the smallest of their texts. Other columns are not read; a table of
    one row is its own next document; an empty table gives an empty result.
    """
    keyed = _keyed(docs)
    bucketed = checkpoint(buckets(keyed))
    # a key of one row carries its digest; rows that share a key, which may be very many, work theirs out again
    own = bucketed.groupBy("key").agg(F.min("bucket").alias("bucket"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    chain = checkpoint(follow(docs).join(own, "key", "left"))
    members = checkpoint(duplicates(bucketed))
    form, known = F.when(F.col("bucket").isNull(), canonical(F.col("text"))).alias("form"), F.coalesce("bucket", digest(F.col("form")))
    # one exchange of texts by key serves the byte comparison, the heads and the rows themselves
    odd = odd_ones(keyed, members)
    heads = keyed.join(chain.select("key", "before", "need", "bucket"), "key")
    heads = heads.select(F.col("before").alias("key"), F.col("key").alias("next"), F.expr("left(text, need)").alias("head"), F.xxhash64("text").alias("next_th"), "bucket", form)
    heads = heads.select("key", "next", "head", "next_th", known.alias("next_bucket"))
    if not chain.where("times > 1").isEmpty():
        heads = heads.groupBy("key", "next").agg(F.min(F.struct("head", "next_th", "next_bucket")).alias("x")).select("key", "next", "x.*")
    rows = keyed.join(heads.join(chain.select("key", "bucket"), "key"), "key")
    rows = rows.withColumn("n", F.char_length("text")).withColumn("edited", F.concat(F.expr("left(text, n - floor(n / 2))"), F.expr("left(head, cast(floor(n / 2) as int))")))
    rows = rows.select("key", F.xxhash64("text").alias("th"), "bucket", form, "next", "next_th", "next_bucket", "n", "text", "edited", canonical(F.col("edited")).alias("edited_form"))
    rows = rows.withColumns({"bucket": known, "edited_bucket": digest(F.col("edited_form"))})
    same = F.when(F.col("edited_bucket") == F.col("bucket"), F.col("edited_form") == canonical(F.col("text"))).otherwise(False)
    rows = rows.select("key", "th", "bucket", "next", "next_th", "next_bucket", "n", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "edited_bucket", same.alias("same"))
    rows = rows.join(odd, ["key", "th", "bucket"], "left")
    of_next = odd.select(F.col("key").alias("next"), F.col("th").alias("next_th"), F.col("bucket").alias("next_bucket"), F.col("own").alias("next_own"))
    rows = rows.join(of_next, ["next", "next_th", "next_bucket"], "left")
    mine, other = F.coalesce("own", "bucket"), F.coalesce("next_own", "next_bucket")
    edited = F.when(F.col("same"), mine).otherwise(F.when(F.col("edited_bucket") == F.col("bucket"), F.concat(F.col("edited_bucket"), F.lit("-edited"))).otherwise(F.col("edited_bucket")))
    back = F.when(F.col("key") == -(2**63), None).otherwise(F.col("key")).cast(docs.schema["doc_id"].dataType)
    return rows.select(
        back.alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited_sha256", mine.alias("fingerprint"), edited.alias("edited_fingerprint"),
        F.col("same").cast("double").alias("near_edited"), (mine == other).cast("double").alias("near_next"),
    )
