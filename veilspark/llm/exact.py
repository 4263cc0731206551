"""Document fingerprints: a canonical exact digest, in Spark SQL functions only.

Texts are brought to a canonical form (Unicode compatibility normalisation,
full case folding, white space folded to single blanks) and digested by two
independent 64-bit xxhash values.  Rows whose wide digest is equal form a
bucket; inside buckets of more than one row the canonical bytes are compared,
and different texts of one bucket get different suffixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm.common import materialize, quantile_splits, range_bucket, table

#: Rows of one range when documents are ordered; ranges are limited in number, not in rows (a window spills what it holds).
RANGE_ROWS, MOST_RANGES = 1000, 65_536
#: The filter of digests that occur again has at most this many entries (a proven bound for its broadcast).
FILTER_BITS = 18


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, white-space runs to one blank, trimmed.

    Both steps call the ICU library that Spark itself ships, inside the JVM.
    """
    icu = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), icu(text), F.lit(True))
    return F.trim(F.regexp_replace(icu(folded), r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """A struct of three independent 64-bit values: ``a`` and ``b`` are the fingerprint, ``c`` tells clashing texts apart."""
    return F.struct(F.xxhash64(canon).alias("a"), F.xxhash64(F.lit("wide"), canon).alias("b"), F.xxhash64(F.lit("apart"), canon).alias("c"))


def following(docs: DataFrame) -> DataFrame:
    """Each row of ``doc_id, text, h`` with ``next_id, next_text, next_h`` of the next document.

    Documents go in descending doc_id; the last one's next is the first.  Rows
    are dealt to ranges of doc_id and the head of each range is copied to the
    range before it, so no task sees more than a range and one row.  Equal
    doc_ids are ordered by digest.
    """
    n = docs.count()
    splits = quantile_splits(docs, "doc_id", min(MOST_RANGES, -(-n // RANGE_ROWS)))
    docs = docs.withColumn("range", range_bucket(F.col("doc_id"), splits))
    heads = docs.groupBy("range").agg(F.max("doc_id").alias("head")).orderBy(F.desc("range")).collect()  # at most MOST_RANGES rows
    before = [(r["head"], heads[i - 1]["range"], i == 0) for i, r in enumerate(heads)]
    copies = docs.sparkSession.createDataFrame(before, "doc_id bigint, to int, wrapped boolean")
    home = F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("copy")))
    again = F.array(F.struct(F.col("to").alias("range"), F.when(F.col("wrapped"), 2).otherwise(1).alias("copy")))
    dealt = docs.join(F.broadcast(copies), "doc_id", "left").withColumn("place", F.explode(F.when(F.col("to").isNull(), home).otherwise(F.concat(home, again))))
    dealt = dealt.select("doc_id", "text", "h", "place.range", "place.copy")
    order = Window.partitionBy("range").orderBy(F.col("copy") == 2, F.desc("doc_id"), "copy", "h")
    ahead = F.lead(F.struct(F.col("doc_id").alias("id"), "text", "h")).over(order)
    found = dealt.withColumn("next", ahead).where("copy = 0")
    return found.select("doc_id", "text", "h", F.col("next.id").alias("next_id"), F.col("next.text").alias("next_text"), F.col("next.h").alias("next_h"))


def edit(text: Column, other: Column) -> Column:
    """``text`` with its last half replaced by the first as many code points of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text (columns ``doc_id, text``; null text: empty).

    Likeness of exact digests is 1 (equal canonical bytes) or 0.  Repeated rows
    each get a row; a table of one row follows itself; an empty table gives none.
    Texts of any length are read whole, a null doc_id stays null and comes last,
    and other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = following(base.withColumn("h", digest(canonical(F.col("text")))))
    rows = rows.withColumn("edited", edit(F.col("text"), F.col("next_text"))).withColumn("e", digest(canonical(F.col("edited"))))
    rows = materialize(rows.select("doc_id", "next_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "h", "e", "next_h"), "digests")
    apart = materialize(clashing(base, rows), "clashes")
    clash = apart.limit(1).count() > 0
    for k in ("h", "e", "next_h"):
        wide = F.lower(F.concat(F.lpad(F.hex(f"{k}.a"), 16, "0"), F.lpad(F.hex(f"{k}.b"), 16, "0")))
        if clash:
            rows = rows.join(apart.select(F.col("h").alias(k), F.col("nth").alias(f"{k}_nth")), k, "left")
            wide = F.concat(wide, F.coalesce(F.concat(F.lit("-"), F.col(f"{k}_nth")), F.lit("")))
        rows = rows.withColumn(f"{k}_wide", wide)
    near = lambda k: (F.col("h_wide") == F.col(k)).cast("double")
    return rows.select("doc_id", "n_chars", "edited_sha256", F.col("h_wide").alias("fingerprint"), F.col("e_wide").alias("edited_fingerprint"), near("e_wide").alias("near_edited"), near("next_h_wide").alias("near_next"))


def _low_bits(col: Column) -> Column:
    return col.bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def clashing(base: DataFrame, rows: DataFrame) -> DataFrame:
    """``h, nth`` for the digests of different canonical texts that share one wide digest.

    Canonical bytes are compared inside every bucket of two or more rows, of
    texts and edited texts alike.  Filters of at most 2**FILTER_BITS hash
    prefixes (a proven bound for their broadcast) keep what occurs once from the
    shuffle; a hot bucket is one row per task before it.
    """
    seen = rows.select(F.explode(F.array("h", "e")).alias("d")).groupBy("d.a", "d.b").count().where("count > 1")
    again = materialize(seen.select(_low_bits(F.col("a")).alias("bits")).distinct(), "again")
    texts = base.withColumn("canon", canonical(F.col("text"))).withColumn("h", digest(F.col("canon"))).withColumn("bits", _low_bits(F.col("h.a")))
    texts = texts.join(F.broadcast(again), "bits", "left_semi").select("h", "canon")
    edits = rows.withColumn("bits", _low_bits(F.col("e.a"))).join(F.broadcast(again), "bits", "left_semi").select("doc_id", "next_id")
    needed = edits.select(F.explode(F.array("doc_id", "next_id")).alias("id")).select(_low_bits(F.xxhash64("id")).alias("bits")).distinct()
    some = base.withColumn("bits", _low_bits(F.xxhash64("doc_id"))).join(F.broadcast(needed), "bits", "left_semi").select("doc_id", "text")
    pairs = edits.join(some, "doc_id").join(some.select(F.col("doc_id").alias("next_id"), F.col("text").alias("next_text")), "next_id")
    pairs = pairs.withColumn("canon", canonical(edit(F.col("text"), F.col("next_text")))).withColumn("h", digest(F.col("canon"))).select("h", "canon")
    sets = texts.unionByName(pairs).groupBy("h.a", "h.b").agg(F.array_sort(F.collect_set("canon")).alias("texts")).where(F.size("texts") > 1)
    return sets.select(F.posexplode("texts").alias("nth", "canon")).select(digest(F.col("canon")).alias("h"), F.col("nth").cast("string").alias("nth"))


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
