"""Batch jobs: one plan over all records, dead-letter rows, job figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.tables import MAX_TEXT
from veilspark.operators.summary import progress


def fault(text: Column, most: int = MAX_TEXT) -> Column:
    """Why a record cannot be processed; null where it can."""
    return F.when(text.isNull(), "missing text").when(~text.rlike(r"(?U)\S"), "empty text").when(F.length(text) > most, "text too long")


def split_faulty(records: DataFrame, most: int = MAX_TEXT) -> tuple[DataFrame, DataFrame]:
    """Good records, and dead letters ``file, row, text_length, text_hash, error`` without raw text."""
    marked = records.withColumn("error", fault(F.col("text"), most))
    dead = marked.where("error is not null").select("file", "row", F.coalesce(F.length("text"), F.lit(0)).alias("text_length"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"), "error")
    return marked.where("error is null").drop("error"), dead


MOST_RECORDS = 500


def guarded(records: DataFrame, most: int = MOST_RECORDS) -> DataFrame:
    """Records of one upload, refused as a whole where there are none or more than ``most`` (an interactive limit; jobs over tables have none)."""
    n = records.limit(most + 1).count()
    if not n:
        raise ValueError("no text to process")
    if n > most:
        raise ValueError(f"more than {most} records")
    return records


def representative(records: DataFrame, order: str = "file") -> DataFrame:
    """The first record of the first file, for a preview; its text up to the limit of one text."""
    first = records.orderBy(order, "row").limit(1)
    return first.withColumn("text", F.substring("text", 1, MAX_TEXT))


def figures(results: DataFrame, dead: DataFrame) -> DataFrame:
    """Totals of a job and its final status, one row."""
    both = results.select(F.lit(0).alias("bad")).unionAll(dead.select(F.lit(1).alias("bad")))
    out = both.agg(F.count("*").alias("total"), F.coalesce(F.sum("bad"), F.lit(0)).alias("failed"))
    return out.select("total", F.col("total").alias("processed"), "failed", F.when(F.col("failed") > 0, "completed_with_errors").otherwise("completed").alias("status"), progress(F.col("total"), F.col("total")).alias("progress"))


def grouped_texts(results: DataFrame, file: str = "file", row: str = "row", text: str = "final_text") -> DataFrame:
    """One text per file, its rows in order."""
    packed = results.groupBy(file).agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("row"), F.col(text).alias("text")))).alias("rows"))
    return packed.select(file, F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("content"), F.size("rows").alias("n_rows"))


#: Characters of a part of an export, beyond which the next row begins a new part.
PART_CHARS = 4_000_000


def export_parts(results: DataFrame, file: str = "file", row: str = "row", text: str = "final_text") -> DataFrame:
    """``file, part, content, n_rows``: whole texts of a file, its rows in order, cut into parts of bounded size.

    The parts of a file, by ``part`` and joined by a line feed, are what ``grouped_texts`` makes of it.  Rows are dealt
    by ranges of file and row, so a file of any size is written by many tasks.  As there, a null text is left out of
    the content but counts as a row.
    """
    rows = results.select(F.col(file).cast("string").alias("file"), F.col(row).alias("row"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange("file", "row", "text").sortWithinPartitions("file", "row", "text")
    parts = ordered.select("file", F.spark_partition_id().cast("bigint").alias("at"), "text").mapInArrow(_parts(PART_CHARS), "file string, part bigint, content string, n_rows bigint")
    return parts.withColumnsRenamed({"file": file})


def _parts(most: int):
    import pyarrow as pa

    def run(batches):
        names = ["file", "part", "content", "n_rows"]
        made, now, texts, size, n, at = 0, None, [], 0, 0, 0

        def part():
            content = "\n".join(texts) if texts else None  # None: nothing to join, not an empty row
            return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([(at << 32) + made], pa.int64()), pa.array([content], pa.string()), pa.array([n], pa.int64())], names)

        for batch in batches:
            for file, at, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if n and (file != now or size > most):
                    yield part()
                    made, texts, size, n = made + 1, [], 0, 0
                now, n = file, n + 1
                if text is not None:
                    texts.append(text)
                    size += len(text) + 1
        if n:
            yield part()

    return run


def export_name(file: Column) -> Column:
    """A safe relative name: back-slashes turned, empty, dot and parent parts dropped, suffix replaced."""
    parts = F.filter(F.split(F.replace(file, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", ".."))
    name = F.array_join(parts, "/")
    return F.concat(F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", ""), F.lit(".redacted.txt"))


def distinct_names(files: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """Adds ``export``: the n-th file of a name gets ``-n`` before the suffix, in first-seen order."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(name).orderBy(order))
    stem = F.regexp_replace(F.col(name), r"\.redacted\.txt$", "")
    return files.withColumn("export", F.when(nth == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), nth.cast("string"), F.lit(".redacted.txt"))))
