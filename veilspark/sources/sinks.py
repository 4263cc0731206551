"""Sinks: append-only tables, CSV, JSON, text and ZIP exports."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.batch import distinct_names, export_name, grouped_texts


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """All cells quoted, quotes doubled, header first."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', quote='"')


RESULTS = ("file", "row", "task_id", "status", "entity_count", "pending_count", "final_revision", "final_text")
FAILURES = ("file", "row", "error", "text_length", "text_hash")


def download_csv(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Lines of a download, ``at, line``: a byte-order mark and the bare header, then rows by file and row, all cells quoted."""
    known = [F.coalesce("final_text", "redacted_text").alias(c) if c == "final_text" and "redacted_text" in rows.columns else F.col(c) for c in columns]
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    body = rows.select(*known).select(F.struct("file", "row").alias("at"), F.concat_ws(",", *cells).alias("line"))
    head = rows.sparkSession.createDataFrame([("\ufeff" + ",".join(columns),)], "line string").select(F.lit(None).cast(body.schema["at"].dataType).alias("at"), "line")
    return head.unionByName(body).orderBy(F.asc_nulls_first("at"))


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def exports(results: DataFrame) -> DataFrame:
    """``export, content, n_rows``: one text per source file, under safe names without collisions."""
    texts = grouped_texts(results).withColumn("name", export_name(F.col("file")))
    return distinct_names(texts.withColumn("ord", F.col("file"))).select("file", "export", "content", "n_rows")


def text_files(results: DataFrame, path: str) -> None:
    """Exports as a table partitioned by name, written by the executors."""
    exports(results).select("export", "content").write.mode("overwrite").partitionBy("export").text(path)


def zip_file(results: DataFrame, failures: DataFrame, path: str) -> int:
    """A ZIP on the driver's disk for a download: files stream through one at a time.  Returns their number."""
    n, names = 0, []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for r in exports(results).toLocalIterator():
            z.writestr(r["export"], r["content"])
            names.append({"source": r["file"], "file": r["export"], "rows": r["n_rows"]})
            n += 1
        z.writestr("manifest.json", json.dumps({"files": names}, ensure_ascii=False))
        cell = lambda v: '"' + str("" if v is None else v).replace('"', '""') + '"'
        lines = None
        for r in failures.toLocalIterator():
            lines = lines or [",".join(map(cell, failures.columns))]
            lines.append(",".join(map(cell, r)))
        if lines:
            z.writestr("failures.csv", "﻿" + "\n".join(lines))
    return n
