"""File sources: records ``file, row, text`` from TXT, MD, CSV, JSON, DOCX and PDF, and dead letters.

Files are read as binary by Spark, so any store works; a file is one record of
the reader and is size-checked first.  ``row`` counts from 1 before blank
records are dropped.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.tables import MAX_FILE_BYTES, MAX_TEXT

KINDS = ("txt", "md", "csv", "json", "docx", "pdf")
_LINES = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def binary(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """``file, kind, bytes, content`` of the files under a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return reader.load(path).select(F.col("path").alias("file"), kind.alias("kind"), F.col("length").alias("bytes"), "content")


def refused(files: DataFrame, most: int = MAX_FILE_BYTES) -> Column:
    """Why a file is not read; null where it is."""
    return F.when(~F.col("kind").isin(*KINDS), "unsupported file type").when(F.col("bytes") > most, "file too large").when(F.col("bytes") == 0, "empty file")


def _decoded(content: str = "content") -> Column:
    text = F.expr(f"try_validate_utf8(cast({content} as string))")
    return F.regexp_replace(text, r"^\x{feff}", "")


def _kept(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("text").rlike(r"(?U)[^\s\x{1c}-\x{1f}]"))


def lines(files: DataFrame) -> DataFrame:
    """One record per non-blank line of TXT and MD files; lines stay unstripped."""
    text = F.split(_decoded(), _LINES)
    return _kept(files.where(F.col("kind").isin("txt", "md")).select("file", F.posexplode(text).alias("at", "text")).select("file", (F.col("at") + 1).alias("row"), "text"))


def json_arrays(files: DataFrame) -> DataFrame:
    """One record per element of a JSON array: an object's ``text``, else ``content``; a scalar as it is."""
    items = F.from_json(_decoded(), "array<string>")
    rows = files.where("kind = 'json'").select("file", F.posexplode(items).alias("at", "item"))
    is_object = F.col("item").startswith("{")
    inner = F.coalesce(F.get_json_object("item", "$.text"), F.get_json_object("item", "$.content"), F.lit(""))
    return _kept(rows.select("file", (F.col("at") + 1).alias("row"), F.when(is_object, inner).otherwise(F.col("item")).alias("text")))


def csv_rows(files: DataFrame) -> DataFrame:
    """One record per row of CSV files with a header: column ``text``, else ``content``, else the first."""
    import csv

    def read(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for name, content in zip(pdf["file"], pdf["content"], strict=True):
                try:
                    decoded = bytes(content).decode("utf-8-sig")
                except UnicodeDecodeError:
                    continue  # reported by ``records`` as a file that cannot be read
                reader = csv.DictReader(io.StringIO(decoded, newline=""))
                columns = reader.fieldnames or []
                column = next((c for c in ("text", "content") if c in columns), columns[0] if columns else None)
                out += [(name, i, r.get(column) or "") for i, r in enumerate(reader, 1) if column is not None]
            yield pd.DataFrame(out, columns=["file", "row", "text"])

    return files.where("kind = 'csv'").select("file", "content").mapInPandas(read, "file string, row int, text string").where("text != ''")


def docx_text(content: bytes) -> str:
    """Non-blank paragraphs, then table rows with cells joined by tabs."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_WORD}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t"))
    paragraphs = [said(p) for p in body.findall(f"{_WORD}p")]
    rows = ["\t".join("\n".join(said(p) for p in cell.findall(f"{_WORD}p")) for cell in r.findall(f"{_WORD}tc")) for t in body.findall(f"{_WORD}tbl") for r in t.findall(f"{_WORD}tr")]
    return "\n".join(x for x in paragraphs + rows if x.strip())


def pdf_pages(content: bytes) -> list[str]:
    from pypdf import PdfReader

    return [(p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(content)).pages]


def documents(files: DataFrame) -> DataFrame:
    """``file, row, text, error`` of DOCX (one record) and PDF files (one per page)."""

    def read(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for name, kind, content in zip(pdf["file"], pdf["kind"], pdf["content"], strict=True):
                try:
                    texts = [docx_text(bytes(content))] if kind == "docx" else pdf_pages(bytes(content))
                    out += [(name, i, t, None) for i, t in enumerate(texts, 1) if t.strip()]
                except ImportError:
                    out.append((name, 0, None, "no PDF reader is installed"))
                except Exception as e:  # a broken file is a dead letter, not a failed job
                    out.append((name, 0, None, f"unreadable {kind}: {type(e).__name__}"))
            yield pd.DataFrame(out, columns=["file", "row", "text", "error"])

    return files.where(F.col("kind").isin("docx", "pdf")).select("file", "kind", "content").mapInPandas(read, "file string, row int, text string, error string")


def records(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All records, and dead letters ``file, error`` for files that were not read."""
    marked = files.withColumn("error", refused(files))
    good = marked.where("error is null")
    rich = documents(good)
    broken_json = good.where("kind = 'json'").where(F.from_json(_decoded(), "array<string>").isNull()).select("file", F.lit("not a JSON array").alias("error"))
    undecoded = good.where(F.col("kind").isin("txt", "md", "csv")).where(_decoded().isNull()).select("file", F.lit("not UTF-8").alias("error"))
    found = lines(good).unionByName(json_arrays(good)).unionByName(csv_rows(good)).unionByName(rich.where("error is null").select("file", "row", "text"))
    dead = marked.where("error is not null").select("file", "error").unionByName(broken_json).unionByName(undecoded).unionByName(rich.where("error is not null").select("file", "error"))
    return found, dead


def extracted(rows: DataFrame) -> DataFrame:
    """Each file's records joined by line feeds, in row order."""
    packed = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("row", "text"))).alias("rows"))
    return packed.select("file", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"))


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold spans of a JSONL file ``{text, spans: [{start, end, entity_type}]}``; blank lines are skipped."""
    return spark.read.schema("text string, spans array<struct<start:int,end:int,entity_type:string>>").json(path).where("text is not null")


def page_text(html: Column, most: int = MAX_TEXT) -> Column:
    """Visible text of a web page, cut at the limit that a selection has."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.substring(F.trim(F.regexp_replace(bare, r"\s+", " ")), 1, most)


def read_or(spark: SparkSession, path: str, default: DataFrame) -> DataFrame:
    """A JSON report where it is there, else the default."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(default.schema).json(path)
    except AnalysisException:
        return default
