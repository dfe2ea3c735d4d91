"""Raw assets: manifests by content digest, cached endpoint pages, workbooks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
HEADER_ROWS = 20


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of every file below ``path``, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Paths whose size or digest differ, or that are on one side only, with the reason."""
    joined = recorded.select("path", F.col("size").alias("r_size"), F.col("sha256").alias("r_sha")).join(found, "path", "full")
    reason = F.when(F.col("sha256").isNull(), "missing").when(F.col("r_sha").isNull(), "unexpected").when(F.col("size") != F.col("r_size"), "size").when(F.col("sha256") != F.col("r_sha"), "sha256")
    return joined.withColumn("reason", reason).filter("reason IS NOT NULL").select("path", "reason")


def fingerprint(*parts: Column) -> Column:
    """sha256 of the JSON of request fields: the same request, the same key."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def paged_rows(pages: DataFrame, schema: str) -> DataFrame:
    """Rows of cached endpoint pages: JSON whose rows stand under ``result``, ``pageHelp.data`` or ``announcements``."""
    body = F.from_json("body", f"result array<{schema}>, pageHelp struct<data: array<{schema}>>, announcements array<{schema}>")
    rows = F.coalesce(F.col("b.result"), F.col("b.pageHelp.data"), F.col("b.announcements"))
    return pages.withColumn("b", body).select(*[c for c in pages.columns if c != "body"], F.explode(rows).alias("row")).select(*[c for c in pages.columns if c != "body"], "row.*")


def split_windows(start: str, end: str) -> tuple[tuple[str, str], tuple[str, str]] | None:
    """The two halves of a date window that has too many pages; None for a single day."""
    a, b = pd.Timestamp(start), pd.Timestamp(end)
    if a >= b:
        return None
    middle = a + (b - a).days // 2 * pd.Timedelta(days=1)
    return (start, str(middle.date())), (str((middle + pd.Timedelta(days=1)).date()), end)


def _cells(data: bytes) -> list[list[str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        texts = lambda e: "".join(t.text or "" for t in e.iter(f"{MAIN}t"))
        shared = [texts(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheet = ElementTree.fromstring(book.read(min(n for n in names if n.startswith("xl/worksheets/sheet"))))
    out = []
    for row in sheet.iter(f"{MAIN}row"):
        line: list[str] = []
        for cell in row.iter(f"{MAIN}c"):
            letters = re.match(r"[A-Z]+", cell.get("r", "A"))[0]
            place = 0
            for x in letters:
                place = place * 26 + ord(x) - 64
            line += [""] * (place - len(line))
            value = cell.find(f"{MAIN}v")
            if cell.get("t") == "s":
                line[place - 1] = shared[int(value.text)]
            elif cell.get("t") == "inlineStr":
                line[place - 1] = texts(cell)
            else:
                line[place - 1] = "" if value is None else value.text or ""
        out.append(line)
    return out


def workbook_rows(data: bytes, wanted: str) -> list[dict[str, str]]:
    """Rows below the header line, the first of HEADER_ROWS rows that holds ``wanted``; repeated headings are an error."""
    cells = _cells(data)
    at = next((k for k, row in enumerate(cells[:HEADER_ROWS]) if wanted in [c.strip() for c in row]), None)
    if at is None:
        raise ValueError(f"no header row with {wanted}")
    heads = [c.strip() for c in cells[at]]
    named = [h for h in heads if h]
    if len(set(named)) < len(named):
        raise ValueError("repeated column headings")
    return [{h: (row[k].strip() if k < len(row) else "") for k, h in enumerate(heads) if h} for row in cells[at + 1:] if any(c.strip() for c in row)]


def read_workbooks(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """(path, row map) of the first sheet of every XLSX file; a workbook that can't be read is a row with an error."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(name, r, None) for r in workbook_rows(bytes(content), wanted)]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as problem:
                    rows.append((name, None, str(problem)))
            yield pd.DataFrame(rows, columns=["path", "row", "error"])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row map<string,string>, error string")
