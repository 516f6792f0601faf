"""File sources: catalogs of folders, decoding, e-mail and office texts, event logs.

Scans are Spark's own readers; content is read only where a query asks for it. Parsers
of container formats run in ``mapInPandas`` and answer a bad file with a status row.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The extensions that are read.
EXTENSIONS = ["txt", "md", "json", "eml", "docx", "xlsx", "pptx", "pdf"]


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, ext, size of the known files below a folder; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), F.col("length").alias("size")).where(F.col("ext").isin(EXTENSIONS))


def source_id(name: Column) -> Column:
    """``doc_`` and eight digits of the name's md5: equal names in different folders are one source by design."""
    return F.concat(F.lit("doc_"), F.substring(F.md5(name), 1, 8))


def decoded(content: Column) -> Column:
    """UTF-8 without its mark, else Latin-1."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def _mail(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in frames:
        rows = []
        for path, content in zip(x["path"], x["content"]):
            try:
                m = email.message_from_bytes(bytes(content), policy=email.policy.default)
                body = m.get_body(preferencelist=("plain", "html"))
                rows.append((path, m["From"], m["To"], m["Subject"], body.get_content() if body else "", [p.get_filename() or "" for p in m.iter_attachments()], "ok"))
            except Exception as e:  # noqa: BLE001  a bad file is a row, not the end of the job
                rows.append((path, None, None, None, f"(error reading {path})", [], type(e).__name__))
        yield pd.DataFrame(rows, columns=["path", "sender", "receiver", "subject", "text", "attachments", "status"])


def mails(files: DataFrame) -> DataFrame:
    """Headers, body (plain before HTML) and attachment names of e-mail files (path, content)."""
    return files.select("path", "content").mapInPandas(_mail, "path string, sender string, receiver string, subject string, text string, attachments array<string>, status string")


#: The parts of a container that hold text, and the tags that end a paragraph.
PARTS = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "xlsx": r"xl/(?:sharedStrings|worksheets/sheet\d+)\.xml"}


def _office(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in frames:
        rows = []
        for path, content in zip(x["path"], x["content"]):
            try:
                pattern = re.compile(PARTS[path.rsplit(".", 1)[-1].lower()])
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    trees = [ET.fromstring(z.read(n)) for n in sorted(z.namelist()) if pattern.fullmatch(n)]
                blocks = ["".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for tree in trees for p in tree.iter() if p.tag.rsplit("}", 1)[-1] in ("p", "si")]
                rows.append((path, "\n".join(b for b in blocks if b.strip()), "ok"))
            except Exception as e:  # noqa: BLE001
                rows.append((path, f"(error reading {path})", type(e).__name__))
        yield pd.DataFrame(rows, columns=["path", "text", "status"])


def office_texts(files: DataFrame) -> DataFrame:
    """Text of docx, pptx and xlsx files (path, content); a file that can't be read gives a row with its error."""
    return files.select("path", "content").mapInPandas(_office, "path string, text string, status string")


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*order)).alias("r")).select("r.*")
