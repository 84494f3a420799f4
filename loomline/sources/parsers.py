"""Files to text: a parser per extension, run per file inside Arrow batches.

A file that can't be parsed is a row with an error, never a failed job.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse_text(data: bytes) -> str:
    """A whole file as strict UTF-8."""
    return data.decode("utf-8")


def parse_docx(data: bytes) -> str:
    """Paragraphs of the body that aren't blank, as they are, one a line; tables are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    marks = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n"}
    paragraphs = ["".join(marks[e.tag](e) for e in p.iter() if e.tag in marks) for p in body.findall(f"{_W}p")]
    return "\n".join(p for p in paragraphs if p.strip())


def parse_pdf(data: bytes) -> str:
    """Text of each page, one after the other; needs the optional pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("PDF files need pypdf, which is not installed") from e
    return "\n".join(page.extract_text() for page in PdfReader(io.BytesIO(data)).pages)


#: Extension -> parser; Markdown keeps its markup.
PARSERS: dict[str, Callable[[bytes], str]] = {"txt": parse_text, "md": parse_text, "pdf": parse_pdf, "docx": parse_docx}


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without a dot."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise(F.lit(""))


def upload_error(name: Column, size: Column) -> Column:
    """Why an upload is refused; null if it isn't."""
    ext = extension(name)
    return F.when(~ext.isin(*PARSERS), F.concat(F.lit("unsupported type: "), ext)).when(F.coalesce(size, F.lit(0)) <= 0, F.lit("empty file"))


def parsed(content: Column, file_type: Column) -> Column:
    """Struct (text, error) of a file's bytes by its type; an unknown type, or bytes that aren't of it, is an error."""

    def run(data: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        def one(d: bytes | None, kind: str | None) -> tuple[str | None, str | None]:
            try:
                if (kind or "").lower() not in PARSERS:
                    raise ValueError(f"unsupported type: {kind}")
                return PARSERS[kind.lower()](d or b""), None
            except Exception as e:  # noqa: BLE001  whatever a broken file does to its parser
                return None, f"{type(e).__name__}: {e}"

        return pd.DataFrame([one(d, k) for d, k in zip(data, kinds, strict=True)], columns=["text", "error"])

    return F.pandas_udf(run, "text string, error string")(content, file_type)


def read_files(spark, path: str) -> DataFrame:
    """file_name, file_type, file_size, text and error of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select(name.alias("file_name"), F.col("length").alias("file_size"), "content").withColumn("file_type", extension(F.col("file_name")))
    return out.withColumn("p", parsed(F.col("content"), F.col("file_type"))).select("file_name", "file_type", "file_size", "p.text", "p.error")
