"""Text of PDF files by scanning their content streams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>|T\*|'|TD|Td|ET")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"(": b"(", b")": b")", b"\\": b"\\"}


def _string(raw: bytes) -> str:
    if raw[:1] == b"<":
        data = bytes.fromhex(re.sub(rb"\s", b"", raw[1:-1]).decode().ljust(2, "0"))
    else:
        data = re.sub(rb"\\([nrt()\\]|[0-7]{1,3})", lambda m: ESCAPES.get(m[1]) or bytes([int(m[1], 8) & 255]), raw[1:-1])
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("utf-8", "ignore") or data.decode("latin-1")


def pdf_text(content: bytes) -> str:
    """Shown strings of all streams, inflated where needed; a new line wherever a text object moves or ends. Streams without text objects are left out."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        data = m[1]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        if b"BT" not in data:
            continue
        said = "".join(_string(t) if t[:1] in b"(<" else "\n" for t in SHOWN.findall(data))
        out.append(re.sub(r"\n{2,}", "\n", said).strip())
    return "\n".join(x for x in out if sum(c.isalpha() for c in x) * 2 >= len(x.replace(" ", "").replace("\n", "")) > 0)


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the PDF files below ``path``; one file at a time in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [pdf_text(c) for c in pdf["content"]]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", F.col("content")).mapInPandas(run, "path string, text string")
