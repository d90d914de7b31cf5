"""Documents as they are kept: their kind by their first bytes, and the text of docx and of simple pdf files."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: First bytes of kinds of files, in hexadecimal digits.
MAGIC = (("pdf", "25504446"), ("docx", "504B0304"), ("doc", "D0CF11E0A1B11AE1"))


def kind(content: Column) -> Column:
    """pdf, docx (any zip), doc, else html or text by the first sign that isn't white space; null for null."""
    head = F.hex(F.substring(content, 1, 8))
    known = F.coalesce(*(F.when(F.startswith(head, F.lit(m)), F.lit(k)) for k, m in MAGIC))
    start = F.decode(F.substring(content, 1, 200), "ISO-8859-1")
    return F.when(content.isNull(), F.lit(None)).otherwise(F.coalesce(known, F.when(start.rlike(r"^\s*<"), F.lit("html")), F.lit("text")))


def _docx(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    space = root.tag.split("}")[0] + "}"
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|')|\[(?:[^\]]|\\\])*\]\s*TJ|T\*|\bET\b", re.S)
_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)", re.S)


def _pdf(content: bytes) -> str:
    """Strings that the pages' streams show, where fonts map bytes to Latin characters; a line for each text object."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        try:
            body = zlib.decompressobj().decompress(m[1], 1 << 26)
        except zlib.error:
            body = m[1]
        line = b""
        for s in _SHOWN.finditer(body):
            if s[0] in (b"T*", b"ET"):
                out.append(line)
                line = b""
            else:
                line += b"".join(re.sub(rb"\\(.)", rb"\1", x[1:-1]) for x in _STRING.findall(s[0]))
        out.append(line)
    return "\n".join(x.decode("cp1252", "replace") for x in out if x.strip())


def text(content: bytes | None) -> str | None:
    """The text of a file; null where it can't be read (old doc files, broken ones)."""
    if content is None:
        return None
    try:
        if content.startswith(b"PK\x03\x04"):
            return _docx(content)
        if content.startswith(b"%PDF"):
            return _pdf(content)
        return None if content.startswith(bytes.fromhex("D0CF11E0A1B11AE1")) else content.decode("utf-8-sig")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, UnicodeDecodeError):
        return None


def text_of(content: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: text(None if x is None else bytes(x)))

    return run(content)
