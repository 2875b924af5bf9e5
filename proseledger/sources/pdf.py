"""Text of PDF files, by a pluggable parser."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PdfParser(Protocol):
    """Turns the bytes of a file into its text, with a line for each paragraph; raises ValueError if it can't."""

    def text(self, content: bytes) -> str: ...


class StubPdfParser:
    """For testing the plumbing: the strings that plain or deflated content streams show, in file order.

    Knows no fonts, no encryption and no layout: strings are UTF-16 if they have its mark and Latin-1 otherwise, and every move to
    another line starts a new one. Install a parser and wrap it in the same protocol for real files.
    """

    _STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.DOTALL)
    _SHOWN = re.compile(rb"<([0-9A-Fa-f\s]*)>|\(((?:[^()\\]|\\.)*)\)|(T\*|Td|TD|Tm|'|ET)(?![A-Za-z])", re.DOTALL)

    def text(self, content: bytes) -> str:
        if not content.startswith(b"%PDF"):
            raise ValueError("not a PDF file")
        lines = [""]
        for stream in self._STREAM.findall(content):
            try:
                stream = zlib.decompress(stream)
            except zlib.error:
                pass  # not deflated
            for digits, literal, move in self._SHOWN.findall(stream):
                if move:
                    lines.append("")
                    continue
                data = bytes.fromhex(digits.decode()) if digits else re.sub(rb"\\(.)", rb"\1", literal)
                lines[-1] += data[2:].decode("utf-16-be") if data.startswith(b"\xfe\xff") else data.decode("latin-1")
        return "\n".join(x for x in lines if x.strip())


def stub_pdf(text: Column) -> Column:
    """A file that the stub parser reads: each line of a text as one shown string."""
    shown = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.concat(F.lit("<FEFF"), F.hex(F.encode(x, "UTF-16BE")), F.lit("> Tj T*")))
    return F.concat(F.lit("%PDF-1.4\n1 0 obj <<>>\nstream\nBT\n"), F.array_join(shown, "\n"), F.lit("\nET\nendstream\nendobj\n")).cast("binary")


def parsed_pdfs(files: DataFrame, parser: PdfParser, lang: str = "en") -> DataFrame:
    """Of files (path, content): path, text, lang and error. A file that can't be parsed has a null text and the reason, and ends nothing."""
    kind = files.schema["path"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str | None] = []
            errors: list[str | None] = []
            for content in batch.column("content"):
                try:
                    texts.append(parser.text(content.as_py() or b""))
                    errors.append(None)
                except ValueError as why:
                    texts.append(None)
                    errors.append(str(why))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    out = files.select("path", "content").mapInArrow(parse, f"path {kind}, text string, error string")
    return out.select("path", "text", F.lit(lang).alias("lang"), "error")
