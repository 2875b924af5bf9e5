"""Column functions on addresses, languages and plain text; see ``html`` for pages. They match RE2 as well as Java, so that SQL elsewhere can do the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import page_paragraphs as article_paragraphs

__all__ = ["article_paragraphs", "host", "line_paragraphs", "page_language"]

LANG = r"""(?i)<html[^>]*\slang\s*=\s*["']?([a-z]+)"""
HOST = r"^[a-z]+://([^/:?#]+)"

def host(url: Column) -> Column:
    return F.regexp_extract(url, HOST, 1)


def page_language(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, LANG, 1))


def line_paragraphs(text: Column) -> Column:
    """The lines of a plain text, in order, trimmed and without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
