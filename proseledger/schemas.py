"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

PAGES = "page_id bigint, url string, html string"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BREAKDOWN = "struct<human:double,light:double,heavy:double,ai:double>"
PARAGRAPH = "source_kind string, source_id bigint, seq int, lang string, text string"
SCORED = f"{PARAGRAPH}, text_sha256 string, model_id string, score double, breakdown {BREAKDOWN}, klass int, chip string"
SUMMARY = "source_id bigint, n_analyzed bigint, n_ai bigint, ai_share double"
SCORE_CACHE = f"model_id string, text_sha256 string, score double, breakdown {BREAKDOWN}"

#: The four classes in order of degree of editing.
CLASSES = ("human", "lightly edited", "heavily edited", "AI-generated")
