"""Removal of lines that spread over many sites, by sketches of distinct sites for each line hash.

A HyperLogLog sketch of the sites is built for each line hash and merged by aggregation. Lines whose estimate lies
within ``margin`` of the threshold get an exact distinct count; the others are decided by the estimate, which can't be
that far off (the error of a sketch is 1.6 % at 12 bits; small sketches are exact). Of a line that is on ``min_sites``
sites or more, the first occurrence (by id, text hash and position) stays and every other one goes.

DataFrame functions only. Shuffles: line hashes with sketches; positions of removed lines; documents joined with them.

Cases: a null text counts as empty and becomes empty; lines of nothing but spaces always stay (other white space is a line like any other); a null site is no site; rows of the same id and
text are one document, so both keep or lose the same lines; an empty table gives an empty one; a document that loses
all lines stays, with an empty text; all columns of the input are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, fresh_name, staged, text_of

_KEY = ["_h1", "_h2"]


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One row for each line that isn't blank: document, position, 128 bits of hash, site."""
    rows = docs.select(docs[id_col].alias("_id"), F.xxhash64(text_of(text_col)).alias("_text"), docs[site_col].cast("string").alias("_site"), F.posexplode(F.split(text_of(text_col), "\n")).alias("_pos", "_line"))
    return rows.where(F.trim("_line") != "").select("_id", "_text", "_pos", "_site", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit("second"), "_line").alias("_h2"))


def spread_lines(lines: DataFrame, min_sites: int, lg_k: int = 12, margin: float = 0.2) -> DataFrame:
    """Keys of the lines that are on ``min_sites`` sites or more, each with its first occurrence."""
    sketches = lines.groupBy(*_KEY).agg(
        F.count("*").alias("n"),
        # null sites aren't counted; the prefix is there since sketches pass over empty strings
        F.hll_sketch_agg(F.concat(F.lit("="), "_site"), F.lit(lg_k)).alias("sites"),
        F.min(F.struct("_id", "_text", "_pos")).alias("first"),
    )
    # fewer lines than sites asked for need no estimate
    told = sketches.where(F.col("n") >= min_sites).select(*_KEY, "first", F.hll_sketch_estimate("sites").alias("estimate"))
    told = staged(told.where(F.col("estimate") >= min_sites * (1 - margin)), "line-spread")
    sure = told.where(F.col("estimate") > min_sites * (1 + margin))
    near = told.where(F.col("estimate") <= min_sites * (1 + margin))
    exact = lines.join(near.select(*_KEY), _KEY, "left_semi").groupBy(*_KEY).agg(F.count_distinct("_site").alias("sites"))
    near = near.join(exact.where(F.col("sites") >= min_sites), _KEY, "left_semi")
    return sure.select(*_KEY, "first").unionByName(near.select(*_KEY, "first"))


def drop_spread_lines(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", lg_k: int = 12, margin: float = 0.2, counts: bool = False) -> DataFrame:
    """``docs`` with the spread lines removed from the text column; with ``counts`` also n_lines and n_removed."""
    lines = staged(_lines(docs, id_col, text_col, site_col), "line-hashes")
    spread = spread_lines(lines, min_sites, lg_k, margin)
    place = F.struct("_id", "_text", "_pos")
    gone = lines.join(spread, _KEY).where(~place.eqNullSafe(F.col("first"))).groupBy("_id", "_text").agg(F.array_sort(F.collect_set("_pos")).alias("gone"))
    # which lines stay, up to the last one that goes; no line is looked for among the others, so time is linear in lines
    before = F.concat(F.array(F.lit(-1)), F.slice("gone", 1, F.size("gone") - 1))
    stays = F.flatten(F.zip_with(before, "gone", lambda last, this: F.concat(F.array_repeat(F.lit(True), this - last - 1), F.array(F.lit(False)))))
    at_id, at_text, at_stays = (fresh_name(docs, stem) for stem in ("_gone_id", "_gone_text", "_stays"))
    gone = gone.select(F.col("_id").alias(at_id), F.col("_text").alias(at_text), stays.alias(at_stays))
    both = docs.join(gone, docs[id_col].eqNullSafe(F.col(at_id)) & (F.xxhash64(text_of(text_col)) == F.col(at_text)), "left")
    parts = F.split(text_of(text_col), "\n")
    marked = F.zip_with(parts, at_stays, lambda line, stay: F.struct(line.alias("line"), F.coalesce(stay, F.lit(True)).alias("stay")))
    left = F.transform(F.filter(marked, lambda x: x["stay"]), lambda x: x["line"])
    out = [column(docs, c) if c != text_col else F.when(F.col(at_stays).isNull(), text_of(text_col)).otherwise(F.array_join(left, "\n")).alias(c) for c in docs.columns]
    removed = F.size(F.filter(at_stays, lambda stay: ~stay))
    extra = [F.size(parts).cast("long").alias("n_lines"), F.when(F.col(at_stays).isNull(), 0).otherwise(removed).cast("long").alias("n_removed")]
    return both.select(*out, *(extra if counts else []))


ORACLE_SQL = """
WITH parts AS (SELECT doc_id, source, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, source, unnest(parts) AS line, unnest(generate_series(1, len(parts))) AS pos FROM parts),
spread AS (SELECT line, arg_min(doc_id, (doc_id, pos)) AS first_doc, arg_min(pos, (doc_id, pos)) AS first_pos FROM lines
    WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
marked AS (SELECT l.*, s.line IS NOT NULL AND NOT (s.first_doc = l.doc_id AND s.first_pos = l.pos) AS gone FROM lines l LEFT JOIN spread s USING (line))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""
