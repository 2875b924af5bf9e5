"""Licence scan: ordered signature rules behind a keyword filter; overlapping detections are settled by priority.

DataFrame functions only. A text is first looked at for a few substrings (``ROOTS``), of which every rule needs one.
The texts that hold one are written as lower-case words, and of the hundreds of rules only those are tried whose
keyword is there. A detection counts unless it lies within one of higher priority, or within an earlier, longer or
lower-numbered one of the same priority. Base phrases always count.

The score of a text is the largest weight of its detections that count.

Cases: a null text counts as empty and has no words; texts without detections have null places, empty labels and score 0;
repeated rows are scanned apart; an empty table gives an empty one; long texts are scanned whole; further columns are not carried.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .license_rules import NARROWED, ROOTS, Rule, rules
from .shared import staged, text_of

#: Fixed value: a word, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _words_in(part: Column) -> Column:
    """Words of a part of a text in which each word has a space on either side."""
    return (F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2


def detections(texts: DataFrame, table: list[Rule]) -> DataFrame:
    """Of (uid, words), where words is a text with a space before and after each word: uid, label, base, weight and place of all detections that count."""
    listed = F.array(*(F.struct(F.lit(r.number).alias("number"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern")) for r in table))
    tried = texts.select("uid", "words", F.explode(F.filter(listed, lambda r: F.contains("words", r["keyword"]))).alias("r"))
    # each text is searched once for each rule: hits are marked where they stand, so that gaps and hits take turns
    marked = tried.select("uid", "r.number", F.regexp_replace("words", F.col("r.pattern"), F.lit("\u0001$0\u0001")).alias("marked")).where(F.contains("marked", F.lit("\u0001")))
    found = marked.select("uid", "number", F.posexplode(F.split("marked", "\u0001")).alias("k", "part"))
    found = found.select("uid", "number", "k", _words_in(F.col("part")).alias("long"))
    upto = Window.partitionBy("uid", "number").orderBy("k")
    found = found.withColumn("last", (F.sum("long").over(upto) - 1).cast("long")).where(F.col("k") % 2 == 1)
    known = texts.sparkSession.createDataFrame([(r.number, r.label, r.priority, r.weight, r.base) for r in table], "number int, label string, priority int, weight double, base boolean")
    found = found.join(F.broadcast(known), "number").withColumn("first", (F.col("last") - F.col("long") + 1).cast("long"))
    earlier = Window.partitionBy("uid").orderBy("first", F.desc("last"), F.desc("priority"), "number").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r.priority for r in table})
    inside = F.lit(False)
    for level in levels:  # ends of what starts no later, at this priority or a higher one
        reach = F.max(F.when(F.col("priority") >= level, F.col("last"))).over(earlier)
        inside = F.when(F.col("priority") == level, F.coalesce(reach >= F.col("last"), F.lit(False))).otherwise(inside)
    return found.withColumn("inside", inside).where(F.col("base") | ~F.col("inside")).select("uid", "label", "base", "weight", "first")


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(labels)), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_base, first_word, last_word (places of base phrases), base_labels, labels, score.

    The texts are read once. Only those that hold a root are shuffled, as words, so that matching them is spread over all tasks.
    """
    spark = docs.sparkSession
    table = rules() if table is None else table

    def rooted(low: Column) -> Column:
        out = F.lit(False)
        for root in ROOTS:
            holds = F.contains(low, F.lit(root))
            out = out | (holds & low.rlike(NARROWED[root]) if root in NARROWED else holds)
        return out

    text = F.col("text")
    words = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(_lowered(text), F.lit(WORD), F.lit(0)), "  "), F.lit(" "))
    # the array of one binds the lower-case text, so that it is made once for all roots
    has_root = F.transform(F.array(F.lower(text)), rooted)[0]
    rows = docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text"))
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "id", F.regexp_count("text", F.lit(_WORD_ANY_CASE)).cast("long").alias("n_words"), F.when(has_root, words).alias("words"))
    rows = staged(rows, "license-texts")
    gated = rows.select("uid", "words").where(F.col("words").isNotNull())
    gated = gated.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "uid")
    base = F.when(F.col("base"), F.col("first"))
    found = detections(gated, table).groupBy("uid").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        _joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), _joined(F.col("label")).alias("labels"), F.max("weight").alias("score"),
    )
    empty = {"n_base": F.lit(0).cast("long"), "first_word": F.lit(None).cast("long"), "last_word": F.lit(None).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    out = rows.select("uid", "id", "n_words").join(found, "uid", "left").select("id", "n_words", *(F.coalesce(F.col(c), v).alias(c) for c, v in empty.items()))
    return out.withColumnRenamed("id", id_col)


def oracle_sql() -> str:
    """The scan of documents in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({r.number}, {quote(r.label)}, {quote(r.keyword)}, {quote(r.pattern)}, {r.priority}, {r.weight}, {r.base})" for r in rules())
    roots = " OR ".join(f"contains(lower(text), {quote(r)})" for r in ROOTS)
    return f"""
WITH rules(number, label, keyword, pattern, priority, weight, base) AS (VALUES {values}),
docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS w FROM documents),
texts AS (SELECT doc_id, ' ' || array_to_string(w, '  ') || ' ' AS words FROM docs WHERE {roots}),
tried AS (SELECT doc_id, number, string_split_regex(words, pattern) AS parts, regexp_extract_all(words, pattern) AS hits FROM texts JOIN rules ON contains(words, keyword)),
pieces AS (SELECT doc_id, number, unnest(parts) AS part, unnest(hits) AS hit, unnest(generate_series(1, len(parts))) AS k FROM tried WHERE len(hits) > 0),
sized AS (SELECT doc_id, number, k, (length(part) - length(replace(part, ' ', ''))) // 2 AS gap, coalesce((length(hit) - length(replace(hit, ' ', ''))) // 2, 0) AS long FROM pieces),
placed AS (SELECT *, sum(gap + long) OVER (PARTITION BY doc_id, number ORDER BY k) - 1 AS last FROM sized),
found AS (SELECT doc_id, p.number, last, last - long + 1 AS first, label, priority, weight, base FROM placed p JOIN rules USING (number) WHERE long > 0),
kept AS (SELECT * FROM found f WHERE base OR NOT EXISTS (SELECT 1 FROM found g WHERE g.doc_id = f.doc_id AND g.first <= f.first AND g.last >= f.last AND
    (g.priority > f.priority OR (g.priority = f.priority AND (g.first < f.first OR g.last > f.last OR g.number < f.number))))),
summed AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score FROM kept GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM docs d LEFT JOIN summed USING (doc_id)
"""
