"""The language of text that doesn't declare one, by profiles of three letters in a row.

Profiles are learned from texts of known language: counts of the three-letter parts of words (with a mark at either end of a word), of
which each language's commonest are kept. A text's score for a language is the sum of the log-likelihoods of its parts among those
kept; the best score tells the language. Likelihoods are whole millionths, so that sums are exact in any order.

The profiles are a table of at most ``kept`` rows for each language, so it is broadcast; learning and telling take one shuffle of counts each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..folders import staged

#: Parts that each language keeps, and how many languages there may be: together the bound of what is broadcast.
KEPT, MOST_LANGUAGES = 4000, 64
NO_LETTERS = r"[^\p{L}]+"
#: Three characters, none of whose neighbours are two marks.
PART = r"(?=(.{3}))(?!__|.__)"


@dataclass
class Profiles:
    """Languages, and of each part kept its log-likelihood in each of them, in millionths."""

    languages: list[str]
    parts: DataFrame  # part string, likelihoods array<long>


def _parts(text: Column) -> Column:
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NO_LETTERS, "__")
    return F.regexp_extract_all(F.concat(F.lit("_"), F.regexp_replace(words, "^__|__$", ""), F.lit("_")), F.lit(PART), F.lit(1))


def learn_profiles(texts: DataFrame, text_col: str = "text", lang_col: str = "lang", kept: int = KEPT) -> Profiles:
    """From all texts with a language. Of equally common parts the smaller is kept; what a language lacks counts as less than one."""
    known = texts.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & (F.col("lang") != ""))
    counts = staged(known.select("lang", F.explode(_parts(F.col("text"))).alias("part")).groupBy("lang", "part").agg(F.count("*").alias("n")), "language-parts")
    languages = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    common = Window.partitionBy("lang").orderBy(F.desc("n"), "part")
    best = counts.withColumn("rank", F.row_number().over(common)).where(F.col("rank") <= kept).select("part").distinct()
    wide = counts.join(F.broadcast(best), "part").groupBy("part").agg(F.count("*").alias("languages"), *(F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, x in enumerate(languages)))
    wide = staged(wide, "language-profiles")
    # one row: of each language how many parts there are, and how many kinds of parts
    sums = wide.agg(F.count("*").alias("kinds"), *(F.sum(f"n{k}").alias(f"all{k}") for k in range(len(languages)))).first()
    likelihood = [F.round(F.log((F.col(f"n{k}") + 0.5) / float(sums[f"all{k}"] + 0.5 * sums["kinds"])) * 1e6).cast("long") for k in range(len(languages))] if languages else []
    return Profiles(languages, wide.select("part", F.array(*likelihood).cast("array<long>").alias("likelihoods")))


def detect(texts: DataFrame, profiles: Profiles, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` (which tell rows apart), detected, n_parts and margin: by how many millionths a part the language is likelier than the next.

    A text without known parts (null, empty, another script) has null, 0 and null. Of equally likely languages the first by name is taken.
    """
    scores = [F.coalesce(F.sum(F.col("likelihoods")[k]), F.lit(0)) for k in range(len(profiles.languages))]
    rows = texts.select(*keys, F.explode_outer(_parts(F.col(text_col))).alias("part")).join(F.broadcast(profiles.parts), "part", "left")
    summed = rows.groupBy(*keys).agg(F.count("likelihoods").alias("n_parts"), F.array(*scores).cast("array<long>").alias("scores"))
    named = F.array(*map(F.lit, profiles.languages)).cast("array<string>")
    best = F.array_max("scores")
    second = F.element_at(F.array_sort("scores"), -2) if len(profiles.languages) > 1 else best
    known = F.col("n_parts") > 0
    return summed.select(
        *keys, F.when(known, F.element_at(named, F.array_position("scores", best).cast("int"))).alias("detected"), "n_parts",
        F.when(known, F.floor((best - second) / F.col("n_parts"))).cast("long").alias("margin"),
    )


def with_language(paragraphs: DataFrame, profiles: Profiles, keys: list[str]) -> DataFrame:
    """Paragraphs whose lang is the declared one, or where none is declared the detected one."""
    silent = F.coalesce(F.col("lang"), F.lit("")) == ""
    found = detect(paragraphs.where(silent), profiles, keys).select(*keys, "detected")
    told = paragraphs.where(silent).join(found, keys, "left").withColumn("lang", F.col("detected")).select(*paragraphs.columns)
    return paragraphs.where(~silent).unionByName(told)
