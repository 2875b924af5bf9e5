"""Where in a page's HTML its paragraphs stand, and which element holds each of them.

The tokens of ``functions.html`` become rows; their places are running sums of their lengths, the depth of articles and hidden elements running sums of
their tags, all within a page. Places are code points of the HTML without the four control characters that mark tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H


#: Elements that are looked at as places of paragraphs.
HOLDERS = ("article", "section", "main", "aside", "nav", "div")
#: Elements and paragraphs meet in ranges of so many characters.
RANGE = 1 << 14


def _tokens(pages: DataFrame) -> DataFrame:
    """source_id, k, token, name, meaning, start, end of every token."""
    clean = F.translate(F.coalesce(F.col("html"), F.lit("")), H.MARKS, "")
    rows = pages.select(F.col("page_id").alias("source_id"), F.posexplode(F.regexp_extract_all(clean, F.lit(H.TOKEN), F.lit(0))).alias("k", "token"))
    rows = rows.withColumn("name", F.lower(F.regexp_extract("token", H.NAME, 1)))
    order = Window.partitionBy("source_id").orderBy("k")
    end = F.sum(F.length("token")).over(order)
    return rows.withColumns({"meaning": H.meaning(F.struct("token", "name")), "end": end, "start": end - F.length("token")})


def paragraph_places(pages: DataFrame) -> DataFrame:
    """source_id, seq, start, end and text of every paragraph of every page (without headings): from its first character that isn't white space to its last."""
    order = Window.partitionBy("source_id").orderBy("k")
    page = Window.partitionBy("source_id")
    steps = {}
    for name, letter in (("article", "a"), ("hidden", "x")):
        moved = F.when(F.col("meaning") == H.REGION + letter.upper(), 1).when(F.col("meaning") == H.REGION + letter, -1).otherwise(0)
        steps[name] = moved
    rows = _tokens(pages).withColumns({f"_{n}": F.sum(m).over(order) for n, m in steps.items()})
    rows = rows.withColumns({n: F.col(f"_{n}") - F.least(F.lit(0), F.min(f"_{n}").over(order)) for n in steps})
    rows = rows.where(F.col("hidden") == 0).withColumn("articles", F.max(F.col("article") > 0).over(page))
    rows = rows.where((F.col("article") > 0) | ~F.col("articles") | F.col("meaning").isin(H.REGION + "a", H.REGION + "A"))
    ends = F.col("meaning").startswith(H.BREAK) | F.col("meaning").isin(H.REGION + "a", H.REGION + "A")
    rows = rows.withColumn("block", F.sum(ends.cast("int")).over(order))
    spoken = (F.col("name") == "") & ~F.col("token").startswith("<!") & (F.trim(F.regexp_replace("meaning", r"\s+", " ")) != "")
    lead = F.length("token") - F.length(F.regexp_replace("token", r"^\s+", ""))
    trail = F.length("token") - F.length(F.regexp_replace("token", r"\s+$", ""))
    said = F.when(F.col("meaning").startswith(H.REGION), "").otherwise(F.col("meaning"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", said.alias("m")))), lambda x: x["m"]), "")
    blocks = rows.groupBy("source_id", "block").agg(joined.alias("raw"), F.min(F.when(spoken, F.col("start") + lead)).alias("start"), F.max(F.when(spoken, F.col("end") - trail)).alias("end"))
    text = F.trim(F.regexp_replace(F.translate(H.decoded(F.translate("raw", H.BREAK, "")), H.HEADING + H.INLINE, ""), r"\s+", " "))
    blocks = blocks.where(~F.coalesce(F.translate("raw", H.BREAK, "").startswith(H.HEADING), F.lit(False))).withColumn("text", text).where(F.col("text") != "")
    seq = F.row_number().over(Window.partitionBy("source_id").orderBy("block")) - 1
    return blocks.select("source_id", seq.alias("seq"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "text")


def holders(pages: DataFrame, names: tuple[str, ...] = HOLDERS) -> DataFrame:
    """source_id, element, start and end of every element of the names: from its tag to its end tag, or to the end of the page without one. Ends without a start are nothing."""
    tokens = _tokens(pages)
    opens = F.col("name").isin(list(names))
    tags = tokens.where(opens | F.col("name").isin([f"/{n}" for n in names])).withColumns({"element": F.regexp_replace("name", "^/", ""), "step": F.when(opens, 1).otherwise(-1)})
    order = Window.partitionBy("source_id", "element").orderBy("k")
    tags = tags.withColumn("_sum", F.sum("step").over(order))
    low = F.least(F.lit(0), F.min("_sum").over(order))
    # an end that goes below all before it ends nothing
    stray = (F.col("step") < 0) & (F.col("_sum") == low) & (F.col("_sum") < F.coalesce(F.least(F.lit(0), F.min("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1))), F.lit(0)))
    tags = tags.withColumns({"stray": stray, "level": F.col("_sum") - low + F.when(F.col("step") < 0, 1).otherwise(0)}).where(~F.col("stray"))
    same = Window.partitionBy("source_id", "element", "level").orderBy("k")
    last = tokens.groupBy("source_id").agg(F.max("end").alias("page_end"))
    closed = tags.withColumn("closes", F.lead("end").over(same)).where(F.col("step") > 0).join(last, "source_id")
    return closed.select("source_id", "element", F.col("start").cast("int").alias("start"), F.coalesce("closes", "page_end").cast("int").alias("end"))


def held_by(places: DataFrame, elements: DataFrame, width: int = RANGE) -> DataFrame:
    """``places`` with the innermost of the elements that they start in, and where it starts; null where none does. An interval join by ranges of ``width`` characters."""
    ranges = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    spread = elements.select("source_id", "element", F.col("start").alias("element_start"), F.col("end").alias("element_end"), F.explode(ranges).alias("_range"))
    dealt = places.withColumn("_range", F.floor(F.col("start") / width))
    inside = (F.col("element_start") <= F.col("start")) & (F.col("start") < F.col("element_end"))
    best = dealt.select("source_id", "seq", "start", "_range").join(spread, ["source_id", "_range"]).where(inside).groupBy("source_id", "seq").agg(F.max(F.struct("element_start", "element")).alias("x"))
    return places.join(best, ["source_id", "seq"], "left").select(*places.columns, F.col("x.element").alias("element"), F.col("x.element_start").alias("element_start"))


def marked_places(pages: DataFrame, scored: DataFrame) -> DataFrame:
    """Chips of scored paragraphs of pages, with where they stand."""
    places = held_by(paragraph_places(pages), holders(pages))
    return places.drop("text").join(scored.select("source_id", "seq", "chip", "klass"), ["source_id", "seq"])


