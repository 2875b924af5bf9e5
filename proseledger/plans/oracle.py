"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from ..functions import html as H
from ..functions import text as T
from ..operators import language as L
from ..operators.places import HOLDERS
from ..operators.report import CAVEAT
from ..schemas import CLASSES
from .queries import OVERLAP, SINGLE_PAGE, WINDOW


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _decoded(x: str) -> str:
    names = "MAP {" + ", ".join(f"{_quote(n)}: {_quote(c)}" for n, c in H.ENTITIES.items()) + "}"
    name = f"regexp_extract(e, {_quote(H.ENTITY)}, 1)"
    code = f"(CASE WHEN lower(substr({name}, 2, 1)) = 'x' THEN '0x' || substr({name}, 3) ELSE substr({name}, 2) END)::BIGINT"
    sound = " OR ".join(f"{code} BETWEEN {low} AND {high}" for low, high in H.CODE_POINTS)
    mark = f"CASE WHEN {name} = '' THEN NULL WHEN {name}[1:1] = '#' THEN CASE WHEN {sound} THEN chr({code}::INT) END ELSE {names}[{name}] END"
    part = f"CASE WHEN k = 1 THEN e ELSE coalesce({mark} || substr(e, length({name}) + 2), '&' || e) END"
    return f"array_to_string(list_transform(string_split({x}, '&'), lambda e, k: {part}), '')"


def _mark(marks: str) -> str:
    return " || ".join(f"chr({ord(c)})" if ord(c) < 32 else _quote(c) for c in marks)


def _meaning(t: str) -> str:
    listed = lambda names: "(" + ", ".join(map(_quote, names)) + ")"
    name = f"lower(regexp_extract({t}, {_quote(H.NAME)}, 1))"
    bare, opens = f"ltrim({name}, '/')", f"{name}[1:1] <> '/'"
    return (
        f"CASE WHEN {t}[1:1] <> '<' OR {t} = '<' THEN {t} WHEN {name} = '' OR {name} IN {listed(H.RAW)} THEN '' "
        f"WHEN {bare} = 'article' THEN CASE WHEN {opens} THEN {_mark(H.REGION + 'A')} ELSE {_mark(H.REGION + 'a')} END "
        f"WHEN {bare} IN {listed(H.HIDDEN)} THEN CASE WHEN NOT {opens} THEN {_mark(H.REGION + 'x')} WHEN {t}[-2:] = '/>' THEN {_mark(H.INLINE)} ELSE {_mark(H.REGION + 'X')} END "
        f"WHEN {bare} IN {listed(H.HEADINGS)} THEN CASE WHEN {opens} THEN {_mark(H.BREAK + H.HEADING)} ELSE {_mark(H.BREAK)} END "
        f"WHEN {bare} IN {listed(H.BLOCKS)} THEN {_mark(H.BREAK)} WHEN {bare} = 'br' THEN ' ' ELSE {_mark(H.INLINE)} END"
    )


_TOKENS = f"regexp_extract_all(translate(coalesce(html, ''), {_mark(H.MARKS)}, ''), {_quote(H.TOKEN_RE2)})"


def _pages(headings: bool = False) -> str:
    """The depth of a part is what has been opened less what has been closed, above the lowest that it has been."""
    marked = f"array_to_string(list_transform({_TOKENS}, lambda t: {_meaning('t')}), '')"
    parts = f"SELECT page_id, lower(regexp_extract(html, {_quote(T.LANG)}, 1)) AS lang, string_split('-' || {_decoded(marked)}, {_mark(H.REGION)}) AS p FROM pages"
    stepped = f"SELECT page_id, lang, generate_subscripts(p, 1) AS k, unnest(p) AS part FROM ({parts})"
    moved = f"SELECT *, CASE part[1:1] WHEN 'A' THEN 1 WHEN 'a' THEN -1 ELSE 0 END AS da, CASE part[1:1] WHEN 'X' THEN 1 WHEN 'x' THEN -1 ELSE 0 END AS dx FROM ({stepped})"
    summed = f"SELECT *, sum(da) OVER w AS sa, sum(dx) OVER w AS sx FROM ({moved}) WINDOW w AS (PARTITION BY page_id ORDER BY k)"
    deep = f"SELECT *, sa > least(0, min(sa) OVER w) AS inside, sx > least(0, min(sx) OVER w) AS hidden FROM ({summed}) WINDOW w AS (PARTITION BY page_id ORDER BY k)"
    shown = f"SELECT *, bool_or(inside) OVER (PARTITION BY page_id) AS articles, CASE WHEN lower(part[1:1]) = 'a' THEN chr(1) ELSE '' END || part[2:] AS text FROM ({deep}) WHERE NOT hidden"
    joined = f"SELECT page_id, lang, string_split(string_agg(text, '' ORDER BY k), chr(1)) AS b FROM ({shown}) WHERE inside OR NOT articles GROUP BY page_id, lang"
    kept = "b" if headings else "list_filter(b, lambda x: x[1:1] <> chr(3))"
    blocks = f"list_filter(list_transform({kept}, lambda x: trim(regexp_replace(translate(x, chr(3) || chr(6), ''), '\\s+', ' ', 'g'))), lambda x: x <> '')"
    return (
        f"SELECT 'page' AS source_kind, page_id AS source_id, (unnest(generate_series(1, len(p))) - 1)::INT AS seq, lang, unnest(p) AS text "
        f"FROM (SELECT page_id, lang, {blocks} AS p FROM ({joined}))"
    )


_DOCUMENTS = (
    "SELECT 'document' AS source_kind, doc_id AS source_id, (unnest(generate_series(1, len(p))) - 1)::INT AS seq, lang, unnest(p) AS text "
    "FROM (SELECT doc_id, lang, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS p FROM documents)"
)
_HOST = f"regexp_extract(url, {_quote(T.HOST)}, 1)"
_GRANTED = f"SELECT page_id, url FROM pages WHERE {_HOST} IN (SELECT DISTINCT {_HOST} FROM pages WHERE {_HOST} < 'n')"


def _number(at: int, n: int) -> str:
    return f"('0x' || substr(md5(text), {at}, {n}))::INT::DOUBLE"


def _score(paragraphs: str) -> str:
    weights = [f"({_number(5 + 2 * k, 2)} + 1)" for k in range(4)]
    total = " + ".join(weights)
    parts = ", ".join(f"{w} / ({total}) AS {name}" for w, name in zip(weights, ("human", "light", "heavy", "ai"), strict=True))
    return (
        f"SELECT *, CASE WHEN floor(score * 100 + 0.5) >= 100 THEN '1.0' ELSE '.' || lpad(floor(score * 100 + 0.5)::INT::VARCHAR, 2, '0') END AS chip, "
        f"(score >= 0.25)::INT + (score >= 0.5)::INT + (score >= 0.75)::INT AS klass FROM "
        f"(SELECT *, sha256(text) AS text_sha256, 'stub-md5' AS model_id, {_number(1, 4)} / 65535.0 AS score, {parts} FROM ({paragraphs}) WHERE lang = 'en' AND length(text) >= 1)"
    )


_PDF = _DOCUMENTS.replace("'document' AS", "'pdf' AS").replace(", lang, unnest", ", 'en' AS lang, unnest").replace("SELECT doc_id, lang,", "SELECT doc_id,")
_EXPORTED = (
    f"SELECT 'export' AS source_kind, 'd' || source_id || '.txt' AS source, seq, 'en' AS lang, text FROM ({_DOCUMENTS}) UNION ALL "
    f"SELECT 'export' AS source_kind, 'p' || source_id || '.html' AS source, seq, CASE WHEN lang = '' THEN 'en' ELSE lang END AS lang, text FROM ({_pages()})"
)
_SCORED, _SCORED_DOCUMENTS = _score(_pages()), _score(_DOCUMENTS)
_ROUNDED = "source_kind, source_id, seq, text_sha256, model_id, round(score, 9) AS score, round(human, 9) AS human, round(light, 9) AS light, round(heavy, 9) AS heavy, round(ai, 9) AS ai, klass, chip"
_COUNT = "SELECT source_id, count(*) AS n_analyzed, count(*) FILTER (klass = 3) AS n_ai, round(count(*) FILTER (klass = 3) / count(*), 9) AS ai_share FROM ({}) GROUP BY 1"
_WARM = f"SELECT DISTINCT text_sha256 FROM ({_SCORED}) WHERE source_id % 2 = 0"
_NAMES = "CASE klass " + " ".join(f"WHEN {k} THEN {_quote(n)}" for k, n in enumerate(CLASSES)) + " END"

#: The checksum of a number's decimal digits, bit by bit.
_CRC = (
    "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: "
    "list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), 4294967295::BIGINT), 4294967295)"
)


def _mark_places() -> str:
    """Paragraphs by their tokens' places, with the innermost element whose tag stands before and whose end behind their start: the one opened last of those still open."""
    holders = "(" + ", ".join(_quote(x) for n in HOLDERS for x in (n, "/" + n)) + ")"
    article, hidden = (f"CASE meaning WHEN {_mark(H.REGION + x.upper())} THEN 1 WHEN {_mark(H.REGION + x)} THEN -1 ELSE 0 END" for x in "ax")
    ends = f"(meaning[1:1] = chr(1) OR meaning IN ({_mark(H.REGION + 'A')}, {_mark(H.REGION + 'a')}))"
    spoken = "(name = '' AND token[1:2] <> '<!' AND trim(regexp_replace(meaning, '\\s+', ' ', 'g')) <> '')"
    return f"""
    WITH cut AS (SELECT page_id, {_TOKENS} AS t FROM pages),
    tokens AS (SELECT page_id, k, token, lower(regexp_extract(token, {_quote(H.NAME)}, 1)) AS name, {_meaning("token")} AS meaning, sum(length(token)) OVER (PARTITION BY page_id ORDER BY k) AS stop
        FROM (SELECT page_id, generate_subscripts(t, 1) AS k, unnest(t) AS token FROM cut)),
    summed AS (SELECT *, sum({article}) OVER w AS sa, sum({hidden}) OVER w AS sx FROM tokens WINDOW w AS (PARTITION BY page_id ORDER BY k)),
    deep AS (SELECT *, sa > least(0, min(sa) OVER w) AS inside, sx > least(0, min(sx) OVER w) AS hidden FROM summed WINDOW w AS (PARTITION BY page_id ORDER BY k)),
    shown AS (SELECT *, bool_or(inside) OVER (PARTITION BY page_id) AS articles FROM deep WHERE NOT hidden),
    blocked AS (SELECT *, sum({ends}::INT) OVER (PARTITION BY page_id ORDER BY k) AS block FROM shown WHERE inside OR NOT articles OR {ends}),
    blocks AS (SELECT page_id, block, string_agg(CASE WHEN meaning[1:1] = chr(2) THEN '' ELSE translate(meaning, chr(1), '') END, '' ORDER BY k) AS raw,
        min(stop - length(ltrim(token, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) FILTER ({spoken}) AS start, max(stop - length(token) + length(rtrim(token, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) FILTER ({spoken}) AS stop FROM blocked GROUP BY 1, 2),
    told AS (SELECT *, trim(regexp_replace(translate({_decoded("raw")}, chr(3) || chr(6), ''), '\\s+', ' ', 'g')) AS text FROM blocks WHERE raw[1:1] <> chr(3)),
    places AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY block) - 1 AS seq, start, stop FROM told WHERE text <> ''),
    tags AS (SELECT page_id, ltrim(name, '/') AS element, k, stop - length(token) AS start, stop, CASE WHEN name[1:1] = '/' THEN -1 ELSE 1 END AS step FROM tokens WHERE name IN {holders}),
    levels AS (SELECT *, sum(step) OVER w AS s FROM tags WINDOW w AS (PARTITION BY page_id, element ORDER BY k)),
    floors AS (SELECT *, s - least(0, min(s) OVER w) AS depth FROM levels WINDOW w AS (PARTITION BY page_id, element ORDER BY k)),
    elements AS (SELECT page_id, element, start, coalesce((SELECT min(c.stop) FROM floors c WHERE c.page_id = o.page_id AND c.element = o.element AND c.k > o.k AND c.step < 0 AND c.depth < o.depth), 1e9) AS stop FROM floors o WHERE step > 0),
    held AS (SELECT p.page_id, p.seq, arg_max(e.element, e.start) AS element, max(e.start) AS element_start FROM places p JOIN elements e ON e.page_id = p.page_id AND e.start <= p.start AND p.start < e.stop GROUP BY 1, 2)
    SELECT p.page_id AS source_id, p.seq::INT AS seq, p.start::INT AS start, p.stop::INT AS "end", element, element_start::INT AS element_start, chip, klass
    FROM places p JOIN ({_SCORED}) s ON s.source_id = p.page_id AND s.seq = p.seq LEFT JOIN held h ON h.page_id = p.page_id AND h.seq = p.seq"""


def _parts(rows: str) -> str:
    """Of rows with a text, each with every part of its words."""
    words = f"'_' || regexp_replace(regexp_replace(lower(coalesce(text, '')), {_quote(L.NO_LETTERS)}, '__', 'g'), '^__|__$', '', 'g') || '_'"
    parts = "list_filter(list_transform(range(1, greatest(len(c) - 1, 1)), lambda i: c[i] || c[i + 1] || c[i + 2]), lambda x: NOT contains(x, '__'))"
    return f"SELECT * EXCLUDE (c), unnest({parts}) AS part FROM (SELECT *, string_split({words}, '') AS c FROM ({rows}))"


def _detected(rows: str, keys: str, learned: str = "SELECT lang, text FROM documents") -> str:
    """The likelihood of a part in each language, summed by text and language; the best two are compared."""
    return f"""
    WITH counts AS (SELECT lang, part, count(*) AS n FROM ({_parts(f"SELECT * FROM ({learned}) WHERE lang <> ''")}) GROUP BY 1, 2),
    kept AS (SELECT DISTINCT part FROM (SELECT part, row_number() OVER (PARTITION BY lang ORDER BY n DESC, part) AS rank FROM counts) WHERE rank <= {L.KEPT}),
    likely AS (SELECT lang, part, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY lang) AS total, count(*) OVER (PARTITION BY lang) AS kinds
        FROM (SELECT DISTINCT lang FROM counts) CROSS JOIN kept LEFT JOIN counts USING (lang, part)),
    profile AS (SELECT lang, part, round(ln((n + 0.5::DOUBLE) / (total + 0.5 * kinds)::DOUBLE) * 1e6)::BIGINT AS likelihood FROM likely),
    rows AS ({rows}),
    scored AS (SELECT {keys}, lang AS detected, count(*) AS n_parts, sum(likelihood) AS score FROM ({_parts("SELECT * FROM rows")}) JOIN profile USING (part) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER w AS rank, score - lead(score) OVER w AS ahead FROM scored WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC, detected))
    SELECT {keys}, detected, coalesce(n_parts, 0)::BIGINT AS n_parts, floor(ahead / n_parts)::BIGINT AS margin FROM (SELECT {keys} FROM rows) LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) USING ({keys})"""


_WINDOWS = (
    f"SELECT source_kind, source_id, seq, lang, array_to_string(w[1 + k * {WINDOW - OVERLAP} : k * {WINDOW - OVERLAP} + {WINDOW}], ' ') AS text FROM (SELECT *, unnest(range(0, 1 + greatest(ceil((len(w) - {WINDOW}) / {WINDOW - OVERLAP}), 0)::BIGINT)) AS k "
    f"FROM (SELECT *, string_split(text, ' ') AS w FROM ({_pages()}) WHERE lang = 'en'))"
)
_N_WORDS = "len(string_split(text, ' '))"
_WINDOWED = f"SELECT source_id, seq, sum(score * {_N_WORDS}) / sum({_N_WORDS}) AS score, sum(ai * {_N_WORDS}) / sum({_N_WORDS}) AS ai, count(*) AS n_windows FROM ({_score(_WINDOWS)}) GROUP BY ALL"
_BOTH = f"SELECT source_kind, source_id, seq, score, klass FROM ({_SCORED}) UNION ALL SELECT source_kind, source_id, seq, score, klass FROM ({_SCORED_DOCUMENTS})"

_TURNS = _detected("SELECT conv_id, turn, text FROM conversations", "conv_id, turn")
_HELD = f"{_CRC} % 5"

ORACLE_SQL: dict[str, str] = {
    "web_pages": f"SELECT page_id, url, {_HOST} AS host, length(html)::BIGINT AS n_chars FROM pages",
    "granted_pages": _GRANTED,
    "single_page": f"SELECT * FROM ({_pages()}) WHERE source_id = {SINGLE_PAGE}",
    "admitted_pages": f"{_GRANTED} UNION SELECT page_id, url FROM pages WHERE page_id = {SINGLE_PAGE}",
    "page_paragraphs": _pages(),
    "page_paragraphs_with_headings": _pages(True),
    "document_paragraphs": _DOCUMENTS,
    "english_paragraphs": f"SELECT * FROM ({_pages()}) WHERE lang = 'en'",
    "long_paragraphs": f"SELECT * FROM ({_pages()}) WHERE lang = 'en' AND length(text) >= 50",
    "scored_paragraphs": f"SELECT {_ROUNDED} FROM ({_SCORED})",
    "scored_documents": f"SELECT {_ROUNDED} FROM ({_SCORED_DOCUMENTS})",
    "model_scored_paragraphs": f"SELECT {_ROUNDED} FROM ({_SCORED})",
    "class_counts": f"SELECT klass, count(*) AS n, {_NAMES} AS name FROM ({_SCORED}) GROUP BY klass",
    "chips": f"SELECT chip, count(*) AS n FROM ({_SCORED}) GROUP BY chip",
    "marks": f"SELECT source_id, seq, chip, klass FROM ({_SCORED}) WHERE klass IN (2, 3)",
    "page_ai_count": _COUNT.format(_SCORED),
    "page_ai_list": f"SELECT source_id, coalesce(string_agg(seq || ' ' || text, chr(10) ORDER BY seq) FILTER (klass = 3), '') AS ai_paragraphs FROM ({_SCORED}) GROUP BY 1",
    "page_report": f"SELECT source_id, concat_ws(chr(10), count(*) FILTER (klass = 3) || ' of ' || count(*) || ' paragraphs read as AI-generated', "
    f"string_agg(chip || ' ' || text, chr(10) ORDER BY seq) FILTER (klass = 3), 'Model: stub-md5. {CAVEAT}') AS report FROM ({_SCORED}) GROUP BY 1",
    "document_ai_count": _COUNT.format(_SCORED_DOCUMENTS),
    "top_paragraphs": f"SELECT source_id, seq, rank, chip FROM (SELECT source_id, seq, chip, (row_number() OVER (PARTITION BY source_id ORDER BY score DESC, seq))::INT AS rank FROM ({_SCORED})) WHERE rank <= 3",
    "site_summary": f"SELECT {_HOST} AS host, count(DISTINCT page_id) AS n_pages, count(*) AS n_analyzed, count(*) FILTER (klass = 3) AS n_ai FROM ({_SCORED}) JOIN pages ON page_id = source_id GROUP BY 1",
    "mixed_ai_count": _COUNT.format(f"SELECT * FROM ({_SCORED}) UNION ALL SELECT * FROM ({_SCORED_DOCUMENTS})").replace("SELECT source_id", "SELECT source_kind, source_id").replace("GROUP BY 1", "GROUP BY ALL"),
    "pdf_ai_count": _COUNT.format(_score(_PDF)),
    "exported_paragraphs": f"SELECT source, seq, lang, text FROM ({_EXPORTED})",
    "exported_ai_count": _COUNT.format(_score(_EXPORTED)).replace("source_id", "source"),
    "corpus_report": f"SELECT source_kind, klass, count(*) AS n, round(avg(score), 6) AS mean_score FROM (SELECT source_kind, klass, score FROM ({_SCORED}) UNION ALL SELECT source_kind, klass, score FROM ({_SCORED_DOCUMENTS})) GROUP BY ROLLUP (source_kind, klass)",
    "class_columns": f"SELECT source_id, count(*) FILTER (klass = 0) AS n_human, count(*) FILTER (klass = 1) AS n_light, count(*) FILTER (klass = 2) AS n_heavy, count(*) FILTER (klass = 3) AS n_ai FROM ({_SCORED}) GROUP BY 1",
    "dedup_ratio": f"SELECT count(*) AS n, count(DISTINCT text_sha256) AS n_distinct FROM ({_SCORED})",
    "cache_hits": f"SELECT DISTINCT model_id, text_sha256, round(score, 9) AS score FROM ({_SCORED}) WHERE text_sha256 IN ({_WARM})",
    "cache_misses": f"SELECT DISTINCT text_sha256, text FROM ({_SCORED}) WHERE text_sha256 NOT IN ({_WARM})",
    "cached_scores": f"SELECT {_ROUNDED} FROM ({_SCORED})",
    "table_cached_scores": f"SELECT {_ROUNDED} FROM ({_SCORED})",
    "live_cached_scores": f"SELECT {_ROUNDED} FROM ({_SCORED})",
    "windowed_scores": f"SELECT source_id, seq, round(score, 9) AS score, round(ai, 9) AS ai, (score >= 0.25)::INT + (score >= 0.5)::INT + (score >= 0.75)::INT AS klass, n_windows FROM ({_WINDOWED})",
    "smoothed_scores": f"SELECT source_id, seq, round(score, 9) AS score, round(avg(score) OVER (PARTITION BY source_id ORDER BY seq RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS smoothed, "
    f"round(CASE WHEN lag(seq) OVER w = seq - 1 THEN score - lag(score) OVER w END, 9) AS change FROM ({_SCORED}) WINDOW w AS (PARTITION BY source_id ORDER BY seq)",
    "ai_runs": f"SELECT source_kind, source_id, min(seq) AS first, max(seq) AS last, count(*) AS n, round(avg(score), 9) AS mean_score FROM "
    f"(SELECT *, seq - row_number() OVER (PARTITION BY source_kind, source_id ORDER BY seq) AS run FROM ({_BOTH}) WHERE klass >= 2) GROUP BY source_kind, source_id, run",
    "site_quantiles": f"SELECT {_HOST} AS host, count(*) AS n, round(quantile_disc(score, 0.1), 9) AS low, round(quantile_disc(score, 0.5), 9) AS middle, round(quantile_disc(score, 0.9), 9) AS high FROM ({_SCORED}) JOIN pages ON page_id = source_id GROUP BY 1",
    "site_overlap": f"SELECT {_HOST} AS host, count(DISTINCT text_sha256) AS n_texts, count(DISTINCT text_sha256) FILTER (text_sha256 IN (SELECT text_sha256 FROM ({_SCORED_DOCUMENTS}))) AS n_shared FROM ({_SCORED}) JOIN pages ON page_id = source_id GROUP BY 1",
    "mark_places": _mark_places(),
    "detected_turns": _TURNS,
    "detected_items": _detected("SELECT item_id, text FROM benchmark", "item_id"),
    "language_confusion": f"SELECT declared AS lang, detected, count(*) AS n FROM ({_detected(f'SELECT doc_id, lang AS declared, text FROM documents WHERE {_HELD} = 0', 'doc_id, declared', f'SELECT lang, text FROM documents WHERE {_HELD} <> 0')}) GROUP BY 1, 2",
    "english_turns": f"SELECT {_ROUNDED} FROM ({_score(f"SELECT 'turn' AS source_kind, conv_id AS source_id, turn::INT AS seq, detected AS lang, text FROM ({_TURNS}) JOIN conversations USING (conv_id, turn)")})",
    "stream_page_ai_count": _COUNT.format(_SCORED),
    "stream_newest_ai_count": f"SELECT page_id AS source_id, coalesce(n_analyzed, 0) AS n_analyzed, coalesce(n_ai, 0) AS n_ai, ai_share FROM pages LEFT JOIN ({_COUNT.format(_SCORED)}) ON source_id = page_id",
}
