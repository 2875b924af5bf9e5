"""HTML to paragraphs, as column functions: a scanner of tokens, then a fold over the few of them that open and close regions.

The page is cut into tokens in one pass: comments, elements whose content is no markup (scripts, styles, the title and so on), declarations,
tags with their quoted attributes, and text. Each token becomes what it means for paragraphs: a block's tag ends one, an inline tag is nothing, a line break is a
space. Tags of articles and of hidden elements open and close regions, which may lie in one another; a fold over the parts between those tags
counts how deep each part lies, as the stack of a tree builder would. Tags that HTML lets authors leave out (html, head, body, the ends of p, li and
others) are never needed.

A page's paragraphs are the blocks of its articles, nested ones included, or of the whole page where no article is shown. Headings are blocks of their own.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that stand apart from what is before and after them.
BLOCKS = (
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset header hgroup hr legend li listing main menu nav noscript ol "
    "optgroup option p plaintext pre search section select summary table caption colgroup tbody td tfoot th thead tr ul video audio canvas object button"
).split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
#: Elements whose content is text up to their end tag, none of it shown as prose.
RAW = "script style title textarea iframe noembed noframes xmp".split()
#: Elements with markup in them that isn't shown as prose.
HIDDEN = "template svg math noscript canvas object audio video select".split()

#: What a tag holds: anything but its end, and quoted values behind an equals sign. At most so many values may be quoted, so that matching stays shallow.
_ATTRIBUTES = r"""(?>[^>=]+|=\s*(?>"[^"]*"|'[^']*')|=){0,300}+"""
_NAMED = rf"(?:[\s/]{_ATTRIBUTES})?>"
TOKEN = "|".join(
    [
        r"(?s:<!--.*?(?:-->|\z))",
        *(rf"(?is:<{name}{_NAMED}.*?(?:</{name}(?:[\s/][^>]*)?>|\z))" for name in RAW),
        r"<[!?][^>]*>",
        rf"</?[a-zA-Z]{_ATTRIBUTES}>",
        r"</?[a-zA-Z][^>]*>",
        r"[^<]+|<",
    ]
)
#: The same for RE2, which never goes back and has no bound on how deep it matches.
TOKEN_RE2 = TOKEN.replace("(?>", "(?:").replace("{0,300}+", "*")
NAME = r"^<(/?[a-zA-Z][^\s/>]*)"

#: Marks in the text made of the tokens: the end of a block, a heading, an inline tag, and before a letter a region's start (capital) or end.
BREAK, HEADING, INLINE, REGION = "\u0001", "\u0003", "\u0006", "\u0002"
MARKS = BREAK + REGION + HEADING + INLINE

#: Names of characters, as the standard library lists them; a no-break space is a space and a soft hyphen nothing.
#: The commonest stand first, since names are looked for in turn.
ENTITIES: dict[str, str] = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "shy": ""}
ENTITIES |= {name: chr(code) for name, code in name2codepoint.items() if name not in ENTITIES}
#: What follows the ampersand of an entity.
ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: Code points that a numeric entity may stand for: no controls but white space, no surrogates, none beyond the last.
CODE_POINTS = ((9, 10), (13, 13), (32, 0xD7FF), (0xE000, 0xFFFD), (0x10000, 0x10FFFF))


def decoded(text: Column) -> Column:
    """Entities as their characters, each once; what is no entity stays."""
    names = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))

    def part(y: Column, k: Column) -> Column:
        x, name = y["x"], y["name"]
        digits = F.substr(name, F.lit(2))
        code = F.when(F.lower(F.substring(digits, 1, 1)) == "x", F.conv(F.substr(digits, F.lit(2)), 16, 10)).otherwise(digits).cast("long")
        sound = F.lit(False)
        for low, high in CODE_POINTS:
            sound = sound | code.between(low, high)
        numeric = F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        mark = F.when(name == "", F.lit(None)).when(name.startswith("#"), numeric).otherwise(F.try_element_at(names, name))
        return F.when(k == 0, x).otherwise(F.coalesce(F.concat(mark, F.substr(x, F.length(name) + 2)), F.concat(F.lit("&"), x)))

    # names first, so that each is looked for once
    named = F.transform(F.split(text, "&"), lambda x: F.struct(x.alias("x"), F.regexp_extract(x, ENTITY, 1).alias("name")))
    return F.when(text.contains("&"), F.array_join(F.transform(named, part), "")).otherwise(text)


def meaning(named: Column) -> Column:
    """What a token with its name is for paragraphs: text, a mark, a space or nothing."""
    token, name = named["token"], named["name"]
    bare = F.when(name.startswith("/"), F.substr(name, F.lit(2))).otherwise(name)
    opens = ~name.startswith("/")
    hidden = F.when(~opens, REGION + "x").when(token.endswith("/>"), INLINE).otherwise(REGION + "X")
    return (
        F.when(~token.startswith("<") | (token == "<"), token)
        .when((name == "") | name.isin(RAW), "")
        .when(bare == "article", F.when(opens, REGION + "A").otherwise(REGION + "a"))
        .when(bare.isin(HIDDEN), hidden)
        .when(bare.isin(HEADINGS), F.when(opens, BREAK + HEADING).otherwise(BREAK))
        .when(bare.isin(BLOCKS), BREAK)
        .when(bare == "br", " ")
        .otherwise(INLINE)
    )


def _shown(parts: Column) -> Column:
    """Of the parts between regions' tags, those that aren't hidden, with whether an article holds them."""
    start = F.struct(F.lit(0).alias("article"), F.lit(0).alias("hidden"), F.array().cast("array<struct<inside:boolean,text:string>>").alias("shown"))

    def step(state: Column, part: Column) -> Column:
        code = F.substring(part, 1, 1)
        depth = lambda now, letter: F.greatest(now + F.when(code == letter.upper(), 1).when(code == letter, -1).otherwise(0), F.lit(0))
        article, hidden = depth(state["article"], "a"), depth(state["hidden"], "x")
        text = F.concat(F.when(F.lower(code) == "a", BREAK).otherwise(""), F.substr(part, F.lit(2)))
        shown = F.when(hidden == 0, F.concat(state["shown"], F.array(F.struct((article > 0).alias("inside"), text.alias("text"))))).otherwise(state["shown"])
        return F.struct(article.alias("article"), hidden.alias("hidden"), shown.alias("shown"))

    return F.aggregate(parts, start, step, lambda state: state["shown"])


def page_paragraphs(html: Column, headings: bool = False) -> Column:
    """The paragraphs of a page in order, without empty ones; with or without its headings. A null page has none."""
    clean = F.translate(F.coalesce(html, F.lit("")), MARKS, "")
    named = F.transform(F.regexp_extract_all(clean, F.lit(TOKEN), F.lit(0)), lambda t: F.struct(t.alias("token"), F.lower(F.regexp_extract(t, NAME, 1)).alias("name")))
    marked = F.array_join(F.transform(named, meaning), "")
    # an array of one binds what is looked at more than once, so that it is made once; the first part follows no tag of a region, for which a letter without meaning stands
    parts = F.split(F.concat(F.lit("-"), F.transform(F.array(marked), decoded)[0]), REGION)

    def blocks(shown: Column) -> Column:
        chosen = F.when(F.exists(shown, lambda x: x["inside"]), F.filter(shown, lambda x: x["inside"])).otherwise(shown)
        found = F.split(F.array_join(F.transform(chosen, lambda x: x["text"]), ""), BREAK)
        if not headings:
            found = F.filter(found, lambda x: ~x.startswith(HEADING))
        return F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(F.translate(x, HEADING + INLINE, ""), r"\s+", " "))), lambda x: x != "")

    return F.transform(F.array(_shown(parts)), blocks)[0]
