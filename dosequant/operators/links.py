"""Links to monthly files in index pages, for whole tables of pages."""

from pyspark.sql import Column, DataFrame, functions as F

from dosequant.fixed_values import MONTH_PREFIXES, SHEET_EXTENSION
from dosequant.functions.text import file_name_of_url

# What a parser would not see as links. What is never closed goes on to the end.
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
NOT_CONTENT = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
# Between tags, this stands for a comment: a text before it and one behind it are two.
NO_TEXT = "<!>"
# What is inside a tag: values in quotes, which open after "=" only, and the rest.
INSIDE = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+"""
# An opening tag with its attributes, and what follows up to the end of the link.
ANCHOR = rf"(?is)<a(\s{INSIDE})>(.*?)(?=</a\b|<a\s|\z)"
# Attributes before href, then its value in quotes of either kind or in none.
HREF = (
    r"""(?is)^(?:[\s/]+(?!href\s*=)[^\s=>/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+))?)*+"""
    r"""[\s/]+href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))"""
)
# Tags and texts, one after the other.
TOKEN = rf"(?is)<[a-z/!?]{INSIDE}>|[^<]++|<"
# A character reference, or what lies between two of them.
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|lt|gt|quot|apos|nbsp|amp);|[^&]++|&"
# Elements without content, and characters by name.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def decoded(text: Column) -> Column:
    """The text with character references, by number or by common names, spelled out.

    Each is decoded once, so that an escaped reference stays one. A number that is no
    character becomes the replacement character.
    """

    def spelled(part: Column) -> Column:
        digits = F.regexp_replace(part, "[&#;xX]", "")
        number = F.when(part.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        good = ((number > 0) & (number < 0xD800)) | ((number > 0xDFFF) & (number < 0x110000))
        code = F.lpad(F.hex(F.when(good, number).otherwise(0xFFFD)), 8, "0")
        by_name = F.lit(None).cast("string")
        for name, character in NAMED.items():
            by_name = F.when(part == name, F.lit(character)).otherwise(by_name)
        by_number = F.when(part.rlike("^&#[0-9xX]"), F.decode(F.unhex(code), "UTF-32"))
        return F.coalesce(by_name, by_number, part)

    parts = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, spelled), "")).otherwise(text)


def own_text(content: Column) -> Column:
    """The first text directly in an element, from its content: not in one within it.

    Reads tag after tag with the names of the elements that are open, so elements of
    one kind within each other are told apart. An end tag closes the last element of
    its name and all in it; one without such an element is passed over.
    """

    def state(names: Column, text: Column, done: Column) -> Column:
        return F.struct(names.alias("open"), text.alias("text"), done.alias("done"))

    def step(s: Column, token: Column) -> Column:
        name = F.lower(F.regexp_extract(token, "^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1))
        empty = name.isin(*VOID) | token.endswith("/>")
        left = F.size(s["open"]) - F.array_position(F.reverse(s["open"]), name).cast("int")
        found = s["text"] != ""
        return (
            F.when(s["done"], s)
            .when(token.rlike("^<[a-zA-Z]"), state(F.when(empty, s["open"]).otherwise(F.array_append(s["open"], name)), s["text"], found))
            .when(token.rlike("^</"), state(F.when(F.array_contains(s["open"], name), F.slice(s["open"], 1, left)).otherwise(s["open"]), s["text"], found))
            .when(token.rlike("^<[!?]"), state(s["open"], s["text"], found))
            .when(F.size(s["open"]) == 0, state(s["open"], F.concat(s["text"], token), F.lit(False)))
            .otherwise(s)
        )

    tokens = F.regexp_extract_all(content, F.lit(TOKEN), F.lit(0))
    start = state(F.array().cast("array<string>"), F.lit(""), F.lit(False))
    return F.aggregate(tokens, start, step, lambda s: s["text"])


def page_links(
    pages: DataFrame,
    host: str,
    prefixes=MONTH_PREFIXES,
    contains: str = SHEET_EXTENSION,
) -> DataFrame:
    """Links whose text begins with one of `prefixes` and whose address holds
    `contains`; addresses not beginning with http get `host` in front.

    A link's text is the first text directly in it, see `own_text`. Links are chosen
    within their page, by address first, so that each text is read once at most.
    """
    content = F.regexp_replace(F.regexp_replace("html", COMMENT, NO_TEXT), NOT_CONTENT, "")
    anchors = F.regexp_extract_all(content, F.lit(ANCHOR), F.lit(0))

    def address(anchor: Column) -> Column:
        attributes = F.regexp_extract(anchor, ANCHOR, 1)
        href = F.concat(*[F.regexp_extract(attributes, HREF, i) for i in (1, 2, 3)])
        return F.struct(decoded(href).alias("href"), anchor.alias("anchor"))

    def named(link: Column) -> Column:
        text = decoded(own_text(F.regexp_extract(link["anchor"], ANCHOR, 2)))
        return F.struct(text.alias("link_text"), link["href"].alias("href"))

    def begins(link: Column) -> Column:
        return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(link["link_text"], p))

    addressed = F.filter(F.transform(anchors, address), lambda x: F.contains(x["href"], F.lit(contains)))
    links = F.filter(F.transform(addressed, named), begins)
    return pages.select("page_id", F.explode(links).alias("link")).select(
        "page_id",
        "link.link_text",
        F.when(F.col("link.href").startswith("http"), F.col("link.href"))
        .otherwise(F.concat(F.lit(host), F.col("link.href")))
        .alias("url"),
    )


def link_file_names(links: DataFrame) -> DataFrame:
    """The name under which each link's file is kept."""
    return links.withColumn("file_name", file_name_of_url("url"))
