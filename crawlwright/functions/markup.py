"""HTML expressions: tags, attributes, text and entities as Columns.

A tag is found by splitting the text at ``<name``: each piece starts with the
attributes of one tag, so nothing is scanned twice. Patterns use possessive
groups, which Java matches without recursion however long an attribute is.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as U

# Texts and attribute lists that results depend on.
IMAGE_INDICATORS = ["<img", ".jpg", ".jpeg", ".png", ".gif", "image/", "background-image", "src=", "data-src="]
LAZY_SRC_ATTRS = ["src", "data-src", "data-original", "data-lazy-src"]
RICH_SRC_ATTRS = ["src", "data-src", "data-original", "data-lazy-src", "data-lazy", "data-url",
                  "data-img-src", "data-image-src"]
CSS_URL = r"""(?i)url\s*\(\s*["']?([^"')\s]+)["']?\s*\)"""
SIMPLE_CSS_URL = r"""(?d)url\(["']?(.*?)["']?\)"""

_ATTR_TEXT = r"""(?s)^((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)"""
_ATTR = r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+"""
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
_COMMENTS = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)"


def visible(html_text) -> Column:
    """Markup without comments, scripts and style sheets."""
    return F.regexp_replace(U._c(html_text), _HIDDEN, "")


def decode_entities(text: Column) -> Column:
    """Named and numeric character references; unknown ones stay."""
    names = json.dumps({k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")})
    table = F.from_json(F.lit(names), "map<string,string>")

    def one(piece, i):
        name = F.regexp_extract(piece, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2)))
        number = F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")
        char = (F.when(name == "", None).when(name == "amp", "&").when(name == "lt", "<").when(name == "gt", ">")
                .when(name == "quot", '"').when(name == "nbsp", " ")
                .when(name.startswith("#"), number).otherwise(F.try_element_at(table, name)))
        return F.when(i == 0, piece).otherwise(F.coalesce(
            F.concat(char, F.substr(piece, F.length(name) + 2)), F.concat(F.lit("&"), piece)))
    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "&"), one), "")).otherwise(text)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<[^>]*>", "")


def attributes(piece: Column) -> Column:
    """``struct<names,values>`` of the attributes a piece of markup starts with, values decoded."""
    text = F.regexp_extract(piece, _ATTR_TEXT, 1)
    return U.let(text, lambda x: F.struct(
        F.transform(F.regexp_extract_all(x, F.lit(_ATTR), F.lit(1)), F.lower).alias("names"),
        F.transform(F.regexp_extract_all(x, F.lit(_ATTR), F.lit(2)),
                    lambda v: decode_entities(F.regexp_replace(v, r"""^["']|["']$""", ""))).alias("values")))


def attr(attrs: Column, name: str) -> Column:
    """Value of an attribute; '' when empty, null when missing."""
    at = F.array_position(attrs["names"], F.lit(name)).cast("int")
    return F.get(attrs["values"], at - 1)


def attr_text(attrs: Column, name: str) -> Column:
    return F.coalesce(attr(attrs, name), F.lit(""))


def pieces(markup: Column, tag: str) -> Column:
    """One piece per opening tag: its attributes and all that follows."""
    return F.filter(F.split(markup, rf"(?i)<{tag}(?=[\s/>])"), lambda _, i: i > 0)


def tag_attributes(markup: Column, tag: str) -> Column:
    """Attributes of every tag of a name, in document order."""
    return F.transform(pieces(markup, tag), attributes)


def styled_tags(markup: Column) -> Column:
    """Attributes of every tag that has a style attribute."""
    styled = F.filter(F.split(markup, "<(?=[a-zA-Z])"), lambda p, i: (i > 0) & F.regexp_extract(
        p, _ATTR_TEXT, 1).rlike(r"(?i)\sstyle\s*="))
    return F.transform(styled, attributes)


def inner_text(piece: Column, tag: str) -> Column:
    """Trimmed text between a piece's tag end and the closing tag."""
    rest = F.substr(piece, F.length(F.regexp_extract(piece, _ATTR_TEXT, 1)) + 2)
    body = F.regexp_extract(rest, rf"(?is)^(.*?)(?:</{tag}\s*>|\z)", 1)
    return U.strip(decode_entities(strip_tags(body)))


def title(html_text) -> Column:
    """H1: text of the first title tag, null when there is none."""
    markup = F.regexp_replace(U._c(html_text), _COMMENTS, "")
    body = F.regexp_extract(markup, r"(?is)<title(?:\s[^>]*)?>(.*?)(?:</title|\z)", 1)
    return F.when(markup.rlike(r"(?i)<title[\s>]"), U.strip(decode_entities(strip_tags(body))))


def _meta(attrs: Column) -> Column:
    return F.struct(
        F.lower(attr_text(attrs, "name")).alias("name"), attr_text(attrs, "name").alias("raw_name"),
        attr_text(attrs, "property").alias("property"), attr(attrs, "content").alias("content"),
        attr_text(attrs, "charset").alias("charset"), F.lower(attr_text(attrs, "http-equiv")).alias("equiv"))


def metas(html_text) -> Column:
    return F.transform(tag_attributes(F.regexp_replace(U._c(html_text), _COMMENTS, ""), "meta"), _meta)


def description(meta_array: Column) -> Column:
    """H2: description, else og:description, from the first such tag; null if neither."""
    def first(pred):
        hit = F.get(F.filter(meta_array, pred), 0)["content"]
        return F.when(hit != "", U.strip(hit))
    return F.coalesce(first(lambda m: m["raw_name"] == "description"),
                      first(lambda m: m["property"] == "og:description"))


def last_wins_map(entries: Column) -> Column:
    """Map of ``struct<k,v>`` entries; a repeated key keeps its place and takes the last value."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(
        F.filter(entries, lambda e: e["k"] == k), -1)["v"]))


def page_info(url, html_text, meta_array: Column) -> Column:
    """H3: the page record as a struct."""
    named = ["description", "keywords", "language"]
    blank = F.lit("")
    last = lambda pred, get: F.coalesce(F.try_element_at(F.transform(
        F.filter(meta_array, pred), get), F.lit(-1)), blank)
    by_name = lambda n: last(lambda m: m["name"] == n, lambda m: F.coalesce(m["content"], blank))
    markup = F.regexp_replace(U._c(html_text), _COMMENTS, "")
    charset = last(
        lambda m: ~m["name"].isin(named) & ((m["charset"] != "") | (m["equiv"] == "content-type")),
        lambda m: F.when(m["charset"] != "", m["charset"]).otherwise(U.charset_of(m["content"])))
    canon = F.get(F.filter(tag_attributes(markup, "link"), lambda a: F.array_contains(
        F.split(attr_text(a, "rel"), r"\s+"), "canonical")), 0)
    href = attr_text(canon, "href")
    lang = F.coalesce(attr(F.get(tag_attributes(markup, "html"), 0), "lang"), blank)
    entry = lambda key: lambda m: F.struct(key(m).alias("k"), F.coalesce(m["content"], blank).alias("v"))
    og = F.filter(meta_array, lambda m: F.lower(m["property"]).startswith("og:"))
    return F.struct(
        U._c(url).alias("url"), U.netloc(url).alias("domain"),
        F.coalesce(title(html_text), blank).alias("title"),
        by_name("description").alias("description"), by_name("keywords").alias("keywords"),
        F.when(lang != "", lang).otherwise(by_name("language")).alias("language"), charset.alias("charset"),
        F.when(href != "", U.join_url(url, href)).otherwise(blank).alias("canonical_url"),
        last_wins_map(F.transform(og, entry(lambda m: F.lower(m["property"])))).alias("og_info"),
        last_wins_map(F.transform(F.filter(meta_array, lambda m: m["name"] != ""), entry(lambda m: m["name"])))
        .alias("meta_info"))


def has_images(html_text) -> Column:
    """At least two of the nine image indicators occur."""
    low = F.lower(U._c(html_text))
    return sum((low.contains(x).cast("int") for x in IMAGE_INDICATORS), F.lit(0)) >= 2
