"""What is read from web pages: title, description pairs, links. Patterns stay inside the JVM; broken markup only costs the
field it breaks."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEAD = r"(?is)<head\b[^>]*>(.*?)(?:</head>|<body\b|$)"
# an attribute's value in quotes or without
_VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_META = r"(?is)<meta\s(?:[^>]*?\s)?name" + _VALUE + r"(?:[^>]*?\s)?content" + _VALUE
_META_TURNED = r"(?is)<meta\s(?:[^>]*?\s)?content" + _VALUE + r"(?:[^>]*?\s)?name" + _VALUE
HREF = r"(?s)<a\s(?:[^>]*?\s)?href" + _VALUE
_BASE = r"(?is)<base\s(?:[^>]*?\s)?href" + _VALUE
_NAMED = {k: chr(v) for k, v in html.entities.name2codepoint.items()} | {"apos": "'"}


def unescaped(text: Column) -> Column:
    """Text with the characters that named and numbered entities stand for; what is no entity stays. Only texts with an
    ampersand are taken apart."""
    names = F.create_map(*(F.lit(x) for pair in _NAMED.items() for x in pair))

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, r"^&([A-Za-z][A-Za-z0-9]*);$", 1)
        hexed, plain = F.regexp_extract(p, r"^&#[xX]([0-9A-Fa-f]{1,6});$", 1), F.regexp_extract(p, r"^&#([0-9]{1,7});$", 1)
        point = F.when(hexed != "", F.conv(hexed, 16, 10)).when(plain != "", plain).cast("int")
        fine = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        return F.when(name != "", F.coalesce(names[name], p)).when(fine, char).otherwise(p)

    cut = F.regexp_extract_all(text, F.lit(r"(&#?[A-Za-z0-9]{1,32};|&|[^&]+)"), F.lit(1))
    return F.when(~F.contains(text, F.lit("&")), text).otherwise(F.array_join(F.transform(cut, piece), ""))


def _value(raw: Column) -> Column:
    """An attribute's value, its quotes and entities undone."""
    return unescaped(F.regexp_replace(raw, "^[\"']|[\"']$", ""))


def head(html: Column) -> Column:
    """What is in the first head of a page; nothing of a page that has none."""
    return F.regexp_extract(html, _HEAD, 1)


def title(html: Column, url: Column) -> Column:
    """The first title in the head, if it isn't blank; else, of a file, its name; else null."""
    text = F.regexp_replace(unescaped(F.regexp_extract(head(html), r"(?is)<title\b[^>]*>(.*?)</title>", 1)), r"(?U)^\s+|\s+$", "")
    return F.when(text != "", text).when(url.startswith("file://"), F.element_at(F.split(url, "/"), -1))


def meta_pairs(html: Column) -> Column:
    """name -> content of the meta elements of the page's head with both; of the same name the last counts."""
    top = head(html)
    found = lambda p, k, v: F.arrays_zip(F.regexp_extract_all(top, F.lit(p), F.lit(k)).alias("k"), F.regexp_extract_all(top, F.lit(p), F.lit(v)).alias("v"))
    read = F.transform(F.concat(found(_META, 1, 2), found(_META_TURNED, 2, 1)), lambda p: F.struct(_value(p["k"]).alias("k"), _value(p["v"]).alias("v")))
    pairs = F.filter(read, lambda p: (F.trim(p["k"]) != "") & (p["v"] != ""))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(names, lambda n: F.element_at(F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"]), -1))
    return F.map_from_arrays(names, last)


def metadata(html: Column, url: Column) -> Column:
    """All that is known of a page: uri, title, meta pairs. A meta pair named title stands before the title."""
    own = F.map_filter(meta_pairs(html), lambda k, v: ~k.isin("uri"))
    name = title(html, url)
    known = F.when(name.isNotNull() & ~F.map_contains_key(own, "title"), F.map_concat(own, F.create_map(F.lit("title"), name))).otherwise(own)
    return F.map_concat(known, F.create_map(F.lit("uri"), url))


def links(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), _value)


def base_href(html: Column) -> Column:
    found = _value(F.regexp_extract(html, _BASE, 1))
    return F.when(found != "", found)


def shown(meta: Column) -> tuple[Column, Column, Column]:
    """Title, description and path as a result page shows them."""
    uri = meta["uri"]
    return F.coalesce(meta["title"], F.lit("Untitled")), F.coalesce(meta["description"], F.lit("No description")), F.when(uri.startswith("file://"), F.substring_index(uri, "//", -1)).otherwise(uri)
