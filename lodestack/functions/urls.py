"""Urls: normal form, resolution of references as the crawler does it, patterns of allowed urls."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def has_authority(url: Column) -> Column:
    return url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+")


def host(url: Column) -> Column:
    """The registered name, without user, port and case; null where there is none."""
    name = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(name != "", F.lower(name))


def resolved(reference: Column, page: Column, base: Column) -> Column:
    """The absolute url of a reference on a page, without fragment; null if neither it nor the page has an authority.

    Scheme and host always come from the page. A path from the root replaces the page's; another is put behind the path
    of the base reference, or of the page, less its last slash. The query is the reference's. Dots are not resolved.
    """
    ref = without_fragment(reference)
    path_of = lambda u: F.regexp_replace(F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), "/$", "")
    origin = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    behind = F.when(base.isNotNull() & (base != ""), path_of(base)).otherwise(path_of(page))
    relative = F.when(ref.startswith("/"), F.concat(origin, ref)).otherwise(F.concat(origin, behind, F.lit("/"), ref))
    return F.when(has_authority(ref), ref).when(has_authority(page), relative)


def resolve(reference: str, page: str, base: str | None = None) -> str | None:
    """`resolved` for single strings."""
    ref = reference.partition("#")[0]
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+", ref):
        return ref
    at = urlsplit(page)
    if not at.netloc:
        return None
    origin = f"{at.scheme}://{at.netloc}"
    if ref.startswith("/"):
        return origin + ref
    behind = urlsplit(base).path if base else at.path
    return f"{origin}{behind.removesuffix('/')}/{ref}"


def allowed_pattern(seed: str) -> str:
    """A pattern for the urls a crawl from a seed may follow: its host and those one label below it, anchored at the begin
    only.

    A seed of www. stands for the hosts one label below its domain and asks for one; any other allows one. A seed without
    scheme allows http and https.
    """
    scheme, sep, rest = seed.partition("://")
    if not sep:
        scheme, rest = "https?", seed
    name = re.split("[/?#]", rest, maxsplit=1)[0]
    if name.startswith("www."):
        return rf"^{scheme}://(?:[^./?#]+\.)" + re.escape(name[4:])
    return rf"^{scheme}://(?:[^./?#]+\.)?" + re.escape(name)
