"""Web pages: references and plain text of HTML."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds of reference, and the tag and attribute that hold each.
KINDS = (("link", "a", "href"), ("image", "img", "src"), ("frame", "frame", "src"), ("iframe", "iframe", "src"))
_BREAKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 table ul ol section article header footer title pre blockquote".split())
_HIDDEN = frozenset(["script", "style", "noscript", "template"])


def links(html: Column) -> Column:
    """array<struct<kind, url>> of references, by kind and then place."""

    def of(kind: str, tag: str, attribute: str) -> Column:
        pattern = rf"""(?is)<{tag}\s[^>]*{attribute}=["']([^"']*)["']"""
        urls = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
        return F.transform(urls, lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("url")))

    return F.concat(*[of(*k) for k in KINDS])


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in _HIDDEN
        if tag in _BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in _HIDDEN))
        if tag in _BREAKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def text_of_html(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.parts).split("\n"))
    return "\n".join(line for line in lines if line)


def plain_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(text_of_html)

    return run(html)
