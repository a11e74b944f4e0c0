"""HTML extraction as column expressions, and a table function for irregular pages."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_LENGTH, SUMMARY_LENGTH = 150, 250
SKIPPED = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->"
#: Where an open paragraph ends if it isn't closed.
PARAGRAPH_END = r"(?s)</p>.*|</article>.*|</div>.*|</section>.*|</body>.*"
#: Entities that pages use for plain characters.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def visible(html: Column) -> Column:
    """The page without scripts, styles and comments."""
    return F.regexp_replace(html, SKIPPED, "")


def plain(fragment: Column) -> Column:
    """The text of a fragment: tags gone, entities read, white space collapsed."""
    text = F.regexp_replace(fragment, r"<[^>]*>", "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def language(html: Column) -> Column:
    """The lang attribute of the html element, empty if it has none."""
    return F.regexp_extract(html, r'<html[^>]*lang="([^"]*)"', 1)


def title(html: Column) -> Column:
    return F.substring(plain(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1)), 1, TITLE_LENGTH)


def headings(html: Column) -> Column:
    """array<struct<level, text>> of h1 to h6 in document order."""
    pattern = F.lit(r"(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>")
    return F.zip_with(
        F.regexp_extract_all(visible(html), pattern, F.lit(1)),
        F.regexp_extract_all(visible(html), pattern, F.lit(2)),
        lambda level, text: F.struct(level.alias("level"), plain(text).alias("text")),
    )


def paragraphs(html: Column) -> Column:
    """The texts of all paragraphs, blank ones included. A paragraph ends where it is closed, where the next begins or
    where its surroundings end."""
    pieces = F.split(visible(html), r"<p(?: [^>]*)?>", -1)
    return F.transform(F.slice(pieces, 2, 1 << 30), lambda p: plain(F.regexp_replace(p, PARAGRAPH_END, "")))


def summary(html: Column) -> Column:
    """The first paragraph that isn't blank, cut to 250 characters, else empty."""
    return F.coalesce(F.substring(F.get(F.filter(paragraphs(html), lambda p: p != ""), F.lit(0)), 1, SUMMARY_LENGTH), F.lit(""))


def anchors(html: Column) -> Column:
    """array<struct<href, text>> of links in document order."""
    pattern = F.lit(r'(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>')
    return F.zip_with(
        F.regexp_extract_all(visible(html), pattern, F.lit(1)),
        F.regexp_extract_all(visible(html), pattern, F.lit(2)),
        lambda href, text: F.struct(href.alias("href"), plain(text).alias("text")),
    )


def page_text(html: Column) -> Column:
    """All visible text of a page, elements apart."""
    return plain(F.regexp_replace(visible(html), r"<[^>]*>", " "))


def base_url(html: Column) -> Column:
    """What <base href> names, null if nothing."""
    return F.nullif(F.regexp_extract(html, r'<base[^>]*href="([^"]*)"', 1), F.lit(""))


class PageLines(HTMLParser):
    """Tag lines of pages that regular expressions read badly: nested markup, unusual quoting, implied ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, str]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "p":
            self.close("p")
        if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or tag == "a" and dict(attrs).get("href"):
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag in ("article", "div", "section", "body"):
            self.close("p")
        self.close(tag)

    def handle_data(self, data):
        if not self.skip:
            for _, parts in self.open:
                parts.append(data)

    def close(self, tag):
        for i in reversed(range(len(self.open))):
            if self.open[i][0] == tag:
                name, parts = self.open.pop(i)
                self.lines.append((name, " ".join("".join(parts).split())))
                return


@F.udtf(returnType="tag string, idx int, text string")
class PageLinesTable:
    """One row for each line of a page, for use with LATERAL: headings and paragraphs are counted by kind."""

    def eval(self, html: str):
        parser = PageLines()
        parser.feed(html or "")
        parser.close("p")
        counts: dict[str, int] = {}
        for tag, text in parser.lines:
            kind = "h" if tag[0] == "h" else tag
            yield tag, counts.setdefault(kind, 0), text
            counts[kind] += 1
