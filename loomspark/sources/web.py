"""Raw web pages to Markdown: headings 1 to 3, paragraphs, list items and tables in order; of
video and repository pages of two sites, the description or the list of files."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that become parts of the text.
PARTS = ("h1", "h2", "h3", "p", "li", "table")
# How pages of two sites begin, by a part of their host's name.
VIDEO, REPOSITORY = ("youtube.com", "YouTube Video Page: {}\n\nDescription:\n{}"), ("github.com", "GitHub Repository Context: {}\n\nFile Listings:\n{}")
_HIDDEN = ("script", "style", "noscript", "template")
_VOID = ("br", "img", "hr", "input", "meta", "link", "wbr")


# Elements that start and end on a line of their own, and those with a blank line around.
_BLOCKS = (
    "address", "article", "aside", "blockquote", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "legend", "li", "main", "menu", "nav", "ol", "pre", "search", "section",
    "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
)
_APART = ("p",)
#: White space that collapses: a no-break space doesn't.
_COLLAPSING = " \t\n\r\f"


class Layout:
    """Text as it is laid out: white space collapses to one blank, none at a line's ends; breaks
    that blocks ask for are made once, before the next text, and the most asked for counts."""

    def __init__(self) -> None:
        self._done: list[str] = []
        self._breaks, self._blank, self._fresh = 0, False, True

    def text(self, data: str, kept: bool = False) -> None:
        if kept:  # as it stands, in <pre>
            self._put(data) if data else None
            return
        words = [w for w in re.split(f"[{_COLLAPSING}]+", data) if w]
        self._blank = self._blank or data[:1] in _COLLAPSING
        for k, word in enumerate(words):
            self._put(f" {word}" if (k or self._blank) and not self._breaks and not self._fresh else word)
            self._blank = False
        self._blank = bool(data) and (self._blank or data[-1] in _COLLAPSING)

    def _put(self, shown: str) -> None:
        if self._breaks and self._done:
            self._done.append("\n" * self._breaks)
        self._breaks, self._blank = 0, False
        self._done.append(shown)
        self._fresh = shown.endswith(("\n", "\t"))

    def line(self) -> None:
        """A line break, which always counts."""
        self._put("\n")

    def cell(self) -> None:
        """The next cell of a row."""
        self._put("\t")

    def apart(self, lines: int) -> None:
        """What follows starts so many lines below."""
        self._breaks, self._blank = max(self._breaks, lines), False

    def shown(self) -> str:
        return "".join(self._done)


class _Page(HTMLParser):
    """Layouts of open parts; a nested part's text belongs to those around it, too."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.parts, self._open, self._hidden, self._in_title = "", [], [], 0, False
        self.areas: dict[str, Layout] = {}
        self._pre = 0
        self._rows: list[int] = []  # cells so far of rows that are open
        self._inside: list[list] = []  # areas that are open: name, element, how often it is nested

    def _area(self, tag: str, attrs: dict) -> str | None:
        if attrs.get("id") == "description-inner":
            return "description"
        if tag == "table" and "files" in (attrs.get("class") or "").split():
            return "files"
        return "listing" if attrs.get("aria-labelledby") == "folders-and-files" else None

    def handle_starttag(self, tag, attrs):
        for area in self._inside:
            area[2] += area[1] == tag
        if tag not in _VOID and (name := self._area(tag, dict(attrs))) and name not in self.areas:
            self.areas[name] = Layout()
            self._inside.append([name, tag, 1])
        if tag not in ("br", "td", "th") and not self._hidden:
            self._apart(tag)  # what is open starts a line; a part that starts here is empty yet
        self._pre += tag == "pre"
        if tag in _HIDDEN:
            self._hidden += 1
        elif tag == "title":
            self._in_title = True
        elif tag in ("ul", "ol"):
            self._end_before(tag)
            self._open.append([tag, None])  # an item inside doesn't end one outside
        elif tag in PARTS:
            self._end_before(tag)
            part = [tag, Layout()]
            self.parts.append(part)
            self._open.append(part)
        elif tag in _BLOCKS:
            self._end_before(tag)
        if tag == "tr":
            self._rows.append(0)
        elif tag == "br" and not self._hidden:
            for layout in self._layouts():
                layout.line()
        elif tag in ("td", "th") and self._rows:
            self._rows[-1] += 1
            if self._rows[-1] > 1:
                for layout in self._layouts():
                    layout.cell()

    def _layouts(self):
        yield from (part[1] for part in self._open if isinstance(part[1], Layout))
        yield from (self.areas[area[0]] for area in self._inside)

    def _apart(self, tag: str) -> None:
        if lines := 2 if tag in _APART else int(tag in _BLOCKS):
            for layout in self._layouts():
                layout.apart(lines)

    def _end_before(self, tag: str) -> None:
        """A paragraph ends where a block starts or ends, an item with the next one of its list."""
        if self._open and self._open[-1][0] == "p":
            self._open.pop()
        if tag == "li":
            names = [name for name, _ in self._open]
            if "li" in names and not {"ul", "ol"} & set(names[len(names) - names[::-1].index("li") :]):
                del self._open[len(names) - 1 - names[::-1].index("li") :]

    def handle_endtag(self, tag):
        for area in self._inside:
            area[2] -= area[1] == tag
        self._inside = [area for area in self._inside if area[2]]
        self._pre = max(0, self._pre - (tag == "pre"))
        if tag == "tr" and self._rows:
            self._rows.pop()
        if tag in _HIDDEN:
            self._hidden = max(0, self._hidden - 1)
        elif tag == "title":
            self._in_title = False
        if tag in _BLOCKS and not self._hidden:
            self._end_before("")
        if tag in (*PARTS, "ul", "ol"):
            for k in range(len(self._open) - 1, -1, -1):
                if self._open[k][0] == tag:
                    del self._open[k:]
                    break
        if not self._hidden:
            self._apart(tag)

    def handle_data(self, data):
        if self._in_title:
            self.title += data
        elif not self._hidden:
            for layout in self._layouts():
                layout.text(data, kept=self._pre > 0)


def to_markdown(html: str | None, url: str | None = None) -> tuple[str, str]:
    page = _Page()
    page.feed(html or "")
    page.close()
    try:
        host = urlsplit(url or "").hostname or ""
    except ValueError:  # not a URL
        host = ""
    title, areas = re.sub(f"[{_COLLAPSING}]+", " ", page.title).strip(), {name: area.shown() for name, area in page.areas.items()}
    for (site, form), area in ((VIDEO, areas.get("description", "")), (REPOSITORY, areas.get("files", areas.get("listing", "")))):
        if site in host:
            return title, form.format(title, area.strip())
    out = []
    for tag, layout in page.parts:
        text = layout.shown().strip()
        if tag[0] == "h":
            out.append(f"{'#' * int(tag[1])} {text}")
        elif text:
            out.append(text)
    return title, "\n\n".join(out)


def html_to_markdown(pages: DataFrame, html: str = "html", url: str | None = "url") -> DataFrame:
    """Adds title and markdown.  `url`: the column of the page's address, if there is one."""

    @F.pandas_udf("title string, markdown string")
    def parse(texts: pd.Series, urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([to_markdown(t, u) for t, u in zip(texts, urls, strict=True)], columns=["title", "markdown"])

    address = F.col(url) if url else F.lit(None)
    return pages.withColumn("_m", parse(F.col(html), address.cast("string"))).select("*", "_m.title", "_m.markdown").drop("_m")
