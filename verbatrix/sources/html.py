"""HTML pages: character set, main content and Markdown.

Python runs here, in Arrow batches, as no built-in function parses HTML that
isn't well-formed.
"""

from __future__ import annotations

import codecs
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import CONTENT_SELECTORS, MIN_REGION

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = {"script", "style", "head", "noscript", "template", "title"}
BLOCKS = set("address article aside blockquote body details div dl dt dd fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS | {"hr"}
BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def decode_bytes(data: bytes, content_type: str | None) -> str:
    """A page's text.  A byte order mark and the header's charset are certain, in this
    order; anything else is read as UTF-8 with U+FFFD for what isn't."""
    for mark, name in BOMS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type or "", re.I)
    if m:
        try:
            return data.decode(m[1])
        except (LookupError, UnicodeDecodeError):
            pass
    return data.decode("utf-8", "replace")


class _Regions(HTMLParser):
    """Finds the first element of each selector and where its content lies in the source."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=False)
        self.starts = [0]
        for m in re.finditer("\n", html):
            self.starts.append(m.end())
        self.open: list[tuple[str, list[int], int]] = []
        self.found: dict[int, tuple[int, int]] = {}
        self.size = len(html)
        self.feed(html)
        self.close()
        for _, selectors, begin in self.open:
            self._done(selectors, begin, self.size)

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def _done(self, selectors: list[int], begin: int, end: int) -> None:
        for k in selectors:
            if k not in self.found or begin < self.found[k][0]:
                self.found[k] = (begin, end)

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        values = dict(attrs)
        classes = (values.get("class") or "").split()
        hits = []
        for k, s in enumerate(CONTENT_SELECTORS):
            if s[0] == ".":
                hit = s[1:] in classes
            elif s[0] == "#":
                hit = values.get("id") == s[1:]
            elif s[0] == "[":
                name, _, value = s[1:-1].partition("=")
                hit = values.get(name) == value
            else:
                hit = tag == s
            if hit:
                hits.append(k)
        self.open.append((tag, hits, self._at() + len(self.get_starttag_text())))

    def handle_endtag(self, tag):
        depth = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if depth is None:
            return
        for _, hits, begin in self.open[depth:]:
            self._done(hits, begin, self._at())
        del self.open[depth:]


def extract_main(html: str) -> str:
    """The inner HTML of the first selector's first match that has over 200 bytes; else the whole page."""
    found = _Regions(html).found
    for k in range(len(CONTENT_SELECTORS)):
        if k in found:
            inner = html[slice(*found[k])]
            if len(inner.encode()) > MIN_REGION:
                return inner
    return html


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.stack: list[str] = []
        self.lists: list[list] = []
        self.links: list[str] = []
        self.tables: list[dict] = []
        self.quotes: list[int] = []
        self.hidden = self.pre = 0

    def text(self, s: str) -> None:
        if s:
            self.out.append(s)

    def brk(self, n: int = 2) -> None:
        tail = "".join(self.out[-3:])
        have = len(tail) - len(tail.rstrip("\n"))
        if self.out and have < n:
            self.out.append("\n" * (n - have))

    def taken(self, at: int) -> str:
        """What was written from ``at`` on, taken back."""
        held = "".join(self.out[at:])
        del self.out[at:]
        return held

    def end_cell(self) -> None:
        table = self.tables[-1]
        if table["cell"] is not None:
            table["rows"][-1].append(re.sub(r"\s+", " ", self.taken(table["cell"])).strip().replace("|", "\\|"))
            table["cell"] = None

    def end_table(self) -> None:
        """Rows between bars, the first one as the head, in as many columns as the longest has."""
        self.end_cell()
        table = self.tables.pop()
        loose, rows = self.taken(table["at"]).strip(), [r for r in table["rows"] if r]
        if loose:  # a caption, say
            self.text(loose)
            self.brk()
        if rows:
            width = max(map(len, rows))
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            self.text("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
        self.brk()

    def end_quote(self) -> None:
        inner = re.sub(r"\n{3,}", "\n\n", self.taken(self.quotes.pop())).strip()
        self.text("\n".join(f"> {line}".rstrip() for line in inner.split("\n")) if inner else "")
        self.brk()

    def close_tag(self, tag: str) -> None:
        if tag in self.stack:
            while self.stack:
                top = self.stack.pop()
                self.leave(top)
                if top == tag:
                    break

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            self.hidden += tag in HIDDEN
            return
        if tag in HIDDEN:
            self.hidden = 1
            return
        if tag in ENDS_P:
            self.close_tag("p")
        if tag == "li" and "li" in self.stack and self.stack[::-1].index("li") < next((i for i, x in enumerate(self.stack[::-1]) if x in ("ul", "ol")), 99):
            self.close_tag("li")
        values = dict(attrs)
        if tag not in VOID:
            self.stack.append(tag)
        if re.fullmatch("h[1-6]", tag):
            self.brk()
            self.text("#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.brk(1 if self.lists else 2)
            self.lists.append([tag, 0])
        elif tag == "li":
            self.brk(1)
            if self.lists:
                self.lists[-1][1] += 1
            kind, n = self.lists[-1] if self.lists else ("ul", 0)
            self.text("  " * max(0, len(self.lists) - 1) + (f"{n}. " if kind == "ol" else "- "))
        elif tag in ("b", "strong"):
            self.text("**")
        elif tag in ("i", "em"):
            self.text("*")
        elif tag == "code" and not self.pre:
            self.text("`")
        elif tag == "pre":
            self.brk()
            self.text("```\n")
            self.pre += 1
        elif tag == "blockquote":
            self.brk()
            self.quotes.append(len(self.out))
        elif tag == "table":
            self.brk()
            self.tables.append({"at": len(self.out), "rows": [], "cell": None})
        elif tag == "tr" and self.tables:
            self.end_cell()
            self.tables[-1]["rows"].append([])
        elif tag in ("td", "th") and self.tables:
            self.end_cell()
            if not self.tables[-1]["rows"]:
                self.tables[-1]["rows"].append([])
            self.tables[-1]["cell"] = len(self.out)
        elif tag == "a":
            self.links.append(values.get("href") or "")
            self.text("[")
        elif tag == "img":
            self.text(f"![{values.get('alt') or ''}]({values.get('src') or ''})")
        elif tag == "br":
            self.text("  \n")
        elif tag == "hr":
            self.brk()
            self.text("---")
            self.brk()
        elif tag in BLOCKS:
            self.brk()

    def leave(self, tag: str) -> None:
        if tag in ("b", "strong"):
            self.text("**")
        elif tag in ("i", "em"):
            self.text("*")
        elif tag == "code" and not self.pre:
            self.text("`")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.brk(1)
            self.text("```")
            self.brk()
        elif tag == "a":
            self.text(f"]({self.links.pop() if self.links else ''})")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.brk(1 if self.lists else 2)
        elif tag == "table" and self.tables:
            self.end_table()
        elif tag == "blockquote" and self.quotes:
            self.end_quote()
        elif tag in ("td", "th") and self.tables:
            self.end_cell()
        elif tag in BLOCKS:
            self.brk(1 if tag == "li" else 2)

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden -= tag in HIDDEN
            return
        self.close_tag(tag)

    def handle_data(self, data):
        if self.hidden:
            return
        if self.pre:
            self.text(data)
            return
        flat = re.sub(r"[ \t\r\n\f]+", " ", data)
        if flat == " " and self.tables and self.tables[-1]["cell"] is None:
            return
        if not self.out or self.out[-1].endswith(("\n", " ")):
            flat = flat.lstrip(" ")
        self.text(flat)

    def result(self) -> str:
        while self.stack:
            self.leave(self.stack.pop())
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<! ) \n", "\n", "".join(self.out))).strip()


def to_markdown(html: str) -> str:
    """Headings, paragraphs, lists, links, images, emphasis, code, quotes, tables and rules as Markdown.

    Scripts, styles, heads and comments go; unclosed paragraphs, items and
    elements end where their container does.
    """
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    return parser.result()


def _map(fn):
    return lambda rows: rows.map(fn, na_action="ignore")


@F.pandas_udf(T.StringType())
def main_content(html: pd.Series) -> pd.Series:
    return _map(extract_main)(html)


@F.pandas_udf(T.StringType())
def markdown(html: pd.Series) -> pd.Series:
    return _map(to_markdown)(html)


@F.pandas_udf(T.StringType())
def page_markdown(html: pd.Series) -> pd.Series:
    """The main content as Markdown, in one pass through Python."""
    return _map(lambda h: to_markdown(extract_main(h)))(html)


@F.pandas_udf(T.StringType())
def decoded(data: pd.Series, content_type: pd.Series) -> pd.Series:
    """Bytes and a Content-Type header as text."""
    return pd.Series([None if d is None else decode_bytes(d, t) for d, t in zip(data, content_type)])


class _Listing(HTMLParser):
    """Rows of the last table that begins: links of results and the text of rows; a table inside has rows of its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[tuple[list[dict], dict | None]] = []
        self.own: list[dict] = []
        self.row: dict | None = None
        self.in_link = False

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag == "table":
            self.open.append((self.own, self.row))
            self.rows = self.own = []
            self.row = None
        elif tag == "tr":
            self.row = {"href": None, "title": "", "text": ""}
            self.own.append(self.row)
        elif tag == "a" and self.row is not None and self.row["href"] is None and "result-link" in (values.get("class") or "").split():
            self.row["href"], self.in_link = values.get("href") or "", True

    def handle_endtag(self, tag):
        if tag == "a":
            self.in_link = False
        elif tag == "tr":
            self.row = None
        elif tag == "table" and self.open:
            self.own, self.row = self.open.pop()

    def handle_data(self, data):
        if self.row is not None:
            self.row["text"] += data
            if self.in_link:
                self.row["title"] += data


def parse_listing(html: str) -> list[dict]:
    """Results (title, href, snippet) of a listing page: the last table's rows with a result link,
    each with the text of the row after it."""
    from ..functions.constants import NO_SNIPPET

    parser = _Listing()
    parser.feed(html)
    parser.close()
    out = []
    for row, after in zip(parser.rows, [*parser.rows[1:], None]):
        if row["href"] is not None:
            out.append({"title": row["title"].strip(), "href": row["href"], "snippet": (after["text"].strip() if after else "") or NO_SNIPPET})
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in ("title", "href", "snippet")])))
def listing(html: pd.Series) -> pd.Series:
    return _map(parse_listing)(html)
