"""Text of documents by format: HTML, Markdown, Word and plain text."""

from __future__ import annotations

import io
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class _Text(HTMLParser):
    """Text nodes by lines; headings marked, preformatted blocks fenced, scripts and styles left out."""

    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.hidden = self.pre = 0
        self.head: list[str] | None = None
        self.level = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "pre":
            self.pre += 1
            self.out.append("```")
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.head, self.level = [], int(tag[1])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("```")
        elif self.head is not None and tag == f"h{self.level}":
            self.out.append("#" * self.level + " " + " ".join("".join(self.head).split()))
            self.head = None

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.head is not None:
            self.head.append(data)
        else:
            self.out.append(data)


def html_text(html: str) -> str:
    """The text of a page, one node a line, without blank lines."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "\n".join(x for x in (line.strip() for line in "\n".join(parser.out).splitlines()) if x)


def docx_text(content: bytes) -> str:
    """The paragraphs of a Word document, headings marked."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val", "") if style is not None else ""
        digits = "".join(c for c in name if c.isdigit())
        mark = "#" * int(digits) + " " if name.lower().startswith("heading") and digits else ""
        out.append(mark + "".join(t.text or "" for t in p.iter(f"{_W}t")))
    return "\n".join(out)


def text_of(content: bytes | None, suffix: str | None) -> str:
    """The text of a document; empty if it cannot be read."""
    try:
        kind = (suffix or "").lower()
        if content is None:
            return ""
        if kind == ".docx":
            return docx_text(content)
        text = content.decode("utf-8")
        return html_text(text) if kind in (".html", ".htm") else text
    except Exception:  # noqa: BLE001  any unreadable document counts as empty
        return ""


def document_text(content: Column, suffix: Column) -> Column:
    """``text_of`` as a column."""

    @F.pandas_udf(StringType())
    def run(contents: pd.Series, suffixes: pd.Series) -> pd.Series:
        return pd.Series([text_of(bytes(c) if c is not None else None, s) for c, s in zip(contents, suffixes)], dtype=object)

    return run(content, suffix)
