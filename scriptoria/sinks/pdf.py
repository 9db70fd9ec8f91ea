"""Pages as plain PDF documents: their text in lines, on as many sheets as it needs."""

from __future__ import annotations

import re
import textwrap
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from scriptoria.sinks.pages import write_pages

#: Characters of a line and lines of a sheet; size of the letters, distance of lines and margin in points, on A4.
LINE, LINES, SIZE, STEP, MARGIN = 92, 58, 10, 13, 50
_BREAK = re.compile(r"<(?:br\s*/?|/p|/li|/h[1-6]|/tr|/div|/title)\s*>", re.I)
_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]+>")


def lines_of(html: str) -> list[str]:
    """The text of a page in lines of at most ``LINE`` characters."""
    text = unescape(_HIDDEN.sub("", _BREAK.sub("\n", html)))
    return [part for line in text.splitlines() if line.strip() for part in textwrap.wrap(" ".join(line.split()), LINE)]


def pdf_of(html: str) -> bytes:
    """A PDF of a page's text; characters beyond Windows-1252 become question marks."""
    lines = lines_of(html) or [""]
    sheets = [lines[i : i + LINES] for i in range(0, len(lines), LINES)]
    shown = lambda line: re.sub(rb"([\\()])", rb"\\\1", line.encode("cp1252", "replace"))
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(sheets)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(sheets)} >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for i, sheet in enumerate(sheets):
        text = f"BT /F1 {SIZE} Tf {STEP} TL {MARGIN} {842 - MARGIN} Td\n".encode() + b"".join(b"(" + shown(x) + b") Tj T*\n" for x in sheet) + b"ET"
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>".encode())
        objects.append(f"<< /Length {len(text)} >>\nstream\n".encode() + text + b"\nendstream")
    out, places = b"%PDF-1.4\n", []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def pdf(html: Column) -> Column:
    """``pdf_of`` as a column; null stays null."""

    @F.pandas_udf(BinaryType())
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(pdf_of, na_action="ignore")

    return run(html)


def write_pdfs(pages: DataFrame, folder: str, path_col: str = "path", html_col: str = "html") -> None:
    """Write each page as a PDF beside its path below ``folder``, in the tasks."""
    path = F.concat(F.regexp_replace(F.col(path_col), r"\.html?$", ""), F.lit(".pdf"))
    write_pages(pages.select(path.alias("path"), pdf(F.col(html_col)).alias("body")), folder, "path", "body")
