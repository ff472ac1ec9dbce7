"""Documents listed in the largest table of an HTML page."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.classify import document_group

ROW = "page_id bigint, item_number int, title string, page_count int, file_type string, href string"
#: Cells of a row that describes a document, and the file type where its link names none.
CELLS, FILE_TYPE = 6, "pdf"


class Tables(HTMLParser):
    """Tables as rows of (text, first link) data cells."""

    def __init__(self):
        super().__init__()
        self.tables: list[list[list[list]]] = []
        self.open: list[list[list[list]]] = []  # those not ended yet, one in another
        self.cell: list | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open.append(self.tables[-1])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag == "td" and self.open and self.open[-1]:
            self.cell = ["", None]
            self.open[-1][-1].append(self.cell)
        elif tag == "a" and self.cell is not None and self.cell[1] is None:
            self.cell[1] = dict(attrs).get("href") or ""

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None
        elif tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0] += data.strip()


def number(text: str) -> int | None:
    """A number in decimal digits that a column of ints can hold."""
    return int(text) if text.isdecimal() and len(text) < 20 and int(text) < 1 << 31 else None


def largest_table(html: str | None) -> list[tuple]:
    """(item_number, title, page_count, file_type, href) of the documents in the table with most rows, the first row being its head. A document's row has a number that fits an int, a title, a number of pages (else 0) and, in its sixth cell, a link; the link names the file type."""
    parser = Tables()
    parser.feed(html or "")
    out = []
    for row in max(parser.tables, key=len, default=[])[1:]:
        if len(row) < CELLS or number(row[0][0]) is None or not row[5][1]:
            continue
        href = row[5][1]
        kind = href.split("FileExtension=")[1].split("&")[0].lower() if "FileExtension=" in href else FILE_TYPE
        out.append((number(row[0][0]), row[1][0], number(row[2][0]) or 0, kind, href))
    return out


def docket_rows(pages: DataFrame) -> DataFrame:
    """(page_id, item_number, title, page_count, file_type, href, group) of the documents that each page lists; built-ins can't parse HTML."""
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = [(page, *r) for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in largest_table(html)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in ROW.split(", ")])

    return pages.select("page_id", "html").mapInArrow(run, ROW).withColumn("group", document_group(F.col("title")))
