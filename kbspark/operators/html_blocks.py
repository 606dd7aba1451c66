"""Blocks of web pages: headings, paragraphs, quotes, lists and tables in page order."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.operators.governance import table_description, table_html

# What is left out, what makes a block, what a block may not be directly inside, and elements without an end.
NOISE = {"script", "style", "nav", "footer", "noscript", "iframe"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | {"p", "table", "ul", "ol", "blockquote", "pre"}
HOLDERS = {"li", "td", "th", "thead", "tbody", "tfoot", "tr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Reader(HTMLParser):
    """Keeps the open elements, each with the list that takes its text; a text goes to all lists that are open around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list | None]] = []
        self.blocks: list[tuple[str, list]] = []
        self.title: list[str] | None = None
        self.noise = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        parent, parent_list = self.open[-1] if self.open else ("", None)
        texts: list | None = None
        self.noise += tag in NOISE
        if not self.noise:
            if tag == "title" and self.title is None:
                texts = self.title = []
            elif tag in BLOCKS and parent not in HOLDERS:
                texts = []
                self.blocks.append((tag, texts))
            elif tag == "li" and parent in ("ul", "ol") and parent_list is not None:
                texts = []
                parent_list.append(texts)
            elif tag == "tr":
                texts = []
                for t, rows in self.open:
                    if t == "table" and rows is not None:
                        rows.append(texts)
            elif tag in ("td", "th"):
                texts = []
                for t, cells in self.open:
                    if t == "tr" and cells is not None:
                        cells.append(texts)
        self.open.append((tag, texts))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while True:
                t, _ = self.open.pop()
                self.noise -= t in NOISE
                if t == tag:
                    return

    def handle_data(self, data: str) -> None:
        piece = data.strip()
        if piece and not self.noise:
            for tag, texts in self.open:
                if texts is not None and tag not in ("ul", "ol", "table", "tr"):
                    texts.append(piece)

    def rows(self) -> Iterator[tuple[str, str, int | None, str, list | None]]:
        """kind, layout_type, level, text, rows of each block that isn't empty."""
        for tag, found in self.blocks:
            if tag == "table":
                cells = [r for r in (["".join(c) for c in r] for r in found) if any(r)]
                if cells:
                    yield "table", "table", None, "", cells
            elif tag in ("ul", "ol"):
                if found:
                    yield "text", "text", None, "\n".join("• " + "".join(x) for x in found), None
            elif text := "".join(found):
                layout = "title" if tag in HEADINGS else "reference" if tag == "blockquote" else "text"
                yield "text", layout, int(tag[1]) if tag in HEADINGS else None, text, None


def html_blocks(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> page_id, block_idx, kind, layout_type, level, text, html, title (of the page).

    A table's text is its description and html its rows; html is null elsewhere. Pages are read one by one, so a page is one row's work; a
    null or empty html has no blocks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page_id, html in zip(b["page_id"], b["html"]):
                reader = Reader()
                reader.feed(html or "")
                reader.close()
                title = "".join(reader.title or []) or None
                out += [(page_id, i, *row, title) for i, row in enumerate(reader.rows())]
            yield pd.DataFrame(out, columns=["page_id", "block_idx", "kind", "layout_type", "level", "text", "rows", "title"]).astype({"level": "Int32"})

    b = pages.select("page_id", "html").mapInPandas(read, "page_id long, block_idx int, kind string, layout_type string, level int, text string, rows array<array<string>>, title string")
    is_table = F.col("kind") == "table"
    return b.withColumns({"text": F.when(is_table, table_description(F.col("rows"))).otherwise(F.col("text")), "html": F.when(is_table, table_html(F.col("rows")))}).drop("rows")
