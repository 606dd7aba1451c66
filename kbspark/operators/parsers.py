"""Parsers by file type: functions over one text that users may add, run by Spark over a table of files of any types."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.operators.block_chunks import markdown_tokens
from kbspark.operators.governance import table_description, table_html
from kbspark.operators.html_blocks import Reader

#: kind, layout_type, level, text, rows (of a table; else None).
Block = tuple[str, str, int | None, str, list[list[str]] | None]
Parser = Callable[[str], Iterable[Block]]


def html(text: str) -> Iterator[Block]:
    reader = Reader()
    reader.feed(text)
    reader.close()
    yield from reader.rows()


def markdown(text: str) -> Iterator[Block]:
    for kind, layout, level, piece, rows in markdown_tokens(text):
        yield kind, layout, level, piece or "", rows


def plain(text: str) -> Iterator[Block]:
    for part in text.split("\n\n"):
        if part.strip():
            yield "text", "text", None, part.strip(), None


#: Parsers that are known from the start; register_blocks adds to them.
PARSERS: dict[str, Parser] = {"html": html, "md": markdown, "txt": plain}


def register_blocks(file_type: str, parser: Parser) -> None:
    """Names the parser of a file type; a later one takes the place of an earlier one. It goes to the executors with the next call of parse_blocks."""
    PARSERS[file_type.lower()] = parser


def parse_blocks(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """files (doc_id, file_type, text) -> doc_id, block_idx, kind, layout_type, level, text, html (of a table), error: the blocks that the parser
    of each row's type gives, in order.

    A row of an unknown type, and one whose parser fails, gives a single row with error and without a block, so that one file stops no
    other. A null text is empty; a text without blocks gives no row. Each text is parsed by itself in one pass over the table."""
    known = dict(PARSERS if parsers is None else {k.lower(): p for k, p in parsers.items()})

    def blocks(file_type: str | None, text: str | None) -> list[tuple]:
        parser = known.get((file_type or "").lower())
        if parser is None:
            return [(0, None, None, None, None, None, f"unknown file type: {file_type}")]
        try:
            return [(i, *b, None) for i, b in enumerate(parser(text or ""))]
        except Exception as e:  # a user's parser may raise anything; the row says so
            return [(0, None, None, None, None, None, f"{type(e).__name__}: {e}")]

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "block_idx", "kind", "layout_type", "level", "text", "rows", "error"]
        for page in pages:
            out = [(d, *b) for d, k, t in zip(page["doc_id"], page["file_type"], page["text"], strict=True) for b in blocks(k, t)]
            yield pd.DataFrame(out, columns=names).astype({"level": "Int32", "block_idx": "int32"})

    schema = "doc_id long, block_idx int, kind string, layout_type string, level int, text string, rows array<array<string>>, error string"
    b = files.select("doc_id", "file_type", "text").mapInPandas(run, schema)
    is_table = F.coalesce(F.col("kind") == "table", F.lit(False))
    return b.withColumns({"text": F.when(is_table, table_description(F.col("rows"))).otherwise(F.col("text")), "html": F.when(is_table, table_html(F.col("rows")))}).select("doc_id", "block_idx", "kind", "layout_type", "level", "text", "html", "error")
