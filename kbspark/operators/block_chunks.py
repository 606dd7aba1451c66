"""Blocks of markdown and of sheets, and chunks of blocks by size or by title."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.functions import text as tx
from kbspark.operators import folds, parents
from kbspark.operators.governance import table_description, table_html

# Blocks

#: What is taken off inside a line, in this order (fixed values).
INLINE = [
    (r"\*\*(.+?)\*\*", r"\1"),
    (r"__(.+?)__", r"\1"),
    (r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*", r"\1"),
    (r"`{1,3}([^`]+)`{1,3}", r"\1"),
    (r"\[(.+?)\]\(.+?\)", r"\1"),
    (r"!\[.*?\]\(.+?\)", ""),
]

#: A text as a row of these, each a line or a run of lines; the first that holds at a line counts.
TOKENS = re.compile(
    r"""(?mx)
      ^[ \t]*```(?P<lang>.*)\n?(?P<fence>(?:(?![ \t]*```).*\n)*(?:(?![ \t]*```).+\Z)?)(?:[ \t]*```.*)?
    | ^(?P<marks>\#{1,6})[ \t]+(?P<title>.+)$
    | ^(?P<table>[ \t]*\|(?:.*\|)?[ \t]*(?:\n[ \t]*\|(?:.*\|)?[ \t]*)*)$
    | ^[ \t]*(?P<rule>[-*_]{3,})[ \t]*$
    | ^>(?P<quote>.*)$
    | ^(?P<list>[ \t]*(?:[-*+]|\d+\.)[ \t]+.+(?:\n[ \t]*(?:[-*+]|\d+\.)[ \t]+.+)*)$
    | ^(?P<line>.*)$"""
)
BULLET = re.compile(r"(?m)^[ \t]*(?:[-*+]|\d+\.)[ \t]+")


def plain(line: str) -> str:
    for pattern, new in INLINE:
        line = re.sub(pattern, new, line)
    return line


def table_rows(text: str) -> list[list[str]]:
    """Cells of a table's lines, without empty rows and the row of dashes."""
    rows = [[c.strip() for c in line.strip()[1:-1].split("|")] for line in text.split("\n")]
    return [r for r in rows if any(r) and not all(re.match(r"[-:]+$", c) for c in r if c)] if len(rows) > 1 else []


def markdown_tokens(text: str) -> Iterator[tuple[str, str, int | None, str | None, list | None]]:
    """(kind, layout_type, level, text, rows of a table). A paragraph ends at a blank line, a title, a table or a fence; quotes and lists
    inside one come before it."""
    lines: list[str] = []

    def paragraph():
        if lines:
            yield "text", "text", None, "\n".join(lines), None
            lines.clear()

    for m in TOKENS.finditer(text):
        kind = m.lastgroup
        if m["fence"] is not None:
            yield from paragraph()
            lang = m["lang"].strip()
            yield "text", "text", None, f"[代码块: {lang}]" if lang else "[代码块]", None
            yield "text", "reference", None, m["fence"].removesuffix("\n"), None
        elif kind == "title":
            yield from paragraph()
            yield "text", "title", len(m["marks"]), plain(m["title"]), None
        elif kind == "table" and (rows := table_rows(m["table"])):
            yield from paragraph()
            yield "table", "text", None, None, rows
        elif kind == "quote" and (quote := plain(m["quote"].strip())):
            yield "text", "reference", None, quote, None
        elif kind == "list":
            yield "text", "text", None, "\n".join("• " + plain(x) for x in BULLET.sub("", m["list"]).split("\n")), None
        elif kind == "line":
            line = plain(m["line"])
            if line.strip():
                lines.append(line)
            else:
                yield from paragraph()
    yield from paragraph()


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text of markdown) -> doc_id, block_idx, kind (text, table), layout_type (title, text, reference), level, text, html, title.

    title is the document's first heading of level 1. A table's text is its description; one line of cells or no data is no table. A fence
    that isn't closed reaches to the end. Null and empty texts have no blocks. Parsing is row-local, linear in the text."""

    @F.pandas_udf("array<struct<kind:string,layout_type:string,level:int,text:string,rows:array<array<string>>>>")
    def parse(text: pd.Series) -> pd.Series:
        names = ("kind", "layout_type", "level", "text", "rows")
        return text.map(lambda s: [dict(zip(names, b, strict=True)) for b in markdown_tokens(s)] if s else [])

    d = docs.select("doc_id", parse("text").alias("b"))
    title = F.try_element_at(F.filter("b", lambda x: (x.layout_type == "title") & (x.level == 1)), F.lit(1)).getField("text")
    b = d.select("doc_id", title.alias("title"), F.posexplode("b").alias("block_idx", "b")).select("doc_id", "block_idx", "b.*", "title")
    rows = F.col("rows")
    return b.withColumn("text", F.when(rows.isNull(), F.col("text")).otherwise(table_description(rows))).withColumn("html", F.when(rows.isNotNull(), table_html(rows))).drop("rows")


def sheet_blocks(cells: DataFrame) -> DataFrame:
    """cells (doc_id, sheet_no, sheet, row, col, value) -> doc_id, block_idx, kind, layout_type, level, text, html: a title and a table for each
    sheet. Missing and null cells are empty, rows of blank cells and sheets without others have no block; of a repeated cell the least counts."""
    sheet = ["doc_id", "sheet_no", "sheet"]
    one = cells.withColumn("col", F.col("col").cast("int")).groupBy(*sheet, "row", "col").agg(F.min(F.coalesce("value", F.lit(""))).alias("value"))
    rows = one.groupBy(*sheet, "row").agg(F.collect_list(F.struct("col", "value")).alias("cells"), F.max("col").alias("last"), F.max(F.trim("value") != "").alias("filled")).filter("filled")
    s = rows.groupBy(*sheet).agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"), F.max("last").alias("last"))
    wide = F.transform("rows", lambda r: F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at(F.map_from_entries(r.cells), i), F.lit(""))))
    s = s.select(*sheet, wide.alias("rows"))
    head, n = F.col("rows")[0], F.size("rows")
    tokens = tx.estimate_tokens(F.array_join(F.transform("rows", lambda r: F.array_join(r, " ")), "\n"))
    about = F.format_string("Sheet '%s'：%d 行 × %d 列，表头为 [%s]，约 %d tokens", F.col("sheet"), n - 1, F.size(head), F.array_join(F.slice(head, 1, 8), ", "), tokens)
    title = F.struct(F.lit("text").alias("kind"), F.lit("title").alias("layout_type"), F.lit(2).alias("level"), F.format_string("Sheet: %s — %d 行数据", F.col("sheet"), n).alias("text"), F.lit(None).cast("string").alias("html"))
    table = F.struct(F.lit("table").alias("kind"), F.lit("text").alias("layout_type"), F.lit(None).cast("int").alias("level"), about.alias("text"), table_html(F.col("rows")).alias("html"))
    both = s.select("doc_id", "sheet_no", F.posexplode(F.array(title, table)).alias("p", "b"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("sheet_no", "p")) - 1
    return both.select("doc_id", place.alias("block_idx"), "b.*")


# Chunks

#: Layouts that become chunks (fixed values).
KEPT = ["title", "text", "equation"]


def size_pieces(text: str, size: int, least: int) -> list[str]:
    """Paragraphs packed in order into pieces of up to `size` tokens (characters div 2); a piece under `least` takes the next one whole, and
    the last one goes to the one before."""
    groups: list[list[str]] = []
    room = -1
    for p in text.split("\n\n"):
        if len(p) + 2 <= room:
            groups[-1].append(p)
            room -= len(p) + 2
        else:
            groups.append([p])
            room = 2 * size + 1 - len(p)
    rest = iter([t for t in ("\n\n".join(g).strip() for g in groups) if t])
    pieces = ["\n\n".join([t, *islice(rest, len(t) // 2 < least)]) for t in rest]
    return pieces[:-2] + ["\n\n".join(pieces[-2:])] if len(pieces) > 1 and len(pieces[-1]) // 2 < least else pieces


def numbered(c: DataFrame, *order: str) -> DataFrame:
    """doc_id, chunk_index, chunk_id and what else is there, in order."""
    c = c.withColumn("chunk_index", (F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1).cast("int"))
    return c.withColumn("chunk_id", tx.chunk_id(F.col("doc_id"), F.col("chunk_index"))).withColumn("tokens", tx.estimate_tokens(F.col("content")))


def contents(blocks: DataFrame, *more: Column) -> DataFrame:
    """Blocks with their text, and that of a table with its html, as content."""
    text = F.coalesce("text", F.lit(""))
    content = F.when(F.col("kind") == "table", F.concat_ws("\n", text, "html")).otherwise(text) if "html" in blocks.columns else text
    return blocks.select("doc_id", "block_idx", F.coalesce("kind", F.lit("text")).alias("kind"), F.coalesce("layout_type", F.lit("text")).alias("layout_type"), content.alias("content"), *more)


def token_chunks(blocks: DataFrame, size: int = 300, least: int = 50) -> DataFrame:
    """blocks (doc_id, block_idx, kind, layout_type, text) -> doc_id, chunk_index, chunk_id, kind, content, tokens.

    Texts of the layouts in KEPT: a short block is a chunk, a longer one gives pieces. Any other kind is a chunk of its own. A null kind is
    text, a null layout is text, a null text is empty."""

    @F.pandas_udf("array<string>")
    def pieces(text: pd.Series) -> pd.Series:
        return text.map(lambda s: size_pieces(s, size, least))

    b = contents(blocks).filter((F.col("kind") != "text") | F.col("layout_type").isin(KEPT))
    long = (F.col("kind") == "text") & (F.length("content") >= 2 * (size + 1))
    parts = b.select("doc_id", "block_idx", "kind", F.posexplode(F.when(long, pieces(F.when(long, F.col("content")).otherwise(""))).otherwise(F.array("content"))).alias("p", "content"))
    return numbered(parts, "block_idx", "p").select("doc_id", "chunk_index", "chunk_id", "kind", "content", "tokens")


def title_chunks(blocks: DataFrame, most: int = 800) -> DataFrame:
    """blocks (doc_id, block_idx, kind, layout_type, level, text) -> doc_id, chunk_index, chunk_id, kind (title, text), heading, level, content,
    tokens, parent_id, prev_id, next_id.

    Each title is a chunk, and the blocks after it are packed into chunks of up to `most` tokens whose parent it is; blocks before the first
    title have none. Documents without titles are cut by size. Nulls as in `token_chunks`; a null level is 1."""
    is_title = (F.col("kind") == "text") & (F.col("layout_type") == "title")
    b = contents(blocks, F.coalesce("level", F.lit(1)).cast("int").alias("level"))
    b = b.withColumn("is_title", is_title).withColumn("titled", F.max(is_title).over(Window.partitionBy("doc_id")))

    def step(state, row):
        section, part, chars, heading, level = state or (0, 1, 0, None, 0)
        if row.is_title:
            state = (section + 1, 1, 0, row.content or None, row.level)
            return state, (section + 1, 0, *state[3:])
        if chars + 2 + row.n <= 2 * most + 1:
            state = (section, part, chars + row.n + 2 * (chars > 0), heading, level)
        else:
            state = (section, part + (chars > 0), row.n, heading, level)
        return state, (section, state[1], heading, level)

    f = folds.fold_rows(b.filter("titled and (is_title or content <> '')").withColumn("n", F.length("content")), "doc_id", ["block_idx"], step, "section int, part int, heading string, own_level int")
    g = f.groupBy("doc_id", "section", "part", "heading", "own_level").agg(F.array_sort(F.collect_list(F.struct("block_idx", "content"))).alias("x"))
    kind = F.when(F.col("part") == 0, "title").otherwise("text")
    packed = g.select("doc_id", "section", "part", kind.alias("kind"), "heading", F.col("own_level").alias("level"), F.array_join(F.transform("x", lambda r: r.content), "\n\n").alias("content"))
    packed = numbered(packed.filter(F.trim("content") != ""), "section", "part").drop("section", "part")
    by_size = token_chunks(b.filter("not titled").withColumnRenamed("content", "text"), most).withColumns({"heading": F.lit(None).cast("string"), "level": F.lit(None).cast("int")})
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    own = F.last(F.when(F.col("kind") == "title", F.col("chunk_id")), ignorenulls=True).over(w)
    both = packed.unionByName(by_size)
    return both.select(
        "doc_id", "chunk_index", "chunk_id", "kind", "heading", "level", "content", "tokens", F.when(F.col("kind") != "title", own).alias("parent_id"),
        F.lag("chunk_id").over(w).alias("prev_id"), F.lead("chunk_id").over(w).alias("next_id"),
    )


def chunk(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """blocks, docs (doc_id distinct, strategy, file_type) -> doc_id, new_index, chunk_id, content, n_merged, tokens, file_type.

    strategy: token, title, and anything else (auto) parents of the blocks' kinds and their children. Short chunks are merged afterwards."""
    b = blocks.join(docs.select("doc_id", F.coalesce("strategy", F.lit("auto")).alias("strategy")), "doc_id")
    token, title = F.col("strategy") == "token", F.col("strategy") == "title"
    cut = [token_chunks(b.filter(token)), title_chunks(b.filter(title)), parents.parent_children(b.filter(~token & ~title))]
    names = ["doc_id", "chunk_index", "kind", "content"]
    merged = folds.merge_short(cut[0].select(*names).unionByName(cut[1].select(*names)).unionByName(cut[2].select(*names)))
    return merged.join(docs.select("doc_id", "file_type"), "doc_id")
