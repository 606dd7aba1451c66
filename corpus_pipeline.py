"""Corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Null texts are empty texts
to every stage, rows with a null doc_id or a doc_id of several rows go through like others, columns of any name stay as they are, and an
empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import decontaminate, line_dedup, near_dup, packing, toxicity
from kbspark.llm.common import materialize, table


def beside(docs: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f over docs whose columns other than doc_id and text are named out of the way of the columns that f adds; theirs come back after it."""
    away = {c: f"__docs_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = f(docs.withColumnsRenamed(away))
    return out.select(*(F.col(away.get(c, c)).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain calls toxic go. Where no label is usable the chain knows nothing and all documents stay."""
    chain = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return beside(docs, lambda d: toxicity.score(d, chain).filter(F.col("p_toxic") < 0.5))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines go, with n_chars as it is then. A document that lost lines and has only white space left goes too."""
    n_chars = f"__docs_{docs.columns.index('n_chars')}" if "n_chars" in docs.columns else None

    def shorten(d: DataFrame) -> DataFrame:
        found = line_dedup.dedup_lines(d)
        changed = F.col("n_dropped") > 0
        left = found.filter(~changed | line_dedup.counts(F.col("kept")))
        new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
        if n_chars:
            new[n_chars] = F.when(changed, F.length("kept").cast("long")).otherwise(F.col(n_chars))
        return left.withColumns(new)

    return beside(docs, shorten)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the first by doc_id; see keep_one."""
    return near_dup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words of a benchmark window go."""
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = found.filter("n_hit > 0").select(F.col("doc_id").alias("hit"), "h").distinct()
    return docs.join(hit, docs.doc_id.eqNullSafe(hit.hit) & F.xxhash64(docs.text).eqNullSafe(hit.h), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A chain of classifiers and tokens of a vocabulary aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
