"""Text files, lists of users and results of evaluations from outside, reports to outside, and citations of answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.functions import text as tx
from kbspark.operators.evaluation import sentences
from kbspark.operators.folds import fold_rows

# Sources


def decode_text(content: Column) -> Column:
    """Bytes as stripped text: UTF-8, or GBK where they aren't valid UTF-8; null where they are neither."""

    @F.pandas_udf("string")
    def gbk(raw: pd.Series) -> pd.Series:
        def one(b):
            try:
                return b.decode("gbk")
            except UnicodeDecodeError:
                return None

        return raw.map(one, na_action="ignore")

    utf8 = F.is_valid_utf8(content.cast("string"))
    text = F.when(utf8, content.cast("string")).otherwise(gbk(F.when(~utf8, content)))
    return F.regexp_replace(text, r"^[\s　]+|[\s　]+$", "")


def text_blocks(files: DataFrame) -> DataFrame:
    """files (path, content as bytes) -> path, block_idx, layout_type, text, readable: one block for each file."""
    return files.select("path", F.lit(0).alias("block_idx"), F.lit("text").alias("layout_type"), decode_text(F.col("content")).alias("text")).withColumn("readable", F.col("text").isNotNull())


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of the .txt files under a path; empty files have no row, as Spark doesn't list them."""
    return text_blocks(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path))


#: What is wrong with a row of users (fixed values).
NO_NAME, BAD_LENGTH, NO_DISPLAY, KNOWN, NO_GROUP = "用户名为空", "用户名长度需 3-32 字符", "显示名称为空", "用户名已存在", "组不存在: "


def import_users(table: DataFrame, users: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """table (row_num, username, display_name, and any of email, groups, group_name), users (username), groups (group_id, name) ->
    new users, memberships (username, group_id), errors (row_num, username, reason).

    Of a name that comes twice the first valid row counts. `groups` are parted by |; an unknown one is an error, but its user stays. An unknown
    `group_name` is left out silently. Of groups with one name the least id counts. Nulls are empty."""
    missing = {"username", "display_name"} - set(table.columns)
    if missing:
        raise ValueError(f"columns {sorted(missing)} are needed")
    text = lambda c: F.trim(F.coalesce(c, F.lit(""))).alias(c) if c in table.columns else F.lit("").alias(c)
    t = table.select("row_num", *[text(c) for c in ("username", "display_name", "email", "groups", "group_name")])
    known = users.select("username").distinct().withColumn("known", F.lit(True))
    n = F.length("username")
    reason = F.when(n == 0, NO_NAME).when(~n.between(3, 32), BAD_LENGTH).when(F.col("display_name") == "", NO_DISPLAY).when(F.col("known"), KNOWN)
    t = t.join(known, "username", "left").withColumn("reason", reason).drop("known")
    first = F.row_number().over(Window.partitionBy("username").orderBy(F.col("reason").isNotNull(), "row_num"))
    t = t.withColumn("reason", F.when(F.col("reason").isNull() & (first > 1), KNOWN).otherwise(F.col("reason")))
    good, bad = t.filter("reason is null"), t.filter("reason is not null").select("row_num", "username", "reason")
    names = F.concat(F.transform(F.split("groups", r"\|"), lambda g: F.struct(F.trim(g).alias("name"), F.lit(True).alias("told"))), F.array(F.struct(F.col("group_name").alias("name"), F.lit(False).alias("told"))))
    wanted = good.select("row_num", "username", F.inline(names)).filter("name <> ''")
    found = wanted.join(groups.filter("name is not null").groupBy("name").agg(F.min("group_id").alias("group_id")), "name", "left")
    lost = found.filter("group_id is null and told").select("row_num", "username", F.concat(F.lit(NO_GROUP), "name").alias("reason"))
    return good.drop("reason", "groups", "group_name"), found.filter("group_id is not null").select("username", "group_id").distinct(), bad.unionByName(lost)


def read_users_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header as the table of `import_users`; row_num is the place in the file, the header being row 1. One file is read by
    one task, as its order counts."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return rows.coalesce(1).withColumn("row_num", F.monotonically_increasing_id() + 2)


#: A file of results.
RESULTS = "batch long, results array<struct<id:long,category:string,faithfulness:double,answer_relevance:double,first_token_ms:double,total_ms:double,n_hits:long,answer:string>>"


def parse_eval_results(raw: DataFrame) -> DataFrame:
    """raw (value: JSON of a batch) -> a row for each question; what isn't JSON has none."""
    return raw.select(F.from_json("value", RESULTS).alias("r")).select("r.batch", F.inline("r.results"))


def read_eval_results(spark: SparkSession, path: str) -> DataFrame:
    return parse_eval_results(spark.read.text(path, wholetext=True))


# Reports


def eval_report(samples: DataFrame, dims: list[str]) -> DataFrame:
    """metric, n, aggregate, least, most over the samples that have the metric, four places; a metric that none has counts as 0."""
    long = samples.select(F.inline(F.array(*[F.struct(F.lit(d).alias("metric"), F.col(d).cast("double").alias("v")) for d in dims])))
    show = lambda c: F.coalesce(F.round(c, 4), F.lit(0.0))
    return long.groupBy("metric").agg(F.count("v").alias("n"), show(F.avg("v")).alias("aggregate"), show(F.min("v")).alias("least"), show(F.max("v")).alias("most"))


def write_eval_report(samples: DataFrame, dims: list[str], path: str, version: str) -> None:
    """JSON folders scores and per_sample (id, question of 80 characters, scores) under path/version, which they replace."""
    eval_report(samples, dims).coalesce(1).write.mode("overwrite").json(f"{path}/{version}/scores")
    samples.select("id", F.left("question", F.lit(80)).alias("question"), F.struct(*dims).alias("judge_scores")).write.mode("overwrite").json(f"{path}/{version}/per_sample")


def slow_and_empty(run: DataFrame, most: int = 5, few: int = 3) -> DataFrame:
    """finding (slowest, no_hits, few_hits), id, value: the slowest questions (a limit that is the feature), and those with few hits."""
    slow = run.filter("total_ms <> 0").orderBy(F.col("total_ms").desc(), "id").limit(most).select(F.lit("slowest").alias("finding"), "id", F.col("total_ms").cast("double").alias("value"))
    low = run.filter(F.coalesce("n_hits", F.lit(0)) < few).select(F.when(F.coalesce("n_hits", F.lit(0)) == 0, "no_hits").otherwise("few_hits").alias("finding"), "id", F.coalesce("n_hits", F.lit(0)).cast("double").alias("value"))
    return slow.unionByName(low)


# Citations


def cite(answers: DataFrame, hits: DataFrame, least: float = 0.6, sentence_vectors: DataFrame | None = None) -> DataFrame:
    """answers (answer_id, answer), hits (answer_id, chunk_id, rank, doc_order, content, embedding if there), sentence_vectors (answer_id,
    sentence_idx, embedding, one for a sentence) -> answer_id, sentence_idx, chunk_id, score.

    Each sentence in order takes the likest hit that no sentence before it took, from `least` on; one that lies before the last cited place
    doesn't displace another. Likeness is the cosine where both have vectors of one length, else that of character pairs. Answers of one
    sentence have no citation. A null content is like nothing."""
    s = answers.select("answer_id", sentences(F.col("answer")).alias("s")).filter(F.size("s") > 1).select("answer_id", F.posexplode("s").alias("sentence_idx", "sentence"))
    s = s.select("answer_id", "sentence_idx", tx.bigrams(F.col("sentence")).alias("x")).withColumn("n", F.size("x"))
    none = F.lit(None).cast("array<double>")
    if sentence_vectors is None:
        s = s.withColumn("u", none)
    else:
        s = s.join(sentence_vectors.select("answer_id", "sentence_idx", F.col("embedding").cast("array<double>").alias("u")), ["answer_id", "sentence_idx"], "left")
    v = F.col("embedding").cast("array<double>") if "embedding" in hits.columns else none
    h = hits.select("answer_id", "chunk_id", "rank", "doc_order", tx.bigrams(F.coalesce("content", F.lit(""))).alias("y"), v.alias("v")).withColumn("m", F.size("y"))
    by_vector = F.col("u").isNotNull() & F.col("v").isNotNull() & (F.size("u") == F.size("v"))
    same = F.size(F.array_intersect("x", "y"))
    alike = (F.col("n") > 0) & (F.least("n", "m") >= least * F.greatest("n", "m"))  # as many pairs as that can't be shared otherwise
    score = F.when(by_vector, tx.cosine(F.col("u"), F.col("v"))).when(alike, same / (F.col("n") + F.col("m") - same))
    j = s.join(h, "answer_id").withColumn("score", score).filter(F.col("score") >= least)
    c = j.groupBy("answer_id", "sentence_idx").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.coalesce("doc_order", F.lit(9999)).cast("int").alias("at"), "score"))).alias("likely"))

    def step(state, row):
        used, last = state or (frozenset(), -1)
        best = None
        for h in row.likely:
            later = h["at"] >= last
            if h["chunk_id"] not in used and (best is None or later and h["score"] >= best["score"]):
                best = h
        if best is None:
            return (used, last), (None, None)
        return (used | {best["chunk_id"]}, best["at"]), (best["chunk_id"], round(best["score"], 3))

    return fold_rows(c, "answer_id", ["sentence_idx"], step, "chunk_id string, score double").filter("chunk_id is not null").select("answer_id", "sentence_idx", "chunk_id", "score")
