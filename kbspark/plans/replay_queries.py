"""Registered queries that replay tables as streams, and operators with functions of the user."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kbspark.operators import access, folds, lifecycle
from kbspark.plans import fold_queries  # noqa: F401  (its SQL is used here)
from kbspark.plans.governance_queries import ranked
from kbspark.plans.queries import KW, ORACLES, query
from kbspark.sources import tables as t
from kbspark.streaming import jobs


def table_stream(s, d, name):
    """A table as a stream, whose rows come in one batch where all of its files are there. A stream reads a path that is one file as a pattern only."""
    return s.readStream.schema(t.read_table(s, d, name).schema).parquet(f"{d}/{{{name}}}.parquet")


def folder(s) -> str:
    return f"{t.shared_folder(s)}/replay-{uuid.uuid4().hex}"


def ingested(s, d):
    """Documents as messages, some of an unknown type: what the callbacks say beside the chunks that were written."""
    f = folder(s)
    messages = table_stream(s, d, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 9 == 0, "exe").otherwise("txt").alias("file_type"), "text")
    jobs.ingest(messages, f"{f}/chunks", f"{f}/callbacks", f"{f}/checkpoint").awaitTermination()
    written = s.read.parquet(f"{f}/chunks").groupBy("doc_id").agg(F.count("*").alias("n_written"), F.sum(F.length("chunk_text")).alias("n_chars"))
    return s.read.parquet(f"{f}/callbacks").select("doc_id", "status", "chunks_created", "reason").join(written, "doc_id", "left")


query("str1_ingest_replay", "", """select doc_id, case when r is null then 'completed' else 'failed' end status, case when r is null then n else 0 end::bigint chunks_created, r reason, case when r is null then n end::bigint n_written, case when r is null then c end::bigint n_chars from
  (select doc_id, case when doc_id % 9 = 0 then 'unknown file type' when not regexp_matches(coalesce(text, ''), '\\S') then 'no text' end r, len(l) n, list_sum([length(x) for x in l]) c from (select *, [x for x in string_split(text, chr(10)) if regexp_matches(x, '\\S')] l from documents))""")(ingested)


def statuses(s, d):
    """Events as callbacks of a seventh as many documents."""
    f = folder(s)
    callbacks = table_stream(s, d, "events").select(F.floor(F.col("event_id") / 7).alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 17 != 0, F.col("event_type")).alias("status"))
    jobs.track_status(callbacks, f"{f}/status", f"{f}/checkpoint", buckets=8).awaitTermination()
    return jobs.latest_status(s, f"{f}/status").select("doc_id", "status")


query("str2_status_replay", "", "select event_id // 7 doc_id, max_by(s, (ts, s)) status from (select *, case when event_id % 17 <> 0 then event_type else 'failed' end s from events) group by 1")(statuses)


def cached(s, d):
    """Clicks leave an answer, views ask for one."""
    f, k = folder(s), F.col("event_id")
    e = table_stream(s, d, "events").filter("event_type in ('click', 'view')").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    click = F.col("event_type") == "click"
    events = e.select(F.col("user_id").alias("key"), "ts", F.when(~click, k).alias("query_id"), F.when(click, F.concat(F.lit("a"), k)).alias("answer"), F.when(click, 3600 * (1 + k % 48)).alias("ttl"))
    jobs.cache_stream(events).writeStream.format("parquet").option("path", f"{f}/answers").option("checkpointLocation", f"{f}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema("query_id long, answer string").parquet(f"{f}/answers")


query("str5_cache_replay", "", ORACLES["qry10_cache_lookup"])(cached)


def lengths(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding function: characters, and blanks among them."""
    return [[float(len(x)), float(x.count(" "))] for x in texts]


query("gov15_embed", "chunks_v", "select chunk_id, length(chunk_text)::double chars, (length(chunk_text) - length(replace(chunk_text, ' ', '')))::double blanks from chunks_v")(
    lambda s, d: folds.embed(t.chunks(s, d).select("chunk_id", "chunk_text"), lengths, "chunk_text").select("chunk_id", F.col("embedding")[0].alias("chars"), F.col("embedding")[1].alias("blanks"))
)


def nearest_length(questions, contents):
    """A stand-in for a scorer: the closer the lengths, the higher."""
    return -(questions.str.len() - contents.str.len()).abs().astype(float)


query("rrk4_rerank_udf", KW + "hits_v", "select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id)::int rank from (select query_id, chunk_id, -abs(length(query) - length(chunk_text))::double score from hits_v join questions_v using (query_id))")(
    lambda s, d: folds.rerank_udf(ranked(s, d).select("query_id", "chunk_id", F.col("chunk_text").alias("content")).join(t.questions(s, d).select("query_id", "query"), "query_id"), nearest_length).select("query_id", "chunk_id", "score", "rank")
)

#: Permissions of each user in the array form, the object form, broken, null and empty.
_PERMISSIONS = """select c_custkey role_no, 'r' || c_custkey % 3 role_id, case c_custkey % 6 when 0 then '["read","n' || c_nationkey || '"]' when 1 then '{"read": true, "write": false, "n' || c_nationkey || '": true}' when 2 then '[broken'
  when 3 then '{"broken' when 4 then '[]' end permissions from """


def permissions_of(s, d):
    return s.sql(_PERMISSIONS.replace("{", "{{").replace("}", "}}") + "{customer}", customer=t.read_table(s, d, "customer"))


query("acl9_parse_permissions", "", "select c_custkey role_no, case c_custkey % 6 when 0 then 'read,n' || c_nationkey when 1 then 'n' || c_nationkey || ',read' else '' end permissions from customer")(
    lambda s, d: permissions_of(s, d).select("role_no", F.array_join(F.when(F.startswith("permissions", F.lit("{")), F.array_sort(access.parse_permissions(F.col("permissions")))).otherwise(access.parse_permissions(F.col("permissions"))), ",").alias("permissions"))
)
FORMS = {"r0": '["read","write"]', "r1": '["read"]'}
query("lif13_migrate_permissions", "", f"""select role_id, permissions, count(*) n from (select role_id, case when permissions like '{{%' then case role_id when 'r0' then '["read","write"]' when 'r1' then '["read"]' else permissions end else permissions end permissions
  from ({_PERMISSIONS} customer)) group by 1, 2""")(lambda s, d: lifecycle.migrate_permissions(permissions_of(s, d), FORMS).groupBy("role_id", "permissions").agg(F.count("*").alias("n")))
