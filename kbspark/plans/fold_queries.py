"""Registered queries over blocks of pages, merged and split chunks, limits, caches, feedback and answers of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators import folds
from kbspark.operators.html_blocks import html_blocks
from kbspark.plans.governance_queries import media, typed
from kbspark.plans.queries import query
from kbspark.sources import tables as t
from kbspark.streaming.jobs import check_intake

query("blk1_html_blocks")(lambda s, d: html_blocks(t.read_table(s, d, "pages")))


def children(s, d):
    c = t.chunks(s, d)
    return folds.split_children(c.select(F.col("chunk_id").alias("parent_id"), F.lit("text").alias("kind"), F.substring_index("chunk_text", " ", 1).alias("heading"), F.col("chunk_text").alias("content")))


query("chk5_split_children")(children)

query("chk11_merge_short", "chunks_v", """with recursive x as (select doc_id, chunk_index i, chunk_text t, length(chunk_text) n, case when length(chunk_text) % 7 in (0, 1) then 'other' else 'text' end kind from chunks_v),
  f as (select doc_id, i, 0::bigint g, n::bigint c, kind = 'text' and greatest(1, n // 2) < 300 o from x where i = 0
    union all select x.doc_id, x.i, case when j then f.g else f.g + 1 end, case when j then f.c + 2 + x.n else x.n end, case when j then greatest(1, (f.c + 2 + x.n) // 2) < 300 else x.kind = 'text' and greatest(1, x.n // 2) < 300 end
    from (select f.*, x.n xn, f.o and x.kind = 'text' and (greatest(1, (f.c + 2 + x.n) // 2) <= 300 or greatest(1, f.c // 2) < 50) j from f join x on x.doc_id = f.doc_id and x.i = f.i + 1) f join x on x.doc_id = f.doc_id and x.i = f.i + 1)
  select doc_id, g::int new_index, sha256(doc_id || ':' || g) chunk_id, string_agg(t, chr(10) || chr(10) order by i) as content, count(*)::int n_merged, greatest(1, length(string_agg(t, chr(10) || chr(10) order by i)) // 2)::int tokens from f join x using (doc_id, i) group by doc_id, g""".replace("with recursive x", "select * from (with recursive x", 1) + ")")(lambda s, d: folds.merge_short(media(s, d)))

query("str4_rate_limit", "", """select * from (with recursive r as (select event_id, user_id, epoch_us(ts) / 1e6 as w, (1 + event_id % 20)::double n, row_number() over (partition by user_id order by ts, event_id) i from events),
  f as (select event_id, user_id, i, w, (30 - n)::double k, true allowed, 0::double retry_after from r where i = 1
    union all select event_id, user_id, i, w, case when h >= n then h - n else h end, h >= n, case when h >= n then 0 else greatest(1, n - h) end
    from (select r.*, least(30, f.k + greatest(r.w - f.w, 0)) h from f join r on r.user_id = f.user_id and r.i = f.i + 1))
  select event_id request_id, allowed, round(retry_after, 3) retry_after from f)""")(
    lambda s, d: folds.rate_limit(t.read_table(s, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("request_id"), (1 + F.col("event_id") % 20).alias("n"))).withColumn("retry_after", F.round("retry_after", 3))
)


def cache(s, d):
    e = t.read_table(s, d, "events")
    entries = e.filter("event_type = 'click'").select(F.col("user_id").alias("key"), F.col("ts").alias("cached_at"), (3600 * (1 + F.col("event_id") % 48)).alias("ttl"), F.concat(F.lit("a"), F.col("event_id")).alias("answer"))
    return folds.cache_lookup(e.filter("event_type = 'view'").select(F.col("event_id").alias("query_id"), F.col("user_id").alias("key"), "ts"), entries)


query("qry10_cache_lookup", "", """select query_id, case when epoch_us(ts) < epoch_us(cached) + 3600000000 * (1 + id % 48) then 'a' || id end answer from (select q.event_id query_id, q.ts, e.ts as cached, e.event_id id,
  row_number() over (partition by q.event_id order by e.ts desc nulls last, 'a' || e.event_id desc) r from events q left join events e on e.user_id = q.user_id and e.event_type = 'click' and e.ts <= q.ts where q.event_type = 'view') where r = 1""")(cache)


def feedback(s, d):
    e = t.read_table(s, d, "events")
    id_ = F.col("event_id")
    rated = e.filter(id_ % 6 == 0).select(F.when(id_ % 60 == 0, id_ + 10**9).otherwise(id_).alias("trace_id"), F.timestamp_add("SECOND", F.col("event_id") % 1200, F.col("ts")).alias("rated_at"), (id_ % 5).alias("rating"))
    traces = e.select(id_.alias("trace_id"), "ts")
    return folds.feedback_join(rated, traces, traces)


query("str3_feedback_join", "", "select case when event_id % 60 = 0 then event_id + 1000000000 else event_id end trace_id, event_id % 5 rating, case when event_id % 60 = 0 then 'error' when event_id % 1200 <= 600 then 'cached' else 'stored' end outcome from events where event_id % 6 = 0")(feedback)


def titles(s, d):
    c = typed(s, d).filter("chunk_type = 'title'").select("doc_id", F.col("chunk_index").alias("index"), F.length("chunk_text").alias("n"), "chunk_text")
    wrong = (F.col("doc_id") % 6 == 0) & (F.col("n") % 5 == 0)
    items = c.select("doc_id", F.when(wrong, F.col("index") + 1000).otherwise(F.col("index")).alias("index"), (1 + F.col("n") % 7).alias("level"), F.col("chunk_text").alias("heading"), (F.col("n") % 6).alias("n_entities"))
    return folds.validate_titles(items, c)


query("gov9_validate_titles", "chunks_v", """select doc_id, case when doc_id % 6 = 0 and n % 5 = 0 then chunk_index + 1000 else chunk_index end "index", 1 + n % 7 "level", chunk_text heading, n % 6 n_entities
  from (select *, bool_or((doc_id % 6 = 0 and n % 5 = 0) or n % 7 = 6) over (partition by doc_id) bad from (select *, length(chunk_text) n from chunks_v) where n < 60) where not bad""")(titles)


def assigned(s, d):
    k = F.col("doc_id") % 7
    r = t.read_table(s, d, "documents").select("doc_id", F.col("source").alias("kb_id"), F.when(k < 2, "create").when(k < 6, "existing").alias("action"), F.when(k == 0, F.concat(F.lit("new "), "lang")).alias("new_kb_name"), F.when(k == 3, "src1").when(k == 4, "").alias("found_kb_id"), F.when(k == 5, F.concat(F.lit("old "), "doc_id")).alias("supersedes"))
    return folds.assign_kb(r)


query("gov10_assign_kb", "", """select doc_id, case when doc_id % 7 < 2 then 'create' else 'existing' end as "action", case when doc_id % 7 < 2 then null when doc_id % 7 = 3 then 'src1' else source end target_kb_id,
  case doc_id % 7 when 0 then coalesce('new ' || lang, '未命名知识库') when 1 then '未命名知识库' end new_kb_name, case when doc_id % 7 = 5 then 'old ' || doc_id end supersedes from documents""")(assigned)


def intake(s, d):
    k = F.col("doc_id") % 9
    kind = F.when(k == 0, "exe").when(k == 1, None).when(k == 2, "PDF").when(k == 3, "md").otherwise("txt")
    good, failed = check_intake(t.read_table(s, d, "documents").select("doc_id", kind.alias("file_type"), "text"))
    return good.select("doc_id", F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("reason")).unionByName(failed)


query("src2_intake", "", "select doc_id, case when r is null then 'accepted' else 'failed' end status, r reason from (select doc_id, case when doc_id is null then 'no document id' when doc_id % 9 < 2 then 'unknown file type' when not regexp_matches(coalesce(text, ''), '\\S') then 'no text' end r from documents)")(intake)
