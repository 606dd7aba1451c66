"""Registered queries over whole traces, judges' scores, times of spans, summaries, weighted chunks, descendants, and citations by vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators import chunking, evaluation, intake, permissions, traces
from kbspark.plans.governance_queries import MEDIA, answers, media, ranked
from kbspark.plans.intake_queries import own_hits
from kbspark.plans.queries import KW, query
from kbspark.sources import tables as t
from kbspark.sources.fixtures import view


def whole_traces(s, d):
    """Questions, a third of them complex, with times of the event and the text of the document of their number."""
    k = F.col("query_id")
    q = t.questions(s, d).select("query_id", "query", F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("re "), "query")).alias("rewritten"), F.when(k % 3 == 0, "complex").when(k % 3 == 1, "factoid").alias("intent"), F.when(k % 6 == 0, k % 5).alias("n_subs"))
    e = t.read_table(s, d, "events").select(F.col("event_id").alias("query_id"), F.floor("value").alias("hybrid_ms"), F.when(F.col("event_id") % 2 == 0, 7).alias("rerank_ms"), F.lit(None).cast("long").alias("planner_ms"), F.floor(F.col("value") * 2).alias("total_ms")).filter("query_id % 5 <> 0")
    h = ranked(s, d)
    n = h.groupBy("query_id").agg(F.count("*").alias("keyword_hits")).withColumn("dense_hits", F.lit(3))
    r = t.read_table(s, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("response"))
    got = traces.full_traces(q, h, e, n, r)
    return got.withColumn("chunks", F.array_join(F.transform("chunks", lambda c: F.concat_ws("|", c.rank.cast("string"), c.chunk_id, c.doc_id.cast("string"), c.source_file, F.format_string("%.4f", c.score), c.snippet)), "\n"))


query("evl1_full_traces", KW + "hits_v", """select query_id, query original_query, case when query_id % 4 = 1 then 're ' || query else query end rewritten_query, case when query_id % 3 = 0 then 'dag' else 'simple' end retrieval_path,
  case when query_id % 3 = 0 then case when query_id % 6 = 0 then query_id % 5 else 0 end end n_sub_queries, coalesce(n, 0) top_k, coalesce(floor(value), 0)::bigint hybrid_ms, case when event_id % 2 = 0 then 7 else 0 end::bigint rerank_ms, 0::bigint planner_ms,
  coalesce(floor(value * 2), 0)::bigint total_ms, case when n > 0 then 3 else 0 end::bigint dense_hits, coalesce(n, 0) keyword_hits, x chunks, coalesce(left(text, 500), '') response
  from questions_v left join (select query_id, count(*) n, string_agg(rank || '|' || chunk_id || '|' || doc_id || '|' || source_file || '|' || printf('%.4f', round(score, 4)) || '|' || left(chunk_text, 150), chr(10) order by rank) filter (rank <= 10) x from hits_v group by 1) using (query_id)
  left join (select * from events where event_id % 5 <> 0) on event_id = query_id left join documents on doc_id = query_id""")(whole_traces)

_JUDGE = "event_id % 5 / cast(4 as double) faithfulness, case when event_id % 3 <> 0 then event_id % 7 / cast(6 as double) end answer_relevance, event_id % 9 / cast(8 as double) context_relevance, 'j' || event_id % 2 judge_model, event_id % 100 judge_latency_ms"


def judgements(s, d):
    """A fourth of the traces are judged, some twice, and some that there aren't."""
    e = t.read_table(s, d, "events")
    k = F.col("event_id")
    row = lambda some, trace, later, judge: e.filter(some).select(
        trace.alias("trace_id"), (F.col("ts") + F.expr(f"interval {later} minutes")).alias("ts"), (k % 5 / 4.0).cast("double").alias("faithfulness") if judge else F.lit(0.5).cast("double").alias("faithfulness"),
        F.when(k % 3 != 0, k % 7 / F.lit(6.0).cast("double")).alias("answer_relevance") if judge else F.lit(None).cast("double").alias("answer_relevance"),
        (k % 9 / F.lit(8.0).cast("double")).alias("context_relevance") if judge else F.lit(0.25).cast("double").alias("context_relevance"),
        F.concat(F.lit("j"), k % 2).alias("judge_model") if judge else F.lit("late").alias("judge_model"), (k % 100).alias("judge_latency_ms"),
    )
    return row("event_id % 4 = 0", k, 0, True).unionByName(row("event_id % 8 = 0", k, 5, False)).unionByName(row("event_id % 40 = 0", -1 - k, 0, True))


query("evl2_apply_judge", "", f"""select event_id trace_id, event_type source, case when event_id % 8 = 0 then 0.5 when event_id % 4 = 0 then faithfulness end faithfulness, case when event_id % 8 <> 0 and event_id % 4 = 0 then answer_relevance end answer_relevance,
  case when event_id % 8 = 0 then 0.25 when event_id % 4 = 0 then context_relevance end context_relevance, case when event_id % 8 = 0 then 'late' when event_id % 4 = 0 then judge_model end judge_model, case when event_id % 4 = 0 then judge_latency_ms end judge_latency_ms from (select *, {_JUDGE} from events)""")(
    lambda s, d: traces.apply_judge(t.traces(s, d).select("trace_id", "source"), judgements(s, d))
)
query("evl2_missing_ids", "", "select -1 - event_id trace_id from events where event_id % 40 = 0")(lambda s, d: traces.missing_ids(t.traces(s, d), judgements(s, d)))

DIMENSIONS = ["faithfulness", "answer_relevance", "context_relevance"]
query("evl6_judge_dimensions", "", " union all ".join(f"select '{c}' metric, count({c}) n, round(avg({c}), 4) mean, round(min({c}), 4) least, round(max({c}), 4) most from (select {_JUDGE} from events where event_id % 4 = 0 and event_id % 8 <> 0 union all select 0.5, null, 0.25, '', 0 from events where event_id % 8 = 0)" for c in DIMENSIONS))(
    lambda s, d: traces.judge_dimensions(traces.apply_judge(t.traces(s, d).select("trace_id"), judgements(s, d)).withColumnRenamed("trace_id", "id"), DIMENSIONS)
)

_NAMED = "case node when 'retrieve' then 'hybrid_search' when 'rerank' then 'reranker' when 'dense' then 'query_planner' when 'fuse' then 'llm_generation' when 'other' then case when trace_id % 2 = 0 then 'judge' else 'other' end end"
query("evl12_named_spans", "spans_v", f"select node, count(*) n, round(avg(ms), 6) mean_ms, max(ms) max_ms from (select {_NAMED} node, ms from spans_v) where node <> 'other' group by 1")(
    lambda s, d: evaluation.span_stats(view(s, d, "spans_v").withColumn("node", F.expr(_NAMED)), traces.NODES)
)

_TREE = """select trace_id, span_id, parent_id, node, case when trace_id % 7 <> 0 then floor(ms)::bigint else 0 end duration_ms from spans_v"""
query("evl15_span_durations", "spans_v", f"""with s as ({_TREE}), f as (select trace_id, span_id, 0 depth, node path, duration_ms from s where parent_id is null),
  g as (select s.trace_id, s.span_id, 1 depth, path || '/' || node path, s.duration_ms from s join f on s.parent_id = f.span_id), h as (select s.trace_id, s.span_id, 2 depth, path || '/' || node path, s.duration_ms from s join g on s.parent_id = g.span_id)
  select * from f union all select * from g union all select * from h""".replace("with s as", "select * from (with s as", 1) + ")")(
    lambda s, d: traces.span_durations(view(s, d, "spans_v").withColumns({"start_time": F.col("ts").cast("timestamp"), "end_time": F.when(F.col("trace_id") % 7 != 0, F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor("ms") * 1000 + 999))}))
)

query("cnv3_summary_action", "", """select conv_id, overflow, case when overflow > 0 then 'update' when length(summary) // 2 >= 40 then 'compress' else 'none' end "action" from
  (select conv_id, least(greatest(count(*) - 4, 0), 4) overflow, first(text order by turn) summary from conversations group by 1 having count(*) // 2 > 0)""")(
    lambda s, d: (lambda c: traces.summary_action(c, c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("summary")), 0, 40, 4))(t.read_table(s, d, "conversations"))
)

_SIZE = "least(floor(length({0}) * 0.15), 200)::int"
_LENT = "case when kind = 'text' then content end"
query("chk6_weighted_content", "chunks_v", f"""select chunk_id, weighted, greatest(1, length(weighted) // 2)::bigint tokens from (select chunk_id, concat_ws(chr(10), content, case when {_SIZE.format('p')} > 0 then right(p, {_SIZE.format('p')}) end, case when {_SIZE.format('n')} > 0 then left(n, {_SIZE.format('n')}) end) weighted
  from (select chunk_id, content, lag({_LENT}) over w p, lead({_LENT}) over w n from {MEDIA} window w as (partition by doc_id order by chunk_index)))""")(lambda s, d: chunking.weighted_content(media(s, d)).select("chunk_id", "weighted", "tokens"))

query("acl2_descendants", "groups_v closure_v", "select ancestor group_id, group_id descendant from closure_v where group_id <> ancestor")(lambda s, d: permissions.descendants(permissions.group_closure(t.groups(s, d))))


def vector_hits(s, d):
    """Hits of which half have a vector, and vectors of the sentences."""
    h = own_hits(s, d)
    e = t.read_table(s, d, "embeddings").select("vec_id", "embedding")
    n = max(1, e.count())
    with_vector = h.withColumn("vec_id", F.when(F.col("rank") % 2 == 0, F.pmod(F.col("answer_id") + F.col("rank"), F.lit(n)))).join(e, "vec_id", "left")
    v = h.select("answer_id", F.col("rank").alias("sentence_idx"), F.pmod(F.col("answer_id") + F.col("rank"), F.lit(n)).alias("vec_id")).join(e, "vec_id")
    return with_vector, v


query("cit3_cite_vectors")(lambda s, d: (lambda h, v: intake.cite(answers(s, d), h, 0.6, v))(*vector_hits(s, d)))
