"""Registered queries over evaluation runs, traces, and the choice of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import evaluation, retrieval
from kbspark.plans.queries import KW, HITS, active, found, hits, query, with_chunks
from kbspark.sources import tables as t
from kbspark.sources.fixtures import view

METRICS = ["faithfulness", "answer_relevance", "first_token_ms", "total_ms"]
LONG = "select id, unnest(['faithfulness', 'answer_relevance', 'first_token_ms', 'total_ms']) metric, unnest([faithfulness, answer_relevance, first_token_ms, total_ms]) score from "
REFUSED = "(trim(answer, ' ') = '' or regexp_matches(answer, '未找到|没有|不包含|无法提供|不在|抱歉'))"


def ranked(s: SparkSession, d: str) -> DataFrame:
    return with_chunks(found(s, d), active(s, d))


query("evl2_apply_ratings", "", """select event_id trace_id, event_type source, case when event_id % 12 = 0 then 5 when event_id % 6 = 0 then event_id % 5 end rating from events""")(
    lambda s, d: evaluation.apply_ratings(t.traces(s, d), t.traces(s, d).filter("trace_id % 6 = 0").select("trace_id", "ts", F.expr("trace_id % 5").alias("rating")).unionByName(t.traces(s, d).filter("trace_id % 12 = 0").select("trace_id", F.expr("ts + interval 5 minutes").alias("ts"), F.lit(5).cast("long").alias("rating")))))

query("evl3_sample_traces")(lambda s, d: evaluation.sample_traces(t.traces(s, d)).select("trace_id", "source"))

query("evl7_compare_runs", "eval_a_v eval_b_v", f"""select metric, a, b, round(b - a, 4) diff, case when round(b - a, 4) > 0.02 then 'improved' when round(b - a, 4) < -0.02 then 'regressed' else 'stable' end verdict
  from (select metric, round(avg(score), 4) a from ({LONG} eval_a_v) group by 1) join (select metric, round(avg(score), 4) b from ({LONG} eval_b_v) group by 1) using (metric)""")(lambda s, d: evaluation.compare_runs(view(s, d, "eval_a_v"), view(s, d, "eval_b_v"), METRICS))

query("evl8_sample_regressions", "eval_a_v eval_b_v", f"""select * from (select id, metric, round(coalesce(b.score, 0) - coalesce(a.score, 0), 4) diff from ({LONG} eval_a_v) a join ({LONG} eval_b_v) b using (id, metric)) where abs(diff) > 0.05""")(lambda s, d: evaluation.sample_regressions(view(s, d, "eval_a_v"), view(s, d, "eval_b_v"), METRICS))

query("evl9_eval_summary", "eval_a_v", f"""select count(*) total, count(*) filter (category <> 'negative') positive, count(*) filter (category = 'negative') negative, round(avg(faithfulness) filter (category <> 'negative'), 4) faithfulness, round(avg(answer_relevance) filter (category <> 'negative'), 4) answer_relevance,
  count(*) filter (category = 'negative' and {REFUSED}) neg_refused, count(*) filter (category = 'negative' and not {REFUSED}) neg_hallucinated, round(sum(first_token_ms) / count(*), 4) first_token_ms, round(sum(total_ms) / count(*), 4) total_ms from eval_a_v""")(lambda s, d: evaluation.eval_summary(view(s, d, "eval_a_v")))

query("evl10_rating_band", "eval_a_v", """select id, case when faithfulness >= 0.7 then 'good' when faithfulness >= 0.5 then 'fair' else 'poor' end band from eval_a_v""")(lambda s, d: view(s, d, "eval_a_v").select("id", evaluation.rating_band(F.col("faithfulness")).alias("band")))

query("evl12_span_stats", "spans_v", """select node, count(*) n, round(avg(ms), 6) mean_ms, max(ms) max_ms from spans_v where node in ('retrieve', 'dense', 'rerank', 'fuse') group by 1""")(lambda s, d: evaluation.span_stats(view(s, d, "spans_v"), ["retrieve", "dense", "rerank", "fuse"]))

query("evl13_diagnose", "eval_a_v", f"""select unnest(case when len(x) > 0 then x else ['none'] end) issue from (select list_filter([case when avg(coalesce(faithfulness, 0)) filter (category <> 'negative') < 0.5 then 'low_faithfulness' end, case when avg(coalesce(answer_relevance, 0)) filter (category <> 'negative') < 0.5 then 'low_relevance' end,
  case when count(*) filter (category = 'negative' and not {REFUSED}) > count(*) filter (category = 'negative') * 0.3 then 'hallucination' end, case when count(*) filter (n_hits = 0) > 0 then 'zero_recall' end], lambda i: i is not null) x from eval_a_v)""")(lambda s, d: evaluation.diagnose(view(s, d, "eval_a_v")))

query("evl15_span_tree", "spans_v", """select a.trace_id, a.span_id, 0 depth, a.node path from spans_v a where a.parent_id is null union all select b.trace_id, b.span_id, 1, a.node || '/' || b.node from spans_v a join spans_v b on b.parent_id = a.span_id where a.parent_id is null
  union all select c.trace_id, c.span_id, 2, a.node || '/' || b.node || '/' || c.node from spans_v a join spans_v b on b.parent_id = a.span_id join spans_v c on c.parent_id = b.span_id where a.parent_id is null""")(lambda s, d: evaluation.span_tree(view(s, d, "spans_v")))

SCORES = "round((ascii(substring(md5(query_id || chunk_id), 1, 1)) * 7 + ascii(substring(md5(query_id || chunk_id), 2, 1))) % 100 / cast(100 as double), 2)"
KNOWN = "ascii(substring(md5(query_id || chunk_id), 3, 1)) % 3 <> 0"
query("rrk1_rerank", KW, f"""select query_id, chunk_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int rank from (select query_id, chunk_id, case when count(*) over (partition by query_id) <= 10 then score when {KNOWN} then {SCORES} else 0.5 end score from bm25_v)) where rank <= 10""")(
    lambda s, d: evaluation.rerank(hits(s, d), hits(s, d).filter(KNOWN).select("query_id", "chunk_id", F.expr(SCORES).alias("score")), 10))

query("flt1_min_score", KW, """select query_id, count(*) filter (score >= 9) kept, count(*) filter (score < 9) filtered from questions_v left join bm25_v using (query_id) group by 1""")(lambda s, d: evaluation.min_score(t.questions(s, d), found(s, d), 9.0))

query("qlt2_version_conflicts", KW, f"""select query_id, kb_id, count(distinct effective_date) n, min(effective_date) oldest, max(effective_date) newest from (select *, row_number() over (partition by query_id order by score desc, chunk_id) r from ({HITS})) where r <= 5 group by 1, 2 having count(distinct effective_date) >= 2""", dates=("oldest", "newest",))(lambda s, d: evaluation.version_conflicts(hits(s, d)))

query("ctx1_context_text", KW, """select query_id, string_agg('[' || rank || '] ' || source_file || chr(10) || chunk_text, chr(10) || chr(10) order by rank) context from bm25_v join chunks_v using (chunk_id) group by 1""")(lambda s, d: evaluation.context_text(ranked(s, d)))

query("ctx2_budget_context", KW, """select query_id, chunk_id, rank, upto from (select query_id, chunk_id, rank, sum(least(length(chunk_text), 300)) over (partition by query_id order by rank)::bigint upto from bm25_v join chunks_v using (chunk_id) where rank <= 3) where upto <= 600""")(lambda s, d: evaluation.budget_context(ranked(s, d), 600))

query("cnv3_summary_due", "", """select conv_id, count(*) // 2 rounds, least(greatest(count(*) - 4, 0), 4) overflow from conversations group by 1 having count(*) // 2 > 1""")(lambda s, d: evaluation.summary_due(t.read_table(s, d, "conversations"), 1, 4))

query("cit1_sentences")(lambda s, d: t.read_table(s, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.posexplode(evaluation.sentences(F.col("text"))).alias("pos", "sentence")))


def grouped(s, d):
    """Hits dealt out to three sub-queries by document; four of five chunks stand for a parent."""
    h = ranked(s, d).select("query_id", (F.col("doc_id") % 3).alias("sub_id"), "rank", "chunk_id", "source_file", "score", F.col("chunk_text").alias("content"), (F.col("chunk_index") % 5 != 4).alias("has_parent"))
    subs = t.questions(s, d).select("query_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("sub_id"))
    return evaluation.grouped_context(h, subs, 3000)


query("ctx2_grouped_context", KW, """select query_id, sub_id, chunk_id, rank, entry, upto from (select *, sum(length(entry)) over (partition by query_id, sub_id order by place)::bigint upto from
  (select *, '[来源: ' || source_file || ' (相关度: ' || score::decimal(18, 6)::decimal(18, 2)::varchar || ')]' || chr(10) || left(chunk_text, case when chunk_index % 5 <> 4 then 2000 else 300 end) || chr(10) entry from
    (select *, doc_id % 3 sub_id, row_number() over (partition by query_id, doc_id % 3 order by rank) place from bm25_v join chunks_v using (chunk_id))) where place <= 3) where upto <= 1000""")(grouped)
