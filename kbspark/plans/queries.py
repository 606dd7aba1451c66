"""Registered queries of the reference's own operators, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions import text as tx
from kbspark.operators import audit, chunking, near_pairs, permissions, retrieval, usage, vector_graph
from kbspark.plans.oracle_views import duck
from kbspark.sources import tables as t
from kbspark.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", body: str | None = None, dates: tuple[str, ...] = ()):
    """Registers a query and its SQL; the columns `dates` are returned as text in both."""

    def add(f):
        QUERIES[name] = (lambda s, d: f(s, d).withColumns({c: F.col(c).cast("string") for c in dates})) if dates else f
        if body:
            plain = f"select * replace ({', '.join(f'{c}::varchar as {c}' for c in dates)}) from ({body})" if dates else body
            ORACLES[name] = duck(views, plain)
        return f

    return add


def with_chunks(found: DataFrame, chunks: DataFrame, most: int = 200_000) -> DataFrame:
    """Hits with the columns of their chunks, written once as several steps read them. Few hits go to the texts, not the texts to the hits."""
    small = F.broadcast(found) if found.count() <= most else found
    return t.materialize(small.join(chunks, "chunk_id"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits with the columns of their chunks."""
    return with_chunks(found(spark, sf_dir).drop("rank"), active(spark, sf_dir))


def found(spark: SparkSession, sf_dir: str, k: int | str = 30) -> DataFrame:
    """Keyword hits of the questions."""
    return t.materialize(keyword_search(spark, sf_dir)(t.questions(spark, sf_dir), k))


def keyword_search(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame, int | str], DataFrame]:
    """Search by terms over the active chunks: all questions are asked at once, so the texts are read without an index."""
    return lambda queries, k: retrieval.keyword_search(queries, active(spark, sf_dir), k)


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.chunks(spark, sf_dir).filter("status = 'active'")


KW = "chunks_v questions_v postings_v terms_v bm25_v "
HITS = "select h.query_id, h.score, c.* from bm25_v h join chunks_v c using (chunk_id)"

query('aud1_totals', 'chunks_v', """select count(*) n_rows, count(distinct doc_id) n_docs, count(distinct kb_id) n_sources from chunks_v""")(lambda s, d: audit.totals(t.chunks(s, d)))

query('aud2_doc_stats', 'chunks_v', """select doc_id, count(*) n, min(chunk_index) first_index, max(chunk_index) last_index, min(length(chunk_text)) shortest, max(length(chunk_text)) longest, round(avg(length(chunk_text)), 6) mean_length from chunks_v group by 1""")(lambda s, d: audit.doc_stats(t.chunks(s, d)))

query('aud3_length_stats', 'chunks_v', """select round(avg(n), 6) mean, min(n) least, max(n) most, quantile_cont(n, 0.5) median, quantile_cont(n, 0.25) p25, quantile_cont(n, 0.75) p75, round(stddev_samp(n), 6) stddev from (select length(chunk_text) n from chunks_v)""")(lambda s, d: audit.length_stats(t.chunks(s, d)))

query('aud4_length_histogram', 'chunks_v', """select (case when n < 20 then 0 when n < 50 then 1 when n < 100 then 2 when n < 200 then 3 when n < 300 then 4 when n < 500 then 5 when n < 800 then 6 when n < 1000 then 7 when n < 1500 then 8 when n < 2000 then 9 else 10 end)::int bucket, count(*) n, round(avg(n), 6) mean_length from (select length(chunk_text) n from chunks_v) group by 1""")(lambda s, d: audit.length_histogram(t.chunks(s, d)))

query('aud5_length_outliers', 'chunks_v', """select chunk_id, length(chunk_text) n, length(chunk_text) > 2000 is_long from chunks_v where length(chunk_text) < 20 or length(chunk_text) > 2000""")(lambda s, d: audit.length_outliers(t.chunks(s, d)))

query('aud7_boundary_quality', 'chunks_v', """select doc_id, sum(regexp_matches(chunk_text, '^[a-z]')::bigint)::bigint starts_lower, sum((chunk_index <> m and not regexp_matches(chunk_text, '[.!?。！？]$'))::bigint)::bigint ends_open from (select *, max(chunk_index) over (partition by doc_id) m from chunks_v) group by 1""")(lambda s, d: audit.boundary_quality(t.chunks(s, d)))

query('aud8_fragment_transitions', 'chunks_v', """select doc_id, chunk_index from (select *, lead(chunk_text) over (partition by doc_id order by chunk_index) x from chunks_v) where not regexp_matches(chunk_text, '[.!?。！？]$') and regexp_matches(x, '^[a-z ]')""")(lambda s, d: audit.fragment_transitions(t.chunks(s, d)))

query('aud9_exact_duplicates', 'chunks_v', """select sha256(chunk_text) hash, count(*) n, count(distinct doc_id) n_docs, min(chunk_id) first_chunk from chunks_v group by 1 having count(*) > 1""")(lambda s, d: audit.exact_duplicates(t.chunks(s, d)))

GRAMS = "list_sort(list_distinct(flatten([[substring('  ' || w || ' ', i, 3) for i in range(1, length(w) + 2)] for w in list_distinct(regexp_extract_all(lower(chunk_text), '[\\p{L}\\p{N}]+'))])))"
PREFIX = "ks[1:(n - ceil(0.6 * n) + 1)::int]"
BITS = ", ".join(f"coalesce(bit_or(1::ubigint << (k % 64)::ubigint) filter (k % 256 // 64 = {i}), 0::ubigint) b{i}" for i in range(4))
query('aud10_near_duplicates', 'chunks_v', f"""select * from (with f as (select s, doc_id d, min(chunk_index) i from (select doc_id, chunk_index, {GRAMS} s from chunks_v) where len(s) > 0 group by all),
  c as (select s, len(s) n, row_number() over () id, list({{'d': d, 'i': i}} order by d)[1:2] o from f group by s), e as (select id, n, unnest(s) g from c), num as (select g, row_number() over (order by count(*), g) k from e group by g),
  k as (select id, n, list_sort(list(k)) ks, {BITS} from e join num using (g) group by 1, 2), p as (select id, n, b0, b1, b2, b3, unnest({PREFIX}) k, generate_subscripts({PREFIX}, 1) pl from k),
  m as (select distinct a.id a, b.id b from p a join p b on a.k = b.k and a.id < b.id and a.n >= 0.6 * b.n and b.n >= 0.6 * a.n and least(a.n - a.pl, b.n - b.pl) + 1 >= ceil(0.375 * (a.n + b.n))
    and (a.n + b.n - bit_count(xor(a.b0, b.b0)) - bit_count(xor(a.b1, b.b1)) - bit_count(xor(a.b2, b.b2)) - bit_count(xor(a.b3, b.b3))) / 2 >= ceil(0.375 * (a.n + b.n))),
  v as (select x.id x, y.id y, x.n + y.n u, len(list_intersect(x.ks, y.ks)) w from m join k x on x.id = a join k y on y.id = b),
  two as (select w::double / (u - w) z, cx.o xo, cy.o yo from v join c cx on cx.id = x join c cy on cy.id = y where w > 0.6 * (u - w) union all select 1.0, o, o from c where len(o) = 2),
  q as (select z, case when xo[1] <= yo[1] then xo else yo end lo, case when xo[1] <= yo[1] then yo else xo end hi from two),
  r as (select z, case when lo[1].d <> hi[1].d or len(hi) = 2 then lo[1] when len(lo) = 2 then hi[1] end a, case when lo[1].d <> hi[1].d then hi[1] when len(hi) = 2 then hi[2] when len(lo) = 2 then lo[2] end b from q)
  select a.d doc_a, a.i index_a, b.d doc_b, b.i index_b, round(z, 6) similarity, row_number() over (order by round(z, 6) desc, a.d, a.i, b.d, b.i)::int rank from r where a is not null order by rank limit 20)""")(lambda s, d: near_pairs.closest(t.chunks(s, d)))

query('aud11_prefix_overlap', 'chunks_v', """select distinct a.chunk_id a, b.chunk_id b from chunks_v a join (select *, left(chunk_text, 80) h from chunks_v where length(chunk_text) >= 100) b on a.doc_id <> b.doc_id and contains(a.chunk_text, b.h)""")(lambda s, d: near_pairs.prefix_overlap(t.chunks(s, d)))

query('aud12_index_gaps', 'chunks_v', """select * from (select doc_id, chunk_index "after", lead(chunk_index) over (partition by doc_id order by chunk_index) "before" from chunks_v where length(chunk_text) >= 50) where "before" - "after" > 1""")(lambda s, d: audit.index_gaps(t.chunks(s, d).filter("length(chunk_text) >= 50")))

query('chk1_estimate_tokens', 'chunks_v', """select chunk_id, greatest(1, length(chunk_text) // 2)::bigint tokens from chunks_v""")(lambda s, d: t.chunks(s, d).select("chunk_id", tx.estimate_tokens(F.col("chunk_text")).alias("tokens")))

query('chk2_chunk_id', 'chunks_v', """select doc_id, chunk_index, sha256(doc_id || ':' || chunk_index) id from chunks_v""")(lambda s, d: t.chunks(s, d).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), tx.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("id")))

query('chk3_truncate_text', 'chunks_v', """select chunk_id, case when length(chunk_text) > 120 then left(chunk_text, 120) || '...' else chunk_text end snippet from chunks_v""")(lambda s, d: t.chunks(s, d).select("chunk_id", tx.truncate_text(F.col("chunk_text"), 120).alias("snippet")))

query('chk9_overlap_content', 'chunks_v', """select chunk_id, concat_ws(chr(10), case when least(floor(length(p) * 0.15), 200) > 0 then right(p, least(floor(length(p) * 0.15), 200)::int) end, chunk_text, case when least(floor(length(n) * 0.15), 200) > 0 then left(n, least(floor(length(n) * 0.15), 200)::int) end) content from (select *, lag(chunk_text) over w p, lead(chunk_text) over w n from chunks_v window w as (partition by doc_id order by chunk_index))""")(lambda s, d: chunking.overlap_content(t.chunks(s, d)))

query('chk10_chunk_relations', 'chunks_v', """select chunk_id, lag(chunk_id) over w prev_id, lead(chunk_id) over w next_id from chunks_v window w as (partition by doc_id order by chunk_index)""")(lambda s, d: chunking.chunk_relations(t.chunks(s, d)))

query('chk4_pack_parents', '', None)(lambda s, d: chunking.pack_parents(t.chunks(s, d)))

query('gov1_mask_pii', '', None)(lambda s, d: t.read_table(s, d, "documents").select("doc_id", F.sha2(tx.mask_pii(F.col("text")), 256).alias("masked_sha256")))

query('gov3_pii_report', '', """select rule, sum(n)::bigint hits, count(*) filter (n > 0) n_docs from (select 'email' rule, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}')) n from documents union all select 'digits', len(regexp_extract_all(text, '[0-9]{12,}')) from documents) group by 1""")(lambda s, d: chunking.pii_report(t.read_table(s, d, "documents"), [("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"), ("digits", "[0-9]{12,}")]))

query('kw3_postings', 'chunks_v postings_v', """select chunk_id, term, tf from postings_v""")(lambda s, d: retrieval.postings(active(s, d)))

query('kw4_query_terms', 'questions_v terms_v', """select query_id, term from terms_v""")(lambda s, d: retrieval.query_terms(t.questions(s, d)))

query('kw5_keyword_search', KW, """select query_id, chunk_id, score, rank from bm25_v""")(lambda s, d: found(s, d))

query('vec2_dense_search', 'chunks_v questions_v vectors_v qvec_v dense_v', """select query_id, chunk_id, score, rank from dense_v""")(lambda s, d: retrieval.dense_search(t.question_vectors(s, d), t.chunk_vectors(s, d)))

query('vec3_dense_search_ann', '', None)(lambda s, d: vector_graph.search(t.question_vectors(s, d), *vector_graph.build_graph(t.chunk_vectors(s, d))))

query('vec1_cosine', 'chunks_v vectors_v', """select chunk_id, round(list_inner_product(e, list_reverse(e)) / sqrt(list_inner_product(e, e)) / sqrt(list_inner_product(e, e)), 6) c from (select chunk_id, [x::double for x in embedding] e from vectors_v)""")(lambda s, d: t.chunk_vectors(s, d).select("chunk_id", F.round(tx.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("c")))

query('fus2_hybrid_search', KW + 'vectors_v qvec_v dense_v', """select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int rank from (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 9) score, count(*) n_lists from (select query_id, chunk_id, rank from dense_v union all select query_id, chunk_id, rank from bm25_v) group by 1, 2)) where rank <= 30""")(lambda s, d: retrieval.rrf([retrieval.dense_search(t.question_vectors(s, d), t.chunk_vectors(s, d)), found(s, d)]))

query('dup2_dedup_content', KW, f"""select query_id, chunk_id, score from (select *, row_number() over (partition by query_id, trim(left(chunk_text, 300), ' ') order by score desc, chunk_id) n from ({HITS})) where n = 1""")(lambda s, d: retrieval.dedup_content(hits(s, d)).select("query_id", "chunk_id", "score"))

query('dup3_cap_per_doc', KW, f"""select query_id, chunk_id from (select *, row_number() over (partition by query_id, doc_id order by score desc, chunk_id) n from ({HITS})) where n <= 1""")(lambda s, d: retrieval.cap_per_doc(hits(s, d), 1).select("query_id", "chunk_id"))

query('dup4_merge_adjacent', KW, f"""select query_id, doc_id, first(chunk_id order by chunk_index) chunk_id, count(*) n, string_agg(chunk_text, chr(10) order by chunk_index) content, round(avg(score), 9) score from (select *, chunk_index - row_number() over (partition by query_id, doc_id order by chunk_index) run from ({HITS})) group by query_id, doc_id, run""")(lambda s, d: retrieval.merge_adjacent(hits(s, d)))

query('flt4_time_range', KW, f"""select query_id, chunk_id from ({HITS}) where coalesce(expiry_date >= date '2024-09-01', true)""")(lambda s, d: retrieval.temporal(hits(s, d), "2024-09-01").select("query_id", "chunk_id"))

query('qlt1_quality_flags', KW, """select query_id, coalesce(n, 0) n, coalesce(b < 12, true) weak from questions_v left join (select query_id, max(score) b, count(*) n from bm25_v group by 1) using (query_id)""")(lambda s, d: retrieval.quality_flags(t.questions(s, d), found(s, d), 12.0))

query('qlt4_recall_stats', KW + 'vectors_v qvec_v dense_v', """select query_id, count(d) dense_hits, count(k) keyword_hits, count(coalesce(d, k)) merged, count(d + k) overlap from questions_v left join (select query_id, chunk_id, max(d) d, max(k) k from (select query_id, chunk_id, 1 d, null k from dense_v union all select query_id, chunk_id, null, 1 from bm25_v) group by 1, 2) using (query_id) group by 1""")(lambda s, d: retrieval.recall_stats(t.questions(s, d), retrieval.dense_search(t.question_vectors(s, d), t.chunk_vectors(s, d)), found(s, d)))

query('acl1_effective_groups', 'groups_v members_v closure_v effective_v', """select * from effective_v""")(lambda s, d: permissions.effective_groups(t.members(s, d), permissions.group_closure(t.groups(s, d))))

query('acl2_ancestors', 'groups_v closure_v', """select * from closure_v where group_id <> ancestor""")(lambda s, d: permissions.group_closure(t.groups(s, d)).filter("group_id <> ancestor"))

query('acl3_expanded_members', 'groups_v members_v closure_v effective_v', """select group_id, count(*) n_users from effective_v group by 1""")(lambda s, d: permissions.expanded_members(t.members(s, d), permissions.group_closure(t.groups(s, d))))

query('acl4_global_admins', 'users_v groups_v members_v', """select user_id from users_v where is_global_admin union select user_id from members_v join groups_v using (group_id) where is_system_admin""")(lambda s, d: permissions.global_admins(t.users(s, d), t.members(s, d), t.groups(s, d)))

query('acl5_user_spaces', 'groups_v members_v closure_v effective_v space_groups_v', """select user_id, space_id, count(*) n_groups from effective_v join space_groups_v using (group_id) group by 1, 2""")(lambda s, d: permissions.user_spaces(permissions.effective_groups(t.members(s, d), permissions.group_closure(t.groups(s, d))), t.space_groups(s, d)))

query('acl19_member_counts', 'groups_v members_v', """select group_id, count(user_id) n from groups_v left join members_v using (group_id) group by 1""")(lambda s, d: permissions.member_counts(t.groups(s, d), t.members(s, d)))

query('cnv1_history_window', '', """select conv_id, string_agg(role || ': ' || left(text, 200), chr(10) order by turn) history from (select *, row_number() over (partition by conv_id order by turn desc) n from conversations) where n <= 6 group by 1""")(lambda s, d: usage.history_window(t.read_table(s, d, "conversations")))

query('cnv2_conversation_stats', '', """select conv_id, count(*) n_messages, count(*) // 2 rounds, left(replace(arg_min(text, turn) filter (role = 'user'), chr(10), ' '), 50) title from conversations group by 1""")(lambda s, d: usage.conversation_stats(t.read_table(s, d, "conversations")))

query('cnv6_recent_history', '', """select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) n from conversations) where n <= 4 and role in ('user', 'assistant')""")(lambda s, d: usage.recent_history(t.read_table(s, d, "conversations")))

query('evl6_judge_scores', 'traces_v', """select source, count(faithfulness) n_scored, round(avg(faithfulness), 4) mean, min(faithfulness) least, max(faithfulness) most from traces_v group by 1""")(lambda s, d: usage.judge_scores(t.traces(s, d)))

query('evl11_latency_stats', 'traces_v', """select source, count(*) n, round(min(total_ms), 6) least, round(max(total_ms), 6) most, round(quantile_cont(total_ms, 0.5), 6) median from traces_v group by 1""")(lambda s, d: usage.latency_stats(t.traces(s, d)))

query('evl14_scores_by_group', 'traces_v', """select case when faithfulness >= 0.7 then 'good' when faithfulness >= 0.5 then 'fair' when faithfulness is not null then 'poor' else 'none' end band, count(*) n, round(avg(total_ms), 4) mean_ms from traces_v group by 1""")(lambda s, d: usage.scores_by_group(t.traces(s, d)))

RUN = "user_id || '-' || strftime(ts, '%Y-%m-%d')"


def results(s, d):
    e = t.read_table(s, d, "events")
    return e.select(F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("run_id"), F.col("event_id").alias("result_id"), "ts", (F.col("event_id") % 3).alias("n_hits"))


query('str6_failure_streaks', '', f"""select * from (with recursive r as (select {RUN} run_id, event_id, event_id % 3 = 0 e, epoch_us(ts) / 1e6 as w, row_number() over (partition by {RUN} order by ts, event_id) i from events),
  f as (select run_id, event_id result_id, i, w as b, e::int streak, 'ok' state from r where i = 1
    union all select run_id, event_id, i, b, n, case when state <> 'ok' then state when n >= 2 then 'empty' when w - b > 7200 then 'timeout' else 'ok' end from (select r.*, f.b, f.state, case when r.e then f.streak + 1 else 0 end n from f join r on r.run_id = f.run_id and r.i = f.i + 1))
  select run_id, result_id, streak, state from f)""")(lambda s, d: usage.failure_streaks(results(s, d), limit=7200.0))

query('str7_cooldown', '', """select * from (with recursive r as (select user_id, event_id, epoch_us(ts) / 1e6 as w, row_number() over (partition by user_id order by ts, event_id) i from events),
  f as (select user_id, event_id request_id, i, w as l, true allowed from r where i = 1
    union all select r.user_id, r.event_id, r.i, case when r.w - f.l >= 3600 then r.w else f.l end, r.w - f.l >= 3600 from f join r on r.user_id = f.user_id and r.i = f.i + 1)
  select user_id, request_id, allowed from f)""")(lambda s, d: usage.cooldown(t.read_table(s, d, "events").select("user_id", F.col("event_id").alias("request_id"), "ts"), 3600))


def replayed(s, d):
    """The events as a stream of callbacks, three of them a document, and the table that it leaves."""
    e = s.readStream.schema(t.read_table(s, d, "events").schema).parquet(f"{d}/events.parque[t]")  # as a pattern it may be a file or a folder of files
    calls = e.select(F.floor(F.col("event_id") / 3).cast("long").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 17 != 0, F.col("event_type")).alias("status"))
    folder = f"{t.shared_folder(s)}/status-{uuid.uuid4().hex}"
    jobs.track_status(calls, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return jobs.latest_status(s, f"{folder}/table").select("doc_id", "status")


query('str2_stream_status', '', """select doc_id, arg_max(s, struct_pack(a := ts, b := s)) status from (select event_id // 3 doc_id, ts, case when event_id % 17 <> 0 then event_type else 'failed' end s from events) group by 1""")(replayed)

query('qry1_intent', 'questions_v', """select query_id, case when regexp_matches(query, '(?i)对比|比较|区别|差异|不同|\\bvs\\b|compare|difference') then 'compare' when regexp_matches(query, '(?i)总结|概括|概述|摘要|summar|overview') then 'summary' when regexp_matches(query, '(?i)如何|怎么|怎样|步骤|how to|how do|steps') then 'howto' else 'factoid' end intent from questions_v""")(lambda s, d: t.questions(s, d).select("query_id", tx.intent(F.col("query")).alias("intent")))

query('qry9_cache_key', 'questions_v', """select query_id, left(md5(trim(query, ' ')), 16) "key" from questions_v""")(lambda s, d: t.questions(s, d).select("query_id", tx.cache_key(F.col("query")).alias("key")))

query('cit2_bigram_jaccard', 'questions_v', """select query_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) j from (select query_id, list_distinct([x[i:i + 1] for i in range(1, length(x))]) a, list_distinct([y[i:i + 1] for i in range(1, length(y))]) b from (select query_id, regexp_replace(query, '\\s+', '', 'g') x, reverse(regexp_replace(query, '\\s+', '', 'g')) y from questions_v))""")(lambda s, d: t.questions(s, d).select("query_id", F.round(tx.bigram_jaccard(F.col("query"), F.reverse("query")), 6).alias("j")))

query('lif10_ingest_status', '', """select doc_id, case when event_id % 17 <> 0 then event_type else 'failed' end status from documents join events on event_id = doc_id""")(lambda s, d: usage.apply_ingest_status(t.read_table(s, d, "documents"), t.read_table(s, d, "events").select(F.col("event_id").alias("doc_id"), F.struct("ts", "event_id").alias("ts"), F.when(F.col("event_id") % 17 != 0, F.col("event_type")).alias("status"))))

query('blk6_file_type', 'chunks_v', """select doc_id, 'txt' file_type from chunks_v where chunk_index = 0""")(lambda s, d: t.chunks(s, d).filter("chunk_index = 0").select("doc_id", tx.file_type(F.col("source_file")).alias("file_type")))

query('src1_documents', '', """select doc_id, lang, source, n_chars from documents""")(lambda s, d: t.read_table(s, d, "documents").select("doc_id", "lang", "source", "n_chars"))
