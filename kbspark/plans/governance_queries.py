"""Registered queries over blocks, masking, metadata, citations, snapshots, and the later steps of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.functions import text as tx
from kbspark.operators import governance as g
from kbspark.operators import retrieval
from kbspark.plans.oracle_views import VIEWS
from kbspark.plans.queries import KW, active, found, hits, keyword_search, query, with_chunks
from kbspark.sources import tables as t
from kbspark.sources.fixtures import view

ORDER = "(partition by doc_id order by chunk_index)"

# Blocks and chunks

ROWS = "(select doc_id, [string_split(l, ' ') for l in string_split(text, chr(10))] r from documents where text is not null)"


def cells(s, d):
    return t.read_table(s, d, "documents").filter("text is not null").select("doc_id", F.transform(F.split("text", "\n", -1), lambda x: F.split(x, " ", -1)).alias("r"))


query("blk3_tables", "", f"select doc_id, greatest(len(r) - 1, 0) || ' x ' || len(r[1]) || ': ' || array_to_string(r[1][1:6], ', ') description, '<table>' || array_to_string(['<tr>' || array_to_string([case when i = 1 then '<th>' || c || '</th>' else '<td>' || c || '</td>' end for c in r[i]], '') || '</tr>' for i in range(1, len(r) + 1)], '') || '</table>' html from {ROWS}")(lambda s, d: cells(s, d).select("doc_id", g.table_description(F.col("r")).alias("description"), g.table_html(F.col("r")).alias("html")))

BLOCKS = "(select doc_id, chunk_index block_idx, chunk_text \"text\", case when contains(chunk_text, ' | ') then 'table' else 'text' end kind, case when length(chunk_text) < 60 then 'title' else 'text' end layout_type, 1 + length(chunk_text) % 6 \"level\" from chunks_v)"


def blocks(s, d):
    c, n = t.chunks(s, d), F.length("chunk_text")
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("block_idx"), F.col("chunk_text").alias("text"), F.when(F.contains("chunk_text", F.lit(" | ")), "table").otherwise("text").alias("kind"), F.when(n < 60, "title").otherwise("text").alias("layout_type"), (1 + n % 6).alias("level"))


query("blk5_plain_text", "chunks_v", f"select doc_id, sha256(string_agg(text, chr(10) || chr(10) order by block_idx)) text_sha256 from {BLOCKS} where text <> '' group by 1")(lambda s, d: g.plain_text(blocks(s, d)).select("doc_id", F.sha2("text", 256).alias("text_sha256")))

query("blk7_block_stats", "chunks_v", f"select doc_id, count(*) n_blocks, count(*) filter (kind = 'text') n_text, count(*) filter (kind = 'table') n_tables, count(*) filter (kind = 'text' and layout_type = 'title') n_titles from {BLOCKS} group by 1")(lambda s, d: g.block_stats(blocks(s, d)))

query("chk8_section_tree", "chunks_v", f"with x as (select * from {BLOCKS} where layout_type = 'title') select doc_id, block_idx, (select max(b.block_idx) from x b where b.doc_id = a.doc_id and b.block_idx < a.block_idx and b.\"level\" < a.\"level\") parent_idx from x a".replace("with x as", "select * from (with x as") + ")")(lambda s, d: g.section_tree(blocks(s, d).filter("layout_type = 'title'")))

MEDIA = "(select *, case when length(chunk_text) % 7 = 0 then 'table' when length(chunk_text) % 7 = 1 then 'image' else 'text' end kind, chunk_text as content from chunks_v)"


def media(s, d):
    n = F.length("chunk_text") % 7
    return t.chunks(s, d).select("doc_id", "chunk_id", "chunk_index", F.when(n == 0, "table").when(n == 1, "image").otherwise("text").alias("kind"), F.col("chunk_text").alias("content"))


_SNIP = "case when kind = 'text' then case when length(content) > 200 then left(content, 200) || '...' else content end end"
_SIDE = "case when {a} is not null and greatest(1, length({a}) // 2) <= 300 then case when {b} is not null and n = 2 and greatest(1, length({a}) // 2) + greatest(1, length({b}) // 2) <= 300 then {ab} else {a} end when {a} is null and n = 2 then {b} end"
query("chk12_enrich_media", "chunks_v", f"""select chunk_id, concat_ws(chr(10) || chr(10), '[上文上下文]' || chr(10) || {_SIDE.format(a='p1', b='p2', ab="p2 || chr(10) || p1")}, content, '[下文上下文]' || chr(10) || {_SIDE.format(a='n1', b='n2', ab="n1 || chr(10) || n2")}) as content
  from (select chunk_id, content, case kind when 'table' then 2 when 'image' then 1 else 0 end n, case when kind <> 'text' then lag(s, 1) over {ORDER} end p1, case when kind <> 'text' then lag(s, 2) over {ORDER} end p2, case when kind <> 'text' then lead(s, 1) over {ORDER} end n1, case when kind <> 'text' then lead(s, 2) over {ORDER} end n2
    from (select *, {_SNIP} s from {MEDIA}))""")(lambda s, d: g.enrich_media(media(s, d)))

query("chk14_index_rows", "chunks_v", """select doc_id, chunk_id, row_number() over (partition by doc_id order by chunk_index) - 1 row_no, '{' || concat_ws(',', '"source":"' || source || '"', '"lang":"' || lang || '"', case when doc_id % 3 = 0 then '"version":' || (doc_id % 4) end) || '}' metadata from chunks_v join documents using (doc_id)""")(
    lambda s, d: g.index_rows(t.chunks(s, d), t.read_table(s, d, "documents").select("doc_id", "source", "lang", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 4).alias("version")))
)

# Masking and metadata

query("gov2_mask_blocks")(lambda s, d: g.mask_blocks(t.chunks(s, d)).select("chunk_id", "sensitive", F.sha2("chunk_text", 256).alias("masked_sha256")))
query("gov3_mask_report")(lambda s, d: g.mask_report(t.read_table(s, d, "documents")))

TYPED = "(select *, case when length(chunk_text) < 60 then 'title' else 'text' end chunk_type from chunks_v)"


def typed(s, d):
    return t.chunks(s, d).withColumn("chunk_type", F.when(F.length("chunk_text") < 60, "title").otherwise("text"))


query("gov4_heading_rules", "chunks_v", f"select chunk_id, case when chunk_type = 'title' then trim(left(chunk_text, 80), ' ') end heading, case when chunk_type = 'title' then greatest(length(regexp_extract(trim(chunk_text, ' '), '^#{{1,6}}')), 1)::bigint end \"level\" from {TYPED}")(lambda s, d: g.heading_rules(typed(s, d)))

query("gov5_title_context", "chunks_v", f"select chunk_id, left(coalesce(concat_ws(chr(10), b, a), ''), 300) context from (select *, lag(x, 1) over {ORDER} a, lag(x, 2) over {ORDER} b from (select *, case when chunk_type <> 'title' then chunk_text end x from {TYPED})) where chunk_type = 'title'")(lambda s, d: g.title_context(typed(s, d)))

query("gov6_doc_sample", "chunks_v", f"select doc_id, chunk_id, left(chunk_text, 300) sample from (select *, row_number() over {ORDER} n, coalesce(sum(length(chunk_text)) over (partition by doc_id order by chunk_index rows between unbounded preceding and 1 preceding), 0) b from chunks_v) where n <= 30 and b <= 5000")(lambda s, d: g.doc_sample(t.chunks(s, d)))

query("gov7_spread_doc_metadata", "chunks_v", "select chunk_id, lang doc_lang, n_chars doc_chars from chunks_v join documents using (doc_id)")(lambda s, d: t.chunks(s, d).select("doc_id", "chunk_id").join(t.read_table(s, d, "documents").select("doc_id", F.col("lang").alias("doc_lang"), F.col("n_chars").alias("doc_chars")), "doc_id").drop("doc_id"))

RAW = "(select event_id id, case event_id % 5 when 0 then '```json' || chr(10) || '{\"faithfulness\": 0.5, \"answer_relevance\": 1.5}' || chr(10) || '```' when 1 then 'Scores: {\"faithfulness\": 0.25, \"context_relevance\": -1, \"answer_correctness\": 0.75} as asked' when 2 then 'broken {' when 3 then '' else '{\"faithfulness\": ' || (event_id % 100) / 100.0::double || '}' end raw from events)"


def raw(s, d):
    e = F.col("event_id")
    text = F.when(e % 5 == 0, '```json\n{"faithfulness": 0.5, "answer_relevance": 1.5}\n```').when(e % 5 == 1, 'Scores: {"faithfulness": 0.25, "context_relevance": -1, "answer_correctness": 0.75} as asked').when(e % 5 == 2, "broken {").when(e % 5 == 3, "")
    return t.read_table(s, d, "events").select(e.alias("id"), text.otherwise(F.concat(F.lit('{"faithfulness": '), (e % 100 / 100.0).cast("string"), F.lit("}"))).alias("raw"))


JUDGED = "(select id, case when id % 5 in (0, 1) then regexp_extract(raw, '(\\{.*\\})', 1, 's') when id % 5 = 4 then raw else '{}' end j from " + RAW + ")"
query("gov8_parse_model_json", "", f"select id, (j->>'$.faithfulness')::double faithfulness, (j->>'$.answer_relevance')::double answer_relevance from {JUDGED}")(lambda s, d: raw(s, d).withColumn("x", g.parse_model_json(F.col("raw"), "faithfulness double, answer_relevance double")).select("id", "x.*"))
query("evl4_parse_judge", "", "select id, " + ", ".join(f"coalesce(least(greatest((j->>'$.{c}')::double, 0), 1), 0)::double {c}" for c in ("faithfulness", "answer_relevance", "context_relevance")) + f", case when j->>'$.answer_correctness' is not null then least(greatest((j->>'$.answer_correctness')::double, 0), 1) end::double answer_correctness from {JUDGED}")(lambda s, d: raw(s, d).select("id", *g.parse_judge(F.col("raw"))))

query("gov11_sibling_kbs", "kbs_v", "select a.kb_id, b.kb_id sibling from kbs_v a join kbs_v b using (space_id) where b.deleted_at is null and a.kb_id <> b.kb_id")(lambda s, d: g.sibling_kbs(view(s, d, "kbs_v")))

TOPICS = "(select source kb_id, unnest(string_split(text, ' ')) topic from documents where text is not null and source is not null)"
SUMMARY = f"(select kb_id, count(*) n_topics, string_agg(topic, '、' order by r) filter (r <= 6) summary from (select *, row_number() over (partition by kb_id order by n desc, topic) r from (select kb_id, topic, count(*) n from {TOPICS} where topic <> '' group by 1, 2)) group by 1)"


def topics(s, d):
    return t.read_table(s, d, "documents").filter("text is not null and source is not null").select(F.col("source").alias("kb_id"), F.explode(F.split("text", " ", -1)).alias("topic")).filter("topic <> ''")


query("gov12_kb_topics", "", f"select * from {SUMMARY}")(lambda s, d: g.kb_topics(topics(s, d)))
query("gov13_kb_catalog", "kbs_v", f"select kb_id, kb_name, coalesce(summary, '') summary, coalesce(doc_count, 0) doc_count from kbs_v left join {SUMMARY} using (kb_id) left join (select source kb_id, count(*) doc_count from documents group by 1) using (kb_id) where visibility = 'space_wide'")(
    lambda s, d: g.kb_catalog(view(s, d, "kbs_v"), view(s, d, "kbs_v").filter("visibility = 'space_wide'").select("kb_id"), g.kb_topics(topics(s, d)), t.read_table(s, d, "documents").select(F.col("source").alias("kb_id")))
)
query("gov14_kb_docs", "chunks_v", """select kb_id, source_file, regexp_extract(source_file, '([^/]+)$', 1) title, left(chunk_text, 200) summary, case when coalesce(expiry_date < date '2024-09-01', false) then 'expired' else 'active' end status
  from (select *, row_number() over (partition by kb_id order by source_file) r from chunks_v where chunk_index = 0) where r <= 50""")(lambda s, d: g.kb_docs(t.chunks(s, d), "2024-09-01"))

POINTS = lambda ws: f"2 * len([w for w in {ws!r} if contains(left(lower(chunk_text), 500), w) or contains(lower(source_file), w)])"
query("aud6_classify_docs", "chunks_v", f"select doc_id, r::bigint \"real\", f::bigint fake, case when f >= 2 and r = 0 then 'fake: test data' when f >= 4 then 'fake: strong' when r >= 4 and f = 0 then 'real' when r >= 2 and r > f then 'likely real' when f > 0 then 'likely fake' else 'uncertain' end kind from (select doc_id, {POINTS(g.REAL)} r, {POINTS(g.FAKE)} f from chunks_v where chunk_index = 0)")(lambda s, d: g.classify_docs(t.chunks(s, d)))

# Citations, context, traces

PAGED = "(select *, case when length(chunk_text) % 9 <> 0 then chunk_index // 3 end page_start, case when length(chunk_text) % 9 <> 0 then chunk_index // 3 + length(chunk_text) % 2 end page_end from chunks_v)"
query("cit4_doc_order", "chunks_v", f"select chunk_id, row_number() over (partition by doc_id order by page_start is null, coalesce(page_start, 0), coalesce(page_end, 0), chunk_index) - 1 place from {PAGED}")(
    lambda s, d: g.doc_order(t.chunks(s, d).withColumn("page_start", F.when(F.length("chunk_text") % 9 != 0, F.floor(F.col("chunk_index") / 3))).withColumn("page_end", F.col("page_start") + F.length("chunk_text") % 2))
)
query("cit5_render_citations", "chunks_v", "select doc_id answer_id, sha256(string_agg(chunk_text || case when chunk_index % 3 = 0 then ' [' || (chunk_index // 3 + 1) || ']' else '' end, '' order by chunk_index)) answer_sha256 from chunks_v group by 1")(
    lambda s, d: g.render_citations(t.chunks(s, d).select(F.col("doc_id").alias("answer_id"), F.col("chunk_index").alias("pos"), F.col("chunk_text").alias("sentence"), F.when(F.col("chunk_index") % 3 == 0, F.floor(F.col("chunk_index") / 3) + 1).alias("cite"))).select("answer_id", F.sha2("answer", 256).alias("answer_sha256"))
)
ANSWERS = "(select conv_id * 1000 + turn answer_id, turn % 3 n_sources, text || case when turn % 2 = 0 then ' [Ref 1]。' else '。next' end answer from conversations where role = 'assistant' and text is not null)"


def answers(s, d):
    c = t.read_table(s, d, "conversations").filter("role = 'assistant' and text is not null")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), (F.col("turn") % 3).alias("n_sources"), F.concat("text", F.when(F.col("turn") % 2 == 0, " [Ref 1]。").otherwise("。next")).alias("answer"))


query("cit6_grounded", "", f"select answer_id, n_sources = 0 or regexp_matches(answer, '\\[Ref\\s*[0-9]+\\]|\\[来源:') grounded from {ANSWERS}")(lambda s, d: answers(s, d).select("answer_id", g.grounded(F.col("answer"), F.col("n_sources")).alias("grounded")))
query("cit7_citation_stats", "", f"select answer_id, len([x for x in string_split(answer, '。') if trim(x, ' ') <> ''])::bigint n_sentences, (answer_id % 2)::bigint n_cited, (answer_id % 2 * 2)::bigint n_chunks from {ANSWERS}")(
    lambda s, d: g.citation_stats(answers(s, d), answers(s, d).filter("answer_id % 2 = 1").select("answer_id", F.lit(0).alias("pos"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("a"))).alias("chunk_id")))
)
query("ctx3_context_tokens", KW + "hits_v", "select query_id, greatest(1, (sum(length(chunk_text)) + count(*) - 1) // 2)::bigint tokens from hits_v group by 1")(lambda s, d: g.context_tokens(hits(s, d)))
query("evl1_build_traces", KW + "hits_v", "select query_id, coalesce(n, 0) n_hits, coalesce(x, '') snapshot from questions_v left join (select query_id, count(*) n, string_agg(rank || '|' || chunk_id || '|' || printf('%.4f', round(score, 4)) || '|' || left(chunk_text, 150), chr(10) order by rank) filter (rank <= 10) x from hits_v group by 1) using (query_id)")(lambda s, d: g.build_traces(t.questions(s, d).select("query_id"), ranked(s, d)))
query("evl5_judge_input", KW + "hits_v", "select query_id, string_agg(left(chunk_text, 300), chr(10) || chr(10) order by rank) context from hits_v where rank <= 5 group by 1")(lambda s, d: g.judge_input(ranked(s, d)))
query("cnv4_assemble_messages", "", """select conv_id, row_number() over (partition by conv_id order by p, turn) place, role, turn, (sum(greatest(1, length(text) // 2)) over (partition by conv_id))::bigint total_tokens
  from (select *, 0 p from conversations where role = 'system' union all select * exclude (n), 1 from (select *, row_number() over (partition by conv_id order by turn desc) n from conversations where role <> 'system') where n <= 6)""")(lambda s, d: g.assemble_messages(t.read_table(s, d, "conversations")))
query("cnv5_list_conversations", "", "select c_custkey user_id, conv_id, row_number() over (partition by c_custkey order by last desc, conv_id desc) place from (select conv_id, conv_id % 50 + 1 c_custkey, max(turn) last from conversations group by 1) join customer using (c_custkey)")(lambda s, d: conversations_of(s, d))


def conversations_of(s, d):
    c = t.read_table(s, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last")).withColumn("user_id", F.col("conv_id") % 50 + 1)
    c = c.join(t.users(s, d).select("user_id"), "user_id")
    return c.select("user_id", "conv_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("last").desc(), F.col("conv_id").desc())).cast("long").alias("place"))


def ranked(s, d):
    return with_chunks(found(s, d), active(s, d))


# Later steps of retrieval

RRF = "select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 9) score, count(*) n_lists from {} group by 1, 2"
PLACE = "row_number() over (partition by query_id order by score desc, chunk_id)"
query("fus1_rrf", KW + "vectors_v qvec_v dense_v lists_v", f"select * from (select *, {PLACE}::int rank from ({RRF.format('lists_v')})) where rank <= 10")(lambda s, d: retrieval.rrf(both(s, d), final=10))
VIEWS["wide_v"] = VIEWS["dense_v"].replace("dense_v as", "dense_wide_v as").replace("rank <= 30)", "rank <= 42)") + ",\n  bm25_wide_v as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int rank from scored_v))"
query("fus2_hybrid_top_k", KW + "vectors_v qvec_v wide_v", f"select x.* from (select *, {PLACE}::int rank from ({RRF.format('(select query_id, chunk_id, rank from dense_wide_v join questions_v using (query_id) where rank <= 3 * top_k union all select query_id, chunk_id, rank from bm25_wide_v join questions_v using (query_id) where rank <= 3 * top_k)')})) x join questions_v using (query_id) where x.rank <= 2 * top_k")(lambda s, d: retrieval.hybrid_search(t.questions(s, d), t.question_vectors(s, d), t.chunk_vectors(s, d), keyword_search(s, d)))


def both(s, d):
    return [retrieval.dense_search(t.question_vectors(s, d), t.chunk_vectors(s, d)), found(s, d)]


def listed(s, d):
    a, b = both(s, d)
    return a.select("query_id", "chunk_id", "rank", F.lit(0).alias("list")).unionByName(b.select("query_id", "chunk_id", "rank", F.lit(1).alias("list")))


MERGED = "(select *, row_number() over (partition by query_id order by list, rank) place from (select *, row_number() over (partition by query_id, chunk_id order by list, rank) n from lists_v) where n = 1)"
LISTS = KW + "vectors_v qvec_v dense_v lists_v"
query("dup1_merge_dedup", LISTS, f"select query_id, chunk_id, list, place from {MERGED}")(lambda s, d: retrieval.merge_lists(listed(s, d)).select("query_id", "chunk_id", "list", F.col("place").cast("long").alias("place")))
query("fus3_multi_query", LISTS, f"select query_id, list, count(*) n, string_agg(chunk_id, ',' order by rank) chunk_ids from {MERGED} group by 1, 2")(lambda s, d: retrieval.groups_of(retrieval.merge_lists(listed(s, d))))
query("fus4_cap_total", LISTS, f"select query_id, chunk_id, place from {MERGED} where place <= 30")(lambda s, d: retrieval.cap_total(retrieval.merge_lists(listed(s, d))).select("query_id", "chunk_id", F.col("place").cast("long").alias("place")))

ONE = f"(select * exclude (n) from (select *, row_number() over (partition by query_id, trim(left(chunk_text, 300), ' ') order by score desc, chunk_id) n from hits_v) where n = 1)"
CAPPED = f"(select * exclude (n) from (select *, row_number() over (partition by query_id, doc_id order by score desc, chunk_id) n from {ONE}) where n <= 3)"
RUNS = f"(select query_id, first(chunk_id order by chunk_index) chunk_id, round(avg(score), 9) score from (select *, chunk_index - row_number() over (partition by query_id, doc_id order by chunk_index) run from {CAPPED}) group by query_id, doc_id, run)"
ENOUGH = f"(select query_id from {RUNS} join questions_v using (query_id) group by query_id, top_k having count(*) >= 2 * top_k)"
query("dup5_dedup_pipeline", KW + "hits_v", f"select query_id, chunk_id, score from {RUNS} where query_id in {ENOUGH} union all select query_id, chunk_id, score from {ONE} where query_id not in {ENOUGH}")(lambda s, d: retrieval.dedup_pipeline(hits(s, d), t.questions(s, d)))

PARENT = "case when chunk_index % 5 <> 4 then chunk_index // 5 end"
query("par1_resolve_parents", KW + "hits_v", f"select query_id, chunk_id, coalesce(pt, chunk_text) as content from (select *, row_number() over (partition by query_id, doc_id, {PARENT} order by score desc, chunk_id) n, {PARENT} parent_id from hits_v) left join (select doc_id, chunk_index // 5 parent_id, string_agg(chunk_text, chr(10) order by chunk_index) pt from chunks_v where chunk_index % 5 <> 4 group by 1, 2) using (doc_id, parent_id) where n = 1 or parent_id is null")(lambda s, d: parents_of(s, d))


def parents_of(s, d):
    parent = F.when(F.col("chunk_index") % 5 != 4, F.floor(F.col("chunk_index") / 5)).alias("parent_id")
    p = t.chunks(s, d).select("doc_id", parent, "chunk_index", "chunk_text").filter("parent_id is not null").groupBy("doc_id", "parent_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("x"))
    p = p.select("doc_id", "parent_id", F.array_join(F.transform("x", lambda c: c.chunk_text), "\n").alias("parent_text"))
    return retrieval.resolve_parents(hits(s, d).select("*", parent), p)


LLM = "case when length(chunk_text) % 3 <> 0 then length(chunk_text) % 101 end"
query("rrk2_rerank_llm", KW + "hits_v", f"select query_id, chunk_id, score, {PLACE}::int rank from (select query_id, chunk_id, coalesce({LLM}, 50) / 100.0::double score from hits_v) qualify rank <= 5")(lambda s, d: retrieval.top(hits(s, d).select("query_id", "chunk_id", (F.coalesce(F.when(F.length("chunk_text") % 3 != 0, F.length("chunk_text") % 101), F.lit(50)) / 100.0).alias("score")), 5))
query("rrk3_rerank_chain", KW + "hits_v", f"""select query_id, chunk_id, strategy, score, {PLACE}::int rank from (select query_id, chunk_id, case query_id % 3 when 0 then 'api' when 1 then 'llm' else 'truncation' end strategy, case query_id % 3 when 0 then length(chunk_text) % 11 / 10.0::double when 1 then length(chunk_text) % 7 / 10.0::double else score end score from hits_v) qualify rank <= 5""")(lambda s, d: chained(s, d))


def chained(s, d):
    h = hits(s, d)
    n, x = F.length("chunk_text"), F.col("query_id")
    row = lambda name, size, some: h.filter(some).select("query_id", "chunk_id", F.lit(name).alias("source"), (n % size / 10.0).alias("score"))
    # The api knows a third of the queries whole and some hits of the others; the llm knows two thirds whole.
    scores = row("api", 11, (x % 3 == 0) | (F.col("chunk_id") < "0")).unionByName(row("llm", 7, x % 3 < 2))
    return retrieval.rerank_chain(h, scores, 5)


KNOWN = "(select query_id, coalesce(max(score) > 14, false) known from questions_v left join bm25_v using (query_id) group by 1)"
query("qlt3_critic_action", KW, f"select query_id, case when m is null and not known then 'not_in_kb' when m is null then 'ask_user' when m >= 13 then 'pass' when not known then 'not_in_kb' else 'ask_user' end \"action\" from questions_v join {KNOWN} using (query_id) left join (select query_id, avg(score) m from bm25_v where rank <= 3 group by 1) using (query_id)")(
    lambda s, d: (lambda h: retrieval.critic_action(t.questions(s, d), h, h.groupBy("query_id").agg((F.max("score") > 14).alias("known")), 13.0))(found(s, d))
)

# Snapshots

query("snk1_write_chunks", "chunks_v", "select doc_id, count(*) inserted from chunks_v where doc_id % 3 <> 0 or chunk_index % 2 = 1 group by 1")(lambda s, d: g.new_rows(t.chunks(s, d), t.chunks(s, d).filter("doc_id % 3 = 0 and chunk_index % 2 = 0")).groupBy("doc_id").agg(F.count("*").alias("inserted")))
query("snk2_set_status", "chunks_v", "select chunk_id, case when doc_id % 4 = 0 then 'archived' else status end status from chunks_v")(lambda s, d: g.set_status(t.chunks(s, d), t.read_table(s, d, "documents").filter("doc_id % 4 = 0").select("doc_id", F.lit("archived").alias("new_status"))).select("chunk_id", "status"))
query("snk3_delete_chunks", "chunks_v", "select d.doc_id, count(chunk_id) n from (select doc_id from documents where doc_id % 4 = 0 union select -5) d left join chunks_v c on c.doc_id = d.doc_id group by 1")(lambda s, d: g.delete_chunks(t.chunks(s, d), t.read_table(s, d, "documents").filter("doc_id % 4 = 0").select("doc_id").union(s.range(-5, -4)))[1])
