"""Registered queries over markdown, sheets, chunks by size and title, lists of users, results of evaluations, and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions import questions as fq
from kbspark.operators import block_chunks as bc
from kbspark.operators import evaluation, intake, parsers, retrieval
from kbspark.plans.governance_queries import answers, blocks, ranked
from kbspark.plans.queries import KW, active, query
from kbspark.sources import tables as t
from kbspark.sources.fixtures import view

# Blocks and chunks


def markdown(s, d):
    """The lines of documents with marks by their place."""
    k, x = F.col("chunk_index") % 6, F.regexp_replace(F.trim("chunk_text"), r"[*_`|\[\]]", "")
    line = F.when(k == 0, F.concat(F.lit("# "), x)).when(k == 1, F.concat(F.lit("> **"), x, F.lit("**"))).when(k < 4, F.concat(F.lit("- "), x)).when(k == 4, F.concat(F.lit("p "), x, F.lit("\n"))).otherwise(F.concat(F.lit("```py\n"), x, F.lit("\n```")))
    c = t.chunks(s, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", line.alias("x")))).alias("l"))
    return c.select("doc_id", F.array_join(F.transform("l", lambda r: r.x), "\n").alias("text"))


query("blk2_markdown_blocks", "chunks_v", """with x as (select doc_id, chunk_index i, chunk_index % 6 k, regexp_replace(trim(chunk_text, ' '), '[*_`|\\[\\]]', '', 'g') x from chunks_v),
  b as (select doc_id, i, 0 j, case k when 0 then 'title' when 1 then 'reference' else 'text' end layout_type, case when k = 0 then 1 end "level", case when k = 2 then '• ' || x || coalesce(chr(10) || '• ' || y, '') when k = 4 then 'p ' || x when k = 5 then '[代码块: py]' else x end "text"
    from (select *, case when k = 2 then lead(x) over (partition by doc_id order by i) end y from x) where k <> 3 union all select doc_id, i, 1, 'reference', null, x from x where k = 5)
  select doc_id, (row_number() over (partition by doc_id order by i, j) - 1)::int block_idx, layout_type, "level"::int "level", "text", first_value("text") over (partition by doc_id order by i, j) title from b""".replace("with x as", "select * from (with x as") + ")")(
    lambda s, d: bc.markdown_blocks(markdown(s, d)).select("doc_id", "block_idx", "layout_type", "level", "text", "title")
)


def sheet_cells(s, d):
    """Lines as rows of two sheets, parted by bars into cells."""
    c = t.read_table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("row", "line"))
    return c.select("doc_id", (F.col("row") % 2).alias("sheet_no"), F.concat(F.lit("s"), F.col("row") % 2).alias("sheet"), "row", F.posexplode(F.split("line", r" \| ", -1)).alias("col", "value"))


query("blk4_sheet_blocks", "", """with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 r from documents),
  c as (select doc_id, r % 2 sheet_no, r, string_split(line, ' | ') c from l where trim(replace(line, ' | ', ''), ' ') <> ''),
  s as (select doc_id, sheet_no, max(len(c)) w from c group by all),
  t as (select doc_id, sheet_no, w, list(list_concat(c, [''for i in range(len(c), w)]) order by r) rows from c join s using (doc_id, sheet_no) group by all),
  b as (select doc_id, sheet_no, 0 p, 'title' layout_type, 'Sheet: s' || sheet_no || ' — ' || len(rows) || ' 行数据' "text", null html from t union all
    select doc_id, sheet_no, 1, 'text', 'Sheet ''s' || sheet_no || '''：' || (len(rows) - 1) || ' 行 × ' || w || ' 列，表头为 [' || array_to_string(rows[1][1:8], ', ') || ']，约 ' || greatest(1, length(array_to_string([array_to_string(x, ' ') for x in rows], chr(10))) // 2) || ' tokens',
    md5('<table>' || array_to_string(['<tr>' || array_to_string(['<' || (case when i = 1 then 'th' else 'td' end) || '>' || v || '</' || (case when i = 1 then 'th' else 'td' end) || '>' for v in rows[i]], '') || '</tr>' for i in range(1, len(rows) + 1)], '') || '</table>') from t)
  select doc_id, (row_number() over (partition by doc_id order by sheet_no, p) - 1)::int block_idx, layout_type, "text", html html_md5 from b""".replace("with l as", "select * from (with l as") + ")")(
    lambda s, d: bc.sheet_blocks(sheet_cells(s, d)).select("doc_id", "block_idx", "layout_type", "text", F.md5("html").alias("html_md5"))
)


def paragraphs(s, d):
    return blocks(s, d).withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n\n")))


query("chk6_token_chunks")(lambda s, d: bc.token_chunks(paragraphs(s, d)))
query("chk7_title_chunks")(lambda s, d: bc.title_chunks(paragraphs(s, d)))
query("chk13_chunk")(lambda s, d: bc.chunk(paragraphs(s, d), t.read_table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "token").when(F.col("doc_id") % 3 == 1, "title").alias("strategy"), F.lit("txt").alias("file_type"))))

# Sources and reports

query("src3_text_docs", "", "select 'd' || doc_id || '.txt' path, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) text_sha256 from documents")(
    lambda s, d: intake.text_blocks(t.read_table(s, d, "documents").select(F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))).select("path", F.sha2("text", 256).alias("text_sha256"))
)


def import_rows(s, d):
    k = F.col("c_custkey")
    name = F.when(k % 11 == 0, " ").when(k % 11 == 1, "ab").when(k % 11 == 2, F.repeat(F.lit("x"), 33)).when(k % 11 == 3, F.concat(F.lit("dup"), F.floor(k / 100))).otherwise(F.concat(F.lit(" "), "c_name"))
    rows = t.read_table(s, d, "customer").select((k + 1).alias("row_num"), name.alias("username"), F.when(k % 13 != 0, F.col("c_name")).alias("display_name"), F.when(k % 4 == 0, "ASIA| EUROPE |ASIA").when(k % 4 == 1, "NOPE|ASIA").alias("groups"), F.when(k % 5 == 0, "AFRICA").alias("group_name"))
    new, joined, errors = intake.import_users(rows, t.users(s, d).filter("user_id % 17 = 0"), t.groups(s, d))
    made = new.select("row_num", "username", F.lit("new").alias("outcome")).unionByName(errors.withColumnRenamed("reason", "outcome"))
    return made.unionByName(joined.join(new.select("row_num", "username"), "username").select("row_num", "username", F.concat(F.lit("in "), "group_id").alias("outcome")))


query("src4_import_users", "users_v", f"""with r as (select c_custkey k, trim(case c_custkey % 11 when 0 then ' ' when 1 then 'ab' when 2 then repeat('x', 33) when 3 then 'dup' || (c_custkey // 100) else c_name end, ' ') u, c_custkey % 13 = 0 nodisplay from customer),
  e as (select *, case when u = '' then '{intake.NO_NAME}' when length(u) not between 3 and 32 then '{intake.BAD_LENGTH}' when nodisplay then '{intake.NO_DISPLAY}' when u in (select username from users_v where user_id % 17 = 0) then '{intake.KNOWN}' end w from r),
  f as (select k, u, case when w is null and row_number() over (partition by u order by w is not null, k) > 1 then '{intake.KNOWN}' else w end w from e)
  select k + 1 row_num, u username, coalesce(w, 'new') outcome from f union all select k + 1, u, '{intake.NO_GROUP}NOPE' from f where w is null and k % 4 = 1
  union all select k + 1, u, 'in r2' from f where w is null and k % 4 < 2 union all select k + 1, u, 'in r3' from f where w is null and k % 4 = 0 union all select k + 1, u, 'in r0' from f where w is null and k % 5 = 0""".replace("with r as", "select * from (with r as") + ")")(import_rows)

RUN = ["id", "category", "faithfulness", "answer_relevance", "first_token_ms", "total_ms", "n_hits", "answer"]


def eval_files(s, d):
    """Questions of a run in batches of 50 ids as JSON."""
    g = view(s, d, "eval_a_v").groupBy(F.floor(F.col("id") / 50).alias("batch")).agg(F.collect_list(F.struct(*RUN)).alias("results"))
    return g.select(F.to_json(F.struct("batch", "results")).alias("value"))


query("src5_eval_results", "eval_a_v", f"select id // 50 batch, {', '.join(RUN)} from eval_a_v")(lambda s, d: intake.parse_eval_results(eval_files(s, d)))
DIMS = ["faithfulness", "answer_relevance", "first_token_ms", "total_ms"]
query("snk4_eval_report", "eval_a_v", " union all ".join(f"select '{c}' metric, count({c}) n, round(coalesce(avg({c}), 0), 4) aggregate, round(coalesce(min({c}), 0), 4) least, round(coalesce(max({c}), 0), 4) most from eval_a_v" for c in DIMS))(lambda s, d: intake.eval_report(view(s, d, "eval_a_v"), DIMS))
query("evl11_slow_and_empty", "eval_a_v", "select * from (select 'slowest' finding, id, total_ms::double \"value\" from eval_a_v where total_ms <> 0 order by total_ms desc, id limit 5) union all select case when n_hits = 0 then 'no_hits' else 'few_hits' end, id, n_hits::double from eval_a_v where n_hits < 3")(lambda s, d: intake.slow_and_empty(view(s, d, "eval_a_v")))

# Retrieval and answers

query("kw3_postings_positions", "chunks_v", "select chunk_id, term, count(*) tf, array_to_string(list(p order by p), ' ') positions from (select chunk_id, unnest(l) term, generate_subscripts(l, 1) - 1 p from (select chunk_id, regexp_extract_all(lower(chunk_text), '[\\x{4e00}-\\x{9fff}]|[\\p{L}\\p{N}]+') l from chunks_v where status = 'active')) group by 1, 2")(
    lambda s, d: retrieval.postings_with_positions(active(s, d)).withColumn("positions", F.array_join("positions", " "))
)
query("ctx1_context_scores", KW, "select query_id, string_agg('[' || rank || '] 来源: ' || source_file || ' (相关度: ' || score::decimal(18, 6)::decimal(18, 2)::varchar || ')' || chr(10) || chunk_text || chr(10), chr(10) || '---' || chr(10) order by rank) context from bm25_v join chunks_v using (chunk_id) group by 1")(lambda s, d: evaluation.scored_context(ranked(s, d)))
query("qry1_intent_route", "questions_v", "select query_id, intent, case intent when 'summary' then 15 when 'factoid' then 5 else 8 end top_k from (select query_id, case " + " ".join(f"when regexp_matches(query, '{p}') then '{n}'" for n, p, _ in fq.ROUTES) + " else 'factoid' end intent from questions_v)")(lambda s, d: t.questions(s, d).select("query_id", *fq.route(F.col("query"))))
query("qry9_cache_key_history", "questions_v", "select query_id, left(md5(trim(query, ' ')), 16) || case when query_id % 2 = 0 then ':' || left(md5(query_id::varchar), 8) else '' end \"key\" from questions_v")(
    lambda s, d: t.questions(s, d).select("query_id", fq.cache_key_with_history(F.col("query"), F.when(F.col("query_id") % 2 == 0, F.md5(F.col("query_id").cast("string")))).alias("key"))
)


def own_hits(s, d):
    """The sentences of an answer with a source's name, last ones first in their document."""
    x = answers(s, d).select("answer_id", F.posexplode(evaluation.sentences(F.col("answer"))).alias("rank", "x"))
    return x.select("answer_id", F.concat("answer_id", F.lit("-"), "rank").alias("chunk_id"), "rank", (100 - F.col("rank")).alias("doc_order"), F.concat("x", F.lit(" (source)")).alias("content"))


query("cit3_cite")(lambda s, d: intake.cite(answers(s, d), own_hits(s, d)))


def files(s, d):
    """Pages as html; documents as markdown, text and types that nobody registered, by their number."""
    kind = F.element_at(F.array(*map(F.lit, ("md", "txt", "TXT", "exe"))), (F.col("doc_id") % 4 + 1).cast("int"))
    pages = t.read_table(s, d, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.lit("html").alias("file_type"), F.col("html").alias("text"))
    return pages.unionByName(t.read_table(s, d, "documents").select("doc_id", kind.alias("file_type"), "text"))


query("blk8_parse_files")(lambda s, d: parsers.parse_blocks(files(s, d)).withColumn("text", F.sha2("text", 256)).drop("html"))
