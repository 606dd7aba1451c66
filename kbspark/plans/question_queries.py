"""Registered queries over questions: classification, keywords, filters and scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions import questions as fq
from kbspark.functions import text as tx
from kbspark.operators import retrieval
from kbspark.plans.queries import KW, active, found, hits, query
from kbspark.sources import tables as t
from kbspark.sources.fixtures import view

QUOTED = fq.BETWEEN_WORDS.replace("'", "''")


def asked(s, d):
    return view(s, d, "asked_v")


def has(text: str, words: list[str]) -> str:
    return f"len([w for w in {words!r} if contains({text}, w)]) > 0"


query("qry2_split_compare", "asked_v", f"select query_id, case when len(p) >= 2 then array_to_string(p, '|') else '' end parts from (select query_id, [trim(x, ' ') for x in string_split_regex(query, '{fq.COMPARED}') if trim(x, ' ') <> ''] p from asked_v)")(lambda s, d: asked(s, d).select("query_id", F.array_join(fq.split_compare(F.col("query")), "|").alias("parts")))

query("qry3_chitchat", "asked_v", f"select query_id, length(q) <= 15 and c > 0 and not {has('q', fq.INTENT_WORDS)} and not (length(q) > 6 and c < length(q) * 0.4) chitchat from (select query_id, lower(trim(query, ' ')) q, coalesce(list_sum([length(w) for w in {fq.CHITCHAT!r} if contains(lower(query), w)]), 0) c from asked_v)")(lambda s, d: asked(s, d).select("query_id", fq.is_chitchat(F.col("query")).alias("chitchat")))

query("qry4_should_plan", "asked_v", f"""select query_id, r reason, r in ('complex_marker', 'default') plan from (select query_id, case when q = '' then 'empty_query' when length(q) <= 15 and not m then 'short_query_no_marker' when m then 'complex_marker'
  when not {has('q', fq.QUESTION_WORDS)} and not {has('q', fq.ACTIONS)} and length(q) <= 30 then 'noun_phrase' else 'default' end r from (select query_id, trim(query, ' ') q, {has('query', fq.COMPLEX)} m from asked_v))""")(lambda s, d: asked(s, d).select("query_id", fq.plan_reason(F.col("query")).alias("reason"), fq.should_plan(F.col("query")).alias("plan")))

query("kw6_extract_keywords", "asked_v " + "keywords_v", "select query_id, array_to_string(ks, '|') keywords from keywords_v")(lambda s, d: asked(s, d).select("query_id", F.array_join(fq.extract_keywords(F.col("query")), "|").alias("keywords")))

query("qry5_use_hyde", "asked_v keywords_v", f"select query_id, {has('query', fq.LISTING)} or ({has('query', fq.ABSTRACT)} and (len(ks) < 3 or len([k for k in ks if length(k) > 2]) = 0)) hyde from asked_v join keywords_v using (query_id)")(lambda s, d: asked(s, d).select("query_id", fq.use_hyde(F.col("query"), fq.extract_keywords(F.col("query"))).alias("hyde")))

query("qry6_should_rewrite", "asked_v", "select query_id, history_len > 0 and not (length(query) > 50 and (regexp_matches(query, '" + fq.NAMED[0] + "') or regexp_matches(query, '" + fq.NAMED[1].replace("'", "''") + "') or length(query) > 80)) and not coalesce(since_last < 60, false) rewrite from asked_v")(lambda s, d: asked(s, d).select("query_id", fq.should_rewrite(F.col("query"), F.col("history_len"), F.col("since_last")).alias("rewrite")))

query("qry7_validate_rewrite", "asked_v", f"select query_id, case when length(trim(rewritten, ' ')) < 2 or (length(rewritten) > length(query) * 1.5 and length(rewritten) - length(query) > 20) or ({has('query', fq.MARKERS)} and not {has('rewritten', fq.MARKERS)} and not {has('rewritten', fq.EXPLAINS)}) then query else rewritten end resolved from asked_v")(lambda s, d: asked(s, d).select("query_id", fq.validate_rewrite(F.col("query"), F.col("rewritten")).alias("resolved")))

query("qry8_is_cacheable", "asked_v", f"select query_id, query_id % 4 <> 0 and not {has('query', fq.TEMPORAL)} and not {has('query', fq.PERSONAL)} cacheable from asked_v")(lambda s, d: asked(s, d).select("query_id", fq.is_cacheable(F.col("query"), F.col("query_id") % 4 == 0).alias("cacheable")))

query("qry11_fill_template", "asked_v", "select query_id, case when x <> '' then x else query || ' ' || rewritten end filled from (select query_id, query, rewritten, trim(regexp_replace(replace(replace(case when query_id % 3 = 0 then '{{extracted.none}}' else 'about {{extracted.a}} or {{extracted.b}} {{extracted.none}}' end, '{{extracted.a}}', query), '{{extracted.b}}', rewritten), '\\{\\{extracted\\.\\w+\\}\\}', '', 'g'), ' ') x from asked_v)")(
    lambda s, d: asked(s, d).select("query_id", fq.fill_template(F.when(F.col("query_id") % 3 == 0, "{{extracted.none}}").otherwise("about {{extracted.a}} or {{extracted.b}} {{extracted.none}}"), F.create_map(F.lit("a"), F.col("query"), F.lit("b"), F.col("rewritten"))).alias("filled"))
)

query("kw1_tokens", "chunks_v", "select chunk_id, array_to_string(regexp_extract_all(lower(chunk_text), '[\\x{4e00}-\\x{9fff}]|[\\p{L}\\p{N}]+'), ' ') tokens from chunks_v")(lambda s, d: t.chunks(s, d).select("chunk_id", F.array_join(tx.terms(F.col("chunk_text")), " ").alias("tokens")))

query("kw2_space_cjk", "asked_v", "select query_id, regexp_replace(query, '([\\x{4e00}-\\x{9fff}])', ' \\1 ', 'g') spaced from asked_v")(lambda s, d: asked(s, d).select("query_id", tx.space_cjk(F.col("query")).alias("spaced")))

ASPECT_SQL = "case a " + " ".join(f"when '{k}' then {v!r}" for k, v in fq.ASPECTS.items()) + " else [] end"
query("kw7_expand_aspects", "asked_v", f"select query_id, coalesce(array_to_string(flatten([{ASPECT_SQL} for a in x]), ' '), '') terms from (select query_id, case query_id % 3 when 0 then ['security', 'api_reference'] when 1 then ['nothing', 'installation'] else []::varchar[] end x from asked_v)")(
    lambda s, d: asked(s, d).select("query_id", F.array_join(fq.expand_aspects(F.when(F.col("query_id") % 3 == 0, fq.words(["security", "api_reference"])).when(F.col("query_id") % 3 == 1, fq.words(["nothing", "installation"])).otherwise(F.array().cast("array<string>"))), " ").alias("terms"))
)

query("kw8_knowledge_exists", KW, "select query_id, coalesce(max(score) > 0.1, false) known from questions_v left join (select * from bm25_v where rank <= 10) using (query_id) group by 1")(
    lambda s, d: t.questions(s, d).select("query_id").join(found(s, d, 10), "query_id", "left").groupBy("query_id").agg(F.coalesce(F.max("score") > 0.1, F.lit(False)).alias("known"))
)

query("qry12_evidence_check", KW + "hits_v", "select distinct query_id, k from (select query_id, unnest(['first', 'none']) k, unnest([string_split(query, ' ')[1], 'no such evidence']) v from questions_v) e where v <> '' and exists (select 1 from hits_v h where h.query_id = e.query_id and (contains(chunk_text, v) or contains(v, chunk_text)))")(
    lambda s, d: evidence(t.questions(s, d).select("query_id", F.explode(F.create_map(F.lit("first"), F.split("query", " ")[0], F.lit("none"), F.lit("no such evidence"))).alias("k", "v")), hits(s, d))
)

query("vec4_temporal_meta", "chunks_v", """select chunk_id, effective_date, expiry_date, "version", coalesce(expiry_date < date '2024-09-01', false) is_expired from chunks_v""", dates=("effective_date", "expiry_date"))(lambda s, d: retrieval.temporal(t.chunks(s, d), "2024-09-01", "include").select("chunk_id", "effective_date", "expiry_date", "version", "is_expired"))

query("flt2_clamp_top_k", "asked_v", "select query_id, least(greatest(query_id % 50 - 5, 1), 30)::int top_k from asked_v")(lambda s, d: asked(s, d).select("query_id", retrieval.clamp(F.col("query_id") % 50 - 5).alias("top_k")))

DOCS = "(select doc_id, source || '/' || doc_id || case doc_id % 4 when 0 then '.md' when 1 then '.docx' else '.txt' end filename, case doc_id % 5 when 0 then 'policy_hr' when 1 then 'report' end doc_type from documents)"


def typed(s, d):
    c = t.read_table(s, d, "documents")
    end = F.when(F.col("doc_id") % 4 == 0, ".md").when(F.col("doc_id") % 4 == 1, ".docx").otherwise(".txt")
    return c.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), end).alias("filename"), F.when(F.col("doc_id") % 5 == 0, "policy_hr").when(F.col("doc_id") % 5 == 1, "report").alias("doc_type"))


query("flt3_doc_type", "", f"select 'policy' wanted, doc_id from {DOCS} where coalesce(doc_type like 'policy%', false) or filename like '%.md' union all select 'report', doc_id from {DOCS} where coalesce(doc_type like 'report%', false) or filename like '%.docx' union all select 'other', doc_id from {DOCS} where filename is not null union all select 'any', doc_id from {DOCS}")(
    lambda s, d: union([retrieval.doc_type(typed(s, d), w).select(F.lit(w).alias("wanted"), "doc_id") for w in ("policy", "report", "other", "any")])
)

ARRAYS = "(select c_custkey user_id, case when c_custkey % 11 = 0 then []::varchar[] else ['s' || (c_custkey % 5), 's' || ((c_custkey + 1) % 5)] end granted, case when c_custkey % 3 = 0 then []::varchar[] else ['s' || (c_custkey % 4)] end requested, case when c_custkey % 7 = 0 then []::varchar[] else ['s' || (c_custkey % 3), 's' || ((c_custkey + 1) % 5)] end key_scope from customer)"


def scopes(s, d):
    c, k, none = t.read_table(s, d, "customer"), F.col("c_custkey"), F.array().cast("array<string>")
    kb = lambda x, n: F.concat(F.lit("s"), (x % n).cast("string"))
    return c.select(k.alias("user_id"), F.when(k % 11 == 0, none).otherwise(F.array(kb(k, 5), kb(k + 1, 5))).alias("granted"), F.when(k % 3 == 0, none).otherwise(F.array(kb(k, 4))).alias("requested"), F.when(k % 7 == 0, none).otherwise(F.array(kb(k, 3), kb(k + 1, 5))).alias("key_scope"))


query("flt5_scope_kbs", "", f"select user_id, array_to_string(list_sort(case when len(key_scope) > 0 then list_intersect(a, key_scope) else a end), ',') kbs from (select *, case when len(requested) > 0 then list_intersect(granted, requested) else granted end a from {ARRAYS})")(lambda s, d: scopes(s, d).select("user_id", F.array_join(retrieval.scope_kbs("requested", "granted", "key_scope"), ",").alias("kbs")))

query("flt6_exclude_docs", KW + "hits_v", "select query_id, chunk_id from hits_v where doc_id not in (select doc_id from documents where source = 'src3')")(lambda s, d: hits(s, d).join(t.read_table(s, d, "documents").filter("source = 'src3'").select("doc_id"), "doc_id", "left_anti").select("query_id", "chunk_id"))

query("flt7_exclude_kbs", "", f"select user_id, array_to_string(list_sort([x for x in granted if not list_contains(requested, x)]), ',') kbs, len([x for x in granted if not list_contains(requested, x)]) = 0 nothing_left from {ARRAYS}")(lambda s, d: scopes(s, d).withColumn("x", F.array_sort(F.array_except("granted", "requested"))).select("user_id", F.array_join("x", ",").alias("kbs"), (F.size("x") == 0).alias("nothing_left")))


def union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evidence(entities, chunks):
    """Entities (query_id, k, v) whose value stands in a chunk of the query, or holds one."""
    e, c = entities.filter("v <> ''"), chunks.select("query_id", "chunk_text")
    return e.join(c, "query_id").filter("contains(chunk_text, v) or contains(v, chunk_text)").select("query_id", "k").distinct()
