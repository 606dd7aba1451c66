"""Registered queries over parents of typed blocks, their relations, and sub-queries of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions import questions as fq
from kbspark.operators import folds, parents, retrieval
from kbspark.plans import fold_queries  # noqa: F401  (its SQL is used here)
from kbspark.plans.governance_queries import PLACE, RRF, media
from kbspark.plans.oracle_views import VIEWS
from kbspark.plans.queries import ORACLES, keyword_search, query
from kbspark.sources import tables as t
from kbspark.sources.fixtures import view

#: Lines as blocks of all kinds, three on a page.
TYPED = """select doc_id, chunk_index block_idx, case when contains(chunk_text, ' | ') then 'table' when length(chunk_text) % 11 = 0 then 'image' when length(chunk_text) % 13 = 0 then 'formula' else 'text' end kind,
  case when length(chunk_text) < 60 then 'title' when length(chunk_text) % 7 = 0 then 'reference' else 'text' end layout_type, case when length(chunk_text) % 22 = 0 then '' else chunk_text end "text",
  case when length(chunk_text) % 33 = 0 then 'figure' end caption, '<table>' || doc_id || '</table>' html, chunk_index // 3 + 1 page_num from chunks_v"""


def typed_blocks(s, d):
    n = F.length("chunk_text")
    kind = F.when(F.contains("chunk_text", F.lit(" | ")), "table").when(n % 11 == 0, "image").when(n % 13 == 0, "formula").otherwise("text")
    return t.chunks(s, d).select(
        "doc_id", F.col("chunk_index").alias("block_idx"), kind.alias("kind"), F.when(n < 60, "title").when(n % 7 == 0, "reference").otherwise("text").alias("layout_type"),
        F.when(n % 22 == 0, "").otherwise(F.col("chunk_text")).alias("text"), F.when(n % 33 == 0, "figure").alias("caption"),
        F.concat(F.lit("<table>"), "doc_id", F.lit("</table>")).alias("html"), (F.floor(F.col("chunk_index") / 3) + 1).cast("int").alias("page_num"),
    )


#: The fold as a recursion over block numbers: p the parent, used the tokens of the open one.
PARENTS = f"""with recursive b as (select *, greatest(1, length(content) // 2) n, case when kind in ('table', 'image') or kind = 'text' and layout_type = 'title' then 1 when kind = 'text' and layout_type = 'text' then 2 else 0 end u from
    (select *, case kind when 'table' then concat_ws(chr(10), nullif("text", ''), html) when 'image' then coalesce(nullif(concat_ws(chr(10), nullif("text", ''), '[图片说明: ' || caption || ']'), ''), '[图片]') else "text" end content from ({TYPED}))),
  f as (select distinct doc_id, -1::bigint i, -1::bigint p, null::bigint used, '' h, 0 u from b
    union all select b.doc_id, b.block_idx, case when b.u = 0 or b.u = 2 and used + b.n <= 500 then p else p + 1 end, case when b.u = 2 then case when used + b.n <= 500 then used + b.n else b.n end end,
      case when b.kind = 'text' and layout_type = 'title' then left(content, 100) else h end, b.u from f join b on b.doc_id = f.doc_id and b.block_idx = i + 1)
  select f.doc_id, p::int parent_index, first(kind order by i) kind, first(h order by i) heading, sha256(string_agg(content, chr(10) || chr(10) order by i)) content_sha256,
    count(*)::int n_blocks, first(page_num order by i)::int start_page, last(page_num order by i)::int end_page, greatest(1, length(string_agg(content, chr(10) || chr(10) order by i)) // 2)::bigint tokens
  from f join b on b.doc_id = f.doc_id and block_idx = i where f.u > 0 group by 1, 2"""
query("chk4_build_parents", "chunks_v", f"select * from ({PARENTS})")(
    lambda s, d: parents.build_parents(typed_blocks(s, d)).select("doc_id", "parent_index", "kind", "heading", F.sha2("content", 256).alias("content_sha256"), "n_blocks", "start_page", "end_page", "tokens")
)

query("chk10_parent_relations", "chunks_v", "select chunk_id, chunk_index // 5 parent_id, lag(chunk_id) over w prev_id, lead(chunk_id) over w next_id from chunks_v window w as (partition by doc_id, chunk_index // 5 order by chunk_index)")(
    lambda s, d: parents.parent_relations(t.chunks(s, d).withColumn("parent_id", F.floor(F.col("chunk_index") / 5)))
)


def paged(s, d):
    """Chunks with the names of their sources and three of them on a page."""
    page = (F.floor(F.col("chunk_index") / 3) + 1).cast("int")
    m = media(s, d)
    return m.select("*", F.when(F.col("chunk_index") % 4 != 1, F.concat(F.lit("h"), "chunk_index")).alias("title"), page.alias("start_page"), (page + F.col("chunk_index") % 2).cast("int").alias("end_page"))


# Chunks of a document have no gaps in their numbers, so the sizes of merged ones tell which they hold.
query("chk11_merge_pages", "", f"""select doc_id, new_index, chunk_id, n_merged, tokens, case when (upto - n_merged) % 4 <> 1 then 'h' || (upto - n_merged) end title, ((upto - n_merged) // 3 + 1)::int start_page, ((upto - 1) // 3 + 1 + (upto - 1) % 2)::int end_page
  from (select *, (sum(n_merged) over (partition by doc_id order by new_index))::bigint upto from ({ORACLES["chk11_merge_short"]}))""")(lambda s, d: folds.merge_short(paged(s, d)).drop("content"))
query("chk13_parent_children")(lambda s, d: parents.parent_children(typed_blocks(s, d)).withColumn("content", F.sha2("content", 256)))

# Sub-queries: the views of one question each, made over all sub-queries instead.

_PARTS = f"[trim(x, ' ') for x in string_split_regex(query, '{fq.COMPARED}') if trim(x, ' ') <> '']"
VIEWS["sub_questions_v"] = f"""subs_v as (select *, row_number() over (order by id, sub_id) query_id from (select id, top_k, unnest(l) query, generate_subscripts(l, 1) - 1 sub_id from
    (select query_id id, (5 + query_id % 10)::int top_k, case when len({_PARTS}) >= 2 then {_PARTS} else [query] end l from asked_v)) where trim(query, ' ') <> ''), questions_v as (select query_id, query, top_k from subs_v)"""
VIEWS["sub_qvec_v"] = "qvec_v as (select query_id, embedding from subs_v join embeddings on vec_id = (id + 31 * sub_id) % (select count(*) from embeddings))"
_LIST = "(select query_id, chunk_id, rank from dense_wide_v join questions_v using (query_id) where rank <= 3 * top_k union all select query_id, chunk_id, rank from bm25_wide_v join questions_v using (query_id) where rank <= 3 * top_k)"


def sub_hits(s, d):
    subs = parents.sub_queries(view(s, d, "asked_v").select("query_id", "query", (5 + F.col("query_id") % 10).cast("int").alias("top_k")))
    e = t.read_table(s, d, "embeddings").select("vec_id", "embedding")
    v = subs.withColumn("vec_id", (F.col("query_id") + 31 * F.col("sub_id")) % max(1, e.count())).join(e, "vec_id")
    return parents.multi_query(subs, v, t.chunk_vectors(s, d), keyword_search(s, d))


query("fus3_sub_queries", "chunks_v asked_v sub_questions_v postings_v terms_v bm25_v vectors_v sub_qvec_v wide_v", f"""select * exclude (n), row_number() over (partition by query_id order by list, rank) place from (select *, row_number() over (partition by query_id, chunk_id order by list, rank) n from
  (select id query_id, sub_id list, x.rank, chunk_id, score from (select *, {PLACE}::int rank from ({RRF.format(_LIST)})) x join subs_v using (query_id) where x.rank <= 2 * top_k)) where n = 1""")(
    lambda s, d: retrieval.merge_lists(sub_hits(s, d)).withColumn("place", F.col("place").cast("long"))
)
