"""The same views as DuckDB common table expressions."""

from kbspark.functions import questions as fq
from kbspark.sources.fixtures import VIEWS as FIXTURES
from kbspark.sources.fixtures import duck_view

VIEWS = {
    "chunks_v": """chunks_v as (select sha256(doc_id || ':' || (i - 1)) chunk_id, doc_id, i - 1 chunk_index, x chunk_text, source kb_id, source || '/' || doc_id || '.txt' source_file,
  case when doc_id % 10 = 0 then 'soft_deleted' else 'active' end status, (date '2024-01-01' + (doc_id % 365)::int) effective_date,
  case when doc_id % 3 = 0 then date '2024-01-01' + (doc_id % 365)::int + 180 end expiry_date, 'v' || (doc_id % 4) "version"
  from (select *, row_number() over (partition by doc_id order by p) i from (select doc_id, source, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) p from documents) where trim(x, ' ') <> ''))""",
    "questions_v": """questions_v as (select item_id query_id, text query, (5 + item_id % 10)::int top_k from benchmark)""",
    "vectors_v": """vectors_v as (select chunk_id, doc_id, embedding from chunks_v join embeddings on vec_id = (doc_id + 7 * chunk_index) % (select count(*) from embeddings))""",
    "qvec_v": """qvec_v as (select query_id, embedding from questions_v join embeddings on vec_id = query_id)""",
    "users_v": """users_v as (select c_custkey user_id, c_name username, c_custkey % 50 = 0 is_global_admin from customer)""",
    "groups_v": """groups_v as (select 'r' || r_regionkey group_id, null::varchar parent_group_id, r_name "name", false is_system_admin from region
  union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name, n_nationkey = 7 from nation
  union all select 't' || n_nationkey || '_' || t, 'n' || n_nationkey, n_name || ' ' || t, false from nation, range(4) r(t))""",
    "members_v": """members_v as (select 't' || c_nationkey || '_' || (c_custkey % 4) group_id, c_custkey user_id from customer where c_custkey % 9 <> 0
  union all select 'n' || c_nationkey, c_custkey from customer where c_custkey % 6 = 0)""",
    "space_groups_v": """space_groups_v as (select 's' || r_regionkey space_id, 'r' || r_regionkey group_id from region union all select 's' || ((n_regionkey + 4) % 5), 'n' || n_nationkey from nation)""",
    "closure_v": """closure_v as (select group_id, group_id ancestor from groups_v union select c.group_id, g.parent_group_id from closure_v c join groups_v g on c.ancestor = g.group_id where g.parent_group_id is not null)""",
    "effective_v": """effective_v as (select distinct user_id, ancestor group_id from members_v join closure_v using (group_id))""",
    "postings_v": """postings_v as (select chunk_id, doc_id, term, count(*) tf from (select chunk_id, doc_id, unnest(regexp_extract_all(lower(chunk_text), '[\\x{4e00}-\\x{9fff}]|[\\p{L}\\p{N}]+')) term from chunks_v where status = 'active') group by all)""",
    "terms_v": """terms_v as (select query_id, term from (select query_id, term, row_number() over (partition by query_id order by min(p)) r from (select query_id, unnest(l) term, generate_subscripts(l, 1) p from (select query_id, regexp_extract_all(lower(query), '[\\x{4e00}-\\x{9fff}]|[\\p{L}\\p{N}]+') l from questions_v)) group by 1, 2) where r <= 30)""",
    "bm25_v": """stat_v as (select count(*) n, avg(l) a from (select chunk_id, sum(tf) l from postings_v group by 1)), len_v as (select chunk_id, sum(tf) l from postings_v group by 1), df_v as (select term, count(*) df from postings_v group by 1),
  scored_v as (select query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) score from terms_v join postings_v using (term) join df_v using (term) join len_v using (chunk_id), stat_v group by 1, 2),
  bm25_v as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int rank from scored_v) where rank <= 30)""",
    "dense_v": """dense_v as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int rank from
  (select query_id, chunk_id, round(list_inner_product([x::double for x in q.embedding], [x::double for x in c.embedding]) / sqrt(list_inner_product([x::double for x in q.embedding], [x::double for x in q.embedding])) / sqrt(list_inner_product([x::double for x in c.embedding], [x::double for x in c.embedding])), 6) score from qvec_v q, vectors_v c)) where rank <= 30)""",
    "traces_v": """traces_v as (select event_id trace_id, ts, user_id, event_type source, value * 100 total_ms, case when event_id % 13 <> 0 then ((props->>'$.k')::int % 4) / 4.0 end::double faithfulness from events)""",
}


#: Views over others: the requests' standing, and (user, space, group) of the groups that a space admits.
VIEWS |= {n: duck_view(n) for n in FIXTURES} | {
    "admitted_v": """admitted_v as (select user_id, space_id, group_id from effective_v join space_groups_v using (group_id))""",
    "globals_v": """globals_v as (select user_id from users_v where is_global_admin union select user_id from members_v join groups_v using (group_id) where is_system_admin)""",
    "standing_v": """standing_v as (select r.user_id, r.space_id, a.role explicit, r.user_id in (select user_id from globals_v) is_global, exists (select 1 from admitted_v m where m.user_id = r.user_id and m.space_id = r.space_id) is_member
  from requests_v r left join space_admins_v a using (user_id, space_id))""",
    "access_v": """ace_hit_v as (select a.*, x.user_id from aces_v a join admitted_v x on principal_type = 'group' and principal_id = x.group_id and a.space_id = x.space_id union all select a.*, principal_id::bigint from aces_v a where principal_type = 'user'),
  access_v as (select c.user_id, c.space_id, c.kb_id from (select s.user_id, s.space_id, k.kb_id from standing_v s join kbs_v k using (space_id) where deleted_at is null and (is_global or explicit is not null or (is_member and visibility = 'space_wide'))
    union select s.user_id, s.space_id, resource_id from standing_v s join ace_hit_v h on s.user_id = h.user_id and s.space_id = h.space_id where resource_type = 'kb' and not is_global and is_member) c
   join standing_v s on s.user_id = c.user_id and s.space_id = c.space_id left join kbs_v k on k.kb_id = c.kb_id and k.space_id = c.space_id
   left join (select user_id, space_id, resource_id, bool_or(principal_type = 'group' and effect = 'allow') ga, bool_or(principal_type = 'group' and effect = 'deny') gd, bool_or(principal_type = 'user' and effect = 'allow') ua, bool_or(principal_type = 'user' and effect = 'deny') ud from ace_hit_v where resource_type = 'kb' group by 1, 2, 3) f
     on f.user_id = c.user_id and f.space_id = c.space_id and f.resource_id = c.kb_id
   where case when is_global then true when not is_member then true else
     case when coalesce(ud, false) then false when coalesce(ua, false) then true when coalesce(gd, false) then false when coalesce(ga, false) then true
      else k.deleted_at is null and (explicit is not null or visibility = 'space_wide') end end)""",
}


_LISTS = ", ".join(f"[trim(x, ' ') for x in regexp_extract_all(query, '{p}')]" for p in fq.ENTITIES)
_BETWEEN = fq.BETWEEN_WORDS.replace("'", "''")
VIEWS["keywords_v"] = f"""found_k as (select query_id, unnest(l) k, generate_subscripts(l, 1) p from (select query_id, list_concat({_LISTS.replace("], [", "], [")}, [w for w in string_split_regex(query, '{_BETWEEN}') if length(w) >= 2 and not list_contains({fq.STOPWORDS!r}, w)]) l from asked_v)),
  keywords_v as (select query_id, coalesce((list(k order by p) filter (k is not null))[1:10], []) ks from asked_v left join (select query_id, k, min(p) p from found_k group by 1, 2) using (query_id) group by 1)"""
VIEWS["hits_v"] = "hits_v as (select h.query_id, h.score, h.rank, c.* from bm25_v h join chunks_v c using (chunk_id))"
VIEWS["lists_v"] = "lists_v as (select query_id, chunk_id, rank, 0 list from dense_v union all select query_id, chunk_id, rank, 1 from bm25_v)"


def duck(names: str, body: str) -> str:
    """body after the views that it needs, in order."""
    return "with recursive " + ",\n".join(VIEWS[n] for n in names.split()) + "\n" + body if names else body
