"""Further views of FIXTURES.md: spaces, knowledge bases, roles, access entries, document metadata, evaluation runs.

Each view is one SQL text that Spark and DuckDB both run; names in braces are the tables or views that it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kbspark.sources.tables import read_table

VIEWS = {
    "asked_v": """select item_id query_id, item_id % 4 history_len, case item_id % 12 when 0 then '你好' when 1 then '谢谢 hello' when 2 then '对比 ' || left(text, 20) || ' 和 ' || left(text, 5)
    when 3 then '如何部署 ' || text when 4 then '价值观' when 5 then '有哪些 ' || left(text, 30) when 6 then '今天的 v3.0 ' || text when 7 then '我的 ERR-500 setup.sh ' || text
    when 8 then left(text, 10) when 9 then '分析 NginxConf ' || text when 10 then '' else text end query,
    case item_id % 5 when 0 then text when 1 then '' when 2 then '介绍 ' || left(text, 10) else left(text, 25) end rewritten,
    case when item_id % 3 = 0 then item_id * 7 % 120 end since_last from {benchmark}""",
    "spaces_v": """select 's' || r_regionkey space_id, r_name as name, case when r_regionkey % 2 = 0 then 'public' else 'team' end space_type,
  case when r_regionkey = 4 then date '2024-02-01' end deleted_at from {region}""",
    "space_admins_v": """select 's' || (c_nationkey % 5) space_id, c_custkey user_id, case when c_custkey % 25 = 0 then 'owner' else 'admin' end as role
  from {customer} where c_custkey % 25 in (0, 1)""",
    "requests_v": """select c_custkey user_id, 's' || (c_custkey % 5) space_id from {customer} union select c_custkey, 's' || (c_nationkey % 5) from {customer}""",
    "kbs_v": """select source kb_id, num, 's' || (num % 5) space_id, 'KB ' || source kb_name, case when num % 2 = 1 then 'restricted' else 'space_wide' end visibility,
  case when num % 11 = 0 then date '2024-03-01' end deleted_at from (select distinct source, cast(substring(source, 4) as int) num from {documents} where source is not null) x""",
    "roles_v": """select * from (values ('admin', '["read","write","manage"]'), ('editor', '["read","write"]'), ('viewer', '{{"read": true, "write": false}}'), ('deny', '[]')) t(role_id, permissions)""",
    "aces_v": """select k.space_id, 'kb' resource_type, kb_id resource_id, 'group' principal_type, 'n' || n_nationkey principal_id,
    case (n_nationkey + num) % 3 when 0 then 'editor' when 1 then 'viewer' else 'admin' end role_id, case when (n_nationkey + num) % 8 = 0 then 'deny' else 'allow' end effect
  from {kbs_v} k join {nation} n on num % 4 = (4 - n_nationkey % 4) % 4
  union all select k.space_id, 'kb', kb_id, 'user', cast(c_custkey as string), case (c_custkey + num) % 3 when 0 then 'viewer' when 1 then 'editor' else 'deny' end,
    case when (c_custkey + num) % 14 = 0 then 'deny' else 'allow' end
  from {kbs_v} k join {customer} c on num % 7 = (7 - c_custkey % 7) % 7
  union all select k.space_id, 'document', cast(doc_id as string), 'group', 'n' || (doc_id % 25), 'viewer', case when doc_id % 10 = 0 then 'deny' else 'allow' end
  from {documents} d join {kbs_v} k on d.source = k.kb_id where doc_id % 5 = 0""",
    "doc_meta_v": """select doc_id, kb_id, space_id, source || '/' || doc_id || '.txt' filename,
    case doc_id % 7 when 0 then 'pdf' when 1 then 'docx' when 2 then 'xlsx' when 3 then 'pptx' when 4 then 'md' when 5 then 'html' else 'txt' end file_type, n_chars file_size,
    case when doc_id % 10 = 0 then 'soft_deleted' else 'active' end status, case when doc_id % 10 = 0 then date '2024-05-01' + cast(doc_id % 20 as int) end deleted_at,
    case doc_id % 4 when 0 then 'pending' when 1 then 'approved' when 2 then 'rejected' else 'approved' end approval_status,
    case doc_id % 3 when 0 then 'upload' when 1 then 'update' else 'delete' end action, doc_id % 5 <> 0 inherit_permissions, 1 + doc_id % 180 contributor,
    date '2024-01-01' + cast(doc_id % 365 as int) effective_date, case when doc_id % 3 = 0 then 'v' || (doc_id % 4) end doc_version
  from {documents} d join {kbs_v} k on d.source = k.kb_id""",
    "eval_a_v": """select doc_id id, case when doc_id % 3 = 0 then 'negative' else 'positive' end category, cast(doc_id % 5 as double) / 4 faithfulness,
    case when doc_id % 4 <> 0 then cast(doc_id % 7 as double) / 6 end answer_relevance, case when doc_id % 5 <> 0 then value * 25 end first_token_ms, value * 100 total_ms,
    case doc_id % 4 when 0 then '' when 1 then '抱歉, nothing found' else 'answer ' || doc_id end answer, doc_id % 6 n_hits
  from {labels} l join {events} e on event_id = doc_id""",
    "eval_b_v": """select id, category, faithfulness + cast(id % 5 - 2 as double) / 20 faithfulness, answer_relevance, first_token_ms, total_ms, answer, n_hits from {eval_a_v} where id % 9 <> 0""",
    "spans_v": """select event_id trace_id, cast(event_id as string) || '-0' span_id, cast(null as string) parent_id, 'retrieve' node, ts, value ms from {events}
  union all select event_id, cast(event_id as string) || '-1', cast(event_id as string) || '-0', 'dense', ts, value / 2 from {events}
  union all select event_id, cast(event_id as string) || '-2', cast(event_id as string) || '-1', case when event_id % 2 = 0 then 'rerank' else 'fuse' end, ts, value / 4 from {events}
  union all select event_id, cast(event_id as string) || '-3', 'lost', 'other', ts, value from {events} where event_id % 5 = 0""",
}
#: The views that each view reads.
NEEDS = {"aces_v": ["kbs_v"], "doc_meta_v": ["kbs_v"], "eval_b_v": ["eval_a_v"]}
TABLES = "region nation customer documents labels events benchmark conversations".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = {t: read_table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    used |= {v: view(spark, sf_dir, v) for v in NEEDS.get(name, [])}
    return spark.sql(sql, **used) if used else spark.sql(sql.format())


def duck_view(name: str) -> str:
    names = {n: n for n in [*TABLES, *VIEWS]}
    return f"{name} as ({VIEWS[name].format(**names)})"
