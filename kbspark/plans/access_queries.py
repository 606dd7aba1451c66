"""Registered queries over permissions and the life of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import access, lifecycle, permissions
from kbspark.plans.queries import query
from kbspark.sources import tables as t
from kbspark.sources.fixtures import view

BASE = "users_v groups_v members_v closure_v effective_v space_groups_v spaces_v space_admins_v requests_v admitted_v globals_v standing_v "
ACES = BASE + "kbs_v aces_v "


def effective(s: SparkSession, d: str) -> DataFrame:
    return permissions.effective_groups(t.members(s, d), permissions.group_closure(t.groups(s, d)))


def admitted(s: SparkSession, d: str) -> DataFrame:
    return effective(s, d).join(t.space_groups(s, d), "group_id").select("user_id", "space_id", "group_id")


def standings(s: SparkSession, d: str) -> DataFrame:
    return access.standing(view(s, d, "requests_v"), view(s, d, "space_admins_v"), permissions.global_admins(t.users(s, d), t.members(s, d), t.groups(s, d)), admitted(s, d))


def accessible(s: SparkSession, d: str) -> DataFrame:
    return access.accessible_kbs(standings(s, d), view(s, d, "kbs_v"), view(s, d, "aces_v"), admitted(s, d))


def granted(s: SparkSession, d: str) -> DataFrame:
    return access.kb_permissions(view(s, d, "requests_v"), view(s, d, "aces_v"), view(s, d, "roles_v"), effective(s, d))


GRANTED = """(select distinct r.user_id, r.space_id, resource_id kb_id, permission from requests_v r join aces_v a using (space_id) join
  (select * from (values ('admin', 'read'), ('admin', 'write'), ('admin', 'manage'), ('editor', 'read'), ('editor', 'write'), ('viewer', 'read')) v(role_id, permission)) using (role_id)
  where resource_type = 'kb' and ((principal_type = 'user' and principal_id = r.user_id::varchar) or (principal_type = 'group' and (r.user_id, principal_id) in (select user_id, group_id from effective_v))))"""

query("acl6_space_role", BASE, """select user_id, space_id, case when explicit is not null then explicit when is_global then 'admin' when is_member then 'member' end "role" from standing_v""")(lambda s, d: access.space_role(standings(s, d)))

query("acl7_accessible_kbs", ACES + "access_v", """select user_id, space_id, kb_id from access_v""")(accessible)

query("acl8_kb_permissions", ACES, f"""select user_id, space_id, kb_id, permission from {GRANTED}""")(granted)

query("acl10_has_permission", ACES, f"""select w.*, exists (select 1 from standing_v s where s.user_id = w.user_id and s.space_id = w.space_id and (is_global or explicit is not null)) or (w.user_id, w.space_id, w.kb_id) in (select user_id, space_id, kb_id from {GRANTED} where permission = 'write') allowed
  from (select user_id, space_id, kb_id, 'write' permission from requests_v join kbs_v using (space_id)) w""")(
    lambda s, d: access.has_permission(standings(s, d), view(s, d, "requests_v").join(view(s, d, "kbs_v"), "space_id").select("user_id", "space_id", "kb_id", F.lit("write").alias("permission")), granted(s, d)))

query("acl11_excluded_docs", ACES + "doc_meta_v", """select s.user_id, s.space_id, d.doc_id from standing_v s join doc_meta_v d using (space_id) left join
  (select x.user_id, a.space_id, resource_id, bool_or(effect = 'deny') denied from aces_v a join admitted_v x on principal_id = x.group_id and a.space_id = x.space_id where resource_type = 'document' group by 1, 2, 3) e
  on e.user_id = s.user_id and e.space_id = s.space_id and e.resource_id = d.doc_id::varchar where not is_global and explicit is null and not inherit_permissions and status = 'active' and coalesce(denied, true)""")(
    lambda s, d: access.excluded_docs(standings(s, d), view(s, d, "doc_meta_v"), view(s, d, "aces_v"), admitted(s, d)))

query("acl12_ace_matrix", "kbs_v aces_v", """select space_id, resource_type, resource_id, count(*) filter (principal_type = 'group' and effect = 'allow') group_allow, count(*) filter (principal_type = 'group' and effect = 'deny') group_deny,
  count(*) filter (principal_type = 'user' and effect = 'allow') user_allow, count(*) filter (principal_type = 'user' and effect = 'deny') user_deny from aces_v group by 1, 2, 3""")(lambda s, d: access.ace_matrix(view(s, d, "aces_v")))

query("acl13_kb_access_info", ACES + "access_v", """select user_id, a.space_id, kb_id, kb_name, visibility, space_type from access_v a join (select kb_id, kb_name, visibility from kbs_v) using (kb_id) join (select space_id, space_type from spaces_v) using (space_id)""")(
    lambda s, d: access.kb_access_info(accessible(s, d), view(s, d, "kbs_v"), view(s, d, "spaces_v")))

query("acl14_key_scope_violations", ACES + "access_v", """select user_id key_id, kb_id from (select user_id, space_id, unnest(['src0', 'src5', 'src7']) kb_id from requests_v) w where (user_id, space_id, kb_id) not in (select user_id, space_id, kb_id from access_v)""")(
    lambda s, d: access.key_scope_violations(view(s, d, "requests_v").select(F.col("user_id").alias("key_id"), "user_id", "space_id", F.array(*map(F.lit, ("src0", "src5", "src7"))).alias("scope")), accessible(s, d)))

query("acl15_group_paths", "", """select * from (select distinct r_name path, null parent_path, r_name "name" from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
  union select r_name || '/' || n_name, r_name, n_name from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
  union select r_name || '/' || n_name || '/' || c_mktsegment, r_name || '/' || n_name, c_mktsegment from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey) where path not in (select r_name from region where r_regionkey < 3)""")(
    lambda s, d: access.group_paths(
        t.read_table(s, d, "customer").join(t.read_table(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t.read_table(s, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("/"), "r_name", F.lit("/ "), "n_name", F.lit("/"), "c_mktsegment").alias("path")),
        t.read_table(s, d, "region").filter("r_regionkey < 3").select(F.col("r_name").alias("path"))))

query("acl16_ace_duplicates", "kbs_v aces_v", """select space_id, resource_type, resource_id, principal_type, principal_id, count(*) n from (select * from aces_v union all select * from aces_v where effect = 'deny') group by all having count(*) > 1""".replace("group by all", "group by 1, 2, 3, 4, 5"))(
    lambda s, d: access.ace_duplicates(view(s, d, "aces_v").unionByName(view(s, d, "aces_v").filter("effect = 'deny'"))))

query("acl17_role_usage", "kbs_v aces_v", """select role_id, count(effect) n_aces, count(effect) = 0 can_drop from (values ('admin'), ('editor'), ('viewer'), ('deny')) r(role_id) left join aces_v using (role_id) group by 1""")(lambda s, d: access.role_usage(view(s, d, "roles_v"), view(s, d, "aces_v")))

query("acl18_space_people", BASE, """select space_id, "role", username "name" from space_admins_v join users_v using (user_id) union all select space_id, 'group', "name" from space_groups_v join groups_v using (group_id)""")(
    lambda s, d: access.space_people(view(s, d, "space_admins_v"), t.space_groups(s, d), t.users(s, d), t.groups(s, d)))

query("acl20_add_members", "members_v", """select 'n' || c_nationkey group_id, c_custkey user_id from customer where c_custkey % 4 = 0 and c_custkey % 6 <> 0""")(
    lambda s, d: access.add_members(t.members(s, d), t.read_table(s, d, "customer").filter("c_custkey % 4 = 0").select(F.concat(F.lit("n"), "c_nationkey").alias("group_id"), F.col("c_custkey").alias("user_id"))))

query("acl21_my_spaces", BASE, """select user_id, space_id, "name", coalesce(explicit, case when is_member then 'member' when is_global then 'admin' end) "role" from standing_v join spaces_v using (space_id) where deleted_at is null and (explicit is not null or is_member or is_global)""")(
    lambda s, d: access.my_spaces(standings(s, d), view(s, d, "spaces_v")))

query("acl22_search_users", "users_v", """select prefix, user_id, username, rank from (select *, row_number() over (partition by prefix order by username, user_id)::int rank from (select distinct left(c_name, 15 + c_nationkey % 4) prefix from customer) p join users_v on starts_with(username, prefix)) where rank <= 10""")(
    lambda s, d: access.search_users(t.users(s, d), t.read_table(s, d, "customer").select(F.expr("left(c_name, int(15 + c_nationkey % 4))").alias("prefix"))))

query("acl23_valid_keys", "", """select c_custkey key_id from customer where c_custkey % 7 <> 0 and (c_custkey % 5 = 0 or date '2024-01-01' + (c_custkey % 365)::int >= date '2024-06-01')""")(
    lambda s, d: access.valid_keys(t.read_table(s, d, "customer").select(F.col("c_custkey").alias("key_id"), (F.col("c_custkey") % 7 == 0).alias("revoked"), F.when(F.col("c_custkey") % 5 != 0, F.expr("date_add(date'2024-01-01', int(c_custkey % 365))")).alias("expires_at")), "2024-06-01").select("key_id"))

META = "kbs_v doc_meta_v "


def meta(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "doc_meta_v")


query("lif1_trash_restore", META, """select doc_id, case when op = 'delete' and status = 'active' then 'soft_deleted' when op = 'restore' and status = 'soft_deleted' then 'active' else status end status,
  case when op = 'delete' and status = 'active' then date '2024-06-01' when op = 'restore' and status = 'soft_deleted' then null else deleted_at end deleted_at,
  case when op = 'delete' and status = 'active' then date '2024-07-01' when op = 'restore' and status = 'soft_deleted' then null else deleted_at + 30 end expires_at
  from (select *, case doc_id % 4 when 0 then 'delete' when 2 then 'restore' end op from doc_meta_v)""", dates=("deleted_at", "expires_at",))(
    lambda s, d: lifecycle.change_state(meta(s, d), meta(s, d).filter("doc_id % 2 = 0").select("doc_id", F.expr("if(doc_id % 4 = 0, 'delete', 'restore')").alias("op")), "2024-06-01"))

query("lif2_cascade_kb", META, """select doc_id, kb_id, case when k.deleted_at is not null then 'soft_deleted' else status end status, case when k.deleted_at is not null and status = 'active' then date '2024-06-01' else m.deleted_at end deleted_at from doc_meta_v m join (select kb_id, deleted_at from kbs_v) k using (kb_id)""", dates=("deleted_at",))(
    lambda s, d: lifecycle.cascade_kb(meta(s, d), view(s, d, "kbs_v"), "2024-06-01"))

query("lif3_purge", META + "chunks_v", """select chunk_id from chunks_v where doc_id not in (select doc_id from doc_meta_v where status = 'soft_deleted')""")(lambda s, d: lifecycle.purge(t.chunks(s, d), meta(s, d).filter("status = 'soft_deleted'")).select("chunk_id"))

query("lif4_trash_listing", META, """select 'kb' kind, kb_id id, kb_name "name", space_id, 30 - (date '2024-05-20' - deleted_at) days_left from kbs_v where deleted_at is not null
  union all select 'document', doc_id::varchar, filename, space_id, 30 - (date '2024-05-20' - deleted_at) from doc_meta_v where status = 'soft_deleted' and kb_id in (select kb_id from kbs_v where deleted_at is null)""")(
    lambda s, d: lifecycle.trash_listing(meta(s, d), view(s, d, "kbs_v"), "2024-05-20"))

query("lif5_sync_chunk_status", META + "chunks_v", """select chunk_id, case when doc_id in (select doc_id from doc_meta_v where status = 'soft_deleted') then 'soft_deleted' else 'new' end status from chunks_v""")(
    lambda s, d: lifecycle.sync_chunk_status(t.chunks(s, d).withColumn("status", F.lit("new")), meta(s, d)))

query("lif6_backfill", META, """select doc_id, space_id, deleted_at + 30 expires_at, case when doc_id % 3 = 0 then date '2023-12-01' else effective_date end effective_date from doc_meta_v""", dates=("expires_at", "effective_date",))(
    lambda s, d: lifecycle.backfill(meta(s, d).select("doc_id", "kb_id", "deleted_at", F.expr("if(doc_id % 2 = 0, null, space_id)").alias("space_id"), F.expr("if(doc_id % 3 = 0, null, effective_date)").alias("effective_date"), F.lit("2023-12-01 08:00:00").alias("created_at")), view(s, d, "kbs_v")))

query("lif7_approvals", META + "users_v", """select doc_id, kb_id, action, coalesce(username, contributor::varchar) submitter from doc_meta_v left join users_v on user_id = contributor where approval_status = 'pending'""")(lambda s, d: lifecycle.approvals(meta(s, d), t.users(s, d)))

query("lif8_apply_approvals", META, """select doc_id, case when doc_id % 12 < 8 then 'approved' else 'rejected' end approval_status, case when doc_id % 12 >= 8 then status when action = 'delete' then 'soft_deleted' else 'active' end status from doc_meta_v where doc_id % 4 = 0""")(
    lambda s, d: lifecycle.apply_approvals(meta(s, d), meta(s, d).select("doc_id", F.expr("doc_id % 12 < 8").alias("approve"), F.lit(2).alias("at")).unionByName(meta(s, d).select("doc_id", F.expr("doc_id % 12 >= 8").alias("approve"), F.lit(1).alias("at")))))

query("lif9_list_documents", META, """select kb_id, doc_id, n from (select kb_id, doc_id, row_number() over (partition by kb_id order by effective_date desc, doc_id desc)::int n from doc_meta_v where status = 'active') where n between 6 and 10""")(lambda s, d: lifecycle.list_documents(meta(s, d), 1, 5))

query("lif11_audit_log", "users_v", """select event_id action_id, event_type "action", ts "at", coalesce(username, e.user_id::varchar) "operator" from events e left join users_v u on u.user_id = e.user_id""")(
    lambda s, d: lifecycle.audit_log(t.read_table(s, d, "events").select(F.col("event_id").alias("action_id"), "user_id", F.col("event_type").alias("action"), F.col("ts").alias("at")), t.users(s, d)))

query("lif12_upload_gate", META + "space_admins_v", """select doc_id, ok accepted, case when not ok then 'refused' when (contributor, space_id) in (select user_id, space_id from space_admins_v) then 'approved' else 'pending' end approval_status, effective_date
  from (select *, file_size > 0 and file_size <= 20000 ok from doc_meta_v)""", dates=("effective_date",))(lambda s, d: lifecycle.upload_gate(meta(s, d), view(s, d, "space_admins_v"), 20_000, "2024-01-01"))

query("lif14_update_metadata", META, """select doc_id, case doc_id % 4 when 0 then null when 1 then 'v9' else doc_version end doc_version, case when doc_id % 5 = 0 then date '2025-01-01' else effective_date end effective_date from doc_meta_v""", dates=("effective_date",))(
    lambda s, d: lifecycle.update_metadata(meta(s, d), meta(s, d).select("doc_id", F.expr("case doc_id % 4 when 0 then ' ' when 1 then 'v9' end").alias("new_version"), F.expr("case doc_id % 5 when 0 then '2025-01-01' when 1 then '' end").alias("new_effective"))))

query("lif15_active_spaces", "spaces_v", """select space_id, "name", space_type from spaces_v where deleted_at is null""")(lambda s, d: lifecycle.active_spaces(view(s, d, "spaces_v")))
