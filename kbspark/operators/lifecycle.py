"""Life of documents: trash, approvals, gates. A change is a table that meets the documents in a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def change_state(docs: DataFrame, changes: DataFrame, as_of: str, keep_days: int = 30) -> DataFrame:
    """changes (doc_id, op): delete moves active documents to the trash for `keep_days`, restore brings them back. Others stay."""
    c = changes.select("doc_id", "op").dropDuplicates(["doc_id"])
    now = F.lit(as_of).cast("date")
    j = docs.join(c, "doc_id", "left")
    gone, back = (F.col("op") == "delete") & (F.col("status") == "active"), (F.col("op") == "restore") & (F.col("status") == "soft_deleted")
    return j.select("doc_id", F.when(gone, "soft_deleted").when(back, "active").otherwise(F.col("status")).alias("status"), F.when(gone, now).when(back, None).otherwise(F.col("deleted_at")).alias("deleted_at"), F.when(gone, F.date_add(now, keep_days)).when(~back, F.date_add("deleted_at", keep_days)).alias("expires_at"))


def cascade_kb(docs: DataFrame, kbs: DataFrame, as_of: str) -> DataFrame:
    """Active documents of deleted knowledge bases go to the trash with them."""
    gone = kbs.filter("deleted_at is not null").select("kb_id", F.lit(True).alias("gone"))
    j = docs.join(gone, "kb_id", "left")
    moved = F.coalesce("gone", F.lit(False)) & (F.col("status") == "active")
    return j.select("doc_id", "kb_id", F.when(moved, "soft_deleted").otherwise(F.col("status")).alias("status"), F.when(moved, F.lit(as_of).cast("date")).otherwise(F.col("deleted_at")).alias("deleted_at"))


def purge(rows: DataFrame, dead: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (documents, chunks, entries) without those whose key is purged."""
    return rows.join(dead.select(key).distinct(), key, "left_anti")


def trash_listing(docs: DataFrame, kbs: DataFrame, as_of: str, keep_days: int = 30) -> DataFrame:
    """Deleted knowledge bases, and deleted documents of live ones, with the days left."""
    left = (F.lit(keep_days) - F.datediff(F.lit(as_of).cast("date"), F.col("deleted_at"))).cast("long").alias("days_left")
    k = kbs.filter("deleted_at is not null").select(F.lit("kb").alias("kind"), F.col("kb_id").alias("id"), F.col("kb_name").alias("name"), "space_id", left)
    live = kbs.filter("deleted_at is null").select("kb_id")
    d = docs.filter("status = 'soft_deleted'").join(live, "kb_id", "left_semi").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.col("filename").alias("name"), "space_id", left)
    return k.unionByName(d)


def sync_chunk_status(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks of deleted documents are soft_deleted."""
    gone = docs.filter("status = 'soft_deleted'").select("doc_id", F.lit(True).alias("gone"))
    return chunks.join(gone, "doc_id", "left").select("chunk_id", F.when(F.col("gone"), "soft_deleted").otherwise(F.col("status")).alias("status"))


def backfill(docs: DataFrame, kbs: DataFrame, keep_days: int = 30) -> DataFrame:
    """Space of the knowledge base where it's missing, expiry of the trash, effective date from the creation date."""
    k = kbs.select("kb_id", F.col("space_id").alias("kb_space"))
    return docs.join(k, "kb_id", "left").select("doc_id", F.coalesce("space_id", "kb_space").alias("space_id"), F.date_add("deleted_at", keep_days).alias("expires_at"), F.coalesce("effective_date", F.to_date("created_at")).alias("effective_date"))


def approvals(docs: DataFrame, users: DataFrame) -> DataFrame:
    """Documents that wait, with the name of who sent them (their id where unknown)."""
    u = users.select(F.col("user_id").alias("contributor"), "username")
    return docs.filter("approval_status = 'pending'").join(u, "contributor", "left").select("doc_id", "kb_id", "action", F.coalesce("username", F.col("contributor").cast("string")).alias("submitter"))


def apply_approvals(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (doc_id, approve, at): the latest counts. Approved deletes go to the trash, other approved ones are active."""
    last = decisions.groupBy("doc_id").agg(F.max_by("approve", "at").alias("approve"))
    j = docs.filter("approval_status = 'pending'").join(last, "doc_id")
    return j.select("doc_id", F.when(F.col("approve"), "approved").otherwise("rejected").alias("approval_status"), F.when(F.col("approve") & (F.col("action") == "delete"), "soft_deleted").when(F.col("approve"), "active").otherwise(F.col("status")).alias("status"))


def list_documents(docs: DataFrame, page: int = 0, size: int = 20) -> DataFrame:
    """A page of each knowledge base's active documents, newest first."""
    n = F.row_number().over(Window.partitionBy("kb_id").orderBy(F.col("effective_date").desc(), F.col("doc_id").desc()))
    return docs.filter("status = 'active'").withColumn("n", n).filter((F.col("n") > page * size) & (F.col("n") <= (page + 1) * size)).select("kb_id", "doc_id", "n")


#: File types that may be uploaded.
FILE_TYPES = ["pdf", "docx", "xlsx", "pptx", "md", "html", "txt"]


def upload_gate(docs: DataFrame, admins: DataFrame, max_size: int, default_day: str) -> DataFrame:
    """accepted by type and size; space admins' uploads are approved, others wait; a default effective date."""
    a = admins.select(F.col("user_id").alias("contributor"), "space_id", F.lit(True).alias("admin")).distinct()
    ok = F.col("file_type").isin(FILE_TYPES) & (F.col("file_size") > 0) & (F.col("file_size") <= max_size)
    return docs.join(a, ["contributor", "space_id"], "left").select("doc_id", ok.alias("accepted"), F.when(~ok, "refused").when(F.col("admin"), "approved").otherwise("pending").alias("approval_status"), F.coalesce("effective_date", F.lit(default_day).cast("date")).alias("effective_date"))


def audit_log(actions: DataFrame, users: DataFrame) -> DataFrame:
    """actions (action_id, user_id, action, at) with the operator's name, or id."""
    return actions.join(users.select("user_id", "username"), "user_id", "left").select("action_id", "action", "at", F.coalesce("username", F.col("user_id").cast("string")).alias("operator"))


def migrate_permissions(roles: DataFrame, forms: dict[str, str]) -> DataFrame:
    """Roles in the object form are rewritten to the array form given for each."""
    new = F.lit(None).cast("string")
    for role, text in forms.items():
        new = F.when(F.col("role_id") == role, text).otherwise(new)
    return roles.select("role_id", F.when(F.col("permissions").startswith("{"), F.coalesce(new, "permissions")).otherwise(F.col("permissions")).alias("permissions"))


def update_metadata(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (doc_id, new_version, new_effective): null keeps, blank clears the version, blank keeps the effective date."""
    v = F.when(F.col("new_version").isNull(), F.col("doc_version")).when(F.trim("new_version") != "", F.col("new_version"))
    e = F.coalesce(F.to_date(F.nullif(F.trim("new_effective"), F.lit(""))), "effective_date")
    return docs.join(changes, "doc_id", "left").select("doc_id", v.alias("doc_version"), e.alias("effective_date"))


def active_spaces(spaces: DataFrame) -> DataFrame:
    return spaces.filter("deleted_at is null").select("space_id", "name", "space_type")
