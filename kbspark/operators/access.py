"""Resolution of spaces, knowledge bases and documents for a table of requests (user_id, space_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.sources.tables import materialize


def standing(requests: DataFrame, admins: DataFrame, global_admins: DataFrame, user_spaces: DataFrame) -> DataFrame:
    """Each request with explicit (owner, admin or null), is_global and is_member."""
    explicit = admins.groupBy("user_id", "space_id").agg(F.max("role").alias("explicit"))
    members = user_spaces.select("user_id", "space_id").distinct().withColumn("is_member", F.lit(True))
    r = requests.join(explicit, ["user_id", "space_id"], "left").join(global_admins.select("user_id").withColumn("is_global", F.lit(True)), "user_id", "left").join(members, ["user_id", "space_id"], "left")
    return r.na.fill(False, ["is_global", "is_member"])


def space_role(standings: DataFrame) -> DataFrame:
    """The explicit role, else admin for global admins, else member, else null."""
    return standings.select("user_id", "space_id", F.coalesce("explicit", F.when(F.col("is_global"), "admin"), F.when(F.col("is_member"), "member")).alias("role"))


def my_spaces(standings: DataFrame, spaces: DataFrame) -> DataFrame:
    """Live spaces of the requests with a role; here being a member comes before being a global admin."""
    role = F.coalesce("explicit", F.when(F.col("is_member"), "member"), F.when(F.col("is_global"), "admin"))
    live = spaces.filter("deleted_at is null").select("space_id", "name")
    return standings.select("user_id", "space_id", role.alias("role")).filter("role is not null").join(live, "space_id")


def matching_aces(requests: DataFrame, aces: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Entries that name a request's user, or a group of `groups`, which joins the requests on `keys`."""
    a = aces.select("space_id", "resource_type", "resource_id", "principal_type", "principal_id", "role_id", "effect")
    direct = a.filter("principal_type = 'user'").withColumn("user_id", F.col("principal_id").try_cast("long"))
    via = a.filter("principal_type = 'group'").join(groups.withColumnRenamed("group_id", "principal_id"), ["principal_id", *(k for k in keys if k != "user_id")])
    cols = ["user_id", "space_id", "resource_type", "resource_id", "principal_type", "role_id", "effect"]
    return direct.select(*cols).unionByName(via.select(*cols)).join(requests.select("user_id", "space_id"), ["user_id", "space_id"], "left_semi")


def accessible_kbs(standings: DataFrame, kbs: DataFrame, aces: DataFrame, admitted: DataFrame) -> DataFrame:
    """Knowledge bases that each request may read. Global admins see every live one. Others start from all live ones as a space admin, from
    the space-wide ones as a member; then group entries add and take away, and user entries after them. admitted: (user_id, space_id,
    group_id). One grouping of all facts, no set is built for a user."""
    inside = (F.col("explicit").isNotNull() | F.col("is_member")) & ~F.col("is_global")
    live = kbs.filter("deleted_at is null").select("space_id", "kb_id", "visibility")
    sees = F.col("is_global") | F.col("explicit").isNotNull() | (F.col("is_member") & (F.col("visibility") == "space_wide"))
    start = standings.join(live, "space_id").filter(sees).select("user_id", "space_id", "kb_id", F.lit("start").alias("fact"))
    phased = standings.filter(inside & F.col("is_member"))
    m = matching_aces(phased, aces.filter("resource_type = 'kb'"), admitted, ["user_id", "space_id"])
    facts = start.unionByName(m.select("user_id", "space_id", F.col("resource_id").alias("kb_id"), F.concat("principal_type", F.lit("_"), "effect").alias("fact")))
    has = lambda x: F.max(F.col("fact") == x)
    g = facts.groupBy("user_id", "space_id", "kb_id").agg(*(has(x).alias(x) for x in ("start", "group_allow", "group_deny", "user_allow", "user_deny")))
    return g.filter("(((start or group_allow) and not group_deny) or user_allow) and not user_deny").select("user_id", "space_id", "kb_id")


def parse_permissions(text: Column) -> Column:
    """The array form, or the true keys of the object form; anything else is empty."""
    listed = F.from_json(text, "array<string>")
    keyed = F.map_keys(F.map_filter(F.from_json(text, "map<string,boolean>"), lambda _, v: v))
    return F.when(text.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.coalesce(keyed, F.array().cast("array<string>")))


def kb_permissions(requests: DataFrame, aces: DataFrame, roles: DataFrame, effective: DataFrame) -> DataFrame:
    """(user_id, space_id, kb_id, permission): of the roles of all entries that match, whatever their effect."""
    m = matching_aces(requests, aces.filter("resource_type = 'kb'"), effective.select("user_id", "group_id"), ["user_id"])
    grants = roles.select("role_id", F.explode(parse_permissions(F.col("permissions"))).alias("permission"))
    return m.join(grants, "role_id").select("user_id", "space_id", F.col("resource_id").alias("kb_id"), "permission").distinct()


def has_permission(standings: DataFrame, wanted: DataFrame, granted: DataFrame) -> DataFrame:
    """wanted (user_id, space_id, kb_id, permission) with allowed: admins always, others by kb_permissions."""
    admin = standings.filter(F.col("is_global") | F.col("explicit").isNotNull()).select("user_id", "space_id", F.lit(True).alias("admin"))
    got = granted.withColumn("got", F.lit(True))
    j = wanted.join(admin, ["user_id", "space_id"], "left").join(got, ["user_id", "space_id", "kb_id", "permission"], "left")
    return j.select(*wanted.columns, F.coalesce("admin", "got", F.lit(False)).alias("allowed"))


def excluded_docs(standings: DataFrame, docs: DataFrame, aces: DataFrame, admitted: DataFrame, block: int = 1024, run: int = 512, most: int = 4_000_000) -> DataFrame:
    """Active documents with permissions of their own that a request is denied or not allowed. Admins have none excluded.

    Requests of a space that are in the same of the groups that its entries name have the same documents excluded by them. These are found
    once for each such set of groups, in lists of up to `run` documents, and meet its users, crowds of about `block`, so pairs of a request and a
    list are written once and pairs of a request and a document are only ever written out. They come list by list: a user stays for a list, and
    the list comes again for each user, which column files store in a fraction of a byte a row. Lists of up to `most` documents in
    all go to every task. Requests with entries for their user are resolved one by one."""
    plain = standings.filter(~F.col("is_global") & F.col("explicit").isNull()).select("user_id", "space_id").distinct()
    own = materialize(docs.filter("not inherit_permissions and status = 'active'").select("space_id", F.col("doc_id").cast("string").alias("resource_id"), "doc_id"))
    entries = materialize(aces.filter("resource_type = 'document'").join(own.select("space_id", "resource_id"), ["space_id", "resource_id"], "left_semi"))
    named = entries.filter("principal_type = 'group'").select("space_id", F.col("principal_id").alias("group_id")).distinct()
    sets = admitted.join(named, ["space_id", "group_id"]).groupBy("user_id", "space_id").agg(F.array_sort(F.collect_set("group_id")).alias("groups"))
    direct = entries.filter("principal_type = 'user'").select(F.col("principal_id").try_cast("long").alias("user_id"), "space_id").distinct()
    request = plain.join(sets, ["user_id", "space_id"], "left").join(direct.withColumn("direct", F.lit(True)), ["user_id", "space_id"], "left")
    request = materialize(request.withColumn("groups", F.coalesce("groups", F.array().cast("array<string>"))))
    alike, single = request.filter("direct is null"), request.filter("direct")

    groups = alike.groupBy("space_id", "groups").agg(F.count("*").alias("n"))
    groups = materialize(groups.withColumn("set", F.monotonically_increasing_id()))  # its numbers are made once
    via = groups.select("set", "space_id", F.explode("groups").alias("principal_id")).join(entries.filter("principal_type = 'group'"), ["space_id", "principal_id"])
    parts = own.groupBy("space_id").agg(F.ceil(F.count("*") / (32 * run)).alias("parts"))
    lists = groups.select("set", "space_id").join(own, "space_id").join(denials(via, ["set", "resource_id"]), ["set", "resource_id"], "left").filter(F.coalesce("denied", F.lit(True)))
    lists = lists.join(parts, "space_id").groupBy("set", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part")).agg(F.sort_array(F.collect_list("doc_id")).alias("all"))
    lists = lists.select("set", F.explode(F.transform(F.sequence(F.lit(1), F.size("all"), F.lit(run)), lambda i: F.slice("all", i, run))).alias("docs"))
    lists = materialize(lists.withColumn("list", F.monotonically_increasing_id()))
    crowds = alike.join(F.broadcast(groups) if groups.count() <= 10_000 else groups, ["space_id", "groups"])
    crowds = materialize(crowds.groupBy("set", "space_id", F.pmod(F.xxhash64("user_id"), F.ceil(F.col("n") / block)).alias("part")).agg(F.collect_list(F.struct("user_id")).alias("users")))
    names, n_docs = lists.select("set", "list"), lists.agg(F.coalesce(F.sum(F.size("docs")), F.lit(0))).first()[0]
    crowds = crowds.repartition(max(1, -(-crowds.count() // 4))).join(F.broadcast(names) if names.count() <= 100_000 else names, "set")
    shared = materialize(crowds.select("space_id", "list", F.explode("users").alias("user")).select("user.user_id", "space_id", "list"))
    shared = shared.join(F.broadcast(lists) if n_docs <= most else lists, "list").select("user_id", "space_id", F.explode("docs").alias("doc_id"))

    keys = ["user_id", "space_id", "resource_id"]
    m = matching_aces(single, entries, admitted, ["user_id", "space_id"])
    alone = single.join(own, "space_id").join(denials(m, keys), keys, "left").filter(F.coalesce("denied", F.lit(True)))
    return shared.unionByName(alone.select("user_id", "space_id", "doc_id"))


def denials(matches: DataFrame, keys: list[str]) -> DataFrame:
    return matches.groupBy(*keys).agg(F.bool_or(F.col("effect") == "deny").alias("denied"))


def ace_matrix(aces: DataFrame) -> DataFrame:
    """Entries of each resource by kind of principal and effect."""
    g = aces.withColumn("kind", F.concat("principal_type", F.lit("_"), "effect")).groupBy("space_id", "resource_type", "resource_id")
    return g.pivot("kind", ["group_allow", "group_deny", "user_allow", "user_deny"]).agg(F.count(F.lit(1))).na.fill(0)


def kb_access_info(accessible: DataFrame, kbs: DataFrame, spaces: DataFrame) -> DataFrame:
    k = kbs.select("kb_id", "kb_name", "visibility")
    return accessible.join(k, "kb_id").join(spaces.select("space_id", "space_type"), "space_id").select("user_id", "space_id", "kb_id", "kb_name", "visibility", "space_type")


def key_scope_violations(keys: DataFrame, accessible: DataFrame) -> DataFrame:
    """keys (key_id, user_id, space_id, scope): entries of a scope that its user isn't granted."""
    wanted = keys.select("key_id", "user_id", "space_id", F.explode("scope").alias("kb_id")).distinct()
    return wanted.join(accessible, ["user_id", "space_id", "kb_id"], "left_anti").select("key_id", "kb_id")


def group_paths(paths: DataFrame, existing: DataFrame) -> DataFrame:
    """Groups to create for slash paths: each missing prefix once, with its parent's path and its name."""
    parts = F.filter(F.transform(F.split("path", "/"), lambda x: F.trim(x)), lambda x: x != "")
    p = paths.select(parts.alias("parts")).filter(F.size("parts") > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.slice("parts", F.lit(1), i))).alias("x")).distinct()
    made = p.select(F.array_join("x", "/").alias("path"), F.when(F.size("x") > 1, F.array_join(F.slice("x", F.lit(1), F.size("x") - 1), "/")).alias("parent_path"), F.element_at("x", -1).alias("name"))
    return made.join(existing.select("path"), "path", "left_anti")


def ace_duplicates(aces: DataFrame) -> DataFrame:
    keys = ["space_id", "resource_type", "resource_id", "principal_type", "principal_id"]
    return aces.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def role_usage(roles: DataFrame, aces: DataFrame) -> DataFrame:
    used = aces.groupBy("role_id").agg(F.count("*").alias("n"))
    return roles.select("role_id").join(used, "role_id", "left").select("role_id", F.coalesce("n", F.lit(0)).alias("n_aces"), F.col("n").isNull().alias("can_drop"))


def space_people(admins: DataFrame, space_groups: DataFrame, users: DataFrame, groups: DataFrame) -> DataFrame:
    """Admins with their names and admitted groups with theirs; an unknown one keeps its id."""
    a = admins.join(users.select("user_id", "username"), "user_id", "left").select("space_id", "role", F.coalesce("username", F.col("user_id").cast("string")).alias("name"))
    g = space_groups.join(groups.select("group_id", "name"), "group_id", "left").select("space_id", F.lit("group").alias("role"), F.coalesce("name", "group_id").alias("name"))
    return a.unionByName(g)


def add_members(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of `wanted` that are not members yet, each once."""
    return wanted.select("group_id", "user_id").distinct().join(members, ["group_id", "user_id"], "left_anti")


def search_users(users: DataFrame, prefixes: DataFrame, most: int = 10) -> DataFrame:
    """For each prefix that isn't blank, the first `most` users by name that begin with it. A user meets the prefixes by equal strings: each
    of its own prefixes up to the longest length asked."""
    p = prefixes.filter(F.trim("prefix") != "").select("prefix").distinct()
    longest = p.agg(F.coalesce(F.max(F.length("prefix")), F.lit(0)).alias("longest"))
    own = users.join(F.broadcast(longest)).withColumn("n", F.least("longest", F.length("username"))).filter("n > 0")  # longest is one row
    own = own.select("user_id", "username", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.substring(F.col("username"), F.lit(1), i))).alias("prefix"))
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy("username", "user_id"))
    return own.join(p, "prefix").withColumn("rank", rank).filter(F.col("rank") <= most).select("prefix", "user_id", "username", "rank")


def valid_keys(keys: DataFrame, as_of: str) -> DataFrame:
    return keys.filter(~F.coalesce("revoked", F.lit(False))).filter(F.coalesce(F.col("expires_at") >= F.lit(as_of).cast("date"), F.lit(True)))
