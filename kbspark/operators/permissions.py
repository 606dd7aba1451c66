"""Permissions as joins: all users and spaces at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.sources.tables import materialize


def group_closure(groups: DataFrame) -> DataFrame:
    """(group_id, ancestor), itself included. Paths double with each join, so that the joins grow with the logarithm of the depth; what is
    found is written to the shared folder each time, and a round that finds nothing new (in a cycle too) is the last."""
    own = groups.select("group_id", F.col("group_id").alias("ancestor"))
    up = groups.filter("parent_group_id is not null").select("group_id", F.col("parent_group_id").alias("ancestor"))
    found = materialize(own.unionByName(up.join(own.select(F.col("group_id").alias("ancestor")), "ancestor", "left_semi").select("group_id", "ancestor")).distinct())
    n = found.count()
    while True:
        further = found.select(F.col("group_id").alias("ancestor"), F.col("ancestor").alias("next"))
        found = materialize(found.join(further, "ancestor").select("group_id", F.col("next").alias("ancestor")).distinct())
        n, before = found.count(), n
        if n == before:
            return found


def descendants(closure: DataFrame) -> DataFrame:
    """(group_id, descendant) of a closure, itself left out."""
    return closure.filter("group_id <> ancestor").select(F.col("ancestor").alias("group_id"), F.col("group_id").alias("descendant"))


def effective_groups(members: DataFrame, closure: DataFrame) -> DataFrame:
    return members.join(closure, "group_id").select("user_id", F.col("ancestor").alias("group_id")).distinct()


def expanded_members(members: DataFrame, closure: DataFrame) -> DataFrame:
    return effective_groups(members, closure).groupBy("group_id").agg(F.count("*").alias("n_users"))


def global_admins(users: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Flagged users, and direct members of a system-admin group."""
    direct = members.join(groups.filter("is_system_admin"), "group_id").select("user_id")
    return users.filter("is_global_admin").select("user_id").union(direct).distinct()


def user_spaces(effective: DataFrame, space_groups: DataFrame) -> DataFrame:
    return effective.join(space_groups, "group_id").groupBy("user_id", "space_id").agg(F.count("*").alias("n_groups"))




def member_counts(groups: DataFrame, members: DataFrame) -> DataFrame:
    return groups.join(members, "group_id", "left").groupBy("group_id").agg(F.count("user_id").alias("n"))
