"""Ordered lists of sets, users, plug-ins and jobs, and their totals for paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paged(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    return rows.offset(max(0, offset)).limit(max(0, limit))


def _owned_by(document_set_user: DataFrame, email: str, role: str = "Owner") -> DataFrame:
    return document_set_user.filter((F.col("user_email") == email) & (F.col("role") == role)).select(F.col("document_set_id").alias("id"))


def sets_of_owner(document_set: DataFrame, document_set_user: DataFrame, email: str) -> DataFrame:
    """A user's own sets that aren't deleted, newest first."""
    return document_set.filter("not deleted").join(_owned_by(document_set_user, email), "id", "left_semi").orderBy(F.col("created_at").desc(), "id")


def n_sets_of_owner(document_set: DataFrame, document_set_user: DataFrame, email: str) -> DataFrame:
    """One row, n: the total for paging sets_of_owner."""
    return document_set.filter("not deleted").join(_owned_by(document_set_user, email), "id", "left_semi").agg(F.count("*").alias("n"))


def _with_owner(document_set: DataFrame, document_set_user: DataFrame) -> DataFrame:
    owners = document_set_user.filter("role = 'Owner'").select(F.col("document_set_id").alias("id"), F.col("user_email").alias("owner_email"))
    return document_set.join(owners, "id")


def sets_shared_with(document_set: DataFrame, document_set_user: DataFrame, email: str) -> DataFrame:
    """Sets that a user may view, with their owners, newest first."""
    mine = _owned_by(document_set_user, email, "Viewer")
    return _with_owner(document_set.join(mine, "id", "left_semi"), document_set_user).orderBy(F.col("created_at").desc(), "id")


def public_sets(document_set: DataFrame, document_set_user: DataFrame, user: DataFrame) -> DataFrame:
    """Public sets whose owner is a user, newest first."""
    known = user.select(F.col("email").alias("owner_email"))
    return _with_owner(document_set.filter("is_public"), document_set_user).join(known, "owner_email", "left_semi").orderBy(F.col("created_at").desc(), "id")


def users_by_activity(user: DataFrame) -> DataFrame:
    """Latest activity first, users without any last, then by e-mail."""
    return user.orderBy(F.col("last_activity_at").desc_nulls_last(), "email")


def by_name(rows: DataFrame, column: str = "name") -> DataFrame:
    return rows.orderBy(column, *[c for c in ("id",) if c in rows.columns and c != column])


def automatic_plugins(plugin: DataFrame) -> DataFrame:
    """Plug-ins that every new set gets, in their order."""
    return plugin.filter("autocreate").orderBy("autocreate_order", "id")


def jobs_by_request(job: DataFrame) -> DataFrame:
    """Reindex jobs, that asked for last first."""
    return job.orderBy(F.col("last_requested_at").desc(), "id")
