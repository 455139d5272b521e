"""Visibility: which rows a user may see. Every query starts here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import COMPLETE


@dataclass(frozen=True)
class User:
    """An acting user: the id, whether they see everything, and the ids of their departments."""

    id: int | None
    is_superuser: bool = False
    departments: tuple[int, ...] = ()


def load_user(users: DataFrame, user_departments: DataFrame, user_id: int) -> User:
    """One user's row and department ids; a missing user sees nothing but public arms."""
    own = user_departments.filter(F.col("user_id") == user_id).select("user_id", "department_id")
    rows = users.filter(F.col("id") == user_id).select(F.col("id").alias("user_id"), "is_superuser").join(own, "user_id", "left").distinct().collect()
    departments = {r.department_id for r in rows if r.department_id is not None}
    return User(user_id if rows else None, any(r.is_superuser for r in rows), tuple(sorted(departments)))


def visible_to(rows: DataFrame, bridge: DataFrame, user: User, bridge_id: str = "document_id", id_col: str = "id") -> DataFrame:
    """Rows a user sees: department rows that share a department with them, and their own private rows.

    The two arms can't overlap, as a row has one visibility, and a semi-join repeats no row for several departments, so that
    nothing needs a DISTINCT (which would be one more shuffle in every query). Each arm is a plain semi-join
    or filter. A department row without departments is visible to superusers only.
    """
    if user.is_superuser:
        return rows
    shared = bridge.filter(F.col("department_id").isin(*user.departments)).select(F.col(bridge_id).alias(id_col))
    department = rows.filter(F.col("visibility") == "department").join(shared, id_col, "left_semi")
    return department.unionByName(rows.filter((F.col("visibility") == "private") & (F.col("owner_id") == F.lit(user.id))))


def roots(docs: DataFrame) -> DataFrame:
    return docs.filter("parent_id IS NULL")


def children_of(visible: DataFrame, parent: int) -> DataFrame:
    return visible.filter(F.col("parent_id") == parent)


def processing_complete(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("processing_status").isin(*COMPLETE))


def needs_review(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("processing_status") == "ready")


def open_actions(visible: DataFrame) -> DataFrame:
    return visible.filter(F.col("action_status") != "erledigt")


def inherit_scope(children: DataFrame, docs: DataFrame, bridge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New children with owner and visibility of their parent unless they bring their own, and their department rows.

    `children` has id, parent_id, owner_id, visibility (null: inherit).
    """
    parent = docs.select(F.col("id").alias("parent_id"), F.col("owner_id").alias("p_owner"), F.col("visibility").alias("p_visibility"))
    scoped = children.join(parent, "parent_id", "left").withColumns({"owner_id": F.coalesce("owner_id", "p_owner"), "visibility": F.coalesce("visibility", "p_visibility")})
    departments = children.select("id", "parent_id").join(bridge.withColumnRenamed("document_id", "parent_id"), "parent_id")
    return scoped.drop("p_owner", "p_visibility"), departments.select(F.col("id").alias("document_id"), "department_id")


def fully_visible(runs: DataFrame, basis: str, visible: DataFrame) -> DataFrame:
    """Stored results of which every basis document is visible; an empty basis hides nothing. `runs` is keyed by `case_id`."""
    needed = runs.select("case_id", F.explode(F.array_distinct(basis)).alias("id"))
    hidden = needed.join(visible.select("id"), "id", "left_anti").select("case_id").distinct()
    return runs.join(hidden, "case_id", "left_anti")


def visible_learned(references: DataFrame, visible: DataFrame | None) -> DataFrame:
    """Owner references by hand, and learned ones whose document is visible; without a user only the former."""
    by_hand = references.filter("learned_from IS NULL")
    if visible is None:
        return by_hand
    seen = references.join(visible.select(F.col("id").alias("learned_from")), "learned_from", "left_semi")
    return by_hand.unionByName(seen.select(*references.columns))
