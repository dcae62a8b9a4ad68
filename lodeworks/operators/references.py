"""References to records that do not exist.

Parent keys and child keys are unioned in long form under tags and grouped by
parent table and key with map-side combine, so a key that holds a third of all
references shrinks before the shuffle. Keys without a live parent, or with a
child older than the parent, are the suspects; only those meet the children
again, in a join on which adaptive execution splits hot keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.common import union_all, utc_month


@dataclass(frozen=True)
class Children:
    """References: df has record_id STRING, ref STRING, at BIGINT (UTC microseconds)."""

    table: str
    field: str
    parent_table: str
    df: DataFrame


def _long(parents: dict[str, DataFrame], children: list[Children]) -> DataFrame:
    """parents: by name, (ref STRING, since BIGINT, gone BOOLEAN), one row per key."""
    rows = [
        df.select(F.lit(name).alias("parent_table"), "ref", F.lit(True).alias("is_parent"), F.col("since").alias("since"), F.col("gone").alias("gone"), F.lit(None).cast("bigint").alias("first_at"))
        for name, df in parents.items()
    ]
    rows += [
        c.df.where("ref is not null").select(F.lit(c.parent_table).alias("parent_table"), "ref", F.lit(False).alias("is_parent"), F.lit(None).cast("bigint").alias("since"), F.lit(None).cast("boolean").alias("gone"), F.col("at").alias("first_at"))
        for c in children
    ]
    return union_all(rows)


def orphans(parents: dict[str, DataFrame], children: list[Children]) -> DataFrame:
    """One row per orphan reference: table_name, field, record_id, ref, at, reason.

    A reference whose key is null refers to nothing and is no orphan; reasons
    are ``missing`` (no parent row), ``removed`` and ``later`` (the parent came
    into being after the referring row). A child without time can only be missing or
    removed. Empty tables give no rows.
    """
    keys = (
        _long(parents, children)
        .groupBy("parent_table", "ref")
        .agg(F.max("is_parent").alias("has_parent"), F.max("since").alias("since"), F.max("gone").alias("gone"), F.min("first_at").alias("first_at"))
        .where(F.expr("not has_parent or gone or first_at < since"))
        .select("parent_table", "ref", "has_parent", "since", "gone")
    )
    kids = union_all([
        c.df.where("ref is not null").select(F.lit(c.table).alias("table_name"), F.lit(c.field).alias("field"), F.lit(c.parent_table).alias("parent_table"), "record_id", "ref", "at")
        for c in children
    ])
    return (
        kids.join(keys, ["parent_table", "ref"])
        .where(F.expr("not has_parent or gone or at < since"))
        .select("table_name", "field", "record_id", "ref", "at", F.expr("case when not has_parent then 'missing' when gone then 'removed' else 'later' end").alias("reason"))
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, field, UTC month and reason."""
    return found.groupBy("table_name", "field", utc_month(F.col("at")).alias("period"), "reason").agg(F.count("*").alias("orphans"))
