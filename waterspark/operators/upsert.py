"""Keyed upserts and table merges as joins, safe to run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waterspark.functions import clean as C


def latest_per_key(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last change per key; a partial aggregate, so a hot key shuffles one row per task."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), F.struct(*order)).alias("r")).select("r.*")


def upsert(existing: DataFrame, changes: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Replace rows by key; columns new to the table are blank on the rows that stay.

    With ``order`` the last change of a key counts; without it keys must be unique.
    """
    changes = changes if order is None else latest_per_key(changes, key, order)
    added = [c for c in changes.columns if c not in existing.columns]
    kept = existing.join(changes.select(key), key, "left_anti").withColumns({c: F.lit("") for c in added})
    return kept.select(*existing.columns, *added).unionByName(changes, allowMissingColumns=True)


def union_columns(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union with the columns of both in first-seen order; gaps are blank."""
    joined = first.unionByName(second, allowMissingColumns=True)
    return joined.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in joined.columns])


def replace_generated(existing: DataFrame, generated: DataFrame, source: str = "local_img") -> DataFrame:
    """Generated rows plus the existing rows of other sources."""
    if "source" not in existing.columns:
        return generated
    kept = existing.where(F.coalesce("source", F.lit("")) != source)
    return generated.unionByName(kept, allowMissingColumns=True)


def merge_selection(existing: DataFrame, generated: DataFrame, key: str = "scope_key", value: str = "product") -> DataFrame:
    """Union of two selections; what exists wins."""
    e, g = existing.select(key, F.col(value).alias("_e")), generated.select(key, F.col(value).alias("_g"))
    return e.join(g, key, "full").select(key, F.coalesce("_e", "_g").alias(value))


def patch_rows(table: DataFrame, patches: DataFrame, key: str, allowed: list[str], order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Update the allowed columns where a patch has a value (NULL = not given).

    Values are cleaned, so that "nan" and blanks are blank. Several patches of a key act
    one after another in ``order`` (the largest value last, if no order is given), each on
    the columns that it has. Returns the table and the joint patches of unknown keys.
    """
    fields = [c for c in allowed if c in patches.columns]
    last = [
        F.max(F.when(F.col(c).isNotNull(), F.struct(*(order or []), C.first_present(F.col(c), default="").alias("_v"))))["_v"].alias(f"_p_{c}")
        for c in fields
    ]
    joint = patches.groupBy(key).agg(*last)
    out = table.join(joint, key, "left").withColumns({c: F.coalesce(F.col(f"_p_{c}"), F.col(c)) for c in fields})
    odd = joint.join(table.select(key), key, "left_anti")
    return out.select(*table.columns), odd.select(key, *[F.col(f"_p_{c}").alias(c) for c in fields])


def delete_rows(table: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and the keys that were not there."""
    return table.join(keys.select(key), key, "left_anti"), keys.select(key).distinct().join(table.select(key), key, "left_anti")
