"""Left joins that hold up under hot keys, and size-checked lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumarole.session import SMALL_ROWS, small_table

#: A key with more than this share of the left rows is joined apart from the others.
HOT_SHARE = 0.001
#: Rows below which a key is never worth a join of its own.
HOT_ROWS = 100_000


def lookup(
    df: DataFrame, table: DataFrame, on: str | Sequence[str], max_rows: int = SMALL_ROWS
) -> DataFrame:
    """Left join with a lookup table that is broadcast only if its size proves small.

    Besides the keys the sides must not share columns.
    """
    keys = [on] if isinstance(on, str) else list(on)
    reject_shared(df, table, keys)
    added = [c for c in table.columns if c not in keys]
    return df.join(small_table(table, max_rows), keys, "left").select(*df.columns, *added)


def assert_unique(df: DataFrame, key: str) -> None:
    """Raise if a non-null key occurs twice."""
    twice = df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"duplicate {key}: {[row[0] for row in twice]}")


def hot_keys(
    df: DataFrame, key: str, share: float = HOT_SHARE, min_rows: int = HOT_ROWS
) -> list[object]:
    """Keys holding more than ``share`` of the rows, fewer than ``1 / share`` by construction."""
    counts = df.groupBy(key).count().persist(StorageLevel.DISK_ONLY)
    try:
        total = counts.agg(F.sum("count")).first()[0] or 0
        heavy = counts.where(F.col("count") > max(total * share, min_rows))
        return [row[0] for row in heavy.collect()]
    finally:
        counts.unpersist()


def reject_shared(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    """Raise if both sides have a column besides the keys: a join would make it ambiguous."""
    shared = sorted(set(left.columns) & set(right.columns) - set(keys))
    if shared:
        raise ValueError(f"columns on both sides of a join: {shared}")


def skew_safe_left_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    null_safe: bool = False,
    share: float = HOT_SHARE,
    min_rows: int = HOT_ROWS,
    max_right: int = SMALL_ROWS,
) -> DataFrame:
    """Left join on one key, whatever share of the left rows a key holds.

    Rows under a hot key are never shuffled: the few right rows of hot keys are broadcast to
    them. Null keys never match (unless ``null_safe``) and skip the join. All other rows take
    an ordinary shuffled join. If the right side has too many rows under hot keys for a
    broadcast, their join is left to the adaptive skew handling.
    """
    reject_shared(left, right, [key])
    added = [c for c in right.columns if c != key]
    columns = [*left.columns, *added]

    def joined(part: DataFrame, table: DataFrame) -> DataFrame:
        renamed = table.withColumnRenamed(key, "_right_key")
        same = part[key].eqNullSafe(renamed["_right_key"]) if null_safe else part[key] == renamed["_right_key"]
        return part.join(renamed, same, "left").select(*columns)

    def unmatched(part: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType for f in right.schema.fields}
        return part.select(*left.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in added])

    hot = hot_keys(left, key, share, min_rows)
    named = [k for k in hot if k is not None]
    if not null_safe and None in hot:
        gaps, left = left.where(F.col(key).isNull()), left.where(F.col(key).isNotNull())
        return _split_join(left, right, key, named, False, max_right, joined).unionByName(unmatched(gaps))
    return _split_join(left, right, key, named, null_safe and None in hot, max_right, joined)


def _split_join(left, right, key, named, with_null, max_right, joined):
    if not named and not with_null:
        return joined(left, right)
    is_hot = F.col(key).isin(named) if named else F.lit(False)
    is_hot = F.coalesce(is_hot, F.lit(False)) | (F.col(key).isNull() if with_null else F.lit(False))
    hot_side = joined(left.where(is_hot), small_table(right.where(is_hot), max_right))
    return hot_side.unionByName(joined(left.where(~is_hot), right.where(~is_hot)))


def merge_financials(
    emissions: DataFrame,
    financials: DataFrame,
    fill: bool = True,
    null_safe: bool = False,
    unique_right: bool = False,
    key: str = "ticker",
) -> DataFrame:
    """Left join the financials extract on ticker.

    Columns both sides have are kept from the emissions side; with ``fill`` its nulls are
    taken from the extract, without it the extract's copies are dropped. A ticker that
    occurs twice in the extract multiplies rows; ``unique_right`` rejects that.
    """
    if key not in financials.columns or key not in emissions.columns:
        return emissions
    if unique_right:
        assert_unique(financials, key)
    shared = [c for c in financials.columns if c in emissions.columns and c != key]
    if not fill:
        return skew_safe_left_join(emissions, financials.drop(*shared), key, null_safe)
    extract = financials.withColumnsRenamed({c: f"_fin_{c}" for c in shared})
    merged = skew_safe_left_join(emissions, extract, key, null_safe)
    filled = {c: F.coalesce(F.col(c), F.col(f"_fin_{c}")) for c in shared}
    return merged.withColumns(filled).drop(*[f"_fin_{c}" for c in shared])


def merge_indicators(df: DataFrame, indicators: DataFrame, null_safe: bool = False) -> DataFrame:
    """Left join the country indicators (one row per country, broadcast after a size check)."""
    if "country" not in indicators.columns or "country" not in df.columns:
        return df
    return skew_safe_lookup(df, indicators, "country", null_safe)


def skew_safe_lookup(df: DataFrame, table: DataFrame, key: str, null_safe: bool) -> DataFrame:
    if not null_safe:
        return lookup(df, table, key)
    renamed = small_table(table).withColumnRenamed(key, "_right_key")
    added = [c for c in table.columns if c != key]
    return df.join(renamed, df[key].eqNullSafe(renamed["_right_key"]), "left").select(*df.columns, *added)
