"""Normalising and filtering review items: states, paths and predicates as Column expressions over flat columns
``filter_status, review_status, decision``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTER_STATES = ("pending", "accepted", "rejected")
REVIEW_STATES = ("pending", "confirmed", "dropped")


def filter_state(status: Column, review: Column) -> Column:
    """A filter status as stored; an unknown one is accepted if the review confirmed the item, else pending."""
    return F.when(status.isin(*FILTER_STATES), status).when(review.eqNullSafe(F.lit("confirmed")), F.lit("accepted")).otherwise(F.lit("pending"))


def review_state(status: Column, decision: Column) -> Column:
    """A review status as stored; an unknown one is dropped if the decision is to drop, else pending."""
    return F.when(status.isin(*REVIEW_STATES), status).when(decision.eqNullSafe(F.lit("drop")), F.lit("dropped")).otherwise(F.lit("pending"))


def decision_or_default(decision: Column, state: Column) -> Column:
    return F.coalesce(F.nullif(decision, F.lit("")), F.when(state == "dropped", F.lit("drop")).otherwise(F.lit("need")))


def normalised(items: DataFrame) -> DataFrame:
    """The items with filter_status, review_status and decision in their defined forms."""
    state = review_state(F.col("review_status"), F.col("decision"))
    return items.withColumns({"filter_status": filter_state(F.col("filter_status"), F.col("review_status")), "review_status": state}).withColumn("decision", decision_or_default(F.col("decision"), F.col("review_status")))


def is_dropped() -> Column:
    return (F.col("review_status") == "dropped") | F.col("decision").eqNullSafe(F.lit("drop"))


def accepted(items: DataFrame) -> DataFrame:
    return items.where(~is_dropped() & (F.col("filter_status") == "accepted"))


def confirmed(items: DataFrame) -> DataFrame:
    return accepted(items).where((F.col("review_status") == "confirmed") & ~F.col("decision").eqNullSafe(F.lit("drop")))


def confirmed_path(confirmed: Column, segmented: Column) -> Column:
    """The confirmed path, else the segmented one below the folder of confirmed images."""
    return F.coalesce(F.nullif(confirmed, F.lit("")), F.regexp_replace(F.nullif(segmented, F.lit("")), "(^|/)segmented/", "$1confirmed/"))


def legacy_entry(items: DataFrame) -> DataFrame:
    """The legacy form of a review state: pending is unreviewed, an empty decision unknown."""
    return items.withColumns({"status": F.when(F.col("review_status") == "pending", F.lit("unreviewed")).otherwise(F.col("review_status")), "legacy_decision": F.coalesce(F.nullif("decision", F.lit("")), F.lit("unknown"))})


def from_legacy(items: DataFrame) -> DataFrame:
    """Back from ``status, legacy_decision``; a confirmed item that says drop needs the glyph after all."""
    state = F.when(F.col("status") == "unreviewed", F.lit("pending")).otherwise(F.col("status"))
    decided = F.when((F.col("status") == "confirmed") & (F.col("legacy_decision") == "drop"), F.lit("need")).when(F.col("legacy_decision") == "unknown", F.lit("")).otherwise(F.col("legacy_decision"))
    return items.withColumns({"review_status": state, "decision": decided})


def latest(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order`` (ascending, ending in a unique column). ``max_by`` over the order, so that each task
    hands on one row per key, however many rows a key has."""
    record = F.struct(*[F.col(f"`{c}`") for c in log.columns])
    picked = log.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(record, F.struct(*order)).alias("r"))
    return picked.select("r.*")


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str = "__rn") -> DataFrame:
    """The first ``n`` rows of each key with their rank; Spark limits the groups before it shuffles them."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], insert: bool = True) -> DataFrame:
    """``current`` with the rows of ``changes`` (same columns, one row per key) in place of those with the same key; rows of new keys
    are added only with ``insert``. Null keys match nothing."""
    new = changes.select(*current.columns)
    kept = current.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new if insert else new.join(current.select(*keys).distinct(), keys, "left_semi"))
