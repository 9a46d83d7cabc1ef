"""Best representative of each duplicate group (problem 1).

Every field of every record is unpivoted into one long row (group, field, value, record, vote); a vote is the trust in the
record's source times the decay of its age; votes are summed per normalised value, the value with the most votes wins its
field by ``max_by``, and the winners are pivoted back into one record per group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.paths import is_preprocessed
from inkwell.runtime import materialise

#: Age of a record without a date.
OLDEST_DAYS = 3650.0
#: Half-lives from ``as_of`` beyond which ages count alike (49 years at 180 days), so that no vote becomes nothing.
MOST_HALF_LIVES = 100
#: A trust that outweighs any number of votes of any age: 2 to the bits of a count and of the decay on both sides.
OUTWEIGHS = 2.0 ** (63 + 2 * MOST_HALF_LIVES)


@dataclass(frozen=True)
class Field:
    """A field of the surviving record: its normalised value (as text; null values don't vote), the trust in the record for
    this field, the days in which a vote loses half its weight, and what decides between values with equal
    votes, larger first; then the larger text wins. Of the voters for the winning value the one with the largest ``best`` (or
    ``ties``) is its voter, whose own values stand for it. With ``listed``, all values come along with their voters."""

    name: str
    value: Column
    trust: Column
    half_life_days: float = 180.0
    ties: Column | None = None
    best: Column | None = None
    listed: bool = False


def confidence_of(col: str = "confidence") -> Column:
    """Confidence as a share: above 1 it is a percentage; null and NaN count as 0."""
    c = F.when(F.isnan(col), None).otherwise(F.col(col))
    return F.coalesce(F.when(c > 1, c / 100).otherwise(c), F.lit(0.0))


def fuse_groups(records: DataFrame, group: str, record: str, fields: list[Field], age_days: Column | None = None) -> DataFrame:
    """One row per group: the winning value of each field (text), ``<field>_votes``, what it won with, and ``<field>_voter``, the
    record (bigint) that stands for it; of a listed field also ``<field>_all``, an array of its values (value, voter).

    A group whose records all lack a field gets null there; rows with a null group are left out; repeated rows vote once
    each; sums are compared by their logarithm to nine digits, so that old groups are told apart as well as new ones; ties go by
    ``Field.ties`` of the best voter, then by the larger text. Votes are added up before they are shuffled and keyed by
    (group, field, value), so that a group with a third of all rows still spreads; a ballot carries its voter's id and none of its
    values."""
    age = F.lit(0.0) if age_days is None else F.coalesce(age_days.cast("double"), F.lit(OLDEST_DAYS))
    none = F.lit(None).cast("struct<a: double, b: bigint, c: bigint>")

    def rank(f: Field) -> Column:
        return next((c for c in (f.ties, f.best) if c is not None), none)

    def decay(f: Field) -> Column:
        return F.pow(F.lit(0.5), F.greatest(F.lit(-float(MOST_HALF_LIVES)), F.least(F.lit(float(MOST_HALF_LIVES)), age / f.half_life_days)))

    rows = [
        F.struct(F.lit(i).cast("tinyint").alias("field"), f.value.cast("string").alias("value"), (f.trust.cast("double") * decay(f)).alias("votes"), rank(f).alias("ties"), F.col(record).cast("bigint").alias("voter"))
        for i, f in enumerate(fields)
    ]
    long = records.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.explode(F.array(*rows)).alias("r")).select("g", "r.*").where("value is not null")
    ballots = long.groupBy("g", "field", "value").agg(F.sum("votes").alias("votes"), F.max("ties").alias("ties"), F.max_by("voter", "ties").alias("voter"))
    order = [F.struct(F.round(F.log2("votes"), 9).alias("v"), (none if f.ties is None else F.col("ties")).alias("ties"), F.col("value")) for f in fields]
    own = F.struct("value", "votes", "voter")
    wide = ballots.groupBy("g").agg(*[F.max_by(F.when(F.col("field") == i, own), F.when(F.col("field") == i, order[i])).alias(f"w{i}") for i in range(len(fields))], *[F.collect_list(F.when(F.col("field") == i, F.struct("value", "voter"))).alias(f"{f.name}_all") for i, f in enumerate(fields) if f.listed])
    named = [F.col(f"w{i}.{k}").alias(f.name + a) for i, f in enumerate(fields) for k, a in (("value", ""), ("votes", "_votes"), ("voter", "_voter"))]
    return wide.select("g", *named, *[f"{f.name}_all" for f in fields if f.listed]).withColumnRenamed("g", group)


def _place() -> Column:
    return F.struct(confidence_of().alias("a"), F.coalesce(-F.col("char_index").cast("bigint"), F.lit(-(2**62))).alias("b"), (-F.col("record_id")).alias("c"))


def standing_field() -> Field:
    """The survivor's election: records stand by their source_image and normalized_bbox (preprocessed and boxed, preprocessed, boxed,
    neither), each standing has the summed votes of its records, and a better one outweighs any votes for a worse one. Of the
    voters for the standing that wins, the one with the highest confidence, then the lowest char_index (null last) and
    record_id is the survivor."""
    pre, boxed = F.col("__kind") == "preprocessed", F.col("__box").isNotNull()
    value = F.concat(F.when(pre, "preprocessed").otherwise("other scan"), F.when(boxed, ", boxed").otherwise(""))
    trust = F.when(pre, OUTWEIGHS**2).otherwise(1.0) * F.when(boxed, OUTWEIGHS).otherwise(1.0)
    return Field("standing", value, trust, best=_place())


def order_fields() -> list[Field]:
    """The fields that the survivor's order compares by what they say, each voted on by all records of the group: source_image by
    its folder, where preprocessed outweighs any votes for the rest, and normalized_bbox by being there (a missing one doesn't
    vote). The pairs of both that occur are listed, each with its best record: the one of the highest confidence, then the
    lowest char_index (null last) and record_id, which are compared by size and not by votes."""
    pre, boxed = F.col("__kind") == "preprocessed", F.col("__box").isNotNull()
    place, box = F.when(pre, "preprocessed").otherwise("other scan"), F.when(boxed, "boxed")
    return [
        Field("source_image", place, F.when(pre, OUTWEIGHS).otherwise(1.0)),
        Field("normalized_bbox", box, F.when(pre, 2.0).otherwise(1.0)),
        Field("pair", F.concat_ws(",", place, box), F.lit(1.0), best=_place(), listed=True),
    ]


def survivor_of(fused: DataFrame) -> Column:
    """The record that holds the elected source_image, then the elected normalized_bbox, of what ``order_fields`` came to."""
    held = lambda p: F.struct(F.startswith(p["value"], F.col("source_image")).alias("s"), F.endswith(p["value"], F.coalesce("normalized_bbox", F.lit(""))).alias("n"), p["voter"].alias("voter"))
    return F.array_max(F.transform("pair_all", held))["voter"]


def survivor_fields(half_life_days: float = 180.0) -> list[Field]:
    """The dealt fields of a matched record, each voted on by all records of the group: source_image by its kind (a group of
    ``duplicate_groups`` lies on one page image, so that is all that differs but the spelling; data/external is another image and
    never in a group with the rest), the normalised box by its sides to three digits (a missing side is a side of its own), the
    confidence to two. The dealt values come along, from the voter that the survivor's order (confidence, char_index,
    record_id) puts first."""
    trust = F.when(F.col("__kind") == "preprocessed", 2.0).otherwise(1.0)
    return [
        Field("source_image", F.col("__kind"), trust, half_life_days, best=_place()),
        Field("normalized_bbox", F.col("__box"), trust, half_life_days, best=_place()),
        Field("confidence", F.when(confidence_of() > 0, F.floor(confidence_of() * 100 + 0.5)), trust, half_life_days, _place()),
        Field("char_index", F.col("char_index"), trust, half_life_days, best=_place()),
    ]


def best_of_groups(matched: DataFrame, groups: DataFrame, as_of: str = "2022-01-01", dealt: bool = True) -> DataFrame:
    """The fused record of each group of ``groups`` (record_id, group_id): group_id, best_record_id (bigint) and the winning values of
    ``order_fields`` with their votes, from which the survivor follows; with ``dealt`` instead the winning values of source_image, normalized_bbox, confidence and char_index with their votes, and as ``<field>_raw`` as the
    records hold them (a confidence may be a percentage). Ages are taken at ``as_of`` (another date scales all votes alike); a
    record without loaded_at counts as ten years old. Rows in no group are left out; an empty table gives no row."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("loaded_at").cast("date"))
    nb = F.col("normalized_bbox")
    sides = [F.coalesce(F.floor(nb[c] * 1000 + 0.5).cast("string"), F.lit("-")) for c in ("x", "y", "width", "height")]
    boxed = F.when(nb.isNotNull(), F.concat_ws(" ", *sides) if dealt else F.lit("box"))
    kind = F.when(is_preprocessed("source_image"), "preprocessed").when(F.col("source_image").isNotNull(), "other scan")
    as_held = [F.col("source_image").alias("__image"), nb.alias("__nb"), F.col("confidence").alias("__confidence")] if dealt else []
    slim = matched.select("record_id", kind.alias("__kind"), boxed.alias("__box"), confidence_of().cast("double").alias("confidence"), "char_index", age.alias("__age"), *as_held)
    records = slim.join(groups.select("record_id", "group_id"), "record_id")
    if not dealt:
        fused = fuse_groups(records, "group_id", "record_id", order_fields(), F.col("__age"))
        return fused.select("group_id", survivor_of(fused).alias("best_record_id"), "source_image", "source_image_votes", "normalized_bbox", "normalized_bbox_votes")
    records = materialise(records)  # read for the ballots, and again for the values of the winners' voters
    fields = survivor_fields()
    fused = materialise(fuse_groups(records, "group_id", "record_id", [standing_field(), *fields], F.col("__age")))
    voters = fused.select("group_id", F.explode(F.array(*[F.struct(F.lit(i).alias("__f"), F.col(f"{f.name}_voter").alias("record_id")) for i, f in enumerate(fields)])).alias("v")).select("group_id", "v.*").where("record_id is not null")
    held = voters.join(records.select("record_id", *[F.col(c).alias(f"__v{i}") for i, c in enumerate(("__image", "__nb", "__confidence", "char_index"))]), "record_id")
    values = held.groupBy("group_id").agg(*[F.max(F.when(F.col("__f") == i, F.col(f"__v{i}"))).alias(f"{f.name}_raw") for i, f in enumerate(fields)])
    kept = [c for f in fields for c in (f.name, f"{f.name}_votes")]
    return fused.join(values, "group_id", "left").select("group_id", F.col("standing_voter").alias("best_record_id"), *kept, *[f"{f.name}_raw" for f in fields])
