"""Answers in the form of JSON:API: their references, resolved within the answer that has them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFERENCE = "struct<type:string,id:string>"
RESOURCE = "array<struct<type:string,id:string,attributes:string,relationships:map<string,struct<data:string>>>>"


def _listed(json: Column, kind: str) -> Column:
    """The elements of a JSON array, or the one element that stands in its place; none for anything else."""
    trimmed = F.trim(json)
    whole = F.when(trimmed.startswith("["), trimmed).when(trimmed.startswith("{"), F.concat(F.lit("["), trimmed, F.lit("]")))
    return F.coalesce(F.from_json(whole, kind), F.array().cast(kind))


def resources(payloads: DataFrame, key: str, part: str, column: str = "payload") -> DataFrame:
    """key, place, type, id, attributes (JSON) and relationships of the resources in a part of each answer, data or included.

    An answer that is null or no JSON has none.
    """
    rows = payloads.select(key, F.posexplode(_listed(F.get_json_object(column, f"$.{part}"), RESOURCE)).alias("place", "r"))
    return rows.select(key, "place", "r.*")


def references(payloads: DataFrame, key: str, column: str = "payload") -> DataFrame:
    """key, from_type, from_id, relation, place, type and id: what the main resources of each answer refer to, without references that have no id."""
    rows = resources(payloads, key, "data", column).select(key, F.col("type").alias("from_type"), F.col("id").alias("from_id"), F.explode("relationships").alias("relation", "target"))
    rows = rows.select(key, "from_type", "from_id", "relation", F.posexplode(_listed(F.col("target.data"), f"array<{REFERENCE}>")).alias("place", "t"))
    return rows.select(key, "from_type", "from_id", "relation", "place", "t.type", "t.id").filter("id <> ''")


def resolved(payloads: DataFrame, key: str, column: str = "payload") -> DataFrame:
    """references() with the attributes (JSON) of the resource among the answer's own included ones, null if it isn't there.

    Of included resources with equal type and id the first counts.
    """
    known = resources(payloads, key, "included", column).groupBy(key, "type", "id").agg(F.min_by("attributes", "place").alias("attributes"))
    return references(payloads, key, column).join(known, [key, "type", "id"], "left").select(key, "from_type", "from_id", "relation", "place", "type", "id", "attributes")


def matches_of(payloads: DataFrame, key: str, column: str = "payload") -> DataFrame:
    """key, place and match: the matches that the first player of each answer refers to."""
    first = resources(payloads, key, "data", column).filter("place = 0").select(key, F.posexplode(_listed(F.try_element_at("relationships", F.lit("matches"))["data"], f"array<{REFERENCE}>")).alias("place", "t"))
    return first.select(key, "place", F.col("t.id").alias("match")).filter("match <> ''")


def telemetry_of(payloads: DataFrame, key: str, column: str = "payload") -> DataFrame:
    """key and url: where each match's first asset with an address has its telemetry."""
    assets = resources(payloads, key, "included", column).filter("type = 'asset'").select(key, "place", F.get_json_object("attributes", "$.URL").alias("url"))
    return assets.filter("url <> ''").groupBy(key).agg(F.min_by("url", "place").alias("url"))
