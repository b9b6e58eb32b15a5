"""Points and rings from the JSON of a map service, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEMA = "elements array<struct<type: string, id: long, lat: double, lon: double, center: struct<lat: double, lon: double>, geometry: array<struct<lat: double, lon: double>>, tags: map<string,string>>>"


def elements(json: Column) -> Column:
    """The elements of a reply; malformed or missing is none."""
    return F.coalesce(F.from_json(json, _SCHEMA)["elements"], F.from_json(F.lit('{"elements": []}'), _SCHEMA)["elements"])


def points(json: Column) -> Column:
    """(id, lat, lon) of the nodes, and of the centres of other elements; what has neither is left out."""
    at = F.transform(elements(json), lambda e: F.struct(e["id"].alias("id"), F.coalesce(e["lat"], e["center"]["lat"]).alias("lat"), F.coalesce(e["lon"], e["center"]["lon"]).alias("lon")))
    return F.filter(at, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())


def ways(json: Column, least: int = 4) -> Column:
    """(id, name, ring) of the ways that have a ring of at least so many points."""
    rings = F.filter(elements(json), lambda e: (e["type"] == "way") & (F.coalesce(F.size(e["geometry"]), F.lit(0)) >= least))
    return F.transform(rings, lambda e: F.struct(e["id"].alias("id"), F.try_element_at(e["tags"], F.lit("name")).alias("name"), e["geometry"].alias("ring")))
