"""Catalogue search: filters, newest first, whether there is more, and a summary."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, MODES, ORBITS, PRODUCTS = 10, ("IW", "EW", "SM", "WV"), ("ascending", "descending"), ("GRD", "SLC")
#: Kilometres of a degree (fixed values).
LON_KM, LAT_KM = 111.32, 110.57


def normalise(scenes: DataFrame) -> DataFrame:
    """One row an id (the one ingested first): one spelling of platform, acquired as a timestamp, no nulls among
    the polarisations."""
    s = scenes.withColumn("platform", F.regexp_replace(F.lower(F.trim("platform")), r"[\s_]+", "-")).withColumn("acquired", F.to_timestamp("acquired"))
    s = s.withColumn("polarisations", F.array_sort(F.filter(F.coalesce("polarisations", F.array()), lambda p: p.isNotNull())))
    names = [c for c in s.columns if c != "id"]
    first = F.min_by(F.struct(*names), F.struct(F.col("ingested_at"), F.to_json(F.struct(*names))))
    return s.where("id is not null").groupBy("id").agg(first.alias("x")).select("id", "x.*")


def search(scenes: DataFrame, start: str | None = None, end: str | None = None, limit: int = LIMIT, **equal) -> DataFrame:
    """The newest scenes of a closed range of days, limit + 1 of them: one more than asked tells that there is more.

    equal: column = value filters, those with None don't count.
    """
    terms = [F.col(c) == v for c, v in equal.items() if v is not None]
    if start is not None:
        terms.append(F.col("acquired") >= F.lit(f"{start} 00:00:00").cast("timestamp"))
    if end is not None:
        terms.append(F.col("acquired") <= F.lit(f"{end} 23:59:59").cast("timestamp"))
    found = scenes.where(reduce(lambda a, b: a & b, terms)) if terms else scenes
    return found.orderBy(F.col("acquired").desc(), "id").limit(limit + 1)


def intersects(west: float, south: float, east: float, north: float):
    """Predicate on columns west, south, east, north: boxes that share a point."""
    return (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)


def satellite(platform):
    """halcyon-3c as Halcyon-3C."""
    return F.concat(F.initcap(F.regexp_extract(platform, "^([a-z]+)", 1)), F.upper(F.regexp_extract(platform, "^[a-z]+(.*)$", 1)))


def passes(scenes: DataFrame) -> DataFrame:
    """Scenes of one day, satellite, orbit and track are one pass: (day, platform, orbit, relative_orbit, scenes)."""
    return scenes.groupBy(F.to_date("acquired").alias("day"), "platform", "orbit", "relative_orbit").agg(F.count("*").alias("scenes"))


def summary(scenes: DataFrame) -> DataFrame:
    """One row: scenes, passes, satellites and days."""
    day = F.to_date("acquired")
    key = F.struct(day, "platform", F.coalesce("orbit", F.lit("")), F.coalesce("relative_orbit", F.lit(-1)))
    return scenes.agg(F.count("*").alias("scenes"), F.count_distinct(key).alias("passes"), F.count_distinct("platform").alias("satellites"), F.count_distinct(day).alias("days"))


def tracks(scenes: DataFrame) -> DataFrame:
    """(orbit, tracks): the tracks of each orbit direction, ascending, as text."""
    return scenes.where("orbit is not null").groupBy("orbit").agg(F.array_join(F.transform(F.array_sort(F.collect_set("relative_orbit")), lambda x: x.cast("string")), ", ").alias("tracks"))


def mode_counts(scenes: DataFrame) -> DataFrame:
    return scenes.groupBy(F.concat_ws(" ", "mode", F.array_join("polarisations", "+")).alias("mode")).agg(F.count("*").alias("scenes"))


def scene_line():
    """One scene as a row of a table."""
    return F.format_string("%s  %s %s %s %s track %s %s", F.date_format("acquired", "yyyy-MM-dd HH:mm"), satellite(F.col("platform")), "mode", F.array_join("polarisations", "+"), F.coalesce("orbit", F.lit("-")), F.coalesce(F.col("relative_orbit").cast("string"), F.lit("-")), "id")


def item_url(base: str, collection: str):
    return F.concat(F.lit(f"{base.rstrip('/')}/collections/{collection}/items/"), "id")


@dataclass(frozen=True)
class Place:
    name: str
    kind: str
    west: float
    south: float
    east: float
    north: float

    def size_km(self) -> tuple[float, float]:
        from math import cos, radians

        return (self.east - self.west) * LON_KM * cos(radians((self.south + self.north) / 2)), (self.north - self.south) * LAT_KM


class SmallPlace(ValueError):
    """A place below a kilometre, which is often another one than meant."""


def guard_place(place: Place, confirmed: set[str], confirm: bool = False) -> None:
    """Raises once a name for a small place, unless it is confirmed."""
    if max(place.size_km()) < 1 and not confirm and place.name not in confirmed:
        confirmed.add(place.name)
        raise SmallPlace(f"{place.name} is a {place.kind} below 1 km; ask again to confirm")


def resolve_days(today: dt.date, days: int | str | None = None, start: str | None = None, end: str | None = None) -> tuple[str, str]:
    """Closed range of days: ``days`` back from today wins; else start and end, end today if it is missing."""
    if days is not None:
        if isinstance(days, str) and not days.isdigit() or int(days) < 1:
            raise ValueError("days is a positive number")
        return (today - dt.timedelta(days=int(days))).isoformat(), today.isoformat()
    if start is None:
        raise ValueError("give days, or start")
    try:
        a, b = dt.date.fromisoformat(start), dt.date.fromisoformat(end) if end else today
    except ValueError as e:
        raise ValueError("dates are YYYY-MM-DD") from e
    if a > b:
        raise ValueError("start is after end")
    return a.isoformat(), b.isoformat()


def check_filters(mode: str | None = None, orbit: str | None = None, product: str | None = None) -> None:
    for name, value, allowed in (("mode", mode, MODES), ("orbit", orbit, ORBITS), ("product", product, PRODUCTS)):
        if value is not None and value not in allowed:
            raise ValueError(f"{name} is one of {', '.join(allowed)}")
