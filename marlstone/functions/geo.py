"""Geographic codes: coordinates as interleaved bits, boxes, and distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 28


def from_dms(value: Column) -> Column:
    """Degrees from a DDDMMSS integer."""
    v = F.abs(value.cast("long"))
    return F.signum(value) * (F.floor(v / 10000) + F.floor(F.pmod(v, F.lit(10000)) / 100) / 60 + F.pmod(v, F.lit(100)) / 3600)


def _spread(x: Column) -> Column:
    """A zero bit before each bit of a number below 2**BITS."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _gather(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _cell(degrees: Column, span: int) -> Column:
    at = F.floor((degrees + span / 2) / span * (1 << BITS)).cast("long")
    return F.least(F.greatest(at, F.lit(0).cast("long")), F.lit((1 << BITS) - 1).cast("long"))


def encode(lat: Column, lon: Column) -> Column:
    """Code whose order keeps near places near: bits of latitude and longitude in turn."""
    return F.shiftleft(_spread(_cell(lat, 180)), 1).bitwiseOR(_spread(_cell(lon, 360)))


def decode(code: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a cell's centre."""
    lat, lon = _gather(F.shiftright(code, 1)), _gather(code)
    return (lat + 0.5) * 180 / (1 << BITS) - 90, (lon + 0.5) * 360 / (1 << BITS) - 180


def box_range(south: Column, west: Column, north: Column, east: Column) -> tuple[Column, Column]:
    """Least and greatest code in a box; codes between them may lie outside it."""
    return encode(south, west), encode(north, east)


def in_box(lat: Column, lon: Column, south: Column, west: Column, north: Column, east: Column) -> Column:
    """The code range prunes, the coordinates decide."""
    low, high = box_range(south, west, north, east)
    code = encode(lat, lon)
    return (code >= low) & (code <= high) & lat.between(south, north) & lon.between(west, east)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere of 6,371,008.8 m radius."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371008.8) * F.asin(F.sqrt(h))


def region_join(points: DataFrame, regions: DataFrame, step: float = 10.0) -> DataFrame:
    """Points (lat, lon, ...) with the regions (south, west, north, east, ...) that hold them.

    A region is spread over the square cells it touches, a point has one cell; the join is on cells,
    and coordinates decide. step should be near the usual size of a region.
    """
    cell = lambda c: F.floor(F.col(c) / step).cast("int")
    p = points.withColumn("_y", cell("lat")).withColumn("_x", cell("lon"))
    r = regions.withColumn("_y", F.explode(F.sequence(cell("south"), cell("north")))).withColumn("_x", F.explode(F.sequence(cell("west"), cell("east"))))
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    return p.join(r, ["_y", "_x"]).where(inside).drop("_y", "_x")
