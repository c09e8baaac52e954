"""Web map tiles, Mercator, Morton codes and tile keys as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mercator ends at this latitude (fixed value).
MAX_LAT = 85.0511287798066
#: Radius of the Mercator sphere in metres (fixed value).
MERCATOR_M = 6_378_137.0


def mercator_x(lon: Column) -> Column:
    """0 to 1 from west to east."""
    return (lon + 180.0) / 360.0


def mercator_y(lat: Column) -> Column:
    """0 to 1 from north to south, latitudes clamped."""
    a = F.radians(F.least(F.greatest(lat, F.lit(-MAX_LAT)), F.lit(MAX_LAT)))
    return (1.0 - F.log(F.tan(a) + 1.0 / F.cos(a)) / math.pi) / 2.0


def mercator_lon(x: Column) -> Column:
    return x * 360.0 - 180.0


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y))))


def web_metres(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator metres."""
    return F.radians(lon) * MERCATOR_M, (1.0 - 2.0 * mercator_y(lat)) * math.pi * MERCATOR_M


def _clamped(v: Column, zoom: Column | int) -> Column:
    n = F.pow(F.lit(2.0), zoom if isinstance(zoom, Column) else F.lit(zoom))
    return F.least(F.greatest(F.floor(v * n), F.lit(0)), (n - 1).cast("long"))


def tile_x(lon: Column, zoom: Column | int) -> Column:
    return _clamped(mercator_x(lon), zoom)


def tile_y(lat: Column, zoom: Column | int) -> Column:
    return _clamped(mercator_y(lat), zoom)


def tile_key(zoom: Column, x: Column, y: Column) -> Column:
    """One number per tile: zoom, x and y in 5, 29 and 29 bits."""
    return zoom.cast("long") * F.lit(1 << 58) + x.cast("long") * F.lit(1 << 29) + y.cast("long")


def tile_key_at(lon: Column, lat: Column, zoom: Column) -> Column:
    return tile_key(zoom, tile_x(lon, zoom), tile_y(lat, zoom))


def tile_zxy(key: Column) -> Column:
    return F.struct(F.floor(key / (1 << 58)).cast("int").alias("z"), (F.shiftright(key, 29) % (1 << 29)).cast("int").alias("x"), (key % (1 << 29)).cast("int").alias("y"))


def morton(x: Column, y: Column, bits: int) -> Column:
    """Interleaved bits of x (even places) and y (odd places)."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out + (F.floor(x / (1 << i)) % 2) * F.lit(1 << (2 * i)) + (F.floor(y / (1 << i)) % 2) * F.lit(1 << (2 * i + 1))
    return out.cast("long")


def tile_box(z: Column, x: Column, y: Column) -> Column:
    """Bounds of a tile in degrees."""
    n = F.pow(F.lit(2.0), z)
    return F.struct(mercator_lon(x / n).alias("west"), mercator_lat((y + 1) / n).alias("south"), mercator_lon((x + 1) / n).alias("east"), mercator_lat(y / n).alias("north"))


def neighbour_tiles(x: Column, y: Column, zoom: int) -> Column:
    """Array of struct(x, y): the tile and its eight neighbours; x wraps, y ends at the map's edge."""
    n = 1 << zoom
    ys = F.filter(F.array(y - 1, y, y + 1), lambda v: (v >= 0) & (v < n))
    xs = F.array_distinct(F.transform(F.array(x - 1, x, x + 1), lambda v: F.pmod(v, F.lit(n))))
    return F.flatten(F.transform(ys, lambda b: F.transform(xs, lambda a: F.struct(a.alias("x"), b.alias("y")))))


def lon_span(west: Column, east: Column) -> Column:
    """Degrees from west to east, over the date line if need be."""
    return F.pmod(east - west, F.lit(360.0))
