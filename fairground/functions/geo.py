"""Distances, grids and viewports as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres; the sphere's radius that distances are taken with.
EARTH_KM = 6371


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance on a sphere."""
    lat1, lon1, lat2, lon2 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians((lat2 - lat1) / 2)), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians((lon2 - lon1) / 2)), 2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * 2 * EARTH_KM


def md5_byte(text: Column, index: int) -> Column:
    """A byte of the md5 of ``text``, 0 to 255."""
    return F.conv(F.substring(F.md5(text.cast("string").cast("binary")), 2 * index + 1, 2), 16, 10).cast("int")


def jitter(text: Column, index: int, width: float) -> Column:
    """A fixed offset of up to half of ``width``, so that events of one city don't cover each other."""
    return (md5_byte(text, index) / F.lit(255.0) - 0.5) * width


def grid_zoom(zoom: float) -> int:
    return math.floor(max(0.0, zoom - 1.5))


def grid_cell(lat: Column, lon: Column, z: int) -> tuple[Column, Column]:
    """(cell_y, cell_x): cells of 360 / 2^(z+4) by 180 / 2^(z+3) degrees."""
    return F.floor((lat + 90) / (180 / 2 ** (z + 3))).cast("int"), F.floor((lon + 180) / (360 / 2 ** (z + 4))).cast("int")


def place_cell(lat: Column, lon: Column, zoom: float) -> tuple[Column, Column]:
    """Cells of 90 / 2^z by 180 / 2^z degrees, z from 0 to 11."""
    z = max(0, min(11, math.floor(zoom)))
    return F.floor((lat + 90) / (90 / 2**z)).cast("int"), F.floor((lon + 180) / (180 / 2**z)).cast("int")


@dataclass(frozen=True)
class Viewport:
    west: float
    south: float
    east: float
    north: float

    def valid(self) -> bool:
        return all(map(math.isfinite, (self.west, self.south, self.east, self.north))) and -90 <= self.south < self.north <= 90 and -180 <= self.west <= 180 and -180 <= self.east <= 180 and self.west != self.east

    def holds(self, lat: Column, lon: Column) -> Column:
        """Inside the box; a box whose west is past its east crosses the date line."""
        if not self.valid():
            return F.lit(False)
        if (self.west, self.south, self.east, self.north) == (-180, -90, 180, 90):
            return lat.isNotNull() & lon.isNotNull()
        across = lon.between(self.west, self.east) if self.west <= self.east else (lon >= self.west) | (lon <= self.east)
        return lat.between(self.south, self.north) & across

    def segments(self) -> list[tuple[float, float]]:
        return [(self.west, self.east)] if self.west <= self.east else [(self.west, 180.0), (-180.0, self.east)]

    def contains(self, other: Viewport) -> bool:
        """Whether ``other`` lies in this box, date line or not."""
        return self.south <= other.south and other.north <= self.north and all(any(w <= a and b <= e for w, e in self.segments()) for a, b in other.segments())

    def snapped(self, zoom: float) -> Viewport:
        """Grown outward to whole cells of the zoom, so that small moves ask for the same box."""
        step = 360 / 2 ** max(0, math.floor(zoom))
        down, up = (lambda x: math.floor(x / step) * step), (lambda x: math.ceil(x / step) * step)
        return Viewport(max(-180, down(self.west)), max(-90, down(self.south)), min(180, up(self.east)), min(90, up(self.north)))


def wrap_longitude(lon: float) -> float:
    return (lon + 180) % 360 - 180


def radius_for_population(population: Column) -> Column:
    """Kilometres to search around a city; the least where its population isn't known."""
    return F.when(population >= 5_000_000, 18).when(population >= 1_000_000, 15).when(population >= 250_000, 12).when(population >= 50_000, 10).otherwise(8)


def checked_pair(lat: Column, lon: Column, city_lat: Column, city_lon: Column, max_km: float) -> Column:
    """struct(latitude, longitude): both or none; in range; not too far from the city."""
    far = city_lat.isNotNull() & city_lon.isNotNull() & (haversine_km(city_lat, city_lon, lat, lon) > max_km)
    fine = lat.isNotNull() & lon.isNotNull() & lat.between(-90, 90) & lon.between(-180, 180) & ~F.coalesce(far, F.lit(False))
    return F.struct(F.when(fine, lat).alias("latitude"), F.when(fine, lon).alias("longitude"))
