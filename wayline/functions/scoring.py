"""Scores of road samples, rides and landmarks as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayline import constants as C


def bit(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def clamp_between(c: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(c, low), high)


def drive_components(ch: Column) -> list[Column]:
    """Twelve values from 0 to 1 of a sample's 13 channels (array of 0..255, in the order of CHANNELS)."""
    at = {n: F.get(ch, F.lit(i)).cast("double") for i, n in enumerate(C.CHANNELS)}
    flags = F.get(ch, F.lit(C.CHANNELS.index("flags"))).cast("int")
    one = lambda n: at[n] / 255.0
    return [
        one("view"), one("water"), one("vista"), F.least(at["relief"] / 200.0, F.lit(1.0)), clamp((at["tpi"] - 128.0) / 30.0, 0.0, 1.0),
        F.least(at["curvy"] / 100.0, F.lit(1.0)), 1.0 - one("enclosure"), one("cover"), one("built"), one("bldg"),
        bit(flags, C.FLAG_SCENIC_ROUTE).cast("double"), bit(flags, C.FLAG_VIEWPOINT).cast("double"),
    ]


def ride_components(ch: Column, eye: Column, sample_flags: Column, grade: Column) -> list[Column]:
    """Eleven values of a rail sample; the last (trains a day) is 0 until frequency() gives it."""
    at = {n: F.get(ch, F.lit(i)).cast("double") for i, n in enumerate(C.CHANNELS)}
    one = lambda n: at[n] / 255.0
    return [
        one("view"), one("water"), one("vista"), F.least(at["relief"] / 200.0, F.lit(1.0)), F.least(F.abs(at["tpi"] - 128.0) / 30.0, F.lit(1.0)),
        clamp((eye - 3.0) / 1500.0, 0.0, 1.0), F.when(bit(sample_flags, C.SAMPLE_BRIDGE), 0.5).otherwise(0.0), bit(sample_flags, C.SAMPLE_TUNNEL).cast("double"),
        F.least(grade / 4.0, F.lit(1.0)), F.least(at["curvy"] / 100.0, F.lit(1.0)), F.lit(0.0),
    ]


def frequency(trains: Column) -> Column:
    """0 to 1 on a log scale to 100 trains a day; null where unknown (none or less)."""
    return F.when(trains > 0, F.least(F.log10(F.greatest(trains, F.lit(1.0))) / 2.0, F.lit(1.0)))


def weighted_score(parts: Sequence[Column], weights: Sequence[float]) -> Column:
    """Sum of weight times part over the sum of the positive weights, from 0 to 1."""
    below = max(sum(max(w, 0.0) for w in weights), 1e-6)
    return clamp(reduce(lambda a, b: a + b, [p * float(w) for p, w in zip(parts, weights)]) / below, 0.0, 1.0)


def ride_score(parts: Sequence[Column], trains: Column, weights: Sequence[float]) -> Column:
    """As weighted_score, with the trains-a-day part last; where it is unknown its weight doesn't count."""
    f = frequency(trains)
    top = reduce(lambda a, b: a + b, [p * float(w) for p, w in zip([*parts[:-1], F.coalesce(f, F.lit(0.0))], weights)])
    known = sum(max(w, 0.0) for w in weights[:-1])
    below = F.greatest(F.lit(known) + F.when(f.isNotNull(), max(weights[-1], 0.0)).otherwise(0.0), F.lit(1e-6))
    return clamp(top / below, 0.0, 1.0)


def grade_percent(eye0: Column, off0: Column, eye1: Column, off1: Column) -> Column:
    return F.least(F.abs(eye1 - eye0) / F.greatest(F.abs(off1 - off0), F.lit(1.0)) * 100.0, F.lit(30.0))


def landmark_score(fame: Column, isolation_km: Column, balance: float) -> Column:
    """Between fame (balance 0) and isolation (1)."""
    far = clamp((F.log10(F.greatest(isolation_km, F.lit(0.05))) + 1.3) / 5.6, 0.0, 1.0)
    return (1.0 - balance) * F.least(fame / 5.0, F.lit(1.0)) + balance * far


def fame(views: Column, sitelinks: Column | None = None) -> Column:
    """log10(1 + views a month), else 0.3 of that of the number of articles."""
    seen = F.when(views > 0, F.log10(1 + views))
    return F.coalesce(seen, 0.3 * F.log10(1 + sitelinks) if sitelinks is not None else F.lit(0.0), F.lit(0.0))


def filter_axis(c: Column, axis: str, newest: float = 2030.0) -> Column:
    """A filter's value on its scale: 'linear', 'log' or 'year' (logarithm of the age, older is less)."""
    if axis == "log":
        return F.when(c > 0, F.log10(c))
    if axis == "year":
        return -F.log10(F.greatest(newest - c, F.lit(1.0)))
    return c.cast("double")


def area_code(km2: Column) -> Column:
    """Area on a log scale from 0.05 to 700 km² as 0..255, and back by area_km2."""
    return clamp(F.round(F.log1p(km2 / 0.05) / F.log1p(F.lit(700.0 / 0.05)) * 255.0), 0.0, 255.0).cast("int")


def area_km2(code: Column) -> Column:
    return F.expm1(code / 255.0 * F.log1p(F.lit(700.0 / 0.05))) * 0.05


def heritage_tier(tier: Column, level: Column) -> Column:
    """The register's tier, else by level 1 to 5."""
    by = {1: "n.top", 2: "n.second", 3: "n.lower", 4: "p.des", 5: "m.des"}
    out = F.when(tier.isNotNull() & (tier != ""), tier)
    for k, v in by.items():
        out = out.when(level == k, v)
    return out.otherwise("m.des")


def drive_filter(cls: Column, flags: Column, classes: int, surface: int = 3, toll: int = 3, unnamed: int = 0) -> Column:
    """Whether a way is shown: its class among the bits of ``classes``; paved (bit 1) or not (2) among ``surface``; free (1) or
    toll (2) among ``toll``; and not an unnamed way of a class in ``unnamed``.  flags: 1 unpaved, 2 toll, 4 unnamed, 8 ferry."""
    among = lambda mask, n: (F.floor(F.lit(mask) / F.pow(F.lit(2.0), n)) % 2) == 1
    unpaved, tolled, nameless, ferry = (bit(flags, m) for m in (1, 2, 4, 8))
    return (
        ~ferry & among(classes, cls)
        & F.when(unpaved, F.lit(surface & 2 != 0)).otherwise(F.lit(surface & 1 != 0))
        & F.when(tolled, F.lit(toll & 2 != 0)).otherwise(F.lit(toll & 1 != 0))
        & ~(nameless & among(unnamed, cls))
    )


def rail_group_filter(groups: Column, cls: Column, mask: int) -> Column:
    """Service groups among the mask; a line without groups counts by its class's bit."""
    return F.when(groups != 0, groups.bitwiseAND(F.lit(mask)) != 0).otherwise((F.floor(F.lit(mask) / F.pow(F.lit(2.0), cls)) % 2) == 1)


def length_filter(length: Column, low: int | None, high: int | None) -> Column:
    """Rounded length in [low, high]; 0 or None leaves an end open."""
    r = F.round(length)
    return (r >= low if low else F.lit(True)) & (r <= high if high else F.lit(True))
