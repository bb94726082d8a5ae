"""Units, coordinates, timestamps, and page measures as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import lookup


def unit_name(c: Column) -> Column:
    key = F.trim(F.lower(c))
    return lookup(L.UNIT_ALIASES, key, key)


def convert(value: Column, unit: Column, target: Column | None = None) -> tuple[Column, Column]:
    """(value, unit) in the unit's own target, or in ``target``; as it is, unrounded, where no rule leads there."""
    source = unit_name(unit)
    number, name = value, source
    for frm, (to, factor, offset) in L.CONVERSIONS.items():
        goes = source == frm if target is None else (source == frm) & (unit_name(target) == to)
        made = (value - 32) * 5 / 9 if frm == "fahrenheit" else value * factor + offset
        number = F.when(goes, F.round(made, 4)).otherwise(number)
        name = F.when(goes, F.lit(to)).otherwise(name)
    return number, name


def coordinates(c: Column) -> tuple[Column, Column]:
    """(latitude, longitude) of 'lat, lon' or of two groups of degrees, minutes and seconds; else nulls."""
    text = F.trim(c)
    plain = r"^(-?\d+\.?\d*)\s*[,;\s]\s*(-?\d+\.?\d*)"
    dms = r"(?i)(\d+)[°]\s*(\d+)['′]\s*(\d+\.?\d*)[\"″]?\s*([NSEW])"
    part = [F.regexp_extract_all(text, F.lit(dms), F.lit(g)) for g in range(1, 5)]

    def degrees(i: int) -> Column:
        d, m, s, way = (F.get(p, F.lit(i)) for p in part)
        total = d.try_cast("double") + m.try_cast("double") / 60 + s.try_cast("double") / 3600
        return F.round(F.when(F.upper(way).isin("S", "W"), -total).otherwise(total), 8)

    both = F.size(part[0]) >= 2
    pick = lambda g, i: F.when(text.rlike(plain), F.regexp_extract(text, plain, g).try_cast("double")).when(both, degrees(i))
    return pick(1, 0), pick(2, 1)


def checked_location(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """(latitude, longitude, warning): rounded if both are in range, else nulls and a warning."""
    sound = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    given = lat.isNotNull() & lon.isNotNull()
    return F.when(sound, F.round(lat, 8)), F.when(sound, F.round(lon, 8)), F.when(given & ~sound, F.lit("Invalid GPS"))


def gps_warnings(lat: Column, lon: Column) -> Column:
    """Array of warnings: latitude or longitude out of range, or the placeholder (0, 0)."""
    return F.array_compact(
        F.array(
            F.when(~lat.between(-90.0, 90.0), "latitude out of range"),
            F.when(~lon.between(-180.0, 180.0), "longitude out of range"),
            F.when((lat == 0.0) & (lon == 0.0), "placeholder"),
        )
    )


def dms(degrees: Column, minutes: Column, seconds: Column, way: Column) -> Column:
    total = F.round(degrees + minutes / 60 + seconds / 3600, 8)
    return F.when(F.upper(way).isin("S", "W"), -total).otherwise(total)


#: (what the text must look like, pattern to read it by), in the order of preference; offsets as given, else UTC
FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(?:Z|[+-]\d{2}:\d{2})$", "y-M-d'T'H:m:sXXX"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}[+-]\d{4}$", "y-M-d'T'H:m:sxx"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}(?:Z|[+-]\d{2}:\d{2})$", "y-M-d'T'H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]XXX"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "y-M-d'T'H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "y-M-d H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(?:Z|[+-]\d{2}:\d{2})$", "y-M-d H:m:sXXX"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "M/d/y H:m:s"),
    (r"(?i)^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2} [AP]M$", "M/d/y h:m:s a"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "d/M/y H:m:s"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
    (r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "d-M-y H:m:s"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"),
    (r"(?i)^[a-z]{4,} \d{1,2}, \d{4}$", "MMMM d, y"),
    (r"(?i)^[a-z]{3} \d{1,2}, \d{4}$", "MMM d, y"),
    (r"^\d{14}$", "yyyyMMddHHmmss"),
    (r"^\d{4}:\d{1,2}:\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}", "y:M:d H:m:s"),
    (r"(?i)^[a-z]{3} \d{1,2} \d{1,2}:\d{1,2}:\d{1,2} \d{4}$", "MMM d H:m:s y"),
    (r"(?i)^\d{1,2} [a-z]{3,} \d{4}$", "d MMMM y"),
    (r"^\d{4}\.\d{1,2}\.\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "y.M.d H:m:s"),
]


def parse_timestamp(c: Column) -> tuple[Column, Column]:
    """(UTC timestamp, precision) of a timestamp in any of the known forms; nulls if none fits.

    Month comes first where both readings are possible. A PDF date's offset is not applied. A year and
    month have the precision day, a year alone is estimated, everything else is exact.
    """
    text = F.regexp_replace(F.trim(c), r"\s+", " ")
    bare = F.regexp_replace(text, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun) (?=[a-z]{3} )", "")
    exact = F.coalesce(*[F.when(bare.rlike(look), F.try_to_timestamp(F.regexp_extract(bare, look, 0), F.lit(form))) for look, form in FORMATS])
    pdf = F.try_to_timestamp(F.nullif(F.regexp_extract(text, r"^D:(\d{14})", 1), F.lit("")), F.lit("yyyyMMddHHmmss"))
    month = F.when(text.rlike(r"^\d{4}-\d{2}$"), F.try_to_timestamp(F.concat(text, F.lit("-01")), F.lit("yyyy-MM-dd")))
    year = F.when(text.rlike(r"^\d{4}$"), F.try_to_timestamp(F.concat(text, F.lit("-01-01")), F.lit("yyyy-MM-dd")))
    precision = F.when(F.coalesce(exact, pdf).isNotNull(), "exact").when(month.isNotNull(), "day").when(year.isNotNull(), "estimated")
    return F.coalesce(exact, pdf, month, year), precision


def zone_hours(zone: Column) -> Column:
    """Whole hours of a zone's abbreviation; null if unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in L.TZ_HOURS.items() for x in kv]), F.upper(zone))


def attach_zone(naive: Column, zone: Column) -> Column:
    """A naive local timestamp in UTC; unknown zones count as UTC."""
    return naive - F.make_interval(hours=F.coalesce(zone_hours(zone), F.lit(0)))


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def hours_since_death(body: Column) -> Column:
    return F.round((37 - body) / 1.5, 2)


def estimated_dpi(w: Column, h: Column) -> Column:
    return F.greatest(F.lit(72), F.least(F.lit(1200), F.floor(F.greatest(w, h) / 11.69).cast("int")))


def resolution_score(w: Column, h: Column) -> Column:
    n = w.cast("long") * h
    return F.when(n >= 8_000_000, 1.0).when(n >= 4_000_000, 0.85).when(n >= 2_000_000, 0.65).when(n >= 1_000_000, 0.45).when(n >= 500_000, 0.25).otherwise(0.1)


def brightness_score(mean: Column) -> Column:
    """``mean``: 0 to 1."""
    return F.when(mean.between(0.4, 0.8), 1.0 - F.abs(mean - 0.6)).when(mean < 0.4, F.greatest(F.lit(0.0), mean / 0.4 * 0.5)).otherwise(F.greatest(F.lit(0.0), (1.0 - mean) / 0.2 * 0.5))


def page_score(blur: Column, noise: Column, contrast: Column, resolution: Column, brightness: Column) -> Column:
    total = blur * 0.30 + (1.0 - noise) * 0.20 + contrast * 0.25 + resolution * 0.15 + brightness * 0.10
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


def deskew_angle(angle: Column) -> Column:
    """Angle to turn a page by: within 15 degrees, and none under 0.3."""
    bound = F.greatest(F.lit(-15.0), F.least(F.lit(15.0), angle))
    return F.when(F.abs(bound) < 0.3, 0.0).otherwise(bound)
