"""Anomalies, quality scores, confidence tracking, canonical records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import CONFIDENCE_FACTORS
from ..functions.measures import checked_location, iso, parse_timestamp
from ..functions.text import clean_text, lookup
from .scan import clamped

#: metadata field -> event type
EVENT_TYPES = {"creation_date": "evidence_created", "modification_date": "evidence_modified", "datetime_original": "photo_taken", "datetime_digitized": "photo_digitized", "creation_time": "video_recorded"}
MOST_AUDIT_ROWS = 200


def anomaly(kind: str, grade: str, field: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("anomaly_type"), F.lit(grade).alias("severity"), F.lit(field).alias("field")))


def anomalies(now: Column, fields: dict[str, Column], lat: Column, lon: Column, error: Column, page_count: Column, file_size: Column, parsed: dict[str, Column] | None = None) -> Column:
    """Array of (anomaly_type, severity, field) of a metadata record; absent fields are empty or null. ``now`` is given, so that a run can be repeated.

    ``parsed``: columns that hold the fields' timestamps already. Reading one is a chain of patterns, so a
    caller that uses them again reads each once.
    """
    found = []
    for name, value in fields.items():
        given = F.coalesce(value, F.lit("")) != ""
        at = parsed[name] if parsed else parse_timestamp(value)[0]
        found += [
            anomaly("unparseable_timestamp", "warning", name, given & at.isNull()),
            anomaly("future_timestamp", "critical", name, at > now + F.expr("INTERVAL 1 DAY")),
            anomaly("impossible_timestamp", "critical", name, F.year(at) < 1900),
        ]
    both = lat.isNotNull() & lon.isNotNull()
    y, x = lat.try_cast("double"), lon.try_cast("double")
    found += [
        anomaly("malformed_gps", "warning", "gps", both & (y.isNull() | x.isNull())),
        anomaly("invalid_gps", "critical", "gps.latitude", x.isNotNull() & ~y.between(-90.0, 90.0)),
        anomaly("invalid_gps", "critical", "gps.longitude", y.isNotNull() & ~x.between(-180.0, 180.0)),
        anomaly("suspicious_gps", "warning", "gps", (y == 0) & (x == 0)),
        anomaly("metadata_extraction_error", "warning", "metadata", F.coalesce(error, F.lit("")) != ""),
        anomaly("suspicious_page_count", "warning", "page_count", page_count > 10000),
        anomaly("zero_file_size", "critical", "file_size_bytes", F.coalesce(file_size, F.lit(0)) == 0),
    ]
    return F.array_compact(F.array(*found))


def quality_report(fields: dict[str, Column], found: Column) -> dict[str, Column]:
    """Scores from named presence flags and an array of anomalies."""
    total = len(fields)
    present = sum(F.coalesce(c, F.lit(False)).cast("int") for c in fields.values())
    completeness = present / total
    critical = F.size(F.filter(found, lambda a: a["severity"] == "critical"))
    penalty = F.least(F.size(found) * 0.1, F.lit(0.5)) + critical * 0.15
    confidence = completeness * 0.4 + completeness * 0.6
    overall = F.greatest(F.lit(0.0), completeness * 0.3 + completeness * 0.4 + confidence * 0.3 - penalty)
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in fields.items()]))
    return {
        "total_fields": F.lit(total),
        "present_fields": present,
        "completeness": F.round(completeness, 4),
        "confidence": F.round(confidence, 4),
        "overall": F.round(overall, 4),
        "missing": missing,
        "anomaly_count": F.size(found),
        "critical_count": critical,
    }


def first_timestamp(*values: Column) -> Column:
    return F.coalesce(*[parse_timestamp(v)[0] for v in values])


def temporal_events(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, event_type, utc, precision, confidence, field): one row for each field that can be read."""
    made = []
    for f in fields:
        at, precision = parse_timestamp(F.col(f))
        made.append(F.struct(F.lit(EVENT_TYPES[f]).alias("event_type"), at.alias("utc"), precision.alias("precision"), F.lit(0.9).alias("confidence"), F.lit(f).alias("field")))
    return df.select(key, F.inline(F.array(*made))).where("utc is not null")


def canonical(df: DataFrame, now: Column) -> DataFrame:
    """Metadata rows (id, filename, mime, category, file_size, sha256, creation_date, modification_date, lat, lon, camera_make, preview) as canonical records with nested sections; empty ones are null."""
    lat, lon, _ = checked_location(F.col("lat").try_cast("double"), F.col("lon").try_cast("double"))
    made, changed = first_timestamp(F.col("creation_date")), first_timestamp(F.col("modification_date"))
    device = F.when(F.col("camera_make") != "", F.struct(F.col("camera_make").alias("make")))
    text = F.nullif(clean_text(F.col("preview"), normalize=False), F.lit(""))
    evidence = F.struct(
        F.col("mime").alias("file_type"), F.col("file_size").alias("file_size_bytes"), iso(made).alias("creation_timestamp"), iso(changed).alias("modification_timestamp"),
        device.alias("device_info"), F.left(text, F.lit(500)).alias("content_summary"), text.alias("extracted_text"),
    )
    place = F.when(lat.isNotNull() & lon.isNotNull(), F.array(F.struct(lat.alias("latitude"), lon.alias("longitude"))))
    events = F.array_compact(F.array(*[F.when(t.isNotNull(), F.struct(F.lit(EVENT_TYPES[n]).alias("event_type"), iso(t).alias("timestamp"))) for n, t in (("creation_date", made), ("modification_date", changed))]))
    return df.select(
        F.lit("1.0.0").alias("schema_version"), F.col("id").alias("source_evidence_id"), iso(now).alias("normalized_at"), F.lit(1.0).alias("confidence"), F.col("filename").alias("original_filename"),
        F.col("mime").alias("mime_type"), "category", F.col("file_size").alias("file_size_bytes"), F.col("sha256").alias("sha256_hash"), evidence.alias("digital_evidence"), events.alias("temporal_events"),
        F.coalesce(place, F.array().cast("array<struct<latitude:double,longitude:double>>")).alias("locations"),
    )


def confidence_steps(df: DataFrame, keys: list[str], order: str, kind: str, override: str | None = None, start: float = 1.0, block_bits: int = 8) -> DataFrame:
    """Before and after of every transformation of a field, in order and clamped to 0..1 at each step.

    Steps of one order go by factor, override and kind. A field may have any number of steps: see ``scan.clamped``.
    """
    factor = F.create_map(*[F.lit(x) for kv in CONFIDENCE_FACTORS.items() for x in kv])
    given = F.col(override) if override else F.lit(None).cast("double")
    by = F.coalesce(F.try_element_at(factor, F.col(kind)), F.lit(1.0))
    fixed = F.when(given.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), given)))
    group = F.to_json(F.struct(*keys))
    at = F.struct(F.col(order).cast("bigint").alias("ord"), by.alias("factor"), given.alias("override"), F.col(kind).alias("kind"))
    items = df.select(group.alias("g"), *keys, at.alias("at"), F.when(given.isNull(), by).otherwise(0.0).alias("a"), F.coalesce(fixed, F.lit(0.0)).alias("lo"), F.coalesce(fixed, F.lit(1.0)).alias("hi"))
    out = clamped(items, ["g"], min(1.0, max(0.0, start)), keys, block_bits)
    return out.select(*keys, "at.ord", "at.kind", "before", "after")


def audit(steps: DataFrame, key: str) -> DataFrame:
    """Number of transformations, the first 200 as an array, and the mean of the fields' last confidences."""
    last = steps.groupBy(key, "field").agg(F.max_by("after", "ord").alias("last")).groupBy(key).agg(F.round(F.avg("last"), 4).alias("composite"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("ord", "field", "kind"))
    first = steps.withColumn("place", place).where(F.col("place") <= MOST_AUDIT_ROWS)
    listed = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ord", "field", "kind"))), lambda x: F.struct(x["ord"].alias("ord"), x["field"].alias("field"), x["kind"].alias("kind"))).alias("transformations"))
    counted = steps.groupBy(key).agg(F.count("*").alias("transformation_count"))
    return counted.join(listed, key).join(last, key)


def stage_status(outcomes: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(completed stages, failed stages, COMPLETED or PARTIAL) from a success flag for each stage."""
    done = F.array_compact(F.array(*[F.when(ok, n) for n, ok in outcomes.items()]))
    failed = F.array_compact(F.array(*[F.when(~ok, n) for n, ok in outcomes.items()]))
    return done, failed, F.when(F.size(failed) == 0, "COMPLETED").otherwise("PARTIAL")


def tags(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def envelope(df: DataFrame, key: str) -> DataFrame:
    """Each row as one JSON text under success and data."""
    return df.select(key, F.to_json(F.struct(F.lit(True).alias("success"), F.struct(*df.columns).alias("data"))).alias("body"))


def event_type(field: Column) -> Column:
    return lookup(EVENT_TYPES, field)
