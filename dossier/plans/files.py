"""Queries over files: dispatch to readers, structured payloads, one ingest batch with its audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import category, resolve_mime
from ..session import deal
from ..sources import readers, sinks
from ..sources.ledger import Ledger
from ..storage import new_path
from .inputs import table
from .registry import query

NOW = "2024-06-01"

#: One file for each customer, of the kind that the key's remainder names: (ending, SQL of its bytes as hexadecimal digits)
_TEXT, _BE = "hex({})", "lpad(hex(CAST({} AS BIGINT)), 8, '0')"
KINDS = [
    (".txt", _TEXT.format("concat('first line', chr(13), chr(10), repeat('word ', c_nationkey), chr(10), 'end')")),
    (".json", _TEXT.format("concat('{\"id\": ', c_custkey, ', \"name\": \"', c_name, '\"}')")),
    (".csv", _TEXT.format("concat('id,name,share', chr(10), repeat(concat(c_custkey, ',', c_name, ',0.5', chr(10)), 90 + c_nationkey))")),
    (".png", f"concat('89504E470D0A1A0A0000000D49484452', {_BE.format('c_custkey')}, {_BE.format('c_nationkey + 1')})"),
    (".pdf", _TEXT.format("concat('%PDF-1.4', chr(10), repeat(concat('<</Type /Page>>', chr(10)), c_nationkey), '<</Author (', c_name, ')>>', chr(10), 'stream', chr(10), 'BT (', c_name, ') Tj ET', chr(10), 'endstream', chr(10), '%%EOF')")),
    (".MP4", f"concat('0000001066747970', '69736F6D', '00000000', '0000006C6D766864', repeat('0', 24), {_BE.format(1000)}, {_BE.format('c_custkey * 500')})"),
    (".json", _TEXT.format("concat('{\"id\": ', c_custkey)")),
    (".xyz", _TEXT.format("'?'")),
    (".docx", _TEXT.format("concat('no archive of ', c_name)")),
    (".txt", "''"),
]
_AT = f"CAST(c_custkey % {len(KINDS)} AS INT)"
_ENDING = f"CASE {_AT} " + " ".join(f"WHEN {i} THEN '{e}'" for i, (e, _) in enumerate(KINDS)) + " END"
_HEX = f"CASE {_AT} " + " ".join(f"WHEN {i} THEN {h}" for i, (_, h) in enumerate(KINDS)) + " END"
_FILES = f"(SELECT *, {_AT} AS kind, concat('case/', lpad(CAST(c_custkey AS VARCHAR), 12, '0'), {_ENDING}) AS path, unhex({_HEX}) AS content FROM customer)"


def files(spark, d) -> DataFrame:
    """The files as the scan returns them."""
    df = deal(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"))
    made = df.select(F.expr(f"concat('case/', lpad(CAST(c_custkey AS STRING), 12, '0'), {_ENDING})").alias("path"), F.expr(f"unhex({_HEX})").alias("content"))
    mime = resolve_mime(F.lit(None).cast("string"), F.col("path"))
    return made.withColumns({"length": F.octet_length("content").cast("long"), "mime": mime, "category": category(mime), "sha256": F.sha2("content", 256), "md5": F.md5("content")})


def _listed(m: Column) -> Column:
    """A map as sorted key=value lines; previews are compared by their digest."""
    pair = lambda e: F.concat(e["key"], F.lit("="), F.when(e["key"] == "content_preview", F.md5(e["value"])).otherwise(e["value"]))
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), pair)), "\n")


_LF = "chr(10)"
_LISTS = [
    f"concat('character_count=', 15 + 5 * c_nationkey, {_LF}, 'content_preview=', md5(concat('first line', {_LF}, repeat('word ', c_nationkey), {_LF}, 'end')), {_LF}, 'line_count=3', {_LF}, 'word_count=', 3 + c_nationkey)",
    f"concat('content_preview=', md5(concat('{{\"id\": ', c_custkey, ', \"name\": \"', c_name, '\"}}')), {_LF}, 'key_count=2', {_LF}, 'top_level_keys=id,name')",
    f"concat('column_count=3', {_LF}, 'columns=id,name,share', {_LF}, 'dtypes=id:int64,name:object,share:float64', {_LF}, 'row_count_sample=', least(100, 90 + c_nationkey), {_LF}, 'total_rows=', 90 + c_nationkey)",
    f"concat('format=PNG', {_LF}, 'height=', c_nationkey + 1, {_LF}, 'width=', c_custkey)",
    f"concat('author=', c_name, {_LF}, 'content_preview=', md5(c_name), {_LF}, 'page_count=', c_nationkey)",
    f"concat('container_format=isom', {_LF}, 'duration_seconds=', CAST(CAST(c_custkey AS DOUBLE) / 2 AS VARCHAR))",
    "NULL",
    "'warning=no reader for this type'",
    "NULL",
    f"concat('character_count=0', {_LF}, 'content_preview=', md5(''), {_LF}, 'line_count=1', {_LF}, 'word_count=0')",
]


@query("src13_dispatch", f"SELECT path, CASE WHEN kind IN (0, 1, 2, 4, 9) THEN CASE WHEN kind = 1 THEN 'structured' ELSE 'document' END WHEN kind = 3 THEN 'exif' WHEN kind = 5 THEN 'video' WHEN kind = 7 THEN 'unknown' ELSE 'error' END AS meta_type, CASE kind " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(_LISTS)) + f" END AS metadata FROM {_FILES} f")
def src13(spark, d):
    """Every file with the metadata of its type's reader; unreadable and unknown ones are rows."""
    found = readers.extract(files(spark, d))
    return found.select("path", "meta_type", F.when(F.col("meta_type") != "error", _listed(F.col("metadata"))).alias("metadata"))


@query("src12_structured", "SELECT concat('payload/', c_custkey, '.json') AS path, 'application/json' AS mime, concat('{', chr(10), '  \"c_custkey\" : ', c_custkey, ',', chr(10), '  \"c_name\" : \"', c_name, '\",', chr(10), '  \"c_nationkey\" : ', c_nationkey, chr(10), '}') AS body FROM customer")
def src12(spark, d):
    """API payloads as indented JSON files."""
    made = readers.structured_payload(table(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey"], "c_custkey")
    return made.select("path", "mime", F.col("content").cast("string").alias("body"))


_GOOD = f"(SELECT *, row_number() OVER (PARTITION BY sha256(content) ORDER BY path) AS place FROM {_FILES} f WHERE kind NOT IN (7, 9))"
_ID = "substr(sha256(content), 1, 32)"
_MIMES = ["text/plain", "application/json", "text/csv", "image/png", "application/pdf", "video/mp4", "application/json", None, "application/vnd.openxmlformats-officedocument.wordprocessingml.document"]
_MIME = "CASE kind " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MIMES) if m) + " END"


def _batch(spark, d) -> dict[str, DataFrame]:
    return sinks.ingest(files(spark, d), None, F.to_timestamp(F.lit(NOW)))


@query("snk04_ingest", f"SELECT {_ID} AS id, split_part(path, '/', 2) AS original_filename, {_MIME} AS mime_type, CASE kind WHEN 3 THEN 'IMAGE' WHEN 5 THEN 'VIDEO' WHEN 1 THEN 'STRUCTURED' WHEN 6 THEN 'STRUCTURED' ELSE 'DOCUMENT' END AS category, octet_length(content) AS file_size, sha256(content) AS sha256, md5(content) AS md5, 'COMPLETED' AS status, CASE WHEN kind = 8 THEN 'not a ZIP container' END AS warning FROM {_GOOD} g WHERE place = 1")
def snk04(spark, d):
    """Evidence rows of one batch with the checksums that go with them."""
    made = _batch(spark, d)
    sums = made["file_checksums"].select(F.col("evidence_file_id").alias("id"), "sha256", "md5", "file_size")
    return made["evidence_files"].drop("created_at").join(sums, ["id", "sha256", "md5", "file_size"])


@query("snk05_audit", f"SELECT {_ID} AS evidence_file_id, 'INGESTED' AS action, split_part(path, '/', 2) AS detail FROM {_GOOD} g WHERE place = 1 UNION ALL SELECT NULL, 'REJECTED', concat('DUPLICATE ', path) FROM {_GOOD} h WHERE place > 1 UNION ALL SELECT NULL, 'REJECTED', concat(CASE kind WHEN 7 THEN 'UNSUPPORTED_FILE_TYPE ' ELSE 'EMPTY_FILE ' END, path) FROM {_FILES} i WHERE kind IN (7, 9)")
def snk05(spark, d):
    """One audit row for each file, taken or rejected."""
    return _batch(spark, d)["acquisition_logs"].drop("created_at")


_COMMITTED = f"(SELECT *, row_number() OVER (PARTITION BY sha256(content) ORDER BY c_custkey % 3, path) AS seat FROM {_FILES} f WHERE kind NOT IN (7, 9))"
_META = "CASE WHEN kind IN (0, 2, 4) THEN 'document' WHEN kind = 1 THEN 'structured' WHEN kind = 3 THEN 'exif' WHEN kind = 5 THEN 'video' ELSE 'error' END"


@query("snk04_commits", f"SELECT {_ID} AS id, CAST(c_custkey % 3 AS BIGINT) AS batch, split_part(path, '/', 2) AS original_filename, sha256(content) AS sha256, md5(content) AS md5, {_META} AS meta_type FROM {_COMMITTED} g WHERE seat = 1 AND c_custkey % 3 < 2")
def snk04_commits(spark, d):
    """Three batches through the ledger: two are published, the second one twice (the later attempt has other rows
    and loses), the third is left half-written. Evidence, checksums and metadata show the same two batches."""
    found, ledger = files(spark, d), Ledger(spark, new_path(spark, "ledger"))
    part = lambda n: found.where(F.expr(f"CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT) % 3 = {n}"))
    now = F.to_timestamp(F.lit(NOW))
    ledger.commit(0, sinks.ingest(part(0), None, now))
    ledger.commit(1, sinks.ingest(part(1), ledger.read("file_checksums"), now))
    late = sinks.ingest(part(2), ledger.read("file_checksums"), now)
    ledger.publish(1, *ledger.stage(1, late))
    ledger.stage(2, {"evidence_files": late["evidence_files"]})
    sums = ledger.read("file_checksums").select(F.col("evidence_file_id").alias("id"), "batch", "sha256", "md5")
    meta = ledger.read("evidence_metadata").select(F.col("evidence_file_id").alias("id"), "batch", "meta_type")
    return ledger.read("evidence_files").select("id", "batch", "original_filename").join(sums, ["id", "batch"]).join(meta, ["id", "batch"])
