"""Relational queries: filters, joins, aggregates, windows, order, sets, writes as projections."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import lexicon as L
from ..functions import measures as M
from ..operators import relational as R
from ..sources import objects
from .inputs import duck, rows, table, view
from .registry import query

EV, NO = duck("evidence"), duck("normalizations")
ISO = "'%Y-%m-%dT%H:%M:%S'"


@query("flt01_point_lookup", f"SELECT id, case_id, status, category FROM {EV} e WHERE id = 33 AND NOT is_deleted ORDER BY id LIMIT 1")
def flt01(spark, d):
    return R.point(view(spark, d, "evidence"), "id", 33).select("id", "case_id", "status", "category")


@query("flt02_list_evidence", f"SELECT id, case_id, file_size FROM {EV} e WHERE NOT is_deleted AND category = 'VIDEO' AND status = 'COMPLETED'")
def flt02(spark, d):
    return R.listing(view(spark, d, "evidence"), category="VIDEO", status="COMPLETED", case_id=None).select("id", "case_id", "file_size")


@query("flt03_logs", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' AND user_id = 7")
def flt03(spark, d):
    return R.listing(table(spark, d, "events"), event_type="click", user_id=7).select("event_id", "user_id", "event_type")


@query("flt04_sessions_of_user", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE user_id = 7 GROUP BY 1, 2")
def flt04(spark, d):
    return R.listing(table(spark, d, "events"), user_id=7).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("flt05_keyed_lookups", "SELECT d.doc_id, sha256(d.text) AS sha256, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 0 AND d.lang = 'en'")
def flt05(spark, d):
    docs = R.listing(table(spark, d, "documents"), lang="en")
    return docs.join(R.listing(table(spark, d, "labels"), quality=0), "doc_id").select("doc_id", F.sha2("text", 256).alias("sha256"), "quality")


@query("flt06_search", "SELECT p_partkey, p_name, p_brand FROM part WHERE (contains(lower(p_name), 'ar') OR contains(lower(p_type), 'ar') OR contains(lower(p_brand), 'ar')) AND p_size = 7")
def flt06(spark, d):
    return R.search(table(spark, d, "part"), "AR", ["p_name", "p_type", "p_brand"], p_size=7).select("p_partkey", "p_name", "p_brand")


@query("flt07_case_evidence", f"SELECT id, category FROM {EV} e WHERE case_id = 10 AND category = 'IMAGE'")
def flt07(spark, d):
    return R.listing(view(spark, d, "evidence"), live_only=False, case_id=10, category="IMAGE").select("id", "category")


@query("flt08_response_shape", f"SELECT id, lower(status) AS status, strftime(created_at, {ISO}) AS created_at FROM {EV} e WHERE NOT is_deleted")
def flt08(spark, d):
    return R.listing(view(spark, d, "evidence")).select("id", F.lower("status").alias("status"), M.iso(F.col("created_at")).alias("created_at"))


_ALLOWED = ", ".join(f"'{m}'" for m in L.MIME_CATEGORY)
_MIME = f"""(SELECT e.*, coalesce(CASE WHEN declared IN ({_ALLOWED}) THEN declared END, x.mime) AS mime FROM {EV} e
LEFT JOIN {rows(list(L.EXTENSION_MIME.items()), 'ext, mime').replace('AS t(', 'AS x(')} ON x.ext = lower(regexp_extract(filename, '(\\.[^./]+)$', 1)))"""


@query("src01_mime", f"SELECT id, mime, c.category FROM {_MIME} m LEFT JOIN {rows(list(L.MIME_CATEGORY.items()), 'm, category').replace('AS t(', 'AS c(')} ON c.m = m.mime")
def src01(spark, d):
    e = view(spark, d, "evidence").withColumn("mime", C.resolve_mime(F.col("declared"), F.col("filename")))
    return e.select("id", "mime", C.category(F.col("mime")).alias("category"))


@query("flt09_upload_check", f"SELECT id, CASE WHEN mime IS NULL THEN 'UNSUPPORTED_FILE_TYPE' WHEN file_size > 300000 THEN 'FILE_TOO_LARGE' WHEN file_size <= 0 THEN 'EMPTY_FILE' END AS error_code FROM {_MIME} m")
def flt09(spark, d):
    e = view(spark, d, "evidence")
    return e.select("id", C.upload_error(C.resolve_mime(F.col("declared"), F.col("filename")), F.col("file_size"), 300_000).alias("error_code"))


@query("flt10_magic", f"""SELECT id, CASE WHEN mime = 'application/pdf' AND head_hex NOT LIKE '255044462D%' THEN 'missing PDF header'
WHEN starts_with(mime, 'application/vnd.openxmlformats-officedocument') AND head_hex NOT LIKE '504B%' THEN 'not a ZIP container'
WHEN mime IN ('video/mp4', 'video/quicktime') AND head_hex NOT LIKE '%66747970%' THEN 'missing ftyp box'
WHEN mime = 'video/x-msvideo' AND head_hex NOT LIKE '52494646%' THEN 'missing RIFF header' END AS warning FROM {_MIME} m""")
def flt10(spark, d):
    e = view(spark, d, "evidence")
    return e.select("id", C.content_warning(C.resolve_mime(F.col("declared"), F.col("filename")), F.unhex("head_hex")).alias("warning"))


@query("flt11_image_sniff", f"""SELECT id, CASE WHEN head_hex LIKE '89504E470D0A1A0A%' THEN 'image/png' WHEN head_hex LIKE 'FFD8%' THEN 'image/jpeg'
WHEN head_hex LIKE '49492A00%' OR head_hex LIKE '4D4D002A%' THEN 'image/tiff' WHEN head_hex LIKE '424D%' THEN 'image/bmp' ELSE 'image/png' END AS mime FROM {EV} e""")
def flt11(spark, d):
    return view(spark, d, "evidence").select("id", C.image_type(F.unhex("head_hex")).alias("mime"))


@query("flt12_json_validity", """SELECT event_id, CASE WHEN NOT json_valid(p) THEN 'INVALID_JSON' WHEN json_type(p) NOT IN ('OBJECT', 'ARRAY') THEN 'SCALAR_ROOT' END AS verdict
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat(props, '}') WHEN 1 THEN '17' WHEN 2 THEN concat('[', props, ']') ELSE props END AS p FROM events) AS e""")
def flt12(spark, d):
    p = F.expr("CASE event_id % 4 WHEN 0 THEN concat(props, '}') WHEN 1 THEN '17' WHEN 2 THEN concat('[', props, ']') ELSE props END")
    return table(spark, d, "events").select("event_id", C.json_verdict(p).alias("verdict"))


@query("flt13_constraints", """SELECT p_partkey, length(p_name) BETWEEN 3 AND 20 AS title_ok, length(p_type) BETWEEN 10 AND 5000 AS description_ok, p_size BETWEEN 0 AND 5 AS priority_ok,
regexp_matches(md5(p_name), '^[0-9a-f]{32}$') AS id_ok, p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AS status_ok FROM part""")
def flt13(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.length("p_name").between(3, 20).alias("title_ok"), F.length("p_type").between(10, 5000).alias("description_ok"), F.col("p_size").between(0, 5).alias("priority_ok"),
        F.md5("p_name").rlike("^[0-9a-f]{32}$").alias("id_ok"), F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13").alias("status_ok"),
    )


_PASS = "CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 'Secret1!' WHEN 1 THEN 'secret1!' WHEN 2 THEN 'SECRET1!' WHEN 3 THEN 'Secret!!' WHEN 4 THEN 'Secret12' ELSE 'Sec 1!xyz' END"


@query("flt14_password_policy", f"""SELECT c_custkey, lower(c_name) AS email, regexp_matches(p, '[a-z]') AND regexp_matches(p, '[A-Z]') AND regexp_matches(p, '[0-9]')
AND regexp_matches(p, '[@$!%*?&]') AND regexp_matches(p, '^[A-Za-z0-9@$!%*?&]{{8,128}}$') AS ok FROM (SELECT *, {_PASS} AS p FROM customer) AS c""")
def flt14(spark, d):
    ok = F.expr(_PASS).rlike(r"^(?=.*[a-z])(?=.*[A-Z])(?=.*\d)(?=.*[@$!%*?&])[A-Za-z\d@$!%*?&]{8,128}$")
    return table(spark, d, "customer").select("c_custkey", F.lower("c_name").alias("email"), ok.alias("ok"))


@query("flt15_roles", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def flt15(spark, d):
    c = table(spark, d, "customer")
    return c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("flt16_session_validity", "SELECT e.event_id, coalesce(c.c_acctbal > 0 AND e.ts + INTERVAL 7 DAY >= TIMESTAMP '2024-01-20', false) AS valid FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id")
def flt16(spark, d):
    e, c = table(spark, d, "events"), table(spark, d, "customer")
    ok = (F.col("c_acctbal") > 0) & (F.expr("ts + INTERVAL 7 DAYS") >= F.expr("TIMESTAMP_NTZ '2024-01-20'"))
    return e.join(c, c.c_custkey == e.user_id, "left").select("event_id", F.coalesce(ok, F.lit(False)).alias("valid"))


@query("flt17_quality_gate", f"SELECT evidence_id, attempt FROM {NO} n WHERE quality >= 0.05")
def flt17(spark, d):
    return view(spark, d, "normalizations").where("quality >= 0.05").select("evidence_id", "attempt")


_PENDING = f"FROM {EV} e WHERE status = 'COMPLETED' AND NOT is_deleted AND NOT EXISTS (SELECT 1 FROM {NO} n WHERE n.evidence_id = e.id AND n.status IN ('COMPLETED', 'IN_PROGRESS'))"


@query("jn01_pending", f"SELECT id, case_id, category, strftime(created_at, {ISO}) AS created_at {_PENDING} ORDER BY e.created_at, id LIMIT 50")
def jn01(spark, d):
    """Pending work, oldest first (SRT-03)."""
    found = R.pending(view(spark, d, "evidence"), view(spark, d, "normalizations"))
    return found.orderBy("created_at", "id").limit(50).select("id", "case_id", "category", M.iso(F.col("created_at")).alias("created_at"))


@query("jn01_pending_capped", f"SELECT id {_PENDING} AND (SELECT count(*) FROM {NO} n WHERE n.evidence_id = e.id) < 3")
def jn01_capped(spark, d):
    return R.pending(view(spark, d, "evidence"), view(spark, d, "normalizations"), attempts=3).select("id")


@query("agg02_pending_count", f"SELECT count(*) AS pending {_PENDING}")
def agg02(spark, d):
    return R.pending(view(spark, d, "evidence"), view(spark, d, "normalizations")).agg(F.count("*").alias("pending"))


@query("agg03_health", f"SELECT (SELECT count(*) {_PENDING}) AS pending_normalizations, (SELECT count(*) FROM {EV} e WHERE status = 'PENDING' AND NOT is_deleted) AS pending_ingestions")
def agg03(spark, d):
    e = view(spark, d, "evidence")
    a = R.pending(e, view(spark, d, "normalizations")).agg(F.count("*").alias("pending_normalizations"))
    return a.crossJoin(R.listing(e, status="PENDING").agg(F.count("*").alias("pending_ingestions")))  # one row each


_LAST = f"(SELECT * FROM (SELECT n.*, row_number() OVER (PARTITION BY evidence_id ORDER BY created_at DESC, attempt DESC, ref) AS k FROM {NO} n) AS r WHERE k = 1)"


@query("win01_latest", f"SELECT evidence_id, attempt, status FROM {_LAST} l")
def win01(spark, d):
    n = view(spark, d, "normalizations")
    return R.latest(n, "evidence_id", F.col("created_at").desc(), F.col("attempt").desc(), F.col("ref")).select("evidence_id", "attempt", "status")


@query("jn02_detail", f"""SELECT e.id, e.status, l.status AS last_status, l.attempt AS last_attempt, coalesce(c.n, 0) AS attempts FROM {EV} e
LEFT JOIN {_LAST} l ON l.evidence_id = e.id LEFT JOIN (SELECT evidence_id, count(*) AS n FROM {NO} n GROUP BY 1) AS c ON c.evidence_id = e.id""")
def jn02(spark, d):
    return R.detail(view(spark, d, "evidence"), view(spark, d, "normalizations"), "ref").select("id", "status", "last_status", "last_attempt", "attempts")


@query("jn03_eager_children", "SELECT d.doc_id, coalesce(string_agg(CAST(l.toxic AS VARCHAR), ',' ORDER BY l.quality), '') AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def jn03(spark, d):
    out = R.with_children(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", "quality", "toxic", "toxic")
    return out.select("doc_id", F.array_join(F.transform("toxic", lambda x: x.cast("string")), ",").alias("toxic"))


@query("jn04_includes", "SELECT c.c_custkey, n.n_name AS created_by, s.s_name AS assigned_to FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey")
def jn04(spark, d):
    c, n, s = (table(spark, d, t) for t in ("customer", "nation", "supplier"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(s, s.s_suppkey == c.c_custkey, "left").select("c_custkey", F.col("n_name").alias("created_by"), F.col("s_name").alias("assigned_to"))


@query("jn05_nested", "SELECT c.c_custkey, coalesce(string_agg(CAST(o.o_orderkey AS VARCHAR), ',' ORDER BY o.o_orderkey), '') AS orders FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
def jn05(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderkey").alias("k"))
    out = R.with_children(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", "k", "o_orderkey", "orders")
    return out.select("c_custkey", F.array_join(F.transform("orders", lambda x: x.cast("string")), ",").alias("orders"))


@query("jn06_parents", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey")
def jn06(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("jn07_exists", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def jn07(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("jn08_dedup", """SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1
OR sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id < 100) AND doc_id >= 100 AS duplicate FROM documents WHERE doc_id >= 100""")
def jn08(spark, d):
    docs = table(spark, d, "documents").withColumn("sha256", F.sha2("text", 256))
    out = R.fresh(docs.where("doc_id >= 100"), docs.where("doc_id < 100"), "sha256", "doc_id")
    return out.select("doc_id", "sha256", F.md5("text").alias("md5"), "duplicate")


@query("jn12_refresh", "SELECT e.event_id, c.c_name FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) AS r WHERE k = 1) AS e JOIN customer c ON c.c_custkey = e.user_id")
def jn12(spark, d):
    e = R.latest(table(spark, d, "events"), "user_id", F.col("ts").desc(), F.col("event_id").desc())
    c = table(spark, d, "customer")
    return e.join(c, c.c_custkey == e.user_id).select("event_id", "c_name")


@query("agg01_counts", f"SELECT status, count(*) AS n, count(*) FILTER (NOT is_deleted) AS live FROM {EV} e GROUP BY 1")
def agg01(spark, d):
    return view(spark, d, "evidence").groupBy("status").agg(F.count("*").alias("n"), F.count_if(~F.col("is_deleted")).alias("live"))


@query("agg04_batch_outcome", f"SELECT evidence_id % 100 AS batch, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed, count(*) AS total FROM {NO} n GROUP BY 1")
def agg04(spark, d):
    n = view(spark, d, "normalizations").withColumn("batch", F.expr("evidence_id % 100"))
    return n.groupBy("batch").agg(F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count("*").alias("total"))


@query("agg05_run_summary", f"SELECT count(*) AS total, count(*) FILTER (status IN ('COMPLETED', 'PARTIAL')) AS completed, count(*) FILTER (status = 'FAILED') AS failed FROM {NO} n")
def agg05(spark, d):
    n = view(spark, d, "normalizations")
    return n.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("COMPLETED", "PARTIAL")).alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"))


@query("agg06_session_progress", f"SELECT evidence_id, count(*) AS total, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status IN ('COMPLETED', 'FAILED')) >= count(*) AS is_complete FROM {NO} n GROUP BY 1")
def agg06(spark, d):
    done, failed = F.count_if(F.col("status") == "COMPLETED"), F.count_if(F.col("status") == "FAILED")
    return view(spark, d, "normalizations").groupBy("evidence_id").agg(F.count("*").alias("total"), done.alias("completed"), failed.alias("failed"), (done + failed >= F.count("*")).alias("is_complete"))


@query("agg07_paginate", f"SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS total_pages, ceil(count(*) / 20) > 3 AS has_next, true AS has_prev FROM {EV} e WHERE NOT is_deleted")
def agg07(spark, d):
    return R.page_info(R.listing(view(spark, d, "evidence")), 3, 20)


@query("agg08_child_counts", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
def agg08(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return R.child_counts(table(spark, d, "customer").select("c_custkey"), o, "c_custkey")


@query("agg16_changed_values", "SELECT a.l_orderkey, a.l_linenumber, CAST(a.l_quantity IS DISTINCT FROM b.l_quantity AS INT) + CAST(a.l_tax IS DISTINCT FROM b.l_tax AS INT) + CAST(a.l_returnflag IS DISTINCT FROM b.l_returnflag AS INT) AS changed FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1")
def agg16(spark, d):
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag")
    b = a.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), *[F.col(c).alias(f"b_{c}") for c in ("l_quantity", "l_tax", "l_returnflag")])
    changed = sum((~F.col(c).eqNullSafe(F.col(f"b_{c}"))).cast("int") for c in ("l_quantity", "l_tax", "l_returnflag"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", changed.alias("changed"))


@query("srt01_page", f"SELECT id, strftime(created_at, {ISO}) AS created_at FROM (SELECT * FROM {EV} e WHERE NOT is_deleted ORDER BY created_at DESC, id LIMIT 20 OFFSET 40) AS p")
def srt01(spark, d):
    return R.page(R.listing(view(spark, d, "evidence")), number=3, size=20).select("id", M.iso(F.col("created_at")).alias("created_at"))


@query("srt02_dynamic_sort", f"SELECT id, file_size FROM {EV} e ORDER BY file_size, id LIMIT 100")
def srt02(spark, d):
    return R.page(view(spark, d, "evidence"), "file_size", False, number=-4, size=5000, columns=["file_size", "created_at"]).select("id", "file_size")


@query("srt07_deterministic_first", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def srt07(spark, d):
    return R.latest(table(spark, d, "events"), "user_id", F.col("event_id").asc()).select("user_id", "event_id")


_KEY = "concat(lower(category), '/', strftime(created_at, '%Y/%m/%d'), '/', md5(CAST(id AS VARCHAR)), CASE WHEN regexp_extract(filename, '(\\.[^./]+)$', 1) = '' THEN '.bin' ELSE regexp_extract(filename, '(\\.[^./]+)$', 1) END)"


def _storage_key():
    ending = F.coalesce(F.nullif(F.regexp_extract("filename", r"(\.[^./]+)$", 1), F.lit("")), F.lit(".bin"))
    return F.concat(F.lower("category"), F.lit("/"), F.date_format("created_at", "yyyy/MM/dd"), F.lit("/"), F.md5(F.col("id").cast("string")), ending)


@query("snk01_object_key", f"SELECT id, {_KEY} AS storage_key FROM {EV} e")
def snk01(spark, d):
    return view(spark, d, "evidence").select("id", _storage_key().alias("storage_key"))


_BUCKET, _REGION, _AT = "evidence", "eu-west-1", datetime.datetime(2024, 6, 1)
_ACCESS, _SECRET = "AKIDEXAMPLE", "example-secret-of-the-tests"
_INNER, _OUTER = (p.hex() for p in objects.pads(objects.signing_key(_SECRET, "20240601", _REGION)))
_FIELDS = "X-Amz-Algorithm=AWS4-HMAC-SHA256&X-Amz-Credential=AKIDEXAMPLE%2F20240601%2Feu-west-1%2Fs3%2Faws4_request&X-Amz-Date=20240601T000000Z&X-Amz-Expires=3600&X-Amz-SignedHeaders=host"


@query("snk02_presigned", f"""WITH k AS (SELECT id, replace(url_encode({_KEY}), '%2F', '/') AS p FROM {EV} e),
q AS (SELECT id, p, 'AWS4-HMAC-SHA256' || chr(10) || '20240601T000000Z' || chr(10) || '20240601/eu-west-1/s3/aws4_request' || chr(10) || sha256('GET' || chr(10) || '/' || p || chr(10) || '{_FIELDS}' || chr(10) || 'host:evidence.s3.eu-west-1.amazonaws.com' || chr(10) || chr(10) || 'host' || chr(10) || 'UNSIGNED-PAYLOAD') AS m FROM k)
SELECT id, 'https://evidence.s3.eu-west-1.amazonaws.com/' || p || '?{_FIELDS}&X-Amz-Signature=' || sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(m)))) AS url FROM q""")
def snk02(spark, d):
    """A link of one hour to every object, signed in the JVM."""
    return view(spark, d, "evidence").select("id", objects.presigned(_storage_key(), _BUCKET, _ACCESS, _SECRET, _REGION, _AT).alias("url"))


@query("snk06_result_status", f"SELECT evidence_id, CASE WHEN count(*) FILTER (status = 'FAILED') = 0 THEN 'COMPLETED' WHEN count(*) FILTER (status = 'FAILED') < count(*) THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM {NO} n GROUP BY 1")
def snk06(spark, d):
    failed = F.count_if(F.col("status") == "FAILED")
    status = F.when(failed == 0, "COMPLETED").when(failed < F.count("*"), "PARTIAL").otherwise("FAILED")
    return view(spark, d, "normalizations").groupBy("evidence_id").agg(status.alias("status"))


@query("snk07_soft_delete", f"SELECT id, is_deleted OR case_id = 10 AS is_deleted, CASE WHEN NOT is_deleted AND case_id = 10 THEN '2024-06-01T00:00:00' END AS deleted_at FROM {EV} e")
def snk07(spark, d):
    e = view(spark, d, "evidence")
    out = R.soft_delete(e, e.where("case_id = 10"), F.to_timestamp(F.lit("2024-06-01")))
    return out.select("id", "is_deleted", M.iso(F.col("deleted_at")).alias("deleted_at"))


@query("snk08_patch", f"""SELECT id, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'CLOSED' ELSE status END AS status,
CASE WHEN id % 3 = 0 THEN CASE WHEN id % 5 = 0 THEN NULL ELSE 99 END ELSE case_id END AS case_id, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN '2024-06-01' END AS closed_at FROM {EV} e""")
def snk08(spark, d):
    e = view(spark, d, "evidence").withColumn("closed_at", F.lit(None).cast("string"))
    changes = e.where("id % 3 = 0").select("id", F.expr("CASE WHEN id % 2 = 0 THEN 'CLOSED' ELSE '' END").alias("status"), F.expr("CASE WHEN id % 5 = 0 THEN NULL ELSE 99 END").alias("case_id"), F.lit(True).alias("has_case_id"))
    return R.patch(e, changes, "id", ["status"], ["case_id"], F.lit("2024-06-01")).select("id", "status", F.col("case_id").cast("long").alias("case_id"), "closed_at")


@query("snk09_cascade_delete", "SELECT o_orderkey, CAST((SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS BIGINT) AS lines FROM orders o WHERE o_orderstatus <> 'P'")
def snk09(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    parents, children = R.delete_cascade(o, li, o.where("o_orderstatus = 'P'"), "o_orderkey", "l_orderkey")
    return R.child_counts(parents.select("o_orderkey"), children.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "lines")


@query("snk10_bulk_update", "SELECT event_id, CASE WHEN user_id = 7 THEN 'invalid' ELSE event_type END AS event_type FROM events")
def snk10(spark, d):
    return R.update_where(table(spark, d, "events"), F.col("user_id") == 7, event_type="invalid").select("event_id", "event_type")


@query("snk11_insert_new", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def snk11(spark, d):
    """Also SRC-17: a seed that does nothing on conflict."""
    return R.insert_new(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id").select("doc_id")


@query("snk12_retention", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR")
def snk12(spark, d):
    e = table(spark, d, "events").withColumnRenamed("ts", "modified_at")
    return R.expired_files(e, F.expr("TIMESTAMP_NTZ '2024-01-20'")).select("event_id")


@query("win11_token_family", """SELECT event_id, (event_id % 5 = 0) OR user_id IN (SELECT user_id FROM events WHERE event_id % 5 = 0 AND event_id % 1000 = 5) AS is_revoked FROM events""")
def win11(spark, d):
    t = table(spark, d, "events").select("event_id", F.col("event_id").alias("token"), F.col("user_id").alias("family"), F.expr("event_id % 5 = 0").alias("is_revoked"))
    return R.revoke_families(t, t.where("event_id % 1000 = 5")).select("event_id", "is_revoked")


@query("set03_right_biased_merge", "SELECT doc_id, coalesce(l.quality, d.n_chars % 2) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def set03(spark, d):
    """Two sources of one key: the later one wins."""
    both = table(spark, d, "documents").select("doc_id", F.expr("n_chars % 2").alias("quality"), F.lit(0).alias("ord"))
    both = both.unionByName(table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"), F.lit(1).alias("ord")))
    return both.groupBy("doc_id").agg(F.max_by("quality", "ord").alias("quality"))


@query("set07_engines_used", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS engines FROM events GROUP BY 1")
def set07(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("engines"))


@query("hsh01_checksums", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def hsh01(spark, d):
    """Also HSH-02 and SNK-13: digests of a token or an upload."""
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.octet_length("text").cast("long").alias("size"))


@query("agg19_argmax", "SELECT o_custkey, arg_max(o_orderpriority, row(o_totalprice, -o_orderkey)) AS best, max(o_totalprice) AS score FROM orders WHERE o_totalprice > 0 GROUP BY 1")
def agg19(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 0")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"), F.max("o_totalprice").alias("score"))


@query("win05_memory", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) AS c WHERE k <= 5")
def win05(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    c = table(spark, d, "conversations").withColumn("k", F.row_number().over(w))
    return c.where("k <= 5").orderBy("conv_id", "turn").select("conv_id", "turn", "role")


@query("udf03_retrieve", """SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM (
SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) AS s) AS r WHERE k <= 10""")
def udf03(spark, d):
    """The ten nearest of all vectors for every vector whose id 100 divides."""
    from ..operators.retrieval import nearest

    e = table(spark, d, "embeddings")
    return nearest(e, e.where("vec_id % 100 = 0"), 10)
