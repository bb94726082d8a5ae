import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from dossier.sources import readers, sinks
from dossier.sources.ledger import Ledger

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return out.getvalue()


CORE = '<cp xmlns:dc="d"><dc:creator>Ann</dc:creator><dc:title>T</dc:title></cp>'
DOCX = zipped({"docProps/core.xml": CORE, "word/document.xml": f'<w:document xmlns:w="{W}"><w:body>' + "".join(f"<w:p><w:r><w:t>para {i}</w:t></w:r></w:p>" for i in range(25)) + "</w:body></w:document>"})
XLSX = zipped({"xl/workbook.xml": '<w xmlns="m"><sheets><sheet name="A"/><sheet name="B"/></sheets></w>', "xl/worksheets/sheet1.xml": '<w xmlns="m"><sheetData><row><c r="A1"/><c r="C7"/></row></sheetData></w>'})
PDF = b"%PDF-1.4\n1 0 obj <</Type /Page>> endobj 2 0 obj <</Type /Pages>> endobj\n3 0 obj <</Author (Bo) /CreationDate (D:20240115143000+05'30')>> endobj\nstream\nBT (hello) Tj ET\nendstream\n%%EOF"
PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
MP4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4sIIIII", 108, b"mvhd", 0, 0, 0, 1000, 2500) + b"\0" * 80


def exif_jpeg():
    """Make, and GPS 12 deg 30' 36" S, 77 deg 0' 0" E."""
    gps_at, data_at = 38, 38 + 2 + 12 * 4 + 4
    rat = lambda *v: b"".join(struct.pack("<II", x, 1) for x in v)
    t = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHI4s", 0x010F, 2, 4, b"Cam\0") + struct.pack("<HHII", 0x8825, 4, 1, gps_at) + struct.pack("<I", 0)
    t = t.ljust(gps_at, b"\0") + struct.pack("<H", 4) + struct.pack("<HHI4s", 1, 2, 2, b"S\0\0\0") + struct.pack("<HHII", 2, 5, 3, data_at) + struct.pack("<HHI4s", 3, 2, 2, b"E\0\0\0") + struct.pack("<HHII", 4, 5, 3, data_at + 24) + struct.pack("<I", 0)
    t += rat(12, 30, 36) + rat(77, 0, 0)
    app = b"Exif\0\0" + t
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 30, 40, 1) + b"\0" * 3 + b"\xff\xd9"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    files = {"a.docx": DOCX, "b.xlsx": XLSX, "c.pdf": PDF, "d.png": PNG, "e.mp4": MP4, "f.jpg": exif_jpeg(), "g.txt": "one two\r\nthree".encode(), "h.json": b'{"a": 1, "b": [2]}', "i.json": b'[{"x": 1}, {"x": 2}]', "j.json": b"{broken", "k.docx": b"not a zip", "l.xyz": b"?", "m.txt": "one two\r\nthree".encode(), "n.txt": b"", "o.csv": b"p,q\n1,x\n2,y\n"}
    for n, b in files.items():
        (d / n).write_bytes(b)
    return str(d)


@pytest.fixture(scope="module")
def meta(spark, folder):
    return {r.path.split("/")[-1]: (r.meta_type, r.metadata) for r in readers.extract(readers.scan(spark, folder)).collect()}


def test_readers(meta):
    assert meta["a.docx"][1]["author"] == "Ann" and meta["a.docx"][1]["paragraph_count"] == "25" and meta["a.docx"][1]["content_preview"].count("\n") == 19
    assert meta["b.xlsx"][1]["sheet_names"] == "A,B" and (meta["b.xlsx"][1]["active_sheet_rows"], meta["b.xlsx"][1]["active_sheet_cols"]) == ("7", "3")
    assert meta["c.pdf"][1]["page_count"] == "1" and meta["c.pdf"][1]["author"] == "Bo" and meta["c.pdf"][1]["content_preview"] == "hello"
    assert meta["d.png"][1] == {"format": "PNG", "width": "640", "height": "480"} and meta["d.png"][0] == "exif"
    assert meta["e.mp4"][1]["duration_seconds"] == "2.5"
    j = meta["f.jpg"][1]
    assert (j["camera_make"], j["width"], j["height"], j["latitude"], j["longitude"]) == ("Cam", "40", "30", "-12.51", "77.0")
    assert (meta["g.txt"][1]["line_count"], meta["g.txt"][1]["word_count"], meta["g.txt"][1]["character_count"]) == ("2", "3", "13")
    assert meta["h.json"][1]["top_level_keys"] == "a,b" and meta["i.json"][1]["record_count"] == "2" and meta["i.json"][1]["sample_keys"] == "x"


def test_csv_types_come_from_the_sample():
    rows = "a,b\n" + "1,x\n" * readers.CSV_SAMPLE + 'late,"two\nlines"\n'
    m = readers.csv_file(rows.encode())
    assert (m["columns"], m["dtypes"], m["row_count_sample"], m["total_rows"]) == ("a,b", "a:int64,b:object", "100", "102")
    with pytest.raises(ValueError):
        readers.csv_file(b"")


def test_pdf_objects_in_streams():
    packed = zlib.compress(b"1 0 2 20 <</Type /Page>> <</Type /Page /Parent 9 0 R>> <</Title (Deep)>>")
    shown = zlib.compress(b"BT (one) Tj (/Type /Page) Tj ET")
    content = b"%PDF-1.5\n4 0 obj <</Type /ObjStm /Filter /FlateDecode>> stream\n" + packed + b"\nendstream endobj\n5 0 obj <</Filter /FlateDecode>> stream\n" + shown + b"\nendstream endobj\n6 0 obj <<>> stream\n\x78broken\nendstream endobj\n%%EOF"
    assert readers.pdf(content) == {"page_count": "2", "title": "Deep", "content_preview": "one\n/Type /Page"}


def test_unreadable_files_are_rows(meta):
    assert meta["j.json"][0] == "error" and meta["k.docx"][0] == "error" and meta["l.xyz"][0] == "unknown" and len(meta) == 15


def test_csv_and_probe(spark, folder):
    r = readers.csv_metadata(spark, f"{folder}/o.csv").first()
    assert r.columns == ["p", "q"] and r.total_rows == 2 and r.dtypes == ["int", "string"]
    probe = json.dumps({"format": {"format_name": "mov", "duration": "3.5", "bit_rate": "9"}, "streams": [{"codec_type": "audio", "codec_name": "aac", "sample_rate": "44100"}, {"codec_type": "video", "codec_name": "h264", "width": 4, "height": 3, "r_frame_rate": "30000/1001"}]})
    p = spark.createDataFrame([(probe,), ("nope",)], "p string").select(*[c.alias(n) for n, c in readers.probe_columns(F.col("p")).items()]).collect()
    assert p[0].frame_rate == 29.97 and p[0].audio_codec == "aac" and p[0].duration_seconds == 3.5 and p[1].video_codec is None


def test_ingest_is_idempotent_and_flags_duplicates(spark, folder, tmp_path):
    now = F.to_timestamp(F.lit("2024-06-01"))
    ledger = Ledger(spark, f"{tmp_path}/t")
    assert [ledger.commit(7, sinks.ingest(readers.scan(spark, folder), None, now)) for _ in range(2)] == [True, False]
    ev = ledger.read("evidence_files").collect()
    bad = {r.path.split("/")[-1]: r.error_code for r in ledger.read("ingest_rejects").collect()}
    assert bad == {"l.xyz": "UNSUPPORTED_FILE_TYPE", "n.txt": "EMPTY_FILE", "m.txt": "DUPLICATE"} and len(ev) == 12
    assert {r.original_filename: r.warning for r in ev}["k.docx"] == "not a ZIP container"
    assert ledger.read("acquisition_logs").count() == 15 and ledger.read("evidence_metadata").count() == 12
    again = sinks.ingest(readers.scan(spark, folder), ledger.read("file_checksums"), now)
    assert again["evidence_files"].count() == 0


def test_store_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "DOCUMENT", "2024-01-01"), (2, "IMAGE", "2024-02-01")], "id int, category string, c string").withColumn("created_at", F.to_timestamp("c"))
    path = f"{tmp_path}/store"
    sinks.store(df, path)
    got = sinks.stored(spark, path, "IMAGE", "2024-01-15")
    assert [r.id for r in got.collect()] == [2] and "PartitionFilters: [isnotnull(category" in got._jdf.queryExecution().toString()
    assert sinks.exists(spark, path) and sinks.remove(spark, path) and not sinks.exists(spark, path)


def test_pages_and_payloads(spark):
    f = spark.createDataFrame([("a", bytearray(b"1|2|3")), ("b", bytearray(b""))], "path string, content binary")
    assert readers.document_pages(f, lambda b: b.split(b"|") if b else [][0], most=2).count() == 2
    p = readers.structured_payload(spark.createDataFrame([(1, "x")], "id int, v string"), ["id", "v"], "id").first()
    assert json.loads(bytes(p.content)) == {"id": 1, "v": "x"} and p.mime == "application/json"
