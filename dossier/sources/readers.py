"""Readers: file types to metadata columns. Binary content comes from Spark's binaryFile source."""

from __future__ import annotations

import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import category, resolve_mime
from ..functions.measures import dms
from ..storage import ship_package

PREVIEW, JSON_PREVIEW = 1000, 2000
#: Rows from which the types of a CSV file's columns are read.
CSV_SAMPLE = 100


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows (path, modificationTime, length, content) with mime, category and digests.

    The source leaves out empty files; they are listed and added, so that they can be rejected by name.
    """
    df = spark.read.format("binaryFile").load(path)
    empty = empty_files(spark, path)
    if empty:
        rows = spark.createDataFrame([(p, t, bytearray()) for p, t in empty], "path string, t long, content binary")
        df = df.unionByName(rows.select("path", F.timestamp_millis("t").alias("modificationTime"), F.lit(0).cast("long").alias("length"), "content"))
    mime = resolve_mime(F.lit(None).cast("string"), F.col("path"))
    return df.withColumns({"mime": mime, "category": category(mime), "sha256": F.sha2("content", 256), "md5": F.md5("content")})


def empty_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, modification time) of the files of length 0 in a folder or under a glob."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for top in fs.globStatus(p) or []:
        for f in fs.listStatus(top.getPath()) if top.isDirectory() else [top]:
            if f.isFile() and f.getLen() == 0 and not f.getPath().getName().startswith(("_", ".")):
                found.append((f.getPath().toString(), f.getModificationTime()))
    return found


def text_metadata(text: Column) -> dict[str, Column]:
    """line_count, character_count, word_count and preview, after translating line ends."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    return {
        "line_count": F.regexp_count(t, F.lit("\n")) + 1,
        "character_count": F.length(t),
        "word_count": F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")),
        "content_preview": F.left(t, F.lit(PREVIEW)),
    }


def json_metadata(text: Column) -> dict[str, Column]:
    """Keys of an object, or length and first element's keys of an array; preview; error if it is no JSON."""
    parsed = F.try_parse_json(text)
    return {
        "top_level_keys": F.json_object_keys(text),
        "key_count": F.size(F.json_object_keys(text)),
        "record_count": F.json_array_length(text),
        "sample_keys": F.json_object_keys(F.get_json_object(text, "$[0]")),
        "content_preview": F.left(text, F.lit(JSON_PREVIEW)),
        "error": F.when(parsed.isNull(), "invalid JSON"),
    }


def csv_metadata(spark: SparkSession, path: str, sample: float = 1.0) -> DataFrame:
    """columns, column_count, dtypes and total_rows (physical lines less the header) of CSV files with one header."""
    df = spark.read.csv(path, header=True, inferSchema=True, samplingRatio=sample)
    lines = spark.read.text(path).agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("total_rows"))
    names, kinds = F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.lit(t) for _, t in df.dtypes])
    return lines.select(names.alias("columns"), F.lit(len(df.columns)).alias("column_count"), kinds.alias("dtypes"), "total_rows")


# ---------------------------------------------------------------- formats read from bytes


def csv_file(content: bytes) -> dict[str, str]:
    """Columns and their types by the first CSV_SAMPLE rows; total_rows is the number of physical lines less the header."""
    head = pd.read_csv(io.BytesIO(content), nrows=CSV_SAMPLE)
    kind = lambda t: str(t) if pd.api.types.is_numeric_dtype(t) or pd.api.types.is_bool_dtype(t) else "object"
    names = [str(c) for c in head.columns]
    return {
        "columns": ",".join(names), "column_count": str(len(names)), "row_count_sample": str(len(head)),
        "dtypes": ",".join(f"{n}:{kind(t)}" for n, t in zip(names, head.dtypes)),
        "total_rows": str(sum(1 for _ in io.TextIOWrapper(io.BytesIO(content), "utf-8")) - 1),
    }


def _core(z: zipfile.ZipFile) -> dict[str, str]:
    if "docProps/core.xml" not in z.namelist():
        return {}
    names = {"creator": "author", "title": "title", "subject": "subject", "lastModifiedBy": "last_modified_by", "revision": "revision", "created": "creation_date", "modified": "modification_date"}
    found = ((e.tag.split("}")[-1], e.text) for e in ET.fromstring(z.read("docProps/core.xml")))
    return {names[t]: x for t, x in found if t in names and x}


def docx(content: bytes) -> dict[str, str]:
    """Core properties, paragraph count, and the first 20 paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml"))
        texts = ["".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in body.iter() if p.tag.endswith("}p")]
        return _core(z) | {"paragraph_count": str(len(texts)), "content_preview": "\n".join(texts[:20])[:PREVIEW]}


def xlsx(content: bytes) -> dict[str, str]:
    """Core properties, sheet names and count, and the first sheet's extent."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        sheets = [e.get("name", "") for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if e.tag.endswith("}sheet")]
        out = _core(z) | {"sheet_names": ",".join(sheets), "sheet_count": str(len(sheets))}
        first = next((n for n in sorted(z.namelist()) if n.startswith("xl/worksheets/sheet")), None)
        if first:
            cells = [e.get("r", "") for e in ET.fromstring(z.read(first)).iter() if e.tag.endswith("}c")]
            spots = [m.groups() for c in cells if (m := re.fullmatch(r"([A-Z]+)(\d+)", c))]
            number = lambda s: sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(s)))
            out |= {"active_sheet_rows": str(max((int(r) for _, r in spots), default=0)), "active_sheet_cols": str(max((number(c) for c, _ in spots), default=0))}
        return out


def pdf(content: bytes) -> dict[str, str]:
    """Page count and document information, in object streams too, and the text of simple content streams; what cannot be read is left out."""
    streams = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        data = m[1]
        if data[:1] == b"\x78":
            try:
                data = zlib.decompress(data)
            except zlib.error:
                continue
        streams.append((b"/ObjStm" in content[max(content.rfind(b"obj", 0, m.start()), 0) : m.start()], data))
    objects = b"\n".join([content, *(data for packed, data in streams if packed)])
    out = {"page_count": str(len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", objects)))}
    for key, name in (("Author", "author"), ("Creator", "creator"), ("Producer", "producer"), ("Title", "title"), ("Subject", "subject"), ("CreationDate", "creation_date"), ("ModDate", "modification_date")):
        m = re.search(rb"/" + key.encode() + rb"\s*\(((?:[^()\\]|\\.)*)\)", objects)
        if m:
            out[name] = m[1].decode("latin-1")
    text = [t.decode("latin-1") for packed, data in streams if not packed for t in re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*Tj", data)]
    return out | {"content_preview": "\n".join(text)[:PREVIEW]}


EXIF = {0x010F: "camera_make", 0x0110: "camera_model", 0x0131: "software", 0x0112: "orientation", 0x9003: "datetime_original", 0x9004: "datetime_digitized"}


def _tiff_tags(data: bytes) -> dict[str, str]:
    order = "<" if data[:2] == b"II" else ">"
    out: dict[str, str] = {}
    gps: dict[int, tuple] = {}

    def values(kind: int, count: int, raw: bytes) -> tuple:
        size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1}.get(kind, 0) * count
        spot = raw[:size] if size <= 4 else data[struct.unpack(order + "I", raw)[0] :][:size]
        if kind == 2:
            return (spot.split(b"\0")[0].decode("latin-1"),)
        if kind == 5:
            n = struct.unpack(order + f"{2 * count}I", spot)
            return tuple(a / b if b else 0.0 for a, b in zip(n[::2], n[1::2]))
        return struct.unpack(order + f"{count}{ {1: 'B', 3: 'H', 4: 'I', 7: 'B'}[kind]}", spot)

    def walk(at: int, into: Callable[[int, tuple], None]) -> None:
        for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
            tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
            try:
                into(tag, values(kind, count, data[at + 10 + 12 * i : at + 14 + 12 * i]))
            except (struct.error, KeyError):
                continue

    def top(tag: int, v: tuple) -> None:
        if tag in EXIF:
            out[EXIF[tag]] = str(v[0])
        elif tag in (0x0100, 0x0101):
            out["width" if tag == 0x0100 else "height"] = str(v[0])
        elif tag == 0x8769:
            walk(v[0], top)
        elif tag == 0x8825:
            walk(v[0], gps.__setitem__)

    walk(struct.unpack(order + "I", data[4:8])[0], top)
    if 2 in gps and 4 in gps:
        for name, ref, parts in (("latitude", gps.get(1, ("N",)), gps[2]), ("longitude", gps.get(3, ("E",)), gps[4])):
            d, m, s = (*parts, 0.0, 0.0)[:3]
            out[name] = str(round((d + m / 60 + s / 3600) * (-1 if ref[0] in ("S", "W") else 1), 8))
        if 6 in gps:
            out["altitude"] = str(round(gps[6][0] * (-1 if gps.get(5, (0,))[0] else 1), 2))
    return out


def image(content: bytes) -> dict[str, str]:
    """Format, size and EXIF tags with GPS in degrees, from the headers of PNG, JPEG, BMP and TIFF."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        w, h = struct.unpack(">II", content[16:24])
        return {"format": "PNG", "width": str(w), "height": str(h)}
    if content[:2] == b"BM":
        w, h = struct.unpack("<ii", content[18:26])
        return {"format": "BMP", "width": str(w), "height": str(abs(h))}
    if content[:4] in (b"II*\0", b"MM\0*"):
        return {"format": "TIFF"} | _tiff_tags(content)
    if content[:2] != b"\xff\xd8":
        raise ValueError("not an image")
    out, at = {"format": "JPEG"}, 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        mark, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
        part = content[at + 4 : at + 2 + size]
        if mark == 0xE1 and part[:6] == b"Exif\0\0":
            out |= _tiff_tags(part[6:])
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", part[1:5])
            out |= {"width": str(w), "height": str(h)}
            break
        at += 2 + size
    return out


def video(content: bytes) -> dict[str, str]:
    """Container and duration of MP4 (movie header box) and AVI (main header)."""
    if content[:4] == b"RIFF":
        at = content.find(b"avih")
        if at < 0:
            return {"container_format": "avi"}
        micros, frames = struct.unpack("<I", content[at + 8 : at + 12])[0], struct.unpack("<I", content[at + 24 : at + 28])[0]
        w, h = struct.unpack("<II", content[at + 40 : at + 48])
        rate = round(1e6 / micros, 2) if micros else 0.0
        return {"container_format": "avi", "duration_seconds": str(round(frames * micros / 1e6, 3)), "frame_rate": str(rate), "width": str(w), "height": str(h)}
    at = content.find(b"mvhd")
    out = {"container_format": content[8:12].decode("latin-1").strip()}
    if at >= 0:
        wide = content[at + 4] == 1
        scale, span = struct.unpack(">IQ" if wide else ">II", content[at + (24 if wide else 16) : at + (36 if wide else 24)])
        out["duration_seconds"] = str(round(span / scale, 3)) if scale else "0"
    return out


def probe_columns(probe: Column) -> dict[str, Column]:
    """A probing tool's JSON reply to columns."""
    kind = "struct<format:struct<format_name:string,duration:string,bit_rate:string>,streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string,sample_rate:string>>>"
    p = F.from_json(probe, kind)
    stream = lambda t: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == t), F.lit(0))
    rate = F.split(stream("video")["r_frame_rate"], "/")
    return {
        "container_format": p["format"]["format_name"], "duration_seconds": p["format"]["duration"].try_cast("double"), "bit_rate": p["format"]["bit_rate"].try_cast("long"),
        "video_codec": stream("video")["codec_name"], "width": stream("video")["width"], "height": stream("video")["height"],
        "frame_rate": F.round(F.try_divide(F.get(rate, F.lit(0)).try_cast("double"), F.get(rate, F.lit(1)).try_cast("double")), 2),
        "audio_codec": stream("audio")["codec_name"], "sample_rate": stream("audio")["sample_rate"].try_cast("int"),
    }


#: mime -> reader of bytes; add your own with register()
READERS: dict[str, Callable[[bytes], dict[str, str]]] = {
    "text/csv": csv_file,
    "application/pdf": pdf,
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": docx,
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": xlsx,
    "image/jpeg": image, "image/png": image, "image/tiff": image, "image/bmp": image,
    "video/mp4": video, "video/quicktime": video, "video/x-msvideo": video,
}


def register(mime: str, reader: Callable[[bytes], dict[str, str]]) -> None:
    READERS[mime] = reader


def extract(files: DataFrame, readers: dict[str, Callable[[bytes], dict[str, str]]] | None = None) -> DataFrame:
    """(path, mime, meta_type, metadata map) of scanned files. A file that cannot be read gives a row of type error, not a failure."""
    table = dict(readers or READERS)
    ship_package(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kinds, found = [], []
            for mime, content in zip(b["mime"], b["content"]):
                try:
                    found.append(table[mime](bytes(content)))
                    kinds.append("exif" if mime.startswith("image/") else "video" if mime.startswith("video/") else "document")
                except Exception as e:  # any malformed file: the error is the row
                    found.append({"error": f"{type(e).__name__}: {e}"})
                    kinds.append("error")
            yield pd.DataFrame({"path": b["path"], "mime": b["mime"], "meta_type": kinds, "metadata": found})

    known = files.where(F.col("mime").isin(*table))
    binary = known.select("path", "mime", "content").mapInPandas(run, "path string, mime string, meta_type string, metadata map<string,string>")
    text = files.where(F.col("mime") == "text/plain").select("path", "mime", F.col("content").cast("string").alias("t"))
    as_map = lambda cols: F.map_filter(F.create_map(*[x for n, c in cols.items() for x in (F.lit(n), c.cast("string"))]), lambda k, v: v.isNotNull())
    plain = text.select("path", "mime", F.lit("document").alias("meta_type"), as_map(text_metadata(F.col("t"))).alias("metadata"))
    j = files.where("mime = 'application/json'").select("path", "mime", F.col("content").cast("string").alias("t"))
    meta = json_metadata(F.col("t"))
    structured = j.select("path", "mime", F.when(meta["error"].isNull(), "structured").otherwise("error").alias("meta_type"), as_map({**meta, "top_level_keys": F.array_join(meta["top_level_keys"], ","), "sample_keys": F.array_join(meta["sample_keys"], ",")}).alias("metadata"))
    others = files.where(F.col("mime").isNull() | ~F.col("mime").isin(*table, "text/plain", "application/json"))
    unknown = others.select("path", "mime", F.lit("unknown").alias("meta_type"), F.create_map(F.lit("warning"), F.lit("no reader for this type")).alias("metadata"))
    return binary.unionByName(plain).unionByName(structured).unionByName(unknown)


def gps_column(degrees: Column, minutes: Column, seconds: Column, way: Column) -> Column:
    return dms(degrees, minutes, seconds, way)


def structured_payload(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """API payloads as JSON files' content: indented text with the JSON type forced."""
    body = F.to_json(F.struct(*cols), {"pretty": "true", "ignoreNullFields": "false"})
    return df.select(F.concat(F.lit("payload/"), F.col(key).cast("string"), F.lit(".json")).alias("path"), F.lit("application/json").alias("mime"), body.cast("binary").alias("content"))


def document_pages(files: DataFrame, split: Callable[[bytes], list[bytes]], most: int = 200) -> DataFrame:
    """(path, page, content): pages of documents by a function of your own, at most ``most`` each; a failing file has no pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    parts = split(bytes(content))[:most]
                except Exception:  # unreadable documents have no pages
                    parts = []
                if parts:
                    yield pd.DataFrame({"path": path, "page": range(1, len(parts) + 1), "content": parts})

    return files.select("path", "content").mapInPandas(run, "path string, page int, content binary")
