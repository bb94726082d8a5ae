"""WARC archives: writing with revisits, and reading by boundary-chain verification (op4)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, claim, materialize, new_path, ship_code

END = "\r\n\r\n"
MAGIC = "WARC/1."
#: Texts are split here. No header holds it, and its first byte does not come again in it: the split
#: reader underneath can miss a delimiter that overlaps itself where its buffer ends.
CUT = "\n" + MAGIC
#: Bits of a stretch of a file (1 MB) in which pieces meet the records that they belong to.
STRETCH_BITS = 20
RECORD = "urn:dossier:page:"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- writing


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: four groups of 40 bits, eight digits each."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(data), 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archive(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per row to WARC 1.1 files under ``path``, a file per task.

    Of rows with equal payloads (by SHA-1 and length) of at least ``least`` bytes, those with the
    smallest id are responses, the others revisits of it; all other rows are responses. The payload is
    the html in UTF-8, null counts as empty. A row without id is never the one referred to. Line breaks
    in an address are written as %0A. Digests and ids are shuffled; the pages too, once, if more than
    200,000 payloads come again.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]+", "%0A").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "size": F.octet_length("html")})
    groups = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    groups = materialize(groups.select("digest", "size", "first"), "payloads")
    rows = rows.join(broadcast_if_small(groups), ["digest", "size"], "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    name = lambda c: F.concat(F.lit(f"<{RECORD}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(F.col("block")).cast("string")),
    )
    rows.withColumn("block", block).select(F.concat(head, F.lit(END), F.col("block")).alias("value")).write.option("lineSep", END).text(path)


# ---------------------------------------------------------------- reading


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, length, value binary): what stands between cuts, in order inside each split of a file."""
    read = spark.read.option("lineSep", CUT).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_block_length").alias("length"), F.col("value").cast("binary").alias("value"))


def headers(head: bytes) -> dict[bytes, bytes]:
    found: dict[bytes, bytes] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


def payload_of(block: bytes, kind: bytes) -> bytes:
    """The block without its HTTP headers, if it has such."""
    return block.partition(END.encode())[2] if kind.startswith(b"application/http") else block


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Split:
    """The candidates of one split. Offsets count from the first cut of the split, as only the splits
    before it tell where that is; a task sees its own split only."""

    def __init__(self, file: str, start: int, length: int):
        self.file, self.start, self.length, self.at, self.rows = file, start, length, 0, []
        self.last, self.from_last = 0, False  # where the last piece begins; whether it is a candidate

    def add(self, value: bytes) -> None:
        head_start = self.start == 0 and self.at == 0
        self.last, self.from_last = self.at, False
        own = self.at if head_start else self.at - len(MAGIC)
        head, _, rest = value.partition(END.encode())
        fields = headers(head)
        length = fields.get(b"content-length", b"")
        if length.isdigit() and len(length) < 16 and (not head_start or value.startswith(MAGIC.encode())):
            size = int(length)
            body = self.at + len(head) + len(END)
            whole = len(rest) >= size
            kind = fields.get(b"content-type", b"")
            payload = payload_of(rest[:size], kind) if whole else None
            self.from_last = True
            text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
            self.rows.append((own, body + size + len(END), body, size, whole, text(b"content-type"), text(b"warc-type"), text(b"warc-record-id"), text(b"warc-refers-to"), text(b"warc-target-uri"), text(b"warc-payload-digest"), None if payload is None else len(payload), None if payload is None else digest(payload)))
        self.at += len(value) + len(CUT)

    def chains(self) -> tuple[list[tuple[int, int]], list[tuple]]:
        """Each candidate's (chain, place), and each chain's end: (next offset, or chain and place that it
        runs into; its last candidate's offset if that is of the split's last piece).

        A chain follows successors from the first candidate that is in none yet, until it leaves the
        split, finds no candidate, or runs into an older chain.
        """
        index = {r[0]: i for i, r in enumerate(self.rows)}
        spot: list[tuple[int, int] | None] = [None] * len(self.rows)
        ends: list[tuple] = []
        for i in range(len(self.rows)):
            if spot[i] is not None:
                continue
            chain, place, now = len(ends), 0, i
            while True:
                spot[now] = (chain, place)
                place += 1
                after = self.rows[now][1]
                following = index.get(after)
                if following is None:
                    ends.append((chain, after, None, None, self.rows[now][0] if self.from_last and now == len(self.rows) - 1 else None))
                    break
                if spot[following] is not None:
                    ends.append((chain, None, *spot[following], None))
                    break
                now = following
        return spot, ends  # type: ignore[return-value]


SCAN = "what string, file string, split bigint, chain int, place int, own bigint, after bigint, body bigint, size bigint, whole boolean, content_type string, type string, record string, refers string, uri string, declared string, payload_bytes bigint, payload_digest string, into int, into_place int"


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates ('c'), chain ends ('e') and lengths ('s') of the splits that a task reads."""
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SCAN.split(", ")])

    def done(s: Split) -> pa.RecordBatch:
        spot, ends = s.chains()
        rows = [("c", s.file, s.start, *spot[i], *r, None, None) for i, r in enumerate(s.rows)]
        none = [None] * 10
        rows += [("e", s.file, s.start, chain, None, own, after, None, *none, into, place) for chain, after, into, place, own in ends]
        rows.append(("s", s.file, s.start, None, None, s.last, s.at, s.length, *none, None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(zip(*rows), SCAN.split(", "))], schema=schema)

    claim("warc")
    now: Split | None = None
    for batch in batches:
        for file, start, length, value in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
            if now is None or (now.file, now.start) != (file, start):
                if now is not None:
                    yield done(now)
                now = Split(file, start, length)
            now.add(value.as_py())
    if now is not None:
        yield done(now)


def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces with their place in the split, for a second look."""
    key, at = None, 0
    for batch in batches:
        places = []
        for file, start, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
            if key != (file, start):
                key, at = (file, start), 0
            places.append(at)
            at += len(value.as_buffer() or b"") + len(CUT)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(places, pa.int64())], names=["file", "split", "value", "at"])


def bases(found: DataFrame) -> DataFrame:
    """(file, split, base, upto): where a split's first piece begins in the file, and from where its pieces are void.

    A reader of splits hands out one piece too many if its split ends inside what looked like a cut and
    was none; the next split then has that piece too. It shows by its cut lying beyond the split. The
    splits of a file (its size over the split size, short rows) are summed in order.
    """
    row = F.struct("split", F.col("own").alias("last"), F.col("after").alias("total"), F.col("body").alias("length"))
    files = found.where("what = 's'").groupBy("file").agg(F.array_sort(F.collect_list(row)).alias("splits"))
    kind = "array<struct<split:bigint,base:bigint,upto:bigint>>"

    def step(state: Column, x: Column) -> Column:
        last = state["at"] + x["last"]
        void = last - len(CUT) >= x["split"] + x["length"]
        after = F.when(void, last).otherwise(state["at"] + x["total"])
        one = F.struct(x["split"].alias("split"), state["at"].alias("base"), F.when(void, last).alias("upto"))
        return F.struct(after.alias("at"), F.concat(state["out"], F.array(one)).cast(kind).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("out"))
    return files.select("file", F.inline(F.aggregate("splits", start, step, lambda z: z["out"])))


def reached(chains: DataFrame) -> DataFrame:
    """(file, split, chain, place): the chains that the starts of files lead to, and where they are entered.

    ``chains``: file, split, chain, and to_split, to_chain, to_place of what follows, null at an end.
    Pointer jumping: each round follows jumps twice as long, so rounds grow with the logarithm of the
    splits of a file.
    """
    node = ["file", "split", "chain"]
    jump = chains.where("to_chain is not null")
    on = chains.where("split = 0 and chain = 0").select(*node, F.lit(0).alias("place"))
    while not jump.isEmpty():
        far = jump.select("file", F.col("split").alias("s"), F.col("chain").alias("c"), F.col("to_split").alias("s2"), F.col("to_chain").alias("c2"), F.col("to_place").alias("p2"))
        here = on.join(far, (on.file == far.file) & (on.split == far.s) & (on.chain == far.c)).select(on.file, far.s2.alias("split"), far.c2.alias("chain"), far.p2.alias("place"))
        on = materialize(on.union(here).distinct(), "reached")
        twice = jump.alias("j").join(far.alias("f"), (F.col("j.file") == F.col("f.file")) & (F.col("to_split") == F.col("s")) & (F.col("to_chain") == F.col("c")))
        jump = materialize(twice.select("j.file", "j.split", "j.chain", F.col("s2").alias("to_split"), F.col("c2").alias("to_chain"), F.col("p2").alias("to_place")), "jumps")
    return on


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under ``path``.

    Returns file, offset, size (of the block), content_type, type, record, refers, uri, declared (its
    payload digest), payload_bytes and payload_digest of what the record itself holds.

    Every magic at the start of a line is a candidate, with its successor by its declared length. Only
    those that the start of a file leads to are records: magic inside a payload is never one. Payloads
    that hold magic are put together from their pieces in a second look at the files. A chain that
    meets no record ends there. Files of any size are read in splits.
    """
    ship_code(spark)
    found = materialize(pieces(spark, path).mapInArrow(scan, SCAN), "scan")
    placing = materialize(bases(found), "bases")
    cands = found.where("what = 'c'").join(broadcast_if_small(placing), ["file", "split"]).withColumns({c: F.col(c) + F.col("base") for c in ("own", "after", "body")})
    cands = cands.where(F.col("upto").isNull() | (F.col("own") < F.col("upto") - len(MAGIC)))
    ends = found.where("what = 'e'").join(broadcast_if_small(placing), ["file", "split"])
    ends = ends.select("file", "split", "chain", (F.col("base") + F.when(F.col("upto").isNull(), F.col("after")).otherwise(F.coalesce("own", "after"))).alias("after"), "into", "into_place")
    at = cands.select("file", F.col("own").alias("after"), F.col("split").alias("s"), F.col("chain").alias("c"), F.col("place").alias("p"))
    leaves = ends.where("into is null").join(at, ["file", "after"], "left").select("file", "split", "chain", F.col("s").alias("to_split"), F.col("c").alias("to_chain"), F.col("p").alias("to_place"))
    runs = ends.where("into is not null").select("file", "split", "chain", F.col("split").alias("to_split"), F.col("into").alias("to_chain"), F.col("into_place").alias("to_place"))
    on = reached(materialize(leaves.union(runs), "chains"))
    real = cands.join(broadcast_if_small(on.select("file", "split", "chain", F.col("place").alias("entered"))), ["file", "split", "chain"]).where("place >= entered")
    real = materialize(real.select("file", F.col("own").alias("offset"), "body", "size", "whole", "content_type", "type", "record", "refers", "uri", "declared", "payload_bytes", "payload_digest"), "records")
    split_up = real.where("not whole")
    whole = real.where("whole").drop("body", "whole")
    if split_up.isEmpty():
        return whole
    # a record's pieces begin inside it: they meet it by stretches of the file, however many records or pieces a file has
    stretch = lambda c: F.shiftright(c, STRETCH_BITS)
    placed = pieces(spark, path).mapInArrow(offsets, "file string, split bigint, value binary, at bigint").join(broadcast_if_small(placing), ["file", "split"]).withColumn("at", F.col("at") + F.col("base")).where(F.col("upto").isNull() | (F.col("at") < F.col("upto")))
    placed = placed.select("file", stretch(F.col("at")).alias("stretch"), "at", "value")
    wanted = split_up.select("file", "offset", "body", "size", (F.col("body") + F.col("size")).alias("end"))
    wanted = wanted.withColumn("stretch", F.explode(F.sequence(stretch(F.col("offset")), stretch(F.col("end")))))
    parts = placed.join(broadcast_if_small(wanted), ["file", "stretch"]).where((F.col("at") >= F.col("offset")) & (F.col("at") < F.col("end")))
    blocks = parts.groupBy("file", "offset").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"), F.first("body").alias("body"), F.first("size").alias("length"))
    late = split_up.drop("payload_bytes", "payload_digest", "body", "whole").join(blocks, ["file", "offset"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, at = (batch.schema.get_field_index(c) for c in ("content_type", "parts"))
            body, length = (batch.schema.get_field_index(c) for c in ("body", "length"))
            got = []
            for k, some, first, n in zip(*(batch.column(c).to_pylist() for c in (kind, at, body, length))):
                whole = CUT.encode().join([*(x["value"] for x in some), b""])
                start = first - some[0]["at"]
                got.append(payload_of(whole[start : start + n], (k or "").encode()))
            keep = [i for i in range(batch.num_columns) if i not in (at, body, length)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array([len(p) for p in got], pa.int64()), pa.array([digest(p) for p in got])], names=[*[batch.schema.names[i] for i in keep], "payload_bytes", "payload_digest"])

    kinds = ", ".join(f"{n} {t}" for n, t in late.drop("parts", "body", "length").dtypes)
    return whole.unionByName(late.mapInArrow(finish, kinds + ", payload_bytes bigint, payload_digest string"))


def archived_pages(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages to archives in the shared folder, read them back, and resolve the revisits.

    Returns ``id_col``, payload_bytes, payload_digest (both of the full payload), record_type,
    refers_to. Repeated rows are records of their own (those of the smallest id are all responses); an
    empty table gives an empty result; other columns are not archived.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archive(pages, path, least, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType
    number = lambda c: F.nullif(F.regexp_extract(c, f"{RECORD}([^>]*)", 1), F.lit("")).cast(kind)
    records = materialize(read_archive(spark, path).select(number(F.col("record")).alias("id"), number(F.col("refers")).alias("refers_to"), "type", F.regexp_replace("declared", "^sha1:", "").alias("declared"), "payload_bytes", "payload_digest"), "pages")
    first = records.where("type = 'response'").groupBy(F.col("id").alias("of"), F.col("declared").alias("of_digest")).agg(F.min("payload_bytes").alias("full"))
    again = records.where("type = 'revisit'").join(first, (F.col("refers_to") == F.col("of")) & (F.col("declared") == F.col("of_digest")), "left")
    again = again.select("id", F.col("full").alias("payload_bytes"), F.col("declared").alias("payload_digest"), "type", "refers_to")
    own = records.where("type = 'response'").select("id", "payload_bytes", "payload_digest", "type", "refers_to")
    return own.union(again).select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
