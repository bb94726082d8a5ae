import base64
import glob
import hashlib
from collections import Counter

import pytest

from dossier.llm.warc import archived_pages, read_archive, write_archive

FAKE = "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:dossier:page:9999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
BIG = "\r\n\r\nWARC/1.1\r\nContent-Length: 99999999\r\n\r\n"
ROWS = [
    (3, "http://a", "same"), (1, "http://b", "same"), (2, "http://c\r\nX: y", "same"), (7, None, None), (6, "u", ""), (8, "WARC/1.1", "WARC/1.1\r\n\r\nx"), (9, "v", FAKE), (10, "w", FAKE * 3 + "é🙂"), (11, "x", BIG + FAKE),
    (12, "y", "\r\n\r\n" * 5), (13, "z", "WARC/1.\r\n\r\nWARC/1.\r\n\r\nWARC/1."), (14, "z", "long " * 20_000), (15, "z", FAKE * 400), (15, "z", FAKE * 400), (16, "q", "\r\n"), (17, "q", "\r\n\r\nWARC/1."), (None, "n", "same"), (None, "n", "alone"), (1, "dup", "another payload of page 1"),
]


def want(rows, least=0):
    pay = [(i, (h or "").encode()) for i, _, h in rows]
    out = Counter()
    for i, p in pay:
        ids = [j for j, q in pay if q == p and j is not None]
        again = len(p) >= least and sum(q == p for _, q in pay) > 1 and ids and i != min(ids)
        out[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", min(ids) if again else None] += 1
    return out


@pytest.mark.parametrize("split", ["128m", "700", "97", "1337"])
def test_round_trip_rejects_magic_in_payloads(spark, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    df = spark.createDataFrame([(*x, 1) for x in ROWS], "page_id long, url string, html string, type int").coalesce(2)
    if split == "97":
        df = df.where("page_id is null or page_id not in (14, 15)")
    rows = [x for x in ROWS if split != "97" or x[0] not in (14, 15)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = Counter(map(tuple, archived_pages(df).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want(rows)


def test_least_bytes_and_empty(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    assert Counter(map(tuple, archived_pages(df, least=5).collect())) == want(ROWS, 5)
    assert archived_pages(df.limit(0)).count() == 0


def test_files_are_plain_warc_and_broken_ends_stop(spark, tmp_path):
    path = f"{tmp_path}/w"
    write_archive(spark.createDataFrame([(i, "u", f"p{i}") for i in range(5)], "page_id long, url string, html string").coalesce(1), path)
    (name,) = glob.glob(f"{path}/part*")
    data, n = open(name, "rb").read(), 0
    while data:
        assert data.startswith(b"WARC/1.1\r\n")
        head, _, rest = data.partition(b"\r\n\r\n")
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert rest[size : size + 4] == b"\r\n\r\n"
        data, n = rest[size + 4 :], n + 1
    assert n == 5
    raw = open(name, "rb").read()
    other = tmp_path / "cut"
    other.mkdir()
    (other / "x").write_bytes(raw.replace(b"p2", b""))
    assert read_archive(spark, str(other)).count() == 3
