"""Encodings of texts in many scripts, with and without order marks."""

import pytest
from pyspark.sql import functions as F

from dossier.functions.encoding import encoding

RU = "Государственный судебно-медицинский эксперт осмотрел тело на месте происшествия и составил протокол. Смерть наступила ночью от потери крови. " * 3
JA = "遺体は発見された時にすでに死後硬直が見られた。目撃者の話によると、被害者は夜の間に自宅で倒れていたという。現場の記録をここに残す。" * 3
KO = "피해자는 어제 밤에 집에서 발견되었다. 경찰은 현장에서 여러 가지 증거를 수집하고 있으며 사망 원인은 아직 확인되지 않았다고 한다. " * 3
ZH = "我们在现场发现了一个人的尸体，这是在昨天晚上的时候。他的家人不在家，警察来了以后说这个人是从外地来的。中国的法医和大家一起工作。" * 3
TW = "我們在現場發現了一個人的屍體，這是在昨天晚上的時候。他的家人不在家，警察來了以後說這個人是從外地來的。中國的法醫和大家一起工作。" * 3
FR = "Le décès a été constaté à la clinique; l'examen a révélé une plaie au côté gauche. Où et quand, on l'ignore déjà. " * 3
CASES = [(RU, "cp1251", "windows-1251"), (RU, "koi8_r", "koi8-r"), (JA, "shift_jis", "shift_jis"), (JA, "euc_jp", "euc-jp"), (KO, "euc_kr", "euc-kr"), (ZH, "gb18030", "gb18030"), (TW, "big5", "big5"), (FR, "latin_1", "iso-8859-1"), (FR + " “—” ", "cp1252", "windows-1252"), (FR, "utf_16_le", "utf-16-le"), (FR, "utf_32_le", "utf-32-le")]


def test_encodings_of_many_scripts(spark):
    rows = [(i, bytearray(t.encode(c)), want) for i, (t, c, want) in enumerate(CASES)]
    rows += [(100 + i, bytearray(t.encode("utf-8")), "utf-8") for i, t in enumerate([RU, JA, KO, ZH, FR, "plain", ""])]
    rows += [(200, bytearray(RU.encode("utf-8-sig")), "utf-8-sig"), (201, bytearray(JA.encode("utf-16")), "utf-16-le"), (202, bytearray(b"\xfe\xff" + JA.encode("utf-16-be")), "utf-16-be"), (203, bytearray(JA.encode("utf-32")), "utf-32-le"), (204, None, None)]
    rows += [(300 + i, bytearray(("x" * i + "é—😀" * 3000).encode("utf-8")), "utf-8") for i in range(4)]  # a character over the cut
    df = spark.createDataFrame(rows, "i int, b binary, want string")
    name, sure = encoding(F.col("b"))
    got = df.select("i", "want", name.alias("name"), sure.alias("sure")).collect()
    assert {x.i: x.name for x in got} == {x.i: x.want for x in got}
    assert all(x.sure is None if x.want is None else 0.2 < x.sure <= 1 for x in got)


@pytest.mark.parametrize("content", [b"\xff\xff\xff\xff", bytes(range(128, 256)), b"\x00", b"\x00" * 50, b"\xe9"])
def test_odd_bytes_get_some_name(spark, content):
    name, sure = encoding(F.col("b"))
    row = spark.createDataFrame([(bytearray(content),)], "b binary").select(name.alias("n"), sure.alias("s")).first()
    assert row.n and 0 < row.s <= 1
