"""Which encoding bytes are in: order marks, byte classes of each encoding, and how often its commonest characters occur."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

#: Below this score nothing is recognized, and bytes that are not UTF-8 are taken for Western ones.
LEAST = 0.2
_UTF8 = r"[\x00-\x7F]++|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"
#: Words, Latin ones too: a text of mostly Latin words is no Cyrillic one.
_WORDS = r"[A-Za-z\x80-\xFF]++"
_WITH_LATIN = r"(?<![A-Za-z\x80-\xFF])[\x80-\xFF]*+[A-Za-z][A-Za-z\x80-\xFF]*+"
#: Different letters, of either case, that Cyrillic words have among them at least; Western words of accented letters alone have fewer.
LETTERS = 6
_BELOW, _ABOVE = "".join(map(chr, range(0xC0, 0xE0))), "".join(map(chr, range(0xE0, 0x100)))

#: (name, characters beyond ASCII, the commonest of them, their usual share). A byte is a character of U+0000 to U+00FF here.
FORMS = [
    ("shift_jis", r"[\x81-\x9F\xE0-\xFC][\x40-\x7E\x80-\xFC]|[\xA1-\xDF]", r"^[\x82\x83]", 0.4),
    ("euc-jp", r"\x8F[\xA1-\xFE]{2}|\x8E[\xA1-\xDF]|[\xA1-\xFE]{2}", r"^[\xA4\xA5]", 0.4),
    # 한 이 다 는 의 가 을 에 고 하 은 를 도 지 로 사 서 나 어 니
    ("euc-kr", r"[\x81-\xFE][\x41-\x5A\x61-\x7A\x81-\xFE]", r"^(?:\xC7\xD1|\xC0\xCC|\xB4\xD9|\xB4\xC2|\xC0\xC7|\xB0\xA1|\xC0\xBB|\xBF\xA1|\xB0\xED|\xC7\xCF|\xC0\xBA|\xB8\xA6|\xB5\xB5|\xC1\xF6|\xB7\xCE|\xBB\xE7|\xBC\xAD|\xB3\xAA|\xBE\xEE|\xB4\xCF)", 0.3),
    # 的 是 不 了 一 在 有 我 人 这 大 中 和 上 国 他 们 来 时 为, the comma and the full stop
    ("gb18030", r"[\x81-\xFE][\x30-\x39][\x81-\xFE][\x30-\x39]|[\x81-\xFE][\x40-\x7E\x80-\xFE]", r"^(?:\xB5\xC4|\xCA\xC7|\xB2\xBB|\xC1\xCB|\xD2\xBB|\xD4\xDA|\xD3\xD0|\xCE\xD2|\xC8\xCB|\xD5\xE2|\xB4\xF3|\xD6\xD0|\xBA\xCD|\xC9\xCF|\xB9\xFA|\xCB\xFB|\xC3\xC7|\xC0\xB4|\xCA\xB1|\xCE\xAA|\xA3\xAC|\xA1\xA3)", 0.2),
    # the same in traditional form
    ("big5", r"[\x81-\xFE][\x40-\x7E\xA1-\xFE]", r"^(?:\xAA\xBA|\xAC\x4F|\xA4\xA3|\xA4\x46|\xA4\x40|\xA6\x62|\xA6\xB3|\xA7\xDA|\xA4\x48|\xB3\x6F|\xA4\x6A|\xA4\xA4|\xA9\x4D|\xA4\x57|\xB0\xEA|\xA5\x4C|\xAD\xCC|\xA8\xD3|\xAE\xC9|\xAC\xB0|\xA1\x41|\xA1\x43)", 0.2),
    # о е а и н т с р в л, in words of two letters and more; a word with a Latin letter is no Cyrillic one
    ("windows-1251", _WORDS, r"^(?!.*[A-Za-z])(?:[\xEE\xE5\xE0\xE8\xED\xF2\xF1\xF0\xE2\xEB\xCE\xCD\xCF\xC2\xD1]{1,}[\x80-\xFF]*[\xE0-\xFF])", 0.7),
    ("koi8-r", _WORDS, r"^(?!.*[A-Za-z])(?:[\xCF\xC5\xC1\xC9\xCE\xD4\xD3\xD2\xD7\xCC\xEF\xEE\xF0\xF7\xF3]{1,}[\x80-\xFF]*[\xC0-\xDF])", 0.7),
]
#: A byte beyond ASCII between plain ones, as in Western European words.
ALONE = r"(?<![\x80-\xFF])[\xC0-\xFF\x80-\x9F\xA0-\xBF](?![\x80-\xFF])"


def _share(s: Column, tokens: str, common: str, usual: float) -> Column:
    """How like the form the bytes are: 0 if some fit no character, else the share of common ones against the usual."""
    rest = F.regexp_replace(F.regexp_replace(s, tokens, ""), r"[\x00-\x7F]+", "")
    found = F.regexp_extract_all(s, F.lit(tokens), F.lit(0))
    share = lambda t: F.size(F.filter(t, lambda x: x.rlike(common))) / F.greatest(F.size(t), F.lit(1))
    return F.when(F.length(rest) > 0, 0.0).otherwise(F.least(F.lit(1.0), bind(found, share) / usual))


def _cyrillic(s: Column) -> Column:
    """Whether the words without a Latin letter have letters enough among them; the halves of the table are the cases of both forms."""
    own = F.translate(F.regexp_replace(s, _WITH_LATIN, ""), _BELOW, _ABOVE)
    return bind(own, lambda w: sum(F.contains(w, F.lit(c)).cast("int") for c in _ABOVE) >= LETTERS)


def _guess(s: Column) -> Column:
    """(confidence, name) of bytes that are neither marked nor UTF-8."""
    return bind(_cyrillic(s), lambda cyrillic: _best(s, cyrillic))


def _best(s: Column, cyrillic: Column) -> Column:
    high = F.regexp_count(s, F.lit(r"[\x80-\xFF]"))
    share = lambda tokens, common, usual: F.when(cyrillic, _share(s, tokens, common, usual)).otherwise(0.0) if tokens == _WORDS else _share(s, tokens, common, usual)
    scores = [F.struct(share(*form).alias("sure"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, *form) in enumerate(FORMS)]
    latin = F.when(s.rlike(r"[\x80-\x9F]"), "windows-1252").otherwise("iso-8859-1")
    alone = F.regexp_count(s, F.lit(ALONE)) / F.greatest(high, F.lit(1))
    scores.append(F.struct(F.least(F.lit(1.0), alone / 0.7).alias("sure"), F.lit(1).alias("place"), latin.alias("name")))
    best = F.array_max(F.array(*scores))
    return bind(best, lambda b: F.when(b["sure"] >= LEAST, F.struct(F.round(b["sure"] * 0.99, 4).alias("sure"), b["name"].alias("name"))).otherwise(F.struct(F.lit(LEAST).alias("sure"), latin.alias("name"))))


def encoding(content: Column) -> tuple[Column, Column]:
    """(name, confidence) of all bytes; null for null.

    In this order: an order mark; UTF-32 and UTF-16 by the zero bytes of Latin text; UTF-8 (ASCII too);
    then East Asian, Cyrillic and Western forms by how much of what the bytes say is common there. What
    nothing fits is Western, as every byte is a character there. Short texts without
    common characters may be taken for a neighbour form (GB for EUC-KR, one Cyrillic form for the other).
    """
    chars = F.decode(content, "ISO-8859-1")
    sure = lambda name, c=1.0: F.struct((F.lit(c) if isinstance(c, float) else c).alias("sure"), F.lit(name).alias("name"))

    def name(s: Column) -> Column:
        pairs = F.greatest(F.floor(F.length(s) / 2), F.lit(1))
        zeros = lambda keep: (F.length(keep) - F.length(F.replace(keep, F.lit("\0"), F.lit("")))) / pairs
        first, second = zeros(F.regexp_replace(s, r"(?s)(.)(.)", "$1")), zeros(F.regexp_replace(s, r"(?s)(.)(.)", "$2"))
        plain = F.when(F.regexp_replace(s, _UTF8, "") == "", sure("utf-8")).otherwise(_guess(s))
        by_four = (F.length(s) >= 4) & (F.length(s) % 4 == 0)
        return (
            F.when(s.startswith("ï»¿"), sure("utf-8-sig")).when(s.startswith("ÿþ\0\0"), sure("utf-32-le")).when(s.startswith("\0\0þÿ"), sure("utf-32-be"))
            .when(s.startswith("ÿþ"), sure("utf-16-le")).when(s.startswith("þÿ"), sure("utf-16-be"))
            .when(~F.contains(s, F.lit("\0")), plain)  # the wide forms of Latin text have zero bytes
            .when(by_four & (F.regexp_replace(s, r"(?s)\x00[\x00-\x10][^\x00].|\x00\x00.{2}", "") == "") & (first > 0.5), sure("utf-32-be"))
            .when(by_four & (F.regexp_replace(s, r"(?s).[^\x00][\x00-\x10]\x00|.{2}\x00\x00", "") == "") & (second > 0.5), sure("utf-32-le"))
            .when((second > 0.3) & (first < 0.05), sure("utf-16-le", F.round(F.least(F.lit(1.0), second), 4))).when((first > 0.3) & (second < 0.05), sure("utf-16-be", F.round(F.least(F.lit(1.0), first), 4)))
            .otherwise(plain)
        )

    said = bind(chars, name)
    return F.when(content.isNotNull(), said["name"]), F.when(content.isNotNull(), said["sure"])
