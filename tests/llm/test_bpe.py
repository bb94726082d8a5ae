import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from dossier.llm.bpe import Codec, PrefixTable, count_tokens, counter, decode_ids, encode_texts, parse_ranks, piece_pattern, splitter

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "a", "  \n\n x", "don't we'll", "a\x1c\x1d b\x85c d", "é" * 50, "aaaa" * 300, "日本語 テキスト🙂🙂", "<|endoftext|>", "x<|endoftext|>y <|endoftext|>", "1234567890" * 20, "!!!???///" * 9, "Aaá‍", "\u0000\u0001", "the " * 2000]


def texts(seed=1, n=300):
    r = random.Random(seed)
    letters = "abcdeths  \n\t.,'0123éüñ日🙂AZ"
    return ODD + ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def codec():
    return Codec(open(RANKS, "rb").read(), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_matches_library(codec, library):
    for t in texts():
        ids = codec.encode(t)
        assert ids == library.encode_ordinary(t), t
        assert codec.coder.decode(ids) == t.encode()


def test_ascii_splitter_is_the_pattern():
    r, split, pattern = random.Random(5), splitter(P.PATTERN), piece_pattern(P.PATTERN)
    for _ in range(3000):
        t = "".join(r.choice("aZ09 '\t\n\x0b\x0c\r\x1c\x1f\x00._-s tdm") for _ in range(r.randrange(40)))
        assert split(t) == pattern.findall(t), t


def test_prefix_table_appends_and_edits(codec):
    r = random.Random(3)
    for _ in range(40):
        data = bytes(r.choice(b"thaeingo") for _ in range(r.randrange(2, 200)))
        table = PrefixTable(codec.coder)
        for i in range(0, len(data), 7):
            table.append(data[i : i + 7])
        assert table.ids() == codec.coder.piece(data)
        a = r.randrange(len(data))
        b = r.randrange(a, len(data) + 1)
        new = bytes(r.choice(b"the ") for _ in range(r.randrange(6)))
        table.replace(a, b, new)
        assert table.data == data[:a] + new + data[b:]
        if table.data:
            assert table.ids() == codec.coder.piece(table.data)


def test_edit_recomputes_only_near_it(codec):
    table = PrefixTable(codec.coder, b"thingandthe" * 400)
    assert table.replace(100, 103, b"xyz") < 600


def test_counts_match_library():
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    c = counter(open(P.path("byte_bpe_50k.json"), "rb").read(), P.PATTERN)
    for t in texts(2):
        assert c.count(t) == len(lib.encode(t, add_special_tokens=False).ids), t


def test_tables_nulls_empties_repeats_and_clashing_columns(spark, codec):
    rows = [(1, None, 9, "k"), (2, "", 8, "k"), (2, "", 8, "k"), (3, "word " * 30_000, 7, "k"), (None, "a b", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, ids string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in encode_texts(df, RANKS, P.PATTERN, with_ids=True).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (1, 0, empty) in got and (2, 0, empty) in got and len(got) == 4
    back = {r.doc_id: bytes(r.decoded) for r in decode_ids(encode_texts(df, RANKS, P.PATTERN, with_ids=True), RANKS, P.PATTERN).collect()}
    assert back == {1: b"", 2: b"", 3: b"word " * 30_000, None: b"a b"}
    counts = count_tokens(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert sorted((r.n_bytes, r.over_limit) for r in counts) == [(0, False), (0, False), (0, False), (3, False), (150_000, True)]
    assert encode_texts(df.limit(0), RANKS, P.PATTERN).count() == 0
    assert count_tokens(df.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_ranks_parse():
    assert parse_ranks(b"YQ== 0\nYg== 1\n") == {b"a": 0, b"b": 1}
