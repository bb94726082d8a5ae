import hashlib

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from dossier.llm.bpe import parse_ranks
from dossier.llm.quality import ACCEPT, SLOPE, Indicators, logistic, train
from tests.llm.test_decontam import plain as plain_leaks
from tests.llm.test_linededup import plain as plain_lines
from tests.llm.test_shingles import plain_components

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{DIR}/{n}.parquet") for n in ("documents", "labels", "benchmark")}


def test_stages_keep_columns_and_match_plain_versions(spark, tables):
    """Every stage on all that its predecessor kept, against a plain version of it."""
    docs = tables["documents"]
    names = docs.columns
    rows = {x.doc_id: x for x in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        model = train(docs, tables["labels"]) if name == "quality" else None
        out = stage(spark, docs, DIR).cache()
        got = {x.doc_id: x for x in out.collect()}
        texts = {i: x.text for i, x in rows.items()}
        if name == "quality":
            find = Indicators()
            want = {i for i, t in texts.items() if logistic(SLOPE * model.margin(find(t or ""))) >= ACCEPT}
            assert set(got) == want and 0 < len(want) < len(rows)
        elif name == "line_dedup":
            lines = plain_lines([(i, x.source, x.text) for i, x in rows.items()], 0.08, 2)
            assert {i: x.text for i, x in got.items()} == {i: t for i, t, _, _ in lines}
            assert all(x.n_chars == len(x.text) for x in got.values())
        elif name == "simhash_dedup":
            assert set(got) == set(plain_components(texts, 5, 0.8).values())
        elif name == "decontamination":
            items = [tuple(x) for x in tables["benchmark"].select("item_id", "text").collect()][:3]
            assert not {d for d, _, _ in plain_leaks(items, [x for x in texts.items() if len(x[1]) < 3000])} & set(got)
            assert set(got) <= set(rows) and len(got) > 0.8 * len(rows)
        else:
            enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=parse_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), special_tokens={})
            for i, x in got.items():
                assert x.ids == enc.encode_ordinary(texts[i]) and x.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()
            assert set(got) == set(rows)
            continue
        assert out.columns == names
        docs, rows = out, got
    assert {x.doc_id for x in corpus_pipeline.run(spark, DIR).select("doc_id").collect()} == set(rows)


def test_stages_take_nulls_repeats_empties_and_extra_columns(spark):
    rows = [(1, None, "en", "a", 0, "x"), (2, "", "en", None, 0, "x"), (3, "The thing " * 9, None, "a", 1, "x"), (3, "The thing " * 9, None, "a", 1, "x"), (None, "other words here", "en", "a", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, DIR)
            assert name == "bpe" or out.columns == docs.columns
            assert out.count() <= df.count()
    assert sorted(x.doc_id or 0 for x in corpus_pipeline.simhash_dedup(spark, docs, DIR).collect()) == [0, 1, 3]
