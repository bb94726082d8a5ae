from collections import Counter, defaultdict

from dossier.llm import common, linededup
from dossier.llm.linededup import drop_boilerplate


def plain(rows, ratio, least):
    total, pages = Counter(), defaultdict(Counter)
    for _, host, text in rows:
        total[host] += 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            pages[host][line] += 1
    out = []
    for i, host, text in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not x.strip(" ") or not (pages[host][x.strip(" ")] >= least and pages[host][x.strip(" ")] > ratio * total[host])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def rows():
    out = []
    for i in range(60):
        host = ["big", "small", None, ""][0 if i < 36 else i % 4]
        out.append((i, host, "\n".join(["Menu", f"unique {i}", " Menu ", "", f"page {i % 3}", "tie" if i % 12 == 0 else "x" * i])))
    return out + [(100, "big", None), (101, "big", ""), (102, "big", "Menu\n" * 20_000), (5, "big", "Menu"), (None, "small", "Menu\nown")]


def test_matches_plain_both_ways(spark, monkeypatch):
    df = spark.createDataFrame([(*x, 7, "n") for x in rows()], "doc_id long, source string, text string, n_lines int, host string")
    for bound in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(linededup, "BROADCAST_ROWS", bound)
        got = drop_boilerplate(df, ratio=0.25, min_pages=3)
        assert set(got.columns) == {"doc_id", "source", "text", "n_lines", "n_dropped", "host"}
        assert Counter((x.doc_id, x.text, x.n_lines, x.n_dropped) for x in got.collect()) == plain(rows(), 0.25, 3)


def test_empty(spark):
    assert drop_boilerplate(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_small_host_loses_what_repeats(spark):
    """On a host of four pages a line of all four goes, lines of one page stay; a host of one page loses nothing."""
    rows = [(i, "four", f"Menu\nonly {i}") for i in range(4)] + [(9, "one", "Menu\nonly 9")]
    got = {x.doc_id: (x.text, x.n_dropped) for x in drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got == {i: (f"only {i}", 1) for i in range(4)} | {9: ("Menu\nonly 9", 0)}


def test_any_column_names(spark):
    """Columns of the input keep their names and values, whatever these are."""
    odd = ["__host", "__at", "__known", "__kept", "host", "known", "kept", "here", "c0", "c1", "h1"]
    rows = [(i, "h", f"Menu\nown {i}", *range(len(odd))) for i in range(30)]
    got = drop_boilerplate(spark.createDataFrame(rows, ["doc_id", "source", "text", *odd]))
    assert got.columns == ["doc_id", "source", "text", *odd, "n_lines", "n_dropped"]
    assert sorted(tuple(x) for x in got.collect()) == [(i, "h", f"own {i}", *range(len(odd)), 2, 1) for i in range(30)]


def test_long_page_and_many_boilerplate_lines(spark):
    """A page of 200,000 lines on a host with 20,000 boilerplate lines."""
    menu = [f"m {i}" for i in range(20_000)]
    rows = [(i, "h", "\n".join(menu)) for i in range(12)] + [(99, "h", "\n".join([*menu, *[f"own {i}" for i in range(180_000)]]))]
    got = {x.doc_id: (x.n_lines, x.n_dropped) for x in drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got == {i: (20_000, 20_000) for i in range(12)} | {99: (200_000, 20_000)}
