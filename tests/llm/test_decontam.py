import random
import tracemalloc

from dossier.llm import decontam
from dossier.llm.decontam import Search, contaminated, normalize, without_contaminated


def least_edits(item, text):
    """Edits of the best occurrence of item in text: the plain table, free at both ends of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def prose(r, n):
    return " ".join("".join(r.choice("the ing er on an st re th ou".split()) for _ in range(r.randrange(1, 4))) for _ in range(n))


def edited(r, t, n):
    t = list(t)
    for _ in range(n):
        k, at = r.randrange(3), r.randrange(len(t))
        t[at : at + 1] = [[r.choice("xyz")], [], [t[at], "q"]][k]
    return "".join(t)


def data():
    r = random.Random(8)
    items = [(i, prose(r, r.randrange(14, 40))) for i in range(12)] + [(50, None), (51, ""), (52, "Who won?"), (53, "ab" * 40), (54, " -! ")]
    docs = []
    for k in range(120):
        t = prose(r, r.randrange(0, 80))
        if k % 2:
            _, x = items[r.randrange(12)]
            x = edited(r, x, r.randrange(0, len(x) // 7))
            t = f"{t}\n{x.upper() if k % 3 else x.replace(' ', ', ')} {prose(r, r.randrange(30))}"
        docs.append((k, t))
    return items, docs + [(200, None), (201, ""), (202, "On on on on " * 800), (203, "ab" * 45), (204, items[0][1]), (204, items[0][1]), (None, items[1][1]), (205, "and who  WON it"), (206, "whowon")]


def folded(text):
    """Lower-case letters and digits, one space for each run of anything else between them."""
    return " ".join("".join(c.lower()[0] if c.isalnum() else " " for c in text or "").split())


def plain(items, docs):
    out = set()
    for d, t in docs:
        for i, x in items:
            x = folded(x)
            n = least_edits(x, folded(t)) if x else None
            if x and n <= len(x) // 10:
                out.add((d, i, n))
    return out


def test_matches_plain_table(spark, monkeypatch):
    items, docs = data()
    want = plain(items, docs)
    assert len(want) > 20 and any(n > 3 for _, _, n in want)
    d = spark.createDataFrame([(*x, 0, "e") for x in docs], "doc_id long, text string, start int, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(d, b).collect()
    assert {(x.doc_id, x.item_id, x.edits) for x in got} == want
    assert sum(x.doc_id == 204 for x in got) == 2
    texts = dict(docs)
    for x in got:
        if x.edits == 0:
            assert normalize(texts[x.doc_id][x.start : x.end])[0].tolist() == normalize(dict(items)[x.item_id])[0].tolist()
    hit = {x for x, _, _ in want}
    assert sorted(x.doc_id for x in without_contaminated(d, b).collect()) == sorted(i for i, _ in docs if i not in hit)
    monkeypatch.setattr(decontam, "INDEX_CHARS", 300)
    monkeypatch.setattr(decontam, "BLOCK", 500)
    assert {(x.doc_id, x.item_id, x.edits) for x in contaminated(d, b).collect()} == want


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "some words that make a passage of some length")], "item_id int, text string")
    assert contaminated(d.limit(0), b).count() == 0 and contaminated(d, b.limit(0)).count() == 0
    assert without_contaminated(d, b.limit(0)).count() == 1


def test_items_of_every_length(spark):
    """Items of 1 to 75 letters with the whole budget of edits, and one more, inside longer texts."""
    r = random.Random(5)
    items = [(n, "".join(r.choice("abcdefghijklmnop") for _ in range(n))) for n in range(1, 76)]
    docs = []
    for n, x in items:
        for k in (n // 10, n // 10 + 1):
            docs.append((len(docs), "qrst" * r.randrange(9) + edited(r, x, k) + "uvw" * r.randrange(9)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(f"i{n}", x) for n, x in items], "item_id string, text string")
    got = {(x.doc_id, int(x.item_id[1:]), x.edits) for x in contaminated(d, b).collect()}
    assert got == plain(items, docs) and len({i for _, i, _ in got}) == 75


def test_windows_of_a_long_text(monkeypatch):
    """A text over many windows, with occurrences across their borders, gives what one block gives."""
    r = random.Random(6)
    items = [prose(r, r.randrange(3, 40)) for _ in range(20)] + ["who won", "x"]
    text = " ".join(edited(r, r.choice(items), r.randrange(3)) if k % 5 == 0 else prose(r, 8) for k in range(400))
    whole = list(Search(items).search(["", text, "who won"]))
    monkeypatch.setattr(decontam, "BLOCK", 700)
    monkeypatch.setattr(decontam, "HITS", 50)
    monkeypatch.setattr(decontam, "CELLS", 3000)
    assert list(Search(items).search(["", text, "who won"])) == whole and len(whole) > 15


def test_memory_of_many_short_items():
    """60,000 items of 14 letters and a text of 60,000: only occupied bands are held."""
    r = random.Random(7)
    word = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    items, text = [word(14) for _ in range(60_000)], word(60_000)
    index = Search(items)
    tracemalloc.start()
    list(index.search([text]))
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()


def test_ids_of_any_type(spark):
    d = spark.createDataFrame([("a", "it was who won, he said")], "doc_id string, text string")
    b = spark.createDataFrame([(1, "Who won?")], "item_id int, text string")
    for kind in ("smallint", "decimal(9,2)", "date", "string"):
        cast = "date_add(DATE'2020-01-01', item_id)" if kind == "date" else f"CAST(item_id AS {kind})"
        got = contaminated(d, b.selectExpr(f"{cast} AS item_id", "text")).collect()
        assert [(x.doc_id, x.start, x.end) for x in got] == [("a", 7, 14)]
