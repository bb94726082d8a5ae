import hashlib
import math
import random
import re
import time

from dossier.llm.pii import personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(len(p) < 4000 and int(p) <= 255 for p in m.split("."))
    if kind == "card":
        s = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d)))
        return 16 <= len(d) <= 19 and s % 10 == 0
    return 8 <= len(d) <= 15 if kind == "phone" else True


def plain(text):
    out = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if ok(k, m.group())] for k, p in PATTERNS.items()}
    every = ",".join(x for k in PATTERNS for x in out[k])
    return *[len(out[k]) for k in PATTERNS], hashlib.sha256(every.encode()).hexdigest(), every


ODD = [
    None, "", "a@b.c@d.e", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 1.2.3.4", "300.1.1.1 01.002.0003.4 0.0.0.00000255 1.1.1.0256", "4111 1111 1111 1111 4111-1111-1111-1111-1", "4111111111111111 4111111111111112",
    "+1 (743) 555-3824 é +1..2 +12345678 +1 ", "日本🙂 joe@x.org, 🙂 10.0.0.1", "9" * 30_000, "a" * 30_000 + "@", "x@y" + ".z" * 20_000, "1" * 9999 + ".1" * 3, "+1" + "-(" * 9000, "@@@...+++", "1-1 1- 1", "a@-.-",
]


def test_base_matches_plain(spark):
    r = random.Random(0)
    texts = ODD + ["".join(r.choice("ab1234.@+- (0)é🙂5") for _ in range(r.randrange(80))) for _ in range(400)]
    texts += ["".join(r.choice("0123 -.") for _ in range(r.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in personal_data(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        x, want = got[i], plain(t)
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) == want[:5], (t, want, x)
        assert set(filter(None, want[5].split(","))) <= set(x.spans.split(","))


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please dial +1 (555) 010-{1000 + i} soon") for i in range(12)]
    rows += [(100, "please dial +1 (555) 010-1003 soon and 7 times"), (101, "mail me at joe@host.org now"), (102, "mail me at amy@host.org now"), (103, "mail me at bob@host.org now"), (104, "mail me at eve@localhost now"), (105, "order 1234567 of 2020"), (106, "please dial 555-0199 soon"), (None, "mail me at sue@intranet now"), (104, "mail me at eve@localhost now")]
    df = spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id long, text string, spans string, k int")
    got = personal_data(df).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(rows)
    assert by[104].spans == "email:11:24" and by[104].n_added == 1 and by[104].n_email == 0
    assert by[None].spans == "email:11:23"
    assert by[105].spans == "" and by[100].n_phone == 1
    assert by[106].spans == "phone:12:20" and by[106].n_phone == 0
    assert sum(x.doc_id == 104 and x.n_added == 1 for x in got) == 2


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert personal_data(df).count() == 0


def test_second_hop_letters_and_spaced_numbers(spark):
    """Found identifiers induce patterns: tickets share a context only with what round one found, orders only with tickets."""
    rows = [f"please dial +1 (555) 010-{1000 + i} soon" for i in range(20)]
    rows += [f"please dial AB-1234{i} soon" for i in range(10)] + [f"the ticket AB-1234{i} closes" for i in range(10)]
    rows += ["the ticket CD-99999 closes", "please dial 555 123 4567 soon", "the weather 1234567 holds"]
    rows += [f"the ticket EF-8888{i} closes" for i in range(3)] + [f"an order EF-8888{i} ships" for i in range(3)] + ["an order GH777 ships"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {rows[x.doc_id]: x.spans for x in personal_data(df).collect()}
    assert got["please dial AB-12341 soon"] == "phone:12:20"
    assert got["please dial 555 123 4567 soon"] == "phone:12:24"
    assert got["the ticket CD-99999 closes"] == "phone:11:19"
    assert got["an order GH777 ships"] == "phone:9:14"
    assert got["the weather 1234567 holds"] == ""


def test_context_words_are_whole(spark):
    """Context words that differ only beyond 80 characters are different ones."""
    far = lambda i: f"{'x' if i else 'y'}{'z' * 90}"
    rows = [f"{far(1)} +1 (555) 010-{1000 + i}" for i in range(12)] + [f"{far(1)} 5550199", f"{far(0)} 5550188"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id: x.n_added for x in personal_data(df).collect()}
    assert got[12] == 1 and got[13] == 0


NUMBER = r"[0-9][0-9().+-]*(?![^\s,;:!?])"
CANDIDATE = re.compile(rf"(?<!\S)(?:[+(]?{NUMBER}(?: \(?{NUMBER})*|[^\s0-9@]*[0-9@]\S*)")


def shape(m):
    return "@" if "@" in m else "a" if re.search("[^\\W\\d_]", m) else "9"


def instances(text):
    """(start, end, string, word before, word after, kind or None) of base spans and candidates."""
    bounds, out, kept = {k: [m for m in re.finditer(p, text)] for k, p in PATTERNS.items()}, [], []
    side = lambda s, e: ((re.search(r"(\S+)\s+$", s) or ["", ""])[1].lower(), (re.match(r"\s+(\S+)", e) or ["", ""])[1].lower())
    for k, found in bounds.items():
        ends = [0, *(m.end() for m in found)]
        starts = [*(m.start() for m in found), len(text)]
        for n, m in enumerate(found):
            if ok(k, m.group()):
                out.append((m.start(), m.end(), m.group(), *side(text[ends[n] : m.start()], text[m.end() : starts[n + 1]]), k))
            if k != "card" or 16 <= len(re.sub("[^0-9]", "", m.group())) <= 19:
                kept.append(m.span())
    found = list(CANDIDATE.finditer(text))
    ends, starts = [0, *(m.end() for m in found)], [*(m.start() for m in found), len(text)]
    for n, m in enumerate(found):
        x = m.group()
        solid = re.sub(r"[\W_]", "", x)
        likely = "@" in x or len(re.sub("[^0-9]", "", x)) >= 5 or (re.search(r"[^\W\d_]", x) and re.search("[0-9]", x) and len(solid) >= 5)
        if likely and not any(s < m.end() and e > m.start() for s, e in kept):
            out.append((m.start(), m.end(), x, *side(text[ends[n] : m.start()], text[m.end() : starts[n + 1]]), None))
    return out


def bootstrap(texts):
    """Added spans of every text, by the rule: a pattern belongs to a kind, and other kinds count against it."""
    rows = [instances(t) for t in texts]
    seeds, seen = {}, {}
    for row in rows:
        for _, _, m, left, right, kind in row:
            for context in [("left", left)] * bool(left) + [("right", right)] * bool(right):
                for form in ("any", shape(m)):
                    seen.setdefault((*context, form), set()).add(m)
                    if kind:
                        seeds[*context, form, m] = max(kind, seeds.get((*context, form, m), ""))
    told = {}
    while True:
        new = {}
        for context, some in seen.items():
            kind_of = {m: seeds.get((*context, m)) or told.get(m) for m in some}
            for kind in PATTERNS:
                votes = [1.0 if k == kind else 0.5 if k is None else 0.0 for k in kind_of.values()]
                if votes.count(1.0) >= 3 and sum(votes) / len(votes) >= 0.8 - 1e-9:
                    for m in (m for m, k in kind_of.items() if k is None):
                        sides = new.setdefault(m, {}).setdefault(kind, {})
                        sides[context[:2]] = max(sides.get(context[:2], 0.0), sum(votes) / len(votes))
        new = {m: v for m, v in new.items() if m not in told}
        if not new:
            break
        for m, by in new.items():
            doubt = {}
            for kind, sides in by.items():
                doubt[kind] = sum(math.log(max(1 - x, 1e-9)) for x in sides.values())
            told[m] = min(by, key=lambda k: (round(doubt[k], 9), k))
    return [sorted(f"{told[m]}:{s}:{e}" for s, e, m, _, _, k in row if not k and m in told) for row in rows]


def planted(r, docs):
    """Texts with identifiers in telling contexts, base ones and unseen forms, and numbers in other contexts."""
    call, mail, others = ["dial", "phone", "ring"], ["write", "mailbox", "reach"], ["order", "paid", "weighs", "year"]
    out = []
    for _ in range(docs):
        parts = []
        for _ in range(r.randrange(1, 6)):
            at, n = r.choices(range(6), [4, 4, 1, 1, 2, 1])[0], r.randrange(10**6, 10**7)
            parts.append(
                [f"{r.choice(call)} +1 555 {n} soon", f"{r.choice(mail)} u{n}@host.org today", f"{r.choice(call)} {n} soon", f"{r.choice(mail)} u{n % 50}@intranet today", f"{r.choice(others)} {n % 3000 + 10**5} units", f"{r.choice(others)} {n % 9} and"][at]
            )
        out.append(" ".join(parts))
    return out


def test_discovery_matches_plain_rounds(spark):
    """All added spans of random corpora, against plain loops."""
    for seed in range(3):
        texts = planted(random.Random(seed), 60) + ["", "dial"]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        want = bootstrap(texts)
        for x in personal_data(df).collect():
            base = set(filter(None, plain(texts[x.doc_id])[5].split(",")))
            assert sorted(set(filter(None, x.spans.split(","))) - base) == want[x.doc_id]
        assert sum(map(len, want)) > 10


def test_a_context_of_several_kinds_tells_nothing(spark):
    """Secrets beside a word that stands beside e-mail addresses, addresses of hosts and telephones alike get no span."""
    rows = [f"foo joe{i}@host.org bar" for i in range(4)] + [f"foo 10.0.0.{i} bar" for i in range(4)] + [f"foo +1 555 01000{i} bar" for i in range(4)] + ["foo ZZ99999 bar"]
    got = {x.doc_id: x for x in personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got[12].spans == "" and got[12].n_added == 0


def test_long_chains_of_finds_end(spark):
    """Each find opens the next context, over more rounds than any cap would allow cheaply."""
    rows = [f"w0 +1 555 01000{i} x" for i in range(9)]
    for n in range(12):
        rows += [f"w{n} id-{n}-7777{i} y{n}" for i in range(2)] + [f"w{n + 1} id-{n}-7777{i} z" for i in range(2)] + [f"w{n + 1} id-{n}-8888{i} z" for i in range(2)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = bootstrap(rows)
    for x in personal_data(df).collect():
        assert sorted(filter(None, x.spans.split(","))) == sorted([*filter(None, plain(rows[x.doc_id])[5].split(",")), *want[x.doc_id]])


def test_many_matches_in_one_text(spark):
    """Work within a text is not quadratic in its matches: 60,000 numbers, addresses among them."""
    text = " ".join(f"{i * 7919 % 90000 + 10000}" + (f" n{i}@x.org" if i % 10 == 0 else "") for i in range(60_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    got = personal_data(df).collect()[0]
    assert time.perf_counter() - began < 120
    assert (got.n_email, got.n_ip, got.n_card, got.n_phone, got.base_sha256) == plain(text)[:5]
