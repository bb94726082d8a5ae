"""Personal data by bootstrapped contextual extraction, in DataFrame functions only (op9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Kinds in the order of the result. Possessive quantifiers and anchors at the start of a run (or where
#: the match before ended) find what the plain patterns find, in linear time and without deep recursion.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be an identifier: numbers with single spaces between them, or a word with an at sign or a digit.
NUMBER = r"[0-9][0-9().+-]*+(?![^\s,;:!?])"
CANDIDATE = rf"(?<!\S)(?:[+(]?{NUMBER}(?:\x20\(?{NUMBER})*+|[^\s0-9@]*+[0-9@]\S*+)"
#: Distinct known instances of one kind that a pattern of that kind needs, and the share of its instances that must be of it.
SUPPORT, CONFIDENCE = 3, 0.8

SPAN = "array<struct<s:int,e:int,m:string,l:string,r:string>>"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, as an array's only element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, merge: Callable[[Column, Column], Column], start: Column) -> Column:
    """What ``merge`` has made of the elements before each one, of an int array.

    Appending copies what is there, so the array goes in blocks of about the root of its size: 100,000
    elements cost some 30 million copied ints and not five billion.
    """
    ints = F.array().cast("array<int>")

    def chain(part: Column, first: Column) -> Column:
        step = lambda z, x: F.struct(merge(z["at"], x).alias("at"), F.concat(z["out"], F.array(z["at"])).alias("out"))
        return F.aggregate(part, F.struct(first.alias("at"), ints.alias("out")), step, lambda z: z["out"])

    def blocks(v: Column, width: Column) -> Column:
        count = F.floor((F.size(v) - 1) / width).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(v, i * width + 1, width))

    def walk(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, start, merge))
        return bind(chain(totals, start), lambda firsts: F.flatten(F.transform(parts, lambda p, i: chain(p, F.get(firsts, i)))))

    cut = lambda v: bind(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda width: bind(blocks(v, width), walk))
    return bind(values, lambda v: F.when(F.size(v) == 0, ints).otherwise(cut(v)))


def spans(text: Column, pattern: str, guard: str) -> Column:
    """Matches of ``pattern`` as (start, end, match, word before, word after); code points, end exclusive.

    The pieces between the matches give the offsets, as no function returns them. ``guard`` is a cheap
    pattern without which a text has no match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)

    def walk(b: Column) -> Column:
        sizes = F.transform(b["f"], lambda m, i: F.length(m) + F.length(F.get(b["p"], i)))

        def placed(before: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                left, right = F.get(b["p"], i), F.get(b["p"], i + 1)
                s = F.get(before, i) + F.length(left)
                return F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"), word(left, True).alias("l"), word(right, False).alias("r"))

            return F.transform(b["f"], one)

        return bind(running(sizes, lambda a, n: a + n, F.lit(0)), placed)

    return F.when(text.rlike(guard), bind(F.struct(found.alias("f"), pieces.alias("p")), walk)).otherwise(F.array().cast(SPAN))


def untouched(cands: Column, touched: Column) -> Column:
    """The spans of ``cands`` that overlap none of ``touched`` (s, e): both are sorted together once."""
    far = F.lit(2**31 - 1)
    event = lambda x, tag, rest: F.struct(x["s"].alias("s"), F.lit(tag).alias("tag"), x["e"].alias("e"), rest.alias("x"))
    every = F.concat(F.transform(touched, lambda t: event(t, 0, F.lit(None).cast(SPAN[6:-1]))), F.transform(cands, lambda c: event(c, 1, c)))

    def sift(ev: Column) -> Column:
        ends = running(F.transform(ev, lambda x: F.when(x["tag"] == 0, x["e"]).otherwise(0)), lambda a, b: F.greatest(a, b), F.lit(0))
        starts = running(F.transform(F.reverse(ev), lambda x: F.when(x["tag"] == 0, x["s"]).otherwise(far)), lambda a, b: F.least(a, b), far)

        def free(b: Column) -> Column:
            alone = F.filter(ev, lambda x, i: (x["tag"] == 1) & (F.get(b["ends"], i) <= x["s"]) & (F.get(b["starts"], F.size(ev) - 1 - i) >= x["e"]))
            return F.transform(alone, lambda x: x["x"])

        return bind(F.struct(ends.alias("ends"), starts.alias("starts")), free)

    return F.when(F.size(cands) == 0, F.array().cast(SPAN)).when(F.size(touched) == 0, cands).otherwise(bind(F.array_sort(every), sift))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) > 3) | (F.try_to_number(F.right(p, F.lit(3)), F.lit("999")) > 255))
    if kind == "card":
        figures = F.split(F.reverse(digits(m)), "")
        twice = F.transform(figures, lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
        long_enough = F.length(digits(m)).between(16, 19)
        return F.when(long_enough, F.aggregate(twice, F.lit(0), lambda a, d: a + d) % 10 == 0).otherwise(False)
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}


def shape(m: Column) -> Column:
    """@ for what has an at sign, 9 for digits between signs only, a for digits with letters."""
    return F.when(m.contains("@"), "@").when(m.rlike(r"\p{L}"), "a").otherwise("9")


def mixed(m: Column) -> Column:
    """Letters and digits, five or more together."""
    return m.rlike(r"\p{L}") & m.rlike("[0-9]") & (F.length(F.regexp_replace(m, r"[^0-9\p{L}]", "")) >= 5)


def word(text: Column, last: bool) -> Column:
    """The last or first word of a context, in lower case; a last word is read backwards, in linear time."""
    found = F.regexp_extract(F.reverse(text) if last else text, r"^\s++(\S++)", 1)
    return F.lower(F.reverse(found) if last else found)


def discovered(cands: DataFrame) -> DataFrame:
    """(rid, kind, s, e) of candidates that contexts of identifiers tell to be identifiers.

    ``cands``: rid, s, e, m, left, right, kind (a seed's kind, else null). A pattern is a side, the word
    on it, the shape of what stands there (or any shape) and a kind. Patterns and instances (distinct
    strings) form a graph. A pattern's score is the mean over its instances: 1 for a known one of its kind,
    0 for one of another kind, a half for an unknown one. Patterns with SUPPORT known instances and a score
    of CONFIDENCE vouch for their unknown instances, which become known, of the kind that is vouched for
    most (of equals the first by name); patterns are then scored anew. What is known stays known, so the
    known ones grow until a round adds none: there is no cap on rounds.
    """
    sides = F.array(F.concat(F.lit("l "), "left"), F.concat(F.lit("r "), "right"))
    edges = cands.select(F.explode(sides).alias("side"), F.array(F.lit("*"), shape(F.col("m"))).alias("shapes"), "m", "kind").where(F.length("side") > 2)
    edges = edges.select("side", F.explode("shapes").alias("shape"), "m", "kind")
    edges = materialize(edges.groupBy("side", "shape", "m").agg(F.max("kind").alias("kind")), "contexts")
    known = None
    while True:
        told = edges if known is None else edges.join(known, "m", "left").withColumn("kind", F.coalesce("kind", "found"))
        counts = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
        scored = told.groupBy("side", "shape").agg(F.count("*").alias("n"), F.count_if(F.col("kind").isNull()).alias("open"), *counts)
        kinds = F.array(*[F.struct(F.lit(k).alias("of"), F.col(k).alias("support"), ((F.col(k) + F.col("open") / 2) / F.col("n")).alias("score")) for k in KINDS])
        good = scored.where("open > 0").select("side", "shape", F.inline(kinds)).where((F.col("support") >= SUPPORT) & (F.col("score") >= CONFIDENCE - 1e-9))
        on = told.where("kind is null").select("side", "shape", "m").join(good, ["side", "shape"])
        on = on.groupBy("m", "of", "side").agg(F.max("score").alias("score"))
        miss = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9))))
        more = on.groupBy("m", "of").agg(F.round(miss, 9).alias("miss")).groupBy("m").agg(F.min(F.struct("miss", "of"))["of"].alias("found"))
        after = materialize(more if known is None else known.union(more), "known")
        before = 0 if known is None else known.count()
        if known is not None:
            discard(known)
        known = after
        if known.count() == before:
            break
    discard(edges)
    return cands.where("kind is null").drop("kind").join(known.withColumnRenamed("found", "kind"), "m").select("rid", "kind", "s", "e")


def sound(i: int, kind: str) -> Column:
    """Base spans of a kind that hold."""
    held = F.filter(F.col(f"__{kind}"), lambda x: valid(kind, x["m"]))
    return F.transform(held, lambda x: F.struct(F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["l"].alias("left"), x["r"].alias("right")))


def taken(i: int, kind: str) -> Column:
    """Base matches of a kind that no candidate may touch: those that hold, and those of the right form that fail their check."""
    of_form = (lambda m: F.length(digits(m)).between(16, 19)) if kind == "card" else (lambda m: F.lit(True))
    return F.transform(F.filter(F.col(f"__{kind}"), lambda x: of_form(x["m"])), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added of every whole text.

    n_email to n_phone and base_sha256 are of the base spans; spans also has the n_added spans found
    by context, each with the kind that its best pattern's seeds have. A candidate is a word with an
    at sign, with five or more digits, or with five or more letters and digits mixed, or a run of numbers
    of five or more digits; it touches no base span and no match that failed its check. Null texts count as
    empty; repeated rows are searched each; an empty table gives an empty result; other columns are
    ignored. The work grows with the text and, within one text, with its number of matches and the copies
    of ``running``.
    """
    text = F.coalesce(F.col("__text"), F.lit(""))
    docs = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    found = {k: spans(text, p, GUARDS[k]) for k, p in KINDS.items()}
    stage = docs.withColumns({f"__{k}": v for k, v in found.items()} | {"__cand": spans(text, CANDIDATE, "[0-9@]")})
    base = F.concat(*[sound(i, k) for i, k in enumerate(KINDS)])
    touched = F.concat(*[taken(i, k) for i, k in enumerate(KINDS)])
    stage = stage.select("__id", "__cand", base.alias("base"), touched.alias("touched"))

    likely = F.filter(F.col("__cand"), lambda x: x["m"].contains("@") | (F.length(digits(x["m"])) >= 5) | mixed(x["m"]))
    cands = F.transform(bind(likely, lambda c: untouched(c, F.col("touched"))), lambda x: F.struct(F.lit(None).cast("int").alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["l"].alias("left"), x["r"].alias("right")))
    stage = materialize(stage.select("__id", F.monotonically_increasing_id().alias("rid"), "base", cands.alias("cands")), "spans")

    names = F.array(*[F.lit(k) for k in KINDS])
    seen = stage.select("rid", F.inline(F.concat("base", "cands"))).select("rid", "s", "e", "m", "left", "right", F.when(F.col("k").isNotNull(), F.element_at(names, F.col("k") + 1)).alias("kind"))
    more = discovered(seen).groupBy("rid").agg(F.collect_list(F.struct((F.array_position(names, F.col("kind")) - 1).cast("int").alias("k"), "s", "e")).alias("added"))
    out = stage.drop("cands").join(more, "rid", "left")
    base = F.transform("base", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    every = F.concat(base, F.coalesce("added", F.array().cast("array<struct<k:int,s:int,e:int>>")))

    def said(a: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(a), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")

    counts = {f"n_{k}": F.size(F.array_remove(F.transform("base", lambda x: x["k"]), F.lit(i))) for i, k in enumerate(KINDS)}
    counts = {n: (F.size("base") - c).cast("long") for n, c in counts.items()}
    return out.select(F.col("__id").alias(id_col), *[c.alias(n) for n, c in counts.items()], F.sha2(said(base), 256).alias("base_sha256"), said(every).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"))
