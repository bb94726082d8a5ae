"""Positions and running values inside groups of any size: no task holds a whole group.

Rows are range-sorted by group and order, so a large group lies in many partitions. What a row needs of
the rows before it is made of three parts: of its own block (a bounded stretch of a sorted partition), of
the blocks before it, and nothing else. Only one row for each group and block (or partition) is looked at
by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import broadcast_if_small, materialize

#: Rows of a block at most (bits), and rows of a range partition, about.
BLOCK_BITS, RANGE_ROWS = 14, 1 << 21


def ordered(df: DataFrame, group: list[str], order: list[Column | str], block_bits: int = BLOCK_BITS) -> DataFrame:
    """``df`` sorted by ``group`` (no nulls) and ``order``, with range_no, block_no and row_no; materialized.

    row_no ascends with the order over the whole table; a block has at most 2**block_bits rows of one
    range partition. Rows alike in group and order may be parted anywhere, so copies make no large partition.
    ``df`` must be cheap to read (it is counted, sampled and read) and have none of these three columns.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    tie = F.monotonically_increasing_id() % 65536
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = df.withColumn("range_no", tie)
    keys = [*map(F.col, group), *order, F.col("range_no")]
    ranged = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    numbered = ranged.withColumn("row_no", F.monotonically_increasing_id())
    numbered = numbered.withColumns({"range_no": F.shiftright("row_no", 33), "block_no": F.shiftright("row_no", block_bits)})
    return materialize(numbered, "ordered")


def offsets(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, range_no, first_row, before, total) of an ordered table: where its rows of a group begin in a
    range partition, how many come in the partitions before, and how many there are; materialized."""
    counts = rows.groupBy(*group, "range_no").agg(F.min("row_no").alias("first_row"), F.count("*").alias("n"))
    by = Window.partitionBy(*group)
    before = F.sum("n").over(by.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*group, "range_no", "first_row", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(by).alias("total"))
    return materialize(counts, "offsets")


def positions(rows: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` (an ordered table) with place (0-based, in the group) and total (rows of the group)."""
    known = broadcast_if_small(offsets(rows, group))
    at = rows.join(known, [*group, "range_no"])
    return at.withColumn("place", F.col("before") + F.col("row_no") - F.col("first_row")).drop("before", "first_row")


_MERGE = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}


def running(rows: DataFrame, group: list[str], values: dict[str, tuple[str, Column]], backwards: bool = False) -> DataFrame:
    """``rows`` (an ordered table) with a running sum, max or min of each value over the row and those before it in
    its group (``backwards``: and those after it); values are name -> (sum, max or min, column), nulls are passed over."""
    ways = {n: (getattr(F, kind), kind, c) for n, (kind, c) in values.items()}
    # frames that begin at the row and end with the group are made anew for each row, so backwards is another order
    order = (lambda c: F.col(c).desc()) if backwards else F.col
    block = Window.partitionBy(*group, "block_no").orderBy(order("row_no")).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumns({n: f(c).over(block) for n, (f, _, c) in ways.items()})
    blocks = rows.groupBy(*group, "block_no").agg(*[f(c).alias(f"{n}_all") for n, (f, _, c) in ways.items()])
    others = Window.partitionBy(*group).orderBy(order("block_no")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialize(blocks.select(*group, "block_no", *[f(f"{n}_all").over(others).alias(f"{n}_past") for n, (f, _, _) in ways.items()]), "running")
    joined = inner.join(broadcast_if_small(blocks), [*group, "block_no"])
    return joined.withColumns({n: _MERGE[kind](F.col(n), F.col(f"{n}_past")) for n, (_, kind, _) in ways.items()}).drop(*[f"{n}_past" for n in values])


def running_sums(rows: DataFrame, group: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` (an ordered table) with the sum of each value over the row and those before it in its group."""
    return running(rows, group, {n: ("sum", c) for n, c in sums.items()})


def with_next(rows: DataFrame, cols: list[str]) -> DataFrame:
    """``rows`` (an ordered table) with next_<col> of the row that follows in the whole order, whatever its group.

    Inside a block a window has it; a block's last row takes the first row of the next block. Which block
    is next follows from each range partition's block numbers: one row for each partition reaches the driver.
    """
    block = Window.partitionBy("block_no").orderBy("row_no")
    inner = rows.withColumns({f"next_{c}": F.lead(c).over(block) for c in cols} | {"last_in_block": F.lead("row_no").over(block).isNull()})
    spans = sorted((r[0], r[1], r[2]) for r in rows.groupBy("range_no").agg(F.min("block_no"), F.max("block_no")).collect())
    jumps = [(a[2], b[1]) for a, b in zip(spans, spans[1:])]
    spark = rows.sparkSession
    jump = F.broadcast(spark.createDataFrame(jumps or [(-1, -1)], "block_no bigint, jump bigint"))
    first = [F.min_by(c, "row_no").alias(f"first_{c}") for c in cols]
    heads = materialize(rows.groupBy(F.col("block_no").alias("next_block")).agg(*first), "heads")
    out = inner.join(jump, "block_no", "left").withColumn("next_block", F.when(F.col("last_in_block"), F.coalesce("jump", F.col("block_no") + 1)))
    out = out.join(broadcast_if_small(heads), "next_block", "left")
    return out.withColumns({f"next_{c}": F.when(F.col("last_in_block"), F.col(f"first_{c}")).otherwise(F.col(f"next_{c}")) for c in cols}).drop("next_block", "jump", "last_in_block", *[f"first_{c}" for c in cols])


def _largest(df: DataFrame, group: list[str]) -> int:
    return df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def _in_order(df: DataFrame, group: list[str], order: list[Column]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` as an ordered table with its columns under plain names (returned too) and the group as one value g."""
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}
    by = {f"o{i}": c for i, c in enumerate(order)}
    plain = df.select(*[F.col(c).alias(n) for c, n in at.items()], *[c.alias(n) for n, c in by.items()], F.struct(*group).alias("g"))
    return ordered(plain, ["g"], list(by)), at


def following(df: DataFrame, group: list[str], order: list[Column], cols: list[str], most: int = RANGE_ROWS) -> DataFrame:
    """``df`` with next_<col> of the row that follows in its group, null after the last one; null is a group of its own.

    ``order`` is complete, or rows alike in it follow in any order. Windows do it while no group has more than ``most``
    rows; a window over a larger one would be one task, so then all rows are range-sorted and compared block by block.
    Both give the same rows. Column names may be any but next_<col>.
    """
    if _largest(df, group) <= most:
        w = Window.partitionBy(*group).orderBy(*order)
        return df.withColumns({f"next_{c}": F.lead(c).over(w) for c in cols})
    rows, at = _in_order(df, group, order)
    found = with_next(rows, ["g", *[at[c] for c in cols]])
    same = F.col("g").eqNullSafe(F.col("next_g"))
    return found.select(*[F.col(n).alias(c) for c, n in at.items()], *[F.when(same, F.col(f"next_{at[c]}")).alias(f"next_{c}") for c in cols])


def placed(df: DataFrame, group: list[str], order: list[Column], name: str = "place", most: int = RANGE_ROWS) -> DataFrame:
    """``df`` with the 1-based place of each row in its group's order, by windows or, beyond ``most`` rows of a group,
    by counts of range partitions; as ``following`` else."""
    if _largest(df, group) <= most:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    rows, at = _in_order(df, group, order)
    return positions(rows, ["g"]).select(*[F.col(n).alias(c) for c, n in at.items()], (F.col("place") + 1).alias(name))


def clamped(items: DataFrame, group: list[str], start: float, keep: list[str] | None = None, block_bits: int = 8) -> DataFrame:
    """``items`` (group, at, a, lo, hi, ``keep``) with before and after of x -> min(hi, max(lo, a * x)), in order of ``at``.

    Such steps are closed under composition (for a >= 0): first (a, l, h) and then (b, m, k) is (a * b, step2(l),
    step2(h)). Groups of up to 2**block_bits steps are folded in one array each. Longer ones go in blocks: every
    block is composed to one step, the blocks' entry values are found by the same function over these, and
    each block is folded from its entry. Memory is that of a block, whatever the group.
    """
    keep = keep or []
    step = F.struct("at", "a", "lo", "hi", *keep)
    apply = lambda s, x: F.least(s["hi"], F.greatest(s["lo"], s["a"] * x))
    most = items.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if most <= 1 << block_bits:
        whole = items.groupBy(*group).agg(F.array_sort(F.collect_list(step)).alias("steps")).withColumn("entry", F.lit(float(start)))
    else:
        by = [*group, "block_no"]
        rows = ordered(items, group, ["at"], block_bits)
        blocks = rows.groupBy(*by).agg(F.array_sort(F.collect_list(step)).alias("steps"))
        none = F.struct(F.lit(1.0).alias("a"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
        both = lambda z, s: F.struct((z["a"] * s["a"]).alias("a"), apply(s, z["lo"]).alias("lo"), apply(s, z["hi"]).alias("hi"))
        # a step of factor 0 forgets what came before: 0 times an infinite bound is no number
        safe = lambda z, s: F.when(s["a"] == 0, F.struct(F.lit(0.0).alias("a"), F.least(s["hi"], F.greatest(s["lo"], F.lit(0.0))).alias("lo"), F.least(s["hi"], F.greatest(s["lo"], F.lit(0.0))).alias("hi"))).otherwise(both(z, s))
        one = materialize(blocks.select(*group, F.col("block_no").alias("at"), F.aggregate("steps", none, safe).alias("f")).select(*group, "at", "f.*"), "steps")
        entries = clamped(one, group, start, [], block_bits).select(*group, F.col("at").alias("block_no"), F.col("before").alias("entry"))
        whole = blocks.join(broadcast_if_small(materialize(entries, "entries")), by)

    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    made = "array<struct<" + ",".join(f"{c}:{kinds[c]}" for c in ["at", *keep]) + ",before:double,after:double>>"

    def fold(z: Column, s: Column) -> Column:
        after = apply(s, z["now"])
        row = F.struct(*[s[c].alias(c) for c in ["at", *keep]], z["now"].alias("before"), after.alias("after"))
        return F.struct(after.alias("now"), F.concat(z["out"], F.array(row)).cast(made).alias("out"))

    begin = F.struct(F.col("entry").alias("now"), F.array().cast(made).alias("out"))
    return whole.select(*group, F.inline(F.aggregate("steps", begin, fold, lambda z: z["out"])))
