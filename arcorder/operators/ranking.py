"""Global ranks and order statistics without a one-task window, whatever values repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from arcorder.operators.storage import written

#: Rows of monotonically_increasing_id() in one partition.
ROWS = 1 << 33
#: Rows that one task may order in a selection, and splitters of a round of it.
SELECTED, SPLITTERS = 1 << 20, 63
#: Equal values that one row stands for when ranks are written out.
RUN = 1 << 14


def global_rank(df: DataFrame, *keys: str | Column, name: str = "rank") -> DataFrame:
    """df with the 0-based position of each row in the order of the keys.

    Rows are range-partitioned and sorted; a row's rank is its place in its partition plus the sizes of the
    partitions before it. Only those sizes (one number for each partition) are summed in one task and broadcast.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    placed = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") % ROWS).drop("_part", "_at", "_before")


def running_total(df: DataFrame, group: list[str], order: str, value: str, block: int = 1 << 16) -> DataFrame:
    """df with `before`: the sum of `value` over the rows of the group with a smaller `order` (a dense number).

    Groups may hold any number of rows: sums run inside blocks of the order, and over the blocks' totals.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    inside = F.sum(value).over(Window.partitionBy(*group, "_block").orderBy(order)) - F.col(value)
    totals = blocked.groupBy(*group, "_block").agg(F.sum(value).alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_block")) - F.col("_sum")
    return blocked.withColumn("_inside", inside).join(totals.withColumn("_earlier", earlier).drop("_sum"), [*group, "_block"]).withColumn("before", F.col("_inside") + F.col("_earlier")).drop("_inside", "_earlier", "_block")


def ranked_values(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """(rank, column) of all rows in the order of the column, ranks from 0; nulls are left out.

    Values are counted first, and ranks follow from running sums of the counts, so a value that many rows share is one
    row until its ranks are written out, in runs of RUN that go to different tasks.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    placed = written(counts.repartitionByRange("_v").sortWithinPartitions("_v").withColumn("_part", F.spark_partition_id()), "ranked-values")
    sizes = placed.groupBy("_part").agg(F.sum("_c").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.sum("_c").over(Window.partitionBy("_part").orderBy("_v")) - F.col("_c")
    firsts = placed.withColumn("_inside", inside).join(F.broadcast(before), "_part").select("_v", "_c", (F.col("_before") + F.col("_inside")).alias("_first"))
    runs = firsts.select("_v", "_c", "_first", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_c - 1) div {RUN}"))).alias("_k")).repartition("_first", "_k")
    size = F.least(F.lit(RUN).cast("long"), F.col("_c") - F.col("_k") * RUN)
    return runs.select((F.col("_first") + F.col("_k") * RUN).alias("_from"), size.alias("_size"), "_v").select(F.explode(F.expr("sequence(_from, _from + _size - 1)")).alias(name), F.col("_v").alias(column))


def at_ranks(df: DataFrame, column: str, ranks: dict[str, int], small: int = SELECTED, splitters: int = SPLITTERS, n: int | None = None) -> DataFrame:
    """One row with the value at each rank (from 0, ascending, nulls left out); null beyond the last.

    A selection: while the rows that may hold a rank are more than `small`, approximate quantiles of them split them into
    ranges and single values, which are counted in one pass, and only the range that holds the rank is read on. A value
    that many rows share ends up alone and is settled by its count. The last rows are counted by value and summed up.
    n: the number of rows that are not null, if it is known.
    """
    value = F.col("_v")
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_v"))
    n = rows.count() if n is None else n
    wanted = {k: r for k, r in ranks.items() if 0 <= r < n}
    # of each rank: the open range that holds it (None: no bound), rows before the range, rows in it
    ranges: dict[str, tuple] = dict.fromkeys(wanted, (None, None, 0, n))
    known: dict[str, object] = {}
    kind = df.schema[column].dataType

    def within(lo, hi):
        bound = F.lit(True)
        if lo is not None:
            bound = bound & (value > F.lit(lo).cast(kind))
        return bound if hi is None else bound & (value < F.lit(hi).cast(kind))

    while wide := sorted({r for k, r in ranges.items() if k not in known and r[3] > small}, key=str):
        shares = [(i + 1) / (splitters + 1) for i in range(splitters)]
        cuts = rows.agg(*[F.percentile_approx(F.when(within(lo, hi), value), F.array(*map(F.lit, shares)), F.lit(4 * splitters)).alias(f"c{i}") for i, (lo, hi, _, _) in enumerate(wide)]).first()
        for i, (lo, hi, before, _) in enumerate(wide):
            found = sorted(set(cuts[i]))
            place = _place(value, [F.lit(x).cast(kind) for x in found])
            counts = dict(rows.where(within(lo, hi)).groupBy(place.alias("p")).count().collect())  # a row for each range
            for k, r in ranges.items():
                if r != wide[i] or k in known:
                    continue
                at = before
                for p in range(2 * len(found) + 1):
                    c = counts.get(p, 0)
                    if at <= wanted[k] < at + c:
                        if p % 2:
                            known[k] = found[p // 2]
                        else:
                            ranges[k] = (found[p // 2 - 1] if p else lo, found[p // 2] if p < 2 * len(found) else hi, at, c)
                        break
                    at += c
    cells = []
    left = sorted({r for k, r in ranges.items() if k not in known}, key=str)
    if left:
        which = F.lit(-1)
        keep = F.lit(False)
        for i, (lo, hi, _, _) in enumerate(left):
            which = F.when(within(lo, hi), i).otherwise(which)
            keep = keep | within(lo, hi)
        counted = rows.where(keep).groupBy(which.alias("_k"), "_v").agg(F.count("*").alias("_c"))
        rows = counted.withColumn("_upto", F.sum("_c").over(Window.partitionBy("_k").orderBy("_v")))
    else:
        rows = rows.sparkSession.range(1)
    for name, rank in ranks.items():
        if name in known:
            cells.append(F.max(F.lit(known[name]).cast(kind)).alias(name))
        elif name in wanted:
            local = rank - ranges[name][2]
            hit = (F.col("_k") == left.index(ranges[name])) & (F.col("_upto") > local) & (F.col("_upto") - F.col("_c") <= local)
            cells.append(F.max(F.when(hit, value)).alias(name))
        else:
            cells.append(F.max(F.lit(None).cast(kind)).alias(name))
    return rows.agg(*cells)


def _place(value: Column, cuts: list[Column], first: int = 0) -> Column:
    """2 i for values between the cuts i - 1 and i, 2 i + 1 for those equal to cut i: a balanced tree of comparisons."""
    if not cuts:
        return F.lit(2 * first)
    m = len(cuts) // 2
    return F.when(value < cuts[m], _place(value, cuts[:m], first)).when(value == cuts[m], F.lit(2 * (first + m) + 1)).otherwise(_place(value, cuts[m + 1 :], first + m + 1))


def ranks_by_run(positions: DataFrame) -> DataFrame:
    """(run, node, pos) -> also `rank` (0-based by pos, then node), `tied_rank` (1-based mean rank of equal positions), `n`."""
    ranked = global_rank(positions, "run", "pos", "node", name="_row")
    first = ranked.groupBy("run").agg(F.min("_row").alias("_first"), F.count("*").alias("n"))
    ranked = ranked.join(F.broadcast(first), "run").withColumn("rank", F.col("_row") - F.col("_first")).drop("_row", "_first")
    ties = ranked.groupBy("run", "pos").agg(((F.min("rank") + F.max("rank")) / 2 + 1).alias("tied_rank"))
    return ranked.join(ties, ["run", "pos"])
