"""Mutual information of numeric columns with a target by nearest neighbours.

The estimate compares, for each row, the distance to its k-th nearest other row in the plane
(column, target), the larger of both axes' distances, with the number of rows that are strictly
nearer on each axis alone. Both axes are measured in their population standard deviations. A row
with k copies or more has distance 0; its copies, itself included, then stand for k.

Equal points are one weighted point. Points are packed into cells of at most ``cell_rows``: sorted
by column into strips, each strip by target into cells, so cells shrink where points are dense and
ties need no care. A point's k smallest distances inside its cell bound its search; it then
visits only the cells whose bounding box lies nearer than that bound, of a list that its cell has
made for all its points. Rows nearer on an axis are
a difference of two running totals: values and interval ends are sorted together, and sorted
partitions are summed inside and shifted by the totals of those before them.

No step meets all pairs: a cell compares its own points and, in blocks of bounded size, the points
that visit it. The driver holds one total for each task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fumarole import vocab
from fumarole.session import materialise, small_table

#: Distinct points of a cell, and visiting points that are compared with a cell at once.
CELL_ROWS = 1024
NEIGHBOURS = 3

CELL = ["column", "strip", "cell"]
POINT = "id long, column string, x double, y double, sx double, sy double, w long"
NAMES = [field.split()[0] for field in POINT.split(", ")]


def points(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Distinct (column, x, y) of the complete rows with finite values, their number of rows and
    the axes' deviations; columns that do not vary are left out. Staged, with an id each."""
    spark = df.sparkSession
    names = list(dict.fromkeys([*columns, target]))
    values = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    finite = [F.abs(F.col(c)) < float("inf") for c in names]  # NaN is above infinity
    complete = materialise(values.where(reduce(and_, finite)), "complete")
    spread = complete.agg(*[F.stddev_pop(c).alias(c) for c in names]).first()
    kept = [c for c in columns if c != target and (spread[c] or 0) > 0]
    if not kept or not spread[target]:
        return spark.createDataFrame([], POINT)
    # adding zero makes one value of both zeros
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), (F.col(c) + 0.0).alias("x"), F.lit(spread[c]).alias("sx")) for c in kept
    ])
    long = complete.select(F.inline(cells), (F.col(target) + 0.0).alias("y"), F.lit(spread[target]).alias("sy"))
    found = long.groupBy("column", "x", "y", "sx", "sy").agg(F.count("*").alias("w"))
    return materialise(found.withColumn("id", F.monotonically_increasing_id()).select(*NAMES), "points")


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with their ``rank`` (from 0) inside their group, in an order, and the group's ``size``.

    One range shuffle; groups may span tasks and tasks may hold many groups.
    """
    ordered = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    staged = materialise(ordered.withColumn("at", F.monotonically_increasing_id()), "ranked")
    staged = staged.withColumn("task", F.shiftright("at", 33))
    parts = staged.groupBy(*group, "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *group, "task", F.sum("n").over(whole).alias("size"),
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
    )
    placed = staged.join(small_table(parts), [*group, "task"])
    return placed.withColumn("rank", F.col("at") + F.col("shift")).drop("at", "task", "shift")


def cells_of(found: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The points with their strip and cell; staged."""

    def cells(n: Column) -> Column:
        return F.ceil(n / F.lit(cell_rows))

    by_x = ranked(found, ["column"], ["x", "y"])
    strip = F.floor(F.col("rank") * F.ceil(F.sqrt(cells(F.col("size")))) / F.col("size")).cast("int")
    strips = by_x.withColumn("strip", strip).drop("rank", "size")
    by_y = ranked(strips, ["column", "strip"], ["y", "x"])
    cell = F.floor(F.col("rank") * cells(F.col("size")) / F.col("size")).cast("int")
    return materialise(by_y.withColumn("cell", cell).drop("rank", "size"), "cells")


def smallest(own: pa.Table, other: pa.Table, k: int, block: int) -> np.ndarray:
    """The k smallest distances of each point to the rows of ``other``, itself (one row) not
    counted, in order; infinite where there are fewer rows."""
    x, y, weight, ids = (other[c].to_numpy() for c in ("x", "y", "w", "id"))
    px, py, pid = (own[c].to_numpy() for c in ("x", "y", "id"))
    sx, sy = own["sx"][0].as_py(), own["sy"][0].as_py()
    out = np.full((len(px), k), np.inf)
    for low in range(0, len(px), block):
        part = slice(low, low + block)
        far = np.maximum(
            np.abs(x - px[part, None]) / sx, np.abs(y - py[part, None]) / sy
        )
        rows = np.where(ids == pid[part, None], weight - 1, weight)
        far[rows == 0] = np.inf
        near = np.argpartition(far, min(k, far.shape[1]) - 1, axis=1)[:, :k]
        d, n = np.take_along_axis(far, near, 1), np.take_along_axis(rows, near, 1)
        # a point of n rows stands n times, k at most
        d = np.repeat(d, k, axis=1)
        d[np.tile(np.arange(k), near.shape[1])[None, :] >= np.repeat(n, k, axis=1)] = np.inf
        d.sort(axis=1)
        out[part] = d[:, :k]
    return out


def nearer(box: Column, axis: str, low: str, high: str) -> Column:
    """The box lies nearer than the bound to a point from low to high, or holds one; with the very
    arithmetic of distances, whose steps keep the order of their terms."""
    unit, r = F.col(f"s{axis}"), F.col("r")
    return ((box[f"{axis}0"] - F.col(high)) / unit < r) & ((F.col(low) - box[f"{axis}1"]) / unit < r)


def reached(asking: DataFrame, boxes: DataFrame) -> DataFrame:
    """(column, strip, cell, boxes): by strip, the boxes of other cells that any point of a cell may
    lie near. A point then tries these few and not those of all cells, whose number grows."""
    # about as many strips as a strip has cells, so neither list outgrows the root of the cells
    strips = boxes.groupBy("column", "strip").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.collect_list(F.struct("cell", "x0", "x1", "y0", "y1")).alias("cells")
    )
    strips = materialise(strips, "strips")
    listed = strips.groupBy("column").agg(F.collect_list(F.struct("strip", "x0", "x1")).alias("strips"))

    reach = asking.groupBy(*CELL, "sx", "sy").agg(
        F.max("r").alias("r"), F.min("x").alias("xl"), F.max("x").alias("xh"), F.min("y").alias("yl"), F.max("y").alias("yh")
    )
    reach = reach.withColumnsRenamed({"strip": "own_strip", "cell": "own_cell"}).join(small_table(listed), "column")
    reach = reach.withColumn("found", F.explode(F.filter("strips", lambda s: nearer(s, "x", "xl", "xh")))).drop("strips")
    reach = reach.withColumn("strip", F.col("found.strip"))
    reach = reach.join(small_table(strips.select("column", "strip", "cells")), ["column", "strip"])
    others = F.filter(
        "cells",
        lambda c: nearer(c, "x", "xl", "xh") & nearer(c, "y", "yl", "yh")
        & ((F.col("strip") != F.col("own_strip")) | (c["cell"] != F.col("own_cell"))),
    )
    reach = reach.withColumn("cells", others).where(F.size("cells") > 0)
    box = F.struct("strip", F.col("found.x0").alias("x0"), F.col("found.x1").alias("x1"), "cells")
    return reach.groupBy("column", F.col("own_strip").alias("strip"), F.col("own_cell").alias("cell")).agg(
        F.collect_list(box).alias("boxes")
    )


def radii(placed: DataFrame, k: int = NEIGHBOURS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The points of ``cells_of`` with ``r``, the distance to the k-th nearest other row."""
    near = "near array<double>"

    def table(own: pa.Table, found: np.ndarray) -> pa.Table:
        return own.append_column("near", pa.array(list(found), pa.list_(pa.float64())))

    def inside(own: pa.Table) -> pa.Table:
        return table(own, smallest(own, own, k, cell_rows))

    def across(visitors: pa.Table, residents: pa.Table) -> pa.Table:
        if not visitors.num_rows or not residents.num_rows:
            return table(visitors.slice(0, 0), np.empty((0, k))).select(["id", "near"])
        return table(visitors, smallest(visitors, residents, k, cell_rows)).select(["id", "near"])

    schema = f"{POINT}, strip int, cell int"
    columns = [*NAMES, "strip", "cell"]
    home = placed.select(*columns).groupBy(*CELL).applyInArrow(inside, f"{schema}, {near}")
    home = materialise(home, "home")

    boxes = placed.groupBy(*CELL).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    boxes = materialise(boxes, "boxes")
    asking = home.select(*NAMES, "strip", "cell", F.col("near")[k - 1].alias("r")).where("r > 0")
    # lists of a cell at the edge may be long, so this table never passes through the driver
    reach = materialise(reached(asking, boxes), "reach")
    asking = asking.join(reach, CELL).drop("strip", "cell")
    asking = asking.withColumn("found", F.explode(F.filter("boxes", lambda s: nearer(s, "x", "x", "x")))).drop("boxes")
    asking = asking.select(*NAMES, "r", "found.strip", "found.cells")
    met = F.filter("cells", lambda c: nearer(c, "x", "x", "x") & nearer(c, "y", "y", "y"))
    asking = asking.withColumn("found", F.explode(met)).withColumn("cell", F.col("found.cell"))
    visits = materialise(asking.select(*columns), "visits")

    # visitors of one cell meet it in blocks, each with its own copy of the cell
    blocks = visits.groupBy(*CELL).agg(F.ceil(F.count("*") / F.lit(cell_rows)).cast("int").alias("blocks"))
    blocks = small_table(blocks)
    dealt = visits.join(blocks, CELL).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("blocks")
    copies = placed.select(*columns).join(blocks, CELL)
    copies = copies.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    met = dealt.groupBy(*CELL, "block").cogroup(copies.groupBy(*CELL, "block"))
    seen = met.applyInArrow(across, f"id long, {near}")
    seen = seen.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("seen"))
    both = F.concat("near", F.coalesce("seen", F.array().cast("array<double>")))
    return home.join(seen, "id", "left").select(*NAMES, F.array_sort(both)[k - 1].alias("r"))


def ordered_bits(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of doubles, neighbours one apart."""
    bits = v.view(np.int64)
    return np.where(bits >= 0, bits, -(bits & np.int64(0x7FFFFFFFFFFFFFFF)))


def doubles(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >= 0, keys, -keys | np.int64(-0x8000000000000000)).view(np.float64)


def ends(x: np.ndarray, unit: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The largest value from x up whose distance is below r, by halving; x itself where r is 0."""
    x = x + 0.0
    below = ordered_bits(x)
    above = ordered_bits(np.minimum(x + 2 * r * unit, np.finfo(float).max))
    above = np.maximum(above, below) + 1
    while True:
        half = (above - below).view(np.uint64) >> np.uint64(1)
        if not half.any():
            return doubles(below)
        middle = below + half.astype(np.int64)
        inside = (half > 0) & ((doubles(middle) - x) / unit < r)
        below = np.where(inside, middle, below)
        above = np.where(inside | (half == 0), above, middle)


def nearer_on_axes(measured: DataFrame) -> DataFrame:
    """(column, axis, id, w, n): for each point and axis, the rows strictly nearer than ``r`` on that
    axis, or equal where ``r`` is 0, the row itself included."""
    events = "column string, axis string, v double, side int, id long, w long"
    order = ["column", "axis", "v", "side"]

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, n = batch["r"].to_numpy(), batch.num_rows
            for axis in ("x", "y"):
                at, unit = batch[axis].to_numpy(), batch[f"s{axis}"].to_numpy()
                # a lower end stands before the rows of its value, an upper end behind them
                for side, v in ((0, -ends(-at, unit, r)), (2, ends(at, unit, r))):
                    yield pa.RecordBatch.from_arrays(
                        [batch["column"], pa.array([axis] * n), pa.array(v + 0.0), pa.array([side] * n, pa.int32()), batch["id"], batch["w"]],
                        ["column", "axis", "v", "side", "id", "w"],
                    )

    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in ("x", "y")])
    rows = measured.select("column", "w", F.inline(axes)).groupBy("column", "axis", "v").agg(F.sum("w").alias("w"))
    rows = rows.select("column", "axis", "v", F.lit(1).alias("side"), F.lit(None).cast("long").alias("id"), "w")
    every = materialise(rows.unionByName(measured.mapInArrow(intervals, events)), "events")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows before each interval end in this task, then the task's total."""
        total, task = 0, TaskContext.get().partitionId()
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        names = ["column", "axis", "side", "id", "w", "sum", "task"]
        for batch in batches:
            side = batch["side"].to_numpy()
            running = total + np.cumsum(np.where(side == 1, batch["w"].to_numpy(), 0))
            total = int(running[-1]) if len(running) else total
            found = pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names[:5]), pa.array(running), pa.array([task] * len(running), pa.int32())], names
            )
            yield found.filter(pa.array(side != 1))
        last = [None, None, -1, None, None, total, task]
        yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(last, kinds)], names)

    ordered = every.repartitionByRange(*order).sortWithinPartitions(*order)
    sums = ordered.mapInArrow(summed, "column string, axis string, side int, id long, w long, sum long, task int")
    sums = materialise(sums, "sums")
    totals = sorted((r["task"], r["sum"]) for r in sums.where("side = -1").select("task", "sum").collect())
    before = np.cumsum([0, *[n for _, n in totals]]).tolist()
    shifts = sums.sparkSession.createDataFrame([(t, b) for (t, _), b in zip(totals, before)], "task int, before long")
    reached = (F.col("side") - 1) * (F.col("sum") + F.col("before"))
    placed = sums.where("side >= 0").join(F.broadcast(shifts), "task")
    return placed.groupBy("column", "axis", "id").agg(F.max("w").alias("w"), F.sum(reached).alias("n"))


def digamma(n: Column) -> Column:
    """Of a whole number from 1: ten steps up, then the asymptotic series."""
    z = n + 10.0
    steps = sum((1.0 / (n + float(i)) for i in range(1, 10)), 1.0 / n)
    square = 1.0 / (z * z)
    series = square * (1.0 / 12 - square * (1.0 / 120 - square * (1.0 / 252 - square / 240.0)))
    return F.ln(z) - 0.5 / z - series - steps


def nearest_information(
    df: DataFrame,
    columns: Sequence[str],
    target: str = vocab.SCOPE1,
    neighbours: int = NEIGHBOURS,
    min_rows: int = vocab.MI_MIN_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(column, mi): nearest-neighbour mutual information in nats, 0 at least, highest first.

    Rows with a null or a value that is not finite in any of the columns are left out, and so are
    columns that do not vary. Fewer than ``min_rows`` complete rows, or not more than
    ``neighbours``, give an empty table. Ties count as they are; no noise is added.
    """
    found = points(df, columns, target)
    n = found.groupBy("column").agg(F.sum("w").alias("n")).agg(F.max("n")).first()[0]
    if not n or n < min_rows or n <= neighbours:
        return df.sparkSession.createDataFrame([], "column string, mi double")
    measured = materialise(radii(cells_of(found, cell_rows), neighbours, cell_rows), "radii")
    axes = nearer_on_axes(measured)
    around = F.when(F.col("r") == 0, F.col("w").cast("double")).otherwise(F.lit(float(neighbours)))
    joint = measured.groupBy("column").agg((F.sum(F.col("w") * digamma(around)) / n).alias("joint"))
    alone = axes.groupBy("column").agg((F.sum(F.col("w") * digamma(F.col("n").cast("double"))) / n).alias("alone"))
    mi = digamma(F.lit(float(n))) + F.col("joint") - F.col("alone")
    table = joint.join(alone, "column").select("column", F.greatest(mi, F.lit(0.0)).alias("mi"))
    return table.orderBy(F.desc("mi"), "column")
