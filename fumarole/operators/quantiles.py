"""Exact quantiles by counting buckets of bit keys, modes, and quantile binning.

A double becomes a long of the same order: its IEEE bits, negated for negative numbers. So
infinities and denormals are ordinary values, and a bucket is a shift of the key. The first pass
counts 16 leading bits of every group and column, combined in the map tasks; each further round
counts 12 more bits of the buckets that hold a wanted rank and too many values, for all columns
and ranks at once. After at most ``len(LEVELS)`` rounds all bits are used; mostly one round leaves
a few thousand values a rank, which are counted value by value. No step holds the values of a
group, and the state is a count for each bucket.
"""

from __future__ import annotations

import bisect
import math
import struct
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from fumarole.session import SMALL_ROWS, materialise, small_table

#: Bits that a key is shifted by in each round.
LEVELS = (48, 36, 24, 12, 0)
#: Values a bucket may hold and be counted value by value.
FEW_VALUES = 4096
#: Relative rank error of the approximate variant is one over this.
SKETCH_ACCURACY = 100_000

#: Bits of the fraction of a double, its smallest exponent, and the key of infinity.
FRACTION = 52
LEAST_EXPONENT = -1022
INFINITY = 0x7FF << FRACTION


def bit_keys(df: DataFrame, columns: Mapping[str, Column], keep: Sequence[str | Column] = ()) -> DataFrame:
    """The order-preserving longs of numbers, by result name, behind the columns to ``keep``; null
    for null and NaN, 0 for both zeros.

    The exponent comes from a logarithm, corrected by one comparison; all scaling is by powers of
    two and exact. Each step is a projection of its own, so that no step is computed twice.
    """
    names = [f"_{i}" for i in range(len(columns))]
    rows = df.select(*keep, *[c.cast("double").alias(f"x{n}") for n, c in zip(names, columns.values())])
    kept = rows.columns[: len(keep)]
    rows = rows.selectExpr("*", *[f"least(floor(log2(abs(x{n}))), 1024) AS guess{n}" for n in names])
    rows = rows.selectExpr("*", *[f"pow(2D, guess{n}) AS power{n}" for n in names])
    exponent = (
        "greatest(guess{n} + CASE WHEN abs(x{n}) < power{n} THEN -1 WHEN abs(x{n}) >= 2 * power{n} THEN 1 ELSE 0 END,"
        f" {LEAST_EXPONENT}) AS exponent{{n}}"
    )
    rows = rows.selectExpr("*", *[exponent.format(n=n) for n in names])
    bits = (
        f"(exponent{{n}} - {LEAST_EXPONENT}) * {1 << FRACTION}L"
        f" + CAST(abs(x{{n}}) / pow(2D, exponent{{n}}) * {1 << FRACTION}D AS LONG)"
    )
    key = (
        "CASE WHEN NOT isnan(x{n}) THEN CASE WHEN x{n} = 0 THEN 0L ELSE CAST(sign(x{n}) AS LONG) *"
        f" CASE WHEN abs(x{{n}}) = double('Infinity') THEN {INFINITY}L ELSE {bits} END END END"
    )
    keys = [f"{key.format(n=n)} AS `{out}`" for n, out in zip(names, columns)]
    return rows.selectExpr(*[f"`{c}`" for c in kept], *keys)


def key_value(key: Column) -> Column:
    """The number of a bit key."""
    size = F.abs(key)
    exponent = F.shiftright(size, FRACTION)
    part = size.bitwiseAND(F.lit((1 << FRACTION) - 1)).cast("double")
    least = F.pow(F.lit(2.0), F.lit(float(LEAST_EXPONENT - FRACTION)))
    normal = (1 + part / float(1 << FRACTION)) * F.pow(F.lit(2.0), exponent + (LEAST_EXPONENT - 1))
    value = F.when(size == INFINITY, float("inf")).when(exponent == 0, part * least).otherwise(normal)
    return F.when(key < 0, -value).otherwise(value)


def plain_value(key: int) -> float:
    return math.copysign(struct.unpack("<d", struct.pack("<q", abs(key)))[0], key or 1)


def quantile_table(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    approx: bool = False,
    levels: Sequence[int] = LEVELS,
    few: int = FEW_VALUES,
    max_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Linearly interpolated quantiles: the grouping columns, then one array per column.

    Nulls and NaN are skipped; a group without values gives null, and so does a point between the
    two infinities. The result has one row per group and is broadcast if it proves small. The keys
    are staged once and read in each pass. Buckets of groups are ranked on the driver while no pass
    can bring more than ``max_rows`` counts to it, and by windows beyond that; results are equal.
    """
    probs, by = [float(p) for p in probs], list(by)
    if approx:
        sketch = [
            F.percentile_approx(c, probs, F.lit(SKETCH_ACCURACY)).cast("array<double>").alias(c)
            for c in columns
        ]
        return small_table(df.groupBy(*by).agg(*sketch))
    spark, cells, groups = df.sparkSession, *_cells(df, columns, by)
    known = cells.where("k is not null")
    if not by:
        counts = [r.asDict() for r in _counted(known, ["i"], levels[0]).collect()]
        schema = ", ".join(f"`{c}` array<double>" for c in columns)
        row = _on_driver(known, groups, counts, len(columns), probs, levels, few)[0]
        return F.broadcast(spark.createDataFrame([row], schema))
    held = _counted(cells, [*groups, "i"], levels[0]).persist(StorageLevel.DISK_ONLY)
    try:
        counts = held.limit(max_rows + 1).toArrow().to_pylist()
        if len(counts) <= max_rows:
            found = _on_driver(known, groups, counts, len(columns), probs, levels, few, max_rows)
            if found is not None:
                fields = [StructField(b, cells.schema[g].dataType) for b, g in zip(by, groups)]
                fields += [StructField(c, ArrayType(DoubleType())) for c in columns]
                return small_table(spark.createDataFrame(found, StructType(fields)))
        return small_table(_by_group(known, held, groups, list(columns), by, probs, levels, few))
    finally:
        held.unpersist()


def _cells(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """One row for each value: the groups, the column's number ``i`` and its bit key ``k``; and the
    names that the groups have there."""
    groups = [f"g{i}" for i in range(len(by))]
    named = [F.col(b).alias(g) for b, g in zip(by, groups)]
    keys = {f"k{i}": F.col(c) for i, c in enumerate(columns)}
    rows = materialise(bit_keys(df, keys, named), "keys")
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"k{i}").alias("k")) for i in range(len(columns))])
    return rows.select(*groups, F.explode(pairs).alias("cell")).select(*groups, "cell.*"), groups


def _counted(cells: DataFrame, place: Sequence[str], shift: int) -> DataFrame:
    """Counts and ranges of keys by ``place`` and the bits left after a shift, as ``p``."""
    return cells.groupBy(*place, F.shiftright("k", shift).alias("p")).agg(
        F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")
    )


def _positions(total: int, probs: Sequence[float]) -> list[int]:
    """The ranks, from 0, between which the wanted quantiles lie."""
    return sorted({step((total - 1) * p) for p in probs for step in (math.floor, math.ceil)})


def _inside(known: DataFrame, held: DataFrame, groups: Sequence[str], shift: int) -> DataFrame:
    """The cells whose bits left after a shift are those of a bucket of their group and column."""
    held = held.withColumn("o", F.shiftright("low", shift)).withColumnsRenamed({g: f"r_{g}" for g in groups})
    held = held.withColumnRenamed("i", "r_i")
    match = (F.col("i") == F.col("r_i")) & (F.shiftright("k", shift) == F.col("o"))
    for g in groups:
        match &= F.col(g).eqNullSafe(F.col(f"r_{g}"))
    return known.join(held, match)


def _on_driver(
    known: DataFrame,
    groups: Sequence[str],
    counts: Sequence[dict],
    columns: int,
    probs: list[float],
    levels: Sequence[int],
    few: int,
    max_rows: int | None = None,
) -> list[list] | None:
    """The rows of the result, with buckets ranked on the driver.

    ``counts`` are those of the first pass. The buckets that hold a wanted rank are broadcast, and
    each later pass counts inside them. None if a pass might bring more than ``max_rows`` counts.
    """
    spark, first = known.sparkSession, levels[0]
    names: dict[str, list] = {}
    cells: dict[tuple[str, int], list[dict]] = {}
    for r in counts:
        values = [r[g] for g in groups]
        names.setdefault(repr(values), values)
        if r["p"] is not None:
            cells.setdefault((repr(values), r["i"]), []).append(r)
    if not groups:
        names[repr([])] = []
    totals = {place: sum(r["n"] for r in rows) for place, rows in cells.items()}
    wanted = {place: _positions(n, probs) for place, n in totals.items()}
    found: dict[tuple[str, int], list[tuple[int, int, int]]] = {place: [] for place in cells}

    def ranked(place: tuple[str, int], rows: list[dict], below: int) -> list[dict]:
        """The rows that hold a wanted rank, with the ranks below them."""
        held = []
        for r in sorted(rows, key=lambda r: r["low"]):
            at = bisect.bisect_left(wanted[place], below)
            if at < len(wanted[place]) and wanted[place][at] < below + r["n"]:
                held.append({"place": place, "low": r["low"], "high": r["high"], "n": r["n"], "below": below})
            below += r["n"]
        return held

    def looked_up(held: list[dict], shift: int) -> DataFrame:
        rows = [[*names[r["place"][0]], r["place"][1], r["low"], r["high"], j] for j, r in enumerate(held)]
        ends = StructType.fromDDL("i int, low long, high long, j int")
        table = spark.createDataFrame(rows, StructType([*[known.schema[g] for g in groups], *ends]))
        return _inside(known, F.broadcast(table), groups, shift)

    held = [r for place, rows in cells.items() for r in ranked(place, rows, 0)]
    if max_rows is not None:
        few = min(few, max_rows // max(len(held), 1))
    closed: list[dict] = []
    for shift, next_shift in zip(levels, [*levels[1:], None]):
        for r in held:
            if r["low"] == r["high"]:
                found[r["place"]].append((r["low"], r["below"], r["below"] + r["n"]))
        closed += [r for r in held if r["low"] < r["high"] and r["n"] <= few]
        held = [r for r in held if r["low"] < r["high"] and r["n"] > few]
        if not held:
            break
        if max_rows is not None and len(held) << (shift - next_shift) > max_rows:
            return None
        inside: dict[int, list[dict]] = {}
        for r in _counted(looked_up(held, shift), ["j"], next_shift).collect():
            inside.setdefault(r["j"], []).append(r.asDict())
        held = [part for j, r in enumerate(held) for part in ranked(r["place"], inside[j], r["below"])]
    if closed:
        values: dict[int, list[dict]] = {}
        near = looked_up(closed, first).where(F.col("k").between(F.col("low"), F.col("high")))
        for r in _counted(near, ["j"], 0).collect():
            values.setdefault(r["j"], []).append(r.asDict())
        for j, r in enumerate(closed):
            own = ranked(r["place"], values[j], r["below"])
            found[r["place"]] += [(v["low"], v["below"], v["below"] + v["n"]) for v in own]

    def quantile(place: tuple[str, int], p: float) -> float | None:
        position = (totals[place] - 1) * p
        low, high = math.floor(position), math.ceil(position)
        a, b = (next(plain_value(k) for k, s, e in found[place] if s <= rank < e) for rank in (low, high))
        value = a if a == b else a * (high - position) + b * (position - low)
        return None if math.isnan(value) else value

    return [
        [*values, *[[quantile((g, i), p) for p in probs] if (g, i) in totals else None for i in range(columns)]]
        for g, values in names.items()
    ]


def _held(counts: DataFrame, groups: list[str], few: int) -> DataFrame:
    """Buckets that hold a wanted rank; their rows carry the ranks and the rows ``below`` them."""
    order = Window.partitionBy(*groups, "i", "o").orderBy("p")
    ranked = counts.withColumn("end", F.col("below") + F.sum("n").over(order))
    ranked = ranked.withColumn("start", F.col("end") - F.col("n"))
    held = ranked.where(
        F.col("p").isNull() | F.exists("ranks", lambda r: (r >= F.col("start")) & (r < F.col("end")))
    )
    still = (F.col("n") > few) & (F.col("low") < F.col("high"))
    return held.select(
        *groups, "i", "total", "ranks", "n", "low", "high", F.col("start").alias("below"), still.alias("open")
    )


def _by_group(
    known: DataFrame,
    counts: DataFrame,
    groups: list[str],
    columns: list[str],
    by: list[str],
    probs: list[float],
    levels: Sequence[int],
    few: int,
) -> DataFrame:
    """Quantiles by group: buckets are ranked by windows, and those that hold a wanted rank are
    joined back by group, column and leading bits. A column without values keeps one empty row.
    ``counts`` are those of the first pass."""
    first = levels[0]
    own = Window.partitionBy(*groups, "i")
    total = F.sum(F.when(F.col("p").isNotNull(), F.col("n")).otherwise(0)).over(own)
    counts = counts.withColumn("total", total)
    counts = counts.where("p is not null or total = 0")
    counts = counts.withColumns(
        {"o": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "ranks": _ranks(F.col("total"), probs)}
    )
    ranges = small_table(_held(counts, groups, few))
    carried = ["total", "ranks", "below"]
    for shift, next_shift in zip(levels, levels[1:]):
        if not ranges.where("open").take(1):
            break
        looked = _inside(known, ranges.where("open").select(*groups, "i", "low", *carried), groups, shift)
        kept = [F.first(c).alias(c) for c in carried]
        counts = looked.groupBy(*groups, "i", "o", F.shiftright("k", next_shift).alias("p")).agg(
            F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"), *kept
        )
        ranges = small_table(ranges.where("not open").unionByName(_held(counts, groups, few)))

    one = ranges.where("low is null or low = high").select(
        *groups, "i", "total", F.col("low").alias("k"), F.col("below").alias("start"),
        (F.col("below") + F.col("n")).alias("end"),
    )
    several = ranges.where("low < high").select(*groups, "i", "low", "high", *carried)
    values = _inside(known, several, groups, first).where(F.col("k").between(F.col("low"), F.col("high")))
    values = values.groupBy(*groups, "i", F.col("low").alias("o"), F.col("k").alias("p")).agg(
        F.count("*").alias("n"), F.min("k").alias("low"), F.min("k").alias("high"),
        *[F.first(c).alias(c) for c in carried],
    )
    found = _held(values, groups, few).select(
        *groups, "i", "total", F.col("low").alias("k"), F.col("below").alias("start"),
        (F.col("below") + F.col("n")).alias("end"),
    )
    return _answers(one.unionByName(found), groups, columns, by, probs)


def _ranks(n: Column, probs: list[float]) -> Column:
    """The ranks, from 0, between which the wanted quantiles lie."""
    wanted = [step((n - 1) * p).cast("long") for p in probs for step in (F.floor, F.ceil)]
    return F.array_distinct(F.array(*wanted))


def _answers(
    found: DataFrame, groups: list[str], columns: list[str], by: list[str], probs: list[float]
) -> DataFrame:
    """One row a group: its quantiles from the values at the wanted ranks."""
    value = F.struct("start", "end", key_value(F.col("k")).alias("v"))
    lists = [
        expr
        for i in range(len(columns))
        for expr in (
            F.collect_list(F.when(F.col("i") == i, value)).alias(f"f{i}"),
            F.max(F.when(F.col("i") == i, F.col("total"))).alias(f"n{i}"),
        )
    ]
    wide = found.groupBy(*groups).agg(*lists)

    def quantiles(i: int) -> Column:
        def at(rank: Column) -> Column:
            held = F.filter(f"f{i}", lambda x: (x["start"] <= rank) & (rank < x["end"]))
            return F.get(held, 0)["v"]

        def one(p: Column) -> Column:
            position = (F.col(f"n{i}") - 1) * p
            return _between(at(F.floor(position)), at(F.ceil(position)), position)

        return F.when(F.col(f"n{i}") > 0, F.transform(F.array(*[F.lit(p) for p in probs]), one))

    return wide.select(
        *[F.col(g).alias(b) for g, b in zip(groups, by)],
        *[quantiles(i).alias(c) for i, c in enumerate(columns)],
    )


def _between(low: Column, high: Column, position: Column) -> Column:
    """Linear interpolation between the values at the ranks around a position."""
    value = low * (F.ceil(position) - position) + high * (position - F.floor(position))
    return F.when(low == high, low).when(~F.isnan(value), value)


def quantile_values(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], approx: bool = False
) -> dict[str, list[float | None]]:
    """Global quantiles as plain values, one list per column."""
    probs = [float(p) for p in probs]
    if approx:
        found = quantile_table(df, columns, probs, approx=True).first()
    else:
        known = _cells(df, columns, [])[0].where("k is not null")
        counts = [r.asDict() for r in _counted(known, ["i"], LEVELS[0]).collect()]
        found = _on_driver(known, [], counts, len(columns), probs, LEVELS, FEW_VALUES)[0]
    row = dict(zip(columns, found))
    return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in columns}


def medians(df: DataFrame, columns: Sequence[str], approx: bool = False) -> dict[str, float | None]:
    return {c: v[0] for c, v in quantile_values(df, columns, [0.5], approx).items()}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per text column, the smallest one on a tie; null if all are null."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]
    )
    counts = (
        df.select(F.explode(cells).alias("cell"))
        .where("cell.value is not null")
        .groupBy("cell.column", "cell.value")
        .count()
    )
    best = counts.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("value")
    )
    found = {row["column"]: row["value"] for row in best.collect()}
    return {c: found.get(c) for c in columns}


def bin_edges(df: DataFrame, column: str, bins: int, approx: bool = False) -> list[float]:
    """Distinct quantile edges of a column, from smallest to largest."""
    edges = quantile_values(df, [column], [i / bins for i in range(bins + 1)], approx)[column]
    return sorted({e for e in edges if e is not None})


def bin_of(c: Column, edges: Sequence[float]) -> Column:
    """Right-closed bin number of a value, from 0; the lowest edge is included.

    With a single distinct edge (a constant column) every value is in bin 0.
    """
    chain = F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(None).cast("int"))
    inner = list(edges[1:-1])
    for number, edge in enumerate(inner):
        chain = chain.when(c <= edge, F.lit(number))
    return chain.otherwise(F.lit(len(inner)))


