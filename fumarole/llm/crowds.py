"""Near copies in crowds: which of a great many alike sets are near which, without listing all pairs.

A crowd is a group of sets with a core P, the items that most of a few members hold. With i(X) the
items of X in P, and E(X) the items that X has and P lacks or P has and X lacks,
``|X and Y| = i(X) + i(Y) - |P| + |E(X) and E(Y)|`` holds for any P. Two sets are near if at least
4/9 of their sizes together is common (a Jaccard similarity of 0.8), so a pair needs so many common
items of E, and nothing else about the pair counts:

- none or fewer are needed: near, counted for all members of one size and i at once;
- more than the smaller E has: not near;
- between: the pair must meet in the rarest items of both E (all but ``needed - 1`` of them), and
  is listed if it does.

The counts do not depend on the core; a better one leaves fewer pairs in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fumarole.session import materialise, small_table

#: Members of a crowd whose common items are its core.
CORE_OF = 15


def near(size: Column, other: Column, both: Column) -> Column:
    """Whether sets of two sizes with ``both`` common items have a Jaccard similarity of 0.8."""
    return 9 * both >= 4 * (size + other)


def _needed(size: Column, inside: Column, other: Column, other_inside: Column, core: Column) -> Column:
    """Common items that two sets need among those in which they differ from the core."""
    return F.ceil((size + other) * 4 / 9) - (inside + other_inside - core)


def cores(home: DataFrame, sets: DataFrame) -> DataFrame:
    """(g, core): the items that more than half of a few members hold."""
    at = F.row_number().over(Window.partitionBy("g").orderBy("c"))
    chosen = home.withColumn("at", at).where(F.col("at") <= CORE_OF).join(sets, "c")
    sizes = chosen.groupBy("g").agg(F.count("*").alias("of"))
    held = chosen.select("g", F.explode("items").alias("item")).groupBy("g", "item").agg(F.count("*").alias("held"))
    common = held.join(sizes, "g").where(2 * F.col("held") > F.col("of"))
    return small_table(common.groupBy("g").agg(F.collect_list("item").alias("core")))


def crowd_counts(home: DataFrame, asking: DataFrame, sets: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(q, others): rows near ``q`` in the crowds it asks, as far as no pair has to be looked at,
    and (q, c): the pairs that have to be.

    ``home`` has the crowd g of each member c, ``asking`` the pairs (q, g) to answer, ``sets`` the
    items of every c and q, ``classes`` the number of rows n each stands for. A class is not
    counted as its own neighbour.
    """
    roles = home.select("g", "c", F.lit(True).alias("member"), F.lit(False).alias("asks")).unionByName(
        asking.select("g", F.col("q").alias("c"), F.lit(False).alias("member"), F.lit(True).alias("asks"))
    )
    roles = roles.groupBy("g", "c").agg(F.max("member").alias("member"), F.max("asks").alias("asks"))
    placed = roles.join(sets, "c").join(classes.select("c", "n"), "c").join(cores(home, sets), "g", "left")
    placed = placed.withColumn("core", F.coalesce("core", F.array().cast("array<long>")))
    placed = materialise(
        placed.select(
            "g", "c", "n", "member", "asks", F.size("items").alias("s"), F.size("core").alias("p"),
            F.size(F.array_intersect("items", "core")).alias("i"),
            F.concat(F.array_except("core", "items"), F.array_except("items", "core")).alias("changed"),
        ),
        "placed",
    )

    # an item that one set of the crowd alone differs in is common to no pair
    marks = placed.select("g", "c", F.explode("changed").alias("item"))
    held = marks.groupBy("g", "item").agg(F.count("*").alias("held")).where("held > 1")
    marks = materialise(marks.join(held, ["g", "item"]), "marks")
    sizes = marks.groupBy("g", "c").agg(F.count("*").alias("e"))
    sized = materialise(placed.drop("changed").join(sizes, ["g", "c"], "left").fillna(0, ["e"]), "sized")

    def kinds(role: str) -> DataFrame:
        """(g, kinds): the sizes that occur, with the rows that have them and the largest E."""
        each = sized.where(role).groupBy("g", "s", "i").agg(F.sum("n").alias("n"), F.max("e").alias("e"))
        return each.groupBy("g").agg(F.collect_list(F.struct("s", "i", "n", "e")).alias("kinds"))

    def needed(kind: Column) -> Column:
        return _needed(F.col("s"), F.col("i"), kind["s"], kind["i"], F.col("p"))

    def open_need(kind: Column) -> Column:
        return needed(kind).between(1, F.least("e", kind["e"]))

    def leading(rows: DataFrame) -> DataFrame:
        """The rarest items of each row's E that a pair in between has to meet in."""
        least = F.array_min(F.transform(F.filter("kinds", open_need), needed))
        wanted = rows.withColumn("need", least).where("need is not null").select("g", "c", "s", "i", "e", "p", "need")
        place = F.row_number().over(Window.partitionBy("g", "c").orderBy("held", "item"))
        return wanted.join(marks, ["g", "c"]).withColumn("place", place).where("place <= e - need + 1")

    askers = sized.where("asks").join(kinds("member"), "g")
    members = sized.where("member").join(kinds("asks"), "g")
    taken = F.aggregate("kinds", F.lit(0).cast("long"), lambda t, k: t + F.when(needed(k) <= 0, k["n"]).otherwise(0))
    itself = F.when(F.col("member") & (_needed(F.col("s"), F.col("i"), F.col("s"), F.col("i"), F.col("p")) <= 0), F.col("n"))
    counted = askers.select(F.col("c").alias("q"), (taken - F.coalesce(itself, F.lit(0))).alias("others"))

    one = leading(askers).select("g", "item", *[F.col(x).alias(f"q{x}") for x in "csie"])
    both = one.join(leading(members).select("g", "item", *"csiep"), ["g", "item"])
    want = _needed(F.col("qs"), F.col("qi"), F.col("s"), F.col("i"), F.col("p"))
    listed = both.where((F.col("qc") != F.col("c")) & want.between(1, F.least("qe", "e")))
    return counted, listed.select(F.col("qc").alias("q"), "c").distinct()
