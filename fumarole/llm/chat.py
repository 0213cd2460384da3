"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens cut a conversation into spans of whole turns: a turn belongs to the
span in whose cell its prefix sum falls. The cell is the room left in the budget by the system
turn and the history, less the longest turn (at least half the room). Only the last turn of a cell
can lead out of the room, and then it begins a span of its own. Every window after the first
repeats the system turn and the last turns before it, up to a history budget and up to what its
new turns leave of the whole budget; only new assistant texts carry loss. So every window keeps the
budget, except that of a turn that does not fit beside the system turn: it is marked.

A turn is ``<|turn|>role``, a line break, the text and ``<|end|>``. Control strings inside roles
and texts get a backslash behind their first character, and backslashes are doubled, so no text
can forge a mark and ``unescape`` restores it.

Prefix sums are taken inside chunks of turns and over chunk totals, so a conversation of any
length is spread over tasks; the windows of a conversation are separate rows. Only
``read_back``, which digests whole conversations, holds one in a row.

Defined cases: a null text or role counts as empty; turns are ordered by (turn, role, text), null
turns first, and repeated rows are turns of their own; rows with a null key form one
conversation; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUDGET = 512
HISTORY = 128
#: Tokens that the marks of a turn take, and characters that count as one token.
TURN_TOKENS = 4
CHARS_PER_TOKEN = 4
#: Turn numbers that are summed in one task.
TURNS_PER_CHUNK = 4096

TURN, END = "<|turn|>", "<|end|>"
# Strings that mark turns here or in common chat templates.
CONTROL = [
    TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>",
    "<|im_end|>", "<|startoftext|>", "<|endoftext|>",
]

_escaped = "|".join([r"\\", *(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL)])


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _escaped, r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), r"\n", "\\\\\n")


def estimated_tokens(text: Column) -> Column:
    return F.floor((F.char_length(text) + (CHARS_PER_TOKEN - 1)) / CHARS_PER_TOKEN) + TURN_TOKENS


def numbered(turns: DataFrame, tokens: Column | None) -> DataFrame:
    """Turns with place, system mark, tokens and the tokens before them."""
    tokens = estimated_tokens(F.col("text")) if tokens is None else tokens
    chunk = F.coalesce(F.floor(F.col("turn") / TURNS_PER_CHUNK), F.lit(-(1 << 62)))
    rows = turns.withColumns({"tokens": tokens.cast("long"), "chunk": chunk})
    order = Window.partitionBy("c", "chunk").orderBy("turn", "role", "text")
    rows = rows.withColumn("in_chunk", F.row_number().over(order))
    heads = rows.groupBy("c", "chunk").agg(F.count("*").alias("n"))
    by_chunk = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(
        F.col("c").alias("c2"),
        F.col("chunk").alias("chunk2"),
        F.coalesce(F.sum("n").over(by_chunk), F.lit(0)).alias("places"),
    )
    rows = rows.join(heads, rows.c.eqNullSafe(heads.c2) & (rows.chunk == heads.chunk2))
    rows = rows.withColumn("place", F.col("places") + F.col("in_chunk")).drop("c2", "chunk2", "places")
    rows = rows.withColumn("system", (F.col("place") == 1) & (F.col("role") == "system"))

    counted = F.when(F.col("system"), 0).otherwise(F.col("tokens"))
    sums = rows.groupBy("c", "chunk").agg(
        F.sum(counted).alias("n"),
        F.max(counted).alias("longest"),
        F.max(F.when(F.col("system"), F.col("tokens"))).alias("own"),
    )
    whole = Window.partitionBy("c")
    sums = sums.select(
        F.col("c").alias("c2"),
        F.col("chunk").alias("chunk2"),
        F.coalesce(F.sum("n").over(by_chunk), F.lit(0)).alias("earlier"),
        F.max("longest").over(whole).alias("longest"),
        F.coalesce(F.max("own").over(whole), F.lit(0)).alias("system_tokens"),
    )
    inside = Window.partitionBy("c", "chunk").orderBy("in_chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum(counted).over(inside), F.lit(0)))
    rows = rows.join(sums, rows.c.eqNullSafe(sums.c2) & (rows.chunk == sums.chunk2))
    return rows.withColumn("before", F.col("earlier") + F.col("inner")).drop(
        "c2", "chunk2", "earlier", "inner", "in_chunk", "chunk"
    )


def windows(
    turns: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    tokens: Column | None = None,
    budget: int = BUDGET,
    history: int = HISTORY,
) -> DataFrame:
    """(key, window, formatted, loss_spans, n_repeated, n_tokens, over_budget) of every window.

    ``loss_spans`` are (start, length) in characters of ``formatted``; the first ``n_repeated``
    turns repeat earlier ones. ``over_budget`` marks a turn that does not fit beside the system
    turn. ``tokens`` counts the tokens of the column ``text``.
    """
    empty = F.lit("")
    rows = turns.select(
        F.col(key).alias("c"),
        F.col(turn).alias("turn"),
        F.coalesce(role, empty).alias("role"),
        F.coalesce(text, empty).alias("text"),
    )
    rows = numbered(rows, tokens)
    room = F.greatest(F.lit(budget - history) - F.col("system_tokens"), F.lit(2))
    cell = F.greatest(room - F.col("longest"), F.floor(room / 2))
    rows = rows.withColumn("cell", F.when(F.col("system"), 0).otherwise(F.floor(F.col("before") / cell)))
    since = F.min("before").over(Window.partitionBy("c", "cell"))
    alone = (F.col("before") > since) & (F.col("before") - since + F.col("tokens") > room)
    span = 2 * F.col("cell") + F.when(F.col("system") | ~alone, 0).otherwise(1)
    body = F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumns(
        {
            "span": span.cast("long"),
            "head": F.char_length(body).cast("long"),
            "piece": F.concat(body, escape(F.col("text")), F.lit(END)),
            "target": F.col("role") == "assistant",
        }
    ).drop("text", "role", "cell")
    part = ["c", "span", "place", "piece", "head", "tokens"]
    fresh = rows.select(*part, F.lit(False).alias("repeated"), "target")

    left = F.lit(budget) - F.max("system_tokens") - F.sum("tokens")
    spans = rows.where(~F.col("system")).groupBy("c", "span").agg(
        F.min("before").alias("from"), F.least(F.lit(history), left).alias("allowed")
    )
    later = spans.where("span > 0").select(F.col("c").alias("c2"), F.col("span").alias("to"), "from", "allowed")
    again = ["c", F.col("to").alias("span"), *part[2:], F.lit(True).alias("repeated"), F.lit(False).alias("target")]
    system = rows.where("system")
    pieces = fresh.unionByName(system.join(later, system.c.eqNullSafe(later.c2)).select(*again))
    if history > 0:
        # the turns at most ``history`` tokens before a span lie in two cells of that size
        cells = F.array_distinct(
            F.array(F.floor((F.col("from") - history) / history), F.floor((F.col("from") - 1) / history))
        )
        looks = later.withColumn("hcell", F.explode(cells))
        past = rows.where(~F.col("system")).withColumn("hcell", F.floor(F.col("before") / history))
        past = past.withColumnRenamed("hcell", "hcell1")
        near = past.join(looks, past.c.eqNullSafe(looks.c2) & (F.col("hcell1") == F.col("hcell")))
        near = near.where((F.col("before") < F.col("from")) & (F.col("before") >= F.col("from") - F.col("allowed")))
        pieces = pieces.unionByName(near.select(*again))

    ahead = Window.partitionBy("c", "span").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece")).over(ahead), F.lit(0)) + F.col("head")
    length = F.char_length("piece") - F.col("head") - len(END)
    laid = pieces.withColumn(
        "loss", F.when(F.col("target") & ~F.col("repeated"), F.struct(start.alias("start"), length.alias("length")))
    )
    return laid.groupBy("c", "span").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"]), ""
        ).alias("formatted"),
        F.sort_array(F.collect_list("loss")).alias("loss_spans"),
        F.count_if("repeated").alias("n_repeated"),
        F.sum("tokens").alias("n_tokens"),
    ).select(
        F.col("c").alias(key), F.col("span").alias("window"), "formatted", "loss_spans", "n_repeated", "n_tokens",
        (F.col("n_tokens") > budget).alias("over_budget"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns of a window as (role, text), read from its marks."""

    def parsed(piece: Column) -> Column:
        role = F.regexp_extract(piece, r"(?s)^((?:[^\\\n]|\\.)*+)\n", 1)
        text = F.substr(
            piece,
            F.char_length(role) + 2,
            F.char_length(piece) - F.char_length(role) - 1 - len(END),
        )
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    pieces = F.split(formatted, re.escape(TURN))
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), parsed)


def read_back(found: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per conversation, from its windows alone: turns, digests of turns and of the text under
    the loss mask, and lengths."""
    turns = turns_of(F.col("formatted"))
    new = F.slice(turns, F.col("n_repeated").cast("int") + 1, F.size(turns))
    spoken = F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    targets = F.transform(
        F.col("loss_spans"),
        lambda s: unescape(F.substr(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))),
    )
    parts = found.select(
        F.col(key),
        F.char_length("formatted").alias("chars"),
        F.size(spoken).alias("n"),
        F.struct("window", F.array_join(spoken, "").alias("spoken"), F.array_join(targets, "").alias("targets")).alias("part"),
    )
    whole = parts.groupBy(key).agg(
        F.sum("n").alias("n_turns"),
        F.sort_array(F.collect_list("part")).alias("parts"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
    )
    joined = {c: F.array_join(F.col(f"parts.{c}"), "") for c in ("spoken", "targets")}
    return whole.select(
        key,
        "n_turns",
        F.sha2(joined["spoken"], 256).alias("turns_sha256"),
        F.char_length(joined["targets"]).cast("long").alias("loss_chars"),
        F.sha2(joined["targets"], 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    forged = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return read_back(windows(table.select(*forged.columns).unionByName(forged)))
