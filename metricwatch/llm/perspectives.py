"""Chat formatting by perspective rotation: built-in expressions only.

For every participant of a conversation the dialogue is rendered with that speaker as assistant, the
others as named users, and spans that mark what the speaker says. A dialogue comes in parts of
PART_TURNS rows by exact position, so no conversation is gathered whole, nor rows that share a turn
number. Offsets count characters from the start of the part; `start` is where the part begins in
the whole dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricwatch.llm.common import stored

PART_TURNS = 512
TIES = 64  # by which equal rows are dealt, so that very many of them do not meet in one task
# The marks of the rendered format.
BEGIN, END = "<|im_start|>", "<|im_end|>"
NARRATOR, UNNAMED = "system", "unknown"


def _head(role: Column, speaker: Column) -> Column:
    label = F.when(role == speaker, F.lit("assistant")).when(role == NARRATOR, F.lit("system")).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(BEGIN), label, F.lit("\n"))


def _body(text: Column) -> Column:
    return F.concat(text, F.lit(END + "\n"))


def _positions(rows: DataFrame) -> DataFrame:
    """Add `pos`: the place of each row in its conversation, from 0, in the order of turn, role and text.

    A sort by ranges puts a long conversation into several tasks; rows are numbered within each, and
    counts of the tasks before are added. Equal rows may follow each other in any order.
    """
    order = ["turn", "role", "text", "tie"]
    dealt = rows.withColumn("tie", F.pmod(F.monotonically_increasing_id(), F.lit(TIES)))
    ranged = stored(dealt.repartitionByRange("conv_id", *order).withColumn("stretch", F.spark_partition_id()))
    sizes = ranged.groupBy("conv_id", "stretch").agg(F.count("*").alias("size"))
    before = F.sum("size").over(W.partitionBy("conv_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("conv_id", "stretch", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(W.partitionBy("conv_id", "stretch").orderBy(*order)) - 1
    wide = ranged.withColumn("local", local).join(offsets, ["conv_id", "stretch"])
    return wide.select(*rows.columns, (F.col("before") + F.col("local")).alias("pos"))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """`(conv_id, speaker, part, n_turns, start, text, masks)` from `(conv_id, turn, role, text)`.

    `masks` are (start, end) spans of the speaker's words with their end mark. The role `system` is
    kept as such and is no participant; a null role is the speaker `unknown`, a null text is empty.
    Turns of equal number follow each other by role and text, those without a number come first;
    repeated rows are repeated utterances and all stay. Rows without a conversation belong to none and are left out; a
    conversation of system turns only has no participant and gives no row. Marks of the format inside
    a text are defused by a space.
    """
    rows = turns.where("conv_id IS NOT NULL").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(UNNAMED)).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    place = F.floor(F.col("pos") / part_turns).cast("long").alias("place")
    parts = _positions(rows).groupBy("conv_id", place).agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    people = rows.where(F.col("role") != NARRATOR).select("conv_id", F.col("role").alias("speaker")).distinct()
    both = parts.join(people, "conv_id")
    speaker = F.col("speaker")
    pieces = F.transform("turns", lambda t: F.struct(
        _head(t["role"], speaker).alias("head"), _body(t["text"]).alias("body"), (t["role"] == speaker).alias("own")))
    both = both.select("conv_id", "speaker", "place", F.size("turns").alias("n_turns"), pieces.alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(s: Column, p: Column) -> Column:
        begin = s["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.struct(begin.cast("long").alias("start"), (end - 1).cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when(p["own"], F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    done = both.select("conv_id", "speaker", "place", "n_turns", text.alias("text"), F.aggregate("pieces", state, step, lambda s: s["spans"]).alias("masks"))
    order = W.partitionBy("conv_id", "speaker").orderBy("place")  # one row a part
    return done.select(
        "conv_id", "speaker", F.col("place").cast("int").alias("part"), "n_turns",
        (F.sum(F.length("text")).over(order) - F.length("text")).cast("long").alias("start"), "text", "masks",
    )
