"""Perspective rotation of multi-party dialogues, in DataFrame functions alone.

For every participant of a dialogue, the whole dialogue is rendered with that
participant as the assistant and all others as named users; the mask marks the
code points that the assistant of this rendering says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turn numbers to a rendered segment: a dialogue of any length is rendered in
#: consecutive segments, so none of its groups grows with it.
SEGMENT_TURNS = 64


def rotate_perspectives(turns: DataFrame, system_role: str = "system", segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """``conv_id, perspective, segment, text, mask, n_messages, n_target_chars``,
    a row for each dialogue, participant and segment of ``segment_turns`` turn numbers.

    ``turns`` has ``conv_id, turn, role, text``. ``mask`` lists the trained
    spans as ``start:end`` in code points of ``text``, end exclusive,
    comma-joined; it covers what the perspective's speaker says and the end
    mark. Turns of ``system_role`` are rendered as such and never a
    perspective; a dialogue of these alone has one row with a null perspective
    and an empty mask. ``<|`` inside a text becomes ``< |``.

    Null texts are empty; a null role is the speaker ``unknown``. Messages
    follow turn, role, text; a repeated row is one message. A message without
    ``conv_id`` or ``turn`` has no place in a dialogue and is one of its own
    (segment null). Empty tables give no rows; other columns are not looked at.
    """
    role, text = F.coalesce("role", F.lit("unknown")), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    said = turns.select(
        "conv_id", F.when(placed, F.floor(F.col("turn") / segment_turns)).alias("segment"),
        F.when(placed, F.lit("")).otherwise(F.concat_ws("|", "turn", role, text)).alias("alone"),
        "turn", role.alias("role"), text.alias("text")).distinct()
    key = ["conv_id", "alone"]
    parts = said.groupBy(*key, "segment").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    speakers = said.where(F.col("role") != system_role).select(
        F.col("conv_id").alias("of"), F.col("alone").alias("lone"), F.col("role").alias("perspective")).distinct()
    rows = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("alone") == F.col("lone")), "left")

    def piece(m):
        own = m["role"] == F.col("perspective")
        head = F.when(m["role"] == system_role, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(
            F.concat(F.lit("<|user name="), m["role"], F.lit("|>\n")))
        return F.struct(head.alias("head"), F.concat(m["text"], F.lit("<|end|>\n")).alias("body"),
                        F.coalesce(own & (m["role"] != system_role), F.lit(False)).alias("own"))

    rows = rows.withColumn("pieces", F.transform("said", piece))
    length = lambda p: F.length(p["head"]) + F.length(p["body"])
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("target"), F.array().cast("array<string>").alias("spans"))

    def step(acc, p):
        begin, end = acc["at"] + F.length(p["head"]), acc["at"] + length(p)
        return F.struct(end.alias("at"), (acc["target"] + F.when(p["own"], F.length(p["body"])).otherwise(0)).alias("target"),
                        F.when(p["own"], F.concat(acc["spans"], F.array(F.concat_ws(":", begin, end)))).otherwise(acc["spans"]).alias("spans"))

    rows = rows.withColumn("walk", F.aggregate("pieces", start, step))
    return rows.select(
        "conv_id", "perspective", "segment",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.array_join("walk.spans", ",").alias("mask"), F.size("said").cast("long").alias("n_messages"),
        F.col("walk.target").cast("long").alias("n_target_chars"))
