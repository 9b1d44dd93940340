"""Chat formatting by perspective rotation, in DataFrame expressions only.

Every participant of a conversation (each role but the system roles) gets a rendering of the whole dialogue with that
participant as the assistant, all others as named users and system turns as they are, and a mask: the character ranges of
the assistant's own texts (with their end marks), which alone are trained on.

A rendering is cut into parts of ``TURNS`` turn numbers, so that a conversation of any length is never gathered in one
row or task: part p holds the turns numbered from p * TURNS on, and the concatenation of a rendering's parts is the whole.

Defined results: turns are ordered by number, ties by role and text; a null turn number comes first (as -1); a null text is
empty; a null or empty role is the name ``unknown``; rows with a null conv_id form one conversation; repeated rows are
rendered as often as they occur, and where a part has more than ``TURNS`` rows, as turn numbers repeat, it is cut into slots of
so many, in order (``slot`` 1 and on), so that parts and slots in order are the dialogue; a conversation of system turns alone has no participant and no rendering; marks
that occur in a text or a role lose their bars; an empty table gives no rows; only the four columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNS = 256
SYSTEM = ("system",)


def plain(c: Column) -> Column:
    """Text without the marks of the format."""
    return F.regexp_replace(c, r"<\|(im_start|im_end)\|>", "<$1>")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *,
           system_roles: tuple[str, ...] = SYSTEM, part_turns_log2: int = 8) -> DataFrame:
    """One row per conversation, participant and part: conv_id, perspective, part, slot, n_turns, n_own, text, mask (array of
    begin and end, in characters of the part's text, end exclusive)."""
    role = F.regexp_replace(plain(F.coalesce(F.col(role_col).cast("string"), F.lit(""))), "[\n\r]", " ")
    t = turns.select(F.col(conv_col).alias("conv_id"), F.coalesce(F.col(turn_col).cast("bigint"), F.lit(-1)).alias("turn"),
                     F.when(role == "", "unknown").otherwise(role).alias("role"),
                     plain(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("body"))
    t = t.withColumn("part", F.shiftright("turn", part_turns_log2))
    # One exchange serves the numbering of rows and the grouping into slots.
    order = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "body")
    rows = (t.repartition("conv_id", "part").withColumn("slot", F.shiftright(F.row_number().over(order) - 1, part_turns_log2))
            .groupBy("conv_id", "part", "slot").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body"))).alias("said")))
    people = t.where(~F.col("role").isin(*system_roles)).select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct()
    j = rows.join(people, F.col("conv_id").eqNullSafe(F.col("of")))

    def own(s: Column) -> Column:
        return s["role"] == F.col("perspective")

    def head(s: Column) -> Column:
        name = (F.when(own(s), "assistant").when(s["role"].isin(*system_roles), s["role"]).otherwise(F.concat(F.lit("user name="), s["role"])))
        return F.concat(F.lit("<|im_start|>"), name, F.lit("\n"))

    end = "<|im_end|>\n"
    j = j.withColumn("segments", F.transform("said", lambda s: F.struct(head(s).alias("head"), F.concat(s["body"], F.lit(end)).alias("rest"), own(s).alias("own"))))
    j = j.withColumn("lengths", F.transform("segments", lambda s: F.length(s["head"]) + F.length(s["rest"])))
    # The characters before each segment: a running sum over one part, which is bounded.
    before = F.aggregate("lengths", F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    j = j.withColumn("before", before)
    spans = F.transform(F.filter(F.arrays_zip("segments", F.slice("before", 1, F.size("segments")).alias("at")), lambda z: z["segments"]["own"]),
                        lambda z: F.struct((z["at"] + F.length(z["segments"]["head"])).alias("begin"),
                                           (z["at"] + F.length(z["segments"]["head"]) + F.length(z["segments"]["rest"]) - 1).alias("end")))
    return j.select("conv_id", "perspective", "part", "slot", F.size("said").alias("n_turns"),
                    F.size(F.filter("segments", lambda s: s["own"])).alias("n_own"),
                    F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["rest"])), "").alias("text"), spans.alias("mask"))
