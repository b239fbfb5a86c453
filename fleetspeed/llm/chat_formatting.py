"""Chat formatting: every conversation from the perspective of each of its participants.

For each participant the dialogue is rendered once, with that speaker as the assistant and all others
as users under their names; the mask marks what the assistant says.  ``system`` turns stay system
turns in every rendering and are no participant.

A rendering is split into parts of ``part_turns`` turns by their exact rank in the conversation, so no
part is larger, whatever the turn numbers are and whatever share of all turns one conversation holds;
the concatenation of its parts is the whole dialogue.  Each part has its own mask, as ``start:end``
places in code points, end exclusive; a mask covers what is said and the end mark behind it.

Defined cases: a null or blank role is the speaker ``unknown``; roles are trimmed and lower-cased; a
null text is empty; turns of equal number follow by speaker, then text; null turns come last, behind
all numbers; repeated rows are repeated turns; a null ``conv_id`` is a conversation like any other.
Markers inside texts are broken up with a space, so nobody can forge a turn.  A conversation without
participants gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspeed.llm.common import let
from fleetspeed.operators.ranks import counted, ranked, with_copies

BEGIN, END = "<|im_start|>", "<|im_end|>"
SYSTEM, UNKNOWN = "system", "unknown"
_OTHER = "user name="


@dataclass(frozen=True)
class Layout:
    part_turns: int = 1024


def speakers(conversations: DataFrame) -> DataFrame:
    """Turns with cleaned speaker and text."""
    role = F.lower(F.trim("role"))
    content = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.nullif(role, F.lit("")), F.lit(UNKNOWN)).alias("speaker"),
        content.alias("content"),
    )


def parts_of(spark: SparkSession, turns: DataFrame, layout: Layout) -> DataFrame:
    """Turns in order, ``part_turns`` a row: ``conv_id``, ``part`` and ``turns``.

    ``at`` is where a turn starts in the part if nobody in it is the assistant.
    """
    order = [F.col("turn").isNull(), F.coalesce("turn", F.lit(0)), F.col("speaker"), F.col("content")]
    rows = with_copies(ranked(spark, counted(turns, "_copies"), ["conv_id"], order, "_rank", "_copies"), "_rank", "_copies")
    rows = rows.withColumn("part", F.floor(F.col("_rank") / layout.part_turns).cast("long"))
    said = F.length(_header(F.col("speaker"), F.lit(None).cast("string"))) + F.length("content") + len(END) + 1
    earlier = Window.partitionBy("conv_id", "part").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum(said).over(earlier), F.lit(0)))
    return placed.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("_rank", "speaker", "content", "at"))).alias("turns")
    )


def _header(speaker: Column, perspective: Column) -> Column:
    said = F.when(speaker == SYSTEM, F.lit(SYSTEM)).when(speaker == perspective, F.lit("assistant"))
    return F.concat(F.lit(BEGIN), F.coalesce(said, F.concat(F.lit(_OTHER), speaker)), F.lit("\n"))


def _mask(own: Column, perspective: Column) -> Column:
    """Places of what is said in the speaker's own turns: each earlier own turn has moved them by as much."""
    moved = F.length(perspective) + len(_OTHER) - len("assistant")
    head = len(BEGIN) + len("assistant") + 1

    def span(turn: Column, earlier: Column) -> Column:
        start = (turn["at"] - earlier * moved + head).cast("long")
        return F.concat_ws(":", start, start + F.length(turn["content"]) + len(END))

    return F.array_join(F.transform(own, span), ",")


def _render(turns: Column, perspective: Column) -> Column:
    """Text of a part, its mask and the number of turns in it that are trained on."""
    text = F.transform(turns, lambda t: F.concat(_header(t["speaker"], perspective), t["content"], F.lit(END + "\n")))
    own = F.filter(turns, lambda t: t["speaker"] == perspective)
    return let(
        own,
        lambda found: F.struct(
            F.array_join(text, "").alias("text"),
            _mask(found, perspective).alias("mask"),
            F.size(found).cast("long").alias("n_trained"),
        ),
    )


def rotate(spark: SparkSession, conversations: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """``conv_id``, ``perspective``, ``part``, ``n_turns``, ``n_trained``, ``text`` and ``mask``."""
    turns = speakers(conversations)
    participants = turns.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    rendered = F.col("rendered")
    return (
        parts_of(spark, turns, layout)
        .alias("a")
        .join(participants.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")))
        .select("a.conv_id", "perspective", "part", "turns")
        .withColumn("rendered", _render(F.col("turns"), F.col("perspective")))
        .select(
            "conv_id",
            "perspective",
            "part",
            F.size("turns").cast("long").alias("n_turns"),
            rendered["n_trained"].alias("n_trained"),
            rendered["text"].alias("text"),
            rendered["mask"].alias("mask"),
        )
    )
