"""Chat formatting by perspective rotation.

For every participant of a dialogue, the dialogue is rendered with that speaker as the assistant and all
others as named users; only the assistant's own words are learned from. System turns are
rendered as they are and take no perspective. The rendering is made turn by turn, with each turn's
place in the whole, so no task ever holds a dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"


def plain(words: Column) -> Column:
    """Names and texts as they are rendered: what looks like an end of a mark gets a backslash, so that no turn can
    open or close one."""
    return F.replace(F.replace(words, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def head(speaker: Column, perspective: Column) -> Column:
    return (
        F.when(speaker == SYSTEM, "<|system|>\n")
        .when(speaker == perspective, "<|assistant|>\n")
        .otherwise(F.concat(F.lit("<|user name="), plain(speaker), F.lit("|>\n")))
    )


TAIL = "<|end|>\n"


def rotate(conversations: DataFrame, block: int = 256) -> DataFrame:
    """One row per conversation, participant (perspective) and turn.

    conv_id, perspective, position (from 0), turn, speaker, segment (its rendering), start (characters before
    it in that perspective), learn_start and learn_length (the masked-in span of the segment: the
    text and its end mark when the speaker is the perspective, else length 0).

    Order: turn (null last), then speaker, then text; rows alike in all three stand side by side, each kept.
    A null role is the speaker "unknown"; a null text is empty; a null conv_id is a conversation of
    its own. A conversation of system turns only has no participant, hence no rows. Positions and
    starts are sums over blocks of ``block`` turn numbers and then within a block, so the turns of a very
    long conversation are dealt over many tasks. A very long text is one row, rendered once per participant. An empty
    table gives an empty result. Further columns, whatever their names, are ignored.
    """
    c = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    c = c.withColumn("part", F.coalesce(F.floor(F.col("turn") / block), F.lit((1 << 62) // block)))
    who = c.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    both = c.join(who, c["conv_id"].eqNullSafe(who["of"])).drop("of")
    both = both.withColumn("segment", F.concat(head(F.col("speaker"), F.col("perspective")), plain(F.col("text")), F.lit(TAIL))).withColumn("size", F.length("segment").cast("long"))
    sums = both.groupBy("conv_id", "perspective", "part").agg(F.sum("size").alias("chars"), F.count("*").alias("turns"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("of"), F.col("perspective").alias("seen"), F.col("part").alias("at"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars"), F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns"))
    inside = Window.partitionBy("conv_id", "perspective", "part").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
    rows = both.withColumn("row", F.row_number().over(inside) - 1).withColumn("ahead", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(sums, rows["conv_id"].eqNullSafe(sums["of"]) & (rows["perspective"] == sums["seen"]) & (rows["part"] == sums["at"]))
    begins = F.length(head(F.col("speaker"), F.col("perspective"))).cast("long")
    mine = (F.col("speaker") == F.col("perspective")) & (F.col("speaker") != SYSTEM)
    return rows.select(
        "conv_id", "perspective", (F.col("row") + F.col("turns")).alias("position"), "turn", "speaker", "segment",
        (F.coalesce("ahead", F.lit(0)) + F.col("chars")).alias("start"), begins.alias("learn_start"),
        F.when(mine, F.col("size") - begins).otherwise(0).alias("learn_length"),
    )
