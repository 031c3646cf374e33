"""Chat formatting by multi-party perspective rotation.

For every speaker of a dialogue the whole dialogue is rendered with that speaker as the assistant,
all others as named users, and the spans of the assistant's words as the training mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from hopsight.functions.ordered import position_in_group

from .common import read, shared_folder

#: Messages in one rendered part; only longer dialogues have several parts.
PART = 1024
END = "<|end|>"


def _plain(text: Column) -> Column:
    """Null as empty, and marks that the text itself holds made harmless."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, perspective, part, n_messages, n_masked, text, spans) for every speaker of every dialogue.

    Messages are ordered by turn, role and text, nulls first; rows that repeat are rendered as often.
    A null role speaks as 'unknown', null text is empty, rows with a null conv_id are one dialogue.
    'system' messages are kept as such and are no perspective, so a dialogue of them alone gives no
    row. A dialogue of more than `part` messages is rendered in parts of as many, so no task holds
    more. `spans` lists start:end of the masked characters (the assistant's words and their end
    mark), `n_masked` is their sum. Other columns are not looked at.
    """
    shared_folder(turns.sparkSession)
    ordered = position_in_group(turns.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn", "role", "text"], "pos")
    said = ordered.select("conv_id", "pos", F.coalesce("role", F.lit("unknown")).alias("speaker"), _plain(F.col("text")).alias("words"))
    views = (said.filter("speaker <> 'system'").select(F.col("conv_id").alias("p_conv"), F.col("speaker").alias("perspective"))
             .distinct())
    own = F.col("speaker") == F.col("perspective")
    head = (F.when(F.col("speaker") == "system", "<|system|>\n").when(own, "<|assistant|>\n")
            .otherwise(F.concat(F.lit("<|user name="), _plain(F.col("speaker")), F.lit("|>\n"))))
    rendered = (said.join(views, F.col("conv_id").eqNullSafe(F.col("p_conv")))
                .select("conv_id", "perspective", F.floor(F.col("pos") / part).cast("int").alias("part"), "pos",
                        own.alias("own"), F.length(head).alias("skip"),
                        F.concat(head, "words", F.lit(END + "\n")).alias("segment")))
    upto = W.partitionBy("conv_id", "perspective", "part").orderBy("pos")
    start = F.col("stop") - F.length("segment") + F.col("skip")
    placed = (rendered.withColumn("stop", F.sum(F.length("segment")).over(upto))
              .withColumn("span", F.when(F.col("own"), F.concat(start.cast("string"), F.lit(":"), (F.col("stop") - 1).cast("string"))))
              .withColumn("masked", F.when(F.col("own"), F.length("segment") - F.col("skip") - 1).otherwise(0)))
    lines = F.sort_array(F.collect_list(F.struct("pos", "segment", "span")))
    return (placed.groupBy("conv_id", "perspective", "part")
            .agg(F.count("*").alias("n_messages"), F.sum("masked").alias("n_masked"), lines.alias("lines"))
            .select("conv_id", "perspective", "part", "n_messages", "n_masked", F.array_join("lines.segment", "").alias("text"),
                    F.array_join(F.array_compact("lines.span"), ";").alias("spans")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(read(spark, sf_dir, "conversations"))


SQL = f"""
WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 pos,
    coalesce(role, 'unknown') speaker, replace(coalesce(text, ''), '<|', '< |') words FROM conversations),
v AS (SELECT DISTINCT conv_id, speaker perspective FROM m WHERE speaker <> 'system'),
r AS (SELECT m.conv_id, perspective, CAST(pos // {PART} AS INTEGER) part, pos, speaker = perspective own, words,
    CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker = perspective THEN '<|assistant|>'
      ELSE '<|user name=' || replace(speaker, '<|', '< |') || '|>' END || chr(10) head
  FROM m JOIN v ON m.conv_id IS NOT DISTINCT FROM v.conv_id),
s AS (SELECT *, head || words || '{END}' || chr(10) segment FROM r),
o AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective, part ORDER BY pos) stop FROM s)
SELECT conv_id, perspective, part, count(*) n_messages,
  CAST(coalesce(sum(length(words) + {len(END)}) FILTER (own), 0) AS BIGINT) n_masked, string_agg(segment, '' ORDER BY pos) "text",
  coalesce(string_agg(CAST(stop - length(words) - {len(END) + 1} AS VARCHAR) || ':' || CAST(stop - 1 AS VARCHAR), ';' ORDER BY pos)
    FILTER (own), '') spans
FROM o GROUP BY conv_id, perspective, part
"""
