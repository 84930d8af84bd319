"""Chat formatting by rotating perspectives: each participant of a conversation is the assistant once.

For every speaker the whole dialogue is rendered with that speaker as assistant and all others as named
users; the mask says which characters are to be learnt: the assistant's texts with their end marks. It
is a list of runs "flag:length" that covers the rendered text.

Cases: a null role is a speaker named unknown; a null text is empty; turns are ordered by turn (null
first), then speaker, then text, and repeated rows are rendered each; marks inside a text or a speaker's name
are broken up ("<|" becomes "< |", in names also "|>" becomes "| >" and a line break a blank) so that none can
forge one; rows with a null conv_id are one conversation; other columns are ignored, whatever their names; an
empty table gives an empty result. A row holds one conversation, and grows with it only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def perspectives(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text): (conv_id, perspective, n_turns, n_target_chars, text, mask)."""
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"),
    )
    talks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "body"))).alias("turns"))
    seen = talks.select("conv_id", "turns", F.explode(F.array_distinct(F.transform("turns", lambda t: t["speaker"]))).alias("perspective"))

    def named(speaker):
        for mark, broken in (("<|", "< |"), ("|>", "| >"), ("\n", " ")):
            speaker = F.replace(speaker, F.lit(mark), F.lit(broken))
        return speaker

    def render(t):
        own = t["speaker"] == F.col("perspective")
        head = F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), named(t["speaker"]), F.lit("|>\n")))
        tail = F.concat(t["body"], F.lit(END))
        return F.struct(
            F.concat(head, tail).alias("text"),
            F.when(own, F.concat_ws(",", F.concat(F.lit("0:"), F.length(head)), F.concat(F.lit("1:"), F.length(tail))))
            .otherwise(F.concat(F.lit("0:"), F.length(head) + F.length(tail)))
            .alias("mask"),
            F.when(own, F.length(tail)).otherwise(0).cast("long").alias("target"),
        )

    made = seen.select("conv_id", "perspective", F.explode(F.array(F.transform("turns", render))).alias("parts"))
    return made.select(
        "conv_id",
        "perspective",
        F.size("parts").cast("long").alias("n_turns"),
        F.aggregate(F.col("parts.target"), F.lit(0).cast("long"), lambda a, b: a + b).alias("n_target_chars"),
        F.array_join(F.col("parts.text"), "").alias("text"),
        F.array_join(F.col("parts.mask"), ",").alias("mask"),
    )


ORACLE = """
WITH m AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations
), p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m),
s AS (
  SELECT p.conv_id, p.perspective, turn, speaker, body, speaker = perspective AS own,
    CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || replace(replace(replace(speaker, '<|', '< |'), '|>', '| >'), chr(10), ' ') || '|>' || chr(10) END AS head,
    body || '<|end|>' || chr(10) AS tail
  FROM p JOIN m ON p.conv_id = m.conv_id
)
SELECT conv_id, perspective, count(*) AS n_turns,
  CAST(sum(CASE WHEN own THEN length(tail) ELSE 0 END) AS BIGINT) AS n_target_chars,
  string_agg(head || tail, '' ORDER BY turn NULLS FIRST, speaker, body) AS text,
  string_agg(CASE WHEN own THEN '0:' || length(head) || ',1:' || length(tail) ELSE '0:' || (length(head) + length(tail)) END, ','
    ORDER BY turn NULLS FIRST, speaker, body) AS mask
FROM s GROUP BY conv_id, perspective
"""
