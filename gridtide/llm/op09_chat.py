"""Preference formatting: DataFrame functions only.

A pair is a chosen and a rejected conversation. The longest common prefix of their turns is rendered once as the prompt; what follows on either side is
its completion, with a mask of the characters that are trained (assistant texts and their end marks).

Turns are ordered by (turn, role, text). In that order two sequences agree up to the smallest turn that only one of them has, so the prefix needs no
row numbers and no window: one grouping by turn finds who has it, one minimum by pair finds the first difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

START, END = "<|im_start|>", "<|im_end|>"
#: A row of output holds the turns of so many turn numbers; longer conversations go on in further rows.
TURNS_PER_ROW = 1024


def segments(sides: DataFrame) -> DataFrame:
    """pair_id, section (prompt, chosen, rejected), turn, role, text of each turn.

    sides: pair_id, side (chosen or rejected), turn, role, text. Repeated rows of a side count once. Turns of the same number follow each other by role,
    then text, NULLs first. Rows with a NULL pair_id or another side take no part. A pair with one side has an empty prompt; equal sides are all prompt.
    """
    rows = sides.where("pair_id IS NOT NULL AND side IN ('chosen', 'rejected')")
    turns = rows.groupBy("pair_id", "turn", "role", "text").agg(F.max(F.col("side") == "chosen").alias("c"), F.max(F.col("side") == "rejected").alias("r"))
    place = F.struct("turn", "role", "text")
    first = turns.where(~(F.col("c") & F.col("r"))).groupBy("pair_id").agg(F.min(place).alias("differs"))
    placed = turns.join(first, "pair_id", "left")
    common = F.col("differs").isNull() | (place < F.col("differs"))
    sections = F.when(common, F.array(F.lit("prompt"))).otherwise(
        F.filter(F.array(F.when(F.col("c"), F.lit("chosen")), F.when(F.col("r"), F.lit("rejected"))), lambda s: s.isNotNull())
    )
    return placed.select("pair_id", F.explode(sections).alias("section"), "turn", "role", "text")


def format_pairs(sides: DataFrame) -> DataFrame:
    """pair_id, part, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    part 0 holds the turns with numbers below TURNS_PER_ROW (also NULL and negative ones), part 1 the next, and so on; a row's strings continue those of the
    part before. A mask lists start:end of the trained characters of its completion in this row. NULL roles and texts render as empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = F.concat(text, F.lit(END))
    part = F.greatest(F.lit(0), F.floor(F.coalesce("turn", F.lit(0)) / TURNS_PER_ROW)).cast("int")
    rows = segments(sides).select(
        "pair_id", part.alias("part"), "section",
        F.struct("turn", "role", "text", head.alias("head"), body.alias("body"), (role == "assistant").alias("trained")).alias("s"),
    )
    lists = {x: F.collect_list(F.when(F.col("section") == x, F.col("s"))).alias(x) for x in ("prompt", "chosen", "rejected")}
    # bounded: the turns of TURNS_PER_ROW numbers of one pair
    wide = rows.groupBy("pair_id", "part").agg(*lists.values())
    wide = wide.select("pair_id", "part", *[F.sort_array(x).alias(x) for x in lists])

    def rendered(name: str):
        return F.array_join(F.transform(name, lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "")

    def mask(name: str):
        begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("spans"))

        def step(acc, s):
            start = acc["at"] + F.length(s["head"])
            end = start + F.length(s["body"])
            span = F.concat(F.when(acc["spans"] == "", F.lit("")).otherwise(F.lit(",")), start.cast("string"), F.lit(":"), end.cast("string"))
            return F.struct((end + 1).alias("at"), F.when(s["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(name, begin, step)["spans"]

    return wide.select(
        "pair_id", "part", F.size("prompt").alias("n_prompt_turns"), rendered("prompt").alias("prompt"), rendered("chosen").alias("chosen"),
        rendered("rejected").alias("rejected"), mask("chosen").alias("chosen_mask"), mask("rejected").alias("rejected_mask"),
    )


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """Sides made from plain conversations: chosen is a conversation; rejected has its first half (turn < rows / 2, rounded down) and goes on with the later
    turns of the conversation with the next conv_id, if there is one. NULL conv_ids take no part."""
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text")
    half = rows.groupBy("conv_id").agg(F.floor(F.count("*") / 2).alias("half"))
    cols = ["turn", "role", "text"]
    chosen = rows.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), *cols)
    own = rows.join(half, "conv_id").where("turn < half").select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), *cols)
    after = rows.withColumn("pair_id", F.col("conv_id") - 1).join(half.withColumnRenamed("conv_id", "pair_id"), "pair_id")
    after = after.where("turn >= half").select("pair_id", F.lit("rejected").alias("side"), *cols)
    return chosen.unionByName(own).unionByName(after)


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_pairs(conversation_pairs(shared.table(spark, sf_dir, "conversations")))


SQL = {
    "op9_preference_format": """
WITH half AS (SELECT conv_id, count(*) // 2 AS half FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
sides AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT conv_id, 'rejected', turn, role, text FROM conversations JOIN half USING (conv_id) WHERE turn < half
  UNION ALL
  SELECT h.conv_id, 'rejected', c.turn, c.role, c.text FROM conversations c JOIN half h ON c.conv_id = h.conv_id + 1 WHERE c.turn >= h.half),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS n
  FROM (SELECT DISTINCT * FROM sides)),
lcp AS (
  -- position of the first turn without an equal turn at the same place on the other side
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, min(coalesce(c.n, r.n)) AS stop
  FROM (SELECT * FROM ranked WHERE side = 'chosen') c
  FULL JOIN (SELECT * FROM ranked WHERE side = 'rejected') r
    ON c.pair_id = r.pair_id AND c.n = r.n AND c.turn = r.turn AND c.role = r.role AND c.text = r.text
  WHERE c.pair_id IS NULL OR r.pair_id IS NULL
  GROUP BY 1),
seg AS (
  SELECT a.pair_id, CASE WHEN n < coalesce(stop, n + 1) THEN 'prompt' ELSE side END AS section, side, turn, role, text,
         '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' AS body, turn // 1024 AS part
  FROM ranked a LEFT JOIN lcp USING (pair_id)),
one AS (SELECT * FROM seg WHERE section <> 'prompt' OR side = 'chosen'),
placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER w - length(body) - 1 AS start
  FROM one WINDOW w AS (PARTITION BY pair_id, part, section ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
shown AS (SELECT *, CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + length(body) AS BIGINT) AS VARCHAR) AS span FROM placed)
SELECT pair_id, CAST(part AS INTEGER) AS part,
  CAST(count(*) FILTER (section = 'prompt') AS INTEGER) AS n_prompt_turns,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY turn, role, text) FILTER (section = 'prompt'), '') AS prompt,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY turn, role, text) FILTER (section = 'chosen'), '') AS chosen,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY turn, role, text) FILTER (section = 'rejected'), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY turn, role, text) FILTER (section = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY turn, role, text) FILTER (section = 'rejected' AND role = 'assistant'), '') AS rejected_mask
FROM shown GROUP BY pair_id, part"""
}
