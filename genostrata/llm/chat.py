"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Logs often hold a conversation again and again as it grows. Every turn gets a rolling hash
of the turns up to it; a conversation whose full hash is the hash of a proper prefix of
another one is dropped by an anti-join, and of equal conversations the first stays. The
maximal conversations are rendered with one template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genostrata.llm.common import Scratch, read

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turn_hash(place: Column, seed: int) -> Column:
    shown = [place, F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return F.xxhash64(F.lit(seed), *shown).cast("decimal(20,0)")


def rolling_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, n, a, b): two hashes of the first k of n turns of each conversation.

    turns(conv_id, turn, role, text). A prefix's hash is the running sum of hashes of
    (place, role, text), so it is one window over the turns in order. Repeats of a whole
    row count once. Nulls are values of their own, but a row without a conv_id is a
    conversation of its own, so that such rows are never gathered.
    """
    known = turns.where("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    again = F.lit(True)
    for c in ("turn", "role", "text"):
        again &= F.col(c).eqNullSafe(F.lag(c).over(order))
    rows = known.withColumn("again", again & (F.row_number().over(order) > 1)).where(~F.col("again"))
    rows = rows.withColumn("k", F.row_number().over(order))
    rows = rows.withColumn("x", _turn_hash(F.col("k"), 1)).withColumn("y", _turn_hash(F.col("k"), 2))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id")
    rolled = rows.select("conv_id", "k", F.count(F.lit(1)).over(whole).cast("int").alias("n"), F.sum("x").over(upto).alias("a"), F.sum("y").over(upto).alias("b"))
    return rolled.unionByName(_alone(turns).select("conv_id", F.lit(1).alias("k"), F.lit(1).alias("n"), "a", "b"))


def _alone(turns: DataFrame) -> DataFrame:
    """The rows without a conv_id with their hashes a and b, in the types of the running sums."""
    return turns.where("conv_id IS NULL").withColumn("a", _turn_hash(F.lit(1), 1).cast("decimal(30,0)")).withColumn("b", _turn_hash(F.lit(1), 2).cast("decimal(30,0)"))


def maximal(rolled: DataFrame) -> DataFrame:
    """(conv_id, n, copies, a, b): conversations that are no proper prefix of another, first of equals."""
    full = rolled.where("k = n").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    prefixes = rolled.where("k < n").select(F.col("k").alias("n"), "a", "b").distinct()
    return full.join(prefixes, ["n", "a", "b"], "left_anti").select("conv_id", "n", "copies", "a", "b")


def rendered(role: Column, text: Column) -> Column:
    """One turn in the template; its marks in a text or role are broken up by a space."""
    safe = lambda c, other: F.replace(F.coalesce(c, F.lit(other)), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), safe(role, "unknown"), F.lit("\n"), safe(text, ""), F.lit(CLOSE), F.lit("\n"))


def format_chats(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, n_copies, rendered for each maximal conversation.

    Turns come in order of (turn, role, text), nulls first. Repeated rows count once. A row
    with a null conv_id is a conversation of one turn, and comes last among equals. A null
    role renders as ``unknown``, a null text as empty. An empty table gives an empty result.
    The turns of one conversation make one row, as the format asks; other columns are not
    read.
    """
    turns = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    with Scratch(conversations.sparkSession) as scratch:
        kept = scratch.table(maximal(scratch.table(rolling_hashes(turns))), keep=True)
    ids = kept.where("conv_id IS NOT NULL").select(F.col("conv_id").alias("id"), "n", "copies")
    rows = turns.join(ids, turns["conv_id"] == ids["id"])
    said = F.array_distinct(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))))
    grouped = rows.groupBy("conv_id").agg(F.first("n").cast("long").alias("n_turns"), F.first("copies").alias("n_copies"), said.alias("said"))
    shown = grouped.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("said", lambda t: rendered(t["role"], t["text"])), "").alias("rendered"))
    # What has no id is found again by its hashes.
    lone = _alone(turns).dropDuplicates(["a", "b"]).join(kept.where("conv_id IS NULL").select("a", "b", "copies"), ["a", "b"])
    return shown.unionByName(lone.select("conv_id", F.lit(1).cast("long").alias("n_turns"), F.col("copies").alias("n_copies"), rendered(F.col("role"), F.col("text")).alias("rendered")))


def op3_chat_snapshots(spark, sf_dir: str) -> DataFrame:
    """The maximal conversations, rendered."""
    return format_chats(read(spark, sf_dir, "conversations"))


OP3_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
s AS (
  SELECT conv_id, role, text,
         row_number() OVER w AS k,
         count(*) OVER (PARTITION BY conv_id) AS n,
         md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)) AS h
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
),
f AS (SELECT min(conv_id) AS conv_id, count(*) AS copies, h, n FROM s WHERE k = n GROUP BY h, n),
m AS (SELECT * FROM f WHERE h NOT IN (SELECT h FROM s WHERE k < n))
SELECT s.conv_id, CAST(max(m.n) AS BIGINT) AS n_turns, CAST(max(m.copies) AS BIGINT) AS n_copies,
       string_agg('{OPEN}' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '{CLOSE}' || chr(10), '' ORDER BY k) AS rendered
FROM s JOIN m ON s.conv_id = m.conv_id GROUP BY s.conv_id
"""
