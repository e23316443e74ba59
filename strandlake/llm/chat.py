"""Multi-party chat formatting by perspective rotation, in DataFrame functions only.

Every participant of a conversation becomes the assistant of a rendering of its own: their turns are assistant
turns and count for training, all others are user turns that carry the speaker's name. Renderings are tables of
turns with their place in the whole, so a conversation of any length is never gathered in one row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, CLOSE, ASSISTANT, USER, NAME, SYSTEM = "<|start|>", "<|end|>\n", "assistant", "user", " name=", "system"
#: Turns of a conversation that one group ranks; places are carried from block to block.
BLOCK = 512


def segment(role: Column, perspective: Column, text: Column) -> tuple[Column, Column]:
    """Head of a turn as seen by perspective, and its body with the closing mark."""
    head = F.when(role == perspective, F.lit(f"{OPEN}{ASSISTANT}\n")).otherwise(F.concat(F.lit(f"{OPEN}{USER}{NAME}"), role, F.lit("\n")))
    head = F.when(role == SYSTEM, F.lit(f"{OPEN}{SYSTEM}\n")).otherwise(head)
    return head, F.concat(text, F.lit(CLOSE))


def escaped(text: Column) -> Column:
    """Text without anything that reads as a mark: a backslash goes between < and | wherever they meet."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, seq, start, body_start, end, mask, segment: a row for each turn and perspective.

    conversations has conv_id long, turn long, role and text string. Concatenated by seq, the segments of a
    conversation and perspective are the rendering; start and end are its code points, end exclusive, and the mask
    counts for body_start to end (the assistant's words and the closing mark) where mask is true.
    Participants are the distinct roles of a conversation but for "system", whose turns stand as system turns in every
    rendering and never count; a conversation of such turns alone has no rendering. Marks in texts and roles are escaped,
    and so are line feeds in roles, so neither can pass for a turn. Turns go by turn number, then role, then text; repeated
    rows stay and keep any order. A null role is the participant "unknown", a null text is empty, a null turn comes
    first; rows with a null conv_id are left out. Other columns are ignored; an empty table gives an empty one.
    """
    clean = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        # backslashes first, so that no two roles become one
        F.replace(escaped(F.replace(F.coalesce(F.col("role").cast("string"), F.lit("unknown")), F.lit("\\"), F.lit("\\\\"))), F.lit("\n"), F.lit("\\n")).alias("role"),
        escaped(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    )
    # places in a long conversation: rows are ranked in blocks of turn numbers, block sums carry on
    blocked = clean.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    people = clean.where(F.col("role") != SYSTEM).groupBy("conv_id", "role").agg(F.count("*").alias("turns")).select("conv_id", F.col("role").alias("perspective"))
    name = F.when(F.col("role") == SYSTEM, len(SYSTEM) - len(USER + NAME)).otherwise(F.length("role"))
    sizes = blocked.groupBy("conv_id", "block", "role").agg(
        F.count("*").alias("turns"), F.sum(F.length("text").cast("long")).alias("chars"), F.max(name).alias("name")
    )
    own = len(f"{OPEN}{ASSISTANT}\n") + len(CLOSE)
    other = len(f"{OPEN}{USER}{NAME}\n") + len(CLOSE)
    # of a block: turns and code points if all are users' turns; of a perspective's own turns, the difference
    totals = sizes.groupBy("conv_id", "block").agg(
        F.sum("turns").alias("turns"), F.sum(F.expr(f"chars + turns * (name + {other})")).alias("chars")
    )
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "conv_id", "block", F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("seq0"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("at0")
    )
    saved = sizes.select("conv_id", "block", F.col("role").alias("perspective"), F.expr(f"turns * (name + {other - own})").alias("saved"))
    # every perspective in every block of its conversation, with what it saved in earlier blocks
    views = people.join(carried, "conv_id").join(saved, ["conv_id", "block", "perspective"], "left")
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    views = views.withColumn("saved0", F.coalesce(F.sum("saved").over(before), F.lit(0))).drop("saved")
    inside = Window.partitionBy("conv_id", "block", "perspective").orderBy("turn", "role", "text")
    rows = blocked.join(views, ["conv_id", "block"])
    head, body = segment(F.col("role"), F.col("perspective"), F.col("text"))
    rows = rows.withColumn("head", head).withColumn("size", (F.length("head") + F.length(body)).cast("long"))
    rows = rows.withColumn("seq", F.col("seq0") + F.row_number().over(inside) - 1)
    end = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("at0") - F.col("saved0")
    rows = rows.withColumn("end", end)
    return rows.select(
        "conv_id", "perspective", "turn", "seq", (F.col("end") - F.col("size")).alias("start"),
        (F.col("end") - F.col("size") + F.length("head")).alias("body_start"), "end",
        (F.col("role") == F.col("perspective")).alias("mask"), F.concat("head", body).alias("segment"),
    )


#: DuckDB's rendering of the same rows.
SQL = f"""
with t as (
  select conv_id, turn, replace(replace(replace(coalesce(role, 'unknown'), chr(92), repeat(chr(92), 2)), '<|', '<\\|'), chr(10), '\\n') role,
    replace(coalesce(text, ''), '<|', '<\\|') text from conversations where conv_id is not null),
p as (select distinct conv_id, role perspective from t where role <> '{SYSTEM}'),
r as (
  select t.*, perspective,
    case when role = '{SYSTEM}' then '{OPEN}{SYSTEM}' || chr(10) when role = perspective then '{OPEN}{ASSISTANT}' || chr(10) else '{OPEN}{USER}{NAME}' || role || chr(10) end head,
    text || '{CLOSE.strip()}' || chr(10) body
  from t join p using (conv_id)),
s as (
  select *, length(head) + length(body) size,
    row_number() over w - 1 seq, sum(length(head) + length(body)) over (w rows unbounded preceding) ends
  from r window w as (partition by conv_id, perspective order by turn nulls first, role, text))
select conv_id, perspective, turn, cast(seq as bigint) seq, cast(ends - size as bigint) as start,
  cast(ends - size + length(head) as bigint) body_start, cast(ends as bigint) as "end",
  role = perspective as mask, head || body as segment
from s
"""
