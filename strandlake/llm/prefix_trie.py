"""The trie of prefixes that conversations share, from the longest common prefixes of neighbours in sorted order.

Conversations are sequences of turns. Equal sequences are one, and distinct ones are ranked: blocks of WIDTH turns are
ranked first, then blocks of WIDTH such ranks, so a sequence of any length is never gathered. The array of common
prefixes with the sequence before, `lcp`, has a Cartesian tree whose nodes of equal value are merged: the node of place
j spans from the nearest smaller value before j to the one after. All nearest smaller values are found in blocks in
parallel; what a block does not hold is looked up in the minima of blocks, which are an array of the same kind. A node
of the tree is a branching point of the trie and stands, with the childless ends of sequences, for the chain of depths
up to its parent's. Members, leaves and tokens of the intervals are differences of running sums over sorted sequences
and over nodes in preorder; least members are range minima, again over blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..intervals import first_below, least_between
from ..ordering import numbered, running_sums
from .common import column, staged

#: Turns, or ranks, in a block of a sequence; depths and members that are made at a time.
WIDTH, DEPTHS, MEMBERS = 16, 1 << 14, 512

NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)

# ---------------------------------------------------------------- turns


def _code(role: Column, text: Column) -> Column:
    """16 bytes that tell turns apart."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16)


def _words(text: Column) -> Column:
    return F.length(F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), " \t\n\x0b\x0c\r", "")).cast("long")


def conversation_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth from 1, code, words) of all turns in order, and (conv_id, n) of all conversations.

    conversations: conv_id, turn, role and text. Turns are in the order of `turn`, those without one first; equal ones in
    that of a hash of role and text. Rows without a conv_id belong to no conversation. A missing role or text is empty.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    source = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", _code(role, text).alias("code"), _words(text).alias("words")
    )
    # the place in the whole table, so that no conversation is sorted in one task
    placed = numbered(source, ["conv_id", "turn"], "place", then=("code",))
    convs = staged(placed.groupBy("conv_id").agg(F.min("place").alias("first"), F.count("*").alias("n")), "conversations")
    turns = placed.join(convs, "conv_id").select("conv_id", (F.col("place") - F.col("first") + 1).alias("depth"), "code", "words")
    return turns, convs.select("conv_id", "n")


def with_shared_openings(turns: DataFrame, convs: DataFrame, group: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """turns and convs in which conversation c begins with the first h turns of conversation c - c % group, then goes on
    with its own turns after its first h. h is the crc32 of the decimal c modulo most + 1."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1))
    asked = convs.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    lent = F.least("h", F.coalesce("there", F.lit(0).cast("long")))
    asked = staged(asked.join(sizes, "base", "left").select("conv_id", "base", "n", "h", lent.alias("lent")), "openings")
    own = turns.join(asked.select("conv_id", "h", "lent"), "conv_id").where(F.col("depth") > F.col("h"))
    own = own.select("conv_id", (F.col("depth") - F.col("h") + F.col("lent")).alias("depth"), "code", "words")
    heads = turns.where(F.col("depth") <= most).withColumnRenamed("conv_id", "base")  # at most `most` rows a base, `group` conversations
    opened = asked.where("lent > 0").join(heads, "base").where(F.col("depth") <= F.col("lent")).select("conv_id", "depth", "code", "words")
    return own.unionByName(opened), asked.select("conv_id", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


# ---------------------------------------------------------------- ranks and common prefixes


def _blocks(rows: DataFrame, place: Column, value: str) -> DataFrame:
    """(conv_id, block, items): the values of each WIDTH places."""
    row = F.array_sort(F.collect_list(F.struct("at", "value")))
    cut = rows.select("conv_id", place.alias("at"), F.col(value).alias("value"))
    return cut.groupBy("conv_id", F.floor(F.col("at") / WIDTH).alias("block")).agg(F.transform(row, lambda r: r["value"]).alias("items"))


def _ranked(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(conv_id, rank) of conversations among distinct sequences, shorter first of a common prefix; and, from single
    turns up, the tables (rank, items) of distinct blocks."""
    longest = convs.agg(F.max("n")).first()[0] or 0
    none = convs.where("n = 0").select("conv_id", F.lit(0).cast("long").alias("block"), F.expr("cast(array() as array<binary>)").alias("items"))
    blocks, tables, span = _blocks(turns, F.col("depth") - 1, "code").unionByName(none), [], WIDTH
    while True:
        blocks = staged(blocks, "blocks")
        tables.append(numbered(blocks.select("items").distinct(), "items", "rank"))
        at = blocks.join(tables[-1], "items").select("conv_id", "block", "rank")
        if span >= longest:
            return at.select("conv_id", "rank"), tables
        blocks, span = _blocks(at, F.col("block"), "rank"), span * WIDTH


def _common_prefixes(tables: list[DataFrame]) -> DataFrame:
    """(rank, lcp): turns that each sequence but the first shares with the one before."""
    top = tables[-1]
    open_ = top.join(top.select((F.col("rank") + 1).alias("rank"), F.col("items").alias("before")), "rank")
    open_ = open_.select("rank", F.lit(0).cast("long").alias("lcp"), F.col("before").alias("a"), F.col("items").alias("b"))
    done = []
    for level in reversed(range(len(tables))):
        # neighbours differ, so some place does; the shorter one's end counts
        place = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), False) - 1
        rows = open_.select("rank", (F.col("lcp") + place * WIDTH**level).alias("lcp"), F.get("a", place.cast("int")).alias("x"), F.get("b", place.cast("int")).alias("y"))
        if not level:
            done.append(rows.select("rank", "lcp"))
            break
        rows = staged(rows, "prefixes")
        both = F.col("x").isNotNull() & F.col("y").isNotNull()
        done.append(rows.where(~both).select("rank", "lcp"))
        below = tables[level - 1]
        left, right = (below.select(F.col("rank").alias(k), F.col("items").alias(n)) for k, n in (("x", "a"), ("y", "b")))
        open_ = rows.where(both).join(left, "x").join(right, "y").select("rank", "lcp", "a", "b")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


# ---------------------------------------------------------------- members


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a rank come one after another; the hash of each rank's texts, joined by commas."""
    now, state = None, None
    for batch in batches:
        ranks, out = [], []
        for rank, text in zip(column(batch, "rank").to_pylist(), column(batch, "text").to_pylist()):
            if rank != now:
                if state:
                    ranks.append(now)
                    out.append(state.hexdigest())
                now, state = rank, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64()), pa.array(out, pa.string())], names=["rank", "ends_sha256"])
    last = [[now], [state.hexdigest()]] if state else [[], []]
    yield pa.RecordBatch.from_arrays([pa.array(last[0], pa.int64()), pa.array(last[1], pa.string())], names=["rank", "ends_sha256"])


def _ends(members: DataFrame) -> DataFrame:
    """(rank, ends_sha256): the SHA-256 of each rank's conv_ids, ascending and joined by commas.

    Ids are written out MEMBERS at a time in parallel; one pass over these texts, which is sequential by definition,
    holds a batch of them at a time, so a third of all conversations may be equal.
    """
    placed = numbered(members, ["rank"], "place", then=("conv_id",))
    row = F.array_sort(F.collect_list(F.struct("place", "conv_id")))
    text = F.array_join(F.transform(row, lambda r: r["conv_id"].cast("string")), ",")
    parts = placed.groupBy("rank", F.floor(F.col("place") / MEMBERS).alias("part")).agg(text.alias("text"))
    return parts.repartition("rank").sortWithinPartitions("rank", "part").select("rank", "text").mapInArrow(_hashed, "rank long, ends_sha256 string")


# ---------------------------------------------------------------- the trie


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first d turns, from the root (d = 0) on: conv_id, its least member; depth d;
    parent_conv_id, that of its parent (none of the root); n_convs, n_children; n_leaves, nodes without children under
    it or itself; saved_tokens, the sum over nodes under it and itself of (n_convs - 1) times the words of the last turn;
    and ends_sha256, the hash of the ascending, comma-joined conv_ids of members that end there.

    turns: conv_id, depth from 1 without gaps, code, words. convs: conv_id (once each), n (turns; may be 0). Without
    conversations there is no node.
    """
    spark = convs.sparkSession
    turns, convs = staged(turns, "turns"), staged(convs, "convs")
    members, tables = _ranked(turns, convs)
    members = staged(members, "members")
    sized = members.join(convs, "conv_id").groupBy("rank").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("least"), F.max("n").alias("len"))
    low = F.lit(-1).cast("long")
    sequences = staged(sized.join(_common_prefixes(tables), "rank", "left").withColumn("lcp", F.coalesce("lcp", low)), "sequences")
    size = sequences.count()
    if not size:
        return spark.createDataFrame([], NODES)

    # running sums over sequences, with a place after the last
    ahead = sequences.select((F.col("rank") - 1).alias("rank"), F.col("lcp").alias("lcp_next"))
    marks = sequences.join(ahead, "rank", "left").withColumn("lcp_next", F.coalesce("lcp_next", low))
    after = spark.range(size, size + 1).select(
        F.col("id").alias("rank"), *(F.lit(0).cast("long").alias(c) for c in ("n_convs", "least", "len")), low.alias("lcp"), F.lit(0).cast("long").alias("lcp_next")
    )
    leaf = F.when((F.col("len") > F.col("lcp_next")) & (F.col("rank") < size), 1).otherwise(0)
    sums = {"convs_before": F.col("n_convs"), "leaves_before": leaf, "nodes_before": F.col("len") - F.col("lcp")}
    marks = staged(running_sums(marks.unionByName(after), "rank", sums), "marks")

    # nearest smaller values on both sides of each place with a neighbour before it
    array = marks.select(F.col("rank").alias("index"), F.col("lcp").alias("value"))
    mirror = array.select((size - F.col("index")).alias("index"), "value")
    inner = array.where((F.col("index") > 0) & (F.col("index") < size))
    right = first_below(array, inner.select((F.col("index") + 1).alias("start"), F.col("value").alias("below")), size + 1)
    left = first_below(mirror, inner.select((size - F.col("index") + 1).alias("start"), F.col("value").alias("below")), size + 1)
    right = right.select((F.col("start") - 1).alias("place"), F.col("below").alias("depth"), F.col("found").alias("next"))
    left = left.select((size - F.col("start") + 1).alias("place"), (size - F.col("found")).alias("first"))
    spans = staged(left.join(right, "place"), "spans")

    # branching nodes: places of equal span are one; ends of sequences that no other goes on from
    branching = spans.groupBy("first", "next").agg(F.max("depth").alias("depth"), F.count("*").alias("cuts"))
    asked = branching.select("first", (F.col("next") - 1).alias("last"))
    least = least_between(sequences.select(F.col("rank").alias("index"), F.col("least").alias("value")), asked, size)
    branching = staged(branching.join(least.select("first", (F.col("last") + 1).alias("next"), "least"), ["first", "next"]), "branching")
    above = F.greatest("lcp", "lcp_next")
    tips = marks.where((F.col("len") > above) & (F.col("rank") < size)).select(
        F.col("rank").alias("first"), (F.col("rank") + 1).alias("next"), F.col("len").alias("depth"), F.lit(0).cast("long").alias("cuts"), "least"
    )
    begin = marks.select(F.col("rank").alias("first"), "len", F.col("lcp").alias("lcp_first"), "convs_before", "leaves_before", "nodes_before", F.col("least").alias("shown"))
    end = marks.select(
        F.col("rank").alias("next"), F.col("lcp").alias("lcp_after"), F.col("convs_before").alias("convs_upto"),
        F.col("leaves_before").alias("leaves_upto"), F.col("nodes_before").alias("nodes_upto"),
    )
    chains = branching.unionByName(tips).join(begin, "first").join(end, "next")
    chains = chains.withColumn("above", F.greatest("lcp_first", "lcp_after"))
    chains = chains.withColumn("parent_place", F.when(F.col("lcp_first") >= F.col("lcp_after"), F.col("first")).otherwise(F.col("next")))
    # a place's span gives its node; only the topmost chain of a place refers to it
    parents = spans.join(branching.select("first", "next", F.col("least").alias("parent_least")), ["first", "next"])
    chains = chains.join(parents.select(F.col("place").alias("parent_place"), "parent_least"), "parent_place", "left")

    # each chain's depths, dealt out before they are made
    steps = chains.withColumn("from", F.explode(F.sequence(F.col("above") + 1, F.col("depth"), F.lit(DEPTHS).cast("long")))).repartition("first", "from")
    steps = steps.withColumn("d", F.explode(F.sequence("from", F.least(F.col("from") + DEPTHS - 1, F.col("depth")))))
    inside, last = F.col("d") > F.col("above") + 1, F.col("d") == F.col("depth")
    branches = F.when(~last, 1).when(F.col("cuts") > 0, F.col("cuts") + F.when(F.col("len") > F.col("depth"), 1).otherwise(0)).otherwise(0)
    nodes = steps.select(
        F.col("least").alias("conv_id"), F.col("d").alias("depth"), F.when(inside, F.col("least")).otherwise(F.col("parent_least")).alias("parent_conv_id"),
        (F.col("convs_upto") - F.col("convs_before")).alias("n_convs"), branches.cast("long").alias("n_children"),
        (F.col("leaves_upto") - F.col("leaves_before")).alias("n_leaves"), (F.col("nodes_before") + F.col("d") - F.col("lcp_first") - 1).alias("at"),
        F.col("nodes_upto").alias("until"), "shown", F.when(F.col("d") == F.col("len"), F.col("first")).alias("rank"),
    )

    # words of a node's last turn, from the first sequence under it; tokens saved by running sums in preorder
    shown = turns.select(F.col("conv_id").alias("shown"), "depth", "words")
    nodes = staged(nodes.join(shown, ["shown", "depth"], "left").withColumn("own", (F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))).drop("shown", "words"), "nodes")
    total = nodes.count()
    close = spark.range(total, total + 1).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("own"))
    saved = staged(running_sums(nodes.select("at", "own").unionByName(close), "at", {"sum": F.col("own")}).select("at", "sum"), "saved")
    nodes = nodes.join(saved, "at").join(saved.select(F.col("at").alias("until"), F.col("sum").alias("sum_until")), "until")
    nodes = nodes.withColumn("saved_tokens", F.col("sum_until") - F.col("sum"))
    ending = nodes.where("rank is not null").join(_ends(members), "rank")
    others = nodes.where("rank is null").withColumn("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    names = [part.split()[0] for part in NODES.split(", ")]
    return ending.select(*names).unionByName(others.select(*names))


#: The twin for DuckDB. crc32 goes bit by bit over a list that holds each character and seven zeros after it.
SQL = r"""
with t as (
  select conv_id, coalesce(role, '') r, coalesce(text, '') t, row_number() over (partition by conv_id order by turn nulls first,
    substr(sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 1, 32)) nth
  from conversations where conv_id is not null),
c as (select conv_id, count(*) n, conv_id - conv_id % 20 base, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(
    range(1, length(conv_id::varchar) + 1), lambda i: [ascii(substr(conv_id::varchar, i, 1)), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, e: xor(xor(a, e) >> 1, (xor(a, e) & 1) * 3988292384)), 4294967295::bigint) % 4 h from t group by 1),
o as (select c.conv_id, c.h, c.base, c.n, least(c.h, coalesce(b.n, 0)) lent from c left join c b on b.conv_id = c.base),
turns as (
  select o.conv_id, nth depth, r, t from o join t on t.conv_id = o.base where nth <= lent
  union all select o.conv_id, nth - h + lent, r, t from o join t using (conv_id) where nth > h),
p as (
  select conv_id, depth, md5(string_agg(md5(concat(length(r), ':', r, t)), '') over (partition by conv_id order by depth)) sig,
    len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) words from turns
  union all select conv_id, 0, '', 0 from o),
nodes as (select depth, sig, min(conv_id) conv_id, count(*) n_convs, max(words) words from p group by 1, 2),
up as (select n.*, q.sig above from nodes n left join p q on q.conv_id = n.conv_id and q.depth = n.depth - 1),
kids as (select depth - 1 depth, above sig, count(*) n from up where depth > 0 group by 1, 2),
below as (select a.depth, a.sig, sum((n.n_convs - 1) * n.words) saved, count(*) filter (k.n is null) leaves
  from nodes n left join kids k using (depth, sig) join p a on a.conv_id = n.conv_id and a.depth <= n.depth group by 1, 2),
ends as (select depth, sig, string_agg(conv_id::varchar, ',' order by conv_id) ids
  from p join o using (conv_id) where depth = lent + greatest(n - h, 0) group by 1, 2)
select u.conv_id, u.depth, m.conv_id parent_conv_id, u.n_convs, coalesce(k.n, 0)::bigint n_children, b.leaves::bigint n_leaves,
  b.saved::bigint saved_tokens, sha256(coalesce(e.ids, '')) ends_sha256
from up u join below b using (depth, sig) left join kids k using (depth, sig) left join ends e using (depth, sig)
left join nodes m on m.depth = u.depth - 1 and m.sig = u.above
"""
