"""The trie of conversation prefixes by van Emde Boas recursion over depth, all cuts of one size at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.session import staged

from .turns import digest, joined_digests, numbered, turn_key

#: Ids of one end that are joined to one text before the digest streams over them.
END_IDS = 4096


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, pos, n, sym, bytes): the turns of each conversation in order; equal neighbours of one turn number are one row with a count.

    Only digests and lengths of the texts go on. Ties of one turn number are ordered by digest.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    light = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), turn_key(role, text).alias("sym"), F.octet_length(text).cast("long").alias("bytes"))
    same = light.groupBy("conv", "turn", "sym").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"))
    return numbered(same, "conv", ["turn", "sym"], "n", "pos").drop("turn")


def shared_heads(turns: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """(conv, pos, sym, bytes): every conversation c begins with the first crc32(c) mod ``heads`` turns of conversation c - c % ``group``.

    Its own turns follow, without the first as many. One more row a conversation, without ``sym``, marks its end.
    """
    at = staged(numbered_turns(turns), "turns")
    size = staged(at.groupBy("conv").agg(F.sum("n").alias("size")), "sizes")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h")
    plan = size.select("conv", (F.col("conv") - F.col("conv") % group).alias("base"), h, "size")
    plan = plan.join(size.select(F.col("conv").alias("base"), F.col("size").alias("base_size")), "base", "left")
    taken, left = F.least("h", F.coalesce("base_size", F.lit(0))), F.greatest(F.col("size") - F.col("h"), F.lit(0))
    plan = staged(plan.select("conv", "base", "h", taken.alias("taken"), (F.col("size") - left).alias("skip"), (taken + left).alias("length")), "plans")
    each = lambda lo, hi: F.explode(F.sequence(lo, hi - 1)).alias("pos")
    head = at.where(F.col("pos") < heads - 1).join(plan.where("taken > 0").select(F.col("conv").alias("to"), F.col("base").alias("conv"), "taken"), "conv")
    head = head.where("pos < taken").select(F.col("to").alias("conv"), "sym", "bytes", each(F.col("pos"), F.least(F.col("pos") + F.col("n"), "taken")))
    own = at.join(plan.select("conv", "h", "taken"), "conv").where("pos + n > h")
    shift = F.col("taken") - F.col("h")
    own = own.select("conv", "sym", "bytes", each(F.greatest("pos", "h") + shift, F.col("pos") + F.col("n") + shift))
    end = plan.select("conv", F.lit(None).cast("binary").alias("sym"), F.lit(None).cast("long").alias("bytes"), F.col("length").alias("pos"))
    return head.unionByName(own).unionByName(end).select("conv", "pos", "sym", "bytes")


def prefix_names(rows: DataFrame) -> DataFrame:
    """(conv, pos, name): the name of the first ``pos`` turns, for every row of ``rows`` (conv, pos, sym; an end row at pos = length).

    Depths are cut in halves: a stretch of 2**(j+1) depths into two of 2**j. The prefix at the cut is named by the name of the
    prefix where the stretch begins and that of the turns of its upper half; all stretches of one size are
    cut in one step. Names of stretches come from those of their halves, from single turns on.
    """
    deepest = rows.agg(F.max("pos")).first()[0]
    levels = (deepest or 0).bit_length()
    parts = [rows.where("sym IS NOT NULL").select("conv", F.col("pos").alias("i"), F.col("sym").alias("part"))]
    for _ in range(1, levels):
        i, odd = F.col("i"), F.col("i") % 2 == 1
        two = parts[-1].groupBy("conv", F.shiftright(i, 1).alias("i")).agg(F.max(F.when(~odd, F.col("part"))).alias("a"), F.max(F.when(odd, F.col("part"))).alias("b"))
        parts.append(staged(two.where("a IS NOT NULL AND b IS NOT NULL").select("conv", "i", digest(F.concat("a", "b")).alias("part")), "stretches"))
    at = rows.where("sym IS NULL").select("conv", F.lit(0).cast("long").alias("i"), digest(F.lit("root").cast("binary")).alias("name"))
    for part in reversed(parts if levels else []):
        upper = part.where("i % 2 = 0").select("conv", F.shiftright("i", 1).alias("i"), "part")
        cut = F.when(F.col("part").isNotNull(), digest(F.concat("name", "part")))  # the upper half is full: something lies beyond it
        halves = F.array(F.struct((F.col("i") * 2).alias("i"), F.col("name")), F.struct((F.col("i") * 2 + 1).alias("i"), cut.alias("name")))
        at = at.join(upper, ["conv", "i"], "left").select("conv", F.inline(F.filter(halves, lambda x: x["name"].isNotNull())))
    return at.withColumnRenamed("i", "pos")


def graft(nodes: DataFrame, paths: DataFrame, sums: list[str]) -> DataFrame:
    """``nodes`` (name, depth, conv: a member) with ``sums`` added up over each node's subtree; ``paths`` (conv, pos, name) of those members.

    Step j knows the sums within stretches of 2**j depths and grafts each lower half's tries on the nodes above them in its upper
    half, so that after the last step a stretch is the whole depth. No step depends on another of its size.
    """
    total, deepest = nodes, nodes.agg(F.max("depth")).first()[0]
    for j in range((deepest or 0).bit_length()):
        root = F.col("depth") % (2 << j) == 1 << j
        low = total.where(root).select("conv", F.shiftright("depth", j + 1).alias("seg"), *sums)
        up = paths.where(F.shiftright("pos", j) % 2 == 0).select("conv", F.shiftright("pos", j + 1).alias("seg"), "name")
        more = up.join(low, ["conv", "seg"]).groupBy("name").agg(*[F.sum(s).alias(s) for s in sums])
        both = total.unionByName(more, allowMissingColumns=True).groupBy("name")
        total = staged(both.agg(F.max("depth").alias("depth"), F.max("conv").alias("conv"), *[F.sum(s).alias(s) for s in sums]), "grafted")
    return total


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row for every node of the trie of the sequences in ``rows`` (conv, pos, sym, bytes; an end row without sym at pos = length).

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, (n_convs - 1) times the bytes of the last turn), ends_sha256 (of the
    members that end here, ascending, comma-joined). A sequence without turns belongs to the root; without sequences there are no nodes.
    A node of one member has that member's turns below it and nothing to save, so only shared nodes are grafted.
    """
    rows = staged(rows, "sequences")
    names = prefix_names(rows)
    last = rows.where("sym IS NOT NULL").select("conv", (F.col("pos") + 1).alias("pos"), "bytes")
    named = staged(names.join(last, ["conv", "pos"], "left"), "named")
    nodes = named.groupBy("pos", "name").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv"), F.max("bytes").alias("bytes"))
    above = named.select("conv", (F.col("pos") + 1).alias("pos"), F.col("name").alias("parent"))
    nodes = staged(nodes.join(above, ["conv", "pos"], "left").withColumnRenamed("pos", "depth"), "nodes")
    below = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("alone"))
    nodes = staged(nodes.join(below, "name", "left").fillna(0, ["n_children", "alone"]), "nodes")
    many = nodes.where("n_convs > 1")
    leaves = (F.col("alone") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves")
    saved = ((F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))).alias("saved")
    paths = named.join(many.groupBy("conv").agg(F.max("depth").alias("deepest")), "conv").where("pos <= deepest").select("conv", "pos", "name")
    grafted = graft(many.select("name", "depth", "conv", saved, leaves), staged(paths, "paths"), ["saved", "leaves"]).select("name", "saved", "leaves")
    ends = rows.where("sym IS NULL").select("conv", "pos").join(named, ["conv", "pos"]).select("name", "conv")
    block = F.floor(F.col("conv") / END_IDS).alias("block")
    ends = ends.groupBy("name", block).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    ends = joined_digests(ends, "name", "block", "ids", ",")
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"))
    out = nodes.join(grafted, "name", "left").join(ends, "name", "left").join(parents, "parent", "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
                      F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.coalesce("sha256", nothing).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """``prefix_trie`` of the conversations (conv_id, turn, role, text) with shared heads (see ``shared_heads``).

    Null roles and texts are empty; turns without a number come first; rows of one turn number are ordered by a digest of
    role and text; repeated rows are turns of their own; a null conv_id takes no part; other columns are ignored.
    """
    return prefix_trie(shared_heads(turns, group, heads))
