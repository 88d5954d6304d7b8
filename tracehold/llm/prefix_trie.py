"""A trie of conversation prefixes, summed up over subtrees in bands of depth.

Every conversation is rebuilt on the first turns of its base conversation.  A prefix is
named by sums over its turns of hashes that take in the turn's place, so the names of all
prefixes come from one running sum, cut into chunks of turns; three sums of 40 bits
each stand for the sequence.  A node is known by its smallest conversation and its depth.

Sums over subtrees roll up by bands of ``height`` depths.  A node's value goes to
its ancestors inside its band only, of which there are no more than ``height``.  The tops
of the bands form a trie that is ``height`` times as shallow, whose totals are made in the
same way; then each completed total goes to the ancestors in the band above it.  Depth
400 takes three levels with ``height`` 8, and depth 100,000 six.

Cases: null roles and texts are empty; turns of a conversation go by turn, nulls first, and
those that tie by the hash of role and text; repeated rows are turns of their own; rows
without a conversation id belong to none and are left out; conversations without turns end
at the root; an empty table has no nodes, not even a root; other columns of any name are not
looked at; no text is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracehold.operators.ordered import numbered
from tracehold.operators.skew import join_unique
from tracehold.session import stage

#: Depths of a band, turns of a chunk, ids of a slice that is joined in one row.
HEIGHT, CHUNK, SLICE = 8, 1024, 4096
#: Conversations share a base in hundreds, and a remainder of 6 says how many turns.
SHARED, TURNS = 100, 6
SUMS = ["s0", "s1", "s2"]
PARENT = ["p0", "p1", "p2"]


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % SHARED


def shared_turns(conv_id: Column) -> Column:
    """How many turns of the base a conversation starts with."""
    return (F.crc32(conv_id.cast("string")) % TURNS).cast("int")


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(``c``, ``at``, ``digest``, ``points``): each turn's place from 0, a hash of what it says, its text's code points."""
    said = F.coalesce(F.col(text), F.lit("")).alias("said")
    by = F.coalesce(F.col(role), F.lit("")).alias("by")
    rows = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("turn"), by, said)
    # The role's length tells where the text begins.
    digest = F.md5(F.concat(F.length("by").cast("string"), F.lit(":"), F.col("by"), F.col("said")))
    rows = rows.select("c", "turn", digest.alias("digest"), F.length("said").cast("long").alias("points"))
    placed = numbered(rows, ["c"], [F.asc_nulls_first("turn"), "digest"], "number")
    return placed.select("c", (F.col("number") - 1).alias("at"), "digest", "points")


def rebuilt(turns: DataFrame) -> DataFrame:
    """The turns of the rebuilt conversations, with ``d`` from 1, and for each conversation one row of ``d`` 0."""
    # The first turns of a base are few, whatever its length.
    start = turns.where(F.col("at") < TURNS - 1)
    convs = turns.groupBy("c").agg(F.lit(0).alias("d")).withColumn("base", base_of(F.col("c"))).withColumn("shared", shared_turns(F.col("c")))
    bases = start.where(F.col("c") == base_of(F.col("c"))).groupBy(F.col("c").alias("base")).agg(F.collect_list(F.struct("at", "digest", "points")).alias("turns"))
    heads = convs.join(bases, "base", "left").withColumn("turns", F.expr("filter(coalesce(turns, array()), t -> t.at < shared)"))
    heads = stage(heads.select("c", "shared", F.size("turns").alias("taken"), "turns"), "heads")
    first = heads.select("c", F.inline("turns")).select("c", (F.col("at") + 1).alias("d"), "digest", "points")
    # Salted: a conversation may be very long.
    own = join_unique(turns, heads.select("c", "shared", "taken"), ["c"], F.col("at")).where("at >= shared")
    own = own.select("c", (F.col("at") - F.col("shared") + F.col("taken") + 1).alias("d"), "digest", "points")
    root = heads.select("c", F.lit(0).cast("long").alias("d"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("points"))
    return first.unionByName(own).unionByName(root)


def named(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Each turn with its prefix's sums ``SUMS``, the next shorter one's ``PARENT``, and whether it is the last (``end``)."""
    placed = F.md5(F.concat("digest", F.lit("@"), F.col("d").cast("string")))
    own = [F.when(F.col("d") == 0, 0).otherwise(F.conv(F.substring(placed, 1 + 10 * k, 10), 16, 10).cast("long")).alias(f"v{k}") for k in range(3)]
    rows = turns.select("c", "d", "points", *own, F.floor(F.col("d") / chunk).alias("chunk"))
    rows = stage(rows, "turns")
    totals = rows.groupBy("c", "chunk").agg(*[F.sum(f"v{k}").alias(f"t{k}") for k in range(3)], F.max("d").alias("highest"))
    before = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("c")
    totals = totals.select("c", "chunk", *[F.coalesce(F.sum(f"t{k}").over(before), F.lit(0)).alias(f"b{k}") for k in range(3)], F.max("highest").over(whole).alias("depth"))
    inside = Window.partitionBy("c", "chunk").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", *[F.sum(f"v{k}").over(inside).alias(f"i{k}") for k in range(3)]).join(totals, ["c", "chunk"])
    sums = [(F.col(f"b{k}") + F.col(f"i{k}")).alias(SUMS[k]) for k in range(3)]
    return rows.select("c", "d", "points", *sums, (F.col("d") == F.col("depth")).alias("end"))


def _chains(paths: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """For each node (``nid``, ``d``) its ancestors in its band, itself last; for each band's top those in the band above.

    ``paths`` has a row (``c``, ``d``, ``nid``) for each conversation and depth; a node is
    listed by the conversation that names it.
    """
    band = F.floor(F.col("d") / height)
    top = (F.col("d") % height == 0) & (F.col("d") > 0)
    both = paths.select("c", "d", "nid", F.explode(F.when(top, F.array(band, band - 1)).otherwise(F.array(band))).alias("band"))
    rows = both.groupBy("c", "band").agg(F.array_sort(F.collect_list(F.struct("d", "nid"))).alias("path"))
    # A conversation names the nodes from some depth on, so its last node tells whether it names any.
    rows = rows.where(F.element_at("path", -1)["nid"] == F.col("c"))
    listed = rows.select("c", "band", "path", F.posexplode("path").alias("k", "node")).where(F.col("node.nid") == F.col("c"))
    chain = F.transform(F.slice("path", 1, F.col("k") + 1), lambda p: p["nid"])
    listed = listed.select("c", "band", "k", F.col("node.d").alias("d"), F.col("node.nid").alias("nid"), chain.alias("chain"))
    own = listed.where(F.floor(F.col("d") / height) == F.col("band")).select("nid", "d", "chain")
    above = listed.where(F.floor(F.col("d") / height) > F.col("band")).select("nid", "d", F.expr("slice(chain, 1, size(chain) - 1)").alias("chain"))
    return own, above


def _spread(values: DataFrame, first: Column, columns: list[str]) -> DataFrame:
    """Sums of the values over the nodes of their chains, whose first node is at depth ``first``."""
    out = values.withColumn("first", first).select("first", *columns, F.posexplode("chain").alias("k", "nid"))
    return out.groupBy("nid", (F.col("first") + F.col("k")).alias("d")).agg(*[F.sum(c).alias(c) for c in columns])


def subtree_sums(paths: DataFrame, values: DataFrame, columns: list[str], height: int = HEIGHT) -> DataFrame:
    """(``nid``, ``d``, sums of ``columns``) over each node's subtree, itself included.

    ``paths``: (``c``, ``d``, ``nid``) of all conversations; ``values``: (``nid``, ``d``,
    ``columns``) of all nodes.
    """
    own, above = _chains(paths, height)
    band = F.floor(F.col("d") / height) * height
    inside = _spread(values.join(own, ["nid", "d"]), band, columns)
    deepest = values.agg(F.max("d")).first()[0]
    if deepest is None or deepest < height:
        return inside
    inside, above = stage(inside, "band"), stage(above, "above")
    is_top = F.col("d") % height == 0
    shallow = (F.col("d") / height).cast("long").alias("d")
    tops = stage(paths.where(is_top).select("c", shallow, "nid"), "tops")
    whole = subtree_sums(tops, inside.where(is_top).select("nid", shallow, *columns), columns, height)
    whole = whole.withColumn("d", F.col("d") * height)
    lower = _spread(whole.join(above, ["nid", "d"]), F.col("d") - height, columns)
    return inside.unionByName(lower).groupBy("nid", "d").agg(*[F.sum(c).alias(c) for c in columns])


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nid, d, sha256) of rows that come in order; a node's slices are hashed one after the other."""
    at, state, out = None, None, []

    def made(rows):
        return pa.RecordBatch.from_pydict({"nid": pa.array([r[0] for r in rows], pa.int64()), "d": pa.array([r[1] for r in rows], pa.int64()), "ends_sha256": pa.array([r[2] for r in rows], pa.string())})

    for batch in batches:
        for nid, d, ids in zip(*(batch.column(c).to_pylist() for c in ("nid", "d", "ids"))):
            if (nid, d) != at:
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = (nid, d), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield made(out)
            out = []
    if at is not None:
        yield made([(*at, state.hexdigest())])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(``nid``, ``d``, ``ends_sha256``) of the conversations ``c`` that end at each node.

    Ids are joined in slices of ``SLICE`` numbers, so a list never stands in one row; a
    node's slices are hashed as a stream.
    """
    parts = ends.groupBy("nid", "d", F.floor(F.col("c") / SLICE).alias("slice")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))
    return parts.repartition("nid", "d").sortWithinPartitions("nid", "d", "slice").mapInArrow(_hash_lists, "nid long, d long, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    height: int = HEIGHT,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per node: ``conv_id`` (its smallest), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``saved_tokens`` is, over the subtree, the code points of each node's last text times the
    conversations beyond the first that share it.
    """
    rows = stage(named(rebuilt(turns_of(conversations, conv_id, turn, role, text)), chunk), "prefixes")
    names = rows.groupBy("d", *SUMS).agg(F.min("c").alias("nid"), F.count("*").alias("n_convs"), F.max("points").alias("points"))
    names = stage(names, "nodes")
    # All conversations share the root, and many their first turns.
    paths = join_unique(rows, names.select("d", *SUMS, "nid"), ["d", *SUMS], F.col("c")).select("c", "d", "nid", "end")
    paths = stage(paths, "paths")
    # The conversation that names a node runs through its parent.
    step = paths.select("c", (F.col("d") + 1).alias("d"), F.col("nid").alias("parent"))
    nodes = names.select("nid", "d", "n_convs", "points").join(step.withColumnRenamed("c", "nid"), ["nid", "d"], "left")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("nid"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["nid", "d"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = stage(nodes, "tree")
    values = nodes.select("nid", "d", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved_tokens"))
    sums = subtree_sums(paths.select("c", "d", "nid"), values, ["n_leaves", "saved_tokens"], height)
    ends = end_hashes(paths.where("end").select("nid", "d", "c"))
    out = nodes.join(sums, ["nid", "d"]).join(ends, ["nid", "d"], "left")
    nothing = F.sha2(F.lit(""), 256)
    return out.select(
        F.col("nid").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    )
