"""Operator 12, conversation prefix trie by parallel tree contraction.

**Naming.** A turn leaves the scan as two 64-bit hashes of (role, text) and a
length; no text is shuffled.  The name of a prefix is the XOR of its turns'
hashes, each mixed with its position, so names of all prefixes are running
totals (``operators.running``) and a parent's name is its child's without the last turn.
A conversation of any length is spread over many tasks.

**Contraction.** The subtree totals of all nodes come from rounds on the live
tree.  *Compress*: unary chains are found and pointer doubling gives every
chain node the chain's end and the sum of what lies before it; all of them
leave, and the end hangs on the chain's parent by an edge that carries that
sum.  *Rake*: leaves are done; they give total and edge to their parents and
leave.  After a round every inner node had two children or more, so rounds are
at most log2(leaves) and joins in a round log2(longest chain).  *Re-expansion*
goes through the rounds backwards: a chain node's total is its sum plus the
total of the node its chain ended in.

Parents with very many children only meet aggregates (map-side combined).  The
ids of one node's ends are sorted over ranges, joined in stretches and streamed
through SHA-256, which has no parallel form, in constant memory.

Nulls: a null turn number comes first, a null role or text is empty, rows
without a conv_id belong to no conversation and are left out.  Turns of equal
number are ordered by their hashes, so repeated rows are turns of their own.
An empty table gives an empty result (not even a root).  Names are exact up to
collisions of 128-bit names.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoseries.operators.running import ranged, running
from geoseries.llm.textkit import map_arrow
from geoseries.session import cut_lineage, drop_staged

NAME = ["depth", "x1", "x2"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx from 0, a, b, chars) of every turn, in order, written once."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit("b"), text, F.lit(":"), role).alias("b"), F.length(text).cast("long").alias("chars")).withColumn("row_no", F.monotonically_increasing_id())
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b"), F.col("row_no")]
    # row numbers only part equal turns, which cannot be told from each other
    numbered = running(ranged(cut_lineage(rows, "turn_rows"), [F.col("conv_id"), *order], "turns").withColumn("one", F.lit(1)), ["conv_id"], order, {"upto": ("one", "sum")})
    return cut_lineage(numbered.select("range_no", "conv_id", (F.col("upto") - 1).alias("idx"), "a", "b", "chars"), "numbered")


def heads(conv_id: Column, most: int) -> Column:
    """How many turns conversation ``conv_id`` takes over: crc32 of its decimal, modulo ``most``."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(most))


def _salted(pos: Column) -> list[Column]:
    return [F.xxhash64(pos, F.col("a"), F.col("b")).alias("s1"), F.xxhash64(F.lit("b"), F.col("b"), pos, F.col("a")).alias("s2")]


def steps(conversations: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(convs, steps).  ``convs``: every conversation with its number of rebuilt
    turns.  ``steps``: every rebuilt turn with the names of the prefix it ends
    and of the prefix before it."""
    every = turns(conversations)
    own = every.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": heads(F.col("conv_id"), most), "base": F.col("conv_id") - F.col("conv_id") % group})
    # the first turns of conversation c - c % group, for the at most 2 * group conversations that share it
    firsts = every.filter((F.col("idx") < most - 1) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), F.col("idx").alias("pos"), "a", "b", "chars")
    taken = cut_lineage(own.select("conv_id", "h", "base").join(firsts, "base").filter("pos < h").select("conv_id", "pos", "chars", *_salted(F.col("pos"))), "heads")
    head = taken.groupBy("conv_id").agg(F.count("*").alias("m"), F.bit_xor("s1").alias("h1"), F.bit_xor("s2").alias("h2"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("m", "h1", "h2")}
    convs = cut_lineage(own.join(head, "conv_id", "left").withColumns(zero)
                        .select("conv_id", "h", "m", "h1", "h2", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    rest = (every.join(convs.select("conv_id", "h", "m"), "conv_id").filter("idx >= h")
            .withColumn("pos", F.col("m") + F.col("idx") - F.col("h")).select("range_no", "conv_id", "pos", "chars", *_salted(F.col("pos"))))
    rest = cut_lineage(rest, "rest")
    xors = {"x1": ("s1", "xor"), "x2": ("s2", "xor")}
    after = running(rest, ["conv_id"], [F.col("pos")], xors).join(convs.select("conv_id", "h1", "h2"), "conv_id")
    after = after.withColumns({f"x{i}": F.col(f"x{i}").bitwiseXOR(F.col(f"h{i}")) for i in (1, 2)})
    few = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # at most most - 1 rows
    ahead = taken.withColumns({f"x{i}": F.bit_xor(f"s{i}").over(few) for i in (1, 2)})
    columns = ["conv_id", (F.col("pos") + 1).alias("depth"), "x1", "x2", F.col("x1").bitwiseXOR(F.col("s1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("s2")).alias("p2"), "chars"]
    return convs, cut_lineage(after.select(*columns).unionByName(ahead.select(*columns)), "steps")


def trie(convs: DataFrame, walked: DataFrame) -> DataFrame:
    """One row a node: node, parent (null: root), its name, conv_id, parent_conv_id, n_convs, n_children, chars; written once."""
    by_name = walked.groupBy(*NAME).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("chars").alias("chars"))
    zero = F.lit(0).cast("long")
    root = convs.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id", "n_convs", F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("chars"))
    named = cut_lineage(by_name.unionByName(root).withColumn("node", F.monotonically_increasing_id()), "named")
    up = named.select(F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    linked = cut_lineage(named.join(up, ["depth", "p1", "p2"], "left").drop("p1", "p2"), "linked")
    kids = linked.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    return cut_lineage(linked.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")


def _compress(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chains, rest): every unary node with its chain's end and the totals up to
    there; the other nodes, hung on the chains' parents."""
    edges = [f"edge_{c}" for c in TOTALS]
    chains = cut_lineage(live.filter("n = 1").select("node", F.col("only").alias("end"), "parent", "depth", *edges, *[(F.col(c) + F.col(f"only_{c}")).alias(c) for c in TOTALS]), "chains")
    doubled = chains
    while True:
        on = doubled.select(F.col("node").alias("end"), F.col("end").alias("next"), *[F.col(c).alias(f"next_{c}") for c in TOTALS])
        moved = cut_lineage(doubled.join(on, "end", "left").select(
            "node", F.coalesce("next", "end").alias("end"), "parent", "depth", *edges, *[(F.col(c) + F.coalesce(f"next_{c}", F.lit(0))).alias(c) for c in TOTALS],
            F.col("next").isNotNull().alias("moved")), "doubled")
        drop_staged(doubled)
        doubled = moved.drop("moved")
        doubled.staged_path = moved.staged_path
        if moved.filter("moved").limit(1).count() == 0:
            break
    # a chain's uppermost node knows the parent, the whole sum and the edge above
    tops = doubled.groupBy(F.col("end").alias("node")).agg(F.min_by(F.struct(F.col("parent").alias("up"), *[(F.col(c) + F.col(f"edge_{c}")).alias(f"over_{c}") for c in TOTALS]), "depth").alias("top"))
    rest = live.filter("n <> 1").join(tops, "node", "left").select(
        "node", "depth", "n", F.when(F.col("top").isNull(), F.col("parent")).otherwise(F.col("top.up")).alias("parent"), *TOTALS,
        *[F.when(F.col("top").isNull(), F.col(f"edge_{c}")).otherwise(F.col(f"top.over_{c}")).alias(f"edge_{c}") for c in TOTALS])
    return doubled.select("node", "end", *TOTALS), rest


#: What is summed over subtrees.
TOTALS = ["n_leaves", "saved_tokens"]


def contract(nodes: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens): for every node the sums over its subtree,
    itself included.  ``nodes``: node, parent (null: root), depth, n_leaves and
    saved_tokens of the node alone."""
    live = cut_lineage(nodes.select("node", "parent", "depth", *[F.col(c).cast("long").alias(c) for c in TOTALS],
                                    *[F.lit(0).cast("long").alias(f"edge_{c}") for c in TOTALS]), "live")
    chains, done = [], []
    while live.limit(1).count():
        kids = live.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(
            F.count("*").alias("n"), F.min("node").alias("only"), *[F.sum(f"edge_{c}").alias(f"only_{c}") for c in TOTALS])
        state = cut_lineage(live.join(kids, "node", "left").withColumn("n", F.coalesce("n", F.lit(0))), "state")
        gone, rest = _compress(state)
        chains.append(gone)
        rest = cut_lineage(rest, "compressed")
        leaves = rest.filter("n = 0")
        done.append(leaves.select("node", *TOTALS))
        given = leaves.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(*[F.sum(F.col(c) + F.col(f"edge_{c}")).alias(f"got_{c}") for c in TOTALS])
        drop_staged(live)
        live = cut_lineage(rest.filter("n > 1").join(given, "node", "left").select(
            "node", "parent", "depth", *[(F.col(c) + F.coalesce(f"got_{c}", F.lit(0))).alias(c) for c in TOTALS], *[f"edge_{c}" for c in TOTALS]), "live")
        drop_staged(state)
    known = None
    for chain, leaves in zip(reversed(chains), reversed(done), strict=True):
        known = leaves if known is None else known.unionByName(leaves)
        ends = known.select(F.col("node").alias("end"), *[F.col(c).alias(f"end_{c}") for c in TOTALS])
        known = cut_lineage(known.unionByName(chain.join(ends, "end").select("node", *[(F.col(c) + F.col(f"end_{c}")).alias(c) for c in TOTALS])), "known")
    return known if known is not None else live.select("node", *TOTALS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, ids) come sorted; the stretches of one node are one digest."""
    at, digest = None, None
    names, digests = [], []
    for batch in batches:
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != at:
                if at is not None:
                    names.append(at)
                    digests.append(digest.hexdigest())
                at, digest = node, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(names) > 10_000:
            yield pa.RecordBatch.from_pydict({"node": pa.array(names, pa.int64()), "ends_sha256": digests})
            names, digests = [], []
    if at is not None:
        names.append(at)
        digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_pydict({"node": pa.array(names, pa.int64()), "ends_sha256": digests})


def ends(convs: DataFrame, walked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, ends_sha256): digest of the ids of the conversations that end at a node."""
    last = walked.join(convs.select("conv_id", "length"), "conv_id").filter("depth = length").select(*NAME, "conv_id")
    none = convs.filter("length = 0").select(*[F.lit(0).cast("long").alias(c) for c in NAME], "conv_id")
    placed = last.unionByName(none).join(nodes.select("node", *NAME), NAME).select("node", "conv_id")
    stretches = (ranged(placed, [F.col("node"), F.col("conv_id")], "ends").groupBy("node", "range_no")
                 .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")))
    return map_arrow(stretches.repartition("node").sortWithinPartitions("node", "range_no").select("node", "ids"), _digest, "node long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """One row a node of the trie of rebuilt conversations: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Conversation c takes over up to ``most - 1`` turns of c - c % group."""
    convs, walked = steps(conversations, group, most)
    nodes = trie(convs, walked)
    alone = nodes.select("node", "parent", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    out = nodes.join(contract(alone), "node").join(ends(convs, walked, nodes), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), *TOTALS,
                      F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
