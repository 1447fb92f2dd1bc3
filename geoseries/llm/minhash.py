"""Operator 2, near-duplicate groups by SuperMinHash.

Signatures: each shingle visits the m signature places in an order of its own
(place number ``a * j + b mod m`` at rank j, m prime, in place of a shuffled
permutation: any two places get any two ranks equally often, which is all the
estimator's variance depends on) and
leaves ``rank + random`` there; a place keeps the least value.  Ranks of one
shingle are correlated - it has exactly one low rank per place - which is what
lowers the variance.  All shingles take rank 0 first, then rank 1, and so on;
a document stops as soon as all its places are filled, since later ranks are
larger.

Candidates: equal texts (by a 128-bit digest of the shingle set) collapse to
their smallest id first, so groups of copies cost one row.  Signatures are cut
into bands; documents with an equal band share a bucket.  First the members of
a bucket are compared with its centre (the first in a fixed random order),
which gathers a group of near copies at its size, not its square.  Then, in
buckets that still hold several components, each row outside the largest one
is held against the other components' rows: a parity sketch of the shingle set
bounds their common shingles exactly from above, and only pairs that may reach
the threshold leave the join.  No candidate pair of two components is skipped.
Links are verified on full shingle sets; components come from joins.  With 56
bands of 6 and independent places a pair at similarity 0.8 would escape all
bands with probability 4e-8.  Affine orders are not independent in sets of a few
shingles: of random pairs that share 4 of 5 shingles about one in 100,000 escapes
(4 of 395,000, measured); none was met among pairs of larger sets.

Nulls: a text that is null or has no words has an empty set, linked with
nothing; a row without an id is linked with nothing and has a null component.
Rows that share an id are versions of one document: a link of any counts for
it.  Repeated rows give repeated results; an empty table an empty result.
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoseries.llm.graph import components
from geoseries.llm.textkit import SPACED, binary_column, joined_words, map_batches, mix64, salt, signed, slices, texts_of
from geoseries.session import cut_lineage, drop_staged

BANDS = 56
ROWS = 6
PLACES = 337            # prime, at least BANDS * ROWS
FIRST_BANDS = 16        # bands whose buckets are compared with their centre first
SKETCH_WORDS = 16       # 64-bit words of a document's parity sketch
SEMI_JOIN_IDS = 2_000_000   # ids broadcast at most (16 MB); more go through a shuffle
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(names: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle names of several documents, with the document of each;
    fewer than k words are one shingle."""
    out, doc = [], []
    code = np.zeros(max(0, len(names)), dtype=np.uint64)
    for j in range(k):
        code[:len(names) - j] += names[j:] * salt(j)
    code = mix64(code)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b - a >= k:
            own = np.unique(code[a:b - k + 1])
        elif b > a:
            own = mix64(np.array([np.sum(names[a:b] * np.array([salt(j) for j in range(b - a)])) + np.uint64(b - a)]))
        else:
            continue
        out.append(own)
        doc.append(np.full(len(own), i))
    if not out:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return np.concatenate(out), np.concatenate(doc)


def signatures(names: np.ndarray, doc: np.ndarray, n: int, m: int = PLACES) -> np.ndarray:
    """SuperMinHash signatures (n x m) of the documents' distinct shingles."""
    out = np.full(n * m, EMPTY, dtype=np.uint64)
    step = (1 + mix64(names ^ salt(200)) % np.uint64(m - 1)).astype(np.int64)
    place = (mix64(names ^ salt(201)) % np.uint64(m)).astype(np.int64)
    base = doc * m
    for rank in range(m):
        value = (np.uint64(rank) << np.uint64(48)) | (mix64(names + salt(300 + rank)) >> np.uint64(16))
        np.minimum.at(out, base + place, value)
        open_ = (out.reshape(n, m) == EMPTY).any(axis=1)
        live = open_[doc]
        if not live.any():
            break
        if not live.all():
            names, doc, base, step, place = (x[live] for x in (names, doc, base, step, place))
        place = place + step
        place[place >= m] -= m
    return out.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    weights = np.array([salt(400 + r) for r in range(rows)])
    own = (sig[:, :bands * rows].reshape(len(sig), bands, rows) * weights).sum(axis=2, dtype=np.uint64)
    return mix64(mix64(own) + np.array([salt(500 + b) for b in range(bands)]))


def sketches(names: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Parity sketches (n x words): each shingle flips one bit.  Shingles that two
    sets do not share flip at least as many bits as the sketches differ in."""
    bits = 64 * SKETCH_WORDS
    at = doc * bits + (mix64(names ^ salt(602)) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(at, minlength=n * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, SKETCH_WORDS, 64), axis=2, bitorder="little").view(np.uint64).reshape(n, SKETCH_WORDS)


def digests(names: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell shingle sets apart, whatever the order of their names."""
    d1, d2 = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    np.add.at(d1, doc, mix64(names ^ salt(600)))
    np.add.at(d2, doc, mix64(names ^ salt(601)))
    return d1, d2


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])


def signed_documents(docs: DataFrame, k: int) -> DataFrame:
    """Per row: set size, 128-bit digest of the set, band keys (none for an empty set)."""
    def fn(batch):
        texts, ids = binary_column(batch, "text"), batch.column("doc_id")
        for lo, hi in slices(texts, 1 << 20):
            n = hi - lo
            _, names, _, _, bounds = joined_words(texts[lo:hi], SPACED, True)
            own, doc = shingles(names, bounds, k)
            size = np.bincount(doc, minlength=n)
            d1, d2 = digests(own, doc, n)
            some = np.flatnonzero(size)
            keys = band_keys(signatures(own, np.searchsorted(some, doc), len(some)))
            bands: list = [[]] * n
            for i, row in zip(some, signed(keys), strict=True):
                bands[i] = row
            yield {"doc_id": ids[lo:hi], "n_shingles": size, "d1": signed(d1), "d2": signed(d2), "bands": pa.array(bands, pa.list_(pa.int64())), "sketch": list(signed(sketches(own, doc, n)))}

    return map_batches(texts_of(docs), fn, SIGNED, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the given rows, one row for each distinct set of a node:
    repeated rows of a document are one."""
    schema = pa.schema([("node", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def fn(batch):
        texts, ids = binary_column(batch, "text"), batch.column("doc_id")
        for lo, hi in slices(texts, 1 << 20):
            _, names, _, _, bounds = joined_words(texts[lo:hi], SPACED, True)
            own, doc = shingles(names, bounds, k)
            ends = np.searchsorted(doc, np.arange(hi - lo + 1))
            d1, d2 = digests(own, doc, hi - lo)
            yield {"node": ids[lo:hi], "d1": signed(d1), "d2": signed(d2), "shingles": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(own)))}

    every = map_batches(docs, fn, schema, "node long, d1 long, d2 long, shingles array<long>")
    return every.groupBy("node", "d1", "d2").agg(F.first("shingles").alias("shingles")).select("node", "shingles")


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    wanted = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= SEMI_JOIN_IDS else wanted
    sets = shingle_sets(texts_of(docs).join(wanted, "doc_id", "left_semi"), k)
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, band, node, n_shingles, centre) of all buckets with two members at
    least; the centre is the first in a fixed random order.  Size and centre are
    aggregates, so no task holds a bucket."""
    rows = nodes.select(F.posexplode("bands").alias("band", "key"), "node", "n_shingles")
    order = F.struct(F.xxhash64("node").alias("h"), F.col("node"))
    shared = (rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.min(order).alias("first"))
              .filter("least <> most").select("key", F.col("first.node").alias("centre")))
    return rows.join(shared, "key")


def _sized(percent: int):
    return 100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def _star_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """Every member of a bucket with the bucket's centre."""
    x = buckets.filter("node = centre").select("key", F.col("node").alias("u"), F.col("n_shingles").alias("nu")).distinct()
    y = buckets.filter("node <> centre").select("key", F.col("node").alias("v"), F.col("n_shingles").alias("nv"))
    return _ordered(x.join(y, (x.key == y.key) & _sized(percent)))


def _stray_pairs(buckets: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The pairs of one bucket that lie in different components and may still be
    similar: each row outside its bucket's largest component with every other row.
    A pair leaves the join once, from the first band that it shares.
    The bound on the common shingles, (u + v - differing sketch bits) / 2, never
    falls short, so no similar pair is lost; dissimilar ones hardly pass it."""
    own = buckets.join(labels, "node", "left").select("key", "band", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    mixed = own.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("key")
    own = cut_lineage(own.join(mixed, "key", "left_semi"), "mixed")
    main = own.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    words = [F.col("sketch")[i] for i in range(SKETCH_WORDS)]
    sketched = own.join(nodes.select("node", "bands", *[w.alias(f"w{i}") for i, w in enumerate(words)]), "node")
    side = lambda rows, s: rows.select("key", *[F.col(c).alias(f"{x}{s}") for c, x in (("node", ""), ("n_shingles", "n"), ("component", "c"), ("bands", "bands_"), ("band", "band_"))],
                                       *[F.col(f"w{i}").alias(f"w{i}{s}") for i in range(SKETCH_WORDS)])
    x, y = side(sketched.join(main, "key").filter("component <> main"), "u"), side(sketched, "v")
    differ = sum((F.bit_count(F.col(f"w{i}u").bitwiseXOR(F.col(f"w{i}v"))) for i in range(1, SKETCH_WORDS)), F.bit_count(F.col("w0u").bitwiseXOR(F.col("w0v"))))
    common = F.col("nu") + F.col("nv") - differ  # twice the bound
    similar = 100 * common >= percent * (2 * (F.col("nu") + F.col("nv")) - common)
    # in the first band they share: there the pair is mixed too, and one of it a stray
    before = lambda s: F.slice(f"bands_{s}", F.lit(1), F.col(f"band_{s}"))
    once = ~F.arrays_overlap(before("u"), before("v"))
    return _ordered(x.join(y, (x.key == y.key) & (F.col("cu") != F.col("cv")) & _sized(percent) & similar & once))


def link(docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of all nodes that have a link."""
    buckets = cut_lineage(_buckets(nodes), "buckets")
    pairs = cut_lineage(_star_pairs(buckets.filter(F.col("band") < FIRST_BANDS), percent), "pairs")
    edges = cut_lineage(verified(docs, pairs, k, percent), "edges")
    drop_staged(pairs)
    labels = components(edges)
    rest = cut_lineage(_stray_pairs(buckets, nodes, labels, percent), "pairs")
    drop_staged(buckets, edges)
    more = cut_lineage(verified(docs, rest, k, percent), "edges")
    drop_staged(rest)
    return _merged(labels, more)


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Components after further edges: those join whole components, so they are
    contracted to the components' labels first."""
    def label_of(rows: DataFrame, end: str) -> DataFrame:
        own = labels.select(F.col("node").alias(end), F.col("component").alias("to"))
        return rows.join(own, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")

    between = components(label_of(label_of(edges, "a"), "b").filter("a <> b").distinct())
    up = between.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return (labels.join(up, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            .unionByName(between.join(labels, "node", "left_anti")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    if k < 1 or not 0 < percent <= 100:
        raise ValueError("k must be positive and percent in 1..100")
    own = cut_lineage(signed_documents(docs, k).withColumn("row_no", F.monotonically_increasing_id()), "signed")
    first = F.min(F.struct("doc_id", "row_no")).alias("first")  # of repeated rows one stands for all
    groups = cut_lineage(own.filter("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(first)
                         .select("d1", "d2", "n_shingles", F.col("first.doc_id").alias("node"), F.col("first.row_no").alias("row_no")), "groups")
    nodes = own.join(groups.select("node", "row_no"), "row_no").select("node", "n_shingles", "bands", "sketch")
    labels = link(docs, nodes, k, percent)
    classes = groups.join(labels, "node", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "node").alias("component"))
    return (own.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2", "n_shingles"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows, all columns, of one document of each group: the smallest id.
    Of rows with that id one stays; rows without an id all stay."""
    found = near_duplicates(docs, k, percent)
    ids = cut_lineage(found.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")), "verdicts")
    gone, repeated = ids.filter("not kept").select("doc_id"), ids.filter("kept and n > 1").select("doc_id")
    small = gone.count() <= SEMI_JOIN_IDS
    rest = docs.join(F.broadcast(gone) if small else gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
    if repeated.isEmpty():
        return rest
    again = rest["doc_id"].cast("long") == repeated["doc_id"]
    return rest.join(repeated, again, "left_anti").unionByName(rest.join(repeated, again, "left_semi").dropDuplicates(["doc_id"]))
