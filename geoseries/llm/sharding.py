"""Operator 3, sharding by fixed virtual slots.

Every record hashes into one of ``n_slots`` virtual slots for good; bytes and
rows are aggregated per slot; a versioned map says which shard holds a slot.
The first version is planned largest slot first onto the lightest shard, so
shard sizes come out near equal; later versions are edits of it that move as
few slots as possible.  Only the slot table (``n_slots`` rows, a parameter, so
a proven bound) ever reaches the driver or is broadcast.

A record's place in its slot comes from running totals over ranges
(``operators.running``), so no task sorts a whole slot.

Nulls: a null text has no bytes and the CRC of the empty text; a null doc_id
hashes by the rest of the record.  Repeated rows share a slot, a thousand at a
time, and get consecutive positions there.  An empty table gives an empty result and a valid map.
Other columns of the input are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoseries.operators.running import ranged, running
from geoseries.session import cut_lineage

N_SLOTS = 8192
COPIES = 1000           # equal records in one slot
ROW_OVERHEAD = 16
MAP_SCHEMA = "version int, virtual_slot int, shard int, slot_rows long, slot_bytes long"


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, row_no, virtual_slot) of every row, text not
    carried on.  The slot is hashed from the record; of equal records every
    ``COPIES`` go to a slot of their own, so neither an id nor a record that a
    third of all rows share makes one heavy slot."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
            .select("doc_id", (F.octet_length("text").cast("long") + ROW_OVERHEAD).alias("size"),
                    F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row_no")))
    content = ["doc_id", "text_crc32", "size"]
    order = [F.col("row_no")]
    # equal records cannot be told apart, so it does not matter which of them is the n-th
    placed = ranged(cut_lineage(rows, "records"), [*map(F.col, content), *order], "records").withColumn("one", F.lit(1))
    numbered = running(placed, content, order, {"nth": ("one", "sum")})
    slot = F.pmod(F.xxhash64(*content, F.floor((F.col("nth") - 1) / COPIES)), F.lit(n_slots)).cast("int")
    return numbered.select("doc_id", "size", "text_crc32", "row_no", slot.alias("virtual_slot"))


def slot_table(recs: DataFrame) -> list[tuple[int, int, int]]:
    """(virtual_slot, rows, bytes), at most one entry per slot."""
    rows = recs.groupBy("virtual_slot").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    return sorted((r.virtual_slot, r.n, r.b) for r in rows)


def plan_map(slots: list[tuple[int, int, int]], n_shards: int, n_slots: int = N_SLOTS) -> dict[int, int]:
    """Slot -> shard: the largest slot goes to the lightest shard; empty slots are dealt round."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    load = [(0, s) for s in range(n_shards)]
    out = {v: v % n_shards for v in range(n_slots)}
    for v, _, size in sorted(slots, key=lambda x: (-x[2], x[0])):
        b, s = heapq.heappop(load)
        out[v] = s
        heapq.heappush(load, (b + size, s))
    return out


def edit_map(old: dict[int, int], slots: list[tuple[int, int, int]], n_shards: int) -> dict[int, int]:
    """The next version of a map: shards over the mean give up their smallest
    slots as long as they do not fall under it, and those go, largest first, to
    the lightest shard, so that a new shard gets almost all that moves.  A slot whose shard no longer exists is always given up."""
    size = {v: b for v, _, b in slots}
    held: list[list[int]] = [[] for _ in range(n_shards)]
    free = []
    for v in sorted(old):
        held[old[v]].append(v) if old[v] < n_shards else free.append(v)
    mean = sum(size.values()) / n_shards
    load = []
    for s, own in enumerate(held):
        b = sum(size.get(v, 0) for v in own)
        for v in sorted(own, key=lambda v: (size.get(v, 0), v)):
            if size.get(v, 0):
                if b - size[v] < mean:
                    break
                free.append(v)
                b -= size[v]
        load.append((b, s))
    out = dict(old)
    heapq.heapify(load)
    for v in sorted(free, key=lambda v: (-size.get(v, 0), v)):
        b, s = heapq.heappop(load)
        out[v] = s
        heapq.heappush(load, (b + size.get(v, 0), s))
    return out


def map_frame(spark: SparkSession, version: int, mapping: dict[int, int], slots: list[tuple[int, int, int]]) -> DataFrame:
    known = {v: (n, b) for v, n, b in slots}
    return spark.createDataFrame([(version, v, s, *known.get(v, (0, 0))) for v, s in sorted(mapping.items())], MAP_SCHEMA)


def save_map(frame: DataFrame, path: str) -> None:
    """Versions lie side by side under ``version=N``; an old one stays readable."""
    version = frame.first().version
    frame.drop("version").coalesce(1).write.mode("error").parquet(f"{path.rstrip('/')}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    rows = spark.read.parquet(f"{path.rstrip('/')}/version={version}").select("virtual_slot", "shard").collect()
    return {r.virtual_slot: r.shard for r in rows}


def assign(recs: DataFrame, mapping: dict[int, int], slots: list[tuple[int, int, int]], version: int = 1) -> DataFrame:
    """Each record's shard and its position there: a shard's slots lie one after
    the other, and a record's position is its slot's offset plus its rank in
    the slot (by doc_id)."""
    offset, upto = {}, {}
    for v, n, _ in slots:
        s = mapping[v]
        offset[v] = upto.get(s, 0)
        upto[s] = offset[v] + n
    place = recs.sparkSession.createDataFrame([(v, mapping[v], offset[v]) for v, _, _ in slots],
                                              "virtual_slot int, shard int, offset long")
    order = [F.col(c) for c in ("doc_id", "text_crc32", "size", "row_no")]
    ranked = running(ranged(recs, [F.col("virtual_slot"), *order], "slots").withColumn("one", F.lit(1)), ["virtual_slot"], order, {"rank": ("one", "sum")})
    return (ranked.join(F.broadcast(place), "virtual_slot")
            .select("doc_id", "size", "text_crc32", "virtual_slot", "shard",
                    (F.col("offset") + F.col("rank") - 1).alias("slot"), F.lit(version).alias("map_version")))


def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS) -> DataFrame:
    """One row per record with its shard under the first version of the map."""
    recs = cut_lineage(records(docs, n_slots), "records")
    slots = slot_table(recs)
    return assign(recs, plan_map(slots, n_shards, n_slots), slots)
