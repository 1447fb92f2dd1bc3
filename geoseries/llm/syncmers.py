"""Operator 4, document fingerprints from closed syncmers.

A k-mer of code points is an anchor when the smallest name among its inner
s-mers belongs to the first or the last of them.  Whether a k-mer is an anchor
depends on the k-mer alone (context-free), so equal passages carry equal
anchors at the same distances.  The fingerprint lists every anchor of the whole
text as (name, position); a text without a single anchor is listed by one name
of the whole of it.  Likeness compares positions: the longest chain of anchors
that occur in both fingerprints in the same order, over the larger number of
anchors (0 to 1).

Null counts as empty; the empty text has the empty fingerprint, which is like
itself (1) and unlike every other (0).  Rows are ordered by doc_id (nulls
first), rows of one id by text; repeated rows are fingerprinted alike; an empty
table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoseries.llm.textkit import map_arrow, mix64, salt, texts_of

K = 24
S = 8
SLICE_CHARS = 1 << 20
ANCHOR = np.dtype([("name", "<u4"), ("at", "<u4")])


def _smallest(names: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w, by doubling."""
    best, span = names, 1
    while span < w:
        step = min(span, w - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    return best


def _anchors(codes: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and positions of the closed syncmers of one run of code points."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
    letters = mix64(codes.astype(np.uint64) + np.uint64(1))
    inner = np.zeros(len(codes) - s + 1, dtype=np.uint64)
    for j in range(s):
        inner += letters[j:j + len(inner)] * salt(j)
    inner = mix64(inner)
    w = k - s + 1
    low = _smallest(inner, w)
    at = np.flatnonzero((inner[:n] == low) | (inner[w - 1:w - 1 + n] == low))
    name = np.zeros(len(at), dtype=np.uint64)
    for j in range(0, k, s):
        name += inner[at + min(j, k - s)] * salt(j + 1)
    return (mix64(name) >> np.uint64(32)).astype(np.uint32), at


def anchors(text: str, k: int = K, s: int = S) -> np.ndarray:
    """All closed syncmers of a text; memory beyond them is bounded by ``SLICE_CHARS``."""
    names, places = [], []
    for lo in range(0, max(1, len(text) - k + 1), SLICE_CHARS):
        part = np.frombuffer(text[lo:lo + SLICE_CHARS + k - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        name, at = _anchors(part, k, s)
        names.append(name)
        places.append(at + lo)
    return _made(np.concatenate(names), np.concatenate(places))


def _made(name: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(name), dtype=ANCHOR)
    out["name"], out["at"] = name, at
    return out


def listed(own: np.ndarray, text: str) -> np.ndarray:
    """A text's fingerprint: its anchors, or one name of the whole if it has none."""
    if len(own) or not text:
        return own
    whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest()
    return _made(np.frombuffer(whole, dtype="<u4"), np.zeros(1))


def fingerprint(text: str | None, k: int = K, s: int = S) -> np.ndarray:
    return listed(anchors(text or "", k, s), text or "")


def spliced(own: np.ndarray, following: np.ndarray, new: str, keep: int, k: int = K, s: int = S) -> np.ndarray:
    """Anchors of ``new``, whose first ``keep`` code points begin the text of ``own``
    and whose rest begins the text of ``following``: an anchor depends on its
    k-mer alone, so only k-mers across the joint are looked at anew."""
    lo = max(0, keep - k + 1)
    joint = anchors(new[lo:keep + k - 1], k, s)
    joint["at"] += lo
    joint = joint[(joint["at"] < keep) & (joint["at"].astype(np.int64) + k > keep)]
    moved = following[following["at"].astype(np.int64) + k <= len(new) - keep].copy()
    moved["at"] += keep
    return np.concatenate([own[own["at"].astype(np.int64) + k <= keep], joint, moved])


def pack(anchors: np.ndarray) -> str:
    return base64.b64encode(anchors.tobytes()).decode()


def unpack(packed: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(packed), dtype=ANCHOR)


def _numbered(names: np.ndarray) -> np.ndarray:
    """Each name joined with the number of its earlier occurrences."""
    order = np.argsort(names, kind="stable")
    own = names[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, dtype=np.int64)
    number = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    out = np.empty(len(own), dtype=np.uint64)
    out[order] = (number.astype(np.uint64) << np.uint64(32)) | own.astype(np.uint64)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Longest chain of common anchors in the same order, over the larger count."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    x, y = _numbered(a["name"]), _numbered(b["name"])
    _, where, at = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(at):
        return 0.0
    tails: list[int] = []
    for p in at[np.argsort(where)].tolist():
        i = bisect_left(tails, p)
        if i == len(tails):
            tails.append(p)
        else:
            tails[i] = p
    return len(tails) / max(len(a), len(b))


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to the first as many of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows with the range of the id they belong to (``part``), ranges of about equal rows."""
    cuts = rows.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    splits = sorted({float(c) for c in cuts})
    if not splits:
        return rows.withColumn("part", F.when(F.col("doc_id").isNull(), -1).otherwise(0))
    cut = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol="as_double", outputCol="range", handleInvalid="keep")
    return (cut.transform(rows.withColumn("as_double", F.col("doc_id").cast("double")))
            .withColumn("part", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("range").cast("int"))).drop("as_double", "range"))


def compare_edited(docs: DataFrame, k: int = K, s: int = S, parts: int | None = None) -> DataFrame:
    """Per row, in doc_id order: its fingerprint, that of its edit by the next row, and their likeness.

    Rows go to ranges of the id (four a shuffle partition unless ``parts`` is
    given), each sorted within one task; every range also gets a copy of the
    first row of the range after it (one row a range), so each row meets its
    successor without a sort of the whole table in one task.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts_of(docs).withColumn("text", F.coalesce("text", F.lit("")))
    dealt = _dealt(rows, parts or 4 * tasks)
    least = {r.part: r.first for r in dealt.groupBy("part").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("n"), F.count("*").alias("m"))
             .select("part", F.when(F.col("n") == F.col("m"), F.col("first")).alias("first")).collect()}  # a null id sorts first
    order = sorted(least)
    heads = spark.createDataFrame([(least[order[(i + 1) % len(order)]], p) for i, p in enumerate(order)], "head long, of int")
    first = (rows.join(F.broadcast(heads.select("head").distinct()), F.col("doc_id").eqNullSafe(F.col("head")), "left_semi")
             .groupBy("doc_id").agg(F.min("text").alias("text")))
    copies = (first.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")))
              .select("doc_id", "text", F.col("of").alias("part"), F.lit(1).alias("copy")))
    sorted_rows = (dealt.withColumn("copy", F.lit(0)).unionByName(copies)
                   .repartition(tasks, "part").sortWithinPartitions("part", "copy", "doc_id", "text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches):
        held = None  # (doc_id, text, anchors, part) of the row that waits for its successor
        for b in batches:
            out = {f.name: [] for f in schema}
            size = 0
            ids, texts, parts = b.column("doc_id").to_pylist(), b.column("text"), b.column("part").to_pylist()
            for i, (doc, p, copy) in enumerate(zip(ids, parts, b.column("copy").to_pylist(), strict=True)):
                text = texts[i].as_py()
                own = anchors(text, k, s)
                if held is not None and held[3] == p:
                    new = edited(held[1], text)
                    other = listed(spliced(held[2], own, new, len(held[1]) - len(held[1]) // 2, k, s), new)
                    mine = listed(held[2], held[1])
                    for c, v in zip(out, (held[0], len(held[1]), hashlib.sha256(new.encode()).hexdigest(), pack(mine), pack(other),
                                          likeness(mine, other), likeness(mine, listed(own, text))), strict=True):
                        out[c].append(v)
                    size += len(out["fingerprint"][-1]) + len(out["edited_fingerprint"][-1])
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pydict(out, schema=schema)
                        out, size = {f.name: [] for f in schema}, 0
                held = None if copy else (doc, text, own, p)
            if out["doc_id"]:
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return map_arrow(sorted_rows, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
