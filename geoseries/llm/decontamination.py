"""Operator 7, benchmark decontamination by winnowing.

A text's fingerprints are the smallest k-gram names of each run of ``w``
consecutive k-grams (the rightmost on ties).  With k + w - 1 = ``window`` words,
any span of ``window`` words that two texts share holds a fingerprint that
both select, so joining fingerprints misses no shared span.  Each hit is
extended over equal words in both directions; spans of at least ``window``
words count.  Items shorter than a window are one window of their own length
and are looked up by their whole-item name.

The benchmark is the stated query set.  Items of equal text are one item with
several ids; it is dealt into blocks of about ``block_bytes`` of text (one block
when it is smaller, measured first); each block is fingerprinted, broadcast and
joined with all documents inside the scan, so documents never shuffle however
common a passage is.  Of several blocks one is held at a time: its results are
written and its broadcast is removed before the next.

Nulls: a null text has no words (document: nothing hit; item: no window).
Empty tables, repeated rows and repeated item ids are fine: an item id counts
once.  Items without an id are looked for like any other; together they count as
one item, which has no name in the digest.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoseries.llm.textkit import ALNUM, binary_column, grams, joined_words, map_arrow, map_batches, slices, texts_of
from geoseries.session import cut_lineage, drop_staged

WINDOW = 10
GRAM = 5
BLOCK_BYTES = 16 << 20


def winnow(gram_names: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest name of each run of w (rightmost on ties)."""
    n = len(gram_names) - w + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    best = gram_names[w - 1:].copy()
    at = np.arange(w - 1, w - 1 + n)
    for j in range(w - 2, -1, -1):
        less = gram_names[j:j + n] < best
        best[less] = gram_names[j:j + n][less]
        at[less] = np.flatnonzero(less) + j
    return at[np.concatenate([[True], at[1:] != at[:-1]])]  # they never go back


class Index:
    """Fingerprints of one block of the benchmark (bounded by its bytes)."""

    def __init__(self, items: list[tuple[list[str | None], bytes | None]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.ids = [i for i, _ in items]
        self.words, self.short = [], {}
        names, where = [], []
        for no, (_, text) in enumerate(items):
            _, own, _, _, _ = joined_words([text], ALNUM, True)
            self.words.append(own)
            if 0 < len(own) < window:
                self.short.setdefault(len(own), {}).setdefault(int(grams(own, len(own))[0]), []).append(no)
            g = grams(own, gram)
            at = winnow(g, window - gram + 1)
            names.append(g[at])
            where.append(np.stack([np.full(len(at), no), at], axis=1))
        names = np.concatenate(names) if names else np.empty(0, dtype=np.uint64)
        where = np.concatenate(where) if where else np.empty((0, 2), dtype=np.int64)
        order = np.argsort(names, kind="stable")
        self.names, self.where = names[order], where[order]
        self.short_names = {m: np.array(sorted(d), dtype=np.uint64) for m, d in self.short.items()}

    def hits(self, names: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
        """For the words of several documents (document i's are
        ``bounds[i]:bounds[i + 1]``): flags of the words that lie in a shared
        window, and the items found per document."""
        hit, found = np.zeros(len(names), dtype=bool), {}
        g = grams(names, self.gram)  # those that cross documents select a few positions more and never extend far enough
        at = winnow(g, self.window - self.gram + 1)
        if len(self.names) and len(at):
            lo = np.searchsorted(self.names, g[at], "left")
            known = np.flatnonzero(self.names[np.minimum(lo, len(self.names) - 1)] == g[at])
            hi = np.searchsorted(self.names, g[at[known]], "right")
            reach: dict[tuple[int, int], int] = {}  # (item, diagonal) -> end of the span already extended there
            for k, end in zip(known, hi, strict=True):
                p = int(at[k])
                doc = int(np.searchsorted(bounds, p, "right")) - 1
                first, last = int(bounds[doc]), int(bounds[doc + 1])
                for no, q in self.where[lo[k]:end].tolist():
                    if reach.get((no, p - q), -1) > p:
                        continue
                    a, b = self._extend(names[first:last], self.words[no], p - first, q)
                    reach[no, p - q] = first + b
                    if b - a >= self.window:
                        hit[first + a:first + b] = True
                        found.setdefault(doc, set()).add(no)
        for m, d in self.short.items():
            whole = grams(names, m)
            for p in np.flatnonzero(np.isin(whole, self.short_names[m])):
                doc = int(np.searchsorted(bounds, p, "right")) - 1
                if p + m <= bounds[doc + 1]:
                    hit[p:p + m] = True
                    found.setdefault(doc, set()).update(d[int(whole[p])])
        return hit, found

    def _extend(self, own: np.ndarray, item: np.ndarray, p: int, q: int) -> tuple[int, int]:
        back = min(p, q)
        differ = np.flatnonzero(own[p - back:p] != item[q - back:q])
        a = p - back + (int(differ[-1]) + 1 if len(differ) else 0)
        ahead = min(len(own) - p, len(item) - q)
        differ = np.flatnonzero(own[p:p + ahead] != item[q:q + ahead])
        return a, p + (int(differ[0]) if len(differ) else ahead)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("row_no", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
DDL = "doc_id long, row_no long, n_words long, spans array<long>, items array<string>"


def _pass(docs: DataFrame, held: Broadcast) -> DataFrame:
    def fn(batch):
        index = held.value
        texts, ids, rows = binary_column(batch, "text"), batch.column("doc_id"), batch.column("row_no")
        for lo, hi in slices(texts):
            _, names, _, _, bounds = joined_words(texts[lo:hi], ALNUM, True)
            hit, found = index.hits(names, bounds)
            spans: list[list[int]] = [[] for _ in range(hi - lo)]
            for doc in found:
                edge = np.diff(hit[bounds[doc]:bounds[doc + 1]].astype(np.int8), prepend=0, append=0)
                spans[doc] = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).ravel().tolist()
            items = [sorted({i for no in found.get(doc, ()) for i in index.ids[no]}, key=lambda i: (i is None, i)) for doc in range(hi - lo)]
            yield {"doc_id": ids[lo:hi], "row_no": rows[lo:hi], "n_words": np.diff(bounds), "spans": spans, "items": items}

    return map_batches(docs, fn, SCHEMA, DDL)


def _merged(a: np.ndarray) -> tuple[list[int], int]:
    """Union of [start, end) pairs given flat, and the words it covers."""
    out: list[int] = []
    for s, e in sorted(zip(a[::2], a[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out, sum(out[1::2]) - sum(out[::2])


def indexes(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[Index, bool]]:
    """The fingerprints of the benchmark's distinct texts in blocks of bounded bytes, and whether the block is the only one."""
    if not 0 < gram <= window:
        raise ValueError("gram must lie between 1 and window")
    items = (benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
             .groupBy("text").agg(F.array_sort(F.collect_set("item_id")).alias("ids"), F.bool_or(F.col("item_id").isNull()).alias("nameless")))
    size = F.octet_length("text") + F.aggregate("ids", F.lit(16), lambda n, i: n + F.octet_length(i) + 8)
    total = items.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for k in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        yield Index([([*r.ids, *([None] if r.nameless else [])], r.text.encode()) for r in block.toLocalIterator()], window, gram), k == blocks - 1 == 0


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows, all columns, without an occurrence of any benchmark window."""
    for index, alone in indexes(benchmark, window, gram, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(index)
        if alone:
            return _clean_pass(docs, held)
        rest = cut_lineage(_clean_pass(docs, held), "clean")
        held.destroy()
        drop_staged(docs)
        docs = rest
    return docs


def _clean_pass(docs: DataFrame, held: Broadcast) -> DataFrame:
    def run(batches):
        index = held.value
        for b in batches:
            texts = binary_column(b, "text")
            for lo, hi in slices(texts):
                _, names, _, _, bounds = joined_words(texts[lo:hi], ALNUM, True)
                found = index.hits(names, bounds)[1]
                yield b.slice(lo, hi - lo).filter(pa.array([d not in found for d in range(hi - lo)]))

    return map_arrow(docs, run, docs.schema)


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, spans (flat array of [start, end) word
    ranges that benchmark windows cover, disjoint) and items (ids, as strings,
    sorted, of the items with an occurring window; a null at the end for items without an id)."""
    rows, parts = texts_of(docs).withColumn("row_no", F.monotonically_increasing_id()), []
    for index, alone in indexes(benchmark, window, gram, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(index)
        if alone:
            return _pass(rows, held).drop("row_no")
        if not parts:
            rows = cut_lineage(rows, "texts")  # row numbers are taken once
        parts.append(cut_lineage(_pass(rows, held), "hits"))
        held.destroy()
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)

    def merge(batches):
        for b in batches:
            d = b.to_pydict()
            d["spans"] = [_merged(np.array(s, dtype=np.int64))[0] for s in d["spans"]]
            yield pa.RecordBatch.from_pydict(d, schema=b.schema)

    grouped = (whole.groupBy("row_no").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                                           F.flatten(F.collect_list("spans")).alias("spans"),
                                           F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
               .drop("row_no"))
    return map_arrow(grouped, merge, "doc_id long, n_words long, spans array<long>, items array<string>")


def report(found: DataFrame) -> DataFrame:
    """Counts and digest per document of ``find_hits``."""
    starts = F.filter("spans", lambda x, i: i % 2 == 0)
    ends = F.filter("spans", lambda x, i: i % 2 == 1)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("doc_id", "n_words", (total(ends) - total(starts)).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))
