"""Operator 9, substring de-duplication by recompression.

A round renames a document's symbols (words at first): every run of one symbol
becomes a symbol, then every pair whose first symbol falls on the left and
whose second falls on the right side of a hashed partition becomes a symbol.
Names are 64-bit hashes of what they stand for, so all tasks of all Spark
stages name alike without a dictionary.  Equal substrings get equal symbols
except at their ends: at either end a round may only lose the run that touches
it and one symbol more.  What is left for certain is the substring's core.

Every window of ``window`` words is represented by one core symbol (the least
by a hash) of its last round with a non-empty core (round 0, the words, is
never empty), so every occurrence of the same window picks the same symbol at
the same place: no repeat is missed, runs and periodic texts included.

1. Every document's picked symbols (one for several windows in a row) go into
   a table; rows with equal words collapse to one key with their smallest id
   first, and are cut once.
2. Symbols found in two documents at least are shared (a minimum and a maximum
   per name, combined before the shuffle).
3. The windows that picked a shared symbol are verified by the name of their
   whole word sequence: the smallest document id per name decides.
4. Words covered by windows that also start in a smaller document go.

Nulls: a null text has no words; a null id counts as larger than every id, and
such a row is cut like any other but nothing is cut because of it.  Rows with
one id are one document: nothing is cut in one because of the other, and each
is cut at its own words.  A document that repeats a smaller one word by word
loses all its words if they make a window.  Empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoseries.llm.textkit import SPACED, binary_column, grams, joined_words, map_batches, mix64, salt, signed, slices, texts_of
from geoseries.session import cut_lineage, drop_staged

WINDOW = 50
ROUNDS = 12
BROADCAST_BYTES = 64 << 20  # of row names broadcast at most; more go through a shuffle
NAME_BYTES = 120            # of a row's four numbers in a broadcast table (measured)
NO_ID = (1 << 63) - 1


def _runs(sym: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs renamed; for each new symbol its first old one; for each old symbol its new one."""
    new = np.concatenate([[True], sym[1:] != sym[:-1]]) | start
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(sym)))
    name = sym[first].copy()
    many = length > 1
    name[many] = mix64(name[many] * salt(700) + length[many].astype(np.uint64))
    return name, first, np.cumsum(new) - 1


def _pairs(sym: np.ndarray, start: np.ndarray, round_no: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (left, right) renamed; first old symbol, new of old, and which old ones lie on the right."""
    right = (mix64(sym ^ salt(710 + round_no)) & np.uint64(1)).astype(bool)
    joined = np.zeros(len(sym), dtype=bool)  # joined to the symbol before it
    joined[1:] = ~right[:-1] & right[1:] & ~start[1:]
    first = np.flatnonzero(~joined)
    name = sym[first].copy()
    pair = np.flatnonzero(joined)
    into = np.cumsum(~joined) - 1
    name[into[pair]] = mix64(sym[pair - 1] * salt(701) + sym[pair] * salt(702) + np.uint64(round_no))
    return name, first, into, right


def picked(names: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For several documents at once: the first words of their windows and the
    name (with its round) of the symbol each window picks."""
    size = np.diff(bounds)
    many = np.flatnonzero(size >= window)
    if not len(many):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    at = np.concatenate([np.arange(bounds[d], bounds[d + 1] - window + 1) for d in many])
    out = np.empty(len(at), dtype=np.uint64)
    sym = names
    start = np.zeros(len(names), dtype=bool)
    start[bounds[:-1][size > 0]] = True

    def settle(own: np.ndarray, lo: np.ndarray, hi: np.ndarray, sym: np.ndarray, round_no: int) -> None:
        """Windows whose core ends with this round pick its least symbol (by a hash)."""
        code = mix64(sym + salt(720 + round_no))
        best, j = code[lo], 0
        while len(own):
            out[own] = best
            j += 1
            more = lo + j <= hi
            own, lo, hi, best = own[more], lo[more], hi[more], np.minimum(best[more], code[(lo + j)[more]])

    live = np.arange(len(at))                       # windows whose core is not empty
    lo, hi = at, at + window - 1                    # first and last core symbol, as places in this round's symbols
    for round_no in range(ROUNDS + 1):
        runs, first, into = _runs(sym, start)
        run_start = start[first]
        a, b = into[lo] + 1, into[hi] - 1           # a run at either end may go on outside
        paired, second, merged, right = _pairs(runs, run_start, round_no)
        some = a <= b
        a[some] += right[a[some]]                   # a right symbol may be joined to one outside
        b[some] -= ~right[b[some]]                  # a left symbol may be joined to one outside
        some = (a <= b) & (round_no < ROUNDS)
        settle(live[~some], lo[~some], hi[~some], sym, round_no)
        live, lo, hi = live[some], merged[a[some]], merged[b[some]]
        sym, start = paired, run_start[second]
        if not len(live):
            break
    return at, out


def _words(batch: pa.RecordBatch, column: str = "text"):
    """(lo, hi, joined bytes, names, starts, ends, bounds) of slices of a batch."""
    texts = binary_column(batch, column)
    for lo, hi in slices(texts):
        yield lo, hi, *joined_words(texts[lo:hi], SPACED, False)


def _kept(buf: bytes, start: np.ndarray, end: np.ndarray) -> str:
    h = hashlib.sha256()
    for lo in range(0, len(start), 4096):
        h.update((b" " if lo else b"") + b" ".join([buf[a:b] for a, b in zip(start[lo:lo + 4096].tolist(), end[lo:lo + 4096].tolist(), strict=True)]))
    return h.hexdigest()


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row_a, row_b, n_words, words_sha256) per row: the digest of the words joined by one space."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_a", pa.int64()), ("row_b", pa.int64()), ("n_words", pa.int64()), ("words_sha256", pa.string())])

    def fn(batch):
        for lo, hi, buf, _, start, end, bounds in _words(batch):
            yield {**{c: batch.column(c)[lo:hi] for c in ("doc_id", "row_a", "row_b")}, "n_words": np.diff(bounds),
                   "words_sha256": [_kept(buf, start[a:b], end[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]}

    return map_batches(docs, fn, schema, "doc_id long, row_a long, row_b long, n_words long, words_sha256 string")


def symbols(docs: DataFrame, window: int) -> DataFrame:
    """(name, key, id): the symbols that some window picks, once for windows in a row."""
    schema = pa.schema([("name", pa.int64()), ("key", pa.int64()), ("id", pa.int64())])

    def fn(batch):
        keys, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id"))
        for lo, hi, _, names, _, _, bounds in _words(batch):
            at, name = picked(names, bounds, window)
            doc = np.searchsorted(bounds, at, "right") - 1
            new = np.concatenate([[True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]) if len(at) else np.empty(0, dtype=bool)
            yield {"name": signed(name[new]), "key": keys[lo:hi][doc[new]], "id": ids[lo:hi][doc[new]]}

    return map_batches(docs, fn, schema, "name long, key long, id long")


def windows(docs: DataFrame, window: int) -> DataFrame:
    """(seq, key, id, at): whole-sequence names of the windows that picked one of the row's shared symbols."""
    schema = pa.schema([("seq", pa.int64()), ("key", pa.int64()), ("id", pa.int64()), ("at", pa.int64())])

    def fn(batch):
        keys, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id"))
        shared = batch.column("shared")
        for lo, hi, _, names, _, _, bounds in _words(batch):
            at, name = picked(names, bounds, window)
            doc = np.searchsorted(bounds, at, "right") - 1
            ends = np.searchsorted(doc, np.arange(hi - lo + 1))
            keep = np.zeros(len(at), dtype=bool)
            for d in range(hi - lo):
                own = shared[lo + d].values.to_numpy(zero_copy_only=False).view(np.uint64)
                keep[ends[d]:ends[d + 1]] = np.isin(name[ends[d]:ends[d + 1]], own)
            at, doc = at[keep], doc[keep]
            yield {"seq": signed(grams(names, window)[at]) if len(at) else [], "key": keys[lo:hi][doc], "id": ids[lo:hi][doc], "at": at - bounds[doc]}

    return map_batches(docs, fn, schema, "seq long, key long, id long, at long")


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """(key, n_removed, kept_sha256) of rows (key, text, gone: first words of the windows to remove)."""
    schema = pa.schema([("key", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def fn(batch):
        gone = batch.column("gone")
        for lo, hi, buf, _, start, end, bounds in _words(batch):
            n, sha = [], []
            for d in range(hi - lo):
                a, b = bounds[d], bounds[d + 1]
                edge = np.zeros(b - a + window + 1, dtype=np.int64)
                at = np.unique(gone[lo + d].values.to_numpy(zero_copy_only=False))
                edge[at] += 1
                edge[at + window] -= 1
                keep = np.cumsum(edge)[:b - a] == 0
                n.append(int((~keep).sum()))
                sha.append(_kept(buf, start[a:b][keep], end[a:b][keep]))
            yield {"key": batch.column("key")[lo:hi], "n_removed": n, "kept_sha256": sha}

    return map_batches(docs, fn, schema, "key long, n_removed long, kept_sha256 string")


def _chosen(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, id, text) of the rows that stand for the given keys; equal rows come as often as they are there."""
    small = keys.count() * NAME_BYTES <= BROADCAST_BYTES
    own = keys.select("key", "id", "row_a", "row_b")
    return rows.join(F.broadcast(own) if small else own, ["id", "row_a", "row_b"]).select("key", "id", "text")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256."""
    if window < 1:
        raise ValueError("window must be positive")
    # a row is named by its id and 128 bits of its text
    rows = texts_of(docs).withColumns({"id": F.coalesce("doc_id", F.lit(NO_ID)), "row_a": F.xxhash64("text"), "row_b": F.xxhash64(F.lit(1), "text")})
    own = cut_lineage(digests(rows), "digests")
    # one key for each word sequence; a row with the smallest id stands for all its copies
    least_row = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "row_a", "row_b")).alias("least")
    first = own.filter(f"n_words >= {window}").groupBy("words_sha256").agg(least_row)
    first = cut_lineage(first.select("words_sha256", "least.*", F.monotonically_increasing_id().alias("key")), "first")
    names = cut_lineage(symbols(_chosen(rows, first), window), "symbols")
    # staged, so that both sides of the join are plain shuffles and a hot name's partition can be split
    shared = cut_lineage(names.groupBy("name").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("name"), "shared-names")
    found = cut_lineage(names.select("name", "key").join(shared, "name", "left_semi").distinct(), "shared")
    drop_staged(names)
    per_row = found.groupBy("key").agg(F.collect_list("name").alias("shared"))  # bounded by the row's own text
    part = _chosen(rows, first.join(found.select("key").distinct(), "key", "left_semi"))
    seqs = cut_lineage(windows(part.join(per_row, "key"), window), "windows")
    least = cut_lineage(seqs.groupBy("seq").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("seq", "least"), "least")
    # a set, as equal rows bring the same places; bounded by the row's own text
    gone = seqs.join(least, "seq").filter("id > least").groupBy("key").agg(F.collect_set("at").alias("gone"))
    gone = cut_lineage(gone, "gone")
    drop_staged(seqs)
    cut = _cut(_chosen(rows, first.join(gone.select("key"), "key", "left_semi")).join(gone, "key"), window)
    verdict = cut_lineage(cut.distinct(), "cut")  # once per key: equal rows are cut alike
    per_words = first.select("words_sha256", "key", F.col("id").alias("id_of_words")).join(verdict, "key", "left").drop("key")
    nothing = hashlib.sha256(b"").hexdigest()
    copy = F.coalesce(F.coalesce("doc_id", F.lit(NO_ID)) > F.col("id_of_words"), F.lit(False))
    return (own.join(per_words, "words_sha256", "left")
            .select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                    F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256")))
