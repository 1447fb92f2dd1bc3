"""Operator 8, language-model scoring by cross-entropy difference.

Two word-bigram models, matched in order, vocabulary and smoothing: the target
(documents labelled good) and the background (all documents).  Every word,
every context (the word before, or a text's start) and every (context, word)
pair is counted under its own 64-bit name, so the models grow with the corpus
and are exact up to hash collisions; the shared vocabulary is the number of
distinct words of all documents.  A document's score is the mean over its
words of the target loss less the background loss (lower is closer to the
target), its own words taken out of both models first, so no document is
judged by itself.

Counting: documents are dealt into blocks of ``BLOCK_BYTES`` of text (a longer
text is in a block of its own), one row each, in which words stand as numbers
into the block's sorted distinct names; texts are read once.  A block counts its
names and sends them, packed, to buckets by name; a bucket adds up the blocks'
counts and sends back the sums in the order of the block's sorted names.  A name
has at most one entry per block, however common it is.  Contexts need no list of
their own: a word is a context wherever it does not end a text.  The number of
buckets is ``PER_PARTITION`` times the session's shuffle partitions, which are
chosen for the size of the data, so a block sends as many messages whatever the
corpus holds.  The driver gets sums over all blocks.

Nulls: a null or wordless text has no score (nulls) and 0 words.  Labels that
are null or name no document count for nothing; a document with several labels
is a target if one says so; without any target the target model is uniform.
Repeated rows are scored alike; empty tables give empty results.  Other
columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoseries.llm.textkit import ALNUM, binary_column, joined_words, map_arrow, mix64, salt, ship_package, slices, texts_of
from geoseries.session import cut_lineage, drop_staged

PRIOR = 0.5             # added to every word's count
WEIGHT = 8.0            # words of belief in the word model when a pair is scored
BROADCAST_IDS = 2_000_000  # of eight bytes each
BLOCK_BYTES = 8 << 20   # text counted and scored at once
PER_PARTITION = 2       # buckets for each shuffle partition


def _read(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Word names and numbers of words of several texts, read in slices."""
    names, sizes = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    for lo, hi in slices(texts):
        _, own, _, _, bounds = joined_words(texts[lo:hi], ALNUM, True)
        names.append(own)
        sizes.append(np.diff(bounds))
    return np.concatenate(names), np.concatenate(sizes)


def _packed(columns: np.ndarray) -> bytes:
    """Columns of numbers, deflated byte place by byte place (small numbers are mostly zero bytes)."""
    width = columns.dtype.itemsize
    return zlib.compress(columns.reshape(-1, 1).view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def _unpacked(data: bytes, columns: int, kind=np.int64) -> np.ndarray:
    places = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(places.T).view(kind).reshape(columns, -1)


def _gaps(key: np.ndarray) -> np.ndarray:
    """Sorted names as their distances."""
    return np.diff(key, prepend=np.uint64(0)).view(np.int64)


def _bucket_edges(key: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts in sorted keys (buckets are ranges of the key's upper half)."""
    return np.searchsorted((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


BLOCKS_DDL = "block long, doc_id array<long>, size array<long>, good array<boolean>, vocabulary binary, at binary, n_words long, m_words long, n_texts long, m_texts long"
BLOCKS = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("size", pa.list_(pa.int64())), ("good", pa.list_(pa.bool_())), ("vocabulary", pa.binary()), ("at", pa.binary()),
                    *((c, pa.int64()) for c in ("n_words", "m_words", "n_texts", "m_texts"))])


def in_blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """One row a block of consecutive rows of a task: ids, numbers of words and
    target flags of its documents, the sorted distinct names of its words, and
    each word's number among them."""

    def one_task(batches):
        from pyspark import TaskContext
        block, held, bytes_held = TaskContext.get().partitionId() << 32, ([], [], []), 0

        def done():
            ids, texts, good = held
            names, size = _read(texts)
            key, at = np.unique(names, return_inverse=True)
            flags = np.array(good, dtype=bool)
            sums = [size.sum(), size[flags].sum(), (size > 0).sum(), (size[flags] > 0).sum()]
            yield pa.RecordBatch.from_pydict({"block": [block], "doc_id": [ids], "size": [size], "good": [good], "vocabulary": [_packed(_gaps(key))],
                                              "at": [_packed(at.astype(np.uint32))], **dict(zip(("n_words", "m_words", "n_texts", "m_texts"), ([int(x)] for x in sums), strict=True))}, schema=BLOCKS)

        for b in batches:
            for doc_id, text, good in zip(b.column("doc_id").to_pylist(), binary_column(b, "text"), b.column("target").to_pylist(), strict=True):
                n = len(text or b"")
                if held[0] and bytes_held + n > block_bytes:
                    yield from done()
                    block, held, bytes_held = block + 1, ([], [], []), 0
                for own, x in zip(held, (doc_id, text, good), strict=True):
                    own.append(x)
                bytes_held += n
        if held[0]:
            yield from done()

    return map_arrow(rows.select("doc_id", "text", "target"), one_task, BLOCKS_DDL)


class Block:
    """A block's words and pairs in the order of their names."""

    def __init__(self, row: dict):
        self.size = np.array(row["size"], dtype=np.int64)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.good = np.array(row["good"], dtype=bool)[self.doc]
        self.words = np.cumsum(_unpacked(row["vocabulary"], 1)[0].view(np.uint64), dtype=np.uint64)
        self.at = _unpacked(row["at"], 1, np.uint32)[0].astype(np.int64)
        n = len(self.words)
        # the word before; 0 at a text's start
        self.before = np.concatenate([[0], self.at[:-1] + 1]) if len(self.at) else self.at
        first = np.cumsum(self.size) - self.size
        self.before[first[self.size > 0]] = 0
        self.ends = np.zeros(len(self.at), dtype=bool)
        self.ends[(first + self.size - 1)[self.size > 0]] = True
        local, pair = np.unique(self.before * max(1, n) + self.at, return_inverse=True)
        left = np.concatenate([np.zeros(1, dtype=np.uint64), self.words])[local // max(1, n)]
        names = mix64(left * salt(801) + self.words[local % max(1, n)] * salt(802)) if n else self.words
        order = np.argsort(names, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.pairs, self.pair = names[order], place[pair] if n else pair

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of words: times in all documents and in the target, and as a text's end; of pairs: times in both."""
        count = lambda at, n, mask: np.bincount(at[mask], minlength=n)
        every = np.ones(len(self.at), dtype=bool)
        words = np.array([count(self.at, len(self.words), m) for m in (every, self.good, self.ends, self.ends & self.good)], dtype=np.int64)
        return words, np.array([count(self.pair, len(self.pairs), m) for m in (every, self.good)], dtype=np.int64)


DDL = "block long, bucket int, words binary, pairs binary, distinct_words long"
SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("pairs", pa.binary()), ("distinct_words", pa.int64())])
COLUMNS = {"words": 4, "pairs": 2}


def messages(blocks: DataFrame, buckets: int) -> DataFrame:
    """Per block and bucket that it has names of: the names and the block's counts."""

    def one_task(batches):
        for b in batches:
            for row in b.to_pylist():
                own = Block(row)
                counts = dict(zip(COLUMNS, own.counts(), strict=True))
                edges = {"words": _bucket_edges(own.words, buckets), "pairs": _bucket_edges(own.pairs, buckets)}
                keys = {"words": own.words, "pairs": own.pairs}
                for j in range(buckets):
                    parts = {k: slice(e[j], e[j + 1]) for k, e in edges.items()}
                    if any(p.start < p.stop for p in parts.values()):
                        yield pa.RecordBatch.from_pydict({"block": [row["block"]], "bucket": [j], **{k: [_packed(np.vstack([_gaps(keys[k][p]), counts[k][:, p]]))] for k, p in parts.items()}, "distinct_words": [0]}, schema=SCHEMA)

    return map_arrow(blocks.select("block", "size", "good", "vocabulary", "at"), one_task, DDL)


def summed_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """Per block and bucket the counts over all documents of the block's sorted
    words and pairs of that bucket; ``distinct_words`` adds up to the vocabulary."""

    def add(table: pa.Table) -> pa.Table:
        out = {"block": table.column("block"), "bucket": table.column("bucket")}
        for kind, n in COLUMNS.items():
            own = [_unpacked(x.as_py(), n + 1) for x in table.column(kind)]
            keys = [np.cumsum(x[0].view(np.uint64), dtype=np.uint64) for x in own]
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros((n, len(key)), dtype=np.int64)
            for c in range(n):
                np.add.at(total[c], at, np.concatenate([x[1 + c] for x in own]))
            edges = np.cumsum([0, *map(len, keys)])
            out[kind] = [_packed(np.ascontiguousarray(total[:, at[a:b]])) for a, b in zip(edges, edges[1:], strict=False)]
            if kind == "words":
                out["distinct_words"] = [len(key), *[0] * (len(keys) - 1)]
        return pa.table(out, schema=SCHEMA)

    return messages(blocks, buckets).groupBy("bucket").applyInArrow(add, DDL)


def losses(counts: tuple[np.ndarray, ...], own: tuple[np.ndarray, ...], words: int, n_own: np.ndarray, size: int) -> np.ndarray:
    """-log P(word | context) of each word under one model of ``words`` words
    over ``size`` distinct ones, less its document's own counts."""
    word, context, pair = (c - o for c, o in zip(counts, own, strict=True))
    single = (word + PRIOR) / (words - n_own + PRIOR * size)
    return -np.log((pair + WEIGHT * single) / (context + WEIGHT))


def score(blocks: DataFrame, sums: DataFrame, buckets: int, vocabulary: int, totals: tuple) -> DataFrame:
    """Per document: doc_id, n_words, target_loss, background_loss, score.
    ``totals``: words and wordy texts of all documents and of the target."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])

    def fn(table: pa.Table, back: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        own = Block(row)
        n = {"words": len(own.words), "pairs": len(own.pairs)}
        total = {k: np.zeros((c, n[k]), dtype=np.int64) for k, c in COLUMNS.items()}
        edges = {"words": _bucket_edges(own.words, buckets), "pairs": _bucket_edges(own.pairs, buckets)}
        for kind, c in COLUMNS.items():
            for j, data in zip(back.column("bucket").to_pylist(), back.column(kind), strict=True):
                total[kind][:, edges[kind][j]:edges[kind][j + 1]] = _unpacked(data.as_py(), c)

        def in_document(what: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
            """(document, thing) numbers of the words, and how often each occurs."""
            _, at, times = np.unique(own.doc * max(1, most) + what, return_inverse=True, return_counts=True)
            return at, times

        word_at, word_times = in_document(own.at, n["words"])
        pair_at, pair_times = in_document(own.pair, n["pairs"])
        # a document's last word is a context once less than it is a word
        context_times = word_times.copy()
        np.subtract.at(context_times, word_at[own.ends], 1)
        start = own.before == 0
        last = np.flatnonzero(~start) - 1  # the word before each word that has one
        each = []
        for model, taken in ((1, own.good), (0, np.ones(len(own.at), dtype=bool))):
            context, mine = np.empty(len(own.at), dtype=np.int64), np.ones(len(own.at), dtype=np.int64)
            words, ends = total["words"][model], total["words"][2 + model]
            context[start] = totals[2 + model]
            context[~start] = (words - ends)[own.at[last]]
            mine[~start] = context_times[word_at[last]]
            counts = (words[own.at], context, total["pairs"][model][own.pair])
            less = tuple(np.where(taken, x, 0) for x in (word_times[word_at], mine, pair_times[pair_at]))
            loss = losses(counts, less, totals[model], np.where(taken, own.size[own.doc], 0), vocabulary)
            each.append(np.bincount(own.doc, weights=loss, minlength=len(own.size)) / np.maximum(own.size, 1))
        columns = [pa.array(x, mask=own.size == 0) for x in (each[0], each[1], each[0] - each[1])]
        return pa.table([pa.array(row["doc_id"], pa.int64()), pa.array(own.size), *columns], schema=schema)

    ship_package(blocks.sparkSession)
    rows = blocks.select("block", "doc_id", "size", "good", "vocabulary", "at")
    return rows.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(fn, "doc_id long, n_words long, target_loss double, background_loss double, score double")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """Scores of all documents; documents with a label of quality 1 are the target."""
    buckets = buckets or PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("target", F.lit(True))
    small = good.count() <= BROADCAST_IDS
    rows = texts_of(docs).join(F.broadcast(good) if small else good, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    blocks = cut_lineage(in_blocks(rows, block_bytes), "blocks")  # the blocks stay the same in every pass
    sums = cut_lineage(summed_counts(blocks, buckets), "sums")
    n = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "m_words", "n_texts", "m_texts")]).first()
    vocabulary = sums.agg(F.sum("distinct_words")).first()[0] or 0
    return score(blocks, sums, buckets, vocabulary, tuple(n))
