"""Operator 10, token counts with overlap resynchronisation.

Texts up to ``chunk_chars`` are counted in place.  A longer text is cut into
overlapping chunks that are encoded independently, with offsets, in as many
tasks; two neighbours are spliced at the first position inside their overlap
where both encodings start a token and the text goes from a non-space to a
space character, or from letters to digits or marks, digits to letters or marks,
marks (but the apostrophe) to letters or digits.  Such a position is proven
stable: the pre-tokenizer reads from left to right, a run of one class ends
where another begins, and what follows is split without regard to the left, so
tokens before and after it do not depend on each other.  (A special string over
such a place is whole in one of the two chunks, which then starts no token
there.)  The tokenizer is checked for this when it is loaded.  Where an
overlap holds no such position, the document goes into a further round with
overlaps ``WIDEN`` times as long, in the end one chunk.  The step between chunks
is never shorter than the overlap, so a round encodes no text more than twice.

In-place counts use the same fact: the text is cut at every such position, and
the library encodes each distinct piece once per task (a bounded cache).

Nulls count as empty: 0 bytes, 0 tokens.  Special strings inside texts are
treated as the library does by default.  Each row is counted for itself, so
repeated rows and ids are fine; an empty table gives an empty result.  Other
columns are not read.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoseries.llm.textkit import map_arrow, slices, texts_of
from geoseries.session import cut_lineage

CHUNK_CHARS = 32768
OVERLAP = 1024
WIDEN = 16
CACHE = 200_000         # pieces remembered per task
CACHED_CHARS = 48       # longer pieces are encoded each time

# Characters with the Unicode property White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[{SPACES}]+[^{SPACES}]*|[^{SPACES}]+")
# Letters, digits and marks on whose classes all Unicode versions agree.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0410-\u044f\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
MARKS = '!"#$%&()*+,./:;<=>?@\\[\\]^_`{|}~\\\\\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f-'
STABLE = re.compile(f"(?<=[^{SPACES}])[{SPACES}]|(?<=[{LETTERS}])[0-9'{MARKS}]|(?<=[0-9])[{LETTERS}'{MARKS}]|(?<=[{MARKS}])[{LETTERS}0-9]")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Tokens:
    """One loaded tokenizer with its cache of piece lengths (one per task)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}
        self._check()

    def _check(self) -> None:
        """The facts that splicing rests on: spaces are never joined to what stands
        before them, nothing is added, and no special string starts or ends in a space."""
        normalizer = self.tokenizer.normalizer
        for text in ("a b", "a\nb", "! \t y", "é  z", "a\u00a0b", "é1", "ab中,", "1а", "2.", "%ひ", "한。", "。3", "a'", "7'"):
            at = STABLE.search(text).start()
            whole = [t[1] for t in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
            if normalizer is not None and normalizer.normalize_str(text) != text or not any(lo == at for lo, _ in whole):
                raise ValueError("the tokenizer must keep texts as they are and start a word at each space after a non-space and at each change of class")
        if any(re.search(f"[{SPACES}]", t.content) for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens must hold no space")

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > CACHE:
            self.known = {}
        cut = [PIECE.findall(t) for t in texts]
        new = [p for p in set().union(*cut) if p not in self.known]
        for lo, hi in slices(new, 1 << 18):
            found = self.tokenizer.encode_batch_fast(new[lo:hi], add_special_tokens=False)
            self.known.update(zip(new[lo:hi], map(len, found), strict=True))
        out = [sum(map(self.known.__getitem__, pieces)) for pieces in cut]
        for p in new:
            if len(p) > CACHED_CHARS:
                del self.known[p]
        return out

    def boundaries(self, text: str, *stretches: tuple[int, int]) -> tuple[int, list[list[tuple[int, int]]]]:
        """Tokens in all; (position, tokens before it) of the stable positions of each stretch."""
        enc = self.tokenizer.encode(text, add_special_tokens=False)
        before = {}
        for n, (start, _) in enumerate(enc.offsets):
            before.setdefault(start, n)
        return len(enc), [[(p, before[p]) for m in STABLE.finditer(text, lo, hi) if (p := m.start()) in before] for lo, hi in stretches]


def _count_short(rows: DataFrame, path: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_chunks", pa.int32())])

    def run(batches):
        tokens = None
        for b in batches:
            tokens = tokens or Tokens(path)
            texts, sizes = b.column("text").to_pylist(), b.column("n_bytes")
            for lo, hi in slices(texts, 1 << 20):
                counts = tokens.count(texts[lo:hi])
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")[lo:hi], "n_bytes": sizes[lo:hi], "n_tokens": counts, "n_chunks": [1] * (hi - lo)}, schema=schema)

    return map_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long, n_chunks int")


def _cut(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """Overlapping chunks (row_no, doc_id, n_bytes, chunk_no, start, last, part), dealt over all tasks."""
    schema = pa.schema([("row_no", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("part", pa.string())])

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                text = b.column("text")[row].as_py()
                head = [b.column(c)[row].as_py() for c in ("row_no", "doc_id", "n_bytes")]
                n = max(1, -(-(len(text) - overlap) // size))
                for lo in range(0, n, 16):
                    ks = range(lo, min(n, lo + 16))
                    yield pa.RecordBatch.from_arrays([pa.array([h] * len(ks), t) for h, t in zip(head, schema.types, strict=False)] + [
                        pa.array(list(ks), pa.int32()), pa.array([k == n - 1 for k in ks]),
                        pa.array([text[k * size:] if k == n - 1 else text[k * size:(k + 1) * size + overlap] for k in ks], pa.string())], schema=schema)

    cut = map_arrow(rows, run, "row_no long, doc_id long, n_bytes long, chunk_no int, last boolean, part string")
    return cut.repartition("row_no", "chunk_no")


def _encode(cut: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """Tokens of each chunk and its stable positions in the overlap with the chunk before (head) and after (tail)."""
    fields = ["row_no", "doc_id", "n_bytes", "chunk_no", "last"]
    schema = pa.schema([("row_no", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("total", pa.int64())]
                       + [(c, pa.list_(pa.int64())) for c in ("head_at", "head_n", "tail_at", "tail_n")])

    def run(batches):
        tokens = None
        for b in batches:
            tokens = tokens or Tokens(path)
            for row in range(b.num_rows):
                k, last = b.column("chunk_no")[row].as_py(), b.column("last")[row].as_py()
                part = b.column("part")[row].as_py()
                total, found = tokens.boundaries(part, (0, overlap if k else 0), (len(part) if last else size, len(part)))
                head, tail = ([(p + k * size, n) for p, n in x] for x in found)
                yield pa.RecordBatch.from_arrays([b.column(c)[row:row + 1] for c in fields] + [
                    pa.array([total], pa.int64())] + [pa.array([[x[i] for x in own]], pa.list_(pa.int64())) for own in (head, tail) for i in (0, 1)], schema=schema)

    return map_arrow(cut, run, "row_no long, doc_id long, n_bytes long, chunk_no int, last boolean, total long, head_at array<long>, head_n array<long>, tail_at array<long>, tail_n array<long>")


def _splice(encoded: DataFrame) -> DataFrame:
    """Per document: tokens between splices; ok is false where two neighbours share no stable position."""
    order = Window.partitionBy("row_no").orderBy("chunk_no")
    at = F.array_min(F.array_intersect("tail_at", "next_at"))
    n_of = lambda keys, values, key: F.element_at(F.map_from_arrays(keys, values), key)
    return (encoded.withColumns({"next_at": F.lead("head_at").over(order), "next_n": F.lead("head_n").over(order)})
            .withColumn("at", F.when(~F.col("last"), at))
            .withColumn("own", F.when(F.col("last"), F.col("total"))
                        .when(F.col("at").isNotNull(), n_of("tail_at", "tail_n", F.col("at")) - n_of("next_at", "next_n", F.col("at"))))
            .groupBy("row_no").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum("own").alias("n_tokens"),
                                   F.count("*").cast("int").alias("n_chunks"), F.bool_and(F.col("own").isNotNull()).alias("ok")))


def count_tokens(docs: DataFrame, path: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP, limit: int = 512) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), n_chunks."""
    path = path or tokenizer_path()
    rows = texts_of(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    long = F.length("text") > chunk_chars
    parts = [_count_short(rows.filter(~long), path)]
    # row numbers are taken once: later rounds read the written rows
    huge = cut_lineage(rows.filter(long).withColumn("row_no", F.monotonically_increasing_id()), "long_texts")
    longest = huge.agg(F.max(F.length("text"))).first()[0] or 0
    while longest:
        step = max(chunk_chars, overlap)
        done = cut_lineage(_splice(_encode(_cut(huge, step, overlap), path, step, overlap)), "spliced")
        parts.append(done.filter("ok").drop("row_no", "ok"))
        failed = done.filter(~F.col("ok")).select("row_no")
        if overlap >= longest or failed.isEmpty():
            break
        huge = huge.join(failed, "row_no", "left_semi")
        overlap *= WIDEN
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")
