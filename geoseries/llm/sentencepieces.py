"""Operator 5, SentencePiece encoding and decoding by a max-plus parallel scan.

The model at hand is a BPE one.  Its segmentation of a text is the one path
through the lattice of pieces in which every two neighbours are compatible
(each would be encoded as itself next to the other), so it is a max-plus
problem with weights 0 (compatible) and minus infinity; results equal the
library's.  A giant text is cut into chunks at fixed places.  A boundary state
is a piece that covers the character before the cut; a chunk yields a transfer
matrix (entry state x exit state); matrices are combined associatively, which
leaves one state per cut, and every chunk is then backtraced on its own.

Inside a chunk, no piece joins two characters that are neighbours in no piece
of the vocabulary (a word end and the next space, for one).  Those places pin
the path, so a matrix is the sum of an entry vector and an exit vector there;
only a chunk without any is worked out in full.

Texts up to ``chunk_chars`` are encoded in place, word by word through a bounded
cache.  Null gives null ids; empty text no ids.  Repeated rows are encoded
alike; an empty table gives an empty result.  Other columns are not read.
Decoding gives back the text, except that the model itself reads U+2581 as a
space.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoseries.llm.textkit import map_arrow, ship_package, slices, texts_of
from geoseries.session import cut_lineage

CHUNK_CHARS = 32768
CACHE_BYTES = 24 << 20  # of remembered words and their ids, with what a dictionary needs for them
ENTRY_BYTES = 230       # of a remembered word besides its characters and ids
CACHED_CHARS = 48
SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
NEVER = -np.inf


def model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """One loaded model: encoding of words through a bounded cache, decoding, lattice facts."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = m = SentencePieceProcessor(model_file=path)
        if m.normalize("a  b") != f"{SPACE}a{SPACE}{SPACE}b":
            raise ValueError("the model must keep text as it is and add a leading space")
        ids = range(m.get_piece_size())
        text = {i: m.id_to_piece(i) for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
        self.pieces = set(text.values())
        self.longest = max(map(len, self.pieces))
        self.joined = {p[i:i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.by_word = not any(x[1] == SPACE != x[0] for x in self.joined)
        self.barrier = next(c for c in "\n\t\r\x00" if not any(c in p for p in self.pieces))  # joins with nothing
        self.lead = len(m.encode(self.barrier))
        self.surface = [text.get(i, "").encode() if i in text else bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else b"" for i in ids]
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, segments: set[str]) -> list[str]:
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        new = [s for s in segments if s not in self.known]
        for lo, hi in slices(new, 1 << 18):
            for s, ids in zip(new[lo:hi], self.model.encode([s[1:].replace(SPACE, " ") for s in new[lo:hi]], num_threads=1), strict=True):
                self.known[s] = np.array(ids, dtype="<i4").tobytes() if len(s) > 1 or not s else self._space()
                if len(s) <= CACHED_CHARS:
                    self.held += ENTRY_BYTES + len(s) + 4 * len(ids)
        return new

    def _space(self) -> bytes:
        """A lone space: the library gives the empty text no pieces."""
        return np.array(self.raw(SPACE), dtype="<i4").tobytes()

    def raw(self, text: str) -> list[int]:
        """Ids of a piece of normalised text, no leading space added."""
        return self.model.encode(self.barrier + text.replace(SPACE, " "))[self.lead:] if text else []

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids (little-endian int32) of whole texts."""
        if not self.by_word:
            return [None if t is None else np.array(self.model.encode(t), dtype="<i4").tobytes() for t in texts]
        cut = [SEGMENT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = self._learn(set().union(*cut))
        out = [None if t is None else b"".join(map(self.known.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]
        for s in new:
            if len(s) > CACHED_CHARS:
                del self.known[s]
        return out

    def decode(self, packed: bytes | None) -> str | None:
        """The text of packed ids: byte pieces by their byte, the leading space dropped."""
        if packed is None:
            return None
        raw = b"".join(map(self.surface.__getitem__, np.frombuffer(packed, dtype="<i4").tolist()))
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    # ---- the lattice around a cut -------------------------------------------------

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Pieces [a, b) that may cover the character before the cut."""
        out = []
        for a in range(cut - 1, max(-1, cut - 1 - self.longest), -1):
            if a < cut - 1 and text[a:a + 2] not in self.joined:
                break
            for b in range(cut, min(len(text), a + self.longest) + 1):
                if b > cut and text[b - 2:b] not in self.joined:
                    break
                if b == a + 1 or text[a:b] in self.pieces:
                    out.append((a, b))
        return sorted(out)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """The encoded spans of a short stretch of normalised text (bytes of a character are one span)."""
        out, at, held = [], 0, b""
        for i in self.raw(text):
            if self.model.is_byte(i):
                held += self.surface[i]
                try:
                    n = len(held.decode())
                except UnicodeDecodeError:
                    continue
                held = b""
            else:
                n = len(self.surface[i].decode())
            out.append((at, at + n))
            at += n
        return out

    def free(self, text: str, lo: int, hi: int, back: bool = False) -> int | None:
        """First (last) place in lo..hi that no piece can cross."""
        return next((p for p in (range(hi, lo - 1, -1) if back else range(lo, hi + 1)) if 0 < p < len(text) and text[p - 1:p + 1] not in self.joined), None)

    def matrix(self, text: str, lo: int, hi: int, first: bool, last: bool) -> tuple[list, list, np.ndarray]:
        """Entry and exit states and transfer weights of the chunk lo..hi of ``text``."""
        entry = [(0, 0)] if first else self.states(text, lo)
        leave = [(hi, hi)] if last else self.states(text, hi)
        begin, end = self.free(text, lo, hi), self.free(text, lo, hi - 1, back=True)
        if begin is not None and end is not None and begin <= end:
            head = [0.0 if first or self.spans(text[a:begin])[:1] == [(0, b - a)] else NEVER for a, b in entry]
            tail = [0.0 if last or self.spans(text[end:b])[-1:] == [(a - end, b - end)] else NEVER for a, b in leave]
            return entry, leave, np.add.outer(np.array(head), np.array(tail))
        out = np.full((len(entry), len(leave)), NEVER)
        for i, (a, b) in enumerate(entry):
            for j, (c, d) in enumerate(leave):
                if first and last:
                    out[i, j] = 0.0
                elif (a, b) == (c, d):
                    out[i, j] = 0.0
                elif (first or b <= c or last) and (b <= c or last):
                    got = self.spans(text[a:d])
                    if (first or got[:1] == [(0, b - a)]) and (last or got[-1:] == [(c - a, d - a)]):
                        out[i, j] = 0.0
        return entry, leave, out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus matrix product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def prefixes(mats: list[np.ndarray]) -> list[np.ndarray]:
    """All products of leading matrices, by the associative scan (pairs first)."""
    if len(mats) <= 1:
        return list(mats)
    half = prefixes([product(mats[i], mats[i + 1]) for i in range(0, len(mats) - 1, 2)])
    out = [mats[0]]
    for i in range(1, len(mats)):
        out.append(half[i // 2] if i % 2 else product(half[i // 2 - 1], mats[i]))
    return out


def resolve(mats: list[np.ndarray]) -> list[int]:
    """The state at each inner cut: the one on a path of weight 0 from start to end."""
    ahead = prefixes(mats)
    behind = prefixes([m.T for m in reversed(mats)])[::-1]
    out = []
    for i in range(len(mats) - 1):
        both = ahead[i][0] + behind[i + 1][0]
        best = int(np.argmax(both))
        if both[best] == NEVER:
            raise ValueError("no segmentation crosses a cut")
        out.append(best)
    return out


def _cut(rows: DataFrame, size: int) -> DataFrame:
    """Chunks (row_no, doc_id, chunk_no, part, lead, last) with a margin of context on both sides."""
    margin = 64  # more than the longest piece, checked when the model is loaded
    schema = pa.schema([("row_no", pa.int64()), ("doc_id", pa.int64()), ("chunk_no", pa.int32()), ("lead", pa.int32()), ("size", pa.int32()), ("last", pa.bool_()), ("part", pa.string())])

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                text = SPACE + b.column("text")[row].as_py().replace(" ", SPACE)
                n = -(-len(text) // size)
                for k in range(n):
                    lo, hi = k * size, min(len(text), (k + 1) * size)
                    yield pa.RecordBatch.from_pydict({"row_no": b.column("row_no")[row:row + 1], "doc_id": b.column("doc_id")[row:row + 1], "chunk_no": [k], "lead": [min(margin, lo)],
                                                      "size": [hi - lo], "last": [k == n - 1], "part": [text[max(0, lo - margin):hi + margin]]}, schema=schema)

    cut = map_arrow(rows, run, "row_no long, doc_id long, chunk_no int, lead int, size int, last boolean, part string")
    return cut.repartition("row_no", "chunk_no")


def _matrices(chunks: DataFrame, path: str) -> DataFrame:
    schema = pa.schema([("row_no", pa.int64()), ("chunk_no", pa.int32()), ("start", pa.list_(pa.int32())), ("stop", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64()))])

    def run(batches):
        pieces = None
        for b in batches:
            pieces = pieces or Pieces(path)
            if pieces.longest >= 64:
                raise ValueError("pieces of 64 characters or more need a wider margin")
            for r in b.to_pylist():
                lo, hi = r["lead"], r["lead"] + r["size"]
                entry, leave, weights = pieces.matrix(r["part"], lo, hi, r["chunk_no"] == 0, r["last"])
                yield pa.RecordBatch.from_pydict({"row_no": [r["row_no"]], "chunk_no": [r["chunk_no"]], "start": [[e - lo for _, e in entry]], "stop": [[e - hi for _, e in leave]], "weights": [weights.ravel().tolist()]}, schema=schema)

    return map_arrow(chunks, run, "row_no long, chunk_no int, start array<int>, stop array<int>, weights array<double>")


def _resolved(matrices: DataFrame) -> DataFrame:
    """Per chunk, where its own pieces begin and end, relative to its cuts."""
    ship_package(matrices.sparkSession)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk_no").drop_duplicates("chunk_no")
        mats = [np.array(w).reshape(len(s), len(t)) for w, s, t in zip(group["weights"], group["start"], group["stop"], strict=True)]
        at = resolve(mats)
        stops = [t[k] for t, k in zip(group["stop"], at, strict=False)] + [0]
        return pd.DataFrame({"row_no": group["row_no"], "chunk_no": group["chunk_no"], "begin": [0, *stops[:-1]], "end": stops})

    return matrices.groupBy("row_no").applyInPandas(one, "row_no long, chunk_no int, begin int, end int")


def _backtrace(chunks: DataFrame, resolved: DataFrame, path: str) -> DataFrame:
    schema = pa.schema([("row_no", pa.int64()), ("doc_id", pa.int64()), ("chunk_no", pa.int32()), ("packed", pa.binary())])

    def run(batches):
        pieces = None
        for b in batches:
            pieces = pieces or Pieces(path)
            for r in b.to_pylist():
                own = r["part"][r["lead"] + r["begin"]:r["lead"] + r["size"] + r["end"]]
                yield pa.RecordBatch.from_pydict({"row_no": [r["row_no"]], "doc_id": [r["doc_id"]], "chunk_no": [r["chunk_no"]], "packed": [np.array(pieces.raw(own), dtype="<i4").tobytes()]}, schema=schema)

    return map_arrow(chunks.join(resolved, ["row_no", "chunk_no"]), run, "row_no long, doc_id long, chunk_no int, packed binary")


#: What a row's ids can be given as; ``packed``: little-endian int32, ``text``: decoded from them.
FORMS = {"packed": pa.binary(), "ids": pa.list_(pa.int32()), "text": pa.string()}


def _forms(pieces: Pieces, packed: list[bytes | None], forms: tuple[str, ...]) -> dict:
    """The wanted forms of some rows' ids."""
    how = {"packed": lambda p: p, "ids": lambda p: None if p is None else np.frombuffer(p, dtype="<i4"), "text": pieces.decode}
    return {f: pa.array([how[f](p) for p in packed], FORMS[f]) for f in forms}


def encode(docs: DataFrame, path: str | None = None, chunk_chars: int = CHUNK_CHARS, forms: tuple[str, ...] = ("packed",)) -> DataFrame:
    """Per row: doc_id, the ids in each of ``forms`` (null for null text), n_chunks.
    Encoding, decoding and unpacking share one Python worker and one model."""
    path = path or model_path()
    rows = texts_of(docs)
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars
    schema = pa.schema([("doc_id", pa.int64()), *[(f, FORMS[f]) for f in forms], ("n_chunks", pa.int32())])
    ddl = "doc_id long, " + "".join({"packed": "packed binary, ", "ids": "ids array<int>, ", "text": "text string, "}[f] for f in forms) + "n_chunks int"

    def run(batches):
        pieces = None
        for b in batches:
            pieces = pieces or Pieces(path)
            texts = b.column("text").to_pylist()
            for lo, hi in slices(texts, 1 << 20):
                got = _forms(pieces, pieces.encode(texts[lo:hi]), forms)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")[lo:hi], **got, "n_chunks": [1] * (hi - lo)}, schema=schema)

    def join(batches):
        pieces = None
        for b in batches:
            pieces = pieces or Pieces(path)
            for row in range(b.num_rows):
                parts = b.column("parts")[row].as_py()
                got = _forms(pieces, [b"".join(p["packed"] for p in parts)], forms)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")[row:row + 1], **got, "n_chunks": [len(parts)]}, schema=schema)

    short = map_arrow(rows.filter(~long), run, ddl)
    # row numbers are taken once: later passes read the written chunks
    chunks = cut_lineage(_cut(rows.filter(long).withColumn("row_no", F.monotonically_increasing_id()), chunk_chars), "chunks")
    resolved = cut_lineage(_resolved(_matrices(chunks, path)), "cuts")
    parts = (_backtrace(chunks, resolved, path).groupBy("row_no", "doc_id")
             .agg(F.array_sort(F.collect_list(F.struct("chunk_no", "packed"))).alias("parts")).select("doc_id", "parts"))
    return short.unionByName(map_arrow(parts, join, ddl))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encode``'s rows with the text of their ids as a further column."""
    path = path or model_path()

    def run(batches):
        pieces = None
        for b in batches:
            pieces = pieces or Pieces(path)
            packed = b.column(b.schema.get_field_index("packed")).to_pylist()
            for lo, hi in slices(packed, 1 << 20):
                texts = pa.array([pieces.decode(p) for p in packed[lo:hi]], pa.string())
                yield pa.RecordBatch.from_arrays([c[lo:hi] for c in b.columns] + [texts], names=[*b.schema.names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return map_arrow(encoded, run, f"{fields}, text string")


def unpack(encoded: DataFrame) -> DataFrame:
    """``encode``'s rows, all columns, with ids array<int> in place of packed."""
    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("packed")
            packed = b.column(at).to_pylist()
            for lo, hi in slices(packed, 1 << 22):
                ids = pa.array([None if p is None else np.frombuffer(p, dtype="<i4") for p in packed[lo:hi]], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([ids if i == at else c[lo:hi] for i, c in enumerate(b.columns)], names=[("ids" if n == "packed" else n) for n in b.schema.names])

    fields = ", ".join("ids array<int>" if f.name == "packed" else f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return map_arrow(encoded, run, fields)
