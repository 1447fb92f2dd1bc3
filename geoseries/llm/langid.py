"""Operator 1, language identification with word-first backoff.

Known words are scored by their per-language log frequency.  An unseen word is
covered from left to right by the longest known character n-gram at each place
(five letters down to one, with word-edge marks), each scored by its
per-language log frequency; letters that no n-gram covers say nothing.  A run of
more than ``LONG`` letters (text without spaces) is never a known word: it is
covered as a whole and counts as one word per ``LONG`` letters or part of it.  A
document's language has the highest mean score of its words; ``score`` is the
posterior of that language over the learned ones (softmax of the summed
scores, tempered so that long texts do not all read 1).

Learning: whole texts of ``sample_rows`` labelled rows in expectation (chosen by
a hash of the id).  Every language has an equal share of them, what small ones
leave goes to the others, and no share is under ``LANG_ROWS`` rows, so that a
language is learned however many rows the others have.  Of more than
``MAX_LANGUAGES`` labels the most frequent ones are learned, ties in the order
of their names.  The model's words and
n-grams are shared out alike: ``max_words`` and ``max_grams``, or ``LANG_UNITS``
for each language if that is more, its most frequent ones.  What a language
never showed is equally unlikely in all of them.  Prediction sees the text only.

Nulls and texts without a letter give ``und`` with score 0, as does every text
when nothing was learned.  A null label or id is not learned from.  Ties go to
the language that sorts first.  Repeated rows are predicted alike; an empty
table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoseries.llm.textkit import map_arrow, slices, texts_of

SAMPLE_ROWS = 8_000
MAX_WORDS = 60_000
MAX_GRAMS = 60_000
MAX_LANGUAGES = 500     # labels that are learned at most, the most frequent ones (a dirty label column may hold millions)
LANG_ROWS = 500         # rows of each language at least (all of them if it has fewer)
LANG_UNITS = 2_000      # words, and n-grams, of each language at least
GRAM = 5
SMOOTH = 0.5
TEMPER = 8.0            # words after which the evidence of a text is divided by its square root
LETTERS = regex.compile(r"\p{L}+")
CACHE = 100_000         # unseen words remembered per task
LONG = 64               # letters of a run that is taken for a word
SLICE = 1 << 16         # letters of a run whose n-grams are counted at once
PART = 50_000           # words of a text looked up at once


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def grams_of(word: str) -> Counter:
    marked, out = f"^{word}$", Counter()
    for lo in range(0, len(marked), SLICE):  # an n-gram belongs to the slice it starts in
        part, starts = marked[lo:lo + SLICE + GRAM - 1], min(SLICE, len(marked) - lo)
        out.update(part[i:i + n] for n in range(1, GRAM + 1) for i in range(min(starts, len(part) - n + 1)))
    return out


def pieces(word: str) -> int:
    """How many words a run of letters counts as."""
    return -(-len(word) // LONG)


def _counts(sample: DataFrame) -> DataFrame:
    """(kind, unit, lang, n) of words and n-grams, summed per slice before the shuffle."""
    schema = pa.schema([("kind", pa.string()), ("unit", pa.string()), ("lang", pa.string()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for lo, hi in slices(texts, 1 << 20):
                words: Counter = Counter()
                for t, lang in zip(texts[lo:hi], langs[lo:hi], strict=True):
                    words.update((w, lang) for w in words_of(t))
                grams: Counter = Counter()
                for (w, lang), n in words.items():
                    for g, k in grams_of(w).items():
                        grams[g, lang] += k * n
                words = Counter({(w, lang): n for (w, lang), n in words.items() if len(w) <= LONG})
                for kind, own in (("word", words), ("gram", grams)):
                    yield pa.RecordBatch.from_pydict({"kind": [kind] * len(own), "unit": [u for u, _ in own], "lang": [x for _, x in own], "n": list(own.values())}, schema=schema)

    counts = map_arrow(sample, run, "kind string, unit string, lang string, n long")
    return counts.groupBy("kind", "unit", "lang").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies of the kept words and n-grams, one column per language."""

    def __init__(self, langs: list[str], words: dict[str, int], word_table: np.ndarray, grams: dict[str, int], gram_table: np.ndarray):
        self.langs, self.words, self.word_table, self.grams, self.gram_table = langs, words, word_table, grams, gram_table
        self.index: dict[str, int] = {}

    def _reset(self) -> None:
        """The known words, with room for ``CACHE`` unseen ones scored by backoff."""
        self.index = dict(self.words)
        self.rows = np.vstack([self.word_table, np.zeros((CACHE + 1, len(self.langs)))])

    def _rows_of(self, words: list[str]) -> np.ndarray:
        """One row of log frequencies per distinct word given."""
        if not self.index or len(self.index) + len(words) > len(self.rows):
            self._reset()
        index, rows = self.index, self.rows
        for w in set(words):
            if w not in index:
                if len(index) + 1 >= len(rows):  # a text with more unseen words than the cache holds
                    return np.array([self.word_table[self.words[w]] if w in self.words else self.backoff(w) for w in words])
                rows[len(index)] = self.backoff(w)
                index[w] = len(index)
        return rows[list(map(index.__getitem__, words))]

    def backoff(self, word: str) -> np.ndarray:
        """Mean log frequency of the longest known n-grams that cover an unseen
        word; for a long run the sum of the means of its parts."""
        marked, i = f"^{word}$", 0
        step = -(-len(marked) // pieces(word))
        whole, total, n = np.zeros(len(self.langs)), np.zeros(len(self.langs)), 0
        end = step
        while i < len(marked):
            for size in range(min(GRAM, len(marked) - i), 0, -1):
                g = self.grams.get(marked[i:i + size])
                if g is not None:
                    total += self.gram_table[g]
                    n += 1
                    i += size
                    break
            else:
                i += 1
            if i >= end or i >= len(marked):
                whole += total / n if n else total
                total, n, end = np.zeros(len(self.langs)), 0, end + step
        return whole

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.langs:
            return "und", 0.0
        short = [w for w in words if len(w) <= LONG]
        total = sum((self._rows_of(short[i:i + PART]).sum(axis=0) for i in range(0, len(short), PART)), np.zeros(len(self.langs)))
        total = sum((self.backoff(w) for w in words if len(w) > LONG), total)
        scaled = total / max(1.0, (sum(map(pieces, words)) / TEMPER) ** 0.5)
        p = np.exp(scaled - scaled.max())
        best = int(np.argmax(total))
        return self.langs[best], float(p[best] / p.sum())


def _table(units: dict[str, dict[str, int]], langs: list[str], sums: dict[str, int]) -> tuple[dict[str, int], np.ndarray]:
    index = {u: i for i, u in enumerate(sorted(units))}
    table = np.zeros((len(index), len(langs)))
    none = SMOOTH / max(1, *sums.values()) if sums else 1.0
    for u, i in index.items():
        for k, lang in enumerate(langs):
            table[i, k] = np.log(units[u].get(lang, 0) / max(1, sums[lang]) + none)
    # only differences between languages matter; centring keeps long sums small
    return index, table - table.mean(axis=1, keepdims=True) if langs else table


def _share(sizes: list[int], total: int, least: int) -> int:
    """The most that each may have so that all together have ``total``, but ``least`` anyway."""
    left, share = total, total
    for i, n in enumerate(sorted(sizes)):
        share = left // (len(sizes) - i)
        if n > share:
            break
        left -= n
    else:
        return max(least, max(sizes, default=0))
    return max(least, share)


def _sampled(rows: DataFrame, sample_rows: int) -> DataFrame:
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()
    by_lang = {r.lang: r["count"] for r in most[:MAX_LANGUAGES]}
    share = _share(list(by_lang.values()), sample_rows, LANG_ROWS)
    if len(most) <= MAX_LANGUAGES and all(n <= share for n in by_lang.values()):
        return rows
    rates = rows.sparkSession.createDataFrame([(x, min(1 << 40, (1 << 40) * share // n)) for x, n in by_lang.items()], "lang string, rate long")
    return rows.join(F.broadcast(rates), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.col("rate")).drop("rate")


def _kept_units(counts: DataFrame, kind: str, most: int) -> dict[str, dict[str, int]]:
    """Each language's most frequent units; those seen once in all only of a language that has no others."""
    flat = counts.filter(F.col("kind") == kind).select("unit", F.col("total") > 1, F.explode("by_lang").alias("lang", "n")).toDF("unit", "often", "lang", "n")
    levels: dict[str, dict[tuple[bool, int], int]] = {}
    for r in flat.groupBy("lang", "often", "n").count().collect():  # levels of a sample
        levels.setdefault(r.lang, {})[r.often, r.n] = r["count"]
    levels = {x: {k: c for k, c in own.items() if k[0] or not any(often for often, _ in own)} for x, own in levels.items()}
    share = _share([sum(own.values()) for own in levels.values()], most, LANG_UNITS)
    cuts = []
    for lang, own in levels.items():
        left = share
        for (often, n), c in sorted(own.items(), reverse=True):
            if left > 0:
                cuts.append((lang, often, n, (1 << 20) * min(c, left) // c))  # of the last level a part, by a hash
            left -= c
    if not cuts:
        return {}
    wanted = flat.join(F.broadcast(flat.sparkSession.createDataFrame(cuts, "lang string, often boolean, n long, part long")), ["lang", "often", "n"])
    wanted = wanted.filter(F.pmod(F.xxhash64("unit"), F.lit(1 << 20)) < F.col("part")).select("unit").distinct()
    return {r.unit: r.by_lang for r in counts.filter(F.col("kind") == kind).join(wanted, "unit", "left_semi").select("unit", "by_lang").collect()}


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Fit on the rows of (doc_id, text, lang) with a non-null label."""
    rows = _sampled(labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()), sample_rows)
    counts = _counts(rows).groupBy("kind", "unit").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang"))
    counts = counts.persist()
    try:
        sums_rows = counts.select("kind", F.explode("by_lang").alias("lang", "n")).groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()
        kept = {kind: _kept_units(counts, kind, most) for kind, most in (("word", max_words), ("gram", max_grams))}
    finally:
        counts.unpersist()
    langs = sorted({r.lang for r in sums_rows})
    sums = {k: {x: next((r.n for r in sums_rows if (r.kind, r.lang) == (k, x)), 0) for x in langs} for k in kept}
    words, word_table = _table(kept["word"], langs, sums["word"])
    grams, gram_table = _table(kept["gram"], langs, sums["gram"])
    return Model(langs, words, word_table, grams, gram_table)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        model = held.value
        for b in batches:
            texts = b.column("text").to_pylist()
            out = [model.predict(t) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "lang_pred": [x for x, _ in out], "score": [x for _, x in out]}, schema=schema)

    return map_arrow(texts_of(docs), run, "doc_id long, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, all columns, whose text has a language: those that are ``und``
    go, and those in which no word or n-gram of any learned language occurs.
    With no learned language only texts without a letter go."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    ddl = docs.schema

    def run(batches):
        model = held.value
        for b in batches:
            keep = []
            for t in b.column(b.schema.get_field_index("text")).to_pylist():
                lang, score = model.predict(t)
                keep.append(bool(words_of(t)) if not model.langs else lang != "und" and (len(model.langs) == 1 or score > 1 / len(model.langs) + 1e-9))
            yield b.filter(pa.array(keep))

    return map_arrow(docs, run, ddl)


def held_out():
    """crc32 of the id as text, mod 4, is 2 (a null id is not)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, **bounds) -> Model:
    """A model from the rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return train(rows.filter(~held_out()), **bounds)


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """Learn from the rows that are not held out, predict all of them."""
    return predict(docs, learn(docs, **bounds)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
