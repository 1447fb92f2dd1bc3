"""Operator 11, spelling variant grouping by a bit-sliced position index.

**Words** are counted in the scan: each task counts the runs of letters of its
texts in a bounded dictionary and sends (word, n) rows; Spark sums them.

**Search.** The vocabulary is cut into buckets; a bucket holds one bitset per
(position, letter), one bit a word.  A query word walks along its letters and
keeps three bitsets of all the bucket's words at once: ``zero`` (equal so far),
``other`` (one letter replaced) and ``extra`` (one letter inserted; such words
are read one position further on).  A step is a handful of AND / OR operations
on whole bitsets::

    other = other & same | zero & ~same
    extra = extra & ahead | zero & ~same & ahead
    zero  = zero & same

with ``same`` the words that hold the letter at this position, ``ahead`` those
that hold it at the next.  Words with a letter more or less see each other from
the shorter one.

**Buckets.** Two words at distance one, the shorter of length L, differ at one
place of 0 to L.  Cut [0, L) into two windows: the place lies in one of them,
and the words share everything before and after it, which is the bucket's key.
The walk covers the window only, and the place of the first difference decides
the window, so a pair is found exactly once.  A bucket of over ``most`` words
(measured, none is dropped) has its window cut in two again; at one letter a
bucket holds no more words than the square of the alphabet.  No pairs are
emitted: a bucket gives each word its count of near words and the best of them.

**Roots** follow forms by pointer doubling; n at least doubles with each form,
so chains are short.

Nulls: a null text has no words; a null id counts as the empty text in the
digest that picks a run to edit.  Repeated rows count again.  Ties between forms
go to the smallest word in code-point order.  A text is read in slices, a run of
letters is never cut.  Empty tables and vocabularies give empty results.  Other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoseries.llm.textkit import map_arrow, texts_of
from geoseries.session import cut_lineage, drop_staged

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SLICE = 1 << 20        # code points of a text whose runs are listed at once
HELD = 200_000         # distinct words a task holds before it sends its counts
MOST = 16_384          # words of a bucket
EDIT_EVERY = 97
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _slices(text: str) -> Iterator[str]:
    """The text in pieces that end where no run of letters does."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text) and (run := RUN.match(text, end)):
            end = run.end()
        yield text[at:end]
        at = end


def _count(every: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for piece in _slices(text.lower().decode()):  # bytes.lower touches A-Z only
                    for word, n in Counter(RUN.findall(piece)).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % every == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1:]
                        if len(word) >= least:
                            held[word] += n
                    if len(held) > HELD:
                        yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, schema=COUNTS)
                        held = Counter()
        if held:
            yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, schema=COUNTS)

    return run


def vocabulary(docs: DataFrame, least_letters: int = 5, least_n: int = 3, every: int = EDIT_EVERY) -> DataFrame:
    """(word, n) of the words of at least ``least_letters`` code points that occur ``least_n`` times; written once."""
    counts = map_arrow(texts_of(docs), _count(every, least_letters), "word string, n long")
    return cut_lineage(counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n), "vocabulary")


def _key(word: Column, length: Column, low: Column, high: Column) -> Column:
    """What words of ``length`` (or one more) share outside [low, high)."""
    before, after = F.substring(word, F.lit(1), low), F.substring(word, F.length(word) - (length - high) + 1, length - high)
    return F.unhex(F.md5(F.concat_ws(":", length.cast("string"), low.cast("string"), high.cast("string"), before, after).cast("binary")))


def _keyed(words: DataFrame, windows: Column) -> DataFrame:
    """(key, low, high, length, word, n) for the windows of every row."""
    rows = words.select("word", "n", "length", F.explode(windows).alias("w")).select("word", "n", "length", "w.low", "w.high")
    return rows.withColumn("key", _key(F.col("word"), F.col("length"), F.col("low"), F.col("high")))


def _halves(low: Column, high: Column) -> Column:
    middle = F.floor((low + high) / 2).cast("int")
    both = F.array(F.struct(low.alias("low"), middle.alias("high")), F.struct(middle.alias("low"), high.alias("high")))
    return F.filter(both, lambda w: w["low"] < w["high"])


def buckets(words: DataFrame, most: int = MOST) -> DataFrame:
    """(key, low, high, length, word, n), no key with over ``most`` rows unless its window is one letter."""
    length = F.length("word")
    shorter = words.withColumn("length", F.explode(F.array(length, length - 1))).filter("length > 0")
    rows, out = cut_lineage(_keyed(shorter, _halves(F.lit(0), F.col("length"))), "buckets"), None
    while True:
        hot = cut_lineage(rows.filter("high - low > 1").groupBy("key").count().filter(F.col("count") > most).select("key"), "hot_buckets")
        if hot.limit(1).count() == 0:
            return rows if out is None else out.unionByName(rows)
        small = rows.join(hot, "key", "left_anti")
        out = small if out is None else out.unionByName(small)
        rows = cut_lineage(_keyed(rows.join(hot, "key", "left_semi"), _halves(F.col("low"), F.col("high"))), "buckets")


def search(words: list[str], length: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Per query (a word of ``length``): its number and the bitset of the words at
    distance one whose first difference lies in [low, high) (at ``length`` too, if
    the window ends there).  All words have ``length`` letters or one more and
    share what lies outside the window."""
    at: dict[tuple[int, str], int] = defaultdict(int)
    equal = longer = 0
    for w, word in enumerate(words):
        bit = 1 << w
        if len(word) == length:
            equal |= bit
        else:
            longer |= bit
        for i in range(low, min(high + 1, len(word))):
            at[i, word[i]] |= bit
    at = dict(at)
    for w, word in enumerate(words):
        if len(word) != length:
            continue
        zero, other, extra = equal | longer, 0, 0
        for i in range(low, high):
            same, ahead = at.get((i, word[i]), 0), at.get((i + 1, word[i]), 0)
            left = zero & ~same
            other = other & same | left
            extra = extra & ahead | left & ahead
            zero &= same
        found = other & equal | extra & longer
        if high == length:
            found |= zero & longer
        if found:
            yield w, found


def _bits(found: int) -> Iterator[int]:
    while found:
        low = found & -found
        yield low.bit_length() - 1
        found ^= low


def _near_of_bucket(words: list[str], n: list[int], length: int, low: int, high: int) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words found, largest n, its smallest word) of each word that has any."""
    count, best = Counter(), {}

    def meet(w: int, other: int) -> None:
        count[w] += 1
        rank = (-n[other], words[other])
        if w not in best or rank < best[w]:
            best[w] = rank

    for w, found in search(words, length, low, high):
        for other in _bits(found):
            meet(w, other)
            if len(words[other]) > length:
                meet(other, w)
    for w, m in count.items():
        yield words[w], m, -best[w][0], best[w][1]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key, so a bucket's rows follow each other."""
    key, window, words, n, out = None, None, [], [], []

    def flush() -> None:
        if len(words) > 1:
            out.extend(_near_of_bucket(words, n, *window))

    def batch_of(rows: list) -> pa.RecordBatch:
        word, m, form_n, form = zip(*rows, strict=True)
        return pa.RecordBatch.from_pydict({"word": word, "m": pa.array(m, pa.int64()), "form_n": pa.array(form_n, pa.int64()), "form": form})

    for batch in batches:
        for k, low, high, length, word, count in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
            if k != key:
                flush()
                key, window, words, n = k, (length, low, high), [], []
                if len(out) > 10_000:
                    yield batch_of(out)
                    out = []
            words.append(word)
            n.append(count)
    flush()
    if out:
        yield batch_of(out)


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, best) of every word with a near word; best: struct<less (-n), form> of its first choice."""
    rows = buckets(words, most).select("key", "low", "high", "length", "word", "n").repartition("key").sortWithinPartitions("key")
    found = map_arrow(rows, _near, "word string, m long, form_n long, form string")
    return found.groupBy("word").agg(F.sum("m").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row of ``forms`` (word, form): the last word that forms lead to."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_staged(at)
        at = moved
        if moved.filter("moved").limit(1).count() == 0:
            return moved.drop("moved")


def group_variants(docs: DataFrame, least_letters: int = 5, least_n: int = 3, factor: int = 2, every: int = EDIT_EVERY, most: int = MOST) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n."""
    words = vocabulary(docs, least_letters, least_n, every)
    near = cut_lineage(words.join(near_words(words, most), "word", "left"), "near")
    form_n = -F.col("best.less")
    near = near.withColumns({"form_n": F.when(form_n >= factor * F.col("n"), form_n), "form": F.when(form_n >= factor * F.col("n"), F.col("best.form"))})
    last = roots(near.filter("form is not null").select("word", "form"))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
