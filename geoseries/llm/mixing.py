"""Operator 13, mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source has a weight and a size in words.  ``targets`` shares the budget by
weight; a source stops at ``epochs`` times its size and the excess is shared
again, so a water level is sought: ``target = min(weight * level, epochs *
size)``.  Each source's documents are shuffled by a digest of id and text, and a
source is passed over ``epochs`` times.  A copy starts at the words its source
has given before it and ends ``size`` words later; divided by the target those
are its virtual start and finish.  Copies are range-sorted by virtual finish
over all sources, and the budget ends the mix.  Since the targets add up to the
budget, it ends at virtual time 1 in every source at once; the one copy of each
source that is in service then gives the words served so far, so a source's
taken words miss its target by less than a word.

Hot sources: totals run over ranges of (source, shuffle key) (``operators.running``), so a
source with a third of all rows is spread over many tasks; texts leave the
scan as a size and a digest.

Nulls: a null text has no words; a null source is a source of its own, ranked
last; a null id shuffles by its text.  Repeated rows are rows of their own, in
an order that cannot be told from any other.  Sources without words have target
0.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoseries.operators.running import ranged, running
from geoseries.session import cut_lineage

WEIGHTS = (3, 1, 2)
EPOCHS = 2
SHARE = 1.5     # of all words: the budget
WORDS = r"[^\x20\x09-\x0D]+"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def word_count(text: Column) -> Column:
    """Number of ``WORDS``: every word becomes one ``x``, and the blanks go."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORDS, "x")
    return F.length(F.translate(marks, BLANKS, "")).cast("long")


def records(docs: DataFrame) -> DataFrame:
    """(row_no, doc_id, source, size, shuffle_key) of every row, written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary")), 1, 16)
    return cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                                   word_count(F.col("text").cast("string")).alias("size"), key.alias("shuffle_key"))
                       .withColumn("row_no", F.monotonically_increasing_id()), "mix_records")


def targets(recs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> tuple[DataFrame, float]:
    """(source, source_size, weight, target) of every source, written once, and the budget.
    Only sums over all sources reach the driver."""
    by_code_point = [F.col("source").asc_nulls_last()]
    sizes = recs.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    ranked = running(ranged(sizes, by_code_point, "mix_sources"), [], by_code_point, {"rank": ("one", "sum")})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    limited = ranked.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * epochs).alias("most"))
    # the level at which a source stops; sources that stop earlier come first
    stop = [(F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    filled = running(ranged(limited, stop, "mix_levels"), [], stop, {"most_upto": ("most", "sum"), "weight_upto": ("weight", "sum")})
    filled = cut_lineage(filled, "mix_filled")
    sums = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weights")).first()
    budget = float(sums.total) * share
    # a source stops if, at its own level, all sources together take no more than the budget
    taken_then = F.col("most_upto") + F.col("most") * (F.lit(sums.weights) - F.col("weight_upto")) / F.col("weight")
    stops = taken_then <= F.lit(budget)
    rest = filled.agg(F.sum(F.when(~stops, F.col("weight"))).alias("weight"), F.coalesce(F.sum(F.when(stops, F.col("most"))), F.lit(0)).alias("done")).first()
    level = (budget - rest.done) / rest.weight if rest.weight else 0.0
    out = filled.select("source", "source_size", "weight", F.when(stops, F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(level)).alias("target"))
    return cut_lineage(out, "mix_targets"), budget


def in_source_order(recs: DataFrame, goals: DataFrame) -> DataFrame:
    """Each record with its source's target and ``served``, the words its source
    has given in one pass when it ends."""
    order = [F.col("shuffle_key"), F.col("size"), F.col("row_no")]
    rows = running(ranged(recs, [F.col("source").asc_nulls_last(), *order], "mix_order"), ["source"], order, {"served": ("size", "sum")})
    goals = goals.withColumnRenamed("source", "of_source")
    return rows.join(goals, rows.source.eqNullSafe(goals.of_source)).drop("of_source", "range_no")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> tuple[DataFrame, DataFrame]:
    """(rows, queue).  ``rows``: every record with its source's size and target.
    ``queue``: the mix in its order, one row a copy: row_no, doc_id, source,
    copy, words (taken of it), finish (virtual time) and position (words of the
    mix up to its end), cut at the budget."""
    recs = records(docs)
    goals, budget = targets(recs, weights, share, epochs)
    rows = cut_lineage(in_source_order(recs, goals), "mix_rows")
    copies = rows.select("row_no", "doc_id", "source", "size", "source_size", "target", "served", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("copy"))
    start = F.col("copy") * F.col("source_size") + F.col("served") - F.col("size")
    # the copy in service when the target is met gives the words served so far
    words = F.least(F.col("size"), F.floor(F.col("target") - start))
    copies = (copies.withColumn("words", words).filter("words > 0")
              .select("row_no", "doc_id", "source", "copy", "words", ((start + F.col("words")) / F.col("target")).alias("finish")))
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("copy"), F.col("row_no")]
    queue = running(ranged(copies, order, "mix_queue"), [], order, {"position": ("words", "sum")})
    return rows, queue.filter(F.col("position") <= F.lit(budget)).drop("range_no")


def taken(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, size, source_size, target (6 decimals), taken."""
    rows, queue = mix(docs, **options)
    given = queue.groupBy("row_no").agg(F.sum("words").alias("taken"))
    return rows.join(given, "row_no", "left").select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), F.coalesce("taken", F.lit(0)).alias("taken"))
