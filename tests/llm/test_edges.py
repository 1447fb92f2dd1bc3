"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from geoseries.llm import decontamination, langid, lmscore, minhash, mixing, recompression, secrets, sentencepieces, sharding, syncmers, tokencount

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wort für wort " * 6000
ROWS = [(1, "the cat sat on the mat", "en", "a", 1), (2, None, None, None, None), (3, "", "de", "b", 0), (4, " \t\n", "fr", None, 3),
        (5, LONG, "de", "a", len(LONG)), (5, LONG, "de", "a", len(LONG)), (None, "the cat sat on the mat", "en", "b", 2), (None, None, None, None, None),
        (6, "\U0001F600 x", None, "c", 3), (7, "12345 !!", "en", "c", 8), (1, "the cat sat on the mat", "en", "a", 1)]
#: Names that operators use inside.
CLASH = ["key", "row_no", "row_key", "node", "label", "component", "spans", "name", "part", "copy", "virtual_slot", "rank", "shared", "gone", "packed", "target", "kept", "n_words"]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("other") for c in CLASH})


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


OPERATORS = {
    "langid": lambda s, d: langid.identify(d),
    "minhash": lambda s, d: minhash.near_duplicates(d, 2),
    "sharding": lambda s, d: sharding.shard(d, 4, 64),
    "syncmers": lambda s, d: syncmers.compare_edited(d, parts=3),
    "sentencepieces": lambda s, d: sentencepieces.encode(d),
    "secrets": lambda s, d: secrets.scan(d),
    "mask": lambda s, d: secrets.mask(d),
    "decontamination": lambda s, d: decontamination.find_hits(d, benchmark(s, [(1, "the cat sat"), (2, None), (None, "x"), (3, "")])),
    "lmscore": lambda s, d: lmscore.cross_entropy_difference(d, labels(s, [(1, 1, 0), (1, 0, 0), (None, 1, 0), (99, 1, 0), (5, None, 0)])),
    "recompression": lambda s, d: recompression.remove_repeats(d, 4),
    "tokencount": lambda s, d: tokencount.count_tokens(d),
    "mixing": lambda s, d: mixing.taken(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, name):
    out = OPERATORS[name](spark, table(spark, ROWS)).collect()
    assert len(out) == len(ROWS)
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in ROWS)


#: Very long texts without a space, and one row some hundred times.
HEAVY = [(1, "中文字" * 30_000, "zh", "a", 90_000), (2, "x" * 70_000, "en", "b", 70_000), (3, "a1" * 40_000, None, "c", 80_000)] + [(4, "the same row of a few words", "en", "a", 27)] * 300


@pytest.mark.parametrize("name", OPERATORS)
def test_long_texts_without_a_space_and_repeated_rows(spark, name):
    out = OPERATORS[name](spark, table(spark, HEAVY)).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in HEAVY)
    # equal rows have equal results (a shard gives each a place of its own, a mix may cut one at its budget)
    if name not in ("sharding", "mixing", "syncmers"):
        assert len({str(r) for r in out if r.doc_id == 4}) == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, table(spark, [])).collect() == []


def test_stages_on_edges(spark):
    docs = table(spark, ROWS)
    kept = langid.drop_unidentified(docs, langid.learn(docs))
    assert kept.columns == docs.columns
    assert not [r for r in kept.collect() if r.text in (None, "", " \t\n", "12345 !!")]
    one = minhash.drop_near_duplicates(docs, 5)
    ids = [r.doc_id for r in one.collect()]
    assert one.columns == docs.columns and ids.count(1) == ids.count(5) == 1 and ids.count(None) == 2
    clean = decontamination.drop_contaminated(docs, benchmark(spark, [(1, "cat sat"), (2, None)]))
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 3
    assert decontamination.drop_contaminated(docs, benchmark(spark, [])).count() == len(ROWS)


def test_values_on_edges(spark):
    docs = table(spark, ROWS)
    by = lambda df: {(r.doc_id, i): r for i, r in enumerate(sorted(df.collect(), key=str))}
    lang = {r.doc_id: r for r in langid.identify(docs).collect() if r.doc_id}
    assert lang[2].lang_pred == lang[3].lang_pred == lang[7].lang_pred == "und" and lang[2].score == 0
    size = {r.doc_id: r for r in sharding.shard(docs, 4, 64).collect() if r.doc_id}
    assert size[2].size == 16 and size[2].text_crc32 == 0 and size[3].size == 16
    count = {r.doc_id: r for r in tokencount.count_tokens(docs).collect() if r.doc_id}
    assert (count[2].n_bytes, count[2].n_tokens, count[3].n_tokens) == (0, 0, 0) and count[5].n_chunks > 1 and count[5].over_limit
    score = {r.doc_id: r for r in lmscore.cross_entropy_difference(docs, labels(spark, [])).collect() if r.doc_id}
    assert score[2].score is None and score[2].n_words == 0 and score[1].score is not None
    ids = {r.doc_id: r for r in sentencepieces.encode(docs).collect() if r.doc_id}
    assert ids[2].packed is None and len(ids[3].packed) == 0
    assert len(by(docs)) == len(ROWS)
