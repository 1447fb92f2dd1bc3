"""Trained operators: held-out accuracy, separation, and the pipeline."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
from geoseries.llm import langid, lmscore, minhash

import corpus_pipeline
from test_exact import brute_hits

SF = "/root/testdata/sf0.001"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)


def test_backoff_of_unseen_words(spark):
    train = [(i, t, x) for i, (t, x) in enumerate([("the thing that other", "en"), ("der die schön straße", "de")] * 40)]
    model = langid.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.predict("thather")[0] == "en" and model.predict("schönstraßen")[0] == "de"
    assert model.predict("123 ?!") == ("und", 0.0) and model.predict(None) == ("und", 0.0)
    assert "thather" not in model.words


def test_runs_without_spaces(spark):
    """Languages written in runs of over 64 letters are learned, and a run is judged by all of its letters."""
    rnd = random.Random(3)
    run = lambda letters, n: "".join(rnd.choices(letters, k=n))
    train = [(i, run("あいうえおかきく", 200), "ja") for i in range(20)] + [(100 + i, run("的一是不了人我在", 200), "zh") for i in range(20)]
    train += [(200 + i, "the thing that other", "en") for i in range(20)]
    model = langid.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "ja", "zh"]
    assert model.predict(run("あいうえおかきく", 100))[0] == "ja" and model.predict(run("的一是不了人我在", 100))[0] == "zh"
    assert model.predict(run("あいうえおかきく", 70) + run("的一是不了人我在", 700))[0] == "zh"
    assert model.predict("the " + run("的一是不了人我在", 640) + " that thing the")[0] == "zh"
    assert langid.pieces("x" * 64) == 1 and langid.pieces("x" * 65) == 2
    long = "ab" * langid.SLICE
    assert langid.grams_of(long)["ab"] == langid.SLICE and sum(langid.grams_of(long).values()) == sum(len(long) + 2 - n + 1 for n in range(1, 6))


def test_small_language_beside_a_large_one(spark):
    """A language with few rows is learned however large the others are, with units of its own."""
    rnd = random.Random(4)
    many = [(i, " ".join(f"{a}{b}" for a, b in zip(rnd.choices("abcdefgh", k=20), rnd.choices("ijklmnop", k=20), strict=True)), "en") for i in range(4000)]
    few = [(10_000 + i, "один два три четыре", "ru") for i in range(3)] + [(20_000, "μία λέξη", "el")]
    frame = spark.createDataFrame(many + few, "doc_id long, text string, lang string")
    model = langid.train(frame, sample_rows=100, max_words=50, max_grams=100)
    assert model.langs == ["el", "en", "ru"]
    assert [model.predict(t)[0] for t in ("два четыре один", "λέξη", "ai bj ck")] == ["ru", "el", "en"]
    kept = langid.drop_unidentified(spark.createDataFrame([(1, "четыре три"), (2, "μία")], "doc_id long, text string"), model)
    assert {r.doc_id for r in kept.collect()} == {1, 2}
    assert langid._share([10, 1, 1], 6, 0) == 4 and langid._share([2, 3], 6, 0) == 3 and langid._share([9, 9], 6, 5) == 5


def test_a_dirty_label_column_is_bounded(spark, monkeypatch):
    """Of very many labels the most frequent are learned; the rows of the others are predicted all the same."""
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    rows = [(i, "the cat and the dog", "en") for i in range(30)] + [(100 + i, "der hund und die katze", "de") for i in range(20)]
    rows += [(1000 + i, "le chat et le chien", f"typo{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == ["de", "en"]
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert len(got) == 100 and got[1] == "en" and got[101] == "de"


def test_lm_score_separates(spark):
    rnd = random.Random(1)
    good, bad = [f"g{i}" for i in range(50)], [f"b{i}" for i in range(50)]
    docs = [(i, " ".join(rnd.choices(good if i % 2 else bad, k=60))) for i in range(200)]
    labels = [(i, 1, 0) for i in range(1, 100, 2)] + [(i, 0, 0) for i in range(0, 100, 2)]
    got = {r.doc_id: r.score for r in lmscore.cross_entropy_difference(spark.createDataFrame(docs, "doc_id long, text string"),
                                                                       spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert max(got[i] for i in range(101, 200, 2)) < min(got[i] for i in range(100, 200, 2))


def brute_force(docs: list[tuple], good: set) -> list[tuple]:
    """Both models counted word by word, less each document's own words."""
    words = [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower()) for _, t in docs]
    pairs = [list(zip([None, *w], w, strict=False)) for w in words]
    size = len({x for w in words for x in w})
    out = []
    for i, (doc_id, _) in enumerate(docs):
        loss = []
        for model in (True, False):
            of = [j for j in range(len(docs)) if j != i and (not model or docs[j][0] in good)]
            single, pair, context = Counter(), Counter(), Counter()
            for j in of:
                single.update(words[j])
                pair.update(pairs[j])
                context.update(a for a, _ in pairs[j])
            n = sum(single.values())
            each = [-np.log((pair[a, b] + lmscore.WEIGHT * (single[b] + lmscore.PRIOR) / (n + lmscore.PRIOR * size)) / (context[a] + lmscore.WEIGHT)) for a, b in pairs[i]]
            loss.append(sum(each) / len(each) if each else None)
        out.append((doc_id, len(words[i]), loss[0], loss[1], loss[0] - loss[1] if words[i] else None))
    return out


def test_lm_score_is_exact(spark):
    """Blocks and buckets of any size against counts word by word: two words in one of the former cells are not taken for one."""
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rnd.choices(words + [f"own{i}"], k=rnd.randint(0, 30)))) for i in range(60)] + [(60, None), (61, " "), (3, "w1 w1 w1")]
    good = set(range(0, 60, 3))
    want = sorted(brute_force(docs, good), key=str)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int")
    for sizes in ((1 << 20, 1), (500, 7), (1, 40), (1 << 20, None)):
        got = sorted((tuple(r) for r in lmscore.cross_entropy_difference(frame, labels, *sizes).collect()), key=str)
        for a, b in zip(got, want, strict=True):
            assert a[:2] == b[:2] and all(x is y is None or abs(x - y) < 1e-9 for x, y in zip(a[2:], b[2:], strict=True))


def test_messages_grow_with_the_blocks_alone(spark):
    """Twice the text is twice the blocks, and a block sends a message to each bucket at most."""
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choices([f"w{j}" for j in range(3000)], k=200)), False) for i in range(200)]
    seen = {}
    for n in (100, 200):
        frame = spark.createDataFrame(docs[:n], "doc_id long, text string, target boolean").coalesce(1)
        blocks = lmscore.in_blocks(frame, 10_000)
        seen[n] = (blocks.count(), lmscore.messages(blocks, 16).count())
    assert 1.8 < seen[200][0] / seen[100][0] < 2.2
    assert all(m <= 16 * blocks for blocks, m in seen.values())


def test_lm_score_does_not_depend_on_other_words(spark):
    """Words that no cell table of a fixed size tells apart leave the loss of a rare pair alone."""
    text = " ".join(f"x{i} y{i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, "rare new"), (2, "rare old"), (3, text)], "doc_id long, text string")
    got = {r.doc_id: r for r in lmscore.cross_entropy_difference(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    single = lambda n: (n + lmscore.PRIOR) / (400_002 + lmscore.PRIOR * 400_003)
    first = (1 + lmscore.WEIGHT * single(1)) / (2 + lmscore.WEIGHT)
    second = lmscore.WEIGHT * single(0) / (1 + lmscore.WEIGHT)
    assert abs(got[1].background_loss + (math.log(first) + math.log(second)) / 2) < 1e-9


def test_pipeline(spark):
    """Each stage against what it must do to its own input."""
    import hashlib

    from geoseries.llm import secrets, sentencepieces
    from sentencepiece import SentencePieceProcessor
    extra = [(10_001, None, None, "s", 0), (10_002, "12 34 !!", "en", "s", 8), (10_003, "the of and password=abcdefgh1234 the", "en", "s", 36)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    kept, held = [], docs
    for name, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, SF).cache()
        kept.append({r.doc_id: r for r in held.collect()})
        assert name == "sentencepiece" or held.columns == docs.columns
    all_ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert all_ids - set(kept[0]) == {10_001, 10_002}
    same = {r.doc_id for r in minhash.near_duplicates(docs.filter("doc_id not in (10001, 10002)"), 5).filter("kept").collect()}
    assert set(kept[1]) == same and len(same) < len(kept[0])
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    hit = {r[0] for r in brute_hits([(i, r.text) for i, r in kept[1].items()], items) if r[5]}
    assert hit and set(kept[2]) == set(kept[1]) - hit
    assert set(kept[3]) == set(kept[2]) and kept[3][10_003].text == "the of and [SECRET] the" and kept[3][10_003].n_chars == 23
    assert not [i for i, r in kept[3].items() if re.search(secrets.PATTERNS["hex"], r.text)]
    library = SentencePieceProcessor(model_file=sentencepieces.model_path())
    for i, r in kept[4].items():
        assert r.ids == library.encode(kept[3][i].text) and r.n_pieces == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(kept[3][i].text.encode()).hexdigest()
