"""Mixing, prefix trie and spelling variants against brute force, and what they rest on."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from geoseries.llm import mixing, trie, variants
from geoseries.operators.running import ranged, running

CLASH = ["key", "word", "n", "node", "end", "size", "copy", "range_no", "one", "idx", "pos", "a", "upto", "row_no", "rank", "target", "length"]


def with_clashes(df):
    return df.withColumns({c: F.lit("other") for c in CLASH})


@pytest.fixture
def uncoalesced(spark):
    """Small shuffles keep all their partitions."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_running_spreads_a_hot_key(spark, uncoalesced):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 else rnd.choice(["a", "b", None, "z"]), i, rnd.randint(-5, 99), rnd.getrandbits(62)) for i in range(900)]
    table = ranged(spark.createDataFrame(rows, "k string, i long, v long, x long"), [F.col("k"), F.col("i")], "t")
    assert table.filter("k = 'hot'").select("range_no").distinct().count() > 1
    got = running(table, ["k"], [F.col("i")], {"s": ("v", "sum"), "xs": ("x", "xor")}).collect()
    total, xors, want = Counter(), Counter(), {}
    for k, i, v, x in rows:
        total[k] += v
        xors[k] ^= x
        want[i] = (total[k], xors[k])
    assert len(got) == len(rows) and {r.i: (r.s, r.xs) for r in got} == want


# ---- mixing ----

DOCS = "doc_id long, text string, source string"


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > epochs * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_its_targets(spark, seed, uncoalesced):
    rnd = random.Random(seed)
    rows = []
    for i in range(700):
        source = "hot" if i % 3 == 0 else rnd.choice(["a", "bé", "z", None, "", "b", "one"])
        text = None if i % 50 == 0 else rnd.choice([" ", "\n\t", "  \x0b"]).join("w\xa0é"[: rnd.randint(1, 3)] for _ in range(rnd.choice([0, 1, 5, 60])))
        rows.append((None if i % 90 == 1 else i, text, source))
    rows += [(7, "same words here", "hot")] * 40 + [(10_000, "big " * 3000, "one")]
    out = mixing.taken(with_clashes(spark.createDataFrame(rows, DOCS))).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    target = brute_targets(sizes)
    assert sorted(str((r.doc_id, r.size)) for r in out) == sorted(str((i, size(t))) for i, t, _ in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    # sources of the same size and target cannot be told apart in the result: compare by (size, target)
    want, got = Counter(), Counter()
    for s in sizes:
        want[sizes[s], round(target[s], 4)] += target[s]
    for r in out:
        got[r.source_size, round(r.target, 4)] += r.taken
    assert all(abs(want[k] - got[k]) < 3 for k in want | got)
    # the partitions of the input and of the shuffles play no part
    again = mixing.taken(spark.createDataFrame(rows[::-1], DOCS).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_queue_is_in_order_and_ends_at_the_budget(spark):
    rows = [(i, "w " * (i % 7), "abc"[i % 3]) for i in range(300)]
    _, queue = mixing.mix(spark.createDataFrame(rows, DOCS))
    out = sorted(queue.collect(), key=lambda r: r.position)
    assert [r.finish for r in out] == sorted(r.finish for r in out)
    at = 0
    for r in out:
        at += r.words
        assert r.position == at
    budget = 1.5 * sum(i % 7 for i in range(300))
    assert budget - 3 < at <= budget
    # at any time every source has been served in proportion to its target
    seen, goal = Counter(), brute_targets({s: sum(i % 7 for i in range(300) if "abc"[i % 3] == s) for s in "abc"})
    for r in out:
        seen[r.source] += r.words
        assert abs(seen[r.source] / goal[r.source] - r.finish) < 1e-9


def test_mix_without_words(spark):
    assert {(r.size, r.target, r.taken) for r in mixing.taken(spark.createDataFrame([(1, None, "a"), (2, " ", None)], DOCS)).collect()} == {(0, 0.0, 0)}


def test_mix_is_native(spark):
    plan = mixing.taken(spark.createDataFrame([(1, "a b", "x"), (2, "c", "y")], DOCS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


# ---- prefix trie ----

TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows, group=100, most=6):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        full = tuple(convs.get(c - c % group, [])[:h] + own[h:])
        for d in range(len(full) + 1):
            members[full[:d]].append(c)
        ends[full].append(c)
    kids, out = defaultdict(list), []
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    total = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        total[p] = (1 if not kids[p] else sum(total[k][0] for k in kids[p]), saved + sum(total[k][1] for k in kids[p]))
    for p, m in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *total[p], digest))
    return sorted(map(str, out))


def trie_of(spark, rows):
    return sorted(str(tuple(r)) for r in trie.prefix_trie(with_clashes(spark.createDataFrame(rows, TURNS))).collect())


def test_trie(spark, uncoalesced):
    rnd = random.Random(3)
    rows = []
    for c in [*range(0, 60), *range(300, 380, 3), *range(1000, 1010)]:
        for t in range(rnd.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bé\U0001F600", None, ""])))
    # one much longer conversation, copied, and one that leaves it half way
    for c in (500, 612, 613):
        rows += [(c, t, "user", f"turn {t if c < 613 or t < 70 else -t}") for t in range(130)]
    # copies that all end at one node
    rows += [(c, t, "user", "hello") for c in range(2000, 2090) for t in range(3)]
    rows += [(None, 1, "user", "x"), (7, None, None, "first")]
    rnd.shuffle(rows)
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_of_ties_and_little(spark):
    twice = [(1, 0, "user", "x")] * 3 + [(2, 0, "user", "x")] * 3
    assert trie_of(spark, twice) == brute_trie(twice)
    mixed = [(700, 1, "user", x) for x in "abcabc"] + [(700, 1, "user", "a")]
    assert len(trie_of(spark, mixed)) == 8 and trie_of(spark, mixed) == trie_of(spark, mixed[::-1])
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 1, "user", "x")]) == []
    one = [(5, 0, None, None)]
    assert trie_of(spark, one) == brute_trie(one)


@pytest.mark.parametrize("seed", range(3))
def test_contraction_of_any_tree(spark, seed):
    rnd = random.Random(seed)
    parent, depth = {0: None}, {0: 0}
    for v in range(1, 400):
        # long chains, stars and bushes
        parent[v] = v - 1 if rnd.random() < (0.9, 0.5, 0.2)[seed] else rnd.choice([0, rnd.randrange(v)])
        depth[v] = depth[parent[v]] + 1
    own = {v: (rnd.randint(0, 3), rnd.randint(0, 100)) for v in parent}
    want = dict(own)
    for v in sorted(parent, key=depth.get, reverse=True):
        if v:
            want[parent[v]] = tuple(a + b for a, b in zip(want[parent[v]], want[v], strict=True))
    nodes = spark.createDataFrame([(v, p, depth[v], *own[v]) for v, p in parent.items()], "node long, parent long, depth long, n_leaves long, saved_tokens long")
    assert {r.node: (r.n_leaves, r.saved_tokens) for r in trie.contract(nodes).collect()} == want


# ---- spelling variants ----

TEXTS = "doc_id long, text string"


def brute_variants(rows, least_letters, least_n, every):
    count = Counter()
    for doc_id, text in rows:
        low = (text or "").encode().lower().decode()
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    count = {w: n for w, n in count.items() if len(w) >= least_letters and n >= least_n}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    met = {w: [v for v in count if near(v, w)] for w in count}
    form = {}
    for w, some in met.items():
        if some:
            best = min(some, key=lambda v: (-count[v], v))
            form[w] = best if count[best] >= 2 * count[w] else None
    out = []
    for w, n in count.items():
        root = w
        while form.get(root):
            root = form[root]
        out.append((w, form.get(w), root, n, len(met[w]), count[form[w]] if form.get(w) else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("most", [variants.MOST, 3])
def test_variants(spark, most):
    rnd = random.Random(11)
    rows = []
    for i in range(150):
        words = ["".join(rnd.choices("abÉ", k=rnd.choice([1, 2, 3, 4, 4, 5, 8]))) for _ in range(60)]
        rows.append((i, rnd.choice([" ", "-", "1", "\n"]).join(words).replace("a", "A" if i % 2 else "a")))
    rows += [(None, "abab abab abba"), (3, None), (4, ""), (5, "12 ! \U0001F600"), (6, "abbb " * 40), (6, "abbb " * 40)]
    got = variants.group_variants(with_clashes(spark.createDataFrame(rows, TEXTS)), least_letters=2, least_n=3, every=11, most=most).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_variants(rows, 2, 3, 11)
    assert variants.group_variants(spark.createDataFrame([], TEXTS)).collect() == []


def test_small_buckets_hold_every_row_once(spark):
    words = spark.createDataFrame([(a + b + c + "xx", 3) for a in "abcd" for b in "abcd" for c in "abcd"], "word string, n long")
    rows = variants.buckets(words, most=5)
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("high") - F.col("low")).alias("width")).collect()
    assert all(r.n <= 5 or r.width == 1 for r in sizes)
    near = {r.word: r.n_near for r in variants.near_words(words, most=5).collect()}
    assert len(near) == 64 and set(near.values()) == {9}


def test_long_texts_are_sliced_between_runs(spark, monkeypatch):
    text = "alpha-" * 50 + "é" * 700 + " " + "beta gamma " * 90
    pieces = lambda n: (monkeypatch.setattr(variants, "SLICE", n), list(variants._slices(text)))[1]
    for n in (7, 64, 300):
        assert "".join(pieces(n)) == text
        assert [w for p in pieces(n) for w in variants.RUN.findall(p)] == variants.RUN.findall(text)
    # a text without a space: one run of a million letters, beside itself with a letter less
    long = "abcde" * 200_000
    rows = [(i, long) for i in range(3)] + [(i, long[:77_777] + long[77_778:]) for i in range(3, 9)]
    got = {len(r.word): r for r in variants.group_variants(spark.createDataFrame(rows, TEXTS)).collect()}
    assert got[1_000_000].form_n == 6 and got[999_999].form is None and got[1_000_000].root == got[999_999].word
