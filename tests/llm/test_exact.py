"""Operators whose results a brute-force version or a library gives exactly."""

import hashlib
import random
import re
import time

import duckdb
import numpy as np
import pytest

from geoseries.llm import decontamination, minhash, queries, recompression, secrets, sentencepieces, sharding, syncmers, tokencount
from geoseries.llm.graph import components
from geoseries.llm.sql import ORACLE

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def documents():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", ORACLE)
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    con.execute(f"create view twin as {ORACLE[name]}")
    want = con.sql("select * from twin")
    got = queries.QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.select(*want.columns).collect())


def brute_hits(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    """Every window of every item against every position."""
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k:k + n])):
                    found |= own
                    hit.update(range(k, k + n))
        ids = sorted(found)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def brute_repeats(docs: list[tuple], window: int = 50) -> set[tuple]:
    """Every window of every document; distinct ids."""
    words = {i: (t or "").encode().split() for i, t in docs}
    least: dict[tuple, int] = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            least.setdefault(tuple(words[i][k:k + window]), i)
    out = set()
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        out.add((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def random_texts(letters, n, most, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(letters, k=rnd.randint(0, most))) for _ in range(n)]


def test_token_counts(spark):
    from tokenizers import Tokenizer
    letters = ["a", "b", " ", "  ", "\n", "\t", "é", "中", "<|endoftext|>", "'s", "1", "22", "!", "\x1c", "　", "\x85", "\xa0", " ", "word", " the"]
    rows = list(enumerate(random_texts(letters, 120, 300, 1) + ["x" * 3000, "ab" * 900 + " " + "c d " * 500, "", None, " " * 2000]))
    library = Tokenizer.from_file(tokencount.tokenizer_path())
    want = {i: len(library.encode(t or "", add_special_tokens=False)) for i, t in rows}
    for chunk, overlap in ((32768, 1024), (100, 16)):
        got = tokencount.count_tokens(spark.createDataFrame(rows, DOC), chunk_chars=chunk, overlap=overlap).collect()
        assert {r.doc_id: r.n_tokens for r in got} == want
        assert all(r.n_bytes == len((rows[r.doc_id][1] or "").encode()) and r.over_limit == (r.n_tokens > 512) for r in got)


def test_token_counts_of_texts_without_a_space(spark, monkeypatch):
    """Runs without spaces splice at changes of class; chunk text stays within twice the text."""
    from tokenizers import Tokenizer
    rnd = random.Random(8)
    many = ["中", "文", "字", "。", "，", "ab", "Q", "7", "42", "+/", "=", "'", "'s", "é", "<|endoftext|>", "한국", "-"]
    rows = [(i, "".join(rnd.choices(many, k=3000))) for i in range(12)] + [(50, "x" * 9000), (51, "中文" * 5000)]
    rows.append((52, "".join(rnd.choices(many, k=600_000))))
    library = Tokenizer.from_file(tokencount.tokenizer_path())
    cut, sizes = tokencount._cut, []
    monkeypatch.setattr(tokencount, "_cut", lambda rows, size, overlap: (c := cut(rows, size, overlap), sizes.append((c.selectExpr("sum(length(part))").first()[0], rows.selectExpr("sum(length(text))").first()[0])))[0])
    got = {r.doc_id: r for r in tokencount.count_tokens(spark.createDataFrame(rows, DOC), chunk_chars=2000, overlap=64).collect()}
    assert {i: got[i].n_tokens for i, _ in rows} == {i: len(library.encode(t, add_special_tokens=False)) for i, t in rows}
    assert got[52].n_chunks > 100 and got[51].n_chunks == 1
    assert len(sizes) > 1 and all(parts <= 2 * text for parts, text in sizes)


def test_sentencepieces(spark):
    from sentencepiece import SentencePieceProcessor
    letters = ["a", "b", " ", "  ", "\n", "é", "中文字", "日本", "word", "ing", "12", "!", "the", " the", "tion", "e", "\U0001F600", "\t"]
    rows = list(enumerate(random_texts(letters, 80, 200, 2) + random_texts("etaoinsrhldANDq", 10, 400, 3) + ["x" * 300, "中文字日本語" * 50, "", None, " " * 100, "theingtion" * 60]))
    library = SentencePieceProcessor(model_file=sentencepieces.model_path())
    want = {i: None if t is None else library.encode(t) for i, t in rows}
    for chunk in (32768, 64):
        encoded = sentencepieces.encode(spark.createDataFrame(rows, DOC), chunk_chars=chunk)
        assert {r.doc_id: r.ids for r in sentencepieces.unpack(encoded).collect()} == want
        assert {r.doc_id: r.text for r in sentencepieces.decode(encoded).collect()} == dict(rows)
        at_once = sentencepieces.encode(spark.createDataFrame(rows, DOC), chunk_chars=chunk, forms=("ids", "text")).collect()
        assert {r.doc_id: (r.ids, r.text) for r in at_once} == {i: (want[i], t) for i, t in rows}


def test_a_giant_text_is_joined_once(spark):
    """Very many chunks of one text without a space."""
    from sentencepiece import SentencePieceProcessor
    text = "".join(random.Random(9).choices("中文字日本語ab1。", k=400_000))
    got = sentencepieces.encode(spark.createDataFrame([(1, text)], DOC), chunk_chars=512, forms=("ids", "text")).first()
    assert got.n_chunks > 700 and got.text == text
    assert got.ids == SentencePieceProcessor(model_file=sentencepieces.model_path()).encode(text)


def test_scan_is_associative():
    rnd = np.random.default_rng(0)
    mats = [np.where(rnd.random((3, 3)) < 0.5, 0.0, -np.inf) for _ in range(9)]
    ahead, by_step = sentencepieces.prefixes(mats), [mats[0]]
    for m in mats[1:]:
        by_step.append(sentencepieces.product(by_step[-1], m))
    assert all(np.array_equal(a, b) for a, b in zip(ahead, by_step, strict=True))


def test_recompression(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(80):
        words = rnd.choice([["a"], ["a", "b"], ["a", "b", "c", "d"], [f"w{j}" for j in range(40)]])
        rows.append((i * 3, " ".join(rnd.choices(words, k=rnd.randint(0, 60)))))
    rows += [(1000 - i, " ".join(rnd.choice(rows)[1].split()[rnd.randint(0, 9):] + rnd.choice(rows)[1].split())) for i in range(40)]
    for window in (6, 15):
        got = recompression.remove_repeats(spark.createDataFrame(rows, DOC), window).collect()
        assert {tuple(r) for r in got} == brute_repeats(rows, window)


def test_recompression_of_equal_and_null_ids(spark):
    """Rows that share an id, or have none, are each cut once at their own words."""
    rows = [(1, "p q r s t"), (5, "a p q r s t"), (5, "p q r s b c d e f g"), (5, "p q r s b c d e f g"), (7, "x p q r s"),
            (None, "h i j k l m n p q r s"), (None, "p q r s t u"), (None, "p q r s t u"), (None, "h i j k l")]
    keep = ["p q r s t", "a", "b c d e f g", "b c d e f g", "x", "h i j k l m n", "u", "u", "h i j k l"]
    want = [(i, len(t.split()), len(t.split()) - len(k.split()), hashlib.sha256(k.encode()).hexdigest()) for (i, t), k in zip(rows, keep, strict=True)]
    got = recompression.remove_repeats(spark.createDataFrame(rows, DOC), 4).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_decontamination_blocks_and_short_items(spark):
    rows, items = documents(), duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall() + [(900, "the of"), (901, "a"), (902, None)]
    docs, bench = spark.createDataFrame(rows, DOC), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute_hits(rows, items))
    for size in (1 << 20, 4000):
        assert sorted(tuple(r) for r in decontamination.report(decontamination.find_hits(docs, bench, block_bytes=size)).collect()) == want


def test_decontamination_by_items_without_id(spark):
    """As the SQL twin has it; the pipeline's form drops what they hit."""
    item = " ".join(f"n{i}" for i in range(14))
    rows = [(1, f"x {item} y"), (2, " ".join(f"n{i}" for i in range(9))), (3, "short one"), (4, f"short one {item} named item"), (5, None), (6, "named item")]
    items = [(None, item), (None, "short one"), (7, "named item"), (None, None)]
    docs, bench = spark.createDataFrame(rows, DOC), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    for name, column, own in (("documents", "doc_id", rows), ("benchmark", "item_id", items)):
        con.execute(f"create table {name} ({column} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", own)
    con.execute(f"create view twin as {ORACLE['op7_decontamination']}")
    twin = con.sql("select * from twin")
    columns, want = twin.columns, sorted(map(str, twin.fetchall()))
    for size in (1 << 20, 60):
        got = decontamination.report(decontamination.find_hits(docs, bench, block_bytes=size))
        assert want == sorted(str(tuple(r)) for r in got.select(*columns).collect())
        assert {r.doc_id for r in got.collect() if r.contaminated} == {1, 3, 4, 6}
        assert {r.doc_id for r in decontamination.drop_contaminated(docs, bench, block_bytes=size).collect()} == {2, 5}


def test_near_copies(spark):
    """A family of near copies some of which miss the threshold, links checked one by one."""
    rnd = random.Random(3)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(120)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rnd.randint(0, 9)):
            words[rnd.randrange(120)] = f"x{rnd.randint(0, 10**6)}"
        rows.append((500 - i, " ".join(words)))
    rows += [(900, base[0]), (901, base[0].upper()), (902, None)]
    sets = {i: set(zip(w, w[1:], strict=False)) or {tuple(w)} - {()} for i, w in ((i, (t or "").lower().split()) for i, t in rows)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOC), 2).collect()
    assert {tuple(r) for r in got} == {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 2**63, 400, dtype=np.uint64)
    both = np.concatenate([a, a[:300], rnd.integers(0, 2**63, 100, dtype=np.uint64)])
    sig = minhash.signatures(both, np.repeat([0, 1], 400), 2)
    assert abs((sig[0] == sig[1]).mean() - 300 / 500) < 0.1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, None), (300, 300), (7, 6)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(spark):
    rows = sorted(documents())
    got = {r.doc_id: r for r in syncmers.compare_edited(spark.createDataFrame(rows, DOC), parts=5).collect()}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        new = syncmers.edited(t, following)
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].fingerprint == syncmers.pack(syncmers.fingerprint(t)) and got[i].edited_fingerprint == syncmers.pack(syncmers.fingerprint(new))
        assert 0 <= got[i].near_next <= 1 and (len(t) < 60 or got[i].near_edited > 0.2)


def test_shards_of_a_hot_record(spark):
    """A third of all rows are one record, another third one id: shards stay near equal, positions gapless."""
    rows = [(1, "same text")] * 6000 + [(2, f"version {i}") for i in range(6000)] + [(i, "x" * (i % 50)) for i in range(10, 6010)]
    out = sharding.shard(spark.createDataFrame(rows, DOC), n_shards=8, n_slots=512).collect()
    assert len(out) == len(rows)
    load, places = {}, {}
    for r in out:
        load[r.shard] = load.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(load) == 8
    assert max(load.values()) < 1.1 * sum(load.values()) / 8
    assert sorted((r.doc_id, r.size) for r in out) == sorted((i, len(t) + 16) for i, t in rows)


def brute_anchors(text, k, s):
    """Closed syncmers written out k-mer by k-mer: the least of a k-mer's inner
    s-mers is its first or its last.  Names of s-mers as the library defines them."""
    wide = lambda x: x & (2 ** 64 - 1)

    def mix(x):
        x = wide((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9)
        x = wide((x ^ (x >> 27)) * 0x94D049BB133111EB)
        return x ^ (x >> 31)

    salt = lambda n: mix(wide((n + 1) * 0x9E3779B97F4A7C15)) | 1
    inner = lambda part: mix(wide(sum(mix(ord(c) + 1) * salt(j) for j, c in enumerate(part))))
    out = []
    for a in range(len(text) - k + 1):
        kmer = text[a:a + k]
        names = [inner(kmer[i:i + s]) for i in range(k - s + 1)]
        if min(names) in (names[0], names[-1]):
            whole = wide(sum(names[min(j, k - s)] * salt(j + 1) for j in range(0, k, s)))
            out.append((mix(whole) >> 32, a))
    return out


def brute_likeness(a, b):
    """Longest chain of common anchors in the same order, by the plain table; an
    anchor's n-th occurrence meets the other's n-th only."""
    if not a or not b:
        return float(len(a) == len(b))
    nth = lambda x: [(n, x[:i].count(n)) for i, n in enumerate(x)]
    x, y = nth(a), nth(b)
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, u in enumerate(x):
        for j, v in enumerate(y):
            best[i + 1][j + 1] = best[i][j] + 1 if u == v else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1] / max(len(x), len(y))


def test_fingerprints_against_the_definition(spark):
    """Anchors k-mer by k-mer and likeness by a plain table, for every document of a small table."""
    rnd = random.Random(12)
    base = " ".join("".join(rnd.choices("abcdeé", k=rnd.randint(2, 7))) for _ in range(60))
    rows = [(0, base), (1, base[:150] + "changed" + base[160:]), (2, "".join(rnd.choices("xyz 😀", k=200))), (3, "short"), (4, ""), (5, None), (6, "ab" * 70)]
    got = {r.doc_id: r for r in syncmers.compare_edited(spark.createDataFrame(rows, DOC), parts=2).collect()}
    k, s = syncmers.K, syncmers.S
    mine = lambda t: brute_anchors(t, k, s)
    for i, (_, t) in enumerate(rows):
        t, following = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        new = t[:len(t) - half] + following[:half]
        found = [(int(n), int(p)) for n, p in syncmers.unpack(got[i].fingerprint)]
        edit = [(int(n), int(p)) for n, p in syncmers.unpack(got[i].edited_fingerprint)]
        if mine(t):
            assert found == mine(t)
        else:  # one name of the whole text, none of the empty one
            assert len(found) == (1 if t else 0)
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and (edit == mine(new) or not mine(new))
        after = [(int(n), int(p)) for n, p in syncmers.unpack(got[(i + 1) % len(rows)].fingerprint)]
        names = lambda x: [n for n, _ in x]
        assert abs(got[i].near_edited - brute_likeness(names(found), names(edit))) < 1e-12
        assert abs(got[i].near_next - brute_likeness(names(found), names(after))) < 1e-12


def test_closed_syncmers_one_by_one():
    text = "context-free anchors for positional matching of documents " * 3
    k, s = 12, 4
    found = syncmers.anchors(text, k, s)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    assert len(found) and all(len(syncmers.anchors(text[a:a + k], k, s)) == 1 for a in found["at"])
    alone = [a for a in range(len(codes) - k + 1) if len(syncmers.anchors(text[a:a + k], k, s))]
    assert alone == found["at"].tolist()


def brute_secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark):
    rnd = random.Random(4)
    bits = ["password", "=", ": ", " ", "'", "token", "abc", "12345678", "AKIA", "ABCDEFGH1234", "é", "deadbeef" * 4, "API_KEY", "secret", "\U0001F600", "x"]
    rows = [(i, "".join(rnd.choices(bits, k=rnd.randint(0, 14))), f"s{i % 5}") for i in range(300)]
    opaque = "tok-ABCdef123456GHIjkl7890mno"
    rows += [(1000 + i, f"shared {opaque}", f"s{i}") for i in range(4)] + [(2000, f"own {opaque[::-1]}", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    for i, t, _ in rows:
        assert got[i].base_sha256 == hashlib.sha256(brute_secrets(t).encode()).hexdigest(), t
    assert "opaque" not in got[1000].spans and got[2000].spans == "opaque:4:33"
    masked = {r.doc_id: r.text for r in secrets.mask(docs).collect()}
    assert masked[1000] == f"shared {opaque}" and masked[2000] == "own [SECRET]"
    for i, t, _ in rows:
        spans = sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in got[i].spans.split(",") if x))
        want, at = "", 0
        for a, b in spans:
            want, at = want + (t[at:a] + "[SECRET]" if a >= at else ""), max(at, b)
        assert masked[i] == want + t[at:], t


def test_equal_items_are_one_and_blocks_come_one_by_one(spark):
    """A benchmark of several blocks: every block is written and its broadcast removed before the next."""
    passage = " ".join(f"p{i}" for i in range(14))
    items = [(f"i{k}", passage) for k in range(50)] + [(None, passage)] + [(f"x{k}", " ".join(f"q{k}_{i}" for i in range(12))) for k in range(40)]
    docs = [(1, f"before {passage} after"), (2, " ".join(f"q7_{i}" for i in range(11))), (3, "nothing here"), (4, None)]
    frame, bench = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id string, text string")
    assert sum(len(index.words) for index, _ in decontamination.indexes(bench, block_bytes=700)) == 41
    assert len(list(decontamination.indexes(bench, block_bytes=700))) > 3
    want = {1: sorted(f"i{k}" for k in range(50)) + [None], 2: ["x7"], 3: [], 4: []}
    for size in (700, 1 << 20):
        got = decontamination.find_hits(frame, bench, block_bytes=size).collect()
        assert {r.doc_id: r["items"] for r in got} == want
        assert {r.doc_id for r in decontamination.drop_contaminated(frame, bench, block_bytes=size).collect()} == {3, 4}


def test_very_many_secrets_in_one_text(spark):
    """Scanning and masking grow with a text's findings, not with their square."""
    n = 100_000
    text = " ".join(f"token=abcdefgh{i:06d}" for i in range(n))
    docs = spark.createDataFrame([(1, text, "s"), (2, "password: " + "x" * 5000 + " end", "s")], "doc_id long, text string, source string")
    began = time.time()
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    masked = {r.doc_id: r.text for r in secrets.mask(docs).collect()}
    assert time.time() - began < 120
    assert got[1].n_assign == n and got[1].spans.split(",")[-1] == f"assign:{len(text) - 20}:{len(text)}"
    assert masked == {1: " ".join(["[SECRET]"] * n), 2: "[SECRET] end"}


def test_repeated_rows_are_one_node(spark, monkeypatch):
    """1,000 rows of two near copies: two nodes, one pair, one shingle set each."""
    words = [f"w{i}" for i in range(60)]
    near = [*words[:-1], "other"]
    rows = [(i % 2, " ".join(near if i % 2 else words)) for i in range(1000)] + [(7, "quite another text of its own")]
    seen = {}
    link, verified = minhash.link, minhash.verified

    def counted_link(docs, nodes, k, percent):
        seen["nodes"] = nodes.count()
        return link(docs, nodes, k, percent)

    def counted_verified(docs, pairs, k, percent):
        out = verified(docs, pairs, k, percent)
        seen.setdefault("pairs", []).append((pairs.count(), out.count()))
        return out

    sets = minhash.shingle_sets
    monkeypatch.setattr(minhash, "link", counted_link)
    monkeypatch.setattr(minhash, "verified", counted_verified)
    monkeypatch.setattr(minhash, "shingle_sets", lambda docs, k: (s := sets(docs, k), seen.setdefault("sets", []).append(s.count()))[0])
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOC), 5).collect()
    assert len(got) == 1001 and {(r.doc_id, r.component_id) for r in got} == {(0, 0), (1, 0), (7, 7)}
    assert seen["nodes"] == 3 and seen["pairs"][0] == (1, 1) and seen["sets"][0] == 2


def test_no_python_in_secret_plan(spark):
    plan = secrets.scan(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_shards_balance_and_edit(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    recs = sharding.records(docs, 512).cache()
    slots = sharding.slot_table(recs)
    plan = sharding.plan_map(slots, 8, 512)
    rows = sharding.assign(recs, plan, slots).collect()
    load, places = {}, {}
    for r in rows:
        load[r.shard] = load.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert max(load.values()) - min(load.values()) <= max(b for _, _, b in slots)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    grown = sharding.edit_map(plan, slots, 9)
    moved = [v for v in plan if plan[v] != grown[v]]
    assert moved and sum(grown[v] == 8 for v in moved) >= 0.7 * len(moved) and len(moved) < 512 / 3
    shrunk = sharding.edit_map(grown, slots, 8)
    assert set(shrunk.values()) <= set(range(8))
    for version, mapping in ((1, plan), (2, grown)):
        sharding.save_map(sharding.map_frame(spark, version, mapping, slots), str(tmp_path / "map"))
    assert sharding.load_map(spark, str(tmp_path / "map"), 1) == plan and sharding.load_map(spark, str(tmp_path / "map"), 2) == grown
