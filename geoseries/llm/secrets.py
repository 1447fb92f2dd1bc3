"""Operator 6, secret scans with corpus-wide ownership frequency (DataFrame functions only).

Four kinds of candidates are found in whole texts: ``assign``, ``access`` and
``hex`` are the base kinds and always count; ``opaque`` is any other run of 24
or more letters, digits, ``_`` and ``-`` with four digits and a letter outside
every base span.  Candidates are hashed in the scan; per hash the distinct
owners and repositories in the whole corpus are counted.  A value that more
than ``max_owners`` owners carry is a widely copied example; one that stays
with its owner looks live.  An opaque run is reported only if it looks live.

Positions come from the lengths of the text between matches, summed by a
window over the matches of one text.  Every text is searched once for
candidates; those with one are written and their matches become rows, of which
only lengths and hashes go on.

Nulls: a null text is empty; a null owner or repository counts as none.
Repeated rows are scanned alike; an empty table gives an empty result.  Only
the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoseries.session import cut_lineage

MAX_OWNERS = 2
MASK = "[SECRET]"
BLOCK = 1000        # code points of a text that are rebuilt at once
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short fails as a whole, so the least length can stand in the pattern; for
#: ``assign`` it cannot, since a match that is dropped still uses up its text.
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}", "opaque": r"[A-Za-z0-9_-]{24,}"}
DIGITS = r"[0-9](?:[^0-9]*[0-9]){3}"


def has_candidate(text: Column) -> Column:
    out = F.lit(False)
    for p in PATTERNS.values():
        out = out | text.rlike(p)
    return out


def _pairs(text: Column, no: int, kind: str) -> Column:
    """struct<kind, array<struct<match, gap before it>>> of one kind, in text order
    (a last pair holds what follows the last match)."""
    found, gaps = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1)
    return F.struct(F.lit(no).alias("kind"), F.arrays_zip(found.alias("m"), gaps.alias("gap")).alias("pairs"))


def candidates(flagged: DataFrame) -> DataFrame:
    """(row_key, owner, repo, kind, start, end, value) of the staged rows' candidates.

    The matches and the gaps between them become rows first, so each text is
    searched once a kind and each match is looked at by itself."""
    kinds = flagged.select("row_key", "owner", "repo", F.explode(F.array(*[_pairs(F.col("text"), no, kind) for no, kind in enumerate(KINDS)])).alias("k"))
    rows = kinds.select("row_key", "owner", "repo", "k.kind", F.posexplode("k.pairs").alias("no", "p")).filter("p.m is not null")
    m = F.col("p.m")
    value = F.when(F.col("kind") == 0, F.regexp_extract(m, ASSIGN, 2)).otherwise(m)
    # as first searched, a match that is too short still uses up its text
    ok = F.when(F.col("kind") == 0, F.length(value) >= 8).when(F.col("kind") == 3, m.rlike(DIGITS) & m.rlike("[A-Za-z]")).otherwise(True)
    rows = rows.select("row_key", "owner", "repo", "kind", "no", F.length("p.gap").cast("long").alias("gap"), F.length(m).cast("long").alias("len"),
                       ok.alias("ok"), F.sha2(value.cast("binary"), 256).alias("value"))
    in_order = Window.partitionBy("row_key", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    placed = (rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(in_order)).withColumn("start", F.col("end") - F.col("len"))
              .filter("ok").select("row_key", "owner", "repo", "kind", "start", "end", "value"))
    # opaque runs that touch a base span are that span's, not findings of their own
    by_start = Window.partitionBy("row_key").orderBy("start", "kind")
    base = F.col("kind") < 3
    before = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    # the next base span, as a running minimum from the end (a frame that runs to the end is worked out anew for every row)
    from_end = Window.partitionBy("row_key").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.min(F.when(base, F.col("start"))).over(from_end)
    apart = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return placed.withColumn("apart", base | apart).filter("apart").drop("apart")


def ownership(found: DataFrame) -> DataFrame:
    """(value, owners, repos): distinct owners and repositories per candidate hash."""
    per_owner = found.select("value", "owner", "repo").distinct().groupBy("value", "owner").agg(F.count("repo").alias("n"))
    return per_owner.groupBy("value").agg(F.count("owner").alias("owners"), F.sum("n").alias("repos"))


def _flagged(docs: DataFrame, owner: str, repo: str, keep: list[str], texts: bool) -> tuple[DataFrame, DataFrame]:
    """(rows with a candidate, rows without), both with the columns ``keep`` as
    ``row`` and with ``text``, that of clean rows only if ``texts``: every text is
    searched once and the outcome written with it."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    marked = docs.select(row, F.col("text").cast("string").alias("text"), F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"),
                         has_candidate(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("some"))
    if not texts:
        marked = marked.withColumn("text", F.when(F.col("some"), F.col("text")))
    staged = cut_lineage(marked.withColumn("row_key", F.monotonically_increasing_id()), "flagged")
    return staged.filter("some").drop("some"), staged.filter("not some").drop("some")


def findings(flagged: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """(row_key, start, kind, end, owners, repos, live): base spans and live opaque runs."""
    found = cut_lineage(candidates(flagged), "candidates")
    known = found.join(ownership(found), "value").withColumn("live", F.col("owners") <= max_owners)
    return known.filter((F.col("kind") < 3) | F.col("live")).select("row_key", "start", "kind", "end", "owners", "repos", "live")


def find_secrets(flagged: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """(row_key, spans): array<struct<start, kind, end, owners, repos, live>> sorted by start and kind."""
    return (findings(flagged, max_owners).groupBy("row_key")
            .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repos", "live"))).alias("spans")))


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", repo: str = "doc_id", max_owners: int = MAX_OWNERS) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example."""
    flagged, clean = _flagged(docs, owner, repo, ["doc_id"], texts=False)
    found = flagged.select("row_key", F.col("row.doc_id").alias("doc_id")).join(find_secrets(flagged, max_owners), "row_key", "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,owners:bigint,repos:bigint,live:boolean>>")
    rows = found.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("spans", none).alias("s")).unionByName(
        clean.select(F.col("row.doc_id").cast("long").alias("doc_id"), none.alias("s")))
    n = lambda test: F.size(F.filter("s", test)).cast("long")
    return rows.select("doc_id", n(lambda x: x["kind"] == 0).alias("n_assign"), n(lambda x: x["kind"] == 1).alias("n_access"), n(lambda x: x["kind"] == 2).alias("n_hex"),
                       F.sha2(_text_of(F.filter("s", lambda x: x["kind"] < 3)).cast("binary"), 256).alias("base_sha256"), _text_of(F.col("s")).alias("spans"),
                       n(lambda x: x["live"]).alias("n_live"), n(lambda x: ~x["live"]).alias("n_example"))


def _cuts(spans: DataFrame) -> DataFrame:
    """(row_key, start, end): findings that overlap are cut out as one."""
    by_start = Window.partitionBy("row_key").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.withColumn("opens", (F.col("start") >= F.coalesce(reach, F.lit(0))).cast("int"))
    return (apart.withColumn("cut", F.sum("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("row_key", "cut").agg(F.min("start").alias("start"), F.max("end").alias("end")))


def mask(docs: DataFrame, owner: str = "source", repo: str = "doc_id", max_owners: int = MAX_OWNERS) -> DataFrame:
    """The rows with every finding (base spans and live opaque runs) replaced by
    ``[SECRET]``; clean rows as they are.  Texts are rebuilt in blocks, each with
    the cuts that reach into it, so the work grows with a text's length and its
    findings, not with their product."""
    others = [c for c in docs.columns if c != "text"]
    flagged, clean = _flagged(docs, owner, repo, others, texts=True)
    first, last = F.col("start"), F.col("end") - 1
    reaching = (_cuts(findings(flagged, max_owners)).select("row_key", "start", "end", F.explode(F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK))).alias("block_no"))
                .groupBy("row_key", "block_no").agg(F.array_sort(F.collect_list(F.struct(
                    F.greatest(first - F.col("block_no") * BLOCK, F.lit(0)).cast("int").alias("lo"), F.least(F.col("end") - F.col("block_no") * BLOCK, F.lit(BLOCK)).cast("int").alias("hi"),
                    (F.floor(first / BLOCK) == F.col("block_no")).alias("opens")))).alias("cuts")))
    blocks = flagged.select("row_key", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("block_no", "block"))
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("cuts", none, lambda a, c: F.struct(c["hi"].alias("at"), F.concat(a["out"], F.col("block").substr(a["at"] + 1, c["lo"] - a["at"]), F.when(c["opens"], F.lit(MASK)).otherwise("")).alias("out")))
    rebuilt = (blocks.join(reaching, ["row_key", "block_no"], "left").withColumn("done", done)
               .withColumn("block", F.when(F.col("cuts").isNull(), F.col("block")).otherwise(F.concat("done.out", F.col("block").substr(F.col("done.at") + 1, F.lit(BLOCK)))))
               .groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("block_no", "block"))).alias("b"))
               .select("row_key", F.array_join(F.transform("b", lambda x: x["block"]), "").alias("masked")))
    rows = flagged.drop("text").join(rebuilt, "row_key")
    columns = lambda text: [F.col(f"row.`{c}`") if c != "text" else text.alias("text") for c in docs.columns]
    return rows.select(*columns(F.col("masked"))).unionByName(clean.select(*columns(F.col("text"))))
