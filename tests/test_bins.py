"""Golden G1: binning, grid gaps and attention level."""
import datetime as dt

from pyspark.sql import functions as F

from geoseries.operators import bins


def _g1(spark):
    rows = [("2020-01-01 01:00:00", "a", 1, 1), ("2020-01-01 10:00:00", "a", 2, 2),
            ("2020-01-01 10:30:00", "a", 2, 3), ("2020-01-02 00:30:00", "b", 5, 4)]
    df = spark.createDataFrame(rows, "ts string, nhood string, id int, p int")
    return df.withColumn("ts", F.to_timestamp_ntz("ts"))


def T(s):
    return dt.datetime.fromisoformat(s)


def test_count_grid_3h(spark):
    out = bins.time_groupby(_g1(spark), "id", "count", ["a", "b", "e"], "3H", ts_col="ts", nhood_col="nhood")
    got = {(r.bin, r.nhood): r.value for r in out.collect()}
    grid_bins = {T("2020-01-01 00:00"), T("2020-01-01 03:00"), T("2020-01-01 06:00"),
                 T("2020-01-01 09:00"), T("2020-01-02 00:00")}
    assert {b for b, _ in got} == grid_bins            # 12:00-21:00 absent
    assert {n for _, n in got} == {"a", "b", "e"}      # e: all-zero column
    assert got[(T("2020-01-01 00:00"), "a")] == 1
    assert got[(T("2020-01-01 09:00"), "a")] == 1      # id 2 twice -> distinct 1
    assert got[(T("2020-01-02 00:00"), "b")] == 1
    assert sum(v for (b, n), v in got.items() if n == "e") == 0
    assert len(got) == 15


def test_attention_level_values(spark):
    out = bins.attention_level(_g1(spark), "all", "180Min", id_col="id", priority_col="p",
                               ts_col="ts", nhood_col="nhood")
    got = {(r.bin, r.nhood): round(r.att_level, 6) for r in out.collect()}
    assert got[(T("2020-01-01 00:00"), "a")] == 1.5
    assert got[(T("2020-01-01 09:00"), "a")] == round(1 / 3.5 + 1, 6)   # 1.285714
    assert got[(T("2020-01-02 00:00"), "b")] == 1.2
    assert got[(T("2020-01-01 03:00"), "a")] == 1.0                   # empty bin
    assert got[(T("2020-01-01 00:00"), "b")] == 1.0


def test_five_hour_bins_use_first_day_origin(spark):
    out = bins.time_groupby(_g1(spark), "id", "count", "all", "5H", ts_col="ts", nhood_col="nhood")
    assert {r.bin for r in out.collect()} == {T("2020-01-01 00:00"), T("2020-01-01 05:00"),
                                               T("2020-01-01 10:00"), T("2020-01-02 00:00")}


def test_avg_empty_is_zero_and_bad_agg(spark):
    out = bins.time_groupby(_g1(spark), "p", "avg", "all", "3H", ts_col="ts", nhood_col="nhood")
    got = {(r.bin, r.nhood): r.value for r in out.collect()}
    assert got[(T("2020-01-01 09:00"), "a")] == 2.5
    assert got[(T("2020-01-01 03:00"), "b")] == 0.0
    try:
        bins.time_groupby(_g1(spark), "p", "sum", "all", "3H", ts_col="ts", nhood_col="nhood")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_pivot_unpivot_identity(spark):
    long = bins.time_groupby(_g1(spark), "id", "count", "all", "3H", ts_col="ts", nhood_col="nhood")
    wide = bins.to_wide(long, "nhood", "value")
    back = bins.to_long(wide, ["bin"], "nhood", "value")
    assert sorted(back.collect()) == sorted(long.select("bin", "nhood", "value").collect())


def test_sum_of_counts_equals_distinct_ids(spark):
    df = _g1(spark)
    long = bins.time_groupby(df, "id", "count", "all", "3H", ts_col="ts", nhood_col="nhood")
    assert long.agg(F.sum("value")).first()[0] == df.select("id").distinct().count()


def test_bins_from_cells_of_a_common_divisor(spark):
    """Widths that do not divide a day: origins, counts and means as row by row, from one pass
    that writes distinct cells only."""
    import datetime as dt
    import random
    rnd = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(rnd.choice("abc"), start + dt.timedelta(minutes=rnd.randrange(9000) + 700 * "abc".index(n)), rnd.randrange(40), rnd.choice([1, 2, 5, None]))
            for n in "abc" for _ in range(300)]
    df = spark.createDataFrame(rows, "FID_nhood string, t timestamp_ntz, id long, pri int").withColumn("t", F.col("t").cast("timestamp_ntz"))
    for freq, seconds in (("5H", 18000), ("7H", 25200), ("90Min", 5400), ("10H", 36000), ("3H", 10800)):
        got = {(r.FID_nhood, r.bin): (r.n, r.m) for r in bins.binned(df, "t", "FID_nhood", freq, {"n": "id"}, {"m": "pri"}).collect()}
        origin = {}
        for k, t, *_ in rows:
            origin[k] = min(origin.get(k, t), t)
        want = {}
        for k, t, i, p in rows:
            d0 = origin[k].replace(hour=0, minute=0, second=0, microsecond=0)
            at = d0 + dt.timedelta(seconds=int((t - d0).total_seconds() // seconds) * seconds)
            ids, pris = want.setdefault((k, at), (set(), []))
            ids.add(i)
            pris += [p] if p is not None else []
        assert {k: len(v[0]) for k, v in want.items()} == {k: v[0] for k, v in got.items()}
        assert all((sum(v[1]) / len(v[1]) if v[1] else None) == got[k][1] or abs(sum(v[1]) / len(v[1]) - got[k][1]) < 1e-12 for k, v in want.items())
