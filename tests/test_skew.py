"""The paths for hot keys and large groups give what the plain paths give."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime
from statistics import median

import pytest
from pyspark.sql import functions as F

from woonvonk.operators import benchmarks, history, matching, skew
from woonvonk.operators.skew import group_median, top_n_per_key, value_ranks, with_previous

ORDER = ["observed_at", "seq"]


def timeline(spark, n=600, seed=3):
    """Three listings, one of which holds most rows; gaps and repeats in prices and times."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 1 if rng.random() < 0.7 else rng.choice([2, 3])
        rows.append((key, 1_700_000_000 + 900 * rng.randrange(400), i, rng.choice([None, 10.0, 20.0, 30.0]), rng.choice(["active", "sold", "withdrawn"])))
    return spark.createDataFrame(rows, "listing_id int, t bigint, seq int, asking_price double, listing_status string").withColumn(
        "observed_at", F.timestamp_seconds("t")
    )


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.listing_id].append(r)
    out = {}
    for group in groups.values():
        last, known = None, None
        for no, r in enumerate(sorted(group, key=lambda r: (r.t, r.seq)), 1):
            out[r.seq] = (no, last, known)
            last = r.asking_price
            known = r.asking_price if r.asking_price is not None else known
    return out


def test_look_back_in_slices_equals_plain(spark):
    rows = timeline(spark)
    want = expected(rows.collect())
    for hot_rows in (10**9, 50, 0):
        got = with_previous(
            rows, "listing_id", "observed_at", ORDER,
            previous={"before": F.col("asking_price")}, previous_filled={"known": F.col("asking_price")}, hot_rows=hot_rows,
        ).collect()
        assert {r.seq: (r.row_no, r.before, r.known) for r in got} == want


def test_history_in_slices_equals_plain(spark):
    rows = timeline(spark, seed=8).withColumn("surface_m2", F.lit(1.0))
    for build in (
        lambda h: history.listing_history(rows, ORDER, hot_rows=h),
        lambda h: history.price_reductions(rows, ORDER, hot_rows=h),
        lambda h: history.snapshot_changes(rows, ORDER, ["asking_price", "listing_status"], hot_rows=h).drop("content_hash"),
    ):
        assert sorted(map(repr, build(10**9).collect())) == sorted(map(repr, build(20).collect()))


def test_ranks_in_slices_equal_plain(spark):
    rng = random.Random(5)
    rows = [("big" if rng.random() < 0.8 else "small", rng.choice([None, rng.randrange(2000) / 4])) for _ in range(3000)] + [("one", 7.0)]
    df = spark.createDataFrame(rows, "city string, price double")
    plain, sliced = (sorted(map(tuple, value_ranks(df, ["city"], "price", window_rows=w).collect())) for w in (10**6, 0))
    assert plain == sliced
    by_city = defaultdict(list)
    for city, price in rows:
        if price is not None:
            by_city[city].append(price)
    got = {r.city: r["median"] for r in group_median(df, ["city"], "price").collect()}
    assert got == {c: median(p) for c, p in by_city.items()}
    for city, value, n, upto, total in plain:
        assert n == by_city[city].count(value) and upto == sum(p <= value for p in by_city[city]) and total == len(by_city[city])


def brute_force(incoming, existing):
    import re

    def norm(a):
        return re.sub(r"[^a-z0-9\s-]", "", re.sub(r"\s+", " ", (a or "").strip().lower()))

    def keys(r):
        yield 1, (r["source_name"], r["external_listing_id"]) if r["external_listing_id"] else None
        m = re.match(r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)", r["source_url"] or "")
        yield 2, (m.group(1).lower(), m.group(2).lower(), m.group(3).rstrip("/")) if m else None
        post = re.search(r"\b([1-9][0-9]{3})\s*([A-Za-z]{2})\b", r["address"] or "")
        house = re.search(r"\b(\d+)([A-Za-z0-9\-]*)\b", norm(r["address"]))
        yield 3, (post.group(1) + post.group(2).upper(), house.groups()) if post and house else None
        yield 4, norm(r["address"]) or None

    out = {}
    for i in incoming:
        best = None
        for tier, key in keys(i):
            hits = [e["listing_id"] for e in existing if key is not None and dict(keys(e))[tier] == key]
            if hits:
                best = (tier, min(hits))
                break
        out[i["record_id"]] = best
    return out


def test_matching_against_brute_force(spark):
    rng = random.Random(11)

    def record(i):
        return dict(
            source_name=rng.choice(["a", "b"]),
            external_listing_id=rng.choice([None, "", str(rng.randrange(30))]) or None,
            source_url=rng.choice(["https://X.example/p/{}", "https://x.example/p/{}/", "http://y.example/q?i={}", "leeg {}"]).format(rng.randrange(40)),
            address=rng.choice(["Straat {} 1234 AB", "straat {},  1234ab", "Plein {}-A", None]) and rng.choice(["Straat {} 1234 AB", "straat {},  1234ab", "Plein {}-A"]).format(rng.randrange(25)) if rng.random() < 0.8 else None,
            surface_m2=float(rng.randrange(40, 60)),
        )

    existing = [dict(record(i), listing_id=i) for i in range(200)]
    incoming = [dict(record(i), record_id=i) for i in range(200)]
    shape = "source_name string, external_listing_id string, source_url string, address string, surface_m2 double"
    matched = matching.match_listings(
        spark.createDataFrame(incoming, f"{shape}, record_id int"), spark.createDataFrame(existing, f"{shape}, listing_id int"), []
    ).collect()
    tiers = {name: tier for tier, name, _ in matching.TIERS}
    got = {r.record_id: (tiers[r.match_method], r.matched_listing_id) if r.matched_listing_id is not None else None for r in matched}
    assert got == brute_force(incoming, existing)


def test_no_pairs_for_copies(spark):
    """Thousands of copies on both sides give one match per incoming row."""
    copies = spark.range(3000).selectExpr(
        "id", "'a' AS source_name", "cast(null AS string) AS external_listing_id", "'https://x.example/same' AS source_url",
        "'Straat 1, 1234 AB' AS address", "50.0D AS surface_m2",
    )
    for strict in (True, False):
        matched = matching.match_listings(
            copies.withColumnRenamed("id", "record_id"), copies.withColumnRenamed("id", "listing_id"), [], strict_address=strict
        )
        assert matched.count() == 3000 and matched.select("matched_listing_id").distinct().collect() == [(0,)]


def test_two_misses_before_inactive(spark):
    runs = spark.createDataFrame(
        [(1, "r1", 1, "completed"), (1, "r2", 2, "completed"), (1, "r3", 3, "failed"), (2, "q1", 1, "completed")],
        "source_id int, run_id string, started_at int, status string",
    )
    seen = spark.createDataFrame([(1, "r1", 10), (1, "r1", 11), (1, "r2", 10), (2, "q1", 20)], "source_id int, run_id string, listing_id int")
    listings = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 20), (2, 21)], "source_id int, listing_id int")
    got = {r.listing_id: r.mark_inactive for r in matching.two_miss_inactive(listings, seen, runs).collect()}
    assert got == {11: False, 12: True}


def test_upsert_overwrites_with_nulls_and_keeps_first_seen(spark):
    shape = "listing_id int, source_url string, asking_price double, first_seen_at string"
    stored = spark.createDataFrame([(1, "https://a.example/x/", 10.0, "old"), (2, "https://a.example/y", 20.0, "old")], shape)
    news = spark.createDataFrame([(8, "HTTPS://A.example/x", None, "new", 2), (7, "https://a.example/x", 5.0, "new", 1), (9, "https://a.example/z", 30.0, "new", 1)], f"{shape}, seq int")
    got = {r.listing_id: (r.asking_price, r.first_seen_at) for r in matching.upsert_listings(stored, news, ["seq"]).collect()}
    assert got == {1: (None, "old"), 2: (20.0, "old"), 9: (30.0, "new")}


def test_top_n_is_trimmed_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id", "id % 2 AS city", "id % 50 AS score")
    best = top_n_per_key(df, ["city"], [F.col("score").desc(), F.col("id")], 20)
    assert best.count() == 40
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()


def test_look_back_of_null_and_early_times(spark):
    """NULL keys and times, the epoch, times before it, and one instant that holds most rows."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        t = rng.choice([None, 0, 0, -1, -3600, -7200, 3600, 1_700_000_000, 1_700_000_000, 1_700_000_000])
        rows.append((rng.choice([None, 1, 1, 1, 2]), t, i, rng.choice([None, 10.0, 20.0]), "active"))
    df = spark.createDataFrame(rows, "listing_id int, t bigint, seq int, asking_price double, listing_status string")
    df = df.withColumn("observed_at", F.timestamp_seconds("t")).withColumn("surface_m2", F.lit(1.0))
    for build in (
        lambda h: with_previous(
            df, "listing_id", "observed_at", ORDER, previous={"before": F.col("asking_price")},
            previous_filled={"known": F.col("asking_price")}, hot_rows=h,
        ),
        lambda h: history.snapshot_changes(df, ORDER, ["asking_price"], hot_rows=h).drop("content_hash"),
        lambda h: history.listing_history(df, ORDER, hot_rows=h),
        lambda h: history.price_points(df, ORDER, hot_rows=h),
        lambda h: history.previous_prices(
            df, spark.createDataFrame([(1, 10.0), (None, 20.0)], "listing_id int, current_price double"), ORDER, hot_rows=h
        ),
    ):
        plain, mixed, split = (sorted(map(repr, build(h).collect())) for h in (10**9, 100, 0))
        assert plain == mixed == split and plain


def test_ranks_of_the_null_group(spark):
    df = spark.createDataFrame([(None, float(i % 7)) for i in range(50)] + [("a", float(i)) for i in range(30)], "city string, price double")
    plain, sliced = (sorted(map(repr, value_ranks(df, ["city"], "price", window_rows=w).collect())) for w in (10**6, 0))
    assert plain == sliced and any("city=None" in r for r in plain)


@pytest.mark.parametrize("window_rows", [10**6, 3])
def test_measures_from_one_table_equal_separate_ones(spark, monkeypatch, window_rows):
    """NULL prices and areas, cities without any price, repeated rows; with plain windows and with chained ranges."""
    rows = [(i, f"c{i % 4}" if i % 9 else None, None if i % 5 == 0 or i % 4 == 3 else 1000.0 * (i % 7), None if i % 6 == 0 else 10.0 + i % 3) for i in range(120)]
    df = spark.createDataFrame(rows + rows[:7], "id long, city string, asking_price double, surface_m2 double")
    base = benchmarks.with_ppm2(df).withColumn("city_key", benchmarks.city_key())
    apart = benchmarks.with_percentile(benchmarks.join_city_benchmarks(base), "city_key", "price_per_m2", "share")
    ranks = skew.ranks_of
    monkeypatch.setattr(benchmarks, "ranks_of", lambda counts, keys, value: ranks(counts, keys, value, window_rows))
    once = benchmarks.with_city_measures(base, "share")
    key = lambda d: sorted(map(repr, d.select(*sorted(d.columns)).collect()))
    assert sorted(once.columns) == sorted(apart.columns) and key(once) == key(apart)


@pytest.mark.parametrize("hot_rows", [10**6, 40, 0])
def test_price_history_agrees_with_its_parts(spark, hot_rows):
    draw = random.Random(5)
    days = [datetime(2001, 3, day, 12) for day in (1, 2, 2, 9, 30)]
    rows = []
    for k in [None, 1, 2, 3, 4, 5]:
        for _ in range({1: 90, 2: 45, 3: 1}.get(k, 20)):
            price = draw.choice([None, -5.0, 0.0, 100.0, 100.0, 100.004, 200.0, 300.0, 250.5])
            rows.append((k, draw.choice([None, *days]), draw.randrange(40), price, draw.choice(["active", "sold"])))
    schema = "listing_id long, observed_at timestamp, snapshot_seq long, asking_price double, listing_status string"
    snapshots = spark.createDataFrame(rows, schema)
    current = spark.createDataFrame([(1, 200.0), (2, None), (4, 100.0), (9, 1.0)], "listing_id long, current_price double")
    order = ["observed_at", "snapshot_seq", "asking_price", "listing_status"]
    counts = {r[0]: r.reduction_count for r in history.price_change_counts(snapshots, order).collect()}
    steps: dict = {}
    for r in sorted(history.previous_prices(snapshots, current, order).where("listing_id IS NOT NULL").collect(), key=lambda r: (r.listing_id, r.step_no)):
        steps.setdefault(r.listing_id, []).append(r.price)
    oldest = {}
    for k, at, *_ in rows:
        if at is not None and k is not None:
            oldest[k] = min(at.date(), oldest.get(k, at.date()))
    found = {r.listing_id: r for r in history.price_history(snapshots, current, order, 4, hot_rows=hot_rows).collect()}
    assert set(found) == {1, 2, 3, 4, 5}
    for k, r in found.items():
        assert (r.reduction_count, r.oldest, r.earlier) == (counts[k], oldest.get(k), steps.get(k, [])[-4:])
    assert any(len(s) > 4 for s in steps.values())
