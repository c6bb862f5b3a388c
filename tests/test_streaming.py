"""Streams give what the batch jobs give, across restarts and however what has landed is cut into micro-batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from woonvonk.operators import history
from woonvonk.plans.registry import JOBS
from woonvonk.plans.views import view
from woonvonk.streaming import jobs

SF = "/root/testdata/sf0.001"
ORDER = ["observed_at", "seq", "asking_price", "listing_status"]


@pytest.fixture(scope="module", autouse=True)
def catalog():
    from woonvonk.plans import catalog as loaded

    return loaded


def observations(spark, rows):
    """(listing_id, source_id, seconds, seq, price, status) as observations; a time of None stays None."""
    df = spark.createDataFrame(rows, "listing_id bigint, source_id int, t bigint, seq bigint, asking_price double, listing_status string")
    return df.withColumn("observed_at", F.timestamp_seconds("t")).drop("t")


def test_change_stream_equals_batch(spark):
    streamed = JOBS["stream_change_detection"](spark, SF)
    batch = history.snapshot_changes(view(spark, SF, "observations"), ORDER, ["asking_price", "listing_status"]).select(
        "listing_id", "seq", "change_type"
    )
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_current_state_survives_replay_and_compaction(spark, tmp_path):
    rows = view(spark, SF, "observations").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    landing, out = str(tmp_path / "landing"), str(tmp_path / "table")
    jobs.land(rows, landing, 0)
    for mark in ("one", "two"):  # a second checkpoint replays the same batch number
        jobs.upsert_current(jobs.read_observations(spark, landing), out, str(tmp_path / mark)).awaitTermination()
    current = jobs.current_state(spark, out)
    assert current.count() == rows.select("listing_id").distinct().count()
    jobs.compact(spark, out, str(tmp_path / "folded"))
    assert sorted(map(repr, jobs.newest_rows(spark.read.parquet(str(tmp_path / "folded"))).collect())) == sorted(map(repr, current.collect()))


def test_late_rows_withdraw_and_add_changes(spark, tmp_path):
    landing, out, seen = (str(tmp_path / x) for x in ("landing", "changes", "seen"))
    landings = [
        [(1, 1, 100, 1, 10.0, "active"), (1, 1, 200, 2, 12.0, "active"), (2, 1, 100, 3, None, "sold")],
        # 150 takes the change of 200 over and makes it another; 900 comes back on the market; no listing, no time
        [(1, 1, 150, 4, 12.0, "active"), (1, 1, 300, 5, 12.0, "active"), (2, 1, 900, 6, None, "active"), (3, 1, 1, 7, 5.0, "active")],
        [(3, 1, 0, 8, 5.0, "active"), (3, 1, 2, 9, 6.0, "active"), (None, 1, 5, 10, 1.0, "active"), (1, 1, 250_000, 11, 12.0, "sold")],
        [(1, 1, 100_000, 12, 13.0, "active"), (4, 1, None, 13, 1.0, "active"), (4, 1, 7, 14, 1.0, "active")],
    ]
    expected = [
        {(1, "new_listing"), (2, "asking_price_change"), (3, "new_listing")},
        {(1, "new_listing"), (4, "asking_price_change"), (3, "new_listing"), (6, "relisting_signal"), (7, "new_listing")},
        {(1, "new_listing"), (4, "asking_price_change"), (11, "listing_status_change"), (3, "new_listing"), (6, "relisting_signal"), (8, "new_listing"), (9, "asking_price_change")},
        {(1, "new_listing"), (4, "asking_price_change"), (12, "asking_price_change"), (11, "asking_price_change"), (3, "new_listing"), (6, "relisting_signal"), (8, "new_listing"), (9, "asking_price_change"), (13, "new_listing")},
    ]
    first = [{1, 3}, {1, 3, 7}, {1, 3, 8}, {1, 3, 8, 14}]
    for k, rows in enumerate(landings):
        jobs.land(observations(spark, rows), landing, k)
        jobs.change_detection(jobs.read_observations(spark, landing), out, str(tmp_path / "c1")).awaitTermination()
        jobs.only_new(jobs.read_observations(spark, landing), seen, str(tmp_path / "c2")).awaitTermination()
        assert {(r.seq, r.change_type) for r in jobs.detected_changes(spark, out).collect()} == expected[k]
        assert {r.seq for r in jobs.first_seen(spark, seen).collect()} == first[k]
    log = spark.read.parquet(out + "/changes").where("sign < 0")
    assert {(r.seq, r.change_type) for r in log.collect()} == {(2, "asking_price_change"), (7, "new_listing"), (11, "listing_status_change")}
    corrected = spark.read.parquet(seen).where("corrects")
    assert [r.seq for r in corrected.collect()] == [8]


@pytest.mark.parametrize("hot_rows", [10**6, 5])
def test_changes_of_random_landings_equal_batch(spark, tmp_path, hot_rows):
    """Rows over several days in any order, with ties, repeated rows and one listing that holds most of them."""
    rng = random.Random(hot_rows)
    landing, out = str(tmp_path / "landing"), str(tmp_path / "changes")
    rows = [
        (rng.choice([1, 1, 1, 2, 3]), 1, rng.randint(0, 8) * 43_200, rng.randint(0, 3), rng.choice([1.0, 2.0, None]), rng.choice(["active", "sold", None]))
        for _ in range(90)
    ]
    rows += rows[:5]
    rng.shuffle(rows)
    for k in range(4):
        jobs.land(observations(spark, rows[k::4]).coalesce(1), landing, k)
        jobs.change_detection(jobs.read_observations(spark, landing), out, str(tmp_path / "mark"), hot_rows=hot_rows).awaitTermination()
    batch = history.snapshot_changes(observations(spark, rows), ORDER, ["asking_price", "listing_status"])
    columns = ["listing_id", *ORDER, "change_type"]
    key = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert key(jobs.detected_changes(spark, out)) == key(batch)


def test_a_replayed_batch_replaces_its_own_files(spark, tmp_path):
    landing = str(tmp_path / "landing")
    jobs.land(observations(spark, [(1, 1, 100, 1, 10.0, "active"), (1, 2, 3_000, 2, 11.0, "sold")]), landing, 0)
    stream = lambda: jobs.read_observations(spark, landing)
    for mark in ("one", "two"):
        jobs.partial_counts(stream(), lambda r: jobs.panes(r, "15 minutes"), str(tmp_path / "panes"), str(tmp_path / mark)).awaitTermination()
        jobs.only_new(stream(), str(tmp_path / "new"), str(tmp_path / f"{mark}-new")).awaitTermination()
        jobs.change_detection(stream(), str(tmp_path / "changes"), str(tmp_path / f"{mark}-changes")).awaitTermination()
    assert jobs.price_stats(spark, str(tmp_path / "panes"), "15 minutes").agg(F.sum("observation_count")).first()[0] == 2
    assert jobs.first_seen(spark, str(tmp_path / "new")).count() == 1
    assert jobs.detected_changes(spark, str(tmp_path / "changes")).count() == 2


def test_counts_unite_over_batches_and_folds(spark, tmp_path):
    landing, out, folded = (str(tmp_path / x) for x in ("landing", "panes", "folded"))
    for k in range(3):
        jobs.land(observations(spark, [(1, 1, 60 * k, k, 0.1, "sold"), (1, 1, 7_200 + k, 10 + k, 0.2, "active"), (2, 1, None, 20, 1.0, "sold")]), landing, k)
        jobs.partial_counts(jobs.read_observations(spark, landing), lambda r: jobs.panes(r, "15 minutes"), out, str(tmp_path / "mark")).awaitTermination()
    stats = [(r.observation_count, r.sold_count, r.price_sum) for r in jobs.price_stats(spark, out, "15 minutes").orderBy("window_start").collect()]
    assert stats == [(3, 3, 0.3), (3, 0, 0.6)]
    assert jobs.price_stats(spark, out, "15 minutes", closed_after="30 MINUTES").count() == 1
    assert jobs.price_stats(spark, out, "30 minutes", "15 minutes").count() == 4
    jobs.fold(spark, out, jobs.PANE_SCHEMA, jobs.PANE_KEYS, folded)
    assert sorted(map(tuple, jobs.price_stats(spark, folded, "15 minutes").collect())) == sorted(map(tuple, jobs.price_stats(spark, out, "15 minutes").collect()))


def test_spells_that_meet_in_a_later_batch_become_one(spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "cells")
    hours = [[0, 11], [6, 30], [12, 24, 36.001]]  # 0, 6, 12 | 11 joins; 24, 30 | 36.001 is too late by seconds
    for k, some in enumerate(hours):
        jobs.land(observations(spark, [(1, 1, int(h * 3600 + 0.5), k, 1.0, "active") for h in some]), landing, k)
        jobs.partial_counts(jobs.read_observations(spark, landing), lambda r: jobs.spell_cells(r, "6 hours"), out, str(tmp_path / "mark")).awaitTermination()
    got = jobs.market_sessions(spark, out, "6 hours").orderBy("session_start").collect()
    assert [r.observation_count for r in got] == [4, 2, 1]


CUT = ["stream_only_new", "stream_change_detection", "stream_upsert_current", "stream_price_stats", "stream_market_sessions", "late_observation_policy"]


@pytest.mark.parametrize("name", CUT)
def test_results_do_not_depend_on_the_size_of_micro_batches(spark, monkeypatch, name):
    """Each landing has files that overlap in time; with one file a micro-batch, rows come out of order."""
    from woonvonk.plans import stream_queries

    rows = stream_queries._observations(spark, SF).where("listing_id < 40")
    monkeypatch.setattr(stream_queries, "_observations", lambda spark, sf_dir: rows.repartition(3, "seq"))
    whole = sorted(map(tuple, JOBS[name](spark, SF).collect()))
    batches = []
    each = jobs.each_batch
    monkeypatch.setattr(jobs, "each_batch", lambda stream, work, *rest: each(stream, lambda df, n: (batches.append(n), work(df, n))[1], *rest))
    monkeypatch.setattr(jobs, "MAX_BYTES", 1)
    assert sorted(map(tuple, JOBS[name](spark, SF).collect())) == whole
    assert len(batches) >= 4
