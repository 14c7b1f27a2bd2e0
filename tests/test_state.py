"""Days replaced safely, the user table folded batch by batch, stored sketches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trialmart.operators import sketches, user_state, users
from trialmart.operators.conform import conform_abmap, conform_consumers, conform_orders
from trialmart.sources import days, versions


def fact_rows(spark, rows):
    return spark.createDataFrame(rows, "order_id string, v int, event_date_brt date")


def at(day, ids, v):
    import datetime

    return [(i, v, datetime.date(2019, 1, day) if day else None) for i in ids]


def rows_of(df):
    return sorted((r["order_id"], r["v"]) for r in df.collect())


def test_a_day_is_replaced_and_the_others_stay(spark, tmp_path):
    path = str(tmp_path / "fact")
    days.replace_days(fact_rows(spark, at(1, "ab", 1) + at(2, "cd", 1) + at(None, "n", 1)), path)
    days.replace_days(fact_rows(spark, at(2, "dx", 2) + at(3, "e", 2)), path)
    assert rows_of(days.read_days(spark, path)) == [("a", 1), ("b", 1), ("d", 2), ("e", 2), ("n", 1), ("x", 2)]
    assert rows_of(days.read_days(spark, path, version=1)) == [("a", 1), ("b", 1), ("c", 1), ("d", 1), ("n", 1)]
    assert rows_of(days.read_days(spark, path, "2019-01-02", "2019-01-03")) == [("d", 2), ("x", 2)]
    days.replace_days(fact_rows(spark, []), path, days=["2019-01-01"])
    assert rows_of(days.read_days(spark, path)) == [("d", 2), ("e", 2), ("n", 1), ("x", 2)]
    assert days.read_days(spark, path).schema == fact_rows(spark, []).schema
    assert days.read_days(spark, path, "2020-01-01").count() == 0
    with pytest.raises(FileNotFoundError):
        days.read_days(spark, str(tmp_path / "nothing"))


def test_a_writer_that_fails_midway_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "fact")
    days.replace_days(fact_rows(spark, at(1, "ab", 1)), path)
    bad = fact_rows(spark, at(1, "cd", 2)).withColumn(
        "v", F.when(F.col("order_id") == "d", F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("int")
    )
    with pytest.raises(Exception, match="lost"):
        days.replace_days(bad.repartition(2), path)
    assert rows_of(days.read_days(spark, path)) == [("a", 1), ("b", 1)]
    # Written in full, but the writer dies before it publishes.
    monkeypatch.setattr(versions, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        days.replace_days(fact_rows(spark, at(1, "xyz", 3)), path)
    monkeypatch.undo()
    assert rows_of(days.read_days(spark, path)) == [("a", 1), ("b", 1)]
    days.replace_days(fact_rows(spark, at(1, "q", 4)), path)
    assert rows_of(days.read_days(spark, path)) == [("q", 4)]
    assert len(days.drop_replaced(spark, path)) >= 2
    assert rows_of(days.read_days(spark, path)) == [("q", 4)]


def test_writers_at_the_same_time_are_put_in_line(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "fact")
    days.replace_days(fact_rows(spark, at(1, "a", 1)), path)
    latest, once = versions.latest, []

    def overtaken(session, folder):
        seen = latest(session, folder)
        if not once:
            once.append(1)
            days.replace_days(fact_rows(spark, at(2, "b", 2)), path)
        return seen

    monkeypatch.setattr(versions, "latest", overtaken)
    assert days.replace_days(fact_rows(spark, at(3, "c", 3)), path) == 3
    assert rows_of(days.read_days(spark, path)) == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(versions.VersionTaken):
        versions.publish(spark, path, 2, {})


RAW = "order_id string, customer_id string, order_created_at string, order_total_amount double, origin_platform string"


def raw_orders(seed, n):
    """Orders with copies, some of them of other customers, negative and null amounts."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        row = [f"o{i}", f"c{rng.randint(0, n // 6)}", f"2019-01-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}:00:00Z",
               rng.choice([None, -5.0, 10.0, 20.5, 33.25]), rng.choice([None, "IOS", "android"])]
        rows.append(tuple(row))
        while rng.random() < 0.3:
            row[2] = f"2019-01-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}:30:00Z"
            row[3] = rng.choice([None, -1.0, 7.0])
            if rng.random() < 0.3:
                row[1] = f"c{rng.randint(0, n // 6)}"
            rows.append(tuple(row))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_folding_batches_equals_all_orders(spark, tmp_path, seed):
    rows = raw_orders(seed, 120)
    random.Random(seed).shuffle(rows)
    window = ("2019-01-03", "2019-01-26")
    state = user_state.UserState(spark, str(tmp_path / "state"), *window)
    with pytest.raises(FileNotFoundError):
        state.totals()
    cuts = [0, 40, 41, 110, len(rows)]
    batches = [rows[a:b] for a, b in zip(cuts, cuts[1:])] + [rows[20:60], []]  # repeated, empty
    for batch in batches:
        state.fold(spark.createDataFrame(batch, RAW))
    people = spark.createDataFrame([(f"c{i}", "x") for i in range(30)], "customer_id string, language string")
    arms = spark.createDataFrame([(f"c{i}", str(i % 2)) for i in range(30)], "customer_id string, is_target string")
    from trialmart.operators.fact import experiment_window

    orders = experiment_window(conform_orders(spark.createDataFrame(rows, RAW)), *window)
    want = users.users_from_conformed(orders, conform_consumers(people), conform_abmap(arms), *window)
    got = users.users_from_totals(state.totals(), conform_consumers(people), conform_abmap(arms), *window)
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert plain(got) == plain(want) and got.count() > 15


def test_a_lost_fold_can_be_run_again(spark, tmp_path, monkeypatch):
    rows = raw_orders(3, 40)
    state = user_state.UserState(spark, str(tmp_path / "state"))
    state.fold(spark.createDataFrame(rows[:30], RAW))
    before = sorted(map(str, state.totals().collect()))
    monkeypatch.setattr(versions, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        state.fold(spark.createDataFrame(rows[30:], RAW))
    monkeypatch.undo()
    assert sorted(map(str, state.totals().collect())) == before
    assert state.fold(spark.createDataFrame(rows[30:], RAW)) == 2
    assert state.totals().agg(F.sum("frequency")).first()[0] == conform_orders(spark.createDataFrame(rows, RAW)).count()


def table(spark, n):
    return spark.range(n).selectExpr(
        "cast(id as string) as customer_id", "cast(id % 2 as int) as is_target", "id % 7 as seg",
        "cast(pow((id * 7919) % 10007, 1.5) as double) as monetary", "cast(id % 9 as bigint) as frequency",
        "timestamp '2019-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 20 as int)) as last_order",
    )


def test_quantiles_of_merged_sketches_keep_their_bound(spark):
    df = table(spark, 60_000)
    stored = sketches.quantile_sketches(df, ["is_target", "seg"], k=400)
    assert stored.count() > 300 and stored.agg(F.sum("n")).first()[0] > 150_000
    probs = {"low": 0.1, "median": 0.5, "p95": 0.95}
    for keys in ([], ["is_target"]):
        for r in sketches.quantiles(sketches.merge_quantiles(stored, keys), probs).where("metric = 'monetary'").collect():
            part = df
            for key in keys:
                part = part.where(F.col(key) == r[key])
            assert r["n"] == part.count() and r["rank_error"] == pytest.approx(sketches.rank_error(400))
            for name, p in probs.items():
                below, upto = part.agg(F.count_if(F.col("monetary") < r[name]), F.count_if(F.col("monetary") <= r[name])).first()
                assert below <= (p + r["rank_error"]) * r["n"] and upto >= (p - r["rank_error"]) * r["n"]


def test_distinct_users_of_overlapping_groups(spark):
    rows = spark.range(90_000).selectExpr(
        "cast(id % 50000 as string) as customer_id", "id % 4 as day", "case id % 3 when 0 then 'a' when 1 then 'b' end as g"
    )
    stored = sketches.user_sketches(rows, ["day", "g"], bits=12)
    exact = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count_distinct("customer_id").alias("n")).collect()}
    found = sketches.distinct_users(sketches.merge_users(stored, ["g"])).collect()
    assert {r["g"] for r in found} == {"a", "b", None}
    for r in found:
        assert abs(r["n_users"] - exact[r["g"]]) <= r["error"] and r["error"] > 0
    both = rows.where("g = 'a'").select("customer_id").intersect(rows.where("g = 'b'").select("customer_id")).count()
    shared = sketches.shared_users(stored, "g", ["a", "b"]).first()
    assert shared["n_groups"] == 2 and abs(shared["n_all"] - both) <= shared["error"]
    small = sketches.user_sketches(rows.where("cast(customer_id as int) < 900"), ["g"], bits=12)
    want = {r["g"]: r["n"] for r in rows.where("cast(customer_id as int) < 900").groupBy("g").agg(F.count_distinct("customer_id").alias("n")).collect()}
    assert {r["g"]: (r["n_users"], r["error"]) for r in sketches.distinct_users(small).collect()} == {g: (n, 0.0) for g, n in want.items()}
    ranked = sorted(want, key=lambda g: (-want[g], g is None, g or ""))
    assert [r["g"] for r in sketches.largest_groups(small, "g", 2).collect()] == ranked[:2]
    assert sketches.user_sketches(rows.where("false"), ["g"]).count() == 0
