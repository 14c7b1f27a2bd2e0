"""Coupon economics, among others against the published figures."""

from __future__ import annotations

import pytest

from trialmart.operators import extensions, finance, quality, reshape

USER = "customer_id string, is_target int, seg string, monetary double, frequency long"

# Published: treated users, uplift per user, gap to break-even, profit per user, status.
PUBLISHED = {
    "overall": (442_676, 17.13, 4.09, 0.94, "OK"),
    "android": (189_796, 13.96, 0.91, 0.21, "OK"),
    "desktop": (63_370, 20.95, 7.91, 1.82, "OK"),
    "ios": (185_497, 18.95, 5.91, 1.36, "OK"),
    "not heavy": (279_181, 3.13, -9.91, -2.28, "NEG"),
    "heavy": (163_495, 0.88, -12.16, -2.80, "NEG"),
}


def arms(spark, uplift):
    return spark.createDataFrame(
        [("t", 1, "s", 100.0 + uplift, 1), ("c", 0, "s", 100.0, 1)], USER
    )


def test_needed():
    assert finance.break_even_needed(0.23, 10, 0.3) == pytest.approx(13.0435, abs=1e-4)
    with pytest.raises(ValueError):
        finance.break_even_needed(0, 10, 0.3)


@pytest.mark.parametrize("cell", PUBLISHED)
def test_published_figures(spark, cell):
    _, uplift, gap, profit, status = PUBLISHED[cell]
    (row,) = finance.break_even_table(arms(spark, uplift), segment_col="seg").collect()
    assert row["gap_uplift"] == pytest.approx(gap, abs=0.01)
    assert row["lucro_por_usuario"] == pytest.approx(profit, abs=0.01)
    assert row["status"] == status


def test_published_viability(spark):
    row = finance.financial_viability(arms(spark, 17.13)).first()
    n = PUBLISHED["overall"][0]
    assert row["roi_absoluto"] * n == pytest.approx(416_000, rel=0.002)
    assert row["roi_percent"] == pytest.approx(0.3135, abs=0.001)
    assert row["cac"] == 10.0


def test_published_projection(spark):
    profits = {"android": 39_850.0, "desktop": 115_192.0, "ios": 251_926.0}
    table = spark.createDataFrame(
        [(s, p, "OK") for s, p in profits.items()] + [("tv", -5.0, "NEG")],
        "segment string, lucro_total double, status string",
    )
    row = finance.project_profit(table, mode="campanhas").first()
    assert row["lucro_periodo_selecionados"] == 406_968
    covered = row["projecao_anual"] * 438_663 / 442_676
    assert covered == pytest.approx(4.84e6, rel=0.001)


def test_three_way_status(spark):
    table = finance.break_even_table(arms(spark, 13.96), segment_col="seg")
    assert extensions.break_even_status3(table).first()["status"] == "No limite"
    table = finance.break_even_table(arms(spark, 3.13), segment_col="seg")
    assert extensions.break_even_status3(table).first()["status"] == "NEG"


def test_segments_without_both_arms_drop_out(spark):
    df = spark.createDataFrame(
        [("1", 1, "a", 2.0, 1), ("2", 0, "a", 1.0, 1), ("3", 1, "b", 1.0, 1),
         ("4", 1, None, 1.0, 1), ("5", 0, None, 1.0, 1), ("6", 7, "a", 900.0, 1)],
        USER,
    )
    table = finance.finance_by_segment(df, segment_col="seg").collect()
    assert [(r["segment"], r["uplift_gmv_user"]) for r in table] == [("a", 1.0)]
    assert finance.break_even_table(df).first()["usuarios_trat"] == 3


def test_free_coupon(spark):
    (row,) = finance.break_even_table(arms(spark, 5.0), redemption_rate=0.0).collect()
    assert row["roi_percent"] is None and row["lucro_total"] == row["receita_total"]


def test_missing_arm_is_an_error(spark):
    only = spark.createDataFrame([("1", 1, "a", 2.0, 1)], USER)
    with pytest.raises(Exception, match="both arms"):
        finance.financial_viability(only).collect()


def test_amounts_missing_count_as_zero(spark):
    df = spark.createDataFrame([("1", 1, "a", 2.0, 1), ("2", 0, "a", None, 1)], USER)
    assert finance.financial_viability(df).first()["gmv_user_ctrl"] == 0.0


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([("s", 2.5, 0.125)], "segment string, lucro_total double, gmv_ctrl double")
    row = finance.round_break_even(df).first()
    assert (row["lucro_total"], row["gmv_ctrl"]) == (2.0, 0.12)


def test_losers_leave_and_unknown_stay(spark):
    users = spark.createDataFrame(
        [("1", True), ("2", False), ("3", None)], "customer_id string, heavy_user boolean"
    )
    table = spark.createDataFrame([(True, "NEG"), (False, "OK")], "segment boolean, status string")
    rest = finance.drop_losing_segments(users, table, "heavy_user").collect()
    assert {r["customer_id"] for r in rest} == {"2", "3"}


def test_coverage_counts_null_segment_in_total(spark):
    users = spark.createDataFrame(
        [("1", 1, "a", 1.0, 1), ("2", 1, "b", 1.0, 1), ("3", 1, None, 1.0, 1), ("4", 0, "a", 1.0, 1)],
        USER,
    )
    table = spark.createDataFrame([("a", "OK"), ("b", "NEG")], "segment string, status string")
    row = finance.coverage_share(users, table, segment_col="seg").first()
    assert (row["covered"], row["treated"]) == (1, 3)
    empty = finance.coverage_share(users.limit(0), table, segment_col="seg").first()
    assert (empty["covered"], empty["treated"], empty["coverage"]) == (0, 0, 0.0)


def test_grid_equals_single_tables(spark):
    users = arms(spark, 20.0)
    grid = {r["coupon_cost"]: r for r in extensions.break_even_grid(users).collect()}
    assert set(grid) == {3.0, 6.0, 9.0, 12.0, 15.0}
    for cost, row in grid.items():
        single = finance.break_even_table(users, coupon_cost=cost).first()
        assert row["lucro_total"] == pytest.approx(single["lucro_total"])
        assert row["uplift_needed"] == pytest.approx(single["uplift_needed"])


def test_suspension_needs_two_bad_readings(spark):
    rows = []
    for week, (t, c) in enumerate([(1.0, 1.0), (1.0, 1.0), (99.0, 1.0), (1.0, 1.0)]):
        day = f"2019-01-{7 + 7 * week:02d} 10:00:00"
        for i in range(2):
            rows.append((f"t{i}", f"t{week}{i}", day, t, 1, "ios"))
            rows.append((f"c{i}", f"c{week}{i}", day, c, 0, "ios"))
    df = spark.createDataFrame(
        rows, "customer_id string, order_id string, ts string, order_total_amount double, "
        "is_target int, origin_platform string",
    ).selectExpr("*", "cast(ts as timestamp) as event_ts_utc")
    table = extensions.governance_checkpoint(df, min_treated=2).orderBy("week").collect()
    assert [r["suspend"] for r in table] == [False, True, False, False]
    fewer = extensions.governance_checkpoint(df, min_treated=3).collect()
    assert not any(r["suspend"] for r in fewer)


def test_duplicates_with_a_hot_group(spark):
    rows = [("hot", None, f"o{i}") for i in range(700)] + [("x", "m", "a"), ("x", "m", "b"), ("y", "m", "c")]
    df = spark.createDataFrame(rows, "customer_id string, merchant_id string, order_id string")
    keys = ["customer_id", "merchant_id"]
    groups = {r["customer_id"]: r["n_orders"] for r in quality.duplicate_groups(df, keys).collect()}
    assert groups == {"hot": 700, "x": 2}
    parts = quality.duplicate_members(df, keys, ids_per_row=100).collect()
    hot = [r["order_ids"] for r in parts if r["customer_id"] == "hot"]
    assert len(hot) == 7 and max(map(len, hot)) < 150
    assert sorted(sum(hot, [])) == sorted(f"o{i}" for i in range(700))
    assert [r["order_ids"] for r in parts if r["customer_id"] == "x"] == [["a", "b"]]
    assert quality.worst_duplicates(quality.duplicate_groups(df, keys), 1).first()["n_orders"] == 700


def test_null_counts(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    assert {r[0]: r[1] for r in quality.null_counts(df, None).collect()} == {"a": 1, "b": 2}


def test_bars_reject_unknown_statistic(spark):
    with pytest.raises(ValueError):
        reshape.prepare_bars_from_robust(spark.range(1), which="mean")


def test_missing_columns_are_named(spark):
    with pytest.raises(KeyError, match="monetary"):
        finance.break_even_table(spark.range(1).toDF("customer_id"))
