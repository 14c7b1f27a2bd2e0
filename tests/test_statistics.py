"""Order statistics, tests, segments and samples against brute force."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmart.functions.pvalues import t_pvalue, z_pvalue
from trialmart.operators import charts, extensions, sampling, segments, significance, summary
from trialmart.operators.order_stats import quantile_table

USER = "customer_id string, is_target int, seg string, frequency long, monetary double, recency int"


def make_users(n=600, seed=1):
    """One value and one segment own far more than a third of the rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        seg = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        money = 50.0 if rng.random() < 0.4 else round(rng.expovariate(0.01), 2)
        money = None if rng.random() < 0.05 else money
        rows.append((f"u{i}", rng.choice([0, 1, 1]), seg, rng.randint(1, 5), money, rng.randint(0, 90)))
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_users()


@pytest.fixture(scope="module")
def users(spark, rows):
    return spark.createDataFrame(rows, USER).repartition(5).cache()


def disc(values, p):
    ordered = sorted(values)
    return ordered[max(1, math.ceil(round(p * len(ordered), 9))) - 1]


@pytest.mark.parametrize("n_buckets", [2, 16, 256])
def test_quantiles_by_key(users, rows, n_buckets):
    probs = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    for method in ("disc", "cont"):
        table = quantile_table(
            users, ["monetary", "frequency"], probs, ["seg"], method=method, n_buckets=n_buckets
        ).collect()
        assert len(table) == 8
        for r in table:
            place = 4 if r["metric"] == "monetary" else 3
            values = [x[place] for x in rows if x[2] == r["seg"] and x[place] is not None]
            assert r["total"] == len(values)
            for i, p in enumerate(probs):
                want = disc(values, p) if method == "disc" else np.quantile(values, p)
                assert r[f"q{i}"] == pytest.approx(want, abs=1e-9)


def test_quantiles_match_builtin(spark, users):
    want = users.groupBy("seg").agg(
        F.expr("percentile_disc(0.3) within group (order by monetary)").alias("d"),
        F.percentile("monetary", 0.3).alias("c"),
    )
    want = {r["seg"]: r for r in want.collect()}
    for method, name in (("disc", "d"), ("cont", "c")):
        for r in quantile_table(users, ["monetary"], [0.3], ["seg"], method=method).collect():
            assert r["q0"] == pytest.approx(want[r["seg"]][name], abs=1e-9)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], USER)
    assert quantile_table(empty, ["monetary"], [0.5], ["seg"]).collect() == []
    scored = segments.build_rfm_buckets(empty)
    assert scored.collect() == []


def test_extreme_values(spark):
    values = [-1e300, -0.0, 0.0, 5e-324, 1e300, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    (row,) = quantile_table(df, ["v"], [0.0, 0.5, 1.0]).collect()
    assert (row["total"], row["q0"], row["q1"], row["q2"]) == (6, -1e300, 0.0, float("inf"))


def brute_u(treat, ctrl):
    return sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(treat, ctrl))


def brute_z(treat, ctrl):
    n1, n0 = len(treat), len(ctrl)
    n, u = n1 + n0, brute_u(treat, ctrl)
    _, counts = np.unique(treat + ctrl, return_counts=True)
    ties = float((counts.astype(float) ** 3 - counts).sum())
    var = n1 * n0 / 12 * ((n + 1) - ties / (n * (n - 1)))
    return (max(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / math.sqrt(var)


@pytest.mark.parametrize("n_buckets", [2, 256])
def test_mann_whitney_by_segment(users, rows, n_buckets):
    table = significance.mann_whitney(
        users, metrics=["monetary", "frequency"], keys=["seg"], n_buckets=n_buckets
    ).collect()
    assert len(table) == 8
    for r in table:
        place = 4 if r["metric"] == "monetary" else 3
        mine = [x for x in rows if x[2] == r["seg"] and x[place] is not None]
        treat = [x[place] for x in mine if x[1] == 1]
        ctrl = [x[place] for x in mine if x[1] == 0]
        assert (r["n_treat"], r["n_ctrl"]) == (len(treat), len(ctrl))
        assert r["U"] == brute_u(treat, ctrl)
        assert r["z"] == pytest.approx(brute_z(treat, ctrl), abs=1e-9)
        assert r["pval"] == pytest.approx(min(1, math.erfc(r["z"] / math.sqrt(2))), abs=1e-12)


def test_mann_whitney_swap(users):
    swapped = users.withColumn("is_target", 1 - F.col("is_target"))
    a = significance.mann_whitney(users).first()
    b = significance.mann_whitney(swapped).first()
    assert a["U"] + b["U"] == a["n_treat"] * a["n_ctrl"]
    assert a["pval"] == pytest.approx(b["pval"])


def test_mann_whitney_small_and_one_sided(spark):
    def frame(treat, ctrl):
        data = [(1, float(v)) for v in treat] + [(0, float(v)) for v in ctrl]
        return spark.createDataFrame(data, "is_target int, monetary double")

    assert significance.mann_whitney(frame([1, 2, 2], [2, 3])).first()["U"] == 1.0
    alone = significance.mann_whitney(frame([1, 2], [])).first()
    assert (alone["U"], alone["z"], alone["pval"], alone["method"]) == (None,) * 4
    same = significance.mann_whitney(frame([4, 4], [4, 4])).first()
    assert same["U"] == 2.0 and same["z"] is None and same["pval"] == 1.0


def test_welch(spark):
    data = [(1, v) for v in (1.0, 2.0, 3.0, None)] + [(0, v) for v in (2.0, 4.0, 6.0)]
    df = spark.createDataFrame(data, "is_target int, monetary double")
    row = significance.welch_ttest(df).first()
    assert row["t"] == pytest.approx(-1.549193, abs=1e-6)
    assert row["df"] == pytest.approx(2.941176, abs=1e-6)
    assert row["n_treat"] == 3
    flipped = df.withColumn("is_target", 1 - F.col("is_target"))
    assert significance.welch_ttest(flipped).first()["t"] == pytest.approx(1.549193, abs=1e-6)


TAILS = [  # t, degrees of freedom, p; None: normal
    (2.228139, 10.0, 0.05), (-12.706205, 1.0, 0.05), (0.0, 5.0, 1.0), (31.820516, 1.0, 0.02),
    (2.0, 2.0, 0.183503), (1.959964, 1e7, 0.05), (3.0, 3.5, 0.046931), (1.959964, None, 0.05),
    (0.0, None, 1.0), (-3.0, None, 0.0026998), (8.0, None, 1.244192e-15), (0.001, None, 0.999202),
    (None, 3.0, None), (float("nan"), 3.0, None), (1.0, 0.0, None), (None, None, None),
]


def test_tails(spark):
    rows = [(i, t, df, t is not None and df is None) for i, (t, df, _) in enumerate(TAILS)]
    table = spark.createDataFrame(rows, "i int, t double, df double, normal boolean")
    p = F.when(F.col("normal"), z_pvalue("t")).otherwise(t_pvalue("t", "df"))
    found = {r["i"]: r["p"] for r in table.select("i", p.alias("p")).collect()}
    for i, (t, df, want) in enumerate(TAILS):
        if want is None:
            assert found[i] is None
        elif df == 3.5:  # no table has it: the neighbours must enclose it
            assert 0.03 < found[i] < 0.0577
        else:
            assert found[i] == pytest.approx(want, rel=2e-5)


def test_p_values_need_no_python(users):
    for table in (significance.run_ab_tests(users), significance.run_nonparam_tests(users)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_conversion_without_variation(users):
    rows = {r["metric"]: r for r in significance.run_ab_tests(users).collect()}
    assert set(rows) == {"gmv_user", "pedidos_user", "aov", "conversao"}
    assert rows["conversao"]["z"] is None and rows["conversao"]["pval"] is None
    assert 0 < rows["gmv_user"]["pval"] < 1


def test_proportions(spark):
    data = [(1, int(i < 30)) for i in range(100)] + [(0, int(i < 20)) for i in range(100)]
    row = significance.ztest_proportions(
        spark.createDataFrame(data, "is_target int, conv_flag int")
    ).first()
    assert row["z"] == pytest.approx(0.1 / math.sqrt(0.25 * 0.75 * 0.02), abs=1e-9)


def test_rfm_bins(spark):
    data = [(f"u{i}", 1, None, i, float(i), i) for i in range(1, 11)]
    data.append(("n", 1, None, 5, None, 5))
    scored = segments.build_rfm_buckets(spark.createDataFrame(data, USER))
    rows = {r["customer_id"]: r for r in scored.collect()}
    # cuts of monetary are 2, 4, 6, 8; a value equal to a cut stays below it
    assert [rows[f"u{i}"]["m_score"] for i in (1, 2, 3, 4, 9, 10)] == [1, 1, 2, 2, 5, 5]
    assert rows["u1"]["r_score"] == 5 and rows["u10"]["r_score"] == 1
    assert rows["n"]["m_score"] == 3
    assert rows["u10"]["rfm_segment"] == "155"


def test_segment_counts_add_up(users, rows):
    table = summary.ab_metrics_by_segment(users, segment_col="seg").collect()
    assert sum(r["usuarios"] for r in table) == len(rows)
    assert {r["seg"] for r in table} == {"hot", "a", "b", None}
    top = summary.ab_metrics_by_segment(users, segment_col="seg", top_k_segments=1).collect()
    assert {r["seg"] for r in top} == {"hot"}


def test_robust_keeps_null_segment_but_cont_drops_it(users):
    disc_rows = summary.robust_metrics_by_segment(users, segment_col="seg").collect()
    cont_rows = summary.robust_metrics_by_segment(users, segment_col="seg", method="cont").collect()
    assert None in {r["segment"] for r in disc_rows}
    assert None not in {r["segment"] for r in cont_rows}
    approx = summary.robust_metrics_by_segment(users, segment_col="seg", method="approx").collect()
    assert [r.asDict() for r in approx] == [r.asDict() for r in disc_rows]


def test_duplicate_ids_count_once(spark, users):
    twice = users.union(users)
    once = summary.compute_ab_summary(users, ids_unique=True).collect()
    assert [r["usuarios"] for r in summary.compute_ab_summary(twice).collect()] == [
        r["usuarios"] for r in once
    ]


def test_sample_is_nested_and_capped(users, rows):
    small = {r[0] for r in sampling.user_level_for_tests(users, sample_frac=0.1).collect()}
    large = {r[0] for r in sampling.user_level_for_tests(users, sample_frac=0.3).collect()}
    assert small < large and 100 < len(large) < 260
    capped = {r[0] for r in sampling.cap_rows(users, 40).collect()}
    assert len(capped) == 40
    bigger = {r[0] for r in sampling.cap_rows(users, 41).collect()}
    assert capped < bigger
    assert sampling.cap_rows(users, 10_000).count() == len(rows)
    with pytest.raises(ValueError):
        sampling.cap_rows(users, 0)


def test_cap_with_equal_hashes(spark):
    # The same id many times gives one hash only; ties fall to the id column.
    df = spark.createDataFrame([("same",)] * 30, "customer_id string")
    assert sampling.cap_rows(df, 7).count() == 7


def test_clip_is_idempotent_at_its_bounds(users):
    once = sampling.winsorize(users, p=0.1, metrics=["monetary"])
    low, high = once.agg(F.min("monetary"), F.max("monetary")).first()
    twice = once.withColumn("monetary", sampling.clip(F.col("monetary"), F.lit(low), F.lit(high)))
    assert once.exceptAll(twice).count() == 0


def test_clip_matches_numpy(users, rows):
    values = [r[4] for r in rows if r[4] is not None]
    low, high = np.quantile(values, [0.05, 0.95])
    got = sampling.winsorize(users, p=0.05, metrics=["monetary"]).select("monetary").collect()
    got = sorted(r[0] for r in got if r[0] is not None)
    assert np.allclose(got, sorted(np.clip(values, low, high)))


def test_box_and_histogram(users, rows):
    boxes = charts.boxplot_stats(users, ["monetary"], keys=["seg"]).collect()
    bins = charts.density_histogram(users, ["monetary"], keys=["seg"], bins=10).collect()
    for r in boxes:
        values = np.array(
            [x[4] for x in rows if (x[2], x[1]) == (r["seg"], r["is_target"]) and x[4] is not None]
        )
        q1, med, q3 = np.quantile(values, [0.25, 0.5, 0.75])
        inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
        assert (r["n"], r["n_outliers"]) == (len(values), len(values) - len(inside))
        assert np.allclose([r["q1"], r["median"], r["q3"]], [q1, med, q3])
        assert r["whisker_lo"] == min(inside.min(), q1)
        assert r["whisker_hi"] == max(inside.max(), q3)
        mine = {b["bin"]: b for b in bins
                if (b["seg"], b["is_target"]) == (r["seg"], r["is_target"])}
        counts, _ = np.histogram(values, bins=10)
        density, _ = np.histogram(values, bins=10, density=True)
        assert [mine[i]["n"] if i in mine else 0 for i in range(10)] == list(counts)
        assert np.allclose([mine[i]["density"] if i in mine else 0 for i in range(10)], density)


def test_charts_of_clipped_values(spark):
    rng = random.Random(5)
    data = [(i % 2, rng.expovariate(0.1)) for i in range(500)]
    df = spark.createDataFrame(data, "is_target int, v double")
    boxes = {r["is_target"]: r for r in charts.boxplot_stats(df, ["v"], clip_p=0.2).collect()}
    bins = charts.density_histogram(df, ["v"], clip_p=0.2, bins=7).collect()
    for arm in (0, 1):
        values = np.array([v for a, v in data if a == arm])
        values = np.clip(values, *np.quantile(values, [0.2, 0.8]))
        r = boxes[arm]
        assert np.allclose([r["q1"], r["median"], r["q3"]], np.quantile(values, [0.25, 0.5, 0.75]))
        assert r["whisker_lo"] == pytest.approx(values.min()) and r["n_outliers"] == 0
        counts, edges = np.histogram(values, bins=7)
        mine = {b["bin"]: b for b in bins if b["is_target"] == arm}
        assert [mine[i]["n"] for i in range(7)] == list(counts)
        assert mine[0]["bin_lo"] == pytest.approx(edges[0])


def test_histogram_clipped_to_one_value(spark):
    data = [(1, 1.0), (1, 9.0)] + [(1, 5.0)] * 30
    df = spark.createDataFrame(data, "is_target int, v double")
    (row,) = charts.density_histogram(df, ["v"], bins=4, clip_p=0.1).collect()
    assert (row["bin"], row["n"]) == (2, 32)


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0)], "is_target int, v double")
    (row,) = charts.density_histogram(df, ["v"], bins=4).collect()
    assert (row["bin"], row["n"], row["bin_lo"], row["density"]) == (2, 2, 5.0, 4.0)


def test_cuped_removes_what_the_past_explains(spark):
    rng = random.Random(3)
    data = []
    for i in range(400):
        past = rng.gauss(50, 10)
        data.append((i % 2, 2 * past + rng.gauss(0, 1) + (i % 2), past))
    df = spark.createDataFrame(data, "is_target int, monetary double, pre_monetary double")
    rows = {r["metric"]: r for r in extensions.cuped_ttest(df).collect()}
    assert abs(rows["monetary_cuped"]["t"]) > 5 > abs(rows["monetary"]["t"])
    y, x = np.array([d[1] for d in data]), np.array([d[2] for d in data])
    theta = np.cov(y, x)[0, 1] / np.var(x, ddof=1)
    got = sorted(r[0] for r in extensions.cuped_adjust(df).select("monetary_cuped").collect())
    assert np.allclose(got, sorted(y - theta * (x - x.mean())))


@pytest.mark.parametrize("partitions", [1, 3, 11])
def test_results_do_not_depend_on_partitions(spark, rows, partitions):
    df = spark.createDataFrame(rows, USER).repartition(partitions)
    robust = summary.robust_metrics_by_segment(df, segment_col="seg").collect()
    ranks = sorted(significance.mann_whitney(df, keys=["seg"]).collect(), key=str)
    base = spark.createDataFrame(rows, USER).repartition(2)
    assert robust == summary.robust_metrics_by_segment(base, segment_col="seg").collect()
    assert ranks == sorted(significance.mann_whitney(base, keys=["seg"]).collect(), key=str)
