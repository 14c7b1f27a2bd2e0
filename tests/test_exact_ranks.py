"""The exact rank test against enumeration of all orders."""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

import pytest

from trialmart.functions.pvalues import exact_u_pvalue, rank_sum_counts
from trialmart.operators import significance


def enumerated(m, n):
    """U of every choice of ranks for the first sample."""
    return Counter(sum(ranks) - m * (m - 1) // 2 for ranks in combinations(range(m + n), m))


@pytest.mark.parametrize("m,n", [(1, 1), (1, 9), (2, 3), (3, 8), (5, 5), (7, 4), (8, 8)])
def test_counts_are_those_of_all_orders(m, n):
    want = enumerated(min(m, n), max(m, n))
    found = rank_sum_counts(min(m, n), max(m, n), m * n)
    assert found.tolist() == [want.get(u, 0) for u in range(m * n + 1)]
    for u in range(m * n + 1):
        high = max(u, m * n - u)
        p = 2 * sum(c for v, c in want.items() if v >= high) / math.comb(m + n, m)
        assert exact_u_pvalue(u, m, n) == pytest.approx(min(1.0, p), rel=1e-12)


def test_a_large_other_side():
    """All counts together are the number of orders, and both ends mirror each other."""
    m, n = 8, 5000
    found = rank_sum_counts(m, n, m * n)
    assert found.sum() == pytest.approx(math.comb(m + n, m), rel=1e-10)
    assert found[:200].tolist() == pytest.approx(found[::-1][:200].tolist(), rel=1e-6, abs=1e13)
    assert 0.99 < exact_u_pvalue(m * n / 2, m, n) <= 1


def test_method_says_which(spark):
    rows = [("tiny", 1, float(v)) for v in (1, 5, 9)] + [("tiny", 0, float(v)) for v in (2, 3)]
    rows += [("tied", 1, 1.0), ("tied", 0, 1.0), ("tied", 0, 2.0)]
    rows += [("large", i % 2, float(i)) for i in range(40)]
    rows += [("one side", 1, 4.0), ("one side", 1, None)]
    users = spark.createDataFrame(rows, "seg string, is_target int, monetary double")
    found = {r["seg"]: r for r in significance.mann_whitney(users, keys=["seg"], method="auto").collect()}
    assert {s: r["method"] for s, r in found.items()} == {
        "tiny": "exact", "tied": "asymptotic", "large": "asymptotic", "one side": None,
    }
    assert found["tiny"]["U"] == 4.0 and found["tiny"]["pval"] == pytest.approx(0.8)
    plain = {r["seg"]: r for r in significance.mann_whitney(users, keys=["seg"]).collect()}
    assert plain["large"]["pval"] == found["large"]["pval"] and plain["tiny"]["method"] == "asymptotic"
    with pytest.raises(ValueError):
        significance.mann_whitney(users, method="other")
