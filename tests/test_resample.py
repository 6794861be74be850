"""Draws of the bootstraps: against plain ones, and never sent to the driver."""

import hashlib
import re

import pytest

from plumbline.operators import resample
from plumbline.plans.queries import QUERIES
from plumbline.scratch import stored

#: Queries whose draws (replicates times targets) were once broadcast.
DRAWN = ["threshold_table", "contrast_specs", "boot_mce", "boot_contrast", "classified_curve", "boot_overconfidence", "boot_ece", "curve_ci"]


def test_sums_equal_plain_draws(spark, monkeypatch):
    """Several blocks and pieces, a level without rows, a target without any, one whose sum is NaN."""
    monkeypatch.setattr(resample, "BLOCK", 4)
    monkeypatch.setattr(resample, "PIECE", 3)
    names = [f"t{i}" for i in range(10)]
    rows = [(t, k, 1 + i + j, 0.5 * i, float("nan") if (i, j) == (6, 1) else 0.25 * j) for i, t in enumerate(names) for j, k in enumerate(("x", None)) if i != 3 and (i + j) % 3]
    stats = spark.createDataFrame(rows, "candidate string, level string, c long, sc double, sa double")
    targets = stored(spark.createDataFrame([(t, i) for i, t in enumerate(names)], "candidate string, idx long"))
    want = {}
    for rep in range(20):
        for draw in range(10):
            t = names[int(hashlib.md5(f"7:{rep}:{draw}".encode()).hexdigest()[:8], 16) % 10]
            for _, level, *sums in (r for r in rows if r[0] == t):
                want[rep, level] = [a + b for a, b in zip(want.get((rep, level), (0, 0, 0)), sums, strict=True)]
    got = {(r.rep, r.level): [r.c, r.sc, r.sa] for r in resample.replicate_sums(stats, targets, ["level"], 20, 7).collect()}
    assert got.keys() == want.keys()
    for k, sums in want.items():
        assert got[k] == pytest.approx(sums, nan_ok=True)
    assert resample.replicate_sums(stats, stored(targets.limit(0)), ["level"], 20).count() == 0


@pytest.mark.parametrize("name", DRAWN)
def test_draws_are_not_broadcast(spark, name):
    """Catalyst takes the size of an explode's result for its input's, so its size check lets all draws pass."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(re.match(r"[ :+\-]*", x)[0]) for x in plan]
    sent = [y for i, x in enumerate(plan) if "BroadcastExchange" in x for j, y in enumerate(plan[i + 1 :], i + 1) if all(d > depth[i] for d in depth[i + 1 : j + 1])]
    assert any("BroadcastExchange" in x for x in plan)
    assert not [x for x in sent if "Generate explode" in x or "MapInArrow" in x or "Range (" in x]
