"""Order statistics against sorting, and chi-square tails against numbers of a table."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tallystone.operators import forensics, ranks, telemetry


def _rows():
    rng = random.Random(4)
    groups = {"ints": [rng.randrange(50) for _ in range(500)], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) * rng.random() for _ in range(300)], "one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 40}
    groups |= {"close": [1.0 + i * 2**-52 for i in range(100)], "huge": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324], None: [float(i) for i in range(9)]}
    return groups, [(k, float(v)) for k, vs in groups.items() for v in vs]


@pytest.mark.parametrize(("bins", "limit"), [(4096, 100_000), (4096, 0), (8, 100_000)])
def test_quantiles(spark, bins, limit, monkeypatch):
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", limit)
    groups, rows = _rows()
    if bins == 8:  # many rounds: fewer groups
        groups = {k: groups[k] for k in ("ints", "one", "two", "same")}
        rows = [r for r in rows if r[0] in groups]
    rows += [("ints", None), ("nothing", None), ("ints", math.nan)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"first": F.lit(0), "p95": F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(0.95))), "middle": F.floor((F.col("n") - 1) / 2), "last": F.col("n") - 1}
    got = {r["k"]: tuple(r)[1:] for r in ranks.ranked(df, "k", "v", wanted, bins).collect()}
    want = {k: (len(v), (s := sorted(map(float, v)))[0], s[min(len(s) - 1, int(len(s) * 0.95))], s[(len(s) - 1) // 2], s[-1]) for k, v in groups.items()}
    assert got == want


def test_the_same_rows_as_by_sorting(spark):
    groups, rows = _rows()
    df = spark.createDataFrame([r for r in rows if r[0] in ("ints", "one", "two", "same", "close")], "k string, v double")
    by_key = lambda out: {r["k"]: r.asDict() for r in out.collect()}
    assert by_key(ranks.quantiles(df, "k", "v")) == by_key(telemetry.exact_ranks(df, "v", "k"))
    for z in (0.5, 1.5):
        assert by_key(ranks.near_median(df, "k", "v", z)) == by_key(telemetry.trimmed_median(df, "k", "v", z))
    assert ranks.quantiles(df.limit(0), "k", "v").collect() == []
    assert ranks.near_median(df.limit(0), "k", "v", 1.0).collect() == []


def _tail(x, k):
    """The upper tail by its closed form for even degrees, by recurrence from the normal tail for odd ones."""
    x = x / 2
    if k % 2 == 0:
        return math.fsum(math.exp(-x + i * math.log(x) - math.lgamma(i + 1)) for i in range(k // 2)) if x else 1.0
    return math.erfc(math.sqrt(x)) + (math.fsum(math.exp(-x + (i + 0.5) * math.log(x) - math.lgamma(i + 1.5)) for i in range(k // 2)) if x else 0.0)


def test_chi_square_tails(spark):
    cases = [(x, k) for k in (1, 2, 3, 4, 7, 10, 33, 64, 127, 128, 500, 1001, 3000) for x in (0.0, 1e-6, 0.1, k * 0.3, k * 0.9, float(k), k + 1.9, k + 2.1, k * 1.2, k * 2.0, k * 5.0 + 20)]
    df = spark.createDataFrame([(i, float(x), k) for i, (x, k) in enumerate(cases)], "i int, x double, k int")
    got = {r["i"]: r["p"] for r in df.select("i", forensics.chi_square_p(F.col("x"), F.col("k")).alias("p")).collect()}
    for i, (x, k) in enumerate(cases):
        want = _tail(x, k)
        assert abs(got[i] - want) < 1e-11 and (want < 1e-280 or abs(got[i] / want - 1) < 1e-6 or want > 1e-3), (x, k, got[i], want)
    # 5 per cent points of the usual table.
    table = [(3.841458820694124, 1), (11.070497693516351, 5), (124.34211340400407, 100)]
    for p in spark.createDataFrame(table, "x double, k int").select(forensics.chi_square_p(F.col("x"), F.col("k"))).collect():
        assert abs(p[0] - 0.05) < 1e-9


def test_hidden_bits(spark):
    even, rng = bytes(range(256)) * 20, random.Random(3)
    rows = [(1, bytes([2 * (b // 2) for b in even])), (2, even), (3, b""), (4, None), (5, bytes(rng.randrange(256) for _ in range(5000)))]
    got = {r["key"]: r for r in forensics.hidden_bits(spark.createDataFrame(rows, "key int, content binary"), "key", "content").collect()}
    assert got[1]["detected"] and got[1]["degrees"] == 128
    assert not got[2]["detected"] and (got[2]["chi2"], got[2]["p"]) == (0.0, 1.0)
    assert [(got[i]["degrees"], got[i]["p"], got[i]["detected"]) for i in (3, 4)] == [(0, 1.0, False)] * 2
    assert 0.001 < got[5]["p"] < 0.999
