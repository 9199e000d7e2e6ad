import math
import struct
from random import Random

import numpy as np
import pytest
from results import rows

from cohortpulse.operators import profile as P


def draw(kind, n, random):
    if kind == "ties":
        return [float(random.choice([0, 0, 0, 1, 5])) for _ in range(n)]
    if kind == "tail":
        return [random.lognormvariate(0, 6) for _ in range(n)]
    if kind == "spike":
        # Nearly all rows share one value, and the quartiles lie around it.
        return [1.0] * int(n * 0.7499) + [random.uniform(1, 2) for _ in range(n - int(n * 0.7499))]
    if kind == "one":
        return [4.0] * n
    return [random.uniform(-10, 10) for _ in range(n)]


@pytest.mark.parametrize("kind", ["ties", "tail", "one", "even", "spike"])
def test_profile_matches_numpy(spark, kind):
    random = Random(kind)
    values = draw(kind, 4001, random)
    data = [(v, None if random.random() < 0.3 else int(v) % 1000) for v in values]
    df = spark.createDataFrame(data, "x double, y long").repartition(5)
    got = {r.column_name: r for r in P.profile_numeric(df).collect()}
    for name, column in (("x", [d[0] for d in data]), ("y", [d[1] for d in data if d[1] is not None])):
        r = got[name]
        assert r["count"] == len(column)
        want = [np.mean(column), np.std(column, ddof=1), min(column), *np.percentile(column, [25, 50, 75]), max(column)]
        have = [r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]]
        assert np.allclose(have, want, rtol=1e-9, atol=1e-12), (name, have, want)


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_small_sizes(spark, n):
    values = [float(v * v) for v in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = P.exact_quantiles(df, ["x"], {"x": n}, (0.1, 0.5, 1.0))
    assert [r[2] for r in rows(got)] == pytest.approx(list(np.percentile(values, [10, 50, 100])))


def test_empty_column(spark):
    df = spark.createDataFrame([(None, 1)], "x double, y int")
    got = {r.column_name: r for r in P.profile_numeric(df).collect()}
    assert got["x"]["count"] == 0 and got["x"]["p50"] is None and got["y"]["p50"] == 1.0


def test_peek_and_shape(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string")
    assert [r.k for r in P.peek(df, ["k"], 2).collect()] == [1, 2]
    assert P.shape(df) == (3, 2)
    assert rows(P.shape_table(df, "t")) == [("t", 3, 2, "k,v")]
    assert P.numeric_columns(df) == ["k"]


def test_order_keys_are_binary_forms(spark):
    random = Random(1)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), -float("inf")]
    values += [struct.unpack("<d", struct.pack("<Q", random.getrandbits(64) & ~(2047 << 52) | random.randrange(2047) << 52))[0] for _ in range(2000)]
    values += [2.0**k * m for k in range(-1073, 1023, 7) for m in (1.0, 1 - 2**-53, 1 + 2**-52)]
    df = spark.createDataFrame([("x", v) for v in values], "column_name string, value double")
    for r in P._with_order_key(df).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r.value)))[0]
        assert r.key == (-bits if r.value < 0 else bits), r.value


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 2), (3.0, 3), (math.nan, 4), (None, 5)], "x double, y int")
    got = {r.column_name: r for r in P.profile_numeric(df).collect()}
    assert (got["x"]["count"], got["x"]["mean"], got["x"]["p75"], got["x"]["max"]) == (3, 2.0, 2.5, 3.0)
    assert got["y"]["count"] == 5


@pytest.mark.parametrize("kind", ["ties", "tail", "even", "spike"])
def test_passes(spark, kind, monkeypatch):
    """The scan of the statistics and one or two more."""
    passes = []
    narrow = P._narrow
    monkeypatch.setattr(P, "_narrow", lambda *a: passes.append(1) or narrow(*a))
    random = Random(kind)
    values = draw(kind, 60_000, random)
    r = P.profile_numeric(spark.createDataFrame([(v,) for v in values], "x double").repartition(7)).first()
    assert np.allclose([r["p25"], r["p50"], r["p75"]], np.percentile(values, [25, 50, 75]), rtol=1e-12)
    assert 1 <= len(passes) <= 2


@pytest.mark.parametrize("about", [[0.0, 0.0], [-1e300, 1e300], [9.9, 9.95], [-5e-324, 5e-324]])
def test_brackets_that_miss(spark, about):
    random = Random(5)
    values = [random.uniform(-10, 10) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = P.exact_quantiles(df, ["x"], {"x": len(values)}, (0.3,), {"x": about}).first()["quantile"]
    assert got == pytest.approx(np.percentile(values, 30), rel=1e-12)
