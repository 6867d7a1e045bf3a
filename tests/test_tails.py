import math

import pytest

from rankfold.functions import tails


def test_published_values():
    assert tails._normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert tails._gamma_q(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-12)
    assert tails._gamma_q(5, 18.307038053275146 / 2) == pytest.approx(0.05, abs=1e-12)
    assert tails._t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails._t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert tails._coin_two_sided(4, 24) == pytest.approx(2 * sum(math.comb(24, i) for i in range(5)) / 2**24)
    assert tails._coin_two_sided(12, 24) == 1.0


def test_chi_square_of_one_degree_is_a_squared_normal():
    for z in (0.01, 0.7, 2.5, 6.0, 20.0):
        assert tails._gamma_q(0.5, z * z / 2) == pytest.approx(tails._normal_two_sided(z), rel=1e-10)


def test_many_degrees_approach_the_normal():
    assert tails._t_two_sided(2.0, 1e7) == pytest.approx(tails._normal_two_sided(2.0), rel=1e-6)


def test_nulls_pass_through(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, 1.0)], "x double, k double")
    rows = df.select(tails.chi2_p("x", "k").alias("c"), tails.t_p("x", "k").alias("t"), tails.normal_p("x").alias("n")).collect()
    assert tuple(rows[0]) == (None, None, None) and rows[1]["t"] == pytest.approx(0.5)


def test_a_fraction_that_does_not_end_is_no_number(monkeypatch):
    import math

    from rankfold.functions import tails

    monkeypatch.setattr(tails, "MOST_STEPS", 2)
    assert math.isnan(tails._gamma_q(3.0, 9.0)) and math.isnan(tails._beta_i(0.4, 30.0, 40.0))
