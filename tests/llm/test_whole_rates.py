"""Rates are measured at the setting in use."""

from larkspur.llm import queries


def test_error_rate_has_the_setting_of_p4_found(spark):
    got = {r.setting: r for r in queries.p4_error_rate(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {"p4_found", "coarse"} and got["p4_found"].bound == 1e-6
    assert all(r.wrong_no == 0 and r.rate <= r.bound and r.layers >= 1 and r.new_keys > 0 for r in got.values())
