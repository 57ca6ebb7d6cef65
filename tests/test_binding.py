from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tracelake.plans import binding

COMPLEX = "struct<re: double, im: double>"


def contract(spark, rows=(("a", 0, "S11", [1.0, 2.0]), ("b", 1, "S21", [1.0, 2.0]))):
    return spark.createDataFrame(list(rows), "channel string, position int, s_parameter string, axis array<double>")


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(t, c, [(3.0, 0.0), (5.0, float(t))]) for t in range(2) for c in "ab"], f"trace_id int, channel string, values array<{COMPLEX}>")


@pytest.fixture(scope="module")
def calibration(spark):
    rows = [(c, k, (1.0, 0.0), (2.0, 0.0), (0.0, 0.0), True) for c in "ab" for k in range(2)]
    terms = spark.createDataFrame(rows, f"channel string, k int, D {COMPLEX}, T {COMPLEX}, S {COMPLEX}, ok boolean")
    return binding.Calibration(terms, contract(spark), "cal", "d1")


@pytest.fixture(scope="module")
def background(spark):
    means = spark.createDataFrame([(c, k, 1.0, 0.0) for c in "ab" for k in range(2)], "channel string, k int, re double, im double")
    return binding.Background(means, contract(spark), "osl_calibrated", "cal", "d1")


def test_bound_references_are_applied(spark, samples, calibration, background):
    got = binding.calibrate(samples, contract(spark), "frequency_raw", calibration)
    assert {(r.trace_id, r.channel): [tuple(v) for v in r["values"]] for r in got.collect()} == {(t, c): [(1.0, 0.0), (2.0, t / 2)] for t in range(2) for c in "ab"}
    less = binding.without_background(got, contract(spark), "frequency_calibrated", background, calibration)
    assert less.where("trace_id = 1 and channel = 'b'").first()["values"][1] == (1.0, 0.5)
    raw = replace(background, kind="raw", calibration_id=None, calibration_sha256=None)
    assert binding.without_background(samples, contract(spark), "frequency_raw", raw).first()["values"][0] == (2.0, 0.0)


@pytest.mark.parametrize("rows, problem", [
    ([("a", 0, "S11", [1.0, 2.0])], "b: missing"),
    ([("a", 0, "S11", [1.0, 2.0]), ("b", 1, "S21", [1.0, 2.0]), ("c", 2, "S21", [1.0, 2.0])], "c: unbound"),
    ([("a", 1, "S11", [1.0, 2.0]), ("b", 0, "S21", [1.0, 2.0])], "a: position, b: position"),
    ([("a", 0, "S22", [1.0, 2.0]), ("b", 1, "S21", [1.0, 2.0])], "a: s_parameter"),
    ([("a", 0, "S11", [1.0, 2.0]), ("b", 1, "S21", [1.0, 2.0000000000000004])], "b: axis"),
    ([("a", 0, "S11", [1.0, 2.0]), ("b", 1, "S21", None)], "b: axis"),
    ([("a", 0, "S11", [1.0, 2.0]), ("a", 0, "S11", [1.0, 2.0]), ("b", 1, "S21", [1.0, 2.0])], "a: repeated"),
])
def test_other_contracts_are_refused(spark, samples, calibration, background, rows, problem):
    with pytest.raises(binding.NotBound, match=f"^{problem}$"):
        binding.calibrate(samples, contract(spark, rows), "frequency_raw", calibration)
    with pytest.raises(binding.NotBound, match=f"^{problem}$"):
        binding.without_background(samples, contract(spark, rows), "frequency_calibrated", background, calibration)


def test_other_provenance_is_refused(spark, samples, calibration, background):
    c = contract(spark)
    with pytest.raises(binding.NotBound, match="not calibrated"):
        binding.calibrate(samples, c, "frequency_calibrated", calibration)
    for domain, bg, cal, word in (
        ("frequency_raw", background, None, "kind"),
        ("time_base", background, calibration, "kind"),
        ("frequency_calibrated", replace(background, kind="raw"), calibration, "kind"),
        ("frequency_calibrated", background, None, "without"),
        ("frequency_calibrated", background, replace(calibration, calibration_id="x"), "another id"),
        ("frequency_calibrated", background, replace(calibration, sha256="x"), "another digest"),
        ("frequency_raw", replace(background, kind="raw"), None, "names a calibration"),
    ):
        with pytest.raises(binding.NotBound, match=word):
            binding.without_background(samples, c, domain, bg, cal)


def test_poles_are_refused(spark, samples, calibration):
    pole = calibration.terms.withColumn("S", F.when((F.col("channel") == "b") & (F.col("k") == 0), F.struct(F.lit(-1.0).alias("re"), F.lit(0.0).alias("im"))).otherwise(F.col("S")))
    for bad in (pole, calibration.terms.withColumns({x: F.when(F.col("k") == 0, F.col(x)) for x in "DTS"})):
        with pytest.raises(Exception, match="pole"):
            binding.calibrate(samples, contract(spark), "frequency_raw", replace(calibration, terms=bad)).collect()
