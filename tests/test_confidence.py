import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import classifier, ranking


def test_features_of_a_term_and_its_suggestions(spark):
    rows = spark.createDataFrame(
        [("Teh", "Teh", -1.0, -9.0, 2, 3, 0), ("Teh", "The", -3.0, -2.0, 1, 90, 1), ("Teh", "Ten", -4.0, -5.0, 3, 9, 1), ("ok", "ok", -1.0, -3.0, 1, 5, 0)],
        "observed string, term string, error_score double, lm_score double, rank int, frequency long, distance int",
    ).withColumn("combined", F.col("error_score") + F.col("lm_score"))
    found = ranking.features(rows, ["observed"]).withColumns({"left_length": F.lit(2), "right_length": F.lit(1)})
    got = {r.observed: [r[c] for c in ranking.FEATURES] for r in ranking.confidence_features(found).collect()}
    assert got["Teh"] == [-1, -9, 1, -2, 7, 1, -3, 4, 0, 0, 1, 1, 0, 1, 2, 3, 2, 1]
    assert got["ok"] == [-1, -3, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 2, 2, 1]


def data(n=300):
    rnd = np.random.default_rng(5)
    rows = []
    for i in range(n):
        x, k = float(rnd.normal()), i % 3
        rows.append((i, x, 7.0, k, int(x + rnd.normal() / 4 > 0), int(k > 0 and x > 0.5)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "i long, x double, constant double, n_suggestions int, misspelled int, top_right int")


def test_three_classifiers_and_a_constant_feature(spark):
    rows = frame(spark, data())
    model = classifier.fit_confidence(rows, ["x", "constant"], held=F.col("i") % 5 == 0, steps=6)
    assert model.offered.weights[1] == 0.0 and model.offered.weights[0] > 1
    judged = model.judged(rows)
    right = judged.filter((F.col("spell_probability") >= F.col("spell_threshold")).cast("int") == F.col("misspelled")).count()
    assert right > 250
    assert judged.select("spell_threshold").distinct().count() <= 2


def test_parts_without_rows_fall_back(spark):
    offered = [r for r in data(60) if r[3] > 0]
    model = classifier.fit_confidence(frame(spark, offered), ["x"], steps=4)
    assert model.alone.weights == pytest.approx(model.offered.weights)
    empty = classifier.fit_confidence(frame(spark, []), ["x"], steps=2)
    assert empty.thresholds == (0.5, 0.5, 0.5)
