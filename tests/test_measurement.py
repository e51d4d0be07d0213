"""Term weights with logistic regression: one reading of the texts for all folds, and a vocabulary that does not hang on partitions."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import measurement


def test_texts_are_split_twice_whatever_the_folds(spark, monkeypatch):
    monkeypatch.setattr(measurement, "VOCABULARY", 12)
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["good", "fine", "Plain"] if i % 2 else ["bad", "poor", "plain"]) for _ in range(6)) if i else None, i % 2 if i % 10 else None, i % 4) for i in range(80)]
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    docs = spark.createDataFrame(rows, "doc long, body string, y int, fold int").repartition(3)
    got = measurement.tfidf_logistic(docs.withColumn("body", F.udf(seen, "string")("body")), "body", "y", "fold", ["doc", "y"]).collect()
    assert read.value <= 2 * len(rows)
    assert sorted(x.doc for x in got) == list(range(80)) and all((x.p > 0.5) == (x.doc % 2 == 1) for x in got if x.doc)
    again = measurement.tfidf_logistic(docs.repartition(2, "fold"), "body", "y", "fold", ["doc", "y"]).collect()
    assert {x.doc: x.p for x in again} == pytest.approx({x.doc: x.p for x in got}, abs=1e-6)
