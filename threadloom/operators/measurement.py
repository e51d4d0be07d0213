"""Measurement models on labelled texts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.joins import parts_of
from threadloom.plans.fixpoint import saved

#: Words of the vocabulary, the most frequent of those in two documents or more.
VOCABULARY = 20_000
#: Texts that a task splits, about.
TEXTS_A_TASK = 2_000


def tfidf_logistic(rows: DataFrame, text: str, label: str, fold: str, keep: list[str]) -> DataFrame:
    """Out-of-fold probabilities of label 1: term weights over words and pairs of words, logistic regression with balanced classes.

    Rows of each fold are scored by a model of the others; rows without a label are scored by every fold's model's complement as well,
    so each row is scored once. Texts are split once to count terms by fold and once to number them, whatever the number of folds; the
    models read the saved numbers. A fold's vocabulary is, of the terms in two or more of its training texts, the VOCABULARY most
    frequent (ties by the term); other terms weigh nothing.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    columns = list(dict.fromkeys([*keep, label, fold]))
    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", w[i - 1], w[i]))
    terms = F.element_at(F.transform(F.array(split), lambda w: F.when(F.size(w) > 1, F.concat(w, pairs(w))).otherwise(w)), 1)
    parts = max(parts_of(rows, TEXTS_A_TASK), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, *keep)  # a file of few row groups is split by few tasks else
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())  # a handful
    once = F.concat(F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(0).alias("df"))), F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("df"))))
    said = rows.where(F.col(label).isNotNull()).select(F.col(fold).alias("fold"), terms.alias("terms")).select("fold", F.explode(once).alias("x")).select("fold", "x.*")
    counted = saved(said.groupBy("term", "fold").agg(F.sum(1 - F.col("df")).alias("tf"), F.sum("df").alias("df")), "terms")
    known = {}
    for k in folds:
        rest = counted.where(F.col("fold") != k).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).where("df >= 2")
        known[k] = {r["term"]: r["df"] for r in rest.orderBy(F.desc("tf"), "term").limit(VOCABULARY).collect()}  # VOCABULARY rows
    names = sorted(set().union(*known.values())) or [""]
    number = CountVectorizerModel.from_vocabulary(names, inputCol="terms", outputCol="counts")
    held = saved(number.transform(rows.select(*columns, terms.alias("terms"))).select(*columns, "counts"), "counts")
    unit = Normalizer(inputCol="scaled", outputCol="features")
    model = LogisticRegression(labelCol=label, weightCol="balance", maxIter=50, regParam=0.01)
    out = None
    for k in folds:
        train = held.where((F.col(fold) != k) & F.col(label).isNotNull())
        n, ones = train.agg(F.count(F.lit(1)), F.sum(label)).first()
        test = held.where(F.col(fold) == k)
        if not ones or ones == n:
            part = test.select(*keep, F.lit(float(bool(ones))).alias("p"))
        else:
            idf = Vectors.dense([math.log((n + 1) / (known[k][x] + 1)) if x in known[k] else 0.0 for x in names])
            weigh = ElementwiseProduct(scalingVec=idf, inputCol="counts", outputCol="scaled")
            balance = F.when(F.col(label) == 1, n / (2.0 * ones)).otherwise(n / (2.0 * (n - ones)))
            fitted = model.fit(unit.transform(weigh.transform(train.withColumn("balance", balance))))
            part = fitted.transform(unit.transform(weigh.transform(test))).select(*keep, vector_to_array("probability")[1].alias("p"))
        out = part if out is None else out.unionByName(part)
    return rows.select(*keep).limit(0).withColumn("p", F.lit(None).cast("double")) if out is None else out
