"""A relation classifier fitted on labelled pairs: hashed words, TF-IDF and a multinomial logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F


def pair_text(subject: str, object_: str, text: str) -> Column:
    """What the classifier reads of a pair: both names, marked, and the chunk."""
    return F.concat_ws(" ", F.lit("subject"), F.coalesce(subject, F.lit("")), F.lit("object"), F.coalesce(object_, F.lit("")), F.lit("text"), F.coalesce(text, F.lit("")))


def train_relations(labelled: DataFrame, text: str, label: str, features: int = 1 << 14) -> PipelineModel:
    """A classifier of text(text) into the labels; rows without either are left out. Labels are ordered by name."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).alias("relation"))
    index = StringIndexer(inputCol="relation", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    steps = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="x"),
        LogisticRegression(featuresCol="x", labelCol="label", regParam=0.01, maxIter=50),
        IndexToString(inputCol="prediction", outputCol="guess", labels=index.labels),
    ]
    return Pipeline(stages=steps).fit(index.transform(rows))


def classify_relations(model: PipelineModel, pairs: DataFrame, key: str, text: str, least: float = 0.6) -> DataFrame:
    """(key, relation, score) of pairs whose likeliest relation has a probability of ``least`` or more."""
    out = model.transform(pairs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("text")))
    return out.select(key, F.col("guess").alias("relation"), F.array_max(vector_to_array("probability")).alias("score")).where(F.col("score") >= least)
