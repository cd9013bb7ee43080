"""Weights that bring one set of prompts to the distribution of another: a balanced logistic classifier on embeddings.

Both sides are sampled with replacement, so many draws a side at most (a documented bound of the fit); the classifier is
``spark.ml``'s logistic regression with each class weighing the same and a penalty of half the squared coefficients for the whole
sample. It is applied to every row with built-in functions.

Results for odd input: rows whose embedding is null, of another length or has a null or NaN take no part in the fit and have
no probability and no weight; repeated rows are drawn each; a side without rows is an error; columns ``p_desirable`` and
``weight`` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.rewards import density_weight
from lodestone.operators.replay import draws


@dataclass(frozen=True)
class Classifier:
    coefficients: tuple[float, ...]
    intercept: float

    def probability(self, embedding: str) -> Column:
        """Of being desirable; null where it cannot be told."""
        w = F.array(*[F.lit(float(x)) for x in self.coefficients])
        whole = (F.size(embedding) == len(self.coefficients)) & ~F.exists(F.col(embedding), lambda x: x.isNull() | F.isnan(x))
        margin = F.aggregate(F.zip_with(F.col(embedding), w, lambda x, y: x.cast("double") * y), F.lit(self.intercept), lambda a, b: a + b)
        return F.when(whole, 1 / (1 + F.exp(-margin)))


def sample(df: DataFrame, key: str, embedding: str, n: int, seed: int) -> DataFrame:
    """So many draws with replacement, or as many as there are rows if those are fewer."""
    rows = df.select(F.col(key).alias("_key"), F.col(embedding).cast("array<double>").alias("_e"))
    most = min(n, rows.count())
    if not most:
        raise ValueError("no rows to draw from")
    drawn = draws(rows.select("_key", F.lit(1.0).alias("_one")), "_one", "_key", most, seed)
    return drawn.join(rows, "_key").select("draw", "_e")


def fit(desirable: DataFrame, undesirable: DataFrame, key: str, embedding: str, n: int = 1024, seed: int = 0) -> Classifier:
    good = lambda df: df.where(F.col(embedding).isNotNull() & ~F.exists(F.col(embedding), lambda x: x.isNull() | F.isnan(x)))
    sides = [sample(good(df), key, embedding, n, seed + k).withColumn("label", F.lit(float(1 - k))) for k, df in enumerate((desirable, undesirable))]
    rows = sides[0].unionByName(sides[1]).checkpoint()
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(counts.values())
    balance = F.when(F.col("label") == 1, total / (2 * counts[1.0])).otherwise(total / (2 * counts[0.0]))
    model = LogisticRegression(featuresCol="_v", labelCol="label", weightCol="_w", regParam=1.0 / total, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8)
    fitted = model.fit(rows.select("label", array_to_vector("_e").alias("_v"), balance.alias("_w")))
    return Classifier(tuple(float(x) for x in fitted.coefficients), float(fitted.intercept))


def with_weights(df: DataFrame, classifier: Classifier, embedding: str, low: float = 0.1, high: float = 10.0) -> DataFrame:
    """Adds ``p_desirable`` and ``weight``, the clamped ratio of both densities."""
    out = df.drop("p_desirable", "weight").withColumn("p_desirable", classifier.probability(embedding))
    return out.withColumn("weight", F.when(F.col("p_desirable").isNotNull(), density_weight(F.col("p_desirable"), low, high)))
