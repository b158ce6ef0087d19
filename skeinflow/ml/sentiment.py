"""A three-class scorer of texts, fitted to labelled rows: multinomial regression on hashed words and pairs of words.

Terms are counted into SLOTS by hash, scaled by how many rows have them, and the weights come from Spark's distributed
gradients; nothing of the corpus passes the driver but the weights. Its scores have the form of the other scorers: three
probabilities that sum to one and their difference, with blank texts neutral and never shown to the model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.sources.shared import stage

#: Slots for terms, penalty on the weights' squares, rounds of the descent, least rows that a term occurs in.
SLOTS, PENALTY, ROUNDS, RARE = 1 << 16, 1e-4, 50, 2
#: The classes in order.
NEGATIVE, NEUTRAL, POSITIVE = 0, 1, 2


def terms(text: Column) -> Column:
    """Lower-case words (runs of letters and digits) and neighbouring pairs of them; null counts as empty."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def with_pairs(w: Column) -> Column:
        short = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, 1, short), F.slice(w, 2, short), lambda a, b: F.concat_ws(" ", a, b)))

    # the words get a name of their own, as the variable of an array of one: they would be split for each use otherwise
    return F.get(F.transform(F.array(words), with_pairs), F.lit(0))


@dataclass
class FittedSentiment:
    """A fitted scorer; ``model`` is None if there was nothing to learn from, and every text is neutral."""

    model: PipelineModel | None

    def scored(self, df: DataFrame, text_col: str, name: str = "s") -> DataFrame:
        """``df`` with a column struct(pos_prob, neu_prob, neg_prob, score), to five digits."""
        parts = ("pos_prob", "neu_prob", "neg_prob", "score")
        neutral = F.struct(*[F.lit(x).alias(c) for c, x in zip(parts, (0.0, 1.0, 0.0, 0.0), strict=True)])
        if self.model is None:
            return df.withColumn(name, neutral)
        keep = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
        rows = self.model.transform(df.select(keep, terms(F.col(f"`{text_col}`")).alias("_terms")))
        p = vector_to_array("_probability")
        pick = lambda i: F.coalesce(F.round(F.get(p, F.lit(i)), 5), F.lit(0.0))
        found = F.struct(pick(POSITIVE).alias("pos_prob"), pick(NEUTRAL).alias("neu_prob"), pick(NEGATIVE).alias("neg_prob"), F.round(F.coalesce(F.get(p, F.lit(POSITIVE)), F.lit(0.0)) - F.get(p, F.lit(NEGATIVE)), 5).alias("score"))
        return rows.select("_row.*", F.when(F.size("_terms") > 0, found).otherwise(neutral).alias(name))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> FittedSentiment:
        return FittedSentiment(PipelineModel.load(path))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label") -> FittedSentiment:
    """Learns from rows with a label (0 negative, 1 neutral, 2 positive); null labels and blank texts are left out. Classes
    count alike, however many rows they have."""
    rows = labelled.select(terms(F.col(text_col)).alias("_terms"), F.col(label_col).cast("double").alias("_label")).filter("_label IS NOT NULL")
    counter = HashingTF(numFeatures=SLOTS, inputCol="_terms", outputCol="_counts")
    # texts are read and counted once; what follows passes over the counts
    counted = stage(counter.transform(rows).select("_label", "_counts", F.size("_terms").alias("_n")), "terms").filter("_n > 0")
    sizes = {r._label: r["count"] for r in counted.groupBy("_label").count().collect()}  # a row for each class
    if not sizes:
        return FittedSentiment(None)
    share = F.create_map(*[F.lit(x) for label, n in sizes.items() for x in (label, sum(sizes.values()) / len(sizes) / n)])
    steps = [
        IDF(minDocFreq=RARE, inputCol="_counts", outputCol="_weighed"), Normalizer(inputCol="_weighed", outputCol="_features"),
        LogisticRegression(family="multinomial", featuresCol="_features", labelCol="_label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_class", weightCol="_weight", regParam=PENALTY, maxIter=ROUNDS),
    ]
    learnt = Pipeline(stages=steps).fit(counted.withColumn("_weight", share[F.col("_label")]))
    return FittedSentiment(PipelineModel([counter, *learnt.stages]))
