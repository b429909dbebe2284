"""Baselines: bag-of-words or encoder features with one logistic regression for each label."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, NGram, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportlake.functions.decisions import binary, confidence
from reportlake.operators.encoders import TextEncoder
from reportlake.operators.metrics import fold_metrics
from reportlake.operators.selection import stratified_folds
from reportlake.operators.terms import top_terms

#: fixed values: vocabulary, longest n-gram, iterations, folds
VOCABULARY, LONGEST, ITERATIONS, FOLDS = 10_000, 5, 1000, 5


def features(longest: int = LONGEST, vocabulary: int = VOCABULARY, stop: list[str] | None = None) -> Pipeline:
    """Words of three letters or more, without stop words, n-grams up to `longest`, the commonest counted."""
    steps = [RegexTokenizer(inputCol="report", outputCol="t0", gaps=False, pattern=r"\b[a-zA-Z]{3,}\b", toLowercase=True)]
    steps.append(StopWordsRemover(inputCol="t0", outputCol="g1", **({"stopWords": stop} if stop is not None else {})))
    steps += [NGram(n=n, inputCol="g1", outputCol=f"g{n}") for n in range(2, longest + 1)]
    steps.append(SQLTransformer(statement=f"SELECT *, concat({', '.join(f'g{n}' for n in range(1, longest + 1))}) AS grams FROM __THIS__"))
    return Pipeline(stages=[*steps, CountVectorizer(inputCol="grams", outputCol="features", vocabSize=vocabulary)])


def encoded(rows: DataFrame, encode: TextEncoder) -> DataFrame:
    """rows with `features` from a text encoder."""
    return rows.withColumn("features", array_to_vector(encode(F.coalesce("report", F.lit(" "))).cast("array<double>")))


def classifier(n: int) -> LogisticRegression:
    """L2 with C = 1: the penalty of a sum of losses is 1 / n of the mean's."""
    return LogisticRegression(featuresCol="features", labelCol="y", regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=ITERATIONS)


@dataclass
class Baseline:
    """Fitted label models, their fold metrics, and the labels that couldn't be trained."""

    models: dict[str, LogisticRegressionModel] = field(default_factory=dict)
    metrics: DataFrame | None = None
    missing: list[str] = field(default_factory=list)
    vectors: PipelineModel | None = None


def trained(rows: DataFrame, labels: list[str], folds: int = FOLDS, refit: bool = False) -> Baseline:
    """rows(pos, features, label columns 1-4) to one model for each label.

    The kept model is the last fold's, which is compatible behaviour; refit=True fits all rows instead.
    """
    out, found = Baseline(), []
    for label in labels:
        y = rows.withColumn("y", binary(F.col(f"`{label}`"))).where("y IS NOT NULL").select("pos", "features", "y")
        if y.select("y").distinct().count() < 2:
            out.missing.append(label)
            continue
        y = stratified_folds(y, "y", folds).cache()
        got = None
        for fold in range(folds):
            train, test = y.where(F.col("fold") != fold), y.where(F.col("fold") == fold)
            model = classifier(train.count()).fit(train)
            one = model.transform(test).select(F.lit(label).alias("category"), "fold", "y", F.col("prediction").cast("int").alias("predicted"))
            got = one if got is None else got.unionByName(one)
        # a row for each fold
        found += fold_metrics(got).collect()
        out.models[label] = classifier(y.count()).fit(y) if refit else model
        y.unpersist()
    if found:
        out.metrics = rows.sparkSession.createDataFrame(found)
    return out


def inferred(rows: DataFrame, models: dict[str, LogisticRegressionModel], epsilon: float = 0.1) -> DataFrame:
    """report_id, category, decision, probability for each label that has a model: one transform a label, no join."""
    out = None
    for label, model in models.items():
        p = vector_to_array("probability")[1]
        one = model.transform(rows.select("report_id", "features")).select("report_id", F.lit(label).alias("category"), confidence(p, epsilon).alias("decision"), p.alias("probability"))
        out = one if out is None else out.unionByName(one)
    return out


def coefficients(rows: DataFrame, models: dict[str, LogisticRegressionModel], vocabulary: list[str]) -> DataFrame:
    """category, term, idx, coef of every label's model: as many rows as labels and terms, which are parameters."""
    found = [(label, t, i, float(c)) for label, m in models.items() for i, (t, c) in enumerate(zip(vocabulary, m.coefficients, strict=True))]
    return rows.sparkSession.createDataFrame(found, "category string, term string, idx int, coef double")


#: Rows of a table of weights up to which it is broadcast.
WEIGHTS = 5_000_000


def contributions(rows: DataFrame, models: dict[str, LogisticRegressionModel], vocabulary: list[str]) -> DataFrame:
    """report_id, category, term, idx, weight: count times coefficient of each term that a report holds. This is also the Shapley
    value of the term in the log-odds, held against a report without words, whose own log-odds is the intercept."""
    weights = coefficients(rows, models, vocabulary)
    counts = rows.select("report_id", F.posexplode(vector_to_array("features")).alias("idx", "n")).where("n <> 0")
    weights = F.broadcast(weights) if len(models) * len(vocabulary) <= WEIGHTS else weights
    return counts.join(weights, "idx").select("report_id", "category", "term", "idx", (F.col("n") * F.col("coef")).alias("weight"))


def attributed(rows: DataFrame, models: dict[str, LogisticRegressionModel], vocabulary: list[str], k: int = 30) -> DataFrame:
    """The k strongest terms for each report and label."""
    return top_terms(contributions(rows, models, vocabulary), k)


def explained(rows: DataFrame, models: dict[str, LogisticRegressionModel], vocabulary: list[str], k: int = 20) -> DataFrame:
    """The k strongest non-zero Shapley values of each report and label, with the model's base value and the log-odds that base and all values add up to."""
    each = contributions(rows, models, vocabulary)
    sums = each.groupBy("report_id", "category").agg(F.sum("weight").alias("total"))
    base = rows.sparkSession.createDataFrame([(c, float(m.intercept)) for c, m in models.items()], "category string, base double")
    top = top_terms(each, k, nonzero=True).withColumnRenamed("weight", "value")
    return top.join(sums, ["report_id", "category"]).join(F.broadcast(base), "category").select("report_id", "category", "rank", "term", "value", "base", (F.col("base") + F.col("total")).alias("log_odds"))


def with_top_words(decided: DataFrame, top: DataFrame) -> DataFrame:
    """decided(report_id, category, ...) with top_words: `word (weight)` of attributed(), strongest first."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term", "weight"))), lambda x: F.format_string("%s (%.4f)", x["term"], x["weight"]))
    return decided.join(top.groupBy("report_id", "category").agg(F.array_join(words, ", ").alias("top_words")), ["report_id", "category"], "left")


def masked(rows: DataFrame, models: dict[str, LogisticRegressionModel], encode: TextEncoder, k: int = 30) -> DataFrame:
    """report_id, category, place, token, effect: how far the probability falls when a report's token is left out, of the first k tokens of rows(report_id, report).

    A leave-one-out attribution for encoders, whose features are no terms: every masked text is encoded. It isn't a Shapley value.
    """
    tokens = F.filter(F.split(F.coalesce("report", F.lit("")), r"\s+"), lambda t: t != "")
    rows = rows.select("report_id", tokens.alias("_t"))
    places = F.when(F.size("_t") > 0, F.sequence(F.lit(0), F.least(F.size("_t"), F.lit(k)))).otherwise(F.array(F.lit(0)))
    # place 0 is the whole report
    each = rows.select("report_id", "_t", F.explode(places).alias("place")).withColumn("token", F.when(F.col("place") > 0, F.element_at("_t", F.greatest("place", F.lit(1)))))
    left = F.array_join(F.filter("_t", lambda t, i: i != F.col("place") - 1), " ")
    given = encoded(each.select("report_id", "place", "token", left.alias("report")), encode)
    out = None
    for label, model in models.items():
        p = model.transform(given).select("report_id", F.lit(label).alias("category"), "place", "token", vector_to_array("probability")[1].alias("p"))
        out = p if out is None else out.unionByName(p)
    whole = out.where("place = 0").select("report_id", "category", F.col("p").alias("whole"))
    return out.where("place > 0").join(whole, ["report_id", "category"]).select("report_id", "category", "place", "token", (F.col("whole") - F.col("p")).alias("effect"))


def polarity_rows(train: DataFrame, most: int = 200) -> DataFrame:
    """The rows that a category's polarity model learns from: the first `most` of train(pos, category, decision, reason) with a reason and a decision, with y."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy("pos"))
    return train.where("reason IS NOT NULL AND decision BETWEEN 1 AND 4").withColumn("_r", rank).where(F.col("_r") <= most).drop("_r").withColumn("y", binary(F.col("decision")))


def polarity_models(train: DataFrame, categories: list[str], most: int = 200, least: int = 50) -> dict[str, LogisticRegressionModel]:
    """Models of a reason's polarity from train(pos, category, decision, reason, features): of each category by polarity_rows(),
    if they are enough and both polarities occur. Labels are polarities, so predictions can be held against them."""
    rows = polarity_rows(train, most).cache()
    sizes = {r.category: r for r in rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("kinds")).collect()}
    found = {c: classifier(sizes[c].n).fit(rows.where(F.col("category") == c)) for c in categories if c in sizes and sizes[c].n >= least and sizes[c].kinds > 1}
    rows.unpersist()
    return found


def model_polarity(long: DataFrame, models: dict[str, LogisticRegressionModel]) -> DataFrame:
    """long(report_id, category, decision, reason, features) with reason_polarity by the category's model; 0 without a reason or a model."""
    out = long.where(~F.col("category").isin(*models) | F.col("features").isNull() | F.col("category").isNull()).drop("features").withColumn("reason_polarity", F.lit(0))
    for c, model in models.items():
        own = model.transform(long.where((F.col("category") == c) & F.col("features").isNotNull()))
        out = out.unionByName(own.select(*out.columns[:-1], F.when(F.col("prediction") > 0.5, 1).otherwise(-1).alias("reason_polarity")))
    return out
