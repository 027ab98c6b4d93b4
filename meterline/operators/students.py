"""Student classifiers: TF-IDF, embedding and hybrid features with logistic regression or MLP.

Fitting is Spark ML: vocabulary and gradients are aggregated over the partitions. To the driver
come only the vocabulary (bounded by `vocab_size`), the label list and the model weights.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import (
    IDF, CountVectorizerModel, ElementwiseProduct, IndexToString, NGram, Normalizer, RegexTokenizer,
    SQLTransformer, StringIndexer, VectorAssembler)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.lineage import stored
from meterline.operators.evaluate import classification_metrics, majority_baseline

BYTES_PER_PARTITION = 16 << 20
TFIDF_KINDS = ("tfidf_logistic", "tfidf_mlp")
EMBEDDING_KINDS = ("embedding_logistic", "embedding_mlp")
HYBRID_KINDS = ("hybrid_logistic", "hybrid_mlp")
KINDS = TFIDF_KINDS + EMBEDDING_KINDS + HYBRID_KINDS


@dataclass(frozen=True)
class StudentSpec:
    kind: str = "tfidf_logistic"
    vocab_size: int | None = None
    hidden: tuple[int, ...] | None = None
    max_iter: int | None = None
    seed: int = 42

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown student kind: {self.kind!r}")


def _word_stages() -> list:
    # A match starts where no word is under way and takes all of it, so it needs no word boundaries.
    return [
        RegexTokenizer(inputCol="text", outputCol="_one", pattern=r"(?U)\w\w+", gaps=False),
        NGram(n=2, inputCol="_one", outputCol="_two"),
        SQLTransformer(statement="SELECT *, concat(_one, _two) AS _grams FROM __THIS__"),
    ]


def _vocabulary(grams: DataFrame, spec: StudentSpec) -> CountVectorizerModel:
    """The words and word pairs that occur most often, the first in order on a tie; for an MLP those of
    two texts at least. Counted as rows, partly before they are shuffled."""
    on_text = spec.kind == "tfidf_mlp"
    size = spec.vocab_size or (20_000 if on_text else 50_000)
    numbered = grams.withColumn("_text", F.monotonically_increasing_id()) if on_text else grams
    each = numbered.select(*(["_text"] if on_text else []), F.explode("_grams").alias("gram"))
    counted = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), *(
        [F.min("_text").alias("first"), F.max("_text").alias("last")] if on_text else []))
    if on_text:
        counted = counted.where("first <> last")
    rows = counted.orderBy(F.desc("n"), "gram").limit(size).select("gram").collect()
    return CountVectorizerModel.from_vocabulary(
        [r["gram"] for r in rows], inputCol="_grams", outputCol="_counts")


def _fit_tfidf(train: DataFrame, spec: StudentSpec) -> tuple[list, list, DataFrame]:
    """Counts times ln((1+n)/(1+df))+1, scaled to length 1: the stages that count words, those that
    weigh the counts, and the training rows with their counts. The texts are cut into words once."""
    words = _word_stages()
    grams = stored(PipelineModel(stages=words).transform(train).drop("text", "_one", "_two"), "grams")
    vocabulary = _vocabulary(grams, spec)
    # the names of all features would travel with every task that reads the counts
    counted = stored(vocabulary.transform(grams).drop("_grams").withColumn(
        "_counts", F.col("_counts").alias("_counts", metadata={})), "counts")
    idf = IDF(inputCol="_counts", outputCol="_idf").fit(counted)
    weights = Vectors.dense([w + 1.0 for w in idf.idf.toArray()])
    return [*words, vocabulary], [
        ElementwiseProduct(scalingVec=weights, inputCol="_counts", outputCol="_weighted"),
        Normalizer(inputCol="_weighted", outputCol="_tfidf"),
    ], counted


@dataclass(frozen=True)
class Student:
    features: PipelineModel
    classifier: object
    labels: list[str]

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add `prediction` and `confidence`, the largest class probability."""
        scored = self.classifier.transform(self.features.transform(_with_vector(rows)))
        named = IndexToString(inputCol="_class", outputCol="prediction", labels=self.labels)
        return named.transform(scored).withColumn(
            "confidence", F.array_max(vector_to_array("_probability"))
        ).select(*rows.columns, "prediction", "confidence")


def _with_vector(rows: DataFrame) -> DataFrame:
    if "embedding" not in rows.columns:
        return rows
    return rows.withColumn("_embedding", array_to_vector(F.col("embedding").cast("array<double>")))


def _features(train: DataFrame, spec: StudentSpec) -> tuple[PipelineModel, DataFrame]:
    """The stages that turn rows into features, and the training rows with theirs."""
    inputs, counting, weighing = [], [], []
    if spec.kind in EMBEDDING_KINDS + HYBRID_KINDS:
        inputs.append("_embedding")
    if spec.kind in TFIDF_KINDS + HYBRID_KINDS:
        counting, weighing, train = _fit_tfidf(train, spec)
        inputs.append("_tfidf")
    weighing = [*weighing, VectorAssembler(inputCols=inputs, outputCol="_features")]
    return PipelineModel(stages=[*counting, *weighing]), PipelineModel(stages=weighing).transform(train)


def _prepared(rows: DataFrame, *extra: str) -> DataFrame:
    """Fitting input, written once; the estimators keep their own blocks of it in memory or on disk.
    Each iteration is a job over it, so it has no more partitions than its size asks for. One
    attribute entry per feature would travel with every task of every iteration, so the metadata is
    left behind."""
    frame = stored(rows.select(
        F.col("_features").alias("_features", metadata={}), "_target", *extra), "features")
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return frame.coalesce(max(1, -(-size // BYTES_PER_PARTITION)))


def fit_student(train: DataFrame, spec: StudentSpec = StudentSpec()) -> Student | None:
    """Fit on `label` and `text` and/or `embedding`. None where a majority baseline is due: fewer
    than two labels or three rows."""
    used = [c for c in ("text", "embedding") if c in train.columns]
    train = _with_vector(stored(train.select(*used, F.col("label").cast("string").alias("label")), "train"))
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("labels")).first()
    n_rows, n_labels = totals["rows"] or 0, totals["labels"]
    if n_labels < 2 or n_rows < 3:
        return None
    indexer = StringIndexer(inputCol="label", outputCol="_target",
                            stringOrderType="alphabetAsc").fit(train)
    labels = list(indexer.labelsArray[0])
    features, ready = _features(indexer.transform(train), spec)
    if spec.kind.endswith("logistic"):
        # Balanced class weights sum to the row count; C = 1 is a penalty of 1 / rows per row.
        balanced = stored(counts.select("label", (
            F.lit(float(n_rows)) / (F.lit(float(n_labels)) * F.col("_n"))).alias("_weight")),
            "weights")
        ready = ready.join(balanced, "label")
        classifier = LogisticRegression(
            featuresCol="_features", labelCol="_target", weightCol="_weight",
            predictionCol="_class", probabilityCol="_probability", rawPredictionCol="_raw",
            family="multinomial", standardization=False, regParam=1.0 / n_rows, tol=1e-4,
            maxIter=spec.max_iter or (1000 if spec.kind == "tfidf_logistic" else 2000))
        prepared = _prepared(ready, "_weight")
    else:
        prepared = _prepared(ready)
        width = prepared.first()["_features"].size
        hidden = spec.hidden or ((256, 128) if spec.kind == "tfidf_mlp" else (256,))
        classifier = MultilayerPerceptronClassifier(
            featuresCol="_features", labelCol="_target", predictionCol="_class",
            probabilityCol="_probability", rawPredictionCol="_raw", seed=spec.seed, blockSize=64,
            layers=[width, *hidden, len(labels)],
            maxIter=spec.max_iter or (80 if spec.kind == "tfidf_mlp" else 120))
    return Student(features, classifier.fit(prepared), labels)


def train_and_score(
    train: DataFrame, evaluation: DataFrame, spec: StudentSpec = StudentSpec()
) -> tuple[Student | None, DataFrame]:
    """Fit, predict the evaluation rows, and return the scored rows as well."""
    student = fit_student(train, spec)
    if student is None:
        return None, majority_baseline(train, evaluation, "label")
    return student, student.predict(evaluation)


def student_report(
    train: DataFrame, evaluation: DataFrame, spec: StudentSpec = StudentSpec()
) -> DataFrame:
    """One row: kind, accuracy, macro-F1, sizes."""
    student, scored = train_and_score(train, evaluation, spec)
    kind = spec.kind if student is not None else "most_frequent"
    scored = scored.withColumn("label", F.col("label").cast("string"))
    return classification_metrics(scored, "label", "prediction") \
        .withColumn("student_kind", F.lit(kind)) \
        .withColumn("train_samples", F.lit(train.count()))
