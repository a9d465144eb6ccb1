"""Classical models on pyspark.ml, with fixed default settings."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import PCA, CountVectorizer, StandardScaler, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions.vectors import dot
from textloom.operators.features import word_tokens
from textloom.session import collect_bounded, pin, scalar


def argmax(values: Column) -> Column:
    """0-based position of the first largest value."""
    return F.array_position(values, F.array_max(values)) - 1


def as_array(vector: Column) -> Column:
    return vector_to_array(vector)


def hstack(df: DataFrame, scalars: list[str], arrays: list[str], out: str = "features") -> DataFrame:
    """Concatenate numeric columns and array columns into one vector column."""
    as_vectors = {f"_v{i}": array_to_vector(F.col(c).cast("array<double>")) for i, c in enumerate(arrays)}
    rows = df.withColumns(as_vectors) if as_vectors else df
    return VectorAssembler(inputCols=[*scalars, *as_vectors], outputCol=out).transform(rows).drop(*as_vectors)


@dataclass
class CountRows:
    rows: DataFrame  # key, features
    key: str
    vocabulary: list[str]


def count_vectors(
    df: DataFrame, key: str, text: str, max_features: int = 2000, min_df: float = 5, max_df: float = 0.7,
    stop_words: list[str] | None = None,
) -> CountRows:
    """Sparse count vectors over the most frequent terms inside the document-frequency limits."""
    tokens = tx.drop_stop_words(word_tokens(F.col(text)), stop_words)
    rows = pin(df.select(key, tokens.alias("_tokens")), "count-tokens")
    # Given shares, the fit keeps all tokens in memory as objects to count the rows; given numbers, it reads them once.
    n = rows.count()
    least = max(min_df * n, 1.0) if min_df < 1 else min_df
    most = max_df * n if max_df < 1 <= max_df * n else max_df
    model = CountVectorizer(
        inputCol="_tokens", outputCol="features", vocabSize=max_features, minDF=least, maxDF=most
    ).fit(rows)
    return CountRows(model.transform(rows).select(key, "features"), key, model.vocabulary)


@dataclass
class Topics:
    model: object
    counts: CountRows


def lda_fit(counts: CountRows, n_topics: int = 10, iterations: int = 10, seed: int = 42) -> Topics:
    return Topics(LDA(k=n_topics, maxIter=iterations, seed=seed, optimizer="online").fit(counts.rows), counts)


def doc_topics(topics: Topics) -> DataFrame:
    """(key, topic_weight, topic): dominant topic of every row."""
    weights = vector_to_array("topicDistribution")
    rows = topics.model.transform(topics.counts.rows)
    return rows.select(topics.counts.key, F.array_max(weights).alias("topic_weight"), argmax(weights).alias("topic"))


def topic_top_words(topics: Topics, k: int = 10) -> DataFrame:
    """(topic, rank, word, weight)."""
    words = F.array(*[F.lit(w) for w in topics.counts.vocabulary])
    described = topics.model.describeTopics(k)
    pairs = F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t")
    rows = described.select("topic", pairs)
    return rows.select(
        "topic", (F.col("rank") + 1).alias("rank"),
        F.element_at(words, F.col("t.termIndices") + 1).alias("word"), F.col("t.termWeights").alias("weight"),
    )


def nmf_factors(
    counts: DataFrame, key: str, n_topics: int = 10, iterations: int = 200, tolerance: float = 1e-4, seed: int = 42, inner: int = 20
) -> tuple[list[str], np.ndarray]:
    """(terms, topic rows): non-negative factors W H of the count matrix, least squares over all cells.

    Alternating multiplicative updates. Each round the rows find their W for the given H inside the
    tasks and send back W'W and W'A, summed over all rows; H (topics x kept terms) is all that the
    driver holds. Stops when a round lowers the error by less than ``tolerance`` of the first one.
    """
    # The counts are computed once; all else is read from the rows.
    rows = pin(counts.groupBy(key).agg(F.collect_list("term").alias("terms"), F.collect_list(F.col("tf").cast("double")).alias("tf")), "count-rows")
    terms = sorted(r["term"] for r in collect_bounded(rows.select(F.explode("terms").alias("term")).distinct(), what="terms"))
    words = pa.array(terms, pa.string())
    random = np.random.default_rng(seed)
    average, square = rows.select(F.explode("tf").alias("tf")).agg(F.avg("tf"), F.sum(F.col("tf") ** 2)).first()
    total, square = average or 1.0, square or 0.0
    h = np.sqrt(total / n_topics) * np.abs(random.standard_normal((n_topics, len(terms)))) + 1e-9

    def sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gram = h @ h.T

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((n_topics, n_topics + len(terms)))
            for batch in batches:
                found = batch.column("terms")
                at = pc.index_in(found.flatten(), words).to_numpy(zero_copy_only=False)
                row = pc.list_parent_indices(found).to_numpy(zero_copy_only=False)
                n = batch.column("tf").flatten().to_numpy(zero_copy_only=False)
                ah = np.stack([np.bincount(row, n * x[at], batch.num_rows) for x in h], axis=1)
                w = np.full(ah.shape, np.sqrt(total / n_topics))
                for _ in range(inner):
                    w *= ah / np.maximum(w @ gram, 1e-12)
                out[:, :n_topics] += w.T @ w
                for topic, x in enumerate(w.T):
                    out[topic, n_topics:] += np.bincount(at, n * x[row], len(terms))
            i, j = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(out[i, j])], ["i", "j", "x"])

        total_sums = np.zeros((n_topics, n_topics + len(terms)))
        found = rows.mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
        total_sums[found["i"].to_numpy(), found["j"].to_numpy()] = found["x"].to_numpy()
        return total_sums[:, :n_topics], total_sums[:, n_topics:]

    errors: list[float] = []
    for _ in range(iterations):
        ww, wa = sums(h)
        errors.append(float(np.sqrt(max(square - 2 * (wa * h).sum() + (ww * (h @ h.T)).sum(), 0.0))))
        if len(errors) > 1 and errors[-2] - errors[-1] <= tolerance * errors[0]:
            break
        for _ in range(inner):
            h = h * wa / np.maximum(ww @ h, 1e-12)
    return terms, h


def nmf_topics(counts: DataFrame, key: str, n_topics: int = 10, iterations: int = 200, seed: int = 42, k: int = 10) -> DataFrame:
    """(topic, rank, term, weight): the k heaviest terms of each topic."""
    terms, h = nmf_factors(counts, key, n_topics, iterations, seed=seed)
    rows = [
        (topic, rank + 1, terms[i], float(weights[i]))
        for topic, weights in enumerate(h)
        for rank, i in enumerate(sorted(range(len(terms)), key=lambda i: (-weights[i], terms[i]))[:k])
    ]
    return counts.sparkSession.createDataFrame(rows, "topic int, rank int, term string, weight double")


def word2vec(df: DataFrame, tokens: Column, size: int = 100, window: int = 5, min_count: int = 2, epochs: int = 10, seed: int = 42) -> DataFrame:
    """(word, vector). Every core trains on its share of the rows; the shares' vectors are averaged after each epoch."""
    rows = df.select(tokens.alias("tokens"))
    model = Word2Vec(
        vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed,
        numPartitions=df.sparkSession.sparkContext.defaultParallelism, inputCol="tokens", outputCol="_v",
    ).fit(rows)
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def _estimator(name: str):
    if name == "logistic_regression":
        return LogisticRegression(maxIter=1000)
    if name == "random_forest":
        return RandomForestClassifier(numTrees=100, seed=42)
    if name == "multinomial_nb":
        return NaiveBayes(modelType="multinomial")
    raise ValueError(f"unknown model {name!r}")


def linear_svm(train: DataFrame, test: DataFrame, iterations: int = 50) -> DataFrame:
    """One linear SVM per class against the rest; the largest margin wins. One fit per class.

    The margins are plain expressions on the feature array, so scoring adds no Python and no UDF.
    """
    classes = sorted(r["label"] for r in train.select("label").distinct().collect())

    def fit(c):
        rows = train.select("features", (F.col("label") == c).cast("double").alias("label"))
        model = LinearSVC(maxIter=iterations).fit(rows)
        return [float(w) for w in model.coefficients.toArray()], float(model.intercept)

    # The fits are independent jobs; a few at a time keep the cluster busy.
    with ThreadPoolExecutor(4) as pool:
        fitted = list(pool.map(fit, classes))
    margins = [dot(F.col("_x"), F.array(*map(F.lit, weights))) + F.lit(bias) for weights, bias in fitted]
    scored = test.withColumn("_x", vector_to_array("features")).withColumn("_m", F.array(*margins))
    labels = F.array(*[F.lit(float(c)) for c in classes])
    return scored.withColumn("prediction", F.element_at(labels, argmax(F.col("_m")).cast("int") + 1)).drop("_x", "_m")


def fit_predict(name: str, train: DataFrame, test: DataFrame) -> DataFrame:
    """Test rows with ``prediction``."""
    if name == "linear_svm":
        return linear_svm(train, test)
    return _estimator(name).fit(train).transform(test)


def compare_models(names: list[str], rows: DataFrame, split: str) -> DataFrame:
    """(model, accuracy, precision, recall, f1): weighted scores on the test rows."""
    from textloom.operators.metrics import classification_metrics

    train, test = rows.filter(F.col(split) == "train"), rows.filter(F.col(split) == "test")
    out = None
    for name in names:
        predicted = fit_predict(name, train, test).select(F.col("label").cast("int"), F.col("prediction").cast("int"))
        scores = classification_metrics(predicted, "prediction", "label").withColumn("model", F.lit(name))
        out = scores if out is None else out.unionByName(scores)
    return out


def kmeans(rows: DataFrame, features: str = "features", seed: int = 42, max_clusters: int = 5) -> DataFrame:
    """Adds ``cluster``: min(5, n / 10) clusters; none for 20 rows or fewer."""
    n = rows.count()
    if n <= 20:
        return rows.withColumn("cluster", F.lit(0))
    model = KMeans(k=min(max_clusters, n // 10), seed=seed, featuresCol=features, predictionCol="cluster").fit(rows)
    return model.transform(rows)


def pca(rows: DataFrame, k: int = 2, features: str = "features") -> DataFrame:
    """Adds pc1..pck: projection of the centred vectors on the leading components."""
    stages = [
        StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="_centred"),
        PCA(k=k, inputCol="_centred", outputCol="_pc"),
    ]
    projected = Pipeline(stages=stages).fit(rows).transform(rows)
    values = vector_to_array("_pc")
    return projected.withColumns({f"pc{i + 1}": values[i] for i in range(k)}).drop("_centred", "_pc")


def explained_variance(rows: DataFrame, k: int, features: str = "features") -> DataFrame:
    """(component, variance, ratio): leading eigenvalues of the sample covariance."""
    model = PCA(k=k, inputCol=features, outputCol="_pc").fit(rows)
    ratios = [float(v) for v in model.explainedVariance.toArray()]
    dims = rows.select(F.posexplode(vector_to_array(features)).alias("i", "x"))
    total = scalar(dims.groupBy("i").agg(F.var_samp("x").alias("v")).agg(F.sum("v").alias("t")), F.col("t"))
    table = rows.sparkSession.createDataFrame([(i + 1, r) for i, r in enumerate(ratios)], "component int, ratio double")
    return table.withColumn("total", total).select("component", (F.col("ratio") * F.col("total")).alias("variance"), "ratio")
