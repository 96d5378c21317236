"""Classifiers and vector statistics on Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.feature import PCA, StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import written
from .evaluate import binary_scores
from .sample import coreset, ranks


def pca_2d(vectors: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """keep, x, y and the explained variance of two principal components; signs are free."""
    v = vectors.withColumn("_v", array_to_vector(column))
    steps = Pipeline(stages=[StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False), PCA(k=2, inputCol="_c", outputCol="_p")])
    model = steps.fit(v)
    share = model.stages[-1].explainedVariance.toArray()
    xy = vector_to_array("_p")
    return model.transform(v).select(*keep, xy[0].alias("x"), xy[1].alias("y"), F.lit(float(share[0])).alias("explained_x"), F.lit(float(share[1])).alias("explained_y"))


def frechet_distance(vectors: DataFrame, column: str, group: str) -> DataFrame:
    """Distance of the two groups' Gaussians: means and covariances are summed in Spark, the
    d x d square root is taken of the two small results. Under two rows a side: infinity."""
    def sums(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for g, rows in pdf.groupby(group):
                x = np.array(rows[column].tolist(), dtype=np.float64)
                yield pd.DataFrame({"g": [g], "n": [len(x)], "s": [x.sum(axis=0)], "p": [(x.T @ x).ravel()]})

    kind = vectors.schema[group].dataType.simpleString()
    parts = vectors.select(group, column).mapInPandas(sums, f"g {kind}, n long, s array<double>, p array<double>")
    each = lambda c: F.posexplode(c).alias("i", "v")
    got: dict = {}
    for r in parts.groupBy("g").agg(F.sum("n").alias("n")).collect():  # a row for each group
        got[r.g] = {"n": r.n}
    for c in ("s", "p"):  # as many sums as dims, and as their square
        for r in parts.select("g", each(c)).groupBy("g", "i").agg(F.sum("v").alias("v")).collect():
            got[r.g].setdefault(c, {})[r.i] = r.v
    spark = vectors.sparkSession
    if len(got) != 2 or min(g["n"] for g in got.values()) < 2:
        return spark.createDataFrame([(float("inf"),)], "distance double")
    mu, cov = [], []
    for _, g in sorted(got.items()):
        n, k = g["n"], len(g["s"])
        m = np.array([g["s"][i] for i in range(k)]) / n
        p = np.array([g["p"][i] for i in range(k * k)]).reshape(k, k) / n
        mu.append(m)
        cov.append((p - np.outer(m, m)) * n / (n - 1))
    root = np.sqrt(np.maximum(np.linalg.eigvals(cov[0] @ cov[1]).real, 0)).sum()
    return spark.createDataFrame([(float(((mu[0] - mu[1]) ** 2).sum() + np.trace(cov[0]) + np.trace(cov[1]) - 2 * root),)], "distance double")


def folds(df: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """A fold number for each row, even within each class: the rank of its hash in the class, by k."""
    return ranks(df, label, key).withColumn("fold", F.pmod("rank", F.lit(k)).cast("int")).drop("rank", "n")


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=columns, outputCol="features").transform(filled)


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of a Gaussian kernel: a linear model on them is a kernel model.

    Products of the cosines of `size` random projections have the kernel exp(-gamma |x - y|^2) as their expectation."""

    gamma = Param(Params._dummy(), "gamma", "width of the kernel", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "of the projections", TypeConverters.toInt)

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None, gamma: float = 0.1, size: int = 200, seed: int = 42) -> None:  # noqa: N803
        super().__init__()
        self._setDefault(gamma=0.1, size=200, seed=42)
        self._set(**{k: v for k, v in {"inputCol": inputCol, "outputCol": outputCol, "gamma": gamma, "size": size, "seed": seed}.items() if v is not None})

    def function(self) -> Callable[[np.ndarray], np.ndarray]:
        """What makes the features of the rows of a matrix."""
        gamma, size, seed = (self.getOrDefault(p) for p in (self.gamma, self.size, self.seed))

        def turned(m: np.ndarray) -> np.ndarray:
            rng = np.random.default_rng(seed)
            turns, shift = rng.normal(size=(m.shape[1], size)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, size)
            return np.cos(m @ turns + shift) * np.sqrt(2 / size)

        return turned

    def _transform(self, dataset: DataFrame) -> DataFrame:
        turned = self.function()

        @F.pandas_udf("array<double>")
        def cosines(x: pd.Series) -> pd.Series:
            return pd.Series(list(turned(np.array(x.tolist(), dtype=np.float64).reshape(len(x), -1))), dtype=object)

        return dataset.withColumn(self.getOutputCol(), array_to_vector(cosines(vector_to_array(self.getInputCol()))))


STRENGTHS = (0.1, 1, 10, 50)


def weather_candidates(trees: int = 300, weight: str | None = None) -> dict:
    """The classifiers that compete, by name: linear ones, ones of a Gaussian kernel and a forest. weight: a column of row weights."""
    w = {"weightCol": weight} if weight else {}
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    turned = FourierFeatures(inputCol="scaled", outputCol="turned")
    linear = {f"linear_{c}": Pipeline(stages=[scale, LogisticRegression(featuresCol="scaled", regParam=1 / c / 100, maxIter=40, **w)]) for c in STRENGTHS}
    kernel = {f"kernel_{c}": Pipeline(stages=[scale, turned, LogisticRegression(featuresCol="turned", regParam=1 / c / 1000, maxIter=40, **w)]) for c in STRENGTHS}
    return linear | kernel | {"forest": Pipeline(stages=[RandomForestClassifier(numTrees=trees, maxDepth=8, maxMemoryInMB=1024, seed=42, **w)])}


#: Beyond so many rows a forest draws equal rows several at a time.
DRAWS = 100_000
#: Trees of a forest grow together as long as their draws, one number for each row and tree, are no more.
AT_ONCE = 50_000_000


def merged(df: DataFrame, columns: list, counts: dict[str, Column]) -> DataFrame:
    """Rows that are equal in the columns as one row with their counts, as a written table: a fit with weights takes as many rows as differ."""
    return written(df.groupBy(*columns).agg(*[c.alias(n) for n, c in counts.items()]), "merged")


def drawn(train: DataFrame, draws: int = DRAWS) -> DataFrame:
    """train(rows, weight), a written table, as what a forest draws: up to `draws` rows each is drawn on its own; of more, up to
    rows / draws equal ones are drawn together. Every row keeps its weight, and rows that differ are never drawn together."""
    total = train.agg(F.sum("rows")).first()[0] or 0
    parts = F.ceil(F.col("rows") / max(1, -(-total // draws))).cast("int")
    out = train.withColumns({"weight": F.col("weight") / parts, "_part": F.explode(F.sequence(F.lit(1), parts))})
    place = F.xxhash64(vector_to_array("features"), "label", "_part")  # the same rows in the same order in every run
    tasks = max(train.sparkSession.sparkContext.defaultParallelism, train.count() // 500_000)  # each shuffles figures for all nodes of all trees
    return out.withColumn("_place", place).repartition(tasks, "_place").sortWithinPartitions("_place").drop("_part", "_place")


def forest(estimator: RandomForestClassifier, train: DataFrame) -> RandomForestClassificationModel:
    """The forest on what drawn() gives, AT_ONCE draws at a time: Spark holds a row with a number for each tree, and shuffles figures for each
    node of each tree, so all trees together take many times the rows. Those that grow apart are one forest in the end."""
    spark, trees = train.sparkSession, estimator.getNumTrees()
    train = train.persist()
    runs = -(-trees // max(10, AT_ONCE // max(1, train.count())))
    grown = []
    for i in range(runs):
        some = {estimator.numTrees: trees * (i + 1) // runs - trees * i // runs, estimator.seed: estimator.getSeed() + i}
        grown.append(estimator.fit(train, some))
        if runs > 1:
            spark._jvm.System.gc()  # else the shuffle files of all runs lie beside each other
    train.unpersist()
    if runs == 1:
        return grown[0]
    java = spark._jvm.org.apache.spark.ml.classification
    of = spark.sparkContext._gateway.new_array(java.DecisionTreeClassificationModel, trees)
    for i, tree in enumerate(t for m in grown for t in m._java_obj.trees()):
        of[i] = tree
    return estimator._copyValues(RandomForestClassificationModel(java.RandomForestClassificationModel(estimator.uid, of, grown[0].numFeatures, max(m.numClasses for m in grown))))


def scalers(estimators: list[Pipeline], train: DataFrame) -> dict[str, Model]:
    """The scalers of the estimators by uid, fitted to train(features, rows); they know no weights, so a row comes as often as it stands for."""
    each = train.select("features", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))))
    return {s.uid: s.fit(each) for s in {s.uid: s for e in estimators for s in e.getStages() if isinstance(s, StandardScaler)}.values()}


def ridge(stage: Estimator) -> bool:
    """Whether a classifier is one that logistic() fits."""
    return isinstance(stage, LogisticRegression) and stage.isSet("weightCol") and not stage.getElasticNetParam() and stage.getFitIntercept() and stage.getStandardization()


def function(stage: Transformer) -> Callable[[np.ndarray], np.ndarray] | None:
    """What a stage makes of the rows of a matrix; none if it is not of the kinds known here."""
    if isinstance(stage, FourierFeatures):
        return stage.function()
    if not isinstance(stage, StandardScalerModel):
        return None
    mean, std = stage.mean.toArray() * stage.getWithMean(), stage.std.toArray()
    by = np.divide(1, std, out=np.zeros_like(std), where=std > 0) if stage.getWithStd() else np.ones_like(std)
    return lambda m: (m - mean) * by


def slopes(train: DataFrame, turns: list[Callable], at: np.ndarray | None) -> np.ndarray:
    """A row for each row of coefficients in `at`, the intercept last (None: one row of zeros): the loss over train(x, label, weight, rows), the sum
    of squared weights, the gradient and the upper half of the second derivatives. A task sends only its sums; what `turns` make of x is never stored."""
    def of(batches):  # noqa: ANN001, ANN202
        total = None
        for batch in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for turn in turns:
                x = turn(x)
            x = np.hstack([x, np.ones((len(x), 1))])
            y, one, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            w, upper, found = one * n, np.triu_indices(x.shape[1]), []
            for b in np.zeros((1, x.shape[1])) if at is None else at:
                m = x @ b
                p = (1 + np.tanh(m / 2)) / 2
                z = x * np.sqrt(w * p * (1 - p))[:, None]
                found.append(np.concatenate([[(w * (np.logaddexp(0, m) - y * m)).sum(), (w * one).sum()], x.T @ (w * (p - y)), (z.T @ z)[upper]]))
            total = np.array(found) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([len(total)], pa.int32()), "sums": [total.tobytes()]})

    few = train.coalesce(train.sparkSession.sparkContext.defaultParallelism).mapInArrow(of, "rows int, sums binary")
    return sum(np.frombuffer(r["sums"]).reshape(r["rows"], -1) for r in few.collect())  # a row for each core


def logistic(classifiers: list[LogisticRegression], train: DataFrame, turns: list[Callable]) -> list[LogisticRegressionModel]:
    """The classifiers on train(x, label, weight, rows), in which a row stands for `rows` equal ones, by Newton's method: all of them share a pass
    over the rows, features are made within it, and no row is held. The penalty is Spark's, on features in units of their deviation."""
    first = slopes(train, turns, None)[0]
    size = int(((9 + 8 * (len(first) - 2)) ** 0.5 - 3) / 2)  # gradient and upper half
    upper, half = np.triu_indices(size), np.zeros((size, size))

    def full(sums: np.ndarray) -> np.ndarray:
        half[upper] = sums[2 + size :]
        return half + np.triu(half, 1).T

    h = 4 * full(first)  # without slopes every row has a quarter of its weight
    total, apart, mean, square = h[-1, -1], first[1], h[:-1, -1] / h[-1, -1], np.diag(h)[:-1] / h[-1, -1]
    spread, rest = np.maximum(square - mean**2, 0), 1 - apart / total**2
    used = np.append(spread > 1e-12 * square, True) & (rest > 0)
    unit = np.append(np.where(used[:-1], spread / max(rest, 1e-300), 0), 0)
    share = 0.5 - first[1 + size] / total  # of the ones
    at, step, low, open_ = np.zeros((len(classifiers), size)), np.zeros((len(classifiers), size)), np.full(len(classifiers), np.inf), set(range(len(classifiers)))
    if not 1e-12 < share < 1 - 1e-12:  # one class, as Spark tells it
        at[:, -1], open_ = np.inf if share > 0.5 else -np.inf, set()
    found = dict.fromkeys(open_, first)
    for done in range(max(c.getMaxIter() for c in classifiers)):
        for i in sorted(open_):
            penalty = classifiers[i].getRegParam() * unit
            loss = found[i][0] / total + (penalty * at[i] ** 2).sum() / 2
            if loss > low[i] + 1e-12:  # too far
                step[i] /= 2
                at[i] -= step[i]
                continue
            low[i], gradient = loss, found[i][2 : 2 + size] / total + penalty * at[i]
            step[i] = 0
            step[i][used] = -np.linalg.solve((full(found[i]) / total + np.diag(penalty + 1e-12))[np.ix_(used, used)], gradient[used])
            at[i] += step[i]
            if -gradient @ step[i] < 1e-12 or done + 1 >= classifiers[i].getMaxIter():
                open_.discard(i)
        if not open_:
            break
        found = dict(zip(sorted(open_), slopes(train, turns, at[sorted(open_)]), strict=True))
    spark = train.sparkSession
    made = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel
    return [c._copyValues(LogisticRegressionModel(made(c.uid, _py2java(spark.sparkContext, Vectors.dense(b[:-1])), float(b[-1])))) for c, b in zip(classifiers, at, strict=True)]


def fitted(estimators: list[Pipeline], train: DataFrame, scaled: dict[str, Model]) -> list[PipelineModel]:
    """Estimators that share all stages but the classifier, on train(features, x, label, weight, rows), in which a row stands for `rows` equal ones
    and x are the features as an array."""
    first, lasts = [scaled.get(s.uid, s) for s in estimators[0].getStages()[:-1]], [e.getStages()[-1] for e in estimators]
    if all(map(ridge, lasts)):
        first = Pipeline(stages=first).fit(train).stages
        if inside := all(map(function, first)):  # made within the passes
            x = F.col("x")
        else:
            train, x = PipelineModel(stages=first).transform(train), vector_to_array(lasts[0].getFeaturesCol())
        flat = train.select(x.alias("x"), *[F.col(c).cast("double") for c in ("label", "weight", "rows")])
        return [PipelineModel(stages=[*first, m]) for m in logistic(lasts, flat, list(map(function, first)) if inside else [])]
    w, n = F.col("weight"), F.col("rows")
    out = []
    for last in lasts:
        if isinstance(last, LogisticRegression):  # it takes variances for the penalty as if each row were one, which `ratio` makes good
            x = train.agg(F.sum(w * n).alias("w"), F.sum(w * w * n).alias("apart"), F.sum(w * w * n * n).alias("merged")).first()  # one row
            ratio = (x.w**2 - x.merged) / (x.w**2 - x.apart) if x.w and x.w**2 > x.merged else 1.0
            last = last.copy({last.regParam: last.getRegParam() * ratio})
        model = Pipeline(stages=first).fit(train)
        if isinstance(last, RandomForestClassifier):
            end = forest(last, drawn(model.transform(train.withColumn("weight", w * n))))
        else:
            end = last.fit(model.transform(train.withColumn("weight", w * n)))
        out.append(PipelineModel(stages=[*model.stages, end]))
    return out


def to_merge(df: DataFrame, key: str, estimators: list[Pipeline]) -> tuple[DataFrame, list]:
    """df and the columns in which equal rows are one for the estimators; all rows stay apart if one of them takes no weights."""
    df = df if "weight" in df.columns else df.withColumn("weight", F.lit(1.0))
    weighed = all((s := e.getStages()[-1]).hasParam("weightCol") and s.isSet("weightCol") for e in estimators)
    return df.withColumn("features", vector_to_array("features")), ["features", "label", "weight", *([] if weighed else [key])]


def competed(df: DataFrame, key: str, candidates: dict, k: int = 5, parallelism: int = 8) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of macro F1 of each candidate over k stratified folds of df(features, label, key, weight).

    Equal rows are one row that says how many of them each fold has, so a fit takes as many rows as differ. Fits of a fold that differ only
    in the classifier share their passes over the rows, and passes run in parallel; forests, which hold their rows, grow one after the other."""
    estimators = list(candidates.values())
    rows, by = to_merge(df, key, estimators)
    few = merged(folds(rows.select("features", "label", "weight", key), "label", key, k), by, {f"in_{f}": F.count_if(F.col("fold") == f) for f in range(k)})
    few = few.withColumns({"x": F.col("features"), "features": array_to_vector("features")})
    sides = [[few.withColumn("rows", n).filter("rows > 0") for n in (sum((F.col(f"in_{g}") for g in range(k) if g != f), F.lit(0)), F.col(f"in_{f}"))] for f in range(k)]
    scaled = [scalers(estimators, train) for train, _ in sides]
    out, alike = np.zeros((k, len(estimators))), {}
    for j, e in enumerate(estimators):
        *first, last = e.getStages()
        alike.setdefault((*[s.uid for s in first], ridge(last) or j), []).append(j)

    def one(task: tuple[int, list[int]]) -> None:
        f, group = task
        train, held = sides[f]
        for j, model in zip(group, fitted([estimators[j] for j in group], train, scaled[f]), strict=True):
            out[f, j] = binary_scores(model.transform(held).select("label", "prediction", "rows"), "label", "prediction", rows="rows").first()["f1_macro"]

    tasks = [(f, group) for f in range(k) for group in alike.values()]
    light = [t for t in tasks if ridge(estimators[t[1][0]].getStages()[-1])]
    with ThreadPool(parallelism) as pool:
        list(pool.imap_unordered(inheritable_thread_target(df.sparkSession)(one), light))
    for t in tasks:
        if t not in light:
            one(t)
    return {n: (float(m.mean()), float(m.std())) for n, m in zip(candidates, out.T, strict=True)}


def fit_all(df: DataFrame, key: str, estimator: Pipeline) -> PipelineModel:
    """The estimator on all rows of df(features, label, key, weight), equal ones merged."""
    rows, by = to_merge(df, key, [estimator])
    few = merged(rows, by, {"rows": F.count(F.lit(1))}).withColumns({"x": F.col("features"), "features": array_to_vector("features")})
    return fitted([estimator], few, scalers([estimator], few))[0]


def cv_macro_f1(df: DataFrame, estimator: Pipeline, key: str, k: int = 5) -> DataFrame:
    """Mean and population deviation of macro F1 over k stratified folds of df(features, label)."""
    return df.sparkSession.createDataFrame([competed(df, key, {"one": estimator}, k)["one"]], "mean double, std double")


def winner(scores: dict[str, tuple[float, float]], gain: float = 0.02) -> str:
    """The best of the linear and kernel models by mean, or the forest if that is better by `gain`."""
    best = max((n for n in scores if n != "forest"), key=lambda n: scores[n][0])
    return "forest" if scores["forest"][0] > scores[best][0] + gain else best


def weather_fit(df: DataFrame, key: str, k: int = 5, gain: float = 0.02, trees: int = 300) -> tuple[PipelineModel, str, dict[str, tuple[float, float]]]:
    """The winner of the competition, its name and all scores; classes count alike, whatever their sizes."""
    even = balanced(df, "label")
    candidates = weather_candidates(trees, "weight")
    scores = competed(even, key, candidates, k)
    name = winner(scores, gain)
    return fit_all(even, key, candidates[name]), name, scores


def weather_predict(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    out = model.transform(df)
    return out.select(*keep, F.col("prediction").cast("int").alias("weather_label"), vector_to_array("probability")[1].alias("weather_proba"))


def balanced(df: DataFrame, label: str, rows: str | None = None) -> DataFrame:
    """`weight`: rows / (classes x rows of the class). rows: a column that says how many rows one stands for; its weight is theirs."""
    n = df.groupBy(label).agg((F.sum(rows) if rows else F.count(F.lit(1))).alias("_c"))
    all_ = W.partitionBy()
    w = n.select(label, (F.sum("_c").over(all_) / (F.count(F.lit(1)).over(all_) * F.col("_c"))).alias("weight"))  # one row per class
    out = df.join(F.broadcast(w), label)
    return out.withColumn("weight", F.col("weight") * F.col(rows)) if rows else out


def volcano_fit(df: DataFrame, label: str, columns: list[str], trees: int = 200) -> tuple[PipelineModel, list[str]] | None:
    """A balanced forest over the classes; None (use the rules) with one class or under two rows of one."""
    few = merged(df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}), [*columns, label], {"rows": F.count(F.lit(1))})
    sizes = {r[label]: r["n"] for r in few.groupBy(label).agg(F.sum("rows").alias("n")).collect()}  # one row per class
    if len(sizes) < 2 or min(sizes.values()) < 2:
        return None
    names = sorted(sizes)
    index = F.array_position(F.array(*map(F.lit, names)), F.col(label)).cast("double") - 1
    train = balanced(assembled(few, columns).withColumn("label", index), "label", "rows")
    estimator = RandomForestClassifier(numTrees=trees, maxDepth=8, maxMemoryInMB=1024, weightCol="weight", seed=42)
    return PipelineModel(stages=[forest(estimator, drawn(train.select("features", "label", "weight", "rows")))]), names


def volcano_predict(fitted: tuple[PipelineModel, list[str]], df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Class, confidence and one probability column per class."""
    model, names = fitted
    p = vector_to_array("probability")
    out = model.transform(assembled(df, columns))
    return out.select(*keep, F.get(F.array(*map(F.lit, names)), F.col("prediction").cast("int")).alias("volcano_class"), F.array_max(p).alias("class_confidence"), *[p[i].alias(f"p_{n}") for i, n in enumerate(names)])


def volcano_proba(fitted: tuple[PipelineModel, list[str]] | None, df: DataFrame, columns: list[str], keep: list[str], classes: list[str]) -> DataFrame:
    """volcano_class, class_confidence and a probability for each of the classes, 0 for one that the
    model has not seen. Without a model the rules' `class` of df has probability 1."""
    if fitted is None:
        one = [F.when(F.col("class") == c, 1.0).otherwise(0.0).alias(f"p_{c}") for c in classes]
        return df.select(*keep, F.col("class").alias("volcano_class"), F.lit(1.0).alias("class_confidence"), *one)
    out = volcano_predict(fitted, df, columns, keep)
    return out.select(*keep, "volcano_class", "class_confidence", *[F.col(f"p_{c}") if f"p_{c}" in out.columns else F.lit(0.0).alias(f"p_{c}") for c in classes])


def importance(fitted: tuple[PipelineModel, list[str]], columns: list[str], df: DataFrame) -> DataFrame:
    values = fitted[0].stages[-1].featureImportances.toArray()
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, values, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def patchcore_fit(patches: DataFrame, train_images: DataFrame, key: str) -> DataFrame:
    """The memory bank: of all non-zero patches of the training images a fixed share, at least 500."""
    used = patches.join(train_images.select("image_id"), "image_id", "left_semi").filter(F.exists("features", lambda x: x != 0))
    return coreset(used, key)

