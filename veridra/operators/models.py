"""Fits: means, ridge from one pass of sums, and pyspark.ml estimators behind one interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridra.operators.encode import Encoding, fit_encoding, with_vector
from veridra.operators.trees import Trees, fit_trees, tree_columns
from veridra.sources.workspace import stored


def mean_model(df: DataFrame, y: str, split: str = "split_name", by: list[str] | None = None) -> DataFrame:
    """Add `predicted`: the train mean of y, within `by`."""
    train = df.filter(F.col(split) == "train")
    means = train.groupBy(*(by or [])).agg(F.avg(y).alias("predicted"))
    return df.join(means, by, "left") if by else df.withColumn("predicted", F.lit(means.first()[0]))


@dataclass(frozen=True)
class Gram:
    """Sums of a table: rows, sums and products of (features..., label), about a fixed shift that keeps them well scaled."""

    columns: list[str]
    n: float
    shift: np.ndarray
    sums: np.ndarray
    products: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.columns, self.n + other.n, self.shift, self.sums + other.sums, self.products + other.products)


def grams(df: DataFrame, features: list[str], y: str, by: str) -> dict[str, Gram]:
    """One Gram per value of `by` (as text), in one pass: each partition emits one row of partial sums per value, the driver adds d*d numbers."""
    names = [*features, y]
    shift = np.array([v or 0.0 for v in df.agg(*(F.avg(F.col(c).cast("double")) for c in names)).first()])
    d = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            codes = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(d)]) - shift
            for code in np.unique(codes):
                k, part = (None if code < 0 else keys.dictionary[code].as_py()), x[codes == code]
                old = total.setdefault(k, [0, np.zeros(d), np.zeros((d, d))])
                old[0] += len(part)
                old[1] += part.sum(axis=0)
                old[2] += part.T @ part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([float(t[0]) for t in total.values()]), pa.array([t[1].tolist() for t in total.values()], pa.list_(pa.float64())), pa.array([t[2].ravel().tolist() for t in total.values()], pa.list_(pa.float64()))],
            names=["k", "n", "s", "p"],
        )

    rows = df.select(F.col(by).cast("string").alias("k"), *(F.col(c).cast("double") for c in names)).mapInArrow(run, "k string, n double, s array<double>, p array<double>")
    merged = rows.groupBy("k").agg(
        F.sum("n").alias("n"),
        *(F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(d)),
        *(F.sum(F.get("p", F.lit(i * d + j))).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)),
    )
    out = {}
    for r in merged.collect():
        p = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                p[i, j] = p[j, i] = r[f"p{i}_{j}"]
        out[r.k] = Gram(names, r.n, shift, np.array([r[f"s{i}"] for i in range(d)]), p)
    return out


def ridge(g: Gram, features: list[str], alpha: float) -> tuple[dict[str, float], float]:
    """Coefficients and intercept for standardised inputs (population deviation) with an alpha penalty on the sum of squares,
    the intercept free. Constant features get none."""
    at = [g.columns.index(c) for c in features]
    y = len(g.columns) - 1
    mean = g.sums / g.n
    cov = g.products / g.n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[at], 0))
    live = sd > 1e-12
    w = np.zeros(len(at))
    if live.any():
        idx, s = np.array(at)[live], sd[live]
        a = cov[np.ix_(idx, idx)] / np.outer(s, s) * g.n + alpha * np.eye(len(idx))
        w[live] = np.linalg.solve(a, cov[idx, y] / s * g.n) / s
    centre = mean + g.shift
    return dict(zip(features, w.tolist())), float(centre[y] - w @ centre[at])


def linear_scores(df: DataFrame, features: list[str], y: str, by: str, models: Mapping[str, list[tuple[tuple, Mapping[str, float], float]]], names: list[str], bands: tuple[float, float], centre: float) -> DataFrame:
    """(names..., n, mae, rmse, r2, within_1, within_2) of linear models: each value of `by` (as text) has a list of (labels, coefficients, intercept)
    that score its rows; sums of equal labels are added up over values. Every row is read once, whatever the number of models; a task emits a row of
    sums per value and model. Labels are taken about `centre`, which keeps their squares well scaled. r2 is null below two rows or for a
    constant label."""
    listed = [(value, k, m) for value, own in models.items() for k, m in enumerate(own)]
    weights = {v: np.array([[m[1].get(c, 0.0) for m in own] for c in features]).reshape(len(features), len(own)) for v, own in models.items()}
    free = {v: np.array([m[2] for m in own]) for v, own in models.items()}
    sums = ["n", "a", "s", "y", "yy", "w1", "w2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {v: np.zeros((len(sums), len(own))) for v, own in models.items()}
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            codes = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            label = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.column_stack([batch.column(i + 2).to_numpy(zero_copy_only=False) for i in range(len(features))])
            for code, v in enumerate(keys.dictionary.to_pylist()):
                if v not in total:
                    continue
                at = codes == code
                e = x[at] @ weights[v] + free[v] - label[at, None]
                t, size = label[at] - centre, np.abs(e)
                total[v] += [np.full(e.shape[1], len(e)), size.sum(axis=0), (e * e).sum(axis=0), np.full(e.shape[1], t.sum()), np.full(e.shape[1], t @ t), *((size <= b).sum(axis=0) for b in bands)]
        rows = [(v, k, *total[v][:, k]) for v, k, _ in listed if total[v][0, k]]
        yield pa.RecordBatch.from_pylist([dict(zip(["v", "k", *sums], r)) for r in rows], schema)

    schema = pa.schema([("v", pa.string()), ("k", pa.int64()), *((c, pa.float64()) for c in sums)])
    rows = df.select(F.col(by).cast("string"), F.col(y).cast("double"), *(F.col(c).cast("double") for c in features))
    rows = rows.mapInArrow(run, "v string, k long, " + ", ".join(f"{c} double" for c in sums))
    labels = df.sparkSession.createDataFrame([(v, k, *m[0]) for v, k, m in listed], ["v", "k", *names])  # a row per value and model
    rows = rows.join(F.broadcast(labels), ["v", "k"]).groupBy(*names).agg(*(F.sum(c).alias(c) for c in sums))
    spread = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    r2 = F.when((F.col("n") > 1) & (spread > 0), 1 - F.col("s") / spread)
    return rows.select(*names, F.col("n").cast("long").alias("n"), (F.col("a") / F.col("n")).alias("mae"), F.sqrt(F.col("s") / F.col("n")).alias("rmse"), r2.alias("r2"), (F.col("w1") / F.col("n")).alias("within_1"), (F.col("w2") / F.col("n")).alias("within_2"))


def linear(coefficients: Mapping[str, float], intercept: float) -> Column:
    """The prediction as a column expression."""
    out = F.lit(intercept)
    for c, w in coefficients.items():
        out = out + F.col(c).cast("double") * F.lit(w)
    return out


@dataclass(frozen=True)
class ModelSpec:
    """A named feature set and a function that makes an estimator from the vector column's and the label's name."""

    name: str
    features: tuple[str, ...]
    estimator: Callable[[str, str], Estimator | Trees]


def least_squares() -> Callable[[str, str], Estimator]:
    return lambda x, y: LinearRegression(featuresCol=x, labelCol=y, predictionCol="predicted", solver="normal")


def random_forest(trees: int = 100, depth: int = 8, seed: int = 42, least: int = 2) -> Callable[[str, str], Trees]:
    """The mean of trees over keyed Poisson draws of the rows, so that any engine repeats it."""
    return lambda x, y: Trees(trees, depth, boosting=False, least=least, seed=seed)


def gradient_boosting(iterations: int = 160, rate: float = 0.06, depth: int = 4, seed: int = 42, l2: float = 0.01, least: int = 20) -> Callable[[str, str], Trees]:
    """Boosted trees over histograms, with an l2 term in gains and leaves."""
    return lambda x, y: Trees(iterations, depth, boosting=True, rate=rate, l2=l2, least=least, seed=seed)


@dataclass(frozen=True)
class Prepared:
    """A fitted preprocessor: adds one sparse vector of all features."""

    encoding: Encoding
    out: str

    def transform(self, rows: DataFrame) -> DataFrame:
        return with_vector(rows, self.encoding, self.out)


@dataclass(frozen=True)
class Preprocessor:
    features: list[str]
    out: str

    def fit(self, train: DataFrame) -> Prepared:
        return Prepared(fit_encoding(train, self.features), self.out)


def preprocessor(train: DataFrame, features: list[str], out: str = "x") -> Preprocessor:
    """Missing numbers become their median, then all are standardised by mean and population deviation (constant ones become 0); texts one-hot by a
    dictionary that is a table, a missing one as a category of its own, unknown ones all zero. Everything is learned, exactly, from the rows given to
    `fit`, which are read several times; give them stored."""
    if missing := set(features) - set(train.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    return Preprocessor(features, out)


def evaluate_grid(df: DataFrame, specs: list[ModelSpec], y: str, keys: list[str], split: str = "split_name") -> DataFrame:
    """Long predictions (keys..., split, model_name, actual, predicted) of every spec, fitted on train. The frame is written once for the fits;
    metrics of all models are one grouped job over the union."""
    kinds, used = dict(df.dtypes), list(dict.fromkeys(c for s in specs for c in s.features))
    rows = stored(df.select(*keys, split, F.col(y).cast("double").alias("_y"), *(F.col(c) if kinds[c] == "string" else F.col(c).cast("double").alias(c) for c in used)))
    train = rows.filter(F.col(split) == "train")
    out = None
    for s in specs:
        estimator = s.estimator("x", "_y")
        if isinstance(estimator, Trees):
            ready, columns = tree_columns(train, rows, list(s.features))
            ready = stored(ready) if columns != list(s.features) else ready
            predicted = fit_trees(ready.filter(F.col(split) == "train"), columns, "_y", keys, estimator).predict(ready, [*keys, split, "_y"])
        else:
            prepared = preprocessor(train, list(s.features)).fit(train)
            predicted = estimator.fit(prepared.transform(train)).transform(prepared.transform(rows))
        one = predicted.select(*keys, split, F.lit(s.name).alias("model_name"), F.col("_y").alias("actual"), "predicted")
        out = one if out is None else out.unionByName(one)
    return out


def alpha_search(train: Gram, df: DataFrame, sets: Mapping[str, list[str]], alphas: list[float], y: str) -> DataFrame:
    """(feature_set, alpha, mae, best): every set and alpha solved from one Gram, scored on `df` (the validation rows) in one job; the lowest
    error wins, ties the lowest alpha."""
    from pyspark.sql import Window

    tries = [(s, a, linear(*ridge(train, f, a))) for s, f in sets.items() for a in alphas]
    scores = df.agg(*(F.avg(F.abs(p - F.col(y))).alias(f"t{i}") for i, (_, _, p) in enumerate(tries)))
    pairs = F.array(*(F.struct(F.lit(s).alias("feature_set"), F.lit(float(a)).alias("alpha"), F.col(f"t{i}").alias("mae")) for i, (s, a, _) in enumerate(tries)))
    rows = scores.select(F.inline(pairs))
    return rows.withColumn("best", F.row_number().over(Window.partitionBy("feature_set").orderBy("mae", "alpha")) == 1)


def predict_sets(df: DataFrame, gram: Gram, sets: Mapping[str, list[str]], alphas: Mapping[str, float], keys: list[str], y: str) -> DataFrame:
    """Long predictions (keys..., setting, actual, predicted) of refitted settings."""
    solved = F.array(*(F.struct(F.lit(s).alias("setting"), linear(*ridge(gram, f, alphas[s])).alias("predicted")) for s, f in sets.items()))
    return df.select(*keys, F.col(y).alias("actual"), F.explode(solved).alias("p")).select(*keys, "p.setting", "actual", "p.predicted")


def predict_by(df: DataFrame, grams: Mapping[str, Gram], by: str, sets: Mapping[str, list[str]], alpha: float, keys: list[str], y: str) -> DataFrame:
    """Long predictions (keys..., model_name, actual, predicted) of a ridge model per set and value of `by`, each fitted on its own sums. A set
    without features is the mean. Rows of other values have null predictions."""

    def predicted(features: list[str]) -> Column:
        out = F.lit(None).cast("double")
        for value, g in grams.items():
            out = F.when(F.col(by).cast("string") == value, linear(*ridge(g, features, alpha))).otherwise(out)
        return out

    solved = F.array(*(F.struct(F.lit(s).alias("model_name"), predicted(f).alias("predicted")) for s, f in sets.items()))
    return df.select(*keys, F.col(y).alias("actual"), F.explode(solved).alias("p")).select(*keys, "p.model_name", "actual", "p.predicted")
