"""Low-quality and toxic documents: a trained classifier and hierarchical empirical Bayes over hosts and paths."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import identity, joined, packed, stored

#: Labelled rows that the classifier is fitted on, at most.
LABELLED = 10_000
#: Rows whose inputs are held at once while a model is fitted.
ROWS = 1000
#: Letters of a beginning.
STEM = 4
WORD = re.compile(r"[^\W\d_]+")
PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
_class = np.zeros((256, 7 + len(PUNCTUATION)))
for _b in range(256):
    _c = chr(_b)
    _class[_b, 0] = 65 <= _b <= 90
    _class[_b, 1] = 97 <= _b <= 122
    _class[_b, 2] = 48 <= _b <= 57
    _class[_b, 3] = _b >= 128
    _class[_b, 4] = _b == 32
    _class[_b, 5] = _b == 10
    _class[_b, 6] = _b < 32 and _b != 10
for _k, _b in enumerate(PUNCTUATION):
    _class[_b, 7 + _k] = 1
CLASSES = _class
MARK = CLASSES[:, 7:].any(axis=1)
#: Numbers in the shape of a text.
SHAPES = 9 + len(PUNCTUATION)


def shape(text: str, words: list[str]) -> np.ndarray:
    """Rates of kinds of characters and of repeats, whatever the words are."""
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(data, minlength=256) @ CLASSES
    upper, lower, marks = counts[0], counts[1], counts[7:].sum()
    again = int(np.count_nonzero((data[1:] == data[:-1]) & MARK[data[1:]]))
    n = max(1, len(words))
    repeated = sum(map(str.__eq__, words[1:], words[:-1]))
    own = [upper / max(1, upper + lower), marks / n, again / n, repeated / n, len(set(words)) / n, np.log1p(len(words)) / 5, sum(map(len, words)) / n / 10, counts[2] / n, counts[5] / n]
    return np.concatenate([own, np.log1p(20 * counts[7:] / n)])


def marks_of(words: set[str]) -> set[str]:
    """The words and, with a star, the beginnings of longer ones."""
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


@dataclass
class Model:
    """Two logistic models, of low quality and of toxicity, on shapes and lexicon marks."""

    middle: np.ndarray = field(default_factory=lambda: np.zeros(SHAPES))
    spread: np.ndarray = field(default_factory=lambda: np.ones(SHAPES))
    lexicons: list[list[str]] = field(default_factory=lambda: [[], []])
    weights: list[np.ndarray] = field(default_factory=list)
    rates: list[float] = field(default_factory=lambda: [0.0, 0.0])

    def inputs(self, shapes: np.ndarray, marks: list[set[str]], which: int) -> np.ndarray:
        lexicon = self.lexicons[which]
        index = {w: i for i, w in enumerate(lexicon)}
        out = np.zeros((len(shapes), 1 + SHAPES + len(lexicon)))
        out[:, 0] = 1
        out[:, 1 : 1 + SHAPES] = np.clip((shapes - self.middle) / self.spread, -8, 8)
        for r, found in enumerate(marks):
            for w in found & index.keys():
                out[r, 1 + SHAPES + index[w]] = 1
        return out

    def fitted(self, shapes: np.ndarray, marks: list[set[str]], which: int, y: np.ndarray) -> np.ndarray:
        """Weights of one of the models; inputs are made again for each step, as a lexicon has any number of marks."""

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for k in range(0, len(y), ROWS):
                yield self.inputs(shapes[k : k + ROWS], marks[k : k + ROWS], which), y[k : k + ROWS]

        return logistic(parts, 1 + SHAPES + len(self.lexicons[which]))

    def scores(self, shapes: np.ndarray, marks: list[set[str]]) -> np.ndarray:
        """Probabilities of low quality and of toxicity, a row for each text."""
        if not self.weights:
            return np.tile(self.rates, (len(shapes), 1))
        return np.stack([_sigmoid(self.inputs(shapes, marks, k) @ self.weights[k]) for k in (0, 1)], 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(parts: Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]], width: int, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method over parts (x, y); the constant isn't shrunk."""
    w, shrink = np.zeros(width), np.full(width, ridge)
    shrink[0] = 1e-6
    for _ in range(steps):
        gradient, curve = shrink * w, np.diag(shrink)
        for x, y in parts():
            p = _sigmoid(x @ w)
            gradient += x.T @ (p - y)
            curve += (x.T * (p * (1 - p))) @ x
        step = np.linalg.solve(curve, gradient)
        w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[set[str]]]]:
    """Batches with shapes and marks of the texts in their last column."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            shapes, marks = [], []
            for value in part.column(part.num_columns - 1):
                text = value.as_py()
                words = WORD.findall(text.lower())
                shapes.append(shape(text, words))
                marks.append(marks_of(set(words)))
            yield part, np.array(shapes).reshape(-1, SHAPES), marks


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", limit: int = LABELLED) -> Model:
    """The model of labels (doc_id, quality 1 or 0, toxic 0 or 1) for docs.

    Fitted on at most limit labelled documents, those with the least hashes of
    their ids.  Labels that repeat a doc_id count once, as the worse; rows
    without an id or without both labels aren't used.  With no label of a kind
    the model gives that kind its rate.
    """
    chosen = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    chosen = chosen.agg((F.min("quality") < 1).cast("int").alias("low"), (F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = stored(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))  # the bound of the sample
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = whole.join(F.broadcast(chosen), "doc_id").select("low", "toxic", F.xxhash64("_text").alias("h"), "_text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, shapes, marks in _features(batches):
            arrays = [part.column(0), part.column(1), part.column(2), pa.array(shapes.tolist(), pa.list_(pa.float64())), pa.array([sorted(m) for m in marks], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["low", "toxic", "h", "shape", "marks"])

    sample = stored(rows.mapInArrow(extract, "low int, toxic int, h long, shape array<double>, marks array<string>").dropDuplicates(["h", "low", "toxic"]))
    model, kinds = Model(), ("low", "toxic")
    totals = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in kinds]).first()
    if not totals.n:
        return model
    model.rates = [totals[k] / totals.n for k in kinds]
    if not any(0 < totals[k] < totals.n for k in kinds):
        return model
    counted = stored(sample.select(*kinds, F.explode("marks").alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in kinds]).filter("n >= 3"))
    for which, kind in enumerate(kinds):
        positive, negative = totals[kind], totals.n - totals[kind]
        if not positive or not negative:
            continue
        rate = F.col("n") / F.lit(totals.n)
        z = (F.col(kind) / F.lit(positive) - (F.col("n") - F.col(kind)) / F.lit(negative)) / F.sqrt(rate * (1 - rate + 1e-9) * F.lit(1 / positive + 1 / negative))
        best = counted.select("mark", z.alias("z")).filter("z > 4").orderBy(F.desc("z"), "mark")  # marks of a bounded sample
        model.lexicons[which] = [r.mark for r in best.collect()]
    wanted = {w for lexicon in model.lexicons for w in lexicon}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([[m for m in found if m in wanted] for found in batch.column(3).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), marks], ["low", "toxic", "shape", "marks"])

    used = sample.select(*kinds, "shape", "marks").mapInArrow(pick, "low int, toxic int, shape array<double>, marks array<string>").collect()
    shapes = np.array([r["shape"] for r in used])
    model.middle, model.spread = shapes.mean(axis=0), shapes.std(axis=0) + 0.05
    marks = [set(r.marks) for r in used]
    model.weights = [model.fitted(shapes, marks, k, np.array([r[kind] for r in used], float)) for k, kind in enumerate(kinds)]
    return model


def evidence(docs: DataFrame, model: Model, host: Column, path: Column, text: str = "text") -> DataFrame:
    """doc_id, text_hash, host, path, p_low and p_toxic of each row of docs."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole).alias("text_hash"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), whole.alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, shapes, marks in _features(batches):
            p = model.scores(shapes, marks)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(p[:, 0]), pa.array(p[:, 1])], ["doc_id", "text_hash", "host", "path", "p_low", "p_toxic"])

    return rows.mapInArrow(score, "doc_id long, text_hash long, host string, path string, p_low double, p_toxic double")


def _strength(groups: DataFrame, around: Column) -> Column:
    """Rows that a prior rate is worth, from how much the groups' rates differ beyond chance."""
    rate = F.col("bad") / F.col("n")
    within = around * (1 - around)
    spread = F.sum(F.col("n") * (F.pow(rate - around, 2))) / F.sum("n") - F.sum(within) / F.sum("n")
    mean = F.sum(F.col("n") * within) / F.sum("n")
    return F.least(F.lit(1e6), F.greatest(F.lit(1.0), mean / F.greatest(spread, F.lit(1e-9)) - 1))


def posteriors(found: DataFrame) -> DataFrame:
    """found (host, path, p_low, p_toxic, ...) with host_rate, path_rate, posterior and kept.

    A row's bad probability is that of low quality or toxicity.  The rate of a
    host is shrunk to the global one, that of a path (within a host) to its
    host's, each as strongly as groups of the level resemble one another, and
    each without the row itself, so that its evidence counts once.  The
    posterior of a row moves its own odds by the ratio of the path's prior odds
    to the global ones.  Rows are kept below one half.
    """
    bad = 1 - (1 - F.col("p_low")) * (1 - F.col("p_toxic"))
    found = found.withColumn("p_bad", bad)
    paths = stored(found.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p_bad").alias("bad")))
    hosts = stored(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = min(1 - 1e-6, max(1e-6, total.bad / total.n)) if total.n else 0.5
    strength = hosts.agg(_strength(hosts, F.lit(rate)).alias("k")).first().k or 1.0
    hosts = hosts.withColumnsRenamed({"n": "host_n", "bad": "host_bad"}).withColumn("around", (F.col("host_bad") + strength * rate) / (F.col("host_n") + strength))
    paths = stored(joined(paths, hosts, ["host"], "inner", F.col("path")))
    within = paths.agg(_strength(paths, F.col("around")).alias("k")).first().k or 1.0
    out = joined(found, paths, ["host", "path"], "inner", F.struct("doc_id", "text_hash"))
    # A row's own evidence stays out of the rates that judge it.
    host_rate = (F.col("host_bad") - F.col("p_bad") + strength * rate) / (F.col("host_n") - 1 + strength)
    out = out.withColumn("host_rate", host_rate)
    out = out.withColumn("path_rate", (F.col("bad") - F.col("p_bad") + within * F.col("host_rate")) / (F.col("n") - 1 + within))
    odds = lambda p: F.log(p / (1 - p))
    safe = lambda c: F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col(c)))
    z = odds(safe("p_bad")) + odds(safe("path_rate")) - float(np.log(rate / (1 - rate)))
    return out.withColumn("posterior", 1 / (1 + F.exp(-z))).withColumn("kept", F.col("posterior") < 0.5)


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text: str = "text", limit: int = LABELLED) -> DataFrame:
    """doc_id, p_low, p_toxic, host_rate, path_rate, posterior and kept of each row of docs.

    Null texts count as empty, null hosts and paths as ones without a name;
    repeated rows are scored alike.  Other columns are not used.
    """
    found = stored(evidence(docs, fit(docs, labels, text, limit), host, path, text))
    return posteriors(found).select("doc_id", "p_low", "p_toxic", "host_rate", "path_rate", "posterior", "kept")


def keep(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text: str = "text", limit: int = LABELLED) -> DataFrame:
    """docs without the rows that classify() doesn't keep; all columns kept, whatever their names are."""
    found = posteriors(stored(evidence(docs, fit(docs, labels, text, limit), host, path, text)))
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keys = ["id", "text_hash", "host", "path"]
    gone = found.filter(~F.col("kept")).withColumn("id", name(F.col("doc_id"))).select(*keys).distinct()
    rows = packed(docs, **identity(text) | {"id": name(F.col("doc_id").cast("long")), "host": name(host), "path": name(path)})
    return joined(rows, gone, keys, "left_anti").select("row.*")
