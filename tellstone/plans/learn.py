"""Weights of signals learned from labelled observations."""
from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import ratio

#: Fewer players or positives than these are refused.
MIN_PLAYERS, MIN_POSITIVES = 60, 15


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    trained_on: dict[str, int] = field(default_factory=dict)
    metrics: dict[str, float] = field(default_factory=dict)

    def probability(self, signals: str | Column = "signals") -> Column:
        """0 to 100 for a map of signals; missing signals count as 0."""
        z = F.lit(self.bias)
        for name, w in sorted(self.weights.items()):
            z = z + F.lit(w) * value_of(signals, name)
        return F.bround(100 / (1 + F.exp(-z)), 1)

    def scoring_weights(self) -> dict[str, float]:
        """Positive weights that sum to one, to be used in the score."""
        kept = {k: v for k, v in self.weights.items() if v > 0}
        total = sum(kept.values())
        return {k: round(v / total, 4) for k, v in kept.items()} if total else {}

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)

    @staticmethod
    def load(path: str) -> Model:
        with open(path, encoding="utf-8") as f:
            return Model(**json.load(f))


def value_of(signals: str | Column, name: str) -> Column:
    column = F.col(signals) if isinstance(signals, str) else signals
    return F.coalesce(F.try_element_at(column, F.lit(name))["value"], F.lit(0.0))


def features(labelled: DataFrame, names: list[str], player: str = "steamid") -> DataFrame:
    """player, label and a column for each signal."""
    return labelled.select(F.col(player).alias("player"), "label", *[value_of("signals", n).alias(n) for n in names])


def _refuse(rows: DataFrame) -> tuple[int, int, int]:
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("player").alias("players"), F.countDistinct(F.when(F.col("label") == 1, F.col("player"))).alias("positives")).first()
    if got.players < MIN_PLAYERS or got.positives < MIN_POSITIVES:
        raise ValueError(f"{got.players} players and {got.positives} positives; at least {MIN_PLAYERS} and {MIN_POSITIVES} are needed")
    return got.n, got.players, got.positives


def train_exact(rows: DataFrame, names: list[str], epochs: int = 400, rate: float = 0.35, l2: float = 0.01) -> Model:
    """Class-weighted logistic regression by full-batch gradient steps.

    Each epoch is one aggregate over the rows, which stay where they are; only
    the gradient, a number for each signal, comes to the driver.
    """
    n, players, positives = _refuse(rows)
    ones = rows.agg(F.sum("label")).first()[0]
    heavy, light = n / (2 * ones), n / (2 * max(1, n - ones))
    w, b = np.zeros(len(names)), 0.0
    rows = rows.select("label", *names).cache()
    for _ in range(epochs):
        z = sum((F.col(k) * float(x) for k, x in zip(names, w, strict=True)), F.lit(float(b)))
        off = (1 / (1 + F.exp(-z)) - F.col("label")) * F.when(F.col("label") == 1, heavy).otherwise(light)
        g = rows.select(off.alias("off"), *names).agg(F.sum("off"), *[F.sum(F.col("off") * F.col(k)) for k in names]).first()
        w = w - rate / n * (np.array(g[1:], float) + l2 * w)
        b -= rate / n * g[0]
    rows.unpersist()
    return Model({k: float(x) for k, x in zip(names, w, strict=True)}, float(b), {"rows": n, "players": players, "positives": positives})


def train(rows: DataFrame, names: list[str], l2: float = 0.01) -> Model:
    """The same objective by the library's solver, for many rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n, players, positives = _refuse(rows)
    ones = rows.agg(F.sum("label")).first()[0]
    weighted = rows.withColumn("_w", F.when(F.col("label") == 1, n / (2 * ones)).otherwise(n / (2 * max(1, n - ones)))).withColumn("label", F.col("label").cast("double"))
    data = VectorAssembler(inputCols=names, outputCol="features").transform(weighted)
    fitted = LogisticRegression(weightCol="_w", regParam=l2 / n, standardization=False, maxIter=200).fit(data)
    return Model(dict(zip(names, map(float, fitted.coefficients.toArray()), strict=True)), float(fitted.intercept), {"rows": n, "players": players, "positives": positives})


def evaluate(scored: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Precision, recall and F1 by player, and the area under the curve by row, of rows (player, label, score)."""
    from .history import auc

    one = scored.groupBy("player").agg(F.max("score").alias("score"), F.max("label").alias("label"))
    hit, bad = F.col("score") >= threshold, F.col("label") == 1
    out = one.agg(F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn"), F.count_if(~hit & ~bad).alias("tn"))
    p, r = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    return out.select("*", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")).crossJoin(auc(scored, "score", "label").select("auc"))  # one row each


def train_held_out(rows: DataFrame, names: list[str], share: float = 0.3, seed: str = "13", threshold: float = 50.0, l2: float = 0.01) -> Model:
    """train() on the players of one side of a split; metrics are those of the players held out.

    rows has player, label and a column for each signal.  All rows of a player
    are on one side.  Too few players, on either side, are refused.
    """
    from .history import split_by

    n, players, positives = _refuse(rows)
    sides = split_by(rows, "player", share, seed)
    test = sides.filter("test")
    model = train(sides.filter("not test"), names, l2)
    signals = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.struct(F.col(c).cast("double").alias("value")) for c in names]))
    got = evaluate(test.select("player", "label", model.probability(signals).alias("score")), threshold).first()
    if not sum(got[k] for k in ("tp", "fp", "fn", "tn")):
        raise ValueError("no player is held out")
    model.metrics = {k: float(got[k]) for k in ("precision", "recall", "f1", "auc")}
    model.trained_on = {"rows": n, "players": players, "positives": positives, "trained": model.trained_on["rows"], "held_out": n - model.trained_on["rows"]}
    return model
