"""Binary classifiers on features, and thresholds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.evaluation import best_f1_threshold


@dataclass
class Logistic:
    features: list[str]
    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray  # the bias last

    def probability(self) -> Column:
        z = F.lit(float(self.weights[-1]))
        for name, m, s, w in zip(self.features, self.means, self.scales, self.weights, strict=False):
            z = z + (F.coalesce(F.col(name).cast("double"), F.lit(0.0)) - float(m)) / float(s) * float(w)
        return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def fit_logistic(rows: DataFrame, features: list[str], label: str, penalty: float = 1e-3, steps: int = 25) -> Logistic:
    """L2-penalised logistic regression by Newton steps over standardised features, the bias free.

    A step is one aggregation of the gradient and of the upper half of the Hessian, as many
    sums as features squared; only these come to the driver.  A constant label gives a
    constant probability.
    """
    names = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    first = rows.agg(*[g(n).alias(f"{k}{i}") for i, n in enumerate(names) for k, g in (("m", F.avg), ("s", F.stddev_pop))], F.avg(F.col(label).cast("double")).alias("y"), F.count("*").alias("n")).first()
    means = np.array([first[f"m{i}"] or 0.0 for i in range(len(names))])
    scales = np.array([first[f"s{i}"] or 0.0 for i in range(len(names))])
    scales[scales < 1e-12] = 1.0
    model = Logistic(features, means, scales, np.zeros(len(features) + 1))
    share = min(max(first["y"] or 0.0, 1e-6), 1 - 1e-6)
    model.weights[-1] = np.log(share / (1 - share))
    if not first["n"] or first["y"] in (0.0, 1.0):
        return model
    # a constant feature keeps the weight 0 and takes no part in the sums
    used = [i for i in range(len(names)) if (first[f"s{i}"] or 0.0) >= 1e-12]
    x = [(names[i] - float(means[i])) / float(scales[i]) for i in used] + [F.lit(1.0)]
    free = [*used, len(names)]
    y = F.col(label).cast("double")
    for _ in range(steps):
        p = model.probability()
        with_p = rows.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], (y - p).alias("r"), (p * (1 - p)).alias("w"))
        d = len(x)
        sums = with_p.agg(*[F.avg(F.col("r") * F.col(f"x{i}")).alias(f"g{i}") for i in range(d)], *[F.avg(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(d) for j in range(i, d)]).first()
        ridge = np.append(np.full(d - 1, penalty), 1e-12)
        gradient = np.array([sums[f"g{i}"] for i in range(d)]) - ridge * model.weights[free]
        hessian = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) + np.diag(ridge)
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        model.weights[free] += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return model


@dataclass
class Confidence:
    """Three classifiers with their thresholds: of an error where there are suggestions and where there are none, and of the first suggestion being right."""

    offered: Logistic
    alone: Logistic
    right: Logistic
    thresholds: tuple[float, float, float]

    def judged(self, rows: DataFrame, suggestions: str = "n_suggestions") -> DataFrame:
        """``rows`` with spell_probability, spell_threshold, correct_probability and correct_threshold."""
        some = F.col(suggestions) > 0
        spell = F.when(some, self.offered.probability()).otherwise(self.alone.probability())
        limit = F.when(some, F.lit(self.thresholds[0])).otherwise(F.lit(self.thresholds[1]))
        return rows.withColumns({"spell_probability": spell, "spell_threshold": limit, "correct_probability": self.right.probability(), "correct_threshold": F.lit(self.thresholds[2])})


def fit_confidence(rows: DataFrame, features: list[str], suggestions: str = "n_suggestions", held: Column | None = None, steps: int = 25) -> Confidence:
    """Classifiers of ``misspelled`` with and without suggestions, and of ``top_right`` among those that the first takes for errors.

    Thresholds are those of the best F1 on the rows where ``held`` holds (all rows without
    it).  Where a part has no rows, what stands for it is fitted to all rows of the part
    above it: rows without suggestions fall back to all rows, flagged rows to all with suggestions.
    """
    part = lambda df, wanted: df.filter(wanted) if held is not None else df
    train, dev = part(rows, ~held if held is not None else None), part(rows, held)

    def some(df: DataFrame, wanted: Column, otherwise: DataFrame) -> DataFrame:
        found = df.filter(wanted)
        return otherwise if found.isEmpty() else found

    def threshold(model: Logistic, judged: DataFrame, label: str) -> float:
        best = best_f1_threshold(judged.select(model.probability().alias("score"), (F.col(label) == 1).alias("label"))).first()
        return 0.5 if best is None else float(best["threshold"])

    offers = F.col(suggestions) > 0
    parts = {name: (some(train, wanted, train), some(dev, wanted, dev)) for name, wanted in (("offered", offers), ("alone", ~offers))}
    offered, alone = (fit_logistic(t, features, "misspelled", steps=steps) for t, _ in parts.values())
    first, second = (threshold(m, d, "misspelled") for m, (_, d) in zip((offered, alone), parts.values(), strict=True))
    flagged = offered.probability() >= first
    chosen, chosen_dev = (some(df, flagged, df) for df in parts["offered"])
    right = fit_logistic(chosen, features, "top_right", steps=steps)
    return Confidence(offered, alone, right, (first, second, threshold(right, chosen_dev, "top_right")))
