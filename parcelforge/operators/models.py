"""Per-neighbourhood ridge models by normal equations, latest-model lookup and the model's adjustment.

The sums of the normal equations are plain aggregates (partial sums before the shuffle), so
a neighbourhood of any size is one small row; only that row's linear system, a dozen
unknowns, is solved in a pandas function.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a neighbourhood needs, the penalty, and the pull and cap of the adjustment.
LEAST_ROWS, ALPHA = 150, 1.0
PULL, LEAST_CAP, CAP_SHARE = 0.15, 10_000.0, 0.05


def design(rows: DataFrame, numeric: list[str], categories: dict[str, list[str]], group: str) -> DataFrame:
    """(group, x array, y): numbers with the group's median for gaps, then one column for each listed category value."""
    medians = rows.groupBy(group).agg(*[F.percentile(c, F.lit(0.5)).alias(f"_m_{c}") for c in numeric])
    joined = rows.join(medians, group)
    numbers = [F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"), F.lit(0.0)) for c in numeric]
    flags = [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c, values in categories.items() for v in values]
    return joined.withColumn("x", F.array(*numbers, *flags))


def fit_ridge(rows: DataFrame, group: str, target: str, width: int, alpha: float = ALPHA, least: int = LEAST_ROWS) -> DataFrame:
    """(group, n, intercept, coefficients, r2, mae_train_mean): ridge with an unpenalised intercept, from (x, target)."""
    y = F.col(target).cast("double")
    at = lambda i: F.col("x")[i]
    sums = [F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")]
    sums += [F.sum(at(i)).alias(f"s{i}") for i in range(width)] + [F.sum(at(i) * y).alias(f"sy{i}") for i in range(width)]
    sums += [F.sum(at(i) * at(j)).alias(f"s{i}_{j}") for i in range(width) for j in range(i, width)]
    totals = rows.filter(F.col(target).isNotNull()).groupBy(group).agg(*sums).filter(F.col("n") >= least)
    packed = totals.select(group, "n", "sy", "syy", F.array(*[f"s{i}" for i in range(width)]).alias("sx"), F.array(*[f"sy{i}" for i in range(width)]).alias("sxy"), F.array(*[f"s{i}_{j}" for i in range(width) for j in range(i, width)]).alias("sxx"))

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                n, mean_x, mean_y = row.n, np.array(row.sx) / row.n, row.sy / row.n
                full = np.zeros((width, width))
                full[np.triu_indices(width)] = row.sxx
                full = full + full.T - np.diag(np.diag(full))
                centred = full - n * np.outer(mean_x, mean_x)
                cross = np.array(row.sxy) - n * mean_x * mean_y
                beta = np.linalg.solve(centred + alpha * np.eye(width), cross)
                total = row.syy - n * mean_y**2
                left = total - 2 * beta @ cross + beta @ centred @ beta
                out.append((getattr(row, group), n, mean_y - float(beta @ mean_x), beta.tolist(), 1 - left / total if total > 0 else 0.0))
            yield pd.DataFrame(out, columns=[group, "n", "intercept", "coefficients", "r2"])

    return packed.mapInPandas(solve, f"{group} string, n long, intercept double, coefficients array<double>, r2 double")


def predict(rows: DataFrame, models: DataFrame, group: str) -> DataFrame:
    """Rows with the prediction of their group's model; null without a model."""
    joined = rows.join(models.select(group, "intercept", "coefficients"), group, "left")
    dot = F.aggregate(F.zip_with("x", "coefficients", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return joined.withColumn("prediction", F.when(F.col("coefficients").isNotNull(), F.col("intercept") + dot)).drop("intercept", "coefficients")


def latest_models(models: DataFrame, group: str, kind: str, at: str) -> DataFrame:
    """The newest model of each group (in any case) and kind."""
    others = [c for c in models.columns if c not in (group, kind)]
    return models.groupBy(F.lower(F.trim(group)).alias(group), kind).agg(F.max_by(F.struct(*others), F.col(at)).alias("m")).select(group, kind, "m.*")


def model_adjustment(base: Column, *predictions: Column) -> Column:
    """A share of what the mean prediction lies off the baseline, capped; nothing without a prediction."""
    known = [p.isNotNull().cast("int") for p in predictions]
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in predictions])
    count = reduce(lambda a, b: a + b, known)
    cap = F.greatest(F.lit(LEAST_CAP), base * CAP_SHARE)
    return F.when(count > 0, F.greatest(-cap, F.least(cap, PULL * (total / count - base)))).otherwise(0.0)
