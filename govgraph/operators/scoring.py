"""Scoring of predictions against gold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0 where undefined."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, ratio(2 * p * r, p + r)


def counts(gold: DataFrame, found: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn of two sets of rows, by group: one full join."""
    by = by or []
    met = gold.select(*by, *keys).distinct().withColumn("__g", F.lit(1)).join(found.select(*by, *keys).distinct().withColumn("__f", F.lit(1)), [*by, *keys], "full")
    return met.groupBy(*by).agg(F.count_if(F.col("__g").isNotNull() & F.col("__f").isNotNull()).alias("tp"), F.count_if(F.col("__g").isNull()).alias("fp"), F.count_if(F.col("__f").isNull()).alias("fn"))


def greedy_match(pairs: DataFrame, group: str, least: float) -> DataFrame:
    """One-to-one matches within a group, by falling score, then by the pair; order matters, so a group is one task.

    pairs: group, pred, gold, score of the candidates only; groups are documents.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows.score >= least].sort_values(["score", "pred", "gold"], ascending=[False, True, True])
        used_p, used_g, keep = set(), set(), []
        for r in rows.itertuples(index=False):
            if r.pred not in used_p and r.gold not in used_g:
                used_p.add(r.pred)
                used_g.add(r.gold)
                keep.append(r)
        return pd.DataFrame(keep, columns=rows.columns)

    return pairs.groupBy(group).applyInPandas(run, pairs.schema)


def greedy_match_classes(members: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """What ``greedy_match`` makes of all pairs of different keys, from pairs of classes; a group is one task.

    members: group, key, cls; pairs: group, x, y, score of classes, in both directions and with themselves.  Both sides of a
    match are keys of the members.  At a score each free key, in order, takes the smallest free one of the classes it fits.
    """
    kind = {f.name: f.dataType.simpleString() for f in members.schema}

    def run(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["key", "cls"])
        golds = {c: k.tolist() for c, k in own.groupby("cls")["key"]}
        classes = own.groupby("key", sort=False)["cls"].agg(list)
        used_p, used_g, out = set(), set(), []

        def smallest(c, at: dict, but):
            """The first free key of a class that is not ``but``; what is used never comes again."""
            keys, i = golds[c], at.get(c, 0)
            while i < len(keys) and keys[i] in used_g:
                i += 1
            at[c] = i
            while i < len(keys) and (keys[i] == but or keys[i] in used_g):
                i += 1
            return keys[i] if i < len(keys) else None

        at: dict = {}
        for score, level in sorted(near.groupby("score"), key=lambda g: -g[0]):
            fits = level.groupby("x")["y"].agg(list).to_dict()
            for p, mine in classes.items():
                if p in used_p:
                    continue
                asked = {y for c in mine for y in fits.get(c, ())}
                found = [g for y in asked if (g := smallest(y, at, p)) is not None]
                if found:
                    used_p.add(p)
                    used_g.add(min(found))
                    out.append((own[group].iloc[0], p, min(found), score))
        return pd.DataFrame(out, columns=[group, "pred", "gold", "score"])

    met = members.select(group, "key", "cls").distinct().groupBy(group).cogroup(pairs.select(F.col(group).alias("near_to"), "x", "y", "score").groupBy("near_to"))
    return met.applyInPandas(run, f"{group} {kind[group]}, pred {kind['key']}, gold {kind['key']}, score double")


def thresholds(scored: DataFrame, grid: list[float]) -> DataFrame:
    """threshold, tp, fp, fn of label (0/1) against score >= threshold: one pass over a histogram of the rows."""
    steps = F.array(*[F.lit(t) for t in grid])
    above = scored.select("label", F.size(F.filter(steps, lambda t: F.col("score") >= t)).alias("passed")).groupBy("label", "passed").agg(F.count("*").alias("n"))
    each = above.select("label", "passed", "n", F.posexplode(steps).alias("i", "threshold"))
    hit = F.col("passed") > F.col("i")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return each.groupBy("threshold").agg(count(hit & (F.col("label") == 1)).alias("tp"), count(hit & (F.col("label") == 0)).alias("fp"), count(~hit & (F.col("label") == 1)).alias("fn"))


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided binomial p-value; ties are dropped before."""

    def run(w: pd.Series, v: pd.Series) -> pd.Series:
        from math import comb

        def p(a: int, b: int) -> float:
            n = a + b
            return 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(min(a, b) + 1)) / 2**n)

        return pd.Series([p(int(a), int(b)) for a, b in zip(w, v, strict=True)])

    return F.pandas_udf(run, "double")(wins, losses)


def bootstrap(values: DataFrame, draws: int = 2000, seed: int = 7) -> DataFrame:
    """low, high: 95 % interval of the mean of ``value`` over Poisson resamples, one pass over the rows.

    Each row takes part in every draw with a weight drawn by hash; only sums for each draw are shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        total, weight = np.zeros(draws), np.zeros(draws)
        for rows in batches:
            for key, value in zip(rows["key"], rows["value"], strict=True):
                w = np.random.default_rng([seed, int(key) & 0xFFFFFFFF]).poisson(1.0, draws)
                total += w * value
                weight += w
        yield pd.DataFrame({"draw": np.arange(draws), "total": total, "weight": weight})

    sums = values.select("key", "value").mapInPandas(run, "draw int, total double, weight double").groupBy("draw").agg((F.sum("total") / F.sum("weight")).alias("mean"))
    return sums.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))


def kendall_tau(a: Column, b: Column) -> Column:
    """Tau-b of two rank arrays of one length, mapped to 0 .. 1."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        import numpy as np

        def tau(p, q) -> float:
            p, q = np.asarray(p, float), np.asarray(q, float)
            if len(p) < 2:
                return 1.0
            i, j = np.triu_indices(len(p), 1)
            dp, dq = np.sign(p[i] - p[j]), np.sign(q[i] - q[j])
            size = np.sqrt((dp != 0).sum() * (dq != 0).sum())
            return float(((dp * dq).sum() / size + 1) / 2) if size else 0.5

        return pd.Series([tau(p, q) for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(run, "double")(a, b)
