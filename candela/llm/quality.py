"""A quality classifier as a sparse ensemble of rules.

Statistics of each text are Spark columns. Boosted trees over them, fitted to labelled rows, give rules: the
conditions on the path to each node. A logistic model with an L1 penalty weighs the rules, most with zero; the rest
are compiled to Spark column expressions, so scoring is a plain projection.

The fit takes at most `most` labelled texts, those with the smallest hashes of their ids and texts; scoring covers all rows.

Cases: null text counts as empty, all its statistics are 0; very long texts are read whole, in time linear in their
length; with no labelled rows the score is 0.5, with one label only its smoothed share; rows of one id are scored each,
and repeated rows are learned from once; an empty table gives an empty result; extra columns are ignored, or kept where
asked for; a kept column that is named like a result gets `_in` at its end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The most labelled rows that a fit takes.
MOST_LABELLED = 20_000


def statistics(text: str = "text") -> dict[str, Column]:
    """Statistics of a text by name. Shares are of the characters, words or lines."""
    t = common.text_of(text)
    n = F.length(t).cast("double")
    without = lambda pattern: n - F.length(F.regexp_replace(t, pattern, ""))
    words, lines = F.split(t, r"\s+"), F.split(t, "\n")
    share = lambda x, of: F.coalesce(x / F.nullif(of, F.lit(0.0)), F.lit(0.0))
    size = lambda x: F.size(x).cast("double")
    return {
        "chars": n,
        "upper": share(without(r"\p{Lu}++"), n),
        "digits": share(without("[0-9]++"), n),
        "symbols": share(without(r"[#$%&*|<>{}\[\]=\\^~@_/]++"), n),
        "marks": share(without("[!?]++"), n),
        "stops": share(without("[.,;:]++"), n),
        "spaces": share(without(r"\s++"), n),
        "word_length": share(n, size(words)),
        "words_differ": share(size(F.array_distinct(words)), size(words)),
        "lines_differ": share(size(F.array_distinct(lines)), size(lines)),
        "line_length": share(n, size(lines)),
    }


class Tree:
    """A regression tree on binned features: nodes as (feature, threshold, left, right, value)."""

    def __init__(self, depth: int, least: int):
        self.depth, self.least, self.nodes = depth, least, []

    def fit(self, bins: np.ndarray, edges: list[np.ndarray], target: np.ndarray, rows: np.ndarray, depth: int = 0) -> int:
        at = len(self.nodes)
        self.nodes.append([None, None, None, None, float(target[rows].mean()) if len(rows) else 0.0])
        if depth == self.depth or len(rows) < 2 * self.least:
            return at
        best = (1e-9, None, None)
        total, n = target[rows].sum(), len(rows)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            counts = np.bincount(bins[rows, f], minlength=len(e) + 1)[:-1].cumsum()
            sums = np.bincount(bins[rows, f], weights=target[rows], minlength=len(e) + 1)[:-1].cumsum()
            ok = (counts >= self.least) & (n - counts >= self.least)
            gain = np.where(ok, sums**2 / np.maximum(counts, 1) + (total - sums) ** 2 / np.maximum(n - counts, 1) - total**2 / n, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        if best[1] is None:
            return at
        f, k = best[1:]
        low = bins[rows, f] <= k
        left = self.fit(bins, edges, target, rows[low], depth + 1)
        right = self.fit(bins, edges, target, rows[~low], depth + 1)
        self.nodes[at][:4] = [f, float(edges[f][k]), left, right]
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            f, cut, left, right, value = self.nodes[at]
            if f is None:
                out[rows] = value
            else:
                low = x[rows, f] <= cut
                todo += [(left, rows[low]), (right, rows[~low])]
        return out

    def rules(self) -> list[tuple]:
        """The path to each node but the root, as conditions (feature, above?, threshold)."""
        out, todo = [], [(0, ())]
        while todo:
            at, path = todo.pop()
            if path:
                out.append(path)
            f, cut, left, right, _ = self.nodes[at]
            if f is not None:
                todo += [(left, (*path, (f, False, cut))), (right, (*path, (f, True, cut)))]
        return out


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > cut) if above else (x[:, f] <= cut) for f, above, cut in rule])


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights, by accelerated proximal gradient steps."""
    n = len(y)
    step = 4 * n / max(np.linalg.norm(x, 2) ** 2 + n, 1e-9)
    w, b = np.zeros(x.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30))) - y
        new = v - step * (x.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        shift = c - step * error.mean()
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / s * (new - w), shift + (t - 1) / s * (shift - b)
        w, b, t = new, shift, s
    return b, w


class RuleEnsemble:
    """Weighted rules over named statistics."""

    def __init__(self, names: list[str], intercept: float, rules: list[tuple[tuple, float]]):
        self.names, self.intercept, self.rules = names, intercept, rules

    @classmethod
    def fit(cls, names: list[str], x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, penalty: float = 1e-3) -> RuleEnsemble:
        if not len(y):
            return cls(names, 0.0, [])
        prior = (y.sum() + 0.5) / (len(y) + 1)
        if y.min() == y.max():
            return cls(names, float(np.log(prior / (1 - prior))), [])
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(x.shape[1])]
        edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
        bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        margin, found = np.full(len(y), np.log(prior / (1 - prior))), {}
        for _ in range(trees):
            tree = Tree(depth, max(5, len(y) // 500))
            tree.fit(bins, edges, y - 1 / (1 + np.exp(-margin)), np.arange(len(y)))
            margin += rate * 4 * tree.predict(x)
            found.update(dict.fromkeys(tree.rules()))
        rules = list(found)
        if not rules:
            return cls(names, float(np.log(prior / (1 - prior))), [])
        design = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float64)
        mean, scale = design.mean(axis=0), np.maximum(design.std(axis=0), 0.02)
        b, w = lasso_logistic((design - mean) / scale, y.astype(float), penalty)
        w = w / scale
        return cls(names, float(b - mean @ w), [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6])

    def column(self) -> Column:
        """The score as an expression over the statistics' columns."""
        margin = F.lit(self.intercept)
        for rule, weight in self.rules:
            whole = None
            for f, above, cut in rule:
                one = F.col(self.names[f]) > cut if above else F.col(self.names[f]) <= cut
                whole = one if whole is None else whole & one
            margin = margin + F.when(whole, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.intercept + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-margin))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, most: int = MOST_LABELLED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, text and __label of `most` different labelled texts at most: those with the smallest hashes of their ids, then of their texts."""
    keys = ("__id", "__tie", "__label")
    marks = labels.select(F.col(doc_id).alias("__id"), F.col(label).alias("__label")).where(F.col("__id").isNotNull() & F.col("__label").isNotNull()).distinct()
    # labels without a document take no place in the sample
    marks = marks.join(documents.select(F.col(doc_id).alias("__id")), "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id", "__label").limit(most)
    own = documents.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.xxhash64(common.text_of(text)).alias("__tie"))
    rows = own.join(F.broadcast(marks), "__id")
    # ids may repeat, so the bound is set once more, on keys alone
    chosen = rows.select(*keys).distinct().orderBy(F.xxhash64("__id"), *keys).limit(most)
    kept = rows.join(F.broadcast(chosen), list(keys), "left_semi")
    parts = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return kept.repartition(parts, *keys).dropDuplicates(list(keys)).select(F.col("__id").alias(doc_id), F.col("__text").alias(text), "__label")


def fit_rules(documents: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", most: int = MOST_LABELLED) -> RuleEnsemble:
    stats = statistics(text)
    rows = labelled_sample(documents, labels, label, most, text=text).select(*[c.alias(k) for k, c in stats.items()], F.col("__label").alias("y")).toPandas()
    return RuleEnsemble.fit(list(stats), rows[list(stats)].to_numpy(dtype=float).reshape(-1, len(stats)), rows["y"].to_numpy(dtype=float))


def score_quality(df: DataFrame, model: RuleEnsemble, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    own = [f"__k{i}" for i in range(len(keep))]
    given = common.numbered(df).select(*[F.col(common.place(df, n)).alias(k) for n, k in zip(keep, own, strict=True)], *[c.alias(k) for k, c in statistics(common.place(df, text)).items()])
    scored = given.withColumn("__score", model.column()).select(*own, "__score", (F.col("__score") >= threshold).cast("int"))
    return scored.toDF(*[n + "_in" if n.lower() in ("score", "predicted") else n for n in keep], "score", "predicted")


def op9_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = common.crc_mod("doc_id", 5) == 0
    model = fit_rules(documents, labels.where(~held_out))
    return score_quality(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
