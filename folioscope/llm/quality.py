"""Quality by a sparse ensemble of rules over statistics of a text.

1. Statistics of whole texts are Spark column expressions (``statistics``).
2. Small boosted trees are grown on a bounded sample of labelled rows; each path from a
   root to a node is a rule, a conjunction of intervals of statistics.
3. A lasso logistic regression weighs the rules and leaves most at zero. How hard it
   presses is chosen by cross-validation in which trees are grown anew for each fold.
4. The rules left are compiled into one column expression, so scoring is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Labelled rows of each class that rules are fitted on at most.
SAMPLE = 2000
TREES, DEPTH, RATE, BINS, LEAST_ROWS = 40, 3, 0.2, 24, 8
#: Fractions of the penalty at which all weights are zero, tried in turn; folds of the cross-validation.
PENALTIES, FOLDS = tuple(0.4 * 0.6**k for k in range(9)), 5


def statistics(text: Column) -> dict[str, Column]:
    """Named numbers of a whole text, none of them null; a text that is null, empty or blank has zeros."""
    t = F.coalesce(text, F.lit(""))
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")
    without = lambda mark: F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))
    chars, letters, words = F.length(t), F.col("_letters"), F.col("_words")
    n, lines = F.size(words), F.col("_lines")
    return {
        "_words": F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
        "_lines": F.split(t, "\n"),
        "_letters": chars - F.length(F.regexp_replace(t, r"\p{L}+", "")),
        "words": F.log1p(n.cast("double")),
        "word_length": share(letters, n),
        "longest_word": F.log1p(F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)).cast("double")),
        "marks": share(chars - letters - n, n),
        "capitals": share(chars - F.length(F.regexp_replace(t, r"\p{Lu}+", "")), letters),
        "stops": share(without("."), n),
        "commas": share(without(","), n),
        "distinct_words": share(F.size(F.array_distinct(words)), n),
        "repeated_words": share(F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))), n),
        "line_words": F.log1p(share(n, F.size(lines))),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "ended_lines": share(F.regexp_count(t, F.lit(r"[.?!](?=\n|$)")), F.size(lines)),
    }


#: The statistics that rules are about, in order.
NAMES = [
    "words", "word_length", "longest_word", "marks", "capitals", "stops", "commas", "distinct_words", "repeated_words", "line_words", "distinct_lines", "ended_lines",
]


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns of docs to keep, and a column s_NAME for each statistic of its text."""
    made = statistics(F.col("_text"))
    rows = docs.select(*[F.col(c) for c in keep], F.col("text").cast("string").alias("_text"))
    rows = rows.withColumns({k: c for k, c in made.items() if k.startswith("_")})
    return rows.select(*keep, *[made[k].alias(f"s_{k}") for k in NAMES])


@dataclass(frozen=True)
class Rule:
    """Intervals (statistic, above, up to) that must all hold, and the weight that the rule then adds."""

    parts: tuple[tuple[str, float, float], ...]
    weight: float = 0.0

    def __str__(self) -> str:
        tell = [f"{n} > {lo:.4g}" if hi == np.inf else f"{n} <= {hi:.4g}" if lo == -np.inf else f"{lo:.4g} < {n} <= {hi:.4g}" for n, lo, hi in self.parts]
        return f"{self.weight:+.3f} if {' and '.join(tell)}"


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    bias: float

    def column(self) -> Column:
        """The score of a row of ``with_statistics``, from 0 to 1."""
        z = F.lit(self.bias)
        for rule in self.rules:
            holds = F.lit(True)
            for name, lo, hi in rule.parts:
                if lo > -np.inf:
                    holds = holds & (F.col(f"s_{name}") > F.lit(lo))
                if hi < np.inf:
                    holds = holds & (F.col(f"s_{name}") <= F.lit(hi))
            z = z + F.when(holds, F.lit(rule.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same for rows of statistics in the order of ``NAMES``."""
        z = np.full(len(x), self.bias)
        for rule in self.rules:
            z += rule.weight * holds(rule.parts, x)
        return 1 / (1 + np.exp(-z))


def holds(parts: tuple[tuple[str, float, float], ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, lo, hi in parts:
        value = x[:, NAMES.index(name)]
        out &= (value > lo) & (value <= hi)
    return out


def even_weights(y: np.ndarray) -> np.ndarray:
    """Weights of mean 1 that make both classes count the same."""
    ones = y.mean()
    return np.where(y == 1, 0.5 / ones, 0.5 / (1 - ones))


def grow_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int) -> list[tuple[tuple[str, float, float], ...]]:
    """Paths of boosted trees, each grown on a random half of the rows, without repeats."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)  # x <= edges[k] means bin <= k
    z, found = np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        grad, hess = weight * (y - p), weight * p * (1 - p) + 1e-6
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        # nodes to split: rows of the half, all rows, and the interval of bins of each statistic
        open_nodes = [(rows, np.arange(len(y)), {})]
        for depth in range(DEPTH + 1):
            deeper = []
            for some, all_rows, box in open_nodes:
                if box:
                    key = tuple((NAMES[f], float(edges[f][lo]) if lo >= 0 else -np.inf, float(edges[f][hi]) if hi < len(edges[f]) else np.inf) for f, (lo, hi) in sorted(box.items()))
                    found.setdefault(key)
                best = _best_split(bins, grad, hess, some, edges) if depth < DEPTH and len(some) >= 2 * LEAST_ROWS else None
                if best is None:
                    if len(some):
                        z[all_rows] += RATE * grad[some].sum() / (hess[some].sum() + 1)
                    continue
                f, k = best
                lo, hi = box.get(f, (-1, len(edges[f])))
                for side, part in ((bins[:, f] <= k, (lo, k)), (bins[:, f] > k, (k, hi))):
                    deeper.append((some[side[some]], all_rows[side[all_rows]], {**box, f: part}))
            open_nodes = deeper
    return list(found)


def _best_split(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, edges: list[np.ndarray]) -> tuple[int, int] | None:
    g, h = grad[rows], hess[rows]
    whole, best, gain = g.sum() ** 2 / (h.sum() + 1), None, 1e-6
    for f, e in enumerate(edges):
        if not len(e):
            continue
        b = bins[rows, f]
        left_g, left_h, left_n = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g, h, np.ones(len(b))))
        ok = (left_n >= LEAST_ROWS) & (len(rows) - left_n >= LEAST_ROWS)
        if ok.any():
            value = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1) - whole
            k = int(np.argmax(np.where(ok, value, -1)))
            if value[k] > gain:
                gain, best = value[k], (f, k)
    return best


def lasso(r: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, start: tuple[np.ndarray, float]) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with penalty times the sum of sizes of weights.

    Steps run over the columns that may have a weight; a column left out that would get one joins, until there is none.
    """
    w, b = start[0].copy(), start[1]
    slope = lambda: r.T @ (weight * (1 / (1 + np.exp(-np.clip(r @ w + b, -40, 40))) - y)) / len(y)
    active = (w != 0) | (np.abs(slope()) > 0.9 * penalty)
    while True:
        w[active], b = _proximal_steps(r[:, active], y, weight, penalty, w[active], b)
        joins = ~active & (np.abs(slope()) > 1.001 * penalty)
        if not joins.any():
            return w, b
        active |= joins


def _proximal_steps(r: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal steps until they hardly move."""
    n = len(y)
    step = 4.0 / (weight.max() * (np.linalg.norm(r, 2) ** 2 / n + 1)) if r.shape[1] else 4.0 / weight.max()
    ahead_w, ahead_b, speed = w, b, 1.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(r @ ahead_w + ahead_b, -40, 40)))
        miss = weight * (p - y) / n
        moved = ahead_w - step * (r.T @ miss)
        new_w, new_b = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0), ahead_b - step * miss.sum()
        next_speed = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead_w, ahead_b = new_w + (speed - 1) / next_speed * (new_w - w), new_b + (speed - 1) / next_speed * (new_b - b)
        change = np.abs(new_w - w).max(initial=0) + abs(new_b - b)
        w, b, speed = new_w, new_b, next_speed
        if change < 1e-4:
            break
    return w, b


def _ensemble(x: np.ndarray, y: np.ndarray, seed: int, penalties: tuple[float, ...]) -> list[RuleModel]:
    """One model for each penalty, from weak to strong use of rules."""
    weight = even_weights(y)
    rules = grow_rules(x, y, weight, seed)
    kept, seen = [], set()
    for parts in rules:
        on = holds(parts, x)
        if LEAST_ROWS <= on.sum() <= len(y) - LEAST_ROWS and on.tobytes() not in seen and (~on).tobytes() not in seen:
            seen.add(on.tobytes())
            kept.append((parts, on))
    base = (np.zeros(len(kept)), 0.0)
    if not kept:
        return [RuleModel((), 0.0) for _ in penalties]
    on = np.stack([o for _, o in kept], 1).astype(float)
    scale = on.std(0)  # rare rules are not favoured
    r = (on - on.mean(0)) / scale
    highest = np.abs(r.T @ (weight * (y - 0.5))).max() / len(y)
    models = []
    for part in penalties:
        base = lasso(r, y, weight, part * highest, base)
        own = base[0] / scale
        pick = np.flatnonzero(own)
        models.append(RuleModel(tuple(Rule(kept[k][0], float(own[k])) for k in pick), float(base[1] - (own * on.mean(0)).sum())))
    return models


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 11) -> RuleModel:
    """A model of rows of statistics; classes count the same, whatever their numbers.

    One class alone, or fewer than two rows of a class, gives a model without rules that says
    the same of all: 0.95 or 0.05 for one class alone, 0.5 for no rows.
    """
    if not len(y) or min(y.sum(), len(y) - y.sum()) < 2:
        return RuleModel((), 0.0 if not len(y) else 2.94 if y.mean() > 0.5 else -2.94)
    rng = np.random.default_rng(seed)
    fold = np.zeros(len(y), int)
    for value in (0, 1):  # folds have as much of each class
        own = rng.permutation(np.flatnonzero(y == value))
        fold[own] = np.arange(len(own)) % FOLDS
    loss = []
    for k in range(min(FOLDS, int(min(y.sum(), len(y) - y.sum())))):
        rest, own = fold != k, fold == k
        if len(set(y[rest])) < 2:
            continue
        weight, of_fold = even_weights(y)[own], []
        for model in _ensemble(x[rest], y[rest], seed + k, PENALTIES):
            p = np.clip(model.score(x[own]), 1e-6, 1 - 1e-6)
            of_fold.append(-(weight * (y[own] * np.log(p) + (1 - y[own]) * np.log(1 - p))).mean())
        loss.append(of_fold)
    # the strongest penalty whose loss is within a standard error of the least
    mean, error = np.mean(loss, 0), np.std(loss, 0) / np.sqrt(len(loss))
    least = int(np.argmin(mean))
    best = int(np.argmax(mean <= mean[least] + error[least]))
    return _ensemble(x, y, seed, PENALTIES[: best + 1])[-1]


def held_out(id_col: str) -> Column:
    """Rows whose labels are not learned from: crc32 of the id is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 11) -> RuleModel:
    """A model from labelled rows that are not held out, at most ``sample`` of each class, in a seeded order of ids.

    A document with several labels is good only if all say so; labels other than 0 and 1 are
    left out. Of several rows of one doc_id the one with the least text counts. The driver
    gets the statistics of the sample alone: at most 2 x ``sample`` rows of 12 numbers.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.withColumn("draw", F.xxhash64("doc_id", F.lit(seed)))
    taken = None
    for value in (0, 1):
        some = known.where(F.col("quality") == value).orderBy("draw", "doc_id").limit(sample)
        taken = some if taken is None else taken.unionByName(some)
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").groupBy("doc_id", "draw").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    got = with_statistics(rows, "doc_id", "draw", "quality").toPandas().sort_values(["draw", "doc_id"])
    return fit_rules(got[[f"s_{n}" for n in NAMES]].to_numpy(float), got["quality"].to_numpy(int), seed)


def score_quality(docs: DataFrame, model: RuleModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score from 0 to 1 and predicted (1 if the score is the threshold or more) of every row.

    Only the text decides; null, empty and blank texts have the score of zeros. Repeated rows
    come back as often as they are there, rows without doc_id too. Other columns, whatever
    their names, are ignored; an empty table gives an empty one.
    """
    scored = with_statistics(docs, "doc_id").select("doc_id", model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
