"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics are Spark expressions over the whole text. Shallow boosted trees on a
bounded sample of labelled rows propose rules (the conjunctions along their
paths), an L1 logistic fit keeps few of them, and those become one Spark column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import table, wrapped

#: Labelled rows that a fit looks at, at most (about; picked by a hash of doc_id).
FIT_ROWS = 20_000
THRESHOLD = 0.3


#: Anything that no statistic counts one by one: what is left of a text without it is short.
UNCOUNTED = r"[^\p{Lu}0-9#$%&*^~@=+<>{}\[\]\\/_!?|.,;:]+"


def pieces(text: Column) -> dict[str, Column]:
    """What a text's statistics are read from, in one pass each. A null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return {
        "chars": F.length(text), "tokens": F.split(text, r"[\x20\x09-\x0D]+"), "lines": F.split(text, "\n"),
        "marks": F.regexp_replace(text, F.lit(UNCOUNTED), F.lit("")),
    }


def statistics(parts: dict[str, Column]) -> dict[str, Column]:
    """Numbers about one text, none of them null, from its pieces."""
    tokens, lines, marks = parts["tokens"], parts["lines"], parts["marks"]
    count = lambda s: F.length(marks) - F.length(F.translate(marks, s, ""))
    return {
        "chars": parts["chars"], "words": F.size(tokens), "unique_words": F.size(F.array_distinct(tokens)),
        "lines": F.size(lines), "unique_lines": F.size(F.array_distinct(lines)),
        "upper": F.regexp_count(marks, F.lit(r"\p{Lu}")), "symbols": count("#$%&*^~@=+<>{}[]\\/_"), "bangs": count("!?"),
        "bars": count("|"), "digits": count("0123456789"), "stops": count("."), "commas": count(",;:"),
    }


def features(counts: dict[str, Column]) -> dict[str, Column]:
    """Ratios of the statistics; 0 where there is nothing to divide by."""
    c = counts
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")
    return {
        "chars": c["chars"].cast("double"), "words": c["words"].cast("double"), "word_length": over(c["chars"], c["words"]),
        "unique_words": over(c["unique_words"], c["words"]), "unique_lines": over(c["unique_lines"], c["lines"]),
        "line_words": over(c["words"], c["lines"]), "upper": over(c["upper"], c["words"]), "symbols": over(c["symbols"], c["words"]),
        "bangs": over(c["bangs"], c["words"]), "bars": over(c["bars"], c["words"]), "digits": over(c["digits"], c["chars"]),
        "stops": over(c["stops"], c["words"]), "commas": over(c["commas"], c["words"]),
    }


def _step(df: DataFrame, kept: list[str], prefix: str, made: dict[str, Column]) -> DataFrame:
    """Columns ``kept`` and the made ones, each of them computed once a row whatever reads it later."""
    new = F.inline(F.array(F.struct(*[c.alias(prefix + n) for n, c in made.items()])))
    return df.select(*[F.col(f"`{c}`") for c in kept], new)


def with_features(docs: DataFrame, prefix: str = "_f_") -> tuple[DataFrame, list[str]]:
    """Add the features in three steps, so that pieces and statistics are computed once a row.

    The steps are generated rows of one element, through which the optimizer can't
    push a later filter; else it would copy the statistics into each condition.
    """
    split = pieces(F.col("text"))
    counts = statistics({n: F.col(f"_p_{n}") for n in split})
    made = features({n: F.col(f"_s_{n}") for n in counts})
    wide = _step(docs, docs.columns, "_p_", split)
    wide = _step(wide, docs.columns, "_s_", counts)
    return _step(wide, docs.columns, prefix, made), list(made)


Rule = tuple[tuple[int, float, bool], ...]  # (feature, threshold, above)


def propose_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 32, rate: float = 0.3) -> list[Rule]:
    """Paths of gradient-boosted trees: one rule for every node below a root."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    score = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        todo: list[tuple[np.ndarray, Rule]] = [(np.arange(len(y)), ())]
        while todo:
            rows, path = todo.pop()
            split = _best_split(binned[rows], g[rows], h[rows], cuts) if len(path) < depth else None
            if path:
                found[tuple(sorted(path))] = None
            if split is None:
                score[rows] += rate * g[rows].sum() / (h[rows].sum() + 1.0)
                continue
            j, at = split
            above = binned[rows, j] > at
            todo.append((rows[above], (*path, (j, float(cuts[j][at]), True))))
            todo.append((rows[~above], (*path, (j, float(cuts[j][at]), False))))
    return list(found)


def _best_split(b: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], least: int = 5) -> tuple[int, int] | None:
    total_g, total_h, best, where = g.sum(), h.sum(), 1e-6, None
    for j, c in enumerate(cuts):
        n = len(c)
        if not n:
            continue
        lg, lh, ln = (np.cumsum(np.bincount(b[:, j], weights=v, minlength=n + 1))[:n] for v in (g, h, np.ones(len(g))))
        gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
        gain[(ln < least) | (len(g) - ln < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best:
            best, where = gain[k], (j, k)
    return where


def rule_matrix(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for j, cut, above in rule:
            out[:, k] *= x[:, j] > cut if above else x[:, j] <= cut
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Proximal gradient descent with momentum; the intercept bears no penalty."""
    n = len(y)
    a = np.hstack([np.ones((n, 1)), r])
    v = np.ones(a.shape[1])
    for _ in range(20):  # largest eigenvalue, for the step length
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(v @ (a.T @ (a @ v)))
    w = np.zeros(a.shape[1])
    w[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    z, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
        new = z + step * (a.T @ (y - p)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return float(w[0]), w[1:]


@dataclass
class RuleModel:
    names: list[str]
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self, prefix: str = "_f_") -> Column:
        """The ensemble as one Spark column over the feature columns."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            met = F.lit(True)
            for j, cut, above in rule:
                x = F.col(prefix + self.names[j])
                met = met & ((x > F.lit(cut)) if above else (x <= F.lit(cut)))
            total = total + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    """Rows that a fit must not see: crc32 of the id's text divisible by five, or no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 == 0


def fit_rules(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, penalty: float = 0.0005) -> RuleModel:
    """Fit on at most about ``rows`` labelled documents of (doc_id, text).

    Labels are (doc_id, quality); null ones and held-out ids are left out. Without
    labels, or with one class only, the model has no rules and scores the share of
    that class (one half without any).
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = usable.count()
    part = min(1.0, rows / max(1, n))
    unit = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    picked = usable.where(unit < part).select(F.col("doc_id").alias("_id"), "quality")
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))  # about FIT_ROWS rows at most
    wide, names = with_features(joined.select("text", "quality"))
    sample = wide.select("quality", *[f"_f_{n}" for n in names]).toPandas()
    sample = sample.sort_values(list(sample.columns), kind="stable")  # sums then come out alike on each run
    x, y = sample.drop(columns="quality").to_numpy(dtype=float), (sample["quality"].to_numpy() > 0).astype(float)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return RuleModel(names, [], [], float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    rules = propose_rules(x, y)
    intercept, w = lasso_logistic(rule_matrix(x, rules), y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(names, [rules[k] for k in kept], [float(w[k]) for k in kept], intercept)


def score_documents(docs: DataFrame, model: RuleModel) -> DataFrame:
    """Add ``score`` to rows with a ``text``; a narrow plan without a shuffle.

    A null or empty text is scored as the statistics of an empty text. Every row
    keeps its own columns, repeated rows included; no rows give no rows.
    """
    wide, _ = with_features(docs)
    return wide.select(*[F.col(f"`{c}`") for c in docs.columns], model.score().alias("score"))


def keep_good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that a model fitted on ``labels`` scores at ``threshold`` or more; same columns."""
    model = fit_rules(docs, labels)
    return score_documents(wrapped(docs, "text"), model).where(F.col("score") >= threshold).select("row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_rules(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
