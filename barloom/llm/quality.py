"""Op 4: quality scores by a sparse rule ensemble.

Statistics of a text (shares of character classes, word lengths, repetition and
so on) are columns. Shallow trees on random subsets of a bounded sample of
labelled rows give conjunctive rules, one for each path from a root; a lasso
logistic regression keeps few of them, and these are compiled into one Spark
column expression over the statistics.

No label of a held-out row is read; language, source and id are never inputs.
Defined results: null and empty texts have all statistics zero and are scored
from those; without labelled rows of both kinds there are no rules and every
score is the smoothed share of label 1; repeated rows get equal scores; an empty
table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import shingles
from barloom.llm.common import held_out, read_table
from barloom.llm.labelled import bounded_sample, labelled_texts, training_labels

#: Labelled rows that rules and weights are fitted on, at most.
TRAIN_ROWS = 20_000
TREES, DEPTH, LEAF, BINS = 32, 3, 12, 32
LASSO = 0.002
THRESHOLD = 0.3

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "symbol", "bang", "pipe", "stop", "comma", "space", "line",
    "non_ascii", "repeated", "distinct", "top_word", "one_byte_words",
)


def _classes() -> np.ndarray:
    """Class of every byte: 0 other, then upper, digit, symbol, bang, pipe, stop, comma, space, line, non-ASCII."""
    out = np.zeros(256, np.uint8)
    out[65:91] = 1
    out[48:58] = 2
    out[[ord(c) for c in "#$%&*+/<=>@\\^_`{}~[]"]] = 3
    out[[ord(c) for c in "!?"]] = 4
    out[ord("|")] = 5
    out[ord(".")] = 6
    out[[ord(c) for c in ",;:"]] = 7
    out[[32, 9]] = 8
    out[[10, 13]] = 9
    out[128:] = 10
    return out


CLASSES = _classes()


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for every text of an Arrow column."""
    data, offsets = shingles.text_bytes(column)
    starts, stops, first = shingles.words(data, offsets)
    n, size, count = len(column), np.diff(offsets).astype(float), np.diff(first).astype(float)
    which = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(which * 11 + CLASSES[data], minlength=11 * n).reshape(n, 11)
    row = np.repeat(np.arange(n), np.diff(first))
    hashes = shingles.word_hashes(data, starts, stops)
    per = lambda values: np.bincount(row, weights=values, minlength=n)
    lengths = (stops - starts).astype(float)
    again = np.zeros(len(hashes))
    if len(hashes) > 1:
        again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    fresh = np.ones(len(h), bool)
    if len(h) > 1:
        fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(fresh)
    runs = np.diff(np.append(at, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, r[at], runs)
    distinct = np.bincount(r[at], minlength=n)
    by_size, by_count = np.maximum(size, 1), np.maximum(count, 1)
    shares = {c: kinds[:, k] / by_size for k, c in enumerate(("", "upper", "digit", "symbol", "bang", "pipe", "stop", "comma", "space", "line", "non_ascii"))}
    columns = {
        **shares, "log_bytes": np.log1p(size), "log_words": np.log1p(count), "mean_word": per(lengths) / by_count, "repeated": per(again) / by_count,
        "distinct": distinct / by_count, "top_word": top / by_count, "one_byte_words": per(lengths == 1) / by_count,
    }
    return np.stack([columns[s] for s in STATISTICS], axis=1) if n else np.zeros((0, len(STATISTICS)))


def add_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and one column `s_<name>` for each statistic of the whole text."""

    def run(batches):
        for batch in shingles.small_batches(batches):
            values = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(c) for c in values.T)], names=names)

    names = [*keep, *(f"s_{s}" for s in STATISTICS)]
    src = docs.select(*keep, "text")
    schema = ", ".join([*(f"{k} {src.schema[k].dataType.simpleString()}" for k in keep), *(f"s_{s} double" for s in STATISTICS)])
    return src.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """All of (statistic index, is greater than, bound); weight is added to the log-odds where they hold."""

    parts: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, bound in self.parts:
            out &= (x[:, k] > bound) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, above, bound in self.parts:
            c = F.col(f"s_{STATISTICS[k]}")
            out = out & (c > F.lit(bound) if above else c <= F.lit(bound))
        return out


def _grow(x: np.ndarray, residual: np.ndarray, edges: list[np.ndarray], rng, depth: int, parts: tuple, rules: list) -> None:
    """A regression tree on residuals over quantile bins; every path below the root becomes a rule."""
    if parts:
        rules.append(parts)
    if depth == 0 or len(x) < 2 * LEAF:
        return
    best = (1e-9, -1, 0.0)
    total, n = residual.sum(), len(residual)
    for k in rng.choice(x.shape[1], size=max(1, x.shape[1] // 2), replace=False):
        if not len(edges[k]):
            continue
        bins = np.searchsorted(edges[k], x[:, k], side="left")
        sums = np.cumsum(np.bincount(bins, weights=residual, minlength=len(edges[k]) + 1))[:-1]
        counts = np.cumsum(np.bincount(bins, minlength=len(edges[k]) + 1))[:-1]
        fits = (counts >= LEAF) & (n - counts >= LEAF)
        if fits.any():
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fits, sums**2 / counts + (total - sums) ** 2 / (n - counts) - total**2 / n, -1)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (float(gain[at]), int(k), float(edges[k][at]))
    _, k, bound = best
    if k < 0:
        return
    above = x[:, k] > bound
    for side in (False, True):
        _grow(x[above == side], residual[above == side], edges, rng, depth - 1, (*parts, (k, side, bound)), rules)


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """Rules of TREES boosted trees, each on a random half of the rows."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    score, seen = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), {}
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-score))
        half = rng.random(len(y)) < 0.5
        found: list = []
        _grow(x[half], residual[half], edges, rng, DEPTH, (), found)
        leaves = [p for p in found if not any(len(q) > len(p) and q[: len(p)] == p for q in found)]
        for p in found:
            seen.setdefault(tuple(sorted(p)), Rule(p))
        for p in leaves:
            held = Rule(p).holds(x)
            inside = held & half
            if inside.any():
                chance = 1 / (1 + np.exp(-score[inside]))
                score[held] += np.clip(0.3 * residual[inside].sum() / max(1e-3, (chance * (1 - chance)).sum()), -1, 1)
    return list(seen.values())


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = 400) -> tuple[np.ndarray, float]:
    """Sparse weights and a free bias by accelerated proximal gradient steps."""
    n = max(1, len(y))
    share = np.clip((y.sum() + 1) / (len(y) + 2), 1e-3, 1 - 1e-3)
    w, b = np.zeros(z.shape[1]), float(np.log(share / (1 - share)))
    if not z.size:
        return w, b
    probe = np.ones(z.shape[1] + 1)
    for _ in range(30):
        mapped = z @ probe[:-1] + probe[-1]
        probe = np.append(z.T @ mapped, mapped.sum())
        norm = np.linalg.norm(probe)
        probe /= norm
    rate = 4 * n / norm
    vw, vb, momentum = w.copy(), b, 1.0
    for _ in range(steps):
        error = (1 / (1 + np.exp(-np.clip(z @ vw + vb, -30, 30))) - y) / n
        step = vw - rate * (z.T @ error)
        new_w = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new_b = vb - rate * error.sum()
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        vw, vb = new_w + (momentum - 1) / after * (new_w - w), new_b + (momentum - 1) / after * (new_b - b)
        w, b, momentum = new_w, new_b, after
    return w, float(b)


def fit_rules(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[Rule], float]:
    """Weighted rules and the bias."""
    chosen = bounded_sample(training_labels(docs, labels, "quality"), train_rows)
    sample = add_statistics(labelled_texts(docs, chosen), ("target", "doc_id")).toPandas().sort_values("doc_id")
    x, y = sample[[f"s_{s}" for s in STATISTICS]].to_numpy(float), sample["target"].to_numpy(float)
    rules = tree_rules(x, y) if 0 < y.sum() < len(y) else []
    held = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    weights, bias = lasso_logistic(held, y)
    return [Rule(r.parts, float(w)) for r, w in zip(rules, weights) if w], bias


def compile_score(rules: list[Rule], bias: float) -> Column:
    """The ensemble as one expression over the statistics."""
    total = F.lit(bias)
    for r in rules:
        total = total + F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rules, bias = fit_rules(docs, labels)
    stats = add_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), compile_score(rules, bias).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
