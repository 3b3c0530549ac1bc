"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Small boosted trees are grown on a bounded sample of labelled rows; every path from a root to a node is a rule (a conjunction
of comparisons); an L1-penalised logistic regression over the rules leaves few with a weight; those become one Spark column
expression over the statistics, which are computed of whole texts.

Defined results: null text counts as empty, an empty text has statistics of zero and is scored like any other; equal texts
have equal scores; labels that are null are left out, a doc_id that is labelled or present several times counts each time;
without labelled rows, or with one label only, all scores are the share of label 1 (1 if there are no rows); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import slices

STATISTICS = ("log_bytes", "words", "word_length", "upper", "digits", "marks", "symbols", "other_bytes", "distinct_words", "top_word", "same_next", "same_third", "lines", "same_lines", "deflated", "capitalised", "marked_words")
#: Labelled rows that the model is fitted on, at most (those of least hash).
SAMPLE = 20_000
TREES, DEPTH, RATE, LEAST, BINS = 40, 3, 0.3, 20, 48
PENALTY, STEPS = 2e-3, 400
#: (index of the statistic, threshold, above it)
Condition = tuple[int, float, bool]
Rule = tuple[Condition, ...]

_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:?'\"-()")] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[b for b in range(33, 127) if not chr(b).isalnum() and not _MARKS[b]]] = True


def statistics(text: str) -> tuple[float, ...]:
    data = text.encode()
    n = len(data)
    words = text.split()
    if not words:
        return (float(np.log1p(n)), *[0.0] * (len(STATISTICS) - 1))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    m, often = len(words), Counter(words)
    lines = [x for x in text.split("\n") if x]
    first = [w[0] for w in words]
    return (
        float(np.log1p(n)),
        float(np.log1p(m)),
        len(text) / m,
        counts[65:91].sum() / letters,
        counts[48:58].sum() / n,
        counts[_MARKS].sum() / n,
        counts[_SYMBOLS].sum() / n,
        counts[128:].sum() / n,
        len(often) / m,
        max(often.values()) / m,
        sum(map(str.__eq__, words, words[1:])) / m,
        sum(map(str.__eq__, words, words[3:])) / m,
        len(lines) / m,
        1 - len(set(lines)) / max(1, len(lines)),
        len(zlib.compress(data, 1)) / n,
        sum(map(str.isupper, first)) / m,
        sum(not w[-1].isalnum() for w in words) / m,
    )


def with_statistics(rows: DataFrame, keep_text: bool = False) -> DataFrame:
    """``rows`` (its text column null: empty) with the statistics; the text goes unless it is to be kept."""
    kept = [c for c in rows.columns if c != "text" or keep_text]
    schema = StructType([*(f for f in rows.schema if f.name in kept), *(StructField(s, DoubleType()) for s in STATISTICS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([statistics(t or "") for t in batch.column("text").to_pylist()], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(v) for v in values.T)], [*kept, *STATISTICS])

    return rows.mapInArrow(run, schema)


def grow(binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> list[tuple[tuple[tuple[int, int, bool], ...], np.ndarray, float]]:
    """One tree of second-order boosting: (path, rows, value) of all nodes but the root; a condition is (statistic, bin, above)."""
    nodes, level = [], [((), np.arange(len(gradient)))]
    for depth in range(DEPTH):
        below = []
        for path, rows in level:
            if len(rows) < 2 * LEAST:
                continue
            g, h, best = gradient[rows], hessian[rows], (1e-6, -1, -1)
            total = g.sum() ** 2 / (h.sum() + 1)
            for s in range(binned.shape[1]):
                b = binned[rows, s]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, BINS))[:-1] for w in (g, h, np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - total
                gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = 0
                if gain.max() > best[0]:
                    best = gain.max(), s, int(gain.argmax())
            if best[1] < 0:
                continue
            above = binned[rows, best[1]] > best[2]
            for side in (False, True):
                part = rows[above == side]
                nodes.append(((*path, (best[1], best[2], side)), part, -gradient[part].sum() / (hessian[part].sum() + 1), depth))
                below.append(nodes[-1][:2])
        level = below
    last = {id(p) for p, _ in level}
    return [(p, r, v if id(p) in last or not any(q[: len(p)] == p and len(q) > len(p) for q, *_ in nodes) else 0.0) for p, r, v, _ in nodes]


def extract_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths of boosted trees, simplified and without repeats."""
    edges = [np.unique(np.quantile(x[:, s], np.linspace(0, 1, BINS + 1)[1:-1])) for s in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, s], "left") for s, e in enumerate(edges)], axis=1)  # bin <= b: value <= edges[b]
    score, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        for path, rows, value in grow(binned, p - y, p * (1 - p)):
            score[rows] += RATE * value
            tightest: dict[tuple[int, bool], float] = {}
            for s, b, above in path:
                at = float(edges[s][b])
                tightest[s, above] = (max if above else min)(at, tightest.get((s, above), at))
            rules[tuple(sorted((s, t, above) for (s, above), t in tightest.items()))] = None
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, s] > t) == above for s, t, above in rule])


def lasso(rules: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic regression over 0/1 columns, by accelerated proximal gradient steps."""
    mean, spread = rules.mean(axis=0), np.maximum(rules.std(axis=0), 1e-9)
    z = ((rules - mean) / spread).astype(np.float32)
    v = np.ones(z.shape[1], np.float32)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    rate = 4 * len(y) / float(np.linalg.norm(z @ v) ** 2 + len(y))
    w = u = np.zeros(z.shape[1])
    b = c = float(np.log(y.mean() / (1 - y.mean())))
    t = 1.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(z @ u.astype(np.float32) + c))) - y
        step = u - rate * (z.T @ error.astype(np.float32)) / len(y)
        new, new_b = np.sign(step) * np.maximum(np.abs(step) - rate * PENALTY, 0), c - rate * error.mean()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c, w, b, t = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b), new, new_b, new_t
    return w / spread, b - float((w / spread * mean).sum())


Model = tuple[list[tuple[Rule, float]], float]


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Weighted rules and the intercept."""
    if not len(y) or y.min() == y.max():
        return [], 40.0 if not len(y) or y.min() else -40.0
    rules = extract_rules(x, y)
    if not rules:
        return [], float(np.log(y.mean() / (1 - y.mean())))
    weights, intercept = lasso(np.stack([holds(r, x) for r in rules], axis=1).astype(np.float32), y)
    return [(r, float(w)) for r, w in zip(rules, weights, strict=True) if w], intercept


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``labels.quality``, learnt from at most ``sample`` rows that aren't held out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality IN (0, 1)").filter(~held_out(F.col("doc_id")))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = np.array([list(r) for r in with_statistics(texts).orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *STATISTICS).limit(sample).collect()], float).reshape(-1, 2 + len(STATISTICS))
    return fit(rows[:, 2:], rows[:, 1])


def compile_score(model: Model) -> Column:
    """The model as an expression over statistics columns."""
    rules, intercept = model
    terms = [F.when(reduce(Column.__and__, [F.col(STATISTICS[s]) > t if above else F.col(STATISTICS[s]) <= t for s, t, above in rule]), w).otherwise(0.0) for rule, w in rules]
    return F.lit(1.0) / (1.0 + F.exp(-reduce(Column.__add__, terms, F.lit(intercept))))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score and predicted."""
    score = compile_score(train(docs, labels, sample))
    rows = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("score", score)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are predicted to be of quality 1."""
    score = compile_score(train(docs, labels, sample))
    packed = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")
    good = with_statistics(packed, keep_text=True).filter(score >= 0.7)
    return good.select(*["text" if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
