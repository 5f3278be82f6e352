"""Quality scores learnt from preferences between documents (Bradley-Terry).

Every labelled document yields counts of its whole text. A good document is preferred to a bad one; the score is the
linear function whose differences explain the preferences best under logistic loss. All pairs of all learnable rows
count: rows are summed by class and narrow bin of their score, and pairs of bins stand for the pairs within. A quantile
of the learning rows' scores becomes the threshold, and the reported score is the logistic of the distance to it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import agreed_labels, held_out, keep_rows, learnable, map_rows
from ebbtide.session import release, stage

PENALTY = 1e-3
QUANTILES = 400
BINS = 32  # per unit of score, of the sums that stand for pairs
FAR = 32 * BINS  # bins from zero on which all pairs with the other class are settled
SQUARES = 4 * FAR  # from this bin on: rows of the sum of squares
STEPS = 60
FLAT = 1e-5  # a gradient of the mean loss below it is next to zero
FINE = 1 << 16  # bins of the scores that the threshold is read from

# Character classes whose share of the text counts.
CLASSES = {
    "symbol": b"#*$%&<>", "bar": b"|", "bang": b"!", "stop": b".,;:?", "digit": b"0123456789",
    "upper": bytes(range(65, 91)), "newline": b"\n", "bracket": b"()[]{}=_/\\@~^",
}
SHARES = ["repeat_next", "repeat_word", "repeat_line", "upper_word", "short_line"]
FEATURES = [*CLASSES, *SHARES, "word_length", "log_words"]

_LOOKUP = np.zeros((len(CLASSES), 256))
for _i, _members in enumerate(CLASSES.values()):
    _LOOKUP[_i, list(_members)] = 1.0


def text_features(text: str | None) -> list[float]:
    """Numbers of the whole text, in the order of FEATURES; all 0 for NULL, empty or blank texts."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    classes = _LOOKUP @ np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    lines = [line for line in data.split(b"\n") if line.strip()]
    shares = [
        sum(a == b for a, b in pairwise(words)) / n,
        1 - len(set(words)) / n,
        1 - len(set(lines)) / len(lines),
        sum(map(bytes.isupper, words)) / n,
        sum(len(line) < 20 for line in lines) / len(lines),
    ]
    length = sum(map(len, words)) / n
    return [*np.log1p(50.0 * classes), *np.log1p(50.0 * np.array(shares)), np.log(length), np.log1p(n)]


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stage table (id, x) of every document's numbers."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(slices):
        for rows in slices:
            yield {"id": rows["id"], "x": [text_features(t) for t in rows["text"]]}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stage(map_rows(rows, run, f"id {kind}, x array<double>"), "features")


@dataclass(frozen=True)
class Ranking:
    """score = weights . (x - mean) / scale, reported as 1 / (1 + exp(threshold - score))."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: str = "x") -> Column:
        steps = self.weights / self.scale
        shift = float(steps @ self.mean) + self.threshold
        total = sum((F.get(x, F.lit(i)) * float(w) for i, w in enumerate(steps)), F.lit(0.0))
        return 1.0 / (1.0 + F.exp(F.lit(shift) - total))


def _sums(z: np.ndarray, weights: np.ndarray):
    """(bin, n, x): rows by bin of their score with the sums of their numbers, then the rows of the sum of squares."""
    at = np.clip(np.rint(z @ weights * BINS), -FAR, FAR).astype(np.int64)
    found, place, n = np.unique(at, return_inverse=True, return_counts=True)
    x = np.zeros((len(found), z.shape[1]))
    np.add.at(x, place, z)
    width = z.shape[1]
    return (np.concatenate([found, SQUARES + np.arange(width)]), np.concatenate([n, np.zeros(width, np.int64)]),
            np.concatenate([x, z.T @ z]))


def _pair_loss(sums: dict[int, tuple], weights: np.ndarray, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean logistic loss over all pairs of a good and a bad row, its gradient and its curvature.

    Rows of a bin count with the bin's mean; what they differ from it enters the curvature as the class's mean spread.
    """
    parts = {}
    for label, (at, n, x) in sums.items():
        binned = at < SQUARES
        squares = x[~binned][np.argsort(at[~binned])]
        n, x = n[binned].astype(float), x[binned]
        mean = x / n[:, None]
        parts[label] = n, mean, (squares - mean.T @ x) / n.sum()
    (n, good, wide), (m, bad, broad) = parts[1], parts[0]
    pairs = n.sum() * m.sum()
    gap = np.subtract.outer(good @ weights, bad @ weights)
    many = np.multiply.outer(n, m) / pairs
    wrong = 1 / (1 + np.exp(np.clip(gap, -500, 500)))
    pull, bend = many * wrong, many * wrong * (1 - wrong)
    gradient = penalty * weights - (pull.sum(1) @ good - pull.sum(0) @ bad)
    cross = good.T @ bend @ bad
    curve = (good.T * bend.sum(1)) @ good + (bad.T * bend.sum(0)) @ bad - cross - cross.T
    curve += bend.sum() * (wide + broad) + penalty * np.eye(len(weights))
    loss = float((many * np.logaddexp(0.0, -gap)).sum() + penalty / 2 * weights @ weights)
    return loss, gradient, curve


def _fit_weights(sums: Callable[[np.ndarray], dict[int, tuple]], width: int, penalty: float) -> np.ndarray:
    """Newton steps from zero until the gradient is next to zero, halved as long as they raise the loss; ``sums`` passes
    over all rows."""
    weights = np.zeros(width)
    loss, gradient, curve = _pair_loss(sums(weights), weights, penalty)
    step = np.linalg.solve(curve, gradient)
    for _ in range(STEPS):
        if np.abs(gradient).max() < FLAT or np.abs(step).max() < FLAT:
            break
        found = _pair_loss(sums(weights - step), weights - step, penalty)
        if found[0] > loss + 1e-12:
            step = step / 2
            continue
        weights, (loss, gradient, curve) = weights - step, found
        step = np.linalg.solve(curve, gradient)
    return weights


def _scale(x):
    return np.where(x < 1e-9, 1.0, x)


def fit_ranking(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> Ranking:
    """The ranking of all preferences between rows at hand; ``learn`` is the same over a table.

    With one class only, all weights are 0 and the score is 0.5 everywhere.
    """
    width = x.shape[1] if x.size else len(FEATURES)
    if not (y == 1).any() or not (y == 0).any():
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = x.mean(0), _scale(x.std(0))
    z = (x - mean) / scale
    weights = _fit_weights(lambda w: {k: _sums(z[y == k], w) for k in (0, 1)}, width, penalty)
    scores = z @ weights
    low, high = float(scores.min()), float(scores.max())
    at = _fine(scores, low, high)
    counts = np.stack([np.bincount(at[y == k], minlength=FINE) for k in (0, 1)])
    return Ranking(mean, scale, weights, quantile_threshold(counts, low, high))


def _fine(scores: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip((scores - low) / ((high - low) or 1.0) * FINE, 0, FINE - 1).astype(np.int64)


def quantile_threshold(counts: np.ndarray, low: float, high: float, quantiles: int = QUANTILES) -> float:
    """The score quantile that tells the classes apart best (mean recall of both); the middle of the best ones.

    ``counts`` are of bad and good rows by bin between the lowest and the highest score; cuts are between bins.
    """
    bad, good = np.concatenate([np.zeros((2, 1)), counts.cumsum(1)], axis=1)
    upto = bad + good
    at = np.searchsorted(upto, np.linspace(0, 1, quantiles + 1) * upto[-1])
    # between two quantiles lies a gap of scores: its middle is tried as well
    cuts = np.unique(np.concatenate([at, (at[1:] + at[:-1]) // 2]))
    balance = 1 - good[cuts] / good[-1] + bad[cuts] / bad[-1]
    best = cuts[balance >= balance.max() - 1e-12]
    return float(low + (best[0] + best[-1]) / 2 / FINE * (high - low))


def learn(features: DataFrame, labels: DataFrame, label: str = "quality", learn_from: Column | None = None) -> Ranking:
    """Fit on all labelled rows of a feature table.

    A pass over them for means and spreads, one per step of the fit and two for the threshold; a task sends a row per
    bin of scores that it meets, at most about 2,000 of a class, and 65,536 for the threshold.
    """
    known = agreed_labels(labels, label).where(learnable() if learn_from is None else learn_from)
    rows = stage(features.join(known, features["id"] == known["doc_id"]).select("label", "x"), "learnable")
    width = len(FEATURES)
    numbers = [F.get("x", F.lit(i)) for i in range(width)]
    first = rows.agg(
        F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0), *map(F.avg, numbers), *map(F.stddev_pop, numbers)).first()
    if not first[0] or not first[1]:
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = np.array(first[2 : 2 + width]), _scale(np.array(first[2 + width :]))

    def standard(batch):
        y = batch.column(0).to_numpy()
        return y, (batch.column(1).flatten().to_numpy().reshape(len(y), width) - mean) / scale

    def sums(weights):
        def add(batches):
            held: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                y, z = standard(batch)
                for k in (0, 1):
                    for at, n, x in zip(*_sums(z[y == k], weights)):
                        row = np.concatenate([[float(n)], x])
                        held[k, int(at)] = held[k, int(at)] + row if (k, int(at)) in held else row
            if held:
                keys = np.array(list(held), np.int32)
                listed = [pa.array(v, pa.list_(pa.float64())) for v in [[r.tolist() for r in held.values()]]]
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), *listed], names=["label", "bin", "x"])

        parts = rows.mapInArrow(add, "label int, bin int, x array<double>").groupBy("label", "bin")
        found = parts.agg(F.array(*[F.sum(F.get("x", F.lit(i))) for i in range(width + 1)]).alias("x")).collect()
        out = {}
        for k in (0, 1):
            mine = sorted((r["bin"], r["x"]) for r in found if r["label"] == k)
            x = np.array([v for _, v in mine])
            out[k] = np.array([at for at, _ in mine]), x[:, 0], x[:, 1:]
        return out

    weights = _fit_weights(sums, width, PENALTY)

    def ends(batches):
        for batch in batches:
            if batch.num_rows:
                s = standard(batch)[1] @ weights
                yield pa.RecordBatch.from_arrays([pa.array([s.min()]), pa.array([s.max()])], names=["lo", "hi"])

    low, high = rows.mapInArrow(ends, "lo double, hi double").agg(F.min("lo"), F.max("hi")).first()

    def count(batches):
        held = np.zeros((2, FINE), np.int64)
        for batch in batches:
            y, z = standard(batch)
            np.add.at(held, (y, _fine(z @ weights, low, high)), 1)
        y, at = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(at, pa.int32()), pa.array(held[y, at])], names=["label", "bin", "n"])

    counts = np.zeros((2, FINE), np.int64)
    found = rows.mapInArrow(count, "label int, bin int, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).toPandas()
    counts[found["label"], found["bin"]] = found["n"]
    release(rows)
    return Ranking(mean, scale, weights, quantile_threshold(counts, low, high))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    Texts and labels are the only inputs. NULL, empty and blank texts are scored as all-zero numbers. A NULL id is
    scored, not held out and never learnt from. Repeated rows are scored each; several labels of a document are put
    to the vote. Without labels of both classes every score is 0.5. Other columns are not read.
    """
    features = feature_table(docs, id_col, text_col)
    model = learn(features, labels, label)
    scored = features.select("id", held_out("id").alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose score is at least 0.5, learnt as in ``score_quality`` (which defines odd cases)."""
    features = feature_table(docs, id_col, text_col)
    model = learn(features, labels, label)
    steps = model.weights / model.scale
    shift = float(steps @ model.mean) + model.threshold

    def wanted(texts):
        return (np.array([text_features(t) for t in texts]) @ steps >= shift).tolist()

    return keep_rows(docs, text_col, wanted)
