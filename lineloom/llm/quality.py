"""Quality classifier: Bradley-Terry scores learned from preference pairs.

A labelled good document is preferred to a labelled bad one. With document scores linear in features, the chance that one is preferred is the logistic of
the score difference, so the weights come from logistic loss on feature differences. All pairs of a good and a bad labelled row count: the sum over the
partners of a row depends on its score alone, and is read off the scores of all rows on a fine grid, each row shared by the two grid points around it. Newton steps
go until they change nothing; each takes two passes over the features of all labelled rows, which lie in a table and are never collected. Documents are then judged
by the quantile of their score: the quarter of the labelled rows that is held back from the pairs tells which quantile of the scores parts good from
bad, and the score at that quantile of all labelled rows is the cut. The published score is the logistic of the distance to it, with the cut at a fixed value.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.llm.common import crc32_of_id, scratch, stored

_SIGNS = re.compile(r"[^\w\s]")
_RUNS = re.compile(r"([^\w\s])\1")
NAMES = ("signs", "sign_runs", "upper", "digits", "bars", "repeated_words", "repeated_lines", "top_word", "next_same", "word_length", "short_lines", "ends", "few_words", "capital_words", "alpha_words")


def features(text: str | None) -> list[float]:
    """Shares between 0 and 1 that describe the form of a text."""
    t = text or ""
    words = t.split()
    if not words:
        return [0.0] * 12 + [1.0, 0.0, 0.0]
    n, chars = len(words), max(len(t), 1)
    counts = Counter(words)
    lines = [x for x in t.split("\n") if x.strip()]
    flat = t.lower()
    upper = sum(map(str.isupper, words))
    signs = len(_SIGNS.findall(t))
    return [
        min(1.0, 4 * signs / chars),
        min(1.0, len(_RUNS.findall(t)) / n),
        upper / n,
        min(1.0, 10 * sum(t.count(d) for d in "0123456789") / chars),
        min(1.0, 2 * (t.count("|") + t.count("\t")) / n),
        1 - len(counts) / n,
        1 - len(set(lines)) / len(lines),
        counts.most_common(1)[0][1] / n if n > 4 else 0.0,
        sum(map(str.__eq__, words, words[1:])) / n,
        min(1.0, chars / n / 20),
        sum(len(x) < 20 for x in lines) / len(lines),
        min(1.0, 5 * (flat.count(".") + flat.count(",")) / n),
        1 / n,
        sum(map(str.istitle, words)) / n,
        sum(map(str.isalpha, words)) / n,
    ]


def expand(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Features and their hinges at each feature's knots: scores are piecewise linear in the features."""
    return np.concatenate([x] + [np.maximum(0.0, x - k) for k in knots], axis=1)


#: Quantiles of features, and cuts, are told to 1 / _FINE; centred scores lie on a grid of so many points a unit up to _REACH, beyond which a preference is certain.
_FINE, _GRID, _REACH, _COARSE = 1 << 12, 32, 40, 32
#: Sums over labelled rows: takes a function of (features, labels, held back) to arrays, gives the sum of what it returns for all blocks of rows.
Total = Callable[[Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def _on_grid(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grid point below each centred score and the share of the one above it."""
    at = (np.clip(s, -_REACH, _REACH) + _REACH) * _GRID
    low = np.minimum(at.astype(np.int64), 2 * _REACH * _GRID - 1)
    return low, at - low


def _histogram(s: np.ndarray) -> np.ndarray:
    low, share = _on_grid(s)
    n = 2 * _REACH * _GRID + 1
    return np.bincount(low, 1 - share, n) + np.bincount(low + 1, share, n)


def _against(counts: np.ndarray, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """At each grid point s, the sum of kernel(s - t) over all counted scores t."""
    n = len(counts)
    return np.convolve(counts, kernel(np.arange(1 - n, n) / _GRID))[n - 1 : 2 * n - 1]


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -80, 80)))


class Ranker:
    """Linear document scores from preference pairs; see the module. ``quantile`` is the share of documents below the cut."""

    def __init__(self, total: Total, rounds: int = 40, l2: float = 1e-3, cut_at: float = 0.3) -> None:
        m = len(NAMES)
        self.weights, self.shift, self.quantile = np.zeros(5 * m), 0.0, 0.0

        def spread(x, y, held):
            at = np.minimum((x * _FINE).astype(np.int64), _FINE) + np.arange(m) * (_FINE + 1)
            return np.r_[np.bincount(at.ravel(), minlength=m * (_FINE + 1)), (y == 1).sum(), (y == 0).sum(), ((y == 1) & ~held).sum(), ((y == 0) & ~held).sum()]

        counts = total(spread)
        n_good, n_bad, self.n_good, self.n_bad = (int(x) for x in counts[-4:])
        self.rows = n_good + n_bad
        below = np.cumsum(counts[:-4].reshape(m, _FINE + 1), axis=1)
        self.knots = np.array([[np.searchsorted(c, max(q * c[-1], 1)) / _FINE if c[-1] else 0.0 for c in below] for q in (0.25, 0.5, 0.75, 0.95)])
        if not n_good or not n_bad:
            self.shift = -math.inf if n_good else math.inf  # only one label: all documents get it
            return
        part = (lambda held: ~held) if self.n_good and self.n_bad else (lambda held: np.ones(len(held), bool))  # too few rows to hold any back

        def moments(x, y, held):
            z = expand(x[part(held)], self.knots)
            return np.r_[len(z), z.sum(0), (z**2).sum(0)]

        sums = total(moments)
        mean = sums[1 : 5 * m + 1] / sums[0]
        scale = np.sqrt(np.maximum(sums[5 * m + 1 :] / sums[0] - mean**2, 0)) + 1e-6

        def placed(x):
            return (expand(x, self.knots) - mean) / scale

        def histograms(w):
            def run(x, y, held):
                mine = part(held)
                s = placed(x[mine]) @ w
                return np.r_[_histogram(s[y[mine] == 1]), _histogram(s[y[mine] == 0])]

            return total(run).reshape(2, -1)

        def loss(w, h):
            return float(h[0] @ _against(h[1], lambda d: np.logaddexp(0, -d))) / pairs + l2 / 2 * float(w @ w)

        def slopes(w, h):
            """Gradient and curvature; how partners move together enters the curvature alone, on a coarser grid."""
            turns = [_against(h[1], lambda d: _logistic(-d)), _against(h[0], _logistic)]  # for a good row over all bad ones, for a bad row over all good ones
            bends = [_against(h[1 - k], lambda d: _logistic(d) * _logistic(-d)) for k in (0, 1)]
            n, cells = len(w), 2 * _REACH * _GRID // _COARSE + 1

            def run(x, y, held):
                mine = part(held)
                z, side = placed(x[mine]), np.where(y[mine] == 1, 0, 1)
                low, share = _on_grid(z @ w)
                turn, bend = (np.where(side == 0, *(t[0 if k == 0 else 1][low] * (1 - share) + t[0 if k == 0 else 1][low + 1] * share for k in (0, 1))) for t in (turns, bends))
                groups = np.zeros((2 * cells, n))
                np.add.at(groups, side * cells + (low + _COARSE // 2) // _COARSE, z)
                return np.r_[z.T @ (turn * np.where(side == 0, -1.0, 1.0)), ((z * bend[:, None]).T @ z).ravel(), groups.ravel()]

            got = total(run)
            grad, gram, (a, b) = got[:n], got[n : n + n * n].reshape(n, n), got[n + n * n :].reshape(2, cells, n)
            d = (np.arange(cells)[:, None] - np.arange(cells)) * _COARSE / _GRID
            cross = a.T @ (_logistic(d) * _logistic(-d)) @ b
            return grad / pairs + l2 * w, (gram - cross - cross.T) / pairs

        w = np.zeros(5 * m)
        h = np.zeros((2, 2 * _REACH * _GRID + 1))
        h[:, _REACH * _GRID] = (self.n_good, self.n_bad) if self.n_good and self.n_bad else (n_good, n_bad)
        pairs = float(h[0].sum() * h[1].sum())
        now = loss(w, h)
        for _ in range(rounds):
            grad, curve = slopes(w, h)
            values, basis = np.linalg.eigh(curve)
            step = -basis @ ((basis.T @ grad) / (np.maximum(values, 0) + l2))
            for _ in range(12):
                h = histograms(w + step)
                then = loss(w + step, h)
                if then <= now:
                    break
                step = step / 4
            else:
                break
            w, last, now = w + step, now, then
            if last - now < 1e-6:
                break
        self.weights, self.loss = w / scale, now

        # where the scores lie: held-back rows choose the quantile, all rows tell the cut there
        middle = float(mean @ self.weights)

        def places(x, y, held):
            at = np.clip((self.raw(x) - middle + _REACH) * 1024, 0, 2 * _REACH * 1024 - 1).astype(np.int64)
            judge = held if n_good > self.n_good and n_bad > self.n_bad else np.ones(len(held), bool)
            return np.r_[np.bincount(at[judge & (y == 1)], minlength=2 * _REACH * 1024), np.bincount(at[judge & (y == 0)], minlength=2 * _REACH * 1024), np.bincount(at, minlength=2 * _REACH * 1024)]

        good, bad, every = total(places).reshape(3, -1)
        self.quantile = self._quantile(good * (n_good / good.sum()), bad * (n_bad / bad.sum()))  # labels weigh as among all rows
        ranks, rank = np.cumsum(every), round(self.quantile * self.rows)
        between = [min(int(np.searchsorted(ranks, rank + k)), len(ranks) - 1) for k in (0.0 if rank else 1.0, 1.0 if rank < self.rows else 0.0)]  # the cells of the rows next to the cut
        self.shift = middle + (sum(between) / 2 + 0.5) / 1024 - _REACH - math.log(cut_at / (1 - cut_at))

    @staticmethod
    def _quantile(good: np.ndarray, bad: np.ndarray) -> float:
        """The share of documents to be put below the cut so that most are on the side of their label, from counts by score; of equally good shares the middle one."""
        below = np.cumsum(np.r_[0, good + bad])
        right = np.cumsum(np.r_[0, bad]) + (good.sum() - np.cumsum(np.r_[0, good]))
        best = below[np.flatnonzero(right == right.max())]
        return float(best[0] + best[-1]) / 2 / below[-1]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand(x, self.knots) @ self.weights

    def of(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1 of rows of features."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.shift, -30, 30)))


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, x): a hash of each row's whole text and its features, read where it lies; null texts count as empty."""

    def run(batches):
        for batch in batches:
            x = pa.array([features(t.as_py()) for t in batch.column(2)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x], ["doc_id", "h", "x"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, "doc_id bigint, h bigint, x array<double>")


def _table_total(rows: DataFrame) -> Total:
    """Sums over a table (y, held, x): each task sums its blocks, and sums of tasks are added in a tree."""

    def total(fn):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            out = 0.0
            for batch in batches:
                x = np.asarray(batch.column(2).flatten(), float).reshape(-1, len(NAMES))
                out = out + np.asarray(fn(x, np.asarray(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)), float)
            if not np.isscalar(out):
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

        none = np.asarray(fn(np.zeros((0, len(NAMES))), np.zeros(0, np.int32), np.zeros(0, bool)), float)
        sums = rows.select("y", "held", "x").mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r.sums))
        return sums.treeAggregate(none, np.add, np.add)

    return total


def train(made: DataFrame, labels: DataFrame, one_of: int = 4, held_out: Column | None = None) -> Ranker:
    """The ranker from all labelled rows outside the held-out fifth (crc32 of the id as text, mod 5, is 0).

    ``made`` is what ``described`` gives, or documents. Labels that differ for one id, or are null, are left out; of texts that share an id the one of the least hash
    is taken. One of ``one_of`` rows, by hash of the id, is held back from the pairs. Without labels all documents score alike.
    """
    made = made if "h" in made.columns and "x" in made.columns and "text" not in made.columns else described(made)
    held_out = crc32_of_id() % 5 == 0 if held_out is None else held_out
    y = F.col("quality").cast("int")
    one = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), y.alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").where(~held_out).select("doc_id", "y")
    with scratch(made.sparkSession):
        rows = made.join(one, "doc_id").groupBy("doc_id", "y").agg(F.min_by("x", "h").alias("x"))
        return Ranker(_table_total(stored(rows.select("y", (F.pmod(F.xxhash64("doc_id"), F.lit(one_of)) == 0).alias("held"), "x"), "labelled")))


def scored(made: DataFrame, model: Ranker) -> DataFrame:
    """(doc_id, score) of rows that ``described`` gave."""
    sent = made.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = sent.value.of(np.asarray(batch.column(1).flatten(), float).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return made.select("doc_id", "x").mapInArrow(run, "doc_id bigint, score double")


def scores(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row's whole text; null texts count as empty; ids may be null or repeat; an empty table gives an empty result; other columns are not read."""
    return scored(described(docs, id_col, text_col), model)
