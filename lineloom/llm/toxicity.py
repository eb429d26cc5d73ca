"""Toxicity by weak supervision.

Voters are lexicon groups and patterns; each says toxic, clean or abstains on a document. A generative label model
estimates every voter's accuracy on each class and the correlations of voters by expectation maximisation, without labels: given the class, votes form a
tree in which each voter depends on the one it moves with most, so that a voter that copies another adds
nothing. Its posterior for each document of a bounded training sample is the soft label that a linear classifier over words is fitted on. That classifier alone scores documents.

The lexicons start from the words below and are widened by words and word beginnings that training labels mark (``marked``), as the words
of a language nobody listed cannot be known otherwise; labels also place the score 0.7. They come only from the rows passed in; language, source and id are never features.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.llm.common import stored

#: Insults and threats by group.
LEXICONS = {
    "intellect": "idiot idiots idiotic moron morons moronic stupid dumb imbecile dimwit halfwit fool brainless",
    "worth": "worthless pathetic loser losers useless failure nobody lowlife",
    "contempt": "trash garbage scum filth vermin rubbish parasite swine",
    "mockery": "clown clowns joke laughable ridiculous buffoon",
    "disgust": "disgusting revolting gross vile repulsive nasty sickening",
    "hate": "hate despise loathe detest hateful",
    "threat": "kill die hurt destroy burn hang",
}
_TOKEN = re.compile(r"[^\W_]+")
_LEET = str.maketrans("013457@$!", "oieastasi")
#: Patterns that vote toxic, and ones that vote clean.
_AIMED = re.compile(r"\b(?:you|your|u)\b(?:\W+\w+){0,3}\W+\b(?:idiots?|morons?|losers?|scum|clowns?|trash|stupid|pathetic|worthless|disgusting)\b", re.I)


#: Lengths of the word beginnings that count as features beside whole words: insults are inflected.
STEMS = (4, 5, 6)


def words(text: str | None) -> set[str]:
    """Lower-cased words, the words behind digits and signs that stand for letters, and the stems of all (marked by ``^``)."""
    low = (text or "").lower()
    found = set(_TOKEN.findall(low))
    if any(c.isdigit() for c in low) or "@" in low or "$" in low or "!" in low:
        for t in low.split():
            if not t.isalpha() and any(c.isalpha() for c in t):
                found.add(t.rstrip("!.,;:?").translate(_LEET))
    return found.union(*[["^" + w[:k] for w in found if len(w) >= k] for k in STEMS])


class Example(NamedTuple):
    """What the fit keeps of a text: features (the lowest by hash of very many), number of all features, whether an insult is aimed at somebody."""

    found: frozenset[str]
    size: int
    aimed: bool


def example(text: str | None, most: int = 20_000) -> Example:
    found = words(text)
    kept = found if len(found) <= most else sorted(found, key=lambda w: (zlib.crc32(w.encode("utf-8", "surrogatepass")), w))[:most]
    return Example(frozenset(kept), len(found), _AIMED.search(text or "") is not None)


def vote(found: set[str] | frozenset[str], size: int, aimed: bool, lexicons: list[frozenset[str]]) -> list[int]:
    """1 toxic, -1 clean, 0 abstains: one per lexicon, then the patterns and the voters for texts without any hit."""
    hits = [1 if not lex.isdisjoint(found) else 0 for lex in lexicons]
    total = sum(hits)
    return [*hits, 1 if total >= 2 else 0, 1 if total and aimed else 0, 0 if total else -1, 0 if total or size < 5 else -1]


class LabelModel:
    """Class balance, each voter's chance of each vote given the class, and which voter it depends on, by expectation maximisation.

    ``log`` has each voter's log ratio of a vote under the classes, ``parent`` the voter it depends on (-1: none), ``weight`` the
    share of its evidence that its parent does not give already.
    """

    def __init__(self, votes: np.ndarray, rounds: int = 30, prior: float = 0.1, dependence: float = 0.05) -> None:
        n, m = votes.shape
        seen = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # rows, voters, values
        flat = seen.reshape(n, m * 3)
        post = np.clip(np.where((votes == 1).any(1), 0.9, prior / 2), 1e-3, 1 - 1e-3)
        self.parent = [-1] * m
        for done in range(rounds):
            self.prior = float(np.clip(post.mean(), 1e-4, 0.5))
            one, two = [], []  # by class: chances of a vote, and of two voters' votes together
            for p in (1 - post, post):
                c = np.einsum("n,nmv->mv", p, seen) + 0.1
                one.append(c / c.sum(1, keepdims=True))
                j = (flat.T @ (flat * p[:, None])).reshape(m, 3, m, 3).transpose(0, 2, 1, 3) + 0.1 * one[-1][:, None, :, None] * one[-1][None, :, None, :]
                two.append(j / j.sum((2, 3), keepdims=True))
            self.log = np.log(one[1]) - np.log(one[0])
            self.log[:, 1] = 0.0  # an abstention says nothing
            # what two voters tell of each other within the classes, over what either tells at all
            shared = sum(w * (t * np.log(t / (o[:, None, :, None] * o[None, :, None, :]))).sum((2, 3)) for w, t, o in zip((1 - self.prior, self.prior), two, one, strict=True))
            own = sum(w * -(o * np.log(o)).sum(1) for w, o in zip((1 - self.prior, self.prior), one, strict=True))
            share = np.clip(shared / np.maximum(np.minimum(own[:, None], own[None]), 1e-9), 0.0, 1.0)
            if done == rounds // 2:  # dependences show once the classes are told apart by voters taken as independent
                self.parent = self._tree(share, dependence)
            self.weight = np.array([1.0 if k < 0 else 1.0 - share[j, k] for j, k in enumerate(self.parent)])
            # given the parent's vote
            self.given = [[None if k < 0 else t[k, j] / t[k, j].sum(1, keepdims=True) for j, k in enumerate(self.parent)] for t in two]
            post = self.posterior(votes)
        self.accuracy = one

    @staticmethod
    def _tree(share: np.ndarray, least: float) -> list[int]:
        """A spanning forest of the strongest dependences of ``least`` or more, each voter with its parent."""
        m = len(share)
        parent, done = [-1] * m, set()
        for root in range(m):
            if root in done:
                continue
            done.add(root)
            inside = [root]
            while True:
                best = max(((share[a, b], -a, -b) for a in inside for b in range(m) if b not in done), default=(0.0, 0, 0))
                if best[0] < least:
                    break
                parent[-best[2]] = -best[1]
                done.add(-best[2])
                inside.append(-best[2])
        return parent

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = np.full(len(votes), math.log(self.prior / (1 - self.prior)))
        for j, k in enumerate(self.parent):
            mine = votes[:, j] + 1
            if k < 0:
                z += self.log[j][mine]
            else:
                theirs = votes[:, k] + 1
                more = np.log(self.given[1][j][theirs, mine]) - np.log(self.given[0][j][theirs, mine])
                # a parent that abstains says nothing that the voter could repeat
                z += np.where(votes[:, j] == 0, 0.0, np.where(votes[:, k] == 0, self.log[j][mine], more))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Classifier:
    """Logistic regression on presence of the given features, with a bias."""

    def __init__(self, rows: list[frozenset[str]], target: np.ndarray, chosen: list[str], rounds: int = 400, l2: float = 1e-5) -> None:
        mean = float(target.mean()) if len(target) else 0.0
        at = {w: j for j, w in enumerate(sorted(chosen))}
        pairs = [(i, at[w]) for i, r in enumerate(rows) for w in at.keys() & r]
        ri, rj = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        w, b, vw, vb = np.zeros(len(at)), math.log((mean + 1e-3) / (1 - mean + 1e-3)), np.full(len(at), 1e-8), 1e-8
        for _ in range(rounds if len(rows) else 0):  # full-batch gradients with a step per coordinate
            z = b + np.bincount(ri, w[rj], len(rows))
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
            gw, gb = np.bincount(rj, g[ri], len(at)) / len(rows) + l2 * w, g.mean()
            vw, vb = vw + gw**2, vb + gb**2
            w, b = w - 0.5 * gw / np.sqrt(vw), b - 0.5 * gb / math.sqrt(vb)
        self.bias = float(b)
        self.weights = {x: float(w[j]) for x, j in at.items()}
        self.shift = 0.0

    def margin(self, found: set[str]) -> float:
        get = self.weights.get
        return self.bias + sum(get(w, 0.0) for w in self.weights.keys() & found)

    def calibrate(self, margins: np.ndarray, labels: np.ndarray, at: float = 0.7) -> None:
        """Moves the score ``at`` to the margin that divides the labels best, the middle of the widest such gap."""
        order = np.argsort(margins, kind="stable")
        m, y = margins[order], labels[order]
        if not len(y) or y.min() == y.max():
            return
        good = np.cumsum(np.r_[0, 1 - y]) + (y.sum() - np.cumsum(np.r_[0, y]))  # clean rows below plus toxic rows above
        edges = np.r_[m[0] - 2, m, m[-1] + 2]
        best = max(range(len(good)), key=lambda k: (edges[k] != edges[k + 1], good[k], edges[k + 1] - edges[k]))
        self.shift = (edges[best] + edges[best + 1]) / 2 - math.log(at / (1 - at))

    def score(self, found: set[str]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.margin(found) - self.shift))))


def marked(rows: DataFrame, evidence: float = 25.0, purity: float = 0.9, most: int = 2000) -> list[str]:
    """Features that labels mark as toxic: nearly only in toxic rows, by more than chance explains. ``rows`` is a sample with y and found.

    ``evidence`` is twice the log likelihood ratio against the base rate; among many rare features some are only in
    toxic rows by chance, and they stay below it.
    """
    n, toxic = rows.agg(F.count("*"), F.sum("y")).first()
    base = min(0.5, max(1e-3, (toxic or 0) / max(n, 1)))
    counts = rows.select("y", F.explode("found").alias("w")).where(F.length("w") > 2).groupBy("w").agg(F.sum("y").alias("c"), F.count("*").alias("n"))
    p = F.col("c") / F.col("n")
    rest = F.when(F.col("n") > F.col("c"), (F.col("n") - F.col("c")) * F.log((1 - p) / (1 - base))).otherwise(0.0)
    g = 2 * (F.col("c") * F.log(p / base) + rest)
    found = counts.where(F.col("c") > 0).withColumn("g", g).where((p >= purity) & (F.col("g") >= evidence))
    return [r.w for r in found.orderBy(F.desc("g"), "w").limit(most).collect()]


def fit(labelled: list[tuple[Example, int]], new: list[str], groups_of: int = 6) -> Classifier:
    """The classifier from examples with their labels, 0 or 1, and the features that labels mark."""
    listed = frozenset(" ".join(LEXICONS.values()).split())
    keep = listed.union(new)
    rows, y = [keep & e.found for e, _ in labelled], [int(v) for _, v in labelled]
    clean, toxic = Counter(), Counter()
    for r, v in zip(rows, y, strict=True):
        (toxic if v else clean).update(listed & r)
    # a word of the lists that labels show to be ordinary in these languages does not vote
    groups = [g for v in LEXICONS.values() if (g := frozenset(w for w in v.split() if clean[w] <= toxic[w]))]
    known = frozenset().union(*groups)
    new = [w for w in new if w not in known]
    groups += [frozenset(new[k::groups_of]) for k in range(groups_of) if new[k::groups_of]]
    votes = np.array([vote(r, e.size, e.aimed, groups) for r, (e, _) in zip(rows, labelled, strict=True)], dtype=int).reshape(len(rows), len(groups) + 4)
    target = LabelModel(votes).posterior(votes) if len(rows) else np.zeros(0)
    seen = Counter(w for r in rows for w in known & r)
    model = Classifier(rows, target, [*new, *(w for w in known if seen[w])])
    if len(rows):
        model.calibrate(np.array([model.margin(r) for r in rows]), np.array(y, float))
    return model


def picked(labels: DataFrame, held_out: Column, rows: int, column: str) -> DataFrame:
    """(doc_id, y): a bounded sample of labelled rows that ``held_out`` is not true for, by hash of the id.

    Labels that differ for one id, or are null, are left out.
    """
    one = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top")
    return one.where(~held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "y")


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, y, text) of the chosen rows, of texts that share an id the least. ``chosen`` is a bounded sample."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def sample(docs: DataFrame, labels: DataFrame, held_out: Column, rows: int, features: int) -> DataFrame:
    """(doc_id, y, found, size, aimed): examples of a bounded sample of labelled rows. Whole texts are read where they lie; ``features`` bounds what is kept of each."""

    def run(batches):
        for batch in batches:
            told = [example(t.as_py(), features) for t in batch.column(2)]
            found = pa.array([sorted(e.found) for e in told], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found, pa.array([e.size for e in told], pa.int64()), pa.array([e.aimed for e in told], pa.bool_())], ["doc_id", "y", "found", "size", "aimed"])

    return stored(labelled_texts(docs, picked(labels, held_out, rows, "toxic")).mapInArrow(run, "doc_id bigint, y int, found array<string>, size bigint, aimed boolean"), "examples")


def scores(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row's whole text; null texts count as empty; ids may be null or repeat; an empty table gives an empty result; other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            s = [m.score(words(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, row_features: int = 20_000) -> Classifier:
    """The classifier from labelled rows outside the held-out third (crc32 of the id as text, mod 3, is 1).

    ``sample_rows`` bounds the rows, by hash of the id, and ``row_features`` the words of one row. Without labels every text is clean.
    """
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    rows = sample(docs, labels, held, sample_rows, row_features)
    new = marked(rows)
    # of each row only what can vote reaches the driver
    able = F.array(*[F.lit(w) for w in sorted({*" ".join(LEXICONS.values()).split(), *new})])
    slim = rows.select("doc_id", "y", F.array_intersect("found", able).alias("found"), "size", "aimed").collect()
    return fit([(Example(frozenset(r.found), r.size, r.aimed), r.y) for r in sorted(slim, key=lambda r: r.doc_id)], new)


def clean(docs: DataFrame, model: Classifier, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more. All columns stay; no shuffle, and no id is needed.

    Null and empty texts score as texts without words; a score of exactly ``threshold`` goes; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([m.score(words(t.as_py())) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
