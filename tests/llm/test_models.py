import math
import random
import re
import zlib

import numpy as np

from lineloom.llm import quality, toxicity
from lineloom.llm.queries import op4_toxicity, op8_quality

CLEAN = "river stone garden music window letter winter summer market bread table silver answer people number".split()
INSULT = ["zonkarel", "zonkamit", "zonkadus", "pavrolin", "pavrotek", "idiot", "moron"]


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) + rng.choice(["", "s", "ly", "ed"]) for _ in range(rng.randrange(20, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULT))
        rows.append((i, " ".join(words)))
        if rng.random() < 0.7:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def held(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def test_toxicity_held_out(spark, documents, tmp_path):
    rows, labels = corpus(900, 1)
    truth = {i: any(w in INSULT for w in t.split()) for i, t in rows}
    extra = [(5000, None), (5001, ""), (5002, "short"), (5003, CLEAN[0] * 50_000), (5004, "you IDIOT!! zonkadus"), (None, "bread")]
    documents(rows + extra).write.parquet(f"{tmp_path}/documents.parquet")
    lab = spark.createDataFrame([*labels, (3, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    got = op4_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(extra)
    ours = {r.doc_id: r for r in got}
    assert all(ours[i].held_out == (held(i, 3) == 1) for i, _ in rows)
    out = [i for i, _ in rows if ours[i].held_out]
    assert sum(ours[i].predicted == truth[i] for i in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert ours[5001].predicted == ours[5000].predicted == 0 and ours[5004].predicted == 1
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(i, q, 1 - t if held(i, 3) == 1 else t) for i, q, t in labels], "doc_id bigint, quality int, toxic int")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    a, b = (toxicity.train(docs, x) for x in (lab, flipped))
    assert a.weights == b.weights and a.bias == b.bias and a.shift == b.shift
    kept = toxicity.clean(docs, a)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted == 0}


def test_label_model_learns_accuracy_and_correlation():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.2
    good = np.where(rng.random(3000) < 0.9, np.where(y, 1, -1), 0)
    bad = np.where(rng.random(3000) < 0.5, rng.choice([-1, 1], 3000), 0)
    other = np.where(rng.random(3000) < 0.85, np.where(y, 1, -1), 0)
    votes = np.stack([good, good, other, bad], axis=1)
    m = toxicity.LabelModel(votes)
    assert m.parent[1] == 0 and m.weight[1] < 0.05 and m.parent[3] == -1  # the copy depends on its twin and adds nothing
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.97
    assert abs(m.log[3][2]) < 1 < m.log[0][2]
    assert m.weight[0] <= m.weight[3]  # copies of a voter share their evidence


def test_models_without_labels(documents, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = documents([(1, "a b c"), (2, None)], extra=True)
    assert {r.doc_id for r in toxicity.scores(docs, toxicity.train(docs, none)).collect()} == {1, 2}
    assert {r.doc_id for r in quality.scores(docs, quality.train(docs, none)).collect()} == {1, 2}
    empty = documents([])
    assert toxicity.scores(empty, toxicity.train(empty, none)).collect() == []
    assert quality.scores(empty, quality.train(empty, none)).collect() == []


def test_quality_held_out(spark, documents, tmp_path):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(700):
        words = [rng.choice(CLEAN) + rng.choice(["", "s", "ly", "ed"]) for _ in range(rng.randrange(30, 80))]
        bad = i % 4 == 0
        kind = rng.randrange(3)
        if bad:
            words = [[w + "###", w.upper() + "!!", words[0]][kind] for w in words]
        rows.append((i, " ".join(words).capitalize() + "." if not bad else " ".join(words)))
        labels.append((i, int(not bad), 0))
    documents([*rows, (9000, None), (9001, ""), (None, "x")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in op8_quality(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + 3
    assert all(got[i].held_out == (held(i, 5) == 0) for i, _ in rows)
    out = [i for i, _ in rows if got[i].held_out]
    assert sum(got[i].predicted == (i % 4 != 0) for i in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    # scores are the logistic of a linear function of the features, by plain loops
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert 0.15 < model.quantile < 0.35  # a quarter is bad, so about as many stand below the cut
    for r in docs.collect()[:60]:
        x = quality.features(r.text)
        z = sum(w * v for w, v in zip(model.weights, x + [max(0.0, v - k) for knot in model.knots for v, k in zip(x, knot)]))
        assert abs(got[r.doc_id].score - 1 / (1 + math.exp(model.shift - z))) < 1e-9


def test_toxicity_scores_match_plain_loops(spark, documents):
    rows, labels = corpus(300, 3)
    rows += [(7, "the same id, IDIOT, again zonkarel"), (7, None), (8000, "moron " * 30_000)]
    docs = documents(rows, extra=True)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = sorted((r.doc_id, round(r.score, 9)) for r in toxicity.scores(docs, model).collect())

    def plain(t):
        found = set()
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            found |= {w, *("^" + w[:k] for k in (4, 5, 6) if len(w) >= k)}
        z = model.bias + sum(v for w, v in model.weights.items() if w in found) - model.shift
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    assert got == sorted((i, round(plain(t), 9)) for i, t in rows)
    assert toxicity.example("a " * 10 + "b c", most=2).size == 3 and len(toxicity.example("aa bb cc dd", most=2).found) == 2


def test_quality_counts_every_pair():
    """The weights are those of the logistic loss over all pairs of a good and a bad row, by plain sums over the pairs."""
    rng = np.random.default_rng(6)
    n, m = 400, len(quality.NAMES)
    y = (rng.random(n) < 0.6).astype(int)
    x = np.clip(rng.random((n, m)) * 0.8 + 0.1 * y[:, None] * (np.arange(m) % 3 == 0), 0, 1)
    held_back = np.arange(n) % 4 == 0

    def total(fn):
        return sum(np.asarray(fn(x[k : k + 150], y[k : k + 150], held_back[k : k + 150]), float) for k in range(0, n, 150))

    model = quality.Ranker(total)
    z = quality.expand(x[~held_back], model.knots)
    scale = z.std(0) + 1e-6
    good, bad = (z[y[~held_back] == k] / scale for k in (1, 0))
    w = model.weights * scale
    d = (good[:, None, :] - bad[None, :, :]).reshape(-1, 5 * m)
    loss = np.logaddexp(0, -(d @ w)).mean() + 0.5e-3 * w @ w
    slope = -(d.T @ (1 / (1 + np.exp(d @ w)))) / len(d) + 1e-3 * w
    assert len(d) == model.n_good * model.n_bad
    assert abs(loss - model.loss) < 1e-3 and np.abs(slope).max() < 2e-3
    # the cut is the score at the quantile of all rows, to a thousandth
    at = model.shift + math.log(0.3 / 0.7)
    raw = model.raw(x)
    assert (raw < at - 2e-3).mean() - 1 / n <= model.quantile <= (raw < at + 2e-3).mean() + 1 / n


def test_quality_learns_from_all_labelled_rows(spark):
    """5600 labelled rows, over the 4000 that were once drawn: all outside the held-out fifth are pairs or held back, each label of two kinds left out."""
    n = 5600
    docs = spark.range(n).selectExpr("id as doc_id", "concat('word ', id, if(id % 3 = 0, ' ###', ' ends.')) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 3 <> 0 as int) as quality").union(spark.sql("select 7L, 0"))
    model = quality.train(docs, labels)
    mine = [i for i in range(n) if held(i, 5) and i != 7]
    assert model.rows == len(mine)
    assert 0.6 * len(mine) < model.n_good + model.n_bad < 0.9 * len(mine)
