import random

import pytest

import corpus_pipeline as cp
from lineloom.llm import decontaminate, mixing, pii, simhash, toxicity

WORDS = [a + b for a in ("ri", "sto", "gar", "mu", "win", "let", "sum", "mar", "bre", "ta") for b in ("ver", "ne", "den", "sic", "dow", "ter", "mer", "ket", "ad", "ble")]
ITEM = "the quick benchmark passage holds twenty words that nobody else would write in exactly this order at any given time"


def folder(spark, documents, path):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly"]) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        t = prose(60)
        toxic = i % 5 == 0
        rows.append((i, f"{t} idiot moron {prose(3)} idiot" if toxic else t, f"s{i % 4}"))
        labels.append((i, 1, int(toxic)))
    long = prose(300)
    rows += [(1000, long, "s1"), (1001, long, "s2"), (1002, long + " tail", "s3"), (1003, f"{prose(30)} {ITEM} {prose(30)}", "s1"), (1004, "write to a.b@example.org or +1 (743) 555-3824 please", "s2"), (1005, None, None), (1006, "", "s0"), (None, prose(40), "s1")]
    documents(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows


def test_stages(spark, documents, tmp_path):
    d = str(tmp_path)
    rows = folder(spark, documents, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    seen = []
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id for r in docs.collect()}
        docs = stage(spark, docs, d)
        if k < 4:
            assert docs.columns == list(cp.COLUMNS), name
        docs.write.parquet(f"{d}/stage{k}")
        docs = spark.read.parquet(f"{d}/stage{k}")
        seen.append(before - {r.doc_id for r in docs.collect()})
    assert seen[0] == {i for i, t, _ in rows if t and "idiot" in t}
    # blank and null texts are one group, like any equal texts
    assert seen[1] == {1001, 1002, 1006}
    assert seen[2] == {1003} and seen[3] == seen[4] == set()
    clean = {r.doc_id: r for r in spark.read.parquet(f"{d}/stage3").collect()}
    assert clean[1004].text == "write to [EMAIL] or [PHONE] please" and clean[1004].n_chars == len(clean[1004].text)
    assert clean[1005].text is None and clean[1005].n_chars is None
    texts = {i: t for i, t, _ in rows}
    assert all(r.text == texts[i] for i, r in clean.items() if i != 1004)
    final = sorted(map(str, docs.collect()))
    assert final == sorted(map(str, cp.run(spark, d).collect()))


def test_empty_documents(spark, documents, tmp_path):
    d = str(tmp_path)
    folder(spark, documents, d)
    nothing = spark.read.parquet(f"{d}/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        nothing = stage(spark, nothing, d)
    assert nothing.collect() == []


def test_stages_call_the_operators(monkeypatch):
    """Every stage goes through the operator it names, and through no other."""
    for name, module, function in (("toxicity", toxicity, "clean"), ("near_duplicates", simhash, "deduplicate"), ("decontamination", decontaminate, "clean"), ("personal_data", pii, "find"), ("mixing", mixing, "mix")):
        called = []

        def spy(*args, called=called, **kwargs):
            called.append(args[0])
            raise StopIteration

        with monkeypatch.context() as m:
            m.setattr(module, function, spy)
            m.setattr(cp, "table", lambda *a: None)
            m.setattr(toxicity, "train", lambda *a: None)

            class Docs:
                def select(self, *columns):
                    return self

            docs = Docs()
            with pytest.raises(StopIteration):
                dict(cp.STAGES)[name](None, docs, "")
        assert called == [docs]
    assert cp.ORACLE_SQL is None
