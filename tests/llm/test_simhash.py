import os
import random

import numpy as np
import pytest
import xxhash

from lineloom.llm import common, simhash


def brute(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < width else [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance=4):
    ids = list(prints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \t\r\n", "one", "one two three", "a b c d", "a b c d e", "É Ö a\x0bb c\x0cd", "x " * 70_000 + "y z"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute(text)


def test_whitespace_is_exactly_the_ascii_kind():
    assert simhash.fingerprint("a\x85b c d e".encode()) == brute("a\x85b c d e")
    assert simhash.fingerprint("a b c\xa0d e".encode()) == brute("a b c\xa0d e")


@pytest.mark.parametrize("distance", range(8))
def test_segments_catch_every_pair(distance):
    rng = random.Random(distance)
    parts = simhash.segments(distance)
    assert sum(w for _, w in parts) == 64
    for _ in range(200):
        x = sum(1 << b for b in rng.sample(range(64), distance))
        assert any((x >> lo & (1 << w) - 1).bit_count() <= 1 for lo, w in parts)


def test_components_match_brute_force(spark, documents):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = {}
    for i in range(300):
        p = rng.choice(base)
        for b in rng.sample(range(64), rng.choice([0, 0, 1, 2, 3, 5])):
            p ^= 1 << b
        prints[i] = p
    signed = [(v - (1 << 64) if v >> 63 else v, i) for i, v in prints.items()]
    classes = spark.createDataFrame(signed, "fp bigint, rep bigint").groupBy("fp").agg({"rep": "min"}).toDF("fp", "rep")
    got = {(r.a, r.b): r.bits for r in simhash.links(classes).collect()}
    reps = {r.rep: r.fp & (1 << 64) - 1 for r in classes.collect()}
    want = {(a, b): (x ^ y).bit_count() for a, x in reps.items() for b, y in reps.items() if a < b and (x ^ y).bit_count() <= 4}
    assert got == want
    assert simhash.links(classes).count() == len(want)  # each pair once
    # ties are links or lead to them, and fewer of them have the same components
    root = {i: i for i in reps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    tied = [(r.a, r.b) for r in simhash.ties(classes).collect()]
    for a, b in tied:
        root[max(top(a), top(b))] = min(top(a), top(b))
    assert {i: top(i) for i in reps} == brute_components(reps)
    assert len(tied) < len(want)


def test_near_duplicates_edge_cases(documents):
    words = " ".join(f"w{k}" for k in range(300))
    rows = [(5, words), (3, words), (3, words), (9, words.upper()), (11, None), (10, ""), (12, " \n"), (1, "short"), (None, words), (20, "other text of five words"), (20, words)]
    found = simhash.near_duplicates(documents(rows, extra=True)).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[5] == by[3] == by[9] == by[20] == {3}
    assert by[10] == by[11] == by[12] == {10}
    assert by[1] == {1} and by[None] == {None}


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    assert simhash.deduplicate(documents([])).collect() == []


def test_similar_groups_follow_jaccard(documents):
    rng = random.Random(3)
    rows, group = [], {}
    for g in range(6):
        words = [f"g{g}w{rng.randrange(5000)}" for _ in range(400)]
        for k in range(20):
            copy = list(words)
            for at in rng.sample(range(400), k % 4):
                copy[at] = "changed"
            rows.append((len(rows), " ".join(copy)))
            group[len(rows) - 1] = g
    rows += [(1000 + k, " ".join(f"z{rng.randrange(5000)}" for _ in range(50))) for k in range(60)]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(rows, extra=True)).collect()}
    assert all(got[i] == 20 * g for i, g in group.items())
    assert all(got[i] == i for i in got if i >= 1000)
    kept = simhash.deduplicate(documents(rows, extra=True))
    assert {r.doc_id for r in kept.collect()} == {20 * g for g in range(6)} | {1000 + k for k in range(60)}


def jaccard(x, y, width=5):
    a, b = ({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} for w in (x.split(), y.split()))
    return len(a & b) / len(a | b)


def test_pairs_of_0_8_and_more_meet(documents):
    rng = random.Random(5)
    rows, pairs = [], []
    for g in range(400):
        words = [f"g{g}w{k}" for k in range(rng.choice([40, 150, 400]))]
        copy = list(words)
        for at in rng.sample(range(len(words)), max(1, len(words) // 50)):
            copy[at] = "changed"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(copy))]
        pairs.append(jaccard(rows[-2][1], rows[-1][1]) >= 0.8)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(rows)).collect()}
    assert sum(pairs) > 100
    assert [got[2 * g + 1] == 2 * g for g in range(400)] == pairs  # all those of 0.8 or more, and no others


def test_keys_meet_at_0_8():
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(2000):
        h = rng.integers(0, 1 << 64, 220, dtype=np.uint64)
        met += bool((simhash.band_keys(h[:198]) == simhash.band_keys(h[22:])).any())  # 176 of 220 shared
    assert met >= 1995


def test_a_repeated_line_is_no_near_copy(documents):
    line = " ".join(f"line{k}" for k in range(12))
    rows = [(k, " ".join([line] * times + [f"t{times}d{k}w{i}" for i in range(150)])) for k, times in enumerate([20, 20, 10, 10])]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}


@pytest.mark.parametrize("tile_rows", [3, 1024])
def test_families_across_tiles(documents, tile_rows):
    """A family of near copies of one text, most alike by less than 0.8 to each other: tiles of any size give the components of all links."""
    rng = random.Random(tile_rows)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):
        copy = list(words)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 5, 8])):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    rows += [(500, None), (501, ""), (502, " "), (None, rows[0][1]), (3, rows[9][1])]
    root = {i: i for i, _ in rows if i is not None}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    named = [(i, t) for i, t in rows if i is not None]
    for a, (i, x) in enumerate(named):
        for j, y in named[:a]:
            if i == j or (not (x or "").split() and not (y or "").split()) or ((x or "").split() and (y or "").split() and jaccard(x, y) >= 0.8):
                root[max(top(i), top(j))] = min(top(i), top(j))
    got = {}
    for r in simhash.similar_groups(documents(rows, extra=True), tile_rows=tile_rows).collect():
        got.setdefault(r.doc_id, set()).add(r.component_id)
    assert got == {i: {top(i)} for i, _ in named}


def test_deduplicate_keeps_rows_that_repeat_an_id(documents):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(2, text), (1, text), (1, text + " end"), (None, text), (5, "other words"), (5, "other words")]
    kept = simhash.deduplicate(documents(rows, extra=True)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, text), (1, text + " end"), (0, text), (5, "other words"), (5, "other words")])


def test_pipeline_families_come_from_signatures(documents, monkeypatch):
    """Near copies of one fingerprint family are linked without any MinHash band, and a family by chance of one line is parted by the sets."""
    monkeypatch.setattr(simhash, "band_keys", lambda hashes: np.zeros(0, np.int64))
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(900)]
    near = [*base[:-1], "changed"]
    line = "the same line of words comes again and again until it ends here"
    own = lambda k: f"{' '.join([line] * 400)} {' '.join(f'x{k}y{i}' for i in range(90))}"
    rows = [(5, " ".join(base)), (9, " ".join(near)), (20, own(1)), (21, own(2))]
    a, b, c, d = (simhash.fingerprint(t.encode()) for _, t in rows)
    assert (a ^ b).bit_count() <= 4 and (c ^ d).bit_count() <= 4
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(rows)).collect()}
    assert got == {5: 5, 9: 5, 20: 20, 21: 21}


def test_sieve_flags_all_keys_and_few_others(spark, monkeypatch):
    keys = spark.range(0, 9000, 3).selectExpr("id * 7919 - 5000000 as k")
    rows = spark.range(0, 9000).selectExpr("cast(id * 7919 - 5000000 as bigint) as x", "id % 3 = 0 as y", "'a' as `_b.c`").unionByName(spark.sql("select cast(null as bigint) as x, false as y, 'a' as `_b.c`"))
    told = common.sieved(rows, "x", keys, "hit")
    assert told.columns == [*rows.columns, "hit"]
    got = told.groupBy("y", "hit").count().collect()
    count = {(r.y, r.hit): r["count"] for r in got}
    assert (True, False) not in count and count[True, True] == 3000
    assert count.get((False, True), 0) < 30 and sum(count.values()) == 9001
    # a sieve that is full flags more, never less
    monkeypatch.setattr(common, "_SLOTS", 2)
    assert common.sifted(rows, "x", keys).where("y").count() == 3000


def test_near_duplicates_leave_no_scratch_and_shuffle_few_texts(spark, documents, tmp_path):
    """All tables made on the way are gone with the call, and texts of documents without a copy are not shuffled."""
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for k in range(200)] + [(900, "one copy of five words"), (901, "one copy of five words")]
    documents(rows).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    where = common.shared_dir(spark).removeprefix("file://")
    before = {p for p in os.listdir(where) if p.startswith("lineloom-")}
    kept = simhash.deduplicate(docs)
    left = {p for p in os.listdir(where) if p.startswith("lineloom-")} - before
    assert [p.split("-")[1] for p in left] == ["gone"]
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {901}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "BroadcastHashJoin" in plan
