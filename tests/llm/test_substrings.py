import hashlib
import random
import re

import numpy as np
import pytest

from lineloom.llm import substrings


def brute(texts, length):
    """Per text: (bytes, removed, spans, hash of what is kept)."""
    seen = {}
    for t in texts:
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]] = seen.get(t[s : s + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(kept).hexdigest()))
    return out


def brute_passages(texts, least, words):
    """Per text: maximal runs under strings of ``least`` bytes that start in another text too, which hold more than ``words`` whole words."""
    owners = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - least + 1):
            owners.setdefault(t[s : s + least], set()).add(i)
    out = []
    for t in texts:
        under = bytearray(len(t))
        for s in range(len(t) - least + 1):
            if len(owners[t[s : s + least]]) > 1:
                under[s : s + least] = b"\1" * least
        tokens = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        out.append(sum(sum(m.start() <= a and b <= m.end() for a, b in tokens) > words for m in re.finditer(b"\1+", bytes(under))))
    return out


def corpus(seed):
    rng = random.Random(seed)
    rand = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [rand(n) for n in (60, 79, 80, 81, 120, 300)]
    texts = []
    for _ in range(60):
        t = ""
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(shared) if rng.random() < 0.6 else rand(rng.randrange(10, 150))
            if rng.random() < 0.3 and len(p) > 20:
                at = rng.randrange(len(p))
                p = p[:at] + "#" + p[at + 1 :]
            t += p
        texts.append(t)
    texts += ["x" * 500, "ab" * 200, "", "short", texts[0], texts[1], rand(80), rand(79)]
    texts += [" ".join(["lines of one text only, again and again"] * 9)]
    return texts


@pytest.mark.parametrize("seed,group_rows,least", [(1, 20_000, 80), (2, 20_000, 50), (3, 2, 80), (4, 2, 50)])
def test_matches_brute_force(documents, seed, group_rows, least):
    texts = corpus(seed)
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (3, texts[3]), (None, texts[5])]
    got = substrings.removed(documents(rows, extra=True), length=80, least=least, passage_words=6, group_rows=group_rows).collect()
    plain = [(t or "").encode() for _, t in rows]
    want = [(*w, p) for w, p in zip(brute(plain, 80), brute_passages(plain, least, 6))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted([(i, *w) for (i, _), w in zip(rows, want)], key=key)
    assert sum(w[-1] for w in want) > 10


def test_short_periods_do_not_multiply_pieces(documents, monkeypatch):
    """Texts that say a word again and again share one seed at many places; a group of them over the bound is split without a row for each place of a window."""
    rng = random.Random(5)
    rand = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    texts = [rand(rng.randrange(70)) + "the " * rng.randrange(25, 60) + rand(rng.randrange(70)) for _ in range(40)]
    rows, plain_stored = [], substrings.stored

    def counted(df, tag):
        out = plain_stored(df, tag)
        if tag == "pieces":
            rows.append(out.count())
        return out

    monkeypatch.setattr(substrings, "stored", counted)
    got = {r.doc_id: tuple(r)[1:5] for r in substrings.removed(documents(list(enumerate(texts))), length=120, least=90, group_rows=20).collect()}
    assert got == dict(enumerate(brute([t.encode() for t in texts], 120)))
    print(f"pieces by level: {rows}")
    assert len(rows) > 3 and max(rows) <= 6 * rows[0]


def test_longest_prefix_elsewhere_skips_the_own():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(2, 12)
        extent, owner = [rng.randrange(9) for _ in range(n - 1)], [rng.randrange(3) for _ in range(n)]
        want = [max([min(extent[min(i, j) : max(i, j)]) for j in range(n) if owner[j] != owner[i]], default=0) for i in range(n)]
        assert substrings._elsewhere(np.array(extent), np.array(owner)).tolist() == want


def test_runs_of_several_texts_are_those_of_each():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab ") for _ in range(n)).encode() for n in (0, 500, 99, 100, 0, 3000, 101, 0)]
    ends = np.cumsum([len(t) for t in texts])
    first, last, anchor, core = (x.tolist() for x in substrings._runs(np.frombuffer(b"".join(texts), np.uint8), ends, 100))
    want = [(f + e - len(t), z + e - len(t), a + e - len(t), c) for t, e in zip(texts, ends.tolist()) for f, z, a, c in substrings.runs(t, 100)]
    assert list(zip(first, last, anchor, core)) == want


def test_runs_cover_all_windows_and_chunks_agree(monkeypatch):
    text = " ".join(map(str, range(3000))).encode()
    whole = substrings.runs(text, 400)
    assert [r[0] for r in whole[1:]] == [r[1] + 1 for r in whole[:-1]] and whole[-1][1] == len(text) - 400
    monkeypatch.setattr(substrings, "_CHUNK", 1000)
    cut = substrings.runs(text, 400)
    of = lambda rs: {s: r[2] for r in rs for s in range(r[0], r[1] + 1)}
    assert of(cut) == of(whole)


def test_interval_tree_has_all_occurrences():
    parts = sorted([b"abcx", b"abcy", b"abd", b"b", b"b"])
    found = set(substrings.intervals(parts))
    assert {(3, 0, 1), (2, 0, 2), (1, 3, 4), (0, 0, 4)} <= found


def test_empty_table(documents):
    assert substrings.removed(documents([])).collect() == []
