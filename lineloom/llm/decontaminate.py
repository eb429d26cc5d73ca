"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a run of ``min_match`` words are a candidate (found through the set of
the benchmark's word seeds). For a candidate, tiles are laid: Karp-Rabin hashes of word windows find the longest
common runs of unmarked words, these are marked on both sides without overlap, and the window shrinks down to
``min_match``. The share of the item's words under tiles is its coverage; tiles may lie in any order, so a passage whose sentences
were reordered still reaches the threshold.

The benchmark is cut into blocks of bounded size; each block is broadcast and meets all documents, so a benchmark of
any size is compared whole.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\w+")
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _TOKEN.findall((text or "").lower())


def _runs(marked: bytearray) -> list[tuple[int, int]]:
    """Maximal unmarked stretches."""
    out, start = [], 0
    for at in [i for i, m in enumerate(marked) if m] + [len(marked)]:
        if at > start:
            out.append((start, at))
        start = at + 1
    return out


def _windows(codes: list[int], marked: bytearray, size: int):
    """(hash, position) of every window of ``size`` unmarked words, by a rolling Karp-Rabin hash."""
    top = pow(_BASE, size - 1, _MOD)
    for lo, hi in _runs(marked):
        if hi - lo < size:
            continue
        h = 0
        for c in codes[lo : lo + size]:
            h = (h * _BASE + c) % _MOD
        yield h, lo
        for at in range(lo + 1, hi - size + 1):
            h = ((h - codes[at - 1] * top) * _BASE + codes[at + size - 1]) % _MOD
            yield h, at


def tiles(item: list[int], doc: list[int], min_match: int, start: int | None = None) -> list[tuple[int, int, int]]:
    """(position in item, position in doc, length) of greedy tiles of at least ``min_match`` words. Codes are positive."""
    in_item, in_doc, out = bytearray(len(item)), bytearray(len(doc)), []
    size = max(min_match, min(start or len(item), len(item)))
    while size >= min_match:
        table = defaultdict(list)
        for h, at in _windows(item, in_item, size):
            table[h].append(at)
        longest, found = size, []
        for h, d in _windows(doc, in_doc, size) if table else ():
            for i in table.get(h, ()):
                if item[i : i + size] != doc[d : d + size]:
                    continue
                n = size
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not in_item[i + n] and not in_doc[d + n]:
                    n += 1
                longest = max(longest, n)
                found.append((-n, i, d))
        if longest > 2 * size:
            size = longest  # long tiles first
            continue
        for n, i, d in sorted(found):
            n = -n
            if any(in_item[i : i + n]) or any(in_doc[d : d + n]):
                continue  # what is left of it comes again in the next round
            in_item[i : i + n] = in_doc[d : d + n] = b"\1" * n
            out.append((i, d, n))
        if all(in_item):
            break
        if not found:
            size = max(min_match, size // 2) if size > min_match else 0
    return out


class Items:
    """A block of the benchmark, ready to be compared with texts."""

    def __init__(self, rows: list[tuple[int, str]], min_match: int) -> None:
        self.min_match, self.items, self.seeds, self.short = min_match, [], defaultdict(list), defaultdict(list)
        self.codes: dict[str, int] = {}
        for item_id, text in rows:
            w = words(text)
            if not w:
                continue
            k, n = len(self.items), min(min_match, len(w))
            self.items.append((item_id, [self.codes.setdefault(x, len(self.codes) + 1) for x in w]))

            for gram in dict.fromkeys(zip(*[w[j:] for j in range(n)], strict=False)):
                (self.seeds if n == min_match else self.short)[gram].append(k)
        self.sizes = sorted({len(g) for g in self.short})

    def covered(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, words under tiles, words of the item) for each item that shares a seed with the text."""
        w, hits = words(text), defaultdict(list)
        m = self.min_match
        for size, seeds in [(m, self.seeds), *[(n, self.short) for n in self.sizes]]:
            grams = [w[j:] for j in range(size)]
            if not seeds or seeds.keys().isdisjoint(zip(*grams, strict=False)):
                continue
            for at, gram in enumerate(zip(*grams, strict=False)):
                for k in seeds.get(gram, ()):
                    hits[k].append(at)
        out = []
        for k, at in hits.items():
            item_id, item = self.items[k]
            size = min(m, len(item))
            doc, end = [], -1
            for a in at:  # only words under seeds can be in a tile; 0 keeps separate stretches apart
                if a > end and doc:
                    doc.append(0)
                doc += [self.codes.get(x, 0) for x in w[max(a, end) : a + size]]
                end = a + size
            out.append((item_id, sum(n for _, _, n in tiles(item, doc, size)), len(item)))
        return out


def blocks(benchmark: DataFrame, min_match: int, block_chars: int, id_col: str = "item_id", text_col: str = "text"):
    """The benchmark as ``Items`` of at most about ``block_chars`` characters each, one at a time on the driver."""
    plain = benchmark.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    chars = plain.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-chars // block_chars)
    for k in range(n):
        part = plain if n == 1 else plain.where(F.pmod(F.xxhash64("i", "t"), F.lit(2 * n)).isin(2 * k, 2 * k + 1))
        yield Items([tuple(r) for r in part.distinct().collect()], min_match)


def overlaps(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.8, block_chars: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_covered, n_words, coverage) for each row and item whose coverage is at least ``threshold``.

    Items of fewer than ``min_match`` words must occur whole; items without words match nothing, and null texts count as
    empty. Ids may be null or repeat: each row of ``docs`` is compared on its own. Rows of the benchmark that repeat both id and text
    count once. An empty table on either side gives an empty result; other columns are not read.
    """
    schema = "doc_id bigint, item_id bigint, n_covered bigint, n_words bigint, coverage double"
    spark, out = docs.sparkSession, None
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for items in blocks(benchmark, min_match, block_chars):
        sent = spark.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            items = sent.value
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for doc_id, t in zip(ids, batch.column(1), strict=True):
                    rows += [(doc_id, i, c, n, c / n) for i, c, n in items.covered(t.as_py()) if c >= threshold * n]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * 5, [pa.int64()] * 4 + [pa.float64()], strict=True)], ["doc_id", "item_id", "n_covered", "n_words", "coverage"])

        part = plain.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.8, block_chars: int = 16 << 20, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that cover a benchmark item. All columns stay; no shuffle; no id is needed."""
    for items in blocks(benchmark, min_match, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                yield batch.filter(pa.array([not any(c >= threshold * n for _, c, n in sent.value.covered(t.as_py())) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


