"""Removal of repeated substrings, exact on bytes, by maximal repeats of an enhanced suffix array.

A full suffix array of a corpus has a row per byte. This one is sparse: of all the k-byte seeds in a window of ``least`` bytes
the lowest by hash is the window's anchor, so equal windows have their anchor at the same place, and any repeat of
``least`` or more bytes holds an anchor that all its occurrences share. An anchor answers for the windows whose anchor it is, and for the strings of ``length``
bytes that start with them, so only its surroundings from the start of the first to the end of the last matter. They go through these steps:

1. anchors whose seed occurs once are done: no window with them repeats;
2. anchors with equal surroundings in several texts are done: all of the surroundings repeats;
3. what is left (the edges of repeats) is cut from the texts and grouped by seed. The parts to the right of
   the seed are sorted (suffix array) with their common prefixes. A stack scan of the prefixes yields the interval tree: each
   interval is a repeat with all its occurrences. Within an interval the parts to the left are compared in
   their order: where they differ (the repeat is left-diverse) it is maximal and ends, where they agree it extends. Left plus right extent
   tell which bytes around an occurrence are found around any other one.

A group that is too large for one task is split as a suffix array's bucket is, by more of the shared text: its members meet by the
part that windows of a narrower range of places share, until groups are small or share whole windows, whose
bytes then repeat without a look at them. A piece goes only where it has windows of its own: in text of a short period (a word again and again),
whose groups are the largest, an anchor answers for as many windows as the period has bytes, so its piece is not multiplied by all places of a window. Texts are known by two 64-bit hashes of their content, so copies of a text share their rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.llm.common import stored

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_SEED = 32  # bytes of a seed; a power of two
_PLACE = 26  # low bits of a packed hash that hold the place
#: So many windows are looked at together, which bounds memory and stays in the processor's cache.
_CHUNK = 1 << 15


def _seeds(a: np.ndarray) -> np.ndarray:
    """Hash of the ``_SEED`` bytes at each place, by doubling a polynomial hash."""
    h, step = _BYTE[a], 1
    while step < _SEED:
        h = h[:-step] * np.uint64(pow(_STEP, step, 1 << 64)) + h[step:]
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _lowest(p: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values that follow one another, by doubling."""
    span = 1
    while span * 2 <= width:
        p = np.minimum(p[:-span], p[span:])
        span *= 2
    return np.minimum(p[: len(p) - width + span], p[width - span :])


def _runs(a: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first windows, last windows, anchors, seed hashes) of the runs of windows that have one anchor. Texts stand one after another in ``a``, up to ``ends``; no window crosses an end."""
    n_windows, width = len(a) - length + 1, length - _SEED + 1
    starts = np.r_[0, ends[:-1]]
    long = ends - starts >= length
    # before and after the windows that lie in a text
    breaks = np.unique(np.r_[starts[long], ends[long] - length + 1])
    parts = [(np.empty(0, np.int64),) * 4]
    for at in range(0, n_windows, _CHUNK):
        count = min(_CHUNK, n_windows - at)
        h = _seeds(a[at : at + count + length - 1])
        p = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
        least = (_lowest(p, width) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        new = np.r_[True, least[1:] != least[:-1]]
        new[breaks[np.searchsorted(breaks, at) : np.searchsorted(breaks, at + count)] - at] = True
        first = np.flatnonzero(new)
        parts.append((first + at, np.r_[first[1:], count] - 1 + at, least[first] + at, h[least[first]].view(np.int64)))
    first, last, anchor, core = (np.concatenate(x) for x in zip(*parts, strict=True))
    inside = first + length <= ends[np.minimum(np.searchsorted(ends, first, "right"), len(ends) - 1)] if len(first) else np.zeros(0, bool)
    first, last, anchor, core = first[inside], last[inside], anchor[inside], core[inside]
    # chunks part runs
    whole = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]][: len(anchor)])
    return first[whole], last[np.r_[whole[1:], len(last)] - 1] if len(whole) else last, anchor[whole], core[whole]


def runs(text: bytes, length: int) -> list[tuple[int, int, int, int]]:
    """(first window, last window, anchor, seed hash) of each run of windows of a text that have one anchor."""
    found = _runs(np.frombuffer(text, np.uint8), np.array([len(text)]), length)
    return list(zip(*(x.tolist() for x in found), strict=True))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, k1, k2): null texts are empty; the keys are hashes of the content."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    return plain.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(1), "text", F.length("text")))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where the values of a column without nulls begin and end, one more than there are, and the bytes they are in."""
    column = column.cast(pa.large_binary())
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return at, memoryview(data if data is not None else b"")


def anchors(keyed: DataFrame, length: int, least: int) -> DataFrame:
    """(k1, k2, a, n_left, n_right, core, class): every text's anchors, how far their surroundings go, hashes of seed and surroundings.

    ``n_right`` is how far they would go if the text were long enough, which tells where the last window of an anchor starts: ``length`` bytes before.
    """

    def run(batches):
        for batch in batches:
            at, data = _bytes_of(batch.column(0))
            k1, k2 = (batch.column(c).to_numpy() for c in (1, 2))
            a = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
            first, last, anchor, core = _runs(a, at[1:] - at[0], least)
            row = np.searchsorted(at[1:] - at[0], first, "right")
            left, start = anchor - first, first + at[0]
            stop = np.minimum(start + (last - first) + length, at[row + 1])
            whole = [xxhash.xxh3_64_intdigest(data[x:y], n) for x, y, n in zip(start.tolist(), stop.tolist(), left.tolist(), strict=True)]
            columns = (k1[row], k2[row], (anchor + at[0] - at[row]).astype(np.int32), left.astype(np.int16), (last + length - anchor).astype(np.int16), core, np.array(whole, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k1", "k2", "a", "n_left", "n_right", "core", "class"])

    if length >= 1 << 15:
        raise ValueError("length must be below 32768")
    return keyed.select("text", "k1", "k2").mapInArrow(run, "k1 bigint, k2 bigint, a int, n_left smallint, n_right smallint, core bigint, class bigint")


def _common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    diff = int.from_bytes(x[:n]) ^ int.from_bytes(y[:n])
    return n - (diff.bit_length() + 7) // 8


def intervals(sorted_parts: list[bytes]) -> list[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals of two or more parts, deeper ones before those around them."""
    out, stack, n = [], [(0, 0)], len(sorted_parts)
    for i in range(1, n + 1):
        depth = _common(sorted_parts[i - 1], sorted_parts[i]) if i < n else -1
        first = i - 1
        while stack and depth < stack[-1][0]:
            d, first = stack.pop()
            out.append((d, first, i - 1))
        if depth >= 0 and (not stack or depth > stack[-1][0]):
            stack.append((depth, first))
    return out


def _elsewhere(extent: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each of a sorted row of parts, its longest common prefix with a part of another owner; ``extent`` is between neighbours."""
    change = owner[1:] != owner[:-1]

    def one_way(extent, change):
        # the least so far, anew for each run of one owner: later runs are set lower
        at = np.r_[0, np.cumsum(change)]
        near = np.minimum.accumulate(np.r_[0, np.where(at[1:] > 0, extent, 0)] - (at << 32)) + (at << 32)
        return near

    return np.maximum(one_way(extent, change), one_way(extent[::-1], change[::-1])[::-1])


class _Least:
    """The least of any stretch of values, from the least of all stretches of 1, 2, 4 and so on."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 1 << len(self.rows) <= len(values):
            half = 1 << len(self.rows) - 1
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))
        self.at = np.cumsum([0, *map(len, self.rows)])
        self.flat = np.concatenate(self.rows)

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of values[lo:hi], none of them empty."""
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        at = self.at[k]
        return np.minimum(self.flat[at + lo], self.flat[at + hi - (1 << k)])


def repeated(left: list[bytes], right: list[bytes], width: int, owner: list | None = None) -> list[list[tuple[int, int, bool]]]:
    """For each occurrence (l, r, other): l bytes to the left and r to the right, ``width`` or more together, recur around another occurrence.

    ``left`` reads away from the shared middle, as ``right`` does. ``other`` says that the occurrence is another ``owner``'s; without
    owners each occurrence is its own. What lies within a longer entry of the same kind is left out.
    """
    n = len(left)
    out: list[list[tuple[int, int, bool]]] = [[] for _ in left]
    order = sorted(range(n), key=right.__getitem__)
    by_left = sorted(range(n), key=left.__getitem__)
    along = np.array([_common(left[x], left[y]) for x, y in zip(by_left, by_left[1:], strict=False)], np.int64)
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    in_order, longest = rank[order], max(map(len, left), default=0)
    least = _Least(along)
    number = {x: i for i, x in enumerate(dict.fromkeys(owner))} if owner is not None else {}
    who = None if len(number) in (0, n) else np.array([number[owner[x]] for x in by_left])
    # by rank: the longest left extent so far; deeper intervals come first, so a shorter or equal one lies within a longer entry
    known = {True: np.full(n, -1), False: np.full(n, -1)}
    for depth, first, last in intervals([right[x] for x in order]):
        if last == first or depth + longest < width:
            continue
        members = np.sort(in_order[first : last + 1])
        extent = least.between(members[:-1], members[1:])  # left extension, neighbour by neighbour
        best = np.r_[extent, 0]
        best[1:] = np.maximum(best[1:], extent)
        if who is None:
            other = best
        else:
            of = who[members]
            other = _elsewhere(extent, of) if (of != of[0]).any() else np.full(len(best), -1)
        for is_other, reach in ((True, other), (False, best)):
            fresh = (reach > known[is_other][members]) & (depth + reach >= width)
            for k, x in zip(members[fresh].tolist(), reach[fresh].tolist(), strict=True):
                out[by_left[k]].append((x, depth, is_other))
                known[is_other][k] = x
                known[False][k] = max(known[False][k], x)
    return out


def pieces(wanted: DataFrame, length: int) -> DataFrame:
    """(g, k1, k2, a, lone, n_left, low, bytes): the surroundings of wanted anchors; ``g`` is the seed's hash, ``low`` how far left of the anchor its last window starts."""

    def run(batches):
        for batch in batches:
            at, data = _bytes_of(batch.column(0))
            asked = batch.column(3)
            row = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy())
            core, a, left, right, lone = (asked.flatten().field(c) for c in ("core", "a", "n_left", "n_right", "lone"))
            place, n_left, n_right = (x.to_numpy().astype(np.int64) for x in (a, left, right))
            start, stop = at[row] + place - n_left, np.minimum(at[row] + place + n_right, at[row + 1])
            around = pa.array([bytes(data[x:y]) for x, y in zip(start.tolist(), stop.tolist(), strict=True)], pa.binary())
            k1, k2 = (batch.column(c).take(pa.array(row)) for c in (1, 2))
            low = pa.array((length - n_right).astype(np.int32))
            yield pa.RecordBatch.from_arrays([core, k1, k2, a, lone, left.cast(pa.int32()), low, around], ["g", "k1", "k2", "a", "lone", "n_left", "low", "bytes"])

    schema = "g bigint, k1 bigint, k2 bigint, a int, lone boolean, n_left int, low int, bytes binary"
    return wanted.select("text", "k1", "k2", F.col("asked").cast("array<struct<a:int,core:bigint,n_left:int,n_right:int,lone:boolean>>").alias("asked")).mapInArrow(run, schema)


#: What tells a group: hash of the shared part, the range of the anchor's places in a window, the window's width.
GROUP = ("g", "o1", "o2", "width")
_SPAN = "k1 bigint, k2 bigint, a int, lo int, hi int, other boolean"


def _spans_of(group: list[tuple], o1: int, o2: int, width: int, least: int):
    """Yields (k1, k2, a, lo, hi, other) of what repeats around the lone pieces (k1, k2, a, lone, n_left, bytes) of a group."""
    by_middle: dict[bytes, list[tuple]] = {}
    for g in {x[:3]: x for x in group}.values():  # rows that repeat id and text bring a piece twice
        by_middle.setdefault(g[5][g[4] - o1 : g[4] - o2 + width], []).append(g)
    for middle, same in by_middle.items():
        if len(same) < 2:
            continue
        left = [g[5][: g[4] - o1][::-1] for g in same]
        right = [g[5][g[4] - o1 + len(middle) :] for g in same]
        for g, found in zip(same, repeated(left, right, least - len(middle), [x[:2] for x in same]), strict=True):
            if g[3]:
                at = g[2] - o1
                for x, y, other in found:
                    yield *g[:3], at - x, at + len(middle) + y, other


def compare(cut_pieces: DataFrame, least: int) -> DataFrame:
    """(k1, k2, a, lo, hi, other): spans that recur in another piece of the group. The pieces of a group meet in one task."""

    def run(batches):
        group, key = [], None

        def told(spans):
            columns = list(zip(*spans, strict=True)) if spans else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["k1", "k2", "a", "lo", "hi", "other"])

        for batch in batches:
            spans = []
            keys = zip(*[batch.column(c).to_pylist() for c in GROUP], strict=True)
            rows = zip(*[batch.column(c).to_pylist() for c in ("k1", "k2", "a", "lone", "n_left", "bytes")], strict=True)
            for now, row in zip(keys, rows, strict=True):
                if now != key:
                    if len(group) > 1:
                        spans += _spans_of(group, *key[1:], least)
                    group, key = [], now
                group.append(row)
            yield told(spans)
        if len(group) > 1:
            yield told(list(_spans_of(group, *key[1:], least)))

    return cut_pieces.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, _SPAN)


def narrowed(cut_pieces: DataFrame, length: int, least: int) -> DataFrame:
    """Pieces of groups that are too large, in smaller ones: windows of half the places, or from ``least`` bytes on those of ``length`` that start there.

    A piece goes where windows of its own are.
    """

    def run(batches):
        for batch in batches:
            names = [*GROUP, "k1", "k2", "a", "lone", "n_left", "low", "bytes"]
            out = [[] for _ in names]
            for _, o1, o2, width, k1, k2, a, lone, left, low, data in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if o1 < o2:
                    ranges = [(o1, (o1 + o2) // 2, width), ((o1 + o2) // 2 + 1, o2, width)]
                else:
                    ranges = [(o1, o1, length)]
                for p, q, w in ranges:
                    if max(p, low, w - (len(data) - left)) <= min(q, left):
                        g = _signed(xxhash.xxh3_64_intdigest(data[left - p : left - q + w], p))
                        for column, value in zip(out, (g, p, q, w, k1, k2, a, lone, left, low, data), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, [batch.schema.field(n) for n in names], strict=True)], names)

    schema = "g bigint, o1 int, o2 int, width int, k1 bigint, k2 bigint, a int, lone boolean, n_left int, low int, bytes binary"
    return cut_pieces.select(*GROUP, "k1", "k2", "a", "lone", "n_left", "low", "bytes").mapInArrow(run, schema)


def repeated_spans(keyed: DataFrame, length: int = 400, least: int = 256, group_rows: int = 1 << 16) -> DataFrame:
    """(k1, k2, lo, hi, other): byte spans that recur elsewhere, all that are maximal in an anchor's surroundings. ``hi`` may lie behind the end of the text, where the span ends.

    Every string of ``least`` up to ``length`` bytes that occurs twice lies within a span. ``other`` says that the other place is in another text or in a copy.
    """
    place = ("k1", "k2", "a")
    # copies of a text count and go on as one row
    per_text = stored(anchors(keyed, length, least).groupBy("core", "class", *place, "n_left", "n_right").agg(F.count("*").alias("n")), "anchors")
    cores = stored(per_text.groupBy("core").agg(F.sum("n").alias("n")).where("n > 1").select("core"), "cores")
    twice = stored(per_text.join(cores, "core"), "twice")
    # texts and places go by hashes of theirs, so that aggregations stay in hash maps
    the_text, the_place = F.xxhash64("k1", "k2"), F.xxhash64(*place)
    several = (F.min(the_text) != F.max(the_text)) | (F.max("n") > 1)
    classes = stored(twice.groupBy("core", "class").agg(several.alias("done"), F.count("*").alias("n"), F.min(the_place).alias("x")), "classes")
    lo, hi = (F.col("a") - F.col("n_left")).alias("lo"), (F.col("a") + F.col("n_right")).alias("hi")
    more = classes.where("done or n > 1").select("core", "class", "done", "x")
    member = stored(twice.join(more, ["core", "class"]).select("core", "class", *place, "n_left", "n_right", "done", (the_place == F.col("x")).alias("first")), "members")
    whole = member.select("k1", "k2", lo, hi, F.col("done").alias("other"))
    # a class in one text only sends its first place; what is found there in other texts holds at all its places
    alone = member.where("not done")
    again = alone.where("first").select("core", "class", *place).join(alone.where("not first").select("core", "class", F.col("a").alias("at")), ["core", "class"]).select(*place, "at")
    # seeds with one class have nothing left to compare; elsewhere a done class sends a piece, too, for others to be compared with
    mixed = stored(classes.groupBy("core").agg(F.count("*").alias("m")).where("m > 1").select("core"), "mixed")
    left = classes.join(mixed, "core").select("core", "class", "done", "x")
    asked = twice.join(left, ["core", "class"]).where(the_place == F.col("x"))
    asked = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "core", "n_left", "n_right", (~F.col("done")).alias("lone"))).alias("asked"))
    # of the copies of a text one row is enough; the least id is taken, nulls first
    one = keyed.select("k1", "k2", "doc_id").groupBy("k1", "k2").agg(F.min(F.struct("doc_id")).alias("first"))
    asked = stored(asked.join(one, ["k1", "k2"]).select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), "asked", F.col("first.doc_id").alias("first_id")), "asked")
    # the id is part of the key, so that the copies of a text are dealt to many tasks
    wanted = keyed.join(asked, (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    level = stored(pieces(wanted, length).select("g", F.lit(0).alias("o1"), F.lit(least - _SEED).alias("o2"), F.lit(least).alias("width"), *place, "lone", "n_left", "low", "bytes"), "pieces")
    out = None
    while True:
        big = stored(level.groupBy(*GROUP).agg(F.count("*").alias("m"), (F.min(the_text) != F.max(the_text)).alias("other"), (F.min(the_place) != F.max(the_place)).alias("twice")).where(F.col("m") > group_rows), "large")
        last = big.isEmpty()
        found = compare(level if last else level.join(big, list(GROUP), "left_anti"), least)
        out = found if out is None else out.unionByName(found)
        if last:
            break
        deep = stored(level.join(big, list(GROUP)), "deep")
        start = F.col("a") - F.col("o1")
        out = out.unionByName(deep.where("o1 = o2 and lone and twice").select(*place, start.alias("lo"), (start + F.col("width")).alias("hi"), "other"))
        level = stored(narrowed(deep.where((F.col("o1") < F.col("o2")) | (F.col("width") < length)), length, least), "pieces")
    out = stored(out, "found")
    moved = out.where("other").join(again, list(place)).select("k1", "k2", (F.col("lo") - F.col("a") + F.col("at")).alias("lo"), (F.col("hi") - F.col("a") + F.col("at")).alias("hi"), "other")
    return whole.unionByName(out.drop("a")).unionByName(moved)


def _merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _whole_words(text: bytes, lo: int, hi: int) -> int:
    """Words that lie in a span with both ends."""
    n = len(text[lo:hi].split())
    cut_first = lo > 0 and not text[lo - 1 : lo].isspace() and not text[lo : lo + 1].isspace()
    cut_last = hi < len(text) and not text[hi : hi + 1].isspace() and not text[hi - 1 : hi].isspace()
    return max(0, n - cut_first - cut_last)


def removed(docs: DataFrame, length: int = 400, least: int = 256, passage_words: int = 50, group_rows: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, spans (removed byte ranges, merged).

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else, in the same or another row, judged on the
    input. ``n_passages`` removes nothing: it counts the maximal runs of bytes under strings of ``least`` bytes that also start in another row
    which hold more than ``passage_words`` whole words. Null and short texts lose nothing; rows that repeat a text all lose it whole. Ids may be null or
    repeat; an empty table gives an empty result; other columns are not read.
    """
    least = min(least, length)
    keyed = _keyed(docs, id_col, text_col)
    spans = stored(repeated_spans(keyed, length, least, group_rows).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi", "other")).alias("spans")), "spans")
    both = keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for t, found in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
                text = t.as_py()
                all_spans = [x | {"hi": min(x["hi"], len(text))} for x in found.as_py() or ()]
                merged = _merged((x["lo"], x["hi"]) for x in all_spans if x["hi"] - x["lo"] >= length)
                passages = sum(_whole_words(text, lo, hi) > passage_words for lo, hi in _merged((x["lo"], x["hi"]) for x in all_spans if x["other"]))
                kept, at = hashlib.sha256(), 0
                for lo, hi in merged:
                    kept.update(text[at:lo])
                    at = hi
                kept.update(text[at:])
                values = (len(text), sum(hi - lo for lo, hi in merged), len(merged), kept.hexdigest(), passages, [{"lo": lo, "hi": hi} for lo, hi in merged])
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "spans"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, spans array<struct<lo:int,hi:int>>")
