"""Near-duplicate documents by SimHash, linked through deletion-variant signatures; and groups of like shingle sets.

A pair of 64-bit fingerprints that differs in at most ``distance`` bits is found through segments: cut into
``distance // 2 + 1`` segments, at least one segment of such a pair differs in at most one bit. Every segment is indexed
under each of its one-wildcard variants (the segment with one bit masked out), so the pair meets in an equality
join, and the whole fingerprints are then compared.

Only distinct fingerprints take part, so exact copies (and all texts of equal shingles) never meet as pairs. Families of near copies are
contracted before pairs are made: under each variant all fingerprints are compared with the one of the least document, and after that
only fingerprints meet that are not yet in one component.

``similar_groups`` serves the pipeline, whose near copies are texts of a Jaccard similarity of 0.8 or more on sets of five words. Its families come from the same
fingerprints and signatures; their sets are then compared whole. At a similarity of 0.8 a SimHash pair differs in 15 % of its bits, which no few segments with one
wildcard catch, so sets that are not in one family yet meet once more in MinHash bands; see the README.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.llm.common import components, per_batch, scratch, sieved, sifted, stored

BITS = 64
#: Hashes are taken and counted in blocks of so many shingles, which bounds memory on very long texts.
BLOCK = 1 << 16


def _ones(hashes: bytes) -> np.ndarray:
    """How many of the big-endian 64-bit hashes have each bit (least significant first) set."""
    bits = np.unpackbits(np.frombuffer(hashes, ">u8").astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255  # so many ones still fit a byte
    ones = bits[whole:].sum(axis=0, dtype=np.int64)
    return ones + bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of ``text``; 0 without words. A bit is 1 if set in over half of the hashes."""
    words = (text or b"").lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    digest, joined = xxhash.xxh64_digest, b" ".join(words)
    if len(words) <= width:
        return int.from_bytes(digest(joined, seed))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1)
    starts = (ends - sizes - 1)[: len(words) - width + 1].tolist()
    ends = (ends[width - 1 :] - 1).tolist()
    n, ones = len(starts), np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        ones += _ones(b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)]))
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's text as a signed bigint. Null text counts as empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.large_binary())
        fp = np.fromiter((fingerprint(t.as_py(), width, seed) for t in texts), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(per_batch(run), "doc_id bigint, fp bigint")


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one holds at most one of ``distance`` differing bits."""
    n = distance // 2 + 1
    cuts = [BITS * k // n for k in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _variants(fp: Column, parts: list[tuple[int, int]]) -> Column:
    """array<bigint>: each segment with each of its bits masked out, over the number of the masked bit."""
    out = []
    for lo, width in parts:
        part = F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << min(width, 63)) - 1)) if width < BITS else fp
        for bit in range(width):
            gap = ~(1 << bit) if bit < 63 else (1 << 63) - 1
            out.append(F.shiftleft(part.bitwiseAND(F.lit(gap)), 8).bitwiseOR(F.lit(lo + bit)))
    return F.array(*out)


def _met_first(x: Column, parts: list[tuple[int, int]], key: Column) -> Column:
    """Whether ``key`` is the first variant under which a pair with the differing bits ``x`` meets."""
    first = F.lit(None).cast("bigint")
    for lo, width in reversed(parts):
        diff = F.shiftrightunsigned(x, lo).bitwiseAND(F.lit((1 << min(width, 63)) - 1)) if width < BITS else x
        at = F.when(diff == 0, F.lit(lo)).when(diff < 0, F.lit(lo + BITS - 1)).otherwise(F.lit(lo) + F.bit_count(diff - 1))  # diff has one bit, so this counts the zeros below it
        first = F.when(F.bit_count(diff) <= 1, at.cast("bigint")).otherwise(first)
    return key.bitwiseAND(F.lit(255)) == first


def index(classes: DataFrame, distance: int = 4) -> DataFrame:
    """``classes`` with a row per variant of ``fp`` and its ``key``."""
    return classes.withColumn("key", F.explode(_variants(F.col("fp"), segments(distance))))


def pairs(indexed: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b, bits): rows of an index whose fingerprints differ in 1 to ``distance`` bits, each pair once, by their ``rep``, or by ``fp`` in an index without it.

    Pairs of one ``root`` are left out where the index has that column. The comparison of whole fingerprints is part of the join, so only links leave it.
    """
    l, r = (indexed.select(*[F.col(c).alias(f"{c}_{k}") for c in indexed.columns]) for k in "12")
    x = F.col("fp_1").bitwiseXOR(F.col("fp_2"))
    name = "rep" if "rep" in indexed.columns else "fp"
    near = (F.col(f"{name}_1") < F.col(f"{name}_2")) & (F.bit_count(x) <= distance) & _met_first(x, segments(distance), F.col("key_1"))
    if "root" in indexed.columns:
        near = near & (F.col("root_1") != F.col("root_2"))
    return l.join(r, (F.col("key_1") == F.col("key_2")) & near).select(F.col(f"{name}_1").alias("a"), F.col(f"{name}_2").alias("b"), F.bit_count(x).alias("bits"))


def links(classes: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b, bits): representatives of distinct fingerprints that differ in 1 to ``distance`` bits, each pair once.

    ``classes`` has rep and fp (bigint), not null, one row per fingerprint.
    """
    return pairs(index(classes.select("rep", "fp"), distance), distance)


def ties(classes: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): pairs of representatives that have the components of all links, without all the links of a family.

    Under a key of two rows the pair is compared in the aggregation that finds it. Under any other, all rows are compared with the least
    fingerprint, and then only those of different components with each other. A key's rows are never brought to one task: its least and
    its greatest come from an aggregation, and joins split hot keys. Index rows carry fingerprints alone; representatives are looked up for the ties at the end.
    """
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    with scratch(classes.sparkSession) as kept:
        rows = index(classes.select("fp"), distance)
        keys = stored(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where((F.col("n") > 2) | ((F.col("n") == 2) & near("lo", "hi"))), "keys")
        twos = keys.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        many = keys.where("n > 2").select("key", "lo")
        met = stored(sifted(rows, "key", many.select("key")).join(many.hint("merge"), "key"), "met")  # the keys grow with the data, so they are never broadcast
        spokes = met.where((F.col("fp") != F.col("lo")) & near("fp", "lo")).select(F.col("fp").alias("a"), F.col("lo").alias("b"))
        roots = stored(components(twos.union(spokes)), "roots")
        rooted = stored(met.select("key", "fp").join(roots, F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("component", "fp").alias("root")), "rooted")
        several = stored(rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("greatest")).where("least <> greatest").select("key"), "several")
        last = pairs(stored(rooted.join(several, "key", "left_semi"), "open"), distance)
        found = roots.where("node <> component").select(F.col("node").alias("x"), F.col("component").alias("y")).union(last.select(F.col("a").alias("x"), F.col("b").alias("y")))
        a, b = (classes.select(F.col("fp").alias(k), F.col("rep").alias(name)) for k, name in (("x", "a"), ("y", "b")))
        return kept(found.join(a, "x").join(b, "y").select("a", "b"), "ties")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp (bigint), component_id (the smallest doc_id reachable by links).

    Links join fingerprints at ``distance`` or fewer differing bits, equal ones included. Null and blank texts
    have fingerprint 0 and link like any other. A row whose id is null keeps its fingerprint, links with
    nothing and gets a null component. Rows that repeat an id are one node with all their fingerprints' links. An empty
    table gives an empty result; columns other than the id and the text are not read.
    """
    prints = stored(fingerprints(docs, width, seed, id_col, text_col), "prints")
    classes = stored(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    twice = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    same_id = prints.join(twice, "doc_id").join(classes, "fp").where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # one fingerprint per representative: of a document with several texts the least stands for the others, which same_id ties to it
    near = ties(classes, distance).where("a <> b")
    found = stored(components(near.union(same_id)), "components")
    roots = stored(classes.join(found, classes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "fps")
    known = prints.where("doc_id is not null").join(roots, "fp", "left").select("doc_id", "fp", "component_id")
    return known.union(prints.where("doc_id is null").select("doc_id", "fp", F.lit(None).cast("bigint")))


#: A shingle set's MinHash index: so many bands of so many values. Two sets of Jaccard J miss each other with (1 - J**ROWS)**BANDS: 0.0002 at 0.8.
ROWS, BANDS = 7, 36
_FACTORS = np.random.default_rng(20).integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of ``text``; of all words if they are fewer than ``width``, none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, joined = xxhash.xxh3_64_digest, b" ".join(words)
    if len(words) <= width:
        starts, ends = [0], [len(joined)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1)
        starts = (ends - sizes - 1)[: len(words) - width + 1].tolist()
        ends = (ends[width - 1 :] - 1).tolist()
    blocks = []
    for at in range(0, len(starts), BLOCK):
        blocks.append(np.unique(np.frombuffer(b"".join([digest(joined[s:e]) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)]), ">u8").astype(np.uint64)))
    return blocks[0] if len(blocks) == 1 else np.unique(np.concatenate(blocks))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key per band of the set's MinHash signature; sets meet where a key is equal. None for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 256):
        np.minimum(least, (low[at : at + 256, None] * _FACTORS).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")


def _set_hash(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def signatures(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, s, n, keys): fingerprint of each row's text, size and band keys of its shingle set; ``s`` is a hash of the whole set, so equal sets have one."""

    def one(text: bytes | None):
        found = shingle_set(text, width)
        return fingerprint(text), _set_hash(found), len(found), band_keys(found)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [one(t.as_py()) for t in batch.column(1).cast(pa.large_binary())]
        fp, s, n, keys = zip(*made, strict=True) if made else ([],) * 4
        columns = [pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(s, pa.int64()), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "fp", "s", "n", "keys"])

    return _texts(docs, id_col, text_col).mapInArrow(per_batch(run), "doc_id bigint, fp bigint, s bigint, n int, keys array<bigint>")


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(s, hashes) of the ``wanted`` sets (rep, s), made again from the texts of their representatives."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t.as_py(), width) for t in batch.column(0).cast(pa.large_binary())]
        mine = [i for i, (h, s) in enumerate(zip(sets, batch.column(1).to_pylist(), strict=True)) if _set_hash(h) == s]  # an id may repeat with another text
        return pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(mine, pa.int64())), pa.array([sets[i].view(np.int64) for i in mine], pa.list_(pa.int64()))], ["s", "hashes"])

    of = sifted(_texts(docs, id_col, text_col), "doc_id", wanted.select("rep")).join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id").select("text", "s")
    return of.mapInArrow(per_batch(run), "s bigint, hashes array<bigint>").groupBy("s").agg(F.first("hashes").alias("hashes"))


def like_sets(sets: list[np.ndarray], roots: list, sides: list[int], similarity: float) -> list[tuple[int, int]]:
    """Pairs (i, j) that tie sets of a Jaccard similarity of ``similarity`` or more: enough of them to span the components of all.

    Sets that already have one root are not compared, nor are two sets of side 1. Sets are bit masks over the shingles
    at hand, so a comparison is one AND of whole numbers.
    """
    flat, at = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.int64), return_inverse=True)
    masks, start = [], 0
    for x in sets:
        bits = np.zeros(len(flat) + 1, np.uint8)
        bits[at[start : start + len(x)]] = 1
        start += len(x)
        masks.append(int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"))
    up: dict = {}

    def top(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    order = sorted(range(len(sets)), key=lambda i: (-len(sets[i]), i))
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            a, b = len(sets[i]), len(sets[j])
            if b < similarity * a - 1e-9:
                break
            if sides[i] and sides[j]:
                continue
            x, y = top(roots[i]), top(roots[j])
            # |x & y| / (|x| + |y| - |x & y|) >= similarity
            if x != y and (masks[i] & masks[j]).bit_count() * (1 + similarity) >= similarity * (a + b) - 1e-9:
                up[x] = y
                out.append((i, j))
    return out


def _ties_of(similarity: float):
    def run(t: pa.Table) -> pa.Table:
        s = t.column("s").to_pylist()
        sets = [np.asarray(h.values if hasattr(h, "values") else h, np.int64) for h in t.column("hashes").combine_chunks()]
        roots, sides = t.column("root").to_pylist(), t.column("side").to_pylist()
        found = like_sets(sets, roots, sides, similarity)
        return pa.table({"a": pa.array([s[i] for i, _ in found], pa.int64()), "b": pa.array([s[j] for _, j in found], pa.int64())})

    return run


def compared(docs: DataFrame, posts: DataFrame, before: DataFrame | None, width: int, similarity: float, tile_rows: int, tile_shingles: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): ties of sets that meet under a key and have a Jaccard similarity of ``similarity`` or more, with the ties from ``before``.

    ``posts`` has key, s, n, rep and root, the component by ``before``. Keys whose sets are all in one component are left alone. The sets of a key are compared in tiles
    of bounded size: first within tiles, which ties most of a large family together, then across tiles only those that are not in their key's largest component. Keys with the same sets are one.
    """
    with scratch(docs.sparkSession) as kept:
        keys = posts.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("size"), F.bit_xor(F.xxhash64("s")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "s")).alias("y"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        tiles = F.greatest(F.ceil(F.col("m") / tile_rows), F.ceil(F.col("size") / tile_shingles)).cast("int")
        lists = stored(keys.groupBy("m", "size", "x", "y").agg(F.min("key").alias("key")).select("key", "m", tiles.alias("tiles")), "bands")
        met = stored(sifted(posts, "key", lists.select("key")).join(lists, "key").select("key", "m", "tiles", "s", "rep", "root"), "met")
        wanted = stored(met.select("rep", "s").distinct(), "wanted")
        sets = stored(whole_sets(docs, wanted, width, id_col, text_col), "sets")
        schema = "a bigint, b bigint"
        part = F.pmod(F.xxhash64("s"), F.col("tiles")).cast("int")
        inside = met.select("key", "s", part.alias("tile"), "root", F.lit(0).alias("side")).join(sets, "s")
        found = inside.groupBy("key", "tile").applyInArrow(_ties_of(similarity), schema)
        ties_ = stored(found if before is None else found.union(before), "ties")
        large = met.where("tiles > 1").drop("root")
        if not large.isEmpty():
            chained = stored(components(ties_), "chained")
            rooted = stored(large.join(chained, F.col("s") == F.col("node"), "left").select("key", "m", "tiles", "s", F.coalesce("component", "s").alias("root")), "rooted")
            most = rooted.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("t"))
            most = stored(most.select("key", F.col("t.root").alias("main"), F.col("t.n").alias("n_main")), "most")
            all_ = stored(rooted.join(most, "key").withColumn("others", F.ceil((F.col("m") - F.col("n_main")) * F.col("tiles") / F.col("m")).cast("int")).where("others > 0"), "across")
            lone = all_.where("root <> main").withColumn("i", F.pmod(F.xxhash64(F.lit(1), "s"), F.col("others")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            any_ = all_.withColumn("j", part).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
            both = lone.select("key", "i", "j", "s", "root", F.lit(0).alias("side")).union(any_.select("key", "i", "j", "s", "root", F.lit(1).alias("side"))).join(sets, "s")
            across = both.groupBy("key", "i", "j").applyInArrow(_ties_of(similarity), schema)
            ties_ = stored(ties_.union(across).where("a <> b"), "ties")
        return kept(ties_, "ties")


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, tile_rows: int = 512, tile_shingles: int = 1 << 18, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of documents whose sets of word shingles have a Jaccard similarity of ``similarity`` or more, linked in chains.

    Families are the components of fingerprints at ``distance`` or fewer differing bits, by deletion-variant signatures (``ties``). Sets that the check of families leaves
    apart meet again where they share a band of their MinHash signatures. Every link is verified on the whole shingle sets. Documents of equal sets (all those without
    words are such) are one node. Rows with a null
    id are left out; rows that repeat an id are one node; an empty table gives an empty result; other columns are not read.
    """
    limits = (width, similarity, tile_rows, tile_shingles, id_col, text_col)
    with scratch(docs.sparkSession) as kept:
        with scratch(docs.sparkSession) as passed:  # tables with band keys go as soon as the next one is there
            made = stored(signatures(docs, width, id_col, text_col), "signatures")
            found = passed(made.select("doc_id", "s"), "found")
            classes = stored(made.groupBy("s").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("keys").alias("keys")), "classes")
            prints = stored(classes.select("fp").distinct().select("fp", F.col("fp").alias("rep")), "prints")
            families = stored(components(ties(prints, distance)), "families")
            family = classes.join(families, F.col("fp") == F.col("node"), "left").select(F.coalesce("component", "fp").alias("key"), "s", "n", "rep", F.col("s").alias("root"))
            tied = passed(compared(docs, family, None, *limits), "tied")
            roots = stored(components(tied), "roots")
            classes = passed(classes.join(roots, F.col("s") == F.col("node"), "left").select("keys", "s", "n", "rep", F.coalesce("component", "s").alias("root")), "rooted")
        ties_ = compared(docs, classes.select(F.explode("keys").alias("key"), "s", "n", "rep", "root"), tied, *limits)
        ids = found.groupBy("doc_id").agg(F.min("s").alias("a"), F.max("s").alias("top")).where("a <> top").select("doc_id", "a")
        same_id = found.join(ids, "doc_id").where("s <> a").select("a", F.col("s").alias("b"))
        tied = stored(components(ties_.union(same_id)), "tied")
        whole = stored(classes.select("s", "rep").join(tied.withColumnRenamed("node", "s"), "s", "left").withColumn("component", F.coalesce("component", "s")), "whole")
        least = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
        roots = whole.join(least, "component").select("s", "component_id")
        return kept(found.join(roots, "s").select("doc_id", "component_id"), "groups")


def deduplicate(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near copies left: the one with the smallest doc_id. All columns are kept.

    Null and blank texts are one group. Rows with a null doc_id are in no group and stay. Of rows that repeat a kept doc_id, all stay. An
    empty table gives an empty result.
    """
    with scratch(docs.sparkSession) as kept:
        found = similar_groups(docs, width, similarity)
        gone = kept(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    # ids that go grow with the documents, so they are never broadcast; a sieve of them spares the texts of the others the shuffle
    told = sieved(docs, "doc_id", gone, "_gone")
    return told.where("not _gone").drop("_gone").union(told.where("_gone").drop("_gone").join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns))
