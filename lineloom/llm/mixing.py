"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Every source's texts form streams of words: its documents are dealt by hash over shards of bounded size and stand in
seeded order within a shard. Streams are cut into blocks of equally many words. The highest quotients
``target / (2 * seat + 1)`` give the sources whole numbers of blocks, and in the same way each source's blocks are
apportioned to its shards by their size. A shard takes its quota as whole passes over its blocks
plus a seeded run of consecutive blocks (around the end if need be), so no block is taken more often than the cap.

Seats are not dealt one by one: rounding ``weight * seats / total`` misses the sum by half a seat per party at most, so
only the seats around that rounding are ranked, about ten per party.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.llm.common import WORD, stored


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size): words of each row's text; null texts have none."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )


def targets(counts: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size, target): one row per source, by water filling.

    Sources in order of code points, null last, have the weights in turn. Targets share the total of all sizes by weight and
    stop at ``cap`` times the source's size; what is above goes to the others by weight until none is above. The level of that
    is found in one pass over sources sorted by the level at which they are full.
    """
    by_source = counts.groupBy("source").agg(F.sum("size").alias("source_size"))
    everyone, in_turn = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(int(x)) for x in weights]), (F.row_number().over(in_turn) - 1) % len(weights)).cast("bigint")
    s = by_source.withColumn("weight", w).withColumn("most", F.col("source_size") * cap)
    s = s.withColumn("full_at", F.col("most").cast("double") / F.col("weight"))
    full = everyone.orderBy("full_at", F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("most").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("level", (F.sum("source_size").over(everyone) - below).cast("double") / F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", F.col("source").isNull().alias("last"), "source", "level"))).over(everyone)["level"])
    return s.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def apportion(parties: DataFrame, group: Sequence[str], party: Sequence[str], weight: str, seats: str, most: str) -> DataFrame:
    """``parties`` with ``quota``: Sainte-Lague seats within each group, at most ``most`` for a party.

    Columns ``weight`` (double) and ``seats`` (bigint, the same within a group) decide; ties go to the party that sorts first.
    """
    of = Window.partitionBy(*[F.col(c) for c in group]) if group else Window.partitionBy(F.lit(0))
    total, n = F.sum(weight).over(of), F.count("*").over(of)
    ideal = F.when(total > 0, F.col(weight) * F.col(seats) / total).otherwise(F.lit(0.0))
    spread = F.when(total > 0, F.ceil(F.lit(1.5) * n * F.col(weight) / total)).otherwise(F.lit(0)).cast("bigint") + 2
    p = parties.withColumn("_near", F.floor(ideal + 0.5).cast("bigint")).withColumn("_spread", spread)
    p = p.withColumn("_sure", F.least(F.greatest(F.col("_near") - F.col("_spread"), F.lit(0).cast("bigint")), F.col(most)))
    p = p.withColumn("_open", F.col(seats) - F.sum("_sure").over(of))
    some = p.where((F.col("_near") + F.col("_spread") > F.col("_sure")) & (F.col(most) > F.col("_sure")) & (F.col(weight) > 0))
    seat = some.withColumn("_seat", F.explode(F.sequence(F.col("_sure"), F.least(F.col("_near") + F.col("_spread"), F.col(most)) - 1)))
    ranked = of.orderBy((F.col(weight) / (2 * F.col("_seat") + 1)).desc(), *[F.col(c).asc_nulls_last() for c in party], "_seat")
    won = seat.withColumn("_rank", F.row_number().over(ranked)).where("_rank <= _open")
    keys = [*group, *party]
    more = won.groupBy(*keys).agg(F.count("*").alias("_more")).withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same: Column = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return p.join(more, same, "left").select(*parties.columns, (F.col("_sure") + F.coalesce("_more", F.lit(0))).alias("quota"))


def _draw(*parts: Column | str) -> Column:
    """A non-negative bigint from a hash of strings, the same in every SQL engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, block_words: int = 256, shard_words: int = 1 << 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken (words taken, repeats counted).

    ``taken`` is at most ``cap`` times the size. Blocks have ``block_words`` words, fewer where the least target needs it (two hundred blocks
    for the smallest). Null sources are one source of their own, null and blank texts have size 0 and take 0; ids may be null or
    repeat, as rows are dealt by id and counted on their own. An empty table gives an empty result. The same rows give
    the same result, whatever their order or partitions.
    """
    counts = stored(word_counts(docs, id_col, text_col, source_col), "counts")
    everyone = Window.partitionBy(F.lit(0))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everyone)
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(least / 200))).cast("bigint")
    t = targets(counts, weights, cap).withColumn("block", F.coalesce(block, F.lit(1).cast("bigint")))
    t = t.withColumn("seats", F.round(F.sum("source_size").over(everyone) / F.col("block")).cast("bigint")).withColumn("most", cap * F.ceil(F.col("source_size") / F.col("block")))
    t = stored(apportion(t, [], ["source"], "target", "seats", "most").withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(shard_words))).cast("bigint")), "targets")
    s = t.select(F.col("source").alias("s_source"), "source_size", "target", "block", F.col("quota").alias("source_quota"), "shards")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # few rows, one per source: their number is checked before they are broadcast
    small = F.broadcast(s) if s.count() <= 10_000 else s
    dealt = counts.join(small, F.col("source").eqNullSafe(F.col("s_source"))).withColumn("shard", _draw(F.lit(str(seed)), ident) % F.col("shards")).withColumn("turn", F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), ident)))
    per_shard = dealt.groupBy("s_source", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota"), F.first("block").alias("block"))
    per_shard = per_shard.withColumn("blocks", F.ceil(F.col("words") / F.col("block"))).withColumn("most", cap * F.col("blocks")).withColumn("weight", F.col("words").cast("double"))
    quotas = apportion(per_shard, ["s_source"], ["shard"], "weight", "source_quota", "most")
    quotas = quotas.where("blocks > 0").select(
        F.col("s_source").alias("q_source"),
        F.col("shard").alias("q_shard"),
        F.expr("quota div blocks").alias("passes"),
        (_draw(F.lit(f"{seed}-start"), F.coalesce("s_source", F.lit("")), F.col("shard").cast("string")) % F.col("blocks") * F.col("block")).alias("from_word"),
        (F.col("quota") % F.col("blocks") * F.col("block")).alias("run_words"),
        (F.col("blocks") * F.col("block")).alias("around"),
    )
    stream = Window.partitionBy("s_source", "shard").orderBy("turn", "doc_id", "size")
    placed = dealt.withColumn("end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("size"))
    both = placed.join(quotas, F.col("s_source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")), "left")
    meet = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("end"), hi) - F.greatest(F.col("start"), lo))
    stop = F.col("from_word") + F.col("run_words")
    taken = F.col("size") * F.col("passes") + meet(F.col("from_word"), stop) + meet(F.lit(0), stop - F.col("around"))
    return both.select("doc_id", F.col("source"), "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("bigint").alias("taken"))
