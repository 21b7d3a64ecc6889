"""Mixing sources to target weights, in DataFrame functions only.

Tokens (words here) of each source are packed, document after document, into
blocks of fixed length. Each output shard draws how many of its slots each source
gets, a multinomial draw; a source's slots are numbered through all shards, and
slot k stands for block p(k mod n) of the source's n blocks, p a pseudorandom
permutation of the indexes that is computed, never stored. Blocks then meet
documents by an equi-join on (source, block index).

Draws miss a source's target by chance, so slots that a source drew beyond its
target go, in order, to the sources that drew too few: totals are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

#: Weights of the sources in order of their names, repeated.
WEIGHTS = (5, 2, 1)


@dataclass(frozen=True)
class MixRules:
    """weights: dealt to the sources by name order. block: words in a block. shard: slots of an output shard.
    most: times its size that a source is taken at most. seed: of draws and permutations. groups: into which a source's
    documents are dealt at least, and rows to one of them, to number words or slots without one long sort. rounds: of the permutation."""

    weights: tuple[int, ...] = WEIGHTS
    block: int = 64
    shard: int = 4096
    most: int = 3
    seed: int = 17
    groups: int = 1024
    group_rows: int = 1 << 16
    rounds: int = 12


@dataclass(frozen=True)
class Mix:
    """targets: a row per source. slots: (shard, slot, source, k, epoch, block) of the output. documents: a row per input row with taken."""

    targets: DataFrame
    slots: DataFrame
    documents: DataFrame


def uniform(*of: Column) -> Column:
    """A pseudorandom number in [0, 1) from values."""
    return F.call_function("shiftrightunsigned", F.xxhash64(*of), F.lit(11)) / float(1 << 53)


def source_targets(sized: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """A row per source: source, source_size, target (double).

    Sources rank by code point, null last. The stop at ``most`` sizes, with the
    excess reshared by weight until none is above, has a closed form: target =
    min(cap, level * weight), where the capped sources are those with the least
    cap / weight. All windows here run over sources, never over documents.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8"))) - 1
    weights = F.array(*map(F.lit, rules.weights))
    df = by_source.withColumn("w", F.get(weights, (rank % len(rules.weights)).cast("int")).cast("double")).withColumn("cap", F.col("source_size") * float(rules.most))
    everything = Window.partitionBy(F.lit(0))
    up_to = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    df = df.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(up_to), zero)) / (F.col("all_w") - F.coalesce(F.sum("w").over(up_to), zero))
    df = df.withColumn("level", level)
    # the first source, in order of cap / weight, that stays below its cap sets the level for all that follow
    ratio = F.col("cap") / F.col("w")
    first = F.when(ratio >= F.col("level"), F.struct(ratio.alias("r"), F.col("source").isNull().alias("none"), F.col("source"), F.col("level")))
    df = df.withColumn("level", F.min(first).over(everything)["level"])
    return df.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def permute(x: Column, n: Column, source_key: Column, rules: MixRules, inverse: bool = False) -> Column:
    """A pseudorandom permutation of [0, n): swap-or-not rounds, each of which pairs x with key - x. A round undoes
    itself, so the rounds in reverse order are the inverse."""

    def turn(x: Column, r: Column) -> Column:
        key = F.pmod(F.xxhash64(source_key, r, F.lit(rules.seed)), n)
        other = F.pmod(key + n - x, n)
        swap = F.xxhash64(F.greatest(x, other), source_key, r).bitwiseAND(1) == 1
        return F.when(swap, other).otherwise(x)

    rounds = (rules.rounds, 1) if inverse else (1, rules.rounds)
    return F.aggregate(F.sequence(*map(F.lit, rounds)), x, turn)


def packed(sized: DataFrame, rules: MixRules) -> DataFrame:
    """Adds ``start``, the first word's number in its source.

    Two levels: sums per (source, group), a running sum of those, and a running sum
    within each group, so that no task sorts a whole source.
    """
    groups = max(rules.groups, sized.count() // rules.group_rows)
    df = sized.withColumn("g", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(rules.seed)), groups))
    sums = df.groupBy("source", "g").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("source").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s_"), F.col("g").alias("g_"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "g").orderBy("doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    df = df.join(sums, F.col("source").eqNullSafe(F.col("s_")) & (F.col("g") == F.col("g_")))
    return df.withColumn("start", F.col("base") + F.col("inner")).drop("g", "g_", "s_", "base", "inner", "text_hash")


def draw(targets: DataFrame, rules: MixRules) -> DataFrame:
    """The output's slots: (shard, slot, source_key, k), k the slot's number within its source."""
    spark = targets.sparkSession
    n_slots = targets.agg(F.coalesce(F.sum("n_slots"), F.lit(0)).alias("n")).first()["n"]
    order = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, 0)
    cells = 1024
    cdf = targets.filter("n_slots > 0").withColumn("hi", F.sum("n_slots").over(order)).withColumn("lo", F.col("hi") - F.col("n_slots"))
    cdf = cdf.select("source_key", (F.col("lo") / float(max(1, n_slots))).alias("lo"), (F.col("hi") / float(max(1, n_slots))).alias("hi"))
    cdf = cdf.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("u", uniform(F.col("slot"), F.lit(rules.seed)))
    drawn = slots.withColumn("cell", F.floor(F.col("u") * cells)).join(cdf, "cell").filter("u >= lo and u < hi")
    drawn = drawn.select("slot", F.floor(F.col("slot") / rules.shard).alias("shard"), "source_key")
    # multinomial counts of each shard, and where each source's numbering goes on in it
    counts = drawn.groupBy("source_key", "shard").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("g", F.floor(F.col("shard") / rules.group_rows))
    sums = counts.groupBy("source_key", "g").agg(F.sum("n").alias("s"))
    upper = Window.partitionBy("source_key").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_key", "g", F.coalesce(F.sum("s").over(upper), F.lit(0)).alias("upper"))
    along = Window.partitionBy("source_key", "g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("inner", F.coalesce(F.sum("n").over(along), F.lit(0))).join(sums, ["source_key", "g"])
    counts = counts.select("source_key", "shard", (F.col("upper") + F.col("inner")).alias("base"))
    inner = Window.partitionBy("shard", "source_key").orderBy("slot")
    drawn = drawn.withColumn("r", F.row_number().over(inner) - 1).join(counts, ["shard", "source_key"])
    return drawn.select("shard", "slot", "source_key", (F.col("base") + F.col("r")).alias("k"))


def settle(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Slots beyond a source's target pass, in order, to sources that drew too few; then each has n_slots."""
    got = drawn.groupBy("source_key").agg(F.count(F.lit(1)).alias("got"))
    t = targets.join(got, "source_key", "left").select("source_key", "n_slots", F.coalesce("got", F.lit(0)).alias("got"))
    order = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("over", F.greatest(F.col("got") - F.col("n_slots"), F.lit(0))).withColumn("short", F.greatest(F.col("n_slots") - F.col("got"), F.lit(0)))
    t = t.withColumn("over_base", F.coalesce(F.sum("over").over(order), F.lit(0))).withColumn("short_base", F.coalesce(F.sum("short").over(order), F.lit(0)))
    need = t.filter("short > 0").select(F.col("source_key").alias("new_key"), "got", "short_base", F.explode(F.sequence(F.lit(0), F.col("short") - 1)).alias("i"))
    need = need.select("new_key", (F.col("got") + F.col("i")).alias("new_k"), (F.col("short_base") + F.col("i")).alias("e"))
    held = drawn.join(t.select("source_key", "n_slots", "over_base"), "source_key")
    kept = held.filter("k < n_slots").select("shard", "slot", "source_key", "k")
    spare = held.filter("k >= n_slots").select("shard", "slot", (F.col("over_base") + F.col("k") - F.col("n_slots")).alias("e"))
    return kept.unionByName(spare.join(need, "e").select("shard", "slot", F.col("new_key").alias("source_key"), F.col("new_k").alias("k")))


def mix_sources(docs: DataFrame, rules: MixRules = MixRules()) -> Mix:
    """Mix all documents to the sources' targets.

    documents has a row per input row: doc_id, source, size, source_size, target
    (the source's), taken (words that the mix takes of it, repeats counted; at most
    ``most`` times its size). Null text has size 0 and is never taken; null source is
    a source of its own, the last; repeated rows are separate documents; an empty
    table gives no rows. Extra columns are ignored. Reruns agree.
    """
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")))
    block = rules.block
    targets = source_targets(sized, rules)
    # whole passes over a source's blocks, then so many words of a last, partial pass
    want = F.round("target").cast("long")
    targets = targets.withColumn("source_key", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    targets = targets.withColumn("n_blocks", F.ceil(F.col("source_size") / block)).withColumn("want", want)
    targets = targets.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("want") / F.col("source_size"))).otherwise(F.lit(0)))
    targets = targets.withColumn("rest", F.col("want") - F.col("passes") * F.col("source_size")).withColumn("tail", F.col("source_size") - (F.col("n_blocks") - 1) * block)
    # the short last block may stand among the partial pass's slots; then that pass needs one slot more to reach its words
    probe = F.ceil(F.col("rest") / block)
    key = F.col("source_key")
    is_early = (F.col("rest") > 0) & (permute(F.col("n_blocks") - 1, F.greatest("n_blocks", F.lit(1)), key, rules, inverse=True) < probe)
    extra = F.when(F.col("rest") == 0, F.lit(0)).when(is_early & (probe * block - block + F.col("tail") < F.col("rest")), probe + 1).otherwise(probe)
    targets = targets.withColumn("n_slots", F.col("passes") * F.col("n_blocks") + F.least(extra, F.col("n_blocks")))
    targets = cut(targets.withColumn("short_early", is_early))

    held = targets.select("source_key", "n_blocks", "n_slots", "passes", "rest", "tail", "short_early")
    slots = settle(draw(targets, rules), targets).join(held, "source_key")
    slots = slots.withColumn("epoch", F.floor(F.col("k") / F.col("n_blocks"))).withColumn("block", permute(F.col("k") % F.col("n_blocks"), F.col("n_blocks"), key, rules))
    # the last slot of a partial pass is cut to the words still wanted
    size = F.when(F.col("block") == F.col("n_blocks") - 1, F.col("tail")).otherwise(F.lit(block))
    last = (F.col("k") == F.col("n_slots") - 1) & (F.col("rest") > 0)
    inside = F.col("k") - F.col("passes") * F.col("n_blocks")
    before = inside * block - F.when(F.col("short_early") & (F.col("block") != F.col("n_blocks") - 1), block - F.col("tail")).otherwise(F.lit(0))
    slots = slots.withColumn("words", F.when(last, F.least(size, F.col("rest") - before)).otherwise(size))
    slots = slots.select("shard", "slot", "source_key", "k", "epoch", "block", size.alias("size"), "words")

    used = slots.groupBy("source_key", "block").agg(
        F.sum((F.col("words") == F.col("size")).cast("long")).alias("times"),
        F.coalesce(F.max(F.when(F.col("words") < F.col("size"), F.col("words"))), F.lit(0)).alias("cut"),
    )
    df = packed(sized, rules).withColumnRenamed("source", "src")
    df = df.join(targets.select("source", "source_key", "source_size", "target"), F.col("src").eqNullSafe(F.col("source"))).drop("src")
    pieces = df.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    lo = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    pieces = pieces.select("source_key", "start", "block", lo.alias("lo"), hi.alias("hi"))
    took = pieces.join(used, ["source_key", "block"]).withColumn("n", F.col("times") * (F.col("hi") - F.col("lo")) + F.greatest(F.least("hi", "cut") - F.col("lo"), F.lit(0)))
    took = took.groupBy(F.col("source_key").alias("key_"), F.col("start").alias("start_")).agg(F.sum("n").alias("n"))
    df = df.join(took, (F.col("source_key") == F.col("key_")) & (F.col("start") == F.col("start_")) & (F.col("size") > 0), "left")
    out = df.select("doc_id", "source", "size", "source_size", "target", F.coalesce("n", F.lit(0)).cast("long").alias("taken"))
    return Mix(targets, slots, out)
