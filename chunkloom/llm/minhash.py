"""Near-duplicates by b-bit MinHash.

Documents with the same shingle set are one class, found by a 128-bit fingerprint
of the set; a class has a number of its own, apart from the ids of its documents. Of
each class, minima of 128 hash functions make bands of four rows (a pair of similarity
0.75 shares none of 32 bands with odds of 5 in a million), and their two lowest bits,
packed in four longs, estimate similarity by bit counts, corrected for chance agreement.
Candidates that the estimate doesn't rule out are confirmed on their full shingle sets.

Buckets don't emit pairs. First each member meets only its bucket's leader, the member
with the most company in all its buckets; who links with a leader takes its label. Then,
where a bucket still holds several labels, its members go to the cluster of the label
that most of them have, once however many buckets they share with it. A cluster's
members are tested in its task on their full sets: those of other labels against all,
in tiles of bounded size, and a tile sends out only links that join what wasn't joined
yet, fewer than it has members. No pair of members that share a bucket stays untested.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, lean_batches
from .graph import components
from .textcore import BASE, mix, shingle_sets

LANES, EVEN_BITS = 32, 0x5555555555555555
#: Members of a tile's side, and shingles of them; pairs of a leader that stay together, and pairs of a block; shingles of a task's sets.
TILE, TILE_SHINGLES, LEADER_PAIRS, BLOCK_PAIRS, TASK_SHINGLES = 4096, 1 << 20, 512, 50000, 1 << 21
FINGERPRINT = ["set_a", "set_b", "n_shingles"]


@dataclass(frozen=True)
class NearRules:
    """similarity: in per cent, Jaccard on shingle sets. slack: the estimate may fall so far below it (over four deviations);
    1 tests all candidates in full."""

    words: int = 5
    similarity: int = 75
    bands: int = 32
    rows: int = 4
    slack: float = 0.2
    seed: int = 11


def hash_parameters(rules: NearRules) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(rules.seed)
    n = rules.bands * rules.rows
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1, 1 << 63, n, dtype=np.uint64)


def minima(hashes: np.ndarray, first: np.ndarray, rules: NearRules) -> np.ndarray:
    """A row of minima for each document; every document must have a hash."""
    a, b = hash_parameters(rules)
    out = np.empty((len(first) - 1, len(a)), np.uint32)
    for i in range(len(a)):
        out[:, i] = np.minimum.reduceat(((hashes * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32), first[:-1])
    return out


def packed_bits(low: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, 32 to a long."""
    lanes = low.astype(np.uint64).reshape(len(low), low.shape[1] // LANES, LANES) & np.uint64(3)
    return np.bitwise_or.reduce(lanes << (np.arange(LANES, dtype=np.uint64) * np.uint64(2)), axis=2).view(np.int64)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def signatures(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_a, set_b, sig, bands) of whole texts; the last four null for texts without words.
    bands: a key for each band, the band's number mixed in."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, hashes, first in shingle_sets(batch.column(2), rules.words):
                counts, sums, xors = np.zeros(j - i, np.int64), np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                for d in np.flatnonzero(np.diff(first)):
                    own = np.unique(hashes[first[d] : first[d + 1]])
                    counts[d], sums[d], xors[d] = len(own), own.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(own))
                full = np.flatnonzero(counts)
                mins = minima(hashes, np.append(first[full], first[-1]), rules) if len(full) else np.zeros((0, rules.bands * rules.rows), np.uint32)
                keys = mins.astype(np.uint64).reshape(len(full), rules.bands, rules.rows)
                key = np.arange(1, rules.bands + 1, dtype=np.uint64)[None] * np.uint64(BASE) + np.zeros((len(full), 1), np.uint64)
                for r in range(rules.rows):
                    key = mix(key ^ keys[:, :, r])
                none = counts == 0

                def lists(values: np.ndarray, none: np.ndarray = none) -> pa.Array:
                    """A list for each document that has shingles, null for the others."""
                    offsets = np.concatenate([[0], np.cumsum(np.where(none, 0, values.shape[1]))]).astype(np.int32)
                    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(none, False)), pa.array(values.reshape(-1)))

                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(counts), pa.array(sums.view(np.int64), mask=none), pa.array(xors.view(np.int64), mask=none), lists(packed_bits(mins)), lists(key.view(np.int64))],
                    ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "sig", "bands"],
                )

    return docs.select("doc_id", text_hash().alias("text_hash"), "text").mapInArrow(lean_batches(sign), "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, sig array<long>, bands array<long>")


def full_sets(texts: DataFrame, rules: NearRules) -> DataFrame:
    """(rep, n, sig, hashes): the distinct shingles of whole texts; texts has columns rep, n, sig and text."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, hashes, first in shingle_sets(batch.column(3), rules.words):
                own = [np.unique(hashes[first[d] : first[d + 1]]).view(np.int64) for d in range(j - i)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                values = np.concatenate(own) if own else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["rep", "n", "sig", "hashes"])

    return texts.select("rep", "n", "sig", "text").mapInArrow(lean_batches(collect), "rep long, n long, sig array<long>, hashes array<long>")


class Sets:
    """Members of one task: their numbers, packed bits, and shingles as numbers of a table that the task's members share."""

    def __init__(self, table: pa.Table, rules: NearRules) -> None:
        self.rules = rules
        self.rep = table.column("rep").to_numpy()
        lists = table.column("hashes").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        self.first = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        self.n = np.diff(self.first)
        self.bits = table.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(self.rep), -1)
        names, self.tokens = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        self.mark = np.zeros(len(names), bool)

    def shared(self, members: np.ndarray) -> np.ndarray:
        """For each of these members how many of its shingles another of them has too."""
        at = spread(self.first[members], self.n[members])
        times = np.bincount(self.tokens[at], minlength=len(self.mark))
        return np.add.reduceat((times[self.tokens[at]] > 1).astype(np.int64), np.cumsum(self.n[members]) - self.n[members])

    def alike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Estimated similarity of all x with all y: agreement of two bits has odds of a quarter by chance, which is taken off."""
        bits = self.bits[x][:, None, :] ^ self.bits[y][None]
        differ = np.bitwise_count((bits | (bits >> np.uint64(1))) & np.uint64(EVEN_BITS)).sum(axis=2, dtype=np.int64)
        return (1 - differ / (self.rules.bands * self.rules.rows) - 0.25) / 0.75

    def linked(self, x: int, others: np.ndarray) -> np.ndarray:
        """Whether x and each of the others are similar enough, by their full sets."""
        own = self.tokens[self.first[x] : self.first[x + 1]]
        self.mark[own] = True
        out = np.zeros(len(others), bool)
        for some in np.array_split(np.arange(len(others)), 1 + int(self.n[others].sum()) // TASK_SHINGLES):
            n = self.n[others[some]]
            if len(some):
                both = np.add.reduceat(self.mark[self.tokens[spread(self.first[others[some]], n)]].astype(np.int64), np.cumsum(n) - n)
                out[some] = 100 * both >= self.rules.similarity * (len(own) + n - both)
        self.mark[own] = False
        return out

    def open(self, x: int, others: np.ndarray) -> np.ndarray:
        """Whether sizes and estimate leave a link of x and each of the others open."""
        n, m = self.n[x], self.n[others]
        return (np.minimum(n, m) * 100 >= np.maximum(n, m) * self.rules.similarity) & (self.alike(np.array([x]), others)[0] >= self.rules.similarity / 100 - self.rules.slack)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, ``size`` of them, for each start."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links_table(pairs: list[tuple[int, int]]) -> pa.Table:
    pair = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(pair.min(axis=1)), "b": pa.array(pair.max(axis=1))}, schema=LINKS)


def star_links(stars: DataFrame, sets: DataFrame, rules: NearRules) -> DataFrame:
    """The pairs (a, b) of ``stars`` (lead, rep) that link.

    Pairs meet in blocks by their leader; one of very many pairs is salted. A block
    gets each set that it needs once, not once for each pair.
    """
    spark = stars.sparkSession
    degree = stars.groupBy("lead").agg(F.count(F.lit(1)).alias("d"))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), stars.count() // BLOCK_PAIRS, 2 * total // TASK_SHINGLES)
    p = stars.join(degree, "lead").select(F.pmod(F.xxhash64("lead", F.pmod(F.xxhash64("rep"), F.ceil(F.col("d") / LEADER_PAIRS))), blocks).cast("int").alias("block"), "lead", "rep")
    needed = p.select("block", F.col("lead").alias("rep")).union(p.select("block", "rep")).distinct().join(sets, "rep").withColumnRenamed("block", "of")

    def hold(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return links_table([])
        own = Sets(right, rules)
        order = np.argsort(own.rep)
        x, y = (order[np.searchsorted(own.rep, left.column(c).to_numpy(), sorter=order)] for c in ("lead", "rep"))
        out, by = [], np.argsort(x, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(x[by])) + 1):
            lead, others = int(x[some[0]]), y[some]
            others = others[own.open(lead, others)]
            out += [(own.rep[lead], own.rep[o]) for o in others[own.linked(lead, others)]]
        return links_table(out)

    return p.groupBy("block").cogroup(needed.groupBy("of")).applyInArrow(lean(hold), "a long, b long")


def tiles(buckets: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(main, i, j, rep, label, left, right): where members of buckets with several labels meet.

    buckets: (key, rep). labels: (rep, label), for those that differ. sizes: (rep, n). A
    bucket's cluster is its most frequent label. Members of other labels stand in row
    i of a cluster's tiles, and are held against all members, by columns j.
    """
    now = buckets.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    share = now.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    share = share.groupBy("key").agg(F.max(F.struct("m", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").drop("parts")
    member = cut(now.join(share, "key").select("main", "rep", "label").distinct().join(sizes, "rep"))
    outside = F.col("label") != F.col("main")
    sides = lambda many, weight: F.greatest(F.ceil(many / TILE), F.ceil(weight / TILE_SHINGLES), F.lit(1)).cast("int")
    grid = member.groupBy("main").agg(
        sides(F.sum(outside.cast("long")), F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0))).alias("rows"),
        sides(F.count(F.lit(1)), F.sum("n")).alias("columns"),
    )
    # both sides of the join are then plain shuffles, of which Spark splits a hot cluster's
    member = member.join(cut(grid), "main")
    row, column = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("rows")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(2)), F.col("columns")).cast("int")
    along = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: F.struct(row.alias("i"), j.alias("j"), F.lit(True).alias("left"), (j == column).alias("right")))
    down = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct(i.alias("i"), column.alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    places = F.when(outside, F.concat(along, F.filter(down, lambda p: p["i"] != row))).otherwise(down)
    return member.select("main", "rep", "label", "n", F.explode(places).alias("p")).select("main", "p.i", "p.j", "rep", "label", "n", "p.left", "p.right")


def tile_links(placed: DataFrame, sets: DataFrame, rules: NearRules) -> DataFrame:
    """Links (a, b) that join the members of all tiles, as far as full sets link them."""
    placed = cut(placed)
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    slots = max(4 * int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_SHINGLES)
    rows = placed.drop("n").join(sets, "rep").withColumn("slot", F.pmod(F.xxhash64("main", "i", "j"), slots).cast("int"))

    def meet(table: pa.Table) -> pa.Table:
        order = [table.column(c).to_numpy() for c in ("rep", "j", "i", "main")]
        table, keys = table.take(pa.array(np.lexsort(order))), np.stack(order[1:], axis=1)[np.lexsort(order)]
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
        return links_table([x for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) for x in spanning_links(table.slice(lo, hi - lo), rules)])

    return rows.groupBy("slot").applyInArrow(lean(meet), "a long, b long")


def spanning_links(tile: pa.Table, rules: NearRules) -> list[tuple[int, int]]:
    """Links among a tile's members, left against right, but those between members that links or labels have joined before."""
    own = Sets(tile, rules)
    everyone = np.arange(len(own.rep))
    label, left, right = (tile.column(c).to_numpy(zero_copy_only=False) for c in ("label", "left", "right"))
    outside = label != tile.column("main")[0].as_py()
    # a link needs ``similarity`` per cent of a member's shingles in another's set
    shared = own.shared(everyone)
    may = 100 * shared >= rules.similarity * own.n
    rows, columns = np.flatnonzero(left & may), np.flatnonzero(right & may)
    group, out = np.unique(label, return_inverse=True)[1], []
    for some in np.array_split(rows, 1 + len(rows) * len(columns) // (1 << 20)):
        if not len(some) or not len(columns):
            continue
        n, m = own.n[some][:, None], own.n[columns][None]
        can = (np.minimum(n, m) * 100 >= np.maximum(n, m) * rules.similarity) & (own.alike(some, columns) >= rules.similarity / 100 - rules.slack)
        can &= np.minimum(shared[some][:, None], shared[columns][None]) * (100 + rules.similarity) >= rules.similarity * (n + m)
        # two members outside the main label are in each other's rows: the smaller number tests
        can &= ~outside[columns][None] | (own.rep[some][:, None] < own.rep[columns][None])
        for x, others in zip(some.tolist(), can, strict=True):
            others = columns[others]
            others = others[group[others] != group[x]]
            for y in others[own.linked(x, others)].tolist() if len(others) else []:
                if group[y] != group[x]:
                    group[group == group[y]] = group[x]
                    out.append((int(own.rep[x]), int(own.rep[y])))
    return out


def solved(docs: DataFrame, rules: NearRules) -> DataFrame:
    """(doc_id, text_hash, n_shingles, group, first_id, first_hash) a row per input row. group: a number of the component,
    null without shingles; first_id, first_hash: its row with the smallest id, of these with the smallest text hash."""
    signed = cut(signatures(docs, rules))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")))
    classes = signed.filter("n_shingles > 0").groupBy(*FINGERPRINT).agg(head.alias("head"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))
    member = classes.select(F.explode("bands").alias("key"), "rep")
    sizes = member.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = cut(member.join(sizes, "key"))
    popular = buckets.groupBy("rep").agg(F.sum("size").alias("company"))
    leaders = buckets.join(popular, "rep").groupBy("key").agg(F.max(F.struct("company", (-F.col("rep")).alias("r"))).alias("top"))
    leaders = leaders.select("key", F.col("top.company").alias("company"), (-F.col("top.r")).alias("lead"))
    buckets = buckets.drop("size")
    stars = cut(buckets.join(leaders, "key").filter("lead <> rep").select("lead", "company", "rep").distinct())

    # full sets of every class that shares a bucket; texts are read anew for these alone
    some = classes.join(buckets.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("n_shingles").alias("n"), "sig", F.col("head.id").alias("id"), F.col("head.hash").alias("hash"))
    texts = docs.select(F.col("doc_id").alias("own"), text_hash().alias("hash_"), "text")
    texts = some.join(texts, F.col("id").eqNullSafe(F.col("own")) & (F.col("hash") == F.col("hash_"))).select("rep", "n", "sig", "text").dropDuplicates(["rep"])
    sets = cut(full_sets(texts, rules))

    links = cut(star_links(stars.select("lead", "rep"), sets, rules))
    # a label is the best leader that a class links with, or that one's own: whoever shares it is connected
    ends = links.select(F.col("a").alias("lead"), F.col("b").alias("rep")).union(links.select("b", "a"))
    best = stars.join(ends, ["lead", "rep"]).groupBy("rep").agg(F.max(F.struct("company", (-F.col("lead")).alias("r"))).alias("top"))
    best = cut(best.select("rep", (-F.col("top.r")).alias("label")))
    further = best.select(F.col("rep").alias("label"), F.col("label").alias("next"))
    labels = best.join(further, "label", "left").select("rep", F.coalesce("next", "label").alias("label"))
    links = links.union(tile_links(tiles(buckets, labels, some.select("rep", "n")), sets, rules))

    found = components(links).select(F.col("id").alias("rep"), "component")
    classes = cut(classes.select(*FINGERPRINT, "rep", "head").join(found, "rep", "left").select(*FINGERPRINT, "head", F.coalesce("component", "rep").alias("group")))
    classes = classes.join(classes.groupBy("group").agg(F.min("head").alias("top")), "group").select(*FINGERPRINT, "group", F.col("top.id").alias("first_id"), F.col("top.hash").alias("first_hash"))
    return signed.select("doc_id", "text_hash", *FINGERPRINT).join(classes, FINGERPRINT, "left").drop("set_a", "set_b")


def near_duplicates(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """A row per input row: doc_id, n_shingles, component_id, kept.

    Linked are documents whose shingle sets have a similarity of at least
    ``similarity``; component_id is the smallest doc_id that links reach. Null, empty
    and blank texts have no shingles and link with nothing. Rows that repeat a doc_id
    get a row each, by their own text. Rows without a doc_id link like all others; a
    component of such rows alone has a null component_id, and its rows count as kept.
    Extra columns are not read; an empty table gives no rows.
    """
    out = solved(docs, rules).withColumn("component_id", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("first_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """Of each group of near-duplicates one row, with all its columns; rows without shingles stay.

    The row with the smallest doc_id stays, rows without one coming last; of several with
    it the one whose text hash is smallest, and of rows that repeat id and text any one.
    """
    rows = cut(solved(docs, rules).filter("group is not null"))
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    keys = [F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")]
    gone = rows.filter(~first).select(*keys).distinct()
    again = cut(rows.filter(first).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), text_hash().alias("own_hash"))
    same = F.col("own_id").eqNullSafe(F.col("of_id")) & (F.col("own_hash") == F.col("of_hash"))
    once = whole.join(gone.union(again), same, "left_anti").select("row.*")
    if again.isEmpty():
        return once
    return once.union(whole.join(again, same, "left_semi").groupBy("own_id", "own_hash").agg(F.first("row").alias("row")).select("row.*"))
