"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle sets, so that an item of the
class b has b to 2b - 1 shingles. For each class a document is seen as windows of 3b
shingles, a new one every b, so a passage as long as an item lies whole in one of
them and shares with it at least 23 per cent of their union. Minima of 48 hash
functions find such windows with odds of a miss of four in a million; minima of
windows are put together from minima of the smallest blocks. Items whose minima
agree with a window's are then confirmed by exact containment: the item's shingles
against those of the whole document.

Items are the stated query set: they are taken to the executors in parts of bounded
number, each part in one pass over all documents, which are neither shuffled nor cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import shingle_sets


@dataclass(frozen=True)
class LeakRules:
    """containment: in per cent of an item's shingles. part, part_bytes: items to a pass at most, and bytes of their texts (their
    sketches go to every executor); an item is never cut, so one that is longer alone has its pass."""

    words: int = 5
    containment: int = 75
    hashes: int = 48
    part: int = 20000
    part_bytes: int = 32 << 20
    seed: int = 5


@dataclass
class ItemSketches:
    """ids and shingle sets of items; for each size class the sorted minima of its items, by hash function, and whose they are."""

    ids: list[int]
    sets: list[np.ndarray]
    classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def hash_parameters(rules: LeakRules) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(rules.seed)
    return rng.integers(1, 1 << 63, rules.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1, 1 << 63, rules.hashes, dtype=np.uint64)


def spread(hashes: np.ndarray, i: int, params: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return ((hashes * params[0][i] + params[1][i]) >> np.uint64(32)).astype(np.uint32)


FILTER_BITS = 16


def sketch_items(ids: list[int], texts: list[str | None], rules: LeakRules) -> ItemSketches:
    sets = [np.unique(h[a:b]) for _, _, h, first in shingle_sets(pa.array(texts, pa.string()), rules.words) for a, b in zip(first[:-1], first[1:], strict=True)]
    params, by_class = hash_parameters(rules), {}
    for n, own in enumerate(sets):
        if len(own):
            by_class.setdefault(1 << (len(own).bit_length() - 1), []).append(n)
    classes = {}
    for b, members in by_class.items():
        # a key holds the number of the hash function above the minimum
        keys = np.array([[(i << 32) | int(spread(sets[n], i, params).min()) for i in range(rules.hashes)] for n in members], np.uint64)
        owner = np.repeat(np.array(members), rules.hashes)
        order = np.argsort(keys.reshape(-1), kind="stable")
        seen = np.zeros((rules.hashes, 1 << FILTER_BITS), bool)
        for i in range(rules.hashes):
            seen[i, (keys[:, i] & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        classes[b] = (keys.reshape(-1)[order], owner[order], seen)
    return ItemSketches(ids, sets, classes)


def run_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, first): every document's run of rows cut into blocks of ``size``; a document without rows has none."""
    n = -(-np.diff(first) // size)
    place = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(first[:-1] - place[:-1] * size, n) + np.arange(place[-1]) * size, place


def candidates(hashes: np.ndarray, first: np.ndarray, sketches: ItemSketches, params: tuple[np.ndarray, np.ndarray], rules: LeakRules) -> dict[int, set[int]]:
    """Documents, of a chunk of them, and the items of which a window of theirs may hold enough."""
    found: dict[int, set[int]] = {}
    if not sketches.classes or len(hashes) == 0:
        return found
    finest = min(sketches.classes)
    edges, small_first = run_starts(first, finest)
    plans = []
    for b, (keys, owner, seen) in sketches.classes.items():
        starts, own_first = run_starts(small_first, b // finest)
        doc = np.repeat(np.arange(len(own_first) - 1), np.diff(own_first))
        # blocks whose next, and next but one, is of the same document
        plans.append((keys, owner, seen, starts, doc, np.flatnonzero(doc[1:] == doc[:-1]), np.flatnonzero(doc[2:] == doc[:-2])))
    for i in range(rules.hashes):
        small = np.minimum.reduceat(spread(hashes, i, params), edges)
        for keys, owner, seen, starts, doc, next1, next2 in plans:
            block = np.minimum.reduceat(small, starts)
            mins = block.copy()
            mins[next1] = np.minimum(mins[next1], block[next1 + 1])
            mins[next2] = np.minimum(mins[next2], block[next2 + 2])
            hit = np.flatnonzero(seen[i, mins & np.uint32((1 << FILTER_BITS) - 1)])
            if len(hit):
                wanted = mins[hit].astype(np.uint64) | np.uint64(i << 32)
                lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
                for h in np.flatnonzero(hi > lo).tolist():
                    found.setdefault(int(doc[hit[h]]), set()).update(owner[lo[h] : hi[h]].tolist())
    return found


def confirmed(hashes: np.ndarray, first: np.ndarray, sketches: ItemSketches, params: tuple[np.ndarray, np.ndarray], rules: LeakRules) -> list[tuple[int, int, int]]:
    """(document of the chunk, item's number, shingles in common) of the candidates of which a document holds enough."""
    out = []
    for d, maybe in sorted(candidates(hashes, first, sketches, params, rules).items()):
        whole = np.unique(hashes[first[d] : first[d + 1]])
        for n in sorted(maybe):
            common = int(np.isin(sketches.sets[n], whole, assume_unique=True).sum())
            if 100 * common >= rules.containment * len(sketches.sets[n]):
                out.append((d, n, common))
    return out


def parted(items: DataFrame, rules: LeakRules) -> list[DataFrame]:
    """The items in parts of bounded number and bytes."""
    items = items.select("item_id", "text")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-size["n"] // rules.part), -(-size["bytes"] // rules.part_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return [items.filter(part == p) if parts > 1 else items for p in range(parts)]


def sketches_of(items: DataFrame, rules: LeakRules) -> ItemSketches:
    rows = items.collect()
    return sketch_items([r["item_id"] for r in rows], [r["text"] for r in rows], rules)


def find_leaks(docs: DataFrame, items: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """(doc_id, item_id, n_item, n_common): documents that contain enough of a test item's shingles.

    Both sides lower-case A-Z and take sets of five-word shingles; a text of fewer
    words is one shingle, so such an item is found only in a document that is the same
    few words. Null and blank texts, of items or documents, match nothing. Items and
    documents that repeat an id give a row each. Extra columns are ignored; empty
    tables give no rows.
    """
    out = None
    for own in parted(items, rules):
        found = search(docs, sketches_of(own, rules), rules)
        out = found if out is None else out.unionByName(found)
    return out


def search(docs: DataFrame, sketches: ItemSketches, rules: LeakRules) -> DataFrame:
    """One pass over all documents for one part of the items."""
    shared = docs.sparkSession.sparkContext.broadcast(sketches)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches, params = shared.value, hash_parameters(rules)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, _, hashes, first in shingle_sets(batch.column(1), rules.words):
                rows += [(ids[i + d], sketches.ids[n], len(sketches.sets[n]), common) for d, n, common in confirmed(hashes, first, sketches, params, rules)]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_item", "n_common"])

    return docs.select("doc_id", "text").mapInArrow(look, "doc_id long, item_id long, n_item long, n_common long")


def decontaminate(docs: DataFrame, items: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """The documents, all their columns, that hold no test item; a pass for each part of the items, no shuffle."""
    for own in parted(items, rules):
        shared = docs.sparkSession.sparkContext.broadcast(sketches_of(own, rules))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sketches, params = shared.value, hash_parameters(rules)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for i, _, hashes, first in shingle_sets(batch.column("text"), rules.words):
                    for d, _, _ in confirmed(hashes, first, sketches, params, rules):
                        clean[i + d] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
