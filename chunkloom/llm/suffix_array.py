"""Repeats across documents by the common-prefix interval tree of an enhanced suffix array.

Suffixes of the routed stretches (see repeats.py) are sorted, eight bytes at a time
and only as far as they agree; with the lengths of neighbours' common prefixes this is
an enhanced suffix array. One scan with a stack gives the tree of its intervals: an
interval of depth l holds all suffixes that share their first l bytes. An interval
whose suffixes have different left neighbours can't be extended to the left, so it is
a maximal repeat, with all its occurrences and not just neighbouring ones.

What is removed follows from the outermost intervals of ``window`` bytes or more that
the left-extension test leaves: of each, all occurrences under larger ids than its
least. Intervals within these hold fewer of the same places, so they remove nothing
more. Depths end with the routed stretch; repeats.py puts the pieces of longer repeats
together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back
from .repeats import Groups, Part, Texts, Windows, answers, closed_groups, ranges, repeat_groups, report

BYTES = Windows(window=50, gram=18)
#: Bytes up to which suffixes are compared by eights; beyond, ranks of ever longer stretches are (periodic text).
NEAR = 256
#: Suffixes whose values are computed at once, and common-prefix lengths that are scanned at once.
BLOCK = 1 << 16


def big_endian(symbols: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as one number; zeros follow the end."""
    padded = np.concatenate([symbols, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), (len(symbols) + 1,), (1,)) if len(symbols) else np.zeros(1, ">u8")


def blocks(n: int) -> Iterator[slice]:
    """0 to n in blocks, so that what is computed on the way to a result stays small."""
    return (slice(i, i + BLOCK) for i in range(0, n, BLOCK))


def eight(words: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Eight bytes at places, with zeros from ``end`` on."""
    out = np.empty(len(at), np.uint64)
    for some in blocks(len(at)):
        left = np.clip(end[some] - at[some], 0, 8)
        got = words[np.minimum(at[some], len(words) - 1)].astype(np.uint64)
        shift = np.minimum(((8 - left) * 8).astype(np.uint64), np.uint64(63))
        out[some] = np.where(left == 0, np.uint64(0), (got >> shift) << shift)
    return out


def sort_suffixes(words: np.ndarray, start: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group) of suffixes by up to ``depth`` bytes: group numbers equal ones. Only suffixes that still agree are sorted on."""
    value = eight(words, start, np.minimum(end, start + depth))
    order = np.argsort(value, kind="stable").astype(start.dtype)
    value = value[order]
    head = np.append(True, value[1:] != value[:-1]) if len(order) else np.zeros(0, bool)
    for t in range(8, depth, 8):
        group = np.cumsum(head, dtype=start.dtype) - 1
        alone = head & np.append(head[1:], True)
        open_ = np.flatnonzero(~alone)
        if len(open_) == 0:
            break
        at = order[open_]
        value = eight(words, start[at] + t, np.minimum(end[at], start[at] + depth))
        inner = np.lexsort([value, group[open_]])
        order[open_] = at[inner]
        value, own = value[inner], group[open_]
        head[open_] = np.append(True, (value[1:] != value[:-1]) | (own[1:] != own[:-1]))
    return order, np.cumsum(head, dtype=start.dtype) - 1


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Bytes that suffixes at a and b share, up to ``left``."""
    out = np.empty(len(a), left.dtype)
    for some in blocks(len(a)):
        out[some] = common_bytes(words, a[some], b[some], left[some])
    return out


def common_bytes(words: np.ndarray, a: np.ndarray, b: np.ndarray, left: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x = words[np.minimum(a[live] + out[live], len(words) - 1)].astype(np.uint64) ^ words[np.minimum(b[live] + out[live], len(words) - 1)].astype(np.uint64)
        same = np.full(len(live), 8, np.int64)
        for i in range(8):
            byte = (x >> np.uint64(56 - 8 * i)) & np.uint64(255)
            same = np.where((same == 8) & (byte != 0), i, same)
        out[live] = np.minimum(out[live] + same, left[live])
        live = live[(same == 8) & (out[live] < left[live])]
    return out


class Ranks:
    """Ranks of the stretches of 8, 16, 32 and so on bytes from every place of some runs, ended by the run's end."""

    def __init__(self, words: np.ndarray, first: np.ndarray, last: np.ndarray, kind: type) -> None:
        sizes = last - first
        self.at = ranges(first, sizes).astype(kind)
        self.index = np.full(len(words), -1, kind)
        self.index[self.at] = np.arange(len(self.at), dtype=kind)
        end = np.repeat(last.astype(kind), sizes)
        left = np.minimum(end - self.at, 8)
        rank = self.dense(eight(words, self.at, end), left)
        self.levels, h = [self.narrow(rank)], 8
        while h < sizes.max(initial=0):
            after = np.zeros(len(rank), kind)
            after[:-h] = rank[h:] + 1
            after[self.at + h >= end] = 0
            rank = self.dense(rank, after)
            self.levels.append(self.narrow(rank))
            h *= 2

    @staticmethod
    def narrow(rank: np.ndarray) -> np.ndarray:
        """Ranks in as few bytes as the largest needs: texts that repeat much have few."""
        return rank.astype(np.min_scalar_type(rank.max(initial=0)))

    @staticmethod
    def dense(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        order = np.lexsort([low, high])
        new = np.zeros(len(order), bool)
        for column in (high, low):
            column = column[order]
            new[1:] |= column[1:] != column[:-1]
        out = np.empty(len(order), low.dtype)
        out[order] = np.cumsum(new, dtype=low.dtype)
        return out

    def common(self, a: np.ndarray, b: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Bytes that suffixes at a and b share, up to ``left`` and to less than eight short of it."""
        out = np.zeros(len(a), left.dtype)
        for some in blocks(len(a)):
            own, most = out[some], left[some]
            for k in range(len(self.levels) - 1, -1, -1):
                for _ in range(2):
                    live = np.flatnonzero(own < most)
                    x, y = self.index[a[some][live] + own[live]], self.index[b[some][live] + own[live]]
                    same = self.levels[k][x] == self.levels[k][y]
                    own[live[same]] = np.minimum(own[live[same]] + (8 << k), most[live[same]])
        return out


def stack_scan(lcp: np.ndarray, least: int, nested: bool) -> tuple[np.ndarray, np.ndarray]:
    """Stack scan of common-prefix lengths: the intervals (depth, first, last) of ``least`` or deeper, if ``nested`` ones are
    wanted, and the outermost (first, last). Lengths become Python's numbers, and intervals arrays, a stretch at a time."""
    intervals, outer, stack = [np.zeros((0, 3), np.int64)], [np.zeros((0, 2), np.int64)], []
    lcp = np.append(lcp, 0)
    for base in range(0, len(lcp), BLOCK):
        inner, top_most = [], []
        for i, depth in enumerate(lcp[base : base + BLOCK].tolist(), base):
            left = i
            while stack and stack[-1][0] > depth:
                top, left = stack.pop()
                if nested:
                    inner.append((top, left, i))
                if not stack and depth < least:
                    top_most.append((left, i))
            if depth >= least and (not stack or stack[-1][0] < depth):
                stack.append((depth, left))
        intervals.append(np.array(inner, np.int64).reshape(-1, 3))
        outer.append(np.array(top_most, np.int64).reshape(-1, 2))
    return np.concatenate(intervals), np.concatenate(outer)


def lcp_intervals(lcp: list[int], least: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """All intervals (depth, first, last) of ``least`` or deeper, and the outermost (first, last), as tuples."""
    intervals, outer = stack_scan(np.array(lcp, np.int64), least, True)
    return [tuple(x) for x in intervals.tolist()], [tuple(x) for x in outer.tolist()]


@dataclass
class Tree:
    """suffix: the windows in array order, those that share at least a window's length with a neighbour. intervals: (depth, first,
    last) of maximal repeats. outer: (first, last) of the outermost intervals, which part the suffixes by their first window, and depth of them."""

    suffix: np.ndarray
    intervals: np.ndarray
    outer: np.ndarray
    depth: np.ndarray


def interval_tree(part: Part, nested: bool) -> Tree:
    """The tree of a part's windows; its inner intervals only if ``nested`` ones are wanted."""
    words, window = big_endian(part.symbols), part.window
    # places are half as wide where they fit, with room for sums of them and a stretch's length
    kind = np.int32 if len(part.symbols) < 1 << 29 else np.int64
    first = part.first.astype(kind)
    start, end = part.windows.astype(kind), first[1:][part.owner]
    order, group = sort_suffixes(words, start, end, window)
    shared = order[(np.bincount(group, minlength=1) > 1)[group]]
    del order, group
    if len(shared) == 0:
        none = np.zeros((0, 2), np.int64)
        return Tree(shared, np.zeros((0, 3), np.int64), none, none[:, 0])
    # the suffixes that share a window are sorted to their ends, for lengths beyond it
    deep, group = sort_suffixes(words, start[shared], end[shared], NEAR)
    shared = shared[deep]
    del deep
    start, end = start[shared], end[shared]
    give_back()
    far = np.flatnonzero(end - start > NEAR)
    if len(far):
        long = np.unique(part.owner[shared[far]])
        ranks = Ranks(words, part.first[long], part.first[long + 1], kind)
        beyond = np.full(len(shared), -1, kind)
        beyond[far] = ranks.levels[-1][ranks.index[start[far] + NEAR]]
        order = np.lexsort([beyond, group])
        shared, start, end = shared[order], start[order], end[order]
        del beyond, order
    del group
    a, b = start[:-1], start[1:]
    left = np.minimum(end[:-1] - a, end[1:] - b)
    lcp = common_prefix(words, a, b, np.minimum(left, NEAR))
    far = np.flatnonzero((lcp == NEAR) & (left > NEAR))
    if len(far):
        more = ranks.common(a[far] + NEAR, b[far] + NEAR, left[far] - NEAR)
        del ranks
        give_back()
        lcp[far] += more + common_prefix(words, a[far] + NEAR + more, b[far] + NEAR + more, left[far] - NEAR - more)
    del a, b, end, left, far
    intervals, outer = stack_scan(lcp, window, nested)
    depth = np.minimum.reduceat(np.append(lcp, 0), outer.reshape(-1))[::2].astype(np.int64)
    if nested:
        # left extension: a run's first byte has an unknown neighbour, which counts as different from any
        before = np.where(start == first[part.owner[shared]], -1 - np.arange(len(shared)), part.symbols[np.maximum(start - 1, 0)].astype(np.int64))
        change = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
        intervals = intervals[change[intervals[:, 2]] > change[intervals[:, 1]]]
    return Tree(shared, intervals, outer, depth)


def outer_groups(part: Part) -> Groups:
    """The outermost intervals that can't be extended to the left."""
    tree = interval_tree(part, nested=False)
    give_back()
    return closed_groups(part, tree.suffix, np.repeat(np.arange(len(tree.outer)), tree.outer[:, 1] - tree.outer[:, 0] + 1), tree.depth)


def match(part: Part) -> pa.Table:
    """Stretches that also start in a document of a smaller id: of each group all members, bounded by its least id."""
    found = outer_groups(part)
    run, start, end, bound = found.run, found.start, found.end, found.low[found.group]
    del found
    give_back()
    return answers(part, run, start, end, bound)


def all_groups(part: Part) -> Groups:
    """The outermost groups, and the maximal repeats that intervals within them are: longer, in fewer places."""
    tree, outer = interval_tree(part, nested=True), outer_groups(part)
    own = {tuple(x) for x in tree.outer.tolist()}
    nested = np.array([x for x in tree.intervals.tolist() if tuple(x[1:]) not in own], np.int64).reshape(-1, 3)
    n = nested[:, 2] - nested[:, 1] + 1
    windows = tree.suffix[ranges(nested[:, 1], n)] if len(nested) else np.zeros(0, np.int64)
    start = part.windows[windows] - part.first[part.owner[windows]]
    return Groups(
        np.concatenate([outer.group, len(outer.low) + np.repeat(np.arange(len(nested)), n)]),
        np.concatenate([outer.run, part.owner[windows]]),
        np.concatenate([outer.start, start]),
        np.concatenate([outer.end, start + np.repeat(nested[:, 0], n)]),
        outer.low,
    )


def maximal_repeats(docs: DataFrame, rules: Windows = BYTES, nested: bool = False) -> DataFrame:
    """(repeat, length, doc_id, start): every occurrence of every repeat of ``window`` bytes or more in texts of several ids.

    A repeat is a longest stretch whose first window, and each further one of it, stands in
    just its places or more. ``nested`` adds longer ones in fewer places, as far as a routed
    stretch shows them; of periodic text these grow with the square of its length.
    Starts are bytes of UTF-8; null ids are one id, the largest. An empty table gives no rows.
    """
    return repeat_groups(docs, rules, all_groups if nested else outer_groups)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def kept_bytes(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]], bytes]]:
    """(row, removed bytes, spans, bytes that stay) of each text."""
    cut = np.searchsorted(rows, np.arange(len(offsets)))
    for r in range(len(offsets) - 1):
        text = data[offsets[r] : offsets[r + 1]]
        own = slice(cut[r], cut[r + 1])
        spans = list(zip(starts[own].tolist(), ends[own].tolist(), strict=True))
        if not spans:
            yield r, 0, spans, text.tobytes()
            continue
        keep = np.ones(len(text), bool)
        for a, b in spans:
            keep[a:b] = False
        yield r, int((~keep).sum()), spans, text[keep].tobytes()


def removal_report(docs: DataFrame, rules: Windows = BYTES) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte covered by a string of ``window`` bytes that also starts in a
    document with a smaller doc_id, judged on the input. Null text is empty. Rows that
    repeat a doc_id get a row each and don't remove each other; a null doc_id counts as
    the largest. Extra columns are not read; an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def tell(texts: Texts, *spans: np.ndarray) -> pa.Table:
        ids, sizes = texts.table.column("c0").to_pylist(), np.diff(texts.offsets).tolist()
        rows = [(ids[r], sizes[r], n, len(s), hashlib.sha256(kept).hexdigest()) for r, n, s, kept in kept_bytes(texts.data, texts.offsets, *spans)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return report(docs.select("doc_id", "text"), rules, match, tell, RESULT)


def remove_repeats(docs: DataFrame, rules: Windows = BYTES) -> DataFrame:
    """The documents with what ``removal_report`` counts taken out of their texts; n_chars, if there, is counted anew.

    All rows and columns stay, also of texts that lose everything. A character that is
    cut in two is dropped. A null text stays null.
    """
    columns = docs.columns
    kinds = {"n_chars": "long"} if "n_chars" in columns else {}
    out = docs.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})

    def tell(texts: Texts, *spans: np.ndarray) -> pa.Table:
        null = texts.table.column(f"c{columns.index('text')}").is_null().to_pylist()
        kept = [None if null[r] else text.decode("utf-8", "ignore") for r, _, _, text in kept_bytes(texts.data, texts.offsets, *spans)]
        new = {"text": pa.array(kept, pa.string()), "n_chars": pa.array([None if k is None else len(k) for k in kept], pa.int64())}
        return pa.Table.from_arrays([new[c] if c in new else texts.table.column(f"c{i}") for i, c in enumerate(columns)], columns)

    return report(out, rules, match, tell, out.schema)
