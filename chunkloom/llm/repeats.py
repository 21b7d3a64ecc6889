"""Routing of repeated windows: which stretches of which texts must be held against each other.

A text is a row of symbols (bytes or words), and a window so many of them. The key of a
window is the least hash of the k-grams in it, so equal windows have equal keys wherever
they stand, and neighbours mostly share theirs: a text falls into runs of windows of one
key. Only keys that occur again matter. Texts are dealt to buckets, keys to parts:

 1. keys   a bucket sends each key of its texts once, four bytes, to the key's part;
 2. again  a part finds the keys that occur again, and tells the buckets that have them;
 3. runs   a bucket sends its runs of those keys to the parts, equal runs once, with
           how often they stand there and the least and the largest id;
 4. match  a part has all windows of its keys: it finds the equal ones (by suffix
           array or suffix tree, in the modules that use this one) and tells the
           buckets which stretches of which of their runs are repeated;
 5. report a bucket finds the places of these runs in its texts again.

Texts are shuffled once, by bucket; buckets and parts grow in number with the text, so
each fits in memory. No message is per occurrence: a passage in a third of all documents
costs its part one run and one answer for each bucket, not for each document. Hashes
only route: equal runs are merged, and windows compared, by their bytes or words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, lean
from .textcore import BASE, chunks, column_bytes, mix, powers, word_hashes, word_spans

NO_ID = np.iinfo(np.int64).max
KEY_SCHEMA = "part int, bucket int, keys binary, several binary"
RUN_SCHEMA = "part int, bucket int, base int, symbols binary, sizes binary, n_places binary, low_ids binary, high_ids binary"
#: To buckets: the keys of a part that occur again, or stretches of runs.
MAIL_SCHEMA = "bucket int, part int, keys binary, runs binary, starts binary, ends binary, bounds binary"
#: Bytes that are compared at once.
STRIDE = 1 << 20


@dataclass(frozen=True)
class Windows:
    """window: symbols of it. gram: symbols of the hashed k-grams. words: symbols are words, not bytes.
    within: windows that repeat within one text count. part_bytes, bucket_bytes: text to a part and to a bucket."""

    window: int
    gram: int
    words: bool = False
    within: bool = False
    part_bytes: int = 4 << 20
    bucket_bytes: int = 8 << 20

    @property
    def grams(self) -> int:
        return self.window - self.gram + 1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width``, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


@dataclass
class Symbols:
    """codes: a 64-bit number for each symbol, equal for equal ones. first: of each text, with one more at the end.
    travel: the bytes that stand for the symbols, at travel[at[i]:at[i + 1]]; of a word, it and a blank."""

    codes: np.ndarray
    first: np.ndarray
    travel: np.ndarray
    at: np.ndarray


def symbols_of(data: np.ndarray, offsets: np.ndarray, rules: Windows) -> Symbols:
    if not rules.words:
        return Symbols(data.astype(np.uint64) + np.uint64(1), offsets, data, np.arange(len(data) + 1))
    starts, ends, first = word_spans(data, offsets)
    at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    travel = np.full(at[-1], 32, np.uint8)
    travel[ranges(at[:-1], ends - starts)] = data[ranges(starts, ends - starts)]
    return Symbols(word_hashes(data, starts, ends), first, travel, at)


def runs_of(symbols: np.ndarray, first: np.ndarray, rules: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, last window, key, self-repeating) of each run of windows."""
    n, k, w, size = len(symbols), rules.gram, rules.grams, rules.window
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * up[:n], out=total[1:])
    grams = mix((total[k:] - total[:-k]) * down[: n - k + 1])
    keys = sliding_min(grams, w)
    valid = np.zeros(len(keys), bool)
    last = np.repeat(first[1:], np.diff(first))[: len(keys)]
    valid[: len(last)] = np.arange(len(last)) + size <= last
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (keys[1:] != keys[:-1])
    over = valid.copy()
    over[:-1] &= ~valid[1:] | (keys[1:] != keys[:-1])
    lo, hi = np.flatnonzero(fresh), np.flatnonzero(over)
    key = keys[lo]
    twice = np.zeros(len(lo), bool)
    if rules.within and len(lo):
        spans = hi - lo + w
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        same = grams[at] == np.repeat(key, spans)
        twice = np.add.reduceat(same.astype(np.int32), np.concatenate([[0], np.cumsum(spans)[:-1]])) > 1
    return np.searchsorted(first, lo, "right") - 1, lo, hi, key, twice


def split_key(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    return ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int32), key.astype(np.uint32)


def grouped(by: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(value, columns) for each value, order kept within."""
    if len(by) == 0:
        return
    order = np.argsort(by, kind="stable")
    cuts = np.flatnonzero(np.diff(by[order])) + 1
    for part in np.split(order, cuts):
        yield int(by[part[0]]), *(c[part] for c in columns)


def packed(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    """Rows of ints and arrays; arrays become bytes."""
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array([x.tobytes() if isinstance(x, np.ndarray) else x for x in c], f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def joined(col: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() or b"" for x in col), dtype)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, for each of these runs, in one array."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def digest(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[hi] - total[lo]) * down[lo])


def distinct(data: np.ndarray, start: np.ndarray, size: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, fresh): stretches of bytes such that equal ones of equal keys are neighbours, and whether each is the first
    of these. The last key orders first. Neighbours of one hash are compared byte by byte."""
    hashes = np.concatenate([digest(data[lo:hi], start[own] - lo, start[own] + size[own] - lo) for lo, hi, own in strides(data, start, size)] or [np.zeros(0, np.uint64)])
    order = np.lexsort([size, hashes, *keys])
    fresh = np.ones(len(order), bool)
    if len(order) > 1:
        fresh[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in (size, hashes, *keys)])
        again = np.flatnonzero(~fresh)
        n = size[order[again]]
        for some in np.split(again, np.searchsorted(np.cumsum(n), np.arange(STRIDE, n.sum(), STRIDE))) if len(again) else []:
            if len(some):
                own = size[order[some]]
                same = data[ranges(start[order[some]], own)] == data[ranges(start[order[some - 1]], own)]
                fresh[some] = ~np.logical_and.reduceat(same, np.cumsum(own) - own)
    return order, fresh


def strides(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, slice]]:
    """(first byte, last byte, stretches) that are hashed together; starts must not fall."""
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + STRIDE)))
        yield int(start[i]), int((start[i:j] + size[i:j]).max()), slice(i, j)
        i = j


# -- buckets -------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """Where a bucketed frame has id and text, and what its columns were called. Its own columns have names by place."""

    names: list[str]

    @property
    def id(self) -> str:
        return f"c{self.names.index('doc_id')}"

    @property
    def text(self) -> str:
        return f"c{self.names.index('text')}"


def bucketed(docs: DataFrame, rules: Windows) -> tuple[DataFrame, Layout, int, int]:
    """(texts with columns c0 and on, hash and bucket; their layout; how many parts and buckets)."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts, buckets = max(32, total // rules.part_bytes), max(32, total // rules.bucket_bytes)
    # rows of one id are spread by their texts: a bucket holds no id whole, only rows that are copies by both
    hashed = [F.xxhash64("text").alias("hash"), F.pmod(F.xxhash64("doc_id", "text"), buckets).cast("int").alias("bucket")]
    texts = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], *hashed)
    return texts, Layout(docs.columns), parts, buckets


@dataclass
class Texts:
    """A bucket's texts, in an order that is the same in every pass."""

    table: pa.Table
    ids: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def load_texts(table: pa.Table, layout: Layout) -> Texts:
    table = table.sort_by([(layout.id, "ascending"), ("hash", "ascending")])
    ids = table.column(layout.id).combine_chunks().cast(pa.int64()).fill_null(NO_ID)
    data, offsets = column_bytes(table.column(layout.text).combine_chunks() if table.num_rows else pa.array([], pa.string()))
    return Texts(table, ids.to_numpy(zero_copy_only=False).astype(np.int64), data, offsets)


def send_keys(texts: Texts, bucket: int, rules: Windows, parts: int) -> pa.Table:
    """Each key of the bucket once, with whether it is there more than once (``within``) or under several ids."""
    keys, low, high = [], [], []
    for i, _, data, at in chunks(texts.data, texts.offsets):
        own = symbols_of(data, at, rules)
        text, _, _, key, twice = runs_of(own.codes, own.first, rules)
        keys.append(np.concatenate([key, key[twice]]) if rules.within else key)
        if not rules.within:
            low.append(texts.ids[i + text])
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    p, short = split_key(key, parts)
    whole = (p.astype(np.uint64) << np.uint64(32)) | short
    order = np.argsort(whole, kind="stable")
    whole = whole[order]
    start = np.flatnonzero(np.append(True, whole[1:] != whole[:-1])) if len(whole) else np.zeros(0, np.int64)
    if rules.within:
        several = np.diff(np.append(start, len(whole))) > 1
    elif len(start):
        ids = np.concatenate(low)[order]
        several = np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start)
    else:
        several = np.zeros(0, bool)
    whole = whole[start]
    rows = [(q, bucket, k, v) for q, k, v in grouped((whole >> np.uint64(32)).astype(np.int32), whole.astype(np.uint32), several.astype(np.uint8))]
    return packed(rows, arrow_schema(KEY_SCHEMA))


def find_again(table: pa.Table) -> pa.Table:
    """To each bucket of a part, its keys that other buckets have too, or that it has several times."""
    low, several = joined(table.column("keys"), np.uint32), joined(table.column("several"), np.uint8).astype(bool)
    bucket = np.repeat(table.column("bucket").to_numpy(), [len(x.as_py()) // 4 for x in table.column("keys")])
    order = np.argsort(low, kind="stable")
    low, several, bucket = low[order], several[order], bucket[order]
    start = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    sizes = np.diff(np.append(start, len(low)))
    keep = np.repeat((sizes > 1) | np.logical_or.reduceat(several, start), sizes)
    part = table.column("part")[0].as_py()
    return packed([(b, part, k, b"", b"", b"", b"") for b, k in grouped(bucket[keep], low[keep])], arrow_schema(MAIL_SCHEMA))


@dataclass
class Runs:
    """A bucket's runs of wanted keys, equal ones once, ordered by part. Run r is size[r] bytes of travel from start[r], and
    stands at (row, place) at[r] to at[r + 1]; place counts symbols of the text."""

    travel: np.ndarray
    part: np.ndarray
    start: np.ndarray
    size: np.ndarray
    at: np.ndarray
    row: np.ndarray
    place: np.ndarray


def find_runs(texts: Texts, mail: pa.Table, rules: Windows, parts: int) -> Runs:
    sent = [(p.as_py(), k.as_py()) for p, k in zip(mail.column("part"), mail.column("keys"), strict=True) if k.as_py()]
    wanted = np.sort(np.concatenate([(np.uint64(p) << np.uint64(32)) | np.frombuffer(k, np.uint32).astype(np.uint64) for p, k in sent] or [np.zeros(0, np.uint64)]))
    found, base = [], 0
    for i, _, data, at in chunks(texts.data, texts.offsets) if len(wanted) else ():
        own = symbols_of(data, at, rules)
        text, lo, hi, key, _ = runs_of(own.codes, own.first, rules)
        p, short = split_key(key, parts)
        whole = (p.astype(np.uint64) << np.uint64(32)) | short
        hit = wanted[np.minimum(np.searchsorted(wanted, whole), len(wanted) - 1)] == whole
        text, lo, hi = text[hit], lo[hit], hi[hit] + rules.window
        found.append((own.travel, p[hit], base + own.at[lo], own.at[hi] - own.at[lo], i + text, lo - own.first[text]))
        base += len(own.travel)
    none = np.zeros(0, np.int64)
    travel, part, start, size, row, place = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint8), none, none, none, none, none)
    order, fresh = distinct(travel, start, size, part)
    head = np.flatnonzero(fresh)
    return Runs(travel, part[order[head]], start[order[head]], size[order[head]], np.append(head, len(order)), row[order], place[order])


def send_runs(texts: Texts, bucket: int, runs: Runs) -> pa.Table:
    schema, rows = arrow_schema(RUN_SCHEMA), []
    if len(runs.part) == 0:
        return packed([], schema)
    n, ids = np.diff(runs.at).astype(np.uint32), texts.ids[runs.row]
    low, high = np.minimum.reduceat(ids, runs.at[:-1]), np.maximum.reduceat(ids, runs.at[:-1])
    cuts = np.append(np.flatnonzero(np.append(True, runs.part[1:] != runs.part[:-1])), len(runs.part)).tolist()
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        symbols = runs.travel[ranges(runs.start[a:z], runs.size[a:z])]
        rows.append((int(runs.part[a]), bucket, a, symbols, runs.size[a:z].astype(np.uint32), n[a:z], low[a:z], high[a:z]))
    return packed(rows, schema)


# -- parts ----------------------------------------------------------------------


@dataclass
class Part:
    """All runs of a part's keys, equal ones once. Run r is symbols[first[r]:first[r+1]]; holders at[r] to at[r+1] have it:
    run number ``runs`` of a bucket, where it stands n_places times, in texts of ids from low to high.
    windows, owner: where windows begin in symbols, and the run of each."""

    symbols: np.ndarray
    first: np.ndarray
    at: np.ndarray
    buckets: np.ndarray
    runs: np.ndarray
    n_places: np.ndarray
    low: np.ndarray
    high: np.ndarray
    windows: np.ndarray
    owner: np.ndarray
    window: int


def load_part(table: pa.Table, rules: Windows) -> Part:
    data, sizes = joined(table.column("symbols"), np.uint8), joined(table.column("sizes"), np.uint32).astype(np.int64)
    per_row = np.array([len(x.as_py()) // 4 for x in table.column("sizes")], np.int64)
    buckets, runs = np.repeat(table.column("bucket").to_numpy(), per_row), ranges(table.column("base").to_numpy().astype(np.int64), per_row)
    n_places, low, high = joined(table.column("n_places"), np.uint32).astype(np.int64), joined(table.column("low_ids"), np.int64), joined(table.column("high_ids"), np.int64)
    start = np.cumsum(sizes) - sizes
    order, fresh = distinct(data, start, sizes)
    head = np.flatnonzero(fresh)
    kept = order[head]
    data, sizes = data[ranges(start[kept], sizes[kept])], sizes[kept]
    if rules.words:
        ends = np.flatnonzero(data == 32).astype(np.int32) + np.int32(1)
        at = np.concatenate([[0], ends]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(data)])
        symbols = words.dictionary_encode().indices.to_numpy().astype(np.uint32)
        first = np.searchsorted(at, np.concatenate([[0], np.cumsum(sizes)]))
    else:
        symbols, first = data, np.concatenate([[0], np.cumsum(sizes)])
    counts = np.diff(first) - rules.window + 1
    return Part(symbols, first, np.append(head, len(order)), buckets[order], runs[order], n_places[order], low[order], high[order], ranges(first[:-1], counts), np.repeat(np.arange(len(sizes)), counts), rules.window)


@dataclass
class Groups:
    """Repeats found in a part: group[i] has a member that is the symbols start[i] to end[i] of run[i], and low[group] is the
    least id under which it stands anywhere."""

    group: np.ndarray
    run: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray


def closed_groups(part: Part, windows: np.ndarray, node: np.ndarray, depth: np.ndarray) -> Groups:
    """Groups from the nodes of a tree: windows[i] is in node[i], whose suffixes share depth[node] symbols.

    A window in no node stands in one run alone, and repeats as that run does, to its end.
    Left-extension test: a node all of whose windows are preceded by the windows of one
    other node, and no more of these, is that one's repeat without its first symbol; it
    is left out, as the other reaches as far.
    """
    n, nodes = len(part.windows), len(depth)
    of = np.full(n, -1)
    of[windows] = node
    alone = np.flatnonzero(of < 0)
    of[alone] = nodes + np.arange(len(alone))
    size = np.bincount(of, minlength=nodes + len(alone))
    first_window = part.windows == part.first[part.owner]
    before = np.where(first_window, -1, np.concatenate([[-1], of[:-1]]))
    order = np.argsort(of, kind="stable")
    start = np.cumsum(size) - size
    least, most = np.minimum.reduceat(before[order], start), np.maximum.reduceat(before[order], start)
    inner = (least == most) & (least >= 0) & (size[np.maximum(least, 0)] == size)
    low = np.minimum.reduceat(np.minimum.reduceat(part.low, part.at[:-1])[part.owner][order], start)
    run_end = part.first[part.owner + 1]
    keep = order[~inner[of[order]]]
    own = of[keep]
    end = np.where(own < nodes, part.windows[keep] + np.append(depth, 0)[np.minimum(own, nodes)], run_end[keep])
    base = part.first[part.owner[keep]]
    return Groups(own, part.owner[keep], part.windows[keep] - base, end - base, low)


def answers(part: Part, run: np.ndarray, start: np.ndarray, end: np.ndarray, bound: np.ndarray | None) -> pa.Table:
    """To every bucket that holds one of these runs, the stretches of it; with a bound, if it has texts of larger ids."""
    n = np.diff(part.at)[run]
    holder = ranges(part.at[run], n) if len(run) else np.zeros(0, np.int64)
    start, end = np.repeat(start.astype(np.uint32), n), np.repeat(end.astype(np.uint32), n)
    limit = np.repeat(bound, n) if bound is not None else np.full(len(holder), np.iinfo(np.int64).min)
    keep = part.high[holder] > limit
    holder, start, end, limit = holder[keep], start[keep], end[keep], limit[keep]
    rows = [(b, -1, b"", r, s, e, x) for b, r, s, e, x in grouped(part.buckets[holder], part.runs[holder].astype(np.uint32), start, end, limit)]
    return packed(rows, arrow_schema(MAIL_SCHEMA))


def placed(texts: Texts, runs: Runs, mail: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the stretches that parts have told, at all places of their runs whose ids exceed the bound."""
    told, start, end = (joined(mail.column(c), np.uint32).astype(np.int64) for c in ("runs", "starts", "ends"))
    bound = joined(mail.column("bounds"), np.int64)
    n = np.diff(runs.at)[told] if len(told) else told
    at = ranges(runs.at[told], n) if len(told) else told
    row, place = runs.row[at], runs.place[at]
    keep = texts.ids[row] > np.repeat(bound, n)
    return row[keep], (place + np.repeat(start, n))[keep], (place + np.repeat(end, n))[keep]


def union_spans(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same cover, in spans that neither overlap nor touch."""
    order = np.lexsort([starts, rows])
    rows, starts, ends = rows[order].astype(np.int64), starts[order].astype(np.int64), ends[order].astype(np.int64)
    if len(rows) == 0:
        return rows, starts, ends
    step = np.int64(1) << np.int64(33)
    far = np.maximum.accumulate(ends + rows * step)
    fresh = np.append(True, starts[1:] + rows[1:] * step > far[:-1])
    begin = np.flatnonzero(fresh)
    return rows[begin], starts[begin], np.maximum.reduceat(ends, begin)


def occurrences(groups: Groups, part: Part, number: int) -> pa.Table:
    """The same as ``answers``, to be told apart by group: starts and ends, and the group's number as bound."""
    n = np.diff(part.at)[groups.run]
    holder = ranges(part.at[groups.run], n)
    start, end = np.repeat(groups.start, n).astype(np.uint32), np.repeat(groups.end, n).astype(np.uint32)
    name = (np.int64(number) << np.int64(32)) | np.repeat(groups.group, n)
    rows = [(b, -1, b"", r, s, e, x) for b, r, s, e, x in grouped(part.buckets[holder], part.runs[holder].astype(np.uint32), start, end, name)]
    return packed(rows, arrow_schema(MAIL_SCHEMA))


# -- the flow -------------------------------------------------------------------


@dataclass(frozen=True)
class Routed:
    """texts by bucket, hits (mail: keys that occur again) and runs by part."""

    texts: DataFrame
    layout: Layout
    parts: int
    hits: DataFrame
    runs: DataFrame


def routed(docs: DataFrame, rules: Windows) -> Routed:
    texts, layout, parts, _ = bucketed(docs, rules)
    bucket = lambda table: table.column("bucket")[0].as_py()
    keys = texts.groupBy("bucket").applyInArrow(lean(lambda t: send_keys(load_texts(t, layout), bucket(t), rules, parts)), KEY_SCHEMA)
    hits = keys.groupBy("part").applyInArrow(lean(find_again), MAIL_SCHEMA)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return packed([], arrow_schema(RUN_SCHEMA))
        own = load_texts(left, layout)
        return send_runs(own, bucket(left), find_runs(own, right, rules, parts))

    return Routed(texts, layout, parts, hits, texts.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(lean(send), RUN_SCHEMA))


def report(docs: DataFrame, rules: Windows, match: Callable[[Part], pa.Table], tell: Callable[..., pa.Table], schema: str | StructType) -> DataFrame:
    """``tell(texts, rows, starts, ends)`` of each bucket, with the stretches that ``match`` finds repeated, makes the result's rows."""
    flow = routed(docs, rules)
    spans = flow.runs.groupBy("part").applyInArrow(lean(lambda table: match(load_part(table, rules))), MAIL_SCHEMA)
    layout, parts = flow.layout, flow.parts

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        own = load_texts(left, layout)
        return tell(own, *union_spans(*placed(own, find_runs(own, right, rules, parts), right)))

    return flow.texts.groupBy("bucket").cogroup(flow.hits.union(spans).groupBy("bucket")).applyInArrow(lean(both), schema)


def repeat_groups(docs: DataFrame, rules: Windows, find: Callable[[Part], Groups]) -> DataFrame:
    """(repeat, length, doc_id, start): a row for every occurrence of every repeat that ``find`` gives, in symbols.

    What parts find ends where their runs do. Pieces that stand at the same places, so
    much further on each time, and touch, are put together: they are one repeat. Their
    places are compared by number, first place and a 128-bit hash of all of them.
    """
    flow = routed(docs.select("doc_id", "text"), rules)
    layout, parts = flow.layout, flow.parts

    def told(table: pa.Table) -> pa.Table:
        part = load_part(table, rules)
        return occurrences(find(part), part, table.column("part")[0].as_py())

    schema = arrow_schema("piece long, length long, doc_id long, bucket int, row long, start long")

    def stand(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = load_texts(left, layout)
        runs = find_runs(texts, right, rules, parts)
        told, start, end = (joined(right.column(c), np.uint32).astype(np.int64) for c in ("runs", "starts", "ends"))
        name, n = joined(right.column("bounds"), np.int64), np.diff(runs.at)[told] if len(told) else told
        at = ranges(runs.at[told], n) if len(told) else told
        ids = texts.table.column(layout.id).combine_chunks().cast(pa.int64()).take(pa.array(runs.row[at], pa.int64()))
        bucket = left.column("bucket")[0].as_py() if left.num_rows else 0
        cols = [np.repeat(name, n), np.repeat(end - start, n), ids, np.full(len(at), bucket, np.int32), runs.row[at], runs.place[at] + np.repeat(start, n)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    mail = flow.hits.union(flow.runs.groupBy("part").applyInArrow(lean(told), MAIL_SCHEMA))
    found = cut(flow.texts.groupBy("bucket").cogroup(mail.groupBy("bucket")).applyInArrow(lean(stand), "piece long, length long, doc_id long, bucket int, row long, start long"))
    whole = F.coalesce("doc_id", F.lit(NO_ID))
    pieces = found.groupBy("piece").agg(F.first("length").alias("length"), F.min(F.struct("bucket", "row", "start")).alias("at"), F.count(F.lit(1)).alias("n"), (F.min(whole) != F.max(whole)).alias("several"))
    pieces = pieces.filter("n > 1" if rules.within else "several").drop("several")
    spread = found.drop("length").join(pieces, "piece")
    place = lambda seed: F.bit_xor(F.xxhash64("bucket", "row", F.col("start") - F.col("at.start"), F.lit(seed)))
    shapes = spread.groupBy("piece").agg(place(1).alias("a"), place(2).alias("b"))
    shape = Window.partitionBy("at.bucket", "at.row", "n", "a", "b").orderBy("at.start", "piece")
    reach = F.max(F.col("at.start") + F.col("length")).over(shape.rowsBetween(Window.unboundedPreceding, -1))
    joint = pieces.join(shapes, "piece").withColumn("fresh", F.coalesce(F.col("at.start") > reach, F.lit(True)))
    joint = joint.withColumn("island", F.sum(F.col("fresh").cast("int")).over(shape.rowsBetween(Window.unboundedPreceding, 0)))
    repeats = joint.groupBy("at.bucket", "at.row", "n", "a", "b", "island").agg(F.min(F.struct("at.start", "piece")).alias("head"), F.max(F.col("at.start") + F.col("length")).alias("end"))
    repeats = repeats.select(F.col("head.piece").alias("piece"), (F.col("end") - F.col("head.start")).alias("whole"))
    return found.join(repeats, "piece").select(F.col("piece").alias("repeat"), F.col("whole").alias("length"), "doc_id", "start")
