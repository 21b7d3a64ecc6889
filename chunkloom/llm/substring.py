"""Repeated word sequences by prefix-partitioned suffix trees.

The suffixes of a part's stretches of words (see repeats.py) are split by prefixes of
variable length: a prefix that too many suffixes share is made longer until each group
fits the memory that a subtree may take. Each group's subtree is then built level by
level, two words at a time: a node is a prefix that several suffixes share, its
children part them by the next words, and a suffix that parts from all others is a leaf
and is dropped. Nodes that reach ``window`` words are followed on to the depth where
their suffixes part: these deep internal nodes are the repeats, with all their
occurrences, and what can be extended to the left is left to the node that does.

Words are compared as words: stretches travel as text, and a part numbers its words by a
dictionary. Prefixes partition within a part; between tasks, stretches are dealt by hashed
keys, as sending each suffix to its prefix would take the text thirty-five times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Groups, Part, Texts, Windows, answers, closed_groups, repeat_groups, report
from .textcore import word_spans

WORDS = Windows(window=35, gram=6, words=True, within=True)
#: Suffixes to a subtree.
GROUP = 1 << 14


def pair_at(symbols: np.ndarray, at: np.ndarray, depth: int, window: int) -> np.ndarray:
    """Words ``depth`` and ``depth`` + 1 of each suffix, as one number; beyond the window there is nothing."""
    high = symbols[at + depth].astype(np.uint64) << np.uint64(32)
    return high | symbols[at + depth + 1].astype(np.uint64) if depth + 1 < window else high


def prefix_groups(symbols: np.ndarray, starts: np.ndarray, windows: np.ndarray, window: int, depth: int = 0, most: int = GROUP) -> Iterator[tuple[int, np.ndarray]]:
    """(depth, windows): groups of at most ``most`` suffixes that no prefix crosses; a prefix with more is extended."""
    if len(windows) <= most or depth >= window:
        yield depth, windows
        return
    value = pair_at(symbols, starts[windows], depth, window)
    order = np.argsort(value, kind="stable")
    windows, value = windows[order], value[order]
    cuts = np.append(np.flatnonzero(np.append(True, value[1:] != value[:-1])), len(windows))
    begin = 0
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if z - a > most:
            if a > begin:
                yield depth, windows[begin:a]
            yield from prefix_groups(symbols, starts, windows[a:z], window, depth + 2, most)
            begin = z
        elif z - begin > most:
            yield depth, windows[begin:a]
            begin = a
    if begin < len(windows):
        yield depth, windows[begin:]


def deep_nodes(symbols: np.ndarray, starts: np.ndarray, windows: np.ndarray, window: int, depth: int) -> np.ndarray:
    """(node, window) pairs of a group's internal nodes at the depth of the window, as two rows."""
    group = np.zeros(len(windows), np.int64)
    for d in range(depth, window, 2):
        if len(windows) == 0:
            break
        value = pair_at(symbols, starts[windows], d, window)
        order = np.lexsort([value, group])
        windows, value, group = windows[order], value[order], group[order]
        head = np.append(True, (value[1:] != value[:-1]) | (group[1:] != group[:-1]))
        leaf = head & np.append(head[1:], True)
        group = (np.cumsum(head) - 1)[~leaf]
        windows = windows[~leaf]
    return np.stack([group, windows])


def node_depths(part: Part, node: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """How many words the windows of each node share: on from the window until they part or a stretch ends."""
    count = int(node.max(initial=-1)) + 1
    depth = np.full(count, part.window)
    head = np.zeros(count, np.int64)
    head[node] = windows
    live = np.ones(len(node), bool)
    d = part.window
    while live.any():
        node, windows = node[live], windows[live]
        at = part.windows[windows] + d
        inside = at < part.first[part.owner[windows] + 1]
        lead = np.minimum(part.windows[head[node]] + d, len(part.symbols) - 1)
        same = inside & (part.symbols[np.minimum(at, len(part.symbols) - 1)] == part.symbols[lead])
        whole = np.ones(count, bool)
        whole[node[~same]] = False
        depth[np.unique(node[whole[node]])] += 1
        live = whole[node]
        d += 1
    return depth


def groups(part: Part, most: int = GROUP) -> Groups:
    """The deep internal nodes of all subtrees of a part that can't be extended to the left."""
    numbers, members, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for depth, windows in prefix_groups(part.symbols, part.windows, np.arange(len(part.windows)), part.window, most=most):
        node, own = deep_nodes(part.symbols, part.windows, windows, part.window, depth)
        if len(own):
            node = np.unique(node, return_inverse=True)[1]
            numbers.append(n + node)
            members.append(own)
            n += int(node.max()) + 1
    node, windows = np.concatenate(numbers), np.concatenate(members)
    return closed_groups(part, windows, node, node_depths(part, node, windows))


def match(part: Part) -> pa.Table:
    """Stretches that start anywhere else: members of a node of several, or of a run that stands in several places."""
    found = groups(part)
    places = np.add.reduceat(part.n_places, part.at[:-1])
    again = np.bincount(found.group, weights=places[found.run], minlength=len(found.low))[found.group] > 1
    return answers(part, found.run[again], found.start[again], found.end[again], None)


def maximal_repeats(docs: DataFrame, rules: Windows = WORDS) -> DataFrame:
    """(repeat, length, doc_id, start): every occurrence of every repeat of ``window`` words or more; lengths and starts count words.

    A repeat is a longest stretch whose first window, and each further one of it, stands in
    just its places or more, in one text or in several. An empty table gives no rows.
    """
    return repeat_groups(docs, rules, groups)


def removal_report(docs: DataFrame, rules: Windows = WORDS) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by a space).

    Removed is each word covered by a window of ``window`` words that also starts
    anywhere else, in the same text too, judged on the input. Null text has no words.
    Rows that repeat a doc_id are separate texts. Extra columns are not read; an empty
    table gives no rows.
    """

    def tell(texts: Texts, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
        ids, data, offsets, out = texts.table.column("c0"), texts.data, texts.offsets, []
        cut = np.searchsorted(rows, np.arange(len(offsets)))
        for r in range(len(offsets) - 1):
            text = data[offsets[r] : offsets[r + 1]]
            a, z, _ = word_spans(text, np.array([0, len(text)]))
            keep = np.ones(len(a), bool)
            for s, e in zip(starts[cut[r] : cut[r + 1]].tolist(), ends[cut[r] : cut[r + 1]].tolist(), strict=True):
                keep[s:e] = False
            out.append((len(a), int((~keep).sum()), hashlib.sha256(joined_words(text, a[keep], z[keep])).hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.Table.from_arrays([ids.combine_chunks().cast(pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    # rows of one id are texts of their own: "anywhere else" needs no ids, only places
    return report(docs.select("doc_id", "text"), rules, match, tell, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def joined_words(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words at these spans, joined by one space."""
    if len(starts) == 0:
        return b""
    keep = np.zeros(len(text) + 1, np.int8)
    keep[starts] += 1
    keep[ends] -= 1
    mask = np.cumsum(keep[:-1]).astype(bool)
    out = np.append(text, np.uint8(32))
    mask = np.append(mask, False)
    mask[ends[:-1]] = True
    out[ends[:-1]] = 32
    return out[mask].tobytes()
