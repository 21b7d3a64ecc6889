"""Toxicity by noisy-channel deobfuscation.

Writers hide words by leetspeak, by spacing letters out and by repeating them. The
channel turns each such span into a lattice of characters: every sign may stand
for itself or a letter, separators between single letters may go, repeats may
collapse. Viterbi finds the path that a character trigram model of the corpus finds
likeliest, and the restored text is scored. Spans without such signs have one
path, themselves, and need no search.

The trigram model counts every document. The scorer, a lexicon with logistic
weights, is learned from a bounded sample of labelled documents. Entries are words and stems
(beginnings of words); each must tell toxic documents from others beyond what so
many candidates would do by chance. What counts is in how many different
surroundings a word stands, so words of a text with many copies gain nothing.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_one_task, lean_batches, sampled_texts
from .textcore import _LOWER, chunks, column_bytes

#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "%": ""}
#: Signs that may part spaced-out letters.
PARTING = " .-_*~"
#: Costs, in nats, of what the channel does: a sign for a letter, a sign kept, a sign dropped, a double kept, a word's end between spaced-out letters.
COST = {"leet": 0.7, "kept": 6.0, "dropped": 3.0, "double": 0.5, "break": 3.0}
OTHER, LETTERS = 0, 27
#: Different words that count for one stem at most.
MOST = 4

_SPANS = re.compile(
    r"(?<![^\W_])(?:(?:[^\W_]|[@$!|+€£(])[ .\-_*~]{1,2}){3,}(?:[^\W_]|[@$!|+€£(])(?![^\W_])"  # spaced-out letters, with signs among them
    r"|[\w@$!|+€£]*[^\W\d_][0-9@$!|+€£(*.\-_]+[^\W\d_][\w@$!|+€£*\-]*"  # signs within a word
    r"|(?<![\w])[0-9@$!|+€£(]+[^\W\d_][\w@$!|+€£(]*"  # signs before its first letter
    r"|[^\W\d_]*([^\W\d_])\1\1[\w]*"  # repeats
)
#: The same but where an alternative that failed at a character's left is sure to fail again: words are read once, not
#: once per letter. What this skips are places where a match has just ended; find_spans() looks at these.
_FAST = re.compile(
    r"(?<![^\W_])(?:(?:[^\W_]|[@$!|+€£(])[ .\-_*~]{1,2}){3,}(?:[^\W_]|[@$!|+€£(])(?![^\W_])"
    r"|(?<![\w@$!|+€£])[\w@$!|+€£]*[^\W\d_][0-9@$!|+€£(*.\-_]+[^\W\d_][\w@$!|+€£*\-]*"
    r"|(?:(?<![\w@$!|+€£(])|(?<=\w[@$!|+€£(]))[0-9@$!|+€£(]+[^\W\d_][\w@$!|+€£(]*"
    r"|(?<![^\W\d_])[^\W\d_]*([^\W\d_])\1\1[\w]*"
)


def find_spans(text: str) -> Iterator[re.Match]:
    """The matches of _SPANS."""
    at = 0
    while m := (at and _SPANS.match(text, at)) or _FAST.search(text, at):
        yield m
        at = m.end()


#: What is restored from spans of up to this many characters is remembered; longer ones seldom come twice.
REMEMBERED = 64
#: Nats by which a reading with an entry of the lexicon may be less likely than the likeliest, in letters without blanks.
SLACK = 16.0


@dataclass(frozen=True)
class ToxicRules:
    """sample: labelled documents to learn from at most (by hash of their id). entries: of the lexicon at most.
    support, precision: of an entry. stem, longest: characters of a stem at least and at most. margin: nats beyond chance."""

    sample: int = 4000
    entries: int = 200
    support: int = 3
    precision: float = 0.6
    stem: int = 4
    longest: int = 32
    margin: float = 1.0
    smoothing: float = 0.1


@dataclass
class ToxicModel:
    logp: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0

    def score(self, found: dict[str, set[str]]) -> float:
        """The score of a text in which entries match so many different words."""
        return logistic(self.bias + sum(self.weights[e] * min(MOST, len(words)) for e, words in found.items()))


# -- the language model ------------------------------------------------------


_CLASS = np.zeros(256, np.int64)
for _i in range(26):
    _CLASS[97 + _i] = _CLASS[65 + _i] = _i + 1


def letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): letter trigrams of all documents; what is not a to z is one sign. Summed per task, then per gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            for _, _, part, at in chunks(data, offsets):
                # two signs before and after each text keep texts apart
                sizes = np.diff(at)
                line = np.zeros(len(part) + 2 * len(sizes) + 2, np.int64)
                line[np.arange(len(part)) + 2 * np.repeat(np.arange(1, len(sizes) + 1), sizes)] = _CLASS[part]
                total += np.bincount((line[:-2] * LETTERS + line[1:-1]) * LETTERS + line[2:], minlength=LETTERS**3)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], ["gram", "n"])

    return docs.select("text").mapInArrow(lean_batches(count), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def log_model(rows: list, smoothing: float = 0.1) -> np.ndarray:
    """Log probability of a letter after two, by (first, second, third); at most 27 cubed rows go in."""
    counts = np.zeros(LETTERS**3)
    for r in rows:
        counts[r["gram"]] += r["n"]
    counts = counts.reshape(LETTERS, LETTERS, LETTERS)
    pairs = counts.sum(axis=0)
    back = (pairs + smoothing) / (pairs + smoothing).sum(axis=1, keepdims=True)
    return np.log((counts + 5 * back[None]) / (counts.sum(axis=2, keepdims=True) + 5))


# -- the channel --------------------------------------------------------------


def spaced_out(span: str) -> bool:
    return len(re.findall(r"[^\W_][ .\-_*~]{1,2}(?=[^\W_])", span)) >= 3 and all(len(x) <= 1 for x in re.split(r"[ .\-_*~]+", span))


def lattice(span: str, breaks: bool = False) -> Iterator[list[tuple[str, float]]]:
    """For each character of a span what it may stand for, with costs; an empty string drops it. With ``breaks``,
    separators of spaced-out letters may also end a word."""
    spaced, low = spaced_out(span), span.lower()
    run, before = 0, ""
    for i, c in enumerate(low):
        ways = [(c, 0.0 if letter(c) or not c.isascii() else COST["kept"])]
        if c in LEET:
            ways += [(x, COST["leet"]) for x in LEET[c]]
        if c in PARTING:
            ways = [("", 0.0 if spaced else COST["dropped"]), (c, COST["kept"] if spaced else 0.5)]
            if spaced and breaks:
                ways.append((" ", COST["break"]))
        elif not c.isalnum():
            ways.append(("", COST["dropped"]))
        run = run + 1 if before == c else 1
        if run > 1 and c.isalpha():  # a double may well be meant
            ways = [("", 1.5), (c, COST["double"])]
            if run > 2:  # a third letter is sooner dropped than kept on any path, so it is no choice
                continue
        if i == len(low) - 1 and i and c in "!.|*-_":  # more likely the sentence's than the word's
            ways = [("", 0.0)]
        before = c
        yield ways


#: Steps after which the search lets go of the part that all its paths share.
STEPS = 1024


def viterbi(ways: Iterable[list[tuple[str, float]]], logp: list) -> str:
    """The likeliest string through a lattice, under the trigram model; ends count as word ends.

    Time and memory grow with the length alone: what all paths share is written out on the way.
    """
    best: dict[tuple[int, int], float] = {(OTHER, OTHER): 0.0}
    came: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    out: list[str] = []
    check = STEPS

    def trace(at: tuple[int, int], steps: int) -> str:
        path = []
        for back in reversed(came[:steps]):
            at, c = back[at]
            path.append(c)
        return "".join(reversed(path))

    for options in ways:
        new: dict[tuple[int, int], float] = {}
        back: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for state, score in best.items():
            a, b = state
            row = logp[a][b]
            for c, cost in options:
                if c:
                    k = letter(c)
                    key, s = (b, k), score + row[k] - cost
                else:
                    key, s = state, score - cost - 1.0
                if key not in new or s > new[key]:
                    new[key], back[key] = s, (state, c)
        best = new
        came.append(back)
        if len(came) >= check:
            alive, steps = set(best), len(came)
            while len(alive) > 1 and steps:
                steps -= 1
                alive = {came[steps][at][0] for at in alive}
            if steps:
                out.append(trace(next(iter(alive)), steps))
                came = came[steps:]
            check = 2 * len(came) + STEPS
    return "".join(out) + trace(max(best, key=lambda x: best[x] + logp[x[0]][x[1]][OTHER]), len(came))


def places_of(entry: str, text: str) -> Iterator[int]:
    at = text.find(entry)
    while at >= 0:
        yield at
        at = text.find(entry, at + 1)


def inside(text: str, entries: dict[str, bool], logp: list) -> set[str]:
    """The entries (True: only the beginning of a word) that letters without blanks hold as words: where the likeliest
    reading with a word's end at the entry's ends is at most SLACK less likely than the likeliest of all."""
    found = [(e, i) for e in entries for i in places_of(e, text)]
    if not found:
        return set()
    k, n = [letter(c) for c in text], len(text)
    pair = [OTHER, OTHER, *k]  # letters before place i are pair[i], pair[i + 1]
    ends = lambda i: 0.0 if i == n else COST["break"] - 1.0
    # the best that can follow place i: within a word, after its first letter, at its beginning
    within, second, fresh = (array("d", [-math.inf]) * (n + 1) for _ in range(3))
    fresh[n] = 0.0
    for i in range(n, -1, -1):
        a, b = pair[i], pair[i + 1]
        old, young, new = logp[a][b], logp[OTHER][b], logp[b][OTHER]
        if i < n:
            fresh[i] = new[k[i]] + second[i + 1]
            within[i] = max(old[OTHER] - ends(i) + fresh[i], old[k[i]] + within[i + 1])
            second[i] = max(young[OTHER] - ends(i) + fresh[i], young[k[i]] + within[i + 1])
        else:
            within[i], second[i] = old[OTHER] + fresh[i], young[OTHER] + fresh[i]
    # and the best that can come before it, if a word begins there
    done, long, short = array("d", [0.0]), -math.inf, -math.inf
    for i in range(n):
        a, b = pair[i], pair[i + 1]
        long, short = max(long + logp[a][b][k[i]], short + logp[OTHER][b][k[i]]), done[i] + logp[b][OTHER][k[i]]
        a, b = pair[i + 1], pair[i + 2]
        done.append(max(long + logp[a][b][OTHER], short + logp[OTHER][b][OTHER]) - ends(i + 1))
    out = set()
    for e, i in found:
        score, (a, b) = done[i], (pair[i + 1], OTHER)
        for x in k[i : i + len(e)]:
            score += logp[a][b][x]
            a, b = b, x
        j = i + len(e)
        score += (within if len(e) > 1 else second)[j] if entries[e] else logp[a][b][OTHER] - ends(j) + fresh[j]
        if score >= fresh[0] - SLACK:
            out.add(e)
    return out


class Restorer:
    def __init__(self, logp: np.ndarray) -> None:
        self.logp = logp = logp.tolist()
        short = lru_cache(maxsize=1 << 16)(lambda x, breaks: viterbi(lattice(x, breaks), logp))
        self.decode = lambda x, breaks=False: (short if len(x) <= REMEMBERED else short.__wrapped__)(x, breaks)

    def span(self, x: str) -> str:
        """Spaced-out letters as words, other spans as they are likeliest."""
        return self.decode(x, spaced_out(x))

    def readings(self, x: str) -> list[str]:
        """What is looked through for words: spaced-out letters as one word and as words, other spans as one."""
        return [self.decode(x), *([self.decode(x, True)] if spaced_out(x) else [])]

    def text(self, text: str) -> str:
        out, at = [], 0
        for m in find_spans(text):
            out += [text[at : m.start()], self.span(m[0])]
            at = m.end()
        return "".join([*out, text[at:]])


# -- the scorer -----------------------------------------------------------------

_WORD = re.compile(r"[^\W\d_]+")


def words_in_context(text: str, restorer: Restorer, known: dict[str, str]) -> dict[str, int]:
    """Each word with a hash of its neighbours where it first stands. Copies of a text give a word one context; a
    word that is put into many texts has many. ``known`` holds each word once for all texts."""
    words = [known.setdefault(w, w) for w in map(str.lower, _WORD.findall(text))]
    out: dict[str, int] = {}
    for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
        if word not in out:
            out[word] = hash((before, after))
    for m in find_spans(text):
        near = hash((text[max(0, m.start() - 20) : m.start()], text[m.end() : m.end() + 20]))
        for reading in restorer.readings(m[0]):
            for word in _WORD.findall(reading):
                out.setdefault(known.setdefault(word, word), near)
    return out


def entries_of(word: str, rules: ToxicRules) -> list[str]:
    """The word, and its stems, written with a star."""
    return [word, *(word[:n] + "*" for n in range(rules.stem, min(len(word), rules.longest + 1)))]


def choose_entries(docs: list[tuple[dict[str, int], int]], rules: ToxicRules) -> list[str]:
    """Words and stems, the best first; words that one takes in no longer count for the others."""
    places = {y: {(w, near) for words, t in docs if t == y for w, near in words.items()} for y in (0, 1)}
    count = {y: Counter(w for w, _ in places[y]) for y in (0, 1)}
    base = sum(y for _, y in docs) / len(docs)
    toxic, clean = Counter(), Counter()
    for word, n in count[1].items():
        for e in entries_of(word, rules):
            toxic[e] += n
    for word, n in count[0].items():
        for e in entries_of(word, rules):
            if e in toxic:
                clean[e] += n
    least = math.log(max(2, len(toxic))) + rules.margin

    def gain(e: str) -> float:
        a, b = toxic[e], clean[e]
        share = a / (a + b) if a else 0.0
        if a < rules.support or share < rules.precision:
            return 0.0
        return a * math.log(share / base) + (b * math.log((1 - share) / (1 - base)) if b else 0.0)

    gains = {e: g for e in toxic if (g := gain(e)) > least}
    words_of: dict[str, list[str]] = defaultdict(list)
    for word in count[1]:
        for e in entries_of(word, rules):
            if e in gains:
                words_of[e].append(word)
    chosen, gone = [], set()
    while gains and len(chosen) < rules.entries:
        best = max(gains, key=lambda e: (gains[e], e[-1:] != "*", len(e)))
        chosen.append(best)
        touched = set()
        for word in words_of[best]:
            if word not in gone:
                gone.add(word)
                for e in entries_of(word, rules):
                    toxic[e] -= count[1][word]
                    clean[e] -= count[0].get(word, 0)
                    touched.add(e)
        gains.pop(best)
        for e in touched & gains.keys():
            gains[e] = gain(e)
            if gains[e] <= least:
                gains.pop(e)
    return chosen


def matches(word: str, lexicon: dict, lengths: list[int]) -> list[str]:
    """The entries that match a word; lengths: of the lexicon's stems."""
    return [e for e in (word, *(word[:n] + "*" for n in lengths if n < len(word))) if e in lexicon]


def stem_lengths(lexicon: Iterable[str]) -> list[int]:
    return sorted({len(e) - 1 for e in lexicon if e.endswith("*")})


def fit(rows: list[tuple[str, int]], logp: np.ndarray, rules: ToxicRules = ToxicRules()) -> ToxicModel:
    """Lexicon and weights from (text, toxic) rows; equal texts count once."""
    restorer = Restorer(logp)
    seen: dict[str, int] = {}
    for text, toxic in rows:
        seen.setdefault(text or "", int(toxic))
    known: dict[str, str] = {}
    docs = [(words_in_context(t, restorer, known), y) for t, y in seen.items()]
    model = ToxicModel(logp)
    n_toxic = sum(y for _, y in docs)
    if not docs or not n_toxic or n_toxic == len(docs):
        model.bias = math.log((n_toxic + 0.5) / (len(docs) - n_toxic + 0.5)) - 1.0 if docs else -3.0
        return model
    lexicon = choose_entries(docs, rules)
    place, lengths = {e: i for i, e in enumerate(lexicon)}, stem_lengths(lexicon)
    x = np.zeros((len(docs), len(lexicon) + 1))
    x[:, 0] = 1
    for row, (words, _) in zip(x, docs, strict=True):
        for word in words:
            for e in matches(word, place, lengths):
                row[place[e] + 1] = min(MOST, row[place[e] + 1] + 1)
    y = np.array([t for _, t in docs], float)
    # ridge logistic regression by Newton steps; columns are the bias and how many words each entry matched
    beta, ridge = np.zeros(x.shape[1]), np.r_[1e-6, np.full(len(lexicon), 0.1)]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    model.bias, model.weights = float(beta[0]), dict(zip(lexicon, beta[1:].tolist(), strict=True))
    return model


def logistic(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_DIGIT, _SIGN, _BEFORE, _PART, _NEVER = (np.zeros(256, bool) for _ in range(5))
_DIGIT[48:58] = True
#: One-byte signs of _SPANS: within a word, and before its first letter.
_SIGN[list(b"0123456789@$!|+(*.-_")] = True
_BEFORE[list(b"0123456789@$!|+(")] = True
_PART[list(PARTING.encode())] = True
#: What may stand alone between separators, by first bytes.
_LONE = _LETTER | _BEFORE
#: One-byte characters that no span holds.
_NEVER[:128] = ~(_LETTER | _SIGN | _PART)[:128]
_NEVER[65:91] = False
_DOUBLE = re.compile(r"(?<![^\W\d_])[^\W\d_]*?([^\W\d_])\1[^\W\d_]*")


def ahead(x: np.ndarray, k: int) -> np.ndarray:
    """The flags k places on."""
    out = np.zeros(len(x), bool)
    out[: max(0, len(x) - k)] = x[k:]
    return out


def suspicious(low: np.ndarray) -> np.ndarray:
    """Places in lower-cased bytes; every match of _SPANS holds one. Each test is of a part that an alternative cannot
    be without, with any byte over 127 as a letter."""
    letters, sign = _LETTER[low], _SIGN[low]
    # signs within a word: a letter, a sign, and a sign or letter; before a word: a sign and a letter
    flag = letters & ahead(sign, 1) & ahead(sign | letters, 2)
    flag |= _BEFORE[low] & ahead(letters, 1)
    # a letter three times
    same = low[:-1] == low[1:]
    flag[:-2] |= same[:-1] & same[1:] & letters[:-2]
    wide = low >= 128
    if wide.any():
        for sign_of in ("€", "£"):
            found = wide.copy()
            for k, byte in enumerate(sign_of.encode()):
                found &= ahead(low == byte, k)
            flag |= found
        for k in (2, 3, 4):  # letters of so many bytes
            same = np.zeros(len(low), bool)
            same[:-k] = wide[:-k] & (low[:-k] == low[k:])
            found = same.copy()
            for i in range(1, 2 * k):
                found &= ahead(same, i)
            flag |= found
    # four single characters, one or two separators apart; by first bytes of characters
    first = np.flatnonzero((low & 0xC0) != 0x80) if wide.any() else None
    chars = low if first is None else low[first]
    one, part = _LONE[chars], _PART[chars]
    follows = one & ahead(part, 1)
    two = ahead(part, 2)
    chain = one
    for _ in range(3):
        chain = follows & (ahead(chain, 2) | (two & ahead(chain, 3)))
    plain = _LETTER[chars] & (chars < 128) | _DIGIT[chars]
    chain[1:] &= ~plain[:-1]
    if first is None:
        flag |= chain
    else:
        flag[first[chain]] = True
    return np.flatnonzero(flag)


def windows(text: bytes, low: np.ndarray, places: np.ndarray) -> Iterator[str]:
    """The stretches of a text that hold places. They end where no span goes on: after a character that is in none,
    and after a blank behind two letters or digits, as spans go over blanks only between single characters."""
    end = _NEVER[low]
    plain = (_LETTER[low] & (low < 128)) | _DIGIT[low]
    end[2:] |= (low[2:] == 32) & plain[1:-1] & plain[:-2]
    ends = np.append(np.flatnonzero(end) + 1, len(text))
    which = np.unique(np.searchsorted(ends, places, "right"))
    for k in which.tolist():
        yield text[ends[k - 1] if k else 0 : ends[k]].decode("utf-8", "replace")


class Finder:
    """Finds words of a model's lexicon in texts, as written, restored, or with letters doubled."""

    def __init__(self, model: ToxicModel) -> None:
        self.model, self.restorer = model, Restorer(model.logp)
        self.known = []
        for e in model.weights:
            w, end = e.removesuffix("*"), r"[^\W\d_]*" if e.endswith("*") else r"(?![^\W\d_])"
            self.known.append((e, w.encode(), self.squeezed(np.frombuffer(w.encode(), np.uint8)), re.compile(rf"(?<![^\W\d_]){re.escape(w)}{end}")))

        # in restored words a double letter is no evidence, so they are compared without
        self.tight = {self.tighten(e): e for e in model.weights}
        self.lengths = stem_lengths(self.tight)

        # a word's own entry is the narrower one, so it comes last
        self.stems = {e.removesuffix("*"): e.endswith("*") for e in sorted(self.tight, key=lambda e: e[-1:] != "*")}

    @staticmethod
    def tighten(word: str) -> str:
        return re.sub(r"(.)\1+", r"\1", word)

    def restored_matches(self, word: str) -> list[str]:
        return [self.tight[e] for e in matches(self.tighten(word), self.tight, self.lengths)]

    @staticmethod
    def squeezed(low: np.ndarray) -> bytes:
        return low[np.append(True, low[1:] != low[:-1])].tobytes() if len(low) else b""

    def words(self, plain: bytes, low: np.ndarray) -> dict[str, set[str]]:
        """The entries found in a text, each with the words that it matches."""
        lowered = low.tobytes()
        hits: dict[str, set[str]] = defaultdict(set)
        for e, raw, _, exact in self.known:
            if raw in lowered and (own := set(exact.findall(lowered.decode("utf-8", "replace").lower()))):
                hits[e] = own
        tight = self.squeezed(low)
        absent = [squeezed for e, _, squeezed, _ in self.known if e not in hits and squeezed in tight]
        if absent:
            for m in _DOUBLE.finditer(lowered.decode("utf-8", "replace")):
                if self.squeezed(np.frombuffer(m[0].encode(), np.uint8)).startswith(tuple(absent)):
                    word = viterbi(lattice(m[0]), self.restorer.logp)
                    for e in self.restored_matches(word):
                        hits[e].add(word)
        places = suspicious(low)
        if len(places):
            for stretch in windows(plain, low, places):
                for m in find_spans(stretch):
                    readings = self.restorer.readings(m[0])
                    own: dict[str, set[str]] = defaultdict(set)
                    for reading in reversed(readings):  # what one reading has found, the next does not count again
                        more = [(e, word) for word in _WORD.findall(reading) for e in self.restored_matches(word) if e not in own]
                        for e, word in more:
                            own[e].add(word)
                    for run in _WORD.findall(readings[-1].replace(" ", "")) if len(readings) > 1 else []:
                        for x in inside(self.tighten(run), self.stems, self.restorer.logp):
                            if (e := self.tight[x + "*" * self.stems[x]]) not in own:
                                own[e].add(x)
                    for e, found in own.items():
                        hits[e] |= found
        return hits


def learn(docs: DataFrame, labels: DataFrame, corpus: DataFrame, rules: ToxicRules = ToxicRules()) -> ToxicModel:
    """The trigram model of the whole corpus, and the scorer of a bounded sample of docs that labels mark.

    A document with several labels is toxic if one says so; rows that repeat an id and a
    text count once. The scorer is learned in one task; the driver gets the model alone.
    """
    logp = log_model(trigram_counts(corpus).collect(), rules.smoothing)
    marked = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = docs.select("doc_id", F.xxhash64("text").alias("text_hash")).distinct().join(marked, "doc_id")

    def make(rows: list[dict]) -> ToxicModel:
        rows = sorted(rows, key=lambda r: r["text_hash"])
        return fit([(r["text"], r["toxic"]) for r in rows], logp, rules)

    return in_one_task(sampled_texts(docs, marks, rules.sample, "toxic"), make)


def score(docs: DataFrame, model: ToxicModel, restored_text: bool = False) -> DataFrame:
    """(doc_id, score, predicted, n_words_found[, restored]) of whole texts, a row per input row.

    Null and empty texts get the score of a text without any word of the lexicon.
    Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        finder = Finder(model)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j, part, at in chunks(data, offsets):
                low = _LOWER[part]
                scores, found, restored = [], [], []
                for d in range(j - i):
                    own = slice(at[d], at[d + 1])
                    plain = part[own].tobytes()
                    hits = finder.words(plain, low[own])
                    found.append(len(hits))
                    scores.append(model.score(hits))
                    if restored_text:
                        restored.append(finder.restorer.text(plain.decode("utf-8", "replace")))
                cols = [batch.column(0).slice(i, j - i), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(found, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(restored, pa.string())] if restored_text else []), names)

    names = ["doc_id", "score", "predicted", "n_words_found"] + ["restored"] * restored_text
    return docs.select("doc_id", "text").mapInArrow(lean_batches(tell), "doc_id long, score double, predicted int, n_words_found long" + ", restored string" * restored_text)


def reject(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The documents, all their columns, that score below a half."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        finder = Finder(model)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            clean = np.ones(batch.num_rows, bool)
            for i, j, part, at in chunks(data, offsets):
                low = _LOWER[part]
                for d in range(j - i):
                    own = slice(at[d], at[d + 1])
                    clean[i + d] = model.score(finder.words(part[own].tobytes(), low[own])) < 0.5
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(lean_batches(keep), docs.schema)
