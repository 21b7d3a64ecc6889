"""Small inputs with every awkward case, and plain versions of what the operators compute."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


def awkward_docs(seed=0, n=60):
    """(doc_id, text, lang, source, n_chars): nulls, blanks, copies, near copies, repeated rows, periodic and long texts."""
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefgé", k=r.randint(2, 6))) for _ in range(150)]
    make = lambda k: " ".join(r.choices(vocab, k=k))
    passage = make(60)
    base = make(300)
    docs = []
    for i in range(n):
        kind = i % 10
        text = make(r.randint(1, 200))
        if kind == 0:
            text = base
        elif kind == 1:
            w = base.split()
            for _ in range(r.randint(1, 5)):
                w[r.randrange(len(w))] = "edit"
            text = " ".join(w)
        elif kind == 2:
            text = make(20) + " " + passage + " " + make(20)
        elif kind == 3:
            text = "aa " * r.choice([1, 34, 35, 36, 80])
        elif kind == 4:
            text = r.choice([None, "", " \n\t ", "x", "one two three four"])
        elif kind == 5:
            text = make(30) + "\n\n" + make(5) + "\x0b" + make(3) + " é" * 40
        docs.append((i, text, r.choice(["en", "de", None]), r.choice(["s1", "s2", None]), len(text or "")))
    docs.append((n, make(4000), "en", "s1", 0))
    docs.append(docs[0])
    return docs


def docs_frame(spark, rows, extra=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if not extra:
        return df
    for name in ("hash", "bucket", "size", "rep", "key", "band", "slot", "v"):
        df = df.withColumn(name, F.lit(name))
    return df


def shingles(text):
    w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in words_of(text)]
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near_components(docs):
    """(doc_id, set size, component) of each row, by all pairs of rows; the component is its smallest id."""
    sets = [shingles(t) for _, t, *_ in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a + 1, len(docs)):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                parent[find(b)] = find(a)
    least = {}
    for x, (i, *_) in enumerate(docs):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return [(i, len(sets[x]), least.get(find(x))) for x, (i, *_) in enumerate(docs)]


def byte_removal(docs, size=50):
    """doc_id -> (bytes, removed, spans, sha256), strings of smaller ids removed."""
    out, seen = {}, {}
    texts = sorted((i, (t or "").encode()) for i, t, *_ in docs)
    for i, b in texts:
        for p in range(len(b) - size + 1):
            seen.setdefault(b[p : p + size], i)
    for i, b in texts:
        keep = bytearray(b"\1" * len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] < i:
                keep[p : p + size] = bytes(size)
        kept = bytes(c for c, k in zip(b, keep) if k)
        out[i] = (len(b), len(b) - len(kept), len(re.findall(rb"\0+", bytes(keep))), hashlib.sha256(kept).hexdigest())
    return out


def word_removal(docs, size=35):
    """doc_id -> (words, removed, sha256), windows that start anywhere else removed; rows are separate texts."""
    from collections import Counter

    texts = [(i, words_of(t)) for i, t, *_ in docs]
    count = Counter(tuple(w[p : p + size]) for _, w in texts for p in range(len(w) - size + 1))
    out = {}
    for i, w in texts:
        keep = [True] * len(w)
        for p in range(len(w) - size + 1):
            if count[tuple(w[p : p + size])] > 1:
                keep[p : p + size] = [False] * size
        kept = [x for x, k in zip(w, keep) if k]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out
