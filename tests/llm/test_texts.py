"""Removal, near-duplicates, leaks, quality and mixing against plain versions on awkward inputs."""

import random
from collections import Counter

import pytest

from chunkloom.llm import decontam, minhash, mixing, quality, repeats, substring, suffix_array
from .fixtures import awkward_docs, byte_removal, docs_frame, near_components, shingles, word_removal, words_of


@pytest.fixture(scope="module")
def rows():
    return awkward_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_frame(spark, rows).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_suffix_array_against_all_windows(docs, rows, nothing):
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.removal_report(docs).collect()}
    assert got == {(i, *x) for i, x in byte_removal(rows).items()}
    assert suffix_array.removal_report(nothing).count() == 0


def test_removed_texts_keep_rows_and_columns(docs, rows):
    out = suffix_array.remove_repeats(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    want = byte_removal(rows)
    assert out.count() == len(rows)
    for i, text, *_ in rows:
        assert (texts[i] is None) == (text is None)
        if text is not None and want[i][1] == 0:
            assert texts[i] == text


def grouped_repeats(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.repeat, r.length), []).append((r.doc_id, r.start))
    return [(length, sorted(places)) for (_, length), places in out.items()]


def test_a_shared_passage_is_one_repeat(spark):
    shared = "".join(random.Random(6).choices("abcdefgh ", k=300))
    texts = {1: "x" * 5 + shared + "left tail one", 2: "yy" + shared + "another", 3: "zzz" + shared[:60] + "zzz", 4: "nothing of it"}
    rows = [(i, t, None, None, 0) for i, t in texts.items()]
    found = grouped_repeats(suffix_array.maximal_repeats(docs_frame(spark, rows, False)))
    size = len(shared)
    assert any(n == 60 and {d for d, _ in places} == {1, 2, 3} for n, places in found)
    assert any({d for d, _ in places} == {1, 2} and places[0][1] + n == 5 + size for n, places in found) and len(found) == 2
    alone = {1: "x" * 5 + shared + "left tail one", 2: "yy" + shared + "another"}
    found = grouped_repeats(suffix_array.maximal_repeats(docs_frame(spark, [(i, t, None, None, 0) for i, t in alone.items()], False)))
    assert found == [(size, [(1, 5), (2, 2)])]


@pytest.mark.parametrize("nested", [False, True])
def test_byte_repeats_have_every_occurrence(docs, rows, nested):
    found = grouped_repeats(suffix_array.maximal_repeats(docs.filter("text not like 'aa%'"), nested=nested))
    texts = [(i, (t or "").encode()) for i, t, *_ in rows if not (t or "").startswith("aa")]
    covered = {}
    for n, places in found:
        own = {b[s : s + n] for i, b in texts for d, s in places if i == d}
        (piece,) = own
        assert n >= 50 and len(piece) == n
        assert places == sorted((i, k) for i, b in texts for k in range(len(b) - n + 1) if b.startswith(piece, k))
        for d, s in places:
            covered.setdefault(d, set()).update(range(s, s + n))
    where = {}
    for i, b in texts:
        for k in range(len(b) - 49):
            where.setdefault(b[k : k + 50], set()).add(i)
    want = {}
    for i, b in texts:
        for k in range(len(b) - 49):
            if len(where[b[k : k + 50]]) > 1:
                want.setdefault(i, set()).update(range(k, k + 50))
    assert covered == want and found


def test_word_repeats_have_every_occurrence(docs, rows):
    found = grouped_repeats(substring.maximal_repeats(docs))
    texts = [(i, words_of(t)) for i, t, *_ in rows]
    for n, places in found:
        piece = next(w[s : s + n] for i, w in texts for d, s in places if i == d)
        assert n >= 35
        assert places == sorted((i, k) for i, w in texts for k in range(len(w) - n + 1) if w[k : k + n] == piece)
    covered = {(d, k) for n, places in found for d, s in places for k in range(s, s + n)}
    removed = {i: x[1] for i, x in word_removal(rows).items()}
    assert found and Counter(d for d, _ in covered) == Counter({i: n for i, n in removed.items() if n})


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("words", [False, True])
def test_hashes_only_route(rows, monkeypatch, weak, words):
    """All steps in one process, also with hashes of which most clash: results hang on texts alone."""
    import numpy as np
    import pyarrow as pa

    if weak:
        hashes = repeats.word_hashes
        monkeypatch.setattr(repeats, "word_hashes", lambda *x: hashes(*x) & np.uint64(3))
        monkeypatch.setattr(repeats, "digest", lambda data, lo, hi: np.zeros(len(lo), np.uint64))
    module, rules = (substring, substring.WORDS) if words else (suffix_array, suffix_array.BYTES)
    layout = repeats.Layout(["doc_id", "text"])
    table = pa.table({"c0": [r[0] for r in rows], "c1": [r[1] for r in rows], "hash": pa.array(range(len(rows)), pa.int64())})
    texts = repeats.load_texts(table, layout)
    mail = repeats.find_again(repeats.send_keys(texts, 0, rules, 1))
    runs = repeats.find_runs(texts, mail, rules, 1)
    told = module.match(repeats.load_part(repeats.send_runs(texts, 0, runs), rules))
    row, start, end = repeats.union_spans(*repeats.placed(texts, runs, told))
    removed = Counter()
    for r, a, z in zip(row, start, end):
        removed[r] += int(z - a)
    want = (word_removal if words else byte_removal)(rows)
    assert [removed[r] for r in range(len(rows))] == [want[i][1] for i in texts.ids.tolist()]


def test_long_periodic_text_takes_seconds(spark):
    import time

    text = "abcdefg " * 40_000
    begin = time.time()
    got = suffix_array.removal_report(docs_frame(spark, [(1, text, None, None, 0), (2, "x" + text[8:], None, None, 0), (3, text, None, None, 0)])).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: len(text) - 8, 3: len(text)} and time.time() - begin < 60


def test_no_column_name_is_reserved(spark):
    from pyspark.sql import functions as F

    rows = awkward_docs(4, 20) + [(None, "same text " * 30, None, None, 0)] * 2
    df = docs_frame(spark, rows)
    for name in ("__hash", "__bucket", "c0", "c1", "hash", "bucket", "row", "text_hash"):
        df = df.withColumn(name, F.lit(7))
    out = suffix_array.remove_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows) and {r["__hash"] for r in out.collect()} == {7}
    assert {r.n_removed for r in suffix_array.removal_report(df).collect() if r.doc_id is None} == {0}
    assert substring.removal_report(df).count() == len(rows) and minhash.one_of_each(df).columns == df.columns


def test_stack_scan():
    intervals, outer = suffix_array.lcp_intervals([60, 55, 10, 70, 70, 52], 50)
    assert set(intervals) == {(60, 0, 1), (55, 0, 2), (70, 3, 5), (52, 3, 6)} and outer == [(0, 2), (3, 6)]


def test_suffix_trees_against_all_windows(docs, rows, nothing):
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal_report(docs).collect()}
    assert got == {(i, *x) for i, x in word_removal(rows).items()}
    assert substring.removal_report(nothing).count() == 0


def test_prefixes_grow_until_groups_fit():
    import numpy as np

    symbols = np.array([1, 2] * 60 + [3, 4, 5] * 20, np.uint32)
    windows = np.arange(len(symbols) - 36)
    for most in (4, 16, 1000):
        groups = list(substring.prefix_groups(symbols, windows, windows, 35, most=most))
        assert sorted(np.concatenate([w for _, w in groups]).tolist()) == windows.tolist()
        found = sorted(x for d, w in groups for x in substring.deep_nodes(symbols, windows, w, 35, d)[1].tolist())
        plain = [tuple(symbols[i : i + 35]) for i in windows]
        assert found == [i for i in windows.tolist() if plain.count(plain[i]) > 1]


def near_rows(docs, **rules):
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, minhash.NearRules(**rules)).collect()]


def plain_rows(rows):
    return Counter((i, n, c, c is None or i == c) for i, n, c in near_components(rows))


def test_near_duplicates_against_all_pairs(docs, rows, nothing):
    assert Counter(near_rows(docs)) == plain_rows(rows)
    assert minhash.near_duplicates(nothing).count() == 0


def variants(seed, n, words=60, most=14):
    """Texts around one template: some near it, some only near others, most near nothing."""
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, most)):
            w[r.randrange(words)] = f"x{r.randrange(40)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_of_one_template(spark, monkeypatch):
    rows = [(i, t, None, None, 0) for i, t in enumerate(variants(1, 150) + variants(2, 60, 200, 12) + variants(3, 60, 8, 2))]
    want = plain_rows(rows)
    assert len({x[2] for x in want}) > 20
    assert Counter(near_rows(docs_frame(spark, rows))) == want
    monkeypatch.setattr(minhash, "TILE", 20)
    monkeypatch.setattr(minhash, "LEADER_PAIRS", 10)  # many tiles and salted leaders give the same
    assert Counter(near_rows(docs_frame(spark, rows), slack=1.0)) == want


def test_near_duplicates_of_repeated_ids(spark):
    make = lambda k: [" ".join(f"{k}{c}{i}" for i in range(60)) for c in "ab"]
    (x, y), (z, u), (v, w) = map(make, "pqr")
    rows = [(3, x), (5, y), (5, x + " end")]
    rows += [(15, z), (15, u), (18, u + " end"), (19, z + " end")]
    rows += [(None, v), (None, v + " end"), (None, w), (24, w), (24, w), (None, None), (None, "")]
    rows = [(i, t, None, None, 0) for i, t in rows]
    assert Counter(near_rows(docs_frame(spark, rows))) == plain_rows(rows)


def test_one_of_each_group_stays(spark, docs, rows):
    x, y = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    few = [(3, x, "en", None, 0), (5, x + " end", "en", None, 0), (5, y, "de", None, 0), (7, y, "en", "s", 1), (7, y, "en", "s", 1), (8, "z", None, None, 0), (8, "z", None, None, 0), (None, x, None, None, 0), (None, None, None, None, 0), (9, "", None, None, 0)]
    out = minhash.one_of_each(docs_frame(spark, few))
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert Counter(got) == Counter([(3, x), (5, y), (8, "z"), (None, None), (9, "")])
    kept = minhash.one_of_each(docs).collect()
    want = near_components(rows)
    full = {c for _, n, c in want if n}
    assert sorted(r.doc_id for r in kept if shingles(r.text)) == sorted(full)
    assert Counter(r.doc_id for r in kept if not shingles(r.text)) == Counter(i for i, n, _ in want if not n)


def test_leaks_against_all_pairs(spark, docs, rows):
    texts = {i: t for i, t, *_ in rows}
    long = words_of(texts[60])
    items = [(0, " ".join(long[100:140])), (1, " ".join(long[3000:3012]) + " never seen words here at all"), (2, None), (3, ""), (4, "one two three four"), (5, " ".join(long[5:25]).upper()), (6, " ".join(long[7:17] + ["other"] + long[17:60]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_item, r.n_common) for r in decontam.find_leaks(docs, bench).collect()}
    want = set()
    for i, t, *_ in rows:
        for k, x in items:
            a, b = shingles(x), shingles(t)
            if a and 100 * len(a & b) >= 75 * len(a):
                want.add((i, k, len(a), len(a & b)))
    assert got == want and any(k == 6 for _, k, *_ in want)
    parts = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench, decontam.LeakRules(part=2)).collect()}
    assert parts == {x[:2] for x in want}
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.select("doc_id").collect()} == set(texts) - {x[0] for x in want}
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0


def test_quality_counts(docs, rows, nothing):
    got = {r.doc_id: r for r in quality.quality_report(docs).collect()}
    for i, t, *_ in rows:
        w, lines = words_of(t), [x for x in (t or "").split("\n") if words_of(x)]
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
    assert quality.quality_report(nothing).count() == 0


def test_quality_lines(spark):
    good = "A sentence that is plainly long enough to be prose, and ends well."
    text = "\n".join([good, "Home | About | Contact", "Accept all cookies to go on with this page.", "### $$$ ||| &&& >>> <<<", "short", "Short.", good])
    r = quality.clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.cleaned_text == "\n".join([good, "Short.", good]) and r.n_removed_lines == 4


def test_mix_reaches_targets(docs, rows, nothing):
    mix = mixing.mix_sources(docs, mixing.MixRules(block=16, shard=64))
    got = mix.documents.collect()
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    taken, sizes, targets = {}, {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        sizes[r.source] = r.source_size
        targets[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    assert sum(targets.values()) == pytest.approx(total) and sum(sizes.values()) == total
    want, weights, full = {}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        w = sum(weights[s] for s in order if s not in full)
        want = {s: 3 * sizes[s] if s in full else rest * weights[s] / w for s in order}
        over = {s for s in order if s not in full and want[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for s in order:
        assert targets[s] == pytest.approx(want[s]) and abs(taken[s] - targets[s]) <= 1
    again = mixing.mix_sources(docs, mixing.MixRules(block=16, shard=64)).documents.collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    slots = mix.slots.collect()
    assert len({(s.source_key, s.k) for s in slots}) == len(slots)
    assert mixing.mix_sources(nothing).documents.count() == 0


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing.permute(F.col("id"), F.lit(n).cast("long"), F.lit(3), mixing.MixRules()).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))
        back = spark.range(n).select("id", mixing.permute(mixing.permute(F.col("id"), F.lit(n).cast("long"), F.lit(3), mixing.MixRules()), F.lit(n).cast("long"), F.lit(3), mixing.MixRules(), inverse=True).alias("p"))
        assert all(r.id == r.p for r in back.collect())


def test_a_hot_part_stays_small():
    """A passage with many variants meets in one part; what finding its repeats takes grows with its windows, by few bytes of each."""
    import tracemalloc

    import numpy as np

    random.seed(3)
    passage = bytes(random.choices(range(97, 123), k=2000))
    runs = []
    for _ in range(150):
        i = random.randrange(2000)
        runs.append(passage[:i] + b"#" + passage[i + 1 :])
    ids = np.arange(len(runs))
    sizes, once = np.array([len(x) for x in runs], np.uint32), np.ones(len(runs), np.uint32)
    table = repeats.packed([(0, 0, 0, np.frombuffer(b"".join(runs), np.uint8), sizes, once, ids, ids)], repeats.arrow_schema(repeats.RUN_SCHEMA))
    tracemalloc.start()
    part = repeats.load_part(table, suffix_array.BYTES)
    before = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    told = suffix_array.match(part)
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert told.num_rows == 1 and peak < 130 * len(part.windows)


def test_workers_give_back_what_a_group_took():
    import re
    from pathlib import Path

    import pyarrow as pa

    from chunkloom.llm.common import lean

    def held():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) << 10

    def work(table):
        many = [bytes(1000) + i.to_bytes(4) for i in range(100_000)]
        last.append(many[-1])  # stands behind all others, so that these stay the process's own
        return table

    last, before = [], held()
    assert lean(work)(pa.table({"a": [1]})).num_rows == 1
    assert held() - before < 30 << 20
