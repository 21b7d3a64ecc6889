"""Every operator on documents with nulls in all columns, repeated rows and ids, empty and very long texts, and clashing column names."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chunkloom.llm import decontam, langid, minhash, mixing, quality, substring, suffix_array, toxicity
from .fixtures import awkward_docs, byte_removal, docs_frame, shingles, word_removal, words_of


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocab = ["".join(r.choices("abcdefgh", k=4)) for _ in range(3000)]
    long = " ".join(r.choices(vocab, k=30_000))
    text = " ".join(r.choices(vocab, k=90))
    token = "x1" * 200_000
    out = [(None, text, None, None, None), (None, text, None, None, None), (None, None, None, None, None), (1, None, "en", "a", 0), (1, "", "en", "a", 0), (1, text, "en", "a", 1), (1, text, "de", "b", 1)]
    out += [(2, " \n\t\x0b ", "en", "b", 2), (3, long, "en", "b", 3), (4, long + " end", "en", "b", 4), (5, token, "en", None, 5), (6, "a b c", "en", "a", 1), (6, "a b c", "en", "a", 1)]
    return out + [(i + 10, t, lang, s, n) for i, t, lang, s, n in awkward_docs(2, 20)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = docs_frame(spark, rows)
    for name in ("cleaned_text", "lost_pct", "n_lines", "lines_", "words_", "row", "own_id", "group", "component_id", "taken", "size_", "label", "text_hash"):
        df = df.withColumn(name, F.lit(7))
    return df.cache()


def per_row(want, ids):
    """What a brute-force version says by id, for rows whose ids it can tell apart."""
    once = {i for i, n in Counter(ids).items() if n == 1 and i is not None}
    return {i: x for i, x in want.items() if i in once}


def test_removal(docs, rows):
    ids = [r[0] for r in rows]
    got = suffix_array.removal_report(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(ids)
    want = byte_removal([(2**62 if i is None else i, t) for i, t, *_ in rows])
    have = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}
    assert all(have[i] == x for i, x in per_row(want, ids).items())
    assert sum(r.n_removed for r in got if r.doc_id is None) == 2 * len(rows[0][1])
    got = substring.removal_report(docs).collect()
    have = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got}
    assert Counter(r.doc_id for r in got) == Counter(ids)
    want = word_removal([(i, t) for i, t, *_ in rows])
    assert all(have[i] == x for i, x in per_row(want, ids).items())


def test_near_duplicates_and_quality(docs, rows):
    got = minhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingles(t))) for i, t, *_ in rows)
    assert {r.component_id for r in got if r.doc_id is None and r.n_shingles} == {1} and {r.component_id for r in got if r.doc_id == 4} == {3}
    report = quality.quality_report(docs)
    got = report.collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((i, len(words_of(t))) for i, t, *_ in rows)
    for r in got:
        assert r.cleaned_text is None or len(r.cleaned_text) <= 400_000
    cleaned = quality.clean_lines(docs)
    assert set(cleaned.columns) == set(docs.columns) | {"n_removed_lines"} and cleaned.filter("row = 7").count() == len(rows)
    w = words_of(rows[8][1])
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {j for k, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for j in range(k, k + 3)}
    assert {r.n_repeat_words for r in got if r.doc_id == 3} == {len(covered)}


def test_models(docs, rows):
    import numpy as np

    model = toxicity.fit([("con idiot " + str(i), 1) for i in range(9)] + [("con di " + str(i), 0) for i in range(30)], np.full((27, 27, 27), -3.3))
    assert toxicity.score(docs, model).count() == len(rows) and toxicity.reject(docs, model).columns == docs.columns
    rules = langid.LangRules(sample=40, buckets=1 << 10, epochs=1)
    found = langid.learn(docs, rules)
    got = langid.identify(docs, found, rules).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id in (2,)} == {"und"}
    assert pytest.approx([r.score for r in sorted(got, key=str)]) == [r.score for r in sorted(langid.identify(docs, langid.learn(docs, rules), rules).collect(), key=str)]


def test_samples_of_a_hot_row(spark):
    """A row that is a third of the table counts once in a sample."""
    rows = [(None, "same text over and over", "en", None, 0)] * 300 + [(i, f"text number {i} is here", "en" if i % 2 else "de", None, 0) for i in range(600)]
    df = docs_frame(spark, rows, False)
    marks = df.groupBy("doc_id", F.xxhash64("text").alias("text_hash")).agg(F.min("lang").alias("lang"))
    from chunkloom.llm.common import sampled_texts

    got = sampled_texts(df, marks, 1000, "lang").collect()
    assert len(got) == 601


def test_leaks(spark, docs, rows):
    items = [(0, " ".join(words_of(rows[8][1])[100:140])), (0, rows[0][1]), (0, rows[0][1]), (None, rows[0][1]), (3, None), (4, ""), (5, rows[8][1][:60_000])]
    bench = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, doc_id string")
    want, wanted = Counter(), [(k, shingles(x)) for k, x in items]
    for i, t, *_ in rows:
        b = shingles(t)
        for k, a in wanted:
            if a and 100 * len(a & b) >= 75 * len(a):
                want[(i, k, len(a), len(a & b))] += 1
    for rules in (decontam.LeakRules(), decontam.LeakRules(part=2), decontam.LeakRules(part_bytes=1000)):
        assert Counter(tuple(r) for r in decontam.find_leaks(docs, bench, rules).select("doc_id", "item_id", "n_item", "n_common").collect()) == want
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(i for i, t, *_ in rows if not any(s and 100 * len(s & shingles(t)) >= 75 * len(s) for _, s in wanted))


def test_mix_by_its_slots(docs, rows):
    """What each document gives, counted plainly from the slots and the packing."""
    rules = mixing.MixRules(block=16, shard=64)
    mix = mixing.mix_sources(docs, rules)
    key = {r.source: r.source_key for r in mix.targets.collect()}
    n_blocks = {r.source_key: r.n_blocks for r in mix.targets.collect()}
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    starts = mixing.packed(sized, rules).collect()
    spans = {}
    for r in starts:
        spans.setdefault(key[r.source], []).append((r.start, r.start + r["size"], r.doc_id))
    for own in spans.values():  # packed end to end, nothing twice
        full = sorted(x[:2] for x in own if x[0] < x[1])
        assert all(a[1] == b[0] for a, b in zip(full, full[1:])) and (not full or full[0][0] == 0)
    slots, taken = mix.slots.collect(), Counter()
    for k in n_blocks:
        epochs = {}
        for s in slots:
            if s.source_key == k:
                epochs.setdefault(s.epoch, []).append(s.block)
        for e, blocks in epochs.items():
            assert len(set(blocks)) == len(blocks) and (e == max(epochs) or len(blocks) == n_blocks[k])
    for s in slots:
        lo, hi = s.block * rules.block, s.block * rules.block + s.words
        for a, z, i in spans[s.source_key]:
            if a < hi and lo < z:
                taken[(s.source_key, i)] += min(z, hi) - max(a, lo)
    got = Counter()
    for r in mix.documents.collect():
        got[(key[r.source], r.doc_id)] += r.taken
    assert +got == +taken and sum(taken.values()) > 0
    assert Counter(r.doc_id for r in mix.documents.collect()) == Counter(r[0] for r in rows)
