"""The pipeline and the queries: stages against plain versions, held-out rows of the driver's tables."""

import os
import random
from collections import Counter

import pytest

import corpus_pipeline
from chunkloom.llm import queries, suffix_array, toxicity
from .fixtures import byte_removal, near_components, shingles, words_of

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    vocab = ["".join(r.choices("abcdefghilmnoprstuv", k=r.randint(2, 9))) for _ in range(900)]
    make = lambda k: " ".join(r.choices(vocab, k=k))
    passage, items = make(60), [make(30) for _ in range(6)]
    rows, labels = [], []
    for i in range(400):
        text = make(r.randint(20, 120))
        bad = i % 5 == 1
        if bad:
            w = text.split()
            for x in ("idiot", "moron", "scum"):
                w.insert(r.randrange(len(w)), x)
            text = " ".join(w)
        elif i % 10 == 0:
            text = make(15) + " " + passage + " " + make(15)
        elif i % 37 == 3:
            text = make(20) + " " + items[i % 6] + " " + make(20)
        rows.append((i, text, "en", r.choice(["s1", "s2", "s3", None]), len(text)))
        labels.append((i, 1, int(bad)))
    x, y = make(80), make(80)
    rows += [(500, x, "en", "s1", 0), (502, x + " end", "en", "s1", 0), (502, y, "en", "s2", 0), (503, y, "en", "s2", 0), (503, y, "en", "s2", 0)]
    rows += [(None, x, None, None, None), (600, None, "en", "s1", None), (601, "", "en", None, 0)]
    place = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (9, None)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place


def listed(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "mixing"]

    clean = stages["toxicity"](spark, docs, folder).cache()
    assert clean.columns == docs.columns
    bad = lambda t: "idiot" in words_of(t)
    assert Counter(listed(clean)) == Counter(x for x in listed(docs) if not bad(x[1]))

    kept = stages["minhash_near_dedup"](spark, clean, folder).cache()
    assert kept.columns == docs.columns
    before = [(i, t) for i, t in listed(clean)]
    groups = near_components(before)
    assert sum(bool(shingles(t)) for _, t in listed(kept)) == len({c for _, n, c in groups if n})
    assert Counter(i for i, t in listed(kept) if shingles(t)) == Counter({c for _, n, c in groups if n})
    assert (502, None) not in listed(kept) and [t for i, t in listed(kept) if i == 502] != []

    cut = stages["suffix_array_dedup"](spark, kept, folder).cache()
    assert cut.columns == docs.columns and cut.count() == kept.count()
    want = byte_removal([(i, t) for i, t in listed(kept)])
    assert sum(len((t or "").encode()) for _, t in listed(cut)) == sum(n - m for n, m, *_ in want.values())

    out = stages["benchmark_decontamination"](spark, cut, folder).cache()
    items = [shingles(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaks = lambda t: any(s and 100 * len(s & shingles(t)) >= 75 * len(s) for s in items)
    assert Counter(listed(out)) == Counter(x for x in listed(cut) if not leaks(x[1])) and out.count() < cut.count()

    mixed = stages["mixing"](spark, out, folder).collect()
    sizes = Counter((i, len(words_of(t))) for i, t in listed(out))
    assert Counter((r.doc_id, r["size"]) for r in mixed) == sizes
    taken, target = Counter(), {}
    for r in mixed:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_run_joins_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {"doc_id", "size", "taken", "target"} <= set(rows[0].asDict())
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)


def test_empty_tables_go_through(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_held_out_rows(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [r for r in queries.op6_toxicity(spark, DATA).collect() if r.held_out and toxic.get(r.doc_id) is not None]
    assert len(rows) > 50 and sum(r.predicted == toxic[r.doc_id] for r in rows) >= 0.93 * len(rows)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op7_language_id(spark, DATA).collect() if r.held_out and lang[r.doc_id] is not None]
    assert len(rows) > 100 and sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.99 * len(rows)


def test_samples_are_bounded_and_move_no_other_text(spark, folder):
    """The texts of a sample are read by a broadcast of ids and hashes, at most so many."""
    from chunkloom.llm.common import sampled_texts
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    marks = docs.groupBy("doc_id", F.xxhash64("text").alias("text_hash")).agg(F.min("lang").alias("lang"))
    got = sampled_texts(docs, marks, 25, "lang")
    assert got.count() == 25
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()


def test_queries_have_the_columns_of_their_contracts():
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) == 10
    assert toxicity.ToxicRules().sample == 4000 and suffix_array.BYTES.window == 50
