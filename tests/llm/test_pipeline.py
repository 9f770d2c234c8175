"""The pipeline against a plain version of every stage, and its registration."""

import os
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from edge import frame, make, texts, words  # noqa: E402
from test_operators import family_rows, items, plain_classes, plain_contamination, plain_secrets  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from veilframe.llm.queries import QUERIES  # noqa: E402
from veilframe.llm.tokens import tokenizer_path  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    rows = family_rows() + [(9000 + k, f"{t} said by all of them") for k, (_, t) in enumerate(items()) if t] + [(9100, 'here is token = "abcdef0123456789abcdef01" and more'), (9101, "12 34")]
    frame(spark, rows).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items(), "item_id int, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, rows


def test_stages(spark, folder):
    out, rows = folder
    docs = spark.read.parquet(f"{out}/documents.parquet")
    columns = docs.columns
    by_id = dict(rows)

    one = corpus_pipeline.known_language(spark, docs, out).cache()
    assert {r["doc_id"] for r in one.collect()} == {i for i, t in rows if t and re.search(r"[^\W\d_]", t)} and one.columns == columns
    left = [(r["doc_id"], r["text"]) for r in one.collect()]

    two = corpus_pipeline.one_of_each(spark, one, out).cache()
    classes = plain_classes(left, 80, 5)  # near copies: five words, a similarity of 0.8 or more
    assert {r["doc_id"] for r in two.collect()} == {i for i, (_, c) in classes.items() if i == c} and two.columns == columns

    three = corpus_pipeline.without_benchmark(spark, two, out).cache()
    assert three.columns == columns
    kept = {r["doc_id"]: r["text"] for r in three.collect()}
    for r in two.collect():
        n, hit, _ = plain_contamination(r["text"], items())
        assert (r["doc_id"] in kept) == (hit <= 0.8 * n)
        if r["doc_id"] in kept and not hit:
            assert kept[r["doc_id"]] == by_id[r["doc_id"]]

    four = corpus_pipeline.without_secrets(spark, three, out).cache()
    assert four.columns == columns and four.count() == three.count()
    for r in four.collect():
        assert "hex:" not in plain_secrets(r["text"]) and r["n_chars"] == len(r["text"])
        if not plain_secrets(kept[r["doc_id"]]):
            assert r["text"] == kept[r["doc_id"]]

    five = corpus_pipeline.packed(spark, four, out).collect()
    assert {p["doc_id"] for p in five} == set(kept) and all(len(np.frombuffer(p["ids"], "<u4")) == p["length"] for p in five)


def near_rows():
    """Copies whose similarity over five words lies between 0.8 and 0.85, or just below 0.8."""
    rng, out = random.Random(13), []
    for k in range(12):
        base = words(rng, 200, 10**6).split()
        out += [(7000 + 10 * k, " ".join(base)), (7001 + 10 * k, " ".join(base + words(rng, 38 + k, 10**6).split())), (7002 + 10 * k, " ".join(base + words(rng, 60, 10**6).split()))]
    return out


def test_near_copies_of_the_stage(spark):
    rows = near_rows()
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, frame(spark, rows), "").collect()}
    classes = plain_classes(rows, 80, 5)
    assert kept == {i for i, (_, c) in classes.items() if i == c} and {7001, 7011} & kept == set() and 7002 in kept


def test_run(spark, folder):
    """run() against plain versions of all stages, one after the other."""
    from tokenizers import Tokenizer

    out, rows = folder
    done = corpus_pipeline.run(spark, out).collect()
    left = [(i, t) for i, t in rows if t and re.search(r"[^\W\d_]", t)]
    classes = plain_classes(left, 80, 5)
    left = [(i, t) for i, t in left if classes[i][1] == i]
    want = {}
    for i, t in left:
        n, hit, _ = plain_contamination(t, items())
        if hit <= 0.8 * n:
            want[i] = t if not hit else None  # texts with cuts are held against the cut ones' words below
    assert {p["doc_id"] for p in done} == set(want)
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    parts = {}
    for p in done:
        parts.setdefault(p["doc_id"], []).append((p["start"], np.frombuffer(p["ids"], "<u4").tolist()))
    checked = 0
    for i, t in want.items():
        ids = [x for _, own in sorted(parts[i]) for x in own]
        assert ids[-1] == 1
        text = tokenizer.decode(ids[:-1], skip_special_tokens=False)
        assert plain_contamination(text, items())[1] == 0 and not re.search("hex:|access:", plain_secrets(text))
        if t is not None and not plain_secrets(t) and "[SECRET]" not in text:
            assert ids == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
            checked += 1
    assert checked > 50
    sequences = {}
    for p in done:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_windows_hold_the_language_that_was_found(spark, tmp_path):
    """What language ID finds, in rows without a label too, decides which documents share a window."""
    rng = random.Random(19)
    kinds = {"en": "the of and to in is was that with from this have", "de": "der die das und ist nicht ein mit von auch sich wird"}
    rows, spoken = [], {}
    for k in range(400):
        spoken[k] = rng.choice(list(kinds))
        label = None if k % 5 == 0 else spoken[k]
        rows.append((k, " ".join(rng.choice(kinds[spoken[k]].split()) for _ in range(rng.randrange(8, 90))), label, "s", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    known = corpus_pipeline.known_language(spark, docs, str(tmp_path))
    assert known.columns == docs.columns and {r["doc_id"]: r["lang"] for r in known.collect()} == spoken
    sequences = {}
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], spoken[p["doc_id"]]))
    assert all(len({lang for _, _, lang in own}) == 1 for own in sequences.values()) and {own[0][2] for own in sequences.values()} == set(kinds)
    for own in sequences.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], frame(spark, []).schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "secret_scan", "packing"]
    found = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in found) for k in range(1, 11)) and found["pipeline"] is corpus_pipeline.run


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    rows = df.count()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert rows > 0 if name in ("pipeline", "op2_license_scan", "op9_packing") else rows == docs


def test_helpers():
    assert len(make(texts())) == len(texts()) and words
