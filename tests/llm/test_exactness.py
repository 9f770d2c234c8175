"""What must hold exactly: hashes that clash, very long texts, plain versions of models, recall of retrieval."""

import collections
import math
import os
import random
import re
import sys
import time
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from edge import frame, texts, words  # noqa: E402
from test_operators import by_id, items, plain_classes, plain_contamination, plain_measures, plain_repeats, plain_secrets  # noqa: E402

from veilframe.llm import components, idfilter, jaccard_join, language_id, license_scan, packing, quality_classifier, quality_rules, secret_scan, suffix_dedup  # noqa: E402
from veilframe.llm.decontaminate import decontaminate, find_contamination  # noqa: E402
from veilframe.llm.jaccard_join import JaccardSettings, jaccard_classes, keep_one_each  # noqa: E402
from veilframe.llm.language_id import LanguageSettings, fit, presence_matrix  # noqa: E402
from veilframe.llm.license_scan import LICENSES, license_matches  # noqa: E402
from veilframe.llm.packing import pack  # noqa: E402
from veilframe.llm.shingles import digested_sets  # noqa: E402
from veilframe.llm.suffix_dedup import RepeatSettings, equal_strings, remove_repeats, same_bytes, string_hashes  # noqa: E402
from veilframe.llm.tokens import Encoder, encoder, token_counts, tokenizer_path  # noqa: E402


def twins(n=1024):
    """Two words that every polynomial hash modulo a power of two mixes up."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_twin_words_have_different_hashes(spark):
    a, b = twins()
    rows = [(1, f"one two three {a}"), (2, f"one two three {b}"), (3, "one two three other"), (4, f"One two THREE {a}")]
    assert by_id(jaccard_classes(frame(spark, rows)), "component_id") == {1: (1,), 2: (2,), 3: (3,), 4: (1,)}
    sets = [s for _, _, s in digested_sets(pa.array([t for _, t in rows]), 4)]
    assert sets[0] == sets[3] and len(set(sets)) == 3 and sets[0][0] != sets[1][0] and sets[0][1] != sets[1][1]


def group_rows(n, seed):
    """n copies of one text, each with so many changes that few of them link, behind one original that links with none."""
    rng = random.Random(seed)
    base = words(rng, 150, 10**6).split()
    out = [(0, " ".join(base))]
    for k in range(1, n):
        own = list(base)
        for at in rng.sample(range(150), 5):
            own[at] = f"x{rng.randrange(10**9)}"
        out.append((k, " ".join(own)))
    return out


def test_group_of_unlike_copies_gives_few_candidates(spark, monkeypatch):
    """Candidates grow with the group, not with its square; and what is found is what all pairs give."""
    made = {}
    original = jaccard_join._list_pairs

    def counted(*args):
        out = jaccard_join.saved(original(*args))
        made[size] = made.get(size, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "_list_pairs", counted)
    for size in (60, 300):
        rows = group_rows(size, 4)
        assert by_id(jaccard_classes(frame(spark, rows)), "n_shingles", "component_id") == plain_classes(rows)
    assert made.get(300, 0) <= 10 * max(made.get(60, 0), 30)


def test_best_candidates_first_still_finds_all_links(spark):
    """With one candidate a round, links that a likelier but false candidate hides are found in later rounds."""
    rng, rows = random.Random(17), []
    for _ in range(6):
        base = words(rng, 120, 10**6).split()
        for _ in range(14):
            own = list(base)
            for at in rng.sample(range(120), rng.randrange(1, 5)):
                own[at] = f"y{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(own)))
    for settings in (JaccardSettings(tries=1, agree=6), JaccardSettings(tries=1, agree=6, sketch=64, bucket=200, percent=80, k=5)):
        assert by_id(jaccard_classes(frame(spark, rows), settings), "n_shingles", "component_id") == plain_classes(rows, settings.percent, settings.k)


def test_parity_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for n in (60, 300, 900):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for change in (0, 3, 40):
            b = np.unique(np.concatenate([a[change:], rng.integers(0, 1 << 63, change // 2, dtype=np.uint64)]))
            bits = int(jaccard_join._sketch_bits(n, 8192))
            x, y = (np.frombuffer(jaccard_join._sketch(t, bits), np.uint8) for t in (a, b))
            differ = int(np.bitwise_count(x ^ y).sum())
            assert differ <= len(np.setxor1d(a, b)) and (change or not differ)
            half = np.frombuffer(jaccard_join._sketch(a, bits // 2), np.uint8)
            assert (half == x[: len(x) // 2] ^ x[len(x) // 2 :]).all()


def test_ids_must_be_integers(spark):
    docs = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    for operator in (jaccard_classes, remove_repeats):
        with pytest.raises(TypeError):
            operator(docs)


@pytest.mark.parametrize("most", [idfilter.MOST, 3])
def test_parted(spark, most):
    docs = spark.createDataFrame([(k if k % 7 else None, f"t{k}") for k in range(1, 400)], "doc_id long, text string")
    ids = spark.createDataFrame([(k,) for k in range(1, 400, 5) if k % 7], "id long")
    inside, outside = idfilter.parted(docs, ids, most=most)
    got, rest = [r["text"] for r in inside.collect()], [r["text"] for r in outside.collect()]
    assert sorted(got + rest) == sorted(f"t{k}" for k in range(1, 400)) and {f"t{k}" for k in range(1, 400, 5) if k % 7} <= set(got)
    assert all(f"t{k}" in rest for k in range(7, 400, 7))


def test_strings_with_one_hash_are_told_apart():
    rng = random.Random(2)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(3000)).encode(), np.uint8)
    at = np.arange(len(data) - 12)
    doc = np.array([rng.randrange(9) for _ in at])
    value = string_hashes(data, np.zeros(1, np.int64), np.array([len(data)]), 12)[: len(at)]
    for clash in (value, value & np.uint64(3), value * np.uint64(0)):
        by, fresh = equal_strings(data, at, clash, doc, 12)
        groups, own = [], None
        for k, new in zip(by, fresh, strict=True):
            if new:
                own = []
                groups.append(own)
            own.append(k)
        seen = set()
        for g in groups:
            found = {data[at[k] : at[k] + 12].tobytes() for k in g}
            assert len(found) == 1 and not found & seen and [doc[k] for k in g] == sorted(doc[k] for k in g)
            seen |= found
    size = np.array([3, 1, 5])
    assert same_bytes(np.frombuffer(b"abcabcxabcde", np.uint8), np.array([0, 0, 7]), np.array([3, 6, 7]), size).tolist() == [True, False, True]


def test_repeats_of_passages_with_many_places(spark):
    """Strings of a passage in many documents go one by one, with different edges, and are settled on their bytes."""
    rng = random.Random(14)
    passage = words(rng, 20, 10**6)
    rows = [(k, words(rng, rng.randrange(1, 9), 10**6) + passage[rng.randrange(9) :] + words(rng, 5, 10**6)) for k in range(120)]
    for settings in (RepeatSettings(hot=2), RepeatSettings(hot=2, unit=2000, sample=1)):
        got = by_id(remove_repeats(frame(spark, rows), settings), "n_bytes", "spans", "kept_sha256")
        assert {i: (n, sum(x["end"] - x["start"] for x in s), len(s), h) for i, (n, s, h) in got.items()} == plain_repeats(rows)


def test_splitters_are_fewer_than_buckets(spark):
    rng = random.Random(8)
    rows = [(bytes(rng.randrange(97, 100) for _ in range(16 * rng.randrange(1, 30))),) for _ in range(200)]
    sample = spark.createDataFrame(rows, "body binary").repartition(5)
    for buckets in (1, 2, 7, 64, 5000):
        found = suffix_dedup._splitters(sample, buckets)
        assert len(found) < buckets and (np.sort(found) == found).all() and len(found) >= min(buckets, 3000) // 2 - 1


def plain_entropy(t, window=20):
    """Spans by the same rules, each window counted anew; for texts without = and /, which part strings."""
    out = []
    for m in re.finditer(secret_scan.CANDIDATE, t):
        own = m[0]
        if any(re.search(x, own) for x in secret_scan.ALLOWED):
            continue
        pairs = [own[k : k + 2] for k in range(len(own) - 1) if re.fullmatch("[A-Za-z]{2}", own[k : k + 2])]
        usual = sum(p.lower() in secret_scan._PAIRS for p in pairs)
        least = next((secret_scan.NEVER if share < 1 and usual >= share * len(pairs) else bits for regex, bits, share in secret_scan.CLASSES if re.fullmatch(regex, own)), secret_scan.NEVER)
        high = [k for k in range(len(own) - window + 1) if -sum(c / window * math.log2(c / window) for c in collections.Counter(own[k : k + window]).values()) >= least - 1e-12]
        if high:
            out.append((m.start() + high[0], m.start() + high[-1] + window))
    return out


def test_entropy_spans_against_all_windows(spark):
    rng = random.Random(33)
    alphabets = ["0123456789", "abcdef0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "aab", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+_-"]
    key = lambda: "".join(rng.choice(rng.choice(alphabets) if rng.random() < 0.05 else own) for _ in range(rng.choice([20, 21, 40, 127, 128, 129, 147, 148, 149, 300, 700, 2000]))) if (own := rng.choice(alphabets)) else ""
    rows = [(k, " ".join(["é text", key(), "and", key(), "."])) for k in range(150)]
    got = by_id(secret_scan.find_secrets(frame(spark, rows)), "entropy")
    assert {i: [(s["start"], s["end"]) for s in e] for i, (e,) in got.items()} == {i: plain_entropy(t) for i, t in rows}
    assert sum(bool(e) for (e,) in got.values()) > 60


def test_long_key_strings_take_linear_time(spark):
    rng = random.Random(1)
    text = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=1 << 20))
    secret_scan.find_secrets(frame(spark, [(1, text[:2000])])).collect()
    began = time.perf_counter()
    got = by_id(secret_scan.find_secrets(frame(spark, [(1, "data " + text)])), "entropy")
    assert [(s["start"], s["end"]) for s in got[1][0]] == [(5, 5 + (1 << 20))]
    assert time.perf_counter() - began < 10


def test_repeated_words_of_millions_of_words(spark):
    n = 3_000_000
    text = " ".join(f"w{k:x}" for k in range(n))
    docs = spark.createDataFrame([(1,)], "doc_id long").select("doc_id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.concat(F.lit("w"), F.lower(F.hex(k)))), " ").alias("text"))
    assert docs.select(F.crc32(F.encode("text", "utf-8"))).first()[0] == zlib.crc32(text.encode())
    both = docs.unionAll(docs.select(F.lit(2).cast("long"), F.concat("text", F.lit(" w5 w6 w7"))))
    got = by_id(quality_rules.measures(both, ["n_words", "n_repeat_words"]), "n_words", "n_repeat_words")
    assert got == {1: (n, 0), 2: (n + 3, 6)}


def test_windows_with_one_hash_are_compared(spark):
    """With so few bits of the hash that windows clash, the words decide."""
    rng = random.Random(6)
    rows = [(k, " ".join(f"v{rng.randrange(12)}" for _ in range(rng.randrange(1, 60)))) for k in range(60)]
    docs = frame(spark, rows).select("doc_id", quality_rules.words_of(F.col("text")).alias("w"))
    bits = F.lit(62)
    keys = quality_rules.window_keys(F.col("w"), bits)
    few = docs.select("doc_id", quality_rules.let(keys, lambda k: quality_rules.covered(quality_rules.repeated_starts(F.col("w"), k, bits))).alias("n"))
    assert {i: n for i, (n,) in by_id(few, "n").items()} == {i: plain_measures(t)[4] for i, t in rows}


@pytest.mark.parametrize("limits", [(40, 80), (40, 1 << 20), (1 << 20, 1 << 25)])
def test_benchmark_in_several_passes(spark, limits):
    block, sent = limits
    rng, bench = random.Random(9), spark.createDataFrame(items(), "item_id int, text string")
    rows = list(texts()) + [(500 + k, words(rng, 5, 60) + " " + (items()[k % 7][1] or "") + " " + words(rng, 9, 60) + " " + (items()[(k + 1) % 7][1] or "")) for k in range(20)]
    got = by_id(find_contamination(frame(spark, rows), bench, block_bytes=block, broadcast_bytes=sent), "n_words", "n_hit", "items")
    assert {i: got[i] for i, _ in rows} == {i: plain_contamination(t, items()) for i, t in rows}
    one, many = (sorted((r["doc_id"], r["text"], r["source"]) for r in decontaminate(frame(spark, [x for x in rows if x[1]]), bench, block_bytes=a, broadcast_bytes=b).collect()) for a, b in ((2 << 20, 1 << 25), limits))
    assert one == many


def test_recall_of_license_retrieval(spark):
    """Templates with words changed, cut out or put in, inside other text: what holds 80 % of a template's shingles is found."""
    rng, rows, want = random.Random(11), [], {}
    grams = lambda t: {tuple(w[k : k + 5]) for w in [re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower())] for k in range(len(w) - 4)}
    sets = {n: grams(t) for n, t in LICENSES.items()}
    for name, text in LICENSES.items():
        for _ in range(6 if len(text) < 8000 else 2):
            own = text.split()
            for at in rng.sample(range(len(own)), int(len(own) * rng.choice([0, 0.01, 0.03, 0.05]))):
                own[at] = rng.choice(["changed", "", "two words"])
            t = words(rng, rng.randrange(0, 300)) + "\n" + " ".join(own) + "\n" + words(rng, rng.randrange(0, 300))
            held = grams(t)
            want[len(rows)] = {n for n, s in sets.items() if len(s & held) >= 0.8 * len(s)}
            rows.append((len(rows), t))
    got = collections.defaultdict(set)
    for r in license_matches(frame(spark, rows)).collect():
        got[r["doc_id"]].add(r["license"])
    total, hit = sum(map(len, want.values())), sum(len(want[k] & got[k]) for k in want)
    assert total > 100 and hit >= 0.97 * total
    assert all(len(sets[n] & grams(rows[k][1])) >= 0.8 * len(sets[n]) for k in got for n in got[k])


def test_short_templates_are_refused(spark):
    with pytest.raises(ValueError):
        license_matches(frame(spark), {"x": "too few words"})
    assert len(LICENSES) == len(license_scan.NOTICES) + 16


def test_kernel_and_ridge_against_plain_sets():
    """Scores from matrices are those of the kernel over sets, solved directly."""
    rng = random.Random(3)
    rows = [("a" if k % 2 else "b", " ".join(rng.choice(("the of and to in" if k % 2 else "der die das und ist").split()) for _ in range(rng.randrange(2, 12)))) for k in range(60)]
    width = 1 << 20
    sets = [set(np.flatnonzero(presence_matrix(pa.array([t]), range(1), width)[0])) for _, t in rows]
    plain = lambda b: bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in b)
    for (_, t), s in zip(rows, sets, strict=True):
        b = plain(t.encode())
        assert len(s) == len({b[k : k + n] for n in (1, 2, 3) for k in range(len(b) - n + 1)})
    kernel = lambda x, z: len(x & z) / math.sqrt(len(x) * len(z))
    settings = LanguageSettings(width=width, landmarks=10)
    matrix = np.concatenate([presence_matrix(pa.array([t]), range(1), width) for _, t in rows])
    model = fit(matrix, np.array([y for y, _ in rows]), settings)
    marks = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]  # dealt evenly over both
    chosen = sorted(marks, key=lambda k: (k // 2, rows[k][0]))
    low = np.array([[kernel(sets[a], sets[b]) for b in chosen] for a in chosen])
    value, vector = np.linalg.eigh(low)
    good = value > 1e-6 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])
    features = np.array([[kernel(s, sets[b]) for b in chosen] for s in sets]) @ root
    y = np.array([[1.0 if label == name else -1.0 for name in ("a", "b")] for label, _ in rows])
    share = 1 / math.sqrt(30)
    weights = np.linalg.solve(share * features.T @ features + settings.ridge * share * len(rows) / 100 * np.eye(features.shape[1]), share * features.T @ y)
    want = features @ weights
    want = np.exp(settings.sharpness * (want - want.max(1, keepdims=True)))
    assert np.allclose(model.scores(matrix, settings.sharpness), want / want.sum(1, keepdims=True), atol=1e-3)


def test_risk_and_its_gradient():
    """The risk is that of the definition, and training follows its slope."""
    rng = np.random.default_rng(4)
    p, u = rng.random(50), rng.random(80)
    first, rest = quality_classifier.risk(p, u, 0.3)
    assert first == pytest.approx(0.3 * sum(1 - x for x in p) / 50) and rest == pytest.approx(sum(u) / 80 - 0.3 * sum(p) / 50)
    columns = [np.unique(rng.integers(0, 40, 9)).astype(np.int32) for _ in range(30)]
    x = quality_classifier.Texts.of([(rng.random(quality_classifier.N_FEATURES), c) for c in columns])
    net = quality_classifier.Network(x.dense.mean(0), x.dense.std(0), 4, 40, 1)
    net.w[4] = rng.normal(0, 1, 40)
    weight = rng.normal(0, 1, 30)
    grad = net.gradient(x, weight)
    for k, w in enumerate(net.w):
        at = tuple(int(rng.integers(0, n)) for n in w.shape)
        w[at] += 1e-6
        up = (net.forward(x)[2] * weight).sum()
        w[at] -= 2e-6
        down = (net.forward(x)[2] * weight).sum()
        w[at] += 1e-6
        assert (up - down) / 2e-6 == pytest.approx(grad[k][at], rel=1e-3, abs=1e-5)
    some = x.take(np.array([3, 3, 0]))
    assert [some.columns[a:b].tolist() for a, b in zip(some.bounds[:-1], some.bounds[1:], strict=True)] == [columns[3].tolist(), columns[3].tolist(), columns[0].tolist()]


def test_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(8)
    for prior in (0.2, 0.5, 0.8):
        positive = rng.beta(6, 2, 4000)
        unlabelled = np.where(rng.random(8000) < prior, rng.beta(6, 2, 8000), rng.beta(2, 6, 8000))
        assert quality_classifier.least_ratio(positive, unlabelled) == pytest.approx(prior, abs=0.08)


def test_labels_other_than_one_are_not_read(spark):
    rng = random.Random(2)
    rows = [(k, words(rng, 60, 300) if k % 3 else "BUY NOW !!! " * 20) for k in range(300)]
    good = [(k, 1) for k in range(300) if k % 3 and k % 2]
    made = [quality_classifier.train(frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int"), F.lit(True), quality_classifier.QualitySettings(steps=40, batch=64)) for marks in (good, good + [(k, 0) for k in range(0, 300, 3)], good + [(k, None) for k in range(300)] + [(10**9, 1), (None, 1)] + good)]
    for other in made[1:2]:
        assert all((a == b).all() for a, b in zip(made[0].w, other.w, strict=True))
    assert made[2] is not None


def test_texts_of_more_than_a_megabyte(spark):
    rng = random.Random(77)
    long = " ".join(f"w{rng.randrange(300_000)}" for _ in range(180_000))
    assert len(long) > 1_100_000
    mit = LICENSES["mit"]
    rows = [(1, long), (2, long + " tail"), (3, long[:600_000] + "\n" + mit + "\n" + long[600_000:]), (4, "short")]
    docs = frame(spark, rows)
    assert {r["doc_id"]: r["license"] for r in license_matches(docs).collect()} == {3: "mit"}
    slow = Encoder(tokenizer_path("byte_bpe_50k.json")).slow
    n = {i: len(slow.encode(t, add_special_tokens=False).ids) for i, t in rows}
    assert by_id(token_counts(docs), "n_tokens") == {i: (c,) for i, c in n.items()}
    tokens = collections.Counter()
    for r in pack(docs).collect():
        tokens[r["doc_id"]] += r["length"]
    assert tokens == {i: c + 1 for i, c in n.items()}
    bench = spark.createDataFrame([(7, " ".join(long.split()[90_000:90_020]))], "item_id int, text string")
    assert {i: x for i, x in by_id(find_contamination(docs, bench), "n_hit", "items").items()} == {1: (20, ["7"]), 2: (20, ["7"]), 3: (20, ["7"]), 4: (0, [])}
    assert by_id(jaccard_classes(docs), "component_id") == {1: (1,), 2: (1,), 3: (1,), 4: (4,)}
    assert {i: x for i, x in by_id(quality_rules.measures(docs, ["n_words", "n_repeat_words"]), "n_words", "n_repeat_words").items()} == {i: (plain_measures(t)[0], plain_measures(t)[4]) for i, t in rows}
    assert by_id(secret_scan.find_secrets(docs).select("doc_id", secret_scan.listed(["assign", "access", "hex"]).alias("x")), "x") == {i: (plain_secrets(t),) for i, t in rows}
    net = quality_classifier.Network(np.zeros(quality_classifier.N_FEATURES), np.ones(quality_classifier.N_FEATURES), 4, 64, 1)
    assert all(0 <= s <= 1 for (s,) in by_id(quality_classifier.classify(docs, net), "score").values())
    assert sorted(r["doc_id"] for r in keep_one_each(docs).collect()) == [1, 4]
    empty = language_id.identify(docs, None)
    assert {i: p for i, (p,) in by_id(empty, "lang_pred").items()} == {1: "und", 2: "und", 3: "und", 4: "und"}


def test_packing_holds_little_in_workers(spark, monkeypatch):
    """Windows that the finishing step closes by hundreds are given out in portions, and common texts need one library only."""
    rng, taken = random.Random(43), []
    rows = [(k, words(rng, 400, 10**6)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: taken.append(f))
    monkeypatch.setattr(packing, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 3)))
    pack(docs)
    encoder.cache_clear()
    out = list(taken[0](iter([pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]})])))
    assert "slow" not in vars(encoder("byte_bpe_50k.json"))
    sizes, pieces = [sum(b.column(2).to_pylist()) for b in out], collections.defaultdict(dict)
    assert max(sizes) <= (1 << 18) + 2048 and sum(sizes) > 1 << 19
    for r in (r for b in out for r in b.to_pylist()):
        pieces[r["doc_id"]][r["start"]] = np.frombuffer(r["ids"], "<u4").tolist()
    slow = Encoder(tokenizer_path("byte_bpe_50k.json")).slow
    assert {i: [x for _, own in sorted(p.items()) for x in own] for i, p in pieces.items()} == {i: [*slow.encode(t, add_special_tokens=False).ids, 1] for i, t in rows}


def test_few_edges_and_ids_need_no_rounds(spark):
    """What the driver joins or fills itself is what the cluster's rounds give."""
    rng = random.Random(41)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (None, 3)]
    table = spark.createDataFrame(edges, "u long, v long").repartition(4)
    rows = [sorted(map(tuple, components.components(table, few).collect())) for few in (0, components.FEW)]
    assert rows[0] == rows[1] and len(rows[0]) > 200
    none = table.filter("u < 0")
    assert components.components(none).collect() == [] == components.components(none, -1).collect() and components.components(none).columns == ["id", "component"]
    docs, ids = spark.createDataFrame([(k, "x") for k in [*range(2000), None]], "doc_id long, text string"), spark.createDataFrame([(k,) for k in [*range(0, 2000, 7), None]], "id long")
    parts = [[sorted(r["doc_id"] or -1 for r in part.collect()) for part in idfilter.parted(docs, ids)]]
    few, idfilter.FEW = idfilter.FEW, 0
    try:
        parts.append([sorted(r["doc_id"] or -1 for r in part.collect()) for part in idfilter.parted(docs, ids)])
    finally:
        idfilter.FEW = few
    assert parts[0] == parts[1] and set(range(7, 2000, 7)) <= set(parts[0][0]) and -1 in parts[0][1]


def test_few_rows_in_many_partitions_make_few_tasks(spark):
    """Small tables between the steps of the join are read by few tasks, however many partitions wrote them."""
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    tracker = spark.sparkContext.statusTracker()
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few-rows", "few-rows")
        rows = group_rows(40, 6)
        assert by_id(jaccard_classes(frame(spark, rows)), "n_shingles", "component_id") == plain_classes(rows)
        stages = {s for j in tracker.getJobIdsForGroup("few-rows") if (info := tracker.getJobInfo(j)) for s in info.stageIds}
        tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < tasks < 1200


def test_bands_are_worked_out_only_where_they_can_agree(monkeypatch):
    """Texts without a shingle that is the least of a template in some band cost no band, and lose no candidate."""
    rng, known = random.Random(43), license_scan._Templates(LICENSES, 5, 32)
    mit = LICENSES["mit-notice"] + " " + LICENSES["gpl-3.0-or-later"]

    def grams_of(rows):
        data = np.frombuffer("".join(rows).encode(), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]]).astype(np.int64)
        found, owner, _, _ = license_scan.placed_word_hashes(data, starts, license_scan._BLANK)
        grams, ok = known.grams(found, owner)
        place = np.flatnonzero(ok)
        return grams[place], np.searchsorted(owner[place], np.arange(len(rows) + 1))

    prose = [words(rng, 700) + " " for _ in range(30)]
    mixed = [t for k in range(30) for t in (prose[k], f"{words(rng, 40)} {mit} {words(rng, 40)} ")]
    every = known.candidates(*grams_of([t for t in mixed if "MIT" in t]), 0.8)
    assert {t for t, _, _ in every} == set(range(30))
    grams, bounds = grams_of(mixed)
    shift = lambda t: int(bounds[2 * t + 1])
    own = grams_of([t for t in mixed if "MIT" in t])[1]
    assert known.candidates(grams, bounds, 0.8) == {(2 * t + 1, first - int(own[t]) + shift(t), n) for t, first, n in every}
    monkeypatch.setattr(known, "permuted", lambda *_: pytest.fail("a band was worked out"))
    assert known.candidates(*grams_of(prose), 0.8) == set()


def test_texts_are_worked_on_in_small_groups(monkeypatch):
    """What is worked out at once for many short texts stays small, and the runs are those of one large group."""
    rng, settings = random.Random(47), RepeatSettings()
    rows = [words(rng, rng.randrange(1, 400)).encode() for _ in range(400)]
    data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    sizes, original = [], suffix_dedup._runs_of

    def counted(data, texts, starts, ends, *rest):
        sizes.append(int((ends - starts).sum()))
        return original(data, texts, starts, ends, *rest)

    monkeypatch.setattr(suffix_dedup, "_runs_of", counted)
    columns = lambda: [np.concatenate(x) for x in zip(*[(r.text, r.first, r.last, r.anchor, r.key, r.lead) for r in suffix_dedup.anchor_runs(data, offsets, settings)], strict=True)]
    small = columns()
    assert len(sizes) > 4 and max(sizes) <= 1 << 16
    monkeypatch.setattr(suffix_dedup, "_GROUP", 1 << 20)
    assert all((a == b).all() for a, b in zip(small, columns(), strict=True))


def test_spans_are_united_as_one_by_one():
    rng = random.Random(53)
    spans = [(d, a, a + rng.randrange(1, 9)) for d in (3, -7, 2**62) for a in (rng.randrange(120) for _ in range(25))]
    want = []
    for d, a, b in sorted(spans):
        if want and want[-1][0] == d and a <= want[-1][2]:
            want[-1][2] = max(want[-1][2], b)
        else:
            want.append([d, a, b])
    got = suffix_dedup._united(*np.array(spans, np.int64).T)
    assert [list(map(int, x)) for x in zip(*got, strict=True)] == want
    assert not len(suffix_dedup._united(*np.zeros((3, 0), np.int64))[0])
