"""Classifiers and the language model: held-out results, awkward rows, brute force."""

import inspect
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelore.llm import ngrams, quality, toxicity
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(ready):
    return ready.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), ready.read.parquet(f"{SF}/labels.parquet")


def _held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("module, label, threshold, least", [(toxicity, "toxic", 0.5, 0.93), (quality, "quality", 0.3, 0.95)])
def test_held_out_accuracy(tables, module, label, threshold, least):
    docs, labels = tables
    model = module.train(docs, labels)
    rows = module.score(docs, model).join(labels, "doc_id").collect()
    right = [(r["score"] >= threshold) == (r[label] == 1) for r in rows if _held(r["doc_id"])]
    assert sum(right) / len(right) >= least


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_awkward_rows(tables, awkward, empty, ready, module, label):
    docs, labels = tables
    model = module.train(docs, labels)
    frame = awkward.selectExpr("doc_id", "text", "1 as made", "2 as places")
    got = module.score(frame, model).collect()
    assert len(got) == frame.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not r["text"]}) == 1
    assert module.score(empty, model).count() == 0
    clash = module.score(frame.withColumnRenamed("made", "Score"), model)
    assert clash.columns[2:] == ["Score", "places", "score_"] and {r["Score"] for r in clash.collect()} == {1}
    nothing = module.train(awkward, ready.createDataFrame([], f"doc_id long, {label} int"))
    assert all(r["score"] == 0.5 for r in module.score(awkward, nothing).collect())
    some = ready.createDataFrame([(i, i % 2) for i in (0, 1, 1, 5, 8, 11, 12)] + [(None, 1), (9, None)], f"doc_id long, {label} int")
    assert module.score(awkward, module.train(awkward, some)).count() == awkward.count()


def _toxic_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {(w,) for w in words} | {("next", *p) for p in zip(words, words[1:])} | {("skip", *p) for p in zip(words, words[2:])}


def test_toxicity_equals_ftrl_over_a_dictionary(ready):
    """Features by name instead of by hash, one dictionary of state, one example at a time."""
    rng = random.Random(5)
    words = [prose(700 + i, 1) for i in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) + (" VILE, thing" if i % 3 == 0 else "") for i in range(300)]
    docs = ready.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "doc_id long, text string")
    labels = ready.createDataFrame([(i, int(i % 3 == 0)) for i in range(301)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels, bits=22)).collect()}
    order = [r["doc_id"] for r in docs.orderBy(F.xxhash64("doc_id")).collect() if not _held(r["doc_id"])]
    z, n, bias, seen = Counter(), Counter(), 0.0, 1.0

    def weight(f):
        return 0.0 if abs(z[f]) <= toxicity.L1 else -(z[f] - math.copysign(toxicity.L1, z[f])) / (
            (toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    features = [_toxic_features(x) for x in [*texts, None]]
    for _ in range(toxicity.EPOCHS):
        for i in order:
            w = {f: weight(f) for f in features[i]}
            error = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - int(i % 3 == 0)
            if abs(error) < 1e-4:
                continue
            for f in w:
                z[f] += error - (math.sqrt(n[f] + error**2) - math.sqrt(n[f])) / toxicity.ALPHA * w[f]
                n[f] += error**2
            seen += error**2
            bias -= 0.1 * error / math.sqrt(seen)
    assert len({round(x, 6) for x in got.values()}) > 20
    for i, found in enumerate(features):
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(sum(map(weight, found)) + bias))), abs=1e-9)


def _quality_terms(text):
    data, words = (text or "").encode(), (text or "").encode().split()
    out = np.zeros(quality.TERMS)
    for a, b, c in zip(data, data[1:], data[2:]):
        h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
        h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
        out[(h ^ h >> 13) >> 32 - quality.BITS] += 1
    out = np.log1p(out)
    if words:
        for k, share in enumerate((sum(a == b for a, b in zip(words, words[1:])) / len(words), 1 - len(set(words)) / len(words))):
            for i in range(quality.STEPS):
                out[(1 << quality.BITS) + k * quality.STEPS + i] = share > (i + 0.5) / quality.STEPS
    return out


def test_quality_equals_a_full_vote(tables):
    """Every vector is made and compared one by one; the space is that of a full decomposition."""
    docs, labels = tables
    docs, labels = docs.where("doc_id < 400").where("length(text) < 3000"), labels.where("doc_id < 400")
    given = {r["doc_id"]: r["quality"] for r in labels.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    terms = {i: _quality_terms(x) for i, x in texts.items()}
    learnt = [i for i in texts if given.get(i) is not None and not _held(i)]
    grams = 1 << quality.BITS
    rarity = np.log((1 + len(learnt)) / (1 + sum(terms[i][:grams] > 0 for i in learnt)))
    rarity = np.append(rarity, np.full(2 * quality.STEPS, quality.STEP_WEIGHT))

    def unit(x):
        return x / max(np.linalg.norm(x), 1e-9)

    def row(i):
        x = terms[i] * rarity
        return unit(np.append(unit(x[:grams]), x[grams:]))

    matrix = np.stack([row(i) for i in learnt])
    model = quality.train(docs, labels)
    _, sizes, full = np.linalg.svd(matrix, full_matrices=False)
    kept = np.linalg.norm(matrix @ model.axes) ** 2
    assert kept >= 0.99 * (sizes[:quality.DIMS] ** 2).sum()
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    prior, same, agreed = float(np.mean([given[i] for i in learnt])), 0, 0
    for i in texts:
        def vote(axes, sample):
            me = unit(row(i) @ axes)
            near = sorted(((float(me @ v), y) for v, y in sample), reverse=True)[:quality.NEIGHBOURS]
            weights = [max(s, 0) ** quality.POWER for s, _ in near]
            return (sum(w * y for w, (_, y) in zip(weights, near)) + 1e-3 * prior) / (sum(weights) + 1e-3)

        same += abs(got[i] - vote(model.axes, list(zip(model.vectors, model.labels)))) < 5e-3
        if i % 4 == 0:
            axes = full[:quality.DIMS].T
            exact = vote(axes, [(unit(r @ axes), given[j]) for r, j in zip(matrix, learnt)])
            agreed += (exact >= 0.3) == (got[i] >= 0.3)
    assert same >= 0.99 * len(texts)
    assert agreed >= 0.97 * sum(i % 4 == 0 for i in texts)


def test_held_out_labels_are_never_learnt(tables, ready):
    docs, labels = tables
    turned = labels.selectExpr("doc_id", "if(crc32(cast(string(doc_id) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    one, other = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert one.places.tolist() == other.places.tolist() and one.weights.tolist() == other.weights.tolist()


def test_the_sample_holds_20_000_labelled_rows(ready):
    docs = ready.range(17_000).selectExpr("id as doc_id", "concat('w', id % 7, ' v', id % 11, if(id % 9 = 0, ' bad', '')) as text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 9 = 0) as toxic")
    one, other = toxicity.train(docs, labels), toxicity.train(docs, labels, rows=1 << 30)
    assert one.bias == other.bias and one.weights.tolist() == other.weights.tolist()


def test_packed_batches_give_back_their_rows():
    rows = [np.arange(n, dtype="<u4") + 7 * n for n in (3, 0, 5, 1)]
    column, labels = pa.array([x.tobytes() for x in rows]), pa.array([0, 1, 1, 0], pa.int32())
    for low, n in ((0, 4), (1, 3), (2, 1), (0, 0)):
        places, bounds, wanted = toxicity.packed(column.slice(low, n), labels.slice(low, n))
        assert [places[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [x.tolist() for x in rows[low:low + n]]
        assert wanted.tolist() == labels.slice(low, n).to_pylist()


def _brute(rows):
    words = [[*(r["text"] or "").encode().lower().split(), None] for r in rows]
    count = Counter()
    for r, w in zip(rows, words):
        if zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 != 2:
            count.update(w)
    n, v = sum(count.values()), len(count)
    return [(len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) for w in words]


@pytest.mark.parametrize("frequent", [1 << 20, 8])
def test_base_scores_are_exact(awkward, ready, monkeypatch, frequent):
    """Also where most words are counted in the buckets of their hashes, not sent to the workers."""
    monkeypatch.setattr(ngrams, "FREQUENT", frequent)
    got = ngrams.score_held_out(awkward).collect()
    rows = awkward.collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(
        (str(r["doc_id"]), a, b, c, round(x, 6)) for r, (a, b, c, x) in zip(rows, _brute(rows)))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_filter_reads_levels_back(ready):
    text = " ".join(["a b"] * 9 + ["c d"] * 2 + ["e"])
    model = ngrams.fit(ready.createDataFrame([(text,)], "text string"))
    import numpy as np
    import pyarrow as pa
    _, _, tokens = next(iter(ngrams.token_groups(pa.array(["a b c e"]))))
    assert ngrams.levels(model, tokens[:4], 1).tolist() == [4, 4, 2, 1]    # 9, 9, 2 and 1 times
    assert ngrams.levels(model, ngrams.pairs_of(tokens)[1:3], 2).tolist() == [4, 1]
    assert ngrams.levels(model, np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 2).mean() < 0.1


def test_pairs_seen_in_training_score_above_the_base(ready):
    rows = [(i, " ".join(["the quick brown fox"] * 5) + " " + prose(i, 20)) for i in range(300)]
    got = ngrams.score_held_out(ready.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["score"] > r["base_score"] for r in held)


def test_a_full_filter_falls_back_to_single_words(ready):
    rows = [(i, prose(i, 200)) for i in range(60)]
    docs = ready.createDataFrame(rows, "doc_id long, text string")
    model = ngrams.fit(docs, filter_bytes=1)
    assert model.trust < 0.1 and len(model.bits) <= 8 * len(model.sizes)
    assert ngrams.score_held_out(docs, filter_bytes=1).count() == 60


def _brute_scores(rows):
    """Scores by exact counts of all words, and pair counts rounded as the filter's levels are."""
    words = [[*(r["text"] or "").encode().lower().split(), None] for r in rows]
    one, two = Counter(), Counter()
    for r, w in zip(rows, words):
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            one.update(w)
            two.update(zip([None, *w], w))
    size, out = sum(one.values()) + len(one) + 1, {}
    for r, w in zip(rows, words):
        out[r["doc_id"]] = 0.0
        for a, b in zip([None, *w], w):
            alone, level = (one[b] + 1) / size, two[a, b].bit_length()
            pair = min(ngrams._DECODED[level], one[a])
            out[r["doc_id"]] += math.log10((pair + ngrams.PRIOR * alone) / (one[a] + ngrams.PRIOR))
    return out


def test_scores_use_every_word_and_pair(ready, monkeypatch):
    """Rare and unseen words count as they are, however few words are sent to the workers."""
    rows = [(i, " ".join(["the quick brown fox"] * (i % 5)) + " " + prose(i % 40, 60) + f" only{i}") for i in range(120)]
    docs = ready.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted, got = _brute_scores(docs.collect()), []
    for frequent in (1 << 20, 8):
        monkeypatch.setattr(ngrams, "FREQUENT", frequent)
        got.append({r["doc_id"]: round(r["score"], 6) for r in ngrams.score_held_out(docs).collect()})
    assert got[0] == got[1] and got[0].keys() == wanted.keys()
    assert all(abs(got[0][i] - wanted[i]) < 0.05 * abs(wanted[i]) for i in wanted)   # a probe errs now and then


def test_the_filter_grows_with_its_entries(ready, monkeypatch):
    """No size is the last: the bits follow the entries, and texts in many groups score the same."""
    docs = ready.createDataFrame([(i, prose(i, 300)) for i in range(60)], "doc_id long, text string")
    small, large = ngrams.fit(docs.where("doc_id < 6"), buckets=64), ngrams.fit(docs, buckets=64)
    assert inspect.signature(ngrams.fit).parameters["filter_bytes"].default is None
    assert len(large.bits) > 6 * len(small.bits) and small.trust > 0.95 and large.trust > 0.95
    whole = sorted(map(tuple, ngrams.score(docs, large).collect()))
    monkeypatch.setattr(ngrams, "GROUP_BYTES", 5000)
    assert [(r[0], *r[1:4]) for r in whole] == [(r[0], *r[1:4]) for r in sorted(map(tuple, ngrams.score(docs, large).collect()))]
    assert [round(r[-1], 6) for r in whole] == [round(r[-1], 6) for r in sorted(map(tuple, ngrams.score(docs, large).collect()))]


def test_nothing_to_learn_from(empty, ready):
    assert ngrams.score_held_out(empty).count() == 0
    one = ready.createDataFrame([(9, "a b")], "doc_id long, text string")
    assert zlib.crc32(b"9") % 7 != 2 or ngrams.score_held_out(one).first()["base_score"] == 0.0
