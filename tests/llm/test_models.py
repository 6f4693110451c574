"""Classifiers by held-out accuracy, the label model, mixing against numpy, personal data against plain rules."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridtide.llm import linear, op04_toxicity, op05_mixing, op07_quality, op10_pii, shared

SF = "/root/testdata/sf0.01"


def test_words_and_pairs():
    texts = ["Hello, wörld!! x1 x1", "", "a\tb", "***a"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    h, starts = shared.hashed_words(np.frombuffer(data, np.uint8), offsets, shared.byte_classes(symbols=True))
    words = [data[a:].decode(errors="ignore") for a in starts]
    expected = ["Hello", ",", "wörld", "!!", "x1", "x1", "a", "b", "***", "a"]
    assert len(words) == len(expected) and all(w.startswith(e) for w, e in zip(words, expected))
    same = {}
    for word, x in zip(expected, h.tolist()):
        assert same.setdefault(word, x) == x
    assert len(set(same.values())) == len(same)
    row, pairs = op07_quality.word_pairs(np.frombuffer(data, np.uint8), offsets)
    assert Counter(row.tolist()) == {0: 12, 2: 3, 3: 3} and len(pairs) == 18


def test_ftrl_learns_and_l1_empties():
    rng = np.random.default_rng(0)
    model, strong = (linear.Ftrl(6, 0.5, 1.0, l1, 0.1) for l1 in (0.01, 1e6))
    for _ in range(400):
        y = int(rng.integers(2))
        slots = np.unique(rng.integers(10, 60, 8))
        slots = np.append(slots, 3 if y else 4)
        for m in (model, strong):
            m.step(slots, np.ones(len(slots)), float(y))
    assert model.weights(np.array([3]))[0] > 1 and model.weights(np.array([4]))[0] < -1
    assert not strong.weights(np.arange(64)).any()


def held_out_accuracy(spark, query, label, most_wrong):
    found = query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("score", label, "predicted").toPandas()
    assert len(found) > 80 and found.score.between(0, 1).all()
    assert (found.predicted != found[label]).mean() <= most_wrong
    rank, pos = found.score.rank(), found[label] == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_held_out(spark):
    assert held_out_accuracy(spark, op07_quality.op7_quality, "quality", 0.05) > 0.98


def test_toxicity_held_out(spark):
    assert held_out_accuracy(spark, op04_toxicity.op4_toxicity, "toxic", 0.1) > 0.75  # few labels here; see the README for larger tables


@pytest.mark.parametrize("module", [op07_quality, op04_toxicity])
def test_scores_of_odd_rows(docs, no_docs, labels, no_labels, module):
    rows = module.scores(docs, labels, ["doc_id", "_id"]).collect()
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["_id"] == "c" for r in rows)
    assert by_id[3] == by_id[4]
    assert module.scores(no_docs, labels, ["doc_id"]).count() == 0
    assert module.scores(docs, no_labels, ["doc_id"]).count() == docs.count()
    assert {r["score"] for r in op07_quality.scores(docs, no_labels, ["doc_id"]).collect()} == {0.5}


def test_label_model_finds_accuracies_and_pairs():
    rng = np.random.default_rng(1)
    y = rng.random(60000) < 0.2
    rates = [(0.02, 0.8), (0.05, 0.6), (0.01, 0.5), (0.1, 0.7), (0.2, 0.2)]
    votes = np.stack([rng.random(len(y)) < np.where(y, b, a) for a, b in rates] + [np.zeros(len(y), bool)])
    votes[5] = np.where(rng.random(len(y)) < 0.9, votes[3], rng.random(len(y)) < 0.3)  # voter 5 copies voter 3
    patterns, counts = np.unique((votes.astype(np.int64) * (1 << np.arange(6))[:, None]).sum(0), return_counts=True)
    model = op04_toxicity.LabelModel(6).fit(patterns, np.full(len(patterns), -1), counts.astype(float))
    assert (5, 3) in model.pairs and abs(model.prior - 0.2) < 0.05
    for j, (a, b) in enumerate(rates[:3]):
        low, high = model.accuracy(j)
        assert abs(low - a) < 0.05 and abs(high - b) < 0.1
    right = (model.posterior((votes.astype(np.int64) * (1 << np.arange(6))[:, None]).sum(0)) >= 0.5) == y
    assert right.mean() > 0.93


def test_mixing_reaches_targets(spark):
    rng = random.Random(5)
    words = {"en": ["the", "of", "and", "to"], "de": ["der", "und", "die", "zu"], "fr": ["le", "et", "la", "de"]}
    docs = []
    for i in range(240):
        lang = rng.choices(list(words), [6, 3, 1])[0]
        pool = words[lang] + (words[rng.choice(list(words))] if i % 5 == 0 else [])
        docs.append((i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 40))), lang))
    docs += docs[:5]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = frame.select("doc_id").where("doc_id % 2 = 0")
    found, domains, report = op05_mixing.rates(frame, labels, target={"en": 1, "de": 1, "fr": 2}, total_tokens=9000)
    assert domains == ["de", "en", "fr"] and found.where("rate < 0").count() == 0
    rows = found.collect()
    expected = np.sum([np.array(r["p"]) * r["tokens"] * r["copies"] * r["rate"] for r in rows], axis=0)
    assert np.allclose(expected, [2250, 2250, 4500], rtol=1e-4) and np.allclose(expected, [report["expected"][d] for d in domains])
    assert sum(r["tokens"] * r["copies"] for r in rows) == sum(len(t.split()) for _, t, _ in docs)
    assert all(abs(sum(r["p"]) - 1) < 1e-9 for r in rows) and sum(r["copies"] for r in rows) == len(docs)
    # posteriors against plain naive Bayes on the same buckets
    bucket = {r["w"]: r["b"] for r in frame.select(F.explode(F.split("text", " ")).alias("w")).distinct().select("w", F.pmod(F.xxhash64("w"), F.lit(op05_mixing.BUCKETS)).alias("b")).collect()}
    counts, texts = {d: Counter() for d in domains}, {i: (t, d) for i, t, d in docs}
    for i, (t, d) in texts.items():
        if i % 2 == 0:
            counts[d].update(bucket[w] for w in t.split())
    for r in rows[:40]:
        w = texts[r["doc_id"]][0].split()
        z = np.array([sum(np.log((counts[d][bucket[x]] + 0.5) / (sum(counts[d].values()) + 0.5 * op05_mixing.BUCKETS)) for x in w) / np.sqrt(len(w)) for d in domains])
        p = np.exp(z - z.max())
        assert np.allclose(p / p.sum(), r["p"])
    out = op05_mixing.mixed(frame, found)
    tokens = out.groupBy("lang").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    assert out.columns == frame.columns and abs(sum(r["n"] for r in tokens) - 9000) < 900
    assert op05_mixing.mixed(frame, found, at_least=1).select("doc_id").distinct().count() == 240


def test_mixing_projects_at_zero(spark):
    members = spark.createDataFrame([(i, i, 1, 100, [0.9, 0.1] if i < 5 else [0.5, 0.5]) for i in range(10)], "doc_id long, text_hash long, copies long, tokens long, p array<double>")
    found, report = op05_mixing.fitted_rates(members, ["a", "b"], {"a": 1, "b": 9}, 1000.0)
    assert found.where("rate < 0").count() == 0 and found.where("rate = 0").count() == 5
    assert report["steps"] > 1  # 10 % cannot be reached: every document has at least half of a


def test_mixing_odd_rows(docs, no_docs, labels, no_labels):
    found, domains, _ = op05_mixing.rates(docs, labels)
    assert domains == ["de", "en"] and found.agg(F.sum("copies")).first()[0] == docs.count()
    mixed = op05_mixing.mixed(docs, found, at_least=1)
    assert mixed.columns == docs.columns and mixed.count() >= docs.count()
    found, domains, _ = op05_mixing.rates(docs, no_labels)
    assert domains == [] and {r["rate"] for r in found.collect()} == {1.0}
    assert op05_mixing.rates(no_docs, labels)[0].count() == 0


def plain_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and op10_pii.luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="0123456789.. --+@ab()é%", max_size=70))
def test_base_rules(text):
    assert op10_pii.base_spans(text) == plain_base(text)


def test_base_rules_on_long_runs():
    for text in ("1" * 200_000, "a" * 200_000, "+1" + "(" * 200_000, "a." * 100_000 + "@", "1." * 100_000, "1 " * 100_000):
        op10_pii.base_spans(text)
    assert op10_pii.base_spans("4111 1111 1111 1111")[0] == ("card", 0, 19)


def test_reconciled_takes_the_surest_set():
    spans = [(0, 10, "card", 0.9), (5, 15, "phone", 0.95), (12, 20, "ip", 0.9), (20, 25, "ip", 0.5)]
    assert [s[:2] for s in op10_pii.reconciled(spans)] == [(0, 10), (12, 20), (20, 25)]
    assert op10_pii.reconciled([]) == []


def test_gradients():
    rng = np.random.default_rng(3)
    model = op10_pii.Tagger()
    x, y = rng.integers(0, op10_pii.VOCABULARY, (3, 12)), np.zeros((3, 12), int)
    y[:, 4:7] = [3, 4, 4]
    _, g = model.gradients(x, y)
    for name, at in (("emb", (int(x[0, 0]), 2)), ("whf", (3, 5)), ("wxb", (2, 7)), ("trans", (0, 3)), ("out", (3, 2)), ("bf", (20,))):
        keep = model.p[name][at]
        ends = []
        for step in (1e-2, -1e-2):
            model.p[name][at] = keep + step
            ends.append(model.gradients(x, y)[0])
        model.p[name][at] = keep
        assert abs(g[name][at] - (ends[0] - ends[1]) / 2e-2) < 2e-3 + 0.02 * abs(g[name][at])


def test_model_finds_base_and_variants(spark, docs, no_docs):
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    model = op10_pii.fit(whole)
    tagger = op10_pii.Tagger.from_bytes(model)
    texts = {i: r["text"] for i, r in enumerate(whole.where("text rlike '[0-9@]'").collect())}
    decoded = op10_pii._decoded(tagger, texts)
    base = {(i, *s) for i, t in texts.items() for s in op10_pii.base_spans(t)}
    hit = {(i, k, a, b) for i, c in decoded.items() for a, b, k, _ in c}
    assert len(base & hit) > 0.85 * len(base)
    rows = op10_pii.find(docs, model, ["doc_id", "score"]).collect()
    by_id = {r["doc_id"]: r["spans"] for r in rows}
    assert len(rows) == docs.count() and not by_id[3] and not by_id[4]
    text = docs.where("doc_id = 8").first()["text"]
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in by_id[8] if s["base"]] == [("email", "bob.smith@example.com"), ("phone", "+1 (972) 555-6416")]
    red = op10_pii.redact(docs, model)
    assert red.columns == docs.columns and red.where("doc_id = 8").first()["text"].endswith("mail <email> and <phone>")
    assert red.where("doc_id = 3").first()["text"] is None
    assert op10_pii.find(no_docs, model, ["doc_id"]).count() == 0 and op10_pii.find(docs, b"", ["doc_id"]).count() == docs.count()


def test_voters_reach_the_scores_when_gold_fills_the_sample(spark, monkeypatch):
    monkeypatch.setattr(op04_toxicity, "SAMPLE_PER_LABEL", 40)
    rng = random.Random(8)
    plain = ["river", "stone", "cloud", "north", "ember", "field", "glass", "paper"]
    rows = []
    for i in range(600):
        insults = [] if i % 2 else ["scum", "trash"] if i < 450 else ["vermin", "filth"]  # the last 150 rows have no label
        rows.append((i, " ".join([*(rng.choice(plain) for _ in range(6)), *insults]), int(i % 2 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    known, found = docs.where("doc_id < 450").select("doc_id", "toxic"), []
    for words in (op04_toxicity.LEXICONS["disgust"], ["scum", "trash"]):
        monkeypatch.setattr(op04_toxicity, "LEXICONS", op04_toxicity.LEXICONS | {"disgust": words})
        scores = op04_toxicity.scores(docs.select("doc_id", "text"), known, ["doc_id"]).where("doc_id >= 450 AND doc_id % 2 = 0")
        found.append(scores.agg(F.avg("score")).first()[0])
    assert found[0] - found[1] > 0.05


def test_mixing_knows_rare_domains(spark, monkeypatch):
    monkeypatch.setattr(op05_mixing, "SAMPLE_DOCS", 5)
    docs = spark.createDataFrame([(i, f"common words here {i % 7}", "en") for i in range(400)] + [(1000, "seltene worte", "de")], "doc_id long, text string, lang string")
    found, domains, report = op05_mixing.rates(docs, docs.select("doc_id"), target={"en": 1, "de": 1})
    assert domains == ["de", "en"] and abs(report["target"]["de"] - report["target"]["en"]) < 1e-6 and found.count() == 401
    with pytest.raises(ValueError, match="fr"):
        op05_mixing.rates(docs, docs.select("doc_id"), target={"en": 1, "fr": 1})
    with pytest.raises(ValueError, match="fr"):
        op05_mixing.rates(docs, docs.select("doc_id").limit(0), target={"fr": 1})
