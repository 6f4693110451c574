import hashlib
import random
import zlib

import numpy as np
import pytest

from gridtide.llm import op11_runs


def brute(ids):
    """All runs by comparing words at every distance."""
    n, found = len(ids), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and ids[i] == ids[i + q]:
                i += 1
            if i + q - s >= max(24, 3 * q):
                found.setdefault((s, i + q - s), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def samples():
    r = random.Random(3)
    yield from ([], [1], [1] * 23, [1] * 24, [1] * 200, [1, 2] * 40, thue_morse(5000), fibonacci(800), list(range(300)) * 3, list(range(300)) * 2)
    for _ in range(150):
        ids = []
        while len(ids) < r.randrange(20, 400):
            kind = r.random()
            if kind < 0.4:
                ids += [r.randrange(r.choice([2, 3, 50])) for _ in range(r.randrange(1, 30))]
            elif kind < 0.8:
                word = [r.randrange(r.choice([2, 5, 100])) for _ in range(r.randrange(1, 25))]
                ids += (word * r.randrange(1, 9))[: r.randrange(1, 120)]
            elif ids:
                a = r.randrange(len(ids))
                ids += ids[a : a + r.randrange(1, 90)]
        yield ids


def test_runs_equal_brute_force_alone_and_together():
    texts = [np.array(t, np.int64) for t in samples()]
    together = op11_runs.runs_of(texts)
    for ids, found in zip(texts, together):
        assert found == brute(ids.tolist())
    for ids in texts[::7]:
        assert op11_runs.runs_of([ids])[0] == brute(ids.tolist())


def test_grammar_derives_its_words_at_every_position():
    ids = np.array([1, 2, 3, 1, 2, 3, 1, 2, 3, 4, 4, 4, 4, 4, 9, 1, 2, 3] * 5)
    g = op11_runs.Grammar(ids, np.zeros(len(ids), np.int64))
    assert g.size.max() == len(ids)
    derived = {}
    for node, start, size in zip(g.node.tolist(), g.start.tolist(), g.size.tolist()):
        assert derived.setdefault(node, ids[start : start + size].tolist()) == ids[start : start + size].tolist()
    assert len(derived) < len(g.node)  # shared nonterminals


def test_long_period_and_long_text():
    r = random.Random(5)
    word = [r.randrange(10**6) for _ in range(30_000)]
    ids = np.array(word * 4 + [7] * 50_000 + word)
    assert op11_runs.runs_of([ids])[0] == [(0, 120_000, 30_000), (120_000, 50_000, 1)]


def planted(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    number = {}
    runs = brute([number.setdefault(w, len(number)) for w in words])
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2]), default=(None,) * 3)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    milli = best[1] * 1000 // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def same_rows(rows, texts):
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    assert sorted((tuple(r) for r in rows), key=key) == sorted((expected(*t) for t in texts), key=key)


@pytest.mark.parametrize("which", ["docs", "made"])
def test_query_equals_brute_force(spark, folder, docs, which):
    if which == "docs":
        frame = docs.where("length(text) < 5000 or text is null")
    else:
        r = random.Random(9)
        data = [(i, " \t".join(r.choice("abc") if i % 3 else f"w{r.randrange(400)}" for _ in range(r.randrange(0, 260))) + " x y " * (i % 2)) for i in range(300)]
        data += [(None, "a b " * 20), (5, "c " * 30), (5, "c " * 30)]
        frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    frame.write.parquet(f"{folder}/documents.parquet")
    rows = op11_runs.op11_periodic_runs(spark, folder).collect()
    same_rows(rows, [tuple(t) for t in frame.select("doc_id", "text").collect()])


def test_runs_of_clashing_columns_and_empty_tables(spark, docs, no_docs):
    named = docs.withColumnRenamed("score", "runs_").withColumn("start", docs.lang)
    out = op11_runs.find(named, ["doc_id", "start", "_id"], "found", "kept")
    assert out.count() == docs.count() and out.columns == ["doc_id", "start", "_id", "found", "kept"]
    assert op11_runs.find(no_docs, ["doc_id"]).count() == 0
    assert op11_runs.with_planted_periods(docs.withColumn("_h", docs.lang)).columns == [*docs.columns, "_h"]
