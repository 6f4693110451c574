import hashlib
import re
from itertools import product

import duckdb
import numpy as np
import pytest

from gridtide.llm import op13_secrets

SF = "/root/testdata/sf0.01"
KINDS = ["assign", "access", "hex"]


def plain_base(text):
    """The base rules read off their definition, one pattern after the other."""
    word = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    found = [(m.start(), 0, m.end()) for m in re.finditer(word + r"""["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(1)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


TRICKY = [
    "", "token", "token = 'abc'", "TOKEN=\"abcdef\" Api_Key: x-y.z=/+ apikey:'123456", "password  =  hunter22 secret:a secret:abcdefg passwd:::", "toKen=abcdef ſecret=abcdef",
    "AKIA" + "A" * 15, "AKIA" + "B" * 16, "AKIAAKIA" + "7" * 16, "a" * 23, "f" * 24 + "g" + "0" * 30, "deadbeef" * 3 + "DEADBEEF" * 3, "ü😀 token='" + "a1" * 20 + "' ☃",
    "secret = token = abcdef123", "token=" + "0123456789abcdef" * 2, "api__key=abcdefg", "password\"=\"abcdef\"", "token\n=abcdefg",
]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans_equal_plain_patterns(text):
    assert op13_secrets.base_spans(text) == plain_base(text)


def all_texts():
    return [t or "" for (t,) in duckdb.sql(f"select text from '{SF}/documents.parquet' order by doc_id").fetchall()]


def test_viterbi_and_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    field = op13_secrets.Field()
    field.w, field.trans = rng.standard_normal(field.w.shape), rng.standard_normal((3, 3))
    rows = [rng.integers(0, 1 << op13_secrets.BITS, (n, op13_secrets.WIDTH)) for n in (1, 2, 5, 4)]
    for r, (tags, sure) in zip(rows, field.decode(rows)):
        scores = {}
        for path in product(range(3), repeat=len(r)):
            steps = list(zip((0, *path), path))
            if any(b == 2 and a == 0 for a, b in steps):
                continue
            scores[path] = sum(field.w[r[i]].sum(0)[t] for i, t in enumerate(path)) + sum(field.trans[a, b] for a, b in zip(path, path[1:]))
        assert max(scores, key=scores.get) == tuple(tags)
        weight = {p: np.exp(s) for p, s in scores.items()}
        for i in range(len(r)):
            assert sure[i] == pytest.approx(sum(w for p, w in weight.items() if p[i]) / sum(weight.values()))


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    field = op13_secrets.Field()
    field.w, field.trans = rng.standard_normal(field.w.shape) * 0.1, rng.standard_normal((3, 3)) * 0.1
    x, mask = op13_secrets.padded([rng.integers(0, 40, (n, op13_secrets.WIDTH)) for n in (3, 1)])
    y = np.array([[1, 2, 0], [1, 0, 0]])
    _, g, g_trans = field.gradient(x, mask, y)
    for array, grad, at in ((field.w, g, (7, 1)), (field.w, g, (11, 2)), (field.trans, g_trans, (1, 2)), (field.trans, g_trans, (1, 0))):
        old, step, losses = array[at], 1e-5, []
        for d in (step, -step):
            array[at] = old + d
            losses.append(field.gradient(x, mask, y)[0])
        array[at] = old
        assert grad[at] == pytest.approx((losses[0] - losses[1]) / (2 * step), rel=1e-4, abs=1e-6)


@pytest.fixture(scope="module")
def field():
    return op13_secrets.trained(all_texts()[::2])


def test_held_out_rewritten_secrets_are_found_and_look_alikes_left(field):
    held = op13_secrets.training_texts(all_texts()[1::2], seed=99)
    found = op13_secrets.added_spans({i: t for i, (t, _) in enumerate(held)}, field)
    right = wrong = missed = 0
    for i, (text, values) in enumerate(held):
        base = op13_secrets.secret_values(text)
        wanted = {v for v in values if all(v[1] <= a or v[0] >= b for a, b in base)}
        right, wrong, missed = right + len(wanted & set(found[i])), wrong + len(set(found[i]) - wanted), missed + len(wanted - set(found[i]))
    assert right > 500 and right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_plain_texts_get_no_spans_and_long_chunks_are_decoded_whole(field):
    plain = {i: t for i, t in enumerate(all_texts()[1::2])}
    assert sum(map(len, op13_secrets.added_spans(plain, field).values())) <= 1
    long = "the api key is " + "-".join("Ab3xY9qLw" for _ in range(5000)) + " in it"
    assert op13_secrets.added_spans({0: long, 1: "z" * 100_000}, field)[1] == []
    for shift in range(0, 60, 7):
        text = "and " * shift + "the access key is K7xPq2Lm9ZtR4vWb8NcY1s now"
        assert op13_secrets.added_spans({0: text}, field)[0] == [(text.index("K7x"), text.index(" now"))]


def test_query_rows(spark, folder, docs):
    extra = [(100 + i, t) for i, t in enumerate(TRICKY)] + [(100, None), (None, "token=abcdef1")]
    frame = docs.select("doc_id", "text").unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
    frame.write.parquet(f"{folder}/documents.parquet")
    rows = op13_secrets.op13_secrets(spark, folder).collect()
    texts = sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)
    digest = lambda t: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(t or "")).encode()).hexdigest()
    count = lambda t, kind: sum(k == kind for k, _, _ in plain_base(t or ""))
    wanted = sorted((str(i), *(count(t, k) for k in KINDS), digest(t)) for i, t in texts)
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == wanted
    for r in rows:
        spans = r.spans.split(",") if r.spans else []
        assert len(spans) == r.n_assign + r.n_access + r.n_hex + r.n_added


def test_empty_tables_and_clashing_names(spark, docs, no_docs):
    assert op13_secrets.fit(no_docs) == b"" and op13_secrets.find(no_docs, b"", ["doc_id"]).count() == 0
    out = op13_secrets.find(docs, b"", ["doc_id", "score", "_id"], "found")
    assert out.columns == ["doc_id", "score", "_id", "found"] and out.count() == docs.count()


WIDE_OPEN = "plain wonderful words 12345678 x1y2z3 pass:word! (hunter-two) password=abcdef1, mail@example.org 漢字漢字漢字漢字\n\tlast words\x1cjoined tiny"


def test_every_token_of_a_text_is_decoded():
    """A field that takes every token for a secret finds every run without white space, whatever its characters, that is long enough and clear of the base."""
    field = op13_secrets.Field()
    field.w[:, 1:], field.trans[:, 1] = 1, -10
    texts = {i: t for i, t in enumerate([*TRICKY, WIDE_OPEN, "", " \n", (WIDE_OPEN + " ") * 40, "z" * 3000])}
    for i, found in op13_secrets.added_spans(texts, field).items():
        base = plain_base(texts[i])
        runs = [m.span() for m in re.finditer(r"[^ \t-\r]+", texts[i])]
        assert found == [(a, b) for a, b in runs if b - a >= 6 and all(b <= p or a >= q for _, p, q in base)]


def test_pieces_and_batches_change_no_span(field, monkeypatch):
    held = {i: t for i, (t, _) in enumerate(op13_secrets.training_texts([*all_texts()[1:80:2], WIDE_OPEN * 9], seed=12))}
    whole = op13_secrets.added_spans(held, field)
    monkeypatch.setattr(op13_secrets, "PIECE_CHARS", 90)
    for i in list(held)[:20]:
        row = np.array([op13_secrets.text_features(held[i])])
        _, first, _, joint, rows = op13_secrets.token_features([held[i]], row)
        at = 0
        for low, start, end, high in op13_secrets.pieces(held[i]):
            _, a, _, j, r = op13_secrets.token_features([held[i][low:high]], row)
            own = (a + low >= start) & (a + low < end)
            n = int(own.sum())
            assert (first[at : at + n] == a[own] + low).all() and (joint[at : at + n] == j[own]).all() and (rows[at : at + n] == r[own]).all()
            at += n
        assert at == len(first)
    monkeypatch.setattr(op13_secrets, "DECODED_AT_ONCE", 3000)
    assert op13_secrets.added_spans(held, field) == whole and sum(map(len, whole.values())) > 20
    chains = [np.random.default_rng(i).standard_normal((n, 3)) for i, n in enumerate([1, 9, 400, 0, 30, 30, 7] * 3)]
    results = []
    for fewest in (10**6, 1):
        monkeypatch.setattr(op13_secrets, "FEWEST", fewest)
        results.append(field.read(chains, True))
    for (tags, sure), (same, near) in zip(*results):
        assert (tags == same).all() and np.allclose(sure, near)
