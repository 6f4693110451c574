"""BPE against the tokenizer library, Merkle trees against plain Python, chat pairs against plain Python."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gridtide.llm import op06_bpe, op08_merkle, op09_chat

PATH, PATTERN = op06_bpe.default_vocabulary()
RANKS = op06_bpe.read_ranks(PATH)
TREE = op06_bpe.TreeBpe(RANKS, PATTERN)
PLAIN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text(alphabet="abest 0.'\n", max_size=400), st.text(alphabet="a", max_size=300)))
def test_ids_and_round_trip(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = TREE.encode(text)
    assert ids.tolist() == PLAIN.encode_ordinary(text) and TREE.decode(ids) == text.encode()


def test_long_pieces_and_joins():
    rng = random.Random(2)
    for text in ("a" * 5000, "".join(rng.choice("abcdefghij") for _ in range(20000)), " " * 3000, "é" * 2000):
        assert TREE.encode(text).tolist() == PLAIN.encode_ordinary(text)
    for _ in range(300):
        a, b = ("".join(rng.choice("etaoin s") for _ in range(rng.randint(0, 40))).encode() for _ in range(2))
        assert TREE.join(TREE.merged(a), TREE.merged(b)) == TREE.merged(a + b)
    assert all(TREE.merged(t) == (i,) for t, i in list(RANKS.items())[::97])


def test_bpe_rows(docs, no_docs):
    rows = op06_bpe.round_trip(docs, PATH, PATTERN, ["doc_id", "ids"]).collect()
    texts = sorted(r["text"] or "" for r in docs.collect())
    want = []
    for t in texts:
        ids = np.array(PLAIN.encode_ordinary(t), "<u4")
        want.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(want) == sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows)
    enc = op06_bpe.encoded(docs, PATH, PATTERN, digests=True)
    assert sorted(enc.columns) == sorted([c for c in docs.columns if c not in ("text", "ids")] + ["ids", "n_tokens", "decoded_sha256"])
    assert {len(r["ids"]) for r in enc.collect()} == {w[0] for w in want}
    assert op06_bpe.round_trip(no_docs, PATH, PATTERN, ["doc_id"]).count() == 0


def test_tree_equality_and_spans():
    text = "\n".join(f"paragraph {i} has some words of its own and goes on for a while {i * 7}" for i in range(40))
    other = text.replace("paragraph 17 has", "paragraph 17 had")
    a, b = op08_merkle.tree(text), op08_merkle.tree(other)
    assert a.digest != b.digest and op08_merkle.tree(text).digest == a.digest and a.size == len(text.encode())
    assert op08_merkle.likeness(a, a) == 1 and 0.97 < op08_merkle.likeness(a, b) < 1
    spans = op08_merkle.differing_spans(a, b)
    place = text.index("paragraph 17 has") + len("paragraph 17 ha")
    assert len(spans) == 1 and spans[0][0] <= place < spans[0][1] and spans[0][1] - spans[0][0] < 120
    empty = op08_merkle.tree("")
    assert op08_merkle.likeness(empty, op08_merkle.tree(None)) == 1 and op08_merkle.likeness(empty, a) == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n", max_size=120), st.text(alphabet="ab \n", max_size=120))
def test_tree_likeness_bounds(x, y):
    a, b = op08_merkle.tree(x), op08_merkle.tree(y)
    assert (a.digest == b.digest) == (x == y)
    assert 0 <= op08_merkle.likeness(a, b) <= 1 and (op08_merkle.likeness(a, b) == 1 or x != y)


@pytest.mark.parametrize("ranges", [1, 4])
def test_neighbours(spark, docs, no_docs, monkeypatch, ranges):
    monkeypatch.setattr(op08_merkle, "RANGES_PER_PARTITION", ranges)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.where("doc_id IS NOT NULL").collect()]
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_next"]) for r in op08_merkle.edits_and_neighbours(docs.where("doc_id IS NOT NULL")).collect()}
    rows.sort(key=lambda r: -r[0])  # only equal rows share an id here
    want = set()
    for i, (doc_id, text) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        near = op08_merkle.likeness(op08_merkle.tree(text), op08_merkle.tree(after))
        want.add((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), near))
    assert got == want
    assert op08_merkle.edits_and_neighbours(docs).count() == docs.count()
    single = op08_merkle.edits_and_neighbours(docs.where("doc_id = 11")).first()
    assert single["near_next"] == 1 and single["n_chars"] == 3
    assert op08_merkle.edits_and_neighbours(no_docs).count() == 0
    prints = op08_merkle.fingerprints(docs.select("doc_id", "text", "score")).where("doc_id IN (1, 7)").collect()
    assert len({r["fingerprint"] for r in prints}) == 1 and prints[0]["score"] == "clash"


def plain_pairs(sides):
    out = {}
    for pair in {s[0] for s in sides if s[0] is not None}:
        seq = {x: sorted({(s[2], s[3], s[4]) for s in sides if s[0] == pair and s[1] == x}) for x in ("chosen", "rejected")}
        n = 0
        while n < min(map(len, seq.values())) and seq["chosen"][n] == seq["rejected"][n]:
            n += 1

        def show(turns):
            at, spans, text = 0, [], ""
            for _, role, body in turns:
                head = f"<|im_start|>{role}\n"
                text += f"{head}{body}<|im_end|>\n"
                if role == "assistant":
                    spans.append(f"{at + len(head)}:{at + len(head) + len(body) + 10}")
                at = len(text)
            return text, ",".join(spans)

        (c, cm), (r, rm) = show(seq["chosen"][n:]), show(seq["rejected"][n:])
        out[pair] = (n, show(seq["chosen"][:n])[0], c, r, cm, rm)
    return out


def test_preference_pairs(spark):
    rng = random.Random(6)
    sides = []
    for pair in range(30):
        common = [(t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb é", ""])) for t in range(rng.randint(0, 4))]
        for side in ("chosen", "rejected"):
            tail = [(t, rng.choice(["user", "assistant"]), rng.choice(["x", "yy"])) for t in range(len(common), len(common) + rng.randint(0, 3))]
            sides += [(pair, side, *t, "extra") for t in common + tail]
    sides += sides[:20]
    frame = spark.createDataFrame(sides + [(None, "chosen", 0, "user", "z", "e"), (3, "other", 0, "user", "z", "e")], "pair_id long, side string, turn long, role string, text string, part string")
    got = {r["pair_id"]: tuple(r)[2:] for r in op09_chat.format_pairs(frame).collect()}
    assert got == plain_pairs([s[:5] for s in sides])
    assert op09_chat.format_pairs(frame.limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, "chosen", None, None, None), (1, "rejected", 0, "user", "q")], "pair_id long, side string, turn long, role string, text string")
    row = op09_chat.format_pairs(nulls).first()
    assert row["prompt"] == "" and row["chosen"] == "<|im_start|>\n<|im_end|>\n" and row["rejected"].startswith("<|im_start|>user")


def test_long_conversation_goes_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(op09_chat, "TURNS_PER_ROW", 4)
    rows = [(1, side, t, "assistant", f"{t}{'!' if side == 'chosen' and t > 5 else ''}") for side in ("chosen", "rejected") for t in range(10)]
    got = op09_chat.format_pairs(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")).orderBy("part").collect()
    assert [r["n_prompt_turns"] for r in got] == [4, 2, 0]
    assert "".join(r["prompt"] + r["chosen"] for r in got) == "".join(f"<|im_start|>assistant\n{t}{'!' if t > 5 else ''}<|im_end|>\n" for t in range(10))
