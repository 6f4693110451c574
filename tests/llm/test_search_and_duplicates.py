"""Top-k, SimHash, lines and components against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gridtide.llm import edit_distance, line_keys, op01_topk, op02_lines, op03_simhash, shared


def brute_top(vectors, queries, k):
    out = []
    for q, v in queries.items():
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors.items() if i != q))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_topk_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(op01_topk, "CANDIDATES_PER_BLOCK", 40)
    monkeypatch.setattr(op01_topk, "QUERIES_PER_BLOCK", 7)
    rng = random.Random(4)
    vectors = {i: [rng.randint(-3, 3) for _ in range(3)] for i in range(150)} | {i: [1, 2, 3] for i in range(150, 220)}
    queries = {i: v for i, v in vectors.items() if i % 11 == 0}
    frame = spark.createDataFrame([*vectors.items()], "vec_id long, v array<long>")
    frame = frame.unionByName(frame.limit(30)).unionByName(spark.createDataFrame([(None, [1]), (999, None)], frame.schema))
    found = op01_topk.top_k(frame, frame.where("vec_id % 11 = 0"))
    assert sorted(tuple(r) for r in found.collect()) == brute_top(vectors, queries, 5)


def test_topk_small_and_empty(spark):
    frame = spark.createDataFrame([(0, [5, 1]), (1, [2])], "vec_id long, v array<long>")
    assert sorted(tuple(r) for r in op01_topk.top_k(frame, frame).collect()) == [(0, 1, 1, 10), (1, 1, 0, 10)]
    assert op01_topk.top_k(frame, frame.where("vec_id > 5")).count() == 0
    assert op01_topk.top_k(frame.limit(0), frame.limit(0)).count() == 0
    assert op01_topk.top_k(frame.limit(1), frame.limit(1)).count() == 0


def slow_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbé \n\t ", max_size=60))
def test_fingerprint(text):
    assert op03_simhash.fingerprint(text) == slow_print(text)


def brute_components(prints, radius):
    forest = shared.Forest(len(prints))
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            forest.union(i, j)
    return [forest.root(i) for i in range(len(prints))]


def test_links_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(op03_simhash, "SHARD_LIMIT", 9)
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (1 << 64) - 1 for b in base for _ in range(25)})
    signed = [(x - (x >> 63 << 64),) for x in prints]
    got = {tuple(r) for r in op03_simhash.links(spark.createDataFrame(signed, "fp long")).collect()}
    want = {(max(a, b), min(a, b)) for (a,), (b,) in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want and len(want) > 50


def test_near_duplicates_edge_rows(docs, no_docs):
    found = {(r["doc_id"], r["fp"], r["component_id"]) for r in op03_simhash.near_duplicates(docs).collect()}
    by_id = {i: (fp, c) for i, fp, c in found if i is not None}
    assert op03_simhash.near_duplicates(docs).count() == docs.count()
    assert by_id[3] == by_id[4] == by_id[5] == (0, 3) and by_id[7] == (by_id[1][0], 1)
    kept = op03_simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.select("doc_id").collect())
    assert (False, 7) not in ids and (False, 4) not in ids and (False, 3) in ids and ids.count((True, None)) == 1
    assert op03_simhash.near_duplicates(no_docs).count() == 0 and op03_simhash.keep_one(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, None), (7, 7)]
    edges += [(2000 + i, 2001 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    forest = shared.Forest(3000)
    for a, b in edges:
        if b is not None:
            forest.union(a, b)
    touched = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    assert got == {x: forest.root(x) for x in touched}
    assert shared.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tiles_bring_all_pairs_together(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, i) for i in range(5)], "k int, id long")
    tiles = shared.tiled(rows, "k", "id", 10).collect()
    met = {}
    for r in tiles:
        met.setdefault((r["k"], r["tile"]), set()).add(r["id"])
    pairs = {(k, a, b) for (k, _), ids in met.items() for a in ids for b in ids if a < b}
    assert len([p for p in pairs if p[0] == 1]) == 50 * 49 // 2 and len([p for p in pairs if p[0] == 2]) == 10
    assert max(len(v) for v in met.values()) < 40


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc ", max_size=40), st.text(alphabet="abc ", max_size=40), st.integers(0, 12))
def test_edit_distance(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    assert edit_distance.within([(a, b, most)]).tolist() == [row[-1] <= most]
    assert row[-1] <= most or not op02_lines.surely_within(a, b, most)


def test_edit_distances_of_many_pairs_at_once(monkeypatch):
    """Patterns of one word and of several, at their borders, of scripts of several bytes; against one integer a pair and plain distances."""
    rng = random.Random(11)
    pairs, want = [], []
    for n in [1, 2, 31, 63, 64, 65, 100, 127, 128, 129, 150] * 8:
        letters = rng.choice(["ab", "abcdefgh ", "äöüabc漢字😀"])
        a = "".join(rng.choice(letters) for _ in range(n))
        b = "".join(rng.choice(["", c, c, c, c, c, c, rng.choice(letters), c + rng.choice(letters)]) for c in rng.choice([a, a[n // 6 :] + a[: n // 9]]))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        for most in (row[-1] - 1, row[-1], n // 5):
            pairs.append((a, b, most))
            want.append(row[-1] <= most)
    assert edit_distance.within(pairs).tolist() == want
    monkeypatch.setattr(edit_distance, "FEWEST", 10**6)
    assert edit_distance.within(pairs).tolist() == want
    monkeypatch.setattr(edit_distance, "FEWEST", 1)
    monkeypatch.setattr(edit_distance, "TABLE_WORDS", 100)
    assert edit_distance.within(pairs).tolist() == want
    assert edit_distance.within([]).tolist() == []


def test_edit_distance_lanes_begin_and_end_with_the_bound_of_the_diagonal(monkeypatch):
    """Lines of many words whose common passage stands at other places, bounds from narrow to wide, all in one block; against one integer a pair."""
    rng = random.Random(12)
    pairs = []
    for n in (70, 200, 513, 900, 1500) * 12:
        passage = "".join(rng.choice("abcdefgh ") for _ in range(n))
        lead, tail = ("".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(n // 4))) for _ in range(2))
        a, b = f"x{lead}{passage}y", f"z{passage}{tail}w"
        pairs += [(a, b, most) for most in (n // 20, n // 5, n // 3) if abs(len(a) - len(b)) <= most]
    want = [edit_distance.one_within(*edit_distance.trimmed(a, b), most) for a, b, most in pairs]
    monkeypatch.setattr(edit_distance, "FEWEST", 1)
    monkeypatch.setattr(edit_distance, "ALIKE", 0)
    assert edit_distance.within(pairs).tolist() == want and 20 < sum(want) < len(want) - 20
    monkeypatch.setattr(edit_distance, "LANES", 1)
    assert edit_distance.within(pairs[:40]).tolist() == want[:40]


def test_tiles_of_the_same_lines_are_one_with_all_their_blocks(spark):
    rows = [(5, 0, 1), (5, 0, 2), (3, 1, 2), (3, 1, 1), (3, 2, 1), (3, 2, 2), (4, 0, 1), (4, 0, 2), (4, 0, 3)]
    got = op02_lines._once(spark.createDataFrame(rows, "block long, tile int, node long")).collect()
    assert sorted((r["block"], r["tile"], sorted(r["blocks"]), r["node"]) for r in got) == [(3, 1, [3, 5], 1), (3, 1, [3, 5], 2), (4, 0, [4], 1), (4, 0, [4], 2), (4, 0, [4], 3)]


def test_links_are_found_in_a_run_that_stands_for_several_blocks():
    forms = ["one two three four five six seven eight", "one two three four five six seven eight nine"]
    keys = np.array([[9, 4, 7, 0], [9, 4, 8, 0]])  # the smallest shared key is 4
    runs = np.zeros(2, np.int64)
    assert list(op02_lines.links(forms, runs, keys, np.array([[9, 4], [9, 4]]))) == [(1, 0)]
    assert list(op02_lines.links(forms, runs, keys, np.array([[9, 9], [9, 9]]))) == []


def test_words_have_the_same_hashes_in_a_short_slice_and_in_a_long_one():
    """Powers are taken by place in the slice where it is short, by place in the word where it or a word is long."""
    rng = np.random.default_rng(6)
    data = rng.choice(np.frombuffer(b"abcXYZ09 .,\xc3\xa9\xe4\xb8\xad", np.uint8), 3000)
    offsets = np.array([0, 0, 7, 1500, 3000])
    for alone in (256, 0xE0):
        words, starts = shared.hashed_words(data, offsets, op02_lines._WORDS, alone)
        for more in (np.full(5000, 97, np.uint8), np.full(1 << 18, 32, np.uint8)):
            again, places = shared.hashed_words(np.concatenate((data, more)), np.append(offsets, 3000 + len(more)), op02_lines._WORDS, alone)
            assert (again[: len(words)] == words).all() and (places[: len(words)] == starts).all()


def test_texts_that_lose_lines_are_rebuilt_and_all_lines_counted():
    texts, drops = ["a\nb\nc", None, "", "x\n", "same\nlines"], [[0, 2], None, None, [1], []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts), pa.array(drops, pa.list_(pa.int32()))], names=["id", "text", "drop"])
    (got,) = op02_lines._without([batch.slice(0, 5)])
    assert [c.to_pylist() for c in got.columns] == [[0, 1, 2, 3, 4], ["b", None, "", "x", "same\nlines"], [3, 0, 1, 2, 2], [2, 0, 0, 1, 0]]


def brute_lines(docs):
    """(doc_id, text without repeats): of all pairs of lines those that share a key and are similar are linked, each group keeps its first line."""
    found = []
    for doc_id, text in docs:
        for n, line in enumerate(text.split("\n")):
            real, data = op02_lines.real_form(line), np.frombuffer((op02_lines.normal_form(line) + "\n").encode(), np.uint8)
            words, _ = shared.hashed_words(data, np.array([0, len(data)]), op02_lines._WORDS, op02_lines._WIDE)
            keys, sim = set(), 0
            if len(words) >= op02_lines.MIN_WORDS:
                keys = set(line_keys.keys_of(data, np.array([0, len(data)]), np.array([0]), words, np.array([0]), np.array([len(words)]))[0].tolist())
                sim = int(line_keys.sim_hashes(words, np.array([0]))[0])
            if real:
                found.append((doc_id, n, real, keys, sim))
    forest = shared.Forest(len(found))
    for i, j in itertools.combinations(range(len(found)), 2):
        a, b = found[i], found[j]
        near = min(len(a[2]), len(b[2])) < op02_lines.LONG or (a[4] ^ b[4]).bit_count() <= op02_lines.RADIUS
        if a[2] == b[2] or (a[3] & b[3] and near and op02_lines.similar(a[2], b[2])):
            forest.union(i, j)
    order = sorted(range(len(found)), key=lambda i: found[i][:2])
    seen, gone = set(), set()
    for i in order:
        if forest.root(i) in seen:
            gone.add(found[i][:2])
        seen.add(forest.root(i))
    return {(d, "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone)) for d, t in docs}, len(gone)


@pytest.mark.parametrize("at_once", [16384, 40, 1])
def test_runs_have_the_groups_of_all_pairs(at_once, monkeypatch):
    monkeypatch.setattr(op02_lines, "PAIRS_AT_ONCE", at_once)
    monkeypatch.setattr(op02_lines, "OPEN_PAIRS", at_once)
    monkeypatch.setattr(edit_distance, "FEWEST", 2)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.choice([6, 30]))) for _ in range(5)]
    forms = sorted(({" ".join(w if rng.random() > 0.06 else rng.choice(words) for w in rng.choice(lines).split()) for _ in range(80)}), key=len)
    table = line_keys.keys_of_forms(forms, op02_lines._WORDS, op02_lines._WIDE).view(np.int64)
    want, got = shared.Forest(len(forms)), shared.Forest(len(forms))
    for i, j in itertools.combinations(range(len(forms)), 2):
        near = min(len(forms[i]), len(forms[j])) < op02_lines.LONG or (int(table[i, -1] ^ table[j, -1]) & (1 << 64) - 1).bit_count() <= op02_lines.RADIUS
        if near and set(table[i, :-1]) & set(table[j, :-1]) and op02_lines.similar(forms[i], forms[j]):
            want.union(i, j)
    blocks = sorted({int(k) for k in table[:, :-1].ravel()})
    members = [(b, i) for b in blocks for i in np.flatnonzero((table[:, :-1] == b).any(1)).tolist()]
    runs, rows = np.array([blocks.index(b) for b, _ in members]), [i for _, i in members]
    for x, y in op02_lines.links([forms[i] for i in rows], runs, table[rows], np.array([b for b, _ in members])):
        assert got.union(rows[x], rows[y]) or got.root(rows[x]) == got.root(rows[y])
    assert [got.root(i) for i in range(len(forms))] == [want.root(i) for i in range(len(forms))]
    assert len({want.root(i) for i in range(len(forms))}) < len(forms) / 2


@pytest.mark.parametrize("tile", [500, 12])
def test_line_dedup_matches_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(op02_lines, "TILE_LIMIT", tile)
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "ember", "north", "south", "ü1"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    docs = []
    for i in range(60):
        mine = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(lines).split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            mine.append(rng.choice([" ".join(w), " ".join(w).upper() + " !", ""]))
        docs.append((i, "\n".join(mine)))
    want, gone = brute_lines(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = op02_lines.dedup_lines(frame).collect()
    assert {(r["doc_id"], r["text"]) for r in got} == want and gone > 25
    assert sum(r["n_removed"] for r in got) == gone


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcé ", max_size=60), st.lists(st.tuples(st.integers(0, 60), st.sampled_from(["", "x", "ab"])), max_size=6))
def test_the_count_filter_never_puts_a_similar_pair_aside(a, edits):
    b = a
    for at, new in edits:
        b = b[:at] + new + b[at + 1 :]
    counts = op02_lines.run_counts([a, "other", b])
    most = next(k for k in range(100) if edit_distance.within([(a, b, k)])[0])
    assert op02_lines.may_be_similar(counts, np.array([0]), np.array([2]), np.array([most])).all()


def test_lines_within_the_simhash_radius_share_a_piece():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    for bits in range(line_keys.PIECES - 1):
        b = a.copy()
        for i in range(len(a)):
            for bit in rng.choice(64, bits, replace=False):
                b[i] ^= np.uint64(1) << np.uint64(bit)
        assert (line_keys.piece_keys(a) == line_keys.piece_keys(b)).any(1).all()
    words = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    begins = np.array([0, 5, 6, 100])
    for i, (x, y) in enumerate(zip(begins, [*begins[1:], 300])):
        own = [int(w) for w in words[x:y]]
        assert int(line_keys.sim_hashes(words, begins)[i]) == sum(1 << k for k in range(64) if 2 * sum(w >> k & 1 for w in own) > len(own))


def test_line_dedup_edge_rows(docs, no_docs):
    got = op02_lines.dedup_lines(docs)
    rows = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    assert got.count() == docs.count() and rows[3]["text"] is None and rows[3]["n_lines"] == 0
    assert rows[4]["text"] == "" and rows[1]["n_removed"] == 0 and rows[7]["text"] == "" and rows[7]["n_removed"] == 2
    assert rows[6]["text"] == docs.where("doc_id = 6").first()["text"]
    assert op02_lines.dedup_lines(docs, counts=False).columns == docs.columns
    assert op02_lines.dedup_lines(no_docs).count() == 0


def near_pairs(rng, words, sizes):
    """(words, line, other line) of lines that differ in one word changed, put in or taken out, or in one character."""
    out = []
    for n in sizes:
        for kind in range(4):
            line = [rng.choice(words) for _ in range(n)]
            other, at = list(line), rng.randrange(n)
            if kind == 0:
                other[at] = rng.choice(words)
            elif kind == 1:
                other.insert(at, rng.choice(words))
            elif kind == 2:
                del other[at]
            else:
                other[at] = "q" + other[at][1:]
            if len(other) >= op02_lines.MIN_WORDS and other != line:
                out.append((n, " ".join(line), " ".join(other)))
    return out


def test_lines_one_word_apart_are_all_found(spark):
    """Every pair of lines that is one word apart and similar by edit distance is found, at any length."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    pairs = [p for p in near_pairs(rng, words, [n for n in (5, 6, 7, 9, 12, 15, 19, 25, 33, 39, 45, 59, 80) for _ in range(12)]) if op02_lines.similar(p[1], p[2])]
    docs = [(2 * i + k, p[1 + k]) for i, p in enumerate(pairs) for k in (0, 1)]
    got = {r["doc_id"]: r["text"] for r in op02_lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    missed = [p[0] for i, p in enumerate(pairs) if got[2 * i + 1]]
    assert len(pairs) > 400 and missed == []
    assert all(got[2 * i] for i in range(len(pairs)))


@pytest.mark.parametrize("limit", [1000, 8])
def test_whole_line_dedup_keeps_only_the_first_of_linked_lines(spark, monkeypatch, limit):
    monkeypatch.setattr(op02_lines, "TILE_LIMIT", limit)
    base = "one two three four five six seven eight nine ten".split()
    lines = [" ".join([*base[:5], f"w{chr(97 + i % 26)}{chr(97 + i // 26)}", *base[5:]]) for i in range(60)]
    docs = spark.createDataFrame([(i, f"{x}\n{'qrstu'[i % 5] * 9} own line of {'vwxyz'[i // 12] * 9} alone here") for i, x in enumerate(lines)], "doc_id long, text string")
    got = op02_lines.dedup_lines(docs).collect()
    assert sum(lines[r["doc_id"]] in r["text"] for r in got) == 1


def test_lines_that_differ_in_digits_stay(spark):
    texts = ["12 34 56 78 90\n-- ++ a b c d e", "98 76 54 32 10", "12 34 56 78 90\n[#] !! <a> (b) {c} *d* /e/", "12  34 56 78 90\n12 34 56 78 91", "A b C d E f G 1", "a b c d e f g 2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in op02_lines.dedup_lines(docs).collect()}
    assert got == {0: texts[0], 1: texts[1], 2: texts[2].split("\n")[1], 3: "", 4: texts[4], 5: ""}


def test_short_lines_and_scripts_without_spaces_are_deduplicated(spark):
    han = "今天天气很好我们一起去公园散步看花吧然后回家吃饭"
    texts = [f"Menu\n{han}。\n\n***\nhome", f"menu\n{han}。\n \n***\nhom", han.replace("公", "花"), f"own line\n{han}！", "Menu 2\nMenu 3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in op02_lines.dedup_lines(docs).collect()}
    assert got == {0: texts[0], 1: " \nhom", 2: "", 3: "own line", 4: texts[4]}
