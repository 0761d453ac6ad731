"""Near-duplicates, repeated passages, embeddings and fingerprints against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm import cover_tree, merkle, near_dedup, shingles, suffix_dedup
from tempora.llm.components import components


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def brute_near(rows, percent):
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    sets, u, uniq, inverted = [], Union(), {}, {}
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    for (i, _), s in zip(rows, sets, strict=True):
        if i is not None and s:
            u.join(uniq.setdefault(s, i), i)
    whole = list(uniq.items())
    for k, (s, i) in enumerate(whole):
        shared = {}
        for x in s:
            for q in inverted.setdefault(x, []):
                shared[q] = shared.get(q, 0) + 1
            inverted[x].append(k)
        for q, n in shared.items():
            if 100 * n >= percent * (len(s) + len(whole[q][0]) - n):
                u.join(i, whole[q][1])
    return sorted(((i, len(s), None if i is None else u.find(i), i is None or u.find(i) == i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def near(df, percent, **more):
    return sorted(map(tuple, near_dedup.near_components(df, percent, **more).collect()), key=str)


def test_near_on_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert near(docs, 85) == brute_near(rows, 85)
    assert near(docs, 80) == brute_near(rows, 80)
    assert sorted(map(tuple, near_dedup.op8_near_dedup(spark, small).collect()), key=str) == brute_near(rows, 85)


def several_texts(n=60):
    """Documents of several texts, in several groups, with copies and near copies, and texts that no document has alone."""
    rnd, vocabulary = random.Random(9), [f"w{i}" for i in range(2000)]
    bases = [[rnd.choice(vocabulary) for _ in range(60)] for _ in range(12)]

    def text():
        w = list(rnd.choice(bases))
        if rnd.random() < 0.5:
            w[rnd.choice([0, 59])] = rnd.choice(vocabulary)
        return " ".join(w)

    return [(rnd.randrange(n // 2), text()) for _ in range(n)] + [(7, None), (8, ""), (None, text()), (900, "only this"), (900, "and that one")]


@pytest.mark.parametrize("group_docs", [1000, 5])
def test_near_with_documents_of_several_texts(spark, group_docs):
    rows = several_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(df, 85, group_docs=group_docs) == brute_near(rows, 85)
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"), (3, "u v w x y z")]
    assert near(spark.createDataFrame(rows, "doc_id long, text string"), 80) == brute_near(rows, 80) == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 2, 1, False)], key=str)


def test_no_text_is_lost_with_documents_of_several_texts(spark):
    kept = lambda rows: sorted(((r["doc_id"], r["text"]) for r in near_dedup.first_of_each(spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, digest string"), 80).collect()), key=str)
    assert kept([(1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"), (3, "u v w x y z")]) == [(1, "a b c d e f"), (2, "u v w x y z")]
    rows = several_texts()
    # Each text as a document of its own: which of them are alike, and the least doc_id among these.
    texts = sorted({t for i, t in rows if t and i is not None})
    alone = {texts[k]: c for k, _, c, _ in brute_near(list(enumerate(texts)), 80)}
    least = {}
    for i, t in rows:
        if t and i is not None:
            least[alone[t]] = min(i, least.get(alone[t], i))
    assert kept(rows) == sorted(((i, t) for i, t in rows if not t or i is None or least[alone[t]] == i), key=str)


@pytest.mark.parametrize("group_docs", [1000, 40])
def test_near_on_one_large_group(spark, group_docs):
    rnd, vocabulary = random.Random(5), [f"w{i}" for i in range(500)]
    base = [rnd.choice(vocabulary) for _ in range(150)]

    def edit(n):
        w = list(base)
        for _ in range(n):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        return " ".join(w)

    rows = [(i, edit(rnd.randrange(8))) for i in range(200)] + [(400 + i, " ".join(base[: rnd.randrange(7)])) for i in range(20)]
    rows += [(None, edit(1)), (None, None), (500, None), (501, " \n"), (3, edit(1)), (502, "A B"), (503, "a b"), (504, "a"), (505, base[0] + " x" * 9000), (505, base[0] + " x" * 9000)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, digest string")
    assert near(df, 85, group_docs=group_docs) == brute_near(rows, 85)
    assert near(df.limit(0), 85) == []


@pytest.mark.parametrize("percent", [85, 80])
def test_near_on_large_groups_that_no_member_holds_together(spark, percent):
    rnd, vocabulary = random.Random(8), [f"w{i}" for i in range(5000)]
    base, revision, rows = [rnd.choice(vocabulary) for _ in range(400)], [rnd.choice(vocabulary) for _ in range(200)], []
    for i in range(120):  # pairs of 0.86 and 0.82, the base isn't in the table
        w = list(base)
        for k in rnd.sample(range(0, 400, 5), 3 if percent == 85 else 4):
            w[k] = rnd.choice(vocabulary)
        rows.append((i, " ".join(w)))
    for i in range(120):  # a chain: each revision changes one word more
        revision[(i * 37) % 200] = f"new{i}"
        rows.append((1000 + (i * 53) % 120, " ".join(revision)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_near(rows, percent)
    assert sum(r[3] for r in expected) == 2
    assert near(df, percent, group_docs=30) == expected


def test_near_on_words_that_simple_hashes_mistake(spark):
    x = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    y = x.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{x} {x}"), (2, f"{y} {y}"), (3, x), (4, y)]
    assert near(spark.createDataFrame(rows, "doc_id long, text string"), 85) == brute_near(rows, 85)


def test_sets_go_by_words_not_hashes(monkeypatch):
    texts = ["a b c d e f g", "a b c d e f h", "b a c d e f g", "a b", "b a", "A  b", "", "a b c d e f g f g f g"]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in texts]
    for weak in (None, lambda sums, start, end: np.zeros(len(start), np.uint64)):
        if weak:
            monkeypatch.setattr(shingles, "range_hash", weak)
            monkeypatch.setattr(shingles, "mix", lambda x: x * np.uint64(0))
        flat, ends, _ = shingles.exact_sets(data, at)
        got = [set(flat[i:j].tolist()) for i, j in zip(ends, ends[1:], strict=False)]
        assert [len(g) for g in got] == [len(w) for w in want]
        assert all(len(got[i] & got[j]) == len(want[i] & want[j]) for i in range(len(texts)) for j in range(len(texts)))


def test_large_groups_grow_with_their_buckets(spark):
    """A chain in which only neighbours are alike: pairs that are estimated are those of buckets, not all of the cluster."""
    rnd, words, rows = random.Random(4), [f"v{i}" for i in range(300)], []
    for i in range(160):
        words[rnd.randrange(300)] = f"n{i}"
        rows.append((i, " ".join(words)))
    assert near(spark.createDataFrame(rows, "doc_id long, text string"), 85, group_docs=20, block=12) == brute_near(rows, 85)


def test_estimates():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    for share in (0.5, 0.8, 0.95):
        k = int(len(a) * share)
        b = np.unique(np.concatenate([a[:k], rng.integers(0, 2**63, len(a) - k).astype(np.uint64)]))
        r = shingles.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        true = k / (len(a) + len(b) - k)
        assert shingles.estimate(r[:1], r[1:], np.array([len(a)]), np.array([len(b)]))[0] == pytest.approx(true, abs=0.16)


def test_components(spark):
    rnd, u = random.Random(8), Union()
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    for a, b in edges:
        u.join(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: u.find(x) for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, span=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - span + 1 if i is not None else 0):
            first[b[j : j + span]] = min(first.get(b[j : j + span], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - span + 1 if i is not None else 0):
            if first[b[j : j + span]] < i:
                gone[j : j + span] = b"\1" * span
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return sorted(out, key=str)


def repeats(df, **more):
    out = suffix_dedup.remove_repeats(df, **more)
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return sorted(map(tuple, out.select("doc_id", F.octet_length("kept") + n, n, F.size("removed"), F.sha2("kept", 256)).collect()), key=str)


def test_repeats_on_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_repeats(rows)
    assert repeats(docs, part_bytes=60_000, range_messages=5000) == want
    assert sorted(map(tuple, suffix_dedup.op5_suffix_dedup(spark, small).collect()), key=str) == want


def test_repeats_on_hard_rows(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice(["aa", "b", "ccc", "dé", "xyz"]) for _ in range(200)) for _ in range(5)]
    rows = []
    for _ in range(200):
        t = "".join(rnd.choice(base)[(k := rnd.randrange(400)) : k + rnd.randrange(120)] for _ in range(rnd.randrange(8)))
        rows.append((rnd.randrange(150) if rnd.random() > 0.05 else None, t if rnd.random() > 0.05 else None))
    rows += [(1000 + i, "ab " * 400) for i in range(5)] + [(7, "z" * 3000), (2000, "z" * 60), (2001, "q" * 60)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int")
    assert repeats(df, part_bytes=9000, range_messages=500) == brute_repeats(rows)
    assert repeats(df.limit(0)) == []
    kept = suffix_dedup.remove_repeats(df, carry=("part", "doc_id"))
    assert kept.columns == ["doc_id", "removed", "kept"]


def test_frequent_leading_bytes_are_cut(spark):
    rnd = random.Random(6)
    texts = ["".join("https://" + "".join(rnd.choice("abcdef") for _ in range(24)) for _ in range(60)) for _ in range(40)]
    rows = list(enumerate(texts)) + [(100 + i, t[300:700]) for i, t in enumerate(texts[:9])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeats(df, part_bytes=9000, range_messages=200) == brute_repeats(rows)
    total = sum(len(t) for _, t in rows)
    lead, rest = suffix_dedup._splitters(df, total, 12, 50, 24)
    part = suffix_dedup.Part(__import__("pyarrow").array(texts), __import__("pyarrow").array(range(len(texts))), 50, 24)
    sizes = [len(suffix_dedup.unpack(b)[0]) for _, b in part.first_messages((lead, rest))]
    assert sum(sizes) == len(part.lead) and len(sizes) > 6 and max(sizes) < 0.4 * sum(sizes)


def test_kept_characters_are_whole(spark):
    shared = "é漢😀" * 30
    rows = [(1, shared), (2, "x" + shared[1:] + "\ufffd own"), (3, "\ufffd" + shared[:40] + "é\ufffd"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: (r["removed"], r["kept"]) for r in suffix_dedup.remove_repeats(df, characters=True).collect()}
    for i, t in rows:
        raw, gone = (t or "").encode(), {b for r in out[i][0] for b in range(r["start"], r["end"])}
        ends = np.cumsum([0, *(len(c.encode()) for c in t or "")])
        want = "".join(c for c, a, b in zip(t or "", ends, ends[1:], strict=False) if not gone & set(range(a, b)))
        assert out[i][1].decode() == want and (i != 2 or ("\ufffd own" in want and len(want) < 20)) and len(raw) == len(t.encode() if t else b"")


def test_multikey_order():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 4, 500) for _ in range(3)]
    order = suffix_dedup.multikey_order(*keys)
    assert [tuple(k[i] for k in keys) for i in order] == sorted(zip(*keys, strict=True))
    columns = [rng.integers(0, 9, 7).astype(np.uint64), np.arange(7, dtype=np.uint8)]
    assert all((a == b).all() for a, b in zip(suffix_dedup.unpack(suffix_dedup.pack(*columns)), columns, strict=True))


def test_long_document_in_pieces(monkeypatch):
    import pyarrow as pa

    text = "".join(random.Random(9).choice("abc ") for _ in range(5000)) * 2
    whole = suffix_dedup.Part(pa.array([text]), pa.array([1]), 50, 24)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 700)
    cut = suffix_dedup.Part(pa.array([text]), pa.array([1]), 50, 24)
    windows = lambda p: sorted((a, w) for a, f, last in zip(p.place, p.first, p.last, strict=True) for w in range(f, last + 1))
    assert windows(whole) == windows(cut)


def brute_cosine(rows, cosine=0.95):
    def ok(k, v):
        return k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links, u = [0] * len(rows), Union()
    good = [i for i, r in enumerate(rows) if ok(*r)]
    for size in {len(rows[i][1]) for i in good}:
        own = [i for i in good if len(rows[i][1]) == size]
        x = cover_tree.unit(np.array([rows[i][1] for i in own], float))
        hit = x @ x.T >= cosine
        np.fill_diagonal(hit, False)
        for a, b in zip(*np.nonzero(hit), strict=True):
            links[own[a]] += 1
            u.join(rows[own[a]][0], rows[own[b]][0])
    return sorted(((k, links[i], None if k is None else u.find(k), k is None or u.find(k) == k) for i, (k, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("more", [{}, {"cell_points": 20, "block": 15}])
def test_cosine(spark, small, more):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in base[rng.integers(6)] * rng.uniform(0.5, 2) + rng.normal(size=8) * rng.choice([0, 0.01, 0.1, 0.3])]) for i in range(300)]
    rows += [(700, None), (701, [0.0] * 8), (702, [float("nan")] * 8), (703, [None] + [1.0] * 7), (704, [1.0, 2.0]), (705, [2.0, 4.0]), (None, [1.0] * 8), (706, []), (3, rows[5][1]), (707, rows[7][1]), (708, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, cover_tree.cosine_components(df, **more).collect()), key=str) == brute_cosine(rows)
    assert cover_tree.cosine_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4000, 5])
def test_cosine_of_any_magnitude_length_and_number(spark, block):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (4, [0.0, 1.0]), (3, [1e-200, 0.0]), (5, [1e200, 1e190]), (6, [5e-324, 0.0]), (7, [0.0, -1e-310]), (8, [-3e307, 1e308])]
    rows += [(10 + n, [1.0] * n) for n in range(3, 1200)] + [(5000 + n, [2.0] * (n - 1) + [2.001]) for n in range(3, 1200, 100)] + [(9000 + i, [3.0, 4.0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.cosine_components(df, block=block, cell_points=3).collect()}
    assert [got[i] for i in (1, 2, 3, 5, 6)] == [(4, 1)] * 5 and [got[i] for i in (4, 7, 8)] == [(1, 4), (0, 7), (1, 4)]
    assert all(got[10 + n] == ((1, 10 + n) if n % 100 == 3 else (0, 10 + n)) for n in range(3, 1200))
    assert all(got[9000 + i] == (2999, 9000) for i in range(3000))


def test_cosine_on_tables(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert sorted(map(tuple, cover_tree.op2_cover_tree(spark, small).collect()), key=str) == brute_cosine(rows)


def test_tree_covers(monkeypatch):
    monkeypatch.setattr(cover_tree, "LEAF", 4)
    x = cover_tree.unit(np.random.default_rng(2).normal(size=(200, 3)))

    def check(node):
        assert cover_tree.distances(x[node.rows], node.centre[None]).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(r for c in node.children for r in c.rows) == sorted(node.rows)
            for c in node.children:
                assert c.radius <= node.radius / 2 + 1e-9
                check(c)

    top = cover_tree.tree(x)
    check(top)
    links = cover_tree.Links(x, np.ones(200, np.int64), 0.95)
    links.dual(top, top)
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    assert (links.count == hit.sum(1)).all()


def test_fingerprints_on_tables(spark, small):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in merkle.op1_merkle_fingerprint(spark, small).collect()}
    by_text = {}
    for k, (i, t) in enumerate(rows):
        q, r = len(t) // 4, got[i]
        edited = t[: len(t) - q] + rows[(k + 1) % len(rows)][1][:q]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        by_text.setdefault(t, set()).add(r["fingerprint"])
        assert 0 <= r["near_next"] <= 1 and (edited != t or r["near_edited"] == 1.0) and (r["edited_fingerprint"] == r["fingerprint"]) == (edited == t)
    assert all(len(v) == 1 for v in by_text.values()) and len({p for v in by_text.values() for p in v}) == len(by_text)
    blocks = lambda f: {x[k : k + 6] for x in re.findall("=([0-9a-f]*)", f) for k in range(0, len(x), 6)}
    like = lambda a, b: len(a & b) / max(len(a), len(b)) if a or b else 1.0
    for k, (i, _) in enumerate(rows):
        own, after = blocks(got[i]["fingerprint"]), blocks(got[rows[(k + 1) % len(rows)][0]]["fingerprint"])
        assert got[i]["near_edited"] == pytest.approx(like(own, blocks(got[i]["edited_fingerprint"]))) and got[i]["near_next"] == pytest.approx(like(own, after))
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.6 and np.mean([r["near_next"] for r in got.values()]) < 0.05


def test_fingerprint_rows(spark):
    df = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (1, "c", 0), (None, "x y z w v u", 0), (None, None, 0), (5, "", 0), (2, "é" * 10, 0), (3, "q " * 50_000, 0)], "doc_id long, text string, copies int")
    rows = merkle.edited_fingerprints(df).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in rows) == [(-1, 0), (-1, 11), (1, 1), (1, 3), (1, 3), (2, 10), (3, 100_000), (5, 0)]
    assert merkle.edited_fingerprints(df.limit(0)).count() == 0
    lone = merkle.edited_fingerprints(spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")).first()
    assert lone["near_next"] == 1.0
    kept = spark.createDataFrame([(lone["fingerprint"],)], "f string").select(merkle.parsed_leaves(F.col("f")).alias("l"), merkle.leaves(merkle.tree(F.lit("one two three four"))).alias("m")).first()
    assert kept["l"] == kept["m"]


def test_paragraphs_locate_edits(spark):
    a, b = "First line here.\nSecond line.\n\nThird part of it.", "First line here.\nSecond line changed.\n\nThird part of it."
    f = lambda t: merkle.fingerprint(F.lit(t), merkle.tree(F.lit(t)))
    x, y = (r.split(";") for r in spark.range(1).select(f(a), f(b)).first())
    assert x[0] != y[0] and x[2] == y[2] and x[1].split(":")[1].split(",")[0] == y[1].split(":")[1].split(",")[0]
