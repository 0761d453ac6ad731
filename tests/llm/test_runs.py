"""Runs of words against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tempora.llm import runs

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(words):
    """(start, length, period) of all runs: for each period the longest stretches, without those of a smaller one."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                s = words[i : j + q]
                if not any(all(x == y for x, y in zip(s, s[p:], strict=False)) for p in range(1, q)):
                    found.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def rest(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def local(texts):
    raw = [t if isinstance(t, bytes) else t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    _, _, word_at, low, high, q = runs.runs_of_texts(np.frombuffer(b"".join(raw), np.uint8), at)
    document = np.searchsorted(word_at, low, side="right") - 1
    out = [[] for _ in raw]
    for d, s, e, p in zip(document.tolist(), low.tolist(), high.tolist(), q.tolist(), strict=True):
        out[d].append((s - int(word_at[d]), e - s, p))
    return out


def periodic(rnd, n=60):
    """A text with powers in powers, broken here and there."""
    words = []
    while len(words) < n:
        unit = [rnd.choice("abc") for _ in range(rnd.randint(1, 5))]
        if rnd.random() < 0.3:
            unit = unit * rnd.randint(1, 6) + [rnd.choice("abcd")]
        words += unit * rnd.randint(1, 9)
        if rnd.random() < 0.5:
            words[rnd.randrange(len(words))] = rnd.choice("abcde")
    return " ".join(words)


def test_many_periodic_texts():
    rnd = random.Random(4)
    texts = [periodic(rnd, rnd.randint(1, 120)) for _ in range(800)] + [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 80))) for _ in range(400)]
    want = [brute(t.split()) for t in texts]
    assert local(texts) == want
    assert sum(map(len, want)) > 1000


def test_every_short_text():
    texts = [" ".join("ab"[i >> k & 1] for k in range(11)) for i in range(2048)]
    assert local(texts) == [brute(t.split()) for t in texts]


@pytest.mark.parametrize("unit", [1, 2, 3, 7, 20])
def test_long_powers(unit):
    words = [f"w{i}" for i in range(unit)] * (4000 // unit)
    (found,) = local([" ".join(["x", *words, "y"])])
    assert found == [(1, len(words), unit)]


def test_fibonacci_and_thue_morse_words():
    fib, thue = ["a", "b"], "a"
    for _ in range(9):
        fib = [fib[-1], fib[-1] + fib[-2]] if len(fib) == 2 else fib
        thue += thue.translate(str.maketrans("ab", "ba"))
    texts = [" ".join(fib[-1]), " ".join(thue), " ".join(thue[:64] * 5)]
    assert local(texts) == [brute(t.split()) for t in texts]


def test_misleading_hashes(monkeypatch):
    """Hashes that always agree: the words decide."""
    monkeypatch.setattr(runs.Agreement, "_equal", lambda self, i, q, k: np.ones(len(i), bool))
    rnd = random.Random(5)
    texts = [periodic(rnd, 40) for _ in range(100)]
    assert local(texts) == [brute(t.split()) for t in texts]


def test_small_steps(monkeypatch):
    monkeypatch.setattr(runs, "STEP", 7)
    rnd = random.Random(6)
    texts = [periodic(rnd, 50) for _ in range(100)]
    assert local(texts) == [brute(t.split()) for t in texts]


def test_each_rule_is_worked_out_once():
    """A power of two words has as many rules as it has bits, not as many nodes as places."""
    words = np.tile(np.arange(2), 4096)
    grammar = runs.Grammar(words, np.zeros(len(words), np.int64))
    assert len(grammar.left) <= 14 and len(grammar.at) == len(words) - 1
    expanded = {k: words[a:b].tolist() for k, (a, b) in enumerate(zip(grammar.left, grammar.right, strict=True))}
    for k, place in zip(grammar.of.tolist(), grammar.at.tolist(), strict=True):
        assert words[place : place + len(expanded[k])].tolist() == expanded[k]


def contract(doc_id, text):
    words = WORD.findall((text or "").encode())
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(rest(words, found)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_and_odd_rows(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(i, periodic(rnd, 70) if i % 3 else " ".join(f"w{rnd.randint(0, 400)}" for _ in range(90)), "x") for i in range(150)]
    rows += [(1, "a a a a a a", "x"), (1, "a a a a a a", "x"), (1, "b\vb\tb\nb\rb b é é é é é é", "x"), (None, "q r " * 5, "x"), (None, None, "x"), (200, None, "x"), (201, "", "x"), (202, " \n ", "x"), (203, "é " * 30_000, None), (204, "a b " * 7, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    from tempora.llm.queries import queries

    got = sorted((tuple(r[c] for c in COLUMNS) for r in queries()["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    small = [r for r in got if r[0] != 203]
    assert small == sorted((contract(i, t) for i, t, _ in rows if i != 203), key=str)
    long = next(r for r in got if r[0] == 203)
    h = zlib.crc32(b"203")
    assert long[1:6] == (1, 0, 30_000, 1, 30_000_000) or h % 10 == 0
    assert runs.collapse(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_collapsed_text(spark):
    df = spark.createDataFrame([(1, "keep this no no no no no no and that", 5)], "doc_id long, text string, n_words int")
    (row,) = runs.collapse(df).collect()
    assert row["collapsed"] == "keep this no and that" and row["n_words"] == 10 and [tuple(r) for r in row["runs"]] == [(2, 6, 1)]


def test_query_on_tables(spark, small):
    from tempora.llm.queries import queries

    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries()["op13_periodic_runs"](spark, small).collect()}
    assert len(got) == len(table)
    short = [(i, t) for i, t in table if len(t or "") < 6000]
    assert [got[i] for i, _ in short] == [contract(i, t) for i, t in short]
    assert any(r[1] for r in got.values())
