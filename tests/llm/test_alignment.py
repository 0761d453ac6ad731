"""Token alignment against a plain loop over the libraries' tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tempora.llm import alignment  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "the ", " of", "don't", "  ", "\n", "\t", " ", "12", "3", "²", "!", "...", "é", "ß", "中文", "😀", "\r\n", "_", "́", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "x" * 30, "Straße", "▁", "　", "\x00", "antidisestablishment", "ab" * 20]


def libraries():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    signs = {s: i for s, i in alignment.bpe._byte_signs().items()}
    of_a = {i: bytes(signs[c] for c in p) for p, i in a.get_vocab().items() if all(c in signs for c in p)}
    of_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    return a, b, of_a, of_b


def brute(texts):
    """The contract's columns after doc_id, text by text."""
    a_lib, b_lib, of_a, of_b = libraries()
    out, held = [], []
    for text in texts:
        want = b" " + (text or "").encode()
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        if not text or b"".join(of_a[i] for i in a) != want or b"".join(of_b[i] for i in b) != want:
            out.append((0, 0, 0, 0, {}, ""))
            held.append(Counter())
            continue
        ends_a, ends_b = np.cumsum([len(of_a[i]) for i in a]), np.cumsum([len(of_b[i]) for i in b])
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            p, q = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.append(links)
        written = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((len(a), len(b), len(groups), sum(links.values()), links, hashlib.sha256(written.encode()).hexdigest()))
    counts = Counter(p for links in held for p in links)
    top = Counter()
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return [(n_a, n_b, g, n, sum(m for p, m in links.items() if counts[p] == top[p[0]]), sum(m * counts[p] for p, m in links.items()), sha) for n_a, n_b, g, n, links, sha in out] if texts else []


def rows(df):
    return sorted(((r["doc_id"], *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in alignment.align(df, A, B).collect()), key=str)


def random_texts(n, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def held(spark, table, columns="doc_id long, text string"):
    got = rows(spark.createDataFrame(table, columns))
    want = sorted(((r[0], *w) for r, w in zip(table, brute([r[1] for r in table]), strict=True)), key=str)
    assert got == want


def test_random_texts(spark):
    held(spark, list(enumerate(random_texts(1500))))


@pytest.mark.parametrize("small", ["runs", "frames", "cache"])
def test_many_runs_frames_and_a_full_cache(spark, monkeypatch, small):
    """The limits of runs, documents, frames, steps and the cache change nothing. Workers fork after this, so they see the limits."""
    limits = {"runs": {"RUN_BYTES": 300, "RUN_DOCS": 3}, "frames": {"FRAME": 3, "STEP": 5, "RUN_RECORDS": 50}, "cache": {"CACHE_WORDS": 20, "CACHE_BYTES": 200}}[small]
    for k, v in limits.items():
        monkeypatch.setattr(alignment, k, v)
    monkeypatch.setattr("tempora.llm.common.SLICE_BYTES", 100)
    texts = random_texts(60, 5)
    got = local(texts)
    assert got == brute(texts)


def local(texts):
    """The three steps called one after another in this process."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    spilled = pa.Table.from_batches(list(alignment._spill(A, B, 8)(iter([batch.slice(i, 7) for i in range(0, len(texts), 7)])))).to_pylist()
    blocks = sorted((r["part"], r["run"], r["head"]) for r in spilled if r["part"] is not None)
    kinds = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("head", pa.binary())])
    counted = pa.Table.from_batches(list(alignment._merge(iter([pa.RecordBatch.from_pylist([dict(zip(kinds.names, b, strict=True)) for b in blocks], kinds)])))).to_pylist()
    tops = np.zeros(60_000, np.int64)
    for r in counted:
        for a, t in zip(r["a"] or [], r["top"] or [], strict=True):
            tops[a] = max(tops[a], t)
    kinds = pa.schema([("doc_id", pa.int64()), ("run", pa.int64()), ("part", pa.int32()), ("head", pa.binary()), ("body", pa.binary()), ("idx", pa.int32()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("counts", pa.binary())])
    both = [{c: r.get(c) for c in kinds.names} for r in [*spilled, *(r for r in counted if r["run"] is not None)]]
    both.sort(key=lambda r: (r["run"], r["part"] is None, r["part"] or 0))
    value = type("Held", (), {"value": tops})
    out = [r for b in alignment._contributions(value)(iter([pa.RecordBatch.from_pylist(both[i : i + 11], kinds) for i in range(0, len(both), 11)])) for r in b.to_pylist()]
    return [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in sorted(out, key=lambda r: r["doc_id"])]


def test_odd_rows(spark):
    table = [(1, "the same", "x"), (1, "the same", "y"), (1, "another", "x"), (None, "no id", "x"), (None, "no id", "x"), (2, None, "x"), (3, "", "x"), (4, "▁ lost", "x"), (5, "a " * 40_000 + "é" * 500, "x"), (6, "z" * 3000, None)]
    held(spark, table, "doc_id long, text string, n_a string")
    assert rows(spark.createDataFrame([], "doc_id long, text string")) == []


def test_stretches_are_short(spark):
    """Plain prose is cut at its words, so that stretches can be remembered."""
    aligner = alignment.Aligner(A, B)
    text = b" The quick brown fox. Jumps over\nthe dog"
    word, at = aligner.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(word) > 8 and at.tolist() == [0, len(word)]


def test_query(spark, small):
    from tempora.llm.queries import queries

    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in queries()["op11_token_alignment"](spark, small).collect()), key=str)
    assert got == sorted(((r[0], *w) for r, w in zip(table, brute([r[1] for r in table]), strict=True)), key=str)
