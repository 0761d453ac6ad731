"""BPE and token counts against the tokenizers library."""

import hashlib
import random
import struct
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tempora.llm import bpe, token_counts  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "'s", "'re", "'", "'ll", " ", "  ", "\n", "\t", " ", "1", "²", "Ⅷ", "!", "?", "don't", "we'll've", "<|endoftext|>", "é", "ß", "中", "😀", "\x1c", "\x85", "　", "'v", "'t", "the", " THE", "\r\n", "_", "́", "x" * 60]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encoded(encoder, texts):
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, ends = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), at)
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


def test_random_texts(library):
    rnd, encoder = random.Random(1), bpe.Encoder(PATH)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(5000)]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert encoded(encoder, texts) == want


def test_every_code_point(library):
    texts = [f"a{chr(i)}b {chr(i)}{chr(i)} x" for i in range(1, 0x30000, 3) if not 0xD800 <= i < 0xE000]
    assert encoded(bpe.Encoder(PATH), texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_long_words_and_full_cache(library, monkeypatch):
    rnd = random.Random(2)
    texts = ["ab" * 3000, "x" * 21_000, "".join(rnd.choice("abcdefgh") for _ in range(22_000)), "é" * 500]
    assert encoded(bpe.Encoder(PATH), texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    encoder = bpe.Encoder(PATH)
    for text in ("one two three four", "two five", "six one two"):
        assert encoded(encoder, [text]) == [library.encode(text, add_special_tokens=False).ids]


ROWS = [(1, "Hello, wörld's 123\n\n ok <|endoftext|>x"), (1, "Hello, wörld's 123\n\n ok <|endoftext|>x"), (1, "other"), (None, "no id"), (2, None), (3, ""), (4, "a " * 3000)]


def test_round_trip_rows(spark, library):
    df = spark.createDataFrame([(i, t, "extra") for i, t in ROWS], "doc_id long, text string, n_tokens string")
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(df, PATH).collect()), key=str)
    want = []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
    arrays = bpe.decode(bpe.encode(df.select("doc_id", "text"), PATH), PATH).collect()
    assert sorted((r["decoded"] for r in arrays), key=str) == sorted((t or "" for _, t in ROWS), key=str)


@pytest.mark.parametrize("head", [400_000, 2, 0])
def test_counts(spark, library, head):
    df = spark.createDataFrame([(i, t, 7) for i, t in ROWS], "doc_id long, text string, piece int")
    got = sorted(map(tuple, token_counts.token_counts(df, PATH, head=head).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in ROWS]
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(df.limit(0), PATH, head=head).count() == 0


def test_copies_share_no_join_key(spark, library):
    texts = [""] * 500 + ["qzxv wkjq"] * 500
    head = token_counts.Head(pa.table({"piece": pa.array([], pa.binary()), "pieces": pa.array([], pa.int64())}))
    batch = pa.record_batch({"doc_id": pa.array(range(1000)), "text": texts})
    rows = pa.Table.from_batches(token_counts._frequencies(PATH, SimpleNamespace(value=head))(iter([batch]))).to_pylist()
    own = [r["piece"] for r in rows if r["n_bytes"] is not None]
    assert len(own) == len(set(own)) == 1000 and not set(own) & {r["piece"] for r in rows if r["n_bytes"] is None}
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(3)
    got = Counter(r["n_tokens"] for r in token_counts.token_counts(df, PATH, head=0).collect())
    assert got == {0: 500, len(library.encode("qzxv wkjq", add_special_tokens=False).ids): 500}


def test_query_on_tables(spark, small, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in token_counts.op4_token_counts(spark, small).collect():
        assert r["n_tokens"] == len(library.encode(docs[r["doc_id"]], add_special_tokens=False).ids)


def alternating(n):
    """a and b in Thue-Morse order, and with a and b exchanged: their polynomial hashes modulo a power of two are equal."""
    x = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_words_that_simple_hashes_mistake(spark, library):
    x, y = alternating(4096)
    texts = [f"{x[:2048]} {y[:2048]}", f"{y[:2048]} {x[:2048]}", f"{x} {y}", y]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for r in bpe.round_trip(df, PATH).collect():
        ids = want[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    for head in (400_000, 0):
        assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, PATH, head=head).collect()} == {i: len(ids) for i, ids in enumerate(want)}


@pytest.mark.parametrize("kinds", [1, 7])
def test_equal_hashes_of_different_words(library, monkeypatch, kinds):

    weak = lambda sums, start, end: ((end - start) % kinds).astype(np.uint64)
    monkeypatch.setattr(bpe, "range_hash", weak)
    monkeypatch.setattr(token_counts, "range_hash", weak)
    encoder, texts = bpe.Encoder(PATH), ["one two three two one", "four one five six two", "two" * 20, "one two"]
    for part in (texts[:2], texts[1:], texts):
        assert encoded(encoder, part) == [x.ids for x in library.encode_batch(part, add_special_tokens=False)]
    found = pa.Table.from_batches(token_counts._distinct(PATH)(iter([pa.record_batch({"text": texts})])))
    words = {}
    for t in texts:
        for w, _ in library.pre_tokenizer.pre_tokenize_str(t):
            words[w] = words.get(w, 0) + 1
    assert dict(zip(found["piece"].to_pylist(), found["total"].to_pylist(), strict=True)) == {w.replace("Ġ", " ").encode(): n for w, n in words.items()}
    pieces = [b"aa", b"bb", b"c"]
    head = token_counts.Head(pa.table({"piece": pa.array(pieces, pa.binary()), "pieces": [1, 2, 3]}))
    data = np.frombuffer(b"aabbccc", np.uint8)
    found, n = head.find(weak(None, np.array([0, 2, 4, 6]), np.array([2, 4, 6, 7])), data, np.array([0, 2, 4, 6]), np.array([2, 2, 2, 1]))
    assert all(not f or (k < 3 and p == k + 1) for k, (f, p) in zip((0, 1, 5, 2), zip(found, n, strict=True), strict=True)) and not found[2]


def test_other_tokenizers_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    assert bpe.special_token(file) == (b"<|endoftext|>", 50256)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [*file["added_tokens"], {"content": "<x>", "id": 7}]}, {"added_tokens": [file["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.special_token(file | change)


def test_round_trip_on_tables(spark, small, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op10_bpe_round_trip(spark, small).collect()}
    want = {}
    for i, t in docs.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert got == want
