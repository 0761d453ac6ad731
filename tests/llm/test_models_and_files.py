"""Language, quality, packing, archives and the pipeline."""

import base64
import functools
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tempora.llm import common, lang_cnn, packing, quality_em, queries, warc

duckdb = pytest.importorskip("duckdb")


def test_language_accuracy(spark, small):
    sf = small.replace("0.001", "0.01")
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = lang_cnn.op6_language_id(spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(known) and 0.2 < len(held) / len(rows) < 0.3
    assert np.mean([r["lang_pred"] == known[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def brute_language(net, text):
    """Mean probabilities over the text's windows by loops over places and filters."""
    raw = bytearray(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    for k in range(1, len(raw)):
        if text.encode()[k - 1] == 0xC3 and 0x80 <= text.encode()[k] <= 0x9E:
            raw[k] += 32
    out = []
    for low in range(0, len(raw), lang_cnn.WINDOW):
        w = bytes(raw[low : low + lang_cnn.WINDOW]).ljust(lang_cnn.WINDOW, b"\0")
        hidden = []
        for table, bias in zip(net.tables, net.biases, strict=True):
            for f in range(lang_cnn.FILTERS):
                hidden.append(max(0.0, max(sum(float(table[k, w[i + k], f]) for k in range(len(table))) for i in range(len(w) - len(table) + 1)) + float(bias[f])))
        z = [sum(h * float(net.dense[j, c]) for j, h in enumerate(hidden)) + float(net.dense_bias[c]) for c in range(len(net.langs))]
        e = [math.exp(v - max(z)) for v in z]
        out.append([v / sum(e) for v in e])
    return np.mean(out, axis=0) if out else None


def test_language_by_hand(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    net = lang_cnn.learn(docs)
    texts = ["the of and thing", "Die der und einer ÜBER " * 30, "é", "xyz " * 90, "", "123", *(r["text"] for r in docs.where("n_chars < 600").orderBy("doc_id").limit(12).collect())]
    got = {r["doc_id"]: r for r in lang_cnn.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    for i, t in enumerate(texts):
        mean = brute_language(net, t)
        if mean is None or not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
        else:
            assert got[i]["lang_pred"] == net.langs[int(mean.argmax())] and got[i]["score"] == pytest.approx(float(mean.max()), abs=1e-4)


def test_language_ties_go_to_the_first(spark):
    shape = (lang_cnn.FILTERS * len(lang_cnn.WIDTHS), 2)
    net = lang_cnn.Network(["aa", "bb"], [np.zeros((w, 256, lang_cnn.FILTERS), np.float32) for w in lang_cnn.WIDTHS], [np.zeros(lang_cnn.FILTERS, np.float32) for _ in lang_cnn.WIDTHS], np.zeros(shape, np.float32), np.zeros(2, np.float32))
    row = lang_cnn.predict(spark.createDataFrame([(1, "text")], "doc_id long, text string"), net).first()
    assert (row["lang_pred"], row["score"]) == ("aa", 0.5)


def test_language_rows(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    net = lang_cnn.learn(docs)
    df = spark.createDataFrame([(1, None, "x"), (None, "the of and thing", "x"), (2, "", "x"), (3, "123 !!", "x"), (4, "die der und enschlich zu einer " * 2000, "x"), (4, "die der und enschlich zu einer " * 2000, "x")], "doc_id long, text string, score string")
    got = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in lang_cnn.predict(df, net, carry=("score",)).collect())
    assert got == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de")]
    assert lang_cnn.learn(docs.limit(0)) is None
    assert {r["lang_pred"] for r in lang_cnn.predict(df, None).collect()} == {"und"}
    assert lang_cnn.predict(df.limit(0), net).count() == 0


def test_windows_cover_texts():
    data = np.frombuffer(b"a" * 300 + b"b", np.uint8)
    x, n = lang_cnn.windows(data, np.array([0, 300, 300, 301]))
    assert n.tolist() == [3, 0, 1] and (x > 0).sum() == 301


def test_quality_on_labels(spark, small):
    sf = small.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    keep = {r["doc_id"]: r["keep"] for r in quality_em.op9_weak_quality(spark, sf).collect()}
    assert np.mean([keep[i] for i, q in labels.items() if q == 1]) > 0.98
    assert np.mean([keep[i] for i, q in labels.items() if q == 0]) < 0.15


def brute_measures(text):
    """The labellers' measures of a text, one byte and one word at a time."""
    raw = text.encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    is_sign = lambda b: not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128 or 48 <= b <= 57 or b == 32 or 9 <= b <= 13 or b in b".,;:'\"()-?")
    size, n = max(1, sum(1 for b in raw if b != 32 and not 9 <= b <= 13)), max(1, len(w))
    upper, lower = sum(1 for b in raw if 65 <= b <= 90), sum(1 for b in raw if 97 <= b <= 122 or b >= 128)
    return len(w), [
        sum(map(is_sign, raw)) / size, upper / max(1, upper + lower), sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, raw.count(b"|") / n, raw.count(b"!") / n,
        sum(1 for b in raw if 48 <= b <= 57) / size, size / n, 1 - len(set(w)) / n, sum(any(map(is_sign, raw[a:b])) for a, b in spans) / n,
        sum(not any(97 <= x <= 122 or x >= 128 for x in raw[a:b]) for a, b in spans) / n, max(map(w.count, w), default=0) / n,
    ]


def test_quality_on_tables_by_hand(spark, small, monkeypatch):
    """Votes, posteriors and scores of all documents against loops over words; only the learnt weights are taken as they are."""
    fit, kept = quality_em.fit_scorer, []
    monkeypatch.setattr(quality_em, "fit_scorer", lambda rows: kept.append(fit(rows)) or kept[0])
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in quality_em.op9_weak_quality(spark, small).collect()}
    patterns = {}
    for i, t in docs.items():
        n, found = brute_measures(t)
        votes = [0 if n < least else 2 if x <= good else 1 if x >= bad else 0 for x, (_, good, bad, least) in zip(found, quality_em.LABELLERS, strict=True)]
        patterns[i] = sum(v * 3**k for k, v in enumerate(votes))
        assert got[i]["votes"] == patterns[i]
    # Expectation-maximisation by loops.
    counts = {}
    for p in patterns.values():
        counts[p] = counts.get(p, 0) + 1
    cast = {p: [p // 3**k % 3 for k in range(len(quality_em.LABELLERS))] for p in counts}
    posterior = {p: min(0.95, max(0.05, 0.95 - 0.6 * v.count(1))) if any(v) else 0.5 for p, v in cast.items()}
    for _ in range(200):
        share = (sum(counts[p] * posterior[p] for p in counts) + 1) / (len(docs) + 2)
        new = {}
        rate = []
        for k in range(len(quality_em.LABELLERS)):
            seen = [[0.5 + sum(counts[p] * (posterior[p] if c else 1 - posterior[p]) for p in counts if cast[p][k] == v) for v in (1, 2)] for c in (0, 1)]
            rate.append([[1, *(x / sum(row) for x in row)] for row in seen])
        for p in counts:
            both = [(share if c else 1 - share) * math.prod(rate[k][c][cast[p][k]] for k in range(len(rate))) for c in (0, 1)]
            new[p] = both[1] / sum(both)
        done = max(abs(new[p] - posterior[p]) for p in counts) < 1e-9
        if done:
            break
        posterior = new
    weight = kept[0]
    for i, t in docs.items():
        assert got[i]["label"] == pytest.approx(posterior[patterns[i]] if t.split() else 0, abs=1e-6)
        data = np.frombuffer(t.encode(), np.uint8)
        found = quality_em.features(data, np.array([0, len(data)]), *quality_em.words(data, np.array([0, len(data)])))
        mean = sum(weight[b] for row in found.tolist() for b in row) / max(1, found.size)
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-mean - weight[-1])) if len(found) else 0, abs=1e-9) and got[i]["keep"] == (got[i]["score"] >= 0.5)


def test_quality_of_one_kind_or_without_votes(spark):
    for texts in (["one two"] * 5 + ["3 4"], [f"plain words of text number {'abcdefgh'[i]}" for i in range(8)], ["$$ ## !! || 99"] * 4):
        df = spark.createDataFrame([(i, t, "l", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, label string, score double")
        rows = quality_em.classify(df, carry=("label", "score")).collect()
        assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and 0 <= r["label"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if texts[r["doc_id"]] == texts[0]}) == 1


def test_samples_hold_whole_texts_in_bounded_size(spark):
    """Rows in the order of their numbers as long as they fit; one that is too long is passed over, copies count once."""
    rows = [(k, "x" * size) for k, size in enumerate([10, 50, 7, 900, 3, 3, 20])] + [(2, "y" * 7)]
    df = spark.createDataFrame(rows, "k long, text string")
    taken = lambda **kw: sorted((r["k"], len(r["text"])) for r in common.whole_sample(df, F.col("k"), **kw).collect())
    assert taken(rows=100, size=77) == [(0, 10), (1, 50), (2, 7), (2, 7), (4, 3)]
    assert taken(rows=3, size=10_000) == [(0, 10), (1, 50), (2, 7), (2, 7)]
    copies = spark.createDataFrame([(f"text {k % 3}",) for k in range(900)] + [("z" * 500,)], "text string")
    assert sorted(r["text"] for r in common.whole_sample(copies, F.xxhash64("text"), 100, 100, once=True).collect()) == ["text 0", "text 1", "text 2"]


def test_quality_rows(spark):
    df = spark.createDataFrame([(1, None), (None, "some plain words here"), (2, ""), (3, "A! " * 9000), (3, "A! " * 9000)], "doc_id long, text string")
    rows = quality_em.classify(df).collect()
    assert len(rows) == 5 and not any(r["keep"] for r in rows if r["doc_id"] in (1, 2))
    assert quality_em.classify(df.limit(0)).count() == 0


def test_quality_learns_from_distinct_texts_beside_many_copies(spark, monkeypatch):
    fit, sizes = quality_em.fit_scorer, []
    monkeypatch.setattr(quality_em, "fit_scorer", lambda rows: sizes.append(len(rows)) or fit(rows))
    texts = [f"some plain words and number {i}" for i in range(200)] + ["the same words each time"] * 20_000
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert quality_em.classify(df, docs=50).count() == len(texts)
    assert 25 <= sizes[0] <= 100


def test_quality_without_a_sample(spark):
    texts = spark.createDataFrame([(i, f"some plain words and number {i}" if i % 2 else f"A{i}! | $$ || ## !!") for i in range(80)], "doc_id long, text string")
    rows = quality_em.classify(texts, docs=0).collect()
    assert len(rows) == 80 and all(r["score"] == r["label"] and r["keep"] == (r["label"] >= 0.5) for r in rows)
    assert {r["keep"] for r in rows} == {True, False}


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(0)
    k, n = len(quality_em.LABELLERS), 40_000
    good, right = rng.random(n) < 0.8, rng.uniform(0.75, 0.95, k)
    vote = np.where(rng.random((n, k)) < right, good[:, None], ~good[:, None]) + 1
    vote[rng.random((n, k)) < 0.3] = 0
    patterns, inverse, counts = np.unique(vote @ 3 ** np.arange(k), return_inverse=True, return_counts=True)
    posterior, rates, share = quality_em.expectation_maximisation(patterns, counts.astype(float))
    assert share == pytest.approx(0.8, abs=0.02) and rates[:, 1, 2] == pytest.approx(right, abs=0.03)
    assert np.mean((posterior[inverse] > 0.5) == good) > 0.97


@functools.lru_cache
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def tokens(texts):
    return [library().encode(t, add_special_tokens=False).ids for t in texts]


def brute_pack(pieces, capacities=packing.CAPACITIES):
    """(id, piece, length) of a shard -> bin, place and capacity of each, in plain loops over lists."""
    left = sorted((p for p in pieces if p[2]), key=lambda p: (-p[2], p[0], p[1]))
    lengths, bins = [p[2] for p in left], []  # bins: capacity, contents
    while left:
        p = left.pop(0)
        lengths.remove(p[2])
        open_ = [b for b in bins if b[0] - sum(q[2] for q in b[1]) >= p[2]]
        if open_:
            best = min(open_, key=lambda b: b[0] - sum(q[2] for q in b[1]))
        else:
            waste = {}
            for c in capacities:
                if c >= p[2]:
                    room = c - p[2]
                    for n in sorted(lengths, reverse=True):
                        room -= n if n <= room else 0
                    waste[c] = round(room / c, 6)
            best = [min(waste, key=lambda c: (waste[c], c)), []]
            bins.append(best)
        best[1].append(p)
    out = {}
    for k, (_, content) in enumerate(bins):
        size = min(c for c in capacities if c >= sum(q[2] for q in content))
        for at, q in enumerate(content):
            out[q[:2]] = (k, sum(x[2] for x in content[:at]), size)
    return out


def test_packing(spark, small):
    rows = packing.op3_best_fit_packing(spark, small).toPandas()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert rows.groupby("doc_id").length.sum().to_dict() == {i: len(t) for i, t in zip(docs, tokens(docs.values()), strict=True)}
    assert rows.shard.nunique() == 1
    want = brute_pack(list(rows[["doc_id", "piece", "length"]].itertuples(index=False, name=None)))
    some = rows[rows.length > 0]
    assert {(r.doc_id, r.piece): (r.bin, r.place, r.capacity) for r in some.itertuples()} == want
    bins = rows.groupby(["shard", "bin"]).agg(used=("length", "sum"), size=("capacity", "first"))
    assert (bins.used <= bins["size"]).all() and bins.used.sum() / bins["size"].sum() > 0.9


def test_sequences(spark, small):
    import public_tokenizers

    odd = spark.createDataFrame([(None, "no id here " * 700, 1), (7_000_001, None, 1), (7_000_002, "", 1), (7_000_003, "漢字" * 4000, 1), (7_000_003, "漢字" * 4000, 1)], "doc_id long, text string, ids int")
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(odd.drop("ids"))
    docs = {}
    for r in df.collect():
        docs.setdefault(r["doc_id"], []).append(r["text"] or "")
    for shard_pieces in (4000, 60):
        got, rows = {}, packing.sequences(df, public_tokenizers.path("byte_bpe_50k.json"), shard_pieces=shard_pieces).collect()
        for r in rows:
            assert len(r["ids"]) <= r["capacity"] and r["places"][0] == 0 and r["capacity"] == min(c for c in packing.CAPACITIES if c >= len(r["ids"]))
            for i, p, a, b in zip(r["doc_ids"], r["pieces"], r["places"], [*r["places"][1:], len(r["ids"])], strict=True):
                got.setdefault((i, p), []).append(r["ids"][a:b])
        whole = {}
        for i, p in sorted(got, key=lambda k: k[1]):
            for k, ids in enumerate(got[i, p]):
                whole.setdefault((i, k), []).extend(ids)
        assert whole == {(i, k): ids for i, texts in docs.items() for k, ids in enumerate(tokens(texts)) if ids}
    assert packing.sequences(odd.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_packing_rows(spark):
    df = spark.createDataFrame([(1, None), (None, 5), (2, 0), (2, 10_000), (3, 4096), (3, 4096)], "doc_id long, length int").selectExpr("*", "1 AS n", "2 AS copies", "3 AS shard", "4 AS copy")
    rows = packing.best_fit(df).collect()
    assert sorted((r["doc_id"] or 0, r["piece"], r["length"]) for r in rows) == [(0, 0, 5), (1, 0, 0), (2, 0, 0), (2, 0, 4096), (2, 1, 4096), (2, 2, 1808), (3, 0, 4096), (3, 0, 4096)]
    assert packing.best_fit(df.limit(0)).count() == 0


def test_packing_ties_go_by_id(spark):
    df = spark.createDataFrame([(i, 300) for i in (5, 3, None, 9, 1)] + [(2, -7), (4, None)], "doc_id long, length int")
    placed = {r["doc_id"]: (r["bin"], r["place"], r["length"]) for r in packing.best_fit(df, capacities=(700,)).collect()}
    assert placed == {1: (0, 0, 300), 3: (0, 300, 300), 5: (1, 0, 300), 9: (1, 300, 300), None: (2, 0, 300), 2: (0, 0, 0), 4: (0, 0, 0)}


def test_packing_deals_repeated_rows_to_many_shards(spark):
    df = spark.range(1200).selectExpr("cast(null as bigint) AS doc_id", "if(id < 900, 0, 5000) AS length")
    rows = packing.best_fit(df, shard_pieces=100).toPandas()
    assert len(rows) == 900 + 2 * 300 and rows.length.sum() == 300 * 5000
    assert rows.shard.nunique() == 15 and rows.groupby("shard").size().max() < 200
    assert (rows.groupby(["shard", "bin"]).length.sum() <= rows.groupby(["shard", "bin"]).capacity.first()).all()


def test_best_fit_chooses_the_cheapest_bin():
    bins, place, size = packing.pack(np.array([600, 420, 400, 112]), (512, 1024))
    assert bins.tolist() == [0, 0, 1, 1] and place.tolist() == [0, 600, 0, 400] and size.tolist() == [1024, 512]


def test_archives_on_tables(spark, small):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    columns = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = sorted(db.sql(f"SELECT {columns} FROM ({queries.oracle_sql()['op7_arc_to_warc']})").fetchall(), key=str)
    got = sorted(map(tuple, warc.op7_arc_to_warc(spark, small).select(*columns.split(", ")).collect()), key=str)
    assert got == want


def test_archive_rows(spark, tmp_path):
    text = "WARC/1.1\r\n\r\n a\r\n\r\n"
    rows = [(3, "u\nx", text), (1, None, text), (None, "q", None), (5, "z", ""), (5, "z", ""), (7, "é", "é\n"), (9, "long", "x" * 300_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha1 int")
    got = warc.archive(df, f"file://{tmp_path}/w").collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got) == sorted([(3, "revisit", 1), (1, "response", None), (0, "revisit", 5), (5, "response", None), (5, "revisit", 5), (7, "response", None), (9, "response", None)], key=lambda x: (x[0], x[1]))
    assert {r["payload"] for r in got if r["page_id"] == 1} == {text}
    digest = base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
    assert {r["payload_digest"] for r in got if r["page_id"] in (1, 3)} == {digest}
    assert warc.archive(df.limit(0), f"file://{tmp_path}/v").count() == 0
    kept = warc.archive(df, f"file://{tmp_path}/u", least_bytes=1).where("payload_bytes = 0").collect()
    assert {r["record_type"] for r in kept} == {"response"}


def test_archives_are_bounded_and_odd_urls_survive(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rows = [(i, f"http://h/{i}\u3000a\u2028b\x85c\td", "x" * 900 + str(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive(df, f"file://{tmp_path}/w").collect()
    assert {(r["page_id"], r["uri"], r["payload"]) for r in got} == {(i, f"http://h/{i}%20a%20b%20c%20d", t) for i, _, t in rows}
    files = list(tmp_path.glob("w/*.gz"))
    assert len(files) >= 8 and max(len(__import__("gzip").decompress(f.read_bytes())) for f in files) < 60_000


@pytest.mark.parametrize("version", [1, 2])
def test_arc(version):
    records = [("http://a/", "20200102030405", b"x\ny 5\n"), ("-", "20200102030406", b""), ("http://b/", "20200102030407", "é".encode())]
    raw = warc.write_arc(records, version)
    assert [(h["url"], h["date"], p) for h, p in warc.read_arc(raw)] == records
    with pytest.raises(ValueError):
        list(warc.read_arc(raw[:-3]))


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before, columns = docs.count(), set(docs.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, small))
        assert set(docs.columns) == columns
        assert docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {i for r in packed for i in r["doc_ids"]} == {r["doc_id"] for r in docs.collect() if r["text"]}
    assert sum(len(r["ids"]) for r in corpus_pipeline.run(spark, small).collect()) == sum(len(r["ids"]) for r in packed)


def test_pipeline_cuts_repeats_between_characters(spark):
    passage = "A passage of which every word stands in several documents, é漢😀 included, and more. "
    rows = [(1, f"one {passage}"), (2, f"own words \ufffd kept {passage}end \ufffd"), (3, "é" * 60), (4, "xé" + "é" * 60), (None, passage), (5, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, removed int")
    out = {r["doc_id"]: r for r in corpus_pipeline.repeats(spark, df, "").collect()}
    assert out[1]["text"] == rows[0][1] and out[3]["text"] == rows[2][1] and out[None]["text"] == passage and out[4]["text"] == "x" and not out[5]["text"]
    assert out[2]["text"].startswith("own words \ufffd kept") and out[2]["text"].endswith("end \ufffd") and len(out[2]["text"]) < 35
    assert all(r["n_chars"] == len(r["text"] or "") for r in out.values())


def test_pipeline_stages_by_hand(spark, small):
    """What each stage keeps of the tables' documents, from the operators' contracts."""
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeats(spark, docs, small).collect()}
    first = {}
    raw = {i: t.encode() for i, t in texts.items()}
    for i, b in sorted(raw.items()):
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    for i, b in raw.items():
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        at, want = 0, []
        for c in texts[i]:
            size = len(c.encode())
            if not any(gone[at : at + size]):
                want.append(c)
            at += size
        assert cut[i] == "".join(want)
    near = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, small).collect()}
    words = {i: (t.translate({k: k + 32 for k in range(65, 91)}).split()) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    kept = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = i, j
                while kept[a] != a:
                    a = kept[a]
                while kept[b] != b:
                    b = kept[b]
                kept[max(a, b)] = min(a, b)
    assert near == {i for i, k in kept.items() if k == i}
    good = {r["doc_id"] for r in quality_em.classify(docs).where("keep").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, small).collect()} == good
    told = lang_cnn.predict(docs, lang_cnn.learn(docs)).where("lang_pred <> 'und' AND score >= 0.5")
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, small).collect()} == {r["doc_id"] for r in told.collect()}


def test_pipeline_packs_tokens(spark):
    """Each text's tokens come back, piece by piece, from the bins that hold them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["plain words, and signs: #1!", "x7Qz/" * 4000, "漢字" * 3000, "", "plain words, and signs: #1!"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {}
    for r in corpus_pipeline.packed(spark, df, "").collect():
        assert len(r["ids"]) <= r["capacity"]
        for i, piece, a, b in zip(r["doc_ids"], r["pieces"], r["places"], [*r["places"][1:], len(r["ids"])], strict=True):
            got[i, piece] = r["ids"][a:b]
    assert max(p for i, p in got if i == 1) > 0 and max(map(len, got.values())) <= 4096
    for i, t in enumerate(texts):
        assert [x for k in sorted(got) if k[0] == i for x in got[k]] == tokenizer.encode(t, add_special_tokens=False).ids


def test_pipeline_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "word " * 30, "en", "s", 1), (2, "", "en", "s", 0), (3, "plain words of a text " * 400, "en", "s", 5), (3, "plain words of a text " * 400, "en", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for data in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, data, "").count() <= 5
