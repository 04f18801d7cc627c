"""The text operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from flarespan.llm import exact_dedup, licenses, media, mixing, near_dedup, quality, repeats, secrets, sentencepiece_bpe, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").persist()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    long = "word " * 30_000
    rows = [(1, None), (2, ""), (3, long), (4, long), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (None, "x y"), (7, " \n ")]
    return spark.createDataFrame([(i, t, "en", "src0", 1, 2, "s", 3) for i, t in rows], "doc_id long, text string, lang string, source string, score int, n int, _raw string, kept int")


OPERATORS = {
    1: licenses.licenses, 2: lambda d: media.media_features(media.stored_media(d)), 3: repeats.without_repeats, 6: exact_dedup.exact_groups,
    7: mixing.mix_documents, 8: secrets.found_secrets, 9: lambda d: sentencepiece_bpe.round_trip(d, MODEL), 10: near_dedup.near_groups,
}


@pytest.mark.parametrize("n", sorted(OPERATORS))
def test_odd_and_empty_tables(odd, n):
    out = OPERATORS[n](odd)
    assert out.count() == (0 if n == 1 else 8)
    assert OPERATORS[n](odd.where("false")).count() == 0


def test_scores_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, labels).where("score BETWEEN 0 AND 1").count() == 8
    assert quality.quality(odd, labels).count() == 8
    assert toxicity.toxicity(odd, labels.where("false")).count() == 8


@pytest.mark.parametrize("n, fn", [(6, "op6_exact_dedup"), (7, "op7_mixing"), (1, "op1_license_scan")])
def test_equals_sql(spark, n, fn):
    from flarespan.llm import queries

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    a, b = queries.QUERIES[fn](spark, SF).toPandas(), c.sql(queries.SQL[fn]).df()
    keys = sorted(a.columns)
    assert sorted(map(tuple, a[keys].astype(str).to_numpy().tolist())) == sorted(map(tuple, b[keys].astype(str).to_numpy().tolist()))


def test_short_license_lines_are_found(spark):
    texts = ["x. All rights\n reserved. y", "ALL RIGHTS RESERVED", "overall rights reserved", "all the rights reserved", None, ""]
    d = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[1])], "doc_id long, text string")
    found = [(r.doc_id, r.template, r.n_found, r.n_shingles, r.containment) for r in licenses.licenses(d).collect()]
    assert sorted(found, key=str) == [(i, "rights-line", 1, 1, 1.0) for i in (0, 1, None)]
    with pytest.raises(ValueError):
        licenses.licenses(d, {"none": "..."})


def covered_by(texts, length, apart):
    """For each text which symbols lie in strings of ``length`` that start anywhere else (``apart``: in another text)."""
    seen = collections.defaultdict(set)
    for i, x in enumerate(texts):
        for p in range(len(x) - length + 1):
            seen[x[p : p + length]].add(i if apart else (i, p))
    out = []
    for x in texts:
        edge = np.zeros(len(x) + 1, int)
        for p in range(len(x) - length + 1):
            if len(seen[x[p : p + length]]) > 1:
                edge[p] += 1
                edge[p + length] -= 1
        out.append(np.cumsum(edge[:-1]) > 0)
    return out


def check_repeats(rows, got):
    raw = [(t or "").encode() for _, t in rows]
    gone, words = covered_by(raw, 400, False), covered_by([tuple(x.split()) for x in raw], 51, True)
    for (i, _), x, g, w in zip(rows, raw, gone, words, strict=True):
        kept = np.frombuffer(x, np.uint8)[~g].tobytes()
        spans = int((np.diff(np.r_[0, g.astype(int)]) == 1).sum())
        want = (len(x), int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), int(w.sum()))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256, got[i].passage_words) == want
        assert "kept" not in got[i] or bytes(got[i].kept) == kept


def test_op3_query_equals_brute_force(spark, docs):
    from flarespan.llm import queries

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_repeats(rows, {r.doc_id: r for r in queries.op3_suffix_array_dedup(spark, SF).collect()})


def test_repeats_in_pieces_batches_and_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(1, 9)))
    shared = [[word() for _ in range(n)] for n in (51, 70, 140)]
    rows = [(0, None), (1, ""), (2, "x" * 399), (3, "x" * 401), (4, "ab" * 900)]
    for i in range(5, 60):
        parts = [[word() for _ in range(rng.randint(0, 60))]]
        for s in rng.sample(shared, rng.randint(0, 3)):
            parts += [s, [word() for _ in range(rng.randint(0, 40))]]
        rows.append((i, " ".join(w for p in parts for w in p)))
    rows += [(60, rows[20][1]), (61, rows[20][1])]
    index = repeats.index
    monkeypatch.setattr(repeats, "index", lambda d, unit, batches=None: index(d, unit, 6))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.without_repeats(d, True, repeats.Unit(400, 200, 16, 300), repeats.Words(51, 26, 4, 60))
    check_repeats(rows, {r.doc_id: r for r in got.collect()})


def brute_near(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_exact_dedup_keeps_every_text_once_where_ids_repeat(spark):
    for ids in ((None, None), (5, 5)):
        rows = [(ids[0], "A", 1), (ids[1], "B", 2), (9, "A", 3), (9, "A", 4), (5, None, 5), (None, "", 6), (7, "C", 7), (7, "D", 8)]
        for order in (rows, rows[::-1]):
            d = spark.createDataFrame(order, "doc_id long, text string, n int")
            got = exact_dedup.drop_exact_copies(d)
            assert got.columns == d.columns
            kept = sorted((r.doc_id or -1, r.text or "") for r in got.collect())
            assert kept == sorted([(ids[0] or -1, "B"), (9, "A"), (5, ""), (7, "C"), (7, "D")])


def test_near_groups_equal_brute_force(docs):
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, 3, 85).collect()}
    assert got == brute_near([(r.doc_id, r.text) for r in docs.collect()])


def test_near_groups_about_the_threshold_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(2, 6)):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    want = brute_near(rows)
    assert 1 < len(set(want.values())) < 150
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_encoding_equals_library():
    model = sentencepiece_bpe.read_model(MODEL)
    mine, back, lib = sentencepiece_bpe.Encoder(model), sentencepiece_bpe.Decoder(model), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    texts = ["".join(rng.choices("aabcdeeilnorstt  \n\t,.▁éñ中🙂<0x>AB12\0", k=rng.randint(0, 50))) for _ in range(1500)]
    for t in [*texts, "", "  ", "<s>hi</s>", "<0x0A>", "a" * 300]:
        ids = lib.encode(t)
        assert mine.encode(t) == ids and back.decode(ids) == lib.decode(ids)


def test_segments_are_kept_in_little_memory_and_characters_that_are_no_pieces_encoded():
    model, lib = sentencepiece_bpe.read_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder = sentencepiece_bpe.Encoder(model, 200)
    words = [f"word{i}🜁{chr(0x4E00 + 37 * i)}" for i in range(400)]
    for t in [*words, *words[::-1], "x" * 100]:
        kept = encoder.segments["▁" + t]
        assert isinstance(kept, str) and list(map(ord, kept)) == lib.encode(t)
    assert len(encoder.segments) <= 100 and len(encoder.segments.old) <= 100
    # which beginning of a piece may follow another is looked up once, not piece by piece
    encoder.pairs.clear()
    tried, stays = [], encoder.stays
    encoder.stays = lambda a, b: tried.append((a, b)) or stays(a, b)
    first = [encoder.split("▁" + t) for t in ("thstblesh", "ofonshenat", "enenreesatan")]
    n = len(tried)
    assert n and first == [encoder.split("▁" + t) for t in ("thstblesh", "ofonshenat", "enenreesatan")] and len(tried) == n


def test_digests_are_of_the_text_decoded_from_the_ids(monkeypatch):
    model, lib = sentencepiece_bpe.read_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(4)
    texts = ["".join(rng.choices("aabcdeeilnorstt  \n\t,.▁éñ中🙂🜁<0x>AB12\0", k=rng.randint(0, 50))) for _ in range(300)]
    texts += ["", "  ", "🜁🜂 🜃", "<0x0A>"]
    got = sentencepiece_bpe._digests(model, [t.encode() for t in texts])
    for t, ids, text in zip(texts, got["ids_sha256"], got["decoded_sha256"], strict=True):
        assert ids == hashlib.sha256(",".join(map(str, lib.encode(t))).encode()).hexdigest()
        assert text == hashlib.sha256(lib.decode(lib.encode(t)).encode()).hexdigest()
    # ids that were lost or changed show in the digest
    monkeypatch.setattr(sentencepiece_bpe, "_encoders", [])
    monkeypatch.setattr(sentencepiece_bpe.Encoder, "ids", lambda self, text, whole=sentencepiece_bpe.Encoder.ids: whole(self, text)[:-1])
    assert sentencepiece_bpe._digests(model, [b"hello world"])["decoded_sha256"] != [hashlib.sha256(b"hello world").hexdigest()]


def test_png_round_trip_and_damage():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 5000):
        data = media.padded(rng.integers(0, 256, n, np.uint8).tobytes())
        assert media.load(media.store(data)).tobytes() == data
    kinds, lines = np.array([4, 3, 2, 1, 0, 4]), rng.integers(0, 256, (6, 64)).astype(np.uint8)
    out = media.unfilter(kinds, lines)
    up = np.zeros(65, int)
    for k, line, got in zip(kinds, lines, out, strict=True):
        row = np.zeros(65, int)
        for i in range(1, 65):
            a, b, c = row[i - 1], up[i], up[i - 1]
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row[i] = (int(line[i - 1]) + (0, a, b, (a + b) // 2, paeth)[k]) % 256
        assert (row[1:] == got).all()
        up = row
    bad = bytearray(media.store(media.padded(b"hello")))
    bad[50] ^= 1
    with pytest.raises(ValueError):
        media.load(bytes(bad))


def test_pipeline_runs_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_short_texts_read_as_one_have_the_runs_of_each(spark, monkeypatch):
    rng = random.Random(8)
    base = [" ".join("".join(rng.choices("abcd", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    texts = [*base, *(a[-500:] + b for a, b in zip(base, base[1:], strict=False)), "a" * 400, "a" * 399, "w " * 51, "w " * 50, "ab" * 500, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for unit in (repeats.BYTES, repeats.PASSAGES):
        found = []
        for joint in (0, 4_000, 1 << 15):  # 0: each text alone
            monkeypatch.setattr(repeats, "JOINT", joint)
            found.append(sorted(tuple(r) for r in repeats.entries(docs, unit).collect()))
        assert found[0] and found[0] == found[1] == found[2]
    calls, anchors = [], repeats.anchors
    monkeypatch.setattr(repeats, "anchors", lambda *a: calls.append(a) or anchors(*a))
    roll, many = repeats.Rolling(), [np.frombuffer(t.encode(), np.uint8) for t in texts if len(t) >= 400]
    repeats.joint_runs(many, repeats.BYTES, roll)
    assert len(calls) == 1 < len(many)
