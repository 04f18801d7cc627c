"""Held-out accuracy of the trained operators, and queries against plain versions of them."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from flarespan.llm import exact_dedup, licenses, media, mixing, near_dedup, quality, queries, secrets, toxicity

SF, SF10 = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def rated(spark):
    """(doc_id, text, quality, toxic) of the labelled documents of sf0.1."""
    d, lab = (spark.read.parquet(f"{SF10}/{t}.parquet") for t in ("documents", "labels"))
    return [(r.doc_id, (r.text or "").encode(), r.quality, r.toxic) for r in d.join(F.broadcast(lab), "doc_id").select("doc_id", "text", "quality", "toxic").collect()]


def test_toxicity_of_held_out_documents(rated):
    words = toxicity.word_table()
    rows = sorted((toxicity.hash_order(i), toxicity.features(x, words), y, zlib.crc32(str(i).encode()) % 4 == 2) for i, x, _, y in rated if y is not None)
    w = toxicity.ftrl([(at, y) for _, at, y, held in rows if not held])
    assert 0 < np.count_nonzero(w) < 20_000  # sparse
    flagged = np.array([w[at].sum() >= np.log(0.3 / 0.7) for _, at, _, held in rows if held])
    y = np.array([y for _, _, y, held in rows if held])
    assert flagged[y == 1].mean() >= 0.9 and flagged[y == 0].mean() <= 0.01


def test_quality_of_held_out_documents(rated):
    words = quality.word_table()
    rows = [(*quality.features(x, words), 0 if q == 0 else 1 if t == 1 else 2, zlib.crc32(str(i).encode()) % 4 == 1) for i, x, q, t in rated if q is not None]
    w, t = quality.fit_ordinal([r[:3] for r in rows if not r[3]], 3)
    assert t[0] < t[1]
    kept = np.array([w[r[0]] @ r[1] >= t[0] for r in rows if r[3]])
    y = np.array([r[2] for r in rows if r[3]])
    assert kept[y == 0].mean() <= 0.1 and kept[y == 2].mean() >= 0.99
    tail = quality.graded  # tails of later grades are never above those of earlier ones, as thresholds are ordered
    assert tail and (np.diff(t) > 0).all()


def test_models_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    for none in (labels, labels.where("false")):
        assert [r.tail_1 for r in quality.quality(docs, none).collect()] == [0.5, 0.5]
        assert quality.drop_rejected(docs, none).count() == 2
        assert [r.score for r in toxicity.toxicity(docs, none).collect()] == [0.5, 0.5]


def test_shape_reads_whole_words():
    assert quality.shape("a" * 100 + "-9") == "x-9" and quality.shape("Ab12.c") == "Xx9.x"


def plain_secrets(text):
    """The base patterns, written once more: letters of either case are those of ASCII."""
    assign = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    found = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({assign})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_secrets_query_and_letters_of_ascii_only(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op8_secrets(spark, SF).collect():
        base = plain_secrets(texts[r.doc_id])
        names = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b[1] == k for b in base) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(names.encode()).hexdigest()
        assert set(filter(None, names.split(","))) <= set(r.spans.split(","))
    for text in ("ſecret = abcdefghijkl", "toKen = abcdefghijkl", "ToKeN='abcdefghijkl", "password = abc", "AKIA" + "A" * 14, "a" * 15 + "g" + "0" * 16):
        assert secrets.base_spans(text) == plain_secrets(text)


def test_network_finds_secrets_of_kinds_it_has_not_seen(rated):
    texts = [x.decode() for _, x, _, _ in rated if x][:2400]
    for kind in (0, 2, 5):
        rest = tuple(k for k in range(secrets.SECRETS) if k != kind)
        rows = [r for t in texts[:1500] for r in secrets.labelled(t, rest)]
        some = [r for k in range(4) for r in sorted({r for r in rows if r[2] == k}, key=lambda r: hashlib.md5(r[0]).digest())[: secrets.MOST_EACH]]
        net, rng, there, put = secrets.fitted(some), random.Random(kind), [], []
        for t in texts[1500:]:
            at, made = t.find(" ") + 1, secrets.made_up(rng, kind)
            there.append(f"{t[:at]}{made} {secrets.look_alike(rng)} {t[at:]}")
            put.append((at, at + len(made)))
        found = secrets.secret_candidates(net, there, [secrets.base_spans(t) for t in there])
        right = {i for i, s, e in found if s < put[i][1] and e > put[i][0]}
        based = {i for i, t in enumerate(there) if any(s < put[i][1] and e > put[i][0] for s, _, e in secrets.base_spans(t))}
        false = [x for x in found if not (x[1] < put[x[0]][1] and x[2] > put[x[0]][0])]
        assert len(right | based) >= 0.9 * len(there) and len(false) <= 0.05 * len(there)


def test_network_learns_from_every_window(spark, rated, monkeypatch):
    texts = [x.decode() for _, x, _, _ in rated if x]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:1600] * 2)], "doc_id long, text string")
    every = {r for t in texts[:1600] for r in secrets.labelled(t)}
    assert max(sum(r[2] == k for r in every) for k in range(4)) > secrets.MOST_EACH
    assert sorted(tuple(r) for r in secrets.labelled_windows(docs).collect()) == sorted(every)
    monkeypatch.setattr(secrets, "BLOCK", 1_000)
    blocks, many = secrets.in_blocks(secrets.labelled_windows(docs))
    dealt = [(r.held, r.windows[k * secrets.WINDOW :][: secrets.WINDOW], r.found[k], r["class"][k]) for r in blocks.collect() for k in range(len(r.found))]
    assert many == -(-len(every) // 1_000) and sorted(dealt) == sorted((secrets.held_back(r[0]), *r) for r in every)
    net = secrets.trained_once(blocks, secrets.Net(), 0)
    assert sum(r.n for r in secrets.held_counts(blocks, net)) == sum(d[0] for d in dealt)
    monkeypatch.setattr(secrets, "ROUNDS", 40)  # such blocks have a dozen steps in a round
    net = secrets.Net.load(secrets.fit(docs))
    rows = sorted({r for t in texts[1600:2400] for r in secrets.labelled(t)} - every)
    x, y, group = secrets.arrays(rows)
    hit = net.probability(x) >= net.p["limit"][0]
    assert hit[group == 2].mean() >= 0.9 and hit[group == 3].mean() <= 0.1


def test_whole_candidates_are_seen():
    text = "x " + "ab1" * 100 + " end"
    (s, e), seen = secrets.other_candidates(text, [])[0], secrets.windows(text, 2, 302)
    assert (s, e) == (2, 302) and len(seen) == 1 + -(-(300 + 2 * secrets.CONTEXT - secrets.WINDOW) // secrets.STRIDE)
    assert secrets.other_candidates("Incomprehensibilities, correct-horse-battery and lettersonly", []) == [(23, 44)]
    assert secrets.other_candidates("aa-bb-cc-dd-" + "f" * 16 + "-xx-yy-zz-11", [(12, 2, 28)]) == [(0, 12), (28, 40)]


def allocate(tree, budget, weight, epochs):
    """Water filling one token unit after the other is too slow; level by level with fractions, rounded down at the end of each level."""

    def cap(node):
        return sum(cap(c) for k, c in node.items() if weight(k) > 0) if isinstance(node, dict) else node * epochs

    def give(node, amount, path):
        if not isinstance(node, dict):
            return {path: amount}
        share, left, rest = dict.fromkeys(node, 0), amount, {k: cap(c) for k, c in node.items() if weight(k) > 0}
        while rest:  # fill what is full at this water level, then share the remainder
            total = sum(weight(k) for k in rest)
            full = [k for k in rest if rest[k] * total <= left * weight(k)]
            if not full:
                share |= {k: left * weight(k) // total for k in rest}
                break
            k = min(full, key=lambda k: rest[k] / weight(k))
            share[k], left = rest[k], left - rest.pop(k)
        return {p: n for k, c in node.items() for p, n in give(c, share[k], (*path, k)).items()}

    return give(tree, min(budget, cap(tree)), ())


@pytest.mark.parametrize("seed", range(3))
def test_budgets_equal_a_plain_allocator(spark, seed):
    rng = random.Random(seed)
    names = [("d1", "d2", "d0"), ("l1", "l2", "l0"), ("s1", "s2", "s0")]
    weights = [{n: rng.randint(1, 5) for n in level[:2]} | {level[2]: 0} for level in names]  # the last of each level has weight 0
    tree = {d: {x: {s: rng.choice([0, 5, 100, 1000]) for s in names[2]} for x in names[1]} for d in names[0]}
    leaves = [(d, x, s, tree[d][x][s]) for d in tree for x in tree[d] for s in tree[d][x]]
    plan = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    for budget in (0, 37, 400, 2_000, 10**6):
        got = mixing.leaf_budgets(plan, F.lit(budget), dict(zip(mixing.LEVELS, weights, strict=True)), 1, 2).collect()
        want = allocate(tree, budget, lambda k: {"d": weights[0], "l": weights[1], "s": weights[2]}[k[0]][k], 2)
        assert {(r.domain, r.lang, r.source): r.budget for r in got} == want
    case = spark.createDataFrame([("A", "en", "x", 1000), ("A", "en", "y", 10), ("B", "en", "z", 1000)], "domain string, lang string, source string, tokens long")
    assert {r.source: r.budget for r in mixing.leaf_budgets(case, F.lit(400), {"source": {"x": 0}}, 1, 1).collect()} == {"x": 0, "y": 10, "z": 390}


def test_edited_licenses_are_found(spark):
    rng = random.Random(1)
    rows, want = [], {}
    long = {t: b.split() for t, b in licenses.TEMPLATES.items() if len(b.split()) >= 28}
    for i in range(400):
        name = rng.choice(sorted(long))
        body = list(long[name])
        for at in range(rng.randrange(25), len(body), 25):  # about one word in 25: a fifth of the shingles
            body[at] = f"zz{rng.randrange(999)}"
        filler = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(0, 300))]
        at = rng.randrange(len(filler) + 1)
        words = [w for w in re.split(licenses.SPLIT.replace("\\p{L}\\p{N}", "a-z0-9"), " ".join(filler[:at] + body + filler[at:]).lower()) if w]
        held = {tuple(words[j : j + 5]) for j in range(len(words) - 4)}
        for t, b in licenses.TEMPLATES.items():
            w = [x for x in re.split("[^a-z0-9]+", b.lower()) if x]
            parts = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
            if parts and len(parts & held) >= licenses.CONTAINED * len(parts):
                want[i, t] = len(parts & held)
        rows.append((i, " ".join(filler[:at] + body + filler[at:])))
    got = {(r.doc_id, r.template): r.n_found for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 150 and got.items() <= want.items() and len(got) >= 0.99 * len(want)


def test_media_query_reads_back_what_was_stored(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op2_media_columns(spark, SF).collect():
        x = texts[r.doc_id]
        payload = x + bytes(-len(x) % 64 or (0 if x else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(x), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.store(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == media.dct_hash(np.frombuffer(payload, np.uint8).reshape(-1, 64), media.cosines())


def test_encoding_query_equals_library(spark):
    import public_tokenizers

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op9_sentencepiece(spark, SF).collect():
        ids = lib.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


CLASHES = ("_keep", "_text", "_rows", "_nth", "_copies", "_id", "_sha", "_md5", "_raw", "_tokens", "kept", "copy", "node", "component", "n", "bucket", "Place", "slice", "domain", "epochs")


@pytest.fixture(scope="module")
def clashing(spark):
    """Odd rows with further columns whose names the stages use inside."""
    good = " ".join(f"word{k}" for k in range(40))
    rows = [(1, None, "en", "src0"), (2, "", "de", None), (3, good, None, "src1"), (4, good, "en", "src0"), (4, good, "en", "src0"), (5, "alpha beta " * 6000, "fr", "src2"), (5, "b c d e f g h i", "en", "src0")]
    rows += [(None, "x y z", "en", "src0"), (None, "other words", "en", "src3"), (6, good + " tail", "en", "src0")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    return d.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHES}).persist()


def test_stages_keep_columns_whatever_their_names(spark, clashing):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    stages = {
        "quality": lambda d: quality.drop_rejected(d, labels), "exact": exact_dedup.drop_exact_copies, "near": near_dedup.drop_near_copies, "mixing": mixing.mixed_documents,
    }
    for name, stage in stages.items():
        out = stage(clashing)
        assert out.columns == clashing.columns and stage(clashing.where("false")).count() == 0
        rows = out.collect()
        assert all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES)
        ids = sorted((r.doc_id or -1, (r.text or "")[:11]) for r in rows)
        if name == "exact":  # of the empty texts the largest doc_id, of repeated rows one
            assert ids == sorted([(2, ""), (4, "word0 word1"), (5, "alpha beta "), (5, "b c d e f g"), (-1, "x y z"), (-1, "other words"), (6, "word0 word1")])
        if name == "near":  # 3, 4 and 6 are one group; repeated doc_ids are compared text by text
            assert ids == sorted([(1, ""), (2, ""), (3, "word0 word1"), (5, "alpha beta "), (5, "b c d e f g"), (-1, "x y z"), (-1, "other words")])


def test_pipeline_stages_have_the_names_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact dedup", "near dedup", "mixing", "encoding"]
