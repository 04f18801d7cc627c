"""Line dedup, Merkle manifest and spelling variants: against plain versions, and their edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from flarespan.llm import line_dedup, manifest, queries, spelling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def docs_of(spark, rows, **more):
    return spark.createDataFrame([(i, t, *m) if m else (i, t, "en", "s", 1) for i, t, *m in rows], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_spelling_forms", "op12_merkle_manifest", "op13_line_dedup"])
def test_equals_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    a, b = queries.QUERIES[name](spark, SF), c.sql(queries.SQL[name])
    assert set(a.columns) == set(b.columns)
    assert rows_of(a) == sorted((tuple(r) for r in b.select(*a.columns).fetchall()), key=repr)


# lines


def plain_lines(rows, least_docs, least_chars):
    keys = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(AZ)
    for i, t in rows:
        for x in (t or "").split("\n"):
            keys[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= least_chars and len(keys[key(x)]) >= least_docs and i != max((d for d in keys[key(x)] if d is not None), default=None) for x in lines]
        out.append((i, len(lines), sum(gone), sha("\n".join(x for x, g in zip(lines, gone, strict=True) if not g))))
    return sorted(out, key=repr)


def test_lines_equal_a_plain_version(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice(["Ünder", "the", "A b", "Line", "x"]) for _ in range(rng.randint(1, 14))) for _ in range(25)] + ["", " ", "\t"]
    rows = [(i, "\n".join(rng.choice([str.upper, str.lower, lambda x: f" {x}\x0b\r", str])(rng.choice(pool)) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    rows += [(None, rows[3][1]), (7, rows[4][1]), (9, rows[9][1]), (90, None), (91, ""), (92, "\n\n"), (93, f"{pool[0]}\n" * 40_000)]
    got = line_dedup.without_common_lines(docs_of(spark, rows), 5, 12)
    assert rows_of(got.drop("text")) == plain_lines(rows, 5, 12)
    assert sum(r.n_dropped for r in got.collect()) > 100
    assert all(sha(r.text) == r.kept_sha256 for r in got.collect())


def test_lines_of_no_rows_and_clashing_names(spark):
    docs = docs_of(spark, [(i, f"{'shared line ' * 5}\nown {i}") for i in range(6)]).withColumns({"pos": F.lit(1), "LINE_KEY": F.lit("x"), "drops": F.lit(2), "_key": F.lit(3), "_id": F.lit(4)})
    assert {r.doc_id: r.text for r in line_dedup.without_common_lines(docs).collect()} == {i: f"own {i}" for i in range(5)} | {5: f"{'shared line ' * 5}\nown 5"}
    assert line_dedup.without_common_lines(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        line_dedup.without_common_lines(docs, 1)


# manifest


def plain_manifest(rows, bad):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, t: sha("".join(map(field, (r[0], r[3], r[2], r[4], t))))

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
        return levels

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, where = {}, {}
    for g in langs:
        mine = sorted((k for k, r in enumerate(rows) if r[2] == g), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaf(rows[k], rows[k][1])))
        trees[g] = up([leaf(rows[k], rows[k][1]) for k in mine])
        where |= {k: i for i, k in enumerate(mine)}
    top = up([trees[g][-1][0] for g in langs])
    out = []
    for k, r in enumerate(rows):
        own = leaf(r, r[1])
        proof, now = "", leaf(r, bad(r))
        for levels, i in ((trees[r[2]], where[k]), (top, langs.index(r[2]))):
            for level in levels[:-1]:
                run = level[i // 8 * 8 : i // 8 * 8 + 8]
                left, right = "".join(run[: i % 8]), "".join(run[i % 8 + 1 :])
                proof, now, i = proof + left + right, sha(left + now + right), i // 8
        out.append((r[0], own, trees[r[2]][-1][0], top[-1][0], sha(proof), now, now == top[-1][0]))
    return sorted(out, key=repr)


def tampered(r):
    return r[1] if r[0] is None or r[1] is None or zlib.crc32(str(r[0]).encode()) % 3 else r[1].translate(AZ)


@pytest.mark.parametrize("n, part, fan", [(1, 4, 2), (3, 4, 2), (9, 4, 2), (150, 7, 2), (150, 3, 3), (700, 64, 4)])
def test_manifest_equals_a_plain_version(spark, monkeypatch, n, part, fan):
    monkeypatch.setattr(manifest, "PART_ROWS", part)
    monkeypatch.setattr(manifest, "FAN", fan)
    rng = random.Random(n)
    langs = [None, "de", "en", "en", "en", "é", "zz"] + [f"l{k}" for k in range(12)]
    rows = [(rng.choice([i, i, i, i // 9, None]), rng.choice(["Ab É", "", None, "plain", "Text %d" % i]), rng.choice(langs), rng.choice([None, "web"]), rng.choice([None, i])) for i in range(n)]
    rows += rows[: n // 9]
    docs = docs_of(spark, rows).withColumns({"leaf": F.lit(1), "PART": F.lit(2), "at": F.lit(3), "tree": F.lit(4)})
    assert rows_of(manifest.manifest(docs, manifest.lower_cased_third())) == plain_manifest(rows, tampered)


def test_manifest_without_tampering_and_without_rows(spark):
    docs = docs_of(spark, [(i, f"Text {i}", f"l{i % 3}", None, i) for i in range(30)])
    got = manifest.manifest(docs).collect()
    assert len(got) == 30 and all(r.verified for r in got)
    assert manifest.manifest(docs.where("false"), manifest.lower_cased_third()).collect() == []


def test_fragments_merge_in_any_order():
    rng = random.Random(1)
    sizes = {0: 100, 1: 1, 2: 37, manifest.TOP: 3}
    leaves = [((t, 0, i), sha(f"{t}:{i}")) for t in (0, 1, 2) for i in range(sizes[t])]
    want = None
    for _ in range(5):
        rng.shuffle(leaves)
        parts = [manifest.settled(dict(leaves[k : k + 9]), sizes, [k for k, _ in leaves[k : k + 9]]) for k in range(0, len(leaves), 9)]
        todo = [(p, sizes) for p in parts]
        while len(todo) > 1:
            k = rng.randrange(len(todo) - 1)
            todo[k : k + 2] = [manifest.merged(todo[k], todo[k + 1])]
        assert len(todo[0][0]) == 1
        want = want or todo[0][0]
        assert todo[0][0] == want
    assert manifest.read(manifest.written(todo[0])) == todo[0]


# spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_spelling(rows, least, least_n, times, spoil):
    import re

    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if spoil and h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    v = {w: n for w, n in count.items() if len(w) >= least and n >= least_n}
    form, n_near = {}, {}
    for w, n in v.items():
        others = [x for x in v if near(w, x)]
        n_near[w] = len(others)
        best = min(others, key=lambda x: (-v[x], x), default=None)
        form[w] = best if best and v[best] >= times * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, n_near[w], v.get(form[w])) for w, n in v.items()), key=repr)


def test_spelling_equals_a_plain_version(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abÀé÷") for _ in range(rng.randint(3, 6))) for _ in range(60)]
    often = [w for k, w in enumerate(words) for _ in range(1 + k * k // 3)]
    rows = [(i, rng.choice([" ", ", ", "1", "日"]).join(rng.choice([str, str.upper])(rng.choice(often)) for _ in range(200))) for i in range(40)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (50, None), (51, ""), (52, "x" * 3000 + " " + "x" * 3001 + " " + "x" * 3000), (53, "chaix " * 2 + "chain " * 25 + "chains " * 300)]
    docs = docs_of(spark, rows).withColumns({"n": F.lit(1), "WORD": F.lit("x"), "rank": F.lit(2), "_id": F.lit(3)})
    for least, least_n, times, spoil in ((4, 2, 3, 5), (4, 1, 2, 0), (5, 2, 10, 2)):
        got = rows_of(spelling.spelling_forms(docs, least, least_n, times, spoil))
        assert got == plain_spelling(rows, least, least_n, times, spoil)
        assert any(r[1] for r in got) and (spoil or ('chaix', 'chain', 'chains', 2, 1, 25) in got)
    assert spelling.spelling_forms(docs.where("false")).collect() == []


def test_long_texts_are_cut_between_words(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgÉé日 ,1\n") for _ in range(20_000)) + "q" * 5000
    whole, cut = Counter(), Counter()
    spelling.words_of(text.encode(), "1", 3, 7, whole)
    monkeypatch.setattr(spelling, "PIECE", 17)
    assert b"".join(spelling.pieces(text.encode())) == text.encode()
    spelling.words_of(text.encode(), "1", 3, 7, cut)
    assert whole == cut and len(whole) > 100


def test_keys_of_holes_and_deletions():
    holes, shorter, whole = spelling.group_keys("aabé")
    assert len(holes) == 4 and len(shorter) == 3 and whole not in shorter
    assert set(shorter) == {spelling.group_keys(w)[2] for w in ("abé", "aaé", "aab")}
    assert set(holes) & set(spelling.group_keys("axbé")[0]) == {holes[1]}
    assert not set(holes) & set(spelling.group_keys("aabéé")[0])
