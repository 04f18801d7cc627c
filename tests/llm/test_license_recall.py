"""Worst cases of the license scan for each long template, and the size of its generated methods."""

from flarespan.llm import licenses
from flarespan.llm.common import table

SF = "/root/testdata/sf0.001"


def shingles(w):
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_every_long_template_is_found_whatever_the_alignment_and_the_edits(spark):
    import re

    rows, want = [], {}
    cut = lambda t: [x for x in re.split(r"[^a-z0-9]+", t.lower()) if x]
    long = {t: cut(b) for t, b in licenses.TEMPLATES.items() if len(shingles(cut(b))) >= licenses.LONG}
    assert len(long) >= 3
    for t, body in long.items():
        for ahead in range(licenses.STRIDE):
            for every, insert in ((25, False), (24, False), (21, True), (20, True)):
                for first in range(0, every, 3):
                    w = [f"pre{k}" for k in range(ahead)]
                    for k, x in enumerate(body):
                        hit = k % every == first
                        w += [f"new{k}", x] if hit and insert else [f"new{k}"] if hit else [x]
                    w += [f"post{k}" for k in range(30)]
                    if len(shingles(body) & shingles(w)) >= licenses.CONTAINED * len(shingles(body)):
                        want[len(rows)] = t
                    rows.append((len(rows), " ".join(w)))
    assert len(want) > 300
    got = {(r.doc_id, r.template) for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, t) for i, t in want.items()} <= got


def test_generated_methods_are_short_enough_to_be_compiled(spark):
    """HotSpot leaves methods of more than 8,000 bytes to its interpreter."""
    docs = table(spark, SF, "documents")
    known = licenses.template_table(spark, licenses.TEMPLATES)
    hashed = docs.select("doc_id", licenses.word_hashes(docs["text"]).alias("_words"))
    windows = licenses.stored(licenses.shingled(hashed, licenses.STRIDE, licenses.WINDOW, "doc_id"), "windows")
    lows = licenses.band_rows(windows, "doc_id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (licenses.holders(docs, known), licenses.shingled(hashed, licenses.STRIDE, licenses.WINDOW, "doc_id"), lows):
            debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
            found = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
            sizes = [found.apply(k)._3().maxMethodCodeSize() for k in range(found.size())]
            assert sizes and max(sizes) < 8_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
