"""The entry points, with and without the optional subpackage and what it needs."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", ["", "ahocorasick", "public_tokenizers", "sentencepiece", "flarespan.llm", "corpus_pipeline"])
def test_other_queries_are_there_whatever_cannot_be_imported(gone):
    code = f"import sys; sys.modules.update({{k: None for k in {gone.split()!r}}}); import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'c4_slot_stats' in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["lifetime_id", "n", "fraud_amount"]
