"""The core's queries are there whatever the training-data operators lack."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from tricklens.plans.oracle import oracle_queries
from tricklens.plans.queries import registry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def entry_without(module: str) -> subprocess.CompletedProcess:
    code = (
        f"import sys; sys.modules[{module!r}] = None; import __spark_entry__ as e; "
        "q, s = e.queries(), e.oracle_sql(); print(sorted(q)); print(sorted(s))"
    )
    return subprocess.run([sys.executable, "-c", code], cwd=HERE, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("module", ["public_tokenizers", "sentencepiece", "tricklens.llm", "corpus_pipeline", "numpy"])
def test_core_queries_without(module):
    done = entry_without(module)
    queries, sql = map(eval, done.stdout.splitlines())
    assert set(registry()) <= set(queries) and set(oracle_queries()) <= set(sql) and set(sql) <= set(queries)
    if module in ("public_tokenizers", "tricklens.llm", "corpus_pipeline"):
        assert not any(q.startswith("op") for q in queries) and "pipeline" not in queries


def test_a_missing_core_module_is_an_error():
    done = entry_without("tricklens.plans.summary")
    assert done.returncode != 0 and "tricklens.plans.summary" in done.stderr
