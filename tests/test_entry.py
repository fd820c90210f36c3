import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_every_oracle_has_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 70


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["c_mktsegment", "sum_o_orderkey"] and got.count() == 3


def test_imports_without_the_text_subpackage(tmp_path):
    """The text operators and the pipeline may be deleted: the rest imports and still has its queries."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'star_topn' in q and 'pipeline' not in q and not [x for x in q if x[:2] == 'op' and x[2].isdigit()]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
