"""The driver's contract: registered queries, their SQL, and what happens without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_registry():
    from lodestone.plans import registry

    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) > 120


def test_entry_without_llm(tmp_path):
    """Without the subpackage and the pipeline the entry still imports and has the other queries."""
    shutil.copytree(os.path.join(ROOT, "lodestone"), tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'group_advantage' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "lodestone")):
        if os.sep + "llm" not in folder:
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as source:
                        assert "lodestone.llm" not in source.read(), name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["group_advantage", "pref_loss_ipo", "chat_template", "exact_dedupe", "pass_at_k", "pack_wrapped"])
def test_against_sql(spark, name):
    from lodestone.plans import registry

    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    result = connection.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(result.columns) == columns
    plain = lambda v: round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    order = [result.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in result.fetchall())
