"""What the entry promises without the training-data folders, and how the rule engine's plan behaves under a filter."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

from pedalspark.operators import lts
from pedalspark.plans.adapters import table

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_entry_without_training_data(tmp_path):
    """With the two folders and the pipeline deleted, with the folders alone deleted, and with all in place."""
    shutil.copytree(ROOT / "pedalspark", tmp_path / "pedalspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'node_lts' in q and set(o) <= set(q); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    counts = []
    for pipeline in (False, True):
        if pipeline and (ROOT / "corpus_pipeline.py").exists():
            shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        counts.append(int(subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, capture_output=True, text=True).stdout))
    assert counts[0] == counts[1] > 100


def test_rules_are_written_once_under_a_filter(spark):
    edges = lts.edge_stress(table(spark, SF, "edges"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    whole, some = plan(edges.groupBy("lts").count()), plan(edges.filter("lts > 2").groupBy("lts").count())
    assert len(some) < 1.2 * len(whole)
