"""Queries on workers that have no copy of the package."""

import os
import subprocess
import sys

import pytest

from quadrille.llm import entry

NAMES = list(entry.QUERIES)
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", {folder!r}).getOrCreate())
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
found = spark.sparkContext.parallelize([0], 1).map(lambda _: __import__("importlib.util").util.find_spec("quadrille") is None).collect()
assert found == [True], "the workers see the package"
for name in {names!r}:
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


@pytest.mark.parametrize("names", [NAMES, ["pipeline"]])
def test_workers_need_no_copy_of_the_package(tmp_path, names):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(folder=str(tmp_path / "shared"), repo=repo, names=names))
    said = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert said.returncode == 0, said.stdout + said.stderr[-3000:]
    assert [line.split()[0] for line in said.stdout.splitlines() if line.split()[0] in names] == names
