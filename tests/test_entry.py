"""The entry module without the training-data package."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT


def test_queries_without_the_training_data_package(tmp_path):
    for d in ("botlog",):
        shutil.copytree(os.path.join(ROOT, d), tmp_path / d, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ("__spark_entry__.py", "oracles.py"):
        shutil.copy(os.path.join(ROOT, f), tmp_path / f)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    n, pipeline, known = out.stdout.split()[-3:]
    assert int(n) >= 69 and (pipeline, known) == ("False", "True"), out.stderr


def test_an_empty_folder_in_its_place_is_not_the_package(tmp_path):
    shutil.copytree(os.path.join(ROOT, "botlog"), tmp_path / "botlog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    os.makedirs(tmp_path / "botlog" / "llm")
    for f in ("__spark_entry__.py", "oracles.py"):
        shutil.copy(os.path.join(ROOT, f), tmp_path / f)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print('pipeline' in e.queries())"], cwd=tmp_path,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[-1] == "False", out.stderr
