"""The entry module imports without reading any file of PySpark's own."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

CODE = """
import os, pathlib, sys, zipfile
def refuse(*a, **k): raise AssertionError("the import looks at files")
pathlib.Path.glob = pathlib.Path.rglob = zipfile.ZipFile = refuse
sys.path.insert(0, {root!r})
import __spark_entry__ as e
q, sql = e.queries(), e.oracle_sql()
assert q and sql and set(sql) <= set(q)
"""


def test_import_reads_no_files(tmp_path):
    done = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT))], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
