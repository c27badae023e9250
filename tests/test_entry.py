"""The driver's contract."""

from __future__ import annotations

import subprocess
import sys

from tests.conftest import ROOT


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(o) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_flagship_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
