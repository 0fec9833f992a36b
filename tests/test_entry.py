"""The driver contract."""

from __future__ import annotations

import subprocess
import sys

import __spark_entry__
from tests.conftest import ROOT


def test_contract(spark):
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 90
    assert __spark_entry__.entry(spark).count() > 0


def test_works_without_the_optional_parts():
    code = "import sys; sys.modules['filmroll.llm'] = None; import __spark_entry__ as e; assert not any(n.startswith('op') for n in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
