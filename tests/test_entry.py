import importlib
import os
import subprocess
import sys

import pytest

import __spark_entry__ as e

SMALL = "/root/testdata/sf0.001"


def test_names_and_sql_agree():
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and {"p3_found", "j0_reads_per_feature"} <= set(q)


def test_queries_are_listed_without_a_session():
    """The driver may ask for the queries before it has a session."""
    here = os.path.dirname(e.__file__)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=here, capture_output=True, text=True, check=True).stdout
    assert [int(x) for x in out.split()] == [len(e.queries()), len(e.oracle_sql())]


def test_core_never_imports_the_llm_package():
    here = os.path.join(os.path.dirname(e.__file__), "strandlake")
    for folder, _, files in os.walk(here):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "strandlake.llm" not in open(os.path.join(folder, f)).read(), f
    importlib.import_module("strandlake.cli")


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_flagship(spark):
    assert e.entry(spark).count() > 0
