"""The registry must import without a session, Spark's jars or the llm subpackage."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True,
                          env=os.environ | {"PYTHONPATH": REPO, "PYTHONDONTWRITEBYTECODE": "1"}, timeout=120)


def test_import_needs_no_jars_and_no_session():
    out = _run("import pyspark; pyspark.__file__ = '/nowhere/pyspark/__init__.py'\n"
               "import __spark_entry__ as e\n"
               "from pyspark.sql import SparkSession\n"
               "assert SparkSession.getActiveSession() is None\n"
               "print(len(e.queries()), len(e.oracle_sql()))")
    assert out.returncode == 0, out.stderr
    n, m = map(int, out.stdout.split())
    assert n >= 37 and m >= 35


def test_import_without_the_llm_subpackage():
    out = _run("import sys\n"
               "class Gone:\n"
               "    def find_spec(self, name, path=None, target=None):\n"
               "        if name.startswith('newslens.llm') or name == 'corpus_pipeline':\n"
               "            raise ModuleNotFoundError(name)\n"
               "sys.meta_path.insert(0, Gone())\n"
               "import __spark_entry__ as e\n"
               "assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']\n"
               "assert set(e.oracle_sql()) <= set(e.queries())")
    assert out.returncode == 0, out.stderr
