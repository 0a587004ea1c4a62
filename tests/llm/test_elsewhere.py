"""Queries where the package is not on the workers' path, and where a library is missing."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def run(script, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", script, str(ROOT)], cwd=folder, env=env, capture_output=True, text=True, timeout=600)


def test_workers_need_not_have_the_package(tmp_path, sf_dir):
    script = f"""
import sys
sys.path.insert(0, sys.argv[1])
from cladeframe.session import local_session
from cladeframe.llm.queries import registry
spark = local_session(4, "elsewhere")
# nothing of this process's path reaches the workers
assert spark.range(1).mapInPandas(lambda b: (d.assign(id=int(any("{ROOT}" == p for p in __import__("sys").path))) for d in b), "id long").first().id == 0
for name in ("op2_kneser_ney", "op3_url_cascade", "op6_tfidf_knn", "op8_rff_quality", "op11_warc", "op13_phrases"):
    assert registry.queries[name](spark, "{sf_dir}").count() > 0, name
print("all fine")
"""
    done = run(script, tmp_path)
    assert "all fine" in done.stdout, done.stderr[-3000:]


def test_base_queries_without_the_libraries_of_the_others(tmp_path):
    script = """
import sys
sys.path.insert(0, sys.argv[1])
sys.modules["xxhash"] = None
import __spark_entry__ as entry
names = set(entry.queries())
assert len(names) > 80 and not any(n.startswith("op") for n in names) and set(entry.oracle_sql()) <= names
print("all fine")
"""
    done = run(script, tmp_path)
    assert "all fine" in done.stdout, done.stderr[-3000:]
