"""The entry module with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(len(e.queries()), *sorted(e.queries())); e.oracle_sql()"


def listed(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, env=env, capture_output=True, text=True)
    return done.returncode, done.stdout.split(), done.stderr


def test_all_other_queries_stay_without_the_subpackage(tmp_path):
    here = tmp_path / "repo"
    skip = shutil.ignore_patterns("llm", "__pycache__", ".git", "corpus_pipeline.py")
    shutil.copytree(ROOT, here, ignore=skip)
    code, names, _ = listed(here)
    assert code == 0 and int(names[0]) == len(names) - 1 > 80
    assert not any(n.startswith("op") and "_" in n and n[2].isdigit() or n == "pipeline" for n in names)


def test_errors_inside_the_subpackage_are_not_hidden(tmp_path):
    here = tmp_path / "repo"
    shutil.copytree(ROOT, here, ignore=shutil.ignore_patterns("llm", "__pycache__", ".git", "corpus_pipeline.py"))
    (here / "defectloom" / "llm").mkdir()
    (here / "defectloom" / "llm" / "__init__.py").write_text("")
    (here / "defectloom" / "llm" / "queries.py").write_text("import no_such_module\n")
    (here / "defectloom" / "llm" / "oracle.py").write_text("ORACLE = {}\n")
    code, _, said = listed(here)
    assert code != 0 and "no_such_module" in said
