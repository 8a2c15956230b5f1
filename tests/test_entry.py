"""The entry module without the corpus folders, and with a broken one."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), len([n for n in q if n.startswith('op') and n[2:3].isdigit()]), 'pipeline' in q, set(s) <= set(q))"


def run(folder):
    return subprocess.run([sys.executable, "-B", "-c", CODE], cwd=folder, capture_output=True, text=True)


def test_with_and_without_the_corpus_folders(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    out = run(tmp_path / "repo")
    assert out.stdout.split()[1:] == ["0", "False", "True"], out.stderr
    broken = tmp_path / "repo/terracell/llm"
    broken.mkdir()
    (broken / "__init__.py").write_text("")
    (broken / "queries.py").write_text("import no_such_module_at_all\n")
    assert "no_such_module_at_all" in run(tmp_path / "repo").stderr
