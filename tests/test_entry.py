"""The entry without its optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries()))"


def listed(folder):
    done = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, check=True)
    return tuple(map(int, done.stdout.split()))


def copied(tmp_path, *without):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda d, names: [
        n for n in names if n in (".git", "__pycache__") or str(Path(d, n).relative_to(ROOT)) in without])
    return tmp_path / "copy"


def test_core_queries_without_the_text_operators(tmp_path):
    core, text = listed(copied(tmp_path, "boxloom/llm", "tests/llm"))
    assert core >= 104 and text == 0


def test_core_queries_without_text_operators_and_pipeline(tmp_path):
    core, text = listed(copied(tmp_path, "boxloom/llm", "tests/llm", "corpus_pipeline.py"))
    assert core >= 104 and text == 0
