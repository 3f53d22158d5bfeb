"""The entry point works with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def names(folder):
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), sum(x.startswith('op') for x in e.queries()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-500:]
    return done.stdout.split()


@pytest.mark.parametrize("gone", [("lucidtext/llm", "tests/llm", "corpus_pipeline.py"), ("lucidtext/llm", "tests/llm"), ()])
def test_entry_without_corpus_operators(tmp_path, gone):
    for name in ("lucidtext", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.exists():
            (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    for name in gone:
        target = tmp_path / name
        if target.is_dir():
            shutil.rmtree(target)
        else:
            target.unlink(missing_ok=True)
    got = names(tmp_path)
    here = not gone and (ROOT / "lucidtext/llm").exists() and (ROOT / "corpus_pipeline.py").exists()
    assert got[2:] == (["True", "13"] if here else ["False", "0"])
    assert int(got[1]) > 100


def test_broken_modules_are_not_hidden(tmp_path):
    shutil.copytree(ROOT / "lucidtext", tmp_path / "lucidtext")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "lucidtext/llm").mkdir(exist_ok=True)
    (tmp_path / "lucidtext/llm/__init__.py").touch()
    (tmp_path / "lucidtext/llm/queries.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode and "no_such_module" in done.stderr
