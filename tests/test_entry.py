"""The driver contract, with and without the subpackage on training data."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert {"qid", "doc_id", "rrf", "rank"} == set(__spark_entry__.entry(spark).columns)


def test_stands_without_training_data_operators(tmp_path):
    for name in ("quillframe", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op')] and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_real_import_errors_show(tmp_path):
    for name in ("quillframe", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / name)
    (tmp_path / "corpus_pipeline.py").write_text("import nothing_of_this_name\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert "nothing_of_this_name" in run.stderr


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "quillframe").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "quillframe.llm" not in path.read_text()
