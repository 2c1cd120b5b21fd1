"""The driver's contract, also where the training-data operators have been removed."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def _names(root: Path) -> set[str]:
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    return set(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True, timeout=120).stdout.split())


def test_whole_and_without_the_operators(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", "*.json")
    for n, gone in enumerate(((), ("quillon/llm", "tests/llm"), ("quillon/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",))):
        root = tmp_path / str(n)
        shutil.copytree(ROOT, root, ignore=skip)
        for x in gone:
            shutil.rmtree(root / x) if (root / x).is_dir() else (root / x).unlink(missing_ok=True)
        if gone:  # what Python left behind is no package
            (root / "quillon/llm/__pycache__").mkdir(parents=True, exist_ok=True)
        found = _names(root)
        assert "flagship" in found
        if (ROOT / "quillon/llm/queries.py").exists():
            assert ("op1_sharding" in found) == ("quillon/llm" not in gone)
            assert ("pipeline" in found) == (not gone)


def test_another_copy_on_the_path(tmp_path, monkeypatch):
    """What has been removed here isn't taken from elsewhere."""
    monkeypatch.setenv("PYTHONPATH", str(ROOT))
    root = tmp_path / "copy"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "corpus_pipeline.py"))
    found = _names(root)
    assert "flagship" in found and "pipeline" not in found
