"""The entry module with optional parts of the repository taken out."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e, registry.catalog as c; print(len(e.queries()) - len(c.QUERIES), set(c.QUERIES) <= set(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def _copy(to: Path, without: list[str]) -> Path:
    def left_out(folder: str, names: list[str]) -> list[str]:
        at = Path(folder).relative_to(ROOT)
        return [n for n in names if str(at / n) in without or n in ("__pycache__", ".git", ".pytest_cache")]

    shutil.copytree(ROOT, to, ignore=left_out)
    return to


def _python(folder: Path, *args: str) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-B", *args], cwd=folder, capture_output=True, text=True, timeout=300)


@pytest.mark.parametrize(
    "without",
    [["riskloom/llm", "tests/llm"], ["riskloom/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]],
    ids=["folders", "folders and pipeline", "pipeline"],
)
def test_import_without_optional_parts(tmp_path, without):
    if not (ROOT / "riskloom/llm").is_dir():
        pytest.skip("already taken out")
    copy = _copy(tmp_path / "copy", without)
    said = _python(copy, "-c", SAY)
    assert said.returncode == 0, said.stderr
    more, *held = said.stdout.split()
    assert held == ["True", "True"] and (int(more) == 0) == ("riskloom/llm" in without)
    if "riskloom/llm" in without:
        collected = _python(copy, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider")
        assert collected.returncode == 0, collected.stdout


def test_other_missing_modules_are_not_hidden(tmp_path):
    copy = _copy(tmp_path / "copy", ["riskloom/plans/lineage.py", "riskloom/llm", "tests/llm"])
    said = _python(copy, "-c", SAY)
    assert said.returncode != 0 and "riskloom.plans.lineage" in said.stderr
