"""The registry works with and without the subpackage for training text."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark, monkeypatch):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 12
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_llm(tmp_path):
    for name in ("quire", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    copy = tmp_path / "quire"
    copy.mkdir()
    for p in (ROOT / "quire").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (copy / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
