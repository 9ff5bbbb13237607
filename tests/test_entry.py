"""The driver contract, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 90 and all(callable(f) for f in q.values())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_imports_without_the_subpackage(tmp_path):
    for p in ("__spark_entry__.py", "tessera"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else None
    (tmp_path / "tessera").mkdir()
    for p in (ROOT / "tessera").iterdir():
        if p.name != "llm":
            (tmp_path / "tessera" / p.name).symlink_to(p)
    (tmp_path / "entry.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import entry; q = entry.queries(); assert len(q) > 80 and not any(n.startswith('op') and n[2].isdigit() for n in q), q"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=100)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_it():
    for p in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
