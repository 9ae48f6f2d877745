"""The catalog stands without the training-data package, and the package is not imported by the rest."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_training_data_package():
    for path in (ROOT / "lemmaforge").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"(from|import) lemmaforge\.llm", path.read_text()), path


def test_entry_without_the_training_data_package(tmp_path):
    for part in ("functions", "operators", "plans", "sources", "streaming"):
        (tmp_path / "lemmaforge" / part).mkdir(parents=True)
    for path in (ROOT / "lemmaforge").rglob("*.py"):
        where = path.relative_to(ROOT)
        if "llm" not in where.parts:
            (tmp_path / where).write_text(path.read_text())
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)
