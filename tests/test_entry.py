"""The driver's contract, with or without the text-preparation subpackage."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_works_without_the_subpackage(tmp_path):
    """The rest imports where the subpackage and the pipeline aren't there."""
    for p in REPO.iterdir():
        if p.name not in ("skerry", "corpus_pipeline.py", ".git", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "skerry").mkdir()
    for p in (REPO / "skerry").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "skerry" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e, sys; assert e.queries() and set(e.oracle_sql()) <= set(e.queries()); assert not any('llm' in m for m in sys.modules if m.startswith('skerry')); assert not any(n.startswith('op') and n[2:3].isdigit() for n in e.queries())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
