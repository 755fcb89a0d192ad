"""The entry module with and without its optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_optional_parts(tmp_path):
    """The whole tree but for the two folders; corpus_pipeline.py may be there or not."""
    left_out = lambda folder, names: [n for n in names if n in (".git", "__pycache__") or (n == "llm" and Path(folder).name in ("melodyspark", "tests"))]
    shutil.copytree(ROOT, tmp_path / "repo", ignore=left_out)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'melody_transcription' in q and 'pipeline' not in q; assert not [x for x in q if x.startswith('op')]; e.oracle_sql()"
    for _ in range(2):
        subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", env={"PATH": "/usr/bin:/bin"}, check=True)
        (tmp_path / "repo" / "corpus_pipeline.py").unlink(missing_ok=True)


def test_nothing_else_imports_the_optional_parts():
    for path in (ROOT / "melodyspark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "melodyspark").parts:
            text = path.read_text()
            assert "melodyspark.llm" not in text and "corpus_pipeline" not in text, path
