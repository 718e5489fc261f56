import pathlib
import shutil
import subprocess
import sys


def test_stands_without_the_corpus_operators(tmp_path):
    """A copy without the corpus subpackage, its tests or the pipeline still has all other queries."""
    root = pathlib.Path(__file__).parent.parent
    skip = lambda d, names: [n for n in names if n in ("llm", ".git", "__pycache__")]
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 50 and s.keys() <= q.keys(); assert not [n for n in q if n.startswith('op') or n == 'pipeline']"
    for drop in (None, "corpus_pipeline.py"):
        if drop:
            (tmp_path / "copy" / drop).unlink()
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True)
