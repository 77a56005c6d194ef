"""The entry point works with and without the corpus subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCK = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("sparktab.llm") or name == "corpus_pipeline":
            raise ImportError(name)
sys.meta_path.insert(0, Block())
"""


def names(prefix: str = "") -> list[str]:
    code = prefix + "import __spark_entry__ as e\nprint(*e.queries())\nassert set(e.oracle_sql()) <= set(e.queries())"
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_the_corpus_subpackage():
    assert not [n for n in names(BLOCK) if n.startswith("op") or n == "pipeline"]


def test_entry_query(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
