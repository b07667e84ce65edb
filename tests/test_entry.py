import subprocess
import sys


def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 1 and rows[0].total_notes > 0


def test_the_rest_does_without_the_subpackage(tmp_path):
    """With the training-data folders gone the entry module still imports and keeps the other queries."""
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('quillspark.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'graph_health' in e.queries() and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries())\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
