"""The driver contract."""

import __spark_entry__ as entry


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert df.columns == ["y", "x", "n", "mean_amp", "da"] and df.count() == 500
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_raster_library_does_not_need_the_training_data_part():
    import subprocess
    import sys

    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('pixelweave.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name.split('.llm')[0] + '.llm' if '.llm' in name else name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries()), list(e.queries())\n"
    )
    import os

    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
