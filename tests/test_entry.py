"""The driver's entry points, with and without the corpus subpackage."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parents[1]


def test_every_query_has_sql_but_models():
    import __spark_entry__ as entry

    from panelwright import oracles, queries

    assert set(oracles.ORACLES) <= set(queries.QUERIES)
    assert {q for q in queries.QUERIES if q not in oracles.ORACLES} == {"local_model", "global_then_transfer_model"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_corpus_subpackage():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.split('.')[0] == 'corpus_pipeline' or name.startswith('panelwright.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'top_origins' in e.queries() and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
