"""The driver's contract holds with and without the optional parts."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def listed(before="pass"):
    code = f"import sys; {before}; import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(' '.join(q))"
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()


def test_library_queries_are_listed_without_the_optional_parts():
    every = listed()
    for missing in ("tiktoken", "skylark.llm", "corpus_pipeline"):
        left = listed(f"sys.modules['{missing}'] = None")
        assert set(left) <= set(every) and len(left) > 100 and "pipeline" not in left
        assert all(n in left for n in every if not n.startswith("op") and n != "pipeline")
