"""The driver's contract, and that the core stands without the subpackage for texts of language models."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "p1_found" in queries
    assert entry.entry(spark).limit(1).count() == 1


def test_core_does_not_import_llm():
    own = [p for p in (ROOT / "millrace").rglob("*.py") if "llm" not in p.relative_to(ROOT / "millrace").parts]
    assert own and not any("millrace.llm" in p.read_text() for p in own)
    code = "import sys; sys.modules['millrace.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p6_ids' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
