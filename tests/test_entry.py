import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


@pytest.mark.parametrize("left_out", [(), ("corpus_pipeline.py",), ("paperloom/llm",), ("paperloom/llm", "corpus_pipeline.py")])
def test_entry_without_training_data(tmp_path, left_out):
    """The rest of the library must not need the subpackage or its pipeline."""
    from paperloom.plans.oracles import ORACLES
    from paperloom.plans.registry import QUERIES

    skip = {ROOT / name for name in left_out}
    shutil.copytree(
        ROOT / "paperloom",
        tmp_path / "paperloom",
        ignore=lambda folder, names: [n for n in names if Path(folder) / n in skip or n == "__pycache__"],
    )
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists() and ROOT / name not in skip:
            shutil.copy(ROOT / name, tmp_path)
    found = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert found.returncode == 0, found.stderr
    n_queries, n_oracles, pipeline = found.stdout.split()
    whole = (ROOT / "paperloom/llm").exists() and "paperloom/llm" not in left_out
    assert int(n_queries) > len(QUERIES) if whole else int(n_queries) == len(QUERIES)
    assert int(n_oracles) > len(ORACLES) if whole else int(n_oracles) == len(ORACLES)
    assert pipeline == str(whole and "corpus_pipeline.py" not in left_out and (ROOT / "corpus_pipeline.py").exists())
