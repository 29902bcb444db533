"""The driver's contract, with and without the subpackage of corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def names(at):
    said = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=at, env={"PYTHONPATH": str(at), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    return [set(line.split()) for line in said.stdout.splitlines()[-2:]]


def copied(to, *left_out):
    for name in ("tallyloom", "__spark_entry__.py", "corpus_pipeline.py"):
        if name in left_out or not (ROOT / name).exists():
            continue
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, to / name, ignore=shutil.ignore_patterns("__pycache__", *left_out))
        else:
            shutil.copy(ROOT / name, to / name)
    return to


def test_every_oracle_has_a_query():
    queries, oracles = names(ROOT)
    assert oracles <= queries and len(queries) > 40


def test_entry_lives_without_the_corpus_operators(tmp_path):
    whole, whole_oracles = names(ROOT)
    own = {q for q in whole if not q.startswith("op") and q != "pipeline"}
    for k, left_out in enumerate((["llm"], ["llm", "corpus_pipeline.py"], ["corpus_pipeline.py"])):
        (tmp_path / str(k)).mkdir()
        queries, oracles = names(copied(tmp_path / str(k), *left_out))
        assert own <= queries <= whole and oracles == whole_oracles & queries
        assert "pipeline" not in queries and ("llm" not in left_out or queries == own)
