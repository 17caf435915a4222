"""Every query against its SQL, and what holds whatever the data."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n != "pipeline" and not (n.startswith("op") and n[2].isdigit())]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(str([float(r[k]) if isinstance(r[k], (int, float)) and not isinstance(r[k], bool) else r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    want = got.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert plain(map(tuple, df.collect()), df.columns) == plain(want, names)
    assert want


def test_entry(spark):
    total = entry.entry(spark).where("scope = 'TOTAL'").first()
    assert total.tp > 0 and total.tp + total.fn == 6000


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("missing", [["llm"], ["llm", "pipeline"]])
def test_imports_without_the_language_operators(tmp_path, missing):
    repo = Path(entry.__file__).parent
    for p in repo.iterdir():
        if p.name not in (".git", "wireloom", "corpus_pipeline.py", "__pycache__") or p.name == "corpus_pipeline.py" and "pipeline" not in missing:
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "wireloom").mkdir()
    for p in (repo / "wireloom").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "wireloom" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[0]) == len(NAMES)
