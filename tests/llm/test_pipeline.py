import os
import subprocess
import sys

import corpus_pipeline
from poolweave.llm import queries

from .helpers import DOCS, FOLDER, documents, prose
from .test_suffix_dedup import brute
from .test_tokens import check_pieces


def test_every_dealt_query_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {q.split("_")[0] + "_" for q in names if q.startswith("op")}
    assert "pipeline" in names and set(queries.SQL) <= set(queries.QUERIES)
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = [(10_000, None), (10_001, "12 34"), (10_002, "kept " + prose(50, 1)), (10_003, "kept " + prose(50, 1)), (10_004, prose(60, 2) + " x"), (10_005, prose(60, 2) + " y")]
    now = docs.unionByName(documents(spark, extra))
    before = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, FOLDER).cache()
        assert out.columns == docs.columns
        before[name] = ({r.doc_id: r.text for r in now.collect()}, {r.doc_id: r.text for r in out.collect()})
        assert set(before[name][1]) <= set(before[name][0])
        now = out
    gone = {k: set(a) - set(b) for k, (a, b) in before.items()}
    assert {10_000, 10_001} <= gone["language"] and 10_002 not in gone["language"]
    assert 10_003 in gone["exact"] and 10_002 in before["exact"][1]
    for name in ("exact", "near"):
        assert all(before[name][0][i] == t for i, t in before[name][1].items())
    assert not gone["repeats"]
    a, b = before["repeats"]
    want = {r[0]: r for r in brute(list(a.items()))}
    assert all(len(a[i].encode()) - want[i][2] >= len(b[i].encode()) >= len(a[i].encode()) - want[i][2] - 8 * (1 + want[i][3]) for i in a)
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, FOLDER).collect()
    assert check_pieces(pieces, list(b.items())) < 0.5


def test_empty_documents(spark):
    now = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, FOLDER)
    assert now.count() == 0


def test_the_rest_imports_without_this_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in ("__spark_entry__.py", "poolweave"):
        os.symlink(f"{root}/{name}", tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "poolweave").mkdir()
    for name in os.listdir(f"{root}/poolweave"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/poolweave/{name}", tmp_path / "poolweave" / name)
    code = "import runpy; m = runpy.run_path('__spark_entry__.py'); q = m['queries'](); assert q and not [x for x in q if x.startswith('op') and x[2].isdigit()] and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
