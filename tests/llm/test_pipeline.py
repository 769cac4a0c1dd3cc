"""Pipeline and helpers: every stage against brute force on whole small tables."""

import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kairos.llm import quality, sharding
from kairos.llm.common import connected_components, table
from tests.conftest import SF001
from tests.llm import brute


@pytest.mark.parametrize("shape", ["chain", "hub", "random"])
def test_components(spark, shape):
    rnd = random.Random(9)
    edges = {"chain": [(i, i + 1) for i in range(60)], "hub": [(100, i) for i in range(50)],
             "random": [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)]}[shape]
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    want = brute.components(sorted(nodes), lambda a, b: (a, b) in edges or (b, a) in edges)
    low = {}
    for n, r in want.items():
        low[r] = min(n, low.get(r, n))
    got = connected_components(spark.createDataFrame([*edges, (7, 7)], "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {n: low[r] for n, r in want.items()} and len(got) == len(nodes)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline_equals_brute_force(spark):
    docs = {r.doc_id: r for r in table(spark, SF001, "documents").collect()}
    items = [tuple(r) for r in table(spark, SF001, "benchmark", "item_id", "text").collect()]
    # the robust verdict has its own tests; everything after it is recomputed
    kept = sorted(r.doc_id for r in quality.judge(table(spark, SF001, "documents")).where("kept").collect())
    for i in docs:
        n, *_, repeats = brute.statistics(docs[i].text)
        assert i not in kept or (n >= 50 and 100 * repeats <= 50 * n)
    comp = brute.simhash([(i, docs[i].text) for i in kept])
    kept = [i for i in kept if comp[i][1] == i]
    bad = {c[0] for c in brute.contained([(i, docs[i].text) for i in kept], items)}
    kept = [i for i in kept if i not in bad]
    out = corpus_pipeline.run(spark, SF001).collect()
    copies = {}
    for r in out:
        assert tuple(r[c] for c in ("text", "lang", "source", "n_chars")) == tuple(
            docs[r.doc_id][c] for c in ("text", "lang", "source", "n_chars"))
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= set(kept) and max(copies.values()) <= 2
    size = {i: len(brute.WORD.findall(docs[i].text or "")) for i in kept}
    taken = sum(size[i] * n for i, n in copies.items())
    assert taken == pytest.approx(1.5 * sum(size.values()), rel=0.1)
    slots = sharding.lookup_table()
    assert all(r.shard == sharding.SHARDS[slots[r.slot]] for r in out)


def test_stages_return_the_columns_of_documents(spark):
    docs = table(spark, SF001, "documents").limit(40)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF001).dtypes == docs.dtypes, name


def test_mix_of_a_table_without_source_words(spark):
    docs = table(spark, SF001, "documents").withColumn("text", F.lit(None).cast("string"))
    assert corpus_pipeline.source_mix(spark, docs, SF001).count() == 0


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    names = [".".join(f.relative_to(root).with_suffix("").parts).removesuffix(".__init__")
             for f in (root / "kairos").rglob("*.py") if "llm" not in f.parts]
    code = (f"import sys, importlib\nfor m in {names!r}: importlib.import_module(m)\n"
            "sys.exit(any(m.startswith('kairos.llm') for m in sys.modules))")
    assert len(names) > 20 and subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
