"""The pipeline against a plain version of each stage's rule, over small tables."""

import hashlib
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path
from unittest.mock import MagicMock

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folium.llm import bpe, common, pii, toxicity
from folium.llm.queries import queries, vocabulary

from .test_documents import near_copies, plain_components


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(4)
    texts = list(near_copies(8, 150).values())
    texts = [t + (" you idiot moron" if i % 7 == 0 else "") + (" mail bob.smith@ex.com" if i % 5 == 0 else "") for i, t in enumerate(texts)] + [None, ""]
    docs = spark.createDataFrame([(i, t, r.choice(["en", "fr", None]), f"s{i % 4}", len(t or ""), i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, tokens long")
    folder = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 == 0 and i < 150), 1) for i in range(152)], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, tables):
    docs = common.table(spark, tables, "documents")
    columns, outputs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.written(stage(spark, docs, tables), name)
        outputs.append((name, before, docs))
    assert [n for n, _, _ in outputs] == ["toxicity", "near_duplicates", "pii", "mixing", "bpe"]
    assert all(after.columns == columns for _, _, after in outputs[:-1])
    ids = [{x.doc_id: x.text for x in after.collect()} for _, _, after in outputs]
    start = {x.doc_id: x.text for x in outputs[0][1].collect()}
    assert not [i for i in ids[0] if i % 7 == 0 and i < 150] and len(ids[0]) >= 120
    groups = plain_components(ids[0])
    assert set(ids[1]) == {i for i in ids[0] if groups[i][1] == i}
    assert set(ids[2]) == set(ids[1]) and not [t for t in ids[2].values() if t and "@" in t]
    size = lambda t: len((t or "").split())
    kept, all_ = sum(size(t) for t in ids[3].values()), sum(size(t) for t in ids[2].values())
    assert set(ids[3]) <= set(ids[2]) and 0.6 * all_ <= kept <= 0.9 * all_ and all(ids[2][i] == t for i, t in ids[3].items())
    own = bpe.RankBpe(vocabulary())
    for x in outputs[4][2].collect():
        assert x.n_tokens == len(x.input_ids) == len(own.encode(x.text)) // 4 and x.decoded == own.decode(x.input_ids)
    assert start[0].endswith("bob.smith@ex.com")


def test_mix_meets_the_weights_of_a_skewed_corpus(spark, tables, caplog):
    caplog.set_level("INFO", logger="folium.llm.mixing")
    names = {}
    for i in range(200):
        names.setdefault(int(hashlib.md5(f"s{i}".encode()).hexdigest()[0], 16) % 4, f"s{i}")
    sizes = {0: 20, 1: 60, 2: 800, 3: 120}
    rows = [(f"{d}-{i}", "w " * 20, "en", names[d]) for d, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame([(k, *x[1:], x[0]) for k, x in enumerate(rows)], "doc_id long, text string, lang string, source string, name string")
    got = corpus_pipeline.mix(spark, docs, tables).collect()
    share = [sum(x.source == names[d] for x in got) / len(got) for d in range(4)]
    assert all(abs(a - b) < 0.01 for a, b in zip(share, (0.4, 0.3, 0.2, 0.1))) and 880 <= len(got) <= 900
    assert max(Counter(x.doc_id for x in got).values()) == 18
    assert "domain d0 has 0.4000 of the tokens, target 0.4000" in caplog.text


def test_run_and_names(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    assert got.count() > 0 and "input_ids" in got.columns
    names = [n.split("_")[0] for n in queries()]
    assert sorted(names) == sorted(f"op{k}" for k in range(1, 11))


def test_stages_of_empty_documents(spark, tables):
    docs = common.table(spark, tables, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, tables), "empty")
        assert docs.count() == 0


def test_pii_sanitises_what_it_finds(spark, tables):
    docs = common.table(spark, tables, "documents")
    clean = pii.sanitise(docs)
    assert pii.personal_data(clean).agg(F.sum("n_email")).head()[0] == 0
    assert toxicity.held_out().alias("x") is not None


def test_stages_of_odd_documents(spark, tables):
    long = " ".join(f"w{k % 999}x{k}" for k in range(40_000))
    texts = [None, "", " \n", long, "a tie of two rows", "a tie of two rows", "you idiot moron", "mail bob.smith@ex.com now"]
    rows = [(1000 + i, t, "en", "s1", 0) for i, t in enumerate(texts)] + [(1004, texts[4], "en", "s1", 0), (1009, "one text", None, None, 0), (1009, "quite another text", None, None, 0), (None, "no id", "en", "s1", 0), (None, "no id", "en", "s1", 0)]
    names = ("part", "row", "tie", "order_key", "copy", "toxicity", "near_copy_of_another", "repeated_doc_id", "revealing_terms", "epoch", "tokens", "h", "of")
    docs = spark.createDataFrame([(*x, *[f"{n}{k}" for n in names]) for k, x in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.written(stage(spark, docs, tables), name)
        assert [c for c in docs.columns if c in before.columns] == before.columns
        got = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
        if name == "near_duplicates":
            assert got.count((1004, texts[4])) == 1 and (1005, texts[5]) not in got and {x for x in got if x[0] == 1009} == {(1009, "one text"), (1009, "quite another text")} and got.count((None, "no id")) == 2
            assert sum(t == long for _, t in got) == 1 and {i for i, _ in got} == {1000, 1001, 1002, 1003, 1004, 1006, 1007, 1009, None}
    assert docs.count() > 0 and {x.h for x in docs.select("h").collect()} <= {f"h{k}" for k in range(len(rows))}


KEPT = """
import random, sys
import pyarrow as pa
from pyspark.sql import SparkSession
from folium.llm import common, jaccard, pii

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
words = spark.range(0, 4000, 1, 1).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(1, 900), k -> concat('w', pmod(xxhash64(id, k), 50000)))) text")
words.write.mode("overwrite").parquet(sys.argv[1])
docs = common.prepare(spark).read.parquet(sys.argv[1]).coalesce(1)

def kept():
    def run(batches):
        for batch in batches:
            with open("/proc/self/smaps_rollup") as f:
                yield pa.RecordBatch.from_pydict({"kb": pa.array([int(x.split()[1]) for x in f if x.startswith("Pss_Anon")], pa.int64())})
    return spark.range(0, 1, 1, 1).mapInArrow(run, "kb long").head()[0] // 1024

for f in (lambda d: jaccard.profile(d, 75), pii.scan):
    f(docs.limit(1)).write.format("noop").mode("overwrite").save()
before = kept()
for f in (lambda d: jaccard.profile(d, 75), pii.scan):
    f(docs).write.format("noop").mode("overwrite").save()
    print("KEPT", before, kept(), flush=True)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_idle_workers_keep_little_of_a_stage(tmp_path):
    """A local session of one core has one Python worker; after a stage it holds little more than before."""
    said = subprocess.run([sys.executable, "-c", KEPT, str(tmp_path / "docs")], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=300)
    found = [[int(x) for x in line.split()[1:]] for line in said.stdout.splitlines() if line.startswith("KEPT")]
    assert len(found) == 2, said.stderr[-2000:]
    assert all(after - before <= 30 for before, after in found), found


@pytest.mark.parametrize("grown", [False, True])
def test_driver_gives_its_heap_back(grown):
    """A heap that has grown beyond half of its limit is asked to shrink, but not at every look; what malloc keeps goes either way."""
    spark = MagicMock()
    runtime = spark._jvm.java.lang.Runtime.getRuntime.return_value
    runtime.maxMemory.return_value, runtime.totalMemory.return_value = 750, 400 if grown else 300
    invoke = spark._jvm.java.lang.Class.forName.return_value.getMethod.return_value.invoke
    common.tidy(spark, 0)
    common.tidy(spark, 1e9)
    assert spark._jvm.java.lang.System.gc.call_count == grown and invoke.call_count == 1
