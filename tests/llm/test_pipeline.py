import os

import corpus_pipeline
from cortexlake.llm import scratch
from cortexlake.llm.decontamination import contaminated
from cortexlake.llm.near_dup import near_duplicates
from cortexlake.llm.quality_rules import quality_rules
from cortexlake.llm.secret_scan import secret_scan

from tests.llm.helpers import DATA, documents, none_of, odd_documents


def test_each_stage_does_what_its_operator_says(spark):
    docs, kept = documents(spark), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, DATA).cache()
        assert docs.columns == documents(spark).columns
        kept[name] = ({r.doc_id for r in before.collect()}, {r.doc_id for r in docs.collect()}, before)
    ids = lambda df: {r.doc_id for r in df.collect()}
    before, after, df = kept["quality_rules"]
    assert after == ids(quality_rules(df).filter("kept")) and after < before
    before, after, df = kept["near_duplicates"]
    assert after == ids(near_duplicates(df).filter("kept")) and after < before
    before, after, df = kept["decontamination"]
    assert before - after == ids(contaminated(df, spark.read.parquet(f"{DATA}/benchmark.parquet"))) and after
    before, after, df = kept["secret_scan"]
    assert before == after
    assert secret_scan(docs).agg({"n_access": "sum"}).first()[0] == 0


def test_run_packs_what_is_left(spark):
    out = corpus_pipeline.run(spark, DATA).collect()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in documents(spark).collect()}
    filled = {}
    for r in out:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 1024


def test_odd_rows_and_nothing(spark):
    """Nulls, repeated rows and ids, empty and very long texts go through every stage; so does an empty table."""
    long = spark.createDataFrame([(70, " ".join(f"w{k}" for k in range(300)), "en", "s", 7, "x")] * 3 + [(None, " ".join(f"v{k}" for k in range(90)), None, None, None, None)], odd_documents(spark).schema)
    for docs, left in ((odd_documents(spark).unionByName(long), 2), (none_of(documents(spark)), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DATA).cache()
        assert docs.count() == left and corpus_pipeline.STAGES[-1][1](spark, docs, DATA).filter("piece = 0").count() == left


def test_tables_of_a_session_can_be_removed(spark):
    table = scratch.written(spark.range(3), "removed")
    (path,) = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    assert table.count() == 3
    scratch.clear(spark)
    assert not os.path.exists(path.removeprefix("file:").replace("///", "/"))
