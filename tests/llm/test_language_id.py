import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortexlake.llm import language_id as L

from tests.llm.helpers import documents, none_of, odd_documents


@pytest.mark.parametrize("seed", range(4))
def test_decoding_is_the_best_of_all_paths(seed):
    r = np.random.default_rng(seed)
    size = [5, 0, 1, 7, 2]
    first = np.concatenate([[0], np.cumsum(size)])
    scores = r.normal(0, 12, (sum(size), 3)).astype(np.float32)
    got = L.decode(scores, first)
    value = lambda e, path: sum(e[i, k] for i, k in enumerate(path)) - L.SWITCH * sum(a != b for a, b in zip(path, path[1:]))
    for a, b in zip(first, first[1:]):
        best = max((value(scores[a:b], p) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert abs(value(scores[a:b], got[a:b]) - best) < 1e-3


def test_held_out_documents(spark):
    d = documents(spark)
    rows = L.language_id(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_spans_of_mixed_text_and_scripts(spark):
    d = documents(spark)
    by = {r.lang: r.text for r in d.filter("length(text) between 1500 and 4000").groupBy("lang").agg(F.max("text").alias("text")).collect()}
    a, b = by["en"].split()[:120], by["fr"].split()[:80]
    rows = [(10**6, " ".join(a + b), None), (10**6 + 1, "это просто русский текст для проверки " * 20, "ru"), (10**6 + 3, "русский текст", "ru"), (10**6 + 4, "ещё русский текст", "ru"), (10**6 + 5, "ещё один русский текст", "ru")]
    every = d.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in L.language_id(every).filter("doc_id >= 1000000").collect()}
    spans = [x.split(":") for x in got[10**6].spans.split(",")]
    assert got[10**6].lang_pred == "en" and spans[0][0] == "en" and spans[-1][0] == "fr" and abs(int(spans[-1][1]) - 120) <= 3
    assert got[10**6 + 1].lang_pred == "ru"


def test_odd_rows_and_nothing(spark):
    got = L.language_id(odd_documents(spark)).collect()
    assert len(got) == odd_documents(spark).count()
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (0, 1, 2, 9)} == {("und", 0.0)}
    assert L.language_id(none_of(documents(spark))).count() == 0
    unlabelled = documents(spark).limit(3).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.language_id(unlabelled).collect()} == {"und"}
