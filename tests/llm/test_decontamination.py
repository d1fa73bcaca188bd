import itertools
import random
import re

from pyspark.sql import functions as F

from cortexlake.llm import decontamination
from cortexlake.llm.decontamination import MASKS, PERCENT, RUN, SPAN, contaminated, decontaminate, seed_masks

from tests.llm.helpers import DATA, WORD, documents, none_of, odd_documents


def brute(docs, items):
    words = lambda t: re.findall(WORD, (t or "").lower())
    out = {}
    for d, text in docs:
        w = words(text)
        for i, other in items:
            v = words(other)
            for offset in range(-len(v), len(w)) if len(v) >= SPAN and len(w) >= SPAN else ():
                lo, hi = max(0, -offset), min(len(v), len(w) - offset)
                equal = [v[k] == w[k + offset] for k in range(lo, hi)]
                run = min(RUN, len(v))
                dense = any(sum(equal[k : k + run]) * 100 >= run * PERCENT for k in range(len(equal) - run + 1))
                if dense:
                    out[d, i] = max(out.get((d, i), (0,)), (sum(equal), -max(offset, 0), len(equal)))
    return sorted((d, i, -b, n, e) for (d, i), (e, b, n) in out.items())


def test_documents_match_brute_force(spark):
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    docs = documents(spark).filter("doc_id < 60").unionByName(documents(spark).join(contaminated(documents(spark), benchmark).select("doc_id").distinct(), "doc_id", "left_semi")).distinct()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in benchmark.select("item_id", "text").collect()])
    assert sorted(map(tuple, contaminated(docs, benchmark).collect())) == want and want


def test_substitutions_and_cuts(spark):
    r = random.Random(3)
    item = [f"w{r.randrange(500)}" for _ in range(45)]
    swap = [f"x{k}" if k % 7 == 3 else w for k, w in enumerate(item)]
    pad = [f"p{k}" for k in range(90)]
    texts = [item, pad + swap + pad, item[:25] + pad, pad + item[22:], pad + item[:15] + pad, [w if k % 2 else "z" for k, w in enumerate(item)], item[:11]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None)], "item_id long, text string")
    got = sorted(map(tuple, contaminated(docs, benchmark).collect()))
    assert got == brute([(k, " ".join(t)) for k, t in enumerate(texts)], [(7, " ".join(item))])
    assert [x[0] for x in got] == [0, 1, 2, 3]
    assert sorted(x.doc_id for x in decontaminate(docs, benchmark).collect()) == [4, 5, 6]


def test_odd_rows_and_nothing(spark):
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    odd = odd_documents(spark)
    assert contaminated(odd, benchmark).count() == 0
    assert decontaminate(odd, benchmark).columns == odd.columns and decontaminate(odd, benchmark).count() == odd.count()
    assert contaminated(none_of(documents(spark)), benchmark).count() == 0
    assert contaminated(documents(spark), none_of(benchmark)).count() == 0


def test_every_accepted_pattern_holds_a_seed():
    for size in range(1, RUN + 1):
        seeds = [{k + p for p in MASKS[m]} for m in seed_masks(size) for k in range(size - MASKS[m][-1])]
        for gone in itertools.combinations(range(size), size * (100 - PERCENT) // 100):
            assert any(seed.isdisjoint(gone) for seed in seeds)


def test_short_items_and_all_their_substitutions(spark):
    r = random.Random(4)
    items = {n: [f"w{n}v{k}" for k in range(n)] for n in (1, 3, 5, 6, 9, 10, 12, 13, 15, 16, 20)}
    texts, want = [], set()
    for n, item in items.items():
        patterns = [g for s in range(n // 5 + 2) for g in itertools.combinations(range(n), min(s, n))]
        for gone in r.sample(patterns, min(len(patterns), 150)):
            body = [f"x{k}" if k in gone else w for k, w in enumerate(item)]
            if (n - len(gone)) * 100 >= n * PERCENT:
                want.add((len(texts), n))
            texts.append(" ".join(["before"] * r.randrange(3) + body + ["after"] * r.randrange(3)))
    docs = spark.createDataFrame([*enumerate(texts), (-1, " \t"), (-2, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([*((n, " ".join(v)) for n, v in items.items()), (98, " "), (99, None)], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in contaminated(docs, benchmark).collect()} == want


def test_rows_with_the_same_id_or_none_are_judged_one_by_one(spark):
    item = " ".join(f"w{k}" for k in range(30))
    rows = [(None, item), (None, "a clean text"), (1, f"before {item}"), (1, "another clean text"), (None, None)]
    out = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_shuffled_seeds_find_the_same(spark, monkeypatch):
    docs, items = documents(spark), spark.read.parquet(f"{DATA}/benchmark.parquet")
    twice = docs.unionByName(docs.limit(20)).unionByName(docs.limit(20).withColumn("doc_id", F.lit(None).cast("long")))
    want = sorted(map(tuple, contaminated(twice, items).collect()), key=str)
    monkeypatch.setattr(decontamination, "BROADCAST_WORDS", 0)
    assert want and sorted(map(tuple, contaminated(twice, items).collect()), key=str) == want
