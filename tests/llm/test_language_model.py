import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cortexlake.llm import language_model
from cortexlake.llm.bytetext import chunks
from cortexlake.llm.language_model import _seat, score_texts
from cortexlake.llm.pair_blocks import CODE, cut, mixed, packed_steps, parts, unpacked_steps
from cortexlake.llm.spelling import END, SPACE, spell

from tests.llm.helpers import WORD, documents, none_of, odd_documents


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_spelling_round_trip():
    import pyarrow as pa

    texts = ["  Ab  c\n", None, "", "é x", "z"]
    (c,) = chunks(pa.array(texts))
    s = spell(c, 3)
    for i, t in enumerate(texts):
        got = s.symbols[s.text_at[i] : s.text_at[i + 1]].tolist()
        want = [END] * 3 + [x for w in re.findall(WORD, low(t)) for x in [*w.encode(), SPACE]] + [END]
        assert got == want
    assert s.scored().sum() == len(s.symbols) - 15


def seatings(customers):
    """Every way to seat so many customers, as the tables' sizes."""
    if not customers:
        yield []
        return
    for sizes in seatings(customers - 1):
        yield [*sizes, 1]
        for k in range(len(sizes)):
            yield [*sizes[:k], sizes[k] + 1, *sizes[k + 1 :]]


def test_table_counts_follow_their_conditional():
    r = np.random.default_rng(1)
    customers, new, d = 6, 0.7, 0.4
    got = _seat(np.full(40000, customers), np.full(40000, new), d, r)
    odds = Counter()
    for sizes in seatings(customers):
        odds[len(sizes)] += new ** len(sizes) * math.prod(k - d for n in sizes for k in range(1, n))
    assert all(abs((got == t).mean() - p / sum(odds.values())) < 0.02 for t, p in odds.items())
    big = _seat(np.array([0, 1, 2, 10**9]), np.full(4, 50.0), d, r)
    assert big[0] == 0 and big[1] == 1 and 1 <= big[2] <= 2 and 1 < big[3] < 10**9


def test_pairs_in_blocks_round_trip():
    r = np.random.default_rng(0)
    first, second = r.integers(0, 1 << CODE, 1000), r.integers(0, 1 << CODE, 1000)
    x = mixed(first, second)
    assert [v.tolist() for v in parts(x)] == [first.tolist(), second.tolist()]
    x = np.unique(x)
    got = [(k, unpacked_steps(packed_steps(x[s]), s.stop - s.start)) for k, s in cut(x, 7)]
    assert np.array_equal(np.concatenate([v for _, v in got]), x) and [k for k, _ in got] == list(range(7))


@pytest.mark.parametrize("frequent", [60, 1 << 18])
def test_all_pairs_are_counted_and_probabilities_sum_to_one_in_each_context(spark, monkeypatch, frequent):
    monkeypatch.setattr(language_model, "FREQUENT", frequent)
    monkeypatch.setattr(language_model, "PER_BUCKET", 4000)
    train = documents(spark).limit(80).select("doc_id", "text").cache()
    words = language_model.word_counts(train).cache()
    texts = [re.findall(WORD, low(r.text)) for r in train.collect()]
    total = sum(len(t) + 1 for t in texts)
    model, rare, pairs, _ = language_model.fit(train, words, len(texts), words.count() + 1, total)
    hot = model.hot
    assert 0 < len(hot.h) <= frequent
    gains = language_model.pair_gains(pairs, model).toPandas()
    before, dish = parts(gains["pair"].to_numpy(np.uint64))
    common = Counter(x for t in texts for x in t)
    least = int(hot.count.min())
    code = lambda x: x if x is None or common[x] >= least else "others"
    want = Counter((code(u), code(w)) for t in texts for u, w in zip([None, *t], [*t, None]))
    assert sorted(gains["n"]) == sorted(want.values()) and gains["n"].sum() == total
    others = rare.selectExpr("coalesce(sum(pow(10, p)), 0) AS s").first().s + 10**model.unknown_log
    p = np.append(10 ** model.word_log[:-1], others)
    for context in range(len(hot.h) + 2):
        gain = np.zeros(len(p))
        gain[dish[before == context]] = gains["gain"].to_numpy()[before == context]
        assert abs((p * 10 ** (gain + model.back_log[context])).sum() - 1) < 1e-5


def test_scores_are_the_sum_over_all_pairs_of_a_text(spark, monkeypatch):
    """However few pairs are broadcast, and however many buckets there are, a text's score is the same."""
    d = documents(spark).limit(60).cache()
    scores = []
    for hot, per_bucket in ((1 << 18, 1 << 21), (5, 1 << 21)):
        monkeypatch.setattr(language_model, "HOT", hot)
        monkeypatch.setattr(language_model, "PER_BUCKET", per_bucket)
        scores.append(sorted((r.doc_id, r.score) for r in score_texts(d).collect()))
    assert np.allclose(np.array(scores[0]), np.array(scores[1]), rtol=1e-6)


def test_words_in_a_known_order_are_likelier(spark):
    words = [f"w{i}" for i in range(40)]
    r = np.random.default_rng(3)
    rows = [(i, " ".join(words)) for i in range(60)] + [(1000 + i, " ".join(r.permutation(words))) for i in range(60)]
    got = {x.doc_id: x for x in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = [k for k, x in got.items() if x.held_out]
    assert min(got[k].score for k in held if k < 1000) > max(got[k].score for k in held if k >= 1000) + 10


def check_base(df, scored):
    rows = [(r.doc_id, re.findall(WORD, low(r.text))) for r in df.collect()]
    mod = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10
    c = Counter(x for d, w in rows if mod(d) for x in [*w, None])
    n, v = sum(c.values()), len(c)
    want = []
    for d, w in rows:
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None])
        want.append((d, mod(d) == 0, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, round(base, 4)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in scored]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_base_columns_and_held_out_texts_become_likelier(spark):
    d = documents(spark)
    rows = score_texts(d).collect()
    check_base(d, rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score <= 0 for r in rows)


def test_odd_rows_and_nothing(spark):
    rows = score_texts(odd_documents(spark)).collect()
    check_base(odd_documents(spark), rows)
    assert score_texts(none_of(documents(spark))).count() == 0
    alone = spark.createDataFrame([(None, "Only held out")], "doc_id long, text string")
    (r,) = score_texts(alone).collect()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == 0


def test_words_beyond_the_frequent_ones_have_contexts_and_dishes_of_their_own(spark, monkeypatch):
    """However few words are broadcast, and however many blocks the others lie in, a text's score is the same."""
    d = documents(spark).limit(60).cache()
    scores = []
    for frequent, per_rare in ((1 << 18, 1 << 19), (40, 500), (40, 1 << 19), (0, 2000)):
        monkeypatch.setattr(language_model, "FREQUENT", frequent)
        monkeypatch.setattr(language_model, "PER_RARE", per_rare, raising=False)
        scores.append(sorted((r.doc_id, r.score, r.base_score, r.n_known) for r in score_texts(d).collect()))
    for other in scores[1:]:
        assert np.allclose(np.array(scores[0]), np.array(other), rtol=1e-6)
