import random
import re

import numpy as np
import pytest

from cortexlake.llm import set_join
from cortexlake.llm.set_join import similar_documents
from cortexlake.llm.signature_tree import alike, signatures

from tests.llm.helpers import WORD, documents, none_of, odd_documents


def brute(rows, words=4, percent=85):
    sets = []
    for _, text in rows:
        w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * min(len(sets[i]), len(sets[j])) >= percent * max(len(sets[i]), len(sets[j])):
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(top(i), []).append(d)
    ids = [min((x for x in least[top(i)] if x is not None), default=None) for i in range(len(rows))]
    return sorted(((d, len(sets[i]), ids[i]) for i, (d, _) in enumerate(rows)), key=str)


def check(df, **how):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted(map(tuple, similar_documents(df, **how).collect()), key=str)
    assert got == brute(rows, **how)
    return got


def crowd(n, r, base=90, edits=(0, 1, 2, 3)):
    rows, words = [], [f"w{i}" for i in range(base)]
    for k in range(n):
        mine = [*words]
        for _ in range(r.choice(edits)):
            mine[r.randrange(base)] = f"n{r.randrange(60)}"
        rows.append((k, " ".join(mine)))
    return rows


def test_documents_match_brute_force(spark):
    check(documents(spark))
    check(documents(spark), words=5, percent=80)


def test_odd_rows_and_nothing(spark):
    check(odd_documents(spark))
    assert similar_documents(none_of(documents(spark))).count() == 0


@pytest.mark.parametrize("edits", [(0, 1, 2, 3), (2, 3, 4), (3,)])
def test_crowd_in_small_blocks(spark, monkeypatch, edits):
    """Sets about the limit, in groups that are cut, with shingles that are dealt out by the set's number."""
    monkeypatch.setattr(set_join, "BLOCK", 16)
    monkeypatch.setattr(set_join, "TOGETHER", 50)
    rows = crowd(300, random.Random(len(edits)), edits=edits) + [(1000 + k, f"text of its own number {k} and some more words {k}") for k in range(50)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_common_line_links_nobody(spark):
    r = random.Random(1)
    line = " ".join(f"common{i}" for i in range(30))
    rows = [(k, line + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(40))) for k in range(200)] + [(k, line) for k in range(200, 240)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_trees_lose_no_pair_that_links():
    r = np.random.default_rng(5)
    pool = [np.unique(r.integers(1, 1 << 62, n, dtype=np.uint64)) for n in (3, 40, 400, 4000)]
    sets = [np.sort(r.choice(p, max(1, int(len(p) * r.uniform(0.8, 1))), replace=False)) for p in pool for _ in range(40)]
    tree = np.sort(r.integers(0, 3, len(sets)))
    r.shuffle(sets)
    meet = [(0, 0), (1, 2)]
    got = set(map(frozenset, zip(*(v.tolist() for v in alike(signatures(sets), np.array([len(s) for s in sets]), np.array([s[0] for s in sets]), tree, meet, 85)))))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 185 * both >= 85 * (len(sets[i]) + len(sets[j])) and (tree[j], tree[i]) in meet:
                assert frozenset((i, j)) in got
    assert len(got) < len(sets) ** 2 / 8
