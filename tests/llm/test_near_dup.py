import random
import re

from cortexlake.llm.near_dup import near_duplicates, one_of_each

from tests.llm.helpers import WORD, documents, none_of, odd_documents


def brute(rows, percent):
    sets = []
    for _, text in rows:
        w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(top(i), []).append(d)
    ids = [min((x for x in least[top(i)] if x is not None), default=None) for i in range(len(rows))]
    return sorted(((d, len(sets[i]), ids[i], d == ids[i]) for i, (d, _) in enumerate(rows)), key=str)


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    for percent in (80, 85):
        assert sorted(map(tuple, near_duplicates(df, percent).collect()), key=str) == brute(rows, percent)


def test_documents_match_brute_force(spark):
    check(documents(spark))


def test_odd_rows_and_nothing(spark):
    check(odd_documents(spark))
    assert near_duplicates(none_of(documents(spark))).count() == 0


def test_chain_of_edits_is_one_component(spark):
    words = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(40):
        words = [*words]
        words[(k * 7) % 300] = f"n{k}"
        rows.append((k, " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_crowd_of_sets_about_the_limit(spark):
    r = random.Random(8)
    base, rows = [f"w{i}" for i in range(120)], []
    for k in range(500):
        words = [*base]
        for _ in range(r.choice((0, 1, 2, 3))):
            words[r.randrange(120)] = f"n{k}x{r.randrange(40)}"
        rows.append((k, " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_one_document_of_each_component_stays(spark):
    d = documents(spark)
    kept = {r.doc_id for r in near_duplicates(d).filter("kept").collect()}
    out = one_of_each(d)
    assert out.columns == d.columns and {r.doc_id for r in out.collect()} == kept


def test_rows_with_the_same_id_or_none_are_judged_one_by_one(spark):
    one, two, three, four = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(1, one), (None, one), (None, two), (None, three), (2, four), (2, four), (3, three + " more"), (3, "text of its own"), (None, None), (None, None)]
    out = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(1, one), (None, two), (2, four), (3, three + " more"), (3, "text of its own"), (None, None), (None, None)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_links_inside_a_crowd_below_the_limit(spark):
    """Every set has hundreds of neighbours just below the limit and at most one partner above it."""
    r = random.Random(11)
    base, rows = [f"w{i}" for i in range(400)], []
    for k in range(900):
        words = [*base]
        for _ in range(8):
            words[r.randrange(400)] = f"n{k}x{r.randrange(9)}"
        rows.append((k, " ".join(words)))
        if k % 20 == 0:
            words[r.randrange(400)] = f"p{k}"
            words[r.randrange(400)] = f"q{k}"
            rows.append((5000 + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, 85)
    assert sorted(map(tuple, near_duplicates(df, 85).collect()), key=str) == want and 45 <= sum(d != c for d, _, c, _ in want) < 300
