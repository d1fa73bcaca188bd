import hashlib
import zlib

import duckdb

from cortexlake.llm.merkle import manifest, oracle

from tests.llm.helpers import DATA, documents, none_of, odd_documents


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def collapsed(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = i // 8 * 8
        out.append((nodes[run:i], nodes[i + 1 : run + 8]))
        i //= 8
    return out


def brute(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        fixed = [field(r[x]) for x in ("doc_id", "source", "lang", "n_chars")]
        leaf = changed = digest(*fixed, field(r["text"]))
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
            changed = digest(*fixed, field(r["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])))
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, changed))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [collapsed([x[2] for x in sorted(groups[g])]) for g in order]
    top = collapsed([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(order):
        for i, (known, doc_id, leaf, changed) in enumerate(sorted(groups[g])):
            path, h = siblings(trees[k], i) + siblings(top, k), changed
            for left, right in path:
                h = digest(*left, h, *right)
            out.append((doc_id if known else None, leaf, trees[k][-1][0], top[-1][0], digest(*(x for left, right in path for x in left + right)), h, h == top[-1][0]))
    return sorted(out, key=str)


def check(df):
    assert sorted(map(tuple, manifest(df).collect()), key=str) == brute([r.asDict() for r in df.collect()])


def test_documents_match_brute_force_and_sql(spark):
    check(documents(spark))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert sorted(con.execute(oracle()).fetchall(), key=str) == brute([r.asDict() for r in documents(spark).collect()])


def test_odd_rows_and_nothing(spark):
    check(odd_documents(spark))
    assert manifest(none_of(documents(spark))).count() == 0


def test_one_row(spark):
    check(documents(spark).limit(1))


def test_more_than_one_block_beside_small_languages(spark):
    rows = [(i, f"Text {i}", "en" if i % 100 else f"l{i % 900}", None, i) for i in range(9000)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def test_more_languages_than_a_run_and_a_hot_id(spark):
    rows = [(i, f"T {i}", f"l{i}", "s", 3) for i in range(70)] + [(7, "Same", "l7", "s", 4)] * 60
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
