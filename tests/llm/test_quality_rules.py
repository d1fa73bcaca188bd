import re
from collections import Counter

from cortexlake.llm.quality_rules import drop_rejected, quality_rules

from .helpers import WORD, documents, none_of, odd_documents


def brute(text):
    text = text or ""
    w = re.findall(WORD, text)
    tri = Counter(zip(w, w[1:], w[2:]))
    rep = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep)


def test_counts_equal_brute_force(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        want = brute(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (g.base_failed and g.kept)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = quality_rules(docs).collect()
    assert len(got) == docs.count()
    for r, text in [(g, t) for g in got for t in [next((d.text for d in docs.collect() if d.doc_id == g.doc_id), "")]]:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text)
    kept = drop_rejected(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in got)
    assert quality_rules(none_of(docs)).count() == 0


def test_stage_agrees_with_query(spark):
    docs = documents(spark)
    want = {r.doc_id for r in quality_rules(docs).filter("kept").collect()}
    assert {r.doc_id for r in drop_rejected(docs).collect()} == want


def test_groups_have_their_own_fences(spark):
    clean = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en", "plain") for i in range(300)]
    code = [(1000 + i, " ".join(f"w{i}y{k}" + "#" * (k % 2) for k in range(60)), "en", "code") for i in range(300)]
    odd = [(5000, " ".join(f"q{k}" + "#" * (k % 2) for k in range(60)), "en", "plain")]
    docs = spark.createDataFrame(clean + code + odd, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules(docs).filter("kept").collect()}
    assert 5000 not in kept and len(kept) >= 0.95 * 600


def verdicts(rows):
    """Places of the (text, lang, source) that stay, with quantiles by counting."""
    counts = [brute(t) for t, _, _ in rows]
    lines = [len([x for x in (t or "").split("\n") if re.search(WORD, x)]) for t, _, _ in rows]
    passed = [i for i, c in enumerate(counts) if c[0] >= 50 and 100 * c[4] <= 50 * c[0]]

    def cut(x):
        drop = max(x.bit_length() - 6, 0)
        return x >> drop << drop

    def share(i, k):
        w, chars, symbols, dups, repeats = counts[i]
        return cut((symbols * 1000 // chars, dups * 1000 // lines[i], repeats * 1000 // w, chars * 100 // w)[k])

    def quantile(members, k, thousandths):
        values = sorted(share(i, k) for i in members)
        return values[-(-len(values) * thousandths // 1000) - 1]

    def fence(i, k, thousandths):
        all_of = [passed, [j for j in passed if rows[j][1] == rows[i][1]], [j for j in passed if rows[j][1:] == rows[i][1:]]]
        out = quantile(all_of[0], k, thousandths)
        for members in all_of[1:]:
            out = (len(members) * quantile(members, k, thousandths) + 200 * out) / (len(members) + 200)
        return out

    return [i for i in passed if all(share(i, k) <= fence(i, k, 990) for k in range(4)) and share(i, 3) >= fence(i, 3, 10)]


def test_verdicts_equal_brute_force(spark):
    for docs in (documents(spark), odd_documents(spark)):
        rows = docs.collect()
        stay = Counter(rows[i].doc_id for i in verdicts([(r.text, r.lang, r.source) for r in rows]))
        assert Counter(r.doc_id for r in quality_rules(docs).filter("kept").collect()) == stay
