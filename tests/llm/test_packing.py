import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st

from cortexlake.llm.packing import best_fit_packing, plan

from .helpers import documents, none_of, odd_documents


def best_fit_decreasing(counts, size):
    free = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [i for i, x in enumerate(free) if x >= length]
            if not fits:
                free.append(size)
                fits = [len(free) - 1]
            free[min(fits, key=lambda i: free[i])] -= length
    return free


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 40), max_size=12))
@example({2: 29, 3: 38, 7: 1})
def test_plan_places_every_piece_once(counts):
    size, seen, at = 20, Counter(), defaultdict(list)
    for length, rank, n, first, offset in plan(counts, size):
        assert rank == seen[length]
        seen[length] += n
        for k in range(n):
            at[first + k].append((offset, length))
    assert seen == Counter(counts)
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    assert len(at) == len(best_fit_decreasing(counts, size))


def test_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = [(-1, "before<|endoftext|>after <|endoftext|>"), (-2, "<|endoftext|>"), (-3, "<|endoftext |> no"), (-4, "it's\u00a0 12  words\n\n \U0001f600")]
    docs = documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in best_fit_packing(docs).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc, rows in by_doc.items():
        ids = [*reference.encode(texts[doc] or "", add_special_tokens=False).ids, 2]
        rows.sort(key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(rows):
            assert (r.piece, r.start) == (k, at) and r.length <= 1024 and (k == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = best_fit_packing(docs).collect()
    assert sum(r.piece == 0 for r in out) == docs.count()
    assert best_fit_packing(none_of(docs)).count() == 0
