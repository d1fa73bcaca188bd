"""Language identification of every word, and of whole texts.

Scripts, told apart by ranges of code points, narrow the languages that a word may be in. Each of these scores the word by
the byte trigrams learned from labelled texts, and Viterbi decoding with a penalty for switching labels spans of one
language. A text's language is the one whose spans hold most of its letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cortexlake.llm.bytetext import Chunk, chunks
from cortexlake.llm.spelling import SPACE, Spelled, spell

BUCKETS = 1 << 16
#: Cost of a switch between languages, in nats, and the count added to each trigram.
SWITCH, PRIOR = 15.0, 0.5
#: A language uses a script if at least one in so many of its letters is in it.
RARE_SCRIPT = 1000
#: What a word costs in a language that doesn't use its script.
FOREIGN = 60.0
#: Words decoded together: bounds the arrays of a task; a longer text is decoded alone.
AT_ONCE = 1 << 21

# First lead byte (UTF-8) of each script's range. Letters below 0x80 are Latin, too.
SCRIPTS = ((0xC2, "latin"), (0xCD, "greek"), (0xD0, "cyrillic"), (0xD5, "armenian-hebrew"), (0xD8, "arabic"), (0xE0, "indic-thai"), (0xE1, "other"), (0xE3, "kana"), (0xE4, "han"), (0xEA, "hangul"), (0xEE, "other"), (0xF0, "other"))
NAMES = tuple(dict.fromkeys(n for _, n in SCRIPTS))


def _script_of_byte() -> np.ndarray:
    """Per symbol: 0 no letter of its own, else one more than the script's index."""
    out = np.zeros(258, np.uint8)
    for lo, name in SCRIPTS:
        out[lo:256] = NAMES.index(name) + 1
    for lo in (65, 97):
        out[lo : lo + 26] = NAMES.index("latin") + 1
    return out


SCRIPT = _script_of_byte()


def _spelled(c: Chunk) -> Spelled:
    """With the accented capitals of the Latin range lower-cased, too."""
    s = spell(c, 2)
    x = s.symbols
    after = np.zeros(len(x), bool)
    after[1:] = x[:-1] == 0xC3
    x[after & (x >= 0x80) & (x <= 0x9E) & (x != 0x97)] += 0x20
    return s


def _trigrams(x: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that ends at each symbol; nothing is seen across a word's beginning."""
    v = x.astype(np.uint32)
    one, two = np.full(len(v), SPACE, np.uint32), np.full(len(v), SPACE, np.uint32)
    one[1:] = np.minimum(v[:-1], SPACE)
    two[2:] = np.minimum(v[:-2], SPACE)
    two[one == SPACE] = SPACE
    return ((v * np.uint32(0x9E3779B1) ^ one * np.uint32(0x85EBCA6B) ^ two * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> np.uint32(16)


def _word_scripts(s: Spelled) -> tuple[np.ndarray, np.ndarray]:
    """Each word's highest script (0: no letters) and its number of letters and other lead bytes."""
    if not len(s.word_at):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    marks = SCRIPT[s.symbols]
    return np.maximum.reduceat(marks, s.word_at), np.add.reduceat((marks > 0).astype(np.int64), s.word_at)


def _fold(modulus: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def learned(train: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probabilities [language, bucket] and scripts used [language, script + 1].

    Spark sums counts per language and bucket; the driver gets at most BUCKETS + 8 of them per language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column("lang").dictionary_encode()
            names, of = codes.dictionary.to_pylist(), codes.indices.to_numpy().astype(np.int64)
            total = np.zeros((len(names), BUCKETS + len(NAMES) + 1), np.int64)
            for c in chunks(b.column("text")):
                s = _spelled(c)
                own = s.scored()
                doc = np.repeat(of[c.rows], np.diff(s.text_at))
                total[:, :BUCKETS] += np.bincount((doc * BUCKETS + _trigrams(s.symbols))[own], minlength=len(names) * BUCKETS).reshape(len(names), -1)
                script, letters = _word_scripts(s)
                total[:, BUCKETS:] += np.bincount(of[c.rows][s.words.doc] * (len(NAMES) + 1) + script, letters, len(names) * (len(NAMES) + 1)).astype(np.int64).reshape(len(names), -1)
            lang, bucket = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in lang], pa.string()), pa.array(bucket), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])

    counts = train.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    table = np.zeros((len(names), BUCKETS + len(NAMES) + 1))
    table[counts["lang"].map({k: i for i, k in enumerate(names)}).to_numpy(int), counts["bucket"].to_numpy(int)] = counts["n"].to_numpy()
    seen, script = table[:, :BUCKETS] + PRIOR, table[:, BUCKETS:]
    used = script * RARE_SCRIPT >= script[:, 1:].sum(1, keepdims=True)
    used &= script > 0
    return names, np.log(seen / seen.sum(1, keepdims=True)).astype(np.float32), used


def word_scores(s: Spelled, logs: np.ndarray, used: np.ndarray) -> np.ndarray:
    """[word, language]; a word without letters scores 0 in all."""
    script, _ = _word_scripts(s)
    out = np.zeros((len(script), len(logs)), np.float32)
    if not len(script):
        return out
    t = _trigrams(s.symbols)
    # A text's end and the next one's pad stand after its last word; they would add the same to all its words' scores.
    t_in = np.where(s.scored() & (s.symbols != 257), t, BUCKETS)
    for k, row in enumerate(logs):
        out[:, k] = np.add.reduceat(np.append(row, np.float32(0))[t_in], s.word_at)
    someone = used.any(0)[script]
    out -= np.where(used.T[script] | ~someone[:, None], 0, FOREIGN).astype(np.float32)
    out[script == 0] = 0
    return out


def decode(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best label of every word; texts are decoded side by side, word by word. Ties go to staying, then the first language."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    out = np.zeros(len(scores), np.int16)
    if not len(scores):
        return out
    active = np.searchsorted(-size, -np.arange(size[0]) - 1, "right")
    stay, best = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
    now = scores[begin[: active[0]]].astype(np.float64)
    for t in range(1, size[0]):
        at, now = begin[: active[t]] + t, now[: active[t]]
        top = now.argmax(1)
        high = now[np.arange(len(top)), top][:, None] - SWITCH
        stay[at], best[at] = now >= high, top
        now = np.maximum(now, high) + scores[at]
        now -= high
        if active[t] > (active[t + 1] if t + 1 < size[0] else 0):
            done = np.arange(active[t + 1] if t + 1 < size[0] else 0, active[t])
            out[at[done]] = now[done].argmax(1)
    alone = np.flatnonzero(size == 1)
    out[begin[alone]] = scores[begin[alone]].argmax(1)
    for t in range(size[0] - 1, 0, -1):
        at = begin[: active[t]] + t
        label = out[at]
        out[at - 1] = np.where(stay[at, label], label, best[at])
    return out


def _has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def identify(docs: DataFrame, names: list[str], logs: np.ndarray, used: np.ndarray) -> DataFrame:
    """``doc_id, lang_pred, score, n_spans, spans``; spans of words as language:start:end, end exclusive, joined by commas."""
    model = docs.sparkSession.sparkContext.broadcast((names, logs, used))

    def groups(column: pa.Array) -> Iterator[tuple[int, list]]:
        part, words = [], 0
        for c in chunks(column):
            s = _spelled(c)
            n = len(s.word_at)
            if part and words + n > AT_ONCE:
                yield part
                part, words = [], 0
            part.append((c.rows, word_scores(s, *model.value[1:]), s.words.first, *_word_scripts(s)))
            words += n
        if part:
            yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = model.value[0]
        for b in batches:
            for part in groups(b.column("text")):
                scores = np.concatenate([p[1] for p in part])
                base = np.cumsum([0, *(len(p[1]) for p in part)])
                first = np.concatenate([*(p[2][:-1] + k for p, k in zip(part, base)), base[-1:]])
                letters = np.concatenate([p[4] for p in part])
                rows = slice(part[0][0].start, part[-1][0].stop)
                texts = b.column("text").slice(rows.start, rows.stop - rows.start)
                label = decode(scores, first) if names else np.zeros(len(scores), np.int16)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                mass = np.bincount(doc * max(len(names), 1) + label, letters, (len(first) - 1) * max(len(names), 1)).reshape(len(first) - 1, -1)
                begins = np.ones(len(label), bool)
                begins[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(begins)
                stop = np.append(at[1:], len(label))
                n_spans = np.bincount(doc[at], minlength=len(first) - 1)
                span = [f"{names[label[i]]}:{i - first[doc[i]]}:{j - first[doc[i]]}" for i, j in zip(at, stop)] if names else []
                cut = np.concatenate([[0], np.cumsum(n_spans)])
                total, top = mass.sum(1), mass.argmax(1)
                pred, score, spans, counts = [], [], [], []
                for i in range(len(first) - 1):
                    sure = names and (total[i] > 0) and _has_letter(texts[i].as_py())
                    pred.append(names[top[i]] if sure else "und")
                    score.append(mass[i, top[i]] / total[i] if sure else 0.0)
                    spans.append(",".join(span[cut[i] : cut[i + 1]]) if sure else "")
                    counts.append(int(n_spans[i]) if sure else 0)
                ids = b.column("doc_id").slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(counts, pa.int64()), pa.array(spans, pa.string())], ["doc_id", "lang_pred", "score", "n_spans", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_spans long, spans string")


def language_id(docs: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, n_spans, spans``.

    Learns from ``text`` and non-null ``lang`` of documents whose crc32(doc_id as text) mod ``modulus`` is not ``held_out`` (a null
    id counts as empty text). ``score`` is the share of the text's letters in spans of ``lang_pred``. Text that is null
    or has no letter, and any text if nothing was learned, gives ``und``, 0 and no spans. Rows with the same id are
    labelled one by one, more columns are ignored, an empty table gives an empty one.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    train = named.filter((_fold(modulus) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    out = identify(named, *learned(train))
    return out.select("doc_id", (_fold(modulus) == held_out).alias("held_out"), "lang_pred", "score", "n_spans", "spans")
