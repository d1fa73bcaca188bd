"""Secret scan: an Aho-Corasick pass finds keywords, anchored expressions run only where one begins, checksums decide.

Base kinds (``assign``, ``access``, ``hex``) follow fixed expressions. The method adds kinds whose tokens carry a
checksum of their own: a span of such a kind is reported only if the checksum holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keywords, prefixes and alphabets.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_WORD = "AKIA"
CRC_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
BASE58_PREFIXES = ("xprv", "yprv", "zprv", "tprv")
BECH32_PREFIX = "AGE-SECRET-KEY-1"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)

BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("crc_token", "extended_key", "age_key")


def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in words)


ASSIGN = re.compile(f"""({"|".join(map(_either_case, ("password", "passwd", "secret", "token")))}|{_either_case("api")}_?{_either_case("key")})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")  # [0-9a-f]+ takes whole runs, so dropping short ones is the same as this
CRC_TOKEN = re.compile("(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
EXTENDED_KEY = re.compile(f"[xyzt]prv[{BASE58}]{{107,108}}(?![A-Za-z0-9])")
AGE_KEY = re.compile("AGE-SECRET-KEY-1[0-9A-Z]{58}(?![0-9A-Za-z])")


def crc_holds(body: str, check: str) -> bool:
    """The last six characters are the body's CRC-32 in base 62."""
    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def base58_holds(key: str) -> bool:
    """The last four bytes are the start of the double SHA-256 of the rest."""
    value = 0
    for c in key:
        value = value * 58 + BASE58.index(c)
    raw = value.to_bytes(82, "big") if value < 1 << 656 else b""
    return bool(raw) and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_holds(key: str) -> bool:
    """The polynomial checksum over the readable part and the data is one."""
    low = key.lower()
    cut = low.rfind("1")
    human, data = low[:cut], low[cut + 1 :]
    if any(c not in BECH32 for c in data):
        return False
    check = 1
    for v in [*(ord(c) >> 5 for c in human), 0, *(ord(c) & 31 for c in human), *map(BECH32.index, data)]:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(BECH32_GENERATOR):
            check ^= g if top >> i & 1 else 0
    return check == 1


@lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    kinds: dict[str, list[str]] = {}
    for word in ASSIGN_WORDS:
        kinds.setdefault(word, []).append("assign")
    kinds.setdefault(ACCESS_WORD.lower(), []).append("access")
    for word in CRC_PREFIXES:
        kinds.setdefault(word, []).append("crc_token")
    for word in BASE58_PREFIXES:
        kinds.setdefault(word, []).append("extended_key")
    kinds.setdefault(BECH32_PREFIX.lower(), []).append("age_key")
    for word, of in kinds.items():
        found.add_word(word, (len(word), tuple(of)))
    found.make_automaton()
    return found


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _folded(text: str) -> str:
    """A-Z lower-cased, each character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


def _checked(kind: str, text: str, start: int) -> int:
    """The end of the added kind's token at ``start`` if its checksum holds, else 0."""
    if kind == "crc_token":
        m = CRC_TOKEN.match(text, start)
        return m.end() if m and crc_holds(m[1], m[2]) else 0
    if kind == "extended_key":
        m = EXTENDED_KEY.match(text, start)
        return m.end() if m and base58_holds(m[0]) else 0
    m = AGE_KEY.match(text, start)
    return m.end() if m and bech32_holds(m[0]) else 0


def spans_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(start, end, kind) of the base spans and of the added ones; code points, end exclusive."""
    base, added, upto = [], [], {"assign": 0, "access": 0}
    hits = sorted((end + 1 - size, kind) for end, (size, kinds) in _automaton().iter(_folded(text)) for kind in kinds)
    for start, kind in hits:
        if kind not in upto:
            if end := _checked(kind, text, start):
                added.append((start, end, kind))
        elif start >= upto[kind] and (m := (ASSIGN if kind == "assign" else ACCESS).match(text, start)):
            upto[kind] = m.end()
            if m.end() - m.start(m.lastindex or 0) >= (12 if kind == "assign" else 18):
                base.append((start, m.end(), kind))
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return base, added


_ORDER = {k: i for i, k in enumerate((*BASE_KINDS, *ADDED_KINDS))}


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], _ORDER[x[2]])))


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, counts per base kind, ``base_sha256``, ``spans`` and ``n_added``.

    Needs ``doc_id`` and ``text``; more columns are ignored. Null text counts as empty: no spans and the digest of
    the empty string. Rows with the same id are scanned one by one. No shuffle; each text is handled on its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text"):
                base, added = spans_of(text.as_py() or "")
                count = [sum(k == kind for *_, k in base) for kind in BASE_KINDS]
                rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 3 + (pa.string(),) * 2 + (pa.int64(),)))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span's characters in ``text`` replaced by ``mark``; overlapping spans give one mark.

    Rows, order of columns and all other values stay; null text stays null. ``n_chars``, where there is one, is that of the new text.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes = [], []
            for value in b.column("text"):
                text = value.as_py()
                if text:
                    base, added = spans_of(text)
                    out, at, reach = [], 0, -1
                    for start, end, _ in sorted(base + added):
                        if start >= reach:
                            out += [text[at:start], mark]
                        reach = max(reach, end)
                        at = reach
                    text = "".join([*out, text[at:]])
                texts.append(text)
                sizes.append(None if text is None else len(text))
            new = {"text": pa.array(texts, b.schema.field("text").type)}
            if "n_chars" in names:
                new["n_chars"] = pa.array(sizes, pa.int64()).cast(b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(i)) for i, n in enumerate(names)], names)

    return docs.mapInArrow(run, docs.schema)
