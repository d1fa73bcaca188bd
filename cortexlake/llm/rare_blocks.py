"""Words beyond the frequent ones with all their pairs, as compressed blocks dealt to buckets by the word's hash.

A bucket holds for each of its words every pair that the word is the dish of and every pair that it is the context of. The other word
of a pair is a code if it is frequent; if not, its hash, and the pair is in both words' buckets (``far``). What a far pair's draw
needs of the other word comes as a message from that word's bucket: both list the pairs between them in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from cortexlake.llm.bytetext import mix
from cortexlake.llm.pair_blocks import packed, unpacked

_ODD = np.uint64(0x9E3779B97F4A7C15)


def blob(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 as one."""
    out = []
    for v in arrays:
        raw = packed(v.astype(np.uint64)) if len(v) else b""
        out += [np.array([len(v), len(raw)], "<u4").tobytes(), raw]
    return b"".join(out)


def unblob(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        n, size = np.frombuffer(raw, "<u4", 2, at).tolist()
        at += 8
        out.append(unpacked(raw[at : at + size], n) if n else np.zeros(0, np.uint64))
        at += size
    return out


def steps(v: np.ndarray) -> np.ndarray:
    return np.diff(v.astype(np.uint64), prepend=np.uint64(0))


def walked(v: np.ndarray) -> np.ndarray:
    return np.cumsum(v, dtype=np.uint64)


def pair_key(before: np.ndarray, dish: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of word hashes; the end's is 0."""
    return mix(mix(before + _ODD) * _ODD + dish)


def bucket_of(h: np.ndarray, n_buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)


@dataclass
class Tokens:
    """Rare tokens: hash, the codes of the words before and after, and the hashes of these where they are rare too (else 0)."""

    h: np.ndarray
    codes: tuple[np.ndarray, np.ndarray]
    far: tuple[np.ndarray, np.ndarray]

    def blocks(self, n_buckets: int, others: int, *more: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """A blob for each bucket; ``more`` goes along."""
        order = np.argsort(self.h, kind="stable")
        h = self.h[order]
        codes, far, more = [v[order] for v in self.codes], [v[order] for v in self.far], [v[order] for v in more]
        bucket = bucket_of(h, n_buckets)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(h)]])
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if hi > lo:
                s = slice(lo, hi)
                yield int(bucket[lo]), blob(steps(h[s]), *(c[s] for c in codes), *(f[s][c[s] == others] for c, f in zip(codes, far)), *(v[s] for v in more))

    @staticmethod
    def together(some: list["Tokens"]) -> "Tokens":
        codes, far = (tuple(np.concatenate([pick(t)[k] for t in some]) for k in (0, 1)) for pick in (lambda t: t.codes, lambda t: t.far))
        return Tokens(np.concatenate([t.h for t in some]), codes, far)

    @staticmethod
    def read(raw: bytes, others: int) -> tuple["Tokens", list[np.ndarray]]:
        h, *rest = unblob(raw)
        codes = tuple(c.astype(np.int64) for c in rest[:2])
        far = (np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64))
        for f, c, v in zip(far, codes, rest[2:4]):
            f[c == others] = v
        return Tokens(walked(h), codes, far), rest[4:]


@dataclass
class Side:
    """Pairs of a block's words: the word's place in the block, the other one's code and hash (0 unless far), and the count."""

    at: np.ndarray
    code: np.ndarray
    far: np.ndarray
    n: np.ndarray

    @staticmethod
    def of(at: np.ndarray, code: np.ndarray, far: np.ndarray) -> "Side":
        order = np.lexsort((far, code, at))
        at, code, far = at[order], code[order], far[order]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (code[1:] != code[:-1]) | (far[1:] != far[:-1])
        first = np.flatnonzero(new)
        return Side(at[first], code[first], far[first], np.diff(np.append(first, len(at))))

    def some(self, which: np.ndarray) -> "Side":
        return Side(self.at[which], self.code[which], self.far[which], self.n[which])

    def arrays(self, others: int) -> list[np.ndarray]:
        return [steps(self.at), self.code, self.n, self.far[self.code == others]]

    @staticmethod
    def read(at: np.ndarray, code: np.ndarray, n: np.ndarray, far: np.ndarray, others: int) -> "Side":
        code, all_far = code.astype(np.int64), np.zeros(len(at), np.uint64)
        all_far[code == others] = far
        return Side(walked(at).astype(np.int64), code, all_far, n.astype(np.int64))


@dataclass
class Block:
    """A bucket's words, ascending by hash: counts, different words after (``tables``) and before (``customers``), and the pairs."""

    h: np.ndarray
    count: np.ndarray
    tables: np.ndarray
    customers: np.ndarray
    dish: Side
    context: Side
    others: int

    @staticmethod
    def of(tokens: list[Tokens], others: int) -> "Block":
        all_of = Tokens.together(tokens)
        h, at, count = np.unique(all_of.h, return_inverse=True, return_counts=True)
        dish, context = (Side.of(at, all_of.codes[k], all_of.far[k]) for k in (0, 1))
        return Block(h, count, np.bincount(context.at, minlength=len(h)), np.bincount(dish.at, minlength=len(h)), dish, context, others)

    def written(self) -> bytes:
        return blob(steps(self.h), self.count, self.tables, self.customers, *self.dish.arrays(self.others), *self.context.arrays(self.others))

    @staticmethod
    def read(raw: bytes, others: int) -> "Block":
        h, *v = unblob(raw)
        count, tables, customers = (x.astype(np.int64) for x in v[:3])
        return Block(walked(h), count, tables, customers, Side.read(*v[3:7], others), Side.read(*v[7:11], others), others)

    def live(self) -> tuple["Block", np.ndarray, np.ndarray, np.ndarray]:
        """The words seen twice or more with their pairs seen twice or more: all whose tables are drawn. And where these are."""
        words = self.count > 1
        place = np.cumsum(words) - 1
        dish, context = self.dish.some(self.dish.n > 1), self.context.some(self.context.n > 1)
        dish.at, context.at = place[dish.at], place[context.at]
        own = Block(self.h[words], self.count[words], self.tables[words], self.customers[words], dish, context, self.others)
        return own, words, self.dish.n > 1, self.context.n > 1

    def far(self, side: Side, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The far pairs of a side in the order in which messages list them, and the bucket of each one's other word."""
        at = np.flatnonzero(side.code == self.others)
        own, other = self.h[side.at[at]], side.far[at]
        before, dish = (other, own) if side is self.dish else (own, other)
        bucket = bucket_of(other, n_buckets)
        order = np.lexsort((before, dish, bucket))
        return at[order], bucket[order]

    def messages(self, n_buckets: int, tables: np.ndarray, customers: np.ndarray | None) -> Iterator[tuple[int, bytes]]:
        """To each bucket that shares far pairs: the contexts' tables, then the dishes' customers."""
        at, to = self.far(self.context, n_buckets)
        sent, none = tables[self.context.at[at]], np.zeros(0, np.int64)
        back, home = self.far(self.dish, n_buckets) if customers is not None else (none, none)
        returned = customers[self.dish.at[back]] if customers is not None else none
        for k in np.union1d(to, home).tolist():
            yield k, blob(sent[slice(*np.searchsorted(to, [k, k + 1]))], returned[slice(*np.searchsorted(home, [k, k + 1]))])

    def received(self, n_buckets: int, messages: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Of each dish pair's far context the tables, of each context pair's far dish the customers (0 where not far)."""
        got = [unblob(raw) for _, raw in sorted(messages, key=lambda m: m[0])]
        out = []
        for k, side in enumerate((self.dish, self.context)):
            values = np.concatenate([m[k] for m in got] or [np.zeros(0, np.uint64)]).astype(np.int64)
            all_values = np.zeros(len(side.at), np.int64)
            if len(values):
                all_values[self.far(side, n_buckets)[0]] = values
            out.append(all_values)
        return out[0], out[1]
