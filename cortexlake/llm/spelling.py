"""Texts as streams of symbols: each word's bytes (A-Z lower-cased) and a space, and one end for each text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from cortexlake.llm.bytetext import SPACE as GAPS
from cortexlake.llm.bytetext import Chunk, Words

SPACE, END = 256, 257


@dataclass
class Spelled:
    """``symbols`` of all texts, each text's after ``pad`` ends; where each word begins in them, and where each text's pad begins (one more: the end)."""

    symbols: np.ndarray
    word_at: np.ndarray
    text_at: np.ndarray
    words: Words
    pad: int

    def scored(self) -> np.ndarray:
        """True but for the pads."""
        out = np.ones(len(self.symbols), bool)
        for k in range(self.pad):
            out[self.text_at[:-1] + k] = False
        return out


def spell(c: Chunk, pad: int) -> Spelled:
    w = c.words(lower=True)
    solid = ~GAPS[w.data]
    size = np.bincount(w.doc, weights=w.ends - w.starts, minlength=len(c)).astype(np.int64) + np.diff(w.first) + pad + 1
    text_at = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    out = np.full(text_at[-1], END, np.uint16)
    letters = np.concatenate([np.zeros(1, np.int64), np.cumsum(w.ends - w.starts)])
    # A word's place: the letters and spaces of the words before it, and the pads and ends of the texts before it.
    word_at = letters[:-1] + np.arange(len(w.starts)) + w.doc * (pad + 1) + pad
    inside = np.repeat(word_at - letters[:-1], w.ends - w.starts) + np.arange(letters[-1])
    out[inside] = w.data[solid]
    out[word_at + (w.ends - w.starts)] = SPACE
    return Spelled(out, word_at, text_at, w, pad)
