"""Recursive filters as second-order sections, run over pieces of a signal with the state carried from one piece to the next."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Samples that one matrix product filters.
RUN = 256


def butterworth(fs: float, low: float, high: float, order: int = 3, kind: str = "pass") -> np.ndarray:
    """Sections ``b0, b1, b2, 1, a1, a2`` of a Butterworth band-pass or band-stop (``kind='stop'``) of ``order`` pole pairs."""
    if not 0 < low < high < fs / 2:
        raise ValueError("the band has to lie between 0 and half the sampling rate")
    a, b = (2 * fs * np.tan(np.pi * f / fs) for f in (low, high))
    centre, width = np.sqrt(a * b), b - a
    p = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    half = p * width / 2 if kind == "pass" else width / 2 / p
    root = np.sqrt(half**2 - centre**2 + 0j)
    poles = np.concatenate([half + root, half - root])
    z = (2 * fs + poles) / (2 * fs - poles)
    upper = np.sort_complex(z[z.imag > 1e-14])
    real = np.sort(z[np.abs(z.imag) <= 1e-14].real)
    pairs = [(-2 * x.real, abs(x) ** 2) for x in upper] + [(-(real[k] + real[k + 1]), real[k] * real[k + 1]) for k in range(0, len(real), 2)]
    middle = np.arctan(centre / (2 * fs)) * 2
    zeros = (0.0, -1.0) if kind == "pass" else (-2 * np.cos(middle), 1.0)
    at = np.exp(-1j * (middle if kind == "pass" else 0.0))
    out = []
    for a1, a2 in pairs:
        gain = abs((1 + a1 * at + a2 * at**2) / (1 + zeros[0] * at + zeros[1] * at**2))
        out.append((gain, gain * zeros[0], gain * zeros[1], 1.0, a1, a2))
    return np.array(out)


@dataclass(frozen=True)
class System:
    """A cascade as one linear system: state after a sample ``F s + G u``, output ``H s + D u``; and what RUN samples do at once."""

    F: np.ndarray
    G: np.ndarray
    H: np.ndarray
    D: float
    pad: int

    @property
    def rest(self) -> np.ndarray:
        """The state that a constant 1 settles to."""
        return np.linalg.solve(np.eye(len(self.F)) - self.F, self.G)

    def after(self, n: int) -> np.ndarray:
        """What ``n`` samples do to a state: F to the power n."""
        return np.linalg.matrix_power(self.F, n)


@lru_cache(64)
def _system(sections: tuple[tuple[float, ...], ...]) -> System:
    n = 2 * len(sections)
    F, G, H, D = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):  # transposed direct form: y = b0 u + s1; s1 = b1 u - a1 y + s2; s2 = b2 u - a2 y
        into_y, u = np.zeros(n), D
        into_y[:] = b0 * H
        into_y[2 * k] += 1
        F[2 * k] = b1 * H - a1 * into_y
        F[2 * k, 2 * k + 1] += 1
        F[2 * k + 1] = b2 * H - a2 * into_y
        G[2 * k], G[2 * k + 1] = b1 * u - a1 * b0 * u, b2 * u - a2 * b0 * u
        H, D = into_y, b0 * u
    zeros = sum(s[2] == 0 for s in sections), sum(s[5] == 0 for s in sections)
    return System(F, G, H, D, 3 * (n + 1 - min(zeros)))


def system(sections: np.ndarray) -> System:
    return _system(tuple(map(tuple, np.asarray(sections, float).tolist())))


@lru_cache(64)
def _runs(key: tuple, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Outputs from the state and from the samples, and the state after ``n`` samples, from both."""
    s = _system(key)
    powers = [np.eye(len(s.F))]
    for _ in range(n):
        powers.append(s.F @ powers[-1])
    from_state = np.array([s.H @ p for p in powers[:n]])
    response = np.array([s.D, *(s.H @ p @ s.G for p in powers[: n - 1])])
    lag = np.subtract.outer(np.arange(n), np.arange(n))
    toeplitz = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
    return from_state, toeplitz, powers[n], np.array([p @ s.G for p in powers[n - 1 :: -1]]).T


def run(sections: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filtered samples and the state after them."""
    key = tuple(map(tuple, np.asarray(sections, float).tolist()))
    out = np.empty(len(x))
    whole = len(x) // RUN * RUN
    if whole:
        from_state, from_samples, carry, gather = _runs(key, RUN)
        pieces = x[:whole].reshape(-1, RUN)
        given = pieces @ gather.T
        states = np.empty((len(pieces), len(state)))
        for k in range(len(pieces)):
            states[k] = state
            state = carry @ state + given[k]
        out[:whole] = (pieces @ from_samples.T + states @ from_state.T).ravel()
    if whole < len(x):
        rest = x[whole:]
        from_state, from_samples, carry, gather = _runs(key, len(rest))
        out[whole:] = from_samples @ rest + from_state @ state
        state = carry @ state + gather @ rest
    return out, state


def left_pad(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` samples before ``x``, mirrored through its first one; fewer if ``x`` is short."""
    n = min(n, len(x) - 1)
    return 2 * x[0] - x[n:0:-1] if n > 0 else x[:0]


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forwards and backwards over one whole signal, with odd padding and settled states at its ends."""
    x = np.asarray(x, float)
    if not len(x):
        return x
    s = system(sections)
    before, behind = left_pad(x, s.pad), left_pad(x[::-1], s.pad)[::-1]
    y = np.concatenate([before, x, behind])
    y, _ = run(sections, y, s.rest * y[0])
    y, _ = run(sections, y[::-1], s.rest * y[-1])
    return y[::-1][len(before) : len(before) + len(x)]
