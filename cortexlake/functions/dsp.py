"""NumPy kernels for one channel's samples; Spark cuts, shuffles and merges the blocks they work on."""

from __future__ import annotations

import numpy as np


def odd_padded(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` samples more on both sides, mirrored through the end points."""
    n = min(n, len(x) - 1)
    return np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]]) if n > 0 else x


def analytic(x: np.ndarray) -> np.ndarray:
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


def analytic_inside(x: np.ndarray, before: int, after: int) -> np.ndarray:
    """The analytic signal of band-passed samples, of which the first ``before`` and last ``after`` are faded in and out, so that what lies between doesn't feel the cut."""
    fade = lambda n: (lambda t: t - np.sin(2 * np.pi * t) / (2 * np.pi))((np.arange(n) + 0.5) / n) if n else np.zeros(0)
    w = np.ones(len(x))
    w[:before] *= fade(before)
    w[len(x) - after :] *= fade(after)[::-1]
    return analytic(x * w)


def psd(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density of the mean-free signal under a Hann window."""
    w = np.hanning(len(x) + 1)[:-1]
    power = np.abs(np.fft.rfft((x - x.mean()) * w)) ** 2 / (fs * (w**2).sum())
    power[1 : -1 if len(x) % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(len(x), 1 / fs), power


def fir_band_pass(fs: float, low: float, high: float, order: int) -> np.ndarray:
    """``order`` + 1 taps: a Hamming-windowed sinc band-pass with gain 1 at the band's centre."""
    k = np.arange(order + 1) - order / 2
    ideal = 2 * high / fs * np.sinc(2 * high / fs * k) - 2 * low / fs * np.sinc(2 * low / fs * k)
    taps = ideal * np.hamming(order + 1)
    return taps / np.abs(np.sum(taps * np.exp(-2j * np.pi * (low + high) / 2 / fs * k)))


def zero_phase_fir(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """The taps forwards and backwards; a signal shorter than three times the taps stays as it is."""
    pad = 3 * (len(taps) - 1)
    if len(x) <= pad:
        return np.asarray(x, float)
    return np.convolve(odd_padded(np.asarray(x, float), pad), np.convolve(taps, taps[::-1]), "same")[pad : pad + len(x)]


def fft_resample(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` samples over the same span, by cutting or filling up the spectrum."""
    if not len(x) or not n:
        return np.zeros(n)
    spectrum, m = np.fft.rfft(x), min(len(x), n)
    out = np.zeros(n // 2 + 1, complex)
    out[: m // 2 + 1] = spectrum[: m // 2 + 1]
    if m % 2 == 0 and len(x) != n:
        out[m // 2] *= 2 if n < len(x) else 0.5
    return np.fft.irfft(out, n) * n / len(x)


def instantaneous_frequency(analytic_signal: np.ndarray, fs: float, low: float, high: float) -> np.ndarray:
    """From the phase's steps, kept within ``low`` and ``high``; the first sample repeats the second's."""
    if len(analytic_signal) < 2:
        return np.full(len(analytic_signal), low)
    f = np.diff(np.unwrap(np.angle(analytic_signal))) * fs / (2 * np.pi)
    return np.clip(np.concatenate([f[:1], f]), low, high)


def morse(x: np.ndarray, fs: float, hz: float, gamma: float = 3.0, product: float = 60.0) -> np.ndarray:
    """Magnitude of the generalised Morse wavelet transform whose peak lies at ``hz``: a pure tone of that frequency gives its amplitude.

    ``product`` is the time-bandwidth product, ``gamma`` the symmetry; the wavelet is (w / w0) ** b * exp((1 - (w / w0) ** gamma) * b / gamma) over positive
    frequencies, twice as high as its peak, with b = product / gamma.
    """
    f = np.fft.fftfreq(len(x), 1 / fs) / hz
    b = product / gamma
    up = f > 0
    shape = np.zeros(len(x))
    shape[up] = 2 * np.exp(b * np.log(f[up]) + (1 - f[up] ** gamma) * b / gamma)
    return np.abs(np.fft.ifft(np.fft.fft(x) * shape))


def octaves(low: float, high: float, voices: int = 10) -> list[float]:
    """Frequencies from ``high`` down to ``low``, ``voices`` to an octave."""
    return [high * 2.0 ** (-k / voices) for k in range(int(np.floor(np.log2(high / low) * voices + 1e-9)) + 1)]
