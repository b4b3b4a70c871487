"""Butterworth design and zero-phase filtering of many signals at once, in numpy.

A filter is linear, so a block of samples goes through it as a matrix product:
outputs and next state are sums of what the block and the state before it give.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_BLOCK = 256


@dataclass(frozen=True)
class Filter:
    """Second-order sections, each (b0, b1, b2, a1, a2), or one section of higher order."""

    sections: tuple[tuple[tuple[float, ...], tuple[float, ...]], ...]
    pad: int

    @property
    def ba(self) -> tuple[np.ndarray, np.ndarray]:
        b = a = np.ones(1)
        for bs, as_ in self.sections:
            b, a = np.convolve(b, bs), np.convolve(a, as_)
        return b, a


def _prototype(order: int) -> np.ndarray:
    k = np.arange(order)
    return np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))


def _digital(poles: np.ndarray, zeros: np.ndarray, gain_at: complex) -> tuple[np.ndarray, np.ndarray, float]:
    """Bilinear transform of analog poles and zeros; the gain is one at gain_at on the unit circle."""
    z = (1 + zeros / 2) / (1 - zeros / 2)
    p = (1 + poles / 2) / (1 - poles / 2)
    z = np.concatenate([z, -np.ones(len(p) - len(z))])
    return p, z, abs(np.prod(gain_at - p) / np.prod(gain_at - z))


def _pairs(roots: np.ndarray) -> list[np.ndarray]:
    """Roots in conjugate pairs (real ones two by two)."""
    complex_ = sorted((r for r in roots if r.imag > 1e-12), key=lambda r: (r.real, r.imag))
    real = sorted(r.real for r in roots if abs(r.imag) <= 1e-12)
    return [np.array([r, r.conj()]) for r in complex_] + [np.array(real[k : k + 2]) for k in range(0, len(real), 2)]


def _sections(p: np.ndarray, z: np.ndarray, gain: float):
    a = [np.real(np.poly(x)) for x in _pairs(p)]
    low, high = sorted(x.real for x in z)[: len(z) // 2], sorted(x.real for x in z)[len(z) // 2 :]
    zeros = [np.array([x, y]) for x, y in zip(low, high, strict=True)]  # one at each end a section
    b = [np.real(np.poly(x)) for x in zeros]
    b[0] = b[0] * gain
    return tuple((tuple(x), tuple(y)) for x, y in zip(b, a, strict=True))


@lru_cache(64)
def lowpass(cutoff: float, fs: float, order: int = 2) -> Filter:
    """Even orders only."""
    warped = 2 * np.tan(np.pi * cutoff / fs)
    p, z, gain = _digital(warped * _prototype(order), np.zeros(0), 1.0)
    return Filter(_sections(p, z, gain), 3 * (order + 1))


@lru_cache(64)
def bandpass(low: float, high: float, fs: float, order: int = 2, sections: bool = True) -> Filter:
    """sections: as cascaded second-order sections; otherwise as one section of order 2 * order."""
    w1, w2 = 2 * np.tan(np.pi * low / fs), 2 * np.tan(np.pi * high / fs)
    half, centre = _prototype(order) * (w2 - w1) / 2, w1 * w2
    root = np.sqrt(half * half - centre + 0j)
    middle = np.exp(2j * np.arctan(np.sqrt(centre) / 2))
    p, z, gain = _digital(np.concatenate([half + root, half - root]), np.zeros(order), middle)
    made = Filter(_sections(p, z, gain), 3 * (2 * order + 1))
    if sections:
        return made
    b, a = made.ba
    return Filter(((tuple(b), tuple(a)),), made.pad)


@lru_cache(64)
def _blocks(b: tuple[float, ...], a: tuple[float, ...], size: int):
    """State space of the transposed direct form II, and its matrices for blocks of size samples."""
    n = max(len(a), len(b)) - 1
    b, a = np.pad(b, (0, n + 1 - len(b))) / a[0], np.pad(a, (0, n + 1 - len(a))) / a[0]
    step = np.eye(n, k=1)
    step[:, 0] -= a[1:]
    drive = b[1:] - a[1:] * b[0]
    observed, driven, power = np.empty((size, n)), np.empty((n, size)), np.eye(n)
    response = np.empty(size)
    response[0] = b[0]
    for k in range(size):
        observed[k] = power[0]
        driven[:, size - 1 - k] = power @ drive
        if k + 1 < size:
            response[k + 1] = (power @ drive)[0]
        power = step @ power
    lag = np.arange(size)[:, None] - np.arange(size)[None, :]
    through = np.where(lag >= 0, response[np.abs(lag)], 0.0)
    steady = np.linalg.solve(np.eye(n) - step, drive)
    return observed, driven, power, through, steady


def steady_state(b, a) -> np.ndarray:
    """The state in which a constant input of one gives a constant output."""
    return _blocks(tuple(b), tuple(a), 1)[4]


def state_matrices(b, a) -> tuple[np.ndarray, np.ndarray]:
    """How a section's state goes on by itself, and what one sample adds to it."""
    _, driven, power, _, _ = _blocks(tuple(b), tuple(a), 1)
    return power, driven[:, 0]


def run(b, a, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Filters the rows of x from the given states."""
    return run_on(b, a, x, state)[0]


def run_on(b, a, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As run, and the states after the rows."""
    out = np.empty_like(x)
    for k in range(0, x.shape[1], _BLOCK):
        part = x[:, k : k + _BLOCK]
        observed, driven, power, through, _ = _blocks(tuple(b), tuple(a), part.shape[1])
        out[:, k : k + _BLOCK] = part @ through.T + state @ observed.T
        state = part @ driven.T + state @ power.T
    return out, state


def zero_phase(filter_: Filter, x: np.ndarray) -> np.ndarray:
    """Forward and backward over the rows of x, oddly extended; rows must be longer than the padding."""
    pad = filter_.pad
    if x.shape[1] <= pad:
        raise ValueError(f"signals of {x.shape[1]} samples are too short for a padding of {pad}")
    y = np.hstack([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]])
    for _ in range(2):
        scale, first = 1.0, y[:, :1]
        for b, a in filter_.sections:
            y = run(b, a, y, first * (steady_state(b, a) * scale)[None, :])
            scale *= sum(b) / sum(a)
        y = y[:, ::-1]
    return y[:, pad:-pad]
