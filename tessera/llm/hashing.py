"""Polynomial hashes of byte spans, and long texts read a segment at a time: memory follows from SEGMENT, not from the text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

U = np.uint64
P = 0x100000001B3
SEGMENT = 1 << 18
_SPACE = re.compile(rb"[\x00-\x20]")


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[U(1), np.full(SEGMENT, base, U)], dtype=U)


UP, DOWN = _powers(P), _powers(pow(P, -1, 1 << 64))


def segments(raw: bytes, cut: re.Pattern = _SPACE) -> Iterator[bytes]:
    """Pieces of about SEGMENT bytes that end with a match of ``cut`` (or the text); joined they are the text."""
    at = 0
    while len(raw) - at > SEGMENT:
        found = cut.search(raw, at + SEGMENT)
        if found is None:
            break
        yield raw[at : found.end()]
        at = found.end()
    yield raw[at:] if at else raw


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each of the ascending spans the sum of (byte + 1) * P**place, wherever the span stands."""
    out, i = np.empty(len(starts), U), 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + SEGMENT, "right"))
        if j > i:
            x = b[lo : int(ends[j - 1])]
            total = np.r_[U(0), np.cumsum((x + U(1)) * UP[: len(x)], dtype=U)]
            out[i:j] = (total[ends[i:j] - lo] - total[starts[i:j] - lo]) * DOWN[starts[i:j] - lo]
            i = j
        else:  # one span longer than a segment
            h = 0
            for k, at in enumerate(range(lo, int(ends[i]), SEGMENT)):
                x = b[at : min(at + SEGMENT, int(ends[i]))]
                h += int(((x + U(1)) * UP[: len(x)]).sum(dtype=U)) * pow(P, SEGMENT * k, 1 << 64)
            out[i] = h % (1 << 64)
            i += 1
    return out
