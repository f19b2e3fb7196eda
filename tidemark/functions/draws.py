"""The draws of tidemark.functions.draw for whole ranges of places at once, as arrays inside a task."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np

#: Places that differ in their last DIGITS digits are hashed together, about as many as fit a core's cache.
DIGITS = 4
TOGETHER = 10**DIGITS
#: Fixed values of MD5 (RFC 1321): the start, the constant of each step and the turns of each round.
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_STEPS = np.array([int(abs(math.sin(k + 1)) * 2**32) for k in range(64)], np.uint32)
_TURN = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_WORDS = [*range(16), *((5 * k + 1) % 16 for k in range(16)), *((3 * k + 5) % 16 for k in range(16)), *(7 * k % 16 for k in range(16))]
_BITS = [np.array(k, np.uint32) for k in range(32)]


def _words(texts: list[bytes], at: int) -> np.ndarray:
    """Texts of one length as the 16 words of a block, from its byte at."""
    block = np.zeros((len(texts), 64), np.uint8)
    block[:, at : at + len(texts[0])] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1)
    return block.view("<u4").astype(np.uint32)


def _turned(state: tuple[np.ndarray, ...], words: list[np.ndarray], steps: range) -> tuple[np.ndarray, ...]:
    """The four words of MD5's state after some steps. What is written over is the state itself, which stays in the core's cache."""
    a, b, c, d = state
    t, left = np.empty_like(a), np.empty_like(a)
    one = np.array([0 if w.ndim else w for w in words], np.uint32)
    add = [x.reshape(()) for x in (one[_WORDS] + _STEPS)[:, None]]
    for k in steps:
        kind = k // 16
        word, turn = words[_WORDS[k]], _TURN[kind][k % 4]
        if kind == 0:
            np.bitwise_xor(c, d, t)
            np.bitwise_and(t, b, t)
            np.bitwise_xor(t, d, t)
        elif kind == 1:
            np.bitwise_xor(b, c, t)
            np.bitwise_and(t, d, t)
            np.bitwise_xor(t, c, t)
        elif kind == 2:
            np.bitwise_xor(b, c, t)
            np.bitwise_xor(t, d, t)
        else:
            np.invert(d, t)
            np.bitwise_or(t, b, t)
            np.bitwise_xor(t, c, t)
        np.add(t, a, t)
        np.add(t, add[k], t)
        if word.ndim:
            np.add(t, word, t)
        np.left_shift(t, _BITS[turn], left)
        np.right_shift(t, _BITS[32 - turn], t)
        np.bitwise_or(t, left, t)
        np.add(t, b, t)
        a, b, c, d, t = d, t, b, c, a
    return a, b, c, d


@functools.lru_cache(64)
def _tails(low: int, high: int, digits: int, at: int) -> tuple[np.ndarray, ...]:
    """The words that end messages with the numbers from low up to high, zeros before them, whose other letters come before the byte at: an array for each word, of one where all are the same."""
    words = _words([f"{k:0{digits}}".encode() + b"\x80" for k in range(low, high)], at)
    words[:, 14] = 8 * (at + digits)
    return tuple(words[:, w].copy() if x else words[:1, w].copy() for w, x in enumerate((words != words[0]).any(axis=0)))


def _first_words(heads: np.ndarray, tails: tuple[np.ndarray, ...]) -> np.ndarray:
    """The first 32 bits, as hexadecimal digits have them, of the MD5 of each head with each tail."""
    shape = len(heads), max(len(t) for t in tails)
    words = [heads[: len(heads) if x else 1, w, None] | tails[w] for w, x in enumerate((heads != heads[0]).any(axis=0))]
    words = [x.reshape(()) if x.size == 1 else np.broadcast_to(x, shape).ravel() for x in words]
    first = min((w for w in range(16) if words[w].ndim), default=0)  # up to there all states are one
    state = _turned(tuple(np.full(1, x, np.uint32) for x in _START), words, range(first))
    state = _turned(tuple(np.full(shape[0] * shape[1], x[0], np.uint32) for x in state), words, range(first, 61))  # the last three steps don't touch the first word
    return (state[1] + np.uint32(_START[0])).byteswap().reshape(shape)


def drawn(seed: int, reps: range, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For the places 0 to n - 1 of each replicate the 32 bits of draw(seed, rep, place), in parts: the first replicate's number, and a row of draws for each."""
    lengths: dict[int, list[int]] = {}
    for rep in reps:
        lengths.setdefault(len(str(rep)), []).append(rep)
    for low in (0, *(10**d for d in range(1, DIGITS)), *range(TOGETHER, n, TOGETHER)):
        if low >= n:
            break
        whole = str(low)
        head, digits = whole[:-DIGITS], len(whole[-DIGITS:])
        places = min(n, 10**digits if not head else low + TOGETHER) - low
        for length, same in lengths.items():
            at = len(f"{seed}--{head}") + length
            if at + digits > 55:
                raise ValueError(f"a draw of {at + digits} letters doesn't fit one block of MD5")
            tails = _tails(low % TOGETHER, low % TOGETHER + places, digits, at)
            step = max(1, TOGETHER // places)
            for i in range(0, len(same), step):
                heads = _words([f"{seed}-{rep}-{head}".encode() for rep in same[i : i + step]], 0)
                yield same[i], _first_words(heads, tails)
