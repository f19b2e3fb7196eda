"""Every token goes through the best fill of a window, and a window is closed by one cut at most."""

from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import packing


def packed(lengths, window, pools, monkeypatch=None):
    """Rows of a packer that gets the documents in some pools; checks that each lies whole and gapless in full sequences."""
    packer = packing._Packer(window, 3, True)
    for i, n in enumerate(lengths):
        packer.add(i, np.arange(n, dtype="<u4"))
        if (i + 1) % (len(lengths) // pools + 1) == 0:
            packer.pack()
            assert packer.tokens == sum(k * len(v) for k, v in packer.waiting.items()) < window
    packer.pack(last=True)
    assert packer.tokens == 0 and not packer.waiting
    docs, sequences = defaultdict(list), defaultdict(list)
    for doc, start, length, _, whole, sequence, offset, ids in packer.rows:
        assert whole == lengths[doc] and np.frombuffer(ids, "<u4").tolist() == list(range(start, start + length))
        docs[doc].append((start, length))
        sequences[sequence].append((offset, length))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(docs[doc]):
            assert start == at
            at += length
        assert at == n
    sizes = []
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        sizes.append(at)
    return packer.rows, sizes


@pytest.mark.parametrize("pools", [1, 4, 30])
@pytest.mark.parametrize("seed", range(4))
def test_windows_are_full_and_cut_once_at_most(seed, pools):
    rng = np.random.default_rng(seed)
    lengths = rng.geometric(0.01, 300).tolist() if seed else [40] * 300
    rows, sizes = packed(lengths, 64 if not seed else 512, pools)
    window = 64 if not seed else 512
    assert sum(s == window for s in sizes) == sum(lengths) // window
    assert sorted((s for s in sizes if s != window), reverse=True) == [1 << i for i in reversed(range(12)) if sum(lengths) % window >> i & 1]
    pieces = len(rows) - sum(n // window for n in lengths) - sum(n % window > 0 for n in lengths)
    assert pieces <= len(sizes)


def test_no_token_passes_by_the_best_fill(monkeypatch):
    asked, kept = [], packing.best_fill

    def seen(counts, target):
        used = kept(counts, target)
        asked.append(target)
        assert sum(k * n for k, n in used.items()) <= target
        return used

    monkeypatch.setattr(packing, "best_fill", seen)
    rng = np.random.default_rng(1)
    lengths = [int(n) for n in rng.integers(1, 500, 400)]
    rows, sizes = packed(lengths, 512, 5)
    alone = sum(1 for s in {r[5] for r in rows} if sum(r[5] == s for r in rows) == 1 and next(r[2] for r in rows if r[5] == s) in (512, 256, 128, 64, 32, 16, 8, 4, 2, 1))
    assert len(asked) >= len(sizes) - alone
    # what the best fill leaves open is closed by one piece that is longer, as all that are left are
    assert len(rows) - len(lengths) <= len(sizes)
