"""Shingle sets and SuperMinHash signatures of many documents at once."""

from __future__ import annotations

import numpy as np

from quarry.llm._words import Texts, mix, rolling, stream

GOLDEN = 0x9E3779B97F4A7C15


def shingle_sets(data: np.ndarray, offsets: np.ndarray, length: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its word shingles, A-Z lower-cased; a
    document with fewer words has its whole sequence as one; without words, none."""
    parsed = Texts(data, offsets)
    hashes, first = parsed.hashes(lower=True), parsed.first
    counts = parsed.counts
    sizes = np.where(counts >= length, counts - length + 1, (counts > 0).astype(counts.dtype))
    document = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[:-1][document]
    ends = np.minimum(starts + length, first[1:][document])
    shingles = rolling(0xE7037ED1A0B428DB).runs(hashes, starts, ends)
    return [np.unique(s) for s in np.split(shingles, np.cumsum(sizes)[:-1])] if len(sizes) else []


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash: each element draws values for the slots in the order of a random
    permutation of its own, the j-th in [j, j + 1); a slot keeps its least value.

    Rounds run over the elements of all documents together. Permutations are kept as the
    swaps made so far. A document stops once every slot is below the next round's values,
    which can't change it any more.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.full(len(sets) * slots, np.inf)
    elements = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    places: list[np.ndarray] = []
    stored: list[np.ndarray] = []
    for j in range(slots):
        if not len(elements):
            break
        drawn = mix(elements + np.uint64((j + 1) * GOLDEN & 0xFFFFFFFFFFFFFFFF))
        value = (drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53 + j
        k = (j + (mix(drawn ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) % np.uint64(slots - j)).astype(np.int16)
        at_k, at_j = k.copy(), np.full(len(k), j, np.int16)
        for place, held in zip(places, stored, strict=True):
            hit = place == k
            at_k[hit] = held[hit]
            hit = place == j
            at_j[hit] = held[hit]
        places.append(k)
        stored.append(at_j)
        np.minimum.at(values, owner * slots + at_k, value)
        going = values.reshape(-1, slots).max(1) >= j + 1
        keep = going[owner]
        if not keep.all():
            elements, owner = elements[keep], owner[keep]
            places, stored = [p[keep] for p in places], [s[keep] for s in stored]
    return values.reshape(-1, slots)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per document and band."""
    bits = np.ascontiguousarray(signature[:, : bands * rows]).view(np.uint64).reshape(-1, bands, rows)
    odd = stream(0xBADD, rows) | np.uint64(1)
    total = (mix(bits) * odd).sum(2, dtype=np.uint64)
    return mix(total + stream(0xBA5D, bands)[None, :])


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a set, as two signed integers."""
    first = mix(shingles ^ np.uint64(0x1B03738712FAD5C9)).sum(dtype=np.uint64)
    second = mix(shingles * np.uint64(0xD1342543DE82EF95) + np.uint64(1)).sum(dtype=np.uint64)
    return int(first.astype(np.int64)), int(second.astype(np.int64))
