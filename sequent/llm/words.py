"""Words of many texts at once, as positions and 64-bit hashes in NumPy arrays.

A word is what stands between ASCII white space.  Texts are laid end to end in a byte buffer, so that a batch
costs a few array passes and no Python step per word.  The hash adds up a pseudo-random value for each byte and its
place, mixed: two given words share one with a chance of 2^-64 however they are built, and any two of n words with a
chance of about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are worked on at once.
CHUNK = 1 << 20
#: Places in a word whose bytes' values are tabulated; those of later places are made as they come.
PLACES = 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well spread 64-bit hash of each 64-bit value."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: The value of byte b at place p of a word stands at 256 p + b.
_VALUES = mixed(np.arange(PLACES << 8, dtype=np.uint64), 11)


def chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, owner, stop) of about CHUNK bytes each: piece k ends at stop[k] and belongs to text owner[k].

    A piece is a whole text, or a part of a long one that ends at white space.  A white-space byte follows
    each piece.  A null text is empty.
    """
    held, owners, stops, size = [], [], [], 0
    for n, text in enumerate(texts):
        data, at = (text or "").encode(), 0
        while True:
            end = len(data)
            if end - at > CHUNK:
                end = max(data.rfind(mark, at, at + CHUNK) for mark in (b" ", b"\n", b"\t")) + 1
                if end <= at:
                    end = min((x for x in (data.find(mark, at + CHUNK) for mark in (b" ", b"\n", b"\t")) if x >= 0), default=len(data) - 1) + 1
            part = data[at:end] + b" "
            if held and size + len(part) > CHUNK:
                yield np.frombuffer(b"".join(held), np.uint8), np.array(owners), np.array(stops)
                held, owners, stops, size = [], [], [], 0
            held.append(part)
            owners.append(n)
            size += len(part)
            stops.append(size)
            at = end
            if at >= len(data):
                break
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.array(owners), np.array(stops)


def spans(data: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; cuts: places inside words where another one starts."""
    word = ~_SPACE[data]
    edge = np.empty(len(word), bool)
    edge[0] = word[0]
    np.logical_and(word[1:], ~word[:-1], out=edge[1:])
    last = np.empty(len(word), bool)
    last[-1] = word[-1]
    np.logical_and(word[:-1], ~word[1:], out=last[:-1])
    if cuts is not None:
        edge |= cuts
        last[:-1] |= cuts[1:]
    return np.flatnonzero(edge), np.flatnonzero(last) + 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, nothing else."""
    return _LOWER[data]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; words stand one after the other."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(starts[0], len(data), dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), np.diff(starts, append=len(data)))
    own = data[starts[0] :]
    total = np.zeros(len(data) + 1, np.uint64)
    value = _VALUES[(np.minimum(place, PLACES - 1) << 8) | own]
    if int((ends - starts).max()) > PLACES:
        late = np.flatnonzero(place >= PLACES)
        value[late] = mixed((place[late].astype(np.uint64) << np.uint64(8)) | own[late], 11)
    np.cumsum(value, out=total[starts[0] + 1 :])
    return mixed(total[ends] - total[starts], 5)


def word_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words of each text."""
    found, counts = [], np.zeros(len(texts), np.int64)
    for data, owner, stop in chunks(texts):
        data = lowered(data) if lower else data
        starts, ends = spans(data)
        found.append(hashes(data, starts, ends))
        np.add.at(counts, owner, np.diff(np.searchsorted(starts, stop), prepend=0))
    return np.concatenate(found) if found else np.zeros(0, np.uint64), counts
