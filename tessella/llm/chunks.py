"""A bounded per-worker cache from space-delimited chunks to what a tokenizer makes of them.

Natural text repeats its words, and the tokenizers used here never look across a space.  So
a task encodes each distinct chunk once and looks the rest up.  The cache only saves time:
results never depend on what it holds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of each of the two generations of chunks that a worker keeps, and what a chunk
#: takes besides its characters and its value.
CACHE_BYTES, ENTRY_BYTES = 128 << 20, 200
#: Longer chunks (texts without spaces) seldom repeat: they are encoded anew each time.
LONGEST_KEPT = 64
#: Bytes of a ``ChunkTable``, and what an entry takes besides its characters and its value.
TABLE_BYTES, PLACE_BYTES = 32 << 20, 24
#: The most frequent chunks of the first batch are also kept in a table small enough for a
#: CPU's cache.
HOT_CHUNKS = 16_000


def _size(value: object) -> int:
    return len(value) if isinstance(value, bytes) else 0


class ChunkCache:
    def __init__(self, encode: Callable[[list[str]], Iterable[object]], limit: int = CACHE_BYTES):
        self.encode, self.limit = encode, limit
        self.hot: dict[str, object] = {}
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.young_bytes = 0

    def _admit(self, found: dict[str, object]) -> None:
        """Keep a batch's chunks in the young generation: it is over its limit by one batch at
        most."""
        kept = {name: value for name, value in found.items() if len(name) <= LONGEST_KEPT}
        size = ENTRY_BYTES * len(kept) + 4 * sum(map(len, kept)) + sum(map(_size, kept.values()))
        if self.young and self.young_bytes + size > self.limit:
            self.old, self.young, self.young_bytes = self.young, {}, 0
        self.young.update(kept)
        self.young_bytes += size

    def values(self, chunked: list[list[str]]) -> list[list]:
        """For each list of chunks the list of their values (never None)."""
        if not self.hot:
            counts = Counter(c for c in chain.from_iterable(chunked) if len(c) <= LONGEST_KEPT)
            often = [c for c, _ in counts.most_common(HOT_CHUNKS)]
            self.hot.update(zip(often, self.encode(often), strict=True))
        hot, young, old = self.hot.get, self.young.get, self.old.get
        out, gaps, new, moved = [], [], set(), {}
        for chunks in chunked:
            own = list(map(hot, chunks))
            for at in [k for k, value in enumerate(own) if value is None]:
                chunk = chunks[at]
                value = young(chunk)
                if value is None:
                    value = old(chunk)
                    if value is None:
                        new.add(chunk)
                        gaps.append((own, at, chunk))
                        continue
                    moved[chunk] = value
                own[at] = value
            out.append(own)
        if new or moved:
            names = list(new)
            learnt = dict(zip(names, self.encode(names), strict=True))
            for own, at, chunk in gaps:
                own[at] = learnt[chunk]
            self._admit(moved | learnt)
        return out


class ChunkTable(ChunkCache):
    """The same as Arrow columns, for values that are bytes: looks up a whole column of chunks at
    once, and hands only new ones, each of them once, to ``encode``.  Over its limit it keeps
    those that were used last, to half of it."""

    def __init__(self, encode: Callable[[pa.Array], pa.Array], limit: int = TABLE_BYTES):
        self.encode, self.limit = encode, limit
        self.names, self.found = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.used = np.zeros(0, "i8")
        self.ticks = 0

    def look_up(self, chunks: pa.Array) -> pa.Array:
        """For each chunk (large_string, not null) its value (large_binary)."""
        at = pc.index_in(chunks, value_set=self.names)
        names, found = self.names, self.found
        if at.null_count:
            new = chunks.filter(at.is_null()).dictionary_encode()
            names = pa.concat_arrays([names, new.dictionary])
            found = pa.concat_arrays([found, self.encode(new.dictionary)])
            places = np.where(at.is_null().to_numpy(zero_copy_only=False), -1, at.fill_null(0).to_numpy())
            places[places < 0] = len(self.names) + new.indices.to_numpy()
        else:
            places = at.to_numpy()
        self._admit(names, found, places)
        return found.take(pa.array(places))

    def _admit(self, names: pa.Array, found: pa.Array, places: np.ndarray) -> None:
        self.ticks += 1
        used = np.concatenate([self.used, np.zeros(len(names) - len(self.used), "i8")])
        used[places] = self.ticks
        lengths = pc.binary_length(names).to_numpy()
        keep = lengths <= LONGEST_KEPT
        sizes = np.where(keep, lengths + pc.binary_length(found).to_numpy() + PLACE_BYTES, 0)
        if sizes.sum() > self.limit:
            last = np.argsort(-used, kind="stable")
            keep[last[np.cumsum(sizes[last]) > self.limit // 2]] = False
        if not keep.all():
            kept = pa.array(keep)
            names, found, used = names.filter(kept), found.filter(kept), used[keep]
        self.names, self.found, self.used = names, found, used

    def values(self, chunked: list[list[str]]) -> list[list[bytes]]:
        flat = self.look_up(pa.array(list(chain.from_iterable(chunked)), pa.large_string())).to_pylist()
        return [flat[a:b] for a, b in pairwise(accumulate(map(len, chunked), initial=0))]
