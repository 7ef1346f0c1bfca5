"""Ids of whole texts from the ids of their chunks, for encoders that never join ids across certain boundaries.

A batch of texts is cut into chunks, equal chunks are found by a dictionary encoding in Arrow, and only chunks
that a worker has not met lately are encoded. The ids of all texts are then gathered in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

#: Characters of the texts that are worked on at once; a longer text is worked on alone.
PORTION = 2_500_000
#: Chunks longer than this are not remembered.
LONGEST_KEPT = 64


def joined(batches: Iterator, column: str = "text") -> Iterator:
    """Small frames put together to about a portion each, so that more equal chunks meet."""
    import pandas as pd

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += sum(len(t) for t in batch[column] if t)
        if size >= PORTION:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


class ChunkEncoder:
    """Cuts texts into chunks, has unseen chunks encoded by `learn`, and remembers those that are likely to come again.

    `mark` gives a text with a NUL character at each cut; where that is None, or one of the chunks is `unsafe` (cut
    off where it must not be; told for an Arrow array of chunks), the text is cut by `split`. `learn` gives the ids
    of a list of chunks, end to end, and how many each has. Chunks met twice in a portion are remembered, in two generations: chunks
    met again move to the younger one, and when that holds `size` chunks the older one is forgotten.
    """

    def __init__(self, mark: Callable, unsafe: Callable, split: Callable, learn: Callable, size: int):
        self.mark, self.unsafe, self.split, self.learn, self.size = mark, unsafe, split, learn, size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> Iterator:
        """An array of unsigned 32-bit ids for every text, in order."""
        at = 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and (held == 0 or held + len(texts[to]) <= PORTION):
                held += len(texts[to])
                to += 1
            yield from self._portion(texts[at:to])
            at = to

    def _chunks(self, texts: list[str]):
        """Distinct chunks, the number of each chunk of all texts, and the ends of the texts among these."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        marked = [self.mark(t) for t in texts]
        lists = pc.split_pattern(pa.array(["" if m is None else m for m in marked], pa.large_string()), "\0")
        coded = lists.flatten().dictionary_encode()
        dictionary, numbers = coded.dictionary, coded.indices.to_numpy()
        names, ends = dictionary.to_numpy(zero_copy_only=False).tolist(), lists.offsets.to_numpy()[1:]
        again = {i for i, m in enumerate(marked) if m is None}
        del coded, marked[:]
        bad = self.unsafe(dictionary).to_numpy(zero_copy_only=False)
        if bad.any():
            again.update(np.searchsorted(ends, np.flatnonzero(bad[numbers]), side="right").tolist())
        if not again:
            return names, numbers, ends
        place = {n: i for i, n in enumerate(names)}
        parts, sizes, at = [], [], 0
        for i, end in enumerate(ends.tolist()):
            mine = [place.setdefault(c, len(place)) for c in self.split(texts[i])] if i in again else numbers[at:end]
            parts.append(np.asarray(mine, dtype=np.int32))
            sizes.append(len(mine))
            at = end
        return list(place), np.concatenate(parts), np.cumsum(sizes)

    def _portion(self, texts: list[str]) -> Iterator:
        import numpy as np

        names, numbers, ends = self._chunks(texts)
        found = list(map(self.young.get, names))
        missing = [i for i, blob in enumerate(found) if blob is None]
        if missing and self.old:
            again = {i: blob for i in missing if (blob := self.old.get(names[i])) is not None}
            for i, blob in again.items():
                found[i] = self.young[names[i]] = blob
            missing = [i for i in missing if i not in again]
        known = b"".join(blob for blob in found if blob is not None)
        flat = np.frombuffer(known, dtype="<u4")
        sizes = np.fromiter((0 if blob is None else len(blob) for blob in found), dtype=np.int32, count=len(found)) // 4
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        if missing:
            new, lengths = self.learn([names[i] for i in missing])
            at = np.cumsum(lengths, dtype=np.int32) - lengths
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            often = np.bincount(numbers, minlength=len(names))[missing] > 1
            for k in np.flatnonzero(often).tolist():
                name = names[missing[k]]
                if len(name) <= LONGEST_KEPT:
                    self.young[name] = new[at[k] : at[k] + lengths[k]].tobytes()
            sizes[missing], starts[missing] = lengths, at + len(flat)
            flat = np.concatenate([flat, new])
        ids, upto = spread(flat, starts[numbers], sizes[numbers])
        upto = np.concatenate([[0], upto])
        for a, b in zip(upto[np.concatenate([[0], ends[:-1]])].tolist(), upto[ends].tolist(), strict=True):
            yield ids[a:b]


def spread(flat, starts, sizes):
    """The stretches of `flat` with these starts and sizes, end to end, and where each ends."""
    import numpy as np

    upto = np.cumsum(sizes, dtype=np.int64)
    place = np.arange(upto[-1] if len(upto) else 0, dtype=np.int32)
    place += np.repeat(starts - (upto - sizes).astype(np.int32), sizes)
    return flat[place], upto
