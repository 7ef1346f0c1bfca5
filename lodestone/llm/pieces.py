"""SentencePiece encoding and decoding by a streaming Viterbi search.

The segmentation with the highest total piece score is found left to right. Only the scores of the last
`longest piece` positions are kept; ids are committed whenever the backpointers of all surviving paths
run through one boundary. Where no piece of the vocabulary can cross a position (before a space mark that
follows something else) that happens by itself, so the stretches in between are encoded independently and
remembered. Characters without a piece fall back to their UTF-8 bytes.

The score of a text is the sum of its pieces' scores as the model file gives them; of two equal
segmentations the one whose last differing piece is longer wins. Spaces become U+2581 and one is put in
front, as the model asks for; nothing else is normalised, so decoding gives the text back, except that a
U+2581 in the text itself comes back as a space.

Edge cases: a null or empty text has no ids; a row's whole text, ids and decoded text are held while it is worked
on, the search itself holds what is not yet committed only, with or without spaces; null ids stay null and ids keep
all their bits beside them; repeated rows give repeated results; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.chunks import ChunkEncoder, joined
from lodestone.llm.shared import map_batches, table

MARK = "▁"


@dataclass
class Vocabulary:
    """Pieces as a trie: a node maps a character to the next node, and "" to the (id, score) of the piece ending there."""

    trie: dict
    longest: int
    byte_ids: list[int]
    fallback: float
    text_of: list[bytes]
    marks_only_first: bool

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        trie, text_of, byte_ids = {}, [], [0] * 256
        low, longest, inner = 0.0, 1, False
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:-1], 16)] = i
                text_of.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                text_of.append(b"")
            else:
                node = trie
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = (i, model.get_score(i))
                low, longest, inner = min(low, node[""][1]), max(longest, len(piece)), inner or MARK in piece.lstrip(MARK)
                text_of.append(piece.replace(MARK, " ").encode())
        return cls(trie, longest, byte_ids, low - 10, text_of, not inner)

    def piece(self, text: str) -> tuple[int, float] | None:
        node = self.trie
        for c in text:
            node = node.get(c)
            if node is None:
                return None
        return node.get("")


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file; a worker process keeps it from task to task."""
    return Vocabulary.load(path)


class StreamingViterbi:
    """Feed text in any portions; `feed` returns the ids that are settled, `finish` the rest.

    What is held: the characters since the last committed boundary, and for each of their positions the best score
    and the edge it came by. Positions before `done` have had their outgoing edges laid; a piece reaches at most
    `longest` characters on, so paths survive in a window of that length only.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""  # not yet committed
        self.done = 0  # positions of self.text whose edges have been laid
        self.best: list[float | None] = [0.0]
        self.back: list[tuple[int, int] | None] = [None]  # (from, id; -1 for bytes)
        self.held = 0  # most characters ever kept, for tests

    def _lay(self, upto: int) -> None:
        """Extend every path from each position by all pieces that start there."""
        text, trie, best, back, end = self.text, self.v.trie, self.best, self.back, len(self.text)
        best += [None] * (min(end, upto + self.v.longest) + 1 - len(best))
        back += [None] * (len(best) - len(back))
        for i in range(self.done, upto):
            here = best[i]
            if here is None:
                continue
            node, to, single = trie, i, False
            while to < end and (node := node.get(text[to])) is not None:
                to += 1
                if "" in node:
                    piece, score = node[""]
                    single |= to == i + 1
                    score += here
                    if best[to] is None or score > best[to]:
                        best[to], back[to] = score, (i, piece)
            if not single:
                score = here + self.v.fallback
                if best[i + 1] is None or score > best[i + 1]:
                    best[i + 1], back[i + 1] = score, (i, -1)
        self.done = max(self.done, upto)

    def _ids(self, at: int) -> list[int]:
        out: list[int] = []
        while at:
            start, piece = self.back[at]
            if piece < 0:
                out += reversed([self.v.byte_ids[b] for b in self.text[start:at].encode()])
            else:
                out.append(piece)
            at = start
        return out[::-1]

    def _commit(self) -> list[int]:
        """Ids up to the last boundary through which every surviving path runs; those characters are forgotten."""
        live = {i for i in range(self.done, len(self.best)) if self.best[i] is not None}
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(self.back[top][0])
        at = live.pop()
        ids = self._ids(at)
        self.text, self.done = self.text[at:], self.done - at
        self.best = [None if b is None else b - self.best[at] for b in self.best[at:]]
        self.back = [None, *((b[0] - at, b[1]) if b and b[0] >= at else None for b in self.back[at + 1 :])]
        return ids

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(text), 4 * self.v.longest):
            self.text += text[at : at + 4 * self.v.longest]
            self.held = max(self.held, len(self.text))
            ready = len(self.text) - self.v.longest
            if ready > self.done:
                self._lay(ready)
                out += self._commit()
        return out

    def finish(self) -> list[int]:
        self._lay(len(self.text))
        ids = self._ids(len(self.text))
        self.text, self.done, self.best, self.back = "", 0, [0.0], [None]
        return ids


def encode(text: str | None, v: Vocabulary) -> list[int]:
    """All ids of a text, in one streaming pass."""
    if not text:
        return []
    search = StreamingViterbi(v)
    return search.feed(MARK + text.replace(" ", MARK)) + search.finish()


def decode(ids: Iterable[int], v: Vocabulary) -> str:
    raw = b"".join(map(v.text_of.__getitem__, ids))
    return raw.decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=1)
def stretch_encoder(model_path: str, cache_size: int) -> ChunkEncoder:
    """An encoder of texts by stretches, kept by a worker process from task to task.

    In a vocabulary whose pieces hold marks at their start only, all paths run through the position before a mark
    that follows something else: what lies between two of them is committed there, and can be remembered.
    """
    import re

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    v = vocabulary(model_path)
    search, cut = StreamingViterbi(v), re.compile(f"(?<=[^{MARK}])(?={MARK})").split

    def learn(unseen: list[str]) -> tuple:
        parts = [search.feed(part) + search.finish() for part in unseen]
        sizes = np.fromiter(map(len, parts), dtype=np.int32, count=len(parts))
        return np.fromiter(chain.from_iterable(parts), dtype="<u4", count=int(sizes.sum())), sizes

    def mark(text: str) -> str | None:
        if "\0" in text or MARK in text or not v.marks_only_first:
            return None
        return MARK + text.replace(" ", "\0" + MARK) if text else ""

    def split(text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK) if text else ""
        return cut(marked) if v.marks_only_first else [marked]

    def unsafe(parts):
        return pc.ends_with(parts, MARK) if len(parts) else pa.array([], pa.bool_())

    return ChunkEncoder(mark, unsafe, split, learn, cache_size)


def encode_documents(docs: DataFrame, model_path: str, cache_size: int = 120_000) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit numbers) and decoded text of every row; one narrow pass."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        v, encoder = vocabulary(model_path), stretch_encoder(model_path, cache_size)
        for batch in joined(batches):
            all_ids, back = [], []
            for ids in encoder.encode([t or "" for t in batch["text"].tolist()]):
                all_ids.append(ids.tobytes())
                back.append(decode(ids.tolist(), v))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": all_ids, "decoded": back, "text": batch["text"]})

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(picked, run, "doc_id long, ids binary, decoded string, text string", rows=1000)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and checksum of its ids, checksum of the decoded text, and whether that is the text."""
    import public_tokenizers

    found = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
