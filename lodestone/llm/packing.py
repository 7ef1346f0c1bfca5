"""Best-fit packing of tokenised documents into sequences by minimum bin slack.

Token lengths run from 1 to the sequence length, so the whole corpus is described by a histogram of at
most `capacity` entries. The bins are planned on that histogram: each round fixes the longest remaining
length, finds by a bitset subset-sum over the available lengths (with their multiplicities) the fullest
feasible combination, and removes it as many times at once as the counts allow. Pieces then find their
place by their rank among the pieces of the same length, which is counted in salted buckets, so no
length, however frequent, meets in one task.

Edge cases: a null text counts as empty and gives one piece holding only the end id; texts of any length
are cut into full pieces behind one shorter first piece; repeated ids and texts are packed separately; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.chunks import ChunkEncoder, joined, spread
from lodestone.llm.shared import map_batches, materialize, table

CAPACITY = 1024
END_ID = 2
#: Rows of one salted bucket of a length, on average.
BUCKET_ROWS = 4096
#: Text chunks of one generation whose ids a worker keeps; there are two generations (about 160 bytes a chunk).
CACHE = 120_000
#: Marks of the tokenizer's class of neither letters, digits nor spaces; no apostrophe, which can start a contraction.
MARKS = ".,;:!?#*$%&|<>"


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The longest available length, and with it the combination of the others that leaves least slack.

    Subset sums are bitsets in Python integers; multiplicities are split into powers of two. Longer
    lengths come first, and the search ends as soon as the bin is full, so ties favour long pieces.
    """
    longest = max(counts)
    room = capacity - longest
    used = {longest: 1}
    if not room:
        return used
    mask = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        chunk = 1
        while left > 0:
            take = min(chunk, left)
            grown = (reach | (reach << (take * length))) & mask
            if grown != reach:
                trail.append((length, take, reach))
                reach = grown
            left -= take
            chunk *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for length, take, before in reversed(trail):
        if not before >> at & 1:
            at -= take * length
            used[length] = used.get(length, 0) + take
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Segments (length, first rank, per sequence, first sequence, offset) and the number of sequences."""
    left = {k: v for k, v in counts.items() if v > 0}
    ranks = dict.fromkeys(left, 0)
    segments, sequence = [], 0
    while left:
        used = fullest(left, capacity)
        times = min(left[k] // n for k, n in used.items())
        offset = 0
        for length, n in used.items():
            segments.append((length, ranks[length], n, sequence, offset))
            ranks[length] += times * n
            offset += n * length
            left[length] -= times * n
            if not left[length]:
                del left[length]
        sequence += times
    return segments, sequence


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or one from 256 on."""
    printable = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    others = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}


@lru_cache(maxsize=1)
def id_encoder(tokenizer_path: str, cache_size: int = CACHE) -> ChunkEncoder:
    """An encoder of texts, kept by a worker process from task to task.

    The byte-level tokenizer first cuts a text into words (an optional space and letters, digits or other signs) and
    never joins ids across them. Texts are cut before spaces and line ends that follow anything but white space, and
    before spaces only where chunks would end in white space. A chunk that is a space or line end, letters and then
    marks is three words at most, so the letters are encoded together with other chunks', without a search for
    words. A text that spells a special token is one chunk.
    """
    import os
    import re

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    #: A task has one core; the library's thread pool would take those of its neighbours.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import CharDelimiterSplit

    tokenizer = Tokenizer.from_file(tokenizer_path)
    special = [x.content for x in tokenizer.get_added_tokens_decoder().values() if x.special]
    #: Ids that start with a space.
    opens = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    opens[[i for token, i in tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
    cut_spaces = re.compile(r"(?<=\S)(?= )").split
    #: Words that are written as byte-level symbols already are split at line ends instead.
    search_words, split_lines = tokenizer.pre_tokenizer, CharDelimiterSplit("\n")
    symbols = byte_symbols() | {10: "\n", 256: byte_symbols()[10]}

    def ids_of(texts: list[str], splitter=search_words) -> list:
        tokenizer.pre_tokenizer = splitter
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4") for x in found]

    line_end = int(ids_of(["\n"])[0][0])

    def encoded(texts: list[str]) -> tuple:
        """Ids of single texts, end to end, and how many each has."""
        parts = ids_of(texts)
        return np.concatenate([*parts, np.empty(0, "<u4")]), np.fromiter(map(len, parts), dtype=np.int32, count=len(parts))

    def encoded_words(words: list[str], led: bool) -> tuple:
        """The same of words that start with a space, or with a line end that stands before each as a word of its own."""
        lines = ("\n".join(words[at : at + 1000]).encode().decode("latin-1").translate(symbols) for at in range(0, len(words), 1000))
        lines = [f"{symbols[256]}\n" + x.replace("\n", f"\n{symbols[256]}\n") if led else x for x in lines]
        ids = np.concatenate([*ids_of(lines, split_lines), np.empty(0, "<u4")])
        first = np.flatnonzero(ids == line_end if led else opens[ids])
        return ids, np.diff(np.append(first, len(ids))).astype(np.int32)

    def learn(unseen: list[str]) -> tuple:
        chunks = pa.array(unseen, pa.large_string())
        cores = pc.utf8_rtrim(chunks, MARKS)
        worded = pc.match_substring_regex(cores, r"^[ \n]\pL+$").to_numpy(zero_copy_only=False)
        coded = cores.filter(pa.array(worded)).dictionary_encode()
        spaced = pc.starts_with(coded.dictionary, " ").to_numpy(zero_copy_only=False)
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        tailed = worded & pc.not_equal(pc.binary_length(cores), pc.binary_length(chunks)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(tailed).tolist()
        kept = pc.utf8_length(cores).to_numpy(zero_copy_only=False)[tailed].tolist()
        tails = [unseen[i][n:] for i, n in zip(at, kept, strict=True)]
        marks = {t: k for k, t in enumerate(dict.fromkeys(tails))}
        odd = np.flatnonzero(~worded).tolist()
        parts = [encoded_words(words[spaced].tolist(), False), encoded_words([w[1:] for w in words[~spaced].tolist()], True), encoded([unseen[i] for i in odd]), encoded(list(marks))]
        flat, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        # Places among the parts: of a word, of a whole chunk, of the marks behind a word.
        of_word = np.empty(len(words), dtype=np.int32)
        of_word[spaced], of_word[~spaced] = np.arange(spaced.sum()), spaced.sum() + np.arange((~spaced).sum())
        body = np.empty(len(unseen), dtype=np.int32)
        body[worded], body[~worded] = of_word[coded.indices.to_numpy()], len(words) + np.arange(len(odd))
        pair = np.full((len(unseen), 2), -1, dtype=np.int32)
        pair[:, 0] = body
        pair[tailed, 1] = len(words) + len(odd) + np.fromiter(map(marks.__getitem__, tails), dtype=np.int32, count=len(tails))
        lengths = np.where(pair < 0, 0, sizes[pair]).astype(np.int32)
        ids, _ = spread(flat, np.where(pair < 0, 0, starts[pair]).astype(np.int32).ravel(), lengths.ravel())
        return ids, lengths.sum(axis=1, dtype=np.int32)

    def mark(text: str) -> str | None:
        if "\0" in text or any(x in text for x in special):
            return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n")

    def split(text: str) -> list[str]:
        return [text] if any(x in text for x in special) else cut_spaces(text)

    def unsafe(chunks):
        return pc.match_substring_regex(chunks, r"[\s\x1c-\x1f\x{85}\pZ]$")

    return ChunkEncoder(mark, unsafe, split, learn, cache_size)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first, if there is more than one."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; one narrow pass over the texts."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        encoder = id_encoder(tokenizer_path)
        end = end_id.to_bytes(4, "little")
        for batch in joined(batches):
            rows = []
            coded = encoder.encode([t or "" for t in batch["text"].tolist()])
            for doc_id, ids in zip(batch["doc_id"].tolist(), coded, strict=True):
                raw = ids.tobytes() + end
                for piece, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                    rows.append((doc_id, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema, rows=1000)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...) by minimum bin slack.

    `pieces` is read three times, so hand over a written table. Only the histogram of lengths (at most
    `capacity` rows) comes to the driver; only the plan built from it goes to the workers.
    """
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    segments, _ = plan(counts, capacity)
    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = salted.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    mine = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(mine) - 1).join(sizes, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("nth") + F.col("ahead")).drop("nth", "ahead", "bucket")
    order = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")

    def place(batches: Iterator) -> Iterator:
        import numpy as np

        known = np.array(sorted(segments), dtype=np.int64).reshape(-1, 5)
        #: Length and first rank in one number: ranks stay below 2 ** 48.
        starts = (known[:, 0] << 48) | known[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            at = np.searchsorted(starts, (length << 48) | rank, side="right") - 1
            inside = rank - known[at, 1]
            each = known[at, 2]
            out = batch[order].copy()
            out["sequence_id"] = known[at, 3] + inside // each
            out["offset"] = known[at, 4] + (inside % each) * length
            yield out

    return map_batches(ranked, place, schema + ", sequence_id long, offset long", rows=65536)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(tokenized_pieces(docs, tokenizer_path, capacity)), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
