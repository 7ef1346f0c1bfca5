"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint is 64 bits, cut into a ring of five segments. If two fingerprints differ in at most two
bits, some start on the ring has a chain of segments whose cumulative differences stay within the
proportional budget 2 l / 5 at every length l: 0 bits over one and over two segments, 1 over three and
over four, 2 over five. So candidates share two consecutive segments (25 or 26 bits) exactly, and the
rest of the chain prunes them before the full Hamming check. Equal fingerprints are merged before any
candidate is looked for; buckets are compared in blocks and give back spanning links only.

Edge cases: a null text counts as empty; texts without a word have fingerprint zero and link like any
other; texts of one or two words use the whole sequence as their only shingle; a bit set in exactly half the
shingles is 0; repeated rows are kept; rows are what is linked, so an id under two texts is in the component of each; null ids get a component only through their fingerprint, and ids keep all 64
bits beside them; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import blocked_buckets, by_sorted_key, join_hot, labelled_components, map_batches, materialize, run_pairs, stars, table

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: First bit and width of the segments, in ring order.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))



def shingle_hashes(text: str | None, shingle: int, seed: int):
    """XXH64 of every shingle of a text in order, repeats included; of the whole sequence where words are fewer."""
    import numpy as np
    from xxhash import xxh64_intdigest

    #: On bytes, lower() touches A-Z only and split() knows just the space and tab to carriage return.
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter((xxh64_intdigest(p, seed) for p in parts), dtype="<u8")


def majority(hashes):
    """The bits set in over half the rows of a matrix of 64-bit numbers, as an array of zeros and ones."""
    import numpy as np

    bits = 64 * hashes.shape[1]
    counts = np.zeros(bits, dtype=np.int64)
    for at in range(0, len(hashes), 65536 // hashes.shape[1]):
        part = np.ascontiguousarray(hashes[at : at + 65536 // hashes.shape[1]]).view(np.uint8).reshape(-1, bits // 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return (2 * counts > len(hashes)).astype(np.uint8)


def within_ring(differ, first, max_bits: int):
    """Which rows of a matrix of segment differences keep the chain from the ring's segment `first` within budget.

    Every run of l segments from there may differ in at most max_bits * l / (segments) bits; over the whole ring
    that is the Hamming distance.
    """
    import numpy as np

    n = differ.shape[1]
    turned = differ[np.arange(len(differ))[:, None], (np.asarray(first)[:, None] + np.arange(n)) % n]
    return (np.cumsum(turned, axis=1) * n <= max_bits * np.arange(1, n + 1)).all(axis=1)


def some_ring(differ, max_bits: int):
    """Which rows have a chain within budget from at least one segment: none that is within max_bits lacks one."""
    import numpy as np

    good = differ.sum(axis=1) <= max_bits
    for first in range(differ.shape[1] if good.any() else 0):
        open_rows = np.flatnonzero(good) if first == 0 else missing
        ok = within_ring(differ[open_rows], np.full(len(open_rows), first), max_bits)
        missing = open_rows[~ok]
        if not len(missing):
            return good
    if good.any():
        good[missing] = False
    return good


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and fingerprint (a signed long holding the 64 bits); one narrow pass over whole texts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            out = []
            for text in batch["text"].tolist():
                h = shingle_hashes(text, shingle, seed)
                out.append(int(np.packbits(majority(h[:, None]), bitorder="little").view("<i8")[0]) if len(h) else 0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": np.array(out, dtype=np.int64)})

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (fp) at most two bits apart."""
    if max_bits != 2:
        raise ValueError("the ring of five segments is laid out for two bits")
    masks = [((1 << width) - 1) << low for low, width in SEGMENTS]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    starts = F.array(
        *(
            F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(signed[i] | signed[(i + 1) % 5]).cast("long")).alias("pair"))
            for i in range(5)
        )
    )
    members = classes.select("fp", F.explode(starts).alias("s")).select("fp", "s.start", "s.pair")
    dealt = blocked_buckets(members, ["start", "pair"], "fp")

    def compare(rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values("task", kind="stable")
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
        own, start = fp.view(np.int64), rows["start"].to_numpy()
        ring = np.array(masks, dtype=np.uint64)
        a, b = [], []
        for i, j in run_pairs(*(rows[c].to_numpy() for c in ("task", "mine", "other"))):
            apart = fp[i] ^ fp[j]
            good = within_ring(np.bitwise_count(apart[:, None] & ring).astype(np.int64), start[i], max_bits)
            good &= np.bitwise_count(apart) <= max_bits
            a.append(own[i[good]])
            b.append(own[j[good]])
        if not a or not sum(map(len, a)):
            return None
        node, root = stars(np.concatenate(a), np.concatenate(b))
        return pd.DataFrame({"a": node, "b": root})

    return by_sorted_key(dealt, "task", compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) for every row of `docs`."""
    prints = materialize(fingerprints(docs))
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    named = labelled_components(classes, links(classes), "fp", "rep").select("fp", "copies", "component_id")
    return join_hot(prints, named, "fp", "copies")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
