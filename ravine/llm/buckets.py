"""Candidates for similarity joins: MinHash bands, buckets, and units of a bounded size.

A text's class is named by 128 bits of hash over its words, so equal texts are one class from
the start. Each class has a MinHash signature over its word shingles (Broder 1997), cut into
BANDS bands of ROWS minima: two classes whose Jaccard similarity is 0.8 share a band with
probability 1 - (1 - 0.8^ROWS)^BANDS = 0.998, more similar ones nearly always, and at 0.3 one
pair in 70 does. The classes of a band are a bucket; only one of the buckets with the same
classes is kept. Buckets are never joined with each other, so a chain of them grows into no
cluster. A bucket of more than MEMBERS classes or WORDS words is met in parts, every two parts
in a unit of their own, so that no task holds more than two parts.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravine.llm.common import discard, stored

BANDS, ROWS = 20, 6
#: Classes, and words of their texts, of a part of a bucket.
MEMBERS, WORDS = 1024, 1_500_000
#: Shingles whose minima are taken together.
_STEP = 1 << 17
#: Shingles hashed together, which a processor's cache holds.
_CACHED = 1 << 14


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def shingle_hashes(one: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the shingles of width words, in order, from the words' hashes; fewer words than that make one."""
    width = min(width, len(one))
    n = len(one) - width + 1
    out, other = np.full(n, width, np.uint64), np.empty(min(n, _CACHED), np.uint64)
    for s in range(0, n, _CACHED):
        total = out[s : s + _CACHED]
        spare = other[: len(total)]
        for k in range(s, s + width):
            total *= np.uint64(0x9E3779B97F4A7C15)
            total += one[k : k + len(total)]
            total ^= np.right_shift(total, np.uint64(32), out=spare)
        total *= np.uint64(0xD6E8FEB86659FD93)
        total ^= np.right_shift(total, np.uint64(29), out=spare)
    return out


def shingles_of(one: np.ndarray, starts: list[int], sizes: list[int], width: int) -> list[np.ndarray]:
    """shingle_hashes() of texts whose words' hashes lie in one, made together."""
    whole = shingle_hashes(one, width) if len(one) >= width else one
    return [whole[s : s + n - width + 1] if n >= width else shingle_hashes(one[s : s + n], width) for s, n in zip(starts, sizes)]


def digest(words: list[bytes]) -> tuple[int, int]:
    """The two halves of the name of the words' class."""
    whole = xxhash.xxh3_128_intdigest(b" ".join(words))
    return whole >> 64, whole & (2**64 - 1)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    a = rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def band_keys(hashes: list[np.ndarray]) -> np.ndarray:
    """(texts, BANDS) 64-bit keys of the bands of each text's signature."""
    a, b = _coefficients()
    out = np.empty((len(hashes), BANDS), np.uint64)
    sizes = np.array([len(h) for h in hashes])
    group = np.cumsum(sizes) // _STEP
    for g in np.unique(group):
        part = np.flatnonzero(group == g)
        flat = np.concatenate([hashes[i] for i in part])
        at = np.cumsum(sizes[part]) - sizes[part]
        for band in range(BANDS):
            key = np.full(len(part), band, np.uint64)
            for r in range(band * ROWS, band * ROWS + ROWS):
                least = np.minimum.reduceat(flat * a[r] + b[r], at)
                key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            out[part, band] = key
    return out


def name() -> Column:
    """A class's name as 32 hex digits."""
    return F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("high", "low"))).alias("node")


def units(classes: DataFrame) -> DataFrame:
    """(unit, high, low), as a table: which classes (high, low, words, bands) are to be compared with each other."""
    banded = classes.select("high", "low", "words", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("high", "low")).alias("all")).where("n > 1")
    shared = stored(shared.groupBy("n", "all").agg(F.min("band").alias("band")).select("band"), "buckets")
    members = stored(banded.join(shared, "band"), "members")
    need = F.greatest(F.count("*") / MEMBERS, F.sum("words") / WORDS)
    large = stored(members.groupBy("band").agg(F.ceil(need).cast("long").alias("parts")).where("parts > 1"), "large")
    parted = members.join(large, "band", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    met = parted.select("band", "high", "low", F.pmod(F.xxhash64("high", "low"), F.col("parts")).alias("own"), other)
    out = stored(met.select(F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "high", "low"), "units")
    discard(shared, members, large)
    return out


def similar_links(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links (of pairs whose sets' Jaccard similarity is at least threshold) that join whatever such pairs join."""
    sizes = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    seen, rest, queue, links = np.zeros(len(values), bool), np.arange(len(sets)), [], []
    begin = np.cumsum(sizes) - sizes
    while len(rest) or queue:
        if not queue:
            queue.append(int(rest[0]))
            rest = rest[1:]
        if not len(rest):
            break
        if len(owner) > 2 * sizes[rest].sum():
            still = np.isin(owner, rest)
            flat_rest, owner_rest = flat[still], owner[still]
        else:
            flat_rest, owner_rest = flat, owner
        me = queue.pop()
        mine = flat[begin[me] : begin[me] + sizes[me]]
        seen[mine] = True
        shared = np.bincount(owner_rest, weights=seen[flat_rest], minlength=len(sets))[rest]
        seen[mine] = False
        near = shared / (sizes[rest] + sizes[me] - shared) >= threshold
        links += [(me, int(x)) for x in rest[near]]
        queue += rest[near].tolist()
        rest = rest[~near]
    return links
