"""Words of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, offsets, hashes): text i has the words codes[offsets[i]:offsets[i+1]]; hashes[code] is a word's xxh3.

    A-Z count as a-z; words are apart by space and U+0009 to U+000D. A null text has no words.
    """
    # large_string: the batch may hold more than 2 GB of text
    whole = texts.take(pa.array(np.arange(len(texts))))  # a copy: the kernels below misread the offset of a slice
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(whole.cast(pa.large_string()), "")))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    codes = flat.indices.to_numpy(zero_copy_only=False)
    words = flat.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    if b"" in words:  # white space at either end of a text gives an empty word
        real = codes != words.index(b"")
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return codes, offsets, hashes
