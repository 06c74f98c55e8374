"""Words of Arrow columns of texts, cut and coded without a Python object a word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Words:
    """The words of some texts, one after the other."""

    rows: np.ndarray  # of each word, the number of its text
    codes: np.ndarray  # of each word, its place in `different`
    different: pa.Array  # each different word once
    texts: int

    def per_text(self, weights: np.ndarray | None = None) -> np.ndarray:
        """The number of words of each text, or the sum of their weights."""
        counts = np.bincount(self.rows, weights, minlength=self.texts)
        return counts if weights is None else counts.astype(np.float64)


def words_of(texts: pa.Array, between: str, lower: bool = True) -> Words:
    """between: a regular expression (RE2) for what parts words. Only A-Z are lower-cased; a null text has no words."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    texts = pc.fill_null(texts, "")
    split = pc.split_pattern_regex(pc.ascii_lower(texts) if lower else texts, pattern=between)
    flat, rows = split.flatten(), pc.list_parent_indices(split)
    full = pc.not_equal(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    rows = rows.filter(full).to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(rows, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, len(texts))
