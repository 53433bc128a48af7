"""Index terms of whole Arrow columns: what ``text.tokenize`` gives, without a call per term."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.functions.text import BREAKS, STOP_WORDS

#: The two characters beyond ASCII whose small form has an ASCII letter.
FOLDED = {"\u0130": "i", "\u212a": "k"}


def _table(legacy: bool) -> np.ndarray:
    """What every byte becomes; 0 is dropped."""
    table = np.zeros(256, dtype=np.uint8)
    for c in b"abcdefghijklmnopqrstuvwxyz0123456789 ":
        table[c] = c
        table[ord(chr(c).upper())] = c
    if not legacy:
        table[[ord(c) for c in BREAKS if ord(c) < 128]] = ord(" ")
    return table


TABLES = {legacy: _table(legacy) for legacy in (False, True)}
WIDE_BREAKS = "[" + "".join(c for c in BREAKS if ord(c) >= 128) + "]"


def index_terms(texts: pa.Array, legacy: bool = False) -> pa.ListArray:
    """Lists of index terms of texts; a null text has a null list."""
    texts = pc.cast(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, pa.string())
    if not pc.all(pc.string_is_ascii(texts)).as_py():
        for wide, plain in FOLDED.items():
            texts = pc.replace_substring(texts, wide, plain)
        if not legacy:
            texts = pc.replace_substring_regex(texts, WIDE_BREAKS, " ")
    n, buffers = len(texts), texts.buffers()
    at = np.frombuffer(buffers[1], dtype=np.int32)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, dtype=np.int32)
    data = TABLES[legacy][np.frombuffer(buffers[2] or b"", dtype=np.uint8)[at[0]:at[-1]]]
    kept = data != 0
    before = np.concatenate([[0], np.cumsum(kept)])[at - at[0]].astype(np.int32)
    cleaned = pa.StringArray.from_buffers(n, pa.py_buffer(before), pa.py_buffer(data[kept]))
    parts = pc.split_pattern(cleaned, " ")
    flat = parts.flatten()
    wanted = pc.and_(pc.greater(pc.binary_length(flat), 1), pc.invert(pc.is_in(flat, value_set=pa.array(STOP_WORDS, flat.type))))
    ends = np.concatenate([[0], np.cumsum(np.asarray(parts.value_lengths(), dtype=np.int64))])
    left = np.concatenate([[0], np.cumsum(wanted.to_numpy(zero_copy_only=False))])[ends].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(left), flat.filter(wanted), mask=pc.is_null(texts))
