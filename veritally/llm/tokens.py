"""What the tokenizer operators share: texts cut into chunks, and rows of varying length.

Texts repeat their words, so a tokenizer is run once on each different chunk of some megabytes of
text. A chunk starts at a single space between two characters that are no white space in any
version of Unicode. The split patterns of byte-level vocabularies always cut there, and what they
see on either side does not depend on the other side; so chunks can be encoded on their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_VISIBLE = np.zeros(256, bool)  # ASCII without blanks and controls
_VISIBLE[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)  # leads a two-byte character from U+00C0 on: no white space among them
_LEAD[0xC3:0xE0] = True


def chunk_ends(text: np.ndarray, ends: np.ndarray, cut: bool = True) -> np.ndarray:
    """Ends of the chunks of all rows, led by 0; every end of a row is one."""
    if not cut or len(text) < 3:
        return np.unique(ends)
    before, after = text[:-2], text[2:]
    here = (text[1:-1] == 0x20) & (_VISIBLE[after] | _LEAD[after])
    wide = np.zeros(len(before), bool)
    wide[1:] = (before[1:] >= 0x80) & _LEAD[text[:-3]]
    marks = np.zeros(len(text) + 1, bool)
    marks[1:-2] = here & (_VISIBLE[before] | wide)
    stops = ends[1:][np.diff(ends) > 0]
    marks[stops - 1] = False  # the space at the end of a row stays with what stands before it
    marks[ends] = True
    return np.flatnonzero(marks)


def distinct_chunks(text: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number of each chunk's content, and the contents."""
    data = pa.py_buffer(np.ascontiguousarray(text))
    if len(stops) < 2:
        return np.zeros(0, np.int32), pa.array([], pa.large_binary())
    chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops) - 1, [None, pa.py_buffer(stops.astype(np.int64).tobytes()), data])
    coded = chunks.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def pick(values: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of these rows one after the other, and where each row ends (led by 0)."""
    size = ends[rows + 1] - ends[rows]
    out = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return values[np.arange(out[-1]) + np.repeat(ends[rows] - out[:-1], size)], out


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of rows that lie behind one another; the ends are counted in bytes."""
    raw = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw)])
