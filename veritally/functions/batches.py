"""Worker-side helper: score one Arrow batch of payloads."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa

NO_PAYLOAD = "no payload"
NO_MODEL = "no model"
NO_SCORE = "no finite score"


def score_batch(
    payloads: pa.Array,
    model: Any,
    decode: Callable[[pa.Array], np.ndarray],
    forward: Callable[[Any, np.ndarray], np.ndarray],
    rows_per_pass: int,
) -> pa.StructArray:
    """One decoding and one forward pass per `rows_per_pass` rows; a bad row only fails itself.
    `decode` gets a slice of the batch, without missing payloads."""
    there = payloads.is_valid().to_numpy(zero_copy_only=False)
    present = np.flatnonzero(there)
    values = payloads if len(present) == len(payloads) else payloads.take(pa.array(present))
    scores, errors = np.full(len(values), np.nan), {}
    for start in range(0, len(values), rows_per_pass):
        _score_rows(start, min(start + rows_per_pass, len(values)), values, model, decode, forward, scores, errors)
    found = np.full(len(payloads), np.nan)
    found[present] = scores
    reasons = np.full(len(payloads), None, dtype=object)
    reasons[np.isnan(found)] = NO_SCORE
    reasons[~there] = NO_PAYLOAD
    for at, problem in errors.items():
        reasons[present[at]] = problem
    return _result(found, reasons)


def _score_rows(start, stop, values, model, decode, forward, scores, errors) -> None:
    """All rows at once; if that fails, in halves, down to the rows that are to blame."""
    try:
        result = np.asarray(forward(model, decode(values.slice(start, stop - start))), dtype=np.float64)
        scores[start:stop] = np.where(np.isfinite(result), result, np.nan)
    except MemoryError:
        raise
    except Exception as problem:
        if stop - start == 1:
            errors[start] = f"{type(problem).__name__}: {problem}"
            return
        half = (start + stop) // 2
        for a, b in ((start, half), (half, stop)):
            _score_rows(a, b, values, model, decode, forward, scores, errors)


def unscored_batch(payloads: pa.Array) -> pa.StructArray:
    """Batch result when there is no model and the caller chose to go on without one."""
    return _result(np.full(len(payloads), np.nan), np.full(len(payloads), NO_MODEL, dtype=object))


def _result(scores: np.ndarray, reasons: np.ndarray) -> pa.StructArray:
    columns = [pa.array(scores, pa.float64(), mask=np.isnan(scores)), pa.array(reasons, pa.string())]
    return pa.StructArray.from_arrays(columns, names=["score", "error"])
