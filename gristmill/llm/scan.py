"""What the Python-side scans share: small slices of batches, and span digests."""

from __future__ import annotations

import hashlib


#: Rows of an Arrow batch that are Python objects at the same time.
SLICE = 256


def slices(batches):
    """The batches in slices of few rows, so that a worker's memory follows these and not Arrow's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def code_points(data: bytes, offsets: list[int]) -> dict[int, int]:
    """Byte offset -> code-point offset, for offsets on character boundaries."""
    out, at, n = {}, 0, 0
    for offset in sorted(set(offsets)):
        n += len(data[at:offset].decode("utf-8", "surrogatepass"))
        out[offset], at = n, offset
    return out


def joined(spans: list[tuple[str, int, int]], kinds: list[str]) -> str:
    """kind:start:end by start, then by the place of the kind in `kinds`, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2])))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
