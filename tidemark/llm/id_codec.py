"""Byte-aligned variable-length coding of token ids, with the control bytes apart from the data bytes.

A block ranks its ids by frequency (ties: smaller id first) and stores each rank in as few bytes as it
needs. A control byte holds the lengths of four ranks, two bits each, first rank lowest. Decoding looks
four lengths up per control byte and gathers the ranks; nothing loops over ids.
"""

from __future__ import annotations

import numpy as np

#: The four lengths that each control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1
#: What to keep of four data bytes, by length.
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def rank_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, most frequent first, and the rank of each id."""
    if ids.dtype.itemsize == 2:
        counts = np.bincount(ids, minlength=1)
        distinct = np.flatnonzero(counts)
        order = distinct[np.argsort(-counts[distinct], kind="stable")]
        ranks = np.zeros(len(counts), np.uint32)
        ranks[order] = np.arange(len(order), dtype=np.uint32)
        return order.astype("<u4"), ranks[ids]
    distinct, where, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    ranks = np.empty(len(order), np.uint32)
    ranks[order] = np.arange(len(order), dtype=np.uint32)
    return distinct[order].astype("<u4"), ranks[where]


def encode(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Rank table, control bytes and data bytes of a block."""
    order, ranks = rank_ids(ids)
    ranks = ranks.astype("<u4")
    lengths = np.ones(len(ranks), np.uint8)
    for bound in (0xFF, 0xFFFF, 0xFFFFFF):
        lengths += ranks > bound
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    longest = int(lengths.max(initial=1))
    data = ranks.view(np.uint8).reshape(-1, 4)[:, :longest][np.arange(longest) < lengths[:, None]]
    return order.tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()


def decode(table: bytes, control: bytes, data: bytes, n_ids: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n_ids]
    starts = np.cumsum(lengths) - lengths
    window = np.ndarray((len(data),), "<u4", data + b"\0\0\0", strides=(1,))
    return np.frombuffer(table, "<u4")[window[starts] & MASKS[lengths]]
