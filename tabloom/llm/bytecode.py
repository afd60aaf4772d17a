"""Byte-aligned variable-length integers with the control bits apart from the data bytes.

A value takes 1 to 4 data bytes (little endian); its length less one is a two-bit code, four codes to a control byte,
the first in the lowest bits. Decoding looks each control byte up in a table of its four lengths.
"""

from __future__ import annotations

import numpy as np

#: The four length codes of each control byte.
TABLE = np.array([[b >> s & 3 for s in (0, 2, 4, 6)] for b in range(256)], dtype=np.uint8)
_BYTE = np.arange(4, dtype=np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    code = (v > 0xFF).astype(np.uint8)
    code += v > 0xFFFF
    code += v > 0xFFFFFF
    full = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    full[: len(v)] = code
    full = full.reshape(-1, 4)
    control = full[:, 0] | full[:, 1] << 2 | full[:, 2] << 4 | full[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[_BYTE <= code[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def pack_rows(values: np.ndarray, n: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """``pack`` for each of consecutive runs of ``n`` values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    code = (v > 0xFF).astype(np.uint8)
    code += v > 0xFFFF
    code += v > 0xFFFFFF
    data = memoryview(v.view(np.uint8).reshape(-1, 4)[_BYTE <= code[:, None]].tobytes())
    room = -(-n // 4) * 4
    full = np.zeros(int(room.sum()), np.uint8)
    full[np.arange(len(v)) + np.repeat(np.cumsum(room - n) - (room - n), n)] = code
    full = full.reshape(-1, 4)
    control = memoryview((full[:, 0] | full[:, 1] << 2 | full[:, 2] << 4 | full[:, 3] << 6).astype(np.uint8).tobytes())
    ends = np.concatenate([[0], np.cumsum(code, dtype=np.int64) + np.arange(1, len(v) + 1)])[np.concatenate([[0], np.cumsum(n)])].tolist()
    stops = np.concatenate([[0], np.cumsum(room // 4)]).tolist()
    return [control[a:b].tobytes() for a, b in zip(stops, stops[1:])], [data[a:b].tobytes() for a, b in zip(ends, ends[1:])]


def unpack_codes(codes: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The values, from their length codes and the data bytes."""
    ends = np.cumsum(codes.astype(np.int64) + 1)
    at = ends - codes - 1
    out = data[at].astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(codes >= k)
        if len(more):
            out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """``n`` values from what ``pack`` made."""
    codes = TABLE[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    return unpack_codes(codes, np.frombuffer(data, np.uint8))
