"""CRC-32 of many byte strings at once.

CRC-32 is linear over GF(2): the checksum of A followed by B is that of A, carried on over as many zero bytes as B has,
exclusive-or that of B. So the checksums of runs of words come from those of the words, without another look at the text.
"""

from __future__ import annotations

import zlib

import numpy as np

SHORT = 64

#: DuckDB: common table expressions that make the byte table, as a list in ``crc.t``; needs WITH RECURSIVE.
CRC_SQL = """
crc_bits AS (SELECT i AS b, 0 AS k, i::BIGINT AS x FROM range(256) AS r(i)
  UNION ALL SELECT b, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM crc_bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(x ORDER BY b) AS t FROM crc_bits WHERE k = 8)
"""


def crc32_sql(hexed: str) -> str:
    """DuckDB: the unsigned CRC-32 of a string given as hex digits of its UTF-8, where ``crc`` is in scope."""
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length({hexed}) // 2), "
        f"lambda i: ('0x' || substr({hexed}, (2 * i + 1)::INT, 2))::BIGINT)), lambda s, b: xor(t[xor(s & 255, b) + 1], s >> 8)))"
    )


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


BYTE = _byte_table()


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0, x & 255] ^ tables[1, (x >> 8) & 255] ^ tables[2, (x >> 16) & 255] ^ tables[3, x >> 24]


def _over_zeros() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables that carry a checksum on over 0 to SHORT - 1 zero bytes, and over SHORT * 2**k of them."""
    now = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
    few = []
    for _ in range(SHORT):
        few.append(now)
        now = BYTE[now & 255] ^ (now >> 8)
    many = [now]
    for _ in range(34):
        many.append(_apply(many[-1], many[-1]))
    return np.stack(few), many


FEW, MANY = _over_zeros()


def carried(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each checksum, carried on over ``length`` zero bytes."""
    few = length & (SHORT - 1)
    x = FEW[few, 0, crc & 255] ^ FEW[few, 1, (crc >> 8) & 255] ^ FEW[few, 2, (crc >> 16) & 255] ^ FEW[few, 3, crc >> 24]
    rest, k = length // SHORT, 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        x[odd] = _apply(MANY[k], x[odd])
        rest, k = rest >> 1, k + 1
    return x


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of concatenations; ``length``: bytes of the second strings."""
    return carried(first, length) ^ second


def crc32(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each ``raw[start:end]``."""
    length = end - start
    state = np.full(len(start), 0xFFFFFFFF, np.uint32)
    live = np.flatnonzero((length > 0) & (length <= SHORT))
    k = 0
    while len(live):
        s = state[live]
        state[live] = BYTE[(s ^ raw[start[live] + k]) & 255] ^ (s >> 8)
        k += 1
        live = live[length[live] > k]
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > SHORT):
        state[i] = zlib.crc32(raw[start[i] : end[i]])
    return state
