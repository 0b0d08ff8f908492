"""Arrow functions: the few per-value computations Spark has no built-in for."""

from __future__ import annotations

import gzip
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as S

MERSENNE_31 = (1 << 31) - 1
MERSENNE_61 = (1 << 61) - 1
NUM_PERM = 64
PERM_SEED = 1234
_SPACES = np.array(
    [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
     0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    dtype=np.uint32,
)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


ROWS = 64  # texts of a batch that are Python strings at a time


def text_slices(values: pa.Array) -> Iterator[list]:
    for start in range(0, len(values), ROWS):
        yield values.slice(start, ROWS).to_pylist()


@F.arrow_udf(S.StringType())
def nfc_text(values: pa.Array) -> pa.Array:
    parts = [pa.array([None if v is None else unicodedata.normalize("NFC", v) for v in part], type=pa.string()) for part in text_slices(values)]
    return pa.concat_arrays(parts) if parts else pa.array([], type=pa.string())


def _top_share(text: str) -> float:
    points = code_points(text)
    if points.size == 0:
        return 1.0
    if int(points.max()) <= 0xFFFF:
        counts = np.bincount(points, minlength=0x3001)
        counts[_SPACES] = 0
    else:
        symbols, counts = np.unique(points, return_counts=True)
        counts = counts[~np.isin(symbols, _SPACES)]
    total = int(counts.sum())
    return float(counts.max() / total) if total else 1.0


@F.arrow_udf(S.DoubleType())
def top_char_share(values: pa.Array) -> pa.Array:
    return pa.array(
        [None if v is None else _top_share(v) for part in text_slices(values) for v in part], type=pa.float64()
    )


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC_TABLE = _crc_table()


def _advanced_tables(steps: int) -> np.ndarray:
    """Row k: what each byte value contributes when k more bytes follow it."""
    rows = [CRC_TABLE]
    for _ in range(steps - 1):
        rows.append((rows[-1] >> 8) ^ CRC_TABLE[rows[-1] & 0xFF])
    return np.stack(rows)


MAX_WIDTH = 32  # bytes of a window that are looked up directly: eight 4-byte characters
CRC_ADVANCED = _advanced_tables(MAX_WIDTH)


def window_crc32(text: str, k: int) -> np.ndarray:
    """CRC-32 of the UTF-8 bytes of every k-character window of ``text``.

    CRC is linear, so a window of w bytes is the XOR of one table entry per
    byte and the checksum of w zero bytes; windows are grouped by width.
    """
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    if starts.size <= k:
        return np.array([zlib.crc32(raw.tobytes())], dtype=np.uint32)
    if starts.size == raw.size:
        return _fixed_width_crc(raw, k, slice(0, raw.size - k + 1))
    begin = starts[: starts.size - k + 1]
    width = np.append(starts[k:], raw.size) - begin
    out = np.empty(begin.size, dtype=np.uint32)
    for w in np.flatnonzero(np.bincount(width)):
        at = np.flatnonzero(width == w)
        out[at] = _fixed_width_crc(raw, int(w), begin[at])
    return out


def _fixed_width_crc(raw: np.ndarray, width: int, begin) -> np.ndarray:
    total = np.uint32(zlib.crc32(bytes(width)) ^ int(np.bitwise_xor.reduce(CRC_ADVANCED[:width, 0])))
    for j in range(width):
        column = raw[begin.start + j : begin.stop + j] if isinstance(begin, slice) else raw[begin + j]
        total = total ^ CRC_ADVANCED[width - 1 - j][column]
    return total


def permutations(num_perm: int = NUM_PERM, seed: int = PERM_SEED) -> tuple[np.ndarray, np.ndarray]:
    """Seeded multipliers and offsets of the hash family, modulo 2^31-1."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, MERSENNE_31, size=num_perm, dtype=np.int64)
    b = rng.integers(0, MERSENNE_31, size=num_perm, dtype=np.int64)
    return a.astype(np.uint64), b.astype(np.uint64)


def wide_permutations(num_perm: int = NUM_PERM, seed: int = 12345) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets below 2^30 for the family modulo 2^61-1."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 30, size=num_perm, dtype=np.int64) | 1
    b = rng.integers(0, 1 << 30, size=num_perm, dtype=np.int64)
    return a.astype(np.uint64), b.astype(np.uint64)


def _folded_minimum(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int, width: int = 1024) -> np.ndarray:
    """min over hashes of (a*h + b) mod (2^bits - 1), by folding instead of division.

    Buffers small enough for the processor cache are reused throughout.  One
    fold leaves at most 2^(bits+1) - 1; subtracting the prime wraps around for
    values that are already below it, so the smaller of both is reduced.  The
    two values that would need a second subtraction take the slow branch.
    """
    narrow = np.uint32 if bits == 31 else np.uint64
    prime, shift, small = np.uint64((1 << bits) - 1), np.uint64(bits), narrow((1 << bits) - 1)
    best = np.full(a.size, small, dtype=narrow)
    wide = np.empty((a.size, width), dtype=np.uint64)
    high = np.empty_like(wide)
    folded, lowered = np.empty(wide.shape, dtype=narrow), np.empty(wide.shape, dtype=narrow)
    for at in range(0, hashes.size, width):
        part = hashes[at : at + width]
        x, y, f, low = (buffer[:, : part.size] for buffer in (wide, high, folded, lowered))
        np.multiply(a[:, None], part, out=x)
        x += b[:, None]
        np.right_shift(x, shift, out=y)
        x &= prime
        x += y
        np.copyto(f, x, casting="unsafe")
        np.subtract(f, small, out=low)
        np.minimum(f, low, out=f)
        if f.max() >= small:
            f[f >= small] -= small
        np.minimum(best, f.min(axis=1), out=best)
    return best


def signature(text: str, k: int, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    if not text:
        return np.zeros(family[0].size, dtype=np.int64)
    hashes = (window_crc32(text, k) % np.uint32(MERSENNE_31)).astype(np.uint64)
    return _folded_minimum(hashes, *family, bits=31).astype(np.int64)


def wide_signature(text: str, k: int, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    hashes = window_crc32(text, k).astype(np.uint64)
    return _folded_minimum(hashes, *family, bits=61).astype(np.int64)


def _signature_column(build, family, k: int):
    num_perm = family[0].size

    @F.arrow_udf(S.ArrayType(S.LongType()))
    def column(values: pa.Array) -> pa.Array:
        rows = [build(v or "", k, family) for v in values.to_pylist()]
        flat = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * num_perm
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return column


def minhash_column(k: int = 5, num_perm: int = NUM_PERM):
    """Column function: collapsed text -> MinHash signature (empty text -> zeros)."""
    return _signature_column(signature, permutations(num_perm), k)


def wide_minhash_column(k: int = 5, num_perm: int = NUM_PERM):
    return _signature_column(wide_signature, wide_permutations(num_perm), k)


def gzip_size_column(level: int):
    """Column function: text -> size of its gzip stream in bytes."""

    @F.arrow_udf(S.LongType())
    def size(values: pa.Array) -> pa.Array:
        return pa.array(
            [None if v is None else len(gzip.compress(v.encode("utf-8"), compresslevel=level))
             for v in values.to_pylist()],
            type=pa.int64(),
        )

    return size


SPREAD = 2.5  # least bits of a fitted sketch for each member
LEAST_BITS = 512


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(text: str, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the pieces of ``k`` code points; a shorter text is one piece."""
    points = _code_points(text).astype(np.uint64)
    n = max(1, points.size - k + 1)
    hashes = np.full(n, points.size if points.size < k else k, dtype=np.uint64)
    for at in range(min(k, points.size)):
        hashes = (hashes ^ points[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(hashes ^ hashes >> np.uint64(32))


def fitted_sketch(hashes: np.ndarray) -> bytes:
    """Bit b says whether an odd number of the hashes falls on b.

    The number of bits is a power of two that follows from the size of the set.
    Sketches of two sets never differ in more bits than the sets in members.
    """
    bits = max(LEAST_BITS, 1 << int(np.ceil(np.log2(SPREAD * max(1, hashes.size)))))
    places = (hashes & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=bits) & 1).tobytes()


def grams(text: str, k: int, alphabet: dict[str, int]) -> np.ndarray | None:
    """The distinct pieces of ``k`` code points, sorted, each as one number over the alphabet; None if that has too many characters."""
    bits = max(1, len(alphabet).bit_length())
    if bits * k > 64:
        return None
    points = np.array([alphabet[c] for c in text], dtype=np.uint64)
    n = max(1, points.size - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for at in range(min(k, points.size)):
        out = out << np.uint64(bits) | points[at : at + n]
    return np.unique(out)


def shared_grams(x: str, y: str, a: np.ndarray | None, b: np.ndarray | None, k: int) -> tuple[int, int, int]:
    """Sizes of two texts' piece sets and of what they share; ``a`` and ``b`` are the sets as ``grams`` gives them."""
    if a is None or b is None:
        a, b = ({t[p : p + k] for p in range(max(1, len(t) - k + 1))} for t in (x, y))
        return len(a), len(b), len(a & b)
    both = np.sort(np.concatenate([a, b]))
    return a.size, b.size, int((both[1:] == both[:-1]).sum())
