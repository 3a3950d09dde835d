"""Word hashes of many texts at once, with NumPy inside a task.

The bytes of a block of texts are one array, and all its words are hashed together: eight
bytes of every word at a time are mixed into its hash, which begins with its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np

BLOCK = 2_000_000
U = np.uint64
#: longer words, in bytes, are hashed one by one
LONG = 512
_ODD = U(0x9E3779B97F4A7C17)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(29))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, after A-Z became a-z. A line feed must not belong."""

    inside: bytes
    gap: str

    @staticmethod
    def excluding(codes: set[int]) -> Alphabet:
        gap = "[" + "".join(re.escape(chr(c)) if chr(c).isprintable() else f"\\x{c:02x}" for c in sorted(codes)) + "]"
        return Alphabet(bytes(c not in codes for c in range(256)), gap)


#: `[^\x20\x09-\x0D]+`
VISIBLE = Alphabet.excluding({0x20, *range(0x09, 0x0E)})
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, upper-case letters counted as their lower-case ones
ALNUM = Alphabet.excluding({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _pieces(texts: list[bytes], alphabet: Alphabet) -> Iterator[tuple[int, bytes]]:
    """Texts, long ones cut between words; a word is never cut."""
    gap = re.compile(alphabet.gap.encode("latin-1"))
    for k, text in enumerate(texts):
        at = 0
        while len(text) - at > BLOCK:
            found = gap.search(text, at + BLOCK)
            if found is None:
                break
            yield k, text[at : found.end()]
            at = found.end()
        yield k, text[at:] if at else text


def word_hashes(texts: list[bytes], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    counts = np.zeros(len(texts), np.int64)
    out: list[np.ndarray] = []
    block: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal block, size
        if block:
            h, n = _hash_block([p for _, p in block], alphabet)
            out.append(h)
            np.add.at(counts, [k for k, _ in block], n)
        block, size = [], 0

    for k, piece in _pieces(texts, alphabet):
        if size + len(piece) > BLOCK:
            flush()
        block.append((k, piece))
        size += len(piece) + 1
    flush()
    return (np.concatenate(out) if out else np.zeros(0, U)), counts


def _hash_block(pieces: list[bytes], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    x = _LOWER[np.frombuffer(b"\n".join(pieces) + b"\n" + bytes(8), np.uint8)]
    edge = np.diff(np.frombuffer(alphabet.inside, np.uint8)[x[:-8]].astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - start
    h = mix(size.astype(U))
    # the eight bytes from every place on
    at_once = np.lib.stride_tricks.as_strided(x, (len(x) - 7, 8), (1, 1))
    left = np.flatnonzero(size <= LONG)
    done = 0
    while len(left):
        eight = np.ascontiguousarray(at_once[start[left] + done]).view("<u8")[:, 0]
        rest = size[left] - done
        h[left] = mix(h[left] ^ ((eight & _LOW[np.minimum(rest, 8)]) * _ODD))
        done += 8
        left = left[rest > 8]
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = int.from_bytes(blake2b(x[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    at = np.cumsum([len(p) + 1 for p in pieces])
    return h, np.diff(np.searchsorted(start, at), prepend=0)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, in order."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, U)
    for k in range(size):
        out = (out ^ (out >> U(29))) * U(0xBF58476D1CE4E5B9) + h[k : k + n]
    return mix(out)


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
