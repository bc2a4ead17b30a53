"""Vectorised words and n-gram hashes of Arrow string columns.

Words are runs of bytes outside [\\x20\\x09-\\x0D], with A-Z lower-cased; both rules touch ASCII bytes only, so they hold on
UTF-8 as they do on code points. A word's hash is a polynomial in its bytes modulo 2**64, read off prefix sums, then mixed;
equal words have equal hashes in every process.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes worked through at once.
PIECE = 1 << 18
#: Every ASCII byte but letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_POWERS: dict[str, np.ndarray] = {}
#: Odd multipliers of the positions in an n-gram.
_PLACE = np.array([0xD6E8FEB86659FD93 * (2 * i + 1) ** 3 % 2**64 | 1 for i in range(64)], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        size = n
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            out = np.full(size, base, dtype=U)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string or binary column; nulls are empty."""
    if column.null_count:
        empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        column = column.fill_null(empty)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """The words of a run of texts: text i has words first[i]:first[i + 1]; starts and ends are byte offsets.

    heads: by n, the hash of each word's first n bytes, of the whole word where it has no more.
    """

    first: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    heads: dict[int, np.ndarray]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def finished(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of words, given their bytes' polynomials."""
    return mix(sums + lengths.astype(U) * U(0xA0761D6478BD642F))


def words(data: np.ndarray, offsets: np.ndarray, longest: int = 0, gap: np.ndarray = _SPACE, heads: tuple[int, ...] = ()) -> Words:
    """Words of each text; those of more than longest bytes are cut in pieces of that many (0: never).

    gap marks the lower-cased bytes that part words. The bytes are worked through in pieces of PIECE, which end between two words, so
    that a long text takes no more room than its words do; the hash of a word of more bytes than that is carried from piece to piece.
    """
    starts_, ends_, hashes_, heads_ = [], [], [], {n: [] for n in heads}
    up, down = _powers(PIECE + 1)
    at, size = 0, len(data)

    def edges(i: int, j: int) -> np.ndarray:
        """Where texts begin in i:j, from i."""
        lo, hi = np.searchsorted(offsets, [i, j])
        return offsets[lo:hi] - i

    def unbroken(i: int) -> bool:
        """Whether bytes i - 1 and i are of one word."""
        return not gap[_LOWER[data[i - 1]]] and not gap[_LOWER[data[i]]] and not len(edges(i, i + 1))

    def whole(low: np.ndarray) -> int:
        """The polynomial of at most PIECE bytes."""
        return int(np.sum((low.astype(U) + U(1)) * up[: len(low)], dtype=U))

    while at < size:
        end = min(at + PIECE, size)
        low = _LOWER[data[at:end]]
        solid = ~gap[low]
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        here = edges(at + 1, end) + 1
        begins[here] = solid[here]
        stops[here - 1] = solid[here - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        if end < size and unbroken(end):
            begin = int(starts[-1])
            kept = (len(low) - begin) // longest * longest if longest else 0
            if begin + kept:  # the word that goes on is left to the next piece, or what it has beyond its full cuts
                end = at + begin + kept
                starts, ends = (starts, ends) if kept else (starts[:-1], ends[:-1])
                ends = np.minimum(ends, begin + kept)
            else:  # one word of more than a piece
                total, length, scale = 0, 0, 1
                stop = at
                while True:
                    stop = min(stop + PIECE, size)
                    part = _LOWER[data[at + length : stop]]
                    inside = np.flatnonzero(gap[part])
                    cut = min([len(part), *inside[:1].tolist(), *(edges(at + length + 1, at + length + len(part)) + 1)[:1].tolist()])
                    part = part[:cut]
                    total = (total + scale * whole(part)) % 2**64
                    scale = scale * pow(_BASE, len(part), 2**64) % 2**64
                    length += len(part)
                    if at + length < stop or stop == size or not unbroken(at + length):
                        break
                starts_.append(np.array([at]))
                ends_.append(np.array([at + length]))
                hashes_.append(finished(np.array([total], dtype=U), np.array([length])))
                for n in heads:
                    heads_[n].append(finished(np.array([whole(_LOWER[data[at : at + n]])], dtype=U), np.array([n])))
                at += length
                continue
        if longest and len(starts) and int((ends - starts).max()) > longest:
            pieces = -(-(ends - starts) // longest)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts = np.repeat(starts, pieces) + nth * longest
            ends = np.minimum(starts + longest, np.repeat(ends, pieces))
        sums = np.zeros(len(low) + 1, dtype=U)
        np.cumsum((low.astype(U) + U(1)) * up[: len(low)], out=sums[1:])
        base = down[starts]
        hashes_.append(finished((sums[ends] - sums[starts]) * base, ends - starts))
        for n in heads:
            to = np.minimum(ends, starts + n)
            heads_[n].append(finished((sums[to] - sums[starts]) * base, to - starts))
        starts_.append(starts + at)
        ends_.append(ends + at)
        at = end
    joined = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    starts = joined(starts_, np.int64)
    return Words(np.searchsorted(starts, offsets), joined(hashes_, U), starts, joined(ends_, np.int64), {n: joined(x, U) for n, x in heads_.items()})


def column_words(column: pa.Array, longest: int = 0) -> Words:
    return words(*buffers(column), longest)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each place on, text bounds aside: one for each place that has n words from it."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U)
    out = hashes[:m] * _PLACE[0]
    for i in range(1, n):
        out += hashes[i : i + m] * _PLACE[i]
    return mix(out + U(n))


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each n-word shingle; a text of fewer words has its whole sequence as one, an empty text none."""
    counts, texts = w.counts, w.texts
    grams = np.zeros(len(texts), dtype=U)
    whole = ngrams(w.hashes, n)
    grams[: len(whole)] = whole
    inside = np.arange(len(texts)) + n <= w.first[1:][texts]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        inside[w.first[i]] = True
        grams[w.first[i]] = ngrams(w.hashes[w.first[i] : w.first[i + 1]], int(counts[i]))[0]
    return texts[inside], grams[inside]


def distinct(owner: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash), ordered by both, and how often each occurs; owner must be in order."""
    if not len(owner):
        return owner, hashed, np.zeros(0, np.int64)
    hashed = hashed.copy()
    bounds = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashed[i:j].sort()
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])]))
    return owner[new], hashed[new], np.diff(np.append(new, len(owner)))


def trailing_ngrams(w: Words, n: int) -> np.ndarray:
    """For each word the hash of the up to n words of its text that end with it."""
    nth = np.arange(len(w.hashes)) - np.repeat(w.first[:-1], w.counts)
    out = w.hashes * _PLACE[0]
    for j in range(1, n):
        out[j:] += np.where(nth[j:] >= j, w.hashes[:-j] * _PLACE[j], U(0))
    return mix(out + np.minimum(nth + 1, n).astype(U))
