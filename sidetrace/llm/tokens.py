"""Token ids of whole texts from a public byte-level BPE file, by the tokenizers library.

Byte-level BPE never merges across the pieces of its splitting pattern, so the library encodes each distinct piece once
and a bounded memory of pieces serves the rest. Texts are split by numpy on their bytes. The splitter knows ASCII without
the apostrophe and the letters of Latin-1 and Latin Extended-A, whose classes are the same in every Unicode version; a text
with any other character is encoded whole by the library.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from sidetrace.llm import textvec

_CLASS = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_STRANGE = np.ones(256, bool)
_STRANGE[[9, 10, 13, *range(32, 127), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = False
_STRANGE[39] = True
#: Pieces remembered by one Python worker; it changes no id.
MEMORY = 500_000


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts without strange characters; each ends where the next starts.

    A run of letters, digits or other characters takes one blank before it; of white space before another character the
    last stands alone if it isn't a blank, and the rest is one piece; white space at the end of a text is one piece.
    """
    kind = _CLASS[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    solid = kind > 0
    changed, blank_before = np.ones(len(data), bool), np.zeros(len(data), bool)
    changed[1:] = kind[1:] != kind[:-1]
    blank_before[1:] = data[:-1] == 32
    last_space = np.zeros(len(data), bool)
    last_space[:-1] = ~solid[:-1] & solid[1:] & ~first[1:]
    return np.flatnonzero(first | (changed & ~(solid & blank_before)) | last_space)


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self._reset()

    def _reset(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted, with the place of each piece's ids in flat
        self.place, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.filled = np.zeros(1 << 16, np.uint32), 0

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, found: list[str]) -> list[np.ndarray]:
        """The ids of single pieces. Words are encoded as lines of one text, which the pattern takes apart again."""
        words = [i for i, p in enumerate(found) if p.strip().isalpha()]
        out: list[np.ndarray | None] = [None] * len(found)
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            ids = self.library(["\n".join([found[i] for i in part])])[0]
            cuts = np.flatnonzero(ids == self.newline)
            for i, a, b in zip(part, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True):
                out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.library([found[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def _remember(self, hashes: np.ndarray, found: list[str]) -> None:
        ids = self._encode_pieces(found)
        size = np.array([len(x) for x in ids], np.int64)
        if len(self.hashes) + len(ids) > MEMORY and len(self.hashes):
            keep = np.sort(np.argsort(-self.used, kind="stable")[: MEMORY // 3])
            spots = np.repeat(self.place[keep] - np.r_[0, np.cumsum(self.size[keep])[:-1]], self.size[keep]) + np.arange(self.size[keep].sum())
            self.flat, self.filled = self.flat[spots], len(spots)
            self.hashes, self.size, self.used = self.hashes[keep], self.size[keep], self.used[keep] // 2
            self.place = np.r_[0, np.cumsum(self.size)[:-1]].astype(np.int64)
        total = self.filled + int(size.sum())
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(total, 2 * len(self.flat)) - len(self.flat), np.uint32)])
        self.flat[self.filled : total] = np.concatenate(ids) if ids else []
        place = self.filled + np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)
        self.filled = total
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.place, self.size, self.used = (np.insert(a, at, b) for a, b in ((self.hashes, hashes), (self.place, place), (self.size, size), (self.used, np.zeros(len(ids), np.int64))))

    def _known(self, unique: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, unique), max(0, len(self.hashes) - 1))
        return self.hashes[at] == unique if len(self.hashes) else np.zeros(len(unique), bool)

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
        """Ids of the texts of a block, None for those with a strange character."""
        n = len(offsets) - 1
        if not len(data):
            return [b""] * n
        odd = _STRANGE[data]
        after = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        odd[1:] |= after
        strange = np.zeros(n, bool)
        strange[np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1)] = True
        start = pieces(data, offsets)
        text = np.searchsorted(offsets, start, "right") - 1
        end = np.r_[start[1:], len(data)]
        good = ~strange[text]
        start, end, text = start[good], end[good], text[good]
        h = textvec.span_hashes(data, start, end)
        unique, where, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        new = ~self._known(unique)
        if new.any():
            raw = data.tobytes()
            self._remember(unique[new], [raw[start[k] : end[k]].decode() for k in where[new].tolist()])
            if not self._known(unique).all():  # what was forgotten is needed after all
                self._reset()
                self._remember(unique, [raw[start[k] : end[k]].decode() for k in where.tolist()])
        at = np.searchsorted(self.hashes, unique)
        self.used[at] += count
        size = self.size[at][inverse]
        ends = np.cumsum(size)
        spots = np.repeat(self.place[at][inverse] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        ids = self.flat[spots].astype("<u4").tobytes()
        cuts = np.r_[0, ends][np.searchsorted(text, np.arange(n + 1))].tolist()
        return [None if s else ids[4 * a : 4 * b] for s, a, b in zip(strange.tolist(), cuts[:-1], cuts[1:], strict=True)]

    def ids(self, column: pa.Array | pa.ChunkedArray | list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; null and empty texts have none."""
        if isinstance(column, list):
            column = pa.array(column, pa.string())
        out: list[bytes] = []
        for row, count, data, offsets in textvec.blocks(column):
            found = self._block(data, offsets)
            for i in range(count):
                out.append(self.library([column[row + i].as_py()])[0].astype("<u4").tobytes() if found[i] is None else found[i])
        return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
