"""Byte-level BPE ids of whole Arrow batches.

A text is first cut into pre-tokens; in a block of texts each distinct pre-token is encoded once and its ids are copied
to every place where it stands. The cutting is done on bytes for texts of ASCII and Latin letters (U+00C0 to U+024F);
any other text, and one with an apostrophe or a special token's string, goes to the tokenizer whole.
"""

from __future__ import annotations

import json
from functools import cached_property

import numpy as np

from archlake.llm.blocks import SPACE, mix, powers

_LETTER, _DIGIT, _OTHER, _WHITE = 1, 2, 3, 0

_KIND = np.full(256, _OTHER, np.uint8)
_KIND[SPACE] = _WHITE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[0x80:0xCA] = _LETTER  # continuation bytes, and the lead bytes of U+00C0 to U+024F

#: Bytes that send a text to the tokenizer: separators that count as white space there, the apostrophe, other lead bytes.
_RARE = np.zeros(256, bool)
_RARE[[0x1C, 0x1D, 0x1E, 0x1F, 0x27]] = True
_RARE[0xC0:0xC3] = True
_RARE[0xCA:] = True

_BYTE_KEYS = mix(np.arange(256, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)

_loaded: dict[str, "Bpe"] = {}


def load(path: str) -> "Bpe":
    """The tokenizer of a file, once in a worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable bytes stand for themselves, the others
    for the code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Bpe:
    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        # pre-tokens are given one by one, so that any pattern which takes a whole string will do
        self.part = tiktoken.Encoding("parts", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def whole(self):
        """The tokenizer itself, loaded for the first text that it has to take."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and the rows' offsets in them."""
        n = len(offs) - 1
        slow = self._unusual(data, offs)
        starts = self._pretokens(data, offs)
        row = np.searchsorted(offs, starts, "right") - 1
        ends = np.append(starts[1:], len(data))
        if slow.any():
            keep = ~slow[row]
            starts, ends, row = starts[keep], ends[keep], row[keep]
        ids, counts = self._by_distinct(data, starts, ends)
        sizes = np.bincount(row, weights=counts, minlength=n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
        if not slow.any():
            return ids, np.concatenate(([0], np.cumsum(sizes)))
        raw = data.tobytes()
        texts = [raw[offs[i] : offs[i + 1]].decode("utf-8", "replace") for i in np.flatnonzero(slow)]
        others = [np.array(x.ids, np.uint32) for x in self.whole.encode_batch(texts, add_special_tokens=False)]
        at, parts, k = np.concatenate(([0], np.cumsum(sizes))), [], 0
        for i in range(n):
            if slow[i]:
                parts.append(others[k])
                sizes[i] = len(others[k])
                k += 1
            else:
                parts.append(ids[at[i] : at[i + 1]])
        return np.concatenate(parts) if parts else ids, np.concatenate(([0], np.cumsum(sizes)))

    def _unusual(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        rare = _RARE[data]
        if len(data) > 1:
            lead, after = data[:-1], data[1:]
            rare[:-1] |= (lead == 0xC3) & ((after == 0x97) | (after == 0xB7))
            rare[:-1] |= (lead == 0xC9) & (after > 0x8F)
        slow = np.zeros(len(offs) - 1, bool)
        slow[np.searchsorted(offs, np.flatnonzero(rare), "right") - 1] = True
        raw = data.tobytes()
        for word in map(str.encode, self.special):
            at = raw.find(word)
            while at >= 0:
                slow[np.searchsorted(offs, at, "right") - 1] = True
                at = raw.find(word, at + 1)
        return slow

    @staticmethod
    def _pretokens(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """A run of letters, digits or other signs takes one blank before it; of white space before a run, the last
        sign stands alone unless it is that blank."""
        if not len(data):
            return np.empty(0, np.int64)
        kind = _KIND[data]
        white = kind == _WHITE
        begin = np.empty(len(data), bool)
        begin[0] = True
        begin[1:] = (kind[1:] != kind[:-1]) & ~((data[:-1] == 0x20) & ~white[1:])
        row_end = np.zeros(len(data), bool)
        full = offs[:-1] < offs[1:]
        row_end[offs[1:][full] - 1] = True
        begin[:-1] |= white[:-1] & ~white[1:] & ~row_end[:-1]
        begin[offs[:-1][full]] = True
        return np.flatnonzero(begin)

    def _by_distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(starts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        up, down = powers(len(data))
        x = _BYTE_KEYS[data]
        x *= up
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(x, out=total[1:])
        keys = mix((total[ends] - total[starts]) * down[starts])
        _, first, same = np.unique(keys, return_index=True, return_inverse=True)
        # two pre-tokens with one key would be a wrong result, so compare the bytes
        lengths, shift = ends - starts, starts - starts[first][same]
        if (lengths != lengths[first][same]).any():
            first, same = np.arange(len(starts)), np.arange(len(starts))
        else:
            here = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
            if (data[here] != data[here - np.repeat(shift, lengths)]).any():
                first, same = np.arange(len(starts)), np.arange(len(starts))
        raw, encode = data.tobytes(), self.part.encode_ordinary
        lists = [encode(raw[a:b].decode()) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.uint32, int(size.sum()))
        begin = np.cumsum(size) - size
        counts = size[same]
        to = np.cumsum(counts)
        return flat[np.repeat(begin[same] - (to - counts), counts) + np.arange(to[-1])], counts
