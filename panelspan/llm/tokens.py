"""Token ids of whole texts with a public byte-level BPE vocabulary.

The vocabulary's own library encodes every distinct word once per worker process; texts are cut into words with numpy
(letters, digits, other signs, each with one leading space, and white space) and their ids are gathered from the words
seen so far.  Texts with an apostrophe (contractions), characters beyond Latin or an added token's content go through the library whole.  Words
are recognised by a 64-bit hash.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa

from panelspan.llm import common

END = 0                     # id after each document
CLAUSE, SENTENCE = 1, 2
_STOPS = np.zeros(256, np.uint8)
_STOPS[list(b",;:)")] = CLAUSE
_STOPS[list(b".!?\n")] = SENTENCE
_LATIN = 0x240              # code points that the numpy cut handles
_HELD = 2_000_000           # words remembered by a worker before it starts afresh
_SLOT_BITS = 22
_ENCODERS: dict[str, "Encoder"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> "Encoder":
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _alphabet() -> np.ndarray:
    """Byte to the character that stands for it in the vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = np.zeros(256, dtype="<U1")
    table[plain] = [chr(b) for b in plain]
    rest = [b for b in range(256) if b not in set(plain)]
    table[rest] = [chr(256 + i) for i in range(len(rest))]
    return table


def _kinds() -> np.ndarray:
    """0 letter, 1 digit, 2 white space, 3 other."""
    table = np.full(_LATIN, 3, np.uint8)
    for i in range(_LATIN):
        kind = unicodedata.category(chr(i))[0]
        table[i] = 2 if chr(i) in "\t\n\v\f\r " else 0 if kind == "L" else 1 if kind == "N" else 3
    return table


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        # texts that hold one of the library's added tokens go through it whole
        self.added = [t.content.encode("utf-8") for t in self.whole.get_added_tokens_decoder().values() if t.content]
        self.model = self.whole.model
        self.size = self.whole.get_vocab_size()
        self.alphabet, self.kinds = _alphabet(), _kinds()
        self.forget()

    def forget(self) -> None:
        self.slots = np.zeros(1 << _SLOT_BITS, np.uint64)          # open addressing: hash, 0 where free
        self.word = np.zeros(1 << _SLOT_BITS, np.int32)
        self.first, self.count, self.ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        self.words, self.length = 0, 0

    def _learn(self, hashes: np.ndarray, low: np.ndarray, high: np.ndarray, data: np.ndarray) -> None:
        """Remember distinct words that are not yet held."""
        if self.words + len(hashes) > _HELD and self.words:
            self.forget()
        letters = "".join(self.alphabet[data[common.ranges(low, high)]])
        ends = np.cumsum(high - low)
        tokenize = self.model.tokenize
        found = [[t.id for t in tokenize(letters[a:b])] for a, b in zip((ends - (high - low)).tolist(), ends.tolist())]
        count = np.array([len(f) for f in found], np.int64)
        ids = np.fromiter((i for f in found for i in f), np.uint32, int(count.sum()))
        # one array each, grown by whole blocks
        self.first = [np.concatenate([*self.first, self.length + np.cumsum(count) - count])]
        self.count = [np.concatenate([*self.count, count])]
        self.ids = [np.concatenate([*self.ids, ids])]
        number = np.arange(self.words, self.words + len(hashes), dtype=np.int32)
        self.words, self.length = self.words + len(hashes), self.length + len(ids)
        slot = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        while len(slot):
            free = np.flatnonzero(self.slots[slot] == 0)
            placed = free[np.unique(slot[free], return_index=True)[1]]
            self.slots[slot[placed]], self.word[slot[placed]] = hashes[placed], number[placed]
            rest = np.ones(len(slot), bool)
            rest[placed] = False
            slot, hashes, number = (slot[rest] + 1) & ((1 << _SLOT_BITS) - 1), hashes[rest], number[rest]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 where it is not held."""
        slot = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        held = self.slots[slot]
        out = np.where(held == hashes, self.word[slot], -1)
        todo = np.flatnonzero((held != hashes) & (held != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << _SLOT_BITS) - 1)
            held = self.slots[slot[todo]]
            same = held == hashes[todo]
            out[todo[same]] = self.word[slot[todo[same]]]
            todo = todo[~same & (held != 0)]
        return out

    def _words(self, part: np.ndarray, heads_of_text: np.ndarray) -> np.ndarray:
        """First byte of every word; ``heads_of_text``: first byte of every non-empty text.

        Both bytes of a Latin letter get its kind; white space has one byte here.
        """
        kind = self.kinds[part]
        wide = np.flatnonzero(part >= 0xC0)
        kind[wide] = self.kinds[((part[wide] & np.uint8(0x1F)).astype(np.int32) << 6) | (part[wide + 1] & np.uint8(0x3F))]
        kind[wide + 1] = kind[wide]
        begins = np.zeros(len(part) + 1, bool)
        begins[heads_of_text] = begins[-1] = True
        space = kind == 2
        start = np.empty(len(part), bool)
        start[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start[1:] &= space[1:] | (part[:-1] != 32)                  # one space belongs to the word after it
        # the last of several white spaces stands alone, unless the text ends there
        start[1:-1] |= space[1:-1] & space[:-2] & ~space[2:] & ~begins[2:-1]
        return np.flatnonzero(start | begins[:-1])

    def encode(self, data: np.ndarray, offsets: np.ndarray, sentences: bool = False):
        """Ids of the texts and their counts; with ``sentences`` also what each id ends: SENTENCE, CLAUSE or 0 for neither."""
        n = len(offsets) - 1
        length = np.diff(offsets)
        part = data[offsets[0]: offsets[-1]]
        # lead bytes from 0xC9 on begin characters beyond Latin; after 0xC2, 0x85 and 0xA0 are white space
        odd_at = np.flatnonzero((part >= 0xC9) | (part == 39))
        blank = np.flatnonzero(part[:-1] == 0xC2)
        odd_at = np.concatenate([odd_at, blank[np.isin(part[blank + 1], [0x85, 0xA0])]])
        odd = np.zeros(n, bool)
        raw = part.tobytes() if self.added else b""
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                odd[np.searchsorted(offsets - offsets[0], at, side="right") - 1] = True
                at = raw.find(content, at + 1)
        odd[np.searchsorted(offsets - offsets[0], odd_at, side="right") - 1] = True
        plain = np.flatnonzero(~odd & (length > 0))
        counts = np.zeros(n, np.int64)
        pieces: dict[int, tuple] = {}
        ids, ends = np.empty(0, np.uint32), np.empty(0, np.uint8)
        if len(plain):
            own = part if len(plain) == n else part[common.ranges(offsets[plain] - offsets[0], offsets[plain + 1] - offsets[0])]
            heads = np.cumsum(length[plain]) - length[plain]
            low = self._words(own, heads)
            high = np.append(low[1:], len(own))
            hashes = common.Rolling(own)(low, high)
            at = self._find(hashes)
            for _ in range(2):                                     # a second time where it started afresh
                missing = np.flatnonzero(at < 0)
                if not len(missing):
                    break
                new, example = np.unique(hashes[missing], return_index=True)
                example = missing[example]
                self._learn(new, low[example], high[example], own)
                at = self._find(hashes)
            count = self.count[0][at]
            ids = self.ids[0][common.ranges(self.first[0][at], self.first[0][at] + count)]
            total = np.concatenate([[0], np.cumsum(count)])
            bounds = total[np.append(np.searchsorted(low, heads), len(low))]
            counts[plain] = np.diff(bounds)
            if sentences:
                ends = np.zeros(len(ids), np.uint8)
                stop = _STOPS[own[high - 1]]
                ends[total[1:][stop > 0] - 1] = stop[stop > 0]
            if len(plain) == n:
                return ids, counts, ends
        for i in np.flatnonzero(odd):
            text = data[offsets[i]: offsets[i + 1]].tobytes().decode("utf-8")
            if sentences:
                whole = self.whole.encode(text, add_special_tokens=False)
                stop = np.array([_STOPS[min(ord(text[e - 1]), 255)] if e else 0 for _, e in whole.offsets], np.uint8)
            else:
                whole, stop = self.whole.encode_batch_fast([text], add_special_tokens=False)[0], np.empty(0, np.uint8)
            pieces[i] = np.array(whole.ids, np.uint32), stop
            counts[i] = len(whole.ids)
        if pieces:                                                 # put the two kinds of texts in order
            out, stops = np.empty(counts.sum(), np.uint32), np.zeros(counts.sum() if sentences else 0, np.uint8)
            first = np.cumsum(counts) - counts
            where = common.ranges(first[plain], first[plain] + counts[plain])
            out[where] = ids
            if sentences:
                stops[where] = ends
            for i, (own_ids, stop) in pieces.items():
                out[first[i]: first[i] + counts[i]] = own_ids
                if sentences:
                    stops[first[i]: first[i] + counts[i]] = stop
            ids, ends = out, stops
        return ids, counts, ends


def with_end(ids: np.ndarray, counts: np.ndarray, ends: np.ndarray | None = None):
    """The same with id 0 after each text (it ends a sentence)."""
    total = counts + 1
    out = np.full(int(total.sum()), END, np.uint32)
    last = np.cumsum(total) - 1
    keep = np.ones(len(out), bool)
    keep[last] = False
    out[keep] = ids
    if ends is None:
        return out, total
    stops = np.full(len(out), SENTENCE, np.uint8)
    stops[keep] = ends
    return out, total, stops


def texts(batch: pa.RecordBatch, column: int, limit: int = 2 << 20):
    offsets, data = common.utf8(batch.column(column))
    for low, high in common.slices(offsets, limit):
        yield low, high, data, offsets[low: high + 1]
