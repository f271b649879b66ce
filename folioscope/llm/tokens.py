"""Token ids of whole texts by the tokenizers library, each distinct word encoded once.

Both kinds of vocabulary split a text at white space before anything else, so a text's ids are those of its words in a
row. Words are found and hashed by ``textbuf``; their ids are looked up in a table of fixed size in each Python worker,
and only words that it lacks are encoded, many in one call. Where the cut at white space is not certain - a byte-level
vocabulary, and white space other than single blanks and line feeds between other characters - a text is encoded as a
whole. Ids are 16-bit numbers (both vocabularies have fewer than 65,536); words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from folioscope.llm import textbuf as tb

SLOTS = 1 << 21
TOGETHER = 2000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: First bytes of white space beyond ASCII, and of what some call so.
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
#: ASCII punctuation but for the apostrophe, at which both vocabularies cut a word after an ASCII letter.
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Table:
    """Ids by word hash: open addressing over arrays, emptied when half full."""

    def __init__(self, slots: int = SLOTS):
        self.mask = np.uint64(slots - 1)
        self.clear()

    def clear(self) -> None:
        slots = int(self.mask) + 1
        self.key, self.entry = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self.count, self.used = 0, 0
        self.first, self.size, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint16)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        at = (keys & self.mask).astype(np.int64)
        out = self.entry[at]
        odd = np.flatnonzero((out >= 0) & (self.key[at] != keys))
        at = at[odd]
        while len(odd):
            at = (at + 1) & int(self.mask)
            out[odd] = self.entry[at]
            on = (out[odd] >= 0) & (self.key[at] != keys[odd])
            odd, at = odd[on], at[on]
        return out

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """New distinct keys with the number of their ids and all ids in a row."""
        n = len(keys)
        while self.count + n > len(self.first):
            self.first, self.size = np.append(self.first, np.zeros_like(self.first)), np.append(self.size, np.zeros_like(self.size))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        new = slice(self.count, self.count + n)
        self.size[new] = sizes
        self.first[new] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + len(ids)] = ids
        todo, at = np.arange(n), (keys & self.mask).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.entry[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.key[at[won]], self.entry[at[won]] = keys[todo[won]], self.count + todo[won]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, at = todo[left], (at[left] + 1) & int(self.mask)
        self.count += n
        self.used += len(ids)


class Encoder:
    """ids of texts; ``glue``: a blank belongs to the word after it (byte-level vocabularies)."""

    def __init__(self, path: str, glue: bool, slots: int = SLOTS):
        self.tokenizer, self.glue, self.table = Tokenizer.from_file(path), glue, Table(slots)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: str, mark: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Numbers of ids and all ids of words, each with what leads it, encoded as one text with a mark after each.

        None if the marks don't come out one for each word."""
        code = self._plain([mark])[0]
        head, tail = (np.frombuffer(x.encode(), np.uint8) for x in (lead, mark if self.glue else f" {mark} "))
        n, each = ends - starts, ends - starts + len(head) + len(tail)
        first = np.cumsum(each) - each
        text = np.zeros(int(each.sum()), np.uint8)
        for k, c in enumerate(head):
            text[first + k] = c
        for k, c in enumerate(tail):
            text[first + len(head) + n + k] = c
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        text[np.repeat(first + len(head), n) + inner] = buf[np.repeat(starts, n) + inner]
        ids = np.array(self._plain([text.tobytes().decode("utf-8")])[0], np.uint16)
        cuts = ids == code[-1]
        if len(code) != 1 or int(cuts.sum()) != len(n):
            return None
        at = np.flatnonzero(cuts)
        return np.diff(np.append(-1, at)) - 1, ids[~cuts]

    def _learn(self, keys: np.ndarray, kind: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Put words into the table. Kinds of byte-level vocabularies: 0 alone, 1 after a blank, 2 after a line feed."""
        for k in range(3) if self.glue else (0,):
            lead, mark = ((" ", " ~") if k == 1 else ("", "\n")) if self.glue else ("", "~")
            own = np.flatnonzero(kind == k)
            marked = tb.any_in(buf == ord(mark.strip() or mark), starts[own], ends[own])
            alone = own[marked].tolist()
            rest = own[~marked]
            feed = np.array(self._plain(["\n"])[0], np.uint16) if k == 2 else np.zeros(0, np.uint16)
            for i in range(0, len(rest), TOGETHER):
                part = rest[i : i + TOGETHER]
                found = self._many(buf, starts[part], ends[part], lead, mark)
                if found is None:
                    alone += part.tolist()
                    continue
                size, ids = found
                if k == 2:
                    ids = np.insert(ids, np.cumsum(size) - size, feed[0]) if len(feed) == 1 else ids
                    size = size + 1
                self.table.add(keys[part], size, ids)
            got = [np.concatenate([feed, np.array(x, np.uint16)]) for x in self._plain([lead + bytes(buf[starts[i] : ends[i]]).decode("utf-8") for i in alone])]
            if got:
                self.table.add(keys[alone], np.array([len(x) for x in got]), np.concatenate(got))

    @staticmethod
    def _uncertain(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Rows with white space other than single blanks and line feeds between other characters."""
        n = len(buf)
        bad = (buf < 32) & (buf != 10)
        gap = (buf == 32) | (buf == 10)
        bad[1:] |= gap[1:] & gap[:-1]
        edge = offs[:-1][offs[:-1] < offs[1:]]
        bad[edge] |= gap[edge]
        bad[offs[1:][offs[:-1] < offs[1:]] - 1] |= gap[offs[1:][offs[:-1] < offs[1:]] - 1]
        wide = np.flatnonzero(_WIDE[buf])
        if len(wide):
            a, b, c = buf[wide], buf[np.minimum(wide + 1, n - 1)], buf[np.minimum(wide + 2, n - 1)]
            odd = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & ((b == 0x9A) | (b == 0xA0)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
            odd |= (a == 0xE2) & ((b == 0x80) & ((c < 0x90) | (c >= 0xA8) & (c < 0xB0)) | (b == 0x81)) | (a == 0xEF) & (b == 0xBB)
            bad[wide] |= odd
        return tb.any_in(bad, offs[:-1], offs[1:])

    def _slice(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        special = len(buf) > 1 and bool(((buf[:-1] == 60) & (buf[1:] == 124)).any())  # "<|": keep special tokens whole
        if not self.glue and not special:
            buf = tb.lower(buf)
        cut = np.zeros(len(buf), bool)
        if not special and len(buf):
            np.logical_and(_LETTER[buf[:-1]], _PUNCTUATION[buf[1:]], out=cut[1:])
            cut[offs[offs < len(buf)]] = False
        starts, ends, first = tb.words(buf, offs, cut)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        kind = np.zeros(len(starts), np.int64)
        whole = np.zeros(0, np.int64)
        if self.glue and len(buf):
            before = buf[np.maximum(starts - 1, 0)]
            kind = np.where(cut[starts], 0, np.where(before == 10, 2, 1))
            kind[first[:-1][np.diff(first) > 0]] = 0
            uncertain = self._uncertain(buf, offs)
            whole = np.flatnonzero(uncertain)
            if len(whole):
                keep = ~uncertain[row]
                starts, ends, row, kind = starts[keep], ends[keep], row[keep], kind[keep]
        keys = tb.hashes(buf, starts, ends)
        if self.glue:
            keys = tb.mix(keys + kind.astype(np.uint64))
        at = self.table.find(keys)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new, one = np.unique(keys[miss], return_index=True)
            if self.table.count + len(new) > (int(self.table.mask) + 1) // 2:
                self.table.clear()
                new, miss = np.unique(keys, return_index=True)
                one = np.arange(len(new))
            if len(new) > (int(self.table.mask) + 1) // 2:  # a single slice of more words than the table holds
                self.table = Table(1 << (2 * len(new)).bit_length())
            k = miss[one]
            self._learn(new, kind[k], buf, starts[k], ends[k])
            at = self.table.find(keys)
        t = self.table
        size, place = t.size[at].astype(np.int64), t.first[at]
        pool = t.pool
        if len(whole):
            data = [np.array(x, np.uint16) for x in self._plain([bytes(buf[offs[r] : offs[r + 1]]).decode("utf-8") for r in whole])]
            n = np.array([len(x) for x in data], np.int64)
            place = np.concatenate([place, t.used + np.cumsum(n) - n])
            pool = np.concatenate([pool[: t.used], *data])
            size, row = np.concatenate([size, n]), np.concatenate([row, whole])
            order = np.argsort(row, kind="stable")
            size, row, place = size[order], row[order], place[order]
        ends_at = np.cumsum(size)
        ids = pool[np.repeat(place - (ends_at - size), size) + np.arange(ends_at[-1] if len(ends_at) else 0)]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(row, size, len(offs) - 1))]).astype(np.int64)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of its rows in a row, where each row's begin) for slices of the texts."""
        for at, buf, offs in tb.slices(texts):
            yield (at, *self._slice(buf, offs))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, glue: bool) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if (path, glue) not in _ENCODERS:
        _ENCODERS[path, glue] = Encoder(path, glue)
    return _ENCODERS[path, glue]


def with_end(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each row."""
    n = len(first) - 1
    out = np.full(len(ids) + n, end, np.uint16)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(first))] = ids
    return out, first + np.arange(n + 1)
