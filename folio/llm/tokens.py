"""Ids of whole texts by the tokenizers library, with the pieces that repeat encoded once per worker.

Both public vocabularies split a text before they merge, and never across a change from a letter or other visible character to
white space, nor from a run of letters to what follows it. So a text can be cut there and each piece be encoded, or looked
up, on its own, with the same ids. That holds for Latin-1 texts without unusual white space; a text with other characters is
cut at plain white space alone, and one with white space other than blank, tab and line ends is encoded as a whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from folio.llm import textkernel as K

LATIN_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: How the byte alphabet writes a blank (fixed value).
BLANK = "Ġ"
#: 1: ASCII letters; 2: the first byte of a two-byte Latin-1 character; and bytes of texts that numpy doesn't look at: control
#: characters and the first bytes of characters beyond Latin-1.
LETTER_BYTE = np.zeros(256, np.uint8)
LETTER_BYTE[65:91] = LETTER_BYTE[97:123] = 1
LETTER_BYTE[0xC2] = LETTER_BYTE[0xC3] = 2
UNUSUAL = np.zeros(256, bool)
UNUSUAL[[0x0B, 0x0C, *range(0x1C, 0x20)]] = True
UNUSUAL[0xC4:] = True
ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]")


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of batches of texts. The pieces of a batch are found and hashed by numpy, and each distinct one is looked up once.

    A piece of letters alone is one pre-token, so the library's model gets it as it stands, in its byte alphabet; other
    pieces go through the whole tokenizer. Pieces are found by 64-bit hashes and then compared byte by byte (those of up to eight
    bytes by length alone, as they can't share a hash); one that differs from what is remembered under its hash is encoded for
    itself. At most about `most` are remembered: beyond that, the half that was used longest ago is forgotten."""

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocabulary_size, self.most = self.tokenizer.get_vocab_size(), most
        with open(path) as f:
            spec = json.load(f)
        before = json.dumps(spec.get("pre_tokenizer"))
        self.spaced = self.lower = False
        if spec.get("normalizer") is None and '"type": "ByteLevel"' in before and '"add_prefix_space": false' in before and '"use_regex": true' in before:
            self.spaced, self.one_word = True, re.compile(f" ?[{LATIN_LETTERS}]+").fullmatch
            self.coarse = re.compile("[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+").findall
        elif "Lowercase" in json.dumps(spec.get("normalizer")) and "[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in before:
            self.lower, self.one_word = True, re.compile(f"[{LATIN_LETTERS}]+").fullmatch
            self.coarse = re.compile("[^ \n\t\r]+").findall
        self.known = self.spaced or self.lower
        # the byte alphabet: printable bytes stand for themselves, the others for 256, 257, ... in their order
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = dict(zip((b for b in range(256) if b not in plain), range(256, 512), strict=False))
        self.model = self.tokenizer.model.tokenize
        self.hashes = np.empty(0, np.uint64)  # of remembered pieces, ascending
        self.first, self.count, self.used = (np.empty(0, np.int64) for _ in range(3))  # where their ids are in flat, how many, and the batch of last use
        self.size, self.raw_at = (np.empty(0, np.int64) for _ in range(2))  # their length, and where the bytes of those of over eight are in raw
        self.flat, self.raw, self.batch = np.empty(0, np.uint32), np.empty(0, np.uint8), 0

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str) -> list[int]:
        if not self.one_word(piece):
            return self._library(piece)
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.alphabet)
        elif piece[0] == " ":
            piece = BLANK + piece[1:]
        return [t.id for t in self.model(piece)]

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Remembers pieces; hashes ascend and are not among those known."""
        size = np.array([len(x) for x in pieces], np.int64)
        long_ = np.where(size > 8, size, 0)
        raw_at = len(self.raw) + np.cumsum(long_) - long_
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(x for x in pieces if len(x) > 8), np.uint8)])
        pieces = [x.decode() for x in pieces]
        model, blank = self.model, self.spaced
        ids = []
        for x in pieces:  # the common kinds first: ASCII letters, after a blank where those count
            if x.isascii() and x.isalpha():
                ids.append([t.id for t in model(x)])
            elif blank and x.isascii() and x[0] == " " and x[1:].isalpha():
                ids.append([t.id for t in model(BLANK + x[1:])])
            else:
                ids.append(self._piece(x))
        count = np.array([len(x) for x in ids], np.int64)
        first = len(self.flat) + np.cumsum(count) - count
        flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum()))])
        at = np.searchsorted(self.hashes, hashes)
        used = np.full(len(hashes), self.batch, np.int64)
        old, new = (self.hashes, self.first, self.count, self.used, self.size, self.raw_at), (hashes, first, count, used, size, raw_at)
        self.hashes, self.first, self.count, self.used, self.size, self.raw_at = (np.insert(a, at, b) for a, b in zip(old, new, strict=True))
        self.flat = flat

    def _forget(self) -> None:
        keep = self.used >= np.median(self.used)
        keep &= (np.cumsum(keep) <= self.most) | (self.used == self.batch)
        first, count = self.first[keep], self.count[keep]
        starts = np.cumsum(count) - count
        self.flat = self.flat[np.repeat(first - starts, count) + np.arange(count.sum())]
        size = self.size[keep]
        long_ = np.where(size > 8, size, 0)
        raw_at = np.cumsum(long_) - long_
        self.raw = self.raw[np.repeat(self.raw_at[keep] - raw_at, long_) + np.arange(long_.sum())]
        self.hashes, self.used, self.count, self.first, self.size, self.raw_at = self.hashes[keep], self.used[keep], count, starts, size, raw_at

    def _strangers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, where: np.ndarray, which: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The pieces that differ from what is remembered under their hash."""
        size = ends - starts
        first = where[which]  # the first piece of the same hash in this batch
        odd = size != size[first]
        check = np.flatnonzero((size > 8) & ~odd & (first != np.arange(len(first))))
        odd[check] = ~K.equal_spans(data, starts[check], data, starts[first[check]], size[check])
        kept = size[where] == self.size[place]
        check = np.flatnonzero(kept & (size[where] > 8))
        kept[check] = K.equal_spans(data, starts[where[check]], self.raw, self.raw_at[place[check]], size[where[check]])
        if not kept.all():
            odd |= ~kept[which]
        return np.flatnonzero(odd)

    def _pieces(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces: of each word between plain white space, its first letters and what follows them."""
        letter = LETTER_BYTE[data]
        two = np.flatnonzero(letter == 2) + 1  # of two-byte letters: 0xC3 with all but 0x97 and 0xB7, 0xC2 with 0xAA, 0xB5, 0xBA
        is_letter = letter == 1
        if len(two):
            lead, second = data[two - 1], data[two]
            good = np.where(lead == 0xC3, (second != 0x97) & (second != 0xB7), (second == 0xAA) | (second == 0xB5) | (second == 0xBA))
            is_letter[two - 1] = is_letter[two] = good
        starts, ends, _ = K.words(data, at)
        other = np.append(np.flatnonzero(~is_letter), len(data))
        cut = np.minimum(other[np.searchsorted(other, starts)], ends)
        split = (cut > starts) & (cut < ends)
        if self.spaced:  # white space belongs to the piece after it, or is one of its own at a text's end
            doc = np.searchsorted(at, starts, "right") - 1
            begin = np.maximum(np.concatenate([[0], ends[:-1]]), at[doc]) if len(starts) else starts
            last = at[:-1].copy()
            np.maximum.at(last, doc, ends)
            rest = np.flatnonzero(last < at[1:])
            begin, cut_end = np.concatenate([begin, cut[split], last[rest]]), np.concatenate([np.where(split, cut, ends), ends[split], at[1:][rest]])
        else:
            begin, cut_end = np.concatenate([starts, cut[split]]), np.concatenate([np.where(split, cut, ends), ends[split]])
        order = np.argsort(begin, kind="stable")
        return begin[order], cut_end[order]

    def encode_batch(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the n+1 positions of the texts; null texts have none."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        data, at = K.views(texts)
        n = len(texts)
        unusual = np.ones(n, bool) if not self.known else np.add.reduceat(np.append(UNUSUAL[data], False), at[:-1], dtype=np.int64) * (np.diff(at) > 0) > 0 if n else np.zeros(0, bool)
        if self.known and (data == 0xC2).any():  # U+0085 and U+00A0
            odd = np.flatnonzero(data[:-1] == 0xC2)
            odd = odd[(data[odd + 1] == 0x85) | (data[odd + 1] == 0xA0)]
            unusual[np.searchsorted(at, odd, "right") - 1] = True
        others: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(unusual).tolist():
            text = texts[i].as_py() or ""
            if not self.known or ODD_SPACE.search(text):
                others[i] = np.array(self._library(text), np.uint32)
            else:
                others[i] = np.array(list(chain.from_iterable(self._library(x) for x in self.coarse(text))), np.uint32)
        if others:  # they are left out of what numpy sees
            keep = np.repeat(~unusual, np.diff(at))
            sizes = np.where(unusual, 0, np.diff(at))
            data, at = data[keep], np.concatenate([[0], np.cumsum(sizes)])
        if self.lower:
            data = K.LOWER[data]
            wide = np.flatnonzero(data[:-1] == 0xC3) + 1
            wide = wide[(data[wide] >= 0x80) & (data[wide] <= 0x9E) & (data[wide] != 0x97)]
            data[wide] += 0x20
        starts, ends = self._pieces(data, at)
        self.batch += 1
        hashes, where, which = np.unique(K.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        fresh = self.hashes[place] != hashes if len(self.hashes) else np.ones(len(hashes), bool)
        raw = memoryview(np.ascontiguousarray(data))
        if fresh.any():
            self._learn(hashes[fresh], [bytes(raw[a:b]) for a, b in zip(starts[where[fresh]].tolist(), ends[where[fresh]].tolist(), strict=True)])
            place = np.searchsorted(self.hashes, hashes)
        self.used[place] = self.batch
        first, count, flat = self.first[place][which], self.count[place][which], self.flat
        for i in self._strangers(data, starts, ends, where, which, place).tolist():
            own = np.array(self._piece(bytes(raw[starts[i] : ends[i]]).decode()), np.uint32)
            first[i], count[i], flat = len(flat), len(own), np.concatenate([flat, own])
        total = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.repeat(first - total[:-1], count) + np.arange(total[-1])]
        out_at = total[np.searchsorted(starts, at, "left")]
        if len(self.hashes) > self.most:
            self._forget()
        if others:
            parts, positions = [], [0]
            for i in range(n):
                part = others.get(i, ids[out_at[i] : out_at[i + 1]])
                parts.append(part)
                positions.append(positions[-1] + len(part))
            return np.concatenate(parts), np.array(positions)
        return ids, out_at

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0].astype("<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of several texts with end_id after each, and their positions."""
    return np.insert(ids, at[1:], end_id), at + np.arange(len(at))
