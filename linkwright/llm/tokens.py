"""Token ids of whole texts by a public tokenizer, the ids of words being kept between documents."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Texts with control characters or unusual white space go to the tokenizer whole, as it need not split there as we do.
UNUSUAL = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
#: Fixed value: the pattern by which such a tokenizer splits a lower-case text with single spaces.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Its contractions, by what follows the apostrophe.
SHORT, LONG = b"stmd", (b"re", b"ve", b"ll")

#: Pieces of ASCII and lower-case Latin-1 letters, which the tokenizer's model takes as they are but for its writing of bytes.
PLAIN = re.compile("[!-~ß-öø-ÿ]+").fullmatch

#: Classes of bytes. Of UTF-8 beyond ASCII only the letters of Latin-1 are no strangers.
SPACE, LETTER, DIGIT, OTHER, STRANGE = range(5)
KIND = np.full(256, STRANGE, dtype=np.uint8)
KIND[0x21:0x7F] = OTHER
KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
KIND[0x30:0x3A] = DIGIT
KIND[0x41:0x5B] = KIND[0x61:0x7B] = LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: The first byte of Latin-1 letters, and the second ones of the multiplication and division signs.
LATIN, SIGNS = 0xC3, (0x97, 0xB7)

#: Bytes of text handled at once.
BLOCK = 2 << 20


def _by_word(d: dict) -> bool:
    """Whether a definition drops white space, splits by SPLIT and marks word ends, so that words can be encoded apart."""
    steps = [x.get("type") for x in (d.get("normalizer") or {}).get("normalizers", [])]
    parts = (d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    alone = not any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) for t in d.get("added_tokens", []))
    split = parts[0].get("pattern") == {"Regex": SPLIT} and [p.get("type") for p in parts[1:]] == ["ByteLevel"] and not parts[1].get("add_prefix_space")
    return steps == ["NFC", "Replace", "Lowercase"] and split and d["model"].get("end_of_word_suffix") == "</w>" and alone


class Encoder:
    """Encodes texts for a tokenizer that drops white space and marks word ends with `</w>`; any other is called directly.

    The result always equals tokenizer.encode(text, add_special_tokens=False).ids. Texts are split into words as arrays
    of bytes, the different words of a block are looked up once each, and only new ones are merged by the tokenizer's
    model. The table of words is emptied when it reaches `most` entries, so memory is bounded.
    """

    def __init__(self, definition: str, most: int = 800_000):
        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocab.values(), default=0) < 65536 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = _by_word(json.loads(definition))
        # how the tokenizer writes the bytes of a Latin-1 letter, told by itself
        letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7] if self.by_word else []
        self.latin = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}
        self.most = most
        self._empty()

    def _empty(self) -> None:
        self.place: dict[bytes, int] = {}
        self.start, self.count, self.store, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, self.dtype), 0

    def _direct(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, new: list[bytes]) -> None:
        """Take pieces of blocks into the table."""
        flat, ends, tokenize, latin = [], [], self.model.tokenize, self.latin
        for word in new:
            if word.isascii():
                if KIND[word[0]] != SPACE:
                    flat += [t.id for t in tokenize(word.decode("ascii"))]
            elif PLAIN(text := word.decode("utf-8", "replace")):
                flat += [t.id for t in tokenize(text.translate(latin))]
            else:
                flat += self._direct(text)
            ends.append(len(flat))
        first, size = len(self.place), len(flat)
        while first + len(new) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        while self.used + size > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        rows, ends = slice(first, first + len(new)), np.array(ends)
        self.count[rows] = np.diff(ends, prepend=0)
        self.start[rows] = self.used + ends - self.count[rows]
        self.store[self.used : self.used + size] = flat
        self.used += size
        self.place.update(zip(new, range(first, first + len(new))))

    def _pieces(self, data: np.ndarray, kind: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where pieces start, the bytes in lower case) of rows that lie one after another in data, from `rows` on.

        Pieces are those of SPLIT, runs of white space, and whole chunks between white space if they have a stranger.
        """
        low = LOWER[data]
        first = np.zeros(len(data) + 4, dtype=bool)  # where a row starts
        first[rows] = True
        if (at := np.flatnonzero(data[:-1] == LATIN)).size:
            second = data[at + 1]
            at = at[(second != SIGNS[0]) & (second != SIGNS[1])]
            second = data[at + 1]
            kind[at] = kind[at + 1] = LETTER
            low[at + 1] = second + np.where(second < 0x9F, 32, 0).astype(np.uint8)
        if (odd := np.flatnonzero(kind == STRANGE)).size:
            edge = np.flatnonzero((kind == SPACE) | first[: len(data)])
            left, right = np.searchsorted(edge, odd, "right") - 1, np.searchsorted(edge, odd, "right")
            begin = np.where(left >= 0, edge[left], 0)
            begin = begin + (kind[begin] == SPACE)
            end = np.where(right < len(edge), edge[np.minimum(right, len(edge) - 1)], len(data))
            depth = np.zeros(len(data) + 1, dtype=np.int32)
            begin, end = np.unique(begin), np.unique(end)
            depth[begin] += 1
            depth[end] -= 1
            whole = np.cumsum(depth[:-1]) > 0
            kind[whole] = STRANGE
            low[whole] = data[whole]
        new = np.empty(len(data), dtype=bool)
        new[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new |= (kind == DIGIT) | first[: len(data)]
        at = np.flatnonzero((low == 0x27) & (kind == OTHER) & new)
        if at.size:
            ahead = np.r_[low, 0, 0, 0]
            x, y = ahead[at + 1], ahead[at + 2]
            short = at[np.isin(x, np.frombuffer(SHORT, np.uint8)) & ~first[at + 1]]
            long = at[np.logical_or.reduce([(x == a) & (y == b) for a, b in LONG]) & ~first[at + 1] & ~first[at + 2]]
            for found, size in ((short, 2), (long, 3)):
                new[found + 1] = False
                rest = found + size
                new[rest[rest < len(data)]] = True
        return np.flatnonzero(new), low

    def _block(self, data: np.ndarray, kind: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each row); kind holds the classes of the bytes, and is changed."""
        starts, low = self._pieces(data, kind, rows[:-1][np.diff(rows) > 0])
        offsets = np.r_[starts, len(data)].astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low)]).dictionary_encode()
        _, cuts, flat = words.dictionary.buffers()
        cuts, flat = np.frombuffer(cuts, np.int32)[: len(words.dictionary) + 1].tolist(), flat.to_pybytes()
        distinct = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        if len(self.place) + len(distinct) > self.most:
            self._empty()
        known = list(map(self.place.get, distinct))
        if None in known:
            fresh = iter(range(len(self.place), self.most + len(distinct)))
            self._learn([w for w, k in zip(distinct, known) if k is None])
            known = [next(fresh) if k is None else k for k in known]
        place = np.array(known, dtype=np.int64)[words.indices.to_numpy()]
        count = self.count[place]
        upto = np.r_[0, np.cumsum(count)]
        ids = self.store[np.repeat(self.start[place] - upto[:-1], count) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(starts, rows)])

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after another, how many each has); null counts as empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_word:
            each = [self._direct(t or "") for t in texts.to_pylist()]
            return np.array([i for x in each for i in x], dtype=self.dtype), np.array([len(x) for x in each], dtype=np.int64)
        binary = texts.fill_null("").cast(pa.large_binary())
        _, offsets, data = binary.buffers()
        ends = np.frombuffer(offsets, np.int64)[binary.offset : binary.offset + len(binary) + 1]
        data = np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None and len(ends) else np.zeros(0, np.uint8)
        ids, counts, at = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)], 0
        while at < len(binary):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, "right")) - 1)
            part, rows = data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            kind = KIND[part]
            whole = self._whole(part, kind, rows)
            if whole or to == at + 1:
                for k in range(to - at):  # one by one; those that go to the tokenizer whole are few
                    text = part[rows[k] : rows[k + 1]]
                    ids.append(np.array(self._direct(text.tobytes().decode("utf-8", "replace")), dtype=self.dtype) if k in whole else self._long(text))
                    counts.append(np.array([len(ids[-1])], dtype=np.int64))
            else:
                x, n = self._block(part, kind, rows)
                ids.append(x)
                counts.append(n)
            at = to
        return np.concatenate(ids), np.concatenate(counts)

    def _whole(self, data: np.ndarray, kind: np.ndarray, rows: np.ndarray) -> set[int]:
        """The rows that have a special token or an unusual character."""
        raw, found = data.tobytes(), set()
        # the second bytes of Latin-1 letters are no sign of one
        odd = np.flatnonzero((kind == STRANGE) & (data != LATIN) & (np.r_[0, data[:-1]] != LATIN))
        for k in np.unique(np.searchsorted(rows, odd, "right") - 1).tolist():
            if UNUSUAL.search(raw[rows[k] : rows[k + 1]].decode("utf-8", "replace")):
                found.add(k)
        for token in self.special:
            if token.encode() in raw:
                found |= {k for k in range(len(rows) - 1) if token.encode() in raw[rows[k] : rows[k + 1]]}
        return found

    def _long(self, text: np.ndarray) -> np.ndarray:
        """The ids of one text, in blocks that end at white space."""
        out, at = [np.zeros(0, self.dtype)], 0
        while at < len(text):
            to = min(len(text), at + BLOCK)
            while to < len(text) and not len(spaces := np.flatnonzero(KIND[text[to : to + BLOCK]] == SPACE)):
                to = min(len(text), to + BLOCK)
            to += int(spaces[0]) if to < len(text) else 0
            part = text[at:to]
            out.append(self._block(part, KIND[part], np.array([0, len(part)]))[0])
            at = to
        return np.concatenate(out)


_ENCODERS: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """One encoder per Python worker and definition, kept from task to task."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]
