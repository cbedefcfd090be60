"""Token ids of many texts under a tokenizer of the tokenizers library (.json) or of sentencepiece (.model).

A byte-level BPE tokenizer first splits a text into pieces (contractions, words, numbers, signs, white space) and encodes each piece by itself. Here the
split is done in numpy for texts whose characters leave no doubt about their class, and the library encodes each distinct piece
once per worker and cache filling. Every other text (other scripts, rare signs, special strings) goes to the library whole. A
sentencepiece BPE model without normalisation, none of whose pieces goes on with a blank after another character, encodes each word with the
blanks before it by itself. Pieces are told apart by 64-bit hashes. Any other tokenizer gets every text whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

from foreband.llm.words import mix, powers

LETTER, DIGIT, SIGN, SPACE, UNSURE = range(5)
_CLASS = np.full(256, UNSURE, np.uint8)
_CLASS[:128] = SIGN
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
# Latin-1 and Latin Extended-A letters take two bytes, 0xC3 to 0xC5 and one below 0xC0; 0xC3 0x97 and 0xC3 0xB7 are signs.
_CLASS[0x80:0xC0] = LETTER
_CLASS[0xC3:0xC6] = LETTER
_VALUE = np.random.default_rng(20260102).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_CACHED_PIECES, _CACHED_IDS = 600_000, 4_000_000
# Bytes that are split together, and pieces that the library encodes at once: a worker keeps what they need at their height.
_BLOCK, _AT_ONCE = 1 << 18, 4_096


def _classes(data: np.ndarray) -> np.ndarray:
    kind = _CLASS[data]
    for lead in np.flatnonzero(data == 0xC2):
        # Inverted marks, section, copyright, guillemets, degree and middle dot.
        if lead + 1 < len(data) and data[lead + 1] in (0xA1, 0xA7, 0xA9, 0xAB, 0xB0, 0xB7, 0xBB, 0xBF):
            kind[lead : lead + 2] = SIGN
    for lead in np.flatnonzero(data == 0xE2):
        # Dashes, quotation marks, bullets and the ellipsis; the euro sign.
        if lead + 2 < len(data) and ((data[lead + 1] == 0x80 and 0x90 <= data[lead + 2] <= 0xA7) or (data[lead + 1] == 0x82 and data[lead + 2] == 0xAC)):
            kind[lead : lead + 3] = SIGN
    odd = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    kind[odd] = UNSURE
    return kind


def _starts(data: np.ndarray, kind: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """First bytes of all pieces of non-empty texts laid end to end; docs: first bytes of the texts."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[docs] = first[n] = True
    new = first[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(new)
    end = np.append(run[1:], n)
    what, size, closing = kind[run], end - run, first[end]
    space = what == SPACE
    blank = space & (data[end - 1] == 32) & ~closing
    joined = np.zeros(len(run), bool)  # runs that take the blank before them
    joined[1:] = blank[:-1]
    keep = np.where(space, (size >= 2) | ~blank, True)
    start = run - joined
    extra = end[space & (size >= 2) & ~closing & ~blank] - 1
    mark = np.flatnonzero((what == SIGN) & (size == 1) & (data[run] == 39) & ~joined & ~closing)
    mark = mark[what[mark + 1] == LETTER] if len(mark) else mark
    more = []
    for m in mark:
        a, b = end[m], end[m + 1]
        tail = data[a : min(a + 2, b)].tobytes()
        taken = 2 if tail in (b"re", b"ve", b"ll") else 1 if tail[:1] in (b"s", b"t", b"m", b"d") else 0
        if taken:
            keep[m + 1] = False
            if a + taken < b:
                more.append(a + taken)
    return np.sort(np.concatenate((start[keep], extra, np.array(more, np.int64))))


# What a tokenizer file says if its split is the one of `_starts`.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


class Encoder:
    """Encodes texts given as UTF-8 bytes by a tokenizer file of the tokenizers library.

    plain: special strings inside texts are ordinary text; else they are handled as by the library's default.
    """

    def __init__(self, path: str, plain: bool = False):
        # One thread for each task, which Spark counts on.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain
        self.specials = [] if plain else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        says = json.loads(self.tokenizer.to_str())
        before = says["pre_tokenizer"] or {}
        self.splits = not says["normalizer"] and says["model"]["type"] == "BPE" and all(before.get(k) == v for k, v in _BYTE_LEVEL.items())
        self.clear()

    def token_bytes(self) -> list[bytes]:
        """The bytes each id stands for, by the byte-level alphabet: bytes that print stand for themselves, the others follow from 256 on."""
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        out = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        added = self.tokenizer.get_added_tokens_decoder()
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            out[i] = token.encode() if i in added else bytes(byte_of[c] for c in token)
        return out

    def clear(self) -> None:
        # Hashes of cached pieces in rising order, with the place and number of each one's ids; arrays, as a dictionary takes ten times the space.
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        """The library itself."""
        return [np.array(ids, np.uint32) for ids in self._library(texts)]

    def _library(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def _pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of distinct pieces of texts."""
        return self._library(pieces)

    def _starts(self, data: np.ndarray, docs: np.ndarray) -> np.ndarray:
        return _starts(data, _classes(data), docs)

    def _numbers(self, hashes: np.ndarray, pieces) -> np.ndarray:
        """Places, until the next call, of distinct pieces in the cache; hashes rise; pieces(i) gives the bytes of those that are not there yet."""
        if len(self.known) > _CACHED_PIECES or self.used > _CACHED_IDS:
            self.clear()
        spots = np.searchsorted(self.known, hashes)
        there = spots < len(self.known)
        there[there] = self.known[spots[there]] == hashes[there]
        missing = np.flatnonzero(~there)
        if len(missing):
            at, sizes, n = spots[missing], [], self.used
            for i in range(0, len(missing), _AT_ONCE):
                encoded = self._pieces([pieces(j) for j in missing[i : i + _AT_ONCE]])
                sizes += [len(e) for e in encoded]
                flat = np.fromiter(chain.from_iterable(encoded), np.uint32)
                while self.used + len(flat) > len(self.ids):
                    self.ids = np.append(self.ids, self.ids)
                self.ids[self.used : self.used + len(flat)] = flat
                self.used += len(flat)
            sizes = np.array(sizes, np.int32)
            self.known = np.insert(self.known, at, hashes[missing])
            self.at = np.insert(self.at, at, n + np.cumsum(sizes) - sizes)
            self.size = np.insert(self.size, at, sizes)
        return spots + (np.cumsum(~there) - ~there)

    def _block(self, texts: list[bytes], want_ids: bool) -> list:
        """Ids or counts of texts that are not empty, each of characters of sure class."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        docs = np.cumsum([0] + [len(t) for t in texts])[:-1]
        starts = self._starts(data, docs)
        sizes = np.diff(starts, append=len(data))
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        hashes = mix(np.add.reduceat(_VALUE[data] * powers(int(sizes.max()))[place], starts) + sizes.astype(np.uint64))
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        number = self._numbers(distinct, lambda i: raw[starts[where[i]] : starts[where[i]] + sizes[where[i]]])[back]
        counts = self.size[number]
        ends = np.cumsum(counts)
        cuts = np.append(0, ends)[np.append(np.searchsorted(starts, docs), len(starts))]
        if not want_ids:
            return np.diff(cuts).tolist()
        index = np.arange(ends[-1]) + np.repeat(self.at[number] - (ends - counts), counts)
        flat = self.ids[index]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _sure(self, text: bytes) -> bool:
        if not self.splits or any(s in text for s in self.specials):
            return False
        return text.isascii() or not (_classes(np.frombuffer(text, np.uint8)) == UNSURE).any()

    def encode(self, texts: list[bytes], want_ids: bool = True) -> Iterator:
        """For each text its ids, or their number."""
        out: dict[int, object] = {}
        plain, size = [], 0

        def flush():
            if plain:
                out.update(zip(plain, self._block([texts[i] for i in plain], want_ids), strict=True))
                plain.clear()

        done = 0
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, np.uint32) if want_ids else 0
            elif self._sure(text):
                plain.append(i)
                size += len(text)
            else:
                ids = self.whole([text])[0]
                out[i] = ids if want_ids else len(ids)
            if size >= _BLOCK or i + 1 == len(texts):
                flush()
                size = 0
                while done <= i:
                    yield out.pop(done)
                    done += 1


_MARK = "\u2581"


class PieceEncoder(Encoder):
    """Encodes texts by a sentencepiece model; special strings inside texts are handled as by the library's default."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_file=path)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.blank = pieces.index(_MARK) if _MARK in pieces else -1
        inner = any(_MARK in p.lstrip(_MARK) for p in pieces)
        self.splits = self.blank >= 0 and not inner and self._simple(path)
        self.clear()

    @staticmethod
    def _simple(path: str) -> bool:
        """Whether the model is a BPE that puts a blank first and leaves texts as they are otherwise."""
        try:
            from sentencepiece import sentencepiece_model_pb2
        except ImportError:
            return False  # without its reader, texts go whole
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trained = model.normalizer_spec, model.trainer_spec
        kept = spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
        return bool(kept and trained.model_type == 2 and not trained.treat_whitespace_as_suffix and not any(p.type == 4 for p in model.pieces))

    def token_bytes(self) -> list[bytes]:
        sp = self.processor
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        return [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(names)]

    def _library(self, texts: list[bytes]) -> list[list[int]]:
        return self.processor.encode([t.decode("utf-8", "replace") for t in texts], num_threads=1)

    def _pieces(self, pieces: list[bytes]) -> list[list[int]]:
        # The library puts the first blank itself, but not before an empty text.
        return [ids or [self.blank] for ids in self._library([p[1:] for p in pieces])]

    def _starts(self, data: np.ndarray, docs: np.ndarray) -> np.ndarray:
        blank = data == 32
        new = blank & ~np.append(False, blank[:-1])
        new[docs] = True
        return np.flatnonzero(new)

    def _block(self, texts: list[bytes], want_ids: bool) -> list:
        return super()._block([b" " + t for t in texts], want_ids)

    def _sure(self, text: bytes) -> bool:
        return self.splits and _MARK.encode() not in text


@lru_cache(maxsize=4)
def encoder(path: str, plain: bool = False) -> Encoder:
    """The encoder of a tokenizer file; plain: see Encoder."""
    return PieceEncoder(path) if path.endswith(".model") else Encoder(path, plain)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
