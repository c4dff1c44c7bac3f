"""Token ids by the tokenizers library, with a bounded memory of what each worker has encoded before."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces remembered in a worker (about 200 bytes each), the ids they may have together, and the longest one remembered.
REMEMBERED = 1_200_000
REMEMBERED_IDS = 8 * REMEMBERED
LONGEST = 48
#: Pieces that are looked up at a time, and bytes of text that callers should give at a time.
PIECES = 1 << 21
BLOCK_BYTES = 1 << 23

#: Settings of a model without which its vocabulary and merges make it whole.
OPTIONS = "dropout unk_token continuing_subword_prefix end_of_word_suffix fuse_unk byte_fallback ignore_merges".split()

_word = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Byte-level models write a byte that is a visible character as itself and the n-th other byte as character 256 + n.
_visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
_printable = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _visible)}
_space = _printable[32]
_open: dict[str, "Encoder"] = {}


def _bytes(*ranges: range) -> np.ndarray:
    out = np.zeros(256, bool)
    for r in ranges:
        out[r.start : r.stop] = True
    return out


#: Bytes that surely begin a character other than white space: visible ASCII, and lead bytes without spaces among theirs.
_SOLID = _bytes(range(0x21, 0x7F), range(0xC3, 0xE1), range(0xE4, 0xF5))
_LETTER = _bytes(range(0x41, 0x5B), range(0x61, 0x7B))
_MARK = _bytes(range(0x21, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x7F))


def cuts(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the usual split pattern starts a new word whatever stands around, as flags over the bytes of texts that
    stand one after the other; starts are theirs, and flagged too.

    The last of several white-space characters before another character is never in a word with those before it; a
    space goes with what follows and a line break alone. A letter and a mark after it are never in one word.
    """
    out = np.zeros(len(text) + 1, bool)
    if len(text) > 1:
        this, after = text[:-1], text[1:]
        solid = _SOLID[after]
        solid[starts[(starts > 0) & (starts < len(text))] - 1] = False
        line = (this == 10) & solid
        out[:-2] = line | ((this == 32) & solid)
        out[1:-1] |= line
        letter = _LETTER[this]
        letter[1:] |= (text[:-2] == 0xC3) & (this[1:] >= 0x80) & (this[1:] != 0x97) & (this[1:] != 0xB7)
        out[1:-1] |= letter & _MARK[after]
    out[starts] = True
    return out


class Encoder:
    """encode(texts) gives the ids of an Arrow array of texts, one after the other, and where each text's begin and end.

    A byte-level tokenizer with the usual split pattern encodes a text as it does the pieces of cuts(), one after the
    other. Arrow numbers the distinct pieces of a block; those that the worker has met are looked up, the others
    encoded. Other tokenizers, and texts that hold a token added to the vocabulary, are encoded whole, by the library's
    defaults.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        made = json.loads(self.tokenizer.to_str())
        pre, model = made.get("pre_tokenizer") or {}, made["model"]
        self.by_piece = made.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = [t["content"].encode() for t in made.get("added_tokens") or []]
        self.model = self.tokenizer.model
        if self.by_piece and isinstance(self.model, BPE) and not any(model.get(k) for k in OPTIONS):
            # The same model without its own memory of words, which costs more than it saves here.
            pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
            self.model = BPE(vocab=model["vocab"], merges=pairs, cache_capacity=0)
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids, self.used = np.empty(1 << 16, self.dtype), 0
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        """Give new pieces slots: runs of letters go to the model alone, which takes bytes as printable characters, as
        the split pattern leaves them whole; the others are encoded as texts."""
        texts = [p.decode() for p in pieces]
        coded: list = [None] * len(texts)
        tokenize, rest = self.model.tokenize, []
        for i, t in enumerate(texts):
            if _word.fullmatch(t):
                shown = t.replace(" ", _space) if t.isascii() else pieces[i].decode("latin-1").translate(_printable)
                coded[i] = [x.id for x in tokenize(shown)]
            else:
                rest.append(i)
        for i, ids in zip(rest, self._whole([texts[i] for i in rest])):
            coded[i] = ids
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        new = np.fromiter(chain.from_iterable(coded), self.dtype)
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(self.used + len(new), self.dtype)])
        self.ids[self.used : self.used + len(new)] = new
        self.slots.update(zip(pieces, range(len(self.sizes), len(self.sizes) + len(pieces))))
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += len(new)

    def _pieces(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces between cut points, and how many each piece has."""
        base = data[at[0] : at[-1]]
        numbered = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at - at[0]), pa.py_buffer(base)]).dictionary_encode()
        pieces = numbered.dictionary.to_pylist()
        if len(self.sizes) + len(pieces) > REMEMBERED or self.used > REMEMBERED_IDS:
            self._forget()
        new = [p for p in pieces if p not in self.slots]
        self._learn(new)
        slots = np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))
        nth = numbered.indices.to_numpy()
        sizes = self.sizes[slots][nth]
        begin = self.starts[slots][nth] - (np.cumsum(sizes) - sizes)
        ids = self.ids[np.repeat(begin, sizes) + np.arange(sizes.sum())]
        for p in new:
            if len(p) > LONGEST:
                del self.slots[p]
        return ids, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i has ids[bounds[i] : bounds[i + 1]]. Texts are not null."""
        texts = texts.cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        if not self.by_piece or any(t in data.tobytes() for t in self.added):
            coded = self._whole(texts.to_pylist())
            return np.fromiter(chain.from_iterable(coded), self.dtype), np.cumsum([0, *map(len, coded)])
        at = np.flatnonzero(cuts(data, bounds - bounds[0]))
        found = [self._pieces(data, at[lo : lo + PIECES + 1]) for lo in range(0, len(at) - 1, PIECES)]
        ids = np.concatenate([np.empty(0, self.dtype), *(i for i, _ in found)])
        before = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *(n for _, n in found)]))])
        return ids, before[np.searchsorted(at, bounds - bounds[0])]

    def closed(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """encode() with end_id after each text's ids."""
        ids, bounds = self.encode(texts)
        return np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))


def blocks(batch: pa.RecordBatch, column: str = "text"):
    """Slices of a batch whose texts have about BLOCK_BYTES together, one row at least."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + BLOCK_BYTES, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, loaded once."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]
