"""Token ids by a public tokenizer: each different word of a slice is looked up once, in bounded memos.

The vocabulary used here splits text at white space before anything else, so the ids
of a text are those of its ASCII-white-space chunks in order. A chunk of plain
characters is split further into the runs that the vocabulary's own rule makes (letters,
single digits, marks), and each run goes to the BPE model directly. Any other chunk
(apostrophes, special tokens, other scripts) is encoded by the whole tokenizer. A file
with other rules is always used whole. Chunks and runs repeat, so each is encoded once
per worker while a memo holds it, and the ids of a slice are gathered from those of its
different chunks.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Id appended to each document.
END = 1
#: Chunks and runs in one generation of a worker's memos.
MEMO = 125_000

# The split rule of the vocabulary file for which runs are taken apart here.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Printable ASCII but the apostrophe, and the letters of Latin-1.
_PLAIN = re.compile("(?:[!-&(-~]|[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])*")
_RUN = re.compile("[A-Za-z\u00c0-\u00ff]+|[0-9]|[^A-Za-z0-9\u00c0-\u00ff]+")
#: Bytes of text that are encoded at once: the more, the more words are equal.
BLOCK_BYTES = 1 << 22


def _byte_letters() -> list[str]:
    """The character that byte-level vocabularies use for each byte: itself if visible, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Memo(dict):
    """Remembers what ``find`` gives, in two generations: beyond MEMO entries the older one goes."""

    def __init__(self, find):
        super().__init__()
        self._find, self._older = find, {}

    def __missing__(self, key: str) -> bytes:
        value = self._older.get(key)
        if value is None:
            value = self._find(key)
        if len(self) >= MEMO:
            self._older = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Encodes texts to unsigned 32-bit ids, with the end id after each text."""

    def __init__(self, path: str):
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenize = self._tokenizer.model.tokenize
        self._letters = _byte_letters()
        self._ids = [i.to_bytes(4, "little") for i in range(self._tokenizer.get_vocab_size())]
        self._runs, self._chunks = _Memo(self._run), _Memo(self._chunk)
        rules = json.loads(self._tokenizer.to_str())
        text = json.dumps(rules["pre_tokenizer"])
        self._splits = json.dumps(_SPLIT) in text and '"Lowercase"' in json.dumps(rules["normalizer"])

    def _packed(self, ids: list[int]) -> bytes:
        known = self._ids
        return b"".join([known[i] for i in ids])

    def _run(self, run: str) -> bytes:
        if not run.isascii():
            letters = self._letters
            run = "".join([letters[b] for b in run.encode()])
        known = self._ids
        return b"".join([known[t.id] for t in self._tokenize(run)])

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            if chunk.isalpha():
                return self._run(chunk.lower())
            if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
                return self._runs[chunk[:-1].lower()] + self._runs[chunk[-1]]
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            return b"".join(map(self._runs.__getitem__, _RUN.findall(chunk.lower())))
        return self._packed(self._tokenizer.encode(chunk, add_special_tokens=False).ids)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin (one more at the end)."""
        texts = pc.fill_null(texts, "")
        if not self._splits:
            found = [np.array([*e.ids, END], "<u4") for e in self._tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *found]), np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        chunks = pc.ascii_split_whitespace(texts)
        words = chunks.flatten().dictionary_encode()
        encoded = list(map(self._chunks.__getitem__, words.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        known = np.frombuffer(b"".join(encoded), "<u4")
        index = words.indices.to_numpy(zero_copy_only=False)
        count = sizes[index]
        before = np.concatenate([[0], np.cumsum(count)])
        rows = np.asarray(chunks.offsets) - chunks.offsets[0].as_py()
        ends = before[rows[1:]] + np.arange(1, len(rows))
        out = np.empty(before[-1] + len(ends), "<u4")
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[ends - 1] = END
        out[inside] = known[np.repeat((np.cumsum(sizes) - sizes)[index] - before[:-1], count) + np.arange(before[-1])]
        return out, np.concatenate([[0], ends])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
