"""Tokenizer files, and whole-text encoding that looks each distinct word up once.

Files are read on the driver and sent to executors by a Spark broadcast: a vocabulary file has a fixed size.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of the texts that are cut into words at once.
SLICE_BYTES = 16 << 20


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)



def _class(kinds: str) -> str:
    """Latin-1 characters of these general categories, for a regular expression, without the space-like ones."""
    return "".join(re.escape(c) for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x100)]) if unicodedata.category(c)[0] in kinds)


#: A character that is not plain Latin-1 text, and the parts of plain text once it is in lower case.
ODD = re.compile(r"[^\x20-\x7e\xa1-\xff]")
PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_class('L')}]+|[{_class('N')}]|[{_class('MPSZC')}]+")
#: Byte-level vocabularies write each byte as a letter: printable Latin-1 bytes as themselves, the rest from U+0100 on.
_plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: chr(b) for b in _plain} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in set(_plain))}


def as_byte_letters(word: str) -> str:
    return word if word.isascii() else "".join(map(BYTE_LETTERS.__getitem__, word.encode()))


class Encoder:
    """ids of whole texts, as the library of the file's kind gives them, without added tokens, truncation or padding.

    A `.json` vocabulary whose normaliser and splitter drop white space lets a text be cut at ASCII white space. Arrow cuts
    the texts, numbers their distinct words and finds them in a table of about `words` entries at most; only new words
    reach the library. A new word of plain Latin-1 characters is cut further, as the file's own splitter does, and its
    parts reach the library's BPE alone. Either way the ids are the library's own.
    """

    def __init__(self, data: bytes, kind: str, words: int = 1_500_000) -> None:
        self.kind, self.most = kind, words
        self.forget()
        self.parts = Table(lambda w: as_bytes(t.id for t in self.model.model.tokenize(as_byte_letters(w))), words // 4)
        if kind == "model":
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.by_word = False
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_str(data.decode("utf-8"))
            self.model.no_truncation()
            self.model.no_padding()
            self.by_word = drops_space(data)

    def forget(self) -> None:
        """Known words, and where each one's ids lie: first, and how many."""
        self.known, self.ids = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.first, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def places(self, words: pa.Array) -> np.ndarray:
        """Each word's number among the known ones; words that are new become known."""
        if len(self.known) > self.most or len(self.ids) > 8 * self.most:
            self.forget()
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(at))
        if len(new):
            blobs = [*map(self.word, new.to_pylist())]
            size = np.fromiter(map(len, blobs), np.int32, len(blobs)) // 4
            self.first = np.append(self.first, len(self.ids) + np.cumsum(size, dtype=np.int32) - size)
            self.size, self.ids = np.append(self.size, size), np.append(self.ids, np.frombuffer(b"".join(blobs), np.uint32))
            start, self.known = len(self.known), pa.concat_arrays([self.known, new])
            at = at.to_numpy(zero_copy_only=False)
            at[np.isnan(at)] = np.arange(start, start + len(new))
            return at.astype(np.int32)
        return at.to_numpy(zero_copy_only=False).astype(np.int32)

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, end, ids of these texts in one array, where each text's ids start and the last ones end)."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            yield at, upto, *self.ragged(texts.slice(at, upto - at))
            at = upto

    def ragged(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            found = texts.to_pylist()
            ids = self.model.encode(found, num_threads=1) if self.kind == "model" else [self.model.encode(x, add_special_tokens=False).ids for x in found]
            starts = np.cumsum([0, *map(len, ids)])
            return np.fromiter((i for x in ids for i in x), np.uint32, int(starts[-1])), starts
        words = pc.ascii_split_whitespace(texts)
        numbered = words.flatten().dictionary_encode()
        word = self.places(numbered.dictionary)[numbered.indices.to_numpy(zero_copy_only=False)]
        n = self.size[word]
        ends = np.append(np.int32(0), np.cumsum(n, dtype=np.int32))
        ids = self.ids[np.arange(ends[-1], dtype=np.int32) + np.repeat(self.first[word] - ends[:-1], n)]
        return ids, ends[words.offsets.to_numpy(zero_copy_only=False) - words.offsets[0].as_py()]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for _, _, ids, starts in self.slices(pa.array(texts, pa.string())):
            out += np.split(ids, starts[1:-1])
        return out

    def word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.parts[word.lower()]
        if ODD.search(word) is None and "<|" not in word:
            return b"".join(map(self.parts.__getitem__, PARTS.findall(word.lower())))
        return as_bytes(self.model.encode(word, add_special_tokens=False).ids)


def as_bytes(ids) -> bytes:
    return array("I", ids).tobytes()


class Table(dict):
    """Remembers at most `most` answers; past that it starts anew."""

    def __init__(self, answer, most: int) -> None:
        super().__init__()
        self.answer, self.most = answer, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[key] = found = self.answer(key)
        return found


def drops_space(data: bytes) -> bool:
    """Whether the file's own rules keep no white space and never look across it."""
    import json

    t = json.loads(data)
    rules, split = t.get("normalizer") or {}, t.get("pre_tokenizer") or {}
    kinds = {x.get("type") for x in rules.get("normalizers", [rules])}
    first = split.get("pretokenizers", [split])[0]
    return kinds <= {"NFC", "Replace", "Lowercase"} and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and "[^\\s" in (first.get("pattern") or {}).get("Regex", "") and not any(re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] or x["single_word"] for x in t.get("added_tokens", []))


def version(data: bytes, kind: str) -> str:
    """Digest of the vocabulary and of the library that reads it."""
    import importlib.metadata as m

    library = "sentencepiece" if kind == "model" else "tokenizers"
    return hashlib.sha256(data + f"\0{library}=={m.version(library)}".encode()).hexdigest()


def encoder_of(held: dict) -> Encoder:
    """The encoder of a broadcast {"data", "kind"}. It stays with the worker's copy of the broadcast, so the tasks that one
    worker runs share its tables; a new worker starts with empty ones."""
    if "encoder" not in held:
        held["encoder"] = Encoder(held["data"], held["kind"])
    return held["encoder"]


def load(path: str) -> tuple[bytes, str]:
    with open(path, "rb") as f:
        return f.read(), "model" if path.endswith(".model") else "json"
