"""Encoders that know each distinct stretch of text, for vocabularies that keep white space.

A text is cut only where no token can lie across, so a stretch's ids are those it has within its text. Where that is,
is a table over adjacent bytes that comes from the vocabulary's own rules; one lookup marks all cuts of a batch.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import tokens

_spaces = [9, 10, 11, 12, 13, 32]
SPACE, LETTER, LATER = (np.zeros(256, bool) for _ in range(3))
SPACE[_spaces] = True
LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
LATER[0x80:0xC0] = True  # bytes within a character

#: Byte pairs with which white space beyond ASCII begins (no-break space, U+2000 and so on).
WIDE_SPACE = [(0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)]


def byte_level(data: bytes) -> np.ndarray | None:
    """Pairs of bytes between which a byte-level vocabulary's splitter always splits: before white space, unless white
    space goes before it, and after an ASCII letter before any other ASCII character. None if its rules are others."""
    t = json.loads(data)
    split = t.get("pre_tokenizer") or {}
    if t.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in t.get("added_tokens", [])):
        return None
    out = ~SPACE[:, None] & SPACE[None, :]
    out |= LETTER[:, None] & ~LETTER[None, :] & (np.arange(256) < 128)[None, :]
    return out


def piece_level(model, data: bytes) -> np.ndarray | None:
    """Pairs of bytes that are adjacent in no piece of a BPE model, so that no merge joins them. None if the model
    rewrites texts or isn't BPE."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(data)
    spec = proto.normalizer_spec
    kinds = {p.type for p in proto.pieces}
    rewrites = spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces
    if rewrites or proto.trainer_spec.model_type != pb.TrainerSpec.BPE or proto.trainer_spec.treat_whitespace_as_suffix or pb.ModelProto.SentencePiece.USER_DEFINED in kinds:
        return None
    joined = np.zeros((256, 256), bool)
    for p in proto.pieces:
        if p.type == pb.ModelProto.SentencePiece.NORMAL:
            for said in (p.piece, p.piece.replace("▁", " ")):
                x = np.frombuffer(said.encode(), np.uint8)
                joined[x[:-1], x[1:]] = True
    if joined[10].any() or joined[:, 10].any() or len(model.encode("\n")) != 2:
        return None
    return ~joined & ~LATER[None, :]


class Cutter:
    """Cuts texts between pairs of bytes that a table names."""

    def __init__(self, pairs: np.ndarray | None) -> None:
        loose = np.zeros((256, 256), np.uint8) if pairs is None else (pairs & ~LATER[None, :]).astype(np.uint8)
        strict = loose.copy()
        strict[np.ix_(range(128, 256), _spaces)] = 0  # a character before may be wide white space
        wide = np.zeros((256, 256), np.uint8)
        wide[tuple(zip(*WIDE_SPACE, strict=True))] = 4
        self.table = (loose | strict << 1 | wide).ravel()

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(stretches of all texts, where each text's stretches start and the last ones end). texts have no nulls; an
        empty text has no stretch."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        first, n = int(offsets[0]), int(offsets[-1] - offsets[0])
        if not n:
            return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
        buffer = texts.buffers()[2].slice(first, n)
        x, ends = np.frombuffer(buffer, np.uint8), offsets - first
        starts = np.zeros(n, bool)
        marks = self.table[(x[:-1].astype(np.uint16) << 8) | x[1:]]
        starts[1:] = marks & (2 if (marks & 4).any() else 1)
        starts[ends[:-1][np.diff(ends) > 0]] = True
        at = np.flatnonzero(starts).astype(np.int32)
        out = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.append(at, np.int32(n))), buffer])
        return out, np.searchsorted(at, ends)


class Encoder(tokens.Encoder):
    """ids of whole texts as the library of the file's kind gives them. plain: special tokens' strings are plain text;
    else a text that holds one goes to the library whole."""

    def __init__(self, data: bytes, kind: str, plain: bool = False, words: int = 1_000_000) -> None:
        super().__init__(data, kind, words)
        self.specials: list[str] = []
        if kind == "model":
            self.pairs = piece_level(self.model, data)
        else:
            self.pairs, self.model.encode_special_tokens = byte_level(data), plain
            self.specials = [] if plain else [x["content"] for x in json.loads(data).get("added_tokens", [])]
        self.cutter = Cutter(self.pairs)

    def word(self, word: str) -> bytes:
        return tokens.as_bytes(self.stretch(word))

    def stretch(self, word: str) -> list[int]:
        """ids of a stretch. The sentencepiece library puts a space before a text; after a line end, which no piece of
        the vocabulary continues, it puts none."""
        if self.kind == "json":
            return self.model.encode(word, add_special_tokens=False).ids
        return self.model.encode(word, num_threads=1) if self.pairs is None else self.model.encode("\n" + word, num_threads=1)[2:]

    def ragged(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        for s in self.specials:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        rest = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        if self.kind == "model" and self.pairs is not None:
            rest = pc.if_else(pc.equal(rest, ""), "", pc.binary_join_element_wise(" ", rest, ""))
        words, at = self.cutter.cut(rest)
        numbered = words.dictionary_encode()
        word = self.places(numbered.dictionary)[numbered.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int32)
        n = self.size[word]
        ends = np.append(0, np.cumsum(n, dtype=np.int64))
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.first[word] - ends[:-1], n)]
        starts = ends[at]
        if whole.any():  # the texts that went to the library whole take their places
            parts = np.split(ids, starts[1:-1])
            for i in np.flatnonzero(whole):
                parts[i] = np.array(self.stretch(texts[int(i)].as_py()), np.uint32)
            ids, starts = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return ids, starts


def encoder_of(held: dict, plain: bool = False) -> Encoder:
    """The encoder of a broadcast {"data", "kind"}, kept with the worker's copy of it."""
    if "stretches" not in held:
        held["stretches"] = Encoder(held["data"], held["kind"], plain)
    return held["stretches"]
