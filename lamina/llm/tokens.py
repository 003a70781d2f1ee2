"""Whole texts to token ids with the tokenizers library, word by word through a bounded cache.

A byte-level BPE never merges across its pre-tokens. Text is therefore cut where a pre-token must
begin, each distinct piece is encoded once, and the pieces' ids are joined. Which cuts are safe is
read from the tokenizer's own file; a kind that is not known is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from lamina.llm.common import binary

#: Distinct pieces in either part of a worker's cache at most; beyond it that part starts anew.
CACHE = 300_000
#: Bytes of texts encoded together, so that what is new in them stays small.
TOGETHER = 4 << 20


def _cut_byte_level(text: str) -> list[str]:
    """Cut before each single space between two characters that are not white space."""
    parts = text.split(" ")
    if _WIDE.search(text) or text[:1] == " " or text[-1:] == " ":
        parts = _SINGLE.split(text)
    return [parts[0], *[" " + p for p in parts[1:]]]


_WIDE = re.compile(r" \s|\s ")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
#: Letters, and marks that are neither white space nor an apostrophe: pre-tokens part between the two.
_LETTER, _MARK, _BLANK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[*b".,!?;:"]] = True
_BLANK[: 0x20 + 1] = True


def _cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of texts (UTF-8, end to end) begin, and which texts must be cut in another way:
    those in which a space is not alone between two characters that are no white space."""
    space = data == 0x20
    begin = space.copy()
    begin[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    begin[offsets[:-1][offsets[:-1] < len(data)]] = True
    blank = _BLANK[data]
    wide = np.flatnonzero(space[:-1] & blank[1:] | blank[:-1] & space[1:])
    edge = np.concatenate([offsets[:-1], offsets[1:] - 1])[np.tile(np.diff(offsets) > 0, 2)]
    wide = np.concatenate([wide, edge[space[edge]]])
    lead = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))  # white space beyond ASCII begins so
    if len(lead):
        second, third = (data[np.minimum(lead + k, len(data) - 1)] for k in (1, 2))
        first = data[lead]
        other = (first == 0xC2) & ((second == 0x85) | (second == 0xA0)) | (first == 0xE1) & (second == 0x9A) | (first == 0xE3) & (second == 0x80)
        other |= (first == 0xE2) & ((second == 0x80) & ((third <= 0x8B) | (third >= 0xA8) & (third <= 0xAF)) | (second == 0x81))
        wide = np.concatenate([wide, lead[other]])
    return np.flatnonzero(begin), np.unique(np.searchsorted(offsets, wide, "right") - 1)


def _cut_spaced(text: str) -> list[str]:
    """Cut at spaces and line feeds, which this kind drops."""
    return text.replace("\n", " ").split(" ")


#: A-Z lower-cased and line feeds as spaces, which makes no difference to this kind.
_LEVEL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\n", b"abcdefghijklmnopqrstuvwxyz ")


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts (UTF-8 through ``_LEVEL``, end to end) cut at spaces and where a mark follows a letter: the bytes
    without the spaces, where each word begins in them, and for each text the index of its first word."""
    held = data != 0x20
    begin = held.copy()
    begin[1:] &= ~held[:-1]
    mark = np.flatnonzero(_MARK[data])
    mark = mark[mark > 1]
    last, lead = data[mark - 1], data[mark - 2]
    begin[mark[_LETTER[last] | (lead == 0xC3) & (last != 0x97) & (last != 0xB7)]] = True  # no times or division sign
    first = offsets[:-1][offsets[:-1] < len(data)]
    begin[first] = held[first]
    return data[held], np.flatnonzero(begin[held]), np.searchsorted(np.flatnonzero(begin), offsets)


#: Fixed value: the pre-token pattern of the byte-level kind.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _kind(spec: dict):
    """(how to cut, pattern of pre-tokens, whether the last id of each carries an end mark), or nones."""
    pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and normal is None:
        return _cut_byte_level, regex.compile(BYTE_LEVEL), None
    steps = pre.get("pretokenizers", [])
    if [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and (normal or {}).get("type") == "Sequence" and {"NFC", "Replace", "Lowercase"} >= {n["type"] for n in normal["normalizers"]} and spec["model"].get("end_of_word_suffix"):
        return _cut_spaced, regex.compile(steps[0]["pattern"]["Regex"]), spec["model"]["end_of_word_suffix"]
    return None, None, None


def _parts(ids: np.ndarray, names: list[str], starts: list[int], ends: list[int]) -> dict[str, bytes]:
    flat = ids.tobytes()
    return {p: flat[4 * i : 4 * j] for p, i, j in zip(names, starts, ends, strict=True)}


class Encoder:
    """``bytes_of(text)``: the ids of a text as little-endian unsigned 32-bit integers.

    They are those of the library's own ``encode(text, add_special_tokens=False)``: a special token's
    string inside a text is its id. Texts with such a string are encoded whole.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.plain = Tokenizer.from_file(path)
        marks = [t for t in spec.get("added_tokens", []) if t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.mark = max(marks, key=lambda t: t["id"]) if marks else None
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut, self.pattern, self.end = _kind(spec) if self.mark else (None, None, None)
        if self.cut:
            vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
            self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes, or 1 for a last id
            for token, at in vocab.items():
                self.width[at] = token.endswith(self.end) if self.end else len(token)
        self.looks = [s.encode() for s in self.special]
        if self.end:  # pre-tokens that were found already need neither the normaliser nor the pattern
            self.looks = [s.translate(_LEVEL) for s in self.looks]
            rest = {k: v for k, v in spec["pre_tokenizer"]["pretokenizers"][1].items() if k in ("add_prefix_space", "use_regex")}
            self.bare = Tokenizer(self.plain.model)
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(**rest)])
        self.most, self.known, self.young = cache, {}, {}

    def whole(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _marked(self, pieces: list[str]) -> dict[str, bytes]:
        """Each piece's ids, from one run over all of them with a special token in between."""
        out = {}
        if pieces:
            ids = np.array(self.plain.encode_batch_fast([self.mark["content"].join(pieces)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.mark["id"])
            out |= _parts(ids, pieces, [0, *(at + 1).tolist()], [*at.tolist(), len(ids)])
        return out

    def _joined(self, tokens: list[str], plain: bool = False) -> dict[str, bytes]:
        """Each pre-token's ids, from one run over all of them; where they end shows in the ids.

        ``plain``: all of them are ASCII words with the space before them, which keep apart.
        """
        safe = tokens if plain or self.end else [t for t in tokens if t[0] == " " and len(t) > 1 and not t[1].isspace()]
        out = self._marked(list(set(tokens).difference(safe))) if len(safe) < len(tokens) else {}
        if safe:
            between, run = (" ", self.bare) if self.end else ("", self.plain)
            ids = np.array(run.encode_batch_fast([between.join(safe)], add_special_tokens=False)[0].ids, "<u4")
            reach = np.cumsum(self.width[ids])
            want = np.arange(1, len(safe) + 1) if self.end else np.cumsum(np.fromiter(map(len, safe) if plain else (len(t.encode()) for t in safe), np.int64, len(safe)))
            last = np.searchsorted(reach, want)
            if len(reach) and reach[-1] == want[-1] and (reach[last] == want).all():
                ends = (last + 1).tolist()
                out |= _parts(ids, safe, [0, *ends[:-1]], ends)
            else:
                out |= self._marked(safe)
        return out

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """New pieces: their pre-tokens are looked up or encoded, then joined."""
        known, young, whole = self.known, self.young, []
        if self.end:
            plain = [p for p in pieces if p.isalpha() and p.islower() and (p.isascii() or max(p) <= "\u00ff")]  # one pre-token as it stands
        else:
            plain = [p for p in pieces if p.isascii() and p[1:].isalpha() and p[0] == " "]
        out = self._joined(plain, plain=not self.end) if plain else {}
        rest = [p for p in pieces if p not in out] if len(out) < len(pieces) else []
        if self.end:
            whole = [p for p in rest if p and max(p) > "\u00ff"]  # may change when it is normalised
            odd = set(whole)
            parts = {p: self.pattern.findall(p.lower()) for p in rest if p not in odd}
        else:
            parts = dict(zip(rest, map(self.pattern.findall, rest), strict=True))
        needed = set(chain.from_iterable(parts.values()))
        found = {t: ids for t in needed if (ids := known.get(t) or out.get(t) or young.get(t)) is not None}
        if new := [t for t in needed if t not in found]:
            fresh = self._joined(new)
            young.update(fresh)
            found.update(fresh)
        out.update({p: found[tokens[0]] if len(tokens) == 1 else b"".join([found[t] for t in tokens]) for p, tokens in parts.items()})
        return out | self._marked(whole) if whole else out

    def _looked_up(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, from the cache or by one run for all new ones.

        What is met a second time moves to the lasting part of the cache; the rest, mostly never met
        again, is dropped whenever there is too much of it.
        """
        known, young = self.known, self.young
        out = list(map(known.get, pieces))
        lacking = [p for p, ids in zip(pieces, out, strict=True) if ids is None]
        if not lacking:
            return out
        again = {p: young.pop(p) for p in lacking if p in young}
        fresh = self._pieces([p for p in lacking if p not in again])
        for part, more in ((known, again), (young, fresh)):
            if len(part) + len(more) > self.most:
                part.clear()
            part.update(more)
        fresh |= again
        return [fresh[p] if ids is None else ids for p, ids in zip(pieces, out, strict=True)]

    def bytes_of_all(self, texts: list[str]) -> list[bytes]:
        """``bytes_of`` for many texts, which share one run for their new pieces."""
        if self.cut is None:
            return [self.whole(t) if t else b"" for t in texts]
        if odd := {t for t in texts if t and any(s in t for s in self.special)}:
            alone = {t: self.whole(t) for t in odd}
            rest = iter(self.bytes_of_all([t for t in texts if t not in odd]))
            return [alone[t] if t in odd else next(rest) for t in texts]
        cuts = [self.cut(t) if t else [] for t in texts]
        names = list(dict.fromkeys(chain.from_iterable(cuts)))
        local = dict(zip(names, self._looked_up(names), strict=True))
        return [b"".join(map(local.__getitem__, parts)) for parts in cuts]

    def bytes_of_column(self, texts: pa.Array) -> list[bytes]:
        """``bytes_of_all`` for an Arrow column; where its texts are cut at spaces alone, they are cut and
        joined without Python strings."""
        if self.cut is None:
            return self.bytes_of_all(texts.to_pylist())
        data, offsets = binary(texts)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        flat = data.tobytes().translate(_LEVEL if self.end else None)
        if any(s in flat for s in self.looks):
            return self.bytes_of_all(texts.to_pylist())
        if self.end:
            data, begin, first = _words(np.frombuffer(flat, np.uint8), offsets)
        else:
            begin, odd = _cuts(data, offsets)
            if len(odd):
                plain = np.setdiff1d(np.arange(len(texts)), odd)
                out = dict(zip(odd.tolist(), self.bytes_of_all(texts.take(pa.array(odd)).to_pylist()), strict=True))
                out |= dict(zip(plain.tolist(), self.bytes_of_column(texts.take(pa.array(plain))) if len(plain) else [], strict=True))
                return [out[i] for i in range(len(texts))]
            first = np.searchsorted(begin, offsets)
        words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        words = words.dictionary_encode()
        found = self._looked_up(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat, ends = binary(pa.array(found, pa.large_binary()).take(words.indices))
        flat, edge = memoryview(flat), ends[first].tolist()
        return [bytes(flat[a:b]) for a, b in zip(edge, edge[1:], strict=False)]

    def bytes_of(self, text: str) -> bytes:
        return self.bytes_of_all([text])[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(column: pa.Array, path: str):
    """The ids of each text of a column (null: none) as bytes, in order, a bounded run of texts at a time."""
    worker = encoder(path)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    row = 0
    while row < len(column):
        base = size[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(size, base + TOGETHER, "right")))
        yield from worker.bytes_of_column(column.slice(row, end - row))
        row = end


def kept(batches):
    """Batches of a task, after which the worker's encoders forget the pieces that were met once."""
    try:
        yield from batches
    finally:
        for worker in _ENCODERS.values():
            worker.young.clear()


def arrays(column: pa.Array, path: str):
    """``encoded``, each as an array of unsigned 32-bit integers."""
    for ids in encoded(column, path):
        yield np.frombuffer(ids, "<u4")
