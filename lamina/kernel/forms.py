"""Kernel runs shared by texts of one form.

The form of some texts is what their trees and edits depend on: everything but the wording of their names,
numbers and strings, of which only the kind and what equals what matters. A kernel runs once for a form, on
trees whose words are marks; its outcome holds for all texts of the form, with their words in the marks' places.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from hashlib import sha256
from operator import itemgetter

from lamina.kernel.graph import File, Tree
from lamina.kernel.parse import _KIND, _LITERAL_WORDS, _MODIFIERS, INDENTED, ParseError, _pattern, parse

#: Characters up to which texts are looked up by form; longer ones are each a form of their own.
SHARED_CHARS = 4096
#: Outcomes kept; beyond it all are made anew.
KEPT = 512

_OPEN, _CLOSE = "\ue000", "\ue001"
_MARK = re.compile(f"{_OPEN}(\\d+){_CLOSE}")
#: Characters that start a comment, a string or a negative number, as a set of a pattern and as they are.
_STARTS, _SPECIAL = r"\"'`#/\-", "\"'`#/-"
_CUTS: dict[str, Callable[[str], list[tuple[str, str]]]] = {}
_kept: dict[tuple, object] = {}


def _cut(language: str) -> Callable[[str], list[tuple[str, str]]]:
    """Cuts a text into pairs: what stands before a comment, string, number or word, and that itself.

    Only some characters start one, so a pair's first half is a run of the others. Where none starts
    after all, the character is a second half by itself.
    """
    if language not in _CUTS:
        lexer = _pattern(language).pattern
        words = re.sub(r"\(\?P<[csnw]>", "(?:", lexer[: lexer.index("|(?P<b>")])
        _CUTS[language] = re.compile(f"([^\\w{_STARTS}]*)({words}|[{_STARTS}]?)", re.S).findall
    return _CUTS[language]


def form(language: str, texts: tuple[str, ...]) -> tuple[tuple, list[str]] | None:
    """A key of the texts' form, and the words that fill it; None where forms aren't used.

    Indentation is counted in characters of the words before it, and markup has a lexer of its own.
    """
    if language == "html" or language in INDENTED or sum(map(len, texts)) > SHARED_CHARS:
        return None
    cut, words, key = _cut(language), [], []
    code: dict[str, object] = {"": ""}
    for text in texts:
        for fixed, word in cut(text):
            if (said := code.get(word)) is None:
                first = word[0]
                if first in "\"'`" and len(word) > 1 or first.isdecimal() or (first == "-" and len(word) > 1 and language == "json"):
                    said = 2 * len(words)
                    words.append(word)
                elif first in _SPECIAL or word in _MODIFIERS or word in _LITERAL_WORDS or word.lower() in _KIND:
                    said = word
                else:
                    said = 2 * len(words) + 1
                    words.append(word)
                code[word] = said
            key += fixed, said
        key.append(None)
    return tuple(key), words


def once(name: str, language: str, texts: tuple[str, ...], make: Callable[[tuple[File | None, ...]], object]) -> tuple[object, list[str]] | None:
    """What ``make`` gives for the marked trees of the texts' form, and the words for the marks.

    None where the texts have to be worked on by themselves.
    """
    found = form(language, texts)
    if found is None:
        return None
    key, words = found
    key = (name, language, key)
    if key not in _kept:
        if len(_kept) >= KEPT:
            _kept.clear()
        _kept[key] = None if any(_OPEN in t for t in texts) else make(tuple(_marked(language, t, words) for t in texts))
    return None if (made := _kept[key]) is None else (made, words)


def _marked(language: str, text: str, words: list[str]) -> File | None:
    try:
        file = parse(language, text)
    except ParseError:
        return None
    if file.text() != text:
        return None
    marks = {word: f"{_OPEN}{i}{_CLOSE}" for i, word in enumerate(words)}
    for node in file.root.walk():
        node.payload = marks.get(node.payload, node.payload)
    file.root.seal()
    return file


def parses(language: str, text: str) -> bool:
    found = once("parses", language, (text,), lambda files: (files[0] is not None,))
    if found is not None:
        return found[0][0]
    try:
        return parse(language, text).text() == text
    except ParseError:
        return False


def said(text: str) -> Callable[[list[str]], str]:
    """A function that puts words in the place of a text's marks."""
    pieces = _MARK.split(text)
    if len(pieces) == 1:
        return lambda words: text
    plan, get = "%s".join(p.replace("%", "%%") for p in pieces[::2]), itemgetter(*map(int, pieces[1::2]))
    return lambda words: plan % get(words)


@lru_cache(maxsize=65536)
def _leaf(kind: bytes, word: str) -> bytes:
    return sha256(kind + word.encode() + b"\0").digest()


@lru_cache(maxsize=65536)
def _inner(parts: tuple[bytes, ...]) -> bytes:
    return sha256(b"".join(parts)).digest()


def digests(nodes: list[Tree]) -> Callable[[list[str]], list[bytes]]:
    """A function that gives the ids of marked nodes, as bytes, for the words in the marks' places.

    Subtrees without a mark are hashed once; equal ones once for each set of words.
    """
    slots: list[bytes] = []
    place: dict[str, int] = {}
    leaves: list[tuple[int, bytes, int]] = []
    inner: list[tuple[int, Callable]] = []
    open_: set[str] = set()

    def slot(value: bytes = b"") -> int:
        slots.append(value)
        return len(slots) - 1

    for top in nodes:
        for node in reversed(list(top.walk())):
            if node.id in place:
                continue
            mark = _MARK.fullmatch(node.payload)
            if mark:
                leaves.append((slot(), node.kind.encode() + b"\0", int(mark[1])))
            elif any(c.id in open_ for c in node.children):
                kids = [place[c.id] for c in node.children]
                body = slot(node.kind.encode() + b"\0" + node.payload.encode() + b"\0")
                inner.append((slot(), itemgetter(body, *kids)))
            else:
                place[node.id] = slot(bytes.fromhex(node.id))
                continue
            open_.add(node.id)
            place[node.id] = len(slots) - 1
    wanted = [place[n.id] for n in nodes]

    def run(words: list[str]) -> list[bytes]:
        out = slots.copy()
        for at, kind, word in leaves:
            out[at] = _leaf(kind, words[word])
        for at, parts in inner:
            out[at] = _inner(parts(out))
        return [out[w] for w in wanted]

    return run
