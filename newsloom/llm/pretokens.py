"""The split of texts into pre-tokens, as the tokenizer libraries make it."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable

import regex

#: Code points up to here have the same classes in every Unicode version that the libraries use.
_SETTLED = re.compile("[^\x00-\u02af\u2010-\u205e\u20ac]")
#: Neither a letter, a number nor white space.
_OTHER = "§"


@functools.cache
def _library_other(char: str) -> bool:
    """Whether `char` is no letter or number for the libraries though the newer Unicode of `regex` says so."""
    from tokenizers import Regex, normalizers

    return bool(regex.match(r"[\p{L}\p{N}]", char)) and bool(normalizers.Replace(Regex(r"[\p{L}\p{N}]"), "").normalize_str(char))


def _ranges(kind: str) -> str:
    """The code points of a class up to U+02AF and among the common punctuation, for a character set of `re`."""
    found = [c for c in [*range(0x2B0), *range(0x2010, 0x205F), 0x20AC] if regex.match(kind, chr(c))]
    spans: list[list[int]] = []
    for c in found:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans)


def _plain(pattern: str) -> re.Pattern:
    """`pattern` for `re`, right for settled texts only: \\p{L}, \\p{N}, \\s and \\S are written as ranges."""
    sets, out, inside, k = {r"\p{L}": _ranges(r"\p{L}"), r"\p{N}": _ranges(r"\p{N}"), r"\s": _ranges(r"\s")}, [], False, 0
    while k < len(pattern):
        name = next((n for n in sets if pattern.startswith(n, k)), None)
        if name:
            out.append(sets[name] if inside else f"[{sets[name]}]")
            k += len(name)
        elif pattern.startswith(r"\S", k) and not inside:
            out.append(f"[^{sets[chr(92) + 's']}]")
            k += 2
        else:
            inside = pattern[k] == "[" or inside and pattern[k] != "]"
            out.append(pattern[k])
            k += 1
    return re.compile("".join(out))


@functools.cache
def splitter(pattern_text: str) -> Callable[[str], list[str]]:
    """A function that gives all matches of the pattern in a text, with the libraries' classes of letters and numbers."""
    plain, pattern = _plain(pattern_text), regex.compile(pattern_text)

    def split(text: str) -> list[str]:
        if settled(text):
            return plain.findall(text)
        odd = [c for c in set(text) if ord(c) > 0x2AF and _library_other(c)]
        if odd:
            shadow = text.translate(dict.fromkeys(map(ord, odd), _OTHER))
            return [text[m.start() : m.end()] for m in pattern.finditer(shadow)]
        return pattern.findall(text)

    return split


def settled(text: str) -> bool:
    """Whether all of `text` is Latin, common punctuation or control characters."""
    return _SETTLED.search(text) is None


@functools.cache
def load_tokenizer(path: str):
    """A `tokenizers` tokenizer from a file, one for each worker process, without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class PieceCache(dict):
    """What is known of pre-tokens, at most `most` of them besides those of the slice at hand."""

    def __init__(self, make: Callable[[list[str]], list], most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def learn(self, words: set[str]) -> None:
        """Make all of `words` known."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(words)
        self.update(zip(new, self.make(new), strict=True))
