"""Encoding whole texts chunk by chunk with a bounded memo.

The split pattern of the byte-level vocabularies never lets a piece hold a
space behind another character of the piece, unless the piece is white space
altogether. A space between two characters that are not white space therefore
always starts a piece, and a newline between two such characters always is a
piece of its own. Texts can so be cut there into chunks that are encoded
independently, and equal chunks need encoding only once. Strings of special
tokens are cut out before; what lies between two is a text of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: re counts more characters as white space than the pattern does, so cuts made by it are always allowed.
_SINGLE = re.compile(r"(?<=\S)(?= \S)")
#: Chunks longer than this many characters are encoded anew each time.
_LONGEST = 48


class _Memo(dict):
    """Numbers of chunks, in the order they were met; ids of those known so far by number, None for chunks that need a look at their white space."""

    def __init__(self):
        self.fresh: list[str] = []
        self.ids: list[bytes | None] = []

    def __missing__(self, chunk: str) -> int:
        self.fresh.append(chunk)
        self[chunk] = len(self)
        return len(self) - 1


class ChunkEncoder:
    """encode_many: the ids of each of some chunks, as little-endian unsigned 32-bit integers.

    encode_words(lead, words): the same for words without white space at their ends, each behind `lead`.
    special: the ids of strings that stand for one token wherever they occur.
    The memo holds at most about `limit` chunks and starts afresh beyond; results never depend on it.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = 600_000, special: dict[str, bytes] | None = None, encode_words: Callable[[str, list[str]], list[bytes]] | None = None):
        self.encode_many, self.limit, self.special = encode_many, limit, special or {}
        self.encode_words = encode_words or (lambda lead, words: encode_many([lead + x for x in words]))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.newline = encode_many(["\n"])[0]
        self._clear()

    def _clear(self) -> None:
        self.inner = _Memo()  # of chunks behind a space, named without it
        self.first = _Memo()  # of chunks at the start of a line
        self.whole: dict[str, bytes] = {}  # of chunks of texts with other white space

    def _learn(self, memo: _Memo, lead: str) -> None:
        new, memo.fresh = memo.fresh, []
        good = [x for x in new if x and not x[0].isspace() and not x[-1].isspace() and len(x) <= _LONGEST]
        memo.ids += [None] * len(new)
        for x, ids in zip(good, self.encode_words(lead, good), strict=True):
            memo.ids[memo[x]] = ids

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not any(s in t for s in self.special for t in texts):
            return self._plain(texts)
        parts = [self.cut.split(t) for t in texts]
        between = iter(self._plain([x for p in parts for x in p[::2]]))
        return [b"".join([self.special[x] if k % 2 else next(between) for k, x in enumerate(p)]) for p in parts]

    def _plain(self, texts: list[str]) -> list[bytes]:
        if len(self.inner) + len(self.first) + len(self.whole) > self.limit:
            self._clear()
        first, inner = self.first.__getitem__, self.inner.__getitem__
        numbers = []
        for text in texts:
            lines = [line.split(" ") for line in text.split("\n")]
            numbers.append([(first(line[0]), list(map(inner, line[1:]))) for line in lines])
        self._learn(self.first, "")
        self._learn(self.inner, " ")
        first, inner, out = self.first.ids, self.inner.ids.__getitem__, []
        for text, lines in zip(texts, numbers, strict=True):
            try:
                out.append(self.newline.join([first[k] + b"".join(map(inner, rest)) for k, rest in lines]))
            except TypeError:
                out.append(self._general(text))
        return out

    def _general(self, text: str) -> bytes:
        """For texts with runs of white space, white space at an end, or a very long chunk."""
        chunks = _SINGLE.split(text) if text else []
        new = list({x for x in chunks if x not in self.whole})
        own = dict(zip(new, self.encode_many(new), strict=True))
        self.whole.update((k, v) for k, v in own.items() if len(k) <= _LONGEST)
        return b"".join([own[x] if x in own else self.whole[x] for x in chunks])
