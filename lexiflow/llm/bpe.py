"""Byte-level BPE ids of whole texts, each distinct chunk encoded once.

The pattern that splits text before the merges never joins a character with a
following space, so a text may be cut before any space that follows a
non-space character without a change in the ids.  Chunks repeat a lot; their
ids are kept in a bounded dictionary until the Python worker turns to another step.
The distinct new chunks of many texts are encoded in one call: only the first
token of a chunk begins with a space, so the ids fall apart into chunks again.
Texts with white space before a space, and texts that hold a special token's
string (which the library turns into that token), are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

from .workers import held

#: Chunks kept by a Python worker, in two generations: about 25 MB.
KEPT = 120_000
#: Texts of about so many characters are encoded together; a longer text is a run of its own.
RUN_CHARS = 1 << 20
_ODD_SPACE = re.compile(r"\s ")
#: Texts of these characters only: there the two libraries' character classes cannot differ.
_LATIN = re.compile(r"[\x20-\x7e\n\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*").fullmatch
#: Such words without white space; most of them are printable ASCII, which is quicker to tell.
_LATIN_WORD = re.compile(r"[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+").fullmatch


def _chunk_encoders(tokenizer):
    """The same vocabulary in the library that is quick for short texts: a
    byte-level BPE gives its merges as ids in their order, and writes each byte
    as a printable character.  Back come the encoder of a chunk, the encoder of
    words each after one space (there no white space meets another, so the
    pattern needs no look at what follows), and for each id whether its token
    begins with a space."""
    import public_tokenizers
    import tiktoken

    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shift = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shift)}
    ranks = {bytes(byte[c] for c in t): i for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if all(c in byte for c in t)}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {t: i for t, i in ranks.items() if t.decode("utf-8", "replace") not in special}
    leads = np.zeros(max(ranks.values()) + 1, bool)
    leads[[i for t, i in ranks.items() if t.startswith(b" ")]] = True
    with_look, without = public_tokenizers.PATTERN, public_tokenizers.PATTERN.replace(r"|\s+(?!\S)", "")
    chunk, words = (tiktoken.Encoding("chunks", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (with_look, without))
    return chunk.encode_ordinary, words.encode_to_numpy, leads


class ByteBpe:
    def __new__(cls, path: str):
        return held((cls, path), lambda: super(ByteBpe, cls).__new__(cls)._load(path))

    def _load(self, path: str) -> "ByteBpe":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunk, self.words, self.leads = _chunk_encoders(self.tokenizer)
        self.kept: dict[str, bytes] = {}       # a word: the ids of it and the space before it
        self.older: dict[str, bytes] = {}
        return self

    def _alone(self, chunk: str) -> bytes:
        ids = self.chunk(chunk) if _LATIN(chunk) else self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _learn(self, wanted: set[str]) -> None:
        new = wanted.difference(self.kept)
        if len(self.kept) + len(new) > KEPT // 2:
            self.older, self.kept = self.kept, {}
            new = wanted
        kept, older = self.kept, self.older
        again = [w for w in new if w in older]
        kept.update(zip(again, map(older.__getitem__, again), strict=True))
        new = new.difference(again)
        joined = [w for w in new if w.isascii() and w.isprintable() and w or _LATIN_WORD(w)]
        if joined:
            ids = self.words(" " + " ".join(joined))
            at = 4 * np.flatnonzero(self.leads[ids])
            raw = ids.astype("<u4").tobytes()
            parts = map(slice, at.tolist(), [*at[1:].tolist(), len(raw)])
            kept.update(zip(joined, map(raw.__getitem__, parts), strict=True))
        for w in new.difference(joined):
            kept[w] = self._alone(" " + w)

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text (null: none)."""
        run, size = [], 0
        for t in texts:
            run.append(t)
            size += len(t) if isinstance(t, str) else 0
            if size >= RUN_CHARS:
                yield from self._encode_run(run)
                run, size = [], 0
        yield from self._encode_run(run)

    def _encode_run(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        cut: list[list[str] | None] = []
        for t in texts:
            if not isinstance(t, str) or not t:
                cut.append([])
            elif _ODD_SPACE.search(t) or any(s in t for s in self.special):
                cut.append(None)
            else:
                cut.append(t.split(" "))
        heads = [w.pop(0) if w else "" for w in cut]
        self._learn(set().union(*[w for w in cut if w]))
        kept = self.kept
        for t, head, words in zip(texts, heads, cut, strict=True):
            if words is None:
                yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4")
            else:
                first = self._alone(head) if head else b""
                yield np.frombuffer(first + b"".join([kept[w] for w in words]), "<u4")
