"""SentencePiece encoding and decoding over a trie of distinct words.

The public model is of the BPE kind: pieces come from merges, not from the best
sum of scores, so a plain Viterbi over scores would give other ids.  But BPE has
the prefix property that Viterbi needs: the ids of a prefix that ends at a token
boundary are a prefix of the ids.  Hence each prefix of a word has exactly one
last token: the piece t that ends there for which (last token before t, t) stay
two tokens when their text is encoded by itself.  Forward states, one last
token per character, depend on the prefix alone.

So the distinct words of a batch, marked with U+2581, are sorted, which is a
trie in depth-first order: a word keeps the forward states of the prefix that it
shares with the word before and computes only the rest.

No piece has the mark after another character, so texts may be cut before each
run of marks, and at characters that no piece holds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words, and pairs of tokens, that a Python worker remembers.
KEPT, KEPT_PAIRS = 600_000, 800_000
#: Texts of about so many characters are encoded together; a longer text is encoded whole.
RUN_CHARS = 1 << 20
_WORKERS: dict[str, "Pieces"] = {}


class Pieces:
    """A BPE piece model with byte fallback, read from a SentencePiece file."""

    def __new__(cls, path: str):
        if path not in _WORKERS:
            self = super().__new__(cls)
            self._load(path)
            _WORKERS[path] = self
        return _WORKERS[path]

    def _load(self, path: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        self.ids, self.score, self.byte, self.text = {}, {}, {}, []
        for i in range(size):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte[int(p[1:-1], 16)] = i
                self.text.append(bytes([int(p[1:-1], 16)]))
            elif m.is_control(i) or m.is_unknown(i):
                self.text.append(b"")
            else:
                self.ids[p], self.score[p] = i, m.get_score(i)
                self.text.append(p.encode())
        self.unknown = m.unk_id()
        known = sorted({c for p in self.ids for c in p} - {MARK})
        inner = "".join(re.escape(c) for c in known)
        self.unit = re.compile(f"{MARK}*[{inner}]+|{MARK}+|[^{MARK}{inner}]")
        # lengths of the pieces of more than one character by the last two, and of more than two by the last three
        two, three = {}, {}
        for p in self.ids:
            if len(p) > 1:
                two.setdefault(p[-2:], set()).add(len(p))
            if len(p) > 2:
                three.setdefault(p[-3:], set()).add(len(p))
        self.short = {c: (2, 1) for c, n in two.items() if 2 in n}
        self.long = {c: (*sorted(n, reverse=True), *self.short.get(c[1:], (1,))) for c, n in three.items()}   # longest first
        self.pairs: dict[str, bool] = {}
        self.words: dict[str, bytes] = {}
        self.bytes_of: dict[str, bytes] = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.table = np.array(self.text, object)

    def merged(self, text: str) -> list[str]:
        """Tokens of a short text by the merges themselves: the best-scored
        neighbours first, the leftmost among equals."""
        t = list(text)
        while True:
            best, at = None, -1
            for i in range(len(t) - 1):
                s = self.score.get(t[i] + t[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return t
            t[at:at + 2] = [t[at] + t[at + 1]]

    def stays(self, before: str, token: str) -> bool:
        key = before + "\0" + token
        r = self.pairs.get(key)
        if r is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            r = self.pairs[key] = self.merged(before + token) == ([before, token] if before else [token])
        return r

    def learn(self, wanted: set[str]) -> None:
        """Encode new distinct words, sorted, sharing the forward states of common prefixes."""
        new = [w for w in wanted if w not in self.words]
        if len(self.words) + len(new) > KEPT:
            self.words.clear()
            new = list(wanted)
        short, long, ids, pairs, bytes_of = self.short, self.long, self.ids, self.pairs, self.bytes_of
        last: list[str] = []          # the last token of each prefix of the word before
        previous = ""
        for w in sorted(new):
            if w.startswith(previous):
                n = len(previous)
            else:
                n = 0
                for x, y in zip(previous, w, strict=False):
                    if x != y:
                        break
                    n += 1
                del last[n:]
            for i in range(n, len(w)):
                # a piece of more than two characters that ends here, if any, tells which shorter ones do
                for k in long.get(w[i - 2:i + 1]) or short.get(w[i - 1:i + 1], (1,)) if i > 1 else short.get(w[:2], (1,)) if i else (1,):
                    j = i + 1 - k
                    if j < 0:
                        continue
                    token = w[j:i + 1]
                    if k == 1 or token in ids:
                        before = last[j - 1] if j else ""
                        stays = pairs.get(before + "\0" + token)
                        if stays is None:
                            stays = self.stays(before, token)
                        if stays:
                            last.append(token)
                            break
                else:
                    raise AssertionError(f"no last token for {w[:i + 1]!r}")
            previous = w
            tokens, i = [], len(w)
            while i:
                token = last[i - 1]
                tokens.append(bytes_of[token] if token in bytes_of else self._token_bytes(token))
                i -= len(token)
            tokens.reverse()
            self.words[w] = b"".join(tokens)

    def _token_bytes(self, token: str) -> bytes:
        return np.array(self._token_ids(token), "<u4").tobytes()

    def _token_ids(self, token: str) -> list[int]:
        i = self.ids.get(token)
        if i is not None:
            return [i]
        return [self.byte[b] for b in token.encode()] if self.byte else [self.unknown]

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; null and empty texts have none."""
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size >= RUN_CHARS:
                yield from self._encode_run(held)
                held, size = [], 0
        yield from self._encode_run(held)

    def _encode_run(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        units = [self.unit.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(set().union(*units))
        words = self.words
        for u in units:
            yield np.frombuffer(b"".join([words[x] for x in u]), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; the mark put before the first word goes."""
        t = b"".join(self.table[ids].tolist()).decode("utf-8", "replace").replace(MARK, " ")
        return t[1:] if t[:1] == " " else t


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), a row per row of ``docs``: repeated rows and
    ids are kept, null and empty texts have no ids, other columns are left out,
    an empty table gives an empty result.  A text with U+2581 of its own is
    encoded as if it were a space, as the library does."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [x.astype(np.int32) for x in Pieces(model).encode(b["text"])]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text, a row per row; null and empty ids give the empty text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = Pieces(model)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [
                "" if x is None else p.decode(np.asarray(x, np.int64)) for x in b["ids"]]})

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(
        run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit
    numbers), text_crc32 (of the decoded text in UTF-8) and lossless: encoding
    and decoding in one pass, so that the ids never leave the task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p, rows = Pieces(model), []
            for t, ids in zip(b["text"], p.encode(b["text"]), strict=True):
                back = p.decode(ids)
                rows.append((len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(back.encode()), back == (t or "")))
            out = pd.DataFrame(rows, columns=["n_ids", "ids_crc32", "text_crc32", "lossless"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, n_ids long, ids_crc32 long, text_crc32 long, lossless boolean")
