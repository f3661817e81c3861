"""Counting straight from texts: one pass of (doc_id, text) through Arrow batches.

Where documents are tagged by the default taggers, whatever is only counted needs
no arrays of tokens: a piece of a batch is cut into words by the classes of its
bytes, each distinct word of a task is lower-cased and tagged once, and counts go
by word numbers.  A task adds up what it counts and hands on a row per key.
Words, tags and units are those of ``operators.tagging``; the classes and lower case of
characters beyond ASCII are asked of the JVM once (``alphabet``).

N-grams above a relative frequency are found in two readings (``frequent_grams``).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicon import DS_LEXICON, POS_LEXICON
from ..functions.tags import PUNCT_TAG, UNCLASSIFIED_TAG, UNTAGGED
from .arrow_counting import combined, grouped
from .arrow_tagging import WS, Phrases, _lists, leftmost, word_tagger

#: Bytes of text in a piece (a longer text is a piece of its own), and rows handed on at a time.
BYTES, ROWS = 1 << 22, 1 << 16
#: Bytes of text whose arrays of words are handed on at a time.
ROW_BYTES = 1 << 19
#: Words and keys that a task numbers before it hands on its counts and begins anew.
VOCABULARY = 3 << 17
#: Words whose n-grams are counted together when frequent ones are looked for.
CHUNK = 1 << 22
#: The least relative frequency (per million) for which n-grams are counted in two readings.
LEAST_RF = 1.0

SPACE, LETTER, NUMBER, SIGN, INNER = range(5)      # INNER: further bytes of a sign
_ALPHABET: list[tuple[bytes, dict[int, str]]] = []


def alphabet(spark: SparkSession) -> tuple[bytes, dict[int, str]]:
    """What the JVM takes for letters and numbers (a class per code point, packed), and the lower case of capitals
    beyond ASCII; asked once, by a job over all characters."""
    if not _ALPHABET:
        points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, points))
        capitals = [c for c in text if c.lower() != c]
        blocks = [(text[i:i + 16384], "") for i in range(0, len(text), 16384)] + [("", "\n".join(capitals))]
        kinds = [F.regexp_replace("s", rf"[^\p{{{k}}}]+", "").alias(k) for k in "LN"]
        found = spark.createDataFrame(blocks, "s string, c string").select(*kinds, F.lower("c").alias("c")).collect()
        of = np.full(0x110000, SIGN, np.uint8)
        of[[ord(c) for c in WS]] = SPACE
        for c in range(0x80):
            if chr(c).isalpha() or chr(c).isdigit():
                of[c] = LETTER if chr(c).isalpha() else NUMBER
        for r in found:
            of[np.array([ord(c) for c in r.L], np.int64)] = LETTER
            of[np.array([ord(c) for c in r.N], np.int64)] = NUMBER
        lower = "".join(r.c for r in found).split("\n")
        _ALPHABET.append((zlib.compress(of.tobytes()), {ord(c): x for c, x in zip(capitals, lower, strict=True)}))
    return _ALPHABET[0]


@lru_cache(1)
def _classes(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


@dataclass(frozen=True)
class Texts:
    """The units of whole documents, not yet made: (doc_id, text), one row per document."""
    docs: DataFrame
    kind: str
    pos_lexicon: dict | None = None
    ds_lexicon: dict | None = None

    @property
    def columns(self) -> list[str]:
        return self.docs.columns

    def reader(self, *kinds: str) -> Callable[[], "Reader"]:
        packed, lower = alphabet(self.docs.sparkSession)
        of = (kinds or (self.kind,), POS_LEXICON if self.pos_lexicon is None else self.pos_lexicon,
              DS_LEXICON if self.ds_lexicon is None else self.ds_lexicon)
        return lambda: Reader(packed, lower, *of)

    def mapped(self, task: Callable[[Iterator[tuple[pa.Array, pa.Array]]], Iterator[dict]], schema: str | T.StructType,
               size: int | None = None) -> DataFrame:
        """Rows of ``task``, a function of pieces (ids, texts) that yields columns."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for columns in task(pieces(batches, size)):
                b = pa.RecordBatch.from_pydict(columns)
                for at in range(0, b.num_rows, ROWS):
                    yield b.slice(at, ROWS)
        return self.docs.select("doc_id", "text").mapInArrow(run, schema)

    def schema(self, before: str, after: str) -> T.StructType:
        """Columns around that of the documents' ids."""
        first, rest = (T._parse_datatype_string(x).fields if x else [] for x in (before, after))
        return T.StructType([*first, self.docs.schema["doc_id"], *rest])


def pieces(batches: Iterable[pa.RecordBatch], size: int | None = None) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of whole rows with about ``size`` bytes of text."""
    size = size or BYTES
    for b in batches:
        ids, texts = b.columns
        edges = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(edges, edges[at] + size, "right")) - 1)
            yield ids.slice(at, end - at), texts.slice(at, end - at)
            at = end


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of valid texts and where each text begins and the last ends; what is not UTF-8 is replaced."""
    def flat(x):
        at = np.frombuffer(x.buffers()[1], np.int64 if pa.types.is_large_string(x.type) else np.int32)[x.offset:x.offset + len(x) + 1].astype(np.int64)
        data = x.buffers()[2]
        return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0]:at[-1]], at - at[0]

    if texts.null_count:
        texts = texts.fill_null("")
    data, edges = flat(texts)
    if len(data) and data.max() >= 0x80:
        try:
            if (data[edges[:-1][edges[:-1] < len(data)]] & 0xC0 == 0x80).any():
                raise UnicodeError
            data.tobytes().decode()
        except UnicodeError:
            data, edges = flat(pa.array([x.decode(errors="replace") for x in texts.cast(pa.binary()).to_pylist()], pa.string()))
    return data, edges


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of a piece: a number each (``Reader``), and where each row begins and the last ends."""
    number: np.ndarray
    edges: np.ndarray
    start: np.ndarray       # first byte
    size: np.ndarray        # bytes
    odd: np.ndarray         # bytes of white space other than blanks
    data: np.ndarray        # all bytes

    def tokens(self) -> pa.Array:
        """The words with the white space behind them; a row's last word has none."""
        size = self.size.astype(np.int64)
        inner = ~self.last(np.arange(len(size)))
        size[inner] = np.diff(self.start)[inner[:-1]] if len(size) else 0
        ends, kept = self.start + size, np.zeros(len(self.data) + 1, np.int8)
        some = self.edges[:-1] < self.edges[1:]
        kept[self.start[self.edges[:-1][some]]] += 1
        kept[ends[self.edges[1:][some] - 1]] -= 1
        values = self.data[np.cumsum(kept[:-1], dtype=np.int8).astype(bool)]
        return pa.StringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(values))

    def last(self, at: np.ndarray) -> np.ndarray:
        """Whether a word is its row's last (it has no white space then)."""
        ends = np.zeros(len(self.number) + 1, bool)
        ends[self.edges[1:]] = True
        return ends[at + 1]

    def spaced(self, at: np.ndarray) -> np.ndarray:
        """Whether white space follows a word that is not its row's last."""
        return self.start[at] + self.size[at] < self.start[at + 1]

    def blank(self, at: np.ndarray) -> np.ndarray:
        """Whether nothing but blanks stands between a word and the next of its row."""
        after = np.append(self.start, np.iinfo(np.int64).max)
        return self.last(at) | (np.searchsorted(self.odd, self.start[at]) == np.searchsorted(self.odd, after[at + 1]))


class Reader:
    """Texts to the numbers of units; numbers hold until ``renew``."""

    def __init__(self, packed: bytes, lower: dict[int, str], kinds: Sequence[str], pos_lexicon: dict[str, str], ds_lexicon: dict[str, str]) -> None:
        from .tagging import SUFFIX_RULES

        self.classes, self.lower, self.kinds, self.kind = _classes(packed), lower, kinds, kinds[0]
        self.of_byte = self.classes[:128].copy()
        self.tagger = word_tagger(pos_lexicon, SUFFIX_RULES, PUNCT_TAG, UNCLASSIFIED_TAG)
        self.phrases = Phrases(ds_lexicon, UNTAGGED)
        self.ds_lexicon = ds_lexicon
        self.renew()

    def renew(self) -> None:
        self.words: dict[str, int] = {}                     # by surface, in lower case where it is ASCII
        self.pairs: list[tuple[str, str]] = []              # (Token, Tag) by number
        self.pair_at: dict[tuple[str, str], int] = {}
        self.lows, self.tags = [], []                       # by word; kept for ``rows``
        self.pos, self.ds, self.phrase_word = (np.zeros(0, np.int64) for _ in range(3))     # by word

    def full(self) -> bool:
        return max(len(self.words), len(self.pairs)) > VOCABULARY

    def keys(self, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Token and Tag of numbers of units."""
        pairs = [self.pairs[i] for i in at.tolist()]
        return tuple(pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1))

    def pair(self, token: str, tag: str) -> int:
        return int(self._paired([token], [tag])[0])

    def _paired(self, tokens: list[str], tags: list[str]) -> np.ndarray:
        """The numbers of pairs."""
        both = list(zip(tokens, tags))
        self.pair_at |= zip([p for p in dict.fromkeys(both) if p not in self.pair_at], count(len(self.pairs)))
        self.pairs += islice(self.pair_at, len(self.pairs), None)
        return np.array(list(map(self.pair_at.get, both)), np.int64)

    def split(self, texts: pa.Array) -> Words:
        data, edges = _bytes(texts)
        kind = np.full(len(data), INNER, np.uint8)
        if not len(data) or data.max() < 0x80:
            kind = self.of_byte[data]
        else:
            low = data < 0x80
            kind[low] = self.of_byte[data[low]]
            lead = np.flatnonzero(data >= 0xC0)
            first = data[lead].astype(np.int64)
            size = 2 + (first >= 0xE0) + (first >= 0xF0)
            point = first & (0x7F >> size)
            for k in range(1, 4):
                more = size > k
                point[more] = point[more] << 6 | data[lead[more] + k] & 0x3F
            of = self.classes[point]
            kind[lead] = of
            inner = of != SIGN
            for k in range(1, 4):
                more = inner & (size > k)
                kind[lead[more] + k] = of[more]
            self._join(kind, edges, lead[point == 0x2019], 3)
        self._join(kind, edges, np.flatnonzero(data == 0x27), 1)

        kept = kind != SPACE
        begins = (kind == LETTER) | (kind == NUMBER)
        begins[1:] &= kind[1:] != kind[:-1]
        begins |= kind == SIGN
        firsts = edges[:-1][edges[:-1] < edges[1:]]
        begins[firsts] = kept[firsts]
        start = np.flatnonzero(begins)
        values = _LOWER[data[kept]]
        offsets = np.append(np.flatnonzero(begins[kept]), len(values)).astype(np.int32)
        tokens = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(values))
        odd = np.flatnonzero(~kept & (data != 0x20))
        return Words(self._numbers(tokens), np.searchsorted(start, edges), start, np.diff(offsets), odd, data)

    @staticmethod
    def _join(kind: np.ndarray, edges: np.ndarray, at: np.ndarray, size: int) -> None:
        """Apostrophes between letters of a text belong to the word."""
        at = at[(at > 0) & (at + size < len(kind))]
        at = at[(kind[at - 1] == LETTER) & (kind[at + size] == LETTER)]
        at = at[np.searchsorted(edges, at - 1, "right") == np.searchsorted(edges, at + size, "right")]
        for k in range(size):
            kind[at + k] = LETTER

    def _numbers(self, tokens: pa.Array) -> np.ndarray:
        coded = tokens.dictionary_encode()
        texts = coded.dictionary.to_pylist()
        number = list(map(self.words.get, texts))
        if None in number:
            self._learn([t for t, i in zip(texts, number) if i is None])
            number = list(map(self.words.get, texts))
        return np.array(number, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

    def _learn(self, new: list[str]) -> None:
        signs, numerals, lows = set(), set(), []
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        beyond = {c for t in new if not t.isascii() for c in t if c > "\x7f"}
        capitals = {chr(c) for c in self.lower} & beyond
        for c in beyond:
            if self.classes[ord(c)] != LETTER:
                (numerals if self.classes[ord(c)] == NUMBER else signs).add(c)
        for t in new:
            if capitals and not t.isascii() and not capitals.isdisjoint(t):
                t = t.lower() if "Σ" in t else t.translate(self.lower)      # (its lower case depends on what stands around)
            lows.append(t)
        if "pos" in self.kinds:
            one = lambda x: pa.array([list(x)], pa.list_(pa.string()))
            tags = self.tagger(one(new), one(lows), one(signs), one(numerals)).flatten().to_pylist()
            if "rows" in self.kinds:
                self.lows += lows
                self.tags += tags
            self.pos = np.append(self.pos, np.where(np.array(tags) == PUNCT_TAG, -1, self._paired(lows, tags)))
        if "ds" in self.kinds:
            self.ds = np.append(self.ds, self._paired(lows, [UNTAGGED] * len(lows)))
            self.phrase_word = np.append(self.phrase_word, self.phrases.numbers(pa.array(lows, pa.string())))

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the units of texts, which are punctuation (``pos``: their number is -1), and where each row begins."""
        return self.of(self.split(texts), self.kind)

    def counted(self, words: Words, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the units that count, their rows, and where each row's words begin and the last end."""
        code, sign, edges = self.of(words, kind)
        row = _rows_of(edges)
        return (code[~sign], row[~sign], words.edges) if kind == "pos" else (code, row, words.edges)

    def of(self, words: Words, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if kind == "pos":
            code = self.pos[words.number] if len(words.number) else np.zeros(0, np.int64)
            return code, code < 0, words.edges
        if not len(words.number):
            return np.zeros(0, np.int64), np.zeros(0, bool), words.edges
        numbers = self.phrase_word[words.number]
        at, size, phrase = self.phrases.longest(numbers, words.edges, np.diff(words.edges))
        taken = leftmost(at, size)
        at, size, phrase = at[taken], size[taken], phrase[taken]
        code, sign = self.ds[words.number], self.phrases.is_punct[numbers]
        texts_of = self.phrases.phrases
        if len(at):
            code[at] = self._paired(texts_of, [self.ds_lexicon[p] for p in texts_of])[phrase]
        starts = np.ones(len(code), bool)
        odd = np.zeros(len(at), bool)
        for k in range(1, len(self.phrases.steps)):
            longer = size > k
            starts[at[longer] + k] = False
            odd[longer] |= ~words.spaced(at[longer] + k - 1)
        for i in np.flatnonzero(odd).tolist():       # a phrase whose words are not all apart
            parts = texts_of[phrase[i]].split(" ")
            apart = words.spaced(at[i] + np.arange(len(parts) - 1)).tolist() + [False]
            code[at[i]] = self.pair("".join(w + " " * s for w, s in zip(parts, apart)), self.ds_lexicon[texts_of[phrase[i]]])
        sign[at] = False
        some = np.flatnonzero(sign)
        sign[some] = words.blank(some)
        unit = np.flatnonzero(starts)
        return code[unit], sign[unit], np.searchsorted(unit, words.edges)


def _added(total: np.ndarray, more: np.ndarray) -> np.ndarray:
    if len(more) > len(total):
        total = np.append(total, np.zeros(max(len(more), 2 * len(total)) - len(total), np.int64))
    total[:len(more)] += more
    return total


def _rows_of(edges: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(edges) - 1), np.diff(edges))


class Tags:
    """The tags of a reader's pairs, numbered."""

    def __init__(self) -> None:
        self.names, self.number, self.at = [], {}, np.zeros(0, np.int64)

    def of(self, reader: Reader, code: np.ndarray) -> np.ndarray:
        new = [self.number.setdefault(tag, len(self.number)) for _, tag in reader.pairs[len(self.at):]]
        self.names, self.at = list(self.number), np.append(self.at, np.array(new, np.int64))
        return self.at[code]

    def texts(self, at: np.ndarray) -> pa.Array:
        return pa.array(self.names, pa.string()).take(pa.array(at))


class Tally:
    """Occurrences of numbers, and rows that have them, added up."""

    def __init__(self) -> None:
        self.n, self.docs = np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def add(self, code: np.ndarray, row: np.ndarray, rows: int) -> None:
        if len(code):
            self.n = _added(self.n, np.bincount(code))
            each = np.sort(code * max(rows, 1) + row)
            each = each[np.append(True, each[1:] != each[:-1])] // max(rows, 1)
            self.docs = _added(self.docs, np.bincount(each))

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, occurrences, rows) of what was counted; counting begins anew."""
        at = np.flatnonzero(self.n)
        found = at, self.n[at], self.docs[at]
        self.__init__()
        return found


def _count_columns(keys: dict[str, pa.Array], n: np.ndarray, docs: np.ndarray) -> dict[str, pa.Array]:
    return keys | {"n": pa.array(n.astype(np.int64)), "docs": pa.array(docs.astype(np.int64))}


def _mark(names: Iterable[str], n: int, docs: int) -> dict[str, pa.Array]:
    """The row with null keys that counts documents."""
    return _count_columns({k: pa.nulls(1, pa.string()) for k in names}, np.array([n]), np.array([docs]))


def counted(texts: Texts, tags_only: bool = False) -> DataFrame:
    """Counting rows of the units (``docrows.counted_units``, ``counted_tags``)."""
    make, kind, names = texts.reader(), texts.kind, ["Tag"] if tags_only else ["Token", "Tag"]

    def task(parts):
        reader, tally, tags, some = make(), Tally(), Tags(), 0

        def rows():
            at, n, docs = tally.taken()
            return _count_columns({"Tag": tags.texts(at)} if tags_only else dict(zip(names, reader.keys(at))), n, docs)

        for _, x in parts:
            code, row, edges = reader.counted(reader.split(x), kind)
            some += int((np.diff(edges) > 0).sum())
            tally.add(tags.of(reader, code) if tags_only else code, row, len(edges) - 1)
            if reader.full():
                yield rows()
                reader.renew()
                tags = Tags()
        yield rows()
        yield _mark(names, 0, some)
    return texts.mapped(task, ", ".join([f"{k} string" for k in names] + ["n bigint", "docs bigint"]))


def near_nodes(texts: Texts, node: str, node_tag: str | None, preceding: int, following: int) -> DataFrame:
    """(Token, Tag, nodes, n, is_node), as ``docrows.near_nodes``."""
    make = texts.reader()

    def task(parts):
        reader = make()
        n, near, is_node, seen = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(0, bool), 0

        def rows():
            at = np.flatnonzero(n)
            token, tag = reader.keys(at)
            return {"Token": token, "Tag": tag, "nodes": pa.array(near[at]), "n": pa.array(n[at]), "is_node": pa.array(is_node[at].astype(np.int64))}

        for _, x in parts:
            code, sign, edges = reader.units(x)
            new = reader.pairs[seen:]
            is_node = np.append(is_node, np.array([w == node and (not node_tag or tag.startswith(node_tag)) for w, tag in new], bool))
            seen += len(new)
            kept = np.flatnonzero(~sign)
            code, edges = code[kept], np.searchsorted(kept, edges)
            nodes = is_node[code]
            if len(code):
                n = _added(n, np.bincount(code))
                near = _added(near, _near(code, nodes, edges, preceding, following))
            if reader.full():
                yield rows()
                reader.renew()
                n, near, is_node, seen = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(0, bool), 0
        yield rows()
    return texts.mapped(task, "Token string, Tag string, nodes bigint, n bigint, is_node bigint")


def _near(code: np.ndarray, nodes: np.ndarray, edges: np.ndarray, preceding: int, following: int) -> np.ndarray:
    """By number, how many of the ``nodes`` a word's places stand 1..preceding before or 1..following behind."""
    row = _rows_of(edges)
    found = np.zeros(int(code.max()) + 1, np.int64)
    at = np.flatnonzero(nodes)
    for k in (*range(-preceding, 0), *range(1, following + 1)):
        place = at + k
        inside = (place >= edges[row[at]]) & (place < edges[row[at] + 1])
        found += np.bincount(code[place[inside]], minlength=len(found))
    return found


def _grams(code: np.ndarray, sign: np.ndarray, edges: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words that are no punctuation, their rows, and at which of them an n-gram begins."""
    broken = np.append(True, sign[:-1]) if len(sign) else sign.copy()
    broken[edges[:-1][edges[:-1] < len(sign)]] = True
    kept = np.flatnonzero(~sign)
    code, broken, edges = code[kept], broken[kept], np.searchsorted(kept, edges)
    row = _rows_of(edges)
    begins = np.flatnonzero(np.arange(len(code)) + span <= edges[1:][row])
    whole = np.ones(len(begins), bool)
    for k in range(1, span):
        whole &= ~broken[begins + k]
    return code, row, begins[whole]


def _gram_names(span: int) -> list[str]:
    return [f"{part}_{i}" for part in ("Token", "Tag") for i in range(1, span + 1)]


def _gram_keys(reader: Reader, words: list[np.ndarray]) -> dict[str, pa.Array]:
    """Token_1..n, Tag_1..n of the words' numbers."""
    distinct, at = np.unique(np.concatenate(words), return_inverse=True)
    columns = [c.take(pa.array(x)) for c in reader.keys(distinct) for x in np.split(at, len(words))]
    return dict(zip(_gram_names(len(words)), columns))


def _gram_schema(span: int) -> str:
    return ", ".join([f"{k} string" for k in _gram_names(span)] + ["n bigint", "docs bigint"])


def _units_in(code: np.ndarray, sign: np.ndarray, kind: str) -> int:
    return int(len(code) - sign.sum()) if kind == "pos" else len(code)


def counted_grams(texts: Texts, span: int) -> DataFrame:
    """Counting rows of all n-grams, as ``docrows.counted_grams``."""
    make = texts.reader()

    def task(parts):
        reader = make()
        for _, x in parts:
            code, sign, edges = reader.units(x)
            total, some = _units_in(code, sign, reader.kind), int((np.diff(edges) > 0).sum())
            word, row, begins = _grams(code, sign, edges, span)
            width = len(reader.pairs) + 1
            gram, _ = combined([(word[begins + k], width) for k in range(span)])
            first, n = grouped(combined([(gram, int(gram.max(initial=0)) + 1), (row[begins], len(edges))])[0])
            edge = np.flatnonzero(np.diff(gram[first], prepend=-1))
            n, docs = np.add.reduceat(n, edge) if len(edge) else n, np.diff(np.append(edge, len(first)))
            yield _count_columns(_gram_keys(reader, [word[begins[first[edge]] + k] for k in range(span)]), n, docs)
            yield _mark(_gram_names(span), total, some)
            if reader.full():
                reader.renew()
    return texts.mapped(task, _gram_schema(span))


def _likely(texts: Texts, span: int, share: float) -> DataFrame:
    """First reading: (keys..., n, docs) of the n-grams that come more than ``docs`` times in a chunk of words, where
    ``docs`` is half of ``share`` of its units; a row with null keys for each chunk says how many units it has."""
    make = texts.reader()

    def task(parts):
        reader, held, units = make(), [], 0

        def rows():
            least = int(units * share / 2)
            code, follows = (np.concatenate(x) if held else np.zeros(0, np.int64) for x in (list(zip(*held)) or ([], [])))
            often = np.bincount(code, minlength=1) > least if len(code) else np.zeros(1, bool)
            at = np.flatnonzero(follows)
            for k in range(span):
                at = at[often[code[at + k]]]
            for k in range(2, span):      # n-grams of which a beginning is rare are rare
                at = _often(at, code, k, least)
            words = [code[at + k] for k in range(span)]
            gram, _ = combined([(w, len(often) + 1) for w in words])
            first, n = grouped(gram)
            first, n = first[n > least], n[n > least]
            yield _count_columns(_gram_keys(reader, [w[first] for w in words]), n, np.full(len(n), least))
            yield _mark(_gram_names(span), units, least)

        for _, x in parts:
            code, sign, edges = reader.units(x)
            units += _units_in(code, sign, reader.kind)
            word, _, begins = _grams(code, sign, edges, span)
            follows = np.zeros(len(word), bool)
            follows[begins] = True
            held.append((word, follows))
            if units >= CHUNK or reader.full():
                yield from rows()
                held, units = [], 0
                if len(reader.pairs) > VOCABULARY // 2:      # (else the next chunk would end early)
                    reader.renew()
        if units:
            yield from rows()
    return texts.mapped(task, _gram_schema(span))


def _often(at: np.ndarray, code: np.ndarray, span: int, least: int) -> np.ndarray:
    """The places whose first ``span`` words come more than ``least`` times among all of them."""
    if not least or not len(at):
        return at
    gram, _ = combined([(code[at + k], int(code.max()) + 1) for k in range(span)])
    distinct, which, n = np.unique(gram, return_inverse=True, return_counts=True)
    return at[n[which] > least]


class _Trie:
    """N-grams as numbers of beginnings: the sorted (beginning, word) that go on, step by step."""

    def __init__(self, grams: list[list[tuple[str, str]]]) -> None:
        self.word = {w: i for i, w in enumerate(dict.fromkeys(w for g in grams for w in g))}
        self.width = len(self.word) + 1
        at = np.zeros(len(grams), np.int64)
        self.columns = [np.array([self.word[g[k]] for g in grams], np.int64) for k in range(len(grams[0]) if grams else 0)]
        self.steps = []
        for column in self.columns:
            keys, at = np.unique(at * self.width + column, return_inverse=True)
            self.steps.append(keys)
        self.gram = np.zeros(len(grams), np.int64)
        self.gram[at] = np.arange(len(grams))

    def find(self, word: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of ``begins`` where one of the n-grams stands, and which."""
        node = np.zeros(len(begins), np.int64)
        for k, keys in enumerate(self.steps):
            w = word[begins + k]
            begins, node, w = begins[w >= 0], node[w >= 0], w[w >= 0]
            key = node * self.width + w
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[i] == key
            begins, node = begins[hit], i[hit]
        return begins, self.gram[node]


def likely_grams(texts: Texts, span: int, min_rf: float) -> list[list[tuple[str, str]]]:
    """All n-grams with more than ``min_rf`` occurrences in a million units, and some with fewer.

    What a chunk does not give comes in it at most ``docs`` times, so the excess of the chunks that give an n-gram
    over these bounds, and the sum of all bounds, are the most that it can have.  A bound is half of the chunk's share
    of the occurrences asked for: n-grams given back have at least the other half, so there are at most
    2,000,000 / ``min_rf`` of them however large the corpus."""
    names = _gram_names(span)
    found = (_likely(texts, span, min_rf / 1_000_000.0)
             .groupBy(*names).agg(F.sum(F.when(F.col(names[0]).isNull(), F.col("n")).otherwise(F.col("n") - F.col("docs"))).alias("more"),
                                  F.sum("docs").alias("bound"), F.max(F.col(names[0]).isNotNull()).alias("is_gram")))
    total = found.select(F.struct(F.max(F.when(~F.col("is_gram"), F.col("more"))).alias("units"),
                                  F.max(F.when(~F.col("is_gram"), F.col("bound"))).alias("bound"))).scalar()
    kept = (found.filter("is_gram AND bound >= 0").withColumn("_t", total)      # (all columns are used, so the total shares the shuffle)
                 .filter((F.col("more") + F.col("_t.bound") + 1) * 1_000_000.0 > F.col("_t.units") * F.lit(float(min_rf))))
    return [list(zip(r[:span], r[span:])) for r in kept.select(*names).collect()]


def frequent_grams(texts: Texts, span: int, min_rf: float) -> DataFrame:
    """Second reading: counting rows of the n-grams that may be above ``min_rf``; those above are all there, with all their counts."""
    make, trie = texts.reader(), _Trie(likely_grams(texts, span, min_rf))

    def task(parts):
        reader, tally, units, some, of = make(), Tally(), 0, 0, np.zeros(0, np.int64)
        for _, x in parts:
            code, sign, edges = reader.units(x)
            units, some = units + _units_in(code, sign, reader.kind), some + int((np.diff(edges) > 0).sum())
            of = np.append(of, np.array([trie.word.get(w, -1) for w in reader.pairs[len(of):]], np.int64))
            word, row, begins = _grams(code, sign, edges, span)
            if trie.steps and len(word):
                at, gram = trie.find(of[word], begins)
                tally.add(gram, row[at], len(edges) - 1)
            if reader.full():
                reader.renew()
                of = of[:0]
        at, n, docs = tally.taken()
        words, grams = list(trie.word), [c[at].tolist() for c in trie.columns] or [[]] * span
        keys = {f"{part}_{k + 1}": pa.array([words[w][i] for w in grams[k]], pa.string())
                for i, part in enumerate(("Token", "Tag")) for k in range(span)}
        yield _count_columns(keys, n, docs)
        yield _mark(_gram_names(span), units, some)
    return texts.mapped(task, _gram_schema(span))


def tabulated(texts: Texts) -> DataFrame:
    """All counting rows and document-term rows of both kinds of units in one reading: (kind, part, doc_id, Token, Tag, n, docs).

    ``part``: ``unit`` (by Token and Tag), ``tag`` (by Tag), ``doc`` (by document and Tag); in ``unit`` and ``tag``,
    rows without a Tag count the documents.  A document row's tags are added up; what equal ids have is not."""
    make = texts.reader("pos", "ds")
    names = ["kind", "part", "doc_id", "Token", "Tag", "n", "docs"]
    schema = texts.schema("kind string, part string", "Token string, Tag string, n bigint, docs bigint")

    def task(parts):
        reader, tags, some, id_type = make(), Tags(), 0, pa.null()
        tallies = {(kind, part): Tally() for kind in ("pos", "ds") for part in ("unit", "tag")}

        def rows_of(kind, part, n, docs, ids=None, token=None, tag=None):
            n, docs = (pa.array(x.astype(np.int64)) for x in (n, docs))
            none = pa.nulls(len(n), pa.string())
            columns = [pa.array([kind] * len(n), pa.string()), pa.array([part] * len(n), pa.string()),
                       pa.nulls(len(n), id_type) if ids is None else ids, none if token is None else token, none if tag is None else tag, n, docs]
            return dict(zip(names, columns))

        def rows():
            for (kind, part), tally in tallies.items():
                at, n, docs = tally.taken()
                token, tag = reader.keys(at) if part == "unit" else (None, tags.texts(at))
                yield rows_of(kind, part, n, docs, token=token, tag=tag)

        for ids, x in parts:
            id_type, words = ids.type, reader.split(x)
            count = len(words.edges) - 1
            some += int((np.diff(words.edges) > 0).sum())
            for kind in ("pos", "ds"):
                code, row, _ = reader.counted(words, kind)
                tag = tags.of(reader, code)
                tallies[kind, "unit"].add(code, row, count)
                tallies[kind, "tag"].add(tag, row, count)
                width = max(len(tags.names), 1)
                n = np.bincount(row * width + tag, minlength=count * width)
                at = np.flatnonzero(n)
                yield rows_of(kind, "doc", n[at], np.ones(len(at)), ids.take(pa.array(at // width)), tag=tags.texts(at % width))
            if reader.full():
                yield from rows()
                reader.renew()
                tags = Tags()
        if id_type != pa.null():
            yield from rows()
            for kind, part in tallies:
                yield rows_of(kind, part, np.array([0]), np.array([some]))
    return texts.mapped(task, schema)


def counts_in(table: DataFrame, kind: str, tags_only: bool = False) -> DataFrame:
    """The counting rows of ``counted`` in a table of ``tabulated``."""
    keys, part = (["Tag"], "tag") if tags_only else (["Token", "Tag"], "unit")
    return table.filter((F.col("kind") == kind) & (F.col("part") == part)).select(*keys, "n", "docs")


def matrix_in(table: DataFrame, kind: str) -> DataFrame:
    """The document-term matrix in a table of ``tabulated``."""
    found = table.filter((F.col("kind") == kind) & (F.col("part") == "doc"))
    return found.groupBy("doc_id", "Tag").agg(F.sum("n").alias("n"))


def document_rows(texts: Texts) -> DataFrame:
    """The rows of ``tagging.document_units``, made from texts in one step and in small batches."""
    from .tagging import UNIT_TYPE

    make = texts.reader("pos", "rows")

    def task(parts):
        reader = make()
        for ids, x in parts:
            words, null = reader.split(x), x.is_null()
            distinct, at = np.unique(words.number, return_inverse=True)
            low, tag = (pa.array([of[i] for i in distinct.tolist()], pa.string()).take(pa.array(at)) for of in (reader.lows, reader.tags))
            toks, low, tags = (_lists(words.edges, v, null) for v in (words.tokens(), low, tag))
            own = pa.array(np.diff(words.edges).astype(np.int32))
            units = reader.phrases.units(toks, low, own, pa.array(np.zeros(len(own), np.int64)))
            yield {"doc_id": ids, "toks": toks, "low": low, "tags": tags, "units": units}
            if reader.full():
                reader.renew()
    found = texts.mapped(task, texts.schema("", f"toks array<string>, low array<string>, tags array<string>, units {UNIT_TYPE}"), ROW_BYTES)
    return found.select("doc_id", "toks", F.size("toks").alias("n"), "low", "tags", "units")
