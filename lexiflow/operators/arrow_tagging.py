"""Both taggers over Arrow batches: what ``operators.tagging`` does in a row, for all words of a batch at once.

A batch's words are looked up by Arrow's hash tables, each distinct token is
tagged once, and phrases are found by numpy over word numbers; only phrases that
overlap an earlier one are looked at one by one.  Which characters are signs or
numerals is told by the JVM's regular expressions, as the tokenizer's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WS = " \t\n\x0b\f\r"
PUNCT = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
UNIT_FIELDS = [("pos", pa.int64()), ("n", pa.int32()), ("tag", pa.string()), ("key", pa.string()), ("punct", pa.bool_())]
SPAN_FIELDS = [("s", pa.int64()), ("n", pa.int32()), ("tag", pa.string())]


def _rows(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of all lists (a null list has none), and where each list begins and the last ends."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _lists(edges: np.ndarray, values: pa.Array, null: pa.Array | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values, mask=null)


def _bools(found: pa.Array) -> np.ndarray:
    return pc.fill_null(found, False).to_numpy(zero_copy_only=False)


def word_tagger(lexicon: dict[str, str], suffixes: Sequence, punct: str, foreign: str) -> Callable:
    """The tags of arrays of tokens, given their lower case and the signs and numerals beyond ASCII."""
    words = pa.array(sorted(lexicon), pa.string())
    names = sorted({"NN1", "MC", punct, foreign, *lexicon.values(), *(tag for _, tag in suffixes)})
    number = {name: i for i, name in enumerate(names)}
    of_word = np.array([number[lexicon[w]] for w in words.to_pylist()], np.int32)

    def tags(toks: pa.Array, low: pa.Array, marks: pa.Array, digits: pa.Array) -> pa.Array:
        flat, edges = _rows(toks)
        coded = flat.dictionary_encode()
        at = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
        first = np.zeros(len(coded.dictionary) + 1, np.int64)
        first[at[::-1]] = np.arange(len(at) - 1, -1, -1)
        lows = low.flatten().take(pa.array(first[:-1]))
        s = pc.utf8_rtrim(coded.dictionary, characters=WS)
        signs, numerals = (pc.unique(x.flatten()) for x in (marks, digits))

        tag = np.full(len(s) + 1, number["NN1"], np.int32)      # (the last one is that of a null token)
        for ends, name in reversed(suffixes):                   # the rule that comes first is written last
            for end in ends:
                tag[:-1][_bools(pc.ends_with(lows, end))] = number[name]
        beyond = ~_bools(pc.string_is_ascii(s))
        tag[:-1][beyond] = number[foreign]
        known = pc.index_in(lows, words)
        tag[:-1][_bools(known.is_valid())] = of_word[known.drop_null().to_numpy(zero_copy_only=False)]
        tag[:-1][_bools(pc.match_substring_regex(s, r"^[0-9]+\z"))] = number["MC"]
        if len(numerals):
            those = {*numerals.to_pylist(), *"0123456789"}
            some = np.flatnonzero(beyond)
            tag[some[[those.issuperset(x) for x in s.take(pa.array(some)).to_pylist()]]] = number["MC"]
        one = _bools(pc.match_substring_regex(s, r"^[\x00-/:-@\[-`{-\x7f]\z"))
        if len(signs):
            one |= _bools(pc.is_in(s, signs))
        tag[:-1][one] = number[punct]
        return _lists(edges, pa.array(names).take(pa.array(tag[at])), toks.is_null())
    return tags


class Phrases:
    """A phrase lexicon as a trie over word numbers: the phrases that go on from each beginning."""

    def __init__(self, lexicon: dict[str, str], untagged: str) -> None:
        self.phrases = sorted(lexicon)
        self.names = [untagged, *sorted(set(lexicon.values()))]
        split = {p: p.split(" ") for p in self.phrases}
        words = sorted({w for ws in split.values() for w in ws})
        self.words = pa.array([*words, *[c for c in PUNCT if c not in set(words)]], pa.string())
        self.is_punct = np.array([w in PUNCT for w in self.words.to_pylist()] + [False])
        self.width = len(self.words) + 1
        number = {w: i for i, w in enumerate(words)}
        nodes, steps = {(): 0}, {}
        for p in self.phrases:
            at = ()
            for w in split[p]:
                steps.setdefault(len(at), {})[nodes[at] * self.width + number[w]] = nodes.setdefault((*at, w), len(nodes))
                at = (*at, w)
        self.steps = [(np.array(sorted(d), np.int64), np.array([d[k] for k in sorted(d)])) for _, d in sorted(steps.items())]
        self.phrase_at = np.full(len(nodes), -1)
        self.phrase_at[[nodes[tuple(split[p])] for p in self.phrases]] = np.arange(len(self.phrases))
        self.tag_at = np.array([self.names.index(lexicon[p]) for p in self.phrases], np.int32)

    def numbers(self, words: pa.Array) -> np.ndarray:
        return pc.index_in(words, self.words).fill_null(self.width - 1).to_numpy(zero_copy_only=False).astype(np.int64)

    def longest(self, numbers: np.ndarray, edges: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, words, phrase): the longest phrase at each of a row's first ``own`` words that begins one."""
        best, size = np.full(len(numbers), -1, np.int64), np.zeros(len(numbers), np.int32)
        begins = np.zeros(self.width, bool)
        if self.steps:
            begins[self.steps[0][0]] = True
        at = np.flatnonzero(begins[numbers])
        row = np.searchsorted(edges, at, "right") - 1
        mine = at - edges[row] < own[row]
        at, end = at[mine], edges[row[mine] + 1]
        node = np.zeros(len(at), np.int64)
        for k, (keys, to) in enumerate(self.steps):
            more = at + k < end
            at, end, node = at[more], end[more], node[more]
            key = node * self.width + numbers[at + k]
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[i] == key
            at, end, node = at[hit], end[hit], to[i[hit]]
            whole = self.phrase_at[node] >= 0
            best[at[whole]], size[at[whole]] = self.phrase_at[node[whole]], k + 1
        at = np.flatnonzero(best >= 0)
        return at, size[at], best[at]

    def candidates(self, low: pa.Array, own: pa.Array) -> pa.Array:
        """Per row the struct(s, n, tag) of ``longest``, in order."""
        words, edges = _rows(low)
        at, size, phrase = self.longest(self.numbers(words), edges, own.fill_null(0).to_numpy(zero_copy_only=False))
        row = np.searchsorted(edges, at, "right") - 1
        values = pa.StructArray.from_arrays([pa.array(at - edges[row]), pa.array(size, pa.int32()),
                                             pa.array(self.names).take(pa.array(self.tag_at[phrase]))], fields=[pa.field(*f) for f in SPAN_FIELDS])
        return _lists(np.searchsorted(at, edges), values)

    def units(self, toks: pa.Array, low: pa.Array, own: pa.Array, skip: pa.Array) -> pa.Array:
        """Per row the units that begin in its first ``own`` words, from word ``skip`` on."""
        words, edges = _rows(low)
        raw = toks.flatten()
        own, skip = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (own, skip))
        numbers = self.numbers(words)
        at, size, phrase = self.longest(numbers, edges, own)
        row = np.searchsorted(edges, at, "right") - 1
        late = at - edges[row] >= skip[row]
        taken = leftmost(at[late], size[late])
        at, size, phrase = at[late][taken], size[late][taken], phrase[late][taken]

        place = np.arange(len(words)) - np.repeat(edges[:-1], np.diff(edges))
        starts = (place < np.repeat(own, np.diff(edges))) & (place >= np.repeat(skip, np.diff(edges)))
        for k in range(1, len(self.steps)):
            starts[at[size > k] + k] = False
        unit = np.flatnonzero(starts)
        n, tag, key = np.ones(len(words), np.int32), np.zeros(len(words), np.int32), np.arange(len(words))
        n[at], tag[at] = size, self.tag_at[phrase]
        several = size > 1
        key[at[several]] = len(words) + phrase[several]
        texts = [words, pa.array(self.phrases, pa.string())]
        odd = self._unspaced(raw, at[several], size[several])       # a phrase whose words are not all apart
        if len(odd):
            key[odd] = len(words) + len(self.phrases) + np.arange(len(odd))
            texts.append(pa.array([self._key(raw, words, i, n[i]) for i in odd.tolist()], pa.string()))
        sign = np.flatnonzero(self.is_punct[numbers] & (tag == 0))
        punct = np.zeros(len(words), bool)
        punct[sign] = pc.match_substring_regex(raw.take(pa.array(sign)), r"^[!-/:-@\[-`{-~] *\z").to_numpy(zero_copy_only=False)
        values = pa.StructArray.from_arrays(
            [pa.array(place[unit]), pa.array(n[unit]), pa.array(self.names, pa.string()).take(pa.array(tag[unit])),
             pa.concat_arrays(texts).take(pa.array(key[unit])), pa.array(punct[unit])], fields=[pa.field(*f) for f in UNIT_FIELDS])
        return _lists(np.searchsorted(unit, edges), values)

    @staticmethod
    def _unspaced(raw: pa.Array, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        bad = np.zeros(len(at), bool)
        for k in range(int(size.max(initial=1)) - 1):
            inner = np.flatnonzero(size > k + 1)
            spaced = pc.match_substring_regex(raw.take(pa.array(at[inner] + k)), r"[ \t\n\x0b\f\r]\z")
            bad[inner] |= ~spaced.to_numpy(zero_copy_only=False)
        return at[bad]

    @staticmethod
    def _key(raw: pa.Array, words: pa.Array, i: int, n: int) -> str:
        return "".join(w + " " * (t[-1:] in WS) for t, w in zip(raw[i:i + n].to_pylist(), words[i:i + n].to_pylist())).rstrip(" ")


def leftmost(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which spans, ordered by start, stay if from left to right each is taken that overlaps none taken before."""
    end = start + size
    free = np.concatenate([[True], np.maximum.accumulate(end)[:-1] <= start[1:]]) if len(start) else np.zeros(0, bool)
    taken, last = free.copy(), 0
    for i in np.flatnonzero(~free).tolist():      # (the span before is free, or the one looked at before)
        if free[i - 1]:
            last = end[i - 1]
        if start[i] >= last:
            taken[i], last = True, end[i]
    return taken
