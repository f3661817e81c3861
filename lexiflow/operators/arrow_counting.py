"""Counting and viewing document rows over Arrow batches.

What a row's arrays say (its units, n-grams, neighbours, character offsets) is
worked out for all words of a piece of a batch at once, and what can be added up
is added up per piece, so that few rows go on to the shuffle.  A piece holds
whole rows and about ``WORDS`` words (a longer row is a piece of its own).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrow_tagging import WS, _bools, _lists, _rows

WORDS = 1 << 18
#: Combined numbers stay below this; beyond it they are numbered anew.
MOST = 1 << 62


def pieces(batches: Iterable[pa.RecordBatch], lists: str) -> Iterator[dict[str, pa.Array]]:
    """Columns of whole rows with about ``WORDS`` elements of the column ``lists``."""
    for b in batches:
        edges = _rows(b.column(lists))[1]
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(edges, edges[at] + WORDS, "right")) - 1)
            yield dict(zip(b.schema.names, b.slice(at, end - at).columns))
            at = end


def by_piece(lists: str, counted: Callable[[dict[str, pa.Array]], dict[str, pa.Array]]) -> Callable:
    """A function for ``mapInArrow`` from one on the columns of a piece."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, lists):
            yield pa.RecordBatch.from_pydict(counted(piece))
    return each


def numbered(values: pa.Array) -> tuple[np.ndarray, int]:
    """A number for each value (null is a value like any other), and how many there are."""
    coded = values.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(coded.dictionary), 1)


def combined(parts: Iterable[tuple[np.ndarray, int]]) -> tuple[np.ndarray, int]:
    """One number for each combination of numbers."""
    parts = iter(parts)
    code, width = next(parts)
    for more, n in parts:
        if width > MOST // n:
            distinct, code = np.unique(code, return_inverse=True)
            width = max(len(distinct), 1)
        code, width = code * n + more, width * n
    return code, width


def grouped(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct number stands first, in the order of numbers, and how often it comes."""
    order = np.argsort(code, kind="stable")
    edge = np.flatnonzero(np.diff(code[order], prepend=-1))
    return order[edge], np.diff(np.append(edge, len(code)))


def key_counts(keys: Sequence[pa.Array], row: np.ndarray, rows: int) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """Distinct keys with their occurrences and the number of rows that have them."""
    return _counts(keys, combined(map(numbered, keys)), row, rows)


def _counts(keys: Sequence[pa.Array], code: tuple[np.ndarray, int], row: np.ndarray, rows: int):
    each, n = grouped(combined([code, (row, max(rows, 1))])[0])      # equal keys stay together
    of = code[0][each]
    edge = np.flatnonzero(np.diff(of, prepend=-1))
    sums = np.add.reduceat(n, edge) if len(edge) else n
    first = pa.array(each[edge])
    return [k.take(first) for k in keys], sums, np.diff(np.append(edge, len(of)))


def _counting_rows(names: Sequence[str], keys: Sequence[pa.Array], n: np.ndarray, docs: np.ndarray, size: pa.Array, total: int):
    """Counting rows, and one with null keys that counts the piece's documents with a token."""
    some = int((size.fill_null(0).to_numpy(zero_copy_only=False) > 0).sum())
    columns = {k: pa.concat_arrays([v, pa.nulls(1, v.type)]) for k, v in zip(names, keys)}
    return columns | {"n": pa.array(np.append(n, total).astype(np.int64)), "docs": pa.array(np.append(docs, some).astype(np.int64))}


def unit_counter(names: Sequence[str], without: str | None) -> Callable:
    """Counting rows of units, given as an array column for each key; ``without``: a tag that does not count."""
    def counted(piece):
        flat, edges = zip(*[_rows(piece[k]) for k in names])
        row = np.repeat(np.arange(len(edges[0]) - 1), np.diff(edges[0]))
        if without is not None:
            kept = _bools(pc.not_equal(flat[names.index("Tag")], without))
            flat, row = [v.filter(pa.array(kept)) for v in flat], row[kept]
        return _counting_rows(names, *key_counts(flat, row, len(edges[0]) - 1), piece["size"], 0)
    return by_piece(names[0], counted)


def tag_matrix(without: str | None) -> Callable:
    """(doc_id, Tag, n) of rows with an array ``Tag``."""
    def counted(piece):
        tags, edges = _rows(piece["Tag"])
        row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        if without is not None:
            kept = _bools(pc.not_equal(tags, without))
            tags, row = tags.filter(pa.array(kept)), row[kept]
        first, n = grouped(combined([numbered(tags), (row, max(len(edges) - 1, 1))])[0])
        return {"doc_id": piece["doc_id"].take(pa.array(row[first])), "Tag": tags.take(pa.array(first)), "n": pa.array(n.astype(np.int64))}
    return by_piece("Tag", counted)


def words_of(piece: dict[str, pa.Array], punct_tag: str | None) -> tuple[dict[str, pa.Array], np.ndarray, np.ndarray]:
    """The units of whole rows that are no punctuation, as columns Token, Tag and ``brk`` (one stands right before,
    or the row begins), where each row begins and the last ends, and how many units of a row count.
    Punctuation has the tag given, or is told by a column ``punct``; then it counts too."""
    tokens, edges = _rows(piece["Token"])
    tags = piece["Tag"].flatten()
    signs = _bools(piece["punct"].flatten()) if punct_tag is None else _bools(pc.equal(tags, punct_tag))
    broken = np.concatenate([[True], signs[:-1]]) if len(signs) else signs.copy()
    broken[edges[:-1][edges[:-1] < len(signs)]] = True
    known = ~signs if punct_tag is None else _bools(pc.not_equal(tags, punct_tag))
    kept = np.flatnonzero(known)
    found = np.searchsorted(kept, edges)
    words = {"Token": tokens.take(pa.array(kept)), "Tag": tags.take(pa.array(kept)), "brk": broken[kept]}
    return words, found, np.diff(edges if punct_tag is None else found)


def gram_counter(span: int, names: Sequence[str], punct_tag: str | None) -> Callable:
    """Counting rows of the n-grams of whole rows."""
    def counted(piece):
        words, edges, units = words_of(piece, punct_tag)
        tokens, tags, broken = words.values()
        row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        begins = np.flatnonzero(np.arange(len(row)) + span <= edges[1:][row])
        whole = np.ones(len(begins), bool)
        for k in range(1, span):
            whole &= ~broken[begins + k]
        begins = begins[whole]
        word, width = combined([numbered(tokens), numbered(tags)])
        code = combined([(word[begins + k], width) for k in range(span)])
        (first,), n, docs = _counts([pa.array(begins)], code, row[begins], len(edges) - 1)
        at = [pc.add(first, k) for k in range(span)]
        keys = [v.take(k) for v in (tokens, tags) for k in at]
        return _counting_rows(names, keys, n, docs, piece["size"], int(units.sum()))
    return by_piece("Token", counted)


def _own_words(piece: dict[str, pa.Array], edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that are a sequence's own, and their rows."""
    lead, own = (piece[c].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lead", "own"))
    own = np.maximum(own, 0)
    row = np.repeat(np.arange(len(own)), own)
    return np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own) + (edges[:-1] + lead)[row], row


def neighbour_counter(node: str, node_tag: str | None, preceding: int, following: int, whole: bool, punct_tag: str | None) -> Callable:
    """(Token, Tag, nodes, n, is_node): nodes within reach of a word's places, summed, and the number of places;
    of whole rows of units, or of blocks of words."""
    def counted(piece):
        if whole:
            words, edges, _ = words_of(piece, punct_tag)
            tokens, tags, _ = words.values()
            at, row = np.arange(len(tokens)), np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        else:
            tokens, edges = _rows(piece["Token"])
            tags = piece["Tag"].flatten()
            at, row = _own_words(piece, edges)
        nodes = _bools(pc.equal(tokens, node))
        if node_tag:
            nodes &= _bools(pc.starts_with(tags, node_tag))
        before = np.concatenate([[0], np.cumsum(nodes)])
        low, high = np.maximum(at - following, edges[row]), np.minimum(at + preceding + 1, edges[row + 1])
        near = before[high] - before[low] - nodes[at]
        code, _ = combined([numbered(tokens), numbered(tags)])
        order = np.argsort(code[at], kind="stable")
        edge = np.flatnonzero(np.diff(code[at][order], prepend=-1))
        sums = np.add.reduceat(near[order], edge) if len(edge) else near
        first = at[order[edge]]
        return {"Token": tokens.take(pa.array(first)), "Tag": tags.take(pa.array(first)), "nodes": pa.array(sums.astype(np.int64)),
                "n": pa.array(np.diff(np.append(edge, len(at))).astype(np.int64)), "is_node": pa.array(nodes[first].astype(np.int64))}
    return by_piece("Token", counted)


def span_lister(phrases: bool) -> Callable:
    """(doc_id, pos, token, Tag, tag_end, last): stripped units, where each ends among the row's, and the white space it ends in.

    Units are tokens, or with ``phrases`` the tokens from ``pos`` on, ``n`` of them."""
    blank = pa.array(list(WS))

    def listed(piece):
        texts, edges = _rows(piece["toks"])
        tags, ends = _rows(piece["Tag"])
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        if phrases:
            place, n = (piece[c].flatten().to_numpy(zero_copy_only=False) for c in ("pos", "n"))
            texts = _joined(texts, edges[row] + place, n)
        else:
            place = np.arange(len(row)) - np.repeat(ends[:-1], np.diff(ends))
        token, last = pc.utf8_trim(texts, characters=WS), pc.utf8_slice_codeunits(texts, start=-1)
        length = pc.utf8_length(token).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(length)
        before = np.concatenate([[0], end])[ends[:-1]]
        return {"doc_id": piece["doc_id"].take(pa.array(row)), "pos": pa.array(place.astype(np.int64)), "token": token, "Tag": tags,
                "tag_end": pa.array(end - before[row]), "last": pc.if_else(pc.is_in(last, blank), last, "")}
    return by_piece("toks", listed)


def _joined(texts: pa.Array, at: np.ndarray, n: np.ndarray) -> pa.Array:
    """The ``n`` texts from ``at`` on as one, for each unit."""
    several = np.flatnonzero(n > 1)
    size = n[several].astype(np.int64)
    edge = np.concatenate([[0], np.cumsum(size)])
    inner = np.arange(edge[-1]) - np.repeat(edge[:-1], size) + np.repeat(at[several], size)
    whole = pc.binary_join(_lists(edge, texts.take(pa.array(inner))), "")
    take = at.copy()
    take[several] = len(texts) + np.arange(len(several))
    return pa.concat_arrays([texts, whole]).take(pa.array(take))
