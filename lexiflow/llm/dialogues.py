"""Repair of the turn structure of conversations by the cheapest edits.

A repaired conversation is empty or has an optional system turn and then pairs
of a user and an assistant turn.  Edits: Keep, Rerole (to user or assistant),
Delete, Insert (an empty user or assistant turn).  Of the cheapest edits those
with the ASCII-least audit (the edits' initials in order) are taken.

Prefix-doubling path ranking.  What matters of the turns so far is one of four
states, so a run of rows is a 4 x 4 matrix of least costs.  Rows are cut into
blocks of ``BLOCK``; the cost dynamic program runs backwards through a block
for all blocks of a batch at once.  An arc is optimal if it lies on a cheapest
way to the end.  The nodes of optimal arcs are then ranked by their least audit
of one letter, two, four and so on: a node's rank for twice the length is the
pair of its rank and that of the node its pointer reaches, and pointers double
along.  The ranks select each node's arc, the doubled pointers list the path.

A conversation of at most ``BLOCK`` rows is one block and moves once.  A longer
one is ranked by range (never in one task); only a row per block goes through
the two passes that carry the cost vector backwards and the state forwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .scratch import Scratch

#: Rows of a block; a longer conversation is several blocks.
BLOCK = 512
#: Names of long conversations are broadcast while there are at most so many.
BROADCAST_NAMES = 100_000

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3     # costs; CUT: an undeleted truncated row

_FAR = 1 << 40
_SPACE = " \t\n\x0b\x0c\r"
_LETTERS = np.frombuffer(b"-DIKR", np.uint8)          # in ASCII order
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_INSERTED = np.array([_USER, _USER, _ASSISTANT, _USER])       # state after an insertion
_TWICE = _INSERTED[_INSERTED]
_ENDS = np.array([0, 2 * INSERT, INSERT, 0])          # least cost to a complete conversation after the last row
_ROLES = ["", "system", "user", "assistant"]
_INITIAL = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
_LEGAL = {"su", "ua", "au"}

_PIECE = ("k string, block long, blocks long, low_turn long, high_turn long, n_turns long, first_initial string, "
          "last_initial string, blank long, duplicate long, truncated long, illegal long, cost long, "
          "edits array<struct<edit:string,turn:long,role:string,text:string>>")


# --- in a task: many blocks at once -------------------------------------------------

def _costs(sizes: np.ndarray, must: np.ndarray, cut: np.ndarray, initial: np.ndarray, end: np.ndarray,
           every: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Least costs to go from the first position of each block, given those
    (blocks, m, 4) after its last row; with ``every`` (m = 1) those of all
    positions too, of which a block has one more than rows."""
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    order = np.argsort(-sizes, kind="stable")
    g = np.minimum(end[order], _FAR)
    known = None
    if every:
        known = np.empty((len(must) + len(sizes), 4), np.int64)
        known[first + np.arange(len(sizes)) + sizes] = end[:, 0]
    stay = np.where(must, _FAR, np.where(cut, CUT, 0))
    for t in range(int(sizes.max(initial=0))):
        act = order[:np.searchsorted(-sizes[order], -t)]
        row = first[act] + sizes[act] - 1 - t
        x, keep, ini = g[:len(act)], stay[row][:, None], initial[row][:, None]
        user = x[..., _USER] + keep + np.where(ini == _USER, KEEP, REROLE)
        assistant = x[..., _ASSISTANT] + keep + np.where(ini == _ASSISTANT, KEEP, REROLE)
        system = x[..., _SYSTEM] + keep + np.where(ini == _SYSTEM, KEEP, _FAR)
        h = x + DELETE
        h[..., _START] = np.minimum(np.minimum(h[..., _START], user), system)
        h[..., _SYSTEM] = np.minimum(h[..., _SYSTEM], user)
        h[..., _USER] = np.minimum(h[..., _USER], assistant)
        h[..., _ASSISTANT] = np.minimum(h[..., _ASSISTANT], user)
        h = np.minimum(h, np.minimum(h[..., _INSERTED] + INSERT, h[..., _TWICE] + 2 * INSERT))
        g[:len(act)] = np.minimum(h, _FAR)
        if every:
            known[row + act] = g[:len(act), 0]
    out = np.empty_like(g)
    out[order] = g
    return out, known


def _arcs(sizes: np.ndarray, must: np.ndarray, cut: np.ndarray, initial: np.ndarray, known: np.ndarray,
          last: np.ndarray) -> np.ndarray:
    """(letters, nodes): the node an optimal arc with that letter leads to, or
    -1.  Node 4 * position + state; a letter leads to one node at most."""
    block = np.repeat(np.arange(len(sizes)), sizes + 1)
    place = np.arange(len(block))
    at_end = np.zeros(len(block), bool)
    at_end[np.cumsum(sizes + 1) - 1] = True
    row = np.minimum(place - block, max(len(must) - 1, 0))
    states = np.arange(4)
    blank = np.zeros(len(block), np.int64)
    ini = np.where(at_end, 0, initial[row]) if len(must) else blank
    stay = np.where(at_end, _FAR, np.where(must[row], _FAR, np.where(cut[row], CUT, 0))) if len(must) else blank + _FAR
    goal = np.array([_USER, _USER, _ASSISTANT, _USER])
    to = np.full((5, len(block), 4), -1, np.int64)
    ways = [(1, states[None, :], np.where(at_end, _FAR, DELETE)[:, None] + 0 * states, 1),
            (2, _INSERTED[None, :], np.where(at_end & ~last[block], _FAR, INSERT)[:, None] + 0 * states, 0),
            (4, goal[None, :], (stay + REROLE)[:, None] + 0 * states, 1)]
    kept = np.where((ini[:, None] == _SYSTEM) & (states == _START), _SYSTEM, goal[None, :])
    fits = (ini[:, None] == kept) & (stay[:, None] < _FAR)
    ways.append((3, kept, np.where(fits, stay[:, None] + KEEP, _FAR), 1))
    flat = known.reshape(-1)
    for letter, state, cost, step in ways:
        target = np.minimum(place + step, len(block) - 1)[:, None] * 4 + state
        good = (cost < _FAR) & (known < _FAR) & (known == cost + flat[target])
        to[letter] = np.where(good, target, -1)
    return to.reshape(5, -1)


def _doubled(to: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Letter of each node's chosen arc, pointers over 1, 2, 4 ... letters, and
    the number of letters from each node to the end of its block."""
    nodes = np.arange(to.shape[1])

    def pointers(letter):
        step = np.where(letter > 0, to[letter, nodes], nodes)
        ptrs, count = [step], (letter > 0).astype(np.int64)
        while True:
            on = ptrs[-1]
            count = count + count[on]
            both = on[on]
            if (both == on).all():
                return ptrs, count
            ptrs.append(both)

    # by their first letter (0 at an end, which is least); then by twice as many letters in each round
    letter = np.where((to[1:] >= 0).any(0), (to[1:] >= 0).argmax(0) + 1, 0)
    ptrs, _ = pointers(letter)
    rank = letter.astype(np.int64)
    for on in ptrs:
        rank = np.unique(rank * (rank.max(initial=0) + 1) + rank[on], return_inverse=True)[1]
    # the arc with the least letter and then the least rank of the rest
    key = np.where(to >= 0, np.arange(5)[:, None] * (rank.max(initial=0) + 1) + rank[to], np.iinfo(np.int64).max)
    letter = np.where((to >= 0).any(0), key.argmin(0), 0)
    ptrs, count = pointers(letter)
    return letter, ptrs, count


def _exits(sizes, to) -> np.ndarray:
    """State at the end of each block, for each state at its beginning."""
    _, ptrs, _ = _doubled(to)
    begin = (np.cumsum(sizes + 1) - sizes - 1)[:, None] * 4 + np.arange(4)
    at = begin
    for _ in range(2):                       # the last pointer reaches every end
        at = ptrs[-1][at]
    return at % 4


def _paths(sizes, to, enter) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Letters and nodes of the chosen path of each block, entered in a state."""
    letter, ptrs, count = _doubled(to)
    begin = (np.cumsum(sizes + 1) - sizes - 1) * 4 + enter
    lengths = count[begin]
    node = np.repeat(begin, lengths)
    step = np.arange(len(node)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    for k, on in enumerate(ptrs):
        node = np.where((step >> k) & 1 == 1, on[node], node)
    cuts = np.cumsum(lengths)[:-1]
    return np.split(letter[node], cuts), np.split(node, cuts)


def _judged(roles: Sequence[str], texts: Sequence[str], first: Sequence[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fault (1 blank, 2 duplicate, 3 truncated, 0 none) and state of the role's initial."""
    fault, initial = np.zeros(len(roles), np.int64), np.zeros(len(roles), np.int64)
    for i, (role, text) in enumerate(zip(roles, texts)):
        seen = text.rstrip(_SPACE)
        fault[i] = 1 if not seen else 2 if not first[i] else 3 if seen[-1] not in ".!?" else 0
        initial[i] = _INITIAL.get(role[:1], 0)
    return fault, fault % 3 > 0, initial


def _runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[dict[str, list]]:
    """Columns of rows in order, cut only where the keys change."""
    held: dict[str, list] = {}
    for batch in batches:
        for name, values in batch.to_pydict().items():
            held.setdefault(name, []).extend(values)
        n = len(held[keys[0]]) if held else 0
        cut = n - 1
        while cut > 0 and all(held[c][cut - 1] == held[c][n - 1] for c in keys):
            cut -= 1
        if cut > 0:
            yield {c: v[:cut] for c, v in held.items()}
            held = {c: v[cut:] for c, v in held.items()}
    if held and held[keys[0]]:
        yield held


def _bounds(rows: dict[str, list], keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """First row and size of each group."""
    n = len(rows[keys[0]])
    cols = [rows[c] for c in keys]
    first = np.array([i for i in range(n) if i == 0 or any(c[i] != c[i - 1] for c in cols)])
    return first, np.diff(np.concatenate([first, [n]]))


def _pieces(rows: dict[str, list], first: np.ndarray, sizes: np.ndarray, is_first: list[bool], end: np.ndarray,
            enter: np.ndarray, block: Sequence[int], blocks: Sequence[int]) -> pa.RecordBatch:
    """Repaired blocks.  ``end`` (blocks, 4): costs to go after each block."""
    fault, must, initial = _judged(rows["role"], rows["text"], is_first)
    cut = fault == 3
    last = np.asarray(block) == np.asarray(blocks) - 1
    _, known = _costs(sizes, must, cut, initial, end[:, None, :], every=True)
    letters, nodes = _paths(sizes, _arcs(sizes, must, cut, initial, known, last), enter)
    out = []
    for b, (f, n) in enumerate(zip(first.tolist(), sizes.tolist())):
        turns = [t for t in rows["turn"][f:f + n] if t is not None]
        initials = [r[:1] for r in rows["role"][f:f + n]]
        edits = []
        here = f + b                          # position of the block's first row
        for letter, node in zip(letters[b].tolist(), nodes[b].tolist()):
            row, state = node // 4 - b, node % 4
            if letter == 1:
                edits.append({"edit": "D", "turn": rows["turn"][row]})
            elif letter == 2:
                edits.append({"edit": "I", "role": _ROLES[_INSERTED[state]], "text": ""})
            else:
                role = rows["role"][row] if letter == 3 else _ROLES[_INSERTED[state]]
                edits.append({"edit": "K" if letter == 3 else "R", "turn": rows["turn"][row], "role": role,
                              "text": rows["text"][row]})
        kinds = fault[f:f + n]
        out.append({
            "k": rows["k"][f], "block": int(block[b]), "blocks": int(blocks[b]), "low_turn": min(turns, default=None),
            "high_turn": max(turns, default=None), "n_turns": len(set(turns)), "first_initial": initials[0],
            "last_initial": initials[-1], "blank": int((kinds == 1).sum()), "duplicate": int((kinds == 2).sum()),
            "truncated": int((kinds == 3).sum()), "illegal": sum(a + z not in _LEGAL for a, z in zip(initials, initials[1:])),
            "cost": int(known[here, enter[b]]), "edits": edits})
    return out


_ARROW = pa.schema([
    *[(c, pa.string() if c in ("k", "first_initial", "last_initial") else pa.int64()) for c in (
        "k", "block", "blocks", "low_turn", "high_turn", "n_turns", "first_initial", "last_initial", "blank", "duplicate",
        "truncated", "illegal", "cost")],
    ("edits", pa.list_(pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])))])


def _repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations, rows in order."""
    for rows in _runs(batches, ["k"]):
        first, sizes = _bounds(rows, ["k"])
        is_first, seen = [], set()
        starts = set(first.tolist())
        for i, pair in enumerate(zip(rows["role"], rows["text"])):
            if i in starts:
                seen = set()
            is_first.append(pair not in seen)
            seen.add(pair)
        n = len(first)
        out = _pieces(rows, first, sizes, is_first, np.tile(_ENDS, (n, 1)), np.zeros(n, np.int64), [0] * n, [1] * n)
        yield from pa.Table.from_pylist(out, _ARROW).to_batches()


# --- conversations of more than one block --------------------------------------------

def _block_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, block, fault, initial) to the matrix of each block, [end][begin]."""
    for rows in _runs(batches, ["k", "block"]):
        first, sizes = _bounds(rows, ["k", "block"])
        fault, initial = np.array(rows["fault"]), np.array(rows["initial"])
        unit = np.where(np.eye(4, dtype=bool), 0, _FAR)
        g, _ = _costs(sizes, fault % 3 > 0, fault == 3, initial, np.tile(unit, (len(sizes), 1, 1)))
        yield pa.RecordBatch.from_pydict({
            "k": [rows["k"][i] for i in first], "block": [rows["block"][i] for i in first],
            "blocks": [rows["blocks"][i] for i in first], "matrix": g.reshape(len(sizes), 16).tolist()})


def _carry_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices, last block of a conversation first, to the costs after each block."""
    key, after = None, _ENDS
    for batch in batches:
        d, ends = batch.to_pydict(), []
        for k, m in zip(d["k"], d["matrix"]):
            if k != key:
                key, after = k, _ENDS
            ends.append(after.tolist())
            after = np.minimum((np.array(m).reshape(4, 4) + after[:, None]).min(0), _FAR)
        yield pa.RecordBatch.from_pydict({"k": d["k"], "block": d["block"], "blocks": d["blocks"], "after": ends})


def _block_exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks, after a row with the block's ``after``, to the state at its end for each at its beginning."""
    for rows in _runs(batches, ["k", "block"]):
        first, sizes = _bounds(rows, ["k", "block"])
        told = np.zeros(len(rows["k"]), bool)
        told[first] = True
        fault, initial = (np.array([v or 0 for v in rows[c]])[~told] for c in ("fault", "initial"))
        sizes = sizes - 1
        after = np.array([rows["after"][i] for i in first])
        must, cut = fault % 3 > 0, fault == 3
        last = np.array([rows["block"][i] == rows["blocks"][i] - 1 for i in first])
        _, known = _costs(sizes, must, cut, initial, after[:, None, :], every=True)
        exits = _exits(sizes, _arcs(sizes, must, cut, initial, known, last))
        yield pa.RecordBatch.from_pydict({
            "k": [rows["k"][i] for i in first], "block": [rows["block"][i] for i in first],
            "blocks": [rows["blocks"][i] for i in first], "after": after.tolist(), "exits": exits.tolist()})


def _carry_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exits, first block of a conversation first, to the state in which each block begins."""
    key, state = None, _START
    for batch in batches:
        d, enter = batch.to_pydict(), []
        for k, exits in zip(d["k"], d["exits"]):
            if k != key:
                key, state = k, _START
            enter.append(state)
            state = exits[state]
        yield pa.RecordBatch.from_pydict({"k": d["k"], "block": d["block"], "blocks": d["blocks"], "after": d["after"],
                                          "enter": enter})


def _repair_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks, each block after a row with its ``after`` and ``enter``, to pieces."""
    for rows in _runs(batches, ["k", "block"]):
        first, sizes = _bounds(rows, ["k", "block"])
        told = set(first.tolist())
        body = {c: [x for i, x in enumerate(rows[c]) if i not in told] for c in ("k", "turn", "role", "text", "first")}
        sizes = sizes - 1
        starts = np.cumsum(sizes) - sizes
        out = _pieces(body, starts, sizes, body["first"], np.array([rows["after"][i] for i in first]),
                      np.array([rows["enter"][i] for i in first]), [rows["block"][i] for i in first],
                      [rows["blocks"][i] for i in first])
        yield from pa.Table.from_pylist(out, _ARROW).to_batches()


def _fault(text: Column, is_first: Column) -> Column:
    seen = F.rtrim(text, F.lit(_SPACE))
    return (F.when(F.length(seen) == 0, 1).when(~is_first, 2)
             .when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0))


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Blocks whole in a partition, rows of each in order."""
    return rows.repartition("k", "block").sortWithinPartitions("k", "block", *order)


def _repair_long(rows: DataFrame, scratch: Scratch) -> DataFrame:
    placed = ranked(rows, "k", ["turn", "role", "said"], scratch, "turns")
    ids = ["k", F.col("rank").alias("at")]
    firsts = (placed.groupBy("k", "role", "said").agg(F.min("rank").alias("at"))     # combined before it is shuffled
                    .select("k", "at", F.lit(True).alias("first")))
    body = (placed.select(*ids, "n", "turn", "role", "text").join(firsts, ["k", "at"], "left")
                  .withColumn("first", F.coalesce("first", F.lit(False)))
                  .withColumn("block", F.floor(F.col("at") / F.lit(BLOCK)).cast("long"))
                  .withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("long")))
    body = scratch.write(body, "turn-rows")
    scratch.drop("turns")
    initial = F.coalesce(*[F.when(F.col("role").startswith(c), s) for c, s in _INITIAL.items()], F.lit(0))
    narrow = body.select("k", "block", "blocks", "at", _fault(F.col("text"), F.col("first")).alias("fault"),
                         initial.alias("initial"))
    matrices = _in_order(narrow, "at").mapInArrow(_block_costs, "k string, block long, blocks long, matrix array<long>")
    after = (matrices.repartition("k").sortWithinPartitions("k", F.col("block").desc())
                     .mapInArrow(_carry_costs, "k string, block long, blocks long, after array<long>"))
    after = scratch.write(after, "turn-costs")
    told = after.select("*", F.lit(-1).cast("long").alias("at"))
    exits = (_in_order(narrow.unionByName(told, allowMissingColumns=True), "at")
             .mapInArrow(_block_exits, "k string, block long, blocks long, after array<long>, exits array<long>"))
    enter = (exits.repartition("k").sortWithinPartitions("k", "block")
                  .mapInArrow(_carry_states, "k string, block long, blocks long, after array<long>, enter long"))
    enter = scratch.write(enter, "turn-states")
    told = enter.select("*", F.lit(-1).cast("long").alias("at"))
    whole = body.select("k", "block", "blocks", "at", "turn", "role", "text", "first")
    return (_in_order(whole.unionByName(told, allowMissingColumns=True), "at").mapInArrow(_repair_blocks, _PIECE))


def _key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def repair(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (conv_id, turn, role, text) to repaired pieces: a row for each
    conversation, or for each ``BLOCK`` rows of a longer one (``block`` of
    ``blocks``), with counts of faults, the cost from its beginning on and the
    ``edits`` in order (edit, turn, role, text; a deleted row's role and text
    are null).  ``k`` is the text of conv_id after ``=``, empty for null.

    Rows of a conversation are ordered by turn (null first), then role and the
    text's SHA-256, so that equal rows are adjacent and no long text is a key.  Null roles and texts count as one space; rows with a null
    conv_id are one conversation; repeated rows are duplicates; an empty table
    gives none; other columns are left out."""
    rows = rows.select(_key(F.col("conv_id")).alias("k"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("said", F.sha2("text", 256))
    long = scratch.write(rows.groupBy("k").count().filter(F.col("count") > BLOCK).select("k"), "long-names")
    n_long = long.count()
    if n_long <= BROADCAST_NAMES:
        long = F.broadcast(long)
    order = ["k", F.col("turn").asc_nulls_first(), "role", "said"]
    short = rows.join(long, "k", "left_anti") if n_long else rows
    pieces = short.repartition("k").sortWithinPartitions(*order).drop("said").mapInArrow(_repair_whole, _PIECE)
    if n_long:
        pieces = pieces.unionByName(_repair_long(rows.join(long, "k", "left_semi"), scratch))
    return scratch.write(pieces, "repaired")


# --- the query ------------------------------------------------------------------------

def _code() -> Column:
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])
    return (F.crc32(name) % 20).cast("int")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the CRC-32 of ``conv_id:turn`` modulo 20: 0 goes, 1 has
    no text, 2 no ``.!?``, 3 comes twice, 4 is the user's.  Nulls count as one
    space (a null turn stays null for the order)."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text"), _code().alias("code")).filter("code <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", ""))
                        .otherwise(F.col("text")).alias("text"),
                       F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


_DIGEST = ("k string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to a row per conversation; of the texts only the hash's state is held."""
    def closed():
        gaps = high - low + 1 - turns if low is not None else 0
        return pa.RecordBatch.from_pylist([dict(k=key, gaps=gaps, **counts, cost=cost, audit="".join(audit),
                                                repaired_sha256=sha.hexdigest())], schema)

    schema = pa.schema([(c, pa.string() if c in ("k", "audit", "repaired_sha256") else pa.int64()) for c in (
        "k", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")])
    key = None
    for batch in batches:
        for p in batch.to_pylist():
            if p["k"] != key:
                if key is not None:
                    yield closed()
                key, low, high, turns, last, cost, audit, sha, some = p["k"], None, None, 0, None, p["cost"], [], hashlib.sha256(), False
                counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
            for c in counts:
                counts[c] += p[c]
            counts["illegal"] += last is not None and last + p["first_initial"] not in _LEGAL
            last = p["last_initial"]
            if p["low_turn"] is not None:
                turns += p["n_turns"] - (high == p["low_turn"])
                low, high = p["low_turn"] if low is None else low, p["high_turn"]
            audit.append(p["audit"])
            if p["n_kept"]:
                sha.update(b"\n" * some + p["kept"].encode("utf-8", "surrogatepass"))
                some = True
    if key is not None:
        yield closed()


def digest(conversations: DataFrame) -> DataFrame:
    """A row per conv_id of ``conversations`` after ``damage`` and ``repair``:
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    A conversation without rows has zeros, an empty audit and the hash of the
    empty string.  The audit and the hash of a longer conversation are by
    nature one value: its blocks pass one task in order, which holds the audit
    (a letter per edit) and the hash's state, never the texts."""
    with Scratch() as scratch:
        pieces = repair(damage(conversations), scratch)
        kept = F.filter("edits", lambda e: e["edit"] != "D")
        pieces = pieces.select("*", F.array_join(F.transform("edits", lambda e: e["edit"]), "").alias("audit"),
                               F.size(kept).alias("n_kept"),
                               F.array_join(F.transform(kept, lambda e: F.concat(e["role"], F.lit(":"), e["text"])), "\n").alias("kept"))
        gaps = F.coalesce(F.col("high_turn") - F.col("low_turn") + 1 - F.col("n_turns"), F.lit(0).cast("long"))
        short = pieces.filter("blocks = 1").select("k", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost",
                                                   "audit", F.sha2("kept", 256).alias("repaired_sha256"))
        long = (pieces.filter("blocks > 1").drop("edits").repartition("k").sortWithinPartitions("k", "block")
                      .mapInArrow(_join_blocks, _DIGEST))
        zero = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        gone = (conversations.select(_key(F.col("conv_id")).alias("k"), _code().alias("code"))
                             .groupBy("k").agg(F.max("code").alias("code")).filter("code = 0")
                             .select("k", *zero, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256")))
        kind = conversations.schema["conv_id"].dataType
        return scratch.keep(short.unionByName(long).unionByName(gone).select(
            F.when(F.col("k") != "", F.expr("substring(k, 2)").cast(kind)).alias("conv_id"),
            "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"), "conversations")
