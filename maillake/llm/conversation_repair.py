"""Repair of conversation structure by Four-Russians block tables.

Rows of a conversation are kept, given another role, deleted, or new empty ones are inserted, at least cost, until the
role initials read ``(s?(ua)+)?``. What is left to pay depends on one of four states (nothing yet, after s, u, a), so a place
between two rows has a cost vector of four numbers. Their differences are bounded: only few vectors exist up to a constant.

1. A row is one of nine symbols (four kinds of role, cut off or not, or to be deleted). For every vector and every block of
   ``BLOCK`` symbols a table holds the vector before the block and the constant.
2. Blocks are processed from the last to the first by look-up, for all conversations of a batch at once.
3. Every block is expanded backward from the vector behind it, which gives the vector behind each row. A second table
   gives, for vector, symbol and state, the least letters of a cheapest way, so ties are settled while tracing forward.

Conversations are ranges of a table sorted by conversation and turn. One that lies inside a range and is of bounded size is
repaired there. What a range border cuts, or what is larger, becomes pieces: their symbols (one byte a row) are put together
per conversation, and each piece is then rewritten by itself. So no task holds the texts of a large conversation.

Defined results: null roles and texts are one space; a null conversation is one of its own; rows come by turn, nulls first,
then by role and the MD5 of their text; a role that does not begin with s, u or a (an empty one too) cannot be kept; repeated
rows are duplicates; an empty table gives empty ones; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..operators import skew
from ..operators.lineage import Scratch
from .store import per_process, quoted

# Costs, and what takes part in a repaired conversation; fixed values.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
KINDS = "sua"
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"

BLOCK = 4
PIECE_ROWS = 4096
PIECE_BYTES = 1 << 22
# States: nothing yet, after s, after u, after a. Inserted and re-roled rows lead to the only role that may follow.
NEXT = (2, 2, 3, 2)
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
END = (0, 2 * INSERT, INSERT, 0)  # what closing a conversation costs
OTHER = len(KINDS)
FAULTS = ("none", "blank", "duplicate", "truncated")
# Symbols: deletion, four kinds of role, the same cut off, and one that stands for no row.
DELETED, CUT, NOTHING = 0, 1 + OTHER + 1, 1 + 2 * (OTHER + 1)
SYMBOLS = NOTHING + 1
_LONG, _INT, _TEXT = pa.int64(), pa.int32(), pa.string()
COUNTED = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_COUNTS = [*[(c, _LONG) for c in COUNTED], ("audit", _TEXT)]
_MESSAGES = ("messages", pa.list_(pa.struct([("role", _TEXT), ("text", _TEXT)])))
_PLACE = [("conv", _LONG), ("part", _INT), ("seq", _INT)]
STAGED = pa.schema(
    [("whole", pa.bool_()), *_PLACE, *_COUNTS, _MESSAGES, ("codes", pa.binary()), ("first", _TEXT), ("last", _TEXT)]
    + [("low", _LONG), ("high", _LONG), ("turns", _LONG), ("roles", pa.list_(_TEXT)), ("texts", pa.list_(_TEXT))]
)
STITCHED = pa.schema([*_PLACE, ("state", _INT), ("letters", pa.list_(_TEXT)), ("opens", pa.bool_()), *_COUNTS])
PIECES = pa.schema([*_PLACE, _MESSAGES])


# -- tables -----------------------------------------------------------------------------------------


def _before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """What is left to pay before a row, from what is left behind it."""
    if symbol == NOTHING:
        return after
    cost = [DELETE + after[s] for s in range(4)]
    if symbol != DELETED:
        extra = CUT_OFF if symbol >= CUT else 0
        kind = (KINDS + "?")[(symbol - 1) % (OTHER + 1)]
        for s in range(4):
            cost[s] = min(cost[s], REROLE + extra + after[NEXT[s]])
            if kind in KEEP[s]:
                cost[s] = min(cost[s], extra + after[KEEP[s][kind]])
    for _ in range(3):  # rows inserted before this one
        cost = [min(cost[s], INSERT + cost[NEXT[s]]) for s in range(4)]
    return tuple(cost)


def _letters(after: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
    """The least letters of a cheapest way over a row, and the state behind it."""
    if symbol == NOTHING:
        return "", state
    left, out = _before(after, symbol), ""
    extra = CUT_OFF if symbol >= CUT else 0
    kind = (KINDS + "?")[(symbol - 1) % (OTHER + 1)] if symbol != DELETED else "?"
    while True:
        if left[state] == DELETE + after[state]:
            return out + "D", state
        if left[state] == INSERT + left[NEXT[state]]:
            out, state = out + "I", NEXT[state]
        elif kind in KEEP[state] and left[state] == extra + after[KEEP[state][kind]]:
            return out + "K", KEEP[state][kind]
        else:
            return out + "R", NEXT[state]


@dataclass
class Tables:
    vectors: np.ndarray  # normalised: the least entry is 0
    step: np.ndarray  # vector before a row, by vector behind it and symbol
    block: np.ndarray  # the same for a block of symbols
    added: np.ndarray  # the constant of a block
    moves: np.ndarray  # number of the letters, by vector behind the row, symbol and state
    follow: np.ndarray  # the state behind the row
    letters: list[str]


def tables() -> Tables:
    return per_process("repair_tables", _tables)


def _tables() -> Tables:
    found, todo = {END: 0}, [END]
    rows, constants = [], []
    while todo:  # every vector that can occur
        row, constant = [], []
        vector = todo.pop(0)
        for symbol in range(SYMBOLS):
            before = _before(vector, symbol)
            least = min(before)
            norm = tuple(c - least for c in before)
            if norm not in found:
                found[norm] = len(found)
                todo.append(norm)
            row.append(found[norm])
            constant.append(least)
        rows.append(row)
        constants.append(constant)
    step, constant = np.array(rows), np.array(constants)
    block = np.repeat(np.arange(len(found))[:, None], SYMBOLS**BLOCK, axis=1)
    added = np.zeros_like(block)
    numbers = np.arange(SYMBOLS**BLOCK)
    for k in range(BLOCK):  # the last symbol of a block is its lowest digit
        symbol = numbers // SYMBOLS**k % SYMBOLS
        added += constant[block, symbol]
        block = step[block, symbol]
    known: dict[str, int] = {}
    moves = np.zeros((len(found), SYMBOLS, 4), np.int64)
    follow = np.zeros_like(moves)
    for vector, symbol, state in product(found, range(SYMBOLS), range(4)):
        text, behind = _letters(vector, symbol, state)
        moves[found[vector], symbol, state] = known.setdefault(text, len(known))
        follow[found[vector], symbol, state] = behind
    return Tables(np.array(list(found)), step, block, added, moves, follow, list(known))


# -- rows as codes ----------------------------------------------------------------------------------


def symbols_of(codes: np.ndarray) -> np.ndarray:
    """Symbols of rows whose codes are the kind of role plus four times the fault."""
    kind, fault = codes % 4, codes // 4
    return np.where((fault == 1) | (fault == 2), DELETED, np.where(fault == 3, CUT + kind, 1 + kind))


def solve(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[list[str]]]:
    """Least cost of each conversation ``codes[bounds[i]:bounds[i + 1]]``, and the letters of each of its rows.

    What is inserted behind the last row is one more entry.
    """
    t = tables()
    n = np.diff(bounds)
    blocks = -(-n // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    filled = np.full(int(first[-1]) * BLOCK, NOTHING)
    owner = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(codes)) - bounds[owner]
    filled[first[owner] * BLOCK + inner] = symbols_of(codes)
    grid = filled.reshape(-1, BLOCK)
    number = grid @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))
    # Blocks from the last to the first.
    behind = np.zeros(len(grid), np.int64)
    vector, cost = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    order = np.argsort(-blocks, kind="stable")
    for k in range(int(blocks.max(initial=0)) - 1, -1, -1):
        live = order[: np.searchsorted(-blocks[order], -k, side="left")]
        at = first[live] + k
        behind[at] = vector[live]
        cost[live] += t.added[vector[live], number[at]]
        vector[live] = t.block[vector[live], number[at]]
    cost += t.vectors[vector, 0]
    # Each block backward: the vector behind each of its rows.
    after = np.empty(grid.shape, np.int64)
    after[:, BLOCK - 1] = behind
    for k in range(BLOCK - 1, 0, -1):
        after[:, k - 1] = t.step[after[:, k], grid[:, k]]
    after = after.ravel()
    # Forward, with the least letters.
    state = np.zeros(len(n), np.int64)
    chosen = np.empty(len(codes), np.int64)
    longest = np.argsort(-n, kind="stable")
    for r in range(int(n.max(initial=0))):
        live = longest[: np.searchsorted(-n[longest], -r, side="left")]
        at = first[live] * BLOCK + r
        chosen[bounds[live] + r] = t.moves[after[at], filled[at], state[live]]
        state[live] = t.follow[after[at], filled[at], state[live]]
    letters = np.array([*t.letters, ""], object)[chosen].tolist()
    close = ["I" * (END[s] // INSERT) for s in state.tolist()]
    return cost, [letters[a:b] + [c] for a, b, c in zip(bounds, bounds[1:], close)]


def counts(codes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Rows of each fault, and neighbours whose roles may not follow each other, for each conversation."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    kind, fault = codes % 4, codes // 4
    out = [np.bincount(owner[fault == f], minlength=len(bounds) - 1) for f in (1, 2, 3)]
    legal = np.zeros((4, 4), bool)
    for a, b in LEGAL:
        legal[KINDS.index(a), KINDS.index(b)] = True
    inside = owner[1:] == owner[:-1]
    wrong = inside & ~legal[kind[:-1], kind[1:]]
    return [*out, np.bincount(owner[1:][wrong], minlength=len(bounds) - 1)]


def rewrite(state: int, letters: list[str], roles: list[str], texts: list[str]) -> tuple[list[dict], int]:
    """The repaired rows from a state on, and the state behind them."""
    out = []
    for i, part in enumerate(letters):
        for letter in part:
            if letter == "D":
                continue
            if letter == "K":
                state = KEEP[state][roles[i][:1]]
                out.append({"role": roles[i], "text": texts[i]})
                continue
            state = NEXT[state]
            out.append({"role": "assistant" if state == 3 else "user", "text": texts[i] if letter == "R" else ""})
    return out, state


# -- sorted rows ------------------------------------------------------------------------------------


def _changes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Where a new value begins in a sorted column; nulls are equal to each other."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1]) if len(codes) else np.zeros(0, np.int64)


def _same_as_before(rows: pa.Table) -> np.ndarray:
    """Rows that repeat the row before: same conversation, turn, role and text."""
    same = np.zeros(rows.num_rows, bool)
    if rows.num_rows > 1:
        same[1:] = True
        for name in ("conv", "turn", "role", "digest"):
            new = np.zeros(rows.num_rows, bool)
            new[_changes(rows.column(name))] = True
            same &= ~new
    return same


def _codes(rows: pa.Table) -> np.ndarray:
    """Kind of role plus four times the first fault."""
    blank, cut, again = (rows.column(c).to_numpy() for c in ("blank", "cut", "again"))
    fault = np.where(blank, 1, np.where(again | _same_as_before(rows), 2, np.where(cut, 3, 0)))
    return rows.column("kind").to_numpy().astype(np.int64) + 4 * fault


def _turns(rows: pa.Table, bounds: np.ndarray) -> tuple[list, list, np.ndarray]:
    """Least and greatest turn (None: no turn) and number of different turns of each conversation."""
    turns = rows.column("turn").combine_chunks() if rows.num_rows else rows.column("turn")
    known = pc.is_valid(turns).to_numpy(zero_copy_only=False)
    value = pc.fill_null(turns, 0).to_numpy(zero_copy_only=False)
    lows, highs, many = [], [], np.zeros(len(bounds) - 1, np.int64)
    upto = np.concatenate([[0], np.cumsum(~known)])
    for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        a += int(upto[b] - upto[a])  # nulls come first
        lows.append(int(value[a]) if a < b else None)
        highs.append(int(value[b - 1]) if a < b else None)
        many[i] = 0 if a == b else 1 + int((value[a + 1 : b] != value[a : b - 1]).sum())
    return lows, highs, many


def _whole(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Results of conversations that are all there."""
    starts = _changes(rows.column("conv"))
    bounds = np.append(starts, rows.num_rows)
    codes = _codes(rows)
    cost, letters = solve(codes, bounds)
    lows, highs, many = _turns(rows, bounds)
    roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
    names = rows.column("conv").to_pylist()
    blank, duplicate, truncated, illegal = (c.tolist() for c in counts(codes, bounds))
    out = []
    for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        gaps = 0 if lows[i] is None else highs[i] - lows[i] + 1 - int(many[i])
        messages, _ = rewrite(0, letters[i], roles[a:b], texts[a:b])
        row = {"whole": True, "conv": names[a], "gaps": gaps, "blank": blank[i], "duplicate": duplicate[i]}
        row |= {"truncated": truncated[i], "illegal": illegal[i], "cost": int(cost[i]), "audit": "".join(letters[i])}
        out.append(row | {"messages": messages})
    yield pa.RecordBatch.from_pylist(out, schema=STAGED)


def _piece(rows: pa.Table, part: int, seq: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of one conversation."""
    low, high, many = _turns(rows, np.array([0, rows.num_rows]))
    ends = []
    for i in (0, rows.num_rows - 1):
        turn, role, digest = (rows.column(c)[i].as_py() for c in ("turn", "role", "digest"))
        ends.append(f"{turn}:{digest}:{role}")
    row = {"whole": False, "conv": rows.column("conv")[0].as_py(), "part": part, "seq": seq}
    row |= {"codes": _codes(rows).astype(np.uint8).tobytes(), "first": ends[0], "last": ends[1]}
    row |= {"low": low[0], "high": high[0], "turns": int(many[0])}
    row |= {"roles": rows.column("role").to_pylist(), "texts": rows.column("text").to_pylist()}
    yield pa.RecordBatch.from_pylist([row], schema=STAGED)


def _over_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations and pieces of one sorted range."""
    part, seq = TaskContext.get().partitionId(), 0
    held: pa.Table | None = None  # the conversation that is still open
    cut = True  # its beginning may be elsewhere: in the range before, or in a piece
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        starts = _changes(rows.column("conv"))
        if len(starts) > 1:
            low = 0
            if cut:
                low = int(starts[1])
                yield from _piece(rows.slice(0, low), part, seq)
                seq, cut = seq + 1, False
            if low < starts[-1]:
                yield from _whole(rows.slice(low, int(starts[-1]) - low))
            rows = rows.slice(int(starts[-1]))
        while rows.num_rows > PIECE_ROWS or (rows.num_rows > 1 and rows.nbytes > PIECE_BYTES):
            size = min(PIECE_ROWS, rows.num_rows - 1)  # the last row stays, to tell where the conversation ends
            yield from _piece(rows.slice(0, size), part, seq)
            rows, seq, cut = rows.slice(size).combine_chunks(), seq + 1, True
        held = rows
    if held is not None:
        yield from _piece(held, part, seq)


# -- conversations of several pieces ----------------------------------------------------------------


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Table]]:
    """The rows of one conversation after the other, from rows sorted by it."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        starts = _changes(rows.column("conv")).tolist()
        for a, b in zip(starts, starts[1:]):
            yield rows.slice(a, b - a)
        held = rows.slice(starts[-1])
    if held is not None:
        yield held



def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letters of each piece, and the counts of its conversation beside the first one."""
    for rows in _by_conversation(batches):
        pieces = rows.to_pylist()
        parts = [np.frombuffer(p["codes"], np.uint8).astype(np.int64) for p in pieces]
        many, low, high = 0, None, None
        for i, p in enumerate(pieces):
            if i and p["first"] == pieces[i - 1]["last"] and parts[i][0] // 4 != 1:
                parts[i][0] = parts[i][0] % 4 + 8  # repeats the row before the border
            if p["low"] is not None:
                many += p["turns"] - (high is not None and high == p["low"])
                low, high = p["low"] if low is None else low, p["high"]
        codes = np.concatenate(parts)
        bounds = np.array([0, len(codes)])
        cost, letters = solve(codes, bounds)
        found = [int(c[0]) for c in counts(codes, bounds)]
        gaps = 0 if low is None else high - low + 1 - many
        at, state = 0, 0
        out = []
        for i, p in enumerate(pieces):
            own = letters[0][at : at + len(parts[i]) + (i == len(pieces) - 1)]
            row = {"conv": p["conv"], "part": p["part"], "seq": p["seq"], "state": state, "letters": own, "opens": i == 0}
            if i == 0:
                row |= dict(zip(("blank", "duplicate", "truncated", "illegal"), found))
                row |= {"gaps": gaps, "cost": int(cost[0]), "audit": "".join(letters[0])}
            out.append(row)
            for code, part in zip(parts[i].tolist(), own):
                for letter in part:
                    if letter != "D":
                        state = KEEP[state][KINDS[code % 4]] if letter == "K" else NEXT[state]
            at += len(parts[i])
        yield pa.RecordBatch.from_pylist(out, schema=STITCHED)



def _rewrite_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for p in batch.to_pylist():
            messages, _ = rewrite(p["state"], p["letters"], p["roles"], p["texts"])
            out.append({"conv": p["conv"], "part": p["part"], "seq": p["seq"], "messages": messages})
        yield pa.RecordBatch.from_pylist(out, schema=PIECES)


@dataclass
class Repaired:
    """``whole``: one row for each conversation that lay in one range, with its ``messages``; ``split``: the others without;
    ``pieces``: the messages of those, by ``part`` and ``seq``. The conversation is in ``conv``."""

    whole: DataFrame
    split: DataFrame
    pieces: DataFrame


def _marked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with what their faults depend on; ``again`` tells that role and text were there at an earlier turn."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.left("role", F.lit(1))
    kind = F.coalesce(*[F.when(initial == k, F.lit(i)) for i, k in enumerate(KINDS)], F.lit(OTHER))
    same = F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), F.lit("")), F.length("role"), "role", "digest")
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary"))).select(
        "*",
        F.md5(same.cast("binary")).alias("same"),
        F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")).alias("place"),
    )
    # Narrow: what is there at several turns. Equal rows of one turn are neighbours and found later.
    seen = rows.groupBy("same").agg(F.min("place").alias("earliest"), F.max("place").alias("latest"))
    repeated = scratch.write(seen.where("earliest < latest").select(F.col("same").alias("_same"), "earliest"), "repeated")
    joined = skew.lookup_measured(rows, repeated, "same", "_same", ["same", "turn"])
    return joined.select(
        "conv",
        "turn",
        "role",
        "text",
        "digest",
        kind.cast("int").alias("kind"),
        (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(*STOPS)).alias("cut"),
        F.coalesce(F.col("place") > F.col("earliest"), F.lit(False)).alias("again"),
    )


def repair(
    rows: DataFrame, scratch: Scratch, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> Repaired:
    """Faults, cheapest edits and repaired messages of every conversation that has rows."""
    spark = rows.sparkSession
    space = F.lit(" ")
    plain = rows.select(
        rows[quoted(conv)].cast("long").alias("conv"),
        rows[quoted(turn)].cast("long").alias("turn"),
        F.coalesce(rows[quoted(role)], space).alias("role"),
        F.coalesce(rows[quoted(text)], space).alias("text"),
    )
    order = ["conv", "turn", "role", "digest"]
    marked = _marked(plain, scratch)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Equal rows, however many, are told apart by their places, so they spread over ranges too.
    dealt = marked.repartitionByRange(ranges, *order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    staged = scratch.write(dealt.mapInArrow(_over_range, from_arrow_schema(STAGED)), "staged")
    counted = [name for name, _ in _COUNTS]
    pieces = staged.where(~F.col("whole"))
    heads = pieces.select("conv", "part", "seq", "codes", "first", "last", "low", "high", "turns")
    sorted_ = heads.repartition(ranges, "conv").sortWithinPartitions("conv", "part", "seq")
    stitched = scratch.write(sorted_.mapInArrow(_stitch, from_arrow_schema(STITCHED)), "stitched")
    ways = stitched.select("part", "seq", "state", "letters")
    rewritten = pieces.select("conv", "part", "seq", "roles", "texts").join(ways, ["part", "seq"])
    return Repaired(
        staged.where("whole").select("conv", *counted, "messages"),
        stitched.where("opens").select("conv", *counted),
        rewritten.mapInArrow(_rewrite_pieces, from_arrow_schema(PIECES)),
    )


def joined_digests(pieces: DataFrame) -> DataFrame:
    """SHA-256 of the newline-joined ``role:text`` of conversations of several pieces, read piece by piece in order."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        name, digest, empty = None, None, True
        for batch in batches:
            starts = set(_changes(batch.column(0)).tolist())
            for i, p in enumerate(batch.to_pylist()):
                if digest is None or (p["conv"] != name if i == 0 else i in starts):
                    if digest is not None:
                        made.append((name, digest.hexdigest()))
                    name, digest, empty = p["conv"], hashlib.sha256(), True
                for m in p["messages"]:
                    digest.update(("" if empty else "\n").encode() + f"{m['role']}:{m['text']}".encode())
                    empty = False
            if made:
                yield _digest_batch(made)
                made = []
        if digest is not None:
            yield _digest_batch([(name, digest.hexdigest())])

    # By number, so that a query's own limits on ranges hold here too.
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(n, "conv").sortWithinPartitions("conv", "part", "seq")
    return dealt.mapInArrow(run, "conv long, repaired_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    names, digests = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(digests)], names=["conv", "repaired_sha256"])
