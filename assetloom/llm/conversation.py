"""Repair of conversations: least-cost edits by min-plus products over a grammar that all conversations share.

Every row of a conversation becomes a symbol: the initial of its role and its first fault. Rows are put in order by one
range partitioning, so that a conversation of any size is cut into chunks of at most ``CHUNK`` symbols. Re-Pair names
the commonest pairs of adjacent symbols of the distinct chunks, round by round. A symbol's meaning is a transfer matrix
between the states of the pattern ``(s?(ua)+)?``: the least cost of editing what it stands for, and the edits as a
rope, that is the state in which the left part hands over to the right. Matrices are computed once per rule, from those
of its two parts, and serve every conversation in which the rule stands.

Ties go to the least string of edits, and the products keep that order without looking at strings: an insertion
belongs to the row it precedes, so each string of edits over the same rows ends in a row's own letter and none is a
prefix of another. Of two paths the left parts decide, and only if those are the same path the right parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Rows in a chunk; rounds of pair replacement (2 ** ROUNDS rows are one symbol at most); rules named in a round, the commonest.
CHUNK, ROUNDS, RULES = 4096, 12, 1024
#: A pair is named if it stands at least so often in the distinct chunks.
TIMES = 2
KEEP, REROLE, DELETE, INSERT, OPEN = 0, 2, 3, 2, 1
SPACE = " \t\n\v\f\r"

# states of the pattern: nothing yet, after s, after u, after a
START, S, U, A = range(4)
STATES = range(4)
NONE = 1 << 40
ROLES = "sua"
OK, TRUNCATED, BLANK, DUPLICATE = range(4)
_NEXT = {START: U, S: U, U: A, A: U}  # the state after a user or assistant row that the pattern wants
_AFTER = {START: "", U: "I", S: "II", A: ""}  # insertions that end a conversation


class Transfer:
    """Costs, handover states and order of edits between states, and what the symbol's rows add to the counts."""

    __slots__ = ("cost", "counts", "first", "last", "mid", "rank")

    def __init__(self, cost, mid, rank, counts, first, last):
        self.cost, self.mid, self.rank, self.counts, self.first, self.last = cost, mid, rank, counts, first, last


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def _row(symbol: int) -> Transfer:
    """Transfer of one row: insertions before it, then its own edit; ``mid`` holds the edits themselves."""
    role, fault = divmod(symbol, 4)
    own = {S: 0, U: 1, A: 2}
    cost, mid = [NONE] * 16, [""] * 16
    for p in STATES:
        state, before, edits = p, 0, ""
        for _ in range(3):
            options = [("D", state, DELETE)]
            if fault not in (BLANK, DUPLICATE):
                add = OPEN if fault == TRUNCATED else 0
                wanted = _NEXT[state]
                if own[wanted] == role or (state == START and role == 0):
                    options.append(("K", S if role == 0 else wanted, KEEP + add))
                options.append(("R", wanted, REROLE + add))
            for letter, q, price in options:
                if (before + price, edits + letter) < (cost[4 * p + q], mid[4 * p + q]):
                    cost[4 * p + q], mid[4 * p + q] = before + price, edits + letter
            state, before, edits = _NEXT[state], before + INSERT, edits + "I"
    rank = [0] * 16
    for p in STATES:
        for k, q in enumerate(sorted(STATES, key=lambda q: mid[4 * p + q])):
            rank[4 * p + q] = k
    return Transfer(cost, mid, rank, (int(fault == BLANK), int(fault == DUPLICATE), int(fault == TRUNCATED), 0), role, role)


def _product(x: Transfer, y: Transfer) -> Transfer:
    cost, mid, rank = [NONE] * 16, [0] * 16, [0] * 16
    for p in STATES:
        keys = []
        for q in STATES:
            c, r, m = min((x.cost[4 * p + m] + y.cost[4 * m + q], x.rank[4 * p + m], m) for m in STATES)
            cost[4 * p + q], mid[4 * p + q] = min(c, NONE), m
            keys.append((c >= NONE, r, y.rank[4 * m + q], q))
        for k, key in enumerate(sorted(keys)):
            rank[4 * p + key[3]] = k
    counts = tuple(a + b for a, b in zip(x.counts, y.counts, strict=True))
    return Transfer(cost, mid, rank, (*counts[:3], counts[3] + (not _legal(x.last, y.first))), x.first, y.last)


class Grammar:
    """Rules by round, as ``(left, right)`` of each new symbol, and the transfers of all symbols."""

    def __init__(self):
        self.parts: list[tuple[int, int] | None] = [None] * 16
        self.rounds: list[dict[tuple[int, int], int]] = []
        self.transfers = [_row(s) for s in range(16)]

    def add(self, rules: list[tuple[tuple[int, int], Transfer]]) -> None:
        """One round: pairs, the commonest first, with their transfers."""
        self.rounds.append({pair: len(self.parts) + k for k, (pair, _) in enumerate(rules)})
        self.parts += [pair for pair, _ in rules]
        self.transfers += [t for _, t in rules]

    def replaced(self, symbols: list[int], turn: int) -> list[int]:
        """Symbols with the pairs of one round replaced from the left; a pair yields to a commoner one that overlaps it."""
        rules, out, i, last = self.rounds[turn], [], 0, len(symbols) - 1
        while i < last:
            new = rules.get((symbols[i], symbols[i + 1]))
            if new is None or (i + 1 < last and rules.get((symbols[i + 1], symbols[i + 2]), new) < new):
                out.append(symbols[i])
                i += 1
            else:
                out.append(new)
                i += 2
        return out + symbols[i:]

    def compressed(self, symbols: list[int]) -> list[int]:
        for turn in range(len(self.rounds)):
            symbols = self.replaced(symbols, turn)
        return symbols

    def edits(self, symbol: int, p: int, q: int) -> str:
        """The rope of a symbol between two states, spelled out."""
        out, todo = [], [(symbol, p, q)]
        while todo:
            symbol, p, q = todo.pop()
            m = self.transfers[symbol].mid[4 * p + q]
            if self.parts[symbol] is None:
                out.append(m)
            else:
                left, right = self.parts[symbol]
                todo += [(right, m, q), (left, p, m)]
        return "".join(out)

    def chunk(self, symbols: list[int]) -> tuple[Transfer, list[str | None]]:
        """Transfer of a chunk, and the edits between any two states that it connects."""
        parts = self.compressed(symbols)
        steps = [self.transfers[parts[0]]]
        for s in parts[1:]:
            steps.append(_product(steps[-1], self.transfers[s]))
        total, audits = steps[-1], []
        for p in STATES:
            for q in STATES:
                if total.cost[4 * p + q] >= NONE:
                    audits.append(None)
                    continue
                pieces, at = [], q
                for k in range(len(parts) - 1, 0, -1):
                    m = steps[k].mid[4 * p + at]
                    pieces.append(self.edits(parts[k], m, at))
                    at = m
                pieces.append(self.edits(parts[0], p, at))
                audits.append("".join(reversed(pieces)))
        return total, audits


_RULE = "l int, r int, cost array<bigint>, mid array<int>, rank array<int>, counts array<bigint>, first int, last int"


def _evaluator(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x, y, _product(grammar.transfers[x], grammar.transfers[y])) for x, y in zip(batch["l"].to_pylist(), batch["r"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "l": pa.array([x for x, _, _ in rows], pa.int32()), "r": pa.array([y for _, y, _ in rows], pa.int32()),
                "cost": pa.array([t.cost for *_, t in rows], pa.list_(pa.int64())), "mid": pa.array([t.mid for *_, t in rows], pa.list_(pa.int32())),
                "rank": pa.array([t.rank for *_, t in rows], pa.list_(pa.int32())), "counts": pa.array([t.counts for *_, t in rows], pa.list_(pa.int64())),
                "first": pa.array([t.first for *_, t in rows], pa.int32()), "last": pa.array([t.last for *_, t in rows], pa.int32())})
    return run


def _replacer(grammar: Grammar):
    turn = len(grammar.rounds) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([grammar.replaced(x, turn) for x in batch.column(0).to_pylist()], pa.list_(pa.int32()))], names=["s"])
    return run


def learn_grammar(chunks: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> Grammar:
    """Re-Pair over the distinct strings of ``chunks`` (``seq``: letters from A), with the matrices of all rules.

    A round counts the pairs, names the commonest ``rules`` of those that occur ``TIMES`` times, and computes their
    matrices in one task; at most ``rules`` rows reach the driver. Pairs that get no name stay as they are.
    """
    grammar = Grammar()
    now = chunks.select("seq").distinct().select(F.transform(F.split("seq", ""), lambda x: F.ascii(x) - 65).alias("s"))
    for turn in range(rounds):
        if turn:
            now = now.mapInArrow(_replacer(grammar), "s array<int>")
        now = written(now.where(F.size("s") > 1), "symbols")
        pairs = (now.select(F.explode(F.arrays_zip(F.slice("s", 1, F.size("s") - 1).alias("l"), F.slice("s", 2, F.size("s") - 1).alias("r"))).alias("p"))
                 .groupBy("p.l", "p.r").agg(F.count("*").alias("n")).where(F.col("n") >= TIMES).orderBy(F.desc("n"), "l", "r").limit(rules))
        found = pairs.select("l", "r", "n").mapInArrow(_evaluator(grammar), _RULE).collect()
        if not found:
            break
        grammar.add([((x.l, x.r), Transfer(x.cost, x["mid"], x["rank"], tuple(x.counts), x["first"], x["last"])) for x in found])
    return grammar


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` after damage by crc32 of ``conv_id:turn`` by 20 (nulls count as one space).

    0 drops the row, 1 empties its text, 2 removes the signs that end sentences, 3 repeats it, 4 makes it a user's.
    """
    named = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (conv_id, turn)]
    out = rows.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), *[F.coalesce(F.col(f"`{a}`").cast("string"), F.lit(" ")).alias(b) for a, b in ((role, "role"), (text, "text"))],
                      (F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20).cast("int").alias("k"))
    return (out.where("k <> 0").withColumns({"text": F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
                                             "role": F.when(F.col("k") == 4, "user").otherwise(F.col("role"))})
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text"))


def _letters(counted: DataFrame) -> DataFrame:
    """``c``, ``g`` (ascending in the order of the rows) and ``letter`` of every row."""
    # the first turn of each text: nulls come first
    low = counted.groupBy("c", "r", "dig").agg(F.max(F.col("t").isNull()).alias("no_turn"), F.min("t").alias("t"))
    first = low.select(F.col("c").alias("fc"), F.col("r").alias("fr"), F.col("dig").alias("fdig"), F.when(~F.col("no_turn"), F.col("t")).alias("ft"))
    # all four columns are keys, so that a text or conversation that stands very often is not one group
    on = F.col("c").eqNullSafe(F.col("fc")) & (F.col("r") == F.col("fr")) & (F.col("dig") == F.col("fdig")) & F.col("t").eqNullSafe(F.col("ft"))
    each = counted.join(first, on, "left").select("c", "t", "r", "dig", "blank", "open", F.col("fr").isNotNull().alias("is_first"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    initial = F.instr(F.lit(ROLES), F.substring("r", 1, 1))
    role = F.when((F.col("r") == "") | (initial == 0), 3).otherwise(initial - 1)
    fault = F.when(F.col("blank"), BLANK).when(~F.col("is_first") | (F.col("k") > 1), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(OK)
    order = ["c", "t", "r", "dig", "k"]
    return (each.withColumn("letter", F.char(role * 4 + fault + 65)).repartitionByRange(*order).sortWithinPartitions(*order)
            .select("c", "letter", F.monotonically_increasing_id().alias("g")))


_CHUNK = "c {c}, p bigint, b bigint, cost array<bigint>, rank array<int>, audits array<string>, counts array<bigint>, first int, last int"


def _chunk_evaluator(grammar: Grammar):
    def evaluate(seq: str):
        t, audits = grammar.chunk([ord(x) - 65 for x in seq])
        return t.cost, t.rank, audits, t.counts, t.first, t.last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = lru_cache(4096)(evaluate)
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int32(), pa.int32()]
        names = ["cost", "rank", "audits", "counts", "first", "last"]
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                done = [kept(s) if len(s) <= 64 else evaluate(s) for s in part["seq"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *[pa.array([x[i] for x in done], k) for i, k in enumerate(kinds)]], names=["c", "p", "b", *names])
    return run


class _Path:
    """Best edits of the rows so far, to each state: costs, order, and strings as chains of pieces that share their past."""

    def __init__(self):
        self.cost, self.rank, self.chain = [0, NONE, NONE, NONE], [0, 1, 2, 3], [None] * 4
        self.counts, self.last = [0, 0, 0, 0], None

    def extend(self, cost, rank, audits, counts, first, last):
        new, chain, keys = [], [], []
        for q in STATES:
            c, r, p = min((self.cost[p] + cost[4 * p + q], self.rank[p], p) for p in STATES)
            new.append(min(c, NONE))
            chain.append((self.chain[p], audits[4 * p + q]) if c < NONE else None)
            keys.append((c >= NONE, r, rank[4 * p + q], q))
        self.rank = [0] * 4
        for k, key in enumerate(sorted(keys)):
            self.rank[key[3]] = k
        self.cost, self.chain = new, chain
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        if self.last is not None:
            self.counts[3] += not _legal(self.last, first)
        self.last = last

    def result(self) -> tuple[int, str]:
        q = min((q for q in STATES if self.cost[q] < NONE), key=lambda q: (self.cost[q] + INSERT * len(_AFTER[q]), self.rank[q]))
        pieces, at = [_AFTER[q]], self.chain[q]
        while at is not None:
            at, piece = at
            pieces.append(piece)
        return self.cost[q] + INSERT * len(_AFTER[q]), "".join(reversed(pieces))


_OUT = ("conv_id {c}, at bigint, edit string, role string, text string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")
_FIELDS = ("at", "edit", "role", "text", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
_TYPES = dict(zip(_FIELDS, [pa.int64(), *[pa.string()] * 3, *[pa.int64()] * 6, pa.string()], strict=True))


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in order: per conversation its own row, its chunks, its texts; out come the repaired rows."""
    out: list[tuple] = []
    room, kind_of_id = 1 << 24, None
    conv, path, gaps, audit, cursor, state, at = None, None, 0, None, 0, START, 0

    def flush():
        columns = [pa.array([x[0] for x in out], kind_of_id), *[pa.array([x[i + 1] for x in out], _TYPES[f]) for i, f in enumerate(_FIELDS)]]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", *_FIELDS])

    def head():
        nonlocal audit
        cost, audit = path.result()
        blank, duplicate, truncated, illegal = path.counts
        out.append((conv, 0, None, None, None, gaps, blank, duplicate, truncated, illegal, cost, audit))

    def insertions():
        nonlocal cursor, state, at
        while cursor < len(audit) and audit[cursor] == "I":
            cursor, state, at = cursor + 1, _NEXT[state], at + 1
            out.append((conv, at, "I", "user" if state == U else "assistant", "", *[None] * 7))

    def close():
        if audit is None:
            head()
        insertions()

    for batch in batches:
        kind_of_id = batch.schema.field("c").type
        columns = {n: batch[n].to_pylist() for n in batch.schema.names}
        for i, kind in enumerate(columns["kind"]):
            if kind == 0:
                if path is not None:
                    close()
                conv, gaps, path, audit, cursor, state, at = columns["c"][i], columns["gaps"][i], _Path(), None, 0, START, 0
            elif kind == 1:
                path.extend(*[columns[n][i] for n in ("cost", "rank", "audits", "counts", "first", "last")])
            else:
                if audit is None:
                    head()
                insertions()
                letter, role, text = audit[cursor], columns["r"][i], columns["x"][i]
                cursor += 1
                if letter != "D":
                    at += 1
                    if letter == "R":
                        state = _NEXT[state]
                        role = "user" if state == U else "assistant"
                    else:
                        state = {"s": S, "u": U, "a": A}[role[0]]
                    out.append((conv, at, letter, role, text, *[None] * 7))
                    room -= len(text)
            if len(out) >= 4096 or room <= 0:
                yield flush()
                out, room = [], 1 << 24
    if path is not None:
        close()
    if out:
        yield flush()


def repair(rows: DataFrame, ids: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Repaired conversations: ``conv_id, at, edit, role, text`` and, in the row with ``at`` 0, what was found and done.

    That row holds ``gaps`` (missing turns between the least and the largest), the numbers of ``blank``, ``duplicate``
    and ``truncated`` rows by first fault, of ``illegal`` neighbours, and ``cost`` and ``audit`` of the cheapest edits.
    Rows from 1 on are the repaired conversation in order. Rows stand in order by ``turn`` (nulls first; ties by role,
    then digest of the text); equal rows are duplicates. A null role or text counts as one space, a null ``conv_id`` is
    one conversation. ``ids`` names conversations that are returned even if they have no row. Conversations stand whole
    and in order within their partition. An empty table gives an empty result.

    Everything up to the chunks spreads over tasks whatever the size of a conversation. The last pass streams the rows
    of each conversation through one task, as it lays its text out in order; it holds the string of edits, no texts.
    """
    base = rows.select(F.col(f"`{conv_id}`").alias("c"), F.col(f"`{turn}`").alias("t"), *[F.coalesce(F.col(f"`{a}`").cast("string"), F.lit(" ")).alias(b) for a, b in ((role, "r"), (text, "x"))])
    trimmed = F.rtrim(F.col("x"), F.lit(SPACE))
    counted = written(base.select("c", "t", "r", F.unhex(F.md5("x")).alias("dig"), (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open"))
                      .groupBy("c", "t", "r", "dig").agg(F.max("blank").alias("blank"), F.max("open").alias("open"), F.count("*").alias("n")), "turns")
    letters = written(_letters(counted), "letters")
    place = F.col("g").bitwiseAND(F.lit((1 << 33) - 1))
    chunks = written(letters.groupBy("c", F.shiftright("g", 33).alias("p"), F.floor(place / CHUNK).alias("b"))
                     .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "letter"))), lambda x: x["letter"]), "").alias("seq")), "chunks")
    kind = counted.schema["c"].dataType.simpleString()
    evaluated = chunks.mapInArrow(_chunk_evaluator(learn_grammar(chunks)), _CHUNK.format(c=kind))
    own = counted.select("c", "t")
    if ids is not None:
        own = own.union(ids.select(F.col(f"`{conv_id}`").alias("c"), F.lit(None).cast(own.schema["t"].dataType).alias("t")))
    span = own.groupBy("c", "t").agg(F.lit(1)).groupBy("c").agg((F.max("t") - F.min("t") + 1 - F.count("t")).cast("long").alias("gaps"))
    parts = (span.select("c", F.lit(0).alias("kind"), F.coalesce("gaps", F.lit(0)).alias("gaps"))
             .unionByName(evaluated.withColumn("kind", F.lit(1)), allowMissingColumns=True)
             .unionByName(base.withColumns({"kind": F.lit(2), "dig": F.unhex(F.md5("x"))}), allowMissingColumns=True))
    return parts.repartition("c").sortWithinPartitions("c", "kind", "p", "b", "t", "r", "dig").mapInArrow(_edit_rows, _OUT.format(c=kind))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head, state, last = None, None, None
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kinds = [*[pa.int64()] * 6, pa.string()]
    done: list[tuple] = []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], last), *[pa.array([x[i + 1] for x in done], k) for i, k in enumerate([*kinds, pa.string()])]],
                                          names=[*names, "repaired_sha256"])

    for batch in batches:
        last = batch.schema.field("conv_id").type
        at, roles, texts = batch["at"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist()
        for i, k in enumerate(at):
            if k == 0:
                if head:
                    done.append((*head, state.hexdigest()))
                head, state = tuple(batch[n][i].as_py() for n in names), sha256()
            else:
                state.update(f"{'' if k == 1 else chr(10)}{roles[i]}:{texts[i]}".encode())
        if done:
            yield flush()
            done = []
    if head:
        done.append((*head, state.hexdigest()))
        yield flush()


def digested(repaired: DataFrame) -> DataFrame:
    """One row per conversation of :func:`repair`: what was found, ``cost``, ``audit`` and the SHA-256 of the repaired rows."""
    c = repaired.schema["conv_id"].dataType.simpleString()
    return repaired.mapInArrow(_digest, f"conv_id {c}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")

