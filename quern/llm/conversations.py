"""Repair of conversations' structure by shortest paths: the cheapest edits that make a conversation ``(s?(ua)+)?``.

A node is a place between two rows and the state there (nothing yet, after s, after u, after a); its arcs keep, rerole or
delete the next row or insert one. Costs are integers up to 6, so distances to the end are found by Dial's bucket queue;
the audit is the walk from the start that takes, of the arcs on a shortest path, the one with the first letter.

Rows that must go (blank or repeated) cost 2 in every state and go at once, since D is the first letter, so the graph has
the other rows only, and copies of a row are a count.

Conversations lie in a range sort, each whole in one task but for those at a task's ends and those of over ``CHUNK`` rows
or 8 MB, which may hold any share of the table. These are cut into chunks. A chunk's distances from each state at its
start to each at its end are a 4 x 4 table that its own task finds; a conversation's tables are chained from its end, so
that each chunk learns its distances to the end; and the chunks are walked in order, which the SHA-256 of the repaired
text needs anyway: that task reads one chunk after the other and holds one at a time (and the audit, which is one value).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quern.llm.common import cut, text_key, tidy, unused

#: Rows of a conversation, and bytes of their texts, that a task holds at a time.
CHUNK, CHUNK_BYTES = 4096, 8 << 20

START, S, U, A = range(4)
INITIALS = "sua"
ROLES = {U: "user", A: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The state after a row of that initial, where one may follow.
AFTER = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
#: The one state that a user or assistant row can lead to.
FORCED = {START: U, S: U, U: A, A: U}
FAR = 1 << 60
LEGAL = {"su", "ua", "au"}
#: Distances at the end of a conversation.
END = (0, FAR, FAR, 0)


@lru_cache(None)
def arcs(state: int, row: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a row, by letter; row: 0 to 2 for an initial of s, u, a, 3 for another,
    and 4 more if it is truncated."""
    initial, more = "sua?"[row & 3], TRUNCATED * (row >> 2)
    out = [("D", DELETE, state)]
    if (state, initial) in AFTER:
        out.append(("K", KEEP + more, AFTER[state, initial]))
    return [*out, ("R", REROLE + more, FORCED[state])]


#: For each kind of row and state after it: (state before, least cost).
BACK = [[[(p, min(c for _, c, q in arcs(p, row) if q == to)) for p in range(4) if any(q == to for _, _, q in arcs(p, row))] for to in range(4)] for row in range(8)]
INTO = [[p for p in range(4) if FORCED[p] == to] for to in range(4)]
LARGEST = REROLE + TRUNCATED


def distances(rows: bytes, ends: tuple[int, ...] = END) -> list[int]:
    """The cost from each node (4 * place + state) to the end, by Dial's bucket queue; ends: the cost from each state
    after the last row."""
    n = len(rows)
    out = [FAR] * (4 * n + 4)
    least = min(ends)
    size = max([LARGEST, *(e - least for e in ends if e < FAR)]) + 1
    buckets: list[list[int]] = [[] for _ in range(size)]
    left = 0
    for q, e in enumerate(ends):
        if e < FAR:
            out[4 * n + q] = e - least
            buckets[e - least].append(4 * n + q)
            left += 1
    d = 0
    while left:
        bucket = buckets[d % size]
        while bucket:
            v = bucket.pop()
            left -= 1
            if out[v] != d:
                continue
            place, q = v >> 2, v & 3
            steps = [(4 * place + p, INSERT) for p in INTO[q]]
            if place:
                steps += [(4 * place - 4 + p, c) for p, c in BACK[rows[place - 1]][q]]
            for u, c in steps:
                if d + c < out[u]:
                    out[u] = d + c
                    buckets[(d + c) % size].append(u)
                    left += 1
        d += 1
    return [x + least if x < FAR else FAR for x in out]


def walk(rows: bytes, dist: list[int], state: int, last: bool) -> tuple[list[tuple[str, int]], int]:
    """The tight arcs from the first place, the first letter first: (letter, state after it) each, and the state at the
    end. Rows are inserted after the last row only in the conversation's last chunk: what stands there is the next one's."""
    n, place, out = len(rows), 0, []
    while place < n or last and dist[4 * n + state]:
        here = dist[4 * place + state]
        moves = [("I", INSERT, FORCED[state], place)]
        if place < n:
            moves += [(letter, cost, to, place + 1) for letter, cost, to in arcs(state, rows[place])]
        letter, _, state, place = next(m for m in sorted(moves) if here == m[1] + dist[4 * m[3] + m[2]])
        out.append((letter, state))
    return out, state


@lru_cache(1 << 14)
def _solved(rows: bytes) -> tuple[int, list[tuple[str, int]]]:
    dist = distances(rows)
    return dist[START], walk(rows, dist, START, True)[0]


def solved(rows: bytes) -> tuple[int, list[tuple[str, int]]]:
    """The least cost of a whole conversation's rows and the walk; short ones are alike, so they are remembered."""
    return _solved(rows) if len(rows) <= 64 else _solved.__wrapped__(rows)


class Piece:
    """Consecutive rows of a conversation: counts, the rows that may stay, and how many must go before each of them."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = None
        self.first = self.last = None
        self.rows, self.gone, self.lines, self.bytes = bytearray(), [0], [], 0

    def take(self, turn, role: str, text: str, n: int, first: bool, blank: bool, truncated: bool) -> None:
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        initial = role[:1]
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += n - 1  # copies follow each other
        self.last = initial
        if blank:
            self.blank += n
            self.gone[-1] += n
            return
        if first:
            self.truncated += truncated
            self.rows.append((INITIALS.find(initial) if initial and initial in INITIALS else 3) + 4 * truncated)
            self.lines.append((role, text))
            self.bytes += len(role) + len(text) + 16
            self.gone.append(0)
        self.duplicate += n - first
        self.gone[-1] += n - first

    def repaired(self, moves: list[tuple[str, int]]) -> tuple[str, list[str]]:
        """The audit and the lines of the walk's rows."""
        audit, lines, i = ["D" * self.gone[0]], [], 0
        for letter, state in moves:
            audit.append(letter)
            if letter == "I":
                lines.append(f"{ROLES[state]}:")
                continue
            role, text = self.lines[i]
            i += 1
            audit.append("D" * self.gone[i])
            if letter != "D":
                lines.append(f"{role if letter == 'K' else ROLES[state]}:{text}")
        return "".join(audit), lines

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


#: A finished conversation, or (done: false) a chunk.
PIECE = (
    "done boolean, p long, chunk long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, "
    "least long, most long, turns long, first string, last string, rows binary, gone array<long>, roles array<string>, texts array<string>"
)
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a task as finished conversations, and as chunks of those that may go on in the next task, come from
    the one before, or are long."""
    conv, piece, whole, chunk, p, out, size = None, None, False, 0, 0, [], 0

    def chunked() -> dict:
        nonlocal chunk
        x = piece
        chunk += 1
        return {
            "conv_id": conv[0], "done": False, "p": p, "chunk": chunk, "blank": x.blank, "duplicate": x.duplicate, "truncated": x.truncated, "illegal": x.illegal, "least": x.least, "most": x.most, "turns": x.turns,
            "first": x.first, "last": x.last, "rows": bytes(x.rows), "gone": x.gone, "roles": [r for r, _ in x.lines], "texts": [t for _, t in x.lines],
        }

    def finished() -> dict:
        x = piece
        cost, moves = solved(bytes(x.rows))
        audit, lines = x.repaired(moves)
        return {
            "conv_id": conv[0], "done": True, "gaps": x.gaps(), "blank": x.blank, "duplicate": x.duplicate, "truncated": x.truncated, "illegal": x.illegal, "cost": cost + DELETE * sum(x.gone), "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest(),
        }

    for b in batches:
        p = b.column("p")[0].as_py() if b.num_rows else p
        for c, *row in zip(*(b.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "n", "first", "blank", "truncated"))):
            if conv is None or conv[0] != c:
                if conv is not None:
                    out.append(finished() if whole else chunked())
                    size += piece.bytes + 200
                whole, conv, piece = conv is not None, (c,), Piece()
            if row[3]:
                piece.take(*row)
            if len(piece.rows) >= CHUNK or piece.bytes >= CHUNK_BYTES:
                out.append(chunked())
                size += piece.bytes
                whole, piece = False, Piece()
            if len(out) >= 1024 or size >= CHUNK_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
    if conv is not None:
        out.append(chunked())
        yield pa.RecordBatch.from_pylist(out, schema)


def _table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs from each state at a chunk's start to each at its end."""
    for b in batches:
        found = []
        for rows in b.column("rows").to_pylist():
            each = [distances(rows, tuple(0 if q == to else FAR for q in range(4)))[:4] for to in range(4)]
            found.append([each[to][q] for q in range(4) for to in range(4)])
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("p"), b.column("chunk"), pa.array(found, pa.list_(pa.int64()))], ["conv_id", "p", "chunk", "costs"])


def _chained(t: pa.Table) -> pa.Table:
    """A conversation's tables (128 bytes a chunk) from its end: each chunk's distances from its end on."""
    rows = sorted(zip(t.column("p").to_pylist(), t.column("chunk").to_pylist(), t.column("costs").to_pylist()), reverse=True)
    ends, out = list(END), []
    for i, (p, chunk, costs) in enumerate(rows):
        out.append((p, chunk, ends, i == 0))
        ends = [min(min(costs[4 * q + to] + ends[to] for to in range(4)), FAR) for q in range(4)]
    cols = list(zip(*out))
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_()))], ["p", "chunk", "ends", "final"])


def _followed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Chunks by conversation and place: walked one after the other."""
    counts = None
    for b in batches:
        done = []
        for r in b.to_pylist():
            if counts is None:
                counts = {"conv_id": r["conv_id"], **dict.fromkeys(COUNTS, 0), "turns": 0}
                least = most = last = None
                state, audit, sha, any_line = START, [], hashlib.sha256(), False
            for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                counts[c] += r[c]
            if r["least"] is not None:
                counts["turns"] -= r["least"] == most
                least, most = r["least"] if least is None else least, r["most"]
            if r["first"] is not None:
                counts["illegal"] += last is not None and last + r["first"] not in LEGAL
                last = r["last"]
            x = Piece()
            x.rows, x.gone, x.lines = bytearray(r["rows"]), r["gone"], list(zip(r["roles"], r["texts"]))
            dist = distances(r["rows"], tuple(r["ends"]))
            if not audit:
                counts["cost"] += dist[state]
            counts["cost"] += DELETE * sum(x.gone)
            moves, state = walk(r["rows"], dist, state, r["final"])
            letters, lines = x.repaired(moves)
            audit.append(letters)
            for line in lines:
                sha.update(("\n" * any_line + line).encode("utf-8", "surrogatepass"))
                any_line = True
            if r["final"]:
                gaps = 0 if least is None else most - least + 1 - counts.pop("turns")
                done.append({**counts, "gaps": gaps, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})
                counts = None
        yield pa.RecordBatch.from_pylist(done, schema)


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conv_id.

    A conversation's rows are taken by turn, null first; rows of one turn by role and then by their text's hash, equal
    rows one after the other. ``copies`` names a column of how often a row stands there; a conversation whose rows all
    stand there 0 times is answered with zeros, an empty audit and the hash of the empty text. A null role or text is one
    space; null conv_ids are one conversation; an empty role has no initial. Very long texts and conversations are cut
    into chunks, with the same result. Repeated rows are duplicates. An empty table gives no rows; other columns are
    left out.
    """
    spark, kind = rows.sparkSession, rows.schema[conv_id].dataType
    n = F.coalesce(F.col(copies).cast("long"), F.lit(0)) if copies else F.lit(1).cast("long")
    (stands,) = unused(rows.columns, "stands")
    rows = rows.withColumn(stands, n)
    there = F.col(stands) > 0
    named = rows.select(
        F.col(conv_id).alias("conv_id"), F.when(there, F.col(turn).cast("long")).alias("turn"), F.when(there, F.coalesce(F.col(role).cast("string"), F.lit(" "))).otherwise("").alias("role"),
        F.when(there, F.coalesce(F.col(text).cast("string"), F.lit(" "))).otherwise("").alias("text"), F.col(stands).alias("n"),
    )
    # keys without nulls, so that the join below finds its rows where the aggregate left them
    keys = named.select("*", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("ck"), F.col("conv_id").isNull().alias("cn"), F.coalesce("turn", F.lit(0)).alias("tk"), F.col("turn").isNull().alias("tn"), *text_key(F.col("text")))
    by = ["ck", "cn", "tk", "tn", "role", "k1", "k2"]
    items = keys.groupBy(*by).agg(F.max("conv_id").alias("conv_id"), F.max("turn").alias("turn"), F.max("text").alias("text"), F.sum("n").alias("n"))
    seen = keys.where("n > 0").groupBy("ck", "cn", "role", "k1", "k2").agg(F.min(F.struct((~F.col("tn")).alias("known"), F.col("tk").alias("tk"))).alias("at"))
    seen = seen.select("ck", "cn", F.col("at.tk").alias("tk"), (~F.col("at.known")).alias("tn"), "role", "k1", "k2", F.lit(True).alias("first"))
    items = items.join(seen, by, "left")
    text_ = F.col("text")
    items = items.select(
        "conv_id", "turn", "role", "text", "n", F.coalesce("first", F.lit(False)).alias("first"), (~text_.rlike("[^\\x20\\x09-\\x0D]")).alias("blank"),
        (~text_.rlike("[.!?][\\x20\\x09-\\x0D]*\\z")).alias("truncated"), "k1", "k2",
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "k1", "k2")]
    dealt = cut(items.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("p", F.spark_partition_id().cast("long")))

    head = StructType([StructField("conv_id", kind)])
    whole = StructType([*head, *StructType.fromDDL(PIECE)])
    out = StructType([*head, *StructType.fromDDL("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")])
    arrow = _arrow(whole)
    pieces = cut(dealt.mapInArrow(tidy(lambda x: _pieces(x, arrow)), whole))
    chunks = pieces.where("not done")
    tables = chunks.select("conv_id", "p", "chunk", "rows").mapInArrow(tidy(_table), StructType([*head, *StructType.fromDDL("p long, chunk long, costs array<long>")]))
    ends = tables.groupBy("conv_id").applyInArrow(_chained, "p long, chunk long, ends array<long>, final boolean")
    ordered = chunks.join(ends, ["p", "chunk"]).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "p", "chunk")
    target = _arrow(out)
    followed = ordered.mapInArrow(tidy(lambda x: _followed(x, target)), out)
    return pieces.where("done").select(*out.names).unionAll(followed)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
