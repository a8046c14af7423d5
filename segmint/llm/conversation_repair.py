"""Repair of damaged conversations by a Viterbi search over edits.

The rows of a conversation, in order of turn, become a sequence of role
initials of the form (s?(ua)+)?; the cheapest edits are sought, and of equally
cheap ones the least in ASCII order. Four states say what the output ends
with: nothing (E), a system row (S), a user row (U), an assistant row (A).
The best way to each state is a leaf of a tree of back pointers with reference
counts. Branches that no state needs are freed; whenever all states share an
ancestor, the edits up to it are final and leave the tree. States that can no
longer win are given up, so that the states come to share one.

Conversations lie in range partitions by (conversation, turn), so one that
holds a third of all rows spreads over many tasks. A conversation that lies
whole in a task is repaired there. Of others each segment gives, for every
state it may begin in, the best way to each state it may end in; these small
tables are chained per conversation, and the segments are repaired with the
states found.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, lean_group, materialize, text_rows

E, S, U, A = range(4)
#: Costs of edits.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows and bytes of text of a segment, at most (a longer row goes alone).
SEGMENT_ROWS, SEGMENT_BYTES = 20_000, 4 << 20
#: What must be appended in each state for a legal end.
TAILS = {E: "", S: "II", U: "I", A: ""}
#: state -> its successor by a user or an assistant row.
NEXT = {E: U, S: U, U: A, A: U}
#: SURPASSED[p][q]: whatever follows, ending from state p costs at most this
#: much more than from state q. q is given up when it costs more than that
#: over p.
SURPASSED = {
    E: {S: 0, U: INSERT, A: 0},
    S: {E: 2 * INSERT, U: INSERT, A: 2 * INSERT},
    U: {E: INSERT + DELETE, S: INSERT, A: INSERT},
    A: {E: DELETE, S: 0, U: INSERT},
}
WHITE = " \t\n\x0b\f\r"


# -------------------------------------------------------------------- search
def _moves() -> list[list[tuple[int, int, str, int]]]:
    """code of a row -> (from, to, edits, cost). A code is the role's initial
    (0 other, 1 s, 2 u, 3 a) + 4 if the row must go + 8 if it is truncated.
    Inserts come right before a row's own edit; more than these never pay."""
    table = []
    for code in range(16):
        initial, must, extra = code & 3, code & 4, TRUNCATED if code & 8 else 0
        rows = []
        for begin in (E, S, U, A):
            q = begin
            for k in range(3 if begin in (E, S) else 2):
                if k:
                    q = NEXT[q]
                edits = [(q, "D", DELETE)]
                if not must:
                    edits.append((NEXT[q], "R", RENAME + extra))
                    if initial == 1 and q == E:
                        edits.append((S, "K", extra))
                    if initial in (2, 3) and NEXT[q] == initial:
                        edits.append((NEXT[q], "K", extra))
                rows += [(begin, to, "I" * k + e, INSERT * k + c) for to, e, c in edits]
        table.append(rows)
    return table


MOVES = _moves()


class Survivors:
    """The best ways to each state, as a tree of back pointers. ``push`` takes
    a row and gives the edits that became final: (state before, edits, state
    after), one for each row, in order.

    Strings that lead to two states at the same row are never one the start
    of the other (both end with that row's own edit), so their order stays
    when both go on. ``rank`` keeps that order of the complete unresolved
    strings; a tie needs no walk back to compare them."""

    def __init__(self, start: int = E):
        self.parent, self.move, self.kids, self.kid_mix = [-1], [None], [0], [0]
        self.free: list[int] = []
        self.root = 0
        self.cost, self.node, self.rank = {start: 0}, {start: 0}, {start: 0}

    def push(self, code: int) -> list[tuple[int, str, int]]:
        best: dict[int, tuple] = {}
        for begin, to, edits, price in MOVES[code]:
            if begin in self.cost:
                key = (self.cost[begin] + price, self.rank[begin], edits, begin)
                if to not in best or key < best[to]:
                    best[to] = key
        kept = [q for q in best if not any(best[q][0] > best[p][0] + more for p, row in SURPASSED.items() if p in best for r, more in row.items() if r == q)]
        old = self.node
        self.node = {q: self._grow(old[best[q][3]], (best[q][3], best[q][2], q)) for q in kept}
        for n in old.values():
            self._drop(n)
        self.cost = {q: best[q][0] for q in kept}
        order = sorted(kept, key=lambda q: best[q][1:3])
        self.rank = {q: k for k, q in enumerate(order)}
        return self._settled()

    def close(self, end: int) -> list[tuple[int, str, int]]:
        """The edits not yet given out on the best way to state ``end``."""
        out, n = [], self.node[end]
        while n != self.root:
            out.append(self.move[n])
            n = self.parent[n]
        return out[::-1]

    def end(self) -> int:
        """The state of the best legal end."""
        return min(self.cost, key=lambda q: (self.cost[q] + INSERT * len(TAILS[q]), self.rank[q]))

    def _grow(self, parent: int, move: tuple) -> int:
        if self.free:
            n = self.free.pop()
            self.parent[n], self.move[n], self.kids[n], self.kid_mix[n] = parent, move, 0, 0
        else:
            n = len(self.parent)
            self.parent.append(parent)
            self.move.append(move)
            self.kids.append(0)
            self.kid_mix.append(0)
        self.kids[parent] += 1
        self.kid_mix[parent] ^= n  # of an only child this is the number
        return n

    def _drop(self, n: int) -> None:
        """Frees a node without children, and what only it needed."""
        while n != self.root and self.kids[n] == 0:
            p = self.parent[n]
            self.kids[p] -= 1
            self.kid_mix[p] ^= n
            self.free.append(n)
            n = p

    def _settled(self) -> list[tuple[int, str, int]]:
        out = []
        while self.kids[self.root] == 1:
            child = self.kid_mix[self.root]
            out.append(self.move[child])
            self.free.append(self.root)
            self.root = child
        return out

    @property
    def held(self) -> int:
        """Nodes of the tree."""
        return len(self.parent) - len(self.free)


def repair_rows(codes: bytes, rows: list[tuple[str, str]], start: int = E, end: int | None = None, last: bool = True) -> tuple[str, int, list[tuple[str, str]]]:
    """(audit, cost, repaired (role, text) rows) of a segment that begins in
    state ``start`` and ends in ``end`` (None: the best legal end)."""
    audit, out = [], []
    names = {U: "user", A: "assistant"}
    source = iter(rows)

    def take(moves):
        for q, edits, to in moves:
            audit.append(edits)
            role, text = next(source)
            for e in edits:
                if e == "D":
                    continue
                q = to if e == "K" else NEXT[q]
                out.append((names[q], "") if e == "I" else (role if e == "K" else names[q], text))

    search = Survivors(start)
    for c in codes:
        take(search.push(c))
    end = search.end() if end is None else end
    take(search.close(end))
    tail = TAILS[end] if last else ""
    q = end
    for _ in tail:
        q = NEXT[q]
        out.append((names[q], ""))
    return "".join([*audit, tail]), search.cost[end] + INSERT * len(tail), out


# ---------------------------------------------------------------------- rows
def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of the rows left after damage by
    crc32("conv_id:turn") % 20: 0 drops the row, 1 empties its text, 2 takes
    its [.!?] away, 3 repeats it (copies = 2), 4 sets the role user. Null
    roles and texts count as one space, and so do null ids and turns in that
    string; the columns conv_id and turn keep their nulls."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return conversations.where(k != 0).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(k == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(k == 3, 2).otherwise(1).alias("copies")
    )


def faults(rows: DataFrame) -> DataFrame:
    """One row for equal rows, with ``copies`` added up, ``again`` (its role
    and text occur at an earlier turn of the conversation), ``blank``,
    ``cut`` (truncated) and ``initial`` (0 other, 1 s, 2 u, 3 a).

    Copies are added up before the shuffle and rows with the same role and
    text are found by an aggregate of hashes, so no group of copies meets in
    one task. Null turns come before all others."""
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    one = one.withColumn("_h", F.md5(F.col("text").cast("binary")))
    seen = one.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_h").alias("_k")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("turn").alias("_least"), F.max(F.col("turn").isNull()).alias("_null")
    )
    both = one.join(seen.where("_n > 1"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_h") == F.col("_k")), "left")
    again = F.col("turn").isNotNull() & F.coalesce(F.col("_null") | (F.col("turn") > F.col("_least")), F.lit(False))
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    return both.select(
        "conv_id", "turn", "role", "text", "copies", again.alias("again"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0).alias("initial"),
    )


STATS = ("n_rows", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal")
LEGAL = {(1, 2), (2, 3), (3, 2)}


class Segment:
    """Rows of one conversation in order, with their faults counted."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.codes, self.size = conv_id, [], bytearray(), 0
        self.first_turn = self.last_turn = self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role, text, initial, again, blank, cut) -> None:
        must = blank or again
        if blank:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
        if self.codes and (self.codes[-1] & 3, initial) not in LEGAL:
            self.illegal += 1
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        if not self.codes:
            self.first_turn = turn
        self.last_turn = turn
        self.codes.append(initial + (4 if must else 8 if cut else 0))
        self.rows.append((role, text))
        self.size += len(text)

    def full(self) -> bool:
        return len(self.rows) >= SEGMENT_ROWS or self.size >= SEGMENT_BYTES

    def record(self, part: int, seg: int, whole: bool) -> dict:
        out = {
            "conv_id": self.conv_id, "part": part, "seg": seg, "whole": whole, "n_rows": len(self.rows), "low": self.low, "high": self.high, "turns": self.turns,
            "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "first_turn": self.first_turn, "last_turn": self.last_turn,
            "first_initial": self.codes[0] & 3, "last_initial": self.codes[-1] & 3,
        }
        if whole:
            audit, cost, rows = repair_rows(bytes(self.codes), self.rows)
            return out | {"audit": audit, "cost": cost, "repaired": [{"role": r, "text": t} for r, t in rows]}
        ways = []
        for start in (E, S, U, A):
            search = Survivors(start)
            for c in self.codes:
                search.push(c)
            ways += [{"start": start, "end": q, "cost": search.cost[q], "rank": search.rank[q]} for q in search.cost]
        return out | {"codes": bytes(self.codes), "ways": ways, "repaired": [{"role": r, "text": t} for r, t in self.rows]}


ROWS = "array<struct<role: string, text: string>>"
WAYS = "array<struct<start: int, end: int, cost: bigint, rank: int>>"
RECORD = (
    "part int, seg int, whole boolean, n_rows bigint, low bigint, high bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "first_turn bigint, last_turn bigint, first_initial int, last_initial int, audit string, cost bigint, codes binary, "
    f"ways {WAYS}, repaired {ROWS}"
)


def arrow_schema(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def segments(told: DataFrame) -> DataFrame:
    """The conversations of ``faults`` rows as segments. ``whole`` segments
    are repaired conversations; others have their rows as they came in
    ``repaired``, their ``codes``, and the ``ways`` through them."""
    import pyarrow as pa

    keys = ["conv_id", "turn", "role", "text"]
    ddl = f"conv_id {told.schema['conv_id'].dataType.simpleString()}, {RECORD}"
    schema = arrow_schema(ddl)

    @lean
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        now, seg, first, size, out = None, 0, True, 0, []
        for columns in text_rows(batches, (*keys, "copies", "initial", "again", "blank", "cut")):
            for conv_id, turn, role, text, copies, initial, again, blank, cut in zip(*columns):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.record(part, seg, seg == 0 and not first))
                        size += now.size
                        first = False
                    now, seg = Segment(conv_id), 0
                for k in range(copies):
                    if now.full():
                        out.append(now.record(part, seg, False))
                        size += now.size
                        now, seg = Segment(conv_id), seg + 1
                    now.add(turn, role, text, initial, again or k > 0, blank, cut)
                    if size > SEGMENT_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        size, out = 0, []
        if now is not None:  # it may go on in the next partition
            out.append(now.record(part, seg, False))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return told.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, ddl)


def chained(parts: DataFrame) -> DataFrame:
    """conv_id, part, seg, start, end, last of every segment that is not whole:
    the states between which the best repair passes it. A group holds sixteen
    numbers for each segment of a conversation."""
    import pyarrow as pa

    ddl = f"conv_id {parts.schema['conv_id'].dataType.simpleString()}, part int, seg int, start int, end int, last boolean"
    schema = arrow_schema(ddl)

    @lean_group
    def run(t):
        rows = sorted(t.to_pylist(), key=lambda r: (r["part"], r["seg"]))
        cost, rank, back = {E: 0}, {E: 0}, []
        for r in rows:
            best: dict[int, tuple] = {}
            for w in r["ways"]:
                q = w["start"]
                if q in cost:
                    key = (cost[q] + w["cost"], rank[q], w["rank"], q)
                    if w["end"] not in best or key < best[w["end"]]:
                        best[w["end"]] = key
            cost = {q: k[0] for q, k in best.items()}
            rank = {q: n for n, q in enumerate(sorted(best, key=lambda q: best[q][1:3]))}
            back.append({q: k[3] for q, k in best.items()})
        q = min(cost, key=lambda q: (cost[q] + INSERT * len(TAILS[q]), rank[q]))
        out = []
        for k in range(len(rows) - 1, -1, -1):
            r = rows[k]
            out.append({"conv_id": r["conv_id"], "part": r["part"], "seg": r["seg"], "start": back[k][q], "end": q, "last": k == len(rows) - 1})
            q = back[k][q]
        return pa.Table.from_pylist(out, schema)

    return parts.where("NOT whole").select("conv_id", "part", "seg", "ways").groupBy("conv_id").applyInArrow(run, ddl)


def repair(told: DataFrame) -> DataFrame:
    """Segments of all conversations in ``faults`` rows, repaired: conv_id,
    part and seg (their order), whole, the counts of ``STATS``, first_turn,
    last_turn, first_initial, last_initial, audit, cost, repaired. An empty
    table gives none."""
    import pyarrow as pa

    parts = materialize(segments(told), "conversation-segments")
    found = chained(parts).withColumnRenamed("conv_id", "_c").withColumnRenamed("part", "_p").withColumnRenamed("seg", "_s")
    open_ = parts.where("NOT whole").join(found, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")) & (F.col("seg") == F.col("_s"))).drop("_c", "_p", "_s")
    names = [c for c in parts.columns if c not in ("codes", "ways")]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema if f.name in names)
    schema = arrow_schema(ddl)

    @lean
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                r["audit"], r["cost"], rows = repair_rows(r["codes"], [(x["role"], x["text"]) for x in r["repaired"]], r["start"], r["end"], r["last"])
                r["repaired"] = [{"role": x, "text": y} for x, y in rows]
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in names}], schema)

    return parts.where("whole").select(names).unionByName(open_.mapInArrow(run, ddl))


def repaired_rows(repaired: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text of the repaired conversations."""
    before = Window.partitionBy("conv_id").orderBy("part", "seg").rowsBetween(Window.unboundedPreceding, -1)  # a row a segment
    each = repaired.withColumn("_before", F.coalesce(F.sum(F.size("repaired")).over(before), F.lit(0)))
    return each.select("conv_id", "_before", F.posexplode("repaired").alias("_k", "_r")).select("conv_id", (F.col("_before") + F.col("_k") + 1).alias("place"), "_r.role", "_r.text")


# ------------------------------------------------------------- conversations
def _lines(rows: str) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")


def _gaps(low: Column, high: Column, turns: Column) -> Column:
    return F.coalesce(high - low + 1 - turns, F.lit(0)).cast("long")


DIGEST = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of every conversation. Whole ones are read as they are;
    the segments of others pass in order through one task, one at a time."""
    import pyarrow as pa

    whole = repaired.where("whole").select(
        "conv_id", _gaps(F.col("low"), F.col("high"), F.col("turns")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(_lines("repaired").cast("binary"), 256).alias("repaired_sha256")
    )
    ddl = f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, {DIGEST}"
    schema = arrow_schema(ddl)
    added = ("blank", "duplicate", "truncated", "illegal", "cost")

    @lean
    def run(batches):
        now = last = digest = None

        def row():
            low, high, turns = now["low"], now["high"], now["turns"]
            told = {"conv_id": now["conv_id"], "gaps": 0 if low is None else high - low + 1 - turns, "audit": "".join(now["audit"]), "repaired_sha256": digest.hexdigest()}
            return pa.RecordBatch.from_pylist([told | {k: now[k] for k in added}], schema)

        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                if now is None or now["conv_id"] != r["conv_id"]:
                    if now is not None:
                        yield row()
                    now, digest, empty = r | {"audit": [r["audit"]]}, hashlib.sha256(), True
                else:
                    for c in added:
                        now[c] += r[c]
                    now["illegal"] += (last["last_initial"], r["first_initial"]) not in LEGAL
                    now["turns"] += r["turns"] - (r["first_turn"] is not None and r["first_turn"] == last["last_turn"])
                    now["low"] = r["low"] if now["low"] is None else now["low"]
                    now["high"] = now["high"] if r["high"] is None else r["high"]
                    now["audit"].append(r["audit"])
                for x in r["repaired"]:
                    digest.update((("" if empty else "\n") + x["role"] + ":" + x["text"]).encode())
                    empty = False
                last = {c: r[c] for c in ("last_turn", "last_initial")}
        if now is not None:
            yield row()

    narrow = repaired.where("NOT whole").drop("whole", "n_rows")
    return whole.unionByName(narrow.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg").mapInArrow(run, ddl))


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Every conv_id of ``conversations`` (conv_id, turn, role, text) with the
    faults, the repair's cost and edits, and the repaired text's digest, after
    ``damage``.

    Rows without an id are one conversation, with the id null. Rows of one
    turn go by role, then text; equal rows are copies of each other. Rows
    without a turn come first and do not count in ``gaps``. A conversation
    without rows left has zeros, no edits and the digest of the empty string;
    an empty table gives no rows. Other columns do not matter."""
    found = digests(repair(faults(damage(conversations)))).withColumnRenamed("conv_id", "_c")
    ids = conversations.select("conv_id").distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
