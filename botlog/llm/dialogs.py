"""Conversation structure repair: the cheapest edits that give every
conversation the roles ``(s?(ua)+)?``, by a square-root checkpointed dynamic
program.

Rows of a conversation are read by turn (nulls first; ties by role, then by
the SHA-256 of the text, so that equal rows are adjacent). A row's first fault
counts: blank, duplicate (its role and text stand on an earlier row) or
truncated. Edits are Keep (0), Rerole to user or assistant (2), Delete (3, the
only edit of blank and duplicate rows) and Insert of an empty user or assistant
turn (2); a truncated row that stays adds 1. Of the cheapest edit strings the
ASCII-least is taken (D < I < K < R).

The program has four states (nothing yet, after system, after user, after
assistant). ``cost vector`` below means: least cost of the rest, by state. Only
vectors at checkpoints are stored; the walk forward recomputes the vectors of
one block at a time and takes the least tight edit. This is done twice, once
over the cluster and once inside a block:

* The rows without their texts (key, digest, one code) are range-partitioned
  in reading order, so a conversation of any size is dealt over many tasks, and
  cut into blocks of at most max(``BLOCK_ROWS``, square root of all rows). Equal rows
  are one row with a count before any shuffle. A conversation inside one block is solved at
  once. For the others each block gives its 4 x 4 matrix of least costs from
  state to state; the matrices of a conversation (at most about the square root of
  all rows) give the cost vectors at block borders, the checkpoints; blocks are
  then walked apart for every state they can start in, and the states are chained.
* Inside a block, vectors are stored at every square root of its rows.

Texts move once: text rows meet the edit strings of their blocks in one sorted
stream for each conversation, which is counted, hashed and never held whole.
(A SHA-256 is a chain: the bytes of one conversation pass one task, as a stream.)

Defined results: nulls in id and turn are values of their own (null turns come
first and count in no gap); null role or text is one space. Every id of the input
has one row; where no row is left all counts are 0, ``audit`` is empty and the hash is
that of the empty text. Repeated rows are duplicates of the first. Texts of any
length are hashed whole. An empty table gives no rows. Only the four
columns are read, so extra columns of any name change nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botlog.llm import common

#: Rows of a block at least; blocks grow with the square root of all rows.
BLOCK_ROWS = 1024

_SPACE = " \t\n\x0b\f\r"
_FAR = 1 << 60
#: State after an inserted turn, and the state that a role leads to from each state that it may follow.
_INSERTED = (2, 2, 3, 2)
_FOLLOWS = {1: {0: 1}, 2: {0: 2, 1: 2, 3: 2}, 3: {2: 3}}
_ROLE = {2: "user", 3: "assistant"}
#: Cost of ending in each state, inserts included: an open user turn needs one, a lone system turn two.
END = (0, 4, 2, 0)


def _edits(code: int) -> list[list[tuple[str, int, int]]]:
    """For each state: (edit, cost, next state) of a row with this code, in
    ASCII order, without inserts. Codes: 0 must go; 1 to 4 system, user,
    assistant, other; plus 4 when truncated."""
    out = []
    for s in range(4):
        moves = [("D", 3, s)]
        if code:
            kind, late = (code - 1) % 4 + 1, int(code > 4)
            if s in _FOLLOWS.get(kind, {}):
                moves.append(("K", late, _FOLLOWS[kind][s]))
            moves.append(("R", 2 + late, _INSERTED[s]))
        out.append(moves)
    return out


EDITS = [_edits(c) for c in range(9)]


def back(code: int, after: tuple) -> tuple:
    """The cost vector before a row from the one after it."""
    r = [min(cost + after[t] for _, cost, t in moves) for moves in EDITS[code]]
    return (min(r[0], 2 + r[2], 4 + r[3]), min(r[1], 2 + r[2], 4 + r[3]), min(r[2], 2 + r[3]), min(r[3], 2 + r[2]))


def matrix(codes: bytes) -> list[int]:
    """Least cost from state s before the block to state t after its last row, row by row."""
    columns = []
    for t in range(4):
        v = tuple(0 if s == t else _FAR for s in range(4))
        for c in reversed(codes):
            v = tuple(min(x, _FAR) for x in back(c, v))
        columns.append(v)
    return [columns[t][s] for s in range(4) for t in range(4)]


def walk(codes: bytes, start: int, end: tuple) -> tuple[str, int]:
    """(edit string, state after the last row): the ASCII-least of the cheapest
    ways through the block from ``start``, given the cost vector after it."""
    step = max(1, math.isqrt(len(codes)))
    v, kept = tuple(end), {}
    for i in range(len(codes) - 1, -1, -1):
        if (i + 1) % step == 0 or i == len(codes) - 1:
            kept[i + 1] = v
        low = min(v)
        v = back(codes[i], tuple(x - low for x in v))
    out, state = [], start
    for a in range(0, len(codes), step):
        b = min(len(codes), a + step)
        after = [kept[b]]
        for i in range(b - 1, a, -1):
            low = min(after[-1])
            after.append(back(codes[i], tuple(x - low for x in after[-1])))
        for i in range(a, b):
            then = after[b - 1 - i]
            now = back(codes[i], then)
            while True:
                moves = EDITS[codes[i]][state]
                if moves[0][1] + then[moves[0][2]] == now[state]:
                    edit, _, state = moves[0]
                elif 2 + now[_INSERTED[state]] == now[state]:
                    out.append("I")
                    state = _INSERTED[state]
                    continue
                else:
                    edit, state = next((e, t) for e, cost, t in moves[1:] if cost + then[t] == now[state])
                out.append(edit)
                break
    return "".join(out), state


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of every row after the damage that
    the checksum of its id and turn asks for; dropped rows have 0 copies."""
    def or_space(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    harm = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    role, text = or_space("role"), or_space("text")
    return conversations.select(
        "conv_id", "turn", F.when(harm == 4, "user").otherwise(role).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).cast("long").alias("copies"))


def _keyed(rows: DataFrame) -> DataFrame:
    last = F.substring(F.rtrim("text", F.lit(_SPACE)), -1, 1)
    first = F.substring("role", 1, 1)
    kind = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(4)
    code = F.when(last == "", 0).otherwise(kind + F.when(last.isin(".", "!", "?"), 0).otherwise(4))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "copies", F.unhex(F.sha2("text", 256)).alias("digest"),
                       kind.alias("kind"), code.alias("code"))


def _marked(keyed: DataFrame) -> DataFrame:
    """One row for each group of equal rows, with whether its role and text
    stand on an earlier turn. Only texts that do are joined."""
    rows = (keyed.where("copies > 0").groupBy("conv_id", "turn", "role", "digest", "kind", "code")
            .agg(F.sum("copies").alias("copies")))
    again = (rows.where("code > 0").groupBy("conv_id", "role", "digest")
             .agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
             .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"))
    met = rows.join(again, rows["conv_id"].eqNullSafe(again["c"]) & (rows["role"] == again["r"]) & (rows["digest"] == again["d"]), "left")
    late = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return met.select("conv_id", "turn", "role", "digest", "kind", "code", "copies", late.alias("late"))


_LEGAL = {(1, 2), (2, 3), (3, 2)}
_BLOCK = ("pid int, seq int, role string, digest binary, codes binary, costs array<long>, audit string, blank long, duplicate long, "
          "truncated long, illegal long, first_kind int, last_kind int, turns long, least_turn long, most_turn long")


class _Block:
    """Rows of one conversation in reading order, at most a block of them."""

    def __init__(self, conv, turn, role, digest):
        self.conv, self.turn, self.role, self.digest = conv, turn, role, digest
        self.codes, self.kinds = bytearray(), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = None

    def add(self, turn, kind, code, copies, extra):
        """``copies`` equal rows; ``extra``: the first is a duplicate too."""
        if self.kinds and (self.kinds[-1], kind) not in _LEGAL:
            self.illegal += 1
        self.kinds = [self.kinds[0] if self.kinds else kind, kind]
        self.illegal += copies - 1
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        first = 0 if extra else code
        self.codes += bytes([first]) + bytes(copies - 1)
        if code == 0:
            self.blank += copies
        else:
            self.duplicate += copies - 1 + int(extra)
            self.truncated += int(first > 4)

    def row(self, pid, seq, whole):
        codes = bytes(self.codes)
        audit = walk(codes, 0, END)[0] if whole else None
        return [self.conv, self.turn, pid, seq, self.role, self.digest, None if whole else codes, None if whole else matrix(codes), audit,
                self.blank, self.duplicate, self.truncated, self.illegal, self.kinds[0], self.kinds[-1], self.turns, self.least, self.most]


def _blocks(marked: DataFrame, size: int) -> DataFrame:
    """The block table: whole conversations with their edits, parts of others with their matrix."""
    spark = marked.sparkSession
    order = ["conv_id", "turn", "role", "digest"]
    dealt = (marked.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
             .sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))
    schema = T.StructType([marked.schema["conv_id"], marked.schema["turn"], *T._parse_datatype_string(_BLOCK).fields])

    def run(batches):
        names, open_, seq, runs, split, rows = schema.names, None, 0, 0, False, []

        def closed(whole):
            nonlocal seq
            rows.append(open_.row(pid, seq, whole))
            seq += 1

        def flush():
            nonlocal rows
            cols = list(zip(*rows))
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], names=names)

        arrow = None
        for b in batches:
            if arrow is None:
                long, text, raw = pa.int64(), pa.string(), pa.binary()
                types = [b.schema.field(0).type, b.schema.field(1).type, pa.int32(), pa.int32(), text, raw, raw, pa.list_(long), text,
                         long, long, long, long, pa.int32(), pa.int32(), long, long, long]
                arrow = [pa.field(n, t) for n, t in zip(names, types)]
            for conv, turn, role, digest, kind, code, copies, late, pid in zip(*(c.to_pylist() for c in b.columns)):
                if open_ is not None and open_.conv != conv:
                    closed(runs > 1 and not split)
                    open_ = None
                if open_ is None:
                    open_, runs, split = _Block(conv, turn, role, digest), runs + 1, False
                while copies:
                    if len(open_.codes) >= size:
                        closed(False)
                        open_, split = _Block(conv, turn, role, digest), True
                    some = min(copies, size - len(open_.codes))
                    open_.add(turn, kind, code, some, late)
                    copies, late = copies - some, True
            if rows:
                yield flush()
        if open_ is not None:
            closed(False)
            yield flush()

    return dealt.select(*order, "kind", "code", "copies", "late", "pid").mapInArrow(run, schema)


def _solved(parts: DataFrame) -> DataFrame:
    """The parts of conversations cut by a border, with their edit strings."""
    def checkpoints(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pid", "seq"])
        after, v = [], list(END)
        for costs in reversed(pdf["costs"].tolist()):
            after.append(v)
            v = [min(int(costs[4 * s + t]) + v[t] for t in range(4)) for s in range(4)]
            v = [x - min(v) for x in v]
        return pd.DataFrame({"pid": pdf["pid"], "seq": pdf["seq"], "after": after[::-1]})

    def walked(batches):
        for b in batches:
            ways = [[walk(codes, s, tuple(after)) for s in range(4)] for codes, after in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[e for _, e in w] for w in ways], pa.list_(pa.int32())),
                                              pa.array([[a for a, _ in w] for w in ways], pa.list_(pa.string()))],
                                             names=["pid", "seq", "ends", "audits"])

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pid", "seq"])
        state, starts = 0, []
        for ends in pdf["ends"].tolist():
            starts.append(state)
            state = int(ends[state])
        return pd.DataFrame({"pid": pdf["pid"], "seq": pdf["seq"], "start": starts})

    at = ["pid", "seq"]
    after = parts.select("conv_id", *at, "costs").groupBy("conv_id").applyInPandas(checkpoints, "pid int, seq int, after array<long>")
    ways = common.written(parts.join(after, at).select(*at, "codes", "after")
                          .mapInArrow(walked, "pid int, seq int, ends array<int>, audits array<string>"), "dialog-ways")
    starts = (parts.select("conv_id", *at).join(ways.select(*at, "ends"), at).groupBy("conv_id")
              .applyInPandas(chained, "pid int, seq int, start int"))
    audit = ways.join(starts, at).select(*at, F.col("audits")[F.col("start")].alias("found"))
    return parts.join(audit, at).withColumn("audit", F.col("found")).drop("found")


class _Story:
    """What is known of the conversation that is being read."""

    def __init__(self, conv):
        self.conv, self.state, self.cost = conv, 0, 0
        self.counts, self.hash, self.any = [0, 0, 0, 0], hashlib.sha256(), False
        self.audit, self.ahead, self.edits = [], deque(), iter(())
        self.kind = self.least = self.most = None
        self.turns = 0

    def block(self, audit, blank, duplicate, truncated, illegal, first, last, turns, least, most):
        joint = int(self.kind is not None and (self.kind, first) not in _LEGAL)
        self.counts = [a + b for a, b in zip(self.counts, (blank, duplicate, truncated, illegal + joint))]
        self.turns += turns - int(turns > 0 and least == self.most)
        if turns:
            self.least, self.most = (least if self.least is None else self.least), most
        self.kind = last
        self.audit.append(audit)
        self.ahead.append(audit)

    def put(self, role, text):
        self.hash.update(("\n" if self.any else "").encode() + role.encode() + b":" + text.encode())
        self.any = True

    def insert(self):
        self.state, self.cost = _INSERTED[self.state], self.cost + 2
        self.put(_ROLE[self.state], "")

    def read(self, role, text, kind, code):
        """The next row, with the inserts before it."""
        while (e := next(self.edits, None)) in ("I", None):
            if e:
                self.insert()
            else:
                self.edits = iter(self.ahead.popleft())
        if e == "D":
            self.cost += 3
            return
        self.state = _FOLLOWS[kind][self.state] if e == "K" else _INSERTED[self.state]
        self.cost += int(code > 4) + (2 if e == "R" else 0)
        self.put(role if e == "K" else _ROLE[self.state], text)

    def row(self):
        tail = {0: "", 1: "II", 2: "I", 3: ""}[self.state]
        for _ in tail:
            self.insert()
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return [self.conv, gaps, *self.counts, self.cost, "".join(self.audit) + tail, self.hash.hexdigest()]


_OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text, copies):
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = rows.sparkSession
    common.prepare(spark)
    keyed = _keyed(rows)
    size = max(block_rows, math.isqrt(rows.count()))
    blocks = common.written(_blocks(_marked(keyed), size), "dialog-blocks")
    found = blocks.where("audit IS NOT NULL").unionByName(_solved(blocks.where("audit IS NULL")))
    facts = ["audit", "blank", "duplicate", "truncated", "illegal", "first_kind", "last_kind", "turns", "least_turn", "most_turn"]
    place = ["conv_id", "turn", "role", "digest", "pid", "seq"]
    heads = found.select(*place, *facts)
    texts = keyed.select("conv_id", "turn", "role", "digest", "text", "copies", "kind", "code")
    both = heads.unionByName(texts, allowMissingColumns=True).select(*place, *facts, "text", "copies", "kind", "code")
    # Blocks come before the rows of their first key: their pid is not null.
    stream = both.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "digest", F.col("pid").asc_nulls_last(), "seq")
    schema = T.StructType([rows.schema["conv_id"], *T._parse_datatype_string(_OUT).fields])

    def run(batches):
        story, done, kind_of_id = None, [], None

        def flush():
            nonlocal done
            cols, done = list(zip(*done)), []
            types = [kind_of_id, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=schema.names)

        for b in batches:
            kind_of_id = b.schema.field(0).type
            for conv, _, role, _, pid, _, *facts_, text, copies, kind, code in zip(*(c.to_pylist() for c in b.columns)):
                if story is None or story.conv != conv:
                    if story is not None:
                        done.append(story.row())
                    story = _Story(conv)
                if pid is not None:
                    story.block(*facts_)
                else:
                    for _ in range(copies):
                        story.read(role, text, kind, code)
            if done:
                yield flush()
        if story is not None:
            done.append(story.row())
            yield flush()

    return stream.mapInArrow(run, schema)


@common.query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every damaged conversation."""
    return repair(damage(common.table(spark, sf_dir, "conversations")))
