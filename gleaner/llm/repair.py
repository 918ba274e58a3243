"""Conversation structure repair by survivor-coalescence Viterbi.

A conversation is legal if the initials of its roles read `(s?(ua)+)?`. Edits of its rows, in order:
Keep (0), Rerole to user or assistant (2), Delete (3; blank and repeated rows must go), and Insert
of an empty user or assistant turn anywhere (2); a truncated row that stays costs 1 more. Among the
cheapest edits those whose initials are least in ASCII are taken.

The walk over a conversation keeps one survivor for each state of that pattern, as tips of a tree
of back pointers with reference counts. Ties are decided by the complete suffixes since the
survivors' last common ancestor. A survivor that another state beats whatever follows is dropped.
What only one child leads on from is decided: it is given out and forgotten, so that memory holds
the undecided rows only.

A conversation of at most `segment_rows` rows is walked by one task. A longer one is cut into
segments by range: each segment tells the cheapest cost from every state to every state, from which
follow the cost of what comes after it; with that it tells where the walk from each state leaves it;
and when the states between segments are known, all segments are walked side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import SPACES, read_table, stored

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a row that is kept leads to, by state and initial.
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Where a turn that is made (rerole, insert) leads to, by state; its role follows.
MAKES = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
PRICES = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED_PRICE = 1
FAR = 1 << 60

SEGMENT_ROWS = 50_000
#: Edits, or code points of their texts, of a batch that a walk gives out.
_BATCH, _BATCH_CHARS = 4096, 1 << 22

EDIT_KINDS = "edit string, turn long, was_role string, role string, text string, fault string"


class _Node:
    """An edit: `kids` and `tips` are what still refers to it."""

    __slots__ = ("parent", "edit", "row", "role", "depth", "kids", "tips")

    def __init__(self, parent: _Node | None, edit: str, row: tuple | None, role: str | None) -> None:
        self.parent, self.edit, self.row, self.role = parent, edit, row, role
        self.depth, self.kids, self.tips = (parent.depth + 1 if parent else 0), [], 1
        if parent:
            parent.kids.append(self)


def _path_before(p: _Node, a: str, q: _Node, b: str) -> bool:
    """Whether the edits up to `p` and then `a` come before those up to `q` and then `b`."""
    left, right = [a], [b]
    while p is not q:
        if p.depth >= q.depth:
            left.append(p.edit)
            p = p.parent
        else:
            right.append(q.edit)
            q = q.parent
    return left[::-1] < right[::-1]


class Survivors:
    """The walk over one run of rows. `give(edit, row, role)` gets each edit, in order, once it is decided."""

    def __init__(self, give: Callable[[str, tuple | None, str | None], None], entry: int = START) -> None:
        self._give, self._root = give, _Node(None, "", None, None)
        self.best: dict[int, tuple[int, _Node]] = {entry: (0, self._root)}

    def undecided(self) -> int:
        """Rows and inserts that are held: the longest path below the root."""
        return max(n.depth for _, n in self.best.values()) - self._root.depth

    def _drop(self, node: _Node) -> None:
        node.tips -= 1
        while not node.tips and not node.kids and node.parent:
            node.parent.kids.remove(node)
            node = node.parent

    def _inserts(self) -> None:
        for state in (START, SYSTEM, ASSISTANT, USER):  # a user turn may come first, an assistant's then follow it
            if state not in self.best:
                continue
            cost, node = self.best[state]
            to, cost = MAKES[state], cost + PRICES["I"]
            had = self.best.get(to)
            if had is None or cost < had[0] or cost == had[0] and _path_before(node, "I", had[1].parent, had[1].edit):
                self.best[to] = (cost, _Node(node, "I", None, ROLES[to]))
                if had:
                    self._drop(had[1])

    def step(self, row: tuple, initial: str, fault: str | None) -> None:
        self._inserts()
        found: dict[int, tuple] = {}

        def offer(to: int, cost: int, node: _Node, edit: str, role: str | None) -> None:
            had = found.get(to)
            if had is None or cost < had[0] or cost == had[0] and _path_before(node, edit, had[1], had[2]):
                found[to] = (cost, node, edit, role)

        extra = TRUNCATED_PRICE if fault == "truncated" else 0
        for state, (cost, node) in self.best.items():
            offer(state, cost + PRICES["D"], node, "D", None)
            if fault in ("blank", "duplicate"):
                continue
            if (state, initial) in KEEPS:
                offer(KEEPS[state, initial], cost + extra, node, "K", None)
            offer(MAKES[state], cost + extra + PRICES["R"], node, "R", ROLES[MAKES[state]])
        was = [node for _, node in self.best.values()]
        self.best = {to: (cost, _Node(node, edit, row, role)) for to, (cost, node, edit, role) in found.items()}
        for node in was:
            self._drop(node)
        self._prune()
        self._decide()

    def _prune(self) -> None:
        """An assistant turn can be followed by all that a system turn can, and by all that nothing can but a system turn, which it would have to delete."""
        cost = lambda state: self.best[state][0] if state in self.best else FAR
        reach = min(cost(ASSISTANT), cost(USER) + PRICES["I"])
        for state, more in ((START, PRICES["D"]), (SYSTEM, 0)):
            if state in self.best and reach + more < cost(state):
                self._drop(self.best.pop(state)[1])

    def _decide(self) -> None:
        while not self._root.tips and len(self._root.kids) == 1:
            self._root = self._root.kids[0]
            self._root.parent = None
            self._give(self._root.edit, self._root.row, self._root.role)

    def finish(self, exits: list[int] | None = None) -> int:
        """Decide the rest; the state it ends in. `exits`: the least cost of what follows, by state; None: nothing follows."""
        if exits is None:
            self._inserts()
            exits = [0, FAR, FAR, 0]
        end = None
        for state, (cost, node) in self.best.items():
            cost += exits[state]
            if end is None or cost < end[0] or cost == end[0] and _path_before(node.parent, node.edit, end[1].parent, end[1].edit):
                end = (cost, node, state)
        path, node = [], end[1]
        while node is not self._root:
            path.append(node)
            node = node.parent
        for n in reversed(path):
            self._give(n.edit, n.row, n.role)
        return end[2]


def segment_costs(rows: Iterable[tuple[str, str | None]]) -> list[list[int]]:
    """The least cost from each state to each, over rows of (initial, fault); inserts come before a row."""
    table = [[0 if a == b else FAR for b in range(4)] for a in range(4)]
    for initial, fault in rows:
        extra = TRUNCATED_PRICE if fault == "truncated" else 0
        for k, costs in enumerate(table):
            c = list(costs)
            c[USER] = min(c[USER], PRICES["I"] + min(c[START], c[SYSTEM], c[ASSISTANT]))
            c[ASSISTANT] = min(c[ASSISTANT], PRICES["I"] + c[USER])
            new = [x + PRICES["D"] for x in c]
            if fault not in ("blank", "duplicate"):
                for state in range(4):
                    new[MAKES[state]] = min(new[MAKES[state]], c[state] + extra + PRICES["R"])
                    if (state, initial) in KEEPS:
                        to = KEEPS[state, initial]
                        new[to] = min(new[to], c[state] + extra)
            table[k] = [min(x, FAR) for x in new]
    return table


#: What is left to pay at the end of a conversation, by state.
LAST_EXITS = [0, 2 * PRICES["I"], PRICES["I"], 0]


def _last_char(text: Column) -> Column:
    """The last character that is not ASCII white space; none: empty."""
    return F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))


def _rows(turns: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(" "))
    slim = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"))
    return slim.withColumn("last", _last_char(F.col("text")))


def _schema(conv: str, **fields: pa.DataType) -> pa.Schema:
    """Of batches of a conv_id of Spark's type `conv`, and `fields`."""
    return pa.schema([("conv_id", {"string": pa.string(), "int": pa.int32()}.get(conv, pa.int64())), *fields.items()])


def _fault(last: str, again: bool) -> str | None:
    return "blank" if not last else "duplicate" if again else None if last in ".!?" else "truncated"


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _walk(batches: Iterator[pa.RecordBatch], schema: pa.Schema, long: bool) -> Iterator[pa.RecordBatch]:
    """Edits of rows (conv_id, segment, turn, role, text, last, again, entry, exits), sorted; `again` of short conversations is found here."""
    out: list[tuple] = []
    chars = 0

    def flushed() -> pa.RecordBatch:
        nonlocal out, chars
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out, chars = [], 0
        return batch

    for (conv, segment), rows in groupby(_stream(batches), itemgetter(0, 1)):
        step, walk, exits, seen = 0, None, None, set()

        def give(edit: str, row: tuple | None, role: str | None) -> None:
            nonlocal step, chars
            turn, was, text, fault = row or (None, None, "", None)
            out.append((conv, segment, step, edit, turn, was, None if edit == "D" else role or was, text, fault))  # noqa: B023
            step, chars = step + 1, chars + len(text)

        for _, _, turn, role, text, last, again, entry, exits in rows:
            walk = walk or Survivors(give, entry)
            if not long:
                key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
                again = key in seen
                seen.add(key)
            fault = _fault(last, again)
            walk.step((turn, role, text, fault), role[:1], fault)
            if len(out) >= _BATCH or chars >= _BATCH_CHARS:
                yield flushed()
        walk.finish(exits)
        if len(out) >= _BATCH or chars >= _BATCH_CHARS:
            yield flushed()
    if out:
        yield flushed()


def _walked(rows: DataFrame, long: bool) -> DataFrame:
    """Rows with segment, again, entry and exits -> edits. Each segment in one task, in order."""
    conv = dict(rows.dtypes)["conv_id"]
    kinds = f"conv_id {conv}, segment long, step long, {EDIT_KINDS}"
    schema = _schema(conv, segment=pa.int64(), step=pa.int64(), edit=pa.string(), turn=pa.int64(), **dict.fromkeys(("was_role", "role", "text", "fault"), pa.string()))
    order = ["conv_id", "segment", "turn", "role", "text", "again"]
    dealt = rows.repartition(*order[:2]) if long else rows.repartition("conv_id")
    return dealt.sortWithinPartitions(*order).select("conv_id", "segment", "turn", "role", "text", "last", "again", "entry", "exits").mapInArrow(lambda b: _walk(b, schema, long), kinds)


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & a[n].eqNullSafe(b[f"_{n}"])
    return cond


def _marked(df: DataFrame, *names: str) -> DataFrame:
    """`df` with `names` behind an underscore, to be joined by."""
    for n in names:
        df = df.withColumnRenamed(n, f"_{n}")
    return df


def _long_edits(rows: DataFrame) -> DataFrame:
    """Edits of the rows of long conversations, by segments cut by range."""
    conv = dict(rows.dtypes)["conv_id"]
    order = ["conv_id", "turn", "role", "text"]
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(cut.withColumn("at", F.monotonically_increasing_id()).withColumn("segment", F.spark_partition_id().cast("long")))
    first = rows.groupBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.min("at").alias("_at"))
    rows = stored(rows.join(first.select("_at"), F.col("at") == F.col("_at"), "left").withColumn("again", F.col("_at").isNull()).drop("at", "_at"))
    fault = F.when(F.col("last") == "", "blank").when(F.col("again"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    slim = rows.select("conv_id", "segment", "turn", "role", "text", "again", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    in_order = lambda df: df.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "turn", "role", "text", "again")

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (c, s), group in groupby(_stream(batches), itemgetter(0, 1)):
            table = segment_costs((i, f) for _, _, i, f in group)
            yield pa.RecordBatch.from_pylist([{"conv_id": c, "segment": s, "costs": [x for line in table for x in line]}], schema=segment_schema)

    segment_schema = _schema(conv, segment=pa.int64(), costs=pa.list_(pa.int64()))
    tables = stored(in_order(slim).select("conv_id", "segment", "initial", "fault").mapInArrow(costs, f"conv_id {conv}, segment long, costs array<long>"))

    def backward(segments: pd.DataFrame) -> pd.DataFrame:
        """The least cost of what follows each segment, by the state it leaves: as many rows as a conversation has segments."""
        segments = segments.sort_values("segment", ascending=False)
        left, out = LAST_EXITS, []
        for flat in segments["costs"]:
            out.append(left)
            left = [min(FAR, *(int(flat[4 * a + b]) + left[b] for b in range(4))) for a in range(4)]
        return segments[["conv_id", "segment"]].assign(exits=out)

    exits = stored(tables.groupBy("conv_id").applyInPandas(backward, f"conv_id {conv}, segment long, exits array<long>"))
    exits = _marked(exits, "conv_id", "segment")
    last = exits.groupBy(F.col("_conv_id").alias("c")).agg(F.max("_segment").alias("final"))
    exits = exits.join(last, F.col("_conv_id").eqNullSafe(F.col("c"))).select("_conv_id", "_segment", F.when(F.col("_segment") < F.col("final"), F.col("exits")).alias("exits"))
    told = slim.join(exits, _same(slim, exits, "conv_id", "segment")).drop("_conv_id", "_segment")

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (c, s), group in groupby(_stream(batches), itemgetter(0, 1)):
            walks, left = [Survivors(lambda *_: None, e) for e in range(4)], None
            for _, _, initial, fault, left in group:
                for w in walks:
                    w.step((), initial, fault)
            yield pa.RecordBatch.from_pylist([{"conv_id": c, "segment": s, "costs": [w.finish(left) for w in walks]}], schema=segment_schema)

    ways = stored(in_order(told).select("conv_id", "segment", "initial", "fault", "exits").mapInArrow(leaves, f"conv_id {conv}, segment long, costs array<long>"))

    def forward(segments: pd.DataFrame) -> pd.DataFrame:
        segments = segments.sort_values("segment")
        at, out = START, []
        for to in segments["costs"]:
            out.append(at)
            at = int(to[at])
        return segments[["conv_id", "segment"]].assign(entry=out)

    entries = _marked(stored(ways.groupBy("conv_id").applyInPandas(forward, f"conv_id {conv}, segment long, entry int")), "conv_id", "segment")
    known = rows.join(exits, _same(rows, exits, "conv_id", "segment")).drop("_conv_id", "_segment")
    return _walked(known.join(entries, _same(known, entries, "conv_id", "segment")), True)


def repaired(turns: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """turns (conv_id, turn, role, text) -> one row an edit: (conv_id, segment, step, edit, turn, was_role, role, text, fault).

    Sorted by segment and step, the edits of a conversation hold each of its rows once (edit K, R
    or D) and what is inserted (I; turn, was_role and fault null). `role` and `text` are the
    repaired ones; role is null where a row is deleted. `fault`: blank, duplicate (of an earlier
    role and text) or truncated, the first that holds.

    Rows are taken by turn, nulls first, then by role and text; rows that repeat are rows. Null
    role or text: one space. A null conv_id is a conversation. A role whose initial is none of s, u
    and a, or that is empty, cannot be kept. conv_id may be long, int or string. Empty input: no
    rows. Other columns are not looked at.
    """
    return _edits(_rows(turns), segment_rows)[0]


def _edits(rows: DataFrame, segment_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """All edits; and, if there are any, those of long conversations alone, whose segments lie apart."""
    plain = lambda df: df.withColumns({"segment": F.lit(0).cast("long"), "again": F.lit(None).cast("boolean"), "entry": F.lit(START), "exits": F.lit(None).cast("array<long>")})
    counts = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    long = _marked(stored(counts.where(F.col("n") > segment_rows).select("conv_id")), "conv_id")
    if long.isEmpty():
        return _walked(plain(rows), False), None
    short = _walked(plain(rows.join(long, _same(rows, long, "conv_id"), "left_anti")), False)
    cut = stored(_long_edits(rows.join(long, _same(rows, long, "conv_id"), "left_semi")))
    return short.unionByName(cut), cut


def _audited(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row a conversation of edits in order, held one at a time."""
    for conv, edits in groupby(_stream(batches), itemgetter(0)):
        sha, audit, fresh = hashlib.sha256(), [], True
        faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        illegal = cost = distinct = 0
        before, low, high = None, None, None
        for _, edit, turn, was, role, text, fault in edits:
            audit.append(edit)
            cost += PRICES[edit] + (TRUNCATED_PRICE if fault == "truncated" and edit != "D" else 0)
            if edit != "I":
                if fault:
                    faults[fault] += 1
                illegal += before is not None and before + was[:1] not in ("su", "ua", "au")
                before = was[:1]
                if turn is not None and turn != high:
                    distinct, low, high = distinct + 1, turn if low is None else low, turn
            if edit != "D":
                sha.update(f"{'' if fresh else chr(10)}{role}:{text}".encode())
                fresh = False
        row = {"conv_id": conv, "gaps": 0 if low is None else high - low + 1 - distinct, **faults, "illegal": illegal, "cost": cost, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
        yield pa.RecordBatch.from_pylist([row], schema=schema)


def audited(turns: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation, from its edits.

    A long conversation's edits are hashed by one task, which holds one edit at a time (and their
    initials, which it returns): a digest of all text in order has no other way.
    """
    rows = _rows(turns)
    conv = dict(turns.dtypes)["conv_id"]
    kinds = f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    schema = _schema(conv, **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), pa.int64()), audit=pa.string(), repaired_sha256=pa.string())
    told = lambda df: df.select("conv_id", "edit", "turn", "was_role", "role", "text", "fault").mapInArrow(lambda b: _audited(b, schema), kinds)
    edits, cut = _edits(rows, segment_rows)
    if cut is None:
        return told(edits)  # a conversation is whole and in order in its task
    return told(edits.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "step"))


def damaged(turns: DataFrame) -> DataFrame:
    """turns with faults made by the checksum of `conv_id:turn` modulo 20: 0 drops a row, 1 empties it, 2 takes its stops away, 3 repeats it, 4 makes it a user's. Nulls: one space."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn")).cast("binary")) % 20
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate(say("text"), ".!?", "")).otherwise(say("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(say("role"))
    hit = turns.select("conv_id", "turn", "role", "text", code.alias("code")).where("code <> 0")
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    every = turns.select("conv_id").distinct()
    found = _marked(audited(damaged(turns)), "conv_id")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(found, _same(every, found, "conv_id"), "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
    )


REPAIR_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: xor((CASE WHEN x >= 0 THEN xor(a, x) ELSE a END) >> 1, CASE WHEN (CASE WHEN x >= 0 THEN xor(a, x) ELSE a END) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT) % 20 AS code FROM keyed),
d AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM coded, (VALUES (0), (1)) AS t(copy) WHERE code <> 0 AND (copy = 0 OR code = 3)),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail, left(role, 1) AS r FROM d),
f AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS r0 FROM o),
seen AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (r0 IS NOT NULL AND (r0 || r) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
walk(conv_id, i, z, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {'c': 0, 'p': ''}, {'c': 99999999, 'p': ''}, {'c': 99999999, 'p': ''}, {'c': 99999999, 'p': ''} FROM seen
  UNION ALL
  SELECT conv_id, i + 1, {'c': z.c + 3, 'p': z.p || 'D'},
    least({'c': s.c + 3, 'p': s.p || 'D'}, {'c': CASE WHEN ok AND r = 's' THEN z.c + t ELSE 99999999 END, 'p': z.p || 'K'}),
    least({'c': u2.c + 3, 'p': u2.p || 'D'},
      {'c': CASE WHEN ok AND r = 'u' THEN z.c + t ELSE 99999999 END, 'p': z.p || 'K'}, {'c': CASE WHEN ok AND r = 'u' THEN s.c + t ELSE 99999999 END, 'p': s.p || 'K'}, {'c': CASE WHEN ok AND r = 'u' THEN a2.c + t ELSE 99999999 END, 'p': a2.p || 'K'},
      {'c': CASE WHEN ok THEN z.c + t + 2 ELSE 99999999 END, 'p': z.p || 'R'}, {'c': CASE WHEN ok THEN s.c + t + 2 ELSE 99999999 END, 'p': s.p || 'R'}, {'c': CASE WHEN ok THEN a2.c + t + 2 ELSE 99999999 END, 'p': a2.p || 'R'}),
    least({'c': a2.c + 3, 'p': a2.p || 'D'}, {'c': CASE WHEN ok AND r = 'a' THEN u2.c + t ELSE 99999999 END, 'p': u2.p || 'K'}, {'c': CASE WHEN ok THEN u2.c + t + 2 ELSE 99999999 END, 'p': u2.p || 'R'})
  FROM (
    SELECT *, least(a, {'c': u2.c + 2, 'p': u2.p || 'I'}) AS a2 FROM (
      SELECT w.*, f.r, f.fault NOT IN ('blank', 'duplicate') AS ok, (f.fault = 'truncated')::INT AS t,
             least(w.u, {'c': w.z.c + 2, 'p': w.z.p || 'I'}, {'c': w.s.c + 2, 'p': w.s.p || 'I'}, {'c': w.a.c + 2, 'p': w.a.p || 'I'}) AS u2
      FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))),
ends AS (
  SELECT conv_id, least(z, a, {'c': u.c + 2, 'p': u.p || 'I'}, {'c': s.c + 4, 'p': s.p || 'II'}) AS e, gaps, blank, duplicate, truncated, illegal
  FROM walk JOIN seen USING (conv_id) WHERE walk.i = seen.n),
letters AS (SELECT conv_id, e.p[j] AS x, j FROM (SELECT conv_id, e, unnest(generate_series(1, length(e.p))) AS j FROM ends)),
placed AS (SELECT *, sum((x <> 'I')::INT) OVER w AS i, sum((x <> 'D')::INT) OVER w AS m FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
whole AS (
  SELECT p.*, f.role, f.text, max((p.x = 'K' AND f.r = 's')::INT) OVER (PARTITION BY p.conv_id) AS has_s
  FROM placed p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = greatest(p.i, 1)),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (m - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) FILTER (x <> 'D') AS said
  FROM whole GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.p, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM c.conv_id
"""
