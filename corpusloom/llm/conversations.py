"""Repair of conversations by cheapest edits, so that roles read: a system message or none, then user and assistant in turn.

A conversation's rows in order of turn span an edit lattice: a node is a number of rows read and one of four states of the
roles written (nothing, a system message, a user's, an assistant's); edges keep, rerole or delete the next row or insert
an empty message.  A bidirectional Dijkstra search runs from the empty beginning and from the ends that may be accepted;
once both heaps together exceed the best crossing, all crossings of that cost are finished and the least joined audit is
taken.  Each side holds, for each node, the least audit among its cheapest ones: in the order of cost, then rows, a node's
predecessors are all settled before it, as only keeping a row is free.

Rows are dealt by ranges of conversation, turn, role and text, so a conversation may span tasks, and each task reads its
rows in order, in blocks of at most BLOCK rows or BYTES of text.  A conversation within one block is searched at once.  A
block of a longer one, or of one at a task's edge, gives a table: the cheapest edits from each state to each state, by the
same search; tables are joined by the same search over a lattice whose steps are blocks.  Joining holds sixteen letters a
row of that one conversation; its texts stay in their blocks.

Defined cases: nulls in role and text are one space; a null conv_id is one conversation; null turns come first; rows of one
turn come in order of role, then text; rows that are all alike are told apart by nothing; conversations without rows are
repaired to nothing; an empty table gives no rows.  Other columns do not pass: the result is made of conversations.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, bound_batches, broadcast_if_small, materialise, table

#: Rows and bytes of text of a block; blocks whose tables are joined at a time.
BLOCK, BYTES, JOINED = 256, 4 << 20, 64
#: Costs of the edits, and of leaving a truncated row in place.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Repeated messages that may be broadcast.
FEW = 200_000
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
ENDS = (NOTHING, ASSISTANT)
#: What a state may be followed by: the state after a user's or an assistant's message.
NEXT = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The letter of a kept system message within a search; K in the audit.  No node has both, and it sorts as K does.
SYSTEM_KEPT = "L"
MESSAGE = pa.struct([("role", pa.string()), ("text", pa.string())])
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPORT = pa.struct([*((x, pa.int64()) for x in COUNTS), ("audit", pa.string())])
STATS = pa.struct([(x, pa.int64()) for x in ("blank", "duplicate", "truncated", "illegal", "low", "high", "turns")] + [("first", pa.string()), ("last", pa.string())])
PIECE = pa.struct([("rows", pa.list_(pa.struct([*MESSAGE, ("must", pa.bool_()), ("cut", pa.bool_())]))), ("stats", STATS), ("table", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])

Step = tuple[int, int, int, str]  # from state, to state, cost, letters


def steps_of(initial: str, must: bool, cut: bool) -> list[Step]:
    """The edges over one row."""
    out = [(x, x, DELETE, "D") for x in STATES]
    if not must:
        more = CUT * cut
        out += [(x, y, REROLE + more, "R") for x, y in NEXT.items()]
        if initial == "s":
            out.append((NOTHING, SYSTEM, more, SYSTEM_KEPT))
        out += [(x, y, more, "K") for x, y in NEXT.items() if ROLES[y][0] == initial]
    return out


INSERTS: list[Step] = [(x, y, INSERT, "I") for x, y in NEXT.items()]


def least_path(steps: list[list[Step]], stays: list[Step], start: int, ends: Iterable[int]) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest path from ``start`` over all steps to one of ``ends``; stays: edges within a layer."""
    n = len(steps)
    known: tuple[dict, dict] = ({(0, start): (0, "")}, {(n, x): (0, "") for x in ends})
    heaps: tuple[list, list] = ([(0, 0, start)], [(0, 0, x) for x in ends])
    settled: tuple[set, set] = (set(), set())
    best = min((a[0] for node, a in known[0].items() if node in known[1]), default=float("inf"))

    def near(side: int, i: int, x: int) -> Iterator[tuple[tuple[int, int], int, str]]:
        """Neighbours of a node, the costs and the letters of the edges."""
        for layer, moved in ((stays, 0), (steps[i] if not side and i < n else steps[i - 1] if side and i else (), 1)):
            for a, b, cost, letters in layer:
                if (b if side else a) == x:
                    yield ((i - moved, a) if side else (i + moved, b)), cost, letters

    while (tops := [h[0][0] for h in heaps if h]) and sum(tops) <= best:  # a side that is done leaves all to the other
        side = 0 if heaps[0] and heaps[0][0][0] == min(tops) else 1
        cost, order, x = heapq.heappop(heaps[side])
        node = (n - order if side else order, x)
        if node in settled[side] or known[side][node][0] < cost:
            continue
        settled[side].add(node)
        audit = known[side][node][1]
        for other, more, letters in near(side, *node):
            reached = (cost + more, letters + audit if side else audit + letters)
            if other not in settled[side] and (other not in known[side] or reached < known[side][other]):
                if other not in known[side] or reached[0] < known[side][other][0]:
                    heapq.heappush(heaps[side], (reached[0], n - other[0] if side else other[0], other[1]))
                known[side][other] = reached
            if other in known[1 - side]:
                best = min(best, cost + more + known[1 - side][other][0])
    if best == float("inf"):
        return None
    for side, sure in enumerate(({(0, start)}, {(n, x) for x in ends})):  # their audits are empty, popped or not
        settled[side].update(sure)
    joined = [known[0][v][1] + known[1][v][1] for v in settled[0] & settled[1] if known[0][v][0] + known[1][v][0] == best]
    for u in settled[0]:
        cost, audit = known[0][u]
        joined += [audit + letters + known[1][v][1] for v, more, letters in near(0, *u) if v in settled[1] and cost + more + known[1][v][0] == best]
    return best, min(joined)


def table_of(steps: list[list[Step]], stays: list[Step]) -> list[Step]:
    """The cheapest paths from each state to each, as the edges of one step."""
    found = ((x, y, least_path(steps, stays, x, (y,))) for x in STATES for y in STATES)
    return [(x, y, *path) for x, y, path in found if path]


def joined_path(tables: list[list[Step]]) -> tuple[int, str]:
    """Cost and audit of a whole conversation, by the tables of its blocks."""
    while len(tables) > JOINED:
        tables = [table_of(tables[i:i + JOINED], []) for i in range(0, len(tables), JOINED)]
    return least_path(tables, [], NOTHING, ENDS)


def cut_audit(audit: str, sizes: list[int]) -> list[str]:
    """The parts of an audit that read so many rows each; insertions go with the row after them, the last ones with the last."""
    out, at = [], 0
    for size in sizes:
        start = at
        while size:
            size -= audit[at] != "I"
            at += 1
        out.append(audit[start:at])
    out[-1] += audit[at:]
    return out


def state_after(letter: str, state: int) -> int:
    return state if letter == "D" else SYSTEM if letter == SYSTEM_KEPT else NEXT[state]


def repaired(rows: Iterable[tuple[str, str]], audit: str, state: int = NOTHING) -> list[dict]:
    """The messages that an audit makes of rows of (role, text), from a state on."""
    out, rows = [], iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        state = state_after(letter, state)
        if letter != "D":
            out.append({"role": ROLES[state] if letter in "IR" else role, "text": text})
    return out


class Block:
    """Rows of one conversation that follow each other, with their first faults."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.size, self.last_turn = conv_id, [], 0, None
        self.stats = dict.fromkeys(STATS.names[:4], 0) | {"low": None, "high": None, "turns": 0, "first": None, "last": None}

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        told = text.strip(BLANKS)
        fault = "blank" if not told else "duplicate" if repeated else "truncated" if told[-1] not in ".!?" else None
        stats, initial = self.stats, role[:1]
        if fault:
            stats[fault] += 1
        if stats["first"] is None:
            stats["first"] = initial
        else:
            stats["illegal"] += stats["last"] + initial not in ("su", "ua", "au")
        stats["last"] = initial
        if turn is not None:
            stats["turns"] += turn != stats["high"]
            stats["low"], stats["high"] = turn if stats["low"] is None else stats["low"], turn
        self.rows.append({"role": role, "text": text, "must": fault in ("blank", "duplicate"), "cut": fault == "truncated"})
        self.size += len(text)

    def steps(self) -> list[list[Step]]:
        return [steps_of(r["role"][:1], r["must"], r["cut"]) for r in self.rows]


def report_of(stats: list[dict], cost: int, audit: str) -> dict:
    """The report of a conversation by the statistics of its blocks."""
    out = {x: sum(s[x] for s in stats) for x in STATS.names[:4]}
    told = [s for s in stats if s["first"] is not None]
    out["illegal"] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
    turned = [s for s in stats if s["turns"]]
    turns = sum(s["turns"] for s in turned) - sum(a["high"] == b["low"] for a, b in zip(turned, turned[1:]))
    out["gaps"] = turned[-1]["high"] - turned[0]["low"] + 1 - turns if turned else 0
    return out | {"cost": cost, "audit": audit.replace(SYSTEM_KEPT, "K")}


def with_first_turns(rows: DataFrame) -> DataFrame:
    """rows with ``late``: whether the conversation has the same role and text in an earlier turn."""
    key = F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.length("role").cast("string"), "role", "text"), 256)
    at = F.struct(F.col("turn").isNotNull().alias("told"), "turn")
    keyed = rows.withColumn("_key", F.when(~F.col("gone"), key)).withColumn("_at", at)
    firsts = keyed.where("NOT gone").groupBy("_key").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last")).where("_first < _last").select("_key", "_first")
    found = keyed.join(broadcast_if_small(firsts, FEW), "_key", "left")
    return found.withColumn("late", F.coalesce(F.col("_first") < F.col("_at"), F.lit(False))).drop("_key", "_at", "_first")


def repair(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """Blocks of repaired conversations; rows: conv_id, turn, role and text; gone: whether a row only names its conversation.  The result has conv_id, part and no (the order of its blocks), whole (no other block),
    report (on the first block alone) and messages, of role and text."""
    spark = rows.sparkSession
    bound_batches(spark)
    gone = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    told = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    flagged = with_first_turns(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *told, gone.alias("gone")))
    ranged = flagged.repartitionByRange(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.substring("role", 1, 20), F.substring("text", 1, 100))
    ordered = ranged.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text").select("conv_id", "turn", "role", "text", "gone", "late")
    kind, arrow = rows.schema["conv_id"].dataType.simpleString(), rows.select("conv_id").limit(0).toArrow().schema.field(0).type
    names = ["conv_id", "part", "no", "whole", "report", "messages", "piece"]
    types = [arrow, pa.int32(), pa.int64(), pa.bool_(), REPORT, pa.list_(MESSAGE), PIECE]
    report = f"struct<{', '.join(f'{x}: long' for x in COUNTS)}, audit: string>"
    messages = "array<struct<role: string, text: string>>"
    stats = "struct<blank: long, duplicate: long, truncated: long, illegal: long, low: long, high: long, turns: long, first: string, last: string>"
    edges = "array<struct<start: int, end: int, cost: long, audit: string>>"
    piece = f"struct<rows: array<struct<role: string, text: string, must: boolean, cut: boolean>>, stats: {stats}, table: {edges}>"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        block, before = None, None
        for batch in batches:
            for conv_id, turn, role, text, gone, late in zip(*(c.to_pylist() for c in batch.columns)):
                if block is None or conv_id != block.conv_id or len(block.rows) >= BLOCK or block.size >= BYTES:
                    if block is not None:
                        yield block
                    block = Block(conv_id)
                if not gone:
                    block.add(turn, role, text, late or before == (conv_id, turn, role, text))
                    before = (conv_id, turn, role, text)
        if block is not None:
            yield block

    def told_blocks(batches):
        """Each block with whether it is the whole of its conversation: not where a task begins or ends."""
        part, held, ahead, last = TaskContext.get().partitionId(), [], iter(blocks(batches)), None
        block, no = next(ahead, None), 0
        while block is not None:
            after = next(ahead, None)
            whole = no > 0 and after is not None and block.conv_id != last.conv_id and block.conv_id != after.conv_id
            held.append((part, no, block, whole))
            if len(held) == BLOCK or sum(b.size for _, _, b, _ in held) >= BYTES:
                yield batch_of(held)
                held = []
            last, block, no = block, after, no + 1
        if held:
            yield batch_of(held)

    def batch_of(held):
        out = []
        for part, no, block, whole in held:
            row = [block.conv_id, part, no, whole, None, None, None]
            if whole:
                cost, audit = least_path(block.steps(), INSERTS, NOTHING, ENDS)
                row[4], row[5] = report_of([block.stats], cost, audit), repaired(((r["role"], r["text"]) for r in block.rows), audit)
            else:
                edges = [dict(zip(("start", "end", "cost", "audit"), x)) for x in table_of(block.steps(), INSERTS)]
                row[6] = {"rows": block.rows, "stats": block.stats, "table": edges}
            out.append(row)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    schema = f"conv_id {kind}, part int, no long, whole boolean, report {report}, messages {messages}, piece {piece}"
    found = materialise(ordered.mapInArrow(told_blocks, schema), "conversations")

    def joined(group: pa.Table) -> pa.Table:
        """The audit of each block of a conversation, the state before it, and the report on the first."""
        rows = sorted(group.select(["part", "no", "size", "stats", "table"]).to_pylist(), key=lambda r: (r["part"], r["no"]))
        cost, audit = joined_path([[(x["start"], x["end"], x["cost"], x["audit"]) for x in r["table"]] for r in rows])
        out, state = [], NOTHING
        for r, part in zip(rows, cut_audit(audit, [r["size"] for r in rows])):
            out.append({"part": r["part"], "no": r["no"], "edits": part, "state": state, "only": len(rows) == 1, "report": None if out else report_of([x["stats"] for x in rows], cost, audit)})
            for letter in part:
                state = state_after(letter, state)
        kinds = [("part", pa.int32()), ("no", pa.int64()), ("edits", pa.string()), ("state", pa.int32()), ("only", pa.bool_()), ("report", REPORT)]
        return pa.Table.from_pylist(out, pa.schema(kinds))

    pieces = found.where("NOT whole")
    tables = pieces.select("conv_id", "part", "no", F.size("piece.rows").alias("size"), "piece.stats", "piece.table")
    plans = tables.groupBy("conv_id").applyInArrow(joined, f"part int, no long, edits string, state int, only boolean, report {report}")

    @F.arrow_udf(messages)
    def written(rows: pa.Array, edits: pa.Array, states: pa.Array) -> pa.Array:
        out = (repaired(((r["role"], r["text"]) for r in x), e, s) for x, e, s in zip(rows.to_pylist(), edits.to_pylist(), states.to_pylist()))
        return pa.array(out, pa.list_(MESSAGE))

    mended = pieces.select("conv_id", "part", "no", "piece.rows").join(plans, ["part", "no"])
    mended = mended.select("conv_id", "part", "no", F.col("only").alias("whole"), "report", written("rows", "edits", "state").alias("messages"))
    return found.where("whole").drop("piece").unionByName(mended)


def messages(blocks: DataFrame) -> DataFrame:
    """conv_id, part, no, at, role and text of the repaired messages; the three numbers order those of a conversation."""
    return blocks.select("conv_id", "part", "no", F.posexplode("messages").alias("at", "m")).select("conv_id", "part", "no", "at", "m.role", "m.text")


def reports(blocks: DataFrame) -> DataFrame:
    """One row for each conversation, with ``repaired_sha256`` of its messages as role:text lines.

    A conversation of several blocks is read in order by one task, as the digest is of all of it; it holds one block."""
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    kind = blocks.schema["conv_id"].dataType.simpleString()
    one = blocks.where("whole").select("conv_id", "report", F.sha2(lines, 256).alias("repaired_sha256"))
    parts = blocks.where("NOT whole").select("conv_id", "part", "no", "report", lines.alias("lines"), F.size("messages").alias("n"))
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")

    def hashed(batches):
        held = None
        for batch in batches:
            for conv_id, report, lines, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "report", "lines", "n"))):
                if report is not None:
                    if held:
                        yield row(held, batch.schema)
                    held = [conv_id, report, hashlib.sha256(), 0]
                if n:
                    held[2].update((("\n" if held[3] else "") + lines).encode("utf-8", "surrogatepass"))
                    held[3] += n
            schema = batch.schema
        if held:
            yield row(held, schema)

    def row(held, schema):
        columns = [pa.array([held[0]], schema.field("conv_id").type), pa.array([held[1]], schema.field("report").type), pa.array([held[2].hexdigest()])]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "report", "repaired_sha256"])

    several = ordered.mapInArrow(hashed, f"conv_id {kind}, report {blocks.schema['report'].dataType.simpleString()}, repaired_sha256 string")
    return one.unionByName(several).select("conv_id", "report.*", "repaired_sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of conversations as the contract of op12 damages them by the digest of their place; dropped ones are ``gone``."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    text = F.when(code <= 1, "").when(code == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    role = F.when(code == 4, "user").otherwise(told("role"))
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (code == 0).alias("gone"), F.when(code == 3, 2).otherwise(1).alias("times"))
    return marked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(repair(damaged(table(spark, sf_dir, "conversations")), F.col("gone")))


# Forward search: the cheapest way to each state after each row, with up to two insertions behind it.
OP12_SQL = """
WITH RECURSIVE byte AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
o AS (SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
h AS (SELECT o.*, xor(list_reduce(list_concat([4294967295], [ord(x)::BIGINT FOR x IN string_split(place, '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code FROM o, byte),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE code <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS no,
  left(role, 1) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS told FROM d),
f AS (SELECT *, CASE WHEN told = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY no) > 1 THEN 'd' WHEN right(told, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY no) || i AS pair FROM n),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, list({'i': i, 'role': role, 'text': text, 'must': fault IN ('b', 'd'), 'more': CASE fault WHEN 't' THEN 3 ELSE 0 END} ORDER BY no) AS rows FROM f GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations),
c AS (SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(rows, []) AS rows
  FROM ids LEFT JOIN s ON ids.conv_id IS NOT DISTINCT FROM s.conv_id),
behind AS (SELECT * FROM (VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:']),
  (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])) b(y, z, dear, added, lines)),
edge AS (SELECT * FROM (VALUES (0, 'D', 0), (1, 'D', 1), (2, 'D', 2), (3, 'D', 3), (0, 'R', 2), (1, 'R', 2), (2, 'R', 3), (3, 'R', 2), (0, 'K', 1), (0, 'K', 2), (1, 'K', 2), (2, 'K', 3), (3, 'K', 2)) e(x, letter, y)),
p AS (SELECT conv_id, rows, 1 AS pos, z AS x, {'cost': dear, 'audit': added, 'lines': lines::VARCHAR[]} AS best FROM c, behind WHERE y = 0
  UNION ALL
  SELECT conv_id, any_value(rows), pos + 1, z, min({'cost': best.cost + dear + CASE letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 + rows[pos].more ELSE rows[pos].more END, 'audit': best.audit || letter || added,
    'lines': list_concat(best.lines, CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [rows[pos].role || ':' || rows[pos].text] ELSE [CASE edge.y WHEN 2 THEN 'user:' ELSE 'assistant:' END || rows[pos].text] END, lines)})
  FROM p JOIN edge ON edge.x = p.x AND (letter = 'D' OR NOT rows[pos].must AND (letter = 'R' OR rows[pos].i = ['s', 'u', 'a'][edge.y])) JOIN behind ON behind.y = edge.y
  WHERE pos <= len(rows) GROUP BY conv_id, pos, z),
e AS (SELECT conv_id, min(best) AS best FROM p WHERE pos = len(rows) + 1 AND x IN (0, 3) GROUP BY conv_id)
SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, best.cost::BIGINT AS cost, best.audit AS audit, sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM c JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
