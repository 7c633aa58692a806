"""Conversation structure repair by a min-plus matrix scan.

The roles of a well-formed conversation read ``(s?(ua)+)?`` by their initials. Read from left to right, that takes four
states: nothing yet, after a system turn, after a user turn, after an assistant turn. A turn is a 4x4 matrix: the entry from
one state to another holds the cheapest edits that lead there, as (cost, audit) with the audit as the tie-breaker, and turns
may be inserted before it (the insert closure). Matrices multiply with "min" for plus and "append" for times. An audit
names its own cost, so no audit is the beginning of another one of equal cost, and the order of audits survives appending:
the product is associative, and a conversation may be cut anywhere and reduced as a tree.

Turns are range-partitioned by conversation and turn. A task reduces each conversation that lies wholly inside its range;
those at the ends of its range, and stretches of very long ones, leave as one matrix for each stretch, and only these
matrices meet by conversation. From the product back down the tree, each stretch learns the state that it starts in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut

NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
SPACES, ENDINGS = " \t\n\v\f\r", ".!?"
LEGAL = {"su", "ua", "au"}
STRETCH, STRETCH_CHARS = 512, 1 << 16  # rows and characters of a conversation that a task holds
CACHED = 8  # turns; the products of so many are kept, as the same few recur

Matrix = tuple  # 16 entries by (from, to): (cost, audit), or None


def _times(x: Matrix, y: Matrix) -> Matrix:
    out = []
    for i in range(0, 16, 4):
        for j in range(4):
            ways = [(a[0] + b[0], a[1], b[1]) for k in range(4) if (a := x[i + k]) and (b := y[4 * k + j])]
            least = min((w[0] for w in ways), default=None)
            out.append(None if least is None else (least, min(p + q for c, p, q in ways if c == least)))
    return tuple(out)


def _closure() -> Matrix:
    reach: list = [[None] * 4 for _ in range(4)]
    for i in range(4):
        at, n = i, 0
        while at is not None and reach[i][at] is None:
            reach[i][at] = (INSERT * n, "I" * n)
            at, n = next((NEXT[c][at] for c in "ua" if at in NEXT[c]), None), n + 1
    return tuple(x for row in reach for x in row)


CLOSURE = _closure()


@lru_cache(maxsize=None)  # nine kinds
def _turn(kind: str) -> Matrix:
    """The matrix of one turn: its initial (s, u, a, or - for any other), upper-case or _ if truncated; d if it must go."""
    ways: dict = {(i, i): [(DELETE, "D")] for i in range(4)}
    if kind != "d":
        more = TRUNCATED * (kind.isupper() or kind == "_")
        for c, to in NEXT.items():
            for i, j in to.items():
                if c == kind.lower():
                    ways.setdefault((i, j), []).append((KEEP + more, "K"))
                if c in NAMES:
                    ways.setdefault((i, j), []).append((REROLE + more, "R"))
    return _times(CLOSURE, tuple(min(ways[i, j]) if (i, j) in ways else None for i in range(4) for j in range(4)))


@lru_cache(maxsize=1 << 14)
def _few(kinds: str) -> Matrix:
    if len(kinds) == 1:
        return _turn(kinds)
    return _times(_few(kinds[: len(kinds) // 2]), _few(kinds[len(kinds) // 2 :]))


def _tree(kinds: str) -> Matrix:
    if len(kinds) <= CACHED:
        return _few(kinds)
    half = (len(kinds) // 2 + CACHED - 1) // CACHED * CACHED
    return _times(_tree(kinds[:half]), _tree(kinds[half:]))


def _least(m: Matrix) -> tuple[int, str, int]:
    """Cost, audit and final state of a whole conversation, further turns inserted at its end if need be."""
    end = _times(m, CLOSURE)
    return min((*end[j], j) for j in (NONE, ASSISTANT) if end[j])


def rewrite(roles: list[str], texts: list[str], audit: str, state: int) -> tuple[list[str], list[str]]:
    """The turns that the audit makes of these, begun in ``state``: it decides which role a rerole or an insert means."""
    out_roles, out_texts, k = [], [], 0
    for letter in audit:
        if letter != "D":
            role = roles[k] if letter == "K" else NAMES["a" if state == USER else "u"]
            state = NEXT[role[0]][state]
            out_roles.append(role)
            out_texts.append("" if letter == "I" else texts[k])
        k += letter != "I"
    return out_roles, out_texts


class _Stretch:
    """Consecutive rows of one conversation; what two neighbours know is enough for their union."""

    def __init__(self) -> None:
        self.kinds: list[str] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.first = self.last = None  # turns
        self.head = self.tail = None  # initials
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.chars = 0

    def add(self, turn: int | None, role: str, text: str, n: int, repeated: bool) -> None:
        bare, initial = text.rstrip(SPACES), role[:1]
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if not bare:
            self.blank += n
            self.kinds.append("d" * n)
        else:
            alive = not repeated
            self.duplicate += n - alive
            if alive:
                cut_off = bare[-1] not in ENDINGS
                self.truncated += cut_off
                kind = initial if initial in NEXT else "-"
                self.kinds.append(("_" if kind == "-" else kind.upper()) if cut_off else kind)
            self.kinds.append("d" * (n - alive))
        if self.head is None:
            self.head = initial
        else:
            self.illegal += self.tail + initial not in LEGAL
        self.illegal += n - 1  # a row beside its repetition
        self.tail = initial
        self.roles += [role] * n
        self.texts += [text] * n
        self.chars += len(text) * n


OPEN = "first long, last long, head string, tail string, turns long, blank long, duplicate long, truncated long, illegal long"
OPEN_NAMES = [x.split()[0] for x in OPEN.split(", ")]
SCANNED = f"conv_id long, stretch long, {OPEN}, costs array<long>, audits array<string>, roles array<string>, texts array<string>"
_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("stretch", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("head", pa.string()), ("tail", pa.string())]
    + [(x, pa.int64()) for x in OPEN_NAMES[4:]]
    + [("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation inside this range (no stretch, one audit), and one for each stretch of the others."""
    base, told, count, held = TaskContext.get().partitionId() << 32, [], 0, 0
    now, conv, whole = None, None, False  # whole: all rows of the conversation so far are in ``now``, and it begins in this range

    def leave(closed: bool) -> None:
        nonlocal count, held
        matrix = _tree("".join(now.kinds)) if any(now.kinds) else tuple((0, "") if i == j else None for i in range(4) for j in range(4))
        row = {"conv_id": conv, **{x: getattr(now, x) for x in OPEN_NAMES}}
        if closed:
            cost, audit, _ = _least(matrix)
            row["costs"], row["audits"] = [cost], [audit]
            row["roles"], row["texts"] = rewrite(now.roles, now.texts, audit, NONE)
        else:
            row |= {"stretch": base + count, "costs": [x and x[0] for x in matrix], "audits": [x and x[1] for x in matrix], "roles": now.roles, "texts": now.texts}
            count += 1
        told.append(row)
        held += now.chars

    begun = False
    for b in batches:
        for conv_id, turn, role, text, n, repeated in zip(*(b.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "n", "repeated")), strict=True):
            if now is None or conv_id != conv:
                if now is not None:
                    leave(closed=whole)
                now, conv, whole, begun = _Stretch(), conv_id, begun, True
            elif len(now.roles) >= STRETCH or now.chars >= STRETCH_CHARS:
                leave(closed=False)
                now, whole = _Stretch(), False
            if n:
                now.add(turn, role, text, n, repeated)
            if held >= STRETCH_CHARS:
                yield pa.RecordBatch.from_pylist(told, _SCHEMA)
                told, held = [], 0
    if now is not None:
        leave(closed=False)
    if told:
        yield pa.RecordBatch.from_pylist(told, _SCHEMA)


STRETCHES = "conv_id long, stretch long, state int, audit string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_STRETCHES = pa.schema([("conv_id", pa.int64()), ("stretch", pa.int64()), ("state", pa.int32()), ("audit", pa.string())] + [(x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])


def _join(table: pa.Table) -> pa.Table:
    """One conversation's stretches: the state that each starts in and its share of the audit, and a row (no stretch) for the whole."""
    rows = sorted(table.to_pylist(), key=lambda r: r["stretch"])
    leaves = [tuple(a if a is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)) for r in rows]
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_times(last[i], last[i + 1]) if i + 1 < len(last) else last[i] for i in range(0, len(last), 2)])
    whole = levels[-1][0]
    cost, audit, _ = _least(whole)
    # Which entry of the whole product the least audit begins with; turns inserted after it belong to the last stretch.
    ends = [(k, whole[k], CLOSURE[4 * k + j]) for k in range(4) for j in (NONE, ASSISTANT) if whole[k] and CLOSURE[4 * k + j]]
    goal = next(k for k, x, tail in ends if (x[0] + tail[0], x[1] + tail[1]) == (cost, audit))
    ways = [(NONE, goal)]
    for level in reversed(levels[:-1]):  # down the tree: an entry is a way through two halves
        down = []
        for n, (i, j) in enumerate(ways):
            if 2 * n + 1 == len(level):
                down.append((i, j))
                continue
            x, y = level[2 * n], level[2 * n + 1]
            k = min((x[4 * i + k][0] + y[4 * k + j][0], x[4 * i + k][1] + y[4 * k + j][1], k) for k in range(4) if x[4 * i + k] and y[4 * k + j])[2]
            down += [(i, k), (k, j)]
        ways = down
    pieces = [leaf[4 * i + j][1] for leaf, (i, j) in zip(leaves, ways, strict=True)]
    pieces[-1] += audit[sum(map(len, pieces)) :]
    sums = {x: sum(r[x] for r in rows) for x in ("turns", "blank", "duplicate", "truncated", "illegal")}
    turns = [(r["first"], r["last"]) for r in rows if r["first"] is not None]
    sums["turns"] -= sum(a[1] == b[0] for a, b in pairwise(turns))
    ends = [(r["head"], r["tail"]) for r in rows if r["head"] is not None]
    sums["illegal"] += sum(a[1] + b[0] not in LEGAL for a, b in pairwise(ends))
    gaps = turns[-1][1] - turns[0][0] + 1 - sums["turns"] if turns else 0
    out = [{"stretch": r["stretch"], "state": i, "audit": p} for r, (i, _), p in zip(rows, ways, pieces, strict=True)]
    out.append({"audit": audit, "gaps": gaps, "cost": cost, **sums})
    return pa.Table.from_pylist([{"conv_id": rows[0]["conv_id"], **x} for x in out], _STRETCHES)


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [rewrite(r, t, a, s) for r, t, a, s in zip(*(b.column(x).to_pylist() for x in ("roles", "texts", "audit", "state")), strict=True)]
        yield pa.record_batch([b.column("conv_id"), b.column("stretch"), pa.array([m[0] for m in made], pa.list_(pa.string())), pa.array([m[1] for m in made], pa.list_(pa.string()))], ["conv_id", "stretch", "roles", "texts"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which come in order; it has no parallel form, but needs one line at a time only."""
    conv, sha, ids, digests, some = None, None, [], [], False

    def end() -> None:
        ids.append(conv)
        digests.append(sha.hexdigest())

    for b in batches:
        for c, line in zip(b.column("conv_id").to_pylist(), b.column("line").to_pylist(), strict=True):
            if sha is None or c != conv:
                if sha is not None:
                    end()
                conv, sha, some = c, hashlib.sha256(), False
            if line is not None:
                sha.update((b"\n" if some else b"") + line.encode("utf-8", "surrogatepass"))
                some = True
    if sha is not None:
        end()
    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], ["conv_id", "repaired_sha256"])


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: the rows after the damage that crc32("conv_id:turn") % 20 decides, ``n`` times each.

    0 drops the row (n = 0), 1 empties its text, 2 removes ``.!?`` from it, 3 repeats it, 4 sets its role to user. A null
    role or text is one space, and so is a null in the string that is hashed. Other columns are not read.
    """
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", of("role").alias("role"), of("text").alias("text"), kind.alias("kind"))
    k = F.col("kind")
    text = F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).cast("long").alias("n"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) and their repaired turns.

    ``rows``: conv_id, turn, role, text, and n, how often the row is there (0: only its conversation is known). A
    conversation's rows are taken by turn, nulls first, then by role and text. The turns come in stretches: conv_id,
    stretch (null, or ascending), roles, texts.

    A null conv_id is a conversation; a null role or text is one space. A role without any character is like one of an
    unknown initial. Rows that repeat are duplicates, or blank; very long texts are taken whole and very long conversations
    in stretches, with an audit that must fit in one value; an empty table gives no rows. Columns other than these five are
    not read. What is returned is written in the shared folder.
    """
    spark = rows.sparkSession
    of = lambda c: F.coalesce(F.col(c), F.lit(" "))
    gone = F.col("n") == 0
    rows = rows.select("conv_id", "turn", F.when(gone, "").otherwise(of("role")).alias("role"), F.when(gone, "").otherwise(of("text")).alias("text"), "n")
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    same = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.char_length("role").cast("string"), F.lit(":"), "role", "text")
    with Scratch(spark) as scratch:
        rows = scratch.cut(rows.withColumn("same", F.sha2(same, 256)))
        # From a table of its own, so that Spark can split the rows of a text that one conversation repeats very often.
        first = scratch.cut(rows.where("n > 0").groupBy("same").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
        rows = rows.join(first, "same", "left").select("conv_id", "turn", "role", "text", "n", F.coalesce(F.struct("turn") > F.col("first"), F.lit(False)).alias("repeated"))
        ranges = rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions("conv_id", "turn", "role", "text")
        scanned = scratch.cut(ranges.mapInArrow(_scan, SCANNED))
        whole, parts = scanned.where("stretch is null"), scanned.where("stretch is not null")
        joined = scratch.cut(parts.drop("roles", "texts").groupBy("conv_id").applyInArrow(_join, STRETCHES))
        gaps = F.when(F.col("first").isNull(), 0).otherwise(F.col("last") - F.col("first") + 1 - F.col("turns"))
        known = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        found = cut(whole.withColumns({"gaps": gaps, "cost": F.col("costs")[0], "audit": F.col("audits")[0]}).select(known).unionByName(joined.where("stretch is null").select(known)))
        piece = joined.where("stretch is not null").select(F.col("stretch").alias("of"), "state", "audit")  # stretches are numbered across conversations
        texts = parts.select("conv_id", "stretch", "roles", "texts").join(piece, F.col("stretch") == F.col("of"))
        made = texts.mapInArrow(_rewritten, "conv_id long, stretch long, roles array<string>, texts array<string>")
        turns = cut(whole.select("conv_id", "stretch", "roles", "texts").unionByName(made))
    return found, turns


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, stretch, position (in the stretch), role, text: the repaired turns of ``repair``."""
    turns = repair(rows)[1].select("conv_id", "stretch", F.posexplode(F.arrays_zip("roles", "texts")).alias("position", "x"))
    return turns.select("conv_id", "stretch", "position", F.col("x.roles").alias("role"), F.col("x.texts").alias("text"))


def digest(conversations: DataFrame) -> DataFrame:
    found, turns = repair(damage(conversations))
    lines: Column = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit(":"), x["texts"]))
    lined = turns.select("conv_id", "stretch", lines.alias("lines"))
    whole = lined.where("stretch is null").select("conv_id", F.sha2(F.array_join("lines", "\n"), 256).alias("repaired_sha256"))
    parts = lined.where("stretch is not null").select("conv_id", "stretch", F.posexplode_outer("lines").alias("position", "line"))
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "position").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    hashes = whole.unionByName(parts)
    return found.join(hashes, found["conv_id"].eqNullSafe(hashes["conv_id"])).select(found["*"], "repaired_sha256")


#: The damage, the faults, and the cheapest edits turn by turn, all ways kept as (cost, audit, lines) by state.
ORACLE_SQL = """
WITH RECURSIVE
crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i))),
hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
dealt AS (SELECT conv_id, turn, role, text,
                 xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
          FROM hashed, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM dealt),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, left(role, 1) AS initial FROM damaged),
told AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS is_blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
                NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut_off, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair FROM ranked),
rows_of AS (SELECT conv_id, turn, role, text, k, initial, pair, is_blank, NOT is_blank AND again AS is_duplicate, NOT is_blank AND NOT again AND cut_off AS is_truncated FROM told),
moves(i, j, letter, name) AS (VALUES (0, 1, 's', NULL), (0, 2, 'u', 'user'), (1, 2, 'u', 'user'), (3, 2, 'u', 'user'), (2, 3, 'a', 'assistant')),
inserts(i, j, cost, audit, lines) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']),
                                             (2, 3, 5, 'I', ['assistant:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
edits AS (SELECT conv_id, k, s.i, s.i AS j, 2 AS cost, 'D' AS audit, []::VARCHAR[] AS lines FROM rows_of, (VALUES (0), (1), (2), (3)) s(i)
          UNION ALL SELECT conv_id, k, i, j, CASE WHEN is_truncated THEN 5 ELSE 0 END, 'K', [role || ':' || text] FROM rows_of JOIN moves ON initial = letter WHERE NOT is_blank AND NOT is_duplicate
          UNION ALL SELECT conv_id, k, i, j, CASE WHEN is_truncated THEN 6 ELSE 1 END, 'R', [name || ':' || text] FROM rows_of, moves WHERE name IS NOT NULL AND NOT is_blank AND NOT is_duplicate),
turns AS (SELECT conv_id, k, n.i, e.j, min({'cost': n.cost + e.cost, 'audit': n.audit || e.audit, 'lines': list_concat(n.lines, e.lines)}) AS v FROM edits e JOIN inserts n ON n.j = e.i GROUP BY ALL),
ways AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM conversations
  UNION ALL
  SELECT conv_id, k, state, v.cost, v.audit, v.lines
  FROM (SELECT w.conv_id, t.k, t.j AS state, min({'cost': w.cost + t.v.cost, 'audit': w.audit || t.v.audit, 'lines': list_concat(w.lines, t.v.lines)}) AS v
        FROM ways w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.k = w.k + 1 AND t.i = w.state GROUP BY ALL)),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_duplicate) AS duplicate,
                  count(*) FILTER (is_truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows_of GROUP BY conv_id),
best AS (SELECT w.conv_id, min({'cost': w.cost + n.cost, 'audit': w.audit || n.audit, 'lines': list_concat(w.lines, n.lines)}) AS v
         FROM ways w JOIN inserts n ON n.i = w.state LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.k = coalesce(c.n, 0) AND n.j IN (0, 3) GROUP BY w.conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, b.v.cost::BIGINT AS cost, b.v.audit AS audit, sha256(array_to_string(b.v.lines, chr(10))) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""
