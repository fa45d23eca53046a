"""Cheapest repair of conversation structure by a rank-compressed dynamic program (operator 12).

A conversation is legal if its roles' initials read ``(s?(ua)+)?``: nothing, or an optional system turn
and then user and assistant in turns. Edits go through the turns in order: Keep, Rerole (to user or
assistant), Delete, and Insert (an empty user or assistant turn, anywhere). Blank and repeated turns
must be deleted; truncated turns that stay cost more. Of the cheapest ways the one whose
edits' initials are least as text wins.

The program walks the turns with four states: nothing yet, after s, after u, after a. One step is a
run of inserts and the edit of one turn, as a code such as ``IK``. No code is the start of
another, so sequences of as many codes compare like their texts, and a layer needs no texts: each state has its cost,
a pointer to the state before, the code, and its rank among the layer's states. The
ranks of the next layer follow from (rank before, code). The edits are read back along the pointers.
Inserts before a deletion are never least, since D sorts before I; runs of more than two are never cheapest.

Conversations may be of any length. Equal rows are counted before anything else, all rows are
dealt by range in the order (conversation, turn, role, text), and each piece of a conversation that
reaches over a partition's border is one table from states to states; the tables of a
conversation are joined in order, and each piece then read back with its own first and last state. So
no task holds more than a piece, and texts stay outside Python except for the digest of the
repaired text, which a conversation's rows pass one batch after another.

Defined results: a null role or text is one space; null turns come first; rows of one turn come
in the order of role and text; repeated rows are repeated turns; rows with a null id are one
conversation; a role without s, u or a at the start must be changed or deleted, and an empty one
has no initial; a conversation without rows has an empty audit; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Cuts, lean, small_batches

#: What the edits cost, and what a truncated turn costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: ASCII white space.
SPACE = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}
#: States after each initial; 0 is before any.
EMPTY, FINAL = 0, (0, 3)
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_INSERTED = {0: "u", 1: "u", 2: "a", 3: "u"}
LEGAL = ("su", "ua", "au")
FAR = 1 << 60


@dataclass(frozen=True)
class Step:
    """From one state to another: inserted initials, then the edit, with the new initial if there is one."""

    before: int
    after: int
    inserts: str
    edit: str
    role: str
    cost: int

    @property
    def code(self) -> str:
        return "I" * len(self.inserts) + self.edit


def _runs(state: int) -> Iterator[tuple[str, int]]:
    """Runs of up to two inserts, and the state after each."""
    run = ""
    for _ in range(3):
        yield run, state
        run += _INSERTED[state]
        state = _NEXT[state, _INSERTED[state]]


def steps(initial: str, truncated: bool) -> list[list[Step]]:
    """For each state after a turn, the steps that lead there."""
    out: list[list[Step]] = [[Step(q, q, "", "D", "", DELETE)] for q in range(4)]
    for q in range(4):
        for run, at in _runs(q):
            for role in "sua":
                own = role == initial
                if (at, role) in _NEXT and (own or role != "s"):
                    cost = INSERT * len(run) + TRUNCATED * truncated + REROLE * (not own)
                    out[_NEXT[at, role]].append(Step(q, _NEXT[at, role], run, "K" if own else "R", "" if own else role, cost))
    return out


STEPS = {(i, t): steps(i, t) for i in ("s", "u", "a", "") for t in (False, True)}
_CODES = {c: k for k, c in enumerate(sorted({s.code for per in STEPS.values() for to in per for s in to}))}
#: For each kind of turn and each state after it: (state before, cost, place of the code, step).
_OPTIONS = {kind: [[(s.before, s.cost, _CODES[s.code], s) for s in to] for to in per] for kind, per in STEPS.items()}
#: What may follow the last turn, by state: a run of inserts to a final state.
ENDS = {q: next((run, INSERT * len(run)) for run, at in _runs(q) if at in FINAL) for q in range(4)}


@dataclass
class Walk:
    """The layers of one piece of a conversation, from one state: costs and ranks of the last, pointers of all."""

    start: int
    cost: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    pointers: list[list[Step | None]] = field(default_factory=list)

    def __post_init__(self):
        self.cost, self.rank = [0 if q == self.start else FAR for q in range(4)], [0] * 4

    def add(self, initial: str, truncated: bool) -> None:
        cost, rank = self.cost, self.rank
        found = [min((cost[q] + c, rank[q], code, k) for k, (q, c, code, _) in enumerate(to)) for to in _OPTIONS[initial, truncated]]
        self.cost = [min(f[0], FAR) for f in found]
        order = sorted((f[1:3], q) for q, f in enumerate(found) if f[0] < FAR)
        self.rank = [0] * 4
        for place, (_, q) in enumerate(order):
            self.rank[q] = place
        self.pointers.append([_OPTIONS[initial, truncated][q][f[3]][3] if f[0] < FAR else None for q, f in enumerate(found)])

    def end(self) -> int:
        """The state of the cheapest whole walk, the least one at ties."""
        return min((self.cost[q] + ENDS[q][1], self.rank[q], q) for q in range(4))[2]

    def back(self, state: int) -> list[Step]:
        out = []
        for layer in reversed(self.pointers):
            out.append(layer[state])
            state = layer[state].before
        return out[::-1]


def _space(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the test damage, chosen by a checksum of id and turn; 0 copies is a dropped row."""
    kind = F.crc32(F.concat(_space(F.col("conv_id")), F.lit(":"), _space(F.col("turn"))).cast("binary")) % 20
    role, text = _space(F.col("role")), _space(F.col("text"))
    return turns.select(
        "conv_id", "turn",
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _records(turns: DataFrame, cuts: Cuts) -> DataFrame:
    """Distinct rows in order, written: with their number, ``fault`` of the first of each, ``initial``, ``_part`` and ``_place``.

    A null fault is none; a row that an earlier turn has is a ``duplicate``.
    """
    rows = turns.select("conv_id", "turn", _space(F.col("role")).alias("role"), _space(F.col("text")).alias("text"), "copies").withColumn("h", F.unhex(F.md5("text")))
    each = rows.groupBy("conv_id", "turn", "role", "h").agg(F.first("text").alias("text"), F.sum("copies").alias("n"))
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    # null turns are the earliest
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.where("copies > 0").groupBy("conv_id", "role", "h").agg(F.min(when).alias("w")).select(F.col("conv_id").alias("c"), F.col("w.turn").alias("t"), F.col("role").alias("r"), F.col("h").alias("f"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("f"))
    fault = F.when(trimmed == "", "blank").when(F.col("f").isNull(), "duplicate").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated")
    told = each.join(first, same, "left").select("conv_id", "turn", "role", "text", "n", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))
    order = ["conv_id", "turn", "role", "text"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = told.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    return cuts.write(placed).withColumn("_part", F.shiftright("_place", 33).cast("int"))


def _lines(batches, *names: str):
    """Rows of batches as tuples of the named columns."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _pieces(rows) -> Iterator[tuple[tuple, list]]:
    """((conversation, part), rows) for rows that begin with these two and are in order."""
    key, held = None, []
    for row in rows:
        if held and row[:2] != key:
            yield key, held
            held = []
        key = row[:2]
        held.append(row)
    if held:
        yield key, held


def _live(row) -> bool:
    """Whether the first of a record's rows may stay; rows are (conversation, part, n, fault, initial, ...)."""
    return row[2] > 0 and row[3] in (None, "truncated")


def _walked(start: int, held: list) -> Walk:
    walk = Walk(start)
    for row in held:
        if _live(row):
            walk.add(row[4] if row[4] in ("s", "u", "a") else "", row[3] == "truncated")
    return walk


def _open_pieces(slim: DataFrame) -> DataFrame:
    """(conv_id, _part, cost, rank, last): the tables of each partition's first and last conversation, 16 entries each."""

    def run(batches):
        first = last = part = None
        for key, held in _pieces(_lines(batches, "conv_id", "_part", "n", "fault", "initial")):
            if key[1] != part:
                yield from _tables(first, last)
                first, part = (key, held), key[1]
            last = (key, held)
        yield from _tables(first, last)

    def _tables(*pieces):
        found = {p[0]: p[1] for p in pieces if p}
        walks = {k: [_walked(q, held) for q in range(4)] for k, held in found.items()}
        last = {k: next((r[4] for r in reversed(held) if r[2] > 0), None) for k, held in found.items()}
        yield pa.record_batch(
            [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int32()), pa.array([[c for w in walks[k] for c in w.cost] for k in found], pa.list_(pa.int64())),
             pa.array([[r for w in walks[k] for r in w.rank] for k in found], pa.list_(pa.int32())), pa.array([last[k] for k in found], pa.string())],
            names=["conv_id", "_part", "cost", "rank", "last"],
        )

    return slim.mapInArrow(lean(run), "conv_id long, _part int, cost array<long>, rank array<int>, last string")


def _joined(pieces: pd.DataFrame) -> pd.DataFrame:
    """One conversation's tables, joined in order: each piece's first and last state, and the initial before it."""
    pieces = pieces.sort_values("_part")
    cost, rank, pointers = [0, FAR, FAR, FAR], [0] * 4, []
    for costs, ranks in zip(pieces["cost"], pieces["rank"], strict=True):
        found = [min((cost[s] + int(costs[4 * s + e]), rank[s], int(ranks[4 * s + e]), s) for s in range(4)) for e in range(4)]
        cost, pointers = [min(f[0], FAR) for f in found], [*pointers, [f[3] for f in found]]
        rank = [0] * 4
        for place, (_, e) in enumerate(sorted((f[1:3], e) for e, f in enumerate(found) if f[0] < FAR)):
            rank[e] = place
    at = min((cost[q] + ENDS[q][1], rank[q], q) for q in range(4))[2]
    ends, starts = [], []
    for layer in reversed(pointers):
        ends.append(at)
        at = layer[at]
        starts.append(at)
    before = pieces["last"].where(pieces["last"].notna(), None).ffill().shift()
    return pd.DataFrame({"conv_id": pieces["conv_id"], "_part": pieces["_part"], "first_state": starts[::-1], "last_state": ends[::-1], "before": before, "closes": [False] * (len(ends) - 1) + [True]})


def _decisions(slim: DataFrame) -> DataFrame:
    """(_place, inserts, edit, new_role, closing, illegal): what becomes of each record's first row, and the inserts after the last."""
    names = ("conv_id", "_part", "n", "fault", "initial", "_place", "first_state", "last_state", "before", "closes")

    def run(batches):
        for _, held in _pieces(_lines(batches, *names)):
            start, end, before, closes = held[0][6:]
            walk = _walked(start or EMPTY, held)
            end, closes = (walk.end(), True) if end is None else (end, closes)
            path = iter(walk.back(end))
            out = []
            for row in held:
                step = next(path) if _live(row) else Step(0, 0, "", "D" if row[2] else "", "", 0)
                illegal = 0
                if row[2]:
                    illegal = row[2] - 1 + (before is not None and before + row[4] not in LEGAL)
                    before = row[4]
                out.append((row[5], step.inserts, step.edit, NAMES.get(step.role), "", illegal))
            if closes:
                out[-1] = (*out[-1][:4], ENDS[end][0], out[-1][5])
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_place", "inserts", "edit", "new_role", "closing", "illegal"])

    return slim.mapInArrow(lean(run), "_place long, inserts string, edit string, new_role string, closing string, illegal long")


def edited(turns: DataFrame) -> DataFrame:
    """A row per distinct turn: ``conv_id``, ``turn``, ``role``, ``text``, ``n`` rows of it, the first one's ``fault``, ``illegal`` pairs that end in it, and its edits.

    ``inserts`` are initials of turns to insert before it, ``edit`` is the initial of the first row's
    edit (others are deleted), ``new_role`` is set if that is R, ``closing`` are inserts after it. ``place`` gives the
    order. ``turns`` has conv_id, turn, role, text, and ``copies`` if a row may stand for several or none.
    """
    spark = turns.sparkSession
    small_batches(spark)
    cuts = Cuts(spark, "repair")
    rows = _records(turns if "copies" in turns.columns else turns.withColumn("copies", F.lit(1)), cuts)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartitionById(parts, F.col("_part")).sortWithinPartitions("_place")
    slim = rows.select("conv_id", "_part", "_place", "n", "fault", "initial")
    solved = _open_pieces(dealt(slim)).groupBy("conv_id").applyInPandas(_joined, "conv_id long, _part int, first_state int, last_state int, before string, closes boolean")
    solved = cuts.write(solved).withColumnsRenamed({"conv_id": "c", "_part": "p"})
    # two rows a partition at most
    marked = slim.join(F.broadcast(solved), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("_part") == F.col("p")), "left").drop("c", "p")
    return rows.drop("_part").join(_decisions(dealt(marked)), "_place").withColumnRenamed("_place", "place")


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, place, nth, role, text): the turns of the repaired conversations, ordered by place and nth."""
    rows = edited(turns)
    added = lambda c: F.transform(F.filter(F.split(c, ""), lambda i: i != ""), lambda i: F.struct(F.when(i == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("edit").isin("K", "R"), F.array(F.struct(F.coalesce("new_role", "role").alias("role"), "text"))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    made = rows.select("conv_id", "place", F.posexplode(F.concat(added(F.col("inserts")), own, added(F.col("closing")))).alias("nth", "t"))
    return made.select("conv_id", "place", "nth", "t.role", "t.text")


@dataclass
class Account:
    """What a digest says of one conversation, added up row by row."""

    conv: int | None
    known: list = field(default_factory=lambda: [None, None, 0])  # least, last and number of turns
    counts: dict = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated"), 0))
    illegal: int = 0
    cost: int = 0
    audit: list = field(default_factory=list)
    sha: object = field(default_factory=hashlib.sha256)
    began: bool = False

    def say(self, role: str, text: str) -> None:
        self.sha.update(("\n" * self.began + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.began = True

    def add(self, turn, role, text, n, fault, inserts, edit, new_role, closing, illegal) -> None:
        if n and turn is not None and turn != self.known[1]:
            self.known = [turn if self.known[0] is None else self.known[0], turn, self.known[2] + 1]
        if n:
            dead = fault in ("blank", "duplicate")
            self.counts["duplicate"] += 0 if dead else n - 1
            if fault:
                self.counts[fault] += n if dead else 1
        self.illegal += illegal
        self.cost += INSERT * len(inserts + closing) + (DELETE * (n - 1) if n else 0)
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "": 0}[edit] + (TRUNCATED if edit in ("K", "R") and fault == "truncated" else 0)
        for i in inserts:
            self.say(NAMES[i], "")
        if edit in ("K", "R"):
            self.say(new_role or role, text)
        for i in closing:
            self.say(NAMES[i], "")
        self.audit.append("I" * len(inserts) + edit + "D" * (n - 1) + "I" * len(closing))

    def row(self) -> tuple:
        least, most, n = self.known
        return (self.conv, most - least + 1 - n if n else 0, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


_DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digest(conversations: DataFrame) -> DataFrame:
    """The damaged conversations' faults and cheapest repairs; a conversation's rows pass one task in order, batch by batch."""
    names = ("conv_id", "turn", "role", "text", "n", "fault", "inserts", "edit", "new_role", "closing", "illegal")
    rows = edited(damaged(conversations)).select(*names, "place")

    def run(batches):
        def out(accounts):
            columns = list(zip(*(a.row() for a in accounts), strict=True))
            return pa.record_batch([pa.array(c, pa.string() if k > 6 else pa.int64()) for k, c in enumerate(columns)], names=[f.split()[0] for f in _DIGEST.split(", ")])

        own, done = None, []
        for row in _lines(batches, *names):
            if own is None or own.conv != row[0]:
                if own:
                    done.append(own)
                own = Account(row[0])
                if len(done) >= 4096:
                    yield out(done)
                    done = []
            own.add(*row[1:])
        if own:
            yield out([*done, own])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(lean(run), _DIGEST)


def _oracle() -> str:
    """The same with the audits themselves as texts, row by row; inserts are steps of their own."""
    least = lambda *options: "list_min(list_filter([" + ", ".join(options) + "], lambda z: z IS NOT NULL))"
    plus = lambda b, cost, code: f"CASE WHEN {b} IS NOT NULL THEN {{'c': {b}.c + {cost}, 'a': {b}.a || '{code}'}} END"
    more = lambda b: (b[0], b[1], least(b[2], *(plus(b[q], 5, "I") for q in (0, 1, 3))), least(b[3], plus(b[2], 5, "I")))
    once = [f"{e} AS i{q}" for q, e in enumerate(more(["b0", "b1", "b2", "b3"]))]
    twice = [f"{e} AS j{q}" for q, e in enumerate(more(["i0", "i1", "i2", "i3"]))]
    turn = lambda b, own: f"CASE WHEN {b} IS NOT NULL AND (initial = '{own}' OR '{own}' <> 's') THEN {{'c': {b}.c + t + CASE WHEN initial = '{own}' THEN 0 ELSE 1 END, 'a': {b}.a || CASE WHEN initial = '{own}' THEN 'K' ELSE 'R' END}} END"
    to = {0: [], 1: [("j0", "s")], 2: [("j0", "u"), ("j1", "u"), ("j3", "u")], 3: [("j2", "a")]}
    after = [f"CASE WHEN dead THEN {plus(f'b{q}', 2, 'D')} ELSE {least(plus(f'b{q}', 2, 'D'), *(turn(b, own) for b, own in to[q]))} END" for q in range(4)]
    kind = "STRUCT(c BIGINT, a VARCHAR)"
    ends = least("b0", "b3", plus("b2", 5, "I"), plus("b1", 10, "II"))
    space = " || ".join(f"chr({k})" for k in (32, 9, 10, 11, 12, 13))
    return f"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS x FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(x, CAST(2 * j - 1 AS BIGINT), 2))::BIGINT FOR j IN range(1, strlen(x) // 2 + 1)]),
  lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295) % 20 AS kind FROM keyed, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
seq AS (SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS earlier, rtrim(text, {space}) AS body FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
told AS (SELECT *, left(role, 1) AS initial, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seq),
walk(conv_id, i, b0, b1, b2, b3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': ''}}, NULL::{kind}, NULL::{kind}, NULL::{kind} FROM conversations
  UNION ALL SELECT conv_id, i, {", ".join(after)} FROM (
    SELECT *, {", ".join(twice)} FROM (SELECT w.*, {", ".join(once)} FROM (
      SELECT p.conv_id, s.i, s.initial, s.role, s.text, s.fault IN ('blank', 'duplicate') AS dead, CASE WHEN s.fault = 'truncated' THEN 5 ELSE 0 END AS t, b0, b1, b2, b3 FROM walk p JOIN told s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.i = p.i + 1) w))
), done AS (SELECT conv_id, {ends} AS best FROM walk QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
-- each edit of the audit, with the row it is for: inserts count none
marks AS (SELECT conv_id, unnest(string_split(best.a, '')) AS e, generate_subscripts(string_split(best.a, ''), 1) AS k FROM done WHERE best.a <> ''),
placed AS (SELECT *, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS i, sum(CASE WHEN e = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS n FROM marks),
named AS (SELECT p.conv_id, p.k, p.n, p.e, t.role, CASE WHEN p.e = 'I' THEN '' ELSE t.text END AS text FROM placed p LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i WHERE p.e <> 'D'),
-- whether a conversation begins with a kept system turn tells which places are users
heads AS (SELECT conv_id, CAST(max(CASE WHEN n = 1 AND e = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) AS BIGINT) AS s FROM named GROUP BY conv_id),
texts AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (n - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS said FROM named JOIN heads h USING (conv_id) GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id)
SELECT done.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM done LEFT JOIN counts USING (conv_id) LEFT JOIN texts USING (conv_id)
"""


ORACLE_SQL = _oracle()
