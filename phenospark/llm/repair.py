"""Conversation structure repair: the cheapest edits after which roles read ``(s?(ua)+)?``.

Rows of a conversation are taken by turn (nulls first; equal turns by role, then text). A row's
first fault counts: blank (no word), duplicate (role and text seen earlier), truncated (last
character not ``.``, ``!`` or ``?``). Edits: Keep costs 0, Rerole to user or assistant 1, Delete 2 (the
only one for blank and duplicate rows), Insert an empty user or assistant row 5; a truncated row
that stays costs 5 more. The audit lists the edits' initials; of equally cheap audits the least in
ASCII order is taken.

Search is iterative-deepening A*: a depth-first search tries edits in the order D, I, K, R under a
cost bound that rises by one; the bound left to each (row, state) that failed is remembered, so
nothing is tried twice with no more to spend; the first path found is cheapest and least.

No conversation has to fit a task. Equal rows are counted before they are shuffled, rows are laid
out by range of (conversation, turn, ...), and each task cuts its rows into runs of at most
``RUN`` rows. Inside a run the search works on pieces of ``PIECE`` rows, once for each pair of
states before and after the piece; pieces, then runs, are put together by cost and order. That is
exact, since a cheapest repair never inserts: leaving out the inserted row, the other half of its
pair and, should no pair remain, the system row costs at most 4. So equally cheap paths have equal lengths, and two
paths that reach different states differ. Only runs at the edge of a task's rows, or longer ones, are combined
across tasks, from fixed-size summaries; hashing a conversation's text is one ordered pass.

Defined results: null roles and texts count as one space, whose initial is no legal role, nor is
that of an empty role. Null conv_ids form one conversation, null turns come first and have no part
in gaps. Gaps beyond the largest bigint are given as that. Conversations without rows give zeros, an
empty audit and the hash of the empty string. Equal rows count as often as they occur. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from phenospark.llm.common import prepare
from phenospark.operators.joins import lookup
from phenospark.runtime import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
PIECE = 32
RUN = 1024
RUN_CHARS = 4 << 20
LONGEST = (1 << 63) - 1

# States: nothing yet, after a system row, after a user row, after an assistant row.
STATES = range(4)
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state after a rerolled or inserted row, and its role.
TURNED = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
WHOLE = (0, 3)
FINE, GONE, CUT = 0, 1, 2


def least_costs(rows: list[tuple[str, int]]) -> list[int]:
    """For each row the least that it and all after it can cost, whatever the state."""
    least = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        initial, fault = rows[i]
        least[i] = least[i + 1] + (DELETE if fault else KEEP if initial and initial in "sua" else REROLE)
    return least


def cheapest(rows: list[tuple[str, int]], start: int, goal: int, failed: dict, least: list[int] | None = None) -> tuple[int, str] | None:
    """(cost, audit) from state ``start`` before the rows to state ``goal`` after them.

    ``rows`` holds (initial, FINE or GONE or CUT). ``failed`` keeps, for one goal, the largest
    bound left with which (row, state) was tried in vain. None if the goal can't be reached.
    """
    n = len(rows)
    # nothing leads back to the first two states
    if start > goal and goal < 2 or start < goal == 1 and not any(a == "s" and f != GONE for a, f in rows):
        return None
    least = least or least_costs(rows)
    for bound in range(least[0], DELETE * n + 2 * INSERT + 1):
        # frames: (row, state, bound left, next edit to try)
        path, frames = [], [[0, start, bound, 0]]
        while frames:
            frame = frames[-1]
            i, state, left, edit = frame
            if edit == 0:
                if i == n and state == goal:
                    return bound - left, "".join(path)
                if least[i] > left or state > goal and goal < 2 or failed.get((i, state), -1) >= left:
                    edit = 4
            frame[3] = edit + 1
            if edit >= 4:
                failed[i, state] = max(left, failed.get((i, state), -1))
                frames.pop()
                if path:
                    path.pop()
                continue
            initial, fault = rows[i] if i < n else ("", GONE)
            stays = TRUNCATED if fault == CUT else 0
            if edit == 0 and i < n:
                name, cost, step, after = "D", DELETE, 1, state
            elif edit == 1:
                name, cost, step, after = "I", INSERT, 0, TURNED[state][0]
            elif edit == 2 and fault != GONE and initial in NEXT[state]:
                name, cost, step, after = "K", KEEP + stays, 1, NEXT[state][initial]
            elif edit == 3 and fault != GONE:
                name, cost, step, after = "R", REROLE + stays, 1, TURNED[state][0]
            else:
                continue
            if cost <= left:
                path.append(name)
                frames.append([i + step, after, left - cost, 0])
    return None


@dataclass
class Joined:
    """Cheapest ways from each entry state through the stretches added so far.

    ``way[p][q]`` is (cost, rank) or None; ranks order the audits of one entry. ``back`` has, per
    stretch, the state before it for each (entry, state after).
    """

    entries: tuple[int, ...]
    way: dict[int, list] = field(init=False)
    back: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.way = {p: [(0, 0) if q == p else None for q in STATES] for p in self.entries}

    def add(self, cost: dict[tuple[int, int], int], order: dict[tuple[int, int], object]) -> None:
        """Append a stretch: costs by (state before, after), and what orders its audits."""
        back = {}
        for p in self.entries:
            found = []
            for q in STATES:
                ways = [(self.way[p][m][0] + cost[m, q], self.way[p][m][1], m) for m in STATES if self.way[p][m] and (m, q) in cost]
                if ways:
                    total, rank, m = min(ways)
                    back[p, q] = m
                    found.append(((rank, order[m, q]), q, total))
            self.way[p] = [None] * 4
            for rank, (_, q, total) in enumerate(sorted(found)):
                self.way[p][q] = (total, rank)
        self.back.append(back)

    def best(self, entry: int) -> int:
        """The whole state that ends the cheapest, least way."""
        return min((self.way[entry][q], q) for q in WHOLE if self.way[entry][q])[1]

    def states(self, entry: int, last: int) -> list[int]:
        """The states before each stretch and after the last."""
        out = [last]
        for back in reversed(self.back):
            out.append(back[entry, out[-1]])
        return out[::-1]


class Pieces:
    """Rows of one run, searched piece by piece."""

    def __init__(self, entries: tuple[int, ...]):
        self.joined, self.found, self.waiting = Joined(entries), [], []

    def add(self, initial: str, fault: int) -> None:
        self.waiting.append((initial, fault))
        if len(self.waiting) == PIECE:
            self.search()

    def search(self, goals: tuple[int, ...] = tuple(STATES)) -> None:
        if not self.waiting:
            return
        live = {m for p in self.joined.entries for m in STATES if self.joined.way[p][m]}
        found, least = {}, least_costs(self.waiting)
        for q in goals:
            failed: dict = {}
            for m in live:
                hit = cheapest(self.waiting, m, q, failed, least)
                if hit:
                    found[m, q] = hit
        self.joined.add({k: c for k, (c, _) in found.items()}, {k: a for k, (_, a) in found.items()})
        self.found.append({k: a for k, (_, a) in found.items()})
        self.waiting = []

    def audit(self, entry: int, last: int) -> str:
        at = self.joined.states(entry, last)
        return "".join(piece[at[i], at[i + 1]] for i, piece in enumerate(self.found))


def rewritten(audit: str, entry: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """Roles and texts after the edits of an audit that starts in state ``entry``."""
    i, state = 0, entry
    for edit in audit:
        after, turned = TURNED[state]
        if edit == "K":
            state = NEXT[state][roles[i][0]]
            yield roles[i], texts[i]
        elif edit in "IR":
            state = after
            yield turned, "" if edit == "I" else texts[i]
        i += edit != "I"


COUNTS = ("n", "turns", "blank", "duplicate", "truncated", "illegal")
SUMMARY = (
    "conv_id bigint, whole boolean, pid int, run int, n bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "least bigint, most bigint, first string, last string, costs array<bigint>, ranks array<int>"
)
RUNS = f"{SUMMARY}, audits array<string>, roles array<string>, texts array<string>"
LEGAL = ("su", "ua", "au")


class Run:
    """Consecutive rows of one conversation in one task."""

    def __init__(self, conv, pid: int, number: int, opens: bool):
        self.conv, self.pid, self.number, self.opens = conv, pid, number, opens
        self.counts = dict.fromkeys(COUNTS, 0)
        self.least = self.most = self.first = self.last = None
        self.roles, self.texts, self.chars = [], [], 0
        self.pieces = Pieces((0,) if opens else tuple(STATES))

    def add(self, turn, role: str, text: str, fault: str) -> None:
        c = self.counts
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most = turn
            c["turns"] += 1
        c["n"] += 1
        if fault:
            c[fault] += 1
        initial = role[:1]
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            c["illegal"] += 1
        self.last = initial
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)
        self.pieces.add(initial, FINE if not fault else CUT if fault == "truncated" else GONE)

    def record(self, whole: bool) -> dict:
        """A whole run is repaired here; others keep their rows and the audit of each pair of states."""
        p = self.pieces
        p.search(WHOLE if whole else tuple(STATES))
        out = {"conv_id": self.conv, "whole": whole, "pid": self.pid, "run": self.number, **self.counts,
               "least": self.least, "most": self.most, "first": self.first, "last": self.last}
        ways = {(a, b): p.joined.way[a][b] for a in p.joined.entries for b in STATES}
        if whole:
            end = p.joined.best(0)
            audit = p.audit(0, end)
            done = list(rewritten(audit, 0, self.roles, self.texts))
            return out | {"costs": [ways[0, end][0]], "ranks": [0], "audits": [audit], "roles": [r for r, _ in done], "texts": [t for _, t in done]}
        pairs = [(a, b) for a in STATES for b in STATES]
        held = [ways.get(k) for k in pairs]
        return out | {
            "costs": [w and w[0] for w in held], "ranks": [w and w[1] for w in held],
            "audits": [w and p.audit(*k) for k, w in zip(pairs, held)], "roles": self.roles, "texts": self.texts}


def batch_of(rows: list[dict], schema: str) -> pa.RecordBatch:
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = []
    for part in schema.split(", "):
        name, kind = part.split(" ")
        of = kind.removeprefix("array<").removesuffix(">")
        fields.append(pa.field(name, pa.list_(types[of]) if kind != of else types[of]))
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a task's ordered rows. A run that may go on in another task or record isn't whole."""
    pid = TaskContext.get().partitionId()
    run: Run | None = None
    edge = True  # of the current run: at the edge of the task's rows or of a longer conversation
    out = []
    for batch in batches:
        for row in batch.to_pylist():
            if run is None or row["conv_id"] != run.conv:
                if run is not None:
                    out.append(run.record(not edge))
                edge = run is None
                run = Run(row["conv_id"], pid, 0, not edge)
            for copy in range(row["copies"]):
                if len(run.roles) >= RUN or run.chars >= RUN_CHARS:
                    out.append(run.record(False))
                    run, edge = Run(run.conv, pid, run.number + 1, False), True
                seen = row["seen"] or copy
                fault = "blank" if row["blank"] else "duplicate" if seen else "" if row["ended"] else "truncated"
                run.add(row["turn"], row["role"], row["text"], fault)
                if len(out) >= 256 or sum(len(o["texts"]) for o in out[-8:]) >= 2 * RUN:
                    yield batch_of(out, RUNS)
                    out = []
    if run is not None:
        out.append(run.record(False))
    if out:
        yield batch_of(out, RUNS)


def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[dict]]]:
    """Consecutive rows with one conv_id, one conversation's rows at a time."""
    conv, held, started = None, [], False
    for batch in batches:
        for row in batch.to_pylist():
            if started and row["conv_id"] != conv:
                yield conv, held
                held = []
            conv, started = row["conv_id"], True
            held.append(row)
    if started:
        yield conv, held


ROUTE = "conv_id bigint, pid int, run int, entry int, leave int, cost bigint, n bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"


def gaps_of(least, most, turns: int) -> int:
    return 0 if least is None else min(most - least + 1 - turns, LONGEST)


def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the summaries of a conversation's runs, in order, the states each run starts and ends in."""
    for conv, runs in ordered(batches):
        joined, total = Joined((0,)), dict.fromkeys(COUNTS, 0)
        least = most = last = None
        for r in runs:
            pairs = {(a, b): i for i, (a, b) in enumerate((a, b) for a in STATES for b in STATES) if r["costs"][i] is not None}
            joined.add({k: r["costs"][i] for k, i in pairs.items()}, {k: r["ranks"][i] for k, i in pairs.items()})
            for c in COUNTS:
                total[c] += r[c]
            if r["first"] is not None:
                total["illegal"] += last is not None and last + r["first"] not in LEGAL
                last = r["last"]
            if r["least"] is not None:
                total["turns"] -= most == r["least"]
                least, most = (r["least"] if least is None else least), r["most"]
        end = joined.best(0)
        at = joined.states(0, end)
        whole = {"cost": joined.way[0][end][0], "gaps": gaps_of(least, most, total["turns"]), **{c: total[c] for c in ("n", "blank", "duplicate", "truncated", "illegal")}}
        for start in range(0, len(runs), 4096):
            yield batch_of([
                {"conv_id": conv, "pid": r["pid"], "run": r["run"], "entry": at[i], "leave": at[i + 1], **whole}
                for i, r in enumerate(runs[start : start + 4096], start)], ROUTE)


LINES = "conv_id bigint, whole boolean, pid int, run int, cost bigint, n bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, audit string, roles array<string>, texts array<string>"


def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with their entry and end state known: their audit and repaired rows."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            audit = r["audits"][4 * r["entry"] + r["leave"]]
            done = list(rewritten(audit, r["entry"], r["roles"], r["texts"]))
            keep = ("conv_id", "whole", "pid", "run", "cost", "n", "gaps", "blank", "duplicate", "truncated", "illegal")
            out.append({c: r[c] for c in keep} | {"audit": audit, "roles": [a for a, _ in done], "texts": [b for _, b in done]})
        if out:
            yield batch_of(out, LINES)


RESULT = "conv_id bigint, n bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its repaired runs in order; only the hash state and the audit
    are held."""
    def finished(first, audit, sha):
        keep = ("conv_id", "n", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        return {c: first[c] for c in keep} | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

    first, audit, sha, empty, out = None, [], None, True, []
    for batch in batches:
        for r in batch.to_pylist():
            if first is None or r["conv_id"] != first["conv_id"]:
                if first is not None:
                    out.append(finished(first, audit, sha))
                first, audit, sha, empty = {k: v for k, v in r.items() if k not in ("roles", "texts")}, [], hashlib.sha256(), True
            audit.append(r["audit"])
            for role, text in zip(r["roles"], r["texts"]):
                sha.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
                empty = False
        if out:
            yield batch_of(out, RESULT)
            out = []
    if first is not None:
        out.append(finished(first, audit, sha))
    if out:
        yield batch_of(out, RESULT)


@dataclass(frozen=True)
class Repaired:
    """``conversations``: one row each, with counts, cost, audit and hash. ``turns``: the repaired
    rows (conv_id, pid, run, position, role, text), in the order of these numbers."""

    conversations: DataFrame
    runs: DataFrame

    @property
    def turns(self) -> DataFrame:
        return self.runs.select("conv_id", "pid", "run", F.posexplode(F.arrays_zip("roles", "texts")).alias("position", "t")).select(
            "conv_id", "pid", "run", "position", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


def spaced(c: str) -> Column:
    """The column as text, nulls as one space."""
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def repair(turns: DataFrame) -> Repaired:
    """Repair conversations of (conv_id, turn, role, text); an optional ``copies`` column says how
    often a row occurs (0: only its conversation is known)."""
    spark = turns.sparkSession
    prepare(spark)
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        spaced("role").alias("role"), spaced("text").alias("text"), copies.cast("bigint").alias("copies"))
    # equal rows shrink to one before they meet
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("key", F.md5(F.concat_ws("\0", F.length("role"), "role", "text")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.where("copies > 0").groupBy(F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("nc"), "key").agg(F.min(place).alias("first"))
    keyed = rows.withColumn("c", F.coalesce("conv_id", F.lit(0))).withColumn("nc", F.col("conv_id").isNull())
    marked = lookup(keyed, first, ["c", "nc", "key"], "left")
    last = F.substring(F.rtrim(F.regexp_replace("text", r"[\x09-\x0D]", " ")), -1, 1)
    marked = marked.select(
        "conv_id", "turn", "role", "text", "copies",
        F.coalesce(place > F.col("first"), F.lit(False)).alias("seen"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), last.isin(".", "!", "?").alias("ended"))
    # the start of the text only deals rows out; rows that share it are ordered by the whole text
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = marked.repartitionByRange(parts, *order, F.substring("text", 1, 200).asc()).sortWithinPartitions(*order, F.col("text").asc())
    runs = materialize(laid.mapInArrow(cut_runs, RUNS), "runs")
    edges = runs.where("not whole")
    skinny = edges.select(*[p.split(" ")[0] for p in SUMMARY.split(", ")])
    by_conv = [F.col("conv_id").asc_nulls_first(), "pid", "run"]
    routes = skinny.repartition("conv_id").sortWithinPartitions(*by_conv).mapInArrow(route, ROUTE)
    known = edges.select("whole", F.col("pid").alias("p"), F.col("run").alias("r"), F.col("conv_id").alias("i"), "audits", "roles", "texts").join(
        routes, F.col("i").eqNullSafe(F.col("conv_id")) & (F.col("p") == F.col("pid")) & (F.col("r") == F.col("run"))).drop("p", "r", "i")
    rewritten_edges = known.mapInArrow(rewrite, LINES)
    whole = runs.where("whole").select(
        "conv_id", "whole", "pid", "run", F.col("costs")[0].alias("cost"), "n",
        gaps_column().alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("audits")[0].alias("audit"), "roles", "texts")
    edge_lines = materialize(rewritten_edges, "edges")
    ends = edge_lines.repartition("conv_id").sortWithinPartitions(*by_conv).mapInArrow(digest, RESULT)
    names = [p.split(" ")[0] for p in RESULT.split(", ")]
    lines = F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit(":"), t["texts"]))
    sha = F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256")
    done = whole.withColumn("repaired_sha256", sha).select(*names)
    return Repaired(done.unionByName(ends), whole.unionByName(edge_lines.select(*whole.columns)))


def gaps_column() -> Column:
    span = F.col("most").cast("decimal(38,0)") - F.col("least").cast("decimal(38,0)") + 1 - F.col("turns")
    return F.when(F.col("least").isNull(), F.lit(0)).otherwise(F.least(span, F.lit(LONGEST).cast("decimal(38,0)"))).cast("bigint")


def damage(turns: DataFrame) -> DataFrame:
    """Rows with planted faults by crc32 of ``conv_id:turn``, as (conv_id, turn, role, text, copies).

    A dropped row leaves its conv_id behind, with copies 0.
    """
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    gone = kind == 0
    text = F.when(gone | (kind == 1), "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    return turns.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(kind == 4, "user").otherwise(spaced("role")).alias("role"),
        text.alias("text"), F.when(gone, 0).when(kind == 3, 2).otherwise(1).alias("copies"))
