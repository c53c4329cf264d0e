"""Repair of conversation structure by weighted finite-state composition.

Three machines meet in one shortest path. The input acceptor is a conversation's rows in order. The edit transducer keeps a row
(cost 0), gives it another role (2), deletes it (3; blank and repeated rows must go) or inserts an empty row (2); a row
that stays although its text is cut short costs 1 more. The role grammar accepts the initials ``(s?(ua)+)?``. The composition is
never built out: its states are (row, grammar state), and a state's edges are looked up when the search comes to its row. Weights are
(cost, label string), compared in that order. All edges that leave a state have different labels, so going backward over the rows it
is enough to hold the least cost of each state and to follow, of the cheapest edges, the one with the least label: that string
is the least of all cheapest ones.

Conversations of any length: rows are sorted over ranges of (conversation, turn), so a range's part of a conversation is a piece. A piece
yields the cheapest path from each state before it to each state after it; pieces are chained, and each piece applies
its own part of the labels. Equal rows of one turn travel as one row with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import attach, stage, width

#: Rows of a range, about; more ranges where there are more rows than the session's width of these.
RANGE_ROWS = 200_000
#: Labels and costs of the edits; what the grammar's states are left by, (initial, state after): start, after s, after u, after a.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLES = {"u": "user", "a": "assistant"}
FINAL = (0, 3)
LEGAL = ("su", "ua", "au")
_NEVER = 1 << 60
SOUND, TRUNCATED, MUST_GO = 0, 1, 2


def _expected(state: int) -> str:
    """The initial that an inserted or reroled row has in a state."""
    return "a" if state == 2 else "u"


def _edges(initial: str, kind: int) -> list[list[tuple[int, str, int]]]:
    """For each state the edges over a row, (cost, label, state after), least label first."""
    out = []
    for state in range(4):
        edges = [(DELETE, "D", state)]
        if kind != MUST_GO:
            more = CUT if kind == TRUNCATED else 0
            if initial in NEXT[state]:
                edges.append((KEEP + more, "K", NEXT[state][initial]))
            edges.append((REROLE + more, "R", NEXT[state][_expected(state)]))
        out.append(edges)
    return out


_EDGES = {(i, k): _edges(i, k) for i in ("s", "u", "a", "") for k in (SOUND, TRUNCATED, MUST_GO)}
_INSERT = [NEXT[state][_expected(state)] for state in range(4)]


class Suffixes:
    """The least costs from each state before each row to a wanted end, and the path of least labels among the cheapest.

    ``rows`` are (initial, kind, copies); copies after the first must go.
    """

    def __init__(self, rows: list[tuple[str, int, int]], ends: list[int]):
        self.rows, after = rows, self._inserted(ends)
        self.after = [after]  # costs before each row, insertions included, from the last row to the first
        for initial, kind, copies in reversed(rows):
            extra = DELETE * (copies - 1)
            edges = _EDGES[initial, kind]
            after = self._inserted([min([c + after[s] for c, _, s in edges[state]]) + extra for state in range(4)])
            self.after.append(after)
        self.ends = ends

    @staticmethod
    def _inserted(costs: list[int]) -> list[int]:
        once = [min(costs[s], INSERT + costs[_INSERT[s]]) for s in range(4)]
        return [min(once[s], INSERT + once[_INSERT[s]]) for s in range(4)]

    def path(self, state: int) -> tuple[int, str]:
        """(cost, labels) of the least path from a state before the first row; the cost is ``_NEVER`` or more where there is none."""
        total = self.after[-1][state]
        if total >= _NEVER:
            return total, ""
        labels, left = [], total
        for at, (initial, kind, copies) in enumerate(self.rows):
            nxt = self.after[len(self.rows) - at - 1]
            extra = DELETE * (copies - 1)
            while True:
                edge = next(((c, lab, s) for c, lab, s in _EDGES[initial, kind][state] if lab == "D" and c + extra + nxt[s] == left), None)
                if edge is None and INSERT + self.after[len(self.rows) - at][_INSERT[state]] == left:
                    labels.append("I")
                    left, state = left - INSERT, _INSERT[state]
                    continue
                c, lab, s = edge or next((c, lab, s) for c, lab, s in _EDGES[initial, kind][state] if c + extra + nxt[s] == left)
                labels.append(lab + "D" * (copies - 1))
                left, state = left - c - extra, s
                break
        while self.ends[state] != left:
            labels.append("I")
            left, state = left - INSERT, _INSERT[state]
        return total, "".join(labels)


def cheapest(rows: list[tuple[str, int, int]], state: int = 0) -> tuple[int, str]:
    """(cost, labels) of the repair of whole conversations; initials other than s, u and a are given as empty strings."""
    return Suffixes(rows, [0 if s in FINAL else _NEVER for s in range(4)]).path(state)


def apply_labels(labels: str, rows: Iterator[tuple[str, str, int]], state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of what ``labels`` leave of the rows (role, text, copies) from a grammar state on."""
    at, rows = 0, iter(rows)
    while at < len(labels):
        if labels[at] == "I":
            at += 1
            yield ROLES[_expected(state)], ""
            state = _INSERT[state]
            continue
        role, text, copies = next(rows)
        if labels[at] != "D":
            if labels[at] == "R":
                role = ROLES[_expected(state)]
            yield role, text
            state = NEXT[state][role[0]]
        at += copies


# Rows, sorted and numbered

def _faults(rows: DataFrame) -> DataFrame:
    """Adds mark, blank and cut to rows of role and text."""
    return rows.withColumns({
        "mark": F.xxhash64("role", "text"),
        "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"),
        "cut": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z"),
    })


#: A row's place in the table: null turns (not known) come first.
PLACE = ["conv", "known", "turn", "role", "mark"]


def _number(batches):
    """Sorted rows with their piece and place; a marker before a row says that its role and text came in an earlier turn."""
    piece, base, first, marked = TaskContext.get().partitionId(), 0, None, False
    for pdf in batches:
        if not len(pdf):
            continue
        first = pdf["conv"].iloc[0] if first is None else first
        before = pdf["later"].shift(1, fill_value=marked).astype(bool)
        marked = bool(pdf["later"].iloc[-1])
        pdf = pdf.assign(piece=piece, k=range(base, base + len(pdf)), again=before, open=pdf["conv"] == first)
        base += len(pdf)
        yield pdf[~pdf["later"]].drop(columns="later")


def _groups(batches, keys: list[str]):
    """(key, rows) of rows sorted by ``keys``; a group's rows are read as they come."""
    current, held = None, []
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            key = tuple(getattr(row, k) for k in keys)
            if key != current:
                if held:
                    yield current, held
                current, held = key, []
            held.append(row)
    if held:
        yield current, held


def _segments(batches):
    """A row for each piece: what it counts, its borders and its cheapest paths between states."""
    out = []
    for (conv, piece), rows in _groups(batches, ["conv", "piece"]):
        kinds, blank, duplicate, truncated, illegal, turns = [], 0, 0, 0, 0, []
        for n, r in enumerate(rows):
            copies, bad, again = int(r.n), bool(r.blank), bool(r.again)
            if bad:
                blank += copies
            else:
                duplicate += copies - 1 + again
                truncated += not again and bool(r.cut)
            illegal += copies - 1 + (n > 0 and rows[n - 1].ini + r.ini not in LEGAL)
            kinds.append((r.ini if r.ini in ("s", "u", "a") else "", MUST_GO if bad or again else TRUNCATED if r.cut else SOUND, copies))
            turns += [int(r.turn)] if r.known else []
        paths = []
        for end in range(4):
            found = Suffixes(kinds, [0 if s == end else _NEVER for s in range(4)])
            for start in range(4) if rows[0].open else (0,):
                cost, labels = found.path(start)
                if cost < _NEVER:
                    paths.append({"start": start, "end": end, "cost": cost, "labels": labels})
        out.append((conv, piece, blank, duplicate, truncated, illegal, len(set(turns)), min(turns, default=0), max(turns, default=0), rows[0].ini, rows[-1].ini, paths))
        if len(out) >= 2000:
            yield pd.DataFrame(out, columns=_SEGMENT_NAMES)
            out = []
    if out:
        yield pd.DataFrame(out, columns=_SEGMENT_NAMES)


_SEGMENT_NAMES = ["conv", "piece", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "left", "right", "paths"]
_SEGMENTS = (
    "conv string, piece int, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, left string, right string, "
    "paths array<struct<start int, end int, cost long, labels string>>"
)
_LABEL_NAMES = ["conv", "piece", "state", "labels", "audit", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_LABELS = "conv string, piece int, state int, labels string, audit string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _chain(batches):
    """The pieces of each conversation with their state and labels; what holds for the conversation is with its first piece."""
    out = []
    for (conv,), pieces in _groups(batches, ["conv"]):
        costs, choices = [0 if s in FINAL else _NEVER for s in range(4)], []
        # After the last row only insertions are left.
        best = {s: (c, "", None) for s, c in enumerate(Suffixes([], costs).after[0])}
        ends = {s: Suffixes([], costs).path(s)[1] for s in range(4)}
        for n, p in reversed(list(enumerate(pieces))):
            here = {}
            for path in p.paths:
                total = int(path["cost"]) + best[path["end"]][0] if path["end"] in best else _NEVER
                labels = path["labels"] + (ends[path["end"]] if n == len(pieces) - 1 else "")
                old = here.get(path["start"])
                # Paths from one state differ at some label and none is another's beginning, so the piece's own labels decide.
                if total < _NEVER and (old is None or (total, labels) < old[:2]):
                    here[path["start"]] = (total, labels, path["end"])
            best = here
            choices.append(here)
        choices.reverse()
        state, walked = 0, []
        for p, choice in zip(pieces, choices, strict=True):
            walked.append((p.piece, state, choice[state][1]))
            state = choice[state][2]
        pairs, numbered = list(zip(pieces, pieces[1:], strict=False)), [p for p in pieces if p.turns]
        shared = sum(int(p.high) == int(q.low) for p, q in pairs if p.turns and q.turns)  # a turn that goes on in the next piece
        distinct = sum(int(p.turns) for p in pieces) - shared
        gaps = min(int(numbered[-1].high) - int(numbered[0].low) + 1 - distinct, (1 << 63) - 1) if numbered else 0
        illegal = sum(int(p.illegal) for p in pieces) + sum(p.right + q.left not in LEGAL for p, q in pairs)
        totals = [gaps, *(sum(int(getattr(p, c)) for p in pieces) for c in ("blank", "duplicate", "truncated")), illegal, choices[0][0][0]]
        for n, w in enumerate(walked):
            out.append((conv, *w, "".join(x[2] for x in walked), *totals) if n == 0 else (conv, *w, *[None] * 7))
        if len(out) >= 2000:
            yield pd.DataFrame(out, columns=_LABEL_NAMES)
            out = []
    if out:
        yield pd.DataFrame(out, columns=_LABEL_NAMES)


def _applied(batches):
    """(conv, piece, j, role, text) of repaired rows; a piece's labels come before its rows."""

    stream = (row for pdf in batches for row in pdf.itertuples(index=False))
    head = next(stream, None)
    while head is not None:
        pending = None

        def own(conv=head.conv, piece=head.piece):
            nonlocal pending
            for r in stream:
                if (r.conv, r.piece) != (conv, piece):
                    pending = r
                    return
                yield r.role, r.text, int(r.n)

        mine = own()
        for j, (role, text) in enumerate(apply_labels(head.labels, mine, int(head.state))):
            yield head.conv, int(head.piece), j, role, text
        for _ in mine:  # nothing is left but the next piece's labels
            raise AssertionError("labels end before the rows")
        head = pending


def _repaired_rows(batches):
    out, size = [], 0
    for row in _applied(batches):
        out.append(row)
        size += len(row[4])
        if len(out) >= 10_000 or size > 1 << 24:
            yield pd.DataFrame(out, columns=["conv", "piece", "j", "role", "text"])
            out, size = [], 0
    if out:
        yield pd.DataFrame(out, columns=["conv", "piece", "j", "role", "text"])


def _digests(batches):
    """(conv, repaired_sha256): the hash takes one repaired row after the other."""
    out, current, state = [], None, None
    for conv, _, _, role, text in _applied(batches):
        row = f"{role}:{text}".encode("utf-8", "surrogatepass")
        if conv != current:
            if current is not None:
                out.append((current, state.hexdigest()))
            current, state = conv, hashlib.sha256(row)
        else:
            state.update(b"\n" + row)
        if len(out) >= 10_000:
            yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
            out = []
    if current is not None:
        out.append((current, state.hexdigest()))
    yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])


def _key(conv_id: str = "conv_id") -> Column:
    """A conversation's key: never null, so that rows without one are a conversation too."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


class Repair:
    """The repair of a table of conv_id, turn, role, text, and perhaps n (copies of the row, in its place)."""

    def __init__(self, conversations: DataFrame):
        n = F.col("n") if "n" in conversations.columns else F.lit(1)
        self.kind = conversations.schema["conv_id"].dataType
        space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        rows = conversations.select(_key().alias("conv"), F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), space("role").alias("role"), space("text").alias("text"), n.cast("long").alias("n"))
        rows = stage(_faults(rows.groupBy("conv", "known", "turn", "role", "text").agg(F.sum("n").alias("n"))), "turns")
        total = rows.count()
        # Of a role and text that come in several turns, all but the first turn's are repeated: a marker is sorted before these.
        turn = F.struct("known", "turn")
        firsts = rows.groupBy("conv", "mark").agg(F.min(turn).alias("first"), F.count("*").alias("n")).where("n > 1")
        later = attach(rows.select(*PLACE), firsts, ["conv", "mark"], total).where(turn != F.col("first"))
        marker = later.select(*PLACE, F.lit("").alias("text"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("blank"), F.lit(False).alias("cut"), F.lit(True).alias("later"))
        every = rows.withColumn("later", F.lit(False)).unionByName(marker)
        parts = max(width(rows.sparkSession), -(-total // RANGE_ROWS))
        ranged = every.repartitionByRange(parts, *PLACE).sortWithinPartitions(*PLACE, F.col("later").desc())
        ranged = ranged.select("conv", "known", "turn", "role", "text", "n", "blank", "cut", "later")
        schema = "conv string, known boolean, turn long, role string, text string, n long, blank boolean, cut boolean, piece int, k long, again boolean, open boolean"
        self.rows = stage(ranged.mapInPandas(_number, schema), "placed")
        flags = self.rows.select("conv", "piece", "k", "known", "turn", "n", "blank", "cut", "again", "open", F.substring("role", 1, 1).alias("ini"))
        segments = flags.repartition("conv", "piece").sortWithinPartitions("conv", "piece", "k").mapInPandas(_segments, _SEGMENTS)
        self.labels = stage(segments.repartition("conv").sortWithinPartitions("conv", "piece").mapInPandas(_chain, _LABELS), "labels")

    def _with_labels(self, *keys: str) -> DataFrame:
        texts = self.rows.select("conv", "piece", "k", "role", "text", "n")
        heads = self.labels.select("conv", "piece", F.lit(-1).cast("long").alias("k"), "state", "labels")
        both = texts.unionByName(heads, allowMissingColumns=True)
        return both.repartition(*keys).sortWithinPartitions("conv", "piece", "k")

    def _named(self, df: DataFrame) -> DataFrame:
        """``df`` with conv_id of the table's own type for conv."""
        return df.withColumn("conv_id", F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30).cast(self.kind))).drop("conv")

    def repaired(self) -> DataFrame:
        """conv_id, piece, j, role, text: the repaired rows, in order of piece and j; pieces of a conversation are apart."""
        return self._named(self._with_labels("conv", "piece").mapInPandas(_repaired_rows, "conv string, piece int, j long, role string, text string"))

    def report(self) -> DataFrame:
        """A row for each conversation that has rows: conv, gaps, blank, duplicate, truncated, illegal, cost, audit."""
        return self.labels.where("audit is not null").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def digests(self) -> DataFrame:
        """conv, repaired_sha256 of conversations of which rows are left: a hash is one task's, which reads its rows as a stream."""
        return self._with_labels("conv").mapInPandas(_digests, "conv string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n of rows harmed by crc32(conv_id:turn) % 20; nulls of role and text are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"))


def repair_report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation, its rows damaged first.

    Null roles and texts are one space; a null conv_id is a conversation of its own; null turns come first. Rows of one turn
    are in order of role, then of a hash of role and text. Roles and texts are told apart by 64-bit hashes within a
    conversation. Initials are case-sensitive; a role whose initial is not s, u or a can be deleted or reroled only. Columns
    other than conv_id, turn, role and text are not read; an empty table gives no rows.
    """
    table = conversations.select("conv_id", "turn", "role", "text")
    repair = Repair(damaged(table))
    every = table.select(_key().alias("conv")).distinct()
    out = every.join(repair.report(), "conv", "left").join(repair.digests(), "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return repair._named(out).select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
