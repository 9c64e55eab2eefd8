"""Conversation structure repair as a lightest derivation, by Knuth's agenda.

A repaired conversation's role initials read ``(s?(ua)+)?``.  Items are deduced from
items: *prefix(i, q)* says that the first i rows are edited and the roles so far lead
to state q; it follows from *prefix(i - 1, p)* together with an edit of row i, or from
*prefix(i, p)* together with an inserted row.  A deduction's value is the sum of its premises' costs and
the concatenation of their audits (initials of Keep, Rerole, Delete, Insert), which
never is less than a premise's, so the agenda may finalise the least open
item each time, and the goal's first value is its least.  Two audits of one item and
cost never continue each other (an insertion costs), so appending keeps their order.

Long conversations are cut into spans of ``SPAN`` rows: each is derived from every
state it may start in, and spans are premises of the same kind of deduction.

Two passes, both in the order (conversation, turn, role, digest of the text). The first sees one
character a row and yields counts, cost and audit; the second streams the texts past
their audit. Neither holds a conversation's texts.

Defined cases: a null role or text is one space; rows without a turn come first; rows without a conversation id are
a conversation; rows alike in all columns are rows of their own, the later ones duplicates; an unknown or empty role is
kept by no edit; a conversation named in ``conv_ids`` without a row has zeros and an empty audit; no rows, no result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import sys
from collections import defaultdict
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import col

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPAN = 256  # rows derived in one agenda
REMEMBERED = 1 << 16  # codes of conversations a task remembers with their repair
BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # costs; keeping is free
ROLES = {"s": "system", "u": "user", "a": "assistant"}
# Which initial may follow in which state; "-" is the state before the first row.
NEXT = {"-": "su", "s": "u", "u": "a", "a": "u"}
ENDS = "-a"
FAULTS = ("blank", "duplicate", "truncated")
PLAN_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PLAN_TYPES = [pa.int64()] * 7 + [pa.string()]

Value = tuple[int, str]
Item = Hashable


def lightest(axioms: dict[Item, Value], uses: Callable[[Item], Iterable[tuple[Item, tuple[Item, ...]]]], goals: set[Item]) -> dict[Item, Value]:
    """Least values of the goals that can be derived.

    ``uses(item)`` names the deductions ``(conclusion, premises)`` that have the item among their premises; a
    deduction fires once its last premise is final.
    """
    final: dict[Item, Value] = {}
    best = dict(axioms)
    agenda = [(value, number, item) for number, (item, value) in enumerate(axioms.items())]
    heapq.heapify(agenda)
    number, open_goals = len(agenda), set(goals)
    while agenda and open_goals:
        value, _, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = value
        open_goals.discard(item)
        for conclusion, premises in uses(item):
            if conclusion in final or any(p not in final for p in premises):
                continue
            made = (sum(final[p][0] for p in premises), "".join(final[p][1] for p in premises))
            if conclusion not in best or made < best[conclusion]:
                best[conclusion] = made
                number += 1
                heapq.heappush(agenda, (made, number, conclusion))
    return {g: final[g] for g in goals if g in final}


def _deductions(premises: Iterable[tuple[Item, Item, Item]]) -> Callable[[Item], list]:
    uses = defaultdict(list)
    for conclusion, *tail in premises:
        for p in tail:
            uses[p].append((conclusion, tuple(tail)))
    return lambda item: uses.get(item, [])


def _edits(code: str) -> Iterator[tuple[str, str, int]]:
    """What may become of a row: audit initial, the role's initial (none if deleted), cost."""
    yield "D", "", DELETE
    if code == "-":
        return
    more = TRUNCATED if code.isupper() else 0
    if code.lower() in ROLES:
        yield "K", code.lower(), more
    for role in "ua":
        yield "R", role, REROLE + more


def span_repairs(codes: str, start: str) -> dict[str, Value]:
    """Least (cost, audit) from one state to each state over a span of rows."""
    axioms: dict[Item, Value] = {("prefix", 0, start): (0, "")}
    rules = []
    for role in "ua":
        axioms["insert", role] = (INSERT, "I")
        rules += [(("prefix", i, role), ("prefix", i, q), ("insert", role)) for i in range(len(codes) + 1) for q in NEXT if role in NEXT[q]]
    for i, code in enumerate(codes):
        for letter, role, cost in _edits(code):
            edit = ("edit", i, letter, role)
            axioms[edit] = (cost, letter)
            rules += [(("prefix", i + 1, role or q), ("prefix", i, q), edit) for q in NEXT if not role or role in NEXT[q]]
    found = lightest(axioms, _deductions(rules), {("prefix", len(codes), q) for q in NEXT})
    return {item[2]: value for item, value in found.items()}


def repair(codes: str) -> Value:
    """Least (cost, audit) for rows coded by role initial: upper case if truncated, ``o`` other, ``-`` to be deleted."""
    spans = [codes[i : i + SPAN] for i in range(0, len(codes), SPAN)] or [""]
    axioms: dict[Item, Value] = {("prefix", 0, "-"): (0, "")}
    rules = []
    known: dict[tuple[str, str], dict[str, Value]] = {}
    for k, span in enumerate(spans):
        for p in NEXT if k else "-":
            if (p, span) not in known:
                known[p, span] = span_repairs(span, p)
            for q, value in known[p, span].items():
                axioms["span", k, p, q] = value
                rules.append((("prefix", k + 1, q), ("prefix", k, p), ("span", k, p, q)))
    axioms["end"] = (0, "")
    rules += [("goal", ("prefix", len(spans), q), "end") for q in ENDS]
    return lightest(axioms, _deductions(rules), {"goal"})["goal"]


def _text(name: str) -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(" "))


def _turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(col("conv_id").cast("long").alias("conv_id"), col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


ORDER = ["conv_id", "here", "turn", "role", "digest"]  # nulls first, as Spark sorts


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and repair of each conversation of rows in order."""
    remembered: dict[str, Value] = {}
    plans: list[tuple] = []
    now: list = []  # the conversation at hand: id, codes, counts

    def close() -> None:
        conv, codes, counts, illegal, low, high, distinct, _, _ = now
        told = codes.decode()
        if told not in remembered:
            if len(remembered) >= REMEMBERED:
                remembered.clear()
            remembered[told] = repair(told)
        cost, audit = remembered[told]
        plans.append((conv, 0 if low is None else high - low + 1 - distinct, *counts, illegal, cost, audit))

    for batch in batches:
        for conv, here, turn, initial, fault in zip(*[batch[c].to_pylist() for c in ("conv_id", "here", "turn", "initial", "fault")]):
            if not now or now[0] != conv:
                if now:
                    close()
                now = [conv, bytearray(), [0, 0, 0], 0, None, None, 0, None, False]
            if not here:
                continue
            if turn is not None and turn != now[5]:
                now[4], now[5], now[6] = turn if now[4] is None else now[4], turn, now[6] + 1
            if fault < 3:
                now[2][fault] += 1
            if now[8] and now[7] + initial not in ("su", "ua", "au"):
                now[3] += 1
            now[7], now[8] = initial, True
            code = initial if initial in ROLES else "o"
            now[1] += ("-" if fault < 2 else code.upper() if fault == 2 else code).encode()
        if plans:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*plans), PLAN_TYPES)], names=[c.split()[0] for c in PLAN_DDL.split(", ")])
            plans.clear()
    if now:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*plans), PLAN_TYPES)], names=[c.split()[0] for c in PLAN_DDL.split(", ")])


def plan_repairs(conversations: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """Per conversation: gaps in its turns, first faults of its rows, illegal neighbours, and the least (cost, audit)."""
    text = F.rtrim(F.col("text"), F.lit(BLANKS))
    first = Window.partitionBy("conv_id", "role", "digest").orderBy("turn")
    fault = (
        F.when(text == "", 0).when(F.row_number().over(first) > 1, 1).when(~F.substring(text, -1, 1).isin(".", "!", "?"), 2).otherwise(3)
    )
    seen = _turns(conversations).select("conv_id", F.lit(True).alias("here"), "turn", "role", "digest", "text")
    rows = seen.select("conv_id", "here", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), F.when(text == "", F.lit("")).otherwise(F.substring(text, -1, 1)).alias("text"))
    if conv_ids is not None:
        marks = conv_ids.select(col("conv_id").cast("long").alias("conv_id")).distinct()
        rows = rows.unionByName(marks.withColumn("here", F.lit(False)), allowMissingColumns=True)
    rows = rows.repartition("conv_id").select("*", fault.alias("fault")).drop("text")
    # Of rows alike the first is the one that repeats nothing.
    return rows.sortWithinPartitions(*ORDER, F.desc("fault")).mapInArrow(_plans, PLAN_DDL)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Conversation id and the next rows of its repair, for rows in order behind their audit; each conversation begins with none."""
    audit, at, state = "", 0, "-"

    def inserted() -> Iterator[tuple[str, str]]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, "a" if state == "u" else "u"
            yield ROLES[state], ""

    for batch in batches:
        for conv, here, role, text, plan in zip(*[batch[c].to_pylist() for c in ("conv_id", "here", "role", "text", "audit")]):
            if not here:
                audit, at, state = plan, 0, "-"
                # A conversation of insertions only has no row to follow them.
                yield conv, None
                if not audit.strip("I"):
                    yield conv, list(inserted())
                continue
            made = list(inserted())
            letter, at = audit[at], at + 1
            if letter == "K":
                state = role[0]
                made.append((role, text))
            elif letter == "R":
                state = "a" if state == "u" else "u"
                made.append((ROLES[state], text))
            if not audit[at:].strip("I"):
                made += inserted()
            yield conv, made


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, rows, size = 0, [], 0
    for conv, made in _repaired(batches):
        if made is None:
            place = 0
            continue
        for role, text in made:
            rows.append((conv, place, role, text))
            place, size = place + 1, size + len(text)
        if len(rows) >= 4096 or size > 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["conv_id", "place", "role", "text"])
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["conv_id", "place", "role", "text"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` rows, joined by line ends."""
    ids, digests = [], []
    state, first = None, True

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])
        ids.clear(), digests.clear()
        return made

    now = None
    for conv, made in _repaired(batches):
        if made is None:
            if state is not None:
                ids.append(now), digests.append(state.hexdigest())
            now, state, first = conv, hashlib.sha256(), True
            if len(ids) >= 4096:
                yield flush()
            continue
        for role, text in made:
            state.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
    if state is not None:
        ids.append(now), digests.append(state.hexdigest())
        yield flush()


def _applied(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    told = plans.select("conv_id", F.lit(False).alias("here"), "audit")
    rows = _turns(conversations).withColumn("here", F.lit(True))
    return rows.unionByName(told, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(*ORDER)


def repaired_turns(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """``(conv_id, place, role, text)``: the repaired rows, numbered from 0."""
    return _applied(conversations, plans).mapInArrow(_rows, "conv_id long, place long, role string, text string")


def repaired_digests(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` over the repaired rows as ``role:text`` lines."""
    return _applied(conversations, plans).mapInArrow(_digested, "conv_id long, repaired_sha256 string")
