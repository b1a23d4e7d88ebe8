"""Conversation structure repair by Knuth's lightest derivation.

Rows of a conversation are ordered by turn (nulls first), then role and text; that order is the input of a
repair. Faults of a row, the first that holds: blank (no character outside space and \\t-\\r), duplicate
(role and text equal to an earlier row's), truncated (its last such character is none of ``.!?``).

A repair is a sequence of edits whose result has role initials ``(s?(ua)+)?`` (system, then pairs of user
and assistant; or nothing): Keep (cost 0), Rerole to user or assistant (1), Delete (2; the only edit of a
blank or duplicate row), Insert an empty user or assistant row (5, anywhere); a truncated row that is not
deleted adds 5. Items are (rows read, state of the role automaton); an edit derives an item from one other
with weight (cost, audit), the audit being the edits' initials (D, I, K, R). Appending an initial is a
superior, monotone function under the order of cost, then audit: two equal-cost derivations of one item never
have audits of which one is a prefix of the other (the longer would have more inserts, so a higher cost).
The agenda therefore pops items in final order, layer by layer of rows read (inserts stay in a layer), and
the goal (all rows read, accepting state) is final when popped: the cheapest repair, ties by the ASCII-least
audit. Roles of reroled and inserted rows follow from the state: user after nothing, system or assistant;
assistant after user. Memory is one layer of audits: O(rows) per conversation.

Gaps are counted over the turns left after damage. Defined cases: null role or text is one space (so a null
text is blank); a row whose damage drops it is
gone, but its conversation stays with zero counts, an empty audit and the hash of the empty text when no row
is left; the conversation of a null id is one conversation; rows of equal turn keep the order of role and
text, so repeated rows are next to each other and all but the first are duplicates; other columns of the
input are not used.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: damage by crc32("conv_id:turn") mod 20 and the edit costs.
DAMAGE_MOD = 20
DROP, EMPTY, UNPUNCTUATE, REPEAT, TO_USER = 0, 1, 2, 3, 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ALLOWED_PAIRS = ("su", "ua", "au")

# Role automaton of (s?(ua)+)?: start, after system, after user, after assistant; start and after assistant accept.
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT,
         (ASSISTANT, "u"): USER}
_ACCEPT = (START, ASSISTANT)
_ROLE = {"u": "user", "a": "assistant"}

RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")
_SPACE = r"[\x20\x09-\x0D]"


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, with ``gone`` rows kept as markers of their conversation (text and role null).

    Columns: conv_id, turn, role, text, copy, gone, blank, truncated (flags by built-in functions).
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    harm = F.pmod(F.crc32(key.cast("binary")), F.lit(DAMAGE_MOD))
    text = F.coalesce(F.col("text"), F.lit(" "))
    role = F.coalesce(F.col("role"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(harm == DROP, None).when(harm == TO_USER, "user").otherwise(role).alias("role"),
        F.when(harm == DROP, None).when(harm == EMPTY, "").when(harm == UNPUNCTUATE, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text).alias("text"),
        F.explode(F.when(harm == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (harm == DROP).alias("gone"))
    last = F.regexp_extract("text", rf"([^\x20\x09-\x0D]){_SPACE}*$", 1)
    return rows.withColumns({
        "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"),
        "truncated": ~last.isin(".", "!", "?")})


def lightest_repair(roles: list[str], texts: list[str], blank: list[bool], truncated: list[bool]) -> tuple[
        int, int, int, int, str, str]:
    """The cheapest repair of one conversation in order: see the module text.

    Returns (rows whose first fault is duplicate, rows whose first fault is truncated, illegal adjacent role
    pairs, cost, audit, repaired text as ``role:text`` lines).
    """
    seen: set[tuple[str, str]] = set()
    fault = []
    for role, text, empty, cut in zip(roles, texts, blank, truncated, strict=True):
        fault.append("blank" if empty else "duplicate" if (role, text) in seen else "truncated" if cut else "")
        seen.add((role, text))
    initials = [r[:1] for r in roles]
    illegal = sum(a + b not in ALLOWED_PAIRS for a, b in zip(initials, initials[1:]))

    layer = _inserts({START: (0, "")})
    for initial, flaw in zip(initials, fault, strict=True):
        derived: dict[int, tuple[int, str]] = {}

        def offer(state: int, weight: tuple[int, str]) -> None:
            if state not in derived or weight < derived[state]:
                derived[state] = weight

        extra = TRUNCATED if flaw == "truncated" else 0
        for state, (cost, audit) in layer.items():
            offer(state, (cost + DELETE, audit + "D"))
            if flaw in ("blank", "duplicate"):
                continue
            if (state, initial) in _NEXT:
                offer(_NEXT[state, initial], (cost + KEEP + extra, audit + "K"))
            for target in "ua":
                if target != initial and (state, target) in _NEXT:
                    offer(_NEXT[state, target], (cost + REROLE + extra, audit + "R"))
        layer = _inserts(derived)
    cost, audit = min(layer[s] for s in _ACCEPT if s in layer)

    out, state, row = [], START, 0
    for edit in audit:
        if edit == "I":
            initial = "u" if state != USER else "a"
            out.append(f"{_ROLE[initial]}:")
        else:
            role, text, initial = roles[row], texts[row], initials[row]
            row += 1
            if edit == "D":
                continue
            if edit == "R":
                initial = "u" if state != USER else "a"
                role = _ROLE[initial]
            out.append(f"{role}:{text}")
        state = _NEXT[state, initial]
    return fault.count("duplicate"), fault.count("truncated"), illegal, cost, audit, "\n".join(out)


def _inserts(items: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
    """Knuth's agenda within one layer: pop the lightest item, finalise it, derive inserts from it."""
    agenda = [(weight, state) for state, weight in items.items()]
    heapq.heapify(agenda)
    final: dict[int, tuple[int, str]] = {}
    while agenda:
        weight, state = heapq.heappop(agenda)
        if state in final:
            continue
        final[state] = weight
        for target in "ua":
            after = _NEXT.get((state, target))
            if after is not None and after not in final:
                heapq.heappush(agenda, ((weight[0] + INSERT, weight[1] + "I"), after))
    return final


def _summary(conv_id: int | None, rows: list[tuple]) -> tuple:
    """The result row of one conversation from its rows in order: (turn, role, text, gone, blank, truncated)."""
    live = [r for r in rows if not r[3]]
    turns = {r[0] for r in live if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    if not live:
        return conv_id, gaps, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()
    dup, cut, illegal, cost, audit, text = lightest_repair(
        [r[1] for r in live], [r[2] for r in live], [bool(r[4]) for r in live], [bool(r[5]) for r in live])
    digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    return conv_id, gaps, sum(bool(r[4]) for r in live), dup, cut, illegal, cost, audit, digest


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()),
                     ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
                     ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_INPUT = ("conv_id", "turn", "role", "text", "gone", "blank", "truncated")


def _repair_partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and order arrive in Arrow batches; a conversation may span batches."""
    done: list[tuple] = []
    key, rows, started = None, [], False
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in _INPUT]
        for conv_id, *row in zip(*columns, strict=True):
            if started and conv_id != key:
                done.append(_summary(key, rows))
                rows = []
            key, started = conv_id, True
            rows.append(tuple(row))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done), _SCHEMA)], schema=_SCHEMA)
            done = []
    if started:
        done.append(_summary(key, rows))
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done), _SCHEMA)], schema=_SCHEMA)


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of the input (null included): fault counts, gaps, illegal pairs and the repair.

    Damage and the per-row flags are built-in expressions. Rows are dealt to tasks by conversation and sorted
    there; each task walks its rows once and derives each conversation as its rows pass (a conversation is the
    unit of the result's hash, so it is not split). Only one conversation's rows are held at a time.
    """
    rows = damaged(conversations)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    ready = rows.repartition("conv_id").sortWithinPartitions(*order).select(*_INPUT)
    return ready.mapInArrow(_repair_partitions, RESULT)
