"""Repair of conversation structure by cheapest edits.

A conversation's rows are edited so that their roles follow the grammar of an optional
system turn and pairs of user and assistant turns. The edits are paths on an implicit
lattice of (row, grammar state): a row is kept, given another role or deleted, and turns
without text are inserted. Dijkstra's search takes nodes by (cost, audit), where the audit
is the string of edits so far, and stops at the first accepting end node it takes, so equal
costs are settled by the least audit.

Rows are dealt by conversation and read in order of turn. A long conversation is searched in
segments: each start state that is still open is searched to every end state, and of what
meets in a state the cheapest goes on, with a digest of its repaired text so far. So
memory holds a segment and the audits, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genostrata.llm.common import read

#: Costs of the edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows, and characters of text, of a long conversation that are searched at a time.
SEGMENT, SEGMENT_CHARS = 1024, 16 << 20

#: Grammar states: nothing yet, after system, after user, after assistant. A role's initial
#: leads from state to state; the conversation may end in the accepting ones.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
STEPS = {
    START: {"s": AFTER_SYSTEM, "u": AFTER_USER},
    AFTER_SYSTEM: {"u": AFTER_USER},
    AFTER_USER: {"a": AFTER_ASSISTANT},
    AFTER_ASSISTANT: {"u": AFTER_USER},
}
ACCEPTING = (START, AFTER_ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(slots=True)
class Row:
    role: str
    text: str
    fault: str  # blank, duplicate, truncated or nothing


def edits(row: Row, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, edit, next state) of each edit that takes a row in a state."""
    yield DELETE, "D", state
    if row.fault in ("blank", "duplicate"):
        return
    extra = TRUNCATED if row.fault == "truncated" else 0
    for initial, then in STEPS[state].items():
        if row.role[:1] == initial:
            yield extra, "K", then
        if initial in ROLES:
            yield extra + REROLE, "R", then


def cheapest(rows: list[Row], start: int, last: bool) -> dict[int, tuple[int, str]]:
    """{end state: (cost, audit)} of the cheapest ways from ``start`` over all rows.

    Of the ``last`` rows of a conversation only the first accepting end is searched for; of
    earlier ones every end, without turns inserted after the final row (those belong to the
    next segment).
    """
    queue, done, ends = [(0, "", 0, start)], set(), {}
    while queue:
        cost, audit, at, state = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows):
            if not last or state in ACCEPTING:
                ends[state] = cost, audit
                if last or len(ends) == len(STEPS):
                    break
            if not last:
                continue
        else:
            for more, edit, then in edits(rows[at], state):
                heapq.heappush(queue, (cost + more, audit + edit, at + 1, then))
        for initial, then in STEPS[state].items():
            if initial in ROLES:
                heapq.heappush(queue, (cost + INSERT, audit + "I", at, then))
    return ends


def turns(rows: list[Row], audit: str, state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each turn that an audit leaves or inserts."""
    left = iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit == "K":
            role = row.role
        else:
            role = next(ROLES[i] for i in STEPS[state] if i in ROLES)
        state = STEPS[state][role[:1]]
        yield edit, role, row.text if row else ""


@dataclass(slots=True)
class Way:
    """The cheapest way to a state at the border of segments; rank orders audits of one border."""

    cost: int
    rank: int
    audit: tuple = ()  # linked: (what came before, segment's audit)
    turns: tuple = ()  # the same with the segment's turns, if they are asked for
    digest: object = field(default_factory=hashlib.sha256)
    empty: bool = True


def whole(linked: tuple) -> list:
    parts = []
    while linked:
        linked, part = linked
        parts.append(part)
    return parts[::-1]


class Conversation:
    """The rows of one conversation, in order, and what becomes of them."""

    def __init__(self, with_turns: bool):
        self.with_turns = with_turns
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first = self.final = self.before = None
        self.distinct = 0
        self.seen: set[bytes] = set()
        self.rows: list[Row] = []
        self.chars = 0
        self.ways = {START: Way(0, 0)}

    def add(self, turn: int | None, role: str, text: str) -> None:
        if len(self.rows) >= SEGMENT or self.chars > SEGMENT_CHARS:
            self.segment(last=False)
        if turn is not None and turn != self.final:
            self.first = turn if self.first is None else self.first
            self.final, self.distinct = turn, self.distinct + 1
        shown = text.rstrip(BLANKS)
        name = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode("utf-8", "replace"))
        if not shown:
            fault = "blank"
        elif name in self.seen:
            fault = "duplicate"
        else:
            fault = "" if shown[-1] in ".!?" else "truncated"
        self.seen.add(name)
        if fault:
            self.counts[fault] += 1
        self.counts["illegal"] += self.before is not None and self.before + role[:1] not in LEGAL
        self.before = role[:1]
        self.rows.append(Row(role, text, fault))
        self.chars += len(text)

    def segment(self, last: bool) -> None:
        """Search the rows at hand from every open state and go on with the best of each end."""
        best: dict[int, tuple] = {}
        for start, way in self.ways.items():
            for end, (cost, audit) in cheapest(self.rows, start, last).items():
                found = (way.cost + cost, way.rank, audit, start)
                if end not in best or found < best[end]:
                    best[end] = found
        if last:
            end = min(best, key=best.get)
            best = {end: best[end]}
        order = sorted(best, key=lambda end: best[end][1:3])
        ways = {}
        for rank, end in enumerate(order):
            cost, _, audit, start = best[end]
            way = self.ways[start]
            digest, empty, kept = way.digest.copy(), way.empty, []
            for turn in turns(self.rows, audit, start):
                digest.update(f"{'' if empty else chr(10)}{turn[1]}:{turn[2]}".encode("utf-8", "replace"))
                empty = False
                if self.with_turns:
                    kept.append(turn)
            ways[end] = Way(cost, rank, (way.audit, audit), (way.turns, kept), digest, empty)
        self.ways, self.rows, self.chars = ways, [], 0

    def end(self) -> Way:
        self.segment(last=True)
        return next(iter(self.ways.values()))

    @property
    def gaps(self) -> int:
        return 0 if self.first is None else self.final - self.first + 1 - self.distinct


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
TURNS = "place bigint, edit string, role string, text string"


def _stream(rows: DataFrame, with_turns: bool) -> DataFrame:
    """Every conversation of ``rows`` (conv, turn, role, text, gone), read in order by one task."""
    kind = rows.schema["conv"].dataType.simpleString()
    added = TURNS if with_turns else REPORT
    types = {"bigint": pa.int64(), "string": pa.string()}
    fields = [(n, types[t]) for n, t in (x.split() for x in added.split(", "))]
    most = 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, key, conv_type = None, None, None

        def packed():
            columns = [pa.array(c, t) for c, t in zip(zip(*out), [conv_type, *(t for _, t in fields)])]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv", *(n for n, _ in fields)])

        def close():
            way = conv.end()
            if with_turns:
                place = 0
                for part in whole(way.turns):
                    for turn in part:
                        out.append((key, place, *turn))
                        place += 1
            else:
                c = conv.counts
                out.append((key, conv.gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], way.cost, "".join(whole(way.audit)), way.digest.hexdigest()))

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for value, turn, role, text, gone in zip(*(batch.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "gone"))):
                if conv is None or value != key:
                    if conv is not None:
                        close()
                        if len(out) >= most:
                            yield packed()
                    conv, key = Conversation(with_turns), value
                if not gone:
                    conv.add(turn, role, text)
        if conv is not None:
            close()
        if out:
            yield packed()

    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return dealt.select("conv", "turn", "role", "text", "gone").mapInArrow(run, f"conv {kind}, {added}")


def _prepared(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, gone: Column) -> DataFrame:
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    return rows.select(F.col(conv_id).alias("conv"), F.col(turn).cast("bigint").alias("turn"), *filled, gone.alias("gone"))


def repair_report(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *, gone: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    Rows go by turn, null turns first, rows of one turn by role and text. Null roles and texts
    count as one space; a null conv_id is a conversation of its own. A row marked by ``gone``
    is not there, but its conversation still has a row in the result: zeros, an empty audit
    and the digest of an empty text if nothing else is left. Repeated rows are duplicates.
    An empty table gives an empty result; other columns are not read.
    """
    found = _stream(_prepared(rows, conv_id, turn, role, text, F.lit(False) if gone is None else gone), False)
    return found.withColumnRenamed("conv", conv_id)


def repaired_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *, gone: Column | None = None) -> DataFrame:
    """conv_id, place, edit, role, text of every turn of the repaired conversations.

    Rows are read as ``repair_report`` reads them. A task holds one conversation's turns.
    """
    found = _stream(_prepared(rows, conv_id, turn, role, text, F.lit(False) if gone is None else gone), True)
    return found.withColumnRenamed("conv", conv_id)


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with faults by a stated rule: conv_id, turn, role, text, gone.

    crc32 of conv_id:turn (nulls are one space) modulo 20 says which: 0 marks a row as gone,
    1 empties its text, 2 takes out its marks .!?, 3 repeats it, 4 makes its role user.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return repair_report(damaged(read(spark, sf_dir, "conversations")), gone=F.col("gone"))


#: crc32 in DuckDB: eight shifts give each entry of the byte table, which is then folded over the bytes.
CRC32_SQL = """
    bits AS (SELECT i, list_reduce([0,1,2,3,4,5,6,7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) t(i)),
    crc_table AS (SELECT list(v ORDER BY i) AS entries FROM bits)"""


def crc32_sql(text: str) -> str:
    """The crc32 of an ASCII text in a query that has crc_table at hand."""
    step = "lambda c, b: xor(c >> 8, entries[xor(c & 255, b) + 1])"
    return f"xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT), {step}, 4294967295), 4294967295)"


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _way(of: str, cost: str, edit: str, turn: str | None, on: str = "TRUE") -> str:
    turn = f"list_append({of}.r, {turn})" if turn else f"{of}.r"
    return f"{{'c': CASE WHEN {on} THEN {of}.c + {cost} ELSE 1000000000 END, 'a': {of}.a || '{edit}', 'r': {turn}}}"


def _op12_sql() -> str:
    """A fold over the rows of each conversation with the cheapest way to each of the four states."""
    fit, late = "NOT x.drop", "x.extra"
    keep = lambda of, i: _way(of, late, "K", "x.role || ':' || x.text", f"{fit} AND left(x.role, 1) = '{i}'")
    rerole = lambda of, role: _way(of, f"(1 + {late})", "R", f"'{role}:' || x.text", fit)
    gone = lambda of: _way(of, "2", "D", None)
    put = lambda of, role: _way(of, "5", "I", f"'{role}:'")
    user = lambda s: _least(f"{s}.u", put(f"{s}.n", "user"), put(f"{s}.s", "user"), put(f"{s}.a", "user"))
    folded = f"""list_transform([list_transform([s], lambda s: {{'n': s.n, 's': s.s, 'u': {user('s')}, 'a': s.a}})[1]],
        lambda s: {{'n': s.n, 's': s.s, 'u': s.u, 'a': {_least('s.a', put('s.u', 'assistant'))}}})[1]"""
    # A fold needs one type, so each element is a state with a row; a state's own row is empty.
    none = "'role': '', 'text': '', 'drop': FALSE, 'extra': 0"
    step = f"""lambda s, x: list_transform([{folded}], lambda s: {{'n': {gone('s.n')}, 's': {_least(gone('s.s'), keep('s.n', 's'))},
        'u': {_least(gone('s.u'), *(w for of in ('s.n', 's.s', 's.a') for w in (keep(of, 'u'), rerole(of, 'user'))))},
        'a': {_least(gone('s.a'), keep('s.u', 'a'), rerole('s.u', 'assistant'))}, {none}}})[1]"""
    nothing = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}"
    begin = f"{{'n': {{'c': CAST(0 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}}, 's': {nothing}, 'u': {nothing}, 'a': {nothing}"
    item = f"{begin}, 'role': role, 'text': text, 'drop': fault IN ('blank', 'duplicate'), 'extra': CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END}}"
    begin = f"{begin}, {none}}}"
    shown = r"regexp_replace(text, '[ \x09-\x0D]+\z', '')"
    return f"""
WITH {CRC32_SQL.strip()},
    keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql('key')} % 20 AS kind FROM keyed, crc_table),
    hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS again
        FROM kinds WHERE kind <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, {shown} AS shown FROM hurt),
    counted_copies AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS nth FROM placed),
    judged AS (SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) AS pair FROM counted_copies),
    counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
        list({item} ORDER BY place) AS items FROM judged GROUP BY conv_id),
    folded AS (SELECT * EXCLUDE (items), list_reduce(items, {step}, {begin}) AS s FROM counted),
    closed AS (SELECT *, {_least('s.n', 's.a', put(f"({user('s')})", 'assistant'))} AS best FROM folded)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN closed ON o.conv_id IS NOT DISTINCT FROM closed.conv_id"""


OP12_SQL = _op12_sql()
