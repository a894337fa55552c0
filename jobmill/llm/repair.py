"""Repair of damaged conversations by generalised LR parsing with weighted edits.

Spark orders and deals out the turns; a task reads the turns of its conversations as one sorted stream.  The turns of a
conversation are the input of a parser for the role grammar.  Where several edits are possible the parser follows all of
them at once: its stacks form a graph whose tops are LR states, and tops with the same state are merged by the smaller
(cost, audit).  A top holds its cost, the rank of its audit among the tops, a link to the top it came from with the edits in
between, and the running digest of the text repaired so far, so no text is kept: a task holds a few numbers and a link
for each turn of one conversation.

Comparing audits needs no strings.  Tops of one layer have read the same number of turns and end in an edit that read one,
so no audit is a prefix of another, and (rank of the origin, edits since) orders them.  What a layer does depends only on
costs relative to the cheapest top, on ranks and on the kind of turn, so layers are remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
_VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
_LEGAL = frozenset(("su", "ua", "au"))


class Costs(NamedTuple):
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


class Grammar(NamedTuple):
    """Shifts of a role grammar by (state, role's initial), its start, its accepting states and the roles that may be made up."""

    shifts: dict[tuple[int, str], int]
    start: int
    accepts: frozenset[int]
    roles: tuple[str, ...]


#: (s?(ua)+)?: 0 nothing read, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
ROLES = Grammar({(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}, 0, frozenset((0, 3)), ("user", "assistant"))


class Parser:
    """Layers of the graph-structured stack, remembered by relative costs, ranks and kind of turn."""

    def __init__(self, grammar: Grammar = ROLES, costs: Costs = Costs()) -> None:
        self.grammar, self.costs, self.layers = grammar, costs, {}
        states = {grammar.start, *grammar.accepts, *grammar.shifts.values(), *(s for s, _ in grammar.shifts)}
        self.inserts = {s: self._inserted(s) for s in states}

    def _inserted(self, state: int) -> list[tuple[tuple[str, ...], int]]:
        """Roles inserted and the state reached, for every state that insertions reach, by the fewest."""
        found, paths, ring = {state}, [((), state)], [((), state)]
        while ring:
            ahead = []
            for roles, at in ring:
                for role in self.grammar.roles:
                    to = self.grammar.shifts.get((at, role[0]))
                    if to is not None and to not in found:
                        found.add(to)
                        ahead.append(((*roles, role), to))
            paths, ring = paths + ahead, ahead
        return paths

    def layer(self, tops: tuple, initial: str, doomed: bool, truncated: bool) -> list[tuple]:
        """New tops as (state, cost, rank, origin's place, edits, roles inserted, role of the turn: None if deleted, "" if kept).

        ``tops`` holds (state, cost over the cheapest, rank) of the last layer.
        """
        key = (tops, initial, doomed, truncated)
        known = self.layers.get(key)
        if known is not None:
            return known
        costs, shifts, best = self.costs, self.grammar.shifts, {}

        def offer(state, cost, origin, roles, edit, role):
            edits = "I" * len(roles) + edit
            rank = tops[origin][2]
            if state not in best or (cost, rank, edits) < best[state][:3]:
                best[state] = (cost, rank, edits, origin, roles, role)

        for origin, (state, cost, _) in enumerate(tops):
            for roles, at in self.inserts[state]:
                so_far = cost + costs.insert * len(roles)
                offer(at, so_far + costs.delete, origin, roles, "D", None)
                if doomed:
                    continue
                more = costs.truncated if truncated else 0
                if (at, initial) in shifts:
                    offer(shifts[at, initial], so_far + more, origin, roles, "K", "")
                for role in self.grammar.roles:
                    if (at, role[0]) in shifts:
                        offer(shifts[at, role[0]], so_far + more + costs.rerole, origin, roles, "R", role)
        order = {s: i for i, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        out = [(s, b[0], order[s], b[3], b[2], b[4], b[5]) for s, b in sorted(best.items())]
        self.layers[key] = out
        return out

    def last(self, tops: tuple) -> tuple[int, int, tuple[str, ...]]:
        """(cost, place, roles inserted) of the cheapest way from a top to an accepting state."""
        ways = [(cost + self.costs.insert * len(roles), rank, "I" * len(roles), place, roles)
                for place, (state, cost, rank) in enumerate(tops) for roles, at in self.inserts[state] if at in self.grammar.accepts]
        cost, _, _, place, roles = min(ways)
        return cost, place, roles


def _fed(digest, started: bool, role: str, text: str) -> None:
    digest.update((f"\n{role}:{text}" if started else f"{role}:{text}").encode())


class Conversation:
    """The state of one conversation while its turns stream by."""

    def __init__(self, parser: Parser) -> None:
        self.parser = parser
        self.base, self.tops = 0, ((parser.grammar.start, 0, 0),)
        self.ends = [(None, hashlib.sha256(), False)]  # by top: link, digest so far, whether anything is in it
        self.seen: set[bytes] = set()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.before: str | None = None
        self.low = self.high = None
        self.n_turns = 0

    def read(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.n_turns += turn != self.high
            self.high = turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in _LEGAL:
            self.counts["illegal"] += 1
        self.before = initial
        mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        blank, again = not _VISIBLE.search(text), mark in self.seen
        self.seen.add(mark)
        cut = not blank and not again and text.rstrip(SPACE)[-1] not in ".!?"
        for name, fault in (("blank", blank), ("duplicate", again and not blank), ("truncated", cut)):
            self.counts[name] += fault
        layer, ends = self.parser.layer(self.tops, initial, blank or again, cut), []
        for _, _, _, origin, edits, inserted, to in layer:
            link, digest, started = self.ends[origin]
            if inserted or to is not None:
                digest = digest.copy()
                for made in inserted:
                    _fed(digest, started, made, "")
                    started = True
                if to is not None:
                    _fed(digest, started, to or role, text)
                    started = True
            ends.append(((link, edits), digest, started))
        least = min(t[1] for t in layer)
        self.base, self.ends = self.base + least, ends
        self.tops = tuple((state, cost - least, rank) for state, cost, rank, *_ in layer)

    def result(self) -> tuple:
        cost, place, roles = self.parser.last(self.tops)
        link, digest, started = self.ends[place]
        for made in roles:
            _fed(digest, started, made, "")
            started = True
        edits = ["I" * len(roles)]
        while link is not None:
            link, edit = link
            edits.append(edit)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.n_turns
        return gaps, *self.counts.values(), self.base + cost, "".join(reversed(edits)), digest.hexdigest()


_FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _repairer(grammar: Grammar, costs: Costs):
    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, current, state, done = Parser(grammar, costs), None, None, []

        def flushed(kind) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])],
                                              ["conv_id", *_FIELDS])

        kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        done.append((current, *state.result()))
                    current, state = conv, Conversation(parser)
                if role is not None:  # else the row only says that the conversation exists
                    state.read(turn, role, text)
            if len(done) > 1000:
                yield flushed(kind)
        if state is not None:
            done.append((current, *state.result()))
        if done:
            yield flushed(kind)
    return repair


def repaired(turns: DataFrame, grammar: Grammar = ROLES, costs: Costs = Costs()) -> DataFrame:
    """One row per conv_id of ``turns`` (conv_id, turn, role, text): gaps, faults, cost, audit and digest of the repair.

    Turns are taken by turn (nulls first), then role and text; rows that tie in all of these are equal.  A row whose role is
    null stands for a conversation without that turn.  A null conv_id is a conversation of its own; equal rows of one turn
    are duplicates; an empty table gives no rows; other columns are ignored.  A conversation is one result with one letter
    per edit, so one task reads it, without keeping its texts.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "text")
    kind = turns.schema["conv_id"].dataType.simpleString()
    longs = ", ".join(f"{name} long" for name in _FIELDS[:6])
    return ordered.mapInArrow(_repairer(grammar, costs), f"conv_id {kind}, {longs}, audit string, repaired_sha256 string")


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults planted by crc32 of conv_id:turn; a dropped row keeps its conv_id and has a null role."""
    kind = F.crc32(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", _filled("role").alias("role"), _filled("text").alias("text"), kind.alias("kind"))
    rows = rows.withColumn("kind", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(3), F.lit(3))).otherwise(F.array(F.col("kind").cast("int")))))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    gone = F.col("kind") == 0
    return rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


# ------------------------------------------------------------------ the same in SQL


def crc32_sql(text: str) -> str:
    """CRC-32 of a string of ASCII characters: bit by bit, for want of a function."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda z: cast(ascii(z) AS bigint))), lambda c, b: {bits}), 4294967295)"


def _step(key: str, cost: str | int, edit: str, add: str | None) -> str:
    """A path (nine digits of cost, the audit, a separator, what is repaired) after one more edit; null stays null."""
    text = f"substr({key}, strpos({key}, chr(1)))"
    more = "" if add is None else f" || CASE WHEN strpos({key}, chr(1)) = length({key}) THEN '' ELSE chr(10) END || {add}"
    return f"(lpad(cast(cast(substr({key}, 1, 9) AS bigint) + {cost} AS varchar), 9, '0') || substr({key}, 10, strpos({key}, chr(1)) - 10) || '{edit}' || {text}{more})"


def _sql() -> str:
    read = "n.role || ':' || n.text"
    # Insertions first: the states' paths with any useful insertions in front of the next turn.
    u1 = f"least({', '.join(['s.u', *(_step(f's.{k}', 3, 'I', chr(39) + 'user:' + chr(39)) for k in ('z', 's', 'a'))])})"
    a1 = f"least(s.a, {_step('s.u1', 3, 'I', chr(39) + 'assistant:' + chr(39))})"
    u2 = f"least(s.u1, {_step('s.a1', 3, 'I', chr(39) + 'user:' + chr(39))})"
    cut = "(3 * cast(n.cut AS bigint))"
    keep = lambda k, initial: f"CASE WHEN NOT n.doomed AND n.initial = '{initial}' THEN {_step(f's.{k}', cut, 'K', read)} END"
    rerole = lambda k, role: f"CASE WHEN NOT n.doomed THEN {_step(f's.{k}', f'(3 + {cut})', 'R', chr(39) + role + ':' + chr(39) + ' || n.text')} END"
    to_user = ", ".join([_step("s.u2", 4, "D", None), *(f(k, x) for k in ("z", "s", "a1") for f, x in ((keep, "u"), (rerole, "user")))])
    to_assistant = ", ".join([_step("s.a1", 4, "D", None), keep("u2", "a"), rerole("u2", "assistant")])
    return f"""WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32_sql("(coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' '))")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM o WHERE kind <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM r),
f AS (SELECT *, body = '' AS blank, body <> '' AND again AS twice, body = '' OR again AS doomed, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS cut,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM w),
c AS (SELECT DISTINCT conv_id FROM o),
g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (twice) AS duplicate,
  count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
steps(conv_id, i, z, s, u, a) AS (
  SELECT conv_id, cast(0 AS bigint), '000000000' || chr(1), cast(NULL AS varchar), cast(NULL AS varchar), cast(NULL AS varchar) FROM c
  UNION ALL
  SELECT s.conv_id, n.i, {_step('s.z', 4, 'D', None)}, least({_step('s.s', 4, 'D', None)}, {keep('z', 's')}), least({to_user}), least({to_assistant})
  FROM (SELECT s.*, {u2} AS u2 FROM (SELECT s.*, {a1} AS a1 FROM (SELECT s.*, {u1} AS u1 FROM steps s) s) s) s
  JOIN f n ON n.conv_id IS NOT DISTINCT FROM s.conv_id AND n.i = s.i + 1),
e AS (SELECT s.conv_id, least(s.z, {a1}) AS best FROM (SELECT s.*, {u1} AS u1 FROM steps s) s LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM s.conv_id WHERE s.i = coalesce(g.n, 0))
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  cast(substr(best, 1, 9) AS bigint) AS cost, substr(best, 10, strpos(best, chr(1)) - 10) AS audit, sha256(substr(best, strpos(best, chr(1)) + 1)) AS repaired_sha256
FROM e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id"""


SQL = _sql()
