"""Repair of conversation structure by Wagner-Fischer alignment with a grammar.

The turns of a conversation are aligned to every feasible length of the
alternating string ``(s?(ua)+)?`` of role initials. All lengths share their
endings, so one edit table over (turn, target characters left) holds them
all; it is filled inside the Ukkonen band that the cost of an incumbent
repair leaves. The cheapest lengths are traced together, letter by letter,
and only those whose audit is still the least go on.

Alignment needs one byte per turn: texts stay in Spark, are judged there, and
meet the edits again through a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memstrata.session import durable

from .common import BLANKS, SPACES, table

RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
OTHER, SYSTEM, USER, ASSISTANT = range(4)        # initials
SOUND, CUT, DOOMED = range(3)                    # faults: none, truncated, blank or duplicate
ROLES = {USER: "user", ASSISTANT: "assistant"}
FAR = np.int32(1 << 30)
SHORT = 64                                       # turns of an alignment that is remembered
SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
FOUND = ["conv_id", *SUMMARY, "audit", "place", "role", "content"]


# alignment of one conversation

class Table:
    """Edit costs of turns i.. against the last r target characters, inside the band of a cost.

    ``open`` holds plain endings, ``led`` those that still need the system
    turn. Rows of every ``step`` turns are kept, the ones between are filled
    again when the trace comes to them.
    """

    def __init__(self, initials: np.ndarray, faults: np.ndarray, most: int) -> None:
        self.initials, self.faults, self.n = initials, faults, len(initials)
        self.above, self.below = most // INSERT, most // DELETE
        self.width = self.n + self.above + 2
        self.left = np.arange(self.width)
        #: the target character with r left: the string ends in an assistant turn
        self.wanted = np.where(self.left % 2 == 0, USER, ASSISTANT)
        self.step = max(16, int(self.n ** 0.5))
        last = np.where(self.left <= self.above, INSERT * self.left, FAR).astype(np.int32)
        row = (last, np.full(self.width, FAR, np.int32))
        self.kept = {self.n: row}
        for i in range(self.n - 1, -1, -1):
            row = self.fill(i, row)
            if i % self.step == 0:
                self.kept[i] = row
        self.block: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def fill(self, i: int, after: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        turns = self.n - i
        low, high = max(0, turns - self.below), min(self.width, turns + self.above + 1)
        part = slice(low, high)
        plain, led = np.full(self.width, FAR, np.int32), np.full(self.width, FAR, np.int32)
        plain[part] = np.minimum(after[0][part] + DELETE, FAR)
        led[part] = np.minimum(after[1][part] + DELETE, FAR)
        if self.faults[i] != DOOMED:
            extra = TRUNCATED * int(self.faults[i] == CUT)
            first = max(low, 1)
            match = after[0][first - 1:high - 1] + np.where(self.wanted[first:high] == self.initials[i], 0, RETYPE).astype(np.int32) + extra
            plain[first:high] = np.minimum(plain[first:high], match)
            if self.initials[i] == SYSTEM:
                led[part] = np.minimum(led[part], after[0][part] + extra)
        # insertions run along the row
        slope = (INSERT * self.left[part]).astype(np.int32)
        plain[part] = np.minimum(np.minimum.accumulate(np.minimum(plain[part], FAR) - slope) + slope, FAR)
        return plain, led

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i in self.kept:
            return self.kept[i]
        if i not in self.block:
            top = min(self.n, (i // self.step + 1) * self.step)
            self.block, row = {}, self.kept[top]
            for k in range(top - 1, top - self.step if top % self.step == 0 else top // self.step * self.step, -1):
                row = self.block[k] = self.fill(k, row)
        return self.block[i]

    def trace(self) -> tuple[int, str]:
        """The least cost of any feasible length, and the ASCII-least audit among all that have it."""
        plain, led = self.row(0)
        even = np.arange(0, self.width, 2)
        cost = int(min(plain[even].min(), led[even[1:]].min() if len(even) > 1 else FAR))
        alive = {(False, int(r)) for r in even[plain[even] == cost]} | {(True, int(r)) for r in even[1:][led[even[1:]] == cost]}
        i, audit = 0, []
        while i < self.n or any(r for _, r in alive):
            here, after = self.row(i), self.row(i + 1) if i < self.n else None
            steps: dict[str, set[tuple[bool, int]]] = {}
            for system, r in alive:
                now = int(here[system][r])
                if i < self.n and now == after[system][r] + DELETE:
                    steps.setdefault("D", set()).add((system, r))
                elif not system and r and now == here[0][r - 1] + INSERT:
                    steps.setdefault("I", set()).add((False, r - 1))
                elif system:
                    steps.setdefault("K", set()).add((False, r))
                elif i < self.n:
                    steps.setdefault("K" if self.wanted[r] == self.initials[i] else "R", set()).add((False, r - 1))
            letter = min(steps)
            alive = steps[letter]
            audit.append(letter)
            i += letter != "I"
        return cost, "".join(audit)


def incumbent(initials: np.ndarray, faults: np.ndarray) -> int:
    """The cost of a repair found in one pass: sound turns that go on with the alternation stay, the rest goes."""
    at, cost, begun = 0, 0, False
    for initial, fault in zip(initials.tolist(), faults.tolist()):
        if fault == SOUND and initial == (USER, ASSISTANT)[at]:
            at, begun = 1 - at, True
        elif fault == SOUND and initial in ROLES and begun and at == 1:
            at, cost = 0, cost + RETYPE
        else:
            cost += DELETE
    return min(cost + INSERT * at, DELETE * len(initials))


def align(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of a conversation whose turns are ``initial + 4 * fault`` each."""
    if not codes:
        return 0, ""
    held = np.frombuffer(codes, np.uint8)
    initials, faults = (held & 3).astype(np.int8), held >> 2
    return Table(initials, faults, incumbent(initials, faults)).trace()


@lru_cache(maxsize=100_000)
def remembered(codes: bytes) -> tuple[int, str]:
    return align(codes)


def edits(codes: bytes, audit: str) -> Iterator[tuple[int, str]]:
    """(turn or -1 for an inserted one, role or '' for the own one) of the repaired turns in order."""
    wanted = None
    i = 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        if letter == "K":
            initial = codes[i] & 3
            yield i, ""
            wanted = USER if initial == SYSTEM else USER + ASSISTANT - initial
            i += 1
            continue
        role = USER if wanted is None else wanted
        yield (i if letter == "R" else -1), ROLES[role]
        wanted = USER + ASSISTANT - role
        i += letter == "R"


# Spark

def damage(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by the checksum of each turn's name; nulls become one space."""
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(named(conv_id), F.lit(":"), named(turn)).cast("binary")) % 20
    body = F.when(fate == 1, "").when(fate == 2, F.translate(named(text), ".!?", "")).otherwise(named(text))
    rows = conversations.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
                                F.when(fate == 4, "user").otherwise(named(role)).alias("role"), body.alias("text"), fate.alias("fate")).where("fate <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fate", "copy")


def judged(rows: DataFrame) -> DataFrame:
    """Adds ``content`` (digest of role and text), ``initial`` and ``fault`` (1 blank, 2 duplicate, 3 truncated, else 0)."""
    text = F.col("text")
    content = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), text).cast("binary"), 256))
    blank = ~text.rlike(f"[^{SPACES}]")
    cut = ~F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1)).isin(".", "!", "?")
    seen = F.row_number().over(Window.partitionBy("conv_id", "content").orderBy("turn")) > 1
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    number = F.when(blank, 1).when(seen, 2).when(cut, 3).otherwise(0)
    return rows.withColumn("content", content).withColumns({"fault": number.cast("byte"), "initial": initial.cast("byte")})


class Conversation:
    """What is known of the conversation being read."""

    def __init__(self, name) -> None:
        self.name, self.codes, self.contents, self.empty = name, bytearray(), [], True
        self.faults, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.turns, self.least, self.greatest = 0, None, None

    def add(self, turn, fault: int, initial: int, content: bytes) -> None:
        self.empty = False
        if turn is not None and turn != self.greatest:
            self.least = turn if self.least is None else self.least
            self.greatest, self.turns = turn, self.turns + 1
        self.faults[fault] += 1
        self.illegal += self.before is not None and (self.before, initial) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
        self.before = initial
        self.codes.append(initial + 4 * (0, DOOMED, DOOMED, CUT)[fault])
        self.contents.append(None if fault in (1, 2) else content)

    def finish(self, out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if self.empty:
            return
        codes = bytes(self.codes)
        cost, audit = (remembered if len(codes) <= SHORT else align)(codes)
        gaps = self.greatest - self.least + 1 - self.turns if self.turns else 0
        out.append((self.name, gaps, self.faults[1], self.faults[2], self.faults[3], self.illegal, cost, audit, None, None, None))
        for place, (i, role) in enumerate(edits(codes, audit)):
            out.append((self.name, *[None] * 7, place, role, None if i < 0 else self.contents[i]))
            if len(out) > 5000:
                yield _batch(out)
                out.clear()


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=FOUND)


def aligned(rows: DataFrame) -> DataFrame:
    """Summaries (``place`` null) and repaired turns (``place`` from 0) of each conversation.

    Rows reach a task in the order of their conversations and turns; of the
    one being read it holds a byte and a reference to its digest per turn.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Conversation(None)
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "fault", "initial", "content")]
            for conv, turn, fault, initial, content in zip(*columns):
                if conv != held.name or held.empty:
                    yield from held.finish(out)
                    held = Conversation(conv)
                held.add(turn, fault, initial, content)
                if len(out) > 5000:
                    yield _batch(out)
                    out.clear()
            if out:
                yield _batch(out)
        out = []
        yield from held.finish(out)
        if out:
            yield _batch(out)

    kinds = ", ".join(["conv_id long", *[f"{c} long" for c in SUMMARY], "audit string", "place long", "role string", "content binary"])
    dealt = (rows.select("conv_id", "turn", "role", "fault", "initial", "content").repartition("conv_id")
             .sortWithinPartitions("conv_id", "turn", "role", "content", F.col("fault") == 2))
    return dealt.select("conv_id", "turn", "fault", "initial", "content").mapInArrow(run, kinds)


def repair(damaged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries, turns) of the cheapest repair of each conversation in (conv_id, turn, role, text).

    Summaries: conv_id, gaps, blank, duplicate, truncated, illegal, cost and
    audit. Turns: conv_id, place from 0, role, text. Turns stand in the order
    of (turn, role, digest of role and text), null turns first, which fixes
    ties; equal rows after the first are duplicates. A role without an
    initial (an empty one) is legal nowhere. A null conv_id is a
    conversation like any other.
    """
    rows = durable(judged(damaged))
    found = durable(aligned(rows))
    summaries = found.where("place is null").select("conv_id", *SUMMARY, "audit")
    kept = found.where("place is not null").select("conv_id", "place", F.col("role").alias("new"), "content")
    # a repaired turn is the first with its role and text, so the digest names one row
    texts = rows.where("fault in (0, 3)").select(F.col("conv_id").alias("of"), F.col("content").alias("named"), "role", "text")
    turns = (kept.where("content is not null").join(texts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("content") == F.col("named")))
             .select("conv_id", "place", F.when(F.col("new") == "", F.col("role")).otherwise(F.col("new")).alias("role"), "text")
             .unionByName(kept.where("content is null").select("conv_id", "place", F.col("new").alias("role"), F.lit("").alias("text"))))
    return summaries, turns


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the ``role:text`` lines of each conversation; a task holds a hash state only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, name, out = None, None, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if state is not None and conv == name:
                    state.update(b"\n")
                else:
                    if state is not None:
                        out.append((name, state.hexdigest()))
                    state, name = hashlib.sha256(), conv
                state.update(f"{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out])], names=["conv_id", "sha256"])
                out = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([state.hexdigest()])], names=["conv_id", "sha256"])

    return (turns.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "role", "text")
            .mapInArrow(run, "conv_id long, sha256 string"))


def repair_report(conversations: DataFrame, damaged: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """One row per conversation of ``conversations``: the summary and the digest of the repaired turns.

    A conversation without a row after the damage has zeros, an empty audit
    and the digest of nothing. An empty table gives an empty result, and
    columns other than the four named ones are not read.
    """
    summaries, turns = repair(damaged)
    all_of_them = conversations.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id")).distinct()
    of = lambda df, name: df.withColumnRenamed("conv_id", name)
    both = (all_of_them.join(of(summaries, "a"), F.col("conv_id").eqNullSafe(F.col("a")), "left")
            .join(of(digests(turns), "b"), F.col("conv_id").eqNullSafe(F.col("b")), "left"))
    zero = F.lit(0).cast("long")
    nothing = hashlib.sha256(b"").hexdigest()
    return both.select("conv_id", *[F.coalesce(c, zero).alias(c) for c in SUMMARY], F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256"))


def op12(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return repair_report(conversations, damage(conversations))


def _sql() -> str:
    """The same repair as a walk over (turns read, state of the grammar): the least of cost and audit per state, as one text."""
    step = lambda s, cost, letter: f"(printf('%09d', substr({s}, 1, 9)::BIGINT + {cost}) || substr({s}, 10) || '{letter}')"
    user = f"least(s2, {step('s0', INSERT, 'I')}, {step('s1', INSERT, 'I')}, {step('s3', INSERT, 'I')})"
    keep = lambda s, initial: (f"CASE WHEN fault IN (1, 2) THEN '900000000' WHEN initial = '{initial}' THEN {step(s, 'extra', 'K')} "  # noqa: E731
                               f"ELSE {step(s, '1 + extra', 'R')} END")
    lead = f"CASE WHEN fault NOT IN (1, 2) AND initial = 's' THEN {step('s0', 'extra', 'K')} ELSE '900000000' END"
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(e ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS e
    FROM (SELECT unnest(range(256)) AS i))),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
fated AS (
  SELECT named.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS fate FROM named, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM fated WHERE fate <> 0),
placed AS (
  SELECT conv_id, turn, role, text, sha256(strlen(role) || ':' || role || text) AS content,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) AS i FROM damaged),
judged AS (
  SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^{SPACES}]') THEN 1
         WHEN row_number() OVER (PARTITION BY conv_id, content ORDER BY i) > 1 THEN 2
         WHEN NOT regexp_matches(text, '[.!?][{SPACES}]*\\z') THEN 3 ELSE 0 END AS fault,
    CASE WHEN NOT regexp_matches(text, '[.!?][{SPACES}]*\\z') THEN {TRUNCATED} ELSE 0 END AS extra
  FROM placed),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS s0, '900000000' AS s1, '900000000' AS s2, '900000000' AS s3
  FROM (SELECT DISTINCT conv_id FROM placed)
  UNION ALL
  SELECT conv_id, i, {step('s0', DELETE, 'D')}, least({step('s1', DELETE, 'D')}, {lead}),
    least({step('u', DELETE, 'D')}, least({keep('s0', 'u')}, {keep('s1', 'u')}, {keep('a', 'u')})),
    least({step('a', DELETE, 'D')}, {keep('u', 'a')})
  FROM (SELECT o.*, least(o.s3, {step('u', INSERT, 'I')}) AS a
        FROM (SELECT j.conv_id, j.i, j.fault, j.extra, j.initial, s0, s1, s2, s3, {user} AS u
              FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1) o)),
facts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (bad) AS illegal
  FROM (SELECT *, i > 1 AND (lag(initial) OVER w || initial) NOT IN ('su', 'ua', 'au') AS bad FROM judged WINDOW w AS (PARTITION BY conv_id ORDER BY i))
  GROUP BY conv_id),
best AS (
  SELECT conv_id, substr(s, 1, 9)::BIGINT AS cost, substr(s, 10) AS audit
  FROM (SELECT f.conv_id, least(s0, s3, {step('u', INSERT, 'I')}) AS s
        FROM (SELECT *, {user} AS u FROM walk) w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i)),
letters AS (
  SELECT conv_id, k, audit[k] AS letter, k - length(replace(audit[:k], 'I', '')) AS inserted, k - length(replace(audit[:k], 'D', '')) AS deleted
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM best)),
kept AS (
  SELECT l.conv_id, l.k, l.letter, l.k - l.deleted AS nth, j.role, j.text, j.initial
  FROM letters l LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.k - l.inserted AND l.letter <> 'I'
  WHERE l.letter <> 'D'),
repaired AS (
  SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY k)) AS sha
  FROM (SELECT conv_id, k, CASE letter WHEN 'I' THEN '' ELSE text END AS text,
          CASE WHEN letter = 'K' THEN role WHEN (nth + (first_value(letter || coalesce(initial, '')) OVER (PARTITION BY conv_id ORDER BY k) = 'Ks')::INT) % 2 = 1
               THEN 'user' ELSE 'assistant' END AS role FROM kept)
  GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP12_SQL = _sql()
