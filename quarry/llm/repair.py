"""Conversation structure repair by iterative-deepening A*.

A conversation is read as one code per row: the role's initial and the row's
first fault.  The search goes through the rows depth first, trying the edits in
ASCII order of their initials (Delete, Insert, Keep, Rerole), and gives up a
path whose cost so far plus a lower bound of what is left passes the current
cost bound.  The bound starts at the lower bound of the whole conversation and
rises to the least cost that was cut off.  A table holds, per (row, grammar
state), the largest remaining budget that has failed, so no state is searched
twice for nothing.  The first path that ends in an accepting state is the
cheapest, and among the cheapest the ASCII-least.

Grammar of role initials: ``(s?(ua)+)?`` as four states: 0 at the start, 1
after the system turn, 2 after a user turn, 3 after an assistant turn; 0 and 3
accept.  The lower bound is the cost of the same rows under a laxer grammar,
where every state accepts.

Spark sorts the rows of each conversation into its partition and tasks stream
them: a first pass keeps a code per row (and a 16-byte digest per row to find
duplicates), finds the edits and forgets the texts; a second pass reads the
edits ahead of the rows and hashes the repaired conversation as it goes by.
Searches are shared by all conversations of a task with the same codes.

Defined cases: a null role, text, turn or id counts as one space (as text; rows
of null turn come first, and gaps skip them); rows that share a turn are taken
by role, then text; a conversation without rows, or all of whose rows are
deleted, has the hash of the empty string; repeated rows count each (the later
is a duplicate); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
LEGAL = frozenset(("su", "ua", "au"))
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}     # state after a role
FORCED = {0: "u", 1: "u", 2: "a", 3: "u"}                               # role that a rerole or an insert gives
ACCEPTS = (True, False, False, True)
ROLES = {"u": "user", "a": "assistant"}
_EMPTY = hashlib.sha256(b"").hexdigest()


# ---- search ----------------------------------------------------------------

def lower_bounds(codes: list[tuple[str, str]]) -> list[tuple[int, int, int, int]]:
    """Per row number and state: least cost of the rows from there on when every state accepts."""
    ahead = (0, 0, 0, 0)
    out = [ahead]
    for role, fault in reversed(codes):
        if fault in "bd":
            here = [DELETE + x for x in ahead]
        else:
            more = TRUNCATED if fault == "t" else 0
            here = []
            for q in range(4):
                best = min(DELETE + ahead[q], REROLE + more + ahead[NEXT[q][FORCED[q]]])
                if role in NEXT[q]:
                    best = min(best, KEEP + more + ahead[NEXT[q][role]])
                here.append(best)
        # one insert, or two, in front of the row
        step = [NEXT[q][FORCED[q]] for q in range(4)]
        once = [min(here[q], INSERT + here[step[q]]) for q in range(4)]
        ahead = tuple(min(once[q], INSERT + once[step[q]]) for q in range(4))
        out.append(ahead)
    return out[::-1]


def edits_of(row: tuple[str, str] | None, q: int) -> Iterator[tuple[str, int, int, int]]:
    """(initial, cost, rows consumed, next state) of the edits that state ``q`` allows, in ASCII order."""
    if row is not None:
        yield "D", DELETE, 1, q
    yield "I", INSERT, 0, NEXT[q][FORCED[q]]
    if row is not None and row[1] not in "bd":
        more = TRUNCATED if row[1] == "t" else 0
        if row[0] in NEXT[q]:
            yield "K", KEEP + more, 1, NEXT[q][row[0]]
        yield "R", REROLE + more, 1, NEXT[q][FORCED[q]]


def search(codes: list[tuple[str, str]]) -> tuple[str, int]:
    """(edits' initials, cost) of the cheapest, ASCII-least repair."""
    n, bound_from = len(codes), lower_bounds(codes)
    limit = bound_from[0][0]
    failed: dict[tuple[int, int], int] = {}
    while True:
        over = None                                    # least cost that was cut off
        path: list[str] = []
        stack = [(0, 0, 0, edits_of(codes[0] if n else None, 0))]
        if n == 0:
            return "", 0
        while stack:
            i, q, g, edits = stack[-1]
            for name, cost, eaten, q2 in edits:
                i2, g2 = i + eaten, g + cost
                f = g2 + bound_from[i2][q2]
                if f > limit:
                    over = f if over is None else min(over, f)
                    continue
                if failed.get((i2, q2), -1) >= limit - g2:
                    continue
                path.append(name)
                if i2 == n and ACCEPTS[q2]:
                    return "".join(path), g2
                stack.append((i2, q2, g2, edits_of(codes[i2] if i2 < n else None, q2)))
                break
            else:
                failed[i, q] = max(failed.get((i, q), -1), limit - g)
                stack.pop()
                if path:
                    path.pop()
        limit = limit + 1 if over is None else over


# ---- rows ------------------------------------------------------------------

def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32 of ``conv_id:turn`` modulo 20 (0 drop, 1 empty, 2 unpunctuate, 3 repeat, 4 user)."""
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn"))) % 20
    t = rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return t.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def fault_of(role: str, text: str, seen: set[bytes]) -> str:
    """``b``lank, ``d``uplicate, ``t``runcated or ``-``; the row is added to ``seen``."""
    digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
    again = digest in seen
    seen.add(digest)
    bare = text.rstrip(SPACE)
    return "b" if not bare else "d" if again else "-" if bare[-1] in ".!?" else "t"


def _ordered(rows: DataFrame) -> DataFrame:
    order = [F.col("conv_id").asc_nulls_first(), F.col("kind").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def _stream(batches, names):
    for b in batches:
        yield from zip(*[b.column(c).to_pylist() for c in names])


FOUND = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


def find_edits(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows``(conv_id, turn, role, text): the counts, the cost and the edits."""
    def run(batches):
        known: dict[str, tuple[str, int]] = {}
        rows_out: list[tuple] = []
        now, state = None, None

        def close():
            codes, turns = state["codes"], state["turns"]
            key = "".join(r + f for r, f in codes)
            if key not in known:
                if len(known) > 100_000:
                    known.clear()
                known[key] = search(codes)
            audit, cost = known[key]
            count = lambda x: sum(f == x for _, f in codes)
            illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(codes, codes[1:]))
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            rows_out.append((now[0], gaps, count("b"), count("d"), count("t"), illegal, cost, audit))

        for conv, turn, role, text in _stream(batches, ("conv_id", "turn", "role", "text")):
            if now != (conv,):
                if now is not None:
                    close()
                    if len(rows_out) >= 5000:
                        yield _found(rows_out)
                        rows_out.clear()
                now, state = (conv,), {"codes": [], "turns": None, "seen": set()}
            state["codes"].append((role[:1] or " ", fault_of(role, text, state["seen"])))
            if turn is not None:
                first, last, n = state["turns"] or (turn, turn - 1, 0)
                state["turns"] = (first, turn, n + (turn > last))
        if now is not None:
            close()
        if rows_out:
            yield _found(rows_out)

    return _ordered(rows.withColumn("kind", F.lit(1))).mapInArrow(run, FOUND)


def _found(rows):
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:-1]], pa.array(cols[-1], pa.string())], names=[c.split()[0] for c in FOUND.split(", ")])


def apply_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of every conversation of ``edits``(conv_id, audit) with its ``rows``."""
    def run(batches):
        out: list[tuple] = []
        now, audit, at, q, sha, first = None, "", 0, 0, hashlib.sha256(), True

        def put(role, text):
            nonlocal first
            sha.update((role + ":" + text if first else "\n" + role + ":" + text).encode())
            first = False

        def insert():
            """The inserts that stand next in the edits."""
            nonlocal at, q
            while at < len(audit) and audit[at] == "I":
                put(ROLES[FORCED[q]], "")
                q, at = NEXT[q][FORCED[q]], at + 1

        for conv, kind, role, text in _stream(batches, ("conv_id", "kind", "role", "text")):
            if kind == 0:
                if now is not None:
                    insert()
                    out.append((now[0], sha.hexdigest()))
                    if len(out) >= 5000:
                        yield _hashes(out)
                        out.clear()
                now, audit, at, q, sha, first = (conv,), text, 0, 0, hashlib.sha256(), True
                continue
            insert()
            edit = audit[at]
            at += 1
            if edit == "K":
                put(role, text)
                q = NEXT[q][role[:1]]
            elif edit == "R":
                put(ROLES[FORCED[q]], text)
                q = NEXT[q][FORCED[q]]
        if now is not None:
            insert()
            out.append((now[0], sha.hexdigest()))
        if out:
            yield _hashes(out)

    ahead = edits.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("kind"))
    both = rows.select("conv_id", "turn", "role", "text", F.lit(1).alias("kind")).unionByName(ahead)
    return _ordered(both).mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def _hashes(rows):
    a, b = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string())], names=["conv_id", "repaired_sha256"])


def repair(original: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts, cost, edits and hash for every conv_id of ``original``, whose rows to repair are ``rows``."""
    found = cut_lineage(find_edits(rows))
    hashes = apply_edits(rows, found).select(F.col("conv_id").alias("id"), "repaired_sha256")
    done = found.join(hashes, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id").withColumnRenamed("conv_id", "id")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (original.select("conv_id").distinct().join(done, F.col("conv_id").eqNullSafe(F.col("id")), "left")
            .select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_EMPTY)).alias("repaired_sha256")))


def conversations(df: DataFrame) -> DataFrame:
    """conv_id and turn as whole numbers, role and text; a missing column is null, and case does not count."""
    kinds = {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"}
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[c]}`") if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
