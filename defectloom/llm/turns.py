"""Repair of damaged conversations at least cost, by depth-first branch-and-bound.

A conversation is whole when the initials of its roles read ``(s?(ua)+)?``. Each turn is kept (free),
given another role (3) or deleted (4; blank and repeated turns must go); an empty user or assistant
turn may be put in anywhere (3); a truncated turn that stays adds 3. The search walks the turns with an
explicit stack of prefixes (turn, state of the pattern, cost, audit of edits). A prefix is left
where its cost and the lower bound of what follows exceed the best whole repair so far, the incumbent
(cost, audit), or where another prefix reached the same turn and state at no more cost with no
later audit. The bounds of all suffixes are worked out from the end, so the first dive mostly ends in
the optimum, and the rest of the stack proves it. Of equal costs the audit that is least in ASCII
order wins.

Conversations of up to ``LARGE`` turns are read and repaired one after another by the task that sorts
them. A larger one, whose rows no task should gather, is numbered over the whole table and cut into
blocks of ``BLOCK`` turns. Each block is searched for every state it may begin and end in; tables of
neighbouring blocks are joined level by level, which keeps cost and audit exact, since no audit of a
block is the beginning of another one of equal cost. Its repaired text is hashed as one stream.

Nulls: role and text count as one blank, turns without a number come first, a missing conv_id is a
conversation of its own. Empty text: a blank turn. Very long texts: a turn is one string in a task. An
empty role has no initial: it is never kept. Ties in turn: by role, then by the SHA-256 of the text,
a repeated turn after itself. Repeated rows: each is a turn, the later ones duplicates.
Empty table: no rows. Other columns are ignored.
"""

import hashlib
import math
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from defectloom.llm.store import keep, ship
from defectloom.operators.positions import with_position

# Costs of the edits.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# States: nothing yet, after s, after u, after a; and what a role's initial makes of them.
STATES, ENDS = 4, (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FREE = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
BLOCK, LARGE = 64, 4096
LEGAL = ("su", "ua", "au")
# Faults of a turn, in order.
SOUND, BLANK, DUPLICATE, CUT = range(4)

_CHAR = r"[^\x20\x09-\x0D]"
_LAST = regex.compile(_CHAR, regex.REVERSE).search
_RESULT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
_NAMES = [field.split()[0] for field in _RESULT.split(", ")]
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def fault(text: str, seen: bool) -> int:
    last = _LAST(text)
    if last is None:
        return BLANK
    if seen:
        return DUPLICATE
    return SOUND if last.group() in ".!?" else CUT


def edits(turn: tuple[str, int], state: int) -> list[tuple[str, int, int]]:
    """(letter, next state, cost) of what may be done with a turn."""
    initial, kind = turn
    out = [("D", state, DELETE)]
    if kind not in (BLANK, DUPLICATE):
        more = TRUNCATED if kind == CUT else 0
        out.append(("R", FREE[state], RENAME + more))
        kept = STEP.get((state, initial))
        if kept is not None:
            out.append(("K", kept, more))
    return out


def _with_inserts(costs: list[float]) -> list[float]:
    for _ in range(STATES):
        costs = [min(c, INSERT + costs[FREE[s]]) for s, c in enumerate(costs)]
    return costs


def suffix_bounds(turns: list[tuple[str, int]], ends) -> list[list[float]]:
    """What the turns from each one on cost at least, by the state before them."""
    out = [_with_inserts([0 if s in ends else math.inf for s in range(STATES)])]
    for turn in reversed(turns):
        after = out[-1]
        out.append(_with_inserts([min(c + after[k] for _, k, c in edits(turn, s)) for s in range(STATES)]))
    return out[::-1]


def search(turns: list[tuple[str, int]], begin: int = 0, ends=ENDS) -> tuple[int, str] | None:
    """(cost, audit) of the best repair of turns (initial, fault) from state ``begin`` to one of
    ``ends``; None where none leads there."""
    n = len(turns)
    bounds = suffix_bounds(turns, ends)
    incumbent = None
    best = {}
    stack = [(0, begin, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        bound = cost + bounds[i][state]
        if bound == math.inf:
            continue
        if incumbent is not None and (bound > incumbent[0] or bound == incumbent[0] and audit > incumbent[1]):
            continue
        at = best.get((i, state))
        if at is not None and at <= (cost, audit):
            continue
        best[i, state] = cost, audit
        if i == n and state in ends and (incumbent is None or (cost, audit) < incumbent):
            incumbent = cost, audit
        children = [(i, FREE[state], cost + INSERT, audit + "I")]
        if i < n:
            children += [(i + 1, after, cost + c, audit + edit) for edit, after, c in edits(turns[i], state)]
        # The least bound is tried first, and of equal ones the least letter.
        children.sort(key=lambda e: (e[2] + bounds[e[0]][e[1]], e[3]), reverse=True)
        stack += children
    return incumbent


def block_table(turns: list[tuple[str, int]]) -> list:
    """(cost, audit) or None for each pair of states that a block begins and ends in."""
    return [search(turns, begin, (end,)) for begin in range(STATES) for end in range(STATES)]


def joined(first: list, second: list) -> list:
    """The table of two blocks in a row."""
    out = []
    for begin in range(STATES):
        for end in range(STATES):
            ways = [
                (a[0] + b[0], a[1] + b[1])
                for a, b in ((first[begin * STATES + k], second[k * STATES + end]) for k in range(STATES))
                if a is not None and b is not None
            ]
            out.append(min(ways, default=None))
    return out


def best_repair(turns: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    if len(turns) <= BLOCK:
        return search(turns)
    table = block_table(turns[:BLOCK])
    for start in range(BLOCK, len(turns), BLOCK):
        table = joined(table, block_table(turns[start : start + BLOCK]))
    return whole(table)


def whole(table: list) -> tuple[int, str]:
    return min(table[end] for end in ENDS if table[end] is not None)


def repaired_turns(rows, audit: str):
    """(role, text) of the turns after the edits; ``rows`` are (role, text) in order."""
    state, rows = 0, iter(rows)
    for edit in audit:
        if edit == "I":
            role, text = None, ""
        else:
            role, text = next(rows)
            if edit == "D":
                continue
        if edit == "K":
            state = STEP[state, role[:1]]
        else:
            state = FREE[state]
            role = ROLE[state]
        yield role, text


def _repaired_hash(rows, audit: str) -> str:
    digest, first = hashlib.sha256(), True
    for role, text in repaired_turns(rows, audit):
        digest.update((f"{role}:{text}" if first else f"\n{role}:{text}").encode("utf-8", "surrogatepass"))
        first = False
    return digest.hexdigest()


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def repaired(turns: list[int | None], rows: list[tuple[str, str]]) -> tuple:
    """The result of one conversation, its rows in order."""
    seen, marked = set(), []
    for role, text in rows:
        marked.append((role[:1], fault(text, (role, text) in seen)))
        seen.add((role, text))
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    faults = [kind for _, kind in marked]
    cost, audit = best_repair(marked)
    return (
        gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), _illegal([r for r, _ in marked]),
        cost, audit, _repaired_hash(rows, audit),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Turns (conv, turn, role, text, copy) dropped, emptied, stripped of sentence ends, repeated or
    given the role user, by ``crc32(conv:turn) % 20``; null parts count as one blank."""
    own = rows.select(
        "conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")])
    kind = F.crc32(F.encode(name, "utf-8")) % 20
    own = own.withColumn("kind", kind).where("kind > 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return own.select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"), F.explode(copies).alias("copy"),
    )


def plain_turns(df: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Conversations as they are, as turns for ``repair``."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return df.select(F.col(f"`{conv}`").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
                     text.alias("text"), F.lit(0).alias("copy"))


_ORDER = ["turn", "role", "mark", "copy"]


def _batch(keys: list, rows: list, kind) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), *columns], ["conv", *_NAMES])


def _small(turns: DataFrame) -> DataFrame:
    """The results of conversations that a task may gather."""
    kind = turns.schema["conv"].dataType.simpleString()

    def scan(batches):
        at, numbers, rows = None, [], []
        keys, done, of = [], [], None
        for batch in batches:
            of = batch.schema.field(0).type
            for conv, turn, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if at is not None and at != (conv,):
                    keys.append(at[0])
                    done.append(repaired(numbers, rows))
                    numbers, rows = [], []
                    if len(done) >= 4096:
                        yield _batch(keys, done, of)
                        keys, done = [], []
                at = (conv,)
                numbers.append(turn)
                rows.append((role, text))
        if at is not None:
            keys.append(at[0])
            done.append(repaired(numbers, rows))
            yield _batch(keys, done, of)

    dealt = turns.withColumn("mark", F.sha2("text", 256)).repartition("conv")
    ordered = dealt.sortWithinPartitions("conv", *_ORDER).select("conv", "turn", "role", "text")
    return ordered.mapInArrow(scan, f"conv {kind}, {_RESULT}")


def _tables(of: pa.DataType):
    """(conv, block, its table) as Arrow rows."""

    def made(conv, block, entry) -> pa.Table:
        table, first, last, counts = entry
        costs = [None if t is None else t[0] for t in table]
        audits = [None if t is None else t[1] for t in table]
        return pa.table(
            [pa.array([conv], of), pa.array([block], pa.int64()), pa.array([costs], pa.list_(pa.int64())),
             pa.array([audits], pa.list_(pa.string())), pa.array([first]), pa.array([last]),
             pa.array([counts], pa.list_(pa.int64()))],
            ["conv", "block", "costs", "audits", "first", "last", "counts"],
        )

    return made


def _block(group: pa.Table) -> pa.Table:
    rows = sorted(zip(*(group.column(c).to_pylist() for c in ("pos", "initial", "fault"))))
    turns = [(initial, kind) for _, initial, kind in rows]
    kinds = [kind for _, kind in turns]
    counts = [kinds.count(BLANK), kinds.count(DUPLICATE), kinds.count(CUT), _illegal([i for i, _ in turns])]
    conv, block = group.column("conv"), group.column("block")
    entry = block_table(turns), turns[0][0], turns[-1][0], counts
    return _tables(conv.type)(conv[0].as_py(), block[0].as_py(), entry)


def _neighbours(group: pa.Table) -> pa.Table:
    names = ("block", "costs", "audits", "first", "last", "counts")
    table = None
    for _, costs, audits, begin, end, own in sorted(zip(*(group.column(c).to_pylist() for c in names))):
        here = [None if c is None else (c, a) for c, a in zip(costs, audits)]
        if table is None:
            table, first, last, counts = here, begin, end, np.array(own)
        else:
            table, counts = joined(table, here), counts + np.array(own)
            counts[3] += last + begin not in LEGAL
            last = end
    conv = group.column("conv")
    entry = table, first, last, counts.tolist()
    return _tables(conv.type)(conv[0].as_py(), group.column("above")[0].as_py(), entry)


def _large(turns: DataFrame) -> DataFrame:
    """The results of conversations that no task gathers: numbered, searched in blocks, joined."""
    kind = turns.schema["conv"].dataType.simpleString()
    # Equal turns may stand in any order; a number keeps them apart.
    rows = turns.withColumns({"mark": F.sha2("text", 256), "row": F.monotonically_increasing_id()})
    rows = with_position(keep(rows, "large"), [*_ORDER, "row"], within=["conv"])
    rows = keep(rows, "numbered")
    same = ("conv", "role", "mark")
    first = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in same]).agg(F.min("pos").alias("first"))
    last = F.regexp_extract("text", rf"(?s)({_CHAR})[\x20\x09-\x0D]*\z", 1)
    fault_ = (
        F.when(~F.rlike("text", F.lit(_CHAR)), BLANK).when(F.col("pos") > F.col("first"), DUPLICATE)
        .when(~F.col("last").isin(".", "!", "?"), CUT).otherwise(SOUND)
    )
    marked = rows.join(first, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same])).select(
        "conv", "pos", F.left("role", F.lit(1)).alias("initial"), "text", "first", last.alias("last")
    )
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    marked = marked.select("conv", "pos", block, "initial", fault_.alias("fault"))
    schema = (
        f"conv {kind}, block long, costs array<long>, audits array<string>, first string, last string, counts array<long>"
    )
    tables = keep(marked.groupBy("conv", "block").applyInArrow(_block, schema), "blocks")
    level = 0
    while tables.where("block > 0").take(1):
        above = tables.withColumn("above", F.floor(F.col("block") / BLOCK))
        level += 1
        tables = keep(above.groupBy("conv", "above").applyInArrow(_neighbours, schema), f"blocks{level}")

    @F.udf("cost long, audit string")
    def chosen(costs, audits):
        return whole([None if c is None else (c, a) for c, a in zip(costs, audits)])

    counts = [F.col("counts")[k].alias(name) for k, name in enumerate(_COUNTS)]
    found = tables.withColumn("best", chosen("costs", "audits")).select(F.col("conv").alias("of"), *counts, "best.*")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy(F.col("conv").alias("of")).agg(F.coalesce(span, F.lit(0)).alias("gaps"))
    found = found.join(gaps.withColumnRenamed("of", "of2"), F.col("of").eqNullSafe(F.col("of2"))).drop("of2")
    found = keep(found, "found")

    def scan(batches):
        own, key, state, digest, edits, at, begun, of = None, None, 0, None, "", 0, False, None

        def put(role, text):
            nonlocal begun
            digest.update((f"\n{role}:{text}" if begun else f"{role}:{text}").encode("utf-8", "surrogatepass"))
            begun = True

        def inserted():
            nonlocal at, state
            while at < len(edits) and edits[at] == "I":
                state = FREE[state]
                put(ROLE[state], "")
                at += 1

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([key], of), pa.array([digest.hexdigest()])], ["conv", "repaired_sha256"]
            )

        for batch in batches:
            of = batch.schema.field(0).type
            for conv, role, text, audit in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if audit is not None:
                    if own is not None:
                        yield done()
                    own, key, state, digest, edits, at, begun = True, conv, 0, hashlib.sha256(), audit, 0, False
                    inserted()
                edit = edits[at]
                at += 1
                if edit == "K":
                    state = STEP[state, role[:1]]
                    put(role, text)
                elif edit == "R":
                    state = FREE[state]
                    put(ROLE[state], text)
                inserted()
        if own is not None:
            yield done()

    # The first row of a conversation carries its audit.
    start = (F.col("pos") == 0) & F.col("conv").eqNullSafe(F.col("of"))
    audited = rows.join(found.select("of", "audit"), start, "left").select("conv", "role", "text", "audit", "pos")
    dealt = audited.repartition("conv").sortWithinPartitions("conv", "pos").drop("pos")
    hashed = dealt.mapInArrow(scan, f"conv {kind}, repaired_sha256 string")
    return found.join(hashed, F.col("of").eqNullSafe(F.col("conv"))).select("conv", *_NAMES)


def repair(turns: DataFrame, large: int = LARGE) -> DataFrame:
    """One row per conversation of ``turns`` (conv, turn, role, text, copy): gaps, faults, cost and
    audit of the best repair, and the SHA-256 of the repaired conversation."""
    ship(turns.sparkSession)
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large)
    sizes = keep(sizes.select(F.col("conv").alias("of")), "large_convs")
    if not sizes.take(1):
        return _small(turns)
    same = F.col("conv").eqNullSafe(F.col("of"))
    return _small(turns.join(sizes, same, "left_anti")).unionByName(_large(turns.join(sizes, same, "left_semi")))


def repair_damaged(df: DataFrame, large: int = LARGE) -> DataFrame:
    """``repair`` of conversations (conv_id, turn, role, text) after damage, with a row for each
    conv_id, also for those that lost all their turns."""
    rows = df.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")
    found = repair(damaged(rows), large)
    every = rows.select(F.col("conv").alias("conv_id")).distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    none = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return out.select("conv_id", *[F.coalesce(n, none.get(n, F.lit(0).cast("long"))).alias(n) for n in _NAMES])
