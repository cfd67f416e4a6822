"""Repair of conversations: the cheapest edits that give turns of a system message at most, then user and assistant.

The edits of a conversation are a path through a lattice of (rows read, role last written). A* searches it; the
heuristic is the suffix sum of what every path still pays: deletions of blank and repeated rows, and the charge of
truncated rows, which costs less than to delete them. The queue is keyed (cost + heuristic, audit), so the first path
to a node is the cheapest and, of equal ones, the least audit.

Rows are sorted over all tasks, so that a conversation of any length is spread over them, and cut into segments of
bounded length. A segment that may hold only part of a conversation is searched from every state to every state; such
tables are composed as (cost, audit) pairs, and the state in which each segment begins is handed back to its rows.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_pieces, plain, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States are what was written last: nothing, s, u, a. Only 0 and 3 may end a conversation.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: What an insertion or a change of role writes in each state, and the state after it.
NEXT = tuple((r, s[r]) for s in STEP for r in "ua" if r in s)
ROLES = {"u": "user", "a": "assistant"}
#: Faults by rank: none, truncated, repeated, blank. The last two must go.
FINE, CUT, AGAIN, BLANK = 0, 1, 2, 3
#: Rows of a search; longer runs are searched in pieces, since the keys of a search are as long as its rows.
PIECE = 128
#: Rows of a segment are at most two to this.
SEGMENT_BITS = 16
SPACE = " \t\n\v\f\r"


def search(rows: list[tuple[str, int]], begin: int, ends=None) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the cheapest and then ASCII-least way from ``begin`` through (initial, fault) rows to each state.

    With ``ends`` the search stops at the first of these states that it reaches after the last row.
    """
    n = len(rows)
    least = [*accumulate(reversed([DELETE if f >= AGAIN else TRUNCATED if f == CUT else 0 for _, f in rows]), initial=0)][::-1]
    queue, done, found = [(least[0], "", 0, begin)], set(), {}
    while queue and len(found) < 4:
        f, audit, i, q = heapq.heappop(queue)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n:
            found[q] = (f, audit)
            if ends and q in ends:
                return {q: found[q]}
        role, after = NEXT[q]
        paid = f - least[i]
        if i < n:
            initial, fault = rows[i]
            heapq.heappush(queue, (paid + DELETE + least[i + 1], audit + "D", i + 1, q))
            if fault < AGAIN:
                charge = paid + TRUNCATED * (fault == CUT) + least[i + 1]
                if initial in STEP[q]:
                    heapq.heappush(queue, (charge + KEEP, audit + "K", i + 1, STEP[q][initial]))
                if initial != role:
                    heapq.heappush(queue, (charge + REROLE, audit + "R", i + 1, after))
        if (i, after) not in done:
            heapq.heappush(queue, (f + INSERT, audit + "I", i, after))
    return found


Ways = list[dict[int, tuple[int, str]]]


def join_ways(a: Ways, b: Ways) -> Ways:
    """Ways through a and then b, by the state that they begin in."""
    out = []
    for first in a:
        best: dict[int, tuple[int, str]] = {}
        for cost, audit, rest in ((c, t, b[q]) for q, (c, t) in first.items()):
            for end, (more, tail) in rest.items():
                new = (cost + more, audit + tail)
                if end not in best or new < best[end]:
                    best[end] = new
        out.append(best)
    return out


def through(rows: list[tuple[str, int]], piece: int = PIECE) -> Ways:
    """The ways through any number of rows, pieces of them composed two by two."""
    parts = [[search(rows[i : i + piece], q) for q in range(4)] for i in range(0, len(rows), piece)]
    while len(parts) > 1:
        parts = [join_ways(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def whole(rows: list[tuple[str, int]], piece: int = PIECE) -> tuple[int, str]:
    """(cost, audit) of a conversation that begins and ends here."""
    return min((search(rows, 0, ENDS) if len(rows) <= piece else {q: w for q, w in through(rows, piece)[0].items() if q in ENDS}).values())


def _runs(rows, key):
    """(value, rows) of runs with an equal value."""
    run: list = []
    for r in rows:
        if run and key(run[-1]) != key(r):
            yield key(run[0]), run
            run = []
        run.append(r)
    if run:
        yield key(run[0]), run


def _each(batches):
    for batch in in_pieces(batches):
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows, schema: pa.Schema, size: int = 2048, most: int = 4 << 20):
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += sum(len(x) for x in r if isinstance(x, str))
        if len(held) == size or n > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_WAYS = "array<struct<begin:int,end:int,cost:long,audit:string>>"
_WAY_TYPE = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_SEGMENT = pa.schema([
    ("conv_id", pa.string()), ("at", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("ways", _WAY_TYPE),
])
_DONE = pa.schema([*[(n, _SEGMENT.field(n).type) for n in ("conv_id", "blank", "duplicate", "truncated", "illegal")], ("cost", pa.int64()), ("audit", pa.string()), ("parts", pa.list_(pa.struct([("at", pa.int64()), ("state", pa.int32()), ("edits", pa.string())])))])
_LEGAL = ("su", "ua", "au")


def _segments(piece: int):
    """From one segment's rows (conv, at, initial, fault) what is known of each conversation in it."""

    def run(_, got: pa.Table) -> pa.Table:
        rows = sorted(_each(got.to_batches()), key=lambda r: r[1])
        runs = [*_runs(rows, lambda r: r[0])]

        def known():
            for k, (conv, own) in enumerate(runs):
                moves = [(r[2], r[3]) for r in own]
                if 0 < k < len(runs) - 1:  # all of the conversation is here
                    ways = [(0, 0, *whole(moves, piece))]
                else:
                    ways = [(b, e, *w) for b, found in enumerate(through(moves, piece)) for e, w in found.items()]
                kinds = [f for _, f in moves]
                illegal = sum(a + b not in _LEGAL for (a, _), (b, _) in zip(moves, moves[1:]))
                yield conv, own[0][1], kinds.count(BLANK), kinds.count(AGAIN), kinds.count(CUT), illegal, moves[0][0], moves[-1][0], [dict(zip(("begin", "end", "cost", "audit"), w)) for w in ways]

        return pa.Table.from_batches(_batches(known(), _SEGMENT), _SEGMENT)

    return run


def _compose(batches):
    """Segments of each conversation, in order, into its cost and audit, and the state that each segment begins in."""

    def done():
        for conv, own in _runs(_each(batches), lambda r: r[0]):
            blank, again, cut = (sum(r[k] for r in own) for k in (2, 3, 4))
            illegal = sum(r[5] for r in own) + sum(a[7] + b[6] not in _LEGAL for a, b in zip(own, own[1:]))
            paths = {0: (0, "", ())}  # state: cost, audit, (state at the start, edits) of each segment
            for r in own:
                best: dict = {}
                for w in r[8]:
                    if w["begin"] in paths:
                        cost, audit, parts = paths[w["begin"]]
                        new = (cost + w["cost"], audit + w["audit"], (parts, w["begin"], w["audit"]))
                        if w["end"] not in best or new[:2] < best[w["end"]][:2]:
                            best[w["end"]] = new
                paths = best
            cost, audit, parts = min((paths[q] for q in ENDS if q in paths), key=lambda p: p[:2])
            handed = []
            for r in reversed(own):
                parts, state, edits = parts
                handed.append({"at": r[1], "state": state, "edits": edits})
            yield conv, blank, again, cut, illegal, cost, audit, handed[::-1]

    yield from _batches(done(), _DONE, 512)


_REPAIRED = pa.schema([("conv_id", pa.string()), ("at", pa.int64()), ("sub", pa.int32()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _apply(batches):
    """Rows in order, before each conversation's the edits that it gets here; gives the rows that are left."""

    def left():
        q, edits, i, body = 0, "", 0, 0
        for conv, at, kind, state, role, text in _each(batches):
            if kind == 0:
                edits, q, i, body = text, state, 0, len(text.rstrip("I"))
                continue
            sub = 0
            while edits[i] == "I":
                written, q = NEXT[q]
                yield conv, at, sub, "I", ROLES[written], ""
                i, sub = i + 1, sub + 1
            if edits[i] == "K":
                q = STEP[q][role[:1]]
                yield conv, at, sub, "K", role, text
            elif edits[i] == "R":
                written, q = NEXT[q]
                yield conv, at, sub, "R", ROLES[written], text
            i += 1
            while body <= i < len(edits):  # after the last row
                sub += 1
                written, q = NEXT[q]
                yield conv, at, sub, "I", ROLES[written], ""
                i += 1

    yield from _batches(left(), _REPAIRED)


def repair(conversations: DataFrame, *, segment_bits: int = SEGMENT_BITS, piece: int = PIECE, part_bytes: int = 8 << 20, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Two frames: (conv_id, blank, duplicate, truncated, illegal, cost, audit) of each conversation, and the rows of the
    repaired ones (conv_id, at, sub, edit, role, text), in the order of at and sub.

    conv_id is text in both. Rows go by turn, nulls first, ties by role and then by the SHA-256 of role and text; equal
    rows stand together. Null roles and texts are one space, so that the text is blank; a role is known by its first
    letter, and an empty role has none. A null conv_id is a conversation like others. Other columns are not read. An
    empty table gives empty frames.
    """
    scratch = scratch or Scratch()
    spark = conversations.sparkSession
    own = plain(conversations)
    rows = own.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("_ms_row"))
    rows = rows.withColumn("key", F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256))
    total = rows.agg(F.sum(F.octet_length("text") + 128)).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-total // part_bytes))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "key", "_ms_row"]
    kept = F.rtrim("text", F.lit(SPACE))
    flags = [
        F.substring("role", 1, 1).alias("initial"),
        F.when(F.length(kept) == 0, BLANK).when(F.right(kept, F.lit(1)).isin(*".!?"), FINE).otherwise(CUT).alias("fault"),
        F.sha2(F.concat_ws(":", F.coalesce(F.concat(F.lit("="), "conv_id"), F.lit("null")), "key").cast("binary"), 256).alias("same"),
    ]
    ordered = scratch.written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).select("conv_id", "at", "role", "text", *flags), "turns")

    light = ordered.select("conv_id", "at", "initial", "fault", "same")
    again = light.groupBy("same").agg(F.min("at").alias("_ms_first"), F.count("*").alias("_ms_n")).where("_ms_n > 1")
    seg = F.shiftright("at", segment_bits)
    judged = light.join(again, "same", "left").select(
        seg.alias("seg"), "conv_id", "at", "initial",
        F.when((F.col("fault") != BLANK) & (F.col("at") > F.col("_ms_first")), AGAIN).otherwise(F.col("fault")).alias("fault"),
    )
    in_segments = judged.groupBy("seg").applyInArrow(_without_seg(_segments(piece)), f"conv_id string, at long, blank long, duplicate long, truncated long, illegal long, first string, last string, ways {_WAYS}")
    made = in_segments.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_compose, "conv_id string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, parts array<struct<at:long,state:int,edits:string>>")
    summary = scratch.written(made, "conversations")
    handed = summary.select("conv_id", F.explode("parts").alias("p")).select("conv_id", "p.at", F.lit(0).alias("kind"), "p.state", F.lit(None).cast("string").alias("role"), F.col("p.edits").alias("text"))
    both = handed.unionByName(ordered.select("conv_id", "at", F.lit(1).alias("kind"), F.lit(0).alias("state"), "role", "text"))
    # a segment is bounded, and all of its rows go to one task, the edits of a conversation first
    left = both.repartition(seg).sortWithinPartitions("at", "kind").mapInArrow(_apply, "conv_id string, at long, sub int, edit string, role string, text string")
    return summary.drop("parts"), left


def _without_seg(fn):
    return lambda key, got: fn(key, got.drop_columns(["seg"]))


def digest(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the newline-joined ``role:text``. A hash is a chain over its input, so that one task
    reads a conversation's rows; it holds one batch of them at a time."""

    def run(batches):
        schema = pa.schema([("conv_id", pa.string()), ("repaired_sha256", pa.string())])

        def hashes():
            current, h = None, None
            for conv, role, text in _each(batches):
                if h is None or conv != current:
                    if h is not None:
                        yield current, h.hexdigest()
                    current, h = conv, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            if h is not None:
                yield current, h.hexdigest()

        yield from _batches(hashes(), schema)

    return repaired.repartition("conv_id").sortWithinPartitions("conv_id", "at", "sub").select("conv_id", "role", "text").mapInArrow(run, "conv_id string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given to the user, by the crc32 of ``conv_id:turn``; nulls are one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = plain(conversations).select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), (F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20).alias("_ms_hit")).where("_ms_hit != 0")
    hit = hit.withColumn("_ms_copy", F.explode(F.when(F.col("_ms_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("_ms_hit") == 1, "").when(F.col("_ms_hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return hit.select("conv_id", "turn", F.when(F.col("_ms_hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def op11_edit_lattice(spark, sf_dir: str) -> DataFrame:
    """The faults of every conversation after damage, its cheapest repair and the digest of what that gives.

    Null conv_ids are one conversation. Repeated rows are damaged alike and become duplicates. A conversation without
    rows after damage has zeros, an empty audit and the digest of nothing.
    """
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damaged(conversations)
    summary, left = repair(rows)
    turns = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    # a conversation's values are one row in each of these, and every conv_id is in the first of them
    every = conversations.select("conv_id").distinct().withColumn("_ms_id", F.col("conv_id").cast("string"))
    name = lambda df: df.withColumnRenamed("conv_id", "_ms_own")
    for one, key in ((turns, "conv_id"), (summary, "_ms_id"), (digest(left), "_ms_id")):
        one = name(one)
        every = every.join(one, every[key].eqNullSafe(one["_ms_own"]), "left").drop("_ms_own")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return every.withColumns(zero).select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
