"""Repair of conversations against a search of all edits."""

import hashlib
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marlstone.llm import dialogue

from ..conftest import SF

AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}  # what may follow what was written last
WHITE = " \t\n\v\f\r"


def cheapest(rows):
    """(cost, audit) by keeping the best way to each last role, row by row."""

    def inserted(ways):
        for _ in range(4):
            for last, (cost, audit) in list(ways.items()):
                for r in set(AFTER[last]) - {"s"}:
                    ways[r] = min(ways.get(r, (cost + 3, audit + "I")), (cost + 3, audit + "I"))
        return ways

    ways = inserted({"": (0, "")})
    for initial, fault in rows:
        new = {}
        for last, (cost, audit) in ways.items():
            charge = 3 if fault == "truncated" else 0
            reach = [(last, cost + 4, "D")]
            if fault in ("", "truncated"):
                reach += [(initial, cost + charge, "K")] if initial and initial in AFTER[last] else []
                reach += [(r, cost + 3 + charge, "R") for r in set(AFTER[last]) - {"s"}]
            for to, c, e in reach:
                new[to] = min(new.get(to, (c, audit + e)), (c, audit + e))
        ways = inserted(new)
    return min(ways[r] for r in ("", "a") if r in ways)


def repaired(rows):
    """Everything that op11 says of one conversation's damaged rows (turn, role, text), in order."""
    seen, moves = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        moves.append((role[:1], fault))
    cost, audit = cheapest(moves)
    out, last, i = [], "", 0
    for edit in audit:
        role, text = (rows[i][1], rows[i][2]) if edit != "I" else (None, "")
        i += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = {"u": "user", "a": "assistant"}[min(set(AFTER[last]) - {"s"})]
        last = role[:1]
        out.append(f"{role}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(moves, moves[1:]))
    kinds = [f for _, f in moves]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            out += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest())
    return sorted(out, key=key)


def expected(rows):
    return {c: repaired(damaged([r for r in rows if r[0] == c])) for c in {r[0] for r in rows}}


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check(spark, folder, rows, monkeypatch=None):
    got = dialogue.op11_edit_lattice(spark, str(folder)).collect()
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r.conv_id], r.conv_id


def test_search_finds_the_cheapest_and_least_audit():
    rng = random.Random(5)
    names = {0: "", 1: "truncated", 2: "duplicate", 3: "blank"}
    for n in [*range(1, 9)] * 30 + [60, 300]:
        rows = [(rng.choice(["s", "u", "a", "a", "u", "t", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        want = cheapest([(i, names[f]) for i, f in rows])
        for piece in (1, 2, 3, 128):
            assert dialogue.whole(rows, piece) == want


def test_shared_conversations(spark):
    check(spark, SF, [tuple(r.values()) for r in pq.read_table(f"{SF}/conversations.parquet").select(["conv_id", "turn", "role", "text"]).to_pylist()])


@pytest.fixture
def few_rows_a_segment(monkeypatch):
    whole = dialogue.repair
    monkeypatch.setattr(dialogue, "repair", lambda rows: whole(rows, segment_bits=2, piece=2, part_bytes=1000))


def test_long_conversations_over_many_segments(spark, tmp_path, few_rows_a_segment):
    """One conversation has most rows; segments hold four rows, so that all of it is composed."""
    rng = random.Random(2)
    texts = ["Yes.", "No!", "cut off", "", "  \n", "Why?", "Done. ", "a.b"]
    rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(texts) + (str(rng.random()) if rng.random() < 0.8 else "")) for t in range(200)]
    rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for c in range(2, 40) for t in range(rng.randint(1, 6))]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    check(spark, tmp_path, rows)


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, ties, repeated rows, roles of other kinds, a long text and clashing columns."""
    rows = [
        (None, None, None, None), (None, 1, "user", "Hm."), (None, 1, "user", "Hm."), (1, None, "user", "a."), (1, None, "assistant", "b."),
        (1, 3, "assistant", "x " * 50_000 + "."), (1, 9, "", "empty role."), (2, 5, "user", None), (3, 0, "system", "only"), (4, 0, None, "q."),
        (4, 0, "User", "q."), (4, 0, "user", "é. "), (4, 2**40, "user", "far."), (5, -3, "assistant", "\t"),
    ]
    names = ("at", "seg", "kind", "edit", "sub", "key", "same", "ways", "audit", "cost")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in names})
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    check(spark, tmp_path, rows)


def test_all_rows_dropped_and_no_rows(spark, tmp_path):
    conv = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(conv, 0, "user", "Gone.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/one/conversations.parquet")
    check(spark, f"{tmp_path}/one", rows)
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert dialogue.op11_edit_lattice(spark, f"{tmp_path}/none").count() == 0


def test_repaired_rows_alternate(spark):
    """The operator's own rows: the roles of each conversation follow the pattern, texts are those of the input."""
    source = spark.read.parquet(f"{SF}/conversations.parquet")
    _, rows = dialogue.repair(source)
    by = {}
    for r in rows.collect():
        by.setdefault(r.conv_id, []).append(r)
    known = {(str(r.conv_id), r.text) for r in source.collect()}
    for conv, own in by.items():
        own.sort(key=lambda r: (r["at"], r["sub"]))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own))
        assert all(r.edit == "I" and r.text == "" or (conv, r.text) in known for r in own)
