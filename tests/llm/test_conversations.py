"""Repairs against an exhaustive search and against plain restatements of the damage and the faults."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from eventide.llm import conversations as c
from pyspark.sql import functions as F


def cheapest(rows: list[tuple[str, str, bool, bool]]) -> tuple[int, str, tuple]:
    """(cost, audit, lines) over all edit scripts: rows are (role, text, must go, truncated). Goes back from the end, trying everything."""

    @lru_cache(None)
    def rest(i: int, made: str, inserts: int) -> tuple:
        """made: the roles so far, repeated pairs shortened to one; at most three inserts in a row, so that the search ends."""
        found = [(0, "", ())] if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", made) else []
        ways = []  # edit, role, cost, text, rows that it takes
        if i < len(rows):
            role, text, gone, cut = rows[i]
            cost, audit, lines = rest(i + 1, made, 0)
            found.append((cost + 4, "D" + audit, lines))
            if not gone:
                ways += [(edit, name, more + 3 * cut, text, 1) for edit, name, more in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3))]
        if inserts < 3:
            ways += [("I", name, 3, "", 0) for name in ("user", "assistant")]
        for edit, name, more, text, taken in ways:
            if name and re.fullmatch(r"s?(ua)*u?", made + name[0]):
                cost, audit, lines = rest(i + taken, re.sub("(ua)+", "ua", made + name[0]), 0 if taken else inserts + 1)
                found.append((cost + more, edit + audit, ((name, text), *lines)))
        return min(found, key=lambda x: x[:2], default=(10**9, "", ()))

    return rest(0, "", 0)


def plain(rows: list[tuple]) -> dict:
    """Faults, gaps and the search for one conversation's rows (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
    seen, counts, given = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        given.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, lines = cheapest(given)
    return counts | {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "illegal": sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(given, given[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
    }


def searched(rows: list[tuple[str, str, bool, bool]]) -> tuple[int, str, int]:
    edits, most = [], 0
    search = c.Viterbi(lambda edit, row: edits.append(edit))
    for role, _, gone, cut in rows:
        search.push(role, role[:1], c.BLANK if gone else c.CUT if cut else c.CLEAN)
        most = max(most, len(search.rows))
    return search.close(), "".join(edits), most


def test_every_short_conversation():
    """All sequences of up to four rows over six kinds of row: cost and audit are those of the exhaustive search."""
    import itertools

    kinds = [("user", "x.", False, False), ("assistant", "y.", False, False), ("system", "z.", False, False), ("tool", "t.", False, False), ("user", "cut", False, True), ("assistant", "", True, False)]
    for n in range(5):
        for rows in itertools.product(kinds, repeat=n):
            cost, audit, _ = cheapest(list(rows))
            assert searched(list(rows))[:2] == (cost, audit), rows


@pytest.mark.parametrize("seed", range(6))
def test_longer_conversations(seed):
    draw = random.Random(seed)
    for _ in range(60):
        rows = [(draw.choice(["user", "assistant", "assistant", "user", "system", "tool", ""]), "x", draw.random() < 0.15, draw.random() < 0.2) for _ in range(draw.randrange(5, 14))]
        assert searched(rows)[:2] == cheapest(rows)[:2], rows


def test_memory_stays_small():
    """A conversation of 100,000 rows: the unresolved part never holds more than a few rows, and the cost is that of a dynamic program without paths."""
    draw = random.Random(1)
    rows = [(draw.choice(["user", "assistant", "system", "tool"]) if draw.random() < 0.3 else ("user", "assistant")[i % 2], "x", draw.random() < 0.1, draw.random() < 0.1) for i in range(100_000)]
    cost, audit, most = searched(rows)
    assert most < 60 and len(re.sub("I", "", audit)) == len(rows)
    best = {0: 0}
    for role, _, gone, cut in rows:
        new: dict[int, int] = {}
        for s, v in best.items():
            for to, more, _ in c.STEPS[role[:1] if role[:1] in "sua" else "", c.BLANK if gone else c.CUT if cut else c.CLEAN][s]:
                new[to] = min(new.get(to, 10**9), v + more)
        best = new
    assert cost == min(v + c.END[s][0] for s, v in best.items())


def damage(rows: list[tuple]) -> dict:
    out: dict = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            kept.extend([(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1))
    return out


def test_rows_of_a_table(spark):
    """Nulls everywhere, repeated rows and texts, one hot conversation, white space of other kinds, a very long text, clashing columns, in any order."""
    draw = random.Random(5)
    said = ["Yes.", "No", "Why?", "", " \t\n", None, "Über! ", "a. \x0b\x0c\r", "x" * 50_000 + "."]
    rows = [(draw.choice([1, 2, 3, 4, 5, None]), draw.choice([0, 1, 2, 5, 9, -3, None]), draw.choice(["user", "assistant", "system", None, "", "tool"]), draw.choice(said)) for _ in range(70)]
    rows += [(7, t, ("user", "assistant")[t % 2], draw.choice(said[:3]) + str(t // 40)) for t in range(120)] + [(8, 0, "user", "hi.")] * 3
    lone = next(i for i in range(1000, 9000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((lone, 0, "user", "dropped."))
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({n: F.lit("clash") for n in ("mark", "key", "fault", "seq", "edit", "_code")}).repartition(3)
    got = {r.conv_id: r.asDict() for r in c.audit(c.damaged(df), df).collect()}
    want = damage(rows)
    assert got.keys() == want.keys()
    for conv, given in want.items():
        assert got[conv] == {"conv_id": conv} | plain(given), conv
    assert got[lone]["audit"] == "" and got[lone]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_edits_are_the_repaired_conversation(spark):
    draw = random.Random(6)
    rows = [(i % 9, t, draw.choice(["user", "assistant", "system"]), draw.choice(["One.", "Two", "Three!", " "]) + str(t % 3) * (t % 2)) for i in range(40) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    edits, audits = {}, {r.conv_id: r for r in c.audit(df).collect()}
    for r in c.repair(df).orderBy("conv_id", "seq").collect():
        edits.setdefault(r.conv_id, []).append(r)
    for conv, made in edits.items():
        assert "".join(r.edit for r in made) == audits[conv].audit
        kept = [f"{r.role}:{r.text}" for r in made if r.edit != "D"]
        assert hashlib.sha256("\n".join(kept).encode()).hexdigest() == audits[conv].repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in made if r.edit != "D"))
        assert [r.seq for r in made] == list(range(1, len(made) + 1))


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.audit(c.damaged(df), df).collect() == [] and c.repair(df).collect() == []


def test_query_and_sql(spark, sf):
    import duckdb
    from eventide.llm import queries

    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    df = queries.op11_conversation_repair(spark, sf)
    want = duckdb.sql(f"SELECT {', '.join(df.columns)} FROM ({c.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
