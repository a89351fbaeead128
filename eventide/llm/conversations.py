"""Repair of conversations to ``(s?(ua)+)?`` at least cost, by a Viterbi search that streams.

Rows of a conversation pass through one task in order, however many they are.
Each of the four states of the grammar keeps its cheapest path; the paths form a
tree of back pointers whose nodes count those that refer to them. A node
without survivors is freed, and while the root has one child only, that child's
edits are final: they are emitted and forgotten. Paths of equal cost into a state are told
apart by all edits since their common ancestor, none of which has been emitted.
What is held is the unresolved part alone.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that trims from texts.
BLANKS = " \t\n\v\f\r"
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
CLEAN, BLANK, DUPLICATE, CUT = range(4)
FAULTS = ("", "blank", "duplicate", "truncated")
#: Parts that the turns of one text of a conversation are dealt to.
SALTS = 16

# States: nothing yet, after system, after user, after assistant. What a state asks for, and where that leads.
ROLE, NEXT = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: By state: what ends a conversation there, and its cost.
END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def _taken(state: int, initial: str) -> int | None:
    """Where a row that is kept leads."""
    if initial == "s":
        return 1 if state == 0 else None
    return NEXT[state] if initial == ROLE[state][0] else None


def _steps(initial: str, fault: int) -> list[list[tuple[int, int, str]]]:
    """By state, ``(next state, cost, edits)`` for one row: the best way to each next state. Inserts stand right before a row that stays."""
    out = []
    for state in range(4):
        best = {state: (DELETE, "D")}
        at, extra = state, TRUNCATED if fault == CUT else 0
        for n in range(3 if fault in (CLEAN, CUT) else 0):
            ways = [(NEXT[at], (INSERT * n + extra + REROLE, "I" * n + "R"))]
            if (to := _taken(at, initial)) is not None:
                ways.append((to, (INSERT * n + extra, "I" * n + "K")))
            for to, way in ways:
                best[to] = min(best.get(to, way), way)
            at = NEXT[at]
        out.append([(to, *way) for to, way in best.items()])
    return out


STEPS = {(initial, fault): _steps(initial, fault) for initial in ("s", "u", "a", "") for fault in range(4)}
#: What the rest of a conversation can cost more from the first state than from the second: a path that is dearer than another by more than that is lost.
BEHIND = {(0, 1): 0, (0, 2): 3, (0, 3): 0, (1, 0): 6, (1, 2): 3, (1, 3): 6, (2, 0): 7, (2, 1): 3, (2, 3): 3, (3, 0): 4, (3, 1): 0, (3, 2): 3}


class Node:
    """A state after a row: the edits of that row, and the paths that go on from here."""

    __slots__ = ("children", "edits", "parent")

    def __init__(self, parent: Node | None, edits: str):
        self.parent, self.edits, self.children = parent, edits, set()


def _before(a: Node, b: Node, end_a: str, end_b: str) -> bool:
    """Whether the edits to a and then end_a come first, from the common ancestor on (both nodes are equally deep)."""
    left, right = [end_a], [end_b]
    while a is not b:
        left.append(a.edits), right.append(b.edits)
        a, b = a.parent, b.parent
    return "".join(reversed(left)) < "".join(reversed(right))


class Viterbi:
    """Cheapest edits of one conversation; ``emit(edit, row)`` gets them in order as soon as they are certain (row: None for inserts)."""

    def __init__(self, emit: Callable[[str, object], None]):
        self.emit = emit
        self.root = Node(None, "")
        self.live = {0: (0, self.root)}
        self.rows: deque = deque()  # of the nodes below the root

    def push(self, row: object, initial: str, fault: int) -> None:
        steps = STEPS[initial if initial in ("s", "u", "a") else "", fault]
        best: dict[int, tuple[int, Node, str]] = {}
        for state, (cost, node) in self.live.items():
            for to, more, edits in steps[state]:
                total, held = cost + more, best.get(to)
                if held is None or total < held[0] or (total == held[0] and _before(node, held[1], edits, held[2])):
                    best[to] = (total, node, edits)
        old, self.live = self.live, {}
        for state, (cost, node, edits) in best.items():
            if not any(other[0] + BEHIND[to, state] < cost for to, other in best.items() if to != state):
                made = Node(node, edits)
                node.children.add(made)
                self.live[state] = (cost, made)
        for _, node in old.values():
            while not node.children and node.parent is not None:
                node.parent.children.discard(node)
                node = node.parent
        self.rows.append(row)
        while len(self.root.children) == 1:  # all survivors descend from it
            (child,) = self.root.children
            child.parent, self.root = None, child
            self._out(child.edits, self.rows.popleft())

    def _out(self, edits: str, row: object) -> None:
        for edit in edits[:-1]:
            self.emit(edit, None)
        self.emit(edits[-1], row)

    def close(self) -> int:
        """The cost; the rest of the edits is emitted."""
        best = None
        for state, (cost, node) in self.live.items():
            more, end = END[state]
            if best is None or cost + more < best[0] or (cost + more == best[0] and _before(node, best[1], end, best[2])):
                best = (cost + more, node, end)
        cost, node, end = best
        path = []
        while node is not self.root:
            path.append(node.edits)
            node = node.parent
        for edits in reversed(path):
            self._out(edits, self.rows.popleft())
        for edit in end:
            self.emit(edit, None)
        return cost


class Conversation:
    """Rows of one conversation in order: its faults, and its edits with the roles that they give."""

    def __init__(self, ident: object, sink: Callable[[str, tuple | None, bytes], None]):
        self.ident, self.sink, self.state = ident, sink, 0
        self.search = Viterbi(self._edit)
        self.counts = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.turn = self.key = self.initial = None
        self.late: set[bytes] = set()  # texts of this turn that earlier turns have said
        self.begun = False

    def announce(self, turn: object, key: bytes | None) -> None:
        if self.begun is False or turn != self.turn:
            self._enter(turn)
        if key is not None:
            self.late.add(key)

    def _enter(self, turn: object) -> None:
        self.begun, self.turn, self.key = True, turn, None
        self.late.clear()

    def row(self, turn: object, role: str, text: bytes, key: bytes, fault: int) -> None:
        if self.begun is False or turn != self.turn:
            self._enter(turn)
        if turn is not None and (self.first is None or turn != self.last):
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if fault != BLANK and (key in self.late or key == self.key):
            fault = DUPLICATE
        self.key = key
        self.counts[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.search.push((turn, role, text, fault), initial, fault)

    def _edit(self, edit: str, row: tuple | None) -> None:
        role = b""
        if edit == "K":
            role, self.state = row[1].encode(), _taken(self.state, row[1][:1])
        elif edit != "D":
            role, self.state = ROLE[self.state].encode(), NEXT[self.state]
        self.sink(edit, row, role)

    @property
    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.turns


def _ending(text: Column) -> Column:
    """CLEAN, BLANK or CUT by the last character that isn't white space."""
    last = F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1)
    return F.when(last == "", BLANK).when(last.isin(".", "!", "?"), CLEAN).otherwise(CUT)


def _in_order(rows: DataFrame, ident: str, turn: str, role: str, text: str, ids: DataFrame | None) -> DataFrame:
    """Rows dealt by conversation and sorted; before a turn's rows stand marks of the texts that an earlier turn has said."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(ident).alias("conv"), F.col(turn).cast("long").alias("turn"), plain(role).alias("role"), plain(text).alias("text"))
    key = F.unhex(F.sha1(F.concat_ws(":", F.octet_length("role"), "role", "text").cast("binary")))
    rows = rows.withColumn("key", key)
    # repeated texts: pre-aggregated, and dealt to parts by their turns, as one text may be said any number of times
    said = rows.select(F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")).alias("name"), "conv", "key", F.struct(F.col("turn").isNotNull().alias("known"), "turn").alias("at")).distinct()
    first = said.groupBy("name", "key").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select("name", "key", "first", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    again = said.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int")).join(first, ["name", "key", "salt"]).where("at > first")
    none = F.lit(None)
    marks = again.select("conv", F.col("at.turn").alias("turn"), F.lit(0).alias("mark"), none.cast("string").alias("role"), none.cast("binary").alias("text"), "key", F.lit(0).alias("fault"))
    dealt = rows.select("conv", "turn", F.lit(1).alias("mark"), "role", F.col("text").cast("binary").alias("text"), "key", _ending(F.col("text")).alias("fault")).unionByName(marks)
    if ids is not None:
        named = ids.select(F.col(ident).alias("conv")).distinct()
        dealt = dealt.unionByName(named.select("conv", none.cast("long").alias("turn"), F.lit(0).alias("mark"), none.cast("string").alias("role"), none.cast("binary").alias("text"), none.cast("binary").alias("key"), F.lit(0).alias("fault")))
    up = lambda c: F.col(c).asc_nulls_first()
    return dealt.repartition("conv").sortWithinPartitions(up("conv"), up("turn"), "mark", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch], begin: Callable[[object], Conversation], end: Callable[[Conversation], None]) -> Iterator[None]:
    """Feeds sorted rows to one conversation after another; yields after every row."""
    at = None
    for batch in batches:
        for ident, turn, mark, role, text, key, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if at is None or ident != at.ident:
                if at is not None:
                    end(at)
                at = begin(ident)
            if mark:
                at.row(turn, role, text, key, fault)
            else:
                at.announce(turn, key)
            yield
    if at is not None:
        end(at)
        yield


def _flushed(out: list[list], schema: pa.Schema) -> pa.RecordBatch:
    made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
    for c in out:
        c.clear()
    return made


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def repair(rows: DataFrame, ident: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The edits, in order, that repair each conversation: ``(ident, seq, edit, turn, role, text, fault)``.

    edit is K(eep), R(erole), D(elete) or I(nsert); role and text are those
    after the edit (of a deleted row: its own), so rows other than D are the repaired conversation. Rows stand
    by turn (nulls first), then role and text. Null roles and texts are one space, a null ident is a conversation of its own;
    an empty table gives no rows. A text said before by the same role counts as a duplicate, however long ago.
    """
    ordered = _in_order(rows, ident, turn, role, text, None)
    kind = rows.schema[ident].dataType
    schema = pa.schema([(ident, _arrow(kind)), ("seq", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string())])
    spark_schema = T.StructType([T.StructField(ident, kind), *T._parse_datatype_string("seq long, edit string, turn long, role string, text string, fault string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in schema]
        held = 0

        def begin(name: object) -> Conversation:
            seq = 0

            def sink(edit: str, row: tuple | None, given: bytes) -> None:
                nonlocal seq, held
                seq += 1
                at, own, said, fault = row or (None, "", b"", CLEAN)
                held += len(said)
                for c, v in zip(out, (name, seq, edit, at, given.decode() or own, said.decode(), FAULTS[fault] or None), strict=True):
                    c.append(v)

            return Conversation(name, sink)

        for _ in _conversations(batches, begin, lambda c: c.search.close()):
            if len(out[0]) >= 4096 or held >= 16 << 20:
                yield _flushed(out, schema)
                held = 0
        if out[0]:
            yield _flushed(out, schema)

    return ordered.mapInArrow(run, spark_schema)


def audit(rows: DataFrame, ids: DataFrame | None = None, ident: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: ``ident, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of the edits that repair() gives.

    The repaired text is hashed as its edits become certain, and not kept.
    With ids, every conversation named there has a row, those without rows zeros, an empty audit and the hash of the empty string.
    """
    ordered = _in_order(rows, ident, turn, role, text, ids)
    kind = rows.schema[ident].dataType
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([(ident, _arrow(kind)), *[(n, pa.int64()) for n in names], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    spark_schema = T.StructType([T.StructField(ident, kind), *[T.StructField(n, T.LongType()) for n in names], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in schema]

        def begin(name: object) -> Conversation:
            sha, edits, lines = hashlib.sha256(), [], 0

            def sink(edit: str, row: tuple | None, given: bytes) -> None:
                nonlocal lines
                edits.append(edit)
                if edit != "D":
                    sha.update(b"\n" + given if lines else given)
                    sha.update(b":")
                    if row is not None:
                        sha.update(row[2])
                    lines += 1

            made = Conversation(name, sink)
            made.result = lambda: ("".join(edits), sha.hexdigest())
            return made

        def end(c: Conversation) -> None:
            cost = c.search.close()
            for column, v in zip(out, (c.ident, c.gaps, *c.counts[1:], c.illegal, cost, *c.result()), strict=True):
                column.append(v)

        for _ in _conversations(batches, begin, end):
            if len(out[0]) >= 1024:
                yield _flushed(out, schema)
        if out[0]:
            yield _flushed(out, schema)

    return ordered.mapInArrow(run, spark_schema)


def damaged(rows: DataFrame, ident: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults, by crc32("ident:turn") % 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 gives it to the user. Nulls are one space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(plain(ident), F.lit(":"), plain(turn)).cast("binary")) % 20
    rows = rows.select(ident, turn, plain(role).alias(role), plain(text).alias(text), code.alias("_code")).where("_code <> 0")
    said = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("_code") == 3, 2).otherwise(1)))
    return rows.select(ident, turn, F.when(F.col("_code") == 4, "user").otherwise(F.col(role)).alias(role), said.alias(text), times.alias("_time")).drop("_time")


def _step_sql() -> str:
    """For each state after a row, the list of ways there, by the costs above, as structs (cost, audit, repaired)."""
    way = lambda state, cost, edits, roles, when: (
        f"CASE WHEN {when} AND s{state}.c IS NOT NULL THEN {{'c': s{state}.c + {cost}, 'a': s{state}.a || '{edits}', 'r': s{state}.r"
        + "".join((" || chr(10)" if i else f" || CASE WHEN s{state}.r = '' THEN '' ELSE chr(10) END") + f" || {x}" for i, x in enumerate(roles))
        + "} END"
    )
    out = []
    for to in range(4):
        ways = [way(to, DELETE, "D", [], "TRUE")]
        for state in range(4):
            for before, at in (([], state), ([f"'{ROLE[state]}:'"], NEXT[state])):
                cost = f"{INSERT * len(before)} + extra"
                initials = [i for i in "sua" if _taken(at, i) == to and not (i == "s" and before)]
                edits = "I" * len(before)
                if initials:
                    ways.append(way(state, cost, edits + "K", [*before, "role || ':' || text"], f"fault NOT IN (1, 2) AND role[1] IN ({', '.join(map(repr, initials))})"))
                if NEXT[at] == to:
                    ways.append(way(state, f"{cost} + {REROLE}", edits + "R", [*before, f"'{ROLE[at]}:' || text"], "fault NOT IN (1, 2)"))
        out.append(f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1] AS s{to}")
    return ", ".join(out)


#: DuckDB's words for op11: crc32 byte by byte, then all conversations walk their rows at once, each state holding its cheapest (cost, audit, repaired).
ORACLE_SQL = f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
coded AS (SELECT n.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[CAST((xor(c, b) & 255) + 1 AS INT)])), 4294967295) % 20 AS code FROM named n, crc),
told AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS k FROM coded WHERE code <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, k) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, k) AS seen, right(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+$', ''), 1) AS ending FROM told),
faulty AS (SELECT *, CASE WHEN ending = '' THEN 1 WHEN seen > 1 THEN 2 WHEN ending NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] AS pair FROM placed),
rows AS (SELECT *, CASE WHEN fault = 3 THEN {TRUNCATED} ELSE 0 END AS extra FROM faulty),
ids AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS n, {{'c': 0, 'a': '', 'r': ''}} AS s0, CAST(NULL AS STRUCT(c INT, a VARCHAR, r VARCHAR)) AS s1, CAST(NULL AS STRUCT(c INT, a VARCHAR, r VARCHAR)) AS s2, CAST(NULL AS STRUCT(c INT, a VARCHAR, r VARCHAR)) AS s3 FROM ids
    UNION ALL
    SELECT w.conv_id, r.n, {_step_sql()} FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1),
ends AS (SELECT conv_id, n, list_sort(list_filter([s0, s3,
    CASE WHEN s2.c IS NOT NULL THEN {{'c': s2.c + {INSERT}, 'a': s2.a || 'I', 'r': s2.r || chr(10) || 'assistant:'}} END,
    CASE WHEN s1.c IS NOT NULL THEN {{'c': s1.c + {2 * INSERT}, 'a': s1.a || 'II', 'r': s1.r || chr(10) || 'user:' || chr(10) || 'assistant:'}} END], lambda x: x.c IS NOT NULL))[1] AS best FROM walk),
counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(best.r) AS repaired_sha256
FROM ids i LEFT JOIN counted c ON i.conv_id IS NOT DISTINCT FROM c.conv_id JOIN ends e ON e.conv_id IS NOT DISTINCT FROM i.conv_id AND e.n = coalesce(c.n, 0)"""
