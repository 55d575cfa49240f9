"""Repair of damaged conversations by a Viterbi search whose chunks run in parallel until their cost vectors agree but for a constant.

The roles of a whole conversation are `(s?(ua)+)?` by initials. Edits of a row: Keep (0), Rerole to user or assistant (2), Delete (3, required for blank
and duplicate rows); Insert an empty user or assistant turn anywhere (2); a truncated row that stays adds 1. The initials so far are one of four states
(nothing, system, user, assistant), so each row maps the costs-to-go behind it to those before it by a min-plus matrix.

A conversation is cut into chunks of CHUNK rows. All start at once from a speculative vector at their right edge (that of a conversation's end); then each takes the vector
that its right neighbour reached. If that differs from the one it used by a constant only, the chunk stands; else it reruns, and stops where its vectors are
the old ones but for a constant. Passes end when no chunk has changed: after k passes the last k chunks are final, so they do end. The chunks' maps of states then
compose (by doubling) to the state in which each is entered, and every chunk traces, with its stitched costs, the ASCII-least of the cheapest edits.

Places of rows in a conversation come from a range partitioning, so a hot conversation is spread over tasks; its audit and its hash are one value, which one task streams row by row.

Defined cases: null role or text is one space (so a null text is blank, a null role no legal initial), and in the damage key a null is one space too; a null turn comes first and counts for no
gap; a null conv_id is a conversation; rows of equal turns go by role, then text; repeated rows are duplicates; conversations without rows after damage have zeros, an
empty audit and the hash of the empty string; very long texts are hashed whole; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, stored

#: Rows of a chunk.
CHUNK = 256
#: Signs of a text by which rows are dealt to ranges.
PREFIX = 200
SPACES = "\t\n\x0b\x0c\r "
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1

# ---- the costs of one conversation ---------------------------------------------------------------------

#: States: nothing yet, after the system turn, after a user's, after an assistant's. What comes next in each, and where it leads.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = "uuau"
AFTER = (USER, USER, ASSISTANT, USER)
FAR = 1 << 40


def _closed(v: list[int]) -> tuple[int, ...]:
    """Costs with insertions before the row."""
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return (min(v[NONE], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant)


def _based(v: tuple[int, ...]) -> tuple[int, ...]:
    low = min(v)
    return tuple(x - low for x in v)


END = _closed([0, FAR, FAR, 0])


def _kept(kind: str, state: int) -> int | None:
    """The state after keeping a row of a kind (its initial, upper case if truncated, '-' if it has to go)."""
    role = kind.lower()
    if role == "s" and state == NONE:
        return SYSTEM
    return AFTER[state] if role == NEXT[state] else None


@lru_cache(maxsize=1 << 16)
def step(kind: str, v: tuple[int, ...]) -> tuple[int, ...]:
    """Costs-to-go before a row of those behind it."""
    out, cut = [], CUT * kind.isupper()
    for state in range(4):
        cost = DELETE + v[state]
        if kind != "-":
            cost = min(cost, REROLE + cut + v[AFTER[state]])
            to = _kept(kind, state)
            if to is not None:
                cost = min(cost, KEEP + cut + v[to])
        out.append(cost)
    return _closed(out)


def left_edge(kinds: str, right: tuple[int, ...]) -> tuple[int, ...]:
    """The vector at the left edge of a chunk, its least entry 0."""
    v = right
    for kind in reversed(kinds):
        v = _based(step(kind, v))
    return v


def rerun(kinds: str, old: tuple[int, ...], new: tuple[int, ...], edge: tuple[int, ...]) -> tuple[int, ...]:
    """The left edge for another right edge: as soon as the vectors are the old ones but for a constant, the old left edge stands."""
    for kind in reversed(kinds):
        if old == new:
            return edge
        old, new = _based(step(kind, old)), _based(step(kind, new))
    return new


@lru_cache(maxsize=1 << 12)
def trace(kinds: str, right: tuple[int, ...], state: int, last: bool) -> tuple[tuple[tuple[str, str, str], ...], int, int]:
    """The ASCII-least of the cheapest edits from a state on: (roles inserted before, edit, new role) of each row, the cost, the state at the end.

    The last chunk has one more entry: what is inserted after the last row.
    """
    costs = [right]
    for kind in reversed(kinds):
        costs.append(step(kind, costs[-1]))
    costs.reverse()
    edits, spent = [], 0
    for i, kind in enumerate(kinds):
        inserted = ""
        while True:
            left, behind, cut = costs[i][state], costs[i + 1], CUT * kind.isupper()
            if DELETE + behind[state] == left:
                edits.append((inserted, "D", ""))
                spent += DELETE
                break
            if INSERT + costs[i][AFTER[state]] == left:
                inserted += NEXT[state]
                spent, state = spent + INSERT, AFTER[state]
                continue
            to = _kept(kind, state)
            if to is not None and KEEP + cut + behind[to] == left:
                edits.append((inserted, "K", ""))
                spent, state = spent + KEEP + cut, to
            else:
                edits.append((inserted, "R", NEXT[state]))
                spent, state = spent + REROLE + cut, AFTER[state]
            break
    if last:
        inserted = ""
        while state not in (NONE, ASSISTANT):
            inserted += NEXT[state]
            spent, state = spent + INSERT, AFTER[state]
        edits.append((inserted, "", ""))
    return tuple(edits), spent, state


# ---- the jobs ------------------------------------------------------------------------------------------


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults planted by crc32 of `conv_id:turn`."""
    said = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = turns.select(turns["conv_id"].alias("conv_id"), turns["turn"].cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), lot.alias("lot"))
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("lot") == 3, 2).otherwise(1))
    return rows.filter("lot <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the place of each row in its conversation, from 0; stored.

    Rows of one key are split over ranges where they are the same (their order does not matter).
    """
    own = turns.select(
        turns["conv_id"].alias("conv_id"), turns["turn"].cast("long").alias("turn"), F.coalesce(turns["role"].cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(turns["text"].cast("string"), F.lit(" ")).alias("text"), F.xxhash64(F.monotonically_increasing_id()).alias("lot"),
    )
    keys = ["conv_id", "turn", "role", F.substring("text", 1, PREFIX), F.when(F.length("text") <= PREFIX, F.col("lot"))]
    own = stored(own.repartitionByRange(*keys).withColumn("task", F.spark_partition_id()).drop("lot"), "turns")
    within = F.row_number().over(Window.partitionBy("task", "conv_id").orderBy("turn", "role", "text")).cast("long")
    tasks = own.groupBy(F.col("task").alias("t"), F.col("conv_id").alias("c")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("c").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("t", "c", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    both = own.withColumn("nth", within).join(tasks, (F.col("task") == F.col("t")) & F.col("conv_id").eqNullSafe(F.col("c")))
    return stored(both.select("conv_id", "turn", "role", "text", (F.col("nth") - 1 + F.col("before")).alias("place")), "placed")


def faults(rows: DataFrame) -> DataFrame:
    """Of placed rows conv_id, place, turn, role and each row's first fault: blank, duplicate, truncated or none."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    marks = rows.select(
        "conv_id", "place", "turn", "role", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256).alias("same"),
        (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    first = marks.groupBy(F.col("conv_id").alias("c"), F.col("same").alias("s")).agg(F.min("place").alias("first"))
    met = marks.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")))
    fault = F.when(F.col("blank"), "blank").when(F.col("first") < F.col("place"), "duplicate").when(F.col("cut"), "truncated")
    return met.select("conv_id", "place", "turn", "role", fault.alias("fault"))


def _kind() -> Column:
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)


def _vectors(f, kinds: str):
    """mapInArrow over chunks: the columns that f gives for a row, next to those that are there."""
    names = [c.split()[0] for c in kinds.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [f(r) for r in batch.to_pylist()]
            made = pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema([(c.split()[0], {"array<long>": pa.list_(pa.int64()), "int": pa.int32(), "long": pa.int64()}.get(c.split(" ", 1)[1], _EDITS)) for c in kinds.split(", ")]))
            for part in made.to_batches():
                yield pa.RecordBatch.from_arrays([*batch.columns, *part.columns], [*batch.schema.names, *names])

    return run


_EDITS = pa.list_(pa.struct([("inserted", pa.string()), ("edit", pa.string()), ("role", pa.string())]))
_EDIT_TYPE = "array<struct<inserted:string,edit:string,role:string>>"


def _mapped(df: DataFrame, f, kinds: str) -> DataFrame:
    schema = ", ".join([f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema] + [kinds.replace("edits", f"edits {_EDIT_TYPE}")])
    return df.mapInArrow(_vectors(f, kinds.replace("edits", "edits edits")), schema)


def _neighbour(df: DataFrame, columns: dict[str, str], by: int) -> DataFrame:
    """df with columns of the chunk that lies `by` chunks further on (null where there is none)."""
    other = df.select(F.col("conv_id").alias("c"), (F.col("chunk") - by).alias("k"), *[F.col(a).alias(b) for a, b in columns.items()])
    return df.join(other, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")), "left").drop("c", "k")


def settled(chunks: DataFrame) -> DataFrame:
    """chunks(conv_id, chunk, last, kinds) of conversations of several chunks -> with the vector of their right edge (``right``), final."""
    now = stored(_mapped(chunks.withColumn("right", F.array(*[F.lit(x).cast("long") for x in END])), lambda r: (left_edge(r["kinds"], tuple(r["right"])),), "left array<long>"), "speculated")
    while True:
        met = _neighbour(now, {"left": "wanted"}, 1).withColumn("wanted", F.coalesce("wanted", "right"))
        again = lambda r: (rerun(r["kinds"], tuple(r["right"]), tuple(r["wanted"]), tuple(r["left"])),)
        then = stored(_mapped(met, again, "fixed array<long>").select("conv_id", "chunk", "last", "kinds", F.col("wanted").alias("right"), F.col("fixed").alias("left"), (F.col("right") != F.col("wanted")).alias("changed")), "fixed")
        free(now)
        now = then.drop("changed")
        now.stored_at = then.stored_at
        if then.filter("changed").isEmpty():
            return now


def entered(chunks: DataFrame) -> DataFrame:
    """Chunks with their right edges -> with the state in which each is entered (``entry``): the maps of the chunks before, composed by doubling."""
    maps = _mapped(chunks, lambda r: ([trace(r["kinds"], tuple(r["right"]), state, False)[2] for state in range(4)],), "map array<long>")
    now, reach = stored(maps, "maps"), 1
    longest = now.agg(F.max("chunk")).first()[0] or 0
    while reach <= longest:
        met = _neighbour(now, {"map": "before"}, -reach)
        then = stored(met.withColumn("map", F.when(F.col("before").isNull(), F.col("map")).otherwise(F.transform("before", lambda s: F.element_at("map", (s + 1).cast("int"))))).drop("before"), "maps")
        free(now)
        now, reach = then, 2 * reach
    met = _neighbour(now, {"map": "before"}, -1)
    return met.withColumn("entry", F.coalesce(F.element_at("before", 1), F.lit(NONE)).cast("int")).drop("map", "before", "left")


def traced(rows: DataFrame) -> DataFrame:
    """rows(conv_id, place, role, fault) -> the chunks of each conversation with the edits of their rows and their cost."""
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "kind"))), lambda x: x["kind"]), "").alias("kinds")
    chunks = rows.withColumn("kind", _kind()).groupBy("conv_id", F.floor(F.col("place") / CHUNK).cast("long").alias("chunk")).agg(kinds)
    sizes = chunks.groupBy(F.col("conv_id").alias("c")).agg(F.max("chunk").alias("top"))
    chunks = stored(chunks.join(sizes, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "chunk", (F.col("chunk") == F.col("top")).alias("last"), "kinds", "top"), "chunks")
    start = F.array(*[F.lit(x).cast("long") for x in END])
    whole = chunks.filter("top = 0").select("conv_id", "chunk", "last", "kinds", start.alias("right"), F.lit(NONE).alias("entry"))
    several = chunks.filter("top > 0").drop("top")
    if not several.isEmpty():
        whole = whole.unionByName(entered(settled(several)).select(*whole.columns))
    edits = lambda r: (lambda t: ([dict(zip(("inserted", "edit", "role"), e)) for e in t[0]], t[1]))(trace(r["kinds"], tuple(r["right"]), r["entry"], r["last"]))
    return _mapped(whole, edits, "edits, cost long").select("conv_id", "chunk", "last", F.length("kinds").alias("n"), "edits", "cost")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns(conv_id, turn, role, text) -> (rows, chunks).

    rows: conv_id, place, turn, role, text, fault, edit (K, R or D; empty for what follows the last row), inserted (initials of the roles that are inserted
    before), repaired_role (null for what goes), cost (on the first row of a chunk, that of the chunk).
    """
    own = placed(turns)
    marks = stored(faults(own), "faults")
    chunks = stored(traced(marks), "traced")
    at = marks.select(F.col("conv_id").alias("c"), F.col("place").alias("p"), "fault")
    rows = own.join(at, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p"))).drop("c", "p")
    keyed = rows.withColumn("chunk", F.floor(F.col("place") / CHUNK).cast("long"))
    told = chunks.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "edits", F.col("cost").alias("chunk_cost"))
    met = keyed.join(told, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))).withColumn("e", F.get("edits", (F.col("place") % CHUNK).cast("int")))
    role = F.when(F.col("e.edit") == "K", F.col("role")).when(F.col("e.role") == "u", "user").when(F.col("e.role") == "a", "assistant")
    cost = F.when(F.col("place") % CHUNK == 0, F.col("chunk_cost")).otherwise(F.lit(0))
    done = met.select("conv_id", "place", "turn", "role", "text", "fault", "e.edit", "e.inserted", role.alias("repaired_role"), cost.alias("cost"))
    tail = chunks.filter("last").withColumn("e", F.element_at("edits", -1)).filter("e.inserted <> ''")
    nothing = lambda kind: F.lit(None).cast(kind)
    tail = tail.select(
        "conv_id", (F.col("chunk") * CHUNK + F.col("n")).alias("place"), nothing("long").alias("turn"), nothing("string").alias("role"), nothing("string").alias("text"), nothing("string").alias("fault"),
        "e.edit", "e.inserted", nothing("string").alias("repaired_role"), F.lit(0).cast("long").alias("cost"),
    )
    return done.unionByName(tail), chunks


def repaired(rows: DataFrame) -> DataFrame:
    """The rows of `repair` -> the repaired turns: conv_id, place, nth (of those at one place), role, text."""
    name = lambda x: F.when(x == "u", "user").otherwise("assistant")
    new = F.transform(F.filter(F.split("inserted", ""), lambda x: x != ""), lambda x: F.struct(name(x).alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("repaired_role").isNotNull(), F.array(F.struct(F.col("repaired_role").alias("role"), "text"))).otherwise(F.array())
    return rows.select("conv_id", "place", F.posexplode(F.concat(new, own)).alias("nth", "t")).select("conv_id", "place", "nth", "t.role", "t.text")


_REPORT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Report:
    """What one conversation's rows, in order, amount to."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.first, self.last, self.faults = conv_id, 0, None, None, dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.before, self.illegal, self.cost, self.audit, self.lines, self.sha = None, 0, 0, [], 0, hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) * (self.lines > 0)}{role}:{text}".encode())
        self.lines += 1

    def add(self, turn, role, text, fault, edit, inserted, repaired_role, cost) -> None:
        if role is not None:
            if turn is not None and turn != self.last:
                self.turns, self.first, self.last = self.turns + 1, turn if self.first is None else self.first, turn
            self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
            self.before = role[:1]
        if fault:
            self.faults[fault] += 1
        self.cost += cost
        self.audit.append("I" * len(inserted) + edit)
        for initial in inserted:
            self.line("user" if initial == "u" else "assistant", "")
        if repaired_role is not None:
            self.line(repaired_role, text)

    def row(self) -> dict:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, **self.faults, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def report(rows: DataFrame) -> DataFrame:
    """The rows of `repair`, one conversation after another and in order -> one row per conversation."""
    kinds = _REPORT.format(rows.schema["conv_id"].dataType.simpleString())

    def run(batches):
        now = None
        for batch in batches:
            out, columns = [], [batch[c].to_pylist() for c in ("turn", "role", "text", "fault", "edit", "inserted", "repaired_role", "cost")]
            for conv_id, *row in zip(batch["conv_id"].to_pylist(), *columns):
                if now is None or now.conv_id != conv_id:
                    out += [now.row()] if now else []
                    now = _Report(conv_id)
                now.add(*row)
            yield from pa.Table.from_pylist(out, schema=made(batch)).to_batches()
        if now:
            yield from pa.Table.from_pylist([now.row()], schema=made(batch)).to_batches()

    def made(batch):
        return pa.schema([("conv_id", batch["conv_id"].type), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.select("conv_id", "turn", "role", "text", "fault", "edit", "inserted", "repaired_role", "cost").mapInArrow(run, kinds)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows, _ = repair(damage(turns))
    told = report(rows).withColumnRenamed("conv_id", "c")
    every = turns.select("conv_id").distinct().join(told, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    empty = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return every.select("conv_id", *[F.coalesce(c, value).alias(c) for c, value in empty.items()])


def _oracle() -> str:
    """A forward search: the cheapest (cost, audit, text) of each state, row after row; ties go to the least audit."""
    far = "{'c': 1000000000, 'a': '', 'r': ''}"

    def add(v: str, cost: str, letter: str, line: str = "") -> str:
        text = f"{v}.r || {line}" if line else f"{v}.r"
        return f"{{'c': {v}.c + {cost}, 'a': {v}.a || '{letter}', 'r': {text}}}"

    def row(letter: str, to: str) -> str:
        """What reaches state `to`, before insertions."""
        ways = [add(f"s.{to}", "3", "D")]
        stays = lambda test, way: f"CASE WHEN NOT o.must AND {test} THEN {way} ELSE {far} END"
        own, cut = "chr(10) || o.role || ':' || o.text", "o.cut"
        for state, initial in {"y": [], "u": [("e", "u"), ("y", "u"), ("a", "u")], "a": [("u", "a")], "e": []}[to]:
            name = {"u": "user", "a": "assistant"}[initial]
            ways.append(stays(f"o.i = '{initial}'", add(f"s.{state}", f"{cut}", "K", own)))
            ways.append(stays("true", add(f"s.{state}", f"2 + {cut}", "R", f"chr(10) || '{name}:' || o.text")))
        if to == "y":
            ways.append(stays("o.i = 's'", add("s.e", cut, "K", own)))
        return f"least({', '.join(ways)})"

    new = {"u": "chr(10) || 'user:'", "a": "chr(10) || 'assistant:'"}
    # two rounds of insertions
    rounds = []
    for a, b in (("b0", "b1"), ("b1", "b2")):
        rounds.append(f"""{b} AS (SELECT conv, n, e, y, least(u, {add('e', '2', 'I', new['u'])}, {add('y', '2', 'I', new['u'])}, {add('a', '2', 'I', new['u'])}) AS u,
          least(a, {add('u', '2', 'I', new['a'])}) AS a FROM {a})""")
    closed = ", ".join(rounds)
    return rf"""
WITH RECURSIVE poly AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
l AS (
  SELECT k.*, xor(list_reduce(list_prepend(4294967295, [ord(x)::BIGINT FOR x IN string_split(key, '')]),
    lambda c, x: xor(c >> 8, t[(xor(c & 255, x)) + 1])), 4294967295) % 20 AS lot FROM k, poly),
d AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM l, range(2) c(copy) WHERE lot <> 0 AND (copy = 0 OR lot = 3)),
ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
p AS (SELECT ids.conv, d.*, row_number() OVER (PARTITION BY ids.conv ORDER BY turn NULLS FIRST, role, text) AS place FROM d JOIN ids ON d.conv_id IS NOT DISTINCT FROM ids.conv_id),
o AS (
  SELECT conv, place, turn, role, text, role[1] AS i, lag(role[1]) OVER (PARTITION BY conv ORDER BY place) AS before,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY place) > 1 AS seen,
    NOT blank AND NOT seen AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS truncated, blank OR seen AS must, truncated::INTEGER AS cut FROM p),
w AS (
  SELECT conv, 0::BIGINT AS n, {{'c': 0, 'a': '', 'r': ''}} AS e, {far} AS y, {{'c': 2, 'a': 'I', 'r': chr(10) || 'user:'}} AS u,
    {{'c': 4, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS a FROM ids
  UNION ALL
  SELECT * FROM (WITH b0 AS (SELECT s.conv, s.n + 1 AS n, {row('', 'e')} AS e, {row('', 'y')} AS y, {row('', 'u')} AS u, {row('', 'a')} AS a FROM w s JOIN o ON o.conv = s.conv AND o.place = s.n + 1),
    {closed} SELECT conv, n, e, y, u, a FROM b2)),
z AS (SELECT conv, least(arg_max(e, n), arg_max(a, n)) AS best FROM w GROUP BY conv),
t AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY conv)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(substr(best.r, 2)) AS repaired_sha256
FROM ids JOIN z ON ids.conv = z.conv LEFT JOIN t ON ids.conv = t.conv"""


ORACLE = _oracle()
