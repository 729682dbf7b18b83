"""Conversation structure repair: the cheapest edits that make roles alternate.

A repaired conversation is empty or has role initials s?(ua)+. Each row is kept, reroled or
deleted, and empty rows may be inserted anywhere; blank and repeated rows must go. What is
still to pay from a row on depends only on the state before it (start, or the last initial),
so a dynamic program runs backwards over vectors of four costs. It stores them at
checkpoints a square root of the rows apart and, walking forward, recomputes one block at a
time; of the edits that are tight there, it takes the ASCII-least. That gives the least
audit, as two audits of one conversation are never prefixes of each other.

Conversations of bounded rows and bytes are sorted and repaired whole, within a partition.
Larger ones are range-partitioned by their order into pieces: a piece is summed up as a
min-plus matrix of costs from state to state, a scan over pieces gives each the cost vector
behind it, then the state that it starts in, and all pieces are walked at once. Only the
SHA-256 of a repaired text, a chain by nature, passes its bytes through one task, as a
stream.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, prepare, small, stage, table

#: Rows and bytes of a conversation that is repaired whole, and rows of a larger one's piece.
WHOLE_ROWS, WHOLE_BYTES, PIECE_ROWS = 50_000, 32 << 20, 50_000
#: Bytes of repaired text that a row carries to the digest.
CHUNK_BYTES = 1 << 20
RETYPE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: A row's faults.
GOOD, BLANK, DUPLICATE, TRUNCATED, ABSENT = range(5)
#: States: nothing yet, after s, after u, after a. By state: the role that an insertion or a new role has, and where it leads.
ROLE = ("user", "user", "assistant", "user")
LEADS = (2, 2, 3, 2)
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEVER = 1 << 60
#: What is to pay by state when no row is left.
AT_END = (0, 6, 3, 0)
WHITE = " \t\n\x0b\f\r"

Row = tuple[str, int]  # a role's initial and the fault
Costs = tuple[int, int, int, int]


def before(row: Row, after: Costs) -> Costs:
    """The costs to go before a row, insertions in front of it included, from those behind it."""
    initial, fault = row
    own = [c + DELETE for c in after]
    if fault in (GOOD, TRUNCATED):
        extra = CUT if fault == TRUNCATED else 0
        for q in range(4):
            own[q] = min(own[q], after[LEADS[q]] + RETYPE + extra, after[KEEP[q][initial]] + extra if initial in KEEP[q] else NEVER)
    u, a = min(own[2], own[3] + INSERT), min(own[3], own[2] + INSERT)
    return min(own[0], u + INSERT), min(own[1], u + INSERT), u, a


def costs(rows: list[Row], end: Costs = AT_END) -> Costs:
    for row in reversed(rows):
        end = before(row, end)
    return end


def walk(rows: list[Row], start: int = 0, end: Costs = AT_END, last: bool = True) -> Iterator[tuple[str, int, int]]:
    """(edit, row, state behind) of the ASCII-least tight edits; row is -1 for an insertion.

    end holds the costs behind the rows; with last, nothing comes behind and insertions at
    the end are walked too.
    """
    size = math.isqrt(len(rows)) + 1
    checkpoints, now = {}, end
    for i in range(len(rows), 0, -1):
        if i % size == 0 or i == len(rows):
            checkpoints[i] = now
        now = before(rows[i - 1], now)
    state = start
    for first in range(0, len(rows), size):
        behind = min(first + size, len(rows))
        block = [checkpoints[behind]]
        for i in range(behind - 1, first - 1, -1):
            block.append(before(rows[i], block[-1]))
        for i in range(first, behind):
            here, after = block[behind - i], block[behind - i - 1]
            initial, fault = rows[i]
            extra = CUT if fault == TRUNCATED else 0
            while True:
                if here[state] == after[state] + DELETE:
                    yield "D", i, state
                elif here[state] == here[LEADS[state]] + INSERT:
                    state = LEADS[state]
                    yield "I", -1, state
                    continue
                elif initial in KEEP[state] and here[state] == after[KEEP[state][initial]] + extra:
                    state = KEEP[state][initial]
                    yield "K", i, state
                else:
                    state = LEADS[state]
                    yield "R", i, state
                break
    while last and state not in (0, 3):
        state = LEADS[state]
        yield "I", -1, state


def lines(rows: list[Row], said: list[tuple[str, str]], start: int = 0, end: Costs = AT_END, last: bool = True) -> Iterator[tuple[str, str | None]]:
    """(edit, repaired line) of a walk; a deleted row has no line."""
    for edit, i, state in walk(rows, start, end, last):
        new = "assistant" if state == 3 else "user"
        if edit == "D":
            yield edit, None
        elif edit == "I":
            yield edit, f"{new}:"
        else:
            role, text = said[i]
            yield edit, f"{role if edit == 'K' else new}:{text}"


def gaps(least: int | None, most: int | None, distinct: int) -> int:
    """Turns missing between the least and the most; as a long, so it may wrap."""
    return 0 if least is None else (most - least + 1 - distinct + (1 << 63)) % (1 << 64) - (1 << 63)


def illegal(initials: Iterable[str]) -> int:
    out, last = 0, None
    for x in initials:
        out += last is not None and last + x not in ("su", "ua", "au")
        last = x
    return out


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """turns(conv, turn, role, text, there) with planted damage, by crc32("conv:turn") % 20; nulls count as one space.

    0 drops the row (there is false), 1 empties its text, 2 takes its sentence ends, 3
    repeats it, 4 makes it the user's.
    """
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    role, text = spoken(role_col), spoken(text_col)
    kind = F.crc32(F.concat(spoken(conv_col), F.lit(":"), spoken(turn_col)).cast("binary")) % 20
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind != 0).alias("there"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def _fault(text: Column, there: Column) -> Column:
    """Faults that a row shows by itself."""
    kept = F.rtrim(text, F.lit(WHITE))
    alone = F.when(F.length(kept) == 0, BLANK).when(~F.right(kept, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(GOOD)
    return F.when(~there, ABSENT).otherwise(alone)


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = ", ".join(f"{n} long" for n in NUMBERS) + ", audit string, repaired_sha256 string"


def repair(turns: DataFrame, conv_col: str = "conv", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", there_col: str | None = None) -> DataFrame:
    """Per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn (nulls first), those of a turn by role, then by the SHA-256 of
    their text, so that repeated rows stand together. A null role or text is one space; a
    role without an initial is never kept. Rows
    for which there_col is false name their conversation and are otherwise not there; one
    without rows has zeros, an empty audit and the empty string's digest. A null
    conversation id is a conversation of its own. Empty tables give no rows; other columns
    are ignored, whatever their names. Texts are read whole.
    """
    prepare(turns.sparkSession)
    rows = _prepared(turns, conv_col, turn_col, role_col, text_col, there_col)
    held = rows.groupBy("conv").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("held"))
    large = stage(held.where((F.col("rows") > WHOLE_ROWS) | (F.col("held") > WHOLE_BYTES)).select("conv", "rows"), "repair-large")
    many = large.agg(F.sum("rows")).first()[0]
    if many is None:
        discard(large)
        return _whole(rows, conv_col)
    of = small(large.select(F.col("conv").alias("large")))
    same = F.col("conv").eqNullSafe(F.col("large"))
    return _whole(rows.join(of, same, "left_anti"), conv_col).unionByName(_in_pieces(rows.join(of, same, "left_semi"), many, conv_col))


def _prepared(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, there_col: str | None) -> DataFrame:
    """rows(conv, turn, role, text, sha, fault): sha of the text, and the faults that a row shows by itself."""
    there = F.lit(True) if there_col is None else F.coalesce(F.col(there_col), F.lit(False))
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
        there.alias("there"),
    )
    return rows.select("conv", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("sha"), _fault(F.col("text"), F.col("there")).alias("fault"))


def _order() -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha")]


def _whole(rows: DataFrame, conv_col: str) -> DataFrame:
    """The result of conversations that are small enough for a task."""
    kind = dict(rows.dtypes)["conv"]

    def result(conv, mine: list[tuple]) -> dict:
        there = [r for r in mine if r[4] != ABSENT]
        seen, faults = set(), []
        for _, role, _, sha, fault in there:
            faults.append(DUPLICATE if fault != BLANK and (role, sha) in seen else fault)
            seen.add((role, sha))
        states = [(role[:1], f) for (_, role, *_), f in zip(there, faults, strict=True)]
        audit, text = [], []
        for edit, line in lines(states, [(r[1], r[2]) for r in there]):
            audit.append(edit)
            if line is not None:
                text.append(line)
        turns = [r[0] for r in there if r[0] is not None]
        return {
            "conv": conv,
            "gaps": gaps(min(turns, default=None), max(turns, default=None), len(set(turns))),
            **{name: faults.count(f) for name, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))},
            "illegal": illegal(s for s, _ in states),
            "cost": costs(states)[0],
            "audit": "".join(audit),
            "repaired_sha256": hashlib.sha256("\n".join(text).encode()).hexdigest(),
        }

    def repaired(batches):
        mine, conv, schema = [], None, None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("conv", batch.schema.field("conv").type), *[(n, pa.int64()) for n in NUMBERS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            out = []
            for own, *row in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "sha", "fault")), strict=True):
                if mine and own != conv:
                    out.append(result(conv, mine))
                    mine = []
                conv = own
                mine.append(tuple(row))
            yield pa.RecordBatch.from_pylist(out, schema)
        if mine:
            yield pa.RecordBatch.from_pylist([result(conv, mine)], schema)

    placed = rows.repartition("conv").sortWithinPartitions(*_order())
    return placed.mapInArrow(repaired, f"conv {kind}, {RESULT}").withColumnRenamed("conv", conv_col)


def _in_pieces(rows: DataFrame, many: int, conv_col: str) -> DataFrame:
    """The result of large conversations, many rows in all."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)["conv"]
    parts = max(1, math.ceil(many / PIECE_ROWS))
    # identical rows can stand in any order, so that however often one is repeated, its copies spread;
    # a written table's rows are dealt the same again if a task is lost
    spread = stage(rows.where(F.col("fault") != ABSENT), "repair-dealt").withColumn("deal", F.rand(1))
    spread = spread.repartitionByRange(parts, *_order(), "deal").sortWithinPartitions(*_order(), "deal").drop("deal")
    rows_ = stage(spread.withColumn("pos", F.monotonically_increasing_id()).withColumn("piece", F.spark_partition_id()), "repair-rows")
    convs = stage(rows.select("conv").distinct(), "repair-convs")  # a row a large conversation

    key = [F.col("conv"), F.col("role"), F.col("sha")]
    firsts = rows_.where(F.col("fault") != BLANK).groupBy(*key).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = stage(firsts.select(F.struct("conv", "role", "sha").alias("of"), "first"), "repair-firsts")
    narrow = rows_.select("conv", "piece", "pos", "turn", "fault", F.left("role", F.lit(1)).alias("initial"), F.struct("conv", "role", "sha").alias("key"))
    marked = narrow.join(small(firsts), F.col("key").eqNullSafe(F.col("of")), "left")
    again = (F.col("fault") != BLANK) & (F.col("pos") > F.col("first"))
    marked = stage(marked.select("conv", "piece", "pos", "turn", "initial", F.when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault")), "repair-marked")

    def rows_of(group: pa.Table) -> list[Row]:
        return list(zip(group["initial"].to_pylist(), group["fault"].to_pylist(), strict=True))

    def summary(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        mine, turns = rows_of(group), [t for t in group["turn"].to_pylist() if t is not None]
        units = [tuple(0 if k == j else NEVER for k in range(4)) for j in range(4)]
        by_end = [costs(mine, u) for u in units]
        faults = [f for _, f in mine]
        return pa.table(
            {
                "conv": group["conv"][:1],
                "piece": group["piece"][:1],
                "matrix": pa.array([[min(by_end[j][q], NEVER) for q in range(4) for j in range(4)]], pa.list_(pa.int64())),
                "faults": pa.array([[faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)]], pa.list_(pa.int64())),
                "illegal": pa.array([illegal(s for s, _ in mine)], pa.int64()),
                "ends": pa.array([[mine[0][0], mine[-1][0]]], pa.list_(pa.string())),
                "turns": pa.array([[turns[0], turns[-1], len(set(turns))] if turns else []], pa.list_(pa.int64())),
            }
        )

    shape = f"conv {kind}, piece int, matrix array<long>, faults array<long>, illegal long, ends array<string>, turns array<long>"
    pieces = stage(marked.groupBy("conv", "piece").applyInArrow(summary, shape), "repair-pieces")

    def scan(group: pa.Table) -> pa.Table:
        """The costs behind each piece, and what the conversation has in all, in each row."""
        rows = group.sort_by("piece").to_pylist()
        behind, end = [], AT_END
        for r in reversed(rows):
            behind.append(end)
            end = tuple(min(r["matrix"][4 * q + j] + end[j] for j in range(4)) for q in range(4))
        turns, borders = [r["turns"] for r in rows if r["turns"]], [(a["ends"][1] + b["ends"][0]) for a, b in zip(rows, rows[1:], strict=False)]
        distinct = sum(t[2] for t in turns) - sum(a[1] == b[0] for a, b in zip(turns, turns[1:], strict=False))
        totals = {"gaps": gaps(turns[0][0] if turns else None, turns[-1][1] if turns else None, distinct), "illegal": sum(r["illegal"] for r in rows) + sum(b not in ("su", "ua", "au") for b in borders), "cost": end[0]}
        totals |= {n: sum(r["faults"][k] for r in rows) for k, n in enumerate(("blank", "duplicate", "truncated"))}
        out = {"conv": [r["conv"] for r in rows], "piece": [r["piece"] for r in rows], "behind": [list(b) for b in reversed(behind)], "last": [k == len(rows) - 1 for k in range(len(rows))]}
        types = {"conv": group["conv"].type, "piece": pa.int32(), "behind": pa.list_(pa.int64()), "last": pa.bool_()}
        return pa.table({c: pa.array(v, types[c]) for c, v in out.items()} | {n: pa.array([totals[n]] * len(rows), pa.int64()) for n in NUMBERS})

    numbers = ", ".join(f"{n} long" for n in NUMBERS)
    placed = stage(pieces.groupBy("conv").applyInArrow(scan, f"conv {kind}, piece int, behind array<long>, last boolean, {numbers}"), "repair-behind")

    def states(group: pa.Table, of: pa.Table) -> pa.Table:
        """Where a piece leads from each state."""
        mine, at = rows_of(group.sort_by("pos")), of.to_pylist()[0]
        leads = []
        for start in range(4):
            end = start
            for _, _, end in walk(mine, start, tuple(at["behind"]), False):
                pass
            leads.append(end)
        return pa.table({"conv": of["conv"], "piece": of["piece"], "leads": pa.array([leads], pa.list_(pa.int32()))})

    met = marked.groupBy("conv", "piece").cogroup(placed.groupBy("conv", "piece"))
    leads = met.applyInArrow(states, f"conv {kind}, piece int, leads array<int>")

    def starts(group: pa.Table) -> pa.Table:
        group, state, out = group.sort_by("piece"), 0, []
        for leads in group["leads"].to_pylist():
            out.append(state)
            state = leads[state]
        return pa.table({"conv": group["conv"], "piece": group["piece"], "start": pa.array(out, pa.int32())})

    begun = leads.groupBy("conv").applyInArrow(starts, f"conv {kind}, piece int, start int")
    begun = stage(begun.withColumnsRenamed({"conv": "c", "piece": "p"}), "repair-starts")
    ways = placed.join(begun, F.col("conv").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p"))).select("conv", "piece", "behind", "last", "start")
    said = rows_.select("conv", "piece", "pos", "role", "text").join(marked.select(F.col("pos").alias("at"), "initial", "fault"), F.col("pos") == F.col("at")).drop("at")

    def texts(group: pa.Table, of: pa.Table) -> pa.Table:
        """A piece's audit and repaired text, a line's break in front of it, in chunks."""
        group, at = group.sort_by("pos"), of.to_pylist()[0]
        audit, chunks, now, held = [], [], [], 0
        for edit, line in lines(rows_of(group), list(zip(group["role"].to_pylist(), group["text"].to_pylist(), strict=True)), at["start"], tuple(at["behind"]), at["last"]):
            audit.append(edit)
            if line is not None:
                now.append(f"\n{line}".encode())
                held += len(now[-1])
                if held >= CHUNK_BYTES:
                    chunks.append(b"".join(now))
                    now, held = [], 0
        chunks.append(b"".join(now))
        n = len(chunks)
        same = lambda c: pa.array([at[c]] * n, of[c].type)
        return pa.table({"conv": same("conv"), "piece": same("piece"), "chunk": pa.array(range(n), pa.int32()), "audit": pa.array(["".join(audit), *[""] * (n - 1)]), "bytes": pa.array(chunks, pa.binary())})

    met = said.groupBy("conv", "piece").cogroup(ways.groupBy("conv", "piece"))
    repaired = stage(met.applyInArrow(texts, f"conv {kind}, piece int, chunk int, audit string, bytes binary"), "repair-texts")

    def digest(batches):
        conv, audit, sha, begun, of = None, [], None, False, None
        for batch in batches:
            out, of = [], batch.schema.field("conv").type
            for own, letters, chunk in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "bytes")), strict=True):
                if sha is not None and own != conv:
                    out.append((conv, "".join(audit), sha.hexdigest()))
                    sha = None
                if sha is None:
                    conv, audit, sha, begun = own, [], hashlib.sha256(), False
                audit.append(letters)
                sha.update(chunk if begun else chunk[1:])
                begun = begun or bool(chunk)
            yield _digests(out, of)
        if sha is not None:
            yield _digests([(conv, "".join(audit), sha.hexdigest())], of)

    ended = repaired.repartition("conv").sortWithinPartitions("conv", "piece", "chunk").mapInArrow(digest, f"conv {kind}, audit string, repaired_sha256 string")
    totals = placed.where("last").select(F.col("conv").alias("c"), *NUMBERS)
    out = convs.join(small(ended.withColumnRenamed("conv", "d")), F.col("conv").eqNullSafe(F.col("d")), "left")
    out = out.join(small(totals), F.col("conv").eqNullSafe(F.col("c")), "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("conv").alias(conv_col), *[F.coalesce(n, F.lit(0)).alias(n) for n in NUMBERS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


def _digests(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.string(), pa.string()), strict=True)], names=["conv", "audit", "repaired_sha256"])


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule, with its faults and its cheapest repair."""
    rows = damaged(table(spark, sf_dir, "conversations"))
    return repair(rows, there_col="there").withColumnRenamed("conv", "conv_id")


OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crcs AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''), lambda x: ascii(x)::BIGINT) AS key
  FROM conversations
), kinds AS (
  SELECT keyed.*, xor(4294967295, list_reduce(key, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT)) % 20 AS kind FROM keyed, crcs
), rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM rows
), marked AS (
  SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS kept, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM ordered
), faulty AS (
  SELECT conv_id, turn, i, role, text, role[1] AS ini, kept = '' AS blank, kept <> '' AND seen > 1 AS dup,
    kept <> '' AND seen = 1 AND right(kept, 1) NOT IN ('.', '!', '?') AS cut
  FROM marked
), sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (next IS NOT NULL AND concat(ini, next) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lead(ini) OVER (PARTITION BY conv_id ORDER BY i) AS next FROM faulty) GROUP BY conv_id
), own(conv_id, i, c) AS (
  SELECT conv_id, n + 1, [0, 6, 3, 0]::BIGINT[] FROM sums
  UNION ALL
  SELECT conv_id, i, [least(o[1], o[3] + 3, o[4] + 6), least(o[2], o[3] + 3, o[4] + 6), least(o[3], o[4] + 3), least(o[4], o[3] + 3)]
  FROM (
    SELECT f.conv_id, f.i, CASE WHEN blank OR dup THEN [c[1] + 4, c[2] + 4, c[3] + 4, c[4] + 4] ELSE [
      least(c[1] + 4, c[3] + 3 + 3 * cut::INT, CASE ini WHEN 's' THEN c[2] WHEN 'u' THEN c[3] ELSE 1000000000 END + 3 * cut::INT),
      least(c[2] + 4, c[3] + 3 + 3 * cut::INT, CASE ini WHEN 'u' THEN c[3] ELSE 1000000000 END + 3 * cut::INT),
      least(c[3] + 4, c[4] + 3 + 3 * cut::INT, CASE ini WHEN 'a' THEN c[4] ELSE 1000000000 END + 3 * cut::INT),
      least(c[4] + 4, c[3] + 3 + 3 * cut::INT, CASE ini WHEN 'u' THEN c[3] ELSE 1000000000 END + 3 * cut::INT)] END AS o
    FROM own JOIN faulty f ON f.conv_id = own.conv_id AND f.i = own.i - 1)
), walk(conv_id, i, q, audit, said) AS (
  SELECT conv_id, 1, 0, '', ''::VARCHAR FROM sums
  UNION ALL
  SELECT conv_id, CASE e WHEN 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN k ELSE l END, concat(audit, e),
    CASE e WHEN 'D' THEN said ELSE concat(said, chr(10), CASE e WHEN 'K' THEN role WHEN 'I' THEN r ELSE r END, ':', CASE e WHEN 'I' THEN '' ELSE text END) END
  FROM (
    SELECT *, CASE WHEN role IS NULL THEN 'I' WHEN here[q + 1] = c[q + 1] + 4 THEN 'D' WHEN here[q + 1] = here[l + 1] + 3 THEN 'I'
      WHEN k IS NOT NULL AND here[q + 1] = c[k + 1] + 3 * cut::INT THEN 'K' ELSE 'R' END AS e
    FROM (
      SELECT w.conv_id, w.i, w.q, w.audit, w.said, f.role, f.text, f.cut, h.c AS here, a.c AS c,
        CASE w.q WHEN 2 THEN 3 ELSE 2 END AS l, CASE w.q WHEN 2 THEN 'assistant' ELSE 'user' END AS r,
        CASE WHEN w.q = 0 AND ini = 's' THEN 1 WHEN w.q <> 2 AND ini = 'u' THEN 2 WHEN w.q = 2 AND ini = 'a' THEN 3 END AS k
      FROM walk w JOIN own h ON h.conv_id = w.conv_id AND h.i = w.i LEFT JOIN faulty f ON f.conv_id = w.conv_id AND f.i = w.i
      LEFT JOIN own a ON a.conv_id = w.conv_id AND a.i = w.i + 1
      WHERE f.i IS NOT NULL OR w.q IN (1, 2)))
), ended AS (
  SELECT w.conv_id, w.audit, sha256(w.said[2:]) AS repaired_sha256 FROM walk w JOIN sums s ON s.conv_id = w.conv_id AND w.i = s.n + 1 AND w.q IN (0, 3)
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(o.c[1], 0)::BIGINT AS cost, coalesce(e.audit, '') AS audit, coalesce(e.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN sums s USING (conv_id) LEFT JOIN own o ON o.conv_id = a.conv_id AND o.i = 1 LEFT JOIN ended e ON e.conv_id = a.conv_id
"""
