"""Repair of the structure of conversations by a suffix-shared automaton.

Roles should read `(s?(ua)+)?` by their initials. Rows may be kept (0), given another role
(2), deleted (3; blank and repeated ones must go) and put in (2); a truncated row that stays
costs 1. The cheapest edits of a conversation depend only on its signature, one letter a row
for role and fault. Signatures are taken from the end: distinct ones are range-partitioned and sorted
backwards, so those that end alike follow each other, and a stack holds one automaton
node for each common ending. A node gets its cost-to-go and the first letter of its best
audit for each grammar state once for all the conversations that share the ending (once more
where a range partition begins). Nodes that prefer the same edits are the same
minimal node: `step` is computed once for each symbol and vector of relative costs. As each
letter of an audit leads to one successor, the least first letter gives the least audit.

Rows of a conversation are read as a sorted stream, never as a group in memory. A digest
of a whole conversation is sequential, so one conversation is one task's stream, whatever its length;
conversations of the same signature, a hot one included, meet their audit by met().

Defined results: a null role or text is one space; a null conv_id is a conversation of its own; rows go by
turn (nulls first), then role and text by code points; of equal rows the first counts
and the others are duplicates; a role whose initial is not s, u or a can only be deleted or
changed; long texts are streamed; an empty table gives an empty result; other columns, of
whatever names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import cut, met

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
#: Grammar states: 0 at first, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
ENDS = (0, 3)
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
MADE = (2, 2, 3, 2)  # the state after an insertion or another role, of which each state allows one
ROLE = {2: "user", 3: "assistant"}
#: A row's symbol: role initial (s, u, a or another) times 4 plus fault.
INITIALS, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
LEGAL = {"su", "ua", "au"}
BATCH = 4096


def symbol(role: Column, text: Column, again: Column) -> Column:
    """The letter a to p of one row; `again` says that the same role and text came before."""
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", 1).when(again, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring(role, 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.char(F.lit(97) + kind * 4 + fault)


def settled(plain: list[tuple[int, str]]) -> tuple[tuple[int, ...], str]:
    """Costs and first letters of the four states, given (cost, letter) without an insertion first; '.' ends."""
    costs = [c for c, _ in plain]
    for _ in range(3):
        costs = [min(c, COST[INSERT] + costs[MADE[q]]) for q, c in enumerate(costs)]
    first = [min(([plain[q][1]] if plain[q][0] == c else []) + ([INSERT] if COST[INSERT] + costs[MADE[q]] == c else [])) for q, c in enumerate(costs)]
    return tuple(costs), "".join(first)


@cache
def step(letter: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """Costs and first letters of a node whose first row is `letter` and whose successor costs `after`."""
    kind, fault = divmod(ord(letter) - 97, 4)
    late, plain = TRUNCATED * (fault == 3), []
    for q in range(4):
        options = [(COST[DELETE] + after[q], DELETE)]
        if fault not in (1, 2):
            options.append((COST[REROLE] + late + after[MADE[q]], REROLE))
            if (to := KEPT.get((q, (INITIALS + "?")[kind]))) is not None:
                options.append((late + after[to], KEEP))
        plain.append(min(options))
    return settled(plain)


END = settled([(0 if q in ENDS else 1 << 40, ".") for q in range(4)])


def nodes(backwards: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) of signatures that come backwards and sorted; the stack holds the endings of the last one."""
    base, relative, letters, last = [0], [END[0]], [END[1]], ""
    for back in backwards:
        same = 0
        for x, y in zip(last, back, strict=False):
            if x != y:
                break
            same += 1
        del base[same + 1 :], relative[same + 1 :], letters[same + 1 :]
        for x in back[same:]:
            costs, first = step(x, relative[-1])
            base.append(base[-1] + min(costs))
            relative.append(tuple(c - min(costs) for c in costs))
            letters.append(first)
        last, signature, audit, q, depth = back, back[::-1], [], 0, len(back)
        while (edit := letters[depth][q]) != ".":
            audit.append(edit)
            if edit != INSERT:
                kind = (ord(signature[len(back) - depth]) - 97) // 4
                depth -= 1
            q = q if edit == DELETE else KEPT[q, INITIALS[kind]] if edit == KEEP else MADE[q]
        yield signature, base[-1] + relative[-1][0], "".join(audit)


def illegal(signature: str) -> int:
    initials = ["sua?"[(ord(x) - 97) // 4] for x in signature]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, symbol: each conversation in one partition and in order."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).repartition("conv_id")
    rows = rows.withColumn("seen", F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())))
    rows = rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "seen")
    return rows.select("conv_id", "turn", "role", "text", symbol(F.col("role"), F.col("text"), F.col("seen") > 1).alias("symbol"))


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches, each of few rows and not many more than `most` characters."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(some) == BATCH or size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


def _mapped(df: DataFrame, rows_of, out: StructType) -> DataFrame:
    """df.mapInArrow with a generator over the rows of a partition."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)
    rows = lambda batches: (row for b in batches for k in range(0, b.num_rows, BATCH) for row in zip(*[c.to_pylist() for c in b.slice(k, BATCH).columns], strict=True))
    return df.mapInArrow(lambda batches: _batches(rows_of(rows(batches)), schema), out)


def _signed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, signature, gaps) of the conversations of a sorted stream of (conv_id, turn, symbol)."""
    conv, letters, first, last, n, began = None, [], None, None, 0, False
    end = lambda: (conv, "".join(letters), 0 if first is None else last - first + 1 - n)
    for c, turn, letter in rows:
        if began and c != conv:
            yield end()
        if not began or c != conv:
            conv, letters, first, last, n, began = c, [], None, None, 0, True
        letters.append(letter)
        if turn is not None and turn != last:
            first, last, n = turn if first is None else first, turn, n + 1
    if began:
        yield end()


def _kind(turns: DataFrame) -> StructField:
    return StructField("conv_id", turns.schema["conv_id"].dataType)


def signatures(turns: DataFrame) -> DataFrame:
    """conv_id, signature, gaps."""
    out = StructType([_kind(turns), StructField("signature", StringType()), StructField("gaps", LongType())])
    return _mapped(ordered(turns).select("conv_id", "turn", "symbol"), _signed, out)


def audits(signs: DataFrame) -> DataFrame:
    """signature, n, illegal, cost, audit for each distinct signature; n conversations have it."""
    distinct = cut(signs.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).select("n", F.reverse("signature").alias("back")), "signatures")
    out = StructType([StructField("n", LongType()), StructField("signature", StringType()), StructField("illegal", LongType()), StructField("cost", LongType()), StructField("audit", StringType())])

    def audited(rows: Iterator[tuple]) -> Iterator[tuple]:
        counts: list[int] = []
        backwards = (back for n, back in rows if counts.append(n) is None)
        for signature, cost, audit in nodes(backwards):
            yield counts.pop(), signature, illegal(signature), cost, audit

    return _mapped(distinct.repartitionByRange("back").sortWithinPartitions("back"), audited, out)


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; a written table."""
    signs = cut(signatures(turns), "signs")
    found = met(signs, cut(audits(signs), "audits"), "signature", "n")
    faults = [F.length(F.translate("signature", "".join(chr(97 + k) for k in range(16) if k % 4 != f), "")).cast("long").alias(FAULTS[f]) for f in (1, 2, 3)]
    return cut(found.select("conv_id", "gaps", *faults, "illegal", "cost", "audit"), "repaired")


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, at, edit, role, text) of a sorted stream of (conv_id, audit, role, text), in which a row with the audit comes first."""
    conv, audit, p, q, at = None, "", 0, 0, 0

    def put_in() -> Iterator[tuple]:
        nonlocal p, q, at
        while p < len(audit) and audit[p] == INSERT:
            p, q = p + 1, MADE[q]
            yield conv, at, INSERT, ROLE[q], ""
            at += 1

    for c, head, role, text in rows:
        if head is not None:
            yield from put_in()
            conv, audit, p, q, at = c, head, 0, 0, 0
            continue
        yield from put_in()
        edit, p = audit[p], p + 1
        if edit != DELETE:
            q = KEPT[q, role[:1]] if edit == KEEP else MADE[q]
            yield c, at, edit, role if edit == KEEP else ROLE[q], text
            at += 1
    yield from put_in()


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the repaired conversations in order: conv_id, at (from 0), edit (K, R or I), role, text."""
    null = lambda kind: F.lit(None).cast(kind)
    heads = found.select("conv_id", "audit", null("long").alias("turn"), null("string").alias("role"), null("string").alias("text"), F.lit(0).alias("seen"))
    rows = turns.select("conv_id", null("string").alias("audit"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("seen"))
    stream = heads.union(rows).repartition("conv_id").sortWithinPartitions("conv_id", "seen", F.col("turn").asc_nulls_first(), "role", "text")
    out = StructType([_kind(turns), StructField("at", LongType()), StructField("edit", StringType()), StructField("role", StringType()), StructField("text", StringType())])
    return _mapped(stream.select("conv_id", "audit", "role", "text"), _edited, out)


def _digested(rows: Iterator[tuple]) -> Iterator[tuple]:
    conv, digest = None, None
    for c, role, text in rows:
        if digest is not None and c == conv:
            digest.update(b"\n")
        else:
            if digest is not None:
                yield conv, digest.hexdigest()
            conv, digest = c, hashlib.sha256()
        digest.update(f"{role}:{text}".encode())
    if digest is not None:
        yield conv, digest.hexdigest()


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the conversations of which any row is left; streams the repaired rows."""
    out = StructType([_kind(turns), StructField("repaired_sha256", StringType())])
    return _mapped(repaired_turns(turns, found).select("conv_id", "role", "text"), _digested, out)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with every 20th row or so dropped, emptied, cut, repeated or given to the user."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name) % 20).alias("h")).filter("h != 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
