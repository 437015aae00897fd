"""Conversation repair: cheapest edits that give a conversation the order system, user, assistant, user, assistant ...

1. Every row gets its first fault: blank, duplicate (its role and text were there before) or truncated (its last
   visible character ends no sentence). Repeats are found by 128-bit digests, so this step moves no texts.
2. A conversation becomes a string with a character for each row: what its role allows and what its fault demands.
   Most conversations share few such signatures.
3. Each distinct signature is solved once, by recursion over (row, what came last) with remembered costs, and its
   audit (the edits' initials) is joined back.
4. The audits are replayed: a conversation's rows come in order behind its audit, and are digested one after the
   other, so no task holds a conversation's texts.

A conversation's rows meet in one task, since its audit and its digest are one value in order; the task streams them
and keeps a byte for each row.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from voxmere.llm.common import in_batches, table, written

BLANKS = " \t\n\x0b\x0c\r"
ENDINGS = [".", "!", "?"]
#: Costs of the edits, and of leaving a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: What may follow, by what came last: nothing, the system's row, the user's, the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
FINDINGS = ("gaps", "blank", "duplicate", "truncated", "illegal")
MUST_GO = "d"


def edits(signature: str, i: int, last: int, put: bool) -> list[tuple[str, int, int, int, bool]]:
    """The edits that are possible before row i, least initial first: (initial, cost, next row, what came last, whether a row was just put in).

    A second row put in at one place never pays: it leads back to where the first began, or saves a system row that
    is cheaper to delete.
    """
    out = []
    row = signature[i] if i < len(signature) else ""
    if row:
        out.append(("D", DELETE, i + 1, last, False))
    if not put:
        out.append(("I", INSERT, i, NEXT[last], True))
    if row and row != MUST_GO:
        left = TRUNCATED if row.isupper() else 0
        role = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(row.lower())
        if role == NEXT[last] or (role == SYSTEM and last == START):
            out.append(("K", left, i + 1, role, False))
        out.append(("R", REROLE + left, i + 1, NEXT[last], False))
    return out


def solve(signature: str) -> tuple[int, str]:
    """Least cost, and of the audits that have it the least one in ASCII order.

    A signature has a character for each row: d for one that must go, else s, u, a or o (any other role), a capital
    if it is truncated. From one state each initial leads to one other, so taking the least initial of a cheapest
    way at every step gives the least audit.
    """
    known: list[dict[tuple[int, bool], int]] = [{} for _ in range(len(signature) + 1)]

    def least(i: int, last: int, put: bool) -> int:
        if (last, put) not in known[i]:
            ways = [cost + least(j, after, again) for _, cost, j, after, again in edits(signature, i, last, put)]
            if i == len(signature) and last in (START, ASSISTANT):
                ways.append(0)
            known[i][last, put] = min(ways, default=1 << 60)
        return known[i][last, put]

    for i in range(len(signature), -1, -1):  # from the end, so that the recursion is never deep
        for last in NEXT:
            least(i, last, False)
    audit, at = [], (0, START, False)
    while left := least(*at):
        for initial, cost, *after in edits(signature, *at):
            if cost + least(*after) == left:
                audit.append(initial)
                at = tuple(after)
                break
    # what is left costs nothing: rows that are kept
    return least(0, START, False), "".join(audit) + "K" * (len(signature) - at[0])


def damaged(rows: DataFrame) -> DataFrame:
    """op13's damage, by the crc32 of '<conv>:<turn>' (null: one space) modulo 20: 0 drops the row (there is false), 1 empties its text, 2 takes out sentence ends, 3 repeats it, 4 makes it the user's."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")))
    dealt = rows.withColumn("kind", F.crc32(name.cast("binary")) % 20)
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", "".join(ENDINGS), "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    return dealt.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("kind") != 0).alias("there"))


def undamaged(rows: DataFrame) -> DataFrame:
    return rows.select("conv", "turn", "role", "text", F.lit(0).alias("copy"), F.lit(True).alias("there"))


def in_order() -> list[Column]:
    """The order of a conversation's rows: by turn, equal turns by content (a digest), copies last."""
    return [F.col("turn").asc_nulls_first(), F.col("h1").asc(), F.col("h2").asc(), F.col("copy").asc()]


def signatures(rows: DataFrame) -> DataFrame:
    """(conv, findings, signature) of every conversation of rows with digests."""
    visible = F.rtrim("text", F.lit(BLANKS))
    light = rows.select("conv", "turn", "h1", "h2", "copy", "there", F.substring("role", 1, 1).alias("initial"), (visible == "").alias("blank"), (~F.substring(visible, -1, 1).isin(ENDINGS)).alias("open"))
    seen = Window.partitionBy("conv", "h1", "h2", "there").orderBy(F.col("turn").asc_nulls_first(), "copy")
    marked = light.withColumn("again", F.row_number().over(seen) > 1)
    fault = F.when(~F.col("there"), "-").when(F.col("blank"), "b").when(F.col("again"), "d").when(F.col("open"), "t").otherwise("")
    ordered = marked.select("conv", "turn", "h1", "h2", "copy", "initial", fault.alias("fault")).repartition("conv").sortWithinPartitions("conv", *in_order()).select("conv", "turn", "initial", "fault")
    conv = rows.schema["conv"].dataType.simpleString()
    kept = pa.schema([(name, pa.int64()) for name in FINDINGS] + [("signature", pa.string())])

    def encode(batches):
        key, run = None, None
        for b in batches:
            out_keys, out_rows = [], []
            keys = b["conv"].to_pylist()
            for conv, turn, initial, fault in zip(keys, *(b[c].to_pylist() for c in ("turn", "initial", "fault"))):
                if run is None or conv != key:
                    if run is not None:
                        out_keys.append(key)
                        out_rows.append(run.row())
                    key, run = conv, _Run()
                run.add(turn, initial, fault)
            if out_keys:
                yield _batch(out_keys, out_rows, b.schema.field("conv").type, kept)
            at = b.schema.field("conv").type
        if run is not None:
            yield _batch([key], [run.row()], at, kept)

    return in_batches(ordered).mapInArrow(encode, f"conv {conv}, {', '.join(f'{f} long' for f in FINDINGS)}, signature string")


def _batch(keys: list, rows: list[dict], key_type: pa.DataType, kept: pa.Schema) -> pa.RecordBatch:
    found = pa.RecordBatch.from_pylist(rows, schema=kept)
    return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *found.columns], names=["conv", *kept.names])


class _Run:
    """What is known of a conversation after some of its rows."""

    def __init__(self) -> None:
        self.letters, self.counts, self.illegal = bytearray(), {"b": 0, "d": 0, "t": 0, "": 0}, 0
        self.first = self.turn = self.before = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if fault == "-":  # the row is gone, its conversation is not
            return
        self.counts[fault] += 1
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        role = initial if initial in ("s", "u", "a") else "o"
        self.letters += (MUST_GO if fault in ("b", "d") else role.upper() if fault == "t" else role).encode()

    def row(self) -> dict:
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, "blank": self.counts["b"], "duplicate": self.counts["d"], "truncated": self.counts["t"], "illegal": self.illegal, "signature": self.letters.decode()}


def solved(found: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each distinct signature."""

    def each(batches):
        for b in batches:
            done = [solve(s) for s in b["signature"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["signature"], pa.array([c for c, _ in done], pa.int64()), pa.array([a for _, a in done], pa.string())], names=["signature", "cost", "audit"])

    return found.select("signature").distinct().mapInArrow(each, "signature string, cost long, audit string")


class _Replay:
    """A conversation's rows taken through its audit, as a digest of what remains."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.last = audit, 0, START
        self.digest, self.empty = hashlib.sha256(), True

    def put(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.last, self.at = NEXT[self.last], self.at + 1
            self.put(ROLE[self.last], "")

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "D":
            return
        self.last = SYSTEM if edit == "K" and role[:1] == "s" else NEXT[self.last]
        self.put(role if edit == "K" else ROLE[self.last], text)

    def end(self) -> str:
        self.insert()
        return self.digest.hexdigest()


def replayed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): a digest of each conversation of `audits` (conv, audit) after its edits."""
    conv = rows.schema["conv"].dataType.simpleString()
    texts = rows.where("there").select("conv", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "h1", "h2", "copy")
    first = audits.select("conv", "audit", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "text", "h1", "h2", "copy")))
    ordered = texts.unionByName(first).repartition("conv").sortWithinPartitions("conv", F.col("audit").isNull(), *in_order()).select("conv", "audit", "role", "text")

    def replay(batches):
        key, run, kind = None, None, None
        for b in batches:
            keys, digests = [], []
            kind = b.schema.field("conv").type
            for conv, audit, role, text in zip(*(b[c].to_pylist() for c in ("conv", "audit", "role", "text"))):
                if audit is None:
                    run.row(role, text)
                    continue
                if run is not None:
                    keys.append(key)
                    digests.append(run.end())
                key, run = conv, _Replay(audit)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(digests)], names=["conv", "repaired_sha256"])
        if run is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([run.end()])], names=["conv", "repaired_sha256"])

    return in_batches(ordered).mapInArrow(replay, f"conv {conv}, repaired_sha256 string")


def repaired(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", before=undamaged) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    Rows are taken by turn, nulls first; equal turns in the order of a digest of role and text. A null role or text
    counts as one space, so such a text is blank; a null conversation is one of its own. Rows that repeat role and
    text are duplicates from the second on. gaps counts the turns that are missing between the first and the last.
    `before` may change the rows first. Rows of a conversation that is all gone give zeros, an empty audit and the
    digest of nothing.
    """
    one = F.lit(" ")
    rows = before(df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), one).alias("role"), F.coalesce(F.col(text), one).alias("text")))
    rows = rows.withColumns({f"h{k}": F.xxhash64(F.lit(k), "role", "text") for k in (1, 2)})
    found = written(signatures(rows))
    audits = written(found.join(solved(found), "signature").drop("signature"))
    digests = replayed(rows, audits.select("conv", "audit"))
    same = audits["conv"].eqNullSafe(digests["conv"])
    return audits.join(digests, same).select(audits["conv"], *FINDINGS, "cost", "audit", "repaired_sha256")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"), before=damaged).withColumnRenamed("conv", "conv_id")
