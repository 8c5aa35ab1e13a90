"""Cheapest repair of conversations, so that their turns alternate.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials; four states tell
how far a prefix has come. A conversation is cut in the middle: forward costs of the four
states (with the order of their least audits) meet backward costs there, the crossing of the
least audit among the cheapest is chosen, and both halves follow, so that space is linear in
the turns. All conversations of a batch take each step at once.

A conversation is solved in pieces of bounded length: each piece gives costs and orders from
every state to every state, these are cut and crossed like turns, and then each piece is
solved between its own two states. No task holds a whole long conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterspark.llm.shared import SPACE_CHARS, stored

#: Rows of a piece, as a power of two.
PIECE_BITS = 16
#: States: nothing yet, after the system turn, after the user, after the assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs of the edits, and of keeping what is truncated.
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
NEVER = 1 << 40
END = 4
#: What precedes a row and what happens to it, in the order of its audit.
EDITS = sorted(before + own for before in ("", "I", "II") for own in "DKR")
LEADS = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The role that may follow each state, and what must follow it at the end.
FOLLOWS = ["user", "user", "assistant", "user"]
TAIL = [[], ["user", "assistant"], ["assistant"], []]


def inserted(state: int, n: int) -> tuple[list[str], int]:
    """The roles of ``n`` insertions after a state, and the state after them."""
    roles = []
    for _ in range(n):
        roles.append(FOLLOWS[state])
        state = LEADS[state, FOLLOWS[state][0]]
    return roles, state


class Steps:
    """For each kind of element the cost from state to state, and the place of its least
    audit in the order of audits."""

    def __init__(self, cost: np.ndarray, order: np.ndarray):
        self.cost, self.order = cost, order

    @classmethod
    def of_rows(cls) -> Steps:
        cost, order = np.full((16, 4, 4), NEVER), np.zeros((16, 4, 4), dtype=np.int64)
        for kind in range(16):
            letter, fault = "sua?"[kind & 3], kind >> 2
            for start in range(4):
                for place, edit in enumerate(EDITS):
                    _, at = inserted(start, len(edit) - 1)
                    own, after = edit[-1], at
                    spent = INSERT * (len(edit) - 1) + {"D": DELETE, "K": 0, "R": REROLE}[own]
                    if own != "D":
                        if fault in (BLANK, DUPLICATE):
                            continue
                        after = LEADS.get((at, letter if own == "K" else FOLLOWS[at][0]))
                        spent += CUT_SHORT * (fault == TRUNCATED)
                    if after is not None and spent < cost[kind, start, after]:
                        cost[kind, start, after], order[kind, start, after] = spent, place
        return cls(cost, order)


ROWS = Steps.of_rows()
AT_END = np.array([INSERT * len(t) if i in (EMPTY, ASSISTANT) or t else NEVER for i, t in enumerate(TAIL)], dtype=np.int64)


def forward(steps: Steps, kinds: np.ndarray, lo: np.ndarray, hi: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least cost of each state after the elements from lo to hi, and the order of the least
    audits that reach the states at that cost. Longer spans come first.

    An audit that ends in a row's own edit is no beginning of another one with as many rows,
    so audits compare by where they come from, and then by their last part.
    """
    cost, rank = np.full((len(lo), 4), NEVER), np.zeros((len(lo), 4), dtype=np.int64)
    cost[np.arange(len(lo)), entry] = 0
    length = hi - lo
    for j in range(int(length.max(initial=0))):
        n = int(np.searchsorted(-length, -j, side="left"))
        kind = kinds[lo[:n] + j]
        key = (cost[:n, :, None] + steps.cost[kind]) * 64 + rank[:n, :, None] * 16 + steps.order[kind]
        best = key.min(axis=1)
        cost[:n] = np.minimum(best >> 6, NEVER)
        way = best & 63
        rank[:n] = (way[:, :, None] > way[:, None, :]).sum(axis=2)
    return cost, rank


def backward(steps: Steps, kinds: np.ndarray, lo: np.ndarray, hi: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Least cost from each state before lo to the wanted one after hi, or to any end."""
    cost = np.where(leave[:, None] == END, AT_END, np.where(leave[:, None] == np.arange(4), 0, NEVER))
    length = hi - lo
    for j in range(1, int(length.max(initial=0)) + 1):
        n = int(np.searchsorted(-length, -j, side="right"))
        cost[:n] = np.minimum((steps.cost[kinds[hi[:n] - j]] + cost[:n, None, :]).min(axis=2), NEVER)
    return cost


def crossings(steps: Steps, kinds: np.ndarray, lo: np.ndarray, hi: np.ndarray, entry: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """The state after each element on the cheapest way of the least audit."""
    after = np.zeros(len(kinds), dtype=np.int64)
    keep = hi > lo
    lo, hi, entry, leave = lo[keep], hi[keep], entry[keep], leave[keep]
    while len(lo):
        mid = (lo + hi + 1) // 2
        longest = np.argsort(lo - mid, kind="stable")
        lo, mid, hi, entry, leave = lo[longest], mid[longest], hi[longest], entry[longest], leave[longest]
        cost, rank = forward(steps, kinds, lo, mid, entry)
        longest = np.argsort(mid - hi, kind="stable")
        rest = np.empty_like(cost)
        rest[longest] = backward(steps, kinds, mid[longest], hi[longest], leave[longest])
        cross = ((cost + rest) * 4 + rank).argmin(axis=1)
        after[mid - 1] = cross
        left, right = mid - lo > 1, hi > mid
        lo, hi, entry, leave = (
            np.concatenate(x) for x in ((lo[left], mid[right]), (mid[left], hi[right]), (entry[left], cross[right]), (cross[left], leave[right]))
        )
    return after


def faulted(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, kind) of ordered rows: the initial of the role and the first fault.

    The first row of a role and a text is found by sums over keys, and the rows learn of it
    by their own position, so a row that makes up a conversation is no hot key.
    """
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    first = rows.filter(~blank).groupBy("conv_id", "role", F.md5("text")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    open_end = ~F.right(F.rtrim("text", F.lit(SPACE_CHARS)), F.lit(1)).isin(".", "!", "?")
    slim = rows.select("conv_id", "pos", F.left("role", F.lit(1)).alias("initial"), blank.alias("blank"), open_end.alias("open_end"))
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("open_end"), TRUNCATED).otherwise(NONE)
    return slim.join(first, "pos", "left").select("conv_id", "pos", (initial + 4 * fault).cast("tinyint").alias("kind"))


SPACE = r"\x20\x09-\x0D"


def in_order(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows (conv_id, turn, role, text, pos) with positions that sort conversations and turns.

    A range sort spreads a long conversation over many tasks. Turns without a number come
    first; ties go by role and text; what is still equal is the same row.
    """
    keys = ["conv_id", "turn", "role", "mark", "spread"]
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("mark", F.md5("text")).withColumn("spread", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("mark", "spread")
    return stored(rows.withColumn("pos", F.monotonically_increasing_id()), "turns")


PIECE = "start long, kinds array<tinyint>, entry int, leave int, last boolean"


def solved(pieces: DataFrame, kind: str) -> DataFrame:
    """Each piece between its states: the codes of its rows, and its sums."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            kinds = lists.flatten().to_numpy().astype(np.int64)
            size = np.diff(lists.offsets.to_numpy())
            hi = np.cumsum(size)
            lo = hi - size
            entry, leave = (batch.column(i).to_numpy().astype(np.int64) for i in (3, 4))
            last = batch.column(5).to_numpy(zero_copy_only=False)
            after = crossings(ROWS, kinds, lo, hi, entry, leave)
            before = np.append(0, after[:-1])
            before[lo] = entry
            codes = before * len(EDITS) + ROWS.order[kinds, before, after]
            spent = np.add.reduceat(ROWS.cost[kinds, before, after], lo) + np.where(last, AT_END[after[hi - 1]], 0)
            tail = np.where(last, after[hi - 1], EMPTY)
            letter, fault = kinds & 3, kinds >> 2
            legal = np.isin(letter[:-1] * 4 + letter[1:], [1, 6, 9])
            inside = np.ones(len(kinds) - 1, dtype=bool)
            inside[hi[:-1] - 1] = False
            illegal = np.add.reduceat(np.append((~legal & inside).astype(np.int64), 0), lo)
            counts = [np.add.reduceat((fault == f).astype(np.int64), lo) for f in (BLANK, DUPLICATE, TRUNCATED)]
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, hi), pa.int32()), pa.array(codes, pa.int8()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), listed, pa.array(tail, pa.int32()), *map(pa.array, (*counts, illegal, spent))],
                names=["conv_id", "start", "codes", "tail", "blank", "duplicate", "truncated", "illegal", "cost"],
            )

    sums = "blank long, duplicate long, truncated long, illegal long, cost long"
    return stored(pieces.mapInArrow(work, f"conv_id {kind}, start long, codes array<tinyint>, tail int, {sums}"), "repaired-pieces")


def ways(parts: DataFrame, kind: str) -> DataFrame:
    """Costs and orders of each piece from every state to every state, and its end letters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                kinds = batch.column(2)[i].values.to_numpy().astype(np.int64)
                cost, rank = forward(ROWS, kinds, np.zeros(4, dtype=np.int64), np.full(4, len(kinds)), np.arange(4))
                ends = [int(kinds[0] & 3), int(kinds[-1] & 3)]
                row = batch.slice(i, 1)
                made = [pa.array([x.reshape(-1).tolist()], pa.list_(pa.int64())) for x in (cost, rank)]
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), *made, pa.array([ends], pa.list_(pa.int64()))], names=["conv_id", "start", "cost", "order", "ends"])

    return parts.select("conv_id", "start", "kinds").mapInArrow(work, f"conv_id {kind}, start long, cost array<long>, `order` array<long>, ends array<long>")


def between(parts: DataFrame, kind: str) -> DataFrame:
    """(conv_id, start, entry, leave, last, illegal) of the pieces of longer conversations:
    pieces are crossed as rows are. A task holds some 300 bytes for 65,536 rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][0] != row[0]:
                    yield one(held)
                    held = []
                held.append(row)
        if held:
            yield one(held)

    def one(rows: list[tuple]) -> pa.RecordBatch:
        n = len(rows)
        steps = Steps(*(np.array([r[i] for r in rows], dtype=np.int64).reshape(n, 4, 4) for i in (2, 3)))
        zero = np.zeros(1, dtype=np.int64)
        after = crossings(steps, np.arange(n), zero, zero + n, zero, zero + END)
        pairs = [0] + [a[4][1] * 4 + b[4][0] for a, b in zip(rows, rows[1:])]
        illegal = [0] + [int(p not in (1, 6, 9)) for p in pairs[1:]]
        columns = (([r[1] for r in rows], pa.int64()), (np.append(0, after[:-1]), pa.int32()), (after, pa.int32()), (np.arange(n) == n - 1, pa.bool_()), (illegal, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kinds[0]), *[pa.array(c, t) for c, t in columns]], names=["conv_id", "start", "entry", "leave", "last", "illegal"])

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(parts.select("conv_id").schema)]
    dealt = ways(parts, kind).repartition("conv_id").sortWithinPartitions("conv_id", "start")
    return stored(dealt.mapInArrow(work, f"conv_id {kind}, start long, entry int, leave int, last boolean, illegal long"), "piece-states")


def by_code(values: list) -> Column:
    """The entry of a literal list for the row's code."""
    return F.element_at(F.array(*values), F.col("code") + 1)


def repair(rows: DataFrame, piece_bits: int = PIECE_BITS) -> tuple[DataFrame, DataFrame]:
    """Of rows from ``in_order``: every edit (conv_id, pos, place, edit, role, text), sorted
    by pos and place, without role and text for what is deleted; and by conversation
    (conv_id, blank, duplicate, truncated, illegal, cost)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    packed = faulted(rows).groupBy("conv_id", F.shiftright("pos", piece_bits).alias("piece"))
    packed = packed.agg(F.min("pos").alias("start"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "kind"))), lambda x: x["kind"]).alias("kinds"))
    pieces = stored(packed.select("conv_id", "start", "kinds"), "pieces")
    longer = stored(pieces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("long_id")), "long-conversations")
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    whole = pieces.join(longer, same, "left_anti").select("conv_id", "start", "kinds", F.lit(EMPTY).alias("entry"), F.lit(END).alias("leave"), F.lit(True).alias("last"))
    parts = stored(pieces.join(longer, same, "left_semi"), "long-pieces")
    states = between(parts, kind)
    parts = parts.join(states.drop("conv_id", "illegal"), "start").select(*whole.columns)
    made = solved(whole.union(parts), kind)

    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    seams = states.select("conv_id", *[(F.col(c) if c == "illegal" else F.lit(0).cast("long")).alias(c) for c in sums])
    summed = made.select("conv_id", *sums).union(seams).groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in sums])

    codes = made.select(F.posexplode("codes").alias("n", "code"), "start").select((F.col("start") + F.col("n")).alias("pos"), "code")
    known = [(state, edit) for state in range(4) for edit in EDITS]
    put = [inserted(state, len(edit) - 1)[0] for state, edit in known]
    new_role = [FOLLOWS[inserted(state, len(edit) - 1)[1]] for state, edit in known]
    letter = by_code([F.lit(edit[-1]) for _, edit in known])
    text, nothing = F.lit("").alias("text"), F.lit(None).cast("string")
    insert = lambda role: F.struct(F.lit("I").alias("edit"), role.alias("role"), text)
    own = F.struct(
        letter.alias("edit"),
        F.when(letter == "K", F.col("role")).when(letter == "R", by_code([F.lit(r) for r in new_role])).alias("role"),
        F.when(letter != "D", F.col("text")).otherwise(nothing).alias("text"),
    )
    put_before = by_code([F.array(*[F.lit(r) for r in roles]).cast("array<string>") for roles in put])
    edits = rows.join(codes, "pos").select("conv_id", "pos", F.posexplode(F.concat(F.transform(put_before, insert), F.array(own))).alias("place", "e"))
    tails = F.element_at(F.array(*[F.array(*[F.lit(r) for r in t]).cast("array<string>") for t in TAIL]), F.col("tail") + 1)
    ends = made.filter(f"tail IN ({SYSTEM}, {USER})").select("conv_id", (F.col("start") + F.size("codes") - 1).alias("pos"), F.posexplode(F.transform(tails, insert)).alias("place", "e"))
    # A row's own edits take three places at most.
    return edits.union(ends.withColumn("place", F.col("place") + 3)).select("conv_id", "pos", "place", "e.*"), summed


def digests(edits: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) of edits. A conversation's digest is made in one
    stream, as SHA-256 has to be; a task holds one batch and the audit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, now, audit, digest, any_line = False, None, [], hashlib.sha256(), False
        done: list[tuple] = []
        for batch in batches:
            for conv, edit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not began or conv != now:
                    if began:
                        done.append((now, "".join(audit), digest.hexdigest()))
                    began, now, audit, digest, any_line = True, conv, [], hashlib.sha256(), False
                audit.append(edit)
                if edit != "D":
                    digest.update((("\n" if any_line else "") + f"{role}:{text}").encode())
                    any_line = True
            if done:
                yield packed(done)
                done = []
        if began:
            yield packed([(now, "".join(audit), digest.hexdigest())])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (kinds[0], pa.string(), pa.string()))], names=["conv_id", "audit", "repaired_sha256"])

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(edits.select("conv_id").schema)]
    kind = edits.schema["conv_id"].dataType.simpleString()
    dealt = edits.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "place").select("conv_id", "edit", "role", "text")
    return dealt.mapInArrow(work, f"conv_id {kind}, audit string, repaired_sha256 string")


def repair_conversations(turns: DataFrame, ids: DataFrame | None = None, piece_bits: int = PIECE_BITS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of
    every conversation of ``ids``, or of ``turns``: numbers missing between the first and the
    last turn, rows by their first fault, neighbours of unfit roles, and the cheapest repair.

    Missing roles and texts count as one space; turns without a number come first and leave
    no gap; rows without a conversation id form one conversation; a repeated row is a
    duplicate; one without rows has zeros and an empty audit. Other columns do not matter; an
    empty table gives none.
    """
    rows = in_order(turns)
    edits, summed = repair(rows, piece_bits)
    numbers = rows.groupBy("conv_id").agg(F.max("turn").alias("most"), F.min("turn").alias("least"), F.countDistinct("turn").alias("n"))
    gaps = numbers.select("conv_id", F.coalesce(F.col("most") - F.col("least") + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps"))
    sums, texts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], ["audit", "repaired_sha256"]
    ids = (turns if ids is None else ids).select("conv_id").distinct()
    found = [ids, gaps, summed, digests(edits)]

    def widened(df: DataFrame) -> DataFrame:
        return df.select("conv_id", *[(F.col(c) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in [*((c, "long") for c in sums), *((c, "string") for c in texts)]])

    every = widened(found[0])
    for df in found[1:]:
        every = every.union(widened(df))
    joined = every.groupBy("conv_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], *[F.max(c).alias(c) for c in texts])
    return joined.select("conv_id", *sums, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damage(turns: DataFrame) -> DataFrame:
    """Turns dropped, emptied, cut short, repeated or given to the user, by a checksum of the
    conversation and the turn."""
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.crc32(named.cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("fate")).filter("fate <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
