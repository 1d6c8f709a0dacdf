"""Repair of conversations by a generalised LR parse over the role grammar.

The grammar is ``(s?(ua)+)?`` over the initials of roles.  Its LR automaton has four states, so a graph-structured stack
has at most four tops a row.  The parser takes a conversation from its last row to its first: a top then stands for the
cheapest way from there to the end, equal tops merge by minimum (cost, audit), and what an edit puts before the audit
of a top cannot change which of two audits is less (read the other way, an audit that begins another one could).  Costs of
the four tops relative to each other take few values, so steps of the stack are remembered and shared by all rows.

Rows travel as one character each (role and fault); texts are only hashed for it.  Repaired texts are then streamed in
order past their audit, one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

BLANKS = " \t\n\x0b\x0c\r"
ROLES, OTHER = "sua", 3  # initials that the grammar knows, by code
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5  # costs; the last is for rows that stay truncated
NAMES = ("user", "assistant")

# states: nothing read, after s, after u, after a
_SHIFT = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})  # state -> role code -> state
_ADDED = (1, 1, 2, 1)  # the only role of NAMES (by code) that each state shifts
_END = (0, 2 * INSERT, INSERT, 0)
_LEGAL = {"su", "ua", "au"}


def _inserting(costs: list, letters: list) -> None:
    """Let each top insert roles where that is cheaper, or as cheap and its letter comes first."""
    for _ in range(2):  # a useful chain of insertions visits a state once
        for q in (3, 2, 1, 0):
            by = INSERT + costs[_SHIFT[q][_ADDED[q]]]
            if by < costs[q] or (by == costs[q] and b"I"[0] < letters[q]):
                costs[q], letters[q] = by, b"I"[0]


@lru_cache(maxsize=1 << 14)
def _step(tops: tuple, code: int) -> tuple[tuple, int, bytes]:
    """(tops before a row, their least cost, the first edit's letter of each) from the tops after it; costs are
    relative to the least."""
    role, fault = divmod(code, 4)
    costs, letters = [], []
    for q in range(4):
        edits = [(DELETE + tops[q], b"D"[0])]
        if fault not in (BLANK, DUPLICATE):
            more = UNFINISHED if fault == TRUNCATED else 0
            if role in _SHIFT[q]:
                edits.append((more + tops[_SHIFT[q][role]], b"K"[0]))
            edits.append((more + REROLE + tops[_SHIFT[q][_ADDED[q]]], b"R"[0]))
        cost, letter = min(edits)
        costs.append(cost)
        letters.append(letter)
    _inserting(costs, letters)
    least = min(costs)
    return tuple(c - least for c in costs), least, bytes(letters)


def repair(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair; of equal ones the audit that is least in ASCII order."""
    tops, base, plan = _END, 0, bytearray(4 * len(codes))
    for i in range(len(codes) - 1, -1, -1):
        tops, more, letters = _step(tops, codes[i] - 65)
        base += more
        plan[4 * i : 4 * i + 4] = letters
    cost, q, i, audit = base + tops[0], 0, 0, bytearray()
    while i < len(codes):
        letter = plan[4 * i + q]
        audit.append(letter)
        if letter == 73:  # I
            q = _SHIFT[q][_ADDED[q]]
            continue
        if letter == 75:  # K
            q = _SHIFT[q][(codes[i] - 65) // 4]
        elif letter == 82:  # R
            q = _SHIFT[q][_ADDED[q]]
        i += 1
    audit += b"I" * (_END[q] // INSERT)
    return cost, audit.decode()


def edited(audit: str) -> Iterator[tuple[str, str | None]]:
    """(letter, role or None) of each edit: the role that an inserted or re-roled row gets.  Of the rows that stay, an
    odd number begins with the kept system's, after which user and assistant alternate."""
    stays = len(audit) - audit.count("D")
    at = 1 - stays % 2  # 0 is the system's place
    for letter in audit:
        if letter == "D":
            yield letter, None
        else:
            yield letter, NAMES[(at - 1) % 2] if at else None
            at += 1


def _illegal(codes: bytes) -> int:
    initials = [(c - 65) // 4 for c in codes]
    return sum(a == OTHER or b == OTHER or ROLES[a] + ROLES[b] not in _LEGAL for a, b in zip(initials, initials[1:]))


PIECE = "conv_id {id}, part int, at long, codes string, low {turn}, high {turn}, turns long"
REPAIRED = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _pieces(batches):
    """Codes of consecutive rows of one conversation as one string: a piece per conversation, task and batch."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        out, held = [], None
        for conv, turn, codes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "codes"))):
            if held is None or held[0] != conv:
                held = [conv, [], None, None, 0]
                out.append(held)
            held[1].append(codes)
            if turn is not None and (held[3] is None or turn != held[3]):
                held[2] = turn if held[2] is None else held[2]
                held[3] = turn
                held[4] += 1
        rows = [(conv, part, at + k, "".join(codes), low, high, n) for k, (conv, codes, low, high, n) in enumerate(out)]
        at += len(rows)
        kind = {n: batch.schema.field(n).type for n in ("conv_id", "turn")}
        types = [kind["conv_id"], pa.int32(), pa.int64(), pa.string(), kind["turn"], kind["turn"], pa.int64()]
        names = ["conv_id", "part", "at", "codes", "low", "high", "turns"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names)


def _repairs(batches):
    for batch in batches:
        out = []
        for pieces in batch.column("pieces").to_pylist():
            codes = "".join(p["codes"] for p in pieces).encode()
            turns = [p for p in pieces if p["low"] is not None]
            gaps = 0
            if turns:
                distinct = sum(p["turns"] for p in turns) - sum(a["high"] == b["low"] for a, b in zip(turns, turns[1:]))
                gaps = turns[-1]["high"] - turns[0]["low"] + 1 - distinct
            faults = [0] * 4
            for code in set(codes):
                faults[(code - 65) % 4] += codes.count(code)
            out.append((gaps, *faults[1:], _illegal(codes), *repair(codes)))
        columns = [pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 7, [pa.int64()] * 6 + [pa.string()])]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def _text_key():
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _rows(df: DataFrame) -> DataFrame:
    return df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def repair_conversations(df: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` per conversation of ``df`` (``conv_id, turn,
    role, text``).

    Rows are taken by turn, nulls first; rows of one turn by role and then by the MD5 of their text.  A row is blank
    without a character that is no white space, else a duplicate if an earlier row has its role and text, else
    truncated if its last such character is none of ``.!?``.  Edits and costs: K(eep) 0, R(erole) to user or assistant 1,
    D(elete) 2, which blank and duplicate rows must take, I(nsert) an empty row 5; a truncated row that stays
    adds 5.  ``audit`` is the letters of the cheapest edits after which the roles' initials match ``(s?(ua)+)?``, of
    equal ones the least in ASCII order.  ``gaps`` counts turns missing between the least and the greatest,
    ``illegal`` neighbours whose initials are none of su, ua, au.

    Null roles and texts are one space, null ids are one conversation; turns must be integers.  Other columns are
    ignored, whatever their names; no rows give no rows.  A conversation of very many rows is dealt over tasks as far as its
    codes, one character a row like its audit; only those meet in one row.
    """
    rows = _rows(df)
    inked = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(inked == "", BLANK).when(F.right(inked, F.lit(1)).isin(".", "!", "?"), OK).otherwise(TRUNCATED)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    narrow = rows.select("conv_id", "turn", "role", _text_key().alias("key"), (4 * role).alias("base"), fault.alias("fault"))
    alike = materialise(narrow.groupBy("conv_id", "turn", "role", "key").agg(F.count(F.lit(1)).alias("copies"), F.max("base").alias("base"), F.max("fault").alias("fault")), "turn-rows")
    order = F.struct(F.col("turn").isNotNull().alias("set"), "turn")
    again = alike.groupBy("conv_id", "role", "key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("__conv"), F.col("role").alias("__role"), F.col("key").alias("__key"), "first")
    met = alike.join(again, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("role") == F.col("__role")) & (F.col("key") == F.col("__key")), "left")
    letter = lambda f: F.char(F.lit(65) + F.col("base") + f)
    later = F.when(F.col("fault") == BLANK, letter(F.lit(BLANK))).otherwise(letter(F.lit(DUPLICATE)))
    earliest = F.col("first").isNull() | F.col("first.turn").eqNullSafe(F.col("turn"))
    codes = F.concat(F.when(earliest, letter(F.col("fault"))).otherwise(later), F.repeat(later, F.col("copies").cast("int") - 1))
    coded = materialise(met.select("conv_id", "turn", "role", "key", codes.alias("codes")), "turn-codes")
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("key").asc()]
    ordered = coded.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "turn", "codes")
    kinds = {"id": coded.schema["conv_id"].dataType.simpleString(), "turn": coded.schema["turn"].dataType.simpleString()}
    pieces = ordered.mapInArrow(_pieces, PIECE.format(**kinds))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "at", "codes", "low", "high", "turns"))).alias("pieces"))
    return whole.mapInArrow(_repairs, REPAIRED.format(**kinds))


def _stream(batches, digest: bool):
    """Head rows (``audit`` not null) each followed by their conversation's rows in order."""
    head, edits, sha, lines = None, iter(()), None, 0

    def line(role, text):
        nonlocal lines
        piece = f"{role}:{text}"
        lines += 1
        if digest:
            sha.update((("\n" if lines > 1 else "") + piece).encode())

    def rest(rows):
        for letter, role in edits:
            if letter == "I":
                line(role, "")
                rows.append((head, lines, role, "", "I"))

    for batch in batches:
        done, rows = [], []
        for conv, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if audit is not None:
                if sha is not None:
                    rest(rows)
                    done.append((head, sha.hexdigest()))
                head, edits, sha, lines = conv, edited(audit), hashlib.sha256(), 0
                continue
            for letter, name in edits:
                if letter != "D":
                    name = role if letter == "K" else name
                    body = "" if letter == "I" else text
                    line(name, body)
                    rows.append((head, lines, name, body, letter))
                if letter != "I":
                    break
            if digest:
                rows.clear()
        yield done, rows
    if sha is not None:
        rows = []
        rest(rows)
        yield [(head, sha.hexdigest())], rows


def _in_order(df: DataFrame, repairs: DataFrame) -> DataFrame:
    key = _text_key()
    rows = _rows(df).select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", key.alias("key"))
    none = F.lit(None)
    heads = repairs.select("conv_id", "audit", none.cast(rows.schema["turn"].dataType).alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("binary").alias("key"))
    both = heads.unionByName(rows).repartition("conv_id")
    by = [F.col(c).asc_nulls_first() for c in ("turn", "role", "key")]
    return both.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("audit").desc_nulls_last(), *by).select("conv_id", "audit", "role", "text")


def repaired_rows(df: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place`` (from 1)``, role, text, edit`` per row that stays or is inserted.

    ``repairs`` is ``repair_conversations(df)``.  A conversation's rows come to one task in order and stream past its audit;
    none is held.
    """

    def run(batches):
        for _, rows in _stream(batches, False):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], ["conv_id", "place", "role", "text", "edit"])

    kind = df.schema["conv_id"].dataType
    types = [_arrow(kind), pa.int64(), pa.string(), pa.string(), pa.string()]
    return _in_order(df, repairs).mapInArrow(run, f"conv_id {kind.simpleString()}, place long, role string, text string, edit string")


def repaired_digests(df: DataFrame, repairs: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: SHA-256 of the repaired ``role:text``, joined by newlines.  A digest is made in
    sequence, so a conversation's texts pass through one task; they are hashed as they come and not held."""

    def run(batches):
        for done, _ in _stream(batches, True):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done) if done else [[]] * 2, types)], ["conv_id", "repaired_sha256"])

    kind = df.schema["conv_id"].dataType
    types = [_arrow(kind), pa.string()]
    return _in_order(df, repairs).mapInArrow(run, f"conv_id {kind.simpleString()}, repaired_sha256 string")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def damaged(df: DataFrame) -> DataFrame:
    """``df`` (``conv_id, turn, role, text``) with faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its
    text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its role user.  Nulls are one space in roles, texts and hash;
    ids and turns stay null."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = _rows(df).withColumn("fault", F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy"))
    return rows.drop("copy")
