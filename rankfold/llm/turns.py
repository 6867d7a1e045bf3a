"""Repair of conversation structure by alignment to the grammar `(system? (user assistant)+)?`.

A turn's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier in the conversation),
truncated (its last character that is not white space ends no sentence). Edits of a turn: keep (0), rerole to user or assistant (2),
delete (3, the only one for blank and duplicate turns); user or assistant turns without text are inserted anywhere (2). A
truncated turn that stays costs 1 more. Of the cheapest edits the ones whose initials D, I, K, R are least in ASCII win.

The turns are aligned by Wagner-Fischer tables to the alternating string of each feasible length. The cheapest alignment so far
bounds the lengths that are still tried and the band of diagonals that Ukkonen's argument leaves open; tables hold the
cost to the end, so tracing from the start with the least letter first gives a length's least audit, and audits of equal cost are compared.

A conversation of any length is spread: turns are sorted by ranges, cut to pieces of at most `PIECE` turns, and a piece is
aligned for each state the grammar can be in at its start. A piece's audit ends with an edit of its last turn, so audits of
one piece are no prefixes of one another and the least audit of a conversation is made of the pieces' least ones. What pieces pass on
(16 numbers up, a state down) is folded in order in constant memory, and so are the digests that the report asks for, as SHA-256
reads its input in order; nothing holds a conversation whole, but for the strings that are the result.

Defined cases: turns are read by turn, nulls first, ties by role and text, repeated rows one after the other; a null role is
one space, which no grammar allows; a null or empty text is blank; a null conversation id is a conversation; roles count by their
first letter (s, u, a); very long texts are never gathered; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rankfold.llm.common import SPACES, materialize

#: Turns in a piece: a power of two.
PIECE_BITS = 6
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
INF = 1 << 40
#: States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Cost of what the end of a conversation still lacks in each state, always insertions.
AT_END = (0, 2 * INSERT, INSERT, 0)
ROLE = {"u": "user", "a": "assistant"}


def targets(state: int, length: int) -> list[tuple[str, int]]:
    """Strings of that length that the grammar allows from a state on, each with the state it leads to."""
    if length == 0:
        return [("", state)]
    first = 1 if state == USER else 0
    plain = ("ua" * (length // 2 + 1))[first:first + length]
    out = [(plain, USER if plain[-1] == "u" else ASSISTANT)]
    if state == START:
        rest = targets(SYSTEM, length - 1)[0]
        out.append(("s" + rest[0], rest[1]))
    return out


def align(codes: str, target: str, limit: int) -> tuple[int, list[list[int]], int] | None:
    """Cost table of turns against a target, or None beyond the limit: `(cost, rows, offset)` with the cost to the end in
    `rows[i][j - i + offset]`. No insertion follows the last turn.

    A code is the initial, upper case if truncated, or `d` for a turn that must go. A way to diagonal k and on to the last one costs at
    least 2 a step up and 3 a step down, which gives the band.
    """
    n, m = len(codes), len(target)
    last = m - n
    high = max(max(0, last), (limit + DELETE * last) // (INSERT + DELETE))
    low = min(min(0, last), -((limit - INSERT * last) // (INSERT + DELETE)))
    high, low = min(high, m), max(low, -n)
    width = high - low + 1
    rows = [[INF] * (width + 1) for _ in range(n + 1)]
    rows[n][last - low] = 0
    for i in range(n - 1, -1, -1):
        code, row, under = codes[i], rows[i], rows[i + 1]
        late = TRUNCATED if code.isupper() else 0
        initial = code.lower()
        for k in range(min(high, m - i), max(low, -i) - 1, -1):
            at = k - low
            best = under[at - 1] + DELETE if at else INF  # the same j lies one diagonal lower in the next row
            if initial != "d" and i + k < m:
                want = target[i + k]
                step = KEEP if initial == want else INF if want == "s" else REROLE
                best = min(best, under[at] + step + late)
            if k < high:
                best = min(best, row[at + 1] + INSERT)
            row[at] = best
    cost = rows[0][-low]
    return (cost, rows, -low) if cost <= limit else None


def trace(codes: str, target: str, table: tuple[int, list[list[int]], int]) -> str:
    """The least audit of an alignment: at each step the first of D, I, K, R that lies on a cheapest way."""
    _, rows, offset = table
    n, m, i, j, out = len(codes), len(target), 0, 0, []
    while i < n:
        here, code = rows[i][j - i + offset], codes[i]
        late = TRUNCATED if code.isupper() else 0
        at = j - i + offset
        if at and rows[i + 1][at - 1] + DELETE == here:
            out.append("D")
            i += 1
        elif j < m and rows[i][at + 1] + INSERT == here:
            out.append("I")
            j += 1
        else:
            out.append("K" if code.lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return "".join(out)


@lru_cache(maxsize=1 << 15)
def best_edits(codes: str, state: int, ahead: tuple[int, ...]) -> tuple[int, str, int]:
    """`(cost, audit, state after)` of a piece entered in `state`, where `ahead` says what follows from each state after it."""
    free = sum(c != "d" for c in codes)
    forced, best = DELETE * (len(codes) - free), (INF, "", START)
    # Lengths near the number of turns that may stay come first, so the limit is low early.
    for length in sorted(range(2 * len(codes) + 3), key=lambda n: abs(n - free)):
        least = forced + (INSERT * (length - free) if length > free else DELETE * (free - length))
        for target, after in targets(state, length):
            if ahead[after] >= INF or least + ahead[after] > best[0]:
                continue
            table = align(codes, target, min(best[0] - ahead[after], DELETE * len(codes) + INSERT * (length + 1)))
            if table is not None:
                best = min(best, (table[0] + ahead[after], trace(codes, target, table), after))
    return best


@lru_cache(maxsize=1 << 13)
def transfer(codes: str) -> tuple[tuple[int, ...], ...]:
    """Cheapest cost of a piece from each state to each state."""
    only = [tuple(0 if x == y else INF for y in range(4)) for x in range(4)]
    return tuple(tuple(best_edits(codes, state, only[after])[0] for after in range(4)) for state in range(4))


def normalised(turns: DataFrame, conv_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    """`(conv, turn, role, text)`, nulls of role and text as one space."""
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(F.col(conv_column).alias("conv"), F.col(turn_column).cast("long").alias("turn"), fill(role_column).alias("role"),
                        fill(text_column).alias("text"))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """Stored `(conv, turn, role, text, at, fault)` of normalised turns; `at` numbers all turns in the order they are read.

    The number of the scanned row is the last sort key, so that copies of one row may lie in several ranges.
    """
    keys = [F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("copy")]
    by_range = turns.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    bare = F.rtrim("text", F.lit(SPACES))
    end = F.substring(bare, -1, 1)
    fault = F.when(bare == "", "blank").when(~end.isin(".", "!", "?"), "truncated")
    return materialize(by_range.select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("at"), fault.alias("fault")))


def _seen_key() -> Column:
    """Role and text as one narrow value."""
    return F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)


def coded_turns(ordered: DataFrame) -> DataFrame:
    """`(conv, at, fault, code)` of all turns, duplicates found. Copies are combined before the shuffle."""
    narrow = ordered.select("conv", "at", "fault", F.substring("role", 1, 1).alias("initial"), F.when(
        F.coalesce("fault", F.lit("")) != "blank", _seen_key()).alias("key"))
    first = narrow.filter("key is not null").groupBy("conv", "key").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.col("conv").alias("_c"), F.col("key").alias("_k"), "first")
    joined = narrow.join(first, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("key") == F.col("_k")), "left")
    fault = F.when(F.col("at") > F.col("first"), "duplicate").otherwise(F.col("fault"))
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    return joined.select("conv", "at", fault.alias("fault"), initial.alias("initial")).select("conv", "at", "fault", code.alias("code"))


def pieces(coded: DataFrame) -> DataFrame:
    """Stored `(conv, at, codes, faults)`: at most 2^PIECE_BITS turns each, `at` is that of the first one."""
    return materialize(coded.groupBy("conv", F.shiftright("at", PIECE_BITS).alias("piece")).agg(
        F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "code", "fault"))).alias("t")).select(
        "conv", "at", F.array_join(F.transform("t", lambda t: t["code"]), "").alias("codes"),
        F.array_join(F.transform("t", lambda t: F.coalesce(F.substring(t["fault"], 1, 1), F.lit("-"))), "").alias("faults")))


def _rows(batch: pa.RecordBatch):
    return zip(*(c.to_pylist() for c in batch.columns))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)] if rows else [pa.nulls(0, t.type) for t in schema], schema=schema)


def _in_order(df: DataFrame, down: bool = False) -> DataFrame:
    """Conversations as runs of rows, `at` rising or falling."""
    return df.repartition("conv").sortWithinPartitions("conv", F.desc("at") if down else F.asc("at"))


def audited_pieces(piece: DataFrame) -> DataFrame:
    """`(conv, at, codes, faults, state, audit, cost)` of every piece: the state it is entered in and its part of the audit.

    A conversation in one piece is aligned at once. Of the others, all pieces are aligned side by side before and after two folds.
    """
    many = piece.groupBy("conv").agg(F.count("*").alias("n"), F.max("at").alias("last")).filter("n > 1").select(F.col("conv").alias("_c"))
    same = F.col("conv").eqNullSafe(F.col("_c"))
    alone = piece.join(many, same, "left_anti")
    spread = materialize(piece.join(many, same, "left_semi"))
    fields = [(f.name, f.dataType.simpleString()) for f in piece.schema.fields]
    base = ", ".join(f"{a} {b}" for a, b in fields)

    def extended(batches, names: list[str], types: list[pa.DataType], make):
        for batch in batches:
            made = [make(row) for row in _rows(batch)]
            extra = [pa.array(c, t) for c, t in zip(zip(*made), types)] if made else [pa.nulls(0, t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])

    def solve(batches):
        def make(row):
            cost, audit, after = best_edits(row[2], START, AT_END)
            return START, audit + "I" * (AT_END[after] // INSERT), cost
        yield from extended(batches, ["state", "audit", "cost"], [pa.int32(), pa.string(), pa.int64()], make)

    def measure(batches):
        yield from extended(batches, ["steps"], [pa.list_(pa.int64())], lambda row: ([x for line in transfer(row[2]) for x in line],))

    def fold_back(batches):
        """What lies ahead of each piece, from the last piece on."""
        held, ahead = object(), AT_END
        for batch in batches:
            out = []
            for c, steps in zip(batch.column(0).to_pylist(), batch.column(batch.schema.get_field_index("steps")).to_pylist()):
                if c != held:
                    held, ahead = c, AT_END
                out.append(list(ahead))
                ahead = tuple(min(min(steps[4 * s + t] + ahead[t] for t in range(4)), INF) for s in range(4))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names[:4], "ahead"])

    def offer(batches):
        """Audit and next state for each state a piece may be entered in."""
        def make(row):
            ahead = tuple(row[4])
            # Counted from the least, so that pieces with like continuations share their answers.
            least = min(ahead)
            found = [best_edits(row[2], s, tuple(min(x - least, INF) for x in ahead)) for s in range(4)]
            return [f[1] for f in found], [f[2] for f in found]
        for batch in extended(batches, ["audits", "after"], [pa.list_(pa.string()), pa.list_(pa.int32())], make):
            yield batch.drop_columns(["ahead"])

    def fold_on(batches):
        held, state = object(), START
        for batch in batches:
            out = []
            for c, _, _, _, audits, after in _rows(batch):
                if c != held:
                    held, state = c, START
                out.append((state, audits[state], after[state]))
                state = after[state]
            part = _batch(out, pa.schema([("state", pa.int32()), ("audit", pa.string()), ("after", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *part.columns], names=[*batch.schema.names[:4], *part.schema.names])

    ends = piece.groupBy("conv").agg(F.max("at").alias("last")).select(F.col("conv").alias("_c"), "last")
    ahead = _in_order(spread.mapInArrow(measure, f"{base}, steps array<bigint>"), down=True).mapInArrow(fold_back, f"{base}, ahead array<bigint>")
    offers = materialize(ahead.mapInArrow(offer, f"{base}, audits array<string>, after array<int>"))
    chosen = _in_order(offers).mapInArrow(fold_on, f"{base}, state int, audit string, after int")
    tail = F.when(F.col("at") == F.col("last"), F.repeat(F.lit("I"), F.when(F.col("after") == SYSTEM, 2).when(F.col("after") == USER, 1).otherwise(0)))
    chosen = chosen.join(ends, same).select(*[n for n, _ in fields], "state", F.concat("audit", F.coalesce(tail, F.lit(""))).alias("audit"))
    done = alone.mapInArrow(solve, f"{base}, state int, audit string, cost bigint").drop("cost")
    return materialize(done.unionByName(chosen))


def _walk(ordered: DataFrame, audited: DataFrame, emit, schema: str) -> DataFrame:
    """Each piece, then its turns, in the order of conversations; `emit` reads batches of `(conv, at, kind, state, audit, faults, turn, role, text)`."""
    heads = audited.select("conv", "at", F.lit(0).alias("kind"), "state", "audit", "faults", F.lit(None).cast("long").alias("turn"),
                           F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    bodies = ordered.select("conv", "at", F.lit(1).alias("kind"), F.lit(0).alias("state"), F.lit(None).cast("string").alias("audit"),
                            F.lit(None).cast("string").alias("faults"), "turn", "role", "text")
    return heads.unionByName(bodies).repartition("conv").sortWithinPartitions("conv", "at", "kind").mapInArrow(emit, schema)


class _Editor:
    """Applies a piece's audit to its turns one by one."""

    def __init__(self):
        self.audit, self.place, self.state = "", 0, START

    def open(self, state: int, audit: str):
        self.audit, self.place, self.state = audit, 0, state

    def _next(self) -> str:
        return "a" if self.state == USER else "u"

    def inserted(self):
        """Roles of the turns put in here."""
        while self.place < len(self.audit) and self.audit[self.place] == "I":
            self.place += 1
            role = self._next()
            self.state = USER if role == "u" else ASSISTANT
            yield ROLE[role]

    def turn(self, role: str) -> tuple[str, str | None]:
        """Edit of the turn and its role after it, None if it goes."""
        edit = self.audit[self.place]
        self.place += 1
        if edit == "D":
            return edit, None
        initial = self._next() if edit == "R" else role[:1]
        self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[initial]
        return edit, ROLE[initial] if edit == "R" else role


def repair(turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """The repaired conversations, one row per turn and edit: `(conv, at, edit, turn, role, text, fault)`.

    `at` orders the turns; inserted ones share the number of the turn they precede, or of the last one, in the order of `part`. Deleted turns are
    listed with edit `D` and a null role.
    """
    ordered = ordered_turns(normalised(turns, conv_column, turn_column, role_column, text_column))
    audited = audited_pieces(pieces(coded_turns(ordered)))
    kind = ordered.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, at bigint, part int, edit string, turn bigint, role string, text string, fault string"

    def emit(batches):
        editor, faults, seen = _Editor(), "", 0
        for batch in batches:
            kept = []
            for c, at, k, state, audit, found, turn, role, text in _rows(batch):
                if not k:
                    editor.open(state, audit)
                    faults, seen = found, 0
                    continue
                part = -1
                for part, put in enumerate(editor.inserted()):
                    kept.append((c, at, part, "I", None, put, "", None))
                edit, now = editor.turn(role)
                kept.append((c, at, part + 1, edit, turn, now, text, NAMES.get(faults[seen])))
                seen += 1
                if seen == len(faults):
                    for part, put in enumerate(editor.inserted(), part + 2):
                        kept.append((c, at, part, "I", None, put, "", None))
            conv = batch.schema.field("conv").type
            yield _batch(kept, pa.schema([("conv", conv), ("at", pa.int64()), ("part", pa.int32()), ("edit", pa.string()), ("turn", pa.int64()),
                                          ("role", pa.string()), ("text", pa.string()), ("fault", pa.string())]))

    return _walk(ordered, audited, emit, schema)


NAMES = {"b": "blank", "d": "duplicate", "t": "truncated"}
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """`(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)` of each conversation that has turns."""
    ordered = ordered_turns(normalised(turns, conv_column, turn_column, role_column, text_column))
    audited = audited_pieces(pieces(coded_turns(ordered)))
    kind = ordered.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired_sha256 string"

    def emit(batches):
        held, state = object(), None
        for batch in batches:
            done = []
            for c, _, k, entered, audit, found, turn, role, text in _rows(batch):
                if c != held:
                    if state is not None:
                        done.append((held, *state.row()))
                    held, state = c, _Summary()
                if k:
                    state.turn(turn, role, text)
                else:
                    state.piece(entered, audit, found)
            yield _batch(done, out := pa.schema([("conv", batch.schema.field("conv").type), *((x, pa.int64()) for x in _COUNTS),
                                                 ("audit", pa.string()), ("repaired_sha256", pa.string())]))
        if state is not None:
            yield _batch([(held, *state.row())], out)

    return _walk(ordered, audited, emit, schema)


class _Summary:
    """Counts and digest of one conversation, turn by turn."""

    def __init__(self):
        self.editor, self.audit, self.digest = _Editor(), [], hashlib.sha256()
        self.count = {"b": 0, "d": 0, "t": 0, "-": 0}
        self.least = self.last = self.initial = None
        self.distinct = self.illegal = self.cost = self.lines = self.left = self.seen = 0
        self.faults = ""

    def piece(self, state: int, audit: str, faults: str):
        self.editor.open(state, audit)
        self.audit.append(audit)
        self.faults, self.seen = faults, 0
        for f in faults:
            self.count[f] += 1

    def line(self, role: str, text: str):
        self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def turn(self, turn: int | None, role: str, text: str):
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.distinct += turn != self.last
            self.last = turn
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self._put()
        edit, now = self.editor.turn(role)
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE}[edit] + (TRUNCATED if edit != "D" and self.faults[self.seen] == "t" else 0)
        if now is not None:
            self.line(now, text)
        self.seen += 1
        if self.seen == len(self.faults):
            self._put()

    def _put(self):
        for role in self.editor.inserted():
            self.cost += INSERT
            self.line(role, "")

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.distinct
        return (gaps, self.count["b"], self.count["d"], self.count["t"], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def damage(conversations: DataFrame) -> DataFrame:
    """The query's test bed: turns dropped, emptied, cut off, repeated or given a wrong role by crc32 of `conv_id:turn`; nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    rows = rows.withColumn("text", F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", F.explode(copies)).drop("col")


def damaged_report(conversations: DataFrame) -> DataFrame:
    """The report of every conversation of the table after the damage; one that lost all turns has zeros and an empty audit."""
    found = report(damage(conversations)).withColumnRenamed("conv", "_c")
    every = conversations.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


_BEST = lambda *options: f"list_min([{', '.join(options)}])"


def _sql() -> str:
    """The same by an automaton: the cheapest audit in each state of the grammar, turn after turn."""
    def step(state: str, cost: str, letters: str, lines: str) -> str:
        return f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letters}', 'body': {state}.body || {lines}}}"

    nothing = "{'cost': 1000000, 'audit': '', 'body': ''}"
    kept, rerole = "chr(10) || r.role || ':' || r.text", "chr(10) || '{}:' || r.text"
    put = "chr(10) || '{}:' || "

    def into(initial: str, before: tuple[str, ...], inserting: tuple[str, ...], role: str) -> str:
        """Ways to end a turn as `initial`, from a state before it or with one turn put in."""
        other = "assistant" if role == "user" else "user"
        free = []
        for state in before:
            free += [f"CASE WHEN r.initial = '{initial}' THEN {step('p.' + state, 'r.late', 'K', kept)} ELSE {step('p.' + state, '2 + r.late', 'R', rerole.format(role))} END"]
        for state in inserting:
            free += [f"CASE WHEN r.initial = '{initial}' THEN {step('p.' + state, '2 + r.late', 'IK', put.format(other) + kept)} "
                     f"ELSE {step('p.' + state, '4 + r.late', 'IR', put.format(other) + rerole.format(role))} END"]
        return f"list_min(list_concat([{step('p.' + {'user': 'u', 'assistant': 'a'}[role], '3', 'D', chr(39) * 2)}], CASE WHEN r.goes THEN [] ELSE [{', '.join(free)}] END))"

    start = f"CASE WHEN true THEN {step('p.b', '3', 'D', chr(39) * 2)} END"
    system = (f"list_min(list_concat([{step('p.s', '3', 'D', chr(39) * 2)}], CASE WHEN r.goes OR r.initial <> 's' THEN [] "
              f"ELSE [{step('p.b', 'r.late', 'K', kept)}] END))")
    user, assistant = into("u", ("b", "s", "a"), ("u",), "user"), into("a", ("u",), ("b", "s", "a"), "assistant")
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, x:
    CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) t(i))),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1]))) % 20 AS kind FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
faults AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
coded AS (
  SELECT conv_id, i, role, text, role[1] AS initial, coalesce(fault IN ('blank', 'duplicate'), false) AS goes,
    CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS late FROM faults),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faults GROUP BY conv_id),
ways AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'cost': 0, 'audit': '', 'body': ''}} AS b, {nothing} AS s, {nothing} AS u, {nothing} AS a FROM damaged
  UNION ALL
  SELECT p.conv_id, r.i, {start}, {system}, {user}, {assistant} FROM ways p JOIN coded r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1),
ended AS (
  SELECT w.conv_id, c.*, {_BEST('w.b', 'w.a', step('w.u', '2', 'I', put.format('assistant') + repr('')), step('w.s', '4', 'II', put.format('user') + put.format('assistant') + repr('')))} AS best
  FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.body[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


SQL = _sql()
