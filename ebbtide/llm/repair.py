"""Cheapest repair of conversations over one automaton of all their endings.

The rows of a conversation become a signature, one letter per row for its role and fault. Distinct signatures are sorted
by their reversed text, so signatures with a common ending are neighbours: a task walks its range of them with the path
of the current ending on a stack, and every ending that several conversations share is one node, entered once. A node
holds, for each state of the role grammar, the cost from there to the end and the first edit of the best audit; nodes
with equal relative costs and equal edits are folded into one entry. An audit is read off by following the entries.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.session import stage

# Fixed values of the contract: costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = r"\x20\x09-\x0D"
PREFIX = 64  # characters of the text by which ranges are cut
PIECE = 4096  # rows whose letters are gathered at a time

# States: nothing written, after a leading s, after u, after a; the role that each wants next and where that leads.
START, SYSTEM, USER, ASSISTANT = range(4)
WANTS, LEADS = "uuau", (USER, USER, ASSISTANT, USER)


# --- automaton ----------------------------------------------------------------------------------------


class Automaton:
    """Entries of nodes: relative cost to go and first edit for each state, found once per letter and entry below."""

    END = 0

    def __init__(self):
        self.costs, self.moves, self.known, self.alike = [], [], {}, {}
        inserts = INSERT, 2 * INSERT
        self._add((0, inserts[1], inserts[0], 0), [("", START), ("I", USER), ("I", ASSISTANT), ("", ASSISTANT)])

    def _add(self, costs, moves) -> int:
        """The entry with these costs and moves: endings that differ but act alike share one."""
        entry = self.alike.setdefault((costs, tuple(moves)), len(self.costs))
        if entry == len(self.costs):
            self.costs.append(costs)
            self.moves.append(tuple(moves))
        return entry

    def entry(self, letter: str, below: int) -> int:
        """The node of a row in front of a shorter ending.

        From any state at most one edit of each kind can be part of a cheapest audit and their initials differ, so the
        smaller initial settles ties; inserts stay at the same row and are relaxed until nothing gets cheaper.
        """
        found = self.known.get((letter, below))
        if found is None:
            found = self.known[letter, below] = self._found(letter, self.costs[below])
        return found

    def _found(self, letter: str, below) -> int:
        best = []
        for state in range(4):
            options = [(DELETE + below[state], "D", state)]
            if letter != "x":
                cost = TRUNCATED if letter.isupper() else 0
                kept = letter.lower() == WANTS[state]
                options.append((cost + (0 if kept else REROLE) + below[LEADS[state]], "K" if kept else "R", LEADS[state]))
                if state == START and letter in "sS":
                    options.append((cost + below[SYSTEM], "K", SYSTEM))
            best.append(min(options))
        changed = True
        while changed:
            changed = False
            for state in range(4):
                option = (INSERT + best[LEADS[state]][0], "I", LEADS[state])
                if option < best[state]:
                    best[state], changed = option, True
        least = min(b[0] for b in best)
        return self._add(tuple(b[0] - least for b in best), [b[1:] for b in best])

    def audit(self, signature: str, path) -> tuple[str, int]:
        """Edits and their cost; ``path`` has the entry of every ending, the longest last."""
        edits, cost, state, at = [], 0, START, len(signature)
        while True:
            edit, state = self.moves[path[at]][state]
            if not edit:
                return "".join(edits), cost
            edits.append(edit)
            if edit == "I":
                cost += INSERT
                continue
            letter = signature[len(signature) - at]
            cost += DELETE if edit == "D" else (REROLE if edit == "R" else 0) + (TRUNCATED if letter.isupper() else 0)
            at -= 1


def audits(signatures) -> list[tuple[str, int]]:
    """Audit and cost of each signature; fastest when sorted by reversed text. The entries that neighbours share stay
    on the stack, so a common ending is entered once."""
    walk = Walk()
    return [walk.audit(s) for s in signatures]


class Walk:
    """The automaton with the path of the current signature."""

    def __init__(self):
        self.automaton, self.path, self.ending = Automaton(), array("l", [Automaton.END]), ""

    def audit(self, signature: str) -> tuple[str, int]:
        backwards = signature[::-1]
        shared = _common(backwards, self.ending)
        del self.path[shared + 1 :]
        entry, below = self.automaton.entry, self.path[-1]
        for letter in backwards[shared:]:
            below = entry(letter, below)
            self.path.append(below)
        self.ending = backwards
        return self.automaton.audit(signature, self.path)


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


# --- steps on tables ----------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) as the contract damages them; NULLs are read as one space, ids stay as they are."""
    def words(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat_ws(":", words("conv_id"), words("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(words("text"), "[.!?]", "")).otherwise(words("text"))
    return rows.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(words("role")).alias("role"), text.alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """Stage table (pos, conv_id, turn, role, text, digest): ``pos`` numbers the rows of a conversation in order.

    Ranges are cut by conversation and turn, then role and text, then by row, so that neither a hot conversation nor a
    hot row of it ends in one task.
    """
    each = rows.where("copies > 0").select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    each = each.withColumn("digest", F.unhex(F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256)))
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
    head = F.substring("text", 1, PREFIX)
    dealt = each.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys, head, "digest", "row")
    placed = dealt.sortWithinPartitions(*keys, head, "digest").withColumn("pos", F.monotonically_increasing_id())
    return stage(placed.select("pos", "conv_id", "turn", "role", "text", "digest"), "ordered")


def _letters(ordered: DataFrame) -> DataFrame:
    """Stage table (pos, conv_id, turn, fault, initial): the first fault of each row, and s, u, a or o by its role."""
    trimmed = F.regexp_extract("text", rf"([^{BLANKS}])[{BLANKS}]*\z", 1)
    initial = F.substring("role", 1, 1)
    slim = ordered.select(
        "pos", "conv_id", "turn", "digest", (trimmed == "").alias("blank"), (~trimmed.isin(".", "!", "?")).alias("cut"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
    )
    firsts = slim.where("not blank").groupBy("conv_id", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    return stage(slim.join(firsts, "pos", "left").select("pos", "conv_id", "turn", fault.alias("fault"), "initial"), "letters")


def _signatures(letters: DataFrame) -> DataFrame:
    """(conv_id, signature, roles, starts, sizes): letters of all rows, and where each gathered piece begins.

    Lower case for sound rows, upper case for truncated ones, x for rows that must go. Rows of a conversation are
    consecutive in ``pos`` within a range, so a piece of them is.
    """
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    cells = letters.select("conv_id", "pos", F.struct("pos", letter.alias("letter"), "initial").alias("cell"))
    pieces = cells.groupBy("conv_id", F.floor(F.col("pos") / PIECE).alias("piece")).agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    joined = pieces.select("conv_id", F.struct(
        F.get("cells", F.lit(0))["pos"].alias("start"), F.size("cells").cast("long").alias("size"),
        F.concat_ws("", F.col("cells.letter")).alias("letters"), F.concat_ws("", F.col("cells.initial")).alias("roles"),
    ).alias("piece"))
    gathered = joined.groupBy("conv_id").agg(F.array_sort(F.collect_list("piece")).alias("p"))
    return gathered.select(
        "conv_id", F.concat_ws("", F.col("p.letters")).alias("signature"), F.concat_ws("", F.col("p.roles")).alias("roles"),
        F.col("p.start").alias("starts"), F.col("p.size").alias("sizes"),
    )


def _solved(signatures: DataFrame) -> DataFrame:
    """Stage table (signature, audit, cost) of the distinct signatures."""
    backwards = F.reverse("signature")
    head = F.substring(backwards, 1, PREFIX)
    distinct = signatures.select("signature").distinct()
    dealt = distinct.repartitionByRange(head, F.xxhash64("signature")).sortWithinPartitions(backwards)

    def run(batches):
        walk = Walk()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                names = batch.column(0).slice(at, 256)
                found = [walk.audit(s) for s in names.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array([a for a, _ in found], pa.string()), pa.array([c for _, c in found], pa.int64())], names=["signature", "audit", "cost"])

    return stage(dealt.mapInArrow(run, "signature string, audit string, cost bigint"), "solved")


def _pairs_allowed(roles: Column) -> Column:
    return F.regexp_count(roles, F.lit("s(?=u)|u(?=a)|a(?=u)"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audits and repaired rows of (conv_id, turn, role, text, copies); a row counts ``copies`` times, none at zero.

    The first is (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row per conversation of
    ``rows``, also of those without rows (zeros and an empty audit); a NULL id is a conversation. The second is
    (conv_id, position, edit, role, text), the rows after repair, inserted ones with empty text. ``turn`` orders a
    conversation, NULL first; rows of one turn are ordered by role, then by the first 64 characters of the text, then
    by a hash. Role and text must not be NULL. Roles count by their first letter; other letters than s, u and a, and
    an empty role, fit nowhere. An empty table gives two empty ones.
    """
    ordered = _ordered(rows)
    letters = _letters(ordered)
    signatures = stage(_signatures(letters), "signatures")
    solved = stage(signatures.join(_solved(signatures), "signature"), "audited")
    facts = letters.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")],
    )
    each = rows.select("conv_id").distinct()
    told = solved.select(F.col("conv_id").alias("c"), "audit", "cost", (F.length("roles") - 1 - _pairs_allowed(F.col("roles"))).cast("long").alias("illegal"))
    counted = facts.withColumnRenamed("conv_id", "f")
    found = each.join(told, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(counted, F.col("conv_id").eqNullSafe(F.col("f")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit")), _repaired(ordered, solved)


def _repaired(ordered: DataFrame, solved: DataFrame) -> DataFrame:
    kind = solved.schema["conv_id"]
    fields = T.StructType([kind, T.StructField("position", T.LongType()), T.StructField("edit", T.StringType()),
                           T.StructField("new_role", T.StringType()), T.StructField("pos", T.LongType())])

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                signature, audit, starts, sizes = (row.column(i)[0].as_py() for i in range(1, 5))
                for columns in _written(signature, audit, starts, sizes):
                    ids = row.column(0).take(pa.array(np.zeros(len(columns[0]), np.int64)))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64())))], names=fields.names)

    edits = stage(solved.select("conv_id", "signature", "audit", "starts", "sizes").mapInArrow(run, fields), "edits")
    kept = edits.where("pos is not null").join(ordered.select("pos", "role", "text"), "pos").select(
        "conv_id", "position", "edit", F.coalesce("new_role", "role").alias("role"), "text")
    added = edits.where("pos is null").select("conv_id", "position", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return kept.unionByName(added)


def _written(signature: str, audit: str, starts, sizes):
    """Columns (position, edit, new role, pos) of the rows an audit leaves, some thousand at a time."""
    places = (start + i for start, size in zip(starts, sizes) for i in range(size))
    letters, state, position, out = iter(signature), START, 0, ([], [], [], [])
    for edit in audit:
        pos, letter = (None, "") if edit == "I" else (next(places), next(letters))
        if edit == "D":
            continue
        leading = edit == "K" and letter in "sS"
        role = None if edit == "K" else "user" if WANTS[state] == "u" else "assistant"
        state = SYSTEM if leading else LEADS[state]
        for column, value in zip(out, (position, edit, role, pos)):
            column.append(value)
        position += 1
        if len(out[0]) >= PIECE:
            yield out
            out = ([], [], [], [])
    if out[0]:
        yield out


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over ``role:text`` lines. A hash of a whole conversation runs through its rows in
    order: they are sorted by Spark and streamed, and a task holds one batch and the state of one hash."""
    import hashlib

    kind = repaired.schema["conv_id"]
    fields = T.StructType([kind, T.StructField("repaired_sha256", T.StringType())])

    def run(batches):
        open_, state = None, None
        for batch in batches:
            ids = batch.column(0)
            firsts = np.array(batch.column(1).to_pylist()) == 0
            for i, line in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                text = ":".join(line).encode("utf-8", "surrogatepass")
                if firsts[i]:
                    if state is not None:
                        yield pa.RecordBatch.from_arrays([open_, pa.array([state.hexdigest()])], names=fields.names)
                    open_, state = ids.slice(i, 1), hashlib.sha256(text)
                else:
                    state.update(b"\n" + text)
        if state is not None:
            yield pa.RecordBatch.from_arrays([open_, pa.array([state.hexdigest()])], names=fields.names)

    rows = repaired.select("conv_id", "position", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(run, fields)


def audited(conversations: DataFrame) -> DataFrame:
    """Damages ``conversations`` as the contract says, repairs them, and gives one row per conv_id with its digest.
    Columns beyond conv_id, turn, role and text are not read."""
    found, repaired = repair(damaged(conversations))
    hashed = digests(repaired).withColumnRenamed("conv_id", "c")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return found.join(hashed, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        *found.columns, F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
