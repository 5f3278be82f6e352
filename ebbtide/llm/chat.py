"""Conversations from quoting messages, in DataFrame operations throughout.

The lines of a message are cut into runs of equal quote level. What a message says itself are its lines of level 0; a
run of level 1 or more is a quoted passage. Passages and the messages' own texts, whole and in parts (runs, paragraphs,
lines), are normalised and hashed, and an equi-join finds the message a part quotes: the earliest one of the same scope
that says just that, else the earliest one with such a part. The parent of a message is what the longest linked part of
its shallowest linked level quotes; roots and depths follow by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.ranking import running_total
from ebbtide.session import release, stage

PREFIX = r"^(?:[ \t]*>)+"


def normalised(text: Column) -> Column:
    """Lower case, every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _parts(text: Column) -> Column:
    """The normalised text, its paragraphs and its lines, each once and in this order; the first may be blank."""
    lines = F.regexp_replace(F.regexp_replace(F.lower(text), r"[ \t\x0B\f\r]+", " "), " ?\n ?", "\n")
    paragraphs = F.transform(F.split(lines, "\n\n+"), lambda p: F.trim(F.translate(p, "\n", " ")))
    each = F.transform(F.split(lines, "\n"), F.trim)
    whole = normalised(text)
    several = F.array_distinct(F.concat(F.array(whole), paragraphs, each))
    return F.when(F.instr(text, "\n") > 0, several).otherwise(F.array(whole))


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, PREFIX, 0), "[^>]", ""))


def parse_quotes(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``own`` (the text of level 0), ``own_runs`` (its runs, if more than one) and ``passages``, an array of
    (place, level, passage) in reading order."""
    lines = F.transform(F.split(F.coalesce(text_col, F.lit("")), "\n"), lambda line: F.struct(
        _level(line).alias("level"), F.regexp_replace(line, PREFIX + "[ \t]?", "").alias("body")))
    rows = messages.withColumn("_lines", lines)
    starts = F.array_compact(F.transform("_lines", lambda line, i: F.when(
        (i == 0) | ~F.coalesce(F.get("_lines", i - 1)["level"] == line["level"], F.lit(False)), i)))
    rows = rows.withColumn("_starts", starts)
    runs = F.transform("_starts", lambda start, k: F.slice(
        "_lines", start + 1, F.coalesce(F.get("_starts", k + 1), F.size("_lines")) - start))
    rows = rows.withColumn("_runs", runs)

    def joined(run):
        return F.array_join(F.transform(run, lambda line: line["body"]), "\n")

    passages = F.filter(
        F.transform("_runs", lambda run, k: F.struct(
            k.alias("place"), F.get(run, F.lit(0))["level"].alias("level"), joined(run).alias("passage"))),
        lambda p: p["level"] > 0)
    own = joined(F.filter("_lines", lambda line: line["level"] == 0))
    said = F.transform(F.filter("_runs", lambda run: F.get(run, F.lit(0))["level"] == 0), joined)
    said = F.when(F.size(said) > 1, said).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"own": own, "own_runs": said, "passages": passages}).drop("_lines", "_starts", "_runs")


def link_quotes(parsed: DataFrame, scope: str, order: str) -> DataFrame:
    """(scope, order, tie, parent, parent_tie, n_linked): what each message answers; no row if no passage finds an
    earlier message.

    ``parsed`` has one row per (scope, order, tie). Whole passages, their paragraphs and their lines are looked for among
    whole texts, their runs, paragraphs and lines; blank ones link nothing. The original is the earliest message whose
    whole text is that part if that one is earlier, else the earliest message with the part. ``n_linked`` counts passages
    of which any part is found. Messages of one order do not answer each other.
    """
    said = parsed.select(scope, order, "tie", F.posexplode(F.concat(F.array("own"), "own_runs")).alias("_run", "said"))
    said = said.select(scope, order, "tie", "_run", F.posexplode(_parts(F.col("said"))).alias("_nth", "part"))
    said = said.where("part <> ''").select(
        F.col(scope).alias("_scope"), F.sha2("part", 256).alias("_hash"), F.struct(F.col(order).alias("at"), "tie").alias("_at"),
        ((F.col("_run") == 0) & (F.col("_nth") == 0)).alias("_whole"))
    originals = said.groupBy("_scope", "_hash").agg(
        F.min("_at").alias("_first"), F.min(F.when(F.col("_whole"), F.col("_at"))).alias("_just"))
    quoted = parsed.select(scope, order, "tie", F.inline("passages"))
    quoted = quoted.select(scope, order, "tie", "place", "level", F.explode(_parts(F.col("passage"))).alias("part"))
    quoted = quoted.where("part <> ''").select(
        scope, order, "tie", "place", "level", F.length("part").alias("_size"), F.sha2("part", 256).alias("_h"))
    match = (F.col(scope) == F.col("_scope")) & (F.col("_h") == F.col("_hash")) & (F.col("_first")["at"] < F.col(order))
    origin = F.when(F.col("_just")["at"] < F.col(order), F.col("_just")).otherwise(F.col("_first"))
    linked = quoted.join(originals, match).withColumn("_origin", origin)
    best = linked.groupBy(scope, order, "tie").agg(
        F.min(F.struct("level", (-F.col("_size")).alias("_size"), "place", "_origin"))["_origin"].alias("_best"),
        F.size(F.collect_set("place")).cast("long").alias("n_linked"))
    return best.select(
        scope, order, "tie", F.col("_best")["at"].alias("parent"), F.col("_best")["tie"].alias("parent_tie"), "n_linked")


def threads(links: DataFrame, scope: str, order: str) -> DataFrame:
    """(scope, order, tie, thread, thread_tie, depth): the first message above each one and the replies between them.

    Every round doubles how far a message sees, so a chain of n replies takes about log2(n) rounds.
    """
    state = stage(links.select(
        scope, order, "tie", F.col("parent").alias("up"), F.col("parent_tie").alias("up_tie"),
        F.coalesce("parent", order).alias("thread"), F.coalesce("parent_tie", "tie").alias("thread_tie"),
        F.col("parent").isNotNull().cast("long").alias("depth")), "threads")
    columns = [scope, order, "tie", "up", "up_tie", "thread", "thread_tie", "depth"]
    while not state.where("up is not null").isEmpty():
        above = state.select(
            F.col(scope).alias("_scope"), F.col(order).alias("_at"), F.col("tie").alias("_tie"), F.col("up").alias("_up"),
            F.col("up_tie").alias("_up_tie"), F.col("thread").alias("_thread"), F.col("thread_tie").alias("_thread_tie"),
            F.col("depth").alias("_depth"))
        climbing = state.where("up is not null")  # whoever sees the root already is not joined again
        same = (F.col(scope) == F.col("_scope")) & (F.col("up") == F.col("_at")) & (F.col("up_tie") == F.col("_tie"))
        met = climbing.join(above, same, "left")
        met = met.select(
            scope, order, "tie", F.col("_up").alias("up"), F.col("_up_tie").alias("up_tie"),
            F.coalesce("_thread", "thread").alias("thread"), F.coalesce("_thread_tie", "thread_tie").alias("thread_tie"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"))
        further = stage(met.unionByName(state.where("up is null").select(*columns)), "threads")
        release(state)
        state = further
    return state.drop("up", "up_tie")


def conversations(messages: DataFrame, scope: str = "conv_id", order: str = "turn", role: str = "role",
                  text_col: str = "text") -> DataFrame:
    """One row per message: (scope, order, role, parent, thread, depth, position, n_quotes, n_linked, text, formatted).

    ``text`` has no quotes, ``formatted`` puts the role before it, ``position`` counts from 0 in reply order within the
    thread, where replies follow what they answer. ``parent`` and ``thread`` are values of ``order``. A message whose
    quotes find nothing starts a thread. Rows equal in scope, order, role and text are one message; different ones of one
    (scope, order) are all kept, and a hash of role and text decides their order. NULL and empty texts say and quote
    nothing. A row with a NULL scope or order links nothing: each is a thread of its own, equal ones too, with NULL where
    its order would stand. An empty table gives an empty one. Other columns are not read.
    """
    rows = messages.select(
        F.col(scope).alias("scope"), F.col(order).alias("ord"), F.col(role).alias("role"), F.col(text_col).alias("text"))
    lone = F.when(F.col("scope").isNull() | F.col("ord").isNull(), F.monotonically_increasing_id())
    rows = rows.withColumn("_lone", lone).distinct().drop("_lone")
    tie = F.xxhash64(F.col("role").isNull(), "role", F.col("text").isNull(), "text")  # a NULL alone leaves no mark
    parsed = stage(parse_quotes(rows.withColumn("tie", tie)).drop("text"), "parsed")
    key = ["scope", "ord", "tie"]
    links = parsed.select(*key).where("scope is not null and ord is not null")
    links = stage(links.join(link_quotes(parsed, "scope", "ord"), key, "left"), "links")
    placed = threads(links, "scope", "ord")
    placed = running_total(placed, ["scope", "thread", "thread_tie"], ["ord", "tie"], F.lit(1).cast("long"), "position")
    known = links.join(placed, key, "inner").select(
        *[F.col(k).alias(f"_{k}") for k in key], "parent", "thread", "depth", "position", "n_linked")
    found = parsed.join(known, [F.col(k) == F.col(f"_{k}") for k in key], "left")
    return found.select(
        F.col("scope").alias(scope), F.col("ord").alias(order), F.col("role").alias(role), "parent",
        F.coalesce("thread", "ord").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("position", F.lit(0)).alias("position"), F.size("passages").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("own").alias(text_col),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), "own", F.lit("\n")).alias("formatted"),
    )


def quoting_messages(turns: DataFrame, scope: str = "conv_id", order: str = "turn", text_col: str = "text") -> DataFrame:
    """The turns as mail: each one's text is followed by the turn before it at level 1 and that one's at level 2."""
    rows = turns.select(scope, order, "role", text_col)
    said = rows.groupBy(scope, order).agg(F.min(text_col).alias("_said"))

    def before(df: DataFrame, n: int) -> DataFrame:
        earlier = said.select(F.col(scope).alias("_s"), (F.col(order) + n).alias("_o"), F.col("_said").alias(f"_before{n}"))
        return df.join(earlier, (F.col(scope) == F.col("_s")) & (F.col(order) == F.col("_o")), "left").drop("_s", "_o")

    def marked(column: str, sign: str) -> Column:
        return F.concat(F.lit("\n" + sign), F.regexp_replace(column, "\n", "\n" + sign))

    mail = before(before(rows, 1), 2)
    body = F.concat(text_col, F.coalesce(marked("_before1", "> "), F.lit("")), F.coalesce(marked("_before2", "> > "), F.lit("")))
    return mail.select(scope, order, "role", body.alias(text_col))
