"""Quotation linking: conversations in reply order, their messages without quotes.

A line that begins with ``>`` marks (blanks between them allowed) is quoted, its level the number of marks. Every quoted
line is normalised (marks and outer blanks off, inner white space one blank, lower case) and hashed; it belongs to the
latest earlier message of the conversation that holds the line itself, unquoted. A message answers the message that most
of its level-1 lines come from (the latest of several); if no level-1 line is found, the one most of its deeper lines
come from; without a found quote, the message before it. Turn order then gives depth and the path from the first message.

Links are found by equi-joins and windows on (conversation, line hash), restricted to lines that are quoted somewhere;
no pairs of messages are made. Only built-in column functions are used. Null texts are empty. Rows without conv_id or turn
are returned with null parent. Of rows that repeat (conv_id, turn) each keeps its text; they share parent and depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from woonvonk.llm.common import table, written

MARKS = r"^[ \t]*(?:>[ \t]*)+"
# An attribution line such as "On 3 May Ann wrote:" directly before a quote goes with it.
ATTRIBUTION = r"(?:wrote|schrieb|écrit|escribió) ?:[ \t]*$"
# Rounds of pointer doubling for depth: enough for 2^40 replies in a row.
ROUNDS = 40


def line_level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.translate(marks, ">", ""))


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"\s+", " ")))


def line_hash(line: Column) -> Column:
    return F.md5(normal(line).cast("binary"))


def own_text(text: Column) -> Column:
    """The text without quoted lines, without attributions before them, and without blank lines at both ends."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    after = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    kept = F.filter(
        F.zip_with(
            lines, after,
            lambda a, b: F.when((line_level(a) > 0) | (a.rlike(ATTRIBUTION) & (line_level(F.coalesce(b, F.lit(""))) > 0)), F.lit(None)).otherwise(a),
        ),
        lambda x: x.isNotNull(),
    )
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"^(?:[ \t]*\n)+", ""), r"\s+$", "")


def parents(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, n_quoted, n_linked): one row per message key."""
    keyed = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    lines = keyed.select("conv_id", "turn", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    lines = lines.select("conv_id", "turn", line_level(F.col("line")).alias("level"), line_hash(F.col("line")).alias("h"), normal(F.col("line")).alias("n"))
    quoted = lines.where("level > 0 AND n <> ''").groupBy("conv_id", "turn", "h").agg(F.min("level").alias("level"), F.count("*").alias("times"))
    quoted = written(quoted, "quoted-lines")
    # messages that hold a line which some message of the conversation quotes
    wanted = quoted.select("conv_id", "h").distinct()
    origin = lines.where("level = 0 AND n <> ''").join(wanted, ["conv_id", "h"], "left_semi").select("conv_id", "turn", "h").distinct()
    events = origin.select("conv_id", "h", "turn", F.lit(None).cast("long").alias("times"), F.lit(None).cast("int").alias("level"), F.col("turn").alias("source")).union(
        quoted.select("conv_id", "h", "turn", "times", F.col("level").cast("int"), F.lit(None).cast("long"))
    )
    earlier = Window.partitionBy("conv_id", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    linked = events.withColumn("from_turn", F.max("source").over(earlier)).where("times IS NOT NULL")
    per_source = linked.groupBy("conv_id", "turn", "from_turn").agg(
        F.sum("times").alias("n"), F.coalesce(F.sum(F.expr("CASE WHEN level = 1 THEN times END")), F.lit(0)).alias("n1")
    )
    best = per_source.groupBy("conv_id", "turn").agg(
        F.max_by("from_turn", F.when(F.col("from_turn").isNotNull(), F.struct((F.col("n1") > 0).alias("direct"), "n1", "n", "from_turn"))).alias("quoted_turn"),
        F.sum("n").alias("n_quoted"),
        F.coalesce(F.sum(F.expr("CASE WHEN from_turn IS NOT NULL THEN n END")), F.lit(0)).alias("n_linked"),
    )
    keys = keyed.select("conv_id", "turn").distinct()
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return (
        keys.withColumn("before", before)
        .join(best, ["conv_id", "turn"], "left")
        .select(
            "conv_id", "turn", F.coalesce("quoted_turn", "before").alias("parent"),
            F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        )
    )


def depths(tree: DataFrame) -> DataFrame:
    """``tree`` with ``root`` and ``depth``, by pointer doubling: each round an equi-join, rounds the log of the depth.

    Conversations without quotes are chains; their depth is the place in turn order and needs no round.
    """
    bent = F.max(F.when(F.col("n_linked") > 0, 1).otherwise(0)).over(Window.partitionBy("conv_id"))
    staged = written(tree.withColumn("bent", bent), "quoted-tree")
    in_order = Window.partitionBy("conv_id").orderBy("turn")
    chains = staged.where("bent = 0").select(
        "conv_id", "turn", F.min("turn").over(in_order).alias("root"), (F.row_number().over(in_order) - 1).cast("long").alias("depth")
    )
    now = staged.where("bent = 1").select(
        "conv_id", "turn", F.coalesce("parent", "turn").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps")
    )
    for _ in range(ROUNDS):
        now = written(now, "quoted-depths")
        if not now.where("steps > 0").limit(1).count():
            break
        far = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("up2"), F.col("steps").alias("steps2"))
        jumped = now.join(far, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("t")))
        after = jumped.select("conv_id", "turn", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("steps2") > 0).alias("moved"))
        after = written(after, "quoted-depths")
        now = after.drop("moved")
        if not after.where("moved").limit(1).count():
            break
    found = chains.union(now.select("conv_id", "turn", F.col("up").alias("root"), F.col("steps").alias("depth")))
    return staged.drop("bent").join(found, ["conv_id", "turn"])


def linked(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text, ...) with parent, root, depth, n_quoted, n_linked and text without quotes."""
    added = ["parent", "root", "depth", "n_quoted", "n_linked"]
    kept = [c for c in messages.columns if c not in added]
    out = messages.select(*kept).join(depths(parents(messages)), ["conv_id", "turn"], "left")
    return out.select(*[own_text(F.col("text")).alias("text") if c == "text" else F.col(c) for c in kept], *added)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "conversations"))


OP7_SQL = r"""
WITH RECURSIVE l AS (
  SELECT conv_id, turn, pos, line, length(marks) - length(replace(marks, '>', '')) AS level,
    lower(trim(regexp_replace(regexp_replace(line, '^[ \t]*(?:>[ \t]*)+', ''), '\s+', ' ', 'g'))) AS n
  FROM (SELECT *, regexp_extract(line, '^[ \t]*(?:>[ \t]*)+') AS marks FROM (
    SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
      unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM conversations))),
q AS (SELECT conv_id, turn, n, min(level) AS level, count(*) AS times FROM l WHERE level > 0 AND n <> '' GROUP BY conv_id, turn, n),
src AS (
  SELECT q.conv_id, q.turn, q.n, any_value(q.level) AS level, any_value(q.times) AS times, max(o.turn) AS from_turn
  FROM q LEFT JOIN l o ON o.level = 0 AND o.conv_id = q.conv_id AND o.n = q.n AND o.turn < q.turn GROUP BY q.conv_id, q.turn, q.n),
per AS (
  SELECT conv_id, turn, from_turn, sum(times) AS n, sum(CASE WHEN level = 1 THEN times ELSE 0 END) AS n1
  FROM src GROUP BY conv_id, turn, from_turn),
best AS (
  SELECT conv_id, turn, arg_max(from_turn, (n1 > 0, n1, n, from_turn)) FILTER (WHERE from_turn IS NOT NULL) AS quoted_turn,
    sum(n) AS n_quoted, sum(CASE WHEN from_turn IS NOT NULL THEN n ELSE 0 END) AS n_linked FROM per GROUP BY conv_id, turn),
tree AS (
  SELECT k.conv_id, k.turn, coalesce(b.quoted_turn, k.before) AS parent, coalesce(b.n_quoted, 0) AS n_quoted,
    coalesce(b.n_linked, 0) AS n_linked
  FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) k
  LEFT JOIN best b ON b.conv_id = k.conv_id AND b.turn = k.turn),
walk AS (
  SELECT conv_id, turn, turn AS root, cast(0 AS bigint) AS depth FROM tree WHERE parent IS NULL
  UNION ALL SELECT t.conv_id, t.turn, w.root, w.depth + 1 FROM tree t JOIN walk w ON w.conv_id = t.conv_id AND w.turn = t.parent),
own AS (
  SELECT conv_id, turn, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '') AS text FROM (
    SELECT *, level > 0 OR (regexp_matches(line, '(?:wrote|schrieb|écrit|escribió) ?:[ \t]*$')
      AND coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY pos), 0) > 0) AS lost FROM l) GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, m.role, regexp_replace(regexp_replace(o.text, '^(?:[ \t]*\n)+', ''), '\s+$', '') AS text, t.parent, w.root,
  w.depth, cast(t.n_quoted AS bigint) AS n_quoted, cast(t.n_linked AS bigint) AS n_linked
FROM conversations m JOIN own o ON o.conv_id = m.conv_id AND o.turn = m.turn
JOIN tree t ON t.conv_id = m.conv_id AND t.turn = m.turn JOIN walk w ON w.conv_id = m.conv_id AND w.turn = m.turn"""
