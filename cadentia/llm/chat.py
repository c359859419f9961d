r"""Conversations as marked-up text with a loss mask, proved by reading the text back.

A turn is written as ``### role: text</turn>`` and a line feed. The parser is deterministic: it cuts
at every ``### ``, reads the role up to the first ``: `` and the text up to the first ``</turn>``,
after which nothing but the line feed may follow; then it drops every ``\.`` and makes every
``\-`` a backslash. Each turn is first written as it stands and read back. Where the result
differs from the source, backslashes are written as ``\-``, and where that is not enough, ``\.`` goes
into every control string. The last form is always read back as its source: it
holds no control string, and every backslash in it is followed by a hyphen or a full stop.

The output has one row per part of a conversation: ``conv_id, part, formatted, spans``. A span says
where a turn begins and which code points of it carry loss (assistant turns; else none).

Scale: the form of each turn is found inside the scan, then one shuffle brings a conversation's
turns together. A conversation of more than ``most`` rows is cut into several parts along its
order, by ranges over all rows of such conversations, so no task collects it; only the digest over
a whole conversation, which is sequential, sees its finished parts in one place. A digest or a part
is limited to the 2 GB of a string.

Edge cases: null role and text count as empty. Rows with a null conv_id are one conversation. Turns of
equal number, and null ones, which come first, are ordered by a digest of role and text, so repeated rows
stay, side by side. Only conv_id, turn, role and text are read, so other columns may have any
name. An empty table gives no rows. The input must be a deterministic frame, such as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadentia.session import materialise

MARK, AFTER_ROLE, END = "### ", ": ", "</turn>"
LOSS_ROLE = "assistant"
MOST_ROWS = 1024

# Forms of a turn, from the plainest to the one that always round trips.
PLAIN, SLASHES, FULL = 0, 1, 2


def _replaced(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def _broken(text: Column, control: str) -> Column:
    """Put the filler behind the first character of every occurrence of a control string."""
    return _replaced(text, control, control[0] + "\\." + control[1:])


def escaped(text: Column, form: int, controls: tuple[str, ...]) -> Column:
    if form >= SLASHES:
        text = _replaced(text, "\\", "\\-")
    if form >= FULL:
        for control in controls:
            text = _broken(text, control)
    return text


def unescaped(text: Column) -> Column:
    return _replaced(_replaced(text, "\\.", ""), "\\-", "\\")


def written(role: Column, text: Column, form: int) -> Column:
    """``role`` and ``text`` of a turn in one form."""
    return F.struct(
        escaped(role, form, (MARK, END, AFTER_ROLE)).alias("role"), escaped(text, form, (MARK, END)).alias("text")
    )


def _behind(text: Column, front: Column, skipped: int) -> Column:
    """What follows ``front`` and ``skipped`` more code points."""
    return F.substring(text, F.length(front) + skipped + 1, F.length(text))


def parsed_turn(piece: Column) -> Column:
    """``role, text`` of what follows a mark; null if it is not exactly one turn."""
    role = F.substring_index(piece, AFTER_ROLE, 1)
    rest = _behind(piece, role, len(AFTER_ROLE))
    text = F.substring_index(rest, END, 1)
    ends = _behind(rest, text, len(END)) == "\n"
    return F.when(ends, F.struct(unescaped(role).alias("role"), unescaped(text).alias("text")))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted part; one that cannot be read is null."""
    pieces = F.split(formatted, MARK)
    read = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), parsed_turn)
    return F.when(F.get(pieces, F.lit(0)) == "", read)


def _line(turn: Column) -> Column:
    return F.concat(F.lit(MARK), turn["role"], F.lit(AFTER_ROLE), turn["text"], F.lit(END + "\n"))


def _form(role: Column, text: Column) -> Column:
    """The plainest form in which a turn is read back as it was."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    same = lambda form: parsed(_line(written(role, text, form))).eqNullSafe(source)
    return F.when(same(PLAIN), PLAIN).when(same(SLASHES), SLASHES).otherwise(FULL)


def _rendered(groups: DataFrame) -> DataFrame:
    """Write out the ordered turns of each row, and refuse a text that is not read back identically."""
    chosen = lambda t: F.when(t["form"] == PLAIN, written(t["role"], t["text"], PLAIN)).when(
        t["form"] == SLASHES, written(t["role"], t["text"], SLASHES)
    ).otherwise(written(t["role"], t["text"], FULL))
    lines = groups.select("conv_id", "part", "turns", F.transform("turns", chosen).alias("lines")).select(
        "conv_id",
        "part",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        F.concat_ws("", F.transform("lines", _line)).alias("formatted"),
        F.zip_with(
            "lines",
            "turns",
            lambda line, turn: F.struct(
                F.length(_line(line)).cast("long").alias("length"),
                (F.length(line["role"]) + len(MARK) + len(AFTER_ROLE)).cast("long").alias("front"),
                F.when(turn["role"] == LOSS_ROLE, F.length(line["text"])).otherwise(0).cast("long").alias("loss"),
            ),
        ).alias("sizes"),
    )
    begin = lambda i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x["length"])
    spans = F.transform(
        "sizes",
        lambda x, i: F.struct(
            begin(i).alias("turn_start"), (begin(i) + x["front"]).alias("start"), (begin(i) + x["front"] + x["loss"]).alias("end")
        ),
    )
    wrong = F.raise_error(F.lit("a conversation is not read back as it was"))
    checked = F.when(parsed(F.col("formatted")).eqNullSafe(F.col("source")), F.col("formatted")).otherwise(wrong)
    return lines.select("conv_id", "part", checked.alias("formatted"), spans.alias("spans"))


def _turns(rows: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return rows.select(
        "conv_id",
        F.struct(
            "turn", F.xxhash64(role, text).alias("digest"), role.alias("role"), text.alias("text"), _form(role, text).alias("form")
        ).alias("t"),
    )


def _gathered(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("turns"))


def formatted_parts(rows: DataFrame, most: int = MOST_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Formatted conversations of up to ``most`` rows, and the parts of longer ones if there are any."""
    lengths = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > most)
    # At most one row per `most` rows of the input.
    long = materialise(lengths.select(F.col("conv_id").alias("long_id")), "long")
    turns, is_long = _turns(rows), F.col("conv_id").eqNullSafe(F.col("long_id"))
    if long.isEmpty():
        return _rendered(_gathered(turns, "conv_id").withColumn("part", F.lit(0))), None
    short = _rendered(_gathered(turns.join(long, is_long, "left_anti"), "conv_id").withColumn("part", F.lit(0)))
    # The row number splits even equal turns; texts never travel as bounds of ranges.
    cut = (
        turns.withColumn("row", F.monotonically_increasing_id())
        .join(long, is_long, "left_semi")
        .repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism * 4, "conv_id", "t.turn", "t.digest", "row")
        .withColumn("part", F.spark_partition_id())
    )
    return short, _rendered(_gathered(cut, "conv_id", "part"))


def format_conversations(rows: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``conv_id, part, formatted, spans``: the parts of a conversation follow each other by ``part``."""
    short, long = formatted_parts(rows, most)
    return short if long is None else short.unionByName(long)


def _read_back(parts: DataFrame) -> DataFrame:
    """What a formatted part says: its turns, and the text under its loss mask."""
    pieces = F.split("formatted", MARK)
    # Every piece but the first is a turn without its mark, so it begins len(MARK) behind the turn.
    masked = F.zip_with(
        F.slice(pieces, F.lit(2), F.size(pieces) - 1),
        "spans",
        lambda piece, s: unescaped(
            F.substring(piece, (s["start"] - s["turn_start"] - len(MARK) + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        ),
    )
    turns = parsed(F.col("formatted"))
    told = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return parts.select(
        "conv_id",
        "part",
        F.size(turns).cast("long").alias("n_turns"),
        F.concat_ws("", told).alias("turns"),
        F.concat_ws("", masked).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _digests(read: DataFrame) -> DataFrame:
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def formatting_report(rows: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """One row per conversation with what its formatted text and its mask hold."""
    short, long = formatted_parts(rows, most)
    told = _read_back(short)
    if long is not None:
        piece = F.struct("part", "n_turns", "turns", "loss", "formatted_chars")
        joined = _read_back(long).groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
        add = lambda name: F.aggregate(f"p.{name}", F.lit(0).cast("long"), lambda s, x: s + x).alias(name)
        told = told.unionByName(
            joined.select(
                "conv_id",
                F.lit(0).alias("part"),
                add("n_turns"),
                F.concat_ws("", "p.turns").alias("turns"),
                F.concat_ws("", "p.loss").alias("loss"),
                add("formatted_chars"),
            )
        )
    return _digests(told)


TRAP_ID, TRAP = -7, "\\### Assistant: </turn> ok"


def with_trap(rows: DataFrame) -> DataFrame:
    """The rows and one more conversation, whose texts hold every control string."""
    turn = F.col("id")
    trap = rows.sparkSession.range(2).select(
        F.lit(TRAP_ID).cast("long").alias("conv_id"),
        turn.alias("turn"),
        F.when(turn == 0, "user").otherwise(LOSS_ROLE).alias("role"),
        F.lit(TRAP).alias("text"),
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(trap)


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
k AS (
  SELECT *, contains(role || ': ' || text, '### ') OR contains(text, '</turn>') OR position(': ' IN role || ': ') <= length(role) AS marks,
    contains(role, '\.') OR contains(role, '\-') OR contains(text, '\.') OR contains(text, '\-') AS slashes
  FROM t),
w AS (
  SELECT conv_id, turn, role, text,
    CASE WHEN marks THEN replace(replace(replace(replace(role, '\', '\-'), '### ', '#\.## '), '</turn>', '<\./turn>'), ': ', ':\. ')
      WHEN slashes THEN replace(role, '\', '\-') ELSE role END AS r,
    CASE WHEN marks THEN replace(replace(replace(text, '\', '\-'), '### ', '#\.## '), '</turn>', '<\./turn>')
      WHEN slashes THEN replace(text, '\', '\-') ELSE text END AS x
  FROM k),
s AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST), '') AS loss,
    sum(length('### ' || r || ': ' || x || '</turn>' || chr(10))) AS formatted_chars
  FROM w GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM s
"""
