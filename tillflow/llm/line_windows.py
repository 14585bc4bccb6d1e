"""Line dedup by overlapping three-line windows, in DataFrame functions only.

Consecutive lines are hashed together, windows found more than once anywhere
are looked up, and every occurrence but the first is removed: the lines from
first to last of each later window, merged over their overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.llm.common import NO_SPACE, empty_if_null, once, saved, table

WINDOW = 3
#: A document in the joins: rows that agree in both are one document.
IDENTITY = ("_doc", "_text")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _identity() -> list[Column]:
    return [F.col("doc_id").alias("_doc"), F.xxhash64(empty_if_null("text")).alias("_text")]


def line_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per window: its document, first and last line, and 128 bits of hash.

    Lines without a word are stepped over; a window joins the lines around them.
    """
    numbered = F.transform(
        _lines(empty_if_null("text")), lambda line, i: F.struct(i.alias("i"), line.alias("line"))
    )
    worded = F.filter(numbered, lambda x: x["line"].rlike(NO_SPACE))
    hashed = F.transform(
        worded,
        lambda x: F.struct(
            x["i"].alias("i"),
            F.xxhash64(x["line"]).alias("h1"),
            F.xxhash64(F.lit(1), x["line"]).alias("h2"),
        ),
    )
    rows = docs.select(*_identity(), once(hashed, "lines")).filter(F.size("lines") >= window)
    starts = F.sequence(F.lit(1), F.size("lines") - F.lit(window - 1))
    rows = rows.select(*IDENTITY, "lines", F.explode(starts).alias("at"))
    members = [F.element_at("lines", (F.col("at") + F.lit(k)).cast("int")) for k in range(window)]
    return rows.select(
        *IDENTITY,
        members[0]["i"].alias("first"),
        members[-1]["i"].alias("last"),
        F.xxhash64(*[m["h1"] for m in members]).alias("h1"),
        F.xxhash64(*[m["h2"] for m in members]).alias("h2"),
    )


def later_windows(windows: DataFrame) -> DataFrame:
    """Windows that stand somewhere before, by ``doc_id`` and line.

    The first places are aggregated with map-side minima; a window that holds a
    third of all rows is one row of the right side, and its left side can be
    split by adaptive execution.
    """
    place = F.struct(*IDENTITY, "first")
    firsts = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("origin"))
    firsts = firsts.filter("n > 1").drop("n")
    found = windows.join(firsts, ["h1", "h2"])
    return found.filter(~place.eqNullSafe(F.col("origin"))).select(*IDENTITY, "first", "last")


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated windows taken out of ``text``.

    All columns are kept and ``n_lines``, ``n_removed`` are added (columns of
    those names are replaced). The least ``doc_id`` keeps a passage, in one
    document its first place. A null ``doc_id`` comes before all others. A null
    text has no windows and stays null; texts of fewer than ``window`` worded
    lines stay as they are. Rows equal in ``doc_id`` and text are one document
    and come out alike. An empty table gives an empty result.
    """
    windows = saved(line_windows(docs, window), "line-windows")
    gone = later_windows(windows).select(*IDENTITY, F.explode(F.sequence("first", "last")).alias("i"))
    gone = gone.groupBy(*IDENTITY).agg(F.collect_set("i").alias("_gone"))  # lines of one document
    rows = docs.select(F.struct("*").alias("_row"), *_identity())
    same = rows["_doc"].eqNullSafe(gone["_doc"]) & (rows["_text"] == gone["_text"])
    text = F.col("_row.text")
    lines = F.when(F.col("_gone").isNotNull(), _lines(F.coalesce(text, F.lit(""))))
    joined = rows.join(gone, same, "left").select("_row", "_gone", once(lines, "_lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - F.lit(1)), F.col("_gone"))
    rest = F.array_join(F.transform(left, lambda i: F.element_at("_lines", i + F.lit(1))), "\n")
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    removed = F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone"))
    new = {
        "text": F.when(F.col("_gone").isNull(), text).otherwise(rest),
        "n_lines": F.coalesce(breaks + F.lit(1), F.lit(0)).cast("long"),
        "n_removed": removed.cast("long"),
    }
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(
        *[new[c].alias(c) if c in new else F.col(f"_row.`{c}`") for c in kept],
        new["n_lines"].alias("n_lines"),
        new["n_removed"].alias("n_removed"),
    )


def op8_line_windows(spark, sf_dir):
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents
), worded AS (
  SELECT * FROM lines WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')
), windows AS (
  SELECT doc_id, i, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS body,
         lead(i, 2) OVER w AS last
  FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), later AS (
  SELECT doc_id, i, last FROM windows WHERE body IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, last)) AS i FROM later
), counted AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g USING (doc_id, i) GROUP BY l.doc_id
)
SELECT * FROM counted
"""
