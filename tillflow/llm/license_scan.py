"""License scan by ordered signature rules, in DataFrame functions only.

Texts become words with one blank on either side of each. One pass looks for the
keywords of all rules; a rule's pattern is tried only where its keyword stands. What
the rules find is then resolved: a detection that lies within another one of an
equal or better tier is suppressed, the longer or earlier one staying. That is one
sweep over a document's detections in the order of their places.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillflow.llm.common import empty_if_null, once, table
from tillflow.llm.license_rules import RULES, Rule

#: Fixed by the contract: what separates words once A-Z are lower-cased.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks at the ends of a match. Both separate words, so no word holds them.
FIRST, LAST = "\x01", "\x02"
PLACE = "struct<start:int,rule:int,end:int>"


def _spaced(rule: Rule) -> str:
    """Lead and pattern as groups, for a text whose words have a blank each on either side."""
    return f" ({rule.lead.replace(' ', '  ')})({rule.pattern.replace(' ', '  ')}) "


def _gate(rules: tuple[Rule, ...]) -> str:
    """A pattern for all keywords, grouped by their first letter."""
    starts = defaultdict(list)
    for keyword in sorted({r.keyword for r in rules}):
        starts[keyword[0]].append(keyword[1:])
    grouped = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(starts.items()))
    return f" ({grouped})(?= )"


def _marked(words: Column, mark: str, at_start: bool) -> Column:
    """Places of the words that carry ``mark``."""
    carries = F.startswith if at_start else F.endswith
    places = F.transform(words, lambda w, i: F.when(carries(w, F.lit(mark)), i))
    return F.filter(places, lambda i: i.isNotNull())


def _places(words: Column, rule: Column) -> Column:
    """Where the rule's pattern stands, as first and last word."""
    marks = F.regexp_replace(words, rule["pattern"], F.lit(f" $1{FIRST}$2{LAST} "))
    split = F.split(F.trim(marks), "  ")
    found = F.zip_with(
        _marked(split, FIRST, True),
        _marked(split, LAST, False),
        lambda a, b: F.struct(a.alias("start"), rule["rule"].alias("rule"), b.alias("end")),
    )
    none = F.array().cast(f"array<{PLACE}>")
    return F.when(F.rlike(words, rule["pattern"]), found).otherwise(none)


def detections(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for every detection, and one with a null ``rule`` for a document without.

    Columns: those of ``docs``' ``doc_id``, ``uid`` (one of each row of ``docs``),
    ``n_words``, ``start`` and ``end`` (first and last word, from 0), ``rule`` (its
    number) and ``kept``.
    """
    every = F.array(
        *[
            F.struct(
                F.lit(i).alias("rule"), F.lit(r.keyword).alias("keyword"), F.lit(_spaced(r)).alias("pattern")
            )
            for i, r in enumerate(rules)
        ]
    )
    lowered = F.translate(empty_if_null("text"), UPPER, LOWER)
    words = F.trim(F.regexp_replace(lowered, BETWEEN_WORDS, "  "))
    rows = docs.select("doc_id", once(F.concat(F.lit(" "), words, F.lit(" ")), "words"))
    gated = F.array_distinct(F.regexp_extract_all("words", F.lit(_gate(rules)), F.lit(1)))
    rows = rows.select("doc_id", "words", once(gated, "keywords"))
    tried = F.filter(every, lambda r: F.array_contains("keywords", r["keyword"]))
    found = F.flatten(F.transform(tried, lambda r: _places(F.col("words"), r)))
    blanks = F.length("words") - F.length(F.replace("words", F.lit("  "), F.lit(" ")))
    n_words = F.when(F.col("words") == "  ", 0).otherwise(blanks + 1).cast("long")
    places = F.when(F.size("keywords") > 0, found)
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("uid"), n_words.alias("n_words"), once(places, "places"))
    rows = rows.select("doc_id", "uid", "n_words", F.explode_outer("places").alias("at"))
    rows = rows.select("doc_id", "uid", "n_words", "at.start", "at.end", "at.rule")

    tiers = F.array(*[F.lit(r.tier) for r in rules])
    tier = F.get(tiers, F.col("rule"))
    rows = rows.withColumn("tier", tier)
    before = (
        Window.partitionBy("uid")
        .orderBy("start", F.desc("end"), "tier", "rule")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    covered = F.coalesce(
        *[
            F.when(F.col("tier") == t, F.max(F.when(F.col("tier") <= t, F.col("end"))).over(before))
            for t in sorted({r.tier for r in rules})
        ]
    )
    kept = F.col("rule").isNotNull() & F.coalesce(covered < F.col("end"), F.lit(True))
    return rows.withColumn("kept", kept).drop("tier")


def _of_rules(rules: tuple[Rule, ...], field: str) -> Column:
    """The field of the row's rule."""
    return F.get(F.array(*[F.lit(getattr(r, field)) for r in rules]), F.col("rule"))


def _listed(labels: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_set(labels)), ",")


def scan_licenses(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each of ``docs`` with what the rules found.

    ``doc_id``, ``n_words``, ``detections`` (label, first and last word, confidence
    and whether kept, by place), ``labels`` of the kept and the base ones, ``score``,
    the best confidence among the kept, 0 without, and of the base phrases ``n_base``,
    ``first_word``, ``last_word`` and ``base_labels``. A null or empty text has no
    words and no detections. Repeated rows are scanned each for itself; of equal
    detections the rule that stands first is kept; an empty table gives an empty
    result; other columns are ignored.
    """
    rows = detections(docs, rules).select(
        "*",
        *[_of_rules(rules, f).alias(f) for f in ("label", "confidence", "base")],
    )
    base, kept = F.col("base"), F.col("kept")
    place = F.struct("start", "end", "rule", "label", "confidence", "kept")
    found = rows.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_list(F.when(F.col("rule").isNotNull(), place))).alias("detections"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        _listed(F.when(base, F.col("label"))).alias("base_labels"),
        _listed(F.when(base | kept, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(kept, F.col("confidence"))), F.lit(0.0)).alias("score"),
    )
    return found.drop("uid")


def op11_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def _op11_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same rules, each tried on all texts with its keyword; containment by a self-join."""
    values = ",\n  ".join(
        f"({i}, '{r.label}', {r.tier}, {r.confidence}, '{r.keyword}', '{_spaced(r)}', {r.base})"
        for i, r in enumerate(rules)
    )
    return f"""
WITH rules(rule, label, tier, confidence, keyword, pattern, base) AS (VALUES
  {values}
), texts AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), matched AS (
  SELECT uid, rule, label, tier, confidence, base, string_split(trim(
    regexp_replace(' ' || array_to_string(words, '  ') || ' ', pattern, ' \\1' || chr(1) || '\\2' || chr(2) || ' ', 'g')
  ), '  ') AS marked
  FROM texts JOIN rules ON list_contains(words, keyword)
), places AS (
  SELECT * EXCLUDE (starts, ends), unnest(starts) - 1 AS start, unnest(ends) - 1 AS "end" FROM (
    SELECT * EXCLUDE (marked),
      list_filter(range(1, len(marked) + 1), lambda i: starts_with(marked[i], chr(1))) AS starts,
      list_filter(range(1, len(marked) + 1), lambda i: ends_with(marked[i], chr(2))) AS ends
    FROM matched
  )
), resolved AS (
  SELECT *, NOT EXISTS (
    SELECT 1 FROM places q
    WHERE q.uid = p.uid AND q.start <= p.start AND q."end" >= p."end" AND q.tier <= p.tier
      AND (q.tier < p.tier OR q.start < p.start OR q."end" > p."end" OR q.rule < p.rule)
  ) AS kept FROM places p
), told AS (
  SELECT uid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
    max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR kept) AS labels,
    max(confidence) FILTER (kept) AS score
  FROM resolved GROUP BY uid
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM texts LEFT JOIN told USING (uid)
"""


OP11_SQL = _op11_sql()
