"""Quality rules whose cutoffs bound the false rejections, in DataFrame functions only.

Every rule rejects documents whose rate lies above a cutoff. The cutoffs are
chosen per stratum from a fixed grid on labelled documents: a cutoff is certified
if the exact binomial tail makes a false rejection rate above ``alpha``
implausible, at a level shared out over all cutoffs tested (Bonferroni). The
strictest certified cutoff is used; without one the rule rejects nothing there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.llm.common import NO_SPACE, SPACES, empty_if_null, once, saved, table

#: Fixed by the base rules.
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
#: Part of a stratum's good documents that may be rejected, and the risk of more.
ALPHA, DELTA = 0.02, 0.05
#: For 1 to 15; beyond, four terms of the series are exact to the last bit.
STIRLING_REST = [math.lgamma(x + 1) - (x + 0.5) * math.log(x) + x - 0.5 * math.log(2 * math.pi) for x in range(1, 16)]


@dataclass(frozen=True)
class Rule:
    """Reject where ``rate`` (a SQL expression over the features) exceeds the cutoff."""

    name: str
    rate: str
    cutoffs: tuple[float, ...]


#: From lenient to strict.
RULES = (
    Rule("symbols", "n_symbols / nullif(n_words, 0)", (2.0, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    Rule("dup_lines", "n_dup_lines / nullif(n_lines, 0)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2)),
    Rule("repeats", "n_repeat_words / nullif(n_words, 0)", (0.19, 0.17, 0.15, 0.13, 0.1)),
    Rule("long_words", "word_chars / nullif(n_words, 0)", (40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0)),
    Rule("short_words", "-(word_chars / nullif(n_words, 0))", (-1.0, -1.5, -2.0, -2.5, -3.0)),
)


def _repeated_words(rows: DataFrame) -> DataFrame:
    """``n_repeat_words`` from ``words``, without leaving the row.

    Window hashes are sorted with their places, so equal ones are neighbours;
    the places found, sorted again, give the words covered. Rows whose hashes
    are all distinct skip that.
    """
    keep = [c for c in rows.columns if c != "words"]
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.select(*keep, once(hashes, "hashes"))
    last = F.size("hashes") - F.lit(REPEAT_WINDOW - 1)
    windows = F.transform(
        F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.slice("hashes", i, REPEAT_WINDOW)),
    )
    rows = rows.select(*keep, once(windows, "windows"))
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.select(*keep, once(F.when(repeats, F.sort_array(placed)), "placed"))
    def same(x: Column, k: Column) -> Column:
        return F.coalesce(F.get("placed", k)["h"] == x["h"], F.lit(False))

    twice = F.transform(
        "placed",
        lambda x, k: F.when(same(x, k - F.lit(1)) | same(x, k + F.lit(1)), x["i"]),
    )
    places = F.sort_array(F.filter(twice, lambda i: i.isNotNull()))
    rows = rows.select(*keep, once(places, "places"))
    covered = F.transform(
        "places",
        lambda x, k: F.least(
            F.lit(REPEAT_WINDOW), F.coalesce(F.get("places", k + F.lit(1)) - x, F.lit(REPEAT_WINDOW))
        ),
    )
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(*keep, F.coalesce(total, F.lit(0)).cast("long").alias("n_repeat_words"))


def features(docs: DataFrame) -> DataFrame:
    """Counts of each row of ``docs``: ``doc_id``, ``text_key``, ``stratum`` and the features."""
    text = F.col("_text")
    others = "[^" + "".join("\\" + c for c in SYMBOLS) + "]+"
    worded = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(NO_SPACE))
    rows = docs.select(
        "doc_id",
        F.xxhash64(empty_if_null("text")).alias("text_key"),
        F.coalesce(F.col("lang"), F.lit("")).alias("stratum"),
        empty_if_null("text").alias("_text"),
    )
    rows = rows.select(
        "doc_id",
        "text_key",
        "stratum",
        F.length(F.regexp_replace(text, others, "")).cast("long").alias("n_symbols"),
        "_text",
        once(worded, "lines"),
    )
    rows = rows.select(
        "doc_id",
        "text_key",
        "stratum",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        once(F.array_remove(F.split(text, SPACES + "+", -1), ""), "words"),
    )
    rows = rows.select(
        "doc_id",
        "text_key",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        "words",
    )
    return _repeated_words(rows)


def base_failed() -> Column:
    return F.expr(
        f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words"
    )


def _stirling_rest(x: Column) -> Column:
    """What Stirling's formula leaves out of the logarithm of x factorial, x at least 1."""
    series = F.lit(1 / 12) / x - F.lit(1 / 360) / F.pow(x, 3) + F.lit(1 / 1260) / F.pow(x, 5)
    few = F.get(F.array(*map(F.lit, STIRLING_REST)), (x - 1).cast("int"))
    return F.when(x <= len(STIRLING_REST), few).otherwise(series - F.lit(1 / 1680) / F.pow(x, 7))


def _deviance(x: Column, mean: Column) -> Column:
    return x * F.log(x / mean) + mean - x


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(X <= k) for X of n trials at ``rate``; 1 where k is at or above the mean.

    The last term comes from its saddle-point form, which does not cancel for
    large n; the others are summed downwards, each as a multiple of the one
    above. Below the mean the i-th of them is under exp(-i * i / 2k) of the last,
    so terms beyond 10 times the root of k are under the last bit of the sum: a
    row takes some 10 * sqrt(k) steps.
    """
    size, hits = n.cast("double"), k.cast("double")
    misses = size - hits
    last = (
        _stirling_rest(size)
        - _stirling_rest(hits)
        - _stirling_rest(misses)
        - _deviance(hits, size * F.lit(rate))
        - _deviance(misses, size * F.lit(1 - rate))
        + F.lit(0.5) * F.log(size / (F.lit(2 * math.pi) * hits * misses))
    )
    steps = F.least(hits, F.ceil(F.lit(10.0) * F.sqrt(hits))).cast("long")
    odds = F.lit((1 - rate) / rate)
    ratio = F.aggregate(
        F.sequence(F.lit(1).cast("long"), steps),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: F.struct(
            (a["term"] * (hits - i + F.lit(1)) / (misses + i) * odds).alias("term"),
            (a["sum"] + a["term"] * (hits - i + F.lit(1)) / (misses + i) * odds).alias("sum"),
        ),
        lambda a: a["sum"],
    )
    return (
        F.when(k >= n * F.lit(rate), F.lit(1.0))
        .when(k < 1, F.exp(size * F.lit(math.log1p(-rate))))
        .otherwise(F.exp(last) * ratio)
    )


def certified_cutoffs(
    counts: DataFrame,
    labels: DataFrame,
    alpha: float = ALPHA,
    delta: float = DELTA,
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """Per ``stratum`` the strictest certified cutoff of each rule, null without one.

    ``labels`` has ``doc_id`` and ``quality``; repeated labels count once, and a
    document labelled both ways counts as good. With probability ``1 - delta``
    over the labelled documents, no stratum loses more than ``alpha`` of its good
    documents to all rules together: each rule has an equal part of ``alpha``.
    """
    good = labels.filter("quality = 1").select("doc_id").distinct()
    held = counts.filter("n_words > 0").join(good, "doc_id", "left_semi")
    failed = [
        F.sum((F.expr(rule.rate) > F.lit(c)).cast("long")).alias(f"{rule.name}_{i}")
        for rule in rules
        for i, c in enumerate(rule.cutoffs)
    ]
    tallies = saved(held.groupBy("stratum").agg(F.count("*").alias("n"), *failed), "risk-tallies")
    strata = counts.select("stratum").distinct().count()
    level = delta / max(1, strata * sum(len(rule.cutoffs) for rule in rules))
    tests = F.array(
        *[
            F.struct(
                F.lit(rule.name).alias("rule"),
                F.lit(i).alias("place"),
                F.lit(c).alias("cutoff"),
                F.col(f"{rule.name}_{i}").alias("k"),
            )
            for rule in rules
            for i, c in enumerate(rule.cutoffs)
        ]
    )
    tested = tallies.select("stratum", "n", F.inline(tests))
    tail = binomial_tail(F.col("n"), F.col("k"), alpha / len(rules))
    strictest = [
        F.max_by(
            F.when(F.col("rule") == rule.name, F.col("cutoff")),
            F.when(F.col("rule") == rule.name, F.col("place")),
        ).alias(f"{rule.name}_cutoff")
        for rule in rules
    ]
    passed = tested.filter(tail <= level).groupBy("stratum").agg(*strictest)
    return tallies.select("stratum").join(passed, "stratum", "left")


def judged(
    docs: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, **settings
) -> DataFrame:
    """Features and verdicts of every row of ``docs``.

    A null text has no words and fails the base rules. A null ``lang`` is a
    stratum of its own. Repeated rows are judged alike. Without labels, or
    without documents, no cutoff is certified.
    """
    counts = saved(features(docs), "risk-features")
    cutoffs = saved(certified_cutoffs(counts, labels, rules=rules, **settings), "risk-cutoffs")
    rejected = [
        F.when(F.expr(rule.rate) > F.col(f"{rule.name}_cutoff"), F.lit(rule.name)) for rule in rules
    ]
    verdicts = counts.join(cutoffs, "stratum", "left").withColumns(
        {"base_failed": base_failed(), "rejected_by": F.concat_ws(",", *rejected)}
    )
    return verdicts.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Rows of ``docs`` that pass, all columns kept."""
    failed = judged(docs, labels, **settings).filter("NOT kept")
    failed = failed.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    same = docs["doc_id"].eqNullSafe(failed["_doc"]) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == failed["_key"]
    )
    return docs.join(failed, same, "left_anti")


def op6_risk_rules(spark, sf_dir):
    verdicts = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return verdicts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rejected_by",
    )


def _grid_sql() -> str:
    return ", ".join(
        f"('{rule.name}', {order}, {place}, {cutoff})"
        for order, rule in enumerate(RULES)
        for place, cutoff in enumerate(rule.cutoffs)
    )


def _rates_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, stratum, n_words, '{rule.name}' AS rule, {rule.rate} AS rate FROM counted"
        for rule in RULES
    )


OP6_SQL = f"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS words FROM texts
), words AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split
), windows AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w || ' '
           || lead(word, 3) OVER w || ' ' || lead(word, 4) OVER w AS body
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i FROM windows WHERE body IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY doc_id, body) > 1
), covered AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) FROM twice)
  GROUP BY doc_id
), worded AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY doc_id
), sized AS (
  SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars
  FROM words GROUP BY doc_id
), counted AS (
  SELECT t.doc_id, t.stratum, coalesce(s.n_words, 0) AS n_words,
         coalesce(s.word_chars, 0) AS word_chars,
         length(regexp_replace(t.text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_dup_lines, 0) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words
  FROM texts t LEFT JOIN sized s USING (doc_id) LEFT JOIN worded l USING (doc_id)
  LEFT JOIN covered c USING (doc_id)
), rates AS ({_rates_sql()}
), grid(rule, rule_order, place, cutoff) AS (VALUES {_grid_sql()}
), tallies AS (
  SELECT stratum, rule, place, cutoff, count(*) AS n,
         count(*) FILTER (rate > cutoff) AS k
  FROM rates JOIN grid USING (rule)
  WHERE n_words > 0 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
  GROUP BY ALL
), tails AS (
  SELECT *, CASE WHEN k >= n * {ALPHA / len(RULES)} THEN 1.0 ELSE list_sum([
      exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
          + j * ln({ALPHA / len(RULES)}) + (n - j) * ln(1 - {ALPHA / len(RULES)}))
      FOR j IN range(k + 1)]) END AS tail
  FROM tallies
), chosen AS (
  SELECT stratum, rule, arg_max(cutoff, place) AS cutoff FROM tails
  WHERE tail <= {DELTA} / ((SELECT count(DISTINCT stratum) FROM counted)
                           * {sum(len(rule.cutoffs) for rule in RULES)})
  GROUP BY stratum, rule
), rejected AS (
  SELECT r.doc_id, string_agg(r.rule, ',' ORDER BY g.rule_order) AS rejected_by
  FROM rates r JOIN chosen c USING (stratum, rule)
  JOIN grid g ON g.rule = r.rule AND g.place = 0
  WHERE r.rate > c.cutoff GROUP BY r.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words
         AS base_failed,
       NOT base_failed AND rejected_by IS NULL AS kept,
       coalesce(rejected_by, '') AS rejected_by
FROM counted LEFT JOIN rejected USING (doc_id)
"""
