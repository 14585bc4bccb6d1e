"""Secret scan by sliding-window Shannon entropy, in DataFrame functions only.

Base patterns are found everywhere. Besides, candidate strings (long runs of key
characters) are read through a window of fixed width that slides by one
character: the counts of the window's characters and the sum of n log n change
by the one that enters and the one that leaves. Every character class reads every
candidate. A window that lies within the class, has enough digits, letters and
changes of case, and reaches the class's entropy makes its candidate a secret. What
the allow-list names is taken out first, so no window reaches into it, and keys
beside it are still seen.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.llm.common import empty_if_null, once, table

#: Fixed by the base rules.
ASSIGN = (
    r"(?i:(password|passwd|secret|token|api_?key))"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGNED = 6

#: Sums taken in another order may fall short of the bound by this much.
ROUNDING = 1e-9

KINDS = ("assign", "access", "hex", "entropy")
SPAN = "struct<start:int,kind:int,end:int>"


DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()


@dataclass(frozen=True)
class CharacterClass:
    """Windows of ``alphabet`` with ``bits`` of entropy and at least so many of each kind.

    ``rises`` are capitals right after a small letter or a digit.
    """

    name: str
    alphabet: str
    bits: float
    digits: int = 0
    letters: int = 0
    lower: int = 0
    upper: int = 0
    rises: int = 0


#: Words and numbers alone are no keys, so digits and letters are asked for, and where
#: there need be no digits, capitals as frequent as they hardly are in joined words.
CLASSES = (
    CharacterClass("hex", DIGITS + "abcdefABCDEF", 3.0, digits=1, letters=1),
    CharacterClass("lower", LOWER + DIGITS, 3.5, digits=1, letters=1),
    CharacterClass("upper", UPPER + DIGITS, 3.3, digits=1, letters=1),
    CharacterClass("base64", UPPER + LOWER + DIGITS + "+/_=-", 3.7, digits=2, lower=2, upper=2),
    CharacterClass("mixed", UPPER + LOWER + DIGITS + "+/", 3.7, lower=4, upper=5, rises=3),
)
#: Strings that look random but are meant to be read: placeholders, counted-out
#: alphabets, the documented sample key, UUIDs, dates and file paths.
ALLOWED = (
    r"(?i:example|sample|dummy|placeholder|changeme|xxxx|abcdefgh|12345678|01234567|wJalrXUtnFEMI)"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|(19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|^/?([a-z0-9_-]+/){2,}"
)
#: Running sums are taken within runs of so many numbers and then over the runs.
RUN = 256


def _no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _running_sums(numbers: Column) -> Column:
    """The sum of each number and all before it.

    An array that grows is copied with every element, so long ones are cut into runs.
    """

    def within(run: Column, before: Column) -> Column:
        start = F.struct(before.alias("sum"), F.array().cast("array<int>").alias("sums"))

        def add(state: Column, number: Column) -> Column:
            upto = state["sum"] + number
            return F.struct(upto.alias("sum"), F.concat(state["sums"], F.array(upto)).alias("sums"))

        return F.aggregate(run, start, add, lambda state: state["sums"])

    starts = F.sequence(F.lit(1), F.size(numbers), F.lit(RUN))
    runs = F.transform(starts, lambda at: F.slice(numbers, at, RUN))
    totals = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda a, x: a + x))
    ends = within(totals, F.lit(0))
    each = F.arrays_zip(runs.alias("run"), totals.alias("total"), ends.alias("end"))
    summed = F.transform(each, lambda r: within(r["run"], r["end"] - r["total"]))
    return F.when(F.size(numbers) > 0, F.flatten(summed)).otherwise(F.array().cast("array<int>"))


def _located(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """Spans of ``pattern`` in code points.

    The pieces between the matches and the matches themselves add up to the
    places. ``keep`` is an array parallel to the matches.
    """
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    pieces = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(found))
    keep = keep if keep is not None else F.transform(found, lambda x: F.lit(True))
    sizes = F.flatten(F.zip_with(pieces, found, lambda gap, size: F.array(gap, size)))
    ends = F.transform(_running_sums(sizes), lambda end, i: F.when(i % 2 == 1, end))
    parts = F.arrays_zip(F.filter(ends, lambda e: e.isNotNull()).alias("end"), found.alias("size"), keep.alias("keep"))
    spans = F.transform(
        F.filter(parts, lambda p: F.coalesce(p["keep"], F.lit(False))),
        lambda p: F.struct(
            (p["end"] - p["size"]).alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end")
        ),
    )
    return F.when(text.rlike(pattern), spans.cast(f"array<{SPAN}>")).otherwise(_no_spans())


def _n_log_n(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def _of_kind(character: Column, kind: str) -> Column:
    return F.coalesce(character.between(kind[0], kind[-1]), F.lit(False)).cast("int")


def highest_entropy(candidate: Column, kind: CharacterClass, window: int) -> Column:
    """The highest entropy of a full window of the class, in bits a character; 0 without one."""
    alphabet = kind.alphabet
    characters = F.split(candidate, "")
    before = F.concat(F.array(F.lit("")), characters)
    rises = F.zip_with(
        characters,
        before,
        lambda c, b: _of_kind(c, UPPER) * (_of_kind(b, LOWER) + _of_kind(b, DIGITS)),
    )
    none = F.array_repeat(F.lit(None).cast("string"), window)
    steps = F.arrays_zip(
        characters.alias("enter"),
        F.concat(none, characters).alias("leave"),
        rises.alias("rise"),
        F.concat(F.array_repeat(F.lit(0), window - 1), rises).alias("past_rise"),
    )
    wanted = {
        name: least
        for name in ("digits", "letters", "lower", "upper", "rises")
        if (least := getattr(kind, name))
    }
    start = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"),
        F.lit(0).alias("n"),
        F.lit(0.0).alias("sum"),
        F.lit(0.0).alias("best"),
        *[F.lit(0).alias(name) for name in wanted],
    )

    def counted(name: str, character: Column) -> Column:
        kinds = {"digits": [DIGITS], "lower": [LOWER], "upper": [UPPER], "letters": [LOWER, UPPER]}[name]
        found = _of_kind(character, kinds[0])
        return found + _of_kind(character, kinds[1]) if len(kinds) > 1 else found

    def slide(state: Column, step: Column) -> Column:
        enter = F.coalesce(F.instr(F.lit(alphabet), step["enter"]), F.lit(0))
        leave = F.coalesce(F.instr(F.lit(alphabet), step["leave"]), F.lit(0))
        counts = state["counts"]
        leaving = F.get(counts, leave - F.lit(1))
        entering = F.get(counts, enter - F.lit(1)) - (enter == leave).cast("int")
        lost = F.when(leave > 0, _n_log_n(leaving - F.lit(1)) - _n_log_n(leaving))
        gained = F.when(enter > 0, _n_log_n(entering + F.lit(1)) - _n_log_n(entering))
        total = state["sum"] + F.coalesce(lost, F.lit(0.0)) + F.coalesce(gained, F.lit(0.0))
        n = state["n"] + (enter > 0).cast("int") - (leave > 0).cast("int")
        bits = F.lit(math.log2(window)) - total / F.lit(float(window))
        now = {
            name: state[name]
            + (
                F.coalesce(step["rise"], F.lit(0)) - F.coalesce(step["past_rise"], F.lit(0))
                if name == "rises"
                else counted(name, step["enter"]) - counted(name, step["leave"])
            )
            for name in wanted
        }
        full = n == window
        for name, least in wanted.items():
            full &= now[name] >= least
        return F.struct(
            F.transform(
                counts,
                lambda c, j: c
                + (j + F.lit(1) == enter).cast("int")
                - (j + F.lit(1) == leave).cast("int"),
            ).alias("counts"),
            n.alias("n"),
            total.alias("sum"),
            F.when(full, F.greatest(state["best"], bits)).otherwise(state["best"]).alias("best"),
            *[now[name].alias(name) for name in wanted],
        )

    return F.aggregate(steps, start, slide, lambda s: s["best"])


def _pattern_of(alphabet: str) -> str:
    """A set of the alphabet's characters."""
    return "[" + "".join(sorted(alphabet, key=lambda c: c == "-")) + "]"


def _is_secret(
    candidate: Column, classes: tuple[CharacterClass, ...], allowed: str, window: int
) -> Column:
    read = F.regexp_replace(candidate, allowed, " ")
    verdict = F.lit(False)
    for kind in classes:
        full = read.rlike(f"{_pattern_of(kind.alphabet)}{{{window}}}")
        high = highest_entropy(read, kind, window) >= kind.bits - ROUNDING
        verdict |= F.when(full, high).otherwise(F.lit(False))
    return verdict


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind"] + F.lit(1)), s["start"], s["end"]
            ),
        ),
        ",",
    )


def find_secrets(
    docs: DataFrame,
    window: int = 20,
    classes: tuple[CharacterClass, ...] = CLASSES,
    allowed: str = ALLOWED,
) -> DataFrame:
    """``doc_id``, ``assign``, ``access``, ``hex`` and ``entropy`` span arrays of each row.

    Spans are code points, end exclusive. Entropy spans that lie within a base
    span are left out. A null or empty text has no spans; repeated rows are read
    alike; an empty table gives an empty result; other columns are ignored. A
    candidate shorter than ``window`` has no full window and is no secret.
    """
    text = F.col("_text")
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    long_enough = F.transform(values, lambda v: F.length(v) >= LEAST_ASSIGNED)
    rows = docs.select("doc_id", empty_if_null("text").alias("_text"))
    rows = rows.select(
        "doc_id",
        "_text",
        once(
            F.struct(
                _located(text, ASSIGN, 0, long_enough).alias("assign"),
                _located(text, ACCESS, 1).alias("access"),
                _located(text, HEX, 2).alias("hex"),
            ),
            "base",
        ),
    )
    pattern = f"[A-Za-z0-9+/_=-]{{{window},}}"
    candidates = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secret = F.transform(candidates, lambda c: _is_secret(c, classes, allowed, window))
    rows = rows.select("doc_id", "base", once(_located(text, pattern, 3, secret), "entropy"))
    known = F.concat("base.assign", "base.access", "base.hex")
    outside = F.filter(
        "entropy",
        lambda s: ~F.exists(
            known, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])
        ),
    )
    return rows.select("doc_id", "base.assign", "base.access", "base.hex", outside.alias("entropy"))


def op10_entropy_secrets(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.sort_array(F.concat("assign", "access", "hex"))
    every = F.sort_array(F.concat("assign", "access", "hex", "entropy"))
    *counts, n_entropy = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"),
        _written(every).alias("spans"), n_entropy,
    )


def _spans_sql(kind: int, pattern: str, keep: str = "true") -> str:
    """Matches of a pattern with their places, from the pieces between them."""
    return f"""
  SELECT doc_id, {kind} AS kind, upto - size AS start, upto AS "end", found FROM (
    SELECT *, length(found) AS size,
           sum(length(gap) + length(found)) OVER (PARTITION BY doc_id ORDER BY i) AS upto
    FROM (
      SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}', 0)) AS found,
             generate_subscripts(regexp_extract_all(text, '{pattern}', 0), 1) AS i,
             unnest(regexp_extract_all(text, '{pattern}', {2 if kind == 0 else 0})) AS value,
             unnest(string_split_regex(text, '{pattern}')
                    [:len(regexp_extract_all(text, '{pattern}', 0))]) AS gap
      FROM texts
    )
  ) WHERE {keep}"""


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _op10_sql() -> str:
    names = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    quote = "[\"'']?"
    assign = f"({names}){quote} *[:=] *{quote}([A-Za-z0-9+/_.=-]+)"
    window = 20
    per_class = ",\n  ".join(
        f"('{c.name}', '{_pattern_of(c.alphabet)}{{{window}}}', {c.bits}, {c.digits}, {c.letters},"
        f" {c.lower}, {c.upper}, {c.rises})"
        for c in CLASSES
    )
    count_of = "length(regexp_replace(w, '[^{0}]', '', 'g'))".format
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    written = "string_agg(names[kind + 1] || ':' || start || ':' || \"end\", ',' ORDER BY start, kind)"
    written = written.replace("names", f"[{kinds}]")
    counts = ", ".join(
        f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(KINDS)
    )
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_spans_sql(0, assign, f"length(value) >= {LEAST_ASSIGNED}")}
  UNION ALL {_spans_sql(1, ACCESS)}
  UNION ALL {_spans_sql(2, HEX)}
), candidates AS ({_spans_sql(3, f"[A-Za-z0-9+/_=-]{{{window},}}")}
), classes(class, pattern, bits, digits, letters, lower, upper, rises) AS (VALUES
  {per_class}
), apart AS (
  SELECT *, regexp_replace(found, '{ALLOWED}', ' ', 'g') AS read FROM candidates c
  WHERE NOT EXISTS (SELECT 1 FROM base b
                    WHERE b.doc_id = c.doc_id AND b.start <= c.start AND c."end" <= b."end")
), windows AS (
  SELECT doc_id, kind, start, "end", pos, read[pos:pos + {window - 1}] AS w
  FROM (SELECT *, unnest(range(1, length(read) - {window - 2})) AS pos FROM apart)
), wanted AS (
  SELECT doc_id, kind, start, "end", pos, w, bits FROM windows JOIN classes
    ON regexp_full_match(w, pattern) AND {count_of("0-9")} >= digits AND {count_of("A-Za-z")} >= letters
      AND {count_of("a-z")} >= lower AND {count_of("A-Z")} >= upper
      AND len(regexp_extract_all(w, '[a-z0-9][A-Z]')) >= rises
), entropies AS (
  SELECT doc_id, kind, start, "end", pos, bits, -sum(n / {window} * log2(n / {window})) AS entropy
  FROM (SELECT doc_id, kind, start, "end", pos, bits, c, count(*) AS n
        FROM (SELECT *, unnest(string_split(w, '')) AS c FROM wanted) GROUP BY ALL)
  GROUP BY ALL
), spans AS (
  SELECT doc_id, kind, start, "end" FROM base
  UNION ALL
  SELECT doc_id, kind, start, "end" FROM entropies
  GROUP BY doc_id, kind, start, "end" HAVING max(entropy - bits) >= -{ROUNDING}
), told AS (
  SELECT doc_id, {counts}, {written} AS spans,
         {written} FILTER (kind < 3) AS base
  FROM spans GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN told USING (doc_id)
"""


OP10_SQL = _op10_sql()
