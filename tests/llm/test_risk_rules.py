import math
import time
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from tillflow.llm.risk_rules import (
    RULES,
    binomial_tail,
    certified_cutoffs,
    features,
    judged,
    keep_good,
)

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = [w for w in "".join(" " if c in SPACE else c for c in text).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def check(docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = features(docs).collect()
    assert sorted(((r.doc_id, *[r[n] for n in names]) for r in found), key=repr) == sorted(
        ((r.doc_id, *brute(r.text)) for r in docs.collect()), key=repr
    )


def test_features_of_the_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_features_of_odd_rows(odd, repeated, documents):
    check(odd)
    check(repeated)
    check(documents(["a b c d e " * 3, "a a a a a a", "a a a a a", "p q a b c d e r a b c d e s"]))


@pytest.mark.parametrize("n, k", [(10, 0), (50, 1), (400, 3), (3000, 8), (20000, 0), (20000, 60)])
def test_binomial_tail(spark, n, k):
    rate = 0.004
    exact = sum(
        math.exp(
            math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1)
            + j * math.log(rate) + (n - j) * math.log1p(-rate)
        )
        for j in range(k + 1)
    )
    row = spark.createDataFrame([(n, k)], "n BIGINT, k BIGINT")
    found = row.select(binomial_tail(F.col("n"), F.col("k"), rate).alias("p")).first().p
    assert found == pytest.approx(1.0 if k >= n * rate else exact, rel=1e-9)


def log_factorial(x):
    """By Stirling's formula in 50 places, for large ``x``."""
    x, tau = Decimal(x), Decimal("6.28318530717958647692528676655900576839433879875021")
    return x * x.ln() - x + (tau * x).ln() / 2 + 1 / (12 * x) - 1 / (360 * x**3)


@pytest.mark.parametrize("n, k", [(10**6, 3700), (10**9, 3_990_000), (10**10, 39_999_000), (10**11, 10**6)])
def test_binomial_tail_of_many_labels_takes_few_steps(spark, n, k):
    rate = 0.004
    with localcontext() as context:
        context.prec = 50
        p = Decimal(rate)
        last = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * p.ln() + (n - k) * (1 - p).ln()
        exact, term, j = Decimal(0), last.exp(), k
        while j >= 0 and term > exact * Decimal(10) ** -20:
            exact += term
            term *= j * (1 - p) / ((n - j + 1) * p)
            j -= 1
    row = spark.createDataFrame([(n, k)], "n BIGINT, k BIGINT")
    started = time.monotonic()
    found = row.select(binomial_tail(F.col("n"), F.col("k"), rate).alias("p")).first().p
    assert time.monotonic() - started < 10  # term by term from zero the third took 4 * 10^7 steps
    assert found == (0 if exact < Decimal("1e-320") else pytest.approx(float(exact), rel=1e-6))


@pytest.mark.parametrize("n", [1, 5, 40, 1000, 3000])
def test_binomial_tails_of_few_labels(spark, n):
    rate = 0.3
    rows = spark.createDataFrame([(n, k) for k in range(min(n, 60) + 1)], "n BIGINT, k BIGINT")
    found = {r.k: r.p for r in rows.select("k", binomial_tail(F.col("n"), F.col("k"), rate).alias("p")).collect()}
    with localcontext() as context:
        context.prec = 50
        exact, p = Decimal(0), Decimal(rate)
        for k in sorted(found):
            exact += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            expected = 1.0 if k >= n * rate else float(exact)
            assert found[k] == pytest.approx(expected, rel=1e-9, abs=1e-300)


def counts(spark, rows):
    return spark.createDataFrame(
        rows,
        "doc_id BIGINT, stratum STRING, n_words BIGINT, word_chars BIGINT, n_symbols BIGINT,"
        " n_lines BIGINT, n_dup_lines BIGINT, n_repeat_words BIGINT",
    )


def test_cutoffs_hold_back_where_good_documents_would_go(spark):
    # 5000 good ones; in "busy" a fifth has one symbol a word, in "few" hardly any are labelled.
    rows = [(i, "plain", 100, 500, 0, 10, 0, 0) for i in range(5000)]
    rows += [(5000 + i, "busy", 100, 500, 100 * (i % 5 == 0), 10, 0, 0) for i in range(5000)]
    rows += [(10000 + i, "few", 100, 500, 0, 10, 0, 0) for i in range(50)]
    table = counts(spark, rows)
    labels = table.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    found = {r.stratum: r for r in certified_cutoffs(table, labels).collect()}
    assert found["plain"].symbols_cutoff == 0.1
    assert found["busy"].symbols_cutoff == 1.0  # rejects rates above 1 only
    assert found["few"].symbols_cutoff is None
    assert found["plain"].repeats_cutoff == 0.1


def test_every_cutoff_certified_keeps_its_promise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    verdicts = judged(docs, labels).join(labels, "doc_id")
    good = verdicts.filter("quality = 1 AND n_words > 0").groupBy("stratum").agg(
        F.avg((F.col("rejected_by") != "").cast("int")).alias("rate")
    )
    assert all(r.rate <= 0.02 for r in good.collect())
    bad = verdicts.filter("quality = 0 AND stratum = 'en'")
    assert bad.filter("NOT kept").count() > 0.2 * bad.count()


def test_base_rules_and_odd_rows(odd, repeated, spark):
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 0), (7, None, None)], "doc_id BIGINT, quality INT, toxic INT")
    for docs in (odd, repeated):
        found = judged(docs, labels).collect()
        assert len(found) == docs.count()
        for r in found:
            failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
            assert r.base_failed == failed and (not failed or not r.kept)
    kept = keep_good(repeated, labels)
    assert kept.columns == repeated.columns
    assert kept.count() == judged(repeated, labels).filter("kept").count()
    assert judged(odd.limit(0), labels).count() == 0
    assert judged(odd, labels.limit(0)).filter("rejected_by <> ''").count() == 0
    assert len(RULES) == len({r.name for r in RULES})
