import random
import re

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tillflow.llm.license_rules import BASE, RULES, Rule
from tillflow.llm.license_scan import op11_license_scan, scan_licenses, _op11_sql

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, rules=RULES):
    """Detections as (first word, last word, rule, kept) and the number of words."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    joined, places = " ".join(words), []
    known = set(words)
    for i, r in enumerate(rules):
        if r.keyword in known:
            for m in re.finditer(f"(?<![^ ]){r.lead}({r.pattern})(?![^ ])", joined):
                first = joined.count(" ", 0, m.start(1))
                places.append((first, first + m.group(1).count(" "), i))

    def covers(q, p):
        better = (rules[q[2]].tier, -(q[1] - q[0]), q[2]) < (rules[p[2]].tier, -(p[1] - p[0]), p[2])
        return q[0] <= p[0] and q[1] >= p[1] and better

    return len(words), sorted((*p, not any(covers(q, p) for q in places)) for p in places)


def written(row):
    return row.n_words, [(d.start, d.end, d.rule, d.kept) for d in row.detections]


def labels(row):
    return set(filter(None, row.labels.split(",")))


@settings(max_examples=3 * len(RULES), deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_no_match_without_its_keyword(data):
    rule = data.draw(st.sampled_from(RULES))
    match = data.draw(st.from_regex(re.compile(rule.lead + rule.pattern, re.ASCII), fullmatch=True))
    assert rule.keyword in match.split(" ")


def test_hundreds_of_rules_and_the_base_first():
    assert len(RULES) > 300 and RULES[:3] == BASE
    assert all(1 <= r.tier <= 4 and re.fullmatch("[a-z0-9]+", r.keyword) for r in RULES)
    assert len({(r.label, r.lead, r.pattern) for r in RULES}) == len(RULES)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Released under the MIT License.", {"mit"}),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", {"mit", "apache-2.0"}),
        ("SPDX-License-Identifier: GPL-3.0-or-later", {"gpl-3.0-or-later"}),
        ("Licensed under the Apache License, Version 2.0.", {"apache", "apache-2.0"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}),
        ("GNU Lesser General Public License v2.1", {"gpl", "lgpl-2.1"}),
        ("under CC BY-NC-SA 4.0", {"cc-by-nc-sa-4.0"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
        ("see https://opensource.org/licenses/BSD-3-Clause", {"bsd-3-clause"}),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl-2.0"}),
        ("Neither the name of Acme Ltd nor the names of its contributors may be used to endorse or promote"
         " products derived from this software without specific prior written permission.", {"bsd-3-clause"}),
        ("a common library of general public interest, with permission to license the side doors", set()),
        ("mitt license, submit licenses; apache helicopters", set()),
        ("the MIT\n\nLICENSE", {"mit"}),
    ],
)
def test_planted_notices(documents, text, expected):
    assert labels(scan_licenses(documents([text])).first()) == expected


def test_containment_and_priority(documents):
    rules = (
        Rule("a", 3, "one", "one two"),
        Rule("b", 2, "two", "one two three"),
        Rule("c", 1, "two", "two"),
        Rule("d", 2, "three", "two three four"),
        Rule("e", 2, "two", "one two three"),
        Rule("f", 4, "five", "five"),
        Rule("g", 3, "five", "five six"),
    )
    text = "one two three four five six, one two. one, two three"
    row = scan_licenses(documents([text]), rules).first()
    assert written(row) == brute(text, rules)
    kept = {(d.start, rules[d.rule].label) for d in row.detections if d.kept}
    assert kept >= {(0, "b"), (1, "c"), (1, "d"), (4, "g"), (6, "a")}
    assert not any(d.kept for d in row.detections if rules[d.rule].label in "ef")


def test_matches_brute_force(documents):
    draw = random.Random(11)
    parts = [re.sub(r"\(\?:|\)\??|\{.*?\}|[?\[\]^]", "", r.pattern).replace("|", " ") for r in RULES]
    parts += ["mit license", "Apache License, Version 2.0", "lorem", "ipsum dolor", "license", "GPLv3", "é 漢字"]
    texts = [" ".join(draw.choice(parts) for _ in range(draw.randrange(40))) for _ in range(60)]
    found = scan_licenses(documents(texts)).collect()
    assert {r.doc_id: written(r) for r in found} == {i: brute(t) for i, t in enumerate(texts)}


def sql_rows(df):
    duck = duckdb.connect()
    documents = df.toPandas()
    duck.register("documents", documents)
    found = duck.sql(_op11_sql())
    return sorted(map(repr, found.select(*map(duckdb.ColumnExpression, sorted(found.columns))).fetchall()))


@pytest.mark.parametrize("kind", ["odd", "repeated"])
def test_odd_rows(spark, monkeypatch, request, kind):
    df = request.getfixturevalue(kind)
    more = spark.createDataFrame([(90, "MIT License mit license " * 3000, "en", "s", 1)], df.schema[:5])
    df = df.unionByName(more, allowMissingColumns=True)
    monkeypatch.setattr("tillflow.llm.license_scan.table", lambda *_: df)
    out = op11_license_scan(spark, "")
    rows = out.select(*sorted(out.columns)).collect()
    if kind == "odd":  # pandas turns ids with nulls into floats
        assert sorted(repr(tuple(r)) for r in rows) == sql_rows(df)
    assert len(rows) == df.count()
    longest = [r for r in rows if r.doc_id == 90]
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.labels, r.score) for r in longest] == [
        (12000, 6000, 0, 11998, "mit", 0.8)
    ]
    assert all(r.labels == "" and r.score == 0 and r.first_word is None for r in rows if r.doc_id != 90)


def test_no_rows(documents):
    assert scan_licenses(documents([])).collect() == []


def test_native_and_one_shuffle(documents):
    plan = scan_licenses(documents(["mit license"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert plan.count("Exchange") == 1
