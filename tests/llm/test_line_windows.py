import random

from tillflow.llm.line_windows import dedup_lines


def brute(rows, window=3):
    """Texts after dedup, in the order of rows sorted by id."""
    seen, out = set(), {}
    for key in sorted({(i is not None, i or 0, t or "") for i, t in rows}):
        lines = key[2].split("\n")
        worded = [i for i, line in enumerate(lines) if line.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for at in range(len(worded) - window + 1):
            span = worded[at : at + window]
            body = tuple(lines[i] for i in span)
            if body in seen:
                gone.update(range(span[0], span[-1] + 1))
            seen.add(body)
        out[key] = "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone), len(lines)
    return out


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute(rows)
    found = dedup_lines(docs)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    assert found.columns == [*kept, "n_lines", "n_removed"]
    collected = found.collect()
    wanted = []
    for i, t in rows:
        text, gone, lines = expected[i is not None, i or 0, t or ""]
        wanted.append((i, t if t is None else text, gone, 0 if t is None else lines))
    assert sorted(((r.doc_id, r.text, r.n_removed, r.n_lines) for r in collected), key=repr) == sorted(
        wanted, key=repr
    )


def test_random_lines(documents):
    r = random.Random(3)
    texts = [
        "\n".join(r.choice(["a", "b", "c", "", " ", "d e"]) for _ in range(r.randint(0, 25)))
        for _ in range(60)
    ]
    check(documents(texts, h1="int", _gone="int", n_lines="int"))


def test_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_odd_rows(odd, repeated):
    check(odd)
    check(repeated)
    assert dedup_lines(odd.limit(0)).count() == 0


def test_overlapping_windows_are_merged(documents):
    passage = "\n".join(f"line {i}" for i in range(6))
    docs = documents([passage, f"head\n{passage}\ntail"])
    assert [r.text for r in dedup_lines(docs).orderBy("doc_id").collect()] == [passage, "head\ntail"]


def test_no_python_in_the_plan(odd):
    plan = dedup_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
