import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillflow.llm import registry
from tillflow.llm.disguised_pii import (
    KINDS,
    Tape,
    _outside,
    find_private,
    identifiers,
    mask_private,
    masked,
    normal_form,
    private_spans,
)

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [d * (1 + i % 2) for i, d in enumerate(map(int, digits[::-1]))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m[0])
    if kind == "ip":
        return all(int(p) <= 255 for p in m[0].split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [
        (m.start(), KINDS.index(kind), m.end())
        for kind, p in PATTERNS.items()
        for m in re.finditer(p, text)
        if passes(kind, m)
    ]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@-+1290 ()%_é\n", max_size=60))
def test_plain_identifiers(text):
    assert identifiers(text) == brute(text)


@pytest.mark.parametrize(
    "text",
    [
        "a@b.c_d@e.f x@y z@@w.q .@-.-",
        "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.03.4 1.2.3.4444",
        "4111 1111 1111 1111, 4111-1111-1111-1111 2 4111111111111112 0" * 2,
        "+1 (017) 555-5036 +1 2 +49 30 1234567890123456 ++1234567890-",
        "9" * 5000 + "@" + "a." * 3000,
    ],
)
def test_plain_identifiers_that_touch(text):
    assert identifiers(text) == brute(text)


def only(text, kind, part):
    plain, hidden = private_spans(text)
    start = text.index(part)
    assert (start, start + len(part), kind) in hidden, (plain, hidden)


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("write to jane (at) mail [dot] org now", "email", "jane (at) mail [dot] org"),
        ("jane AT mail DOT example dot org!", "email", "jane AT mail DOT example dot org"),
        ("é😀 jane[@]mail.org", "email", "jane[@]mail.org"),
        ("jаne@mail.org has a Cyrillic letter", "email", "jаne@mail.org"),
        ("ｊａｎｅ＠ｍａｉｌ．ｏｒｇ", "email", "ｊａｎｅ＠ｍａｉｌ．ｏｒｇ"),
        ("ja​ne@ma­il.org", "email", "ja​ne@ma­il.org"),
        ("host one dot two dot 3 dot 4 up", "ip", "one dot two dot 3 dot 4"),
        ("card four" + " one" * 15 + " and no more", "card", "four" + " one" * 15),
        ("call plus one 017 555 five zero 36 today", "phone", "plus one 017 555 five zero 36"),
        ("call +١ 017 555 5036", "phone", "+١ 017 555 5036"),
    ],
)
def test_disguises(text, kind, part):
    only(text, kind, part)
    assert part not in masked(text) and f"<{kind.upper()}>" in masked(text)


@pytest.mark.parametrize(
    "text",
    [
        "look at this. Than look at file.txt, or arrive at 10.30 (at last)",
        "one two three, nine lives; a dot on a line dot com",
        "Vièle aile, größer, ñandú; Привет мир, Αθήνα",
        "thinst at anre.Than at all",
    ],
)
def test_clean_texts_are_left_alone(text):
    assert private_spans(text) == ([], []) and masked(text) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.@ (at)dotone1​аＡ", max_size=50))
def test_tape_keeps_offsets(text):
    tape = normal_form(text) or Tape.of(text)
    assert len(tape.text) == len(tape.start) == len(tape.end)
    assert all(tape.start[1:] >= tape.start[:-1]) and all(tape.end > tape.start)
    for c, s, e in zip(tape.text, tape.start, tape.end):
        assert c in "@." or c.isdigit() or c == "+" or e - s == 1


def test_masks_merge_overlaps():
    assert masked("mail a@b.cd, 1.2.3.4 end") == "mail <EMAIL>, <IP> end"
    assert masked("+4111 1111 1111 1111") in ("<PHONE>", "+<CARD>")


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    found = {r.doc_id: r for r in registry.QUERIES["op2_disguised_pii"](spark, "/root/testdata/sf0.01").collect()}
    for r in docs:
        spans = brute(r.text)
        written = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        row = found[r.doc_id]
        assert row.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in KINDS] == [sum(s[2] == k for s in spans) for k in KINDS]
        assert set(filter(None, written.split(","))) <= set(row.spans.split(","))


def test_odd_rows(odd, repeated):
    for docs in (odd, repeated):
        assert find_private(docs).count() == docs.count()
        clean = mask_private(docs)
        assert clean.columns == docs.columns
        assert sorted(map(repr, clean.collect())) == sorted(map(repr, docs.collect()))
    assert find_private(odd.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("host one nine two dot one six eight dot one dot one up", "ip", "one nine two dot one six eight dot one dot one"),
        ("at one-nine-two.one-six-eight.two five.one zero.", "ip", "one-nine-two.one-six-eight.two five.one zero"),
        ("nine nine one dot two dot three dot four", "ip", "one dot two dot three dot four"),
        ("jane one two at mail dot org", "email", "one two at mail dot org"),
        ("é😀 One two (at) three  four [dot] org", "email", "One two (at) three  four [dot] org"),
    ],
)
def test_neighbouring_digit_words_are_one_number(text, kind, part):
    assert private_spans(text)[1].count((text.index(part), text.index(part) + len(part), kind)) == 1
    assert len(private_spans(text)[1]) == 1 and part not in masked(text)


def test_the_sweep_drops_what_lies_within():
    r = random.Random(6)
    draw = lambda: (a := r.randrange(60), a + r.randrange(1, 12), r.choice(["email", "ip"]))
    for _ in range(300):
        spans, covers = {draw() for _ in range(12)}, {draw() for _ in range(6)}
        within = {s for s in spans for c in covers if c[0] <= s[0] and s[1] <= c[1] and s[2] == c[2]}
        assert _outside(spans, covers) == spans - within
