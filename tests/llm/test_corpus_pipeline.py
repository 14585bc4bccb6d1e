import re
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_disguised_pii import brute as plain_identifiers
from test_line_windows import brute as brute_lines
from test_simhash import brute_components, brute_fingerprint
from tillflow.llm.common import saved, table
from tillflow.llm.risk_rules import judged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(session):
    """What each stage returns, by name, read back as rows."""
    docs, out = table(session, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(session, docs, SF), f"test-{name}")
        out[name] = docs.collect()
        if name != "packing":
            assert docs.dtypes == table(session, SF, "documents").dtypes
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "pii", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality_drops_what_the_rules_reject(session, stages):
    docs, labels = table(session, SF, "documents"), table(session, SF, "labels")
    kept = {r.doc_id for r in judged(docs, labels).filter("kept").collect()}
    assert {r.doc_id for r in stages["quality"]} == kept and kept
    whole = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in whole for r in stages["quality"])


def test_line_dedup_matches_brute_force(stages):
    expected = brute_lines([(r.doc_id, r.text) for r in stages["quality"]])
    texts = {key[1]: text for key, (text, _, _) in expected.items()}
    assert {r.doc_id: r.text for r in stages["line_dedup"]} == texts
    assert all(r.n_chars == len(r.text) for r in stages["line_dedup"])


def test_one_document_of_each_group_stays(stages):
    prints = {r.doc_id: brute_fingerprint(r.text) for r in stages["line_dedup"]}
    roots = brute_components(sorted(set(prints.values())), 2)
    least = {}
    for i, f in prints.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    before = {r.doc_id: tuple(r) for r in stages["line_dedup"]}
    assert sorted(map(tuple, stages["near_dedup"])) == sorted(before[i] for i in least.values())


def test_no_identifier_is_left(stages):
    assert {r.doc_id for r in stages["pii"]} == {r.doc_id for r in stages["near_dedup"]}
    assert not [r.doc_id for r in stages["pii"] if plain_identifiers(r.text)]
    before = {r.doc_id: r.text for r in stages["near_dedup"]}
    changed = [r for r in stages["pii"] if r.text != before[r.doc_id]]
    assert all(re.search("<(EMAIL|IP|CARD|PHONE)>", r.text) for r in changed)
    assert {r.doc_id for r in changed} >= {i for i, t in before.items() if plain_identifiers(t)}


def test_packed_ids_are_the_texts(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in stages["packing"]:
        pieces.setdefault(r.doc_id, []).append(r)
    for r in stages["pii"]:
        own = sorted(pieces.pop(r.doc_id), key=lambda p: p.start)
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in own]).tolist()
        assert ids == [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]
        assert all(p.ids_crc32 == crc32(p.ids) for p in own)
    assert not pieces


def test_run_is_the_stages_in_turn(session, stages):
    found = corpus_pipeline.run(session, SF).collect()
    assert sorted(tuple(r)[:4] for r in found) == sorted(tuple(r)[:4] for r in stages["packing"])


def test_empty_documents(session):
    docs = table(session, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(session, docs, SF)
        assert docs.count() == 0
