from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tillflow.llm import registry
from tillflow.llm.bm25_packing import Index, Packing, encoder, in_route_order, pack, pack_documents, shards

PACKING = Packing(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text",
    ["", "a  b", "x\n\n y \t z ", "<|endoftext|> don't 12ab é😀漢   ", " \x1c \x85x", "aaa" * 900],
)
def test_ids_are_the_tokenizer_s(reference, text):
    assert encoder(PACKING.ranks_path, PACKING.pattern)(text).tolist() == reference(text)


def check(found, docs, reference, window):
    """Every id in exactly one piece, sequences gapless, at most ``window`` long."""
    wanted = {}
    for r in docs.collect():
        ids = [*reference(r.text), 1]
        wanted.setdefault(r.doc_id, []).append(ids)
    pieces, sequences = {}, {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == wanted.keys()
    for key, texts in wanted.items():
        rows = sorted(pieces[key], key=lambda r: (r.doc_tokens, r.start, r.length))
        assert sum(r.length for r in rows) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for r in rows:
                part = np.array(texts[0][at : at + r.length], "<u4").tobytes()
                assert (r.start, r.doc_tokens) == (at, len(texts[0]))
                assert r.ids_crc32 == crc32(part) and r.length > 0
                at += r.length
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        sizes.append(at)
    return sizes


def test_whole_table(spark, reference):
    sf = "/root/testdata/sf0.001"
    found = registry.QUERIES["op1_bm25_packing"](spark, sf).collect()
    sizes = check(found, spark.read.parquet(f"{sf}/documents.parquet"), reference, 2048)
    assert sum(s < 2048 for s in sizes) <= 1


def test_many_shards(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    small = Packing(PACKING.ranks_path, PACKING.pattern, window=128, shard_tokens=4096)
    found = pack_documents(docs, small)
    sizes = check(found.collect(), docs, reference, 128)
    shards = found.selectExpr("sequence_id >> 32 AS shard").distinct().count()
    assert shards > 10 and sum(s < 128 for s in sizes) <= shards


def test_odd_rows(odd, repeated, reference):
    for docs in (odd, repeated):
        check(pack_documents(docs, PACKING).collect(), docs, reference, 2048)
    assert pack_documents(odd.limit(0), PACKING).count() == 0


def brute_scores(ids, idf, mean, seed, terms):
    tf = lambda t, d: list(d).count(t)
    weight = lambda t, d: idf[t] * tf(t, d) * 2.2 / (
        tf(t, d) + 1.2 * (1 - 0.75 + 0.75 * len(d) / mean)
    )
    own = sorted(set(ids[seed]), key=lambda t: -weight(t, ids[seed]))[:terms]
    return [sum(weight(t, d) for t in own if t in d) for d in ids]


def test_bm25_scores_and_greedy_order():
    r = np.random.default_rng(4)
    ids = [r.integers(0, 40, r.integers(1, 30)).astype(np.uint32) for _ in range(30)]
    idf = r.random(40).astype(np.float32) + 0.1
    index = Index(ids, idf, 12.0)
    for seed in range(30):
        found = index.scores(seed)
        assert found == pytest.approx(brute_scores(ids, idf, 12.0, seed, 32), rel=1e-4)
    order = []
    for doc, start, *_ in pack(ids, index, 64):
        if start == 0:
            order.append(doc)
    assert sorted(order) == list(range(30)) and order[0] == 0
    best = max((s, -i) for i, s in enumerate(index.scores(0)) if i)
    assert order[1] == -best[1]


def test_neighbours_share_a_window(spark, documents):
    texts = [
        "common words here " + ("zebra quagga okapi " * 30 if i % 10 == 0 else "filler text " * 45) + str(i)
        for i in range(200)
    ]
    found = pack_documents(documents(texts), PACKING).collect()
    together = {}
    for r in found:
        together.setdefault(r.sequence_id, set()).add(r.doc_id % 10 == 0)
    assert sum(kinds == {True, False} for kinds in together.values()) <= 2


def test_shards_are_near_their_size_and_whole():
    draw = np.random.default_rng(1)
    rows = [(i // 3, int(n)) for i, n in enumerate(draw.integers(1, 60, 9000))]
    rows += [(3000, 5000), (3001, 9000), (3002, 1)] + [(3003, 90)] * 50
    found = list(shards(iter(rows), 1000))
    assert [r for shard in found for r in shard] == rows
    sizes = [sum(n for _, n in shard) for shard in found]
    assert all(500 <= n <= 1500 for n in sizes[:-9]) and len(sizes) > 200
    ends = {shard[-1][0] for shard in found[:-9]}
    assert not any(shard[0][0] in ends for shard in found[:-9])
    assert list(shards(iter([]), 10)) == []


def test_the_file_s_added_token_is_one_id(documents, spark, monkeypatch):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|>\n\n<|endoftext|> y", "<|endoftext", None]
    docs = documents(texts)
    monkeypatch.setattr("tillflow.llm.bm25_packing.table", lambda *_: docs)
    rows = registry.QUERIES["op1_bm25_packing"](spark, "").collect()
    packed = corpus_pipeline.packing(spark, docs, "").collect()
    for found in (rows, packed):
        assert sorted((r.doc_id, r.doc_tokens, r.ids_crc32) for r in found) == [
            (i, len(ids), crc32(np.array(ids, "<u4").tobytes()))
            for i, t in enumerate(texts)
            for ids in [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]]
        ]
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 65]


def test_crowded_routes_are_split_by_content(spark):
    """Copies stand side by side where documents of one first hash fill many shards."""
    r = np.random.default_rng(7)
    rows, route = [], lambda *ids: np.array(ids, ">u4").tobytes()
    for i in range(400):
        own = route(5000, *r.permutation(400)[:5].tolist())
        rows += [(4 * i, own, 100, i), (4 * i + 2, own, 100, i)]
    rows += [(2001 + 2 * i, route(6000), 100, -1) for i in range(500)]  # one route: cut by row
    tokens = spark.createDataFrame(rows, "row long, route binary, n long, copy long").repartition(5)
    parts = {}
    for x in in_route_order(tokens, 12).collect():
        parts.setdefault(x.part, []).append((x.copy, x.route, x.n))
    assert len(parts) == 12
    found = [[copy for copy, *_ in shard] for part in parts.values() for shard in shards(part, 1000)]
    assert sorted(c for shard in found for c in shard) == sorted(row[3] for row in rows)
    apart = [c for c in range(400) if sum(c in shard for shard in found) > 1]
    assert len(apart) < 12 and sum(-1 in shard for shard in found) > 30
    assert sum({-1} < set(shard) for shard in found) <= 2


def test_one_shuffle_and_no_join(documents):
    found = pack_documents(documents(["same words"] * 50 + ["others"]), PACKING)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert found.count() == 51
