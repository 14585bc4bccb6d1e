"""Packing by lexical retrieval over a sharded BM25 inverted index.

Documents are tokenised once. A document longer than the window fills windows by
itself; what remains of it is retrieved like a short one. Documents are sorted by
their least hashes over rarer tokens, so that those that share such tokens stand
close, and each run of about ``shard_tokens`` tokens is a shard. Each shard has an
inverted index with the statistics of the whole corpus. In a shard, a seed document
retrieves its best unused neighbours, which fill its window; the one that is cut goes
on as the next seed.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.common import bounded_batches, empty_if_null, saved, table

END_ID = 1
WINDOW = 2048
#: BM25's usual constants.
K1, B = 1.2, 0.75
#: Byte-level merges are numbered by how common they are. Tokens below this say little.
COMMON_IDS = 5000
#: Least hashes by which documents are sorted. Those that agree on all of them are
#: sorted by row, so a group of any size is cut.
ROUTE_IDS = 16
#: Tasks of the packing at most; beyond, each packs several shards one after the other.
MOST_TASKS = 20_000
#: Kinds of tokens a seed asks for, the most telling first.
QUERY_TERMS = 32


@dataclass(frozen=True)
class Packing:
    """``shard_tokens`` is about what a shard holds; a longer document has one of its own.

    ``added`` are tokens beside the ranks, as text and id, that are looked for
    before all others. Without ``keep_ids`` pieces come back without their ids.
    """

    ranks_path: str
    pattern: str
    window: int = WINDOW
    end_id: int = END_ID
    shard_tokens: int = 1 << 21
    keep_ids: bool = True
    added: tuple[tuple[str, int], ...] = ()

    def stored(self) -> str:
        """Type of ids between steps: two bytes each where the vocabulary allows."""
        with open(self.ranks_path, "rb") as ranks:
            size = sum(1 for _ in ranks)
        size = max(size, self.end_id + 1, *[number + 1 for _, number in self.added])
        return "<u2" if size < 1 << 16 else "<u4"


def added_tokens(vocabulary: str) -> tuple[tuple[str, int], ...]:
    """The tokens a tokenizer's file names beside its merges, as text and id."""
    with open(vocabulary, encoding="utf-8") as file:
        return tuple((t["content"], t["id"]) for t in json.load(file)["added_tokens"])


def _tokenizer(ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...]):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(added))


TWO_SPACES = re.compile(r"\s\s")
LOOKAHEAD = r"\s+(?!\S)|"


@lru_cache(1)
def encoder(ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
    """Text to an array of ids.

    The pattern's lookahead only matters where white space meets white space;
    other texts go through the pattern without it, which is twice as fast.
    """
    exact = _tokenizer(ranks_path, pattern, added)
    plain = _tokenizer(ranks_path, pattern.replace(LOOKAHEAD, ""), added)

    def encode(text: str) -> np.ndarray:
        fitting = exact if TWO_SPACES.search(text) else plain
        special = {token for token, _ in added if token in text}
        return fitting.encode_to_numpy(text, allowed_special=special, disallowed_special=())

    return encode


def _route(kinds: np.ndarray) -> bytes:
    """The least hashes of the ids that are not too common, else of all, in order as bytes."""
    telling = kinds[np.searchsorted(kinds, COMMON_IDS) :]
    chosen = telling if len(telling) else kinds
    mixed = chosen.astype(np.uint32) * np.uint32(2654435761)  # a fixed shuffle
    return np.sort(mixed)[:ROUTE_IDS].astype(">u4").tobytes()


def tokenized(docs: DataFrame, packing: Packing) -> DataFrame:
    """``doc_id``, ``row``, ``ids`` (of the type ``stored`` names), ``n`` and ``route`` of each row."""
    stored = packing.stored()

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        to_ids = encoder(packing.ranks_path, packing.pattern, packing.added)
        for texts in batches:
            rows = []
            for text in texts:
                ids = np.append(to_ids(text), packing.end_id).astype(stored)
                rows.append((ids.tobytes(), len(ids), _route(np.unique(ids))))
            yield pd.DataFrame(rows, columns=["ids", "n", "route"])

    encode_udf = F.pandas_udf(encode, "ids binary, n long, route binary")
    rows = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), encode_udf(empty_if_null("text")).alias("t")
    )
    return rows.select("doc_id", "row", "t.*")


def document_frequencies(tokens: DataFrame, stored: str) -> DataFrame:
    """``id`` and ``df`` over all documents: at most a row per word of the vocabulary."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch["ids"]:
                kinds = np.unique(np.frombuffer(ids, stored))
                if kinds[-1] >= len(total):
                    total = np.pad(total, (0, int(kinds[-1]) + 1 - len(total)))
                total[kinds] += 1
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen, "df": total[seen]})

    parts = tokens.select("ids").mapInPandas(count, "id long, df long")
    return parts.groupBy("id").agg(F.sum("df").alias("df"))


class Index:
    """BM25 inverted index of one shard's documents."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float):
        sizes = np.array([len(x) for x in ids])
        self.n = len(ids)
        width = np.uint64(len(idf))
        keys = np.repeat(np.arange(self.n, dtype=np.uint64), sizes) * width
        keys += np.concatenate(ids).astype(np.uint64)
        keys, tf = np.unique(keys, return_counts=True)
        self.doc = (keys // width).astype(np.int32)
        self.term = (keys % width).astype(np.int32)
        norm = K1 * (1 - B + B * sizes / max(mean_length, 1.0))
        self.weight = (idf[self.term] * tf * (K1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        self.first = np.searchsorted(self.doc, np.arange(self.n + 1))
        order = np.argsort(self.term, kind="stable")
        self.posted_doc, self.posted_weight = self.doc[order], self.weight[order]
        self.posted = np.searchsorted(self.term[order], np.arange(len(idf) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """Scores of all documents for the seed's most telling terms."""
        here = slice(self.first[seed], self.first[seed + 1])
        terms, weights = self.term[here], self.weight[here]
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argpartition(-weights, QUERY_TERMS)[:QUERY_TERMS]]
        places = np.concatenate([np.arange(self.posted[t], self.posted[t + 1]) for t in terms])
        return np.bincount(self.posted_doc[places], self.posted_weight[places], self.n)


def pack(ids: list[np.ndarray], index: Index, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)``.

    ``ids`` and ``index`` hold the documents in the order in which they become
    seeds when nothing is left over. Every sequence but the last is full.
    """
    unused, sizes = np.ones(len(ids), bool), np.array([len(x) for x in ids])
    sequence = offset = 0
    for first in range(len(ids)):
        if not unused[first]:
            continue
        queue, seed, asked = [first], first, False
        while queue:
            doc = queue.pop(0)
            unused[doc] = False
            start = 0
            while start < len(ids[doc]):
                length = min(window - offset, len(ids[doc]) - start)
                yield doc, start, length, sequence, offset
                start, offset = start + length, offset + length
                if offset == window:
                    sequence, offset = sequence + 1, 0
                    # What the cut document leaves over seeds the next window.
                    queue, seed, asked = [], doc, False
            if offset and not queue and not asked:
                asked = True
                scores = index.scores(seed)
                ranked = np.flatnonzero(unused & (scores > 0))
                best = ranked[np.argsort(-scores[ranked], kind="stable")]
                filled = np.cumsum(sizes[best])
                enough = int(np.searchsorted(filled, window - offset)) + 1
                queue = best[:enough].tolist()


def shards(rows: Iterable[tuple], shard_tokens: int) -> Iterator[list[tuple]]:
    """Runs of rows, of half to one and a half ``shard_tokens`` but for longer rows.

    ``rows`` end with their route and their number of tokens. A run ends where the
    route changes, unless rows of one route fill half a shard. At most one run is held.
    """
    held, tokens = [], 0
    for row in rows:
        held.append(row)
        tokens += row[-1]
        while 2 * tokens > 3 * shard_tokens and len(held) > 1:
            upto = np.cumsum([r[-1] for r in held])
            most = max(1, int(np.searchsorted(upto, shard_tokens, side="right")))
            least = max(1, int(np.searchsorted(upto, shard_tokens // 2)))
            borders = (i for i in range(most, least, -1) if held[i - 1][-2] != held[i][-2])
            first = next(borders, most)
            yield held[:first]
            held, tokens = held[first:], tokens - int(upto[first - 1])
    if held:
        yield held


def in_route_order(tokens: DataFrame, tasks: int) -> DataFrame:
    """``tokens`` sorted by route over ``tasks`` partitions, with their ``part``.

    A route may hold any share of the rows: the next hash, and at last the row itself,
    tells where it is cut.
    """
    order = ["route", "row"]
    dealt = tokens.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return dealt.withColumn("part", F.spark_partition_id())


def pack_documents(docs: DataFrame, packing: Packing) -> DataFrame:
    """Pieces of all rows of ``docs`` in sequences of at most ``window`` tokens.

    Columns: ``doc_id``, ``start`` and ``length`` in the document's ids,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``. A null or
    empty text is the end id alone. Repeated rows are packed each for itself. Of
    neighbours with equal scores the one with the lesser ``doc_id``, read as text, comes
    first. One sequence in a shard may be short, all others are full. An empty table
    gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    tokens = saved(tokenized(docs, packing), "bm25-tokens")
    totals = tokens.agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).first()
    n_docs, n_tokens = totals["docs"], totals["tokens"] or 0

    # At most a row per word of the vocabulary.
    frequencies = document_frequencies(tokens, packing.stored()).toPandas()
    size = int(frequencies["id"].max()) + 1 if len(frequencies) else 1
    df = np.zeros(size)
    df[frequencies["id"]] = frequencies["df"]
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean_length = n_tokens / max(1, n_docs)
    window, keep_ids, stored, shard_tokens = packing.window, packing.keep_ids, packing.stored(), packing.shard_tokens

    def pack_shard(rows: list[tuple], first_sequence: int) -> pd.DataFrame:
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
        ids = [np.frombuffer(r[1], stored) for r in rows]
        # Windows that a long document fills alone need no neighbours.
        whole = [len(x) // window * window for x in ids]
        rests = [(i, x[w:]) for i, (x, w) in enumerate(zip(ids, whole)) if w < len(x)]
        pieces = [
            (i, start, window, k, 0)
            for k, (i, start) in enumerate(
                (i, start) for i, w in enumerate(whole) for start in range(0, w, window)
            )
        ]
        done = len(pieces)
        if rests:
            short = [x for _, x in rests]
            for doc, start, length, sequence, offset in pack(
                short, Index(short, idf, mean_length), window
            ):
                i = rests[doc][0]
                pieces.append((i, whole[i] + start, length, done + sequence, offset))
        out = []
        for i, start, length, sequence, offset in pieces:
            part = ids[i][start : start + length].astype("<u4").tobytes()
            out.append(
                (rows[i][0], start, length, crc32(part), len(ids[i]), first_sequence + sequence, offset,
                 part if keep_ids else None)
            )
        names = "doc_id start length ids_crc32 doc_tokens sequence_id offset ids".split()
        return pd.DataFrame(out, columns=names)

    def pack_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = 0

        def rows() -> Iterator[tuple]:
            nonlocal part
            for batch in batches:
                part = int(batch["part"].iat[0]) if len(batch) else part
                yield from zip(batch["doc_id"], batch["ids"], batch["route"], batch["n"].tolist())

        for k, shard in enumerate(shards(rows(), shard_tokens)):
            yield pack_shard(shard, part << 48 | k << 32)

    tasks = max(1, min(MOST_TASKS, -(-n_tokens // shard_tokens)))
    placed = in_route_order(tokens, tasks).select(
        F.col("doc_id").cast("string").alias("doc_id"), "ids", "route", "n", "part"  # pandas has no null longs
    )
    pieces = placed.mapInPandas(
        pack_partition,
        "doc_id string, start long, length long, ids_crc32 long, doc_tokens long,"
        " sequence_id long, offset long, ids binary",
    )
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))


def op1_bm25_packing(spark, sf_dir):
    import public_tokenizers

    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    packing = Packing(
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False, added=added
    )
    return pack_documents(table(spark, sf_dir, "documents"), packing).drop("ids")
