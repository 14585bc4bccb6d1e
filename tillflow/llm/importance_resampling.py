"""Target-distribution importance resampling over hashed n-grams.

A document's weight is the mean log ratio of its n-grams under a target and under
the corpus, both as counts over a fixed number of buckets. Weights are perturbed
with Gumbel noise seeded by the row's key, so that the highest scores are a sample
without replacement.

The n-grams of a batch of texts are interned in an open-addressed table of NumPy
arrays. Keys are xxhash64; a key that is met again counts as the same n-gram only if
its bytes agree, else probing goes on. Bucket and count are computed and stored once
a slot, and the slot ids of the occurrences gather the buckets' gains.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.llm.common import bounded_batches, saved, table

#: Occurrences that are interned at once; the table has room for them beside what it holds.
RUN = 1 << 16
#: Byte strings longer than this are compared one by one.
LONG = 256

#: Bytes of words: digits, letters after lower-casing, and all of other scripts.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


@dataclass(frozen=True)
class Resampling:
    """``shortest`` to ``longest`` words an n-gram; ``percent`` of the documents with
    ``least_words`` are drawn. The driver and every task hold ``buckets`` gains."""

    shortest: int = 1
    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: str = "2024"


class NGramTable:
    """Distinct byte strings of one buffer, by open addressing with linear probing."""

    def __init__(self, buffer: np.ndarray, buckets: int, hashed=xxhash.xxh64_intdigest):
        self.buffer, self.bytes, self.buckets, self.hashed = buffer, buffer.tobytes(), buckets, hashed
        self._allocate(1 << 10)

    def _allocate(self, capacity: int) -> None:
        self.used = np.zeros(capacity, bool)
        self.keys = np.zeros(capacity, np.uint64)
        self.starts, self.sizes, self.counts, self.owners = np.zeros((4, capacity), np.int64)
        self.bucket = np.zeros(capacity, np.int64)

    def _equal(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the strings of ``sizes`` bytes at ``a`` and ``b`` agree."""
        same = a == b
        long = np.flatnonzero(~same & (sizes > LONG))
        same[long] = [
            self.bytes[x : x + n] == self.bytes[y : y + n]
            for x, y, n in zip(a[long].tolist(), b[long].tolist(), sizes[long].tolist())
        ]
        short = np.flatnonzero(~same & (sizes <= LONG))
        if len(short):
            n = sizes[short]
            first = np.cumsum(n) - n
            within = np.arange(n.sum()) - np.repeat(first, n)
            agree = self.buffer[np.repeat(a[short], n) + within] == self.buffer[np.repeat(b[short], n) + within]
            same[short] = np.logical_and.reduceat(agree, first)
        return same

    def _settle(self, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Slots of strings, new ones where nothing equal is found."""
        mask = len(self.used) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        slots, open_ = np.empty(len(keys), np.int64), np.arange(len(keys))
        while len(open_):
            here = at[open_]
            free = ~self.used[here]
            if free.any():
                claims = open_[free]
                self.owners[here[free]] = claims  # of several, the last one keeps the slot
                won = claims[self.owners[here[free]] == claims]
                into = at[won]
                self.used[into] = True
                self.keys[into], self.starts[into], self.sizes[into] = keys[won], starts[won], sizes[won]
            alike = np.flatnonzero((self.keys[here] == keys[open_]) & (self.sizes[here] == sizes[open_]))
            chosen, found = open_[alike], here[alike]
            chosen, found = (x[self._equal(starts[chosen], self.starts[found], sizes[chosen])] for x in (chosen, found))
            slots[chosen] = found
            at[open_] = (here + 1) & mask
            settled = np.zeros(len(keys), bool)
            settled[chosen] = True
            open_ = open_[~settled[open_]]
        return slots

    def _grow(self, room: int) -> np.ndarray:
        """Make room for that many more strings; where each old slot went."""
        old = np.flatnonzero(self.used)
        keys, starts, sizes, counts, bucket = (
            x[old] for x in (self.keys, self.starts, self.sizes, self.counts, self.bucket)
        )
        moved = np.full(len(self.used), -1)
        self._allocate(1 << (2 * (len(old) + room)).bit_length())
        moved[old] = self._settle(keys, starts, sizes)
        self.counts[moved[old]], self.bucket[moved[old]] = counts, bucket
        return moved

    def intern(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The slot of every occurrence; counts and buckets are stored by slot."""
        slots, filled = np.empty(len(starts), np.int64), 0
        for at in range(0, len(starts), RUN):
            here = slice(at, at + RUN)
            spans = zip(starts[here].tolist(), (starts[here] + sizes[here]).tolist())
            keys = np.array([self.hashed(self.bytes[a:b]) for a, b in spans], np.uint64)
            if 2 * (filled + len(keys)) > len(self.used):
                slots[:at] = self._grow(len(keys))[slots[:at]]
            before = self.used.copy()
            slots[here] = self._settle(keys, starts[here], sizes[here])
            np.add.at(self.counts, slots[here], 1)
            new = np.flatnonzero(self.used & ~before)
            filled += len(new)
            spans = zip(self.starts[new].tolist(), (self.starts[new] + self.sizes[new]).tolist())
            self.bucket[new] = [crc32(self.bytes[a:b]) % self.buckets for a, b in spans]
        return slots


def interned(texts: list[bytes | None], settings: Resampling):
    """Table, slot and document of every n-gram occurrence in order, and words a text."""
    parts = [t or b"" for t in texts]
    buffer = np.frombuffer((b"\0".join(parts) + b"\0").lower(), np.uint8).copy()
    in_word = _WORD[buffer]
    edges = np.flatnonzero(np.diff(in_word, prepend=False))
    starts, ends = edges[0::2], edges[1::2]
    borders = np.cumsum([len(p) + 1 for p in parts])
    doc = np.searchsorted(borders, starts, side="right")
    # Words stand side by side, one blank after each.
    in_word[ends], buffer[ends] = True, 0x20
    joined = buffer[in_word]
    sizes = ends - starts
    places = np.cumsum(sizes + 1) - sizes - 1
    ngrams = NGramTable(joined, settings.buckets)
    slots, docs = [], []
    for n in range(settings.shortest, settings.longest + 1):
        first = np.arange(max(0, len(starts) - n + 1))
        first = first[doc[first] == doc[first + n - 1]]
        last = first + n - 1
        slots.append(places[last] + sizes[last] - places[first])
        docs.append(first)
    spans = np.concatenate(slots) if slots else np.zeros(0, np.int64)
    first = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    found = ngrams.intern(places[first], spans)
    return ngrams, found, doc[first], np.bincount(doc, minlength=len(parts))


def bucket_counts(texts: DataFrame, settings: Resampling) -> DataFrame:
    """``bucket`` and ``n`` over all n-grams of the column ``text``."""
    bounded_batches(texts.sparkSession, 4)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(settings.buckets, np.int64)
        for batch in batches:
            ngrams, *_ = interned(batch["text"].tolist(), settings)
            np.add.at(total, ngrams.bucket[ngrams.used], ngrams.counts[ngrams.used])
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": seen, "n": total[seen]})

    parts = texts.select(F.col("text").cast("binary").alias("text"))
    return parts.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, settings: Resampling) -> np.ndarray:
    """A bucket's gain in thousandths, from two tables of at most ``buckets`` rows."""
    counts = np.zeros((2, settings.buckets), np.int64)
    for of, found in zip(counts, (corpus.toPandas(), target.toPandas())):
        of[found["bucket"]] = found["n"]
    all_s, all_t = (float(c.sum()) + settings.buckets for c in counts)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t)))
            for s, t in zip(*counts.tolist())
        ],
        np.int64,
    )


def noise(seed: str, key: str | None) -> int:
    """A Gumbel variate in thousandths, from the row's key alone."""
    h = int(sha256(f"{seed}:{key or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, of_buckets: np.ndarray, settings: Resampling) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``n_words`` of every row."""
    bounded_batches(docs.sparkSession, 4)

    def weigh(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, texts in batches:
            ngrams, slots, doc, words = interned(texts.tolist(), settings)
            n = np.bincount(doc, minlength=len(texts))
            total = np.zeros(len(texts), np.int64)
            np.add.at(total, doc, of_buckets[ngrams.bucket][slots])
            weight = total // np.maximum(n, 1)
            noises = np.array([noise(settings.seed, k) for k in keys], np.int64)
            yield pd.DataFrame(
                {"n_features": n, "weight": weight, "score": weight + noises, "n_words": words}
            )

    weigh_udf = F.pandas_udf(weigh, "n_features long, weight long, score long, n_words long")
    found = weigh_udf(F.col("doc_id").cast("string"), F.col("text").cast("binary"))
    return docs.select("doc_id", found.alias("w")).select("doc_id", "w.*")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their place in ``order``, from 1, numbered by many tasks.

    After a range sort the rows of each partition are numbered on their own; what
    reaches the driver is one count a partition. Equal rows differ by their place in
    the input, so that they can be split too.
    """
    place = F.monotonically_increasing_id()
    numbered = rows.withColumn("_tie", place).orderBy(*order, "_tie").select(
        *rows.columns,
        F.shiftright(place, 33).alias("_part"),
        place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"),
    )
    numbered = saved(numbered, "resampling-order")
    sizes = {r["_part"]: r["n"] for r in numbered.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, upto = [], 0
    for part in sorted(sizes):
        starts += [F.lit(part), F.lit(upto)]
        upto += sizes[part]
    if not starts:
        return numbered.drop("_part", "_at").withColumn("rank", F.lit(None).cast("long"))
    before = F.element_at(F.create_map(*starts), F.col("_part"))
    return numbered.withColumn("rank", (before + F.col("_at") + 1).cast("long")).drop("_part", "_at")


def resampled(docs: DataFrame, target: DataFrame, settings: Resampling = Resampling()) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score``, ``rank`` and ``n_words`` of every row.

    Of the N documents with ``least_words`` words, floor(``percent`` * N / 100) are
    drawn: those of the highest scores, ties to the smaller ``doc_id``, null ids last;
    the others have a null ``rank``. A null or empty text has no n-grams and weight 0.
    Repeated rows count each for itself, with equal scores and ranks of their own. An
    empty table gives an empty result, an empty target equal counts. Other columns of
    either table are ignored.
    """
    corpus = bucket_counts(docs, settings)
    of_buckets = gains(corpus, bucket_counts(target, settings), settings)
    rows = saved(weighted(docs, of_buckets, settings), "resampling-weights")
    enough = F.col("n_words") >= settings.least_words
    drawn = settings.percent * rows.filter(enough).count() // 100
    placed = ranked(rows.filter(enough), [F.desc("score"), F.asc_nulls_last("doc_id")])
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    few = rows.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    return placed.select(*names).union(few.select(*names))


def op12_importance_resampling(spark, sf_dir):
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampled(docs, target).drop("n_words")


def _op12_sql() -> str:
    """CRC-32 is taken byte by byte, by its polynomial's table, once a distinct word."""
    step = "CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"
    entry = "i"
    for _ in range(8):
        entry = f"list_transform([{entry}], lambda c: {step})[1]"
    return f"""
WITH crc AS (SELECT list({entry} ORDER BY i) AS t FROM range(256) r(i)),
texts AS (
  SELECT 'S' AS side, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 'T', row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT side, row, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
  FROM texts
), spelled AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)
), bytes AS (
  SELECT word, list_transform(range(1, length(h), 2),
    lambda i: 16 * (instr('0123456789ABCDEF', h[i]) - 1) + instr('0123456789ABCDEF', h[i + 1]) - 1) AS b
  FROM spelled
), buckets AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]),
    lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) % 10000 AS bucket
  FROM bytes, crc
), counted AS (
  SELECT bucket, count(*) FILTER (side = 'S') AS s, count(*) FILTER (side = 'T') AS t
  FROM words JOIN buckets USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counted
), weights AS (
  SELECT row, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM words JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 'S' GROUP BY row
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[:8])::BIGINT
      + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (row) WHERE side = 'S'
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
    count(*) OVER (PARTITION BY n_features >= 20) AS n
  FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank
FROM ordered
"""


OP12_SQL = _op12_sql()
