"""Distinct sampled segmentations by perturbed A* over the piece lattice.

Gumbel noise is added to the log-probability of every segmentation of a text, top
down: the set of all segmentations has the largest perturbed value, and each
split of a set hands its value to the part that holds the best and draws a
smaller, truncated one for the rest. Best-first search over such sets pops
segmentations in the order of their perturbed values, so the first k are a sample
without replacement. The (k+1)-th value gives each its inclusion probability.

Pieces never cross a word border, so a text's lattice is a chain of word
lattices. A task takes a run of texts at a time: the lattices of their distinct
words are built together, and the first walk goes through all texts at once.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, count
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.common import bounded_batches, empty_if_null, table

SPACE = "▁"
WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
#: A byte above ASCII as ``surrogateescape`` writes it.
BYTE_ESCAPE = re.compile("[\ud800-\udfff]")
#: Characters of the texts whose lattices stand side by side in a task.
RUN_CHARACTERS = 1 << 18
CERTAIN = 1 - 1e-12
#: Weight of a character that has no piece and is spelled in bytes.
BYTES_WEIGHT = -12.0
#: Decimal places of a trie key that hold the character.
CHARACTER_BITS = 16


@dataclass(frozen=True)
class Sampling:
    """``alpha`` flattens (below 1) or sharpens the distribution over segmentations."""

    model_path: str
    samples: int = 2
    alpha: float = 1.0
    keep_ids: bool = True


class Vocabulary:
    """The model's pieces as a trie in arrays.

    The model's merges are in the order of how common they are. A piece weighs
    by Zipf's law of its place, ``1 / (1 + place)`` to the power of ``alpha``.
    """

    def __init__(self, model_path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.byte = np.zeros(256, np.int64)
        #: What each id stands for, with plain blanks; a byte as the escape that encodes to it.
        self.surface = np.full(model.get_piece_size(), "", object)
        pieces = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte = int(piece[1:-1], 16)
                self.byte[byte] = i
                self.surface[i] = bytes([byte]).decode("utf-8", "surrogateescape")
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if SPACE not in piece.lstrip(SPACE):
                    self.surface[i] = piece.replace(SPACE, " ")
                    pieces[piece] = i, -alpha * math.log1p(-model.get_score(i))
        alphabet = sorted({c for piece in pieces for c in piece})
        self.code = np.zeros(0x110000, np.int64)
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        states, keys = {"": 0}, []
        for piece in sorted(pieces):
            for i in range(1, len(piece) + 1):
                if piece[:i] not in states:
                    states[piece[:i]] = len(states)
                    key = states[piece[: i - 1]] << CHARACTER_BITS | int(self.code[ord(piece[i - 1])])
                    keys.append((key, states[piece[:i]]))
        self._place(*(np.array(column) for column in zip(*keys)))
        #: The states after one character, by its code; 0 where no piece begins so.
        self.begun = np.zeros(len(alphabet) + 1, np.int64)
        for i, c in enumerate(alphabet, 1):
            self.begun[i] = states.get(c, 0)
        self.piece = np.full(len(states), -1)
        self.weight = np.zeros(len(states))
        for piece, (i, weight) in pieces.items():
            self.piece[states[piece]], self.weight[states[piece]] = i, weight
        self.longest = max(map(len, pieces))

    def _place(self, keys: np.ndarray, states: np.ndarray) -> None:
        """An open-addressed table from state and character to the next state."""
        self.bits = 64 - (4 * len(keys)).bit_length()
        size = 1 << (64 - self.bits)
        self.key, self.next = np.full(size, -1), np.zeros(size, np.int32)
        at, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):
            free = waiting[self.key[at[waiting]] < 0]
            self.key[at[free]] = keys[free]  # of several, the last one keeps the slot
            stays = self.key[at[waiting]] == keys[waiting]
            self.next[at[waiting[stays]]] = states[waiting[stays]]
            waiting = waiting[~stays]
            at[waiting] = (at[waiting] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.bits)).astype(np.int64)

    def _found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and their next states."""
        at = self._slot(keys)
        there = self.key[at]
        known = there == keys
        other = np.flatnonzero(~known & (there >= 0))
        while len(other):
            at[other] = (at[other] + 1) & (len(self.key) - 1)
            there = self.key[at[other]]
            hit = there == keys[other]
            known[other[hit]] = True
            other = other[~hit & (there >= 0)]
        return known, self.next[at[known]]

    def matches(self, characters: np.ndarray, left: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per length, the places where a piece starts and its state; ``left`` bounds the length."""
        codes = self.code[characters]
        state = self.begun[codes]
        places = np.flatnonzero(state)
        state = state[places]
        found = []
        for length in range(1, self.longest + 1):
            if length > 1:
                going = np.flatnonzero(left[places] >= length)
                places = places[going]
                known, state = self._found(state[going] << CHARACTER_BITS | codes[places + length - 1])
                places, state = places[known], state.astype(np.int64)
            ends = np.flatnonzero(self.piece[state] >= 0)
            found.append((places[ends], state[ends]))
        return found


class Lattices:
    """Lattices of distinct words.

    Nodes are numbered by how many characters of their word are left; node 0 is
    the end of every word. Edges stand by node. A negative piece is a character
    without a piece. ``upto`` is the probability of a node's edges so far.
    """

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        characters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(len(characters))
        order = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")
        node = np.empty(len(order) + 1, np.int64)
        node[order] = np.arange(1, len(order) + 1)
        self.start = node[ends - lengths]
        self.left = np.concatenate(([0], left[order]))

        matches = vocabulary.matches(characters, left)
        bare = np.ones(len(characters), bool)
        bare[matches[0][0]] = False
        bare = np.flatnonzero(bare)
        groups = [
            (places, length, vocabulary.piece[state], vocabulary.weight[state])
            for length, (places, state) in enumerate(matches, 1)
        ]
        groups.append((bare, 1, -1 - characters[bare], np.full(len(bare), BYTES_WEIGHT)))
        groups = [(node[places], places + length, left[places] == length, *more) for places, length, *more in groups]
        counts = np.zeros(len(node), np.int64)
        for own, *_ in groups:
            counts[own] += 1
        self.first = np.concatenate((np.cumsum(counts) - counts, [counts.sum()]))
        total, filled = int(self.first[-1]), self.first[:-1].copy()
        self.node, self.to = np.empty(total, np.int32), np.empty(total, np.int32)
        self.piece, weight = np.empty(total, np.int32), np.empty(total)
        for own, after, ends_word, piece, w in reversed(groups):  # long pieces first: they are likely
            at = filled[own]
            filled[own] = at + 1
            self.node[at], self.piece[at], weight[at] = own, piece, w
            to = node[after]
            to[ends_word] = 0
            self.to[at] = to
        self._weigh(weight)

    def _weigh(self, weight: np.ndarray) -> None:
        """Probabilities of the edges, from the ends of the words to their starts."""
        beta = np.zeros(len(self.left))
        self.logp, self.upto = np.empty(len(weight)), np.empty(len(weight))
        levels = np.searchsorted(self.left, np.arange(1, int(self.left[-1]) + 2))
        for a, b in zip(levels[:-1], levels[1:]):
            lo, hi = self.first[a], self.first[b]
            firsts = self.first[a:b] - lo
            own = self.node[lo:hi] - a
            value = weight[lo:hi] + beta[self.to[lo:hi]]
            top = np.maximum.reduceat(value, firsts)
            share = np.exp(value - top[own])
            total = np.add.reduceat(share, firsts)
            beta[a:b] = top + np.log(total)
            share /= total[own]
            self.logp[lo:hi] = value - beta[a:b][own]
            self.upto[lo:hi] = share
        # Node by node, so that a word's numbers do not depend on the words beside it.
        degrees = np.diff(self.first)
        for place in range(1, int(degrees.max(initial=0))):
            edges = self.first[:-1][degrees > place] + place
            self.upto[edges] += self.upto[edges - 1]
        self.upto[self.first[2:] - 1] = 2.0  # no draw goes beyond the last edge

    def drawn(self, nodes: np.ndarray, ends: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a random path from each node to its word's end, and how many they are.

        ``ends`` says where the words end in ``u``, which has a number for each
        character; a walk uses the numbers of the places it visits.
        """
        which = np.flatnonzero(nodes)
        current = nodes[which]
        steps, counts = [], np.zeros(len(nodes), np.int64)
        while len(which):
            draw = u[ends[which] - self.left[current]]
            edge = self.first[current]
            beyond = np.flatnonzero(draw >= self.upto[edge])
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[draw[beyond] >= self.upto[edge[beyond]]]
            steps.append((which, edge))
            counts[which] += 1
            current = self.to[edge]
            going = current > 0
            which, current = which[going], current[going]
        path = np.empty(int(counts.sum()), np.int64)
        places = np.cumsum(counts) - counts
        for step, (which, edge) in enumerate(steps):
            path[places[which] + step] = edge
        return path, counts


@lru_cache(1)
def vocabulary(model_path: str, alpha: float) -> Vocabulary:
    return Vocabulary(model_path, alpha)


def _truncated(location: np.ndarray, upper: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``location``, given that they are at most ``upper``."""
    return location - np.log(np.exp(location - upper) - np.log(u))


def _words(text: str) -> list[str]:
    """The words of a text, each without the blank it begins with."""
    if not text:
        return []
    if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in WORD.findall(SPACE + text.replace(" ", SPACE))]
    return text.split(" ")


class Run:
    """Samples of several texts. Each text's numbers come from a generator of its key."""

    def __init__(self, texts: list[str], keys: list[str], words: Vocabulary):
        split = [_words(t) for t in texts]
        self.bounds = np.cumsum([0, *map(len, split)])
        types = defaultdict(count().__next__)  # a new word takes the next number
        codes = np.fromiter(
            map(types.__getitem__, chain.from_iterable(split)), np.int64, int(self.bounds[-1])
        )
        self.ends = np.cumsum(np.fromiter(map(len, types), np.int64, len(types))[codes] + 1)
        self.lattices = Lattices([SPACE + w for w in types], words) if types else None
        self.starts = self.lattices.start[codes] if types else codes
        self.sizes = np.diff(np.concatenate(([0], self.ends))[self.bounds])
        self.generators = [np.random.default_rng(xxhash.xxh64_intdigest(k, 42)) for k in keys]

    def _numbers(self) -> np.ndarray:
        """A fresh number in (0, 1) for every character of every text."""
        drawn = [r.random(n) for r, n in zip(self.generators, self.sizes)]
        return np.clip(np.concatenate(drawn), 1e-300, 1 - 2.0**-53)

    def samples(self, k: int) -> list[tuple[list[tuple[np.ndarray, float, float]], float]]:
        """Per text up to ``k`` paths with log-probability and perturbed value, and the next value."""
        n = len(self.sizes)
        values = np.array([-math.log(-math.log(min(max(r.random(), 1e-300), 1 - 2.0**-53))) for r in self.generators])
        found: list[list] = [[] for _ in range(n)]
        if self.lattices is None:
            return [([(np.zeros(0, np.int64), 0.0, float(v))], -math.inf) for v in values]
        heaps: list[list] = [[] for _ in range(n)]
        path, counts = self.lattices.drawn(self.starts, self.ends, self._numbers())
        words = np.repeat(np.arange(len(self.starts)), counts)
        bounds = np.concatenate(([0], np.cumsum(counts)))[self.bounds]
        kept: list[tuple[int, frozenset[int]]] = [(0, frozenset())] * n
        active = np.arange(n)
        while True:
            self._branches(active, path, words, bounds, values, kept, heaps, k - len(found[active[0]]))
            for i, a, b in zip(active, bounds[:-1], bounds[1:]):
                own = path[a:b]
                found[i].append((own, float(self.lattices.logp[own].sum()), float(values[i])))
            active = np.array([i for i in active if heaps[i] and len(found[i]) < k])
            if not len(active):
                break
            path, words, bounds = self._left(active, values, kept, heaps)
        return [(f, -h[0][0] if h else -math.inf) for f, h in zip(found, heaps)]

    def _branches(self, active, path, words, bounds, values, kept, heaps, most: int) -> None:
        """Put the best sets that leave the new paths at one of their nodes on the heaps."""
        if not len(path):
            return
        logp = self.lattices.logp[path]
        sizes = np.diff(bounds)
        which = np.repeat(np.arange(len(active)), sizes)
        before = np.concatenate([np.cumsum(logp[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]) - logp
        fresh = np.ones(len(path), bool)
        for a, i in zip(bounds[:-1], active):
            fresh[a : a + kept[i][0]] = False  # those nodes' sets are on the heap already
        here = np.ones(len(path))
        here[fresh] = np.exp(logp[fresh])
        for a, i in zip(bounds[:-1], active):
            at, out = kept[i]
            if out:  # earlier branches at the node where this path left its parent
                here[a + at] += math.fsum(math.exp(self.lattices.logp[e]) for e in out)
        sure = np.flatnonzero(here < CERTAIN)
        location = before[sure] + np.log1p(-here[sure])
        numbers = self._numbers()
        u = numbers[self.ends[words[sure]] - self.lattices.left[self.lattices.node[path[sure]]]]
        noisy = np.full(len(path), -np.inf)
        noisy[sure] = _truncated(location, values[active][which[sure]], u)
        filled = sizes > 0
        for _ in range(most):
            best = np.maximum.reduceat(noisy, bounds[:-1][filled])
            hit = np.flatnonzero((noisy == np.repeat(best, sizes[filled])) & (noisy > -np.inf))
            for place in hit:
                j = which[place]
                i, a, b = active[j], bounds[j], bounds[j + 1]
                at, out = kept[i]
                own = (out if place - a == at else frozenset()) | {int(path[place])}
                entry = (-float(noisy[place]), len(heaps[i]), int(place - a), own, path[a:b], words[a:b])
                heapq.heappush(heaps[i], entry)
            noisy[hit] = -np.inf

    def _left(self, active, values, kept, heaps):
        """For each text the path of its best set: along the old one, off it, and on at random."""
        edges = self.lattices
        heads, nodes, ends = [], [], []
        for i in active:
            value, _, place, out, path, words = heapq.heappop(heaps[i])
            values[i], kept[i] = -value, (place, out)
            node = int(edges.node[path[place]])
            others = [e for e in range(edges.first[node], edges.first[node + 1]) if e not in out]
            weight = np.cumsum(np.exp(edges.logp[others]))
            draw = self.generators[i].random() * weight[-1]
            edge = others[min(int(np.searchsorted(weight, draw, "right")), len(others) - 1)]
            word = int(words[place])
            heads.append((path[:place], words[:place], edge, word))
            nodes.append(np.concatenate(([edges.to[edge]], self.starts[word + 1 : self.bounds[i + 1]])))
            ends.append(self.ends[word : self.bounds[i + 1]])
        rest, counts = edges.drawn(np.concatenate(nodes), np.concatenate(ends), self._numbers())
        sizes = np.cumsum([0, *map(len, nodes)])
        cuts = np.concatenate(([0], np.cumsum(counts)))[sizes]
        paths, numbers = [], []
        for j, (path, words, edge, word) in enumerate(heads):
            own = np.repeat(np.arange(word, word + len(nodes[j])), counts[sizes[j] : sizes[j + 1]])
            paths += [path, [edge], rest[cuts[j] : cuts[j + 1]]]
            numbers += [words, [word], own]
        bounds = np.cumsum([0, *(len(h[0]) + 1 + c for h, c in zip(heads, np.diff(cuts)))])
        return np.concatenate(paths).astype(np.int64), np.concatenate(numbers).astype(np.int64), bounds

    def ids(self, path: np.ndarray, words: Vocabulary) -> np.ndarray:
        """Piece ids of a path; characters without a piece become their bytes."""
        if not len(path):
            return np.zeros(0, "<u4")
        ids = self.lattices.piece[path].astype(np.int64)
        plain = np.flatnonzero((ids < 0) & (ids >= -128))  # one byte each
        ids[plain] = words.byte[-1 - ids[plain]]
        if ids.min() < 0:
            spelled = [[i] if i >= 0 else words.byte[list(chr(-1 - i).encode())] for i in ids.tolist()]
            ids = np.concatenate(spelled)
        return ids.astype("<u4")


def decoded(ids: np.ndarray, words: Vocabulary) -> str:
    """The text that ids stand for, bytes put together to characters."""
    text = "".join(words.surface[ids].tolist())
    if not text.isascii() and BYTE_ESCAPE.search(text):
        text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:]


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``RUN_CHARACTERS`` together."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > RUN_CHARACTERS:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def sampled(docs: DataFrame, sampling: Sampling) -> DataFrame:
    """Up to ``samples`` distinct segmentations of every row's text, drawn by the row's key.

    Columns: ``doc_id``, ``sample`` from 1 in the order of ``perturbed`` (the
    log-probability with its Gumbel noise), ``ids`` (little-endian unsigned
    32-bit), ``n_pieces``, ``ids_crc32``, ``log_prob``, ``inclusion`` (the
    probability of being among the samples, given the next perturbed value) and
    ``round_trip``, whether decoding gives the text back. A text with fewer
    segmentations has fewer rows, all with inclusion 1; null counts as empty and
    has the empty one. Equal keys and texts give equal samples. An empty table
    gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
    """
    bounded_batches(docs.sparkSession)

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(sampling.model_path, sampling.alpha)
        names = "doc_id sample ids n_pieces ids_crc32 log_prob perturbed inclusion round_trip"
        for batch in batches:
            keys, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for a, b in _runs(texts):
                run = Run(texts[a:b], list(map(str, keys[a:b])), words)
                rows = []
                for key, text, (found, after) in zip(keys[a:b], texts[a:b], run.samples(sampling.samples)):
                    plain = text.replace(SPACE, " ")
                    for place, (path, logp, value) in enumerate(found, 1):
                        ids = run.ids(path, words)
                        raw = ids.tobytes()
                        inclusion = -math.expm1(-math.exp(min(logp - after, 700.0)))
                        same = decoded(ids, words) == plain
                        rows.append(
                            (key, place, raw if sampling.keep_ids else None, len(ids), crc32(raw), logp,
                             value, inclusion, same)
                        )
                yield pd.DataFrame(rows, columns=names.split())

    keyed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), empty_if_null("text").alias("text"))
    found = keyed.mapInPandas(
        sample,
        "doc_id string, sample int, ids binary, n_pieces long, ids_crc32 long, log_prob double,"
        " perturbed double, inclusion double, round_trip boolean",
    )
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def op4_gumbel_lattice(spark, sf_dir):
    import public_tokenizers

    sampling = Sampling(public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)
    return sampled(table(spark, sf_dir, "documents"), sampling).drop("ids")
