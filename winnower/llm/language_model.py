"""Language-model scores by a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing. Of a word w after the context h (h' is h without its first word)
    p(w | h) = (c(hw) + kappa p(w | h')) / (c(h) + kappa)    if h is a state, else p(w | h'),
and below all contexts p(w) = (c(w) + 1) / (N + V + 1), which leaves one share for words never seen. Contexts of one word are states if
seen at least ``least[0]`` times in the learning texts, contexts of two words from ``least[1]`` times on. All sums over w are 1.

As an automaton: every state has an arc for each word seen after it, with the logarithm of p and the longest state that the
new words end in; words without an arc take the failure arc, of weight log(kappa / (c(h) + kappa)), to the state of h', as
often as needed. The empty state has arcs for all words. A text is gone through once from left to right, carrying the state and adding up weights; it begins
in the state of the beginning of a text, which is a context but no token, and its last token is the end.

On Spark the model is never in one place. Texts become blocks of token numbers (``token_blocks``). Every block sends its distinct n-grams
of 64-bit hashes, with their counts in its learning texts, to buckets by range of hash; a bucket adds them up and answers
each block with its n-grams' totals. Each n-gram goes to its bucket once a block, so the most frequent ones weigh no more than others. A block then holds all
of the automaton that its texts can reach: it builds that and runs texts through it, many pieces of texts side by side.
Words and pairs are asked for at once, triples only where the first two words are a state, as a bit array of fixed size says
(a bit set by chance costs a useless question). A question holds about block * bucket / tokens keys, so that on 10 TB and more both should grow: 8 million tokens each leave 3 keys a row at 100 TB.

Equal 64-bit hashes of different n-grams are taken as equal: with 10^9 n-grams the chance that any two meet is 3 per cent.

Defined results: a null or empty text is the end token alone; every row gives one row, repeated ones too; other columns are ignored, whatever their names;
an empty table gives no rows; without learning texts every probability of a word is 1 (N = V = 0) and every score 0.
A null doc_id counts as empty text for the choice of learning rows. A very long text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.llm import textbytes as tb
from winnower.llm.shared import shared_path, small_batches
from winnower.llm.token_blocks import bit_at, from_planes, pack_sorted, planes, read_blocks, slot_bits, unpack_sorted, write_blocks


@dataclass(frozen=True)
class Automaton:
    kappa: tuple[float, float] = (500.0, 16.0)
    least: tuple[int, int] = (1, 8)
    block: int = 1 << 19
    bucket: int = 1 << 21
    state_bits: int = 26
    piece: int = 64


_END, _BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_PAIR, _TRIPLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_ASKED = "level int, bucket int, block long, keys binary, counts binary"
_ANSWERED = "level int, bucket int, block long, counts binary, n_distinct long, states binary"


def tokens(data: np.ndarray, bounds: np.ndarray):
    """Words and, after each text, the end token."""
    starts, ends, first = tb.words(data, bounds)
    h = np.insert(tb.word_hashes(data, starts, ends), first[1:], _END)
    return h, np.zeros(0, np.int64), np.zeros(0, np.int64), np.diff(first) + 1


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(8)).astype(np.int64) & ((1 << bits) - 1)


class Block:
    """Token numbers of a block, its texts, and its distinct n-grams of each length in the order of their hashes."""

    def __init__(self, row: dict, states: np.ndarray | None, fit: Automaton):
        self.lengths = from_planes(row["lengths"], np.int32).astype(np.int64)
        self.ids = from_planes(row["ids"], np.int32)
        self.hashes = np.frombuffer(row["hashes"], np.uint64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.learnt = np.repeat(~np.asarray(row["held_out"], bool), self.lengths)
        word = self.hashes[self.ids]
        before = np.concatenate([[_BEGIN], word[:-1]]) if len(word) else word
        before[self.starts] = _BEGIN
        pair = tb.mix(before * _PAIR + word)
        self.order = np.argsort(self.hashes)
        self.pairs, self.pair_at, self.pair_of = np.unique(pair, return_index=True, return_inverse=True)
        self.triple_at = np.zeros(0, np.int64)
        if states is not None and len(word):
            inner = np.ones(len(word), bool)
            inner[self.starts] = False
            inner[1:] &= bit_at(states, _slots(pair[:-1], fit.state_bits))
            self.triple_at = np.flatnonzero(inner)
            triple = tb.mix(pair[self.triple_at - 1] * _TRIPLE + word[self.triple_at])
            self.triples, first, self.triple_of = np.unique(triple, return_index=True, return_inverse=True)
            self.triple_first = self.triple_at[first]

    def asked(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes and their counts in the learning texts."""
        if level == 1:
            return self.hashes[self.order], np.bincount(self.ids[self.learnt], minlength=len(self.hashes))[self.order]
        if level == 2:
            return self.pairs, np.bincount(self.pair_of[self.learnt], minlength=len(self.pairs))
        return self.triples, np.bincount(self.triple_of[self.learnt[self.triple_at]], minlength=len(self.triples))


def _questions(levels: tuple[int, ...], buckets: int, states, fit: Automaton) -> Callable:
    edges = np.array([k * 2**64 // buckets for k in range(1, buckets)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, states.value if states else None, fit)
                for level in levels:
                    keys, counts = block.asked(level)
                    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                    parts = [(k, s, e) for k, (s, e) in enumerate(zip(cuts, cuts[1:])) if s < e]
                    yield pa.record_batch(
                        [
                            pa.array([level] * len(parts), pa.int32()), pa.array([k for k, _, _ in parts], pa.int32()), pa.array([row["block"]] * len(parts), pa.int64()),
                            pa.array([pack_sorted(keys[s:e]) for _, s, e in parts], pa.binary()), pa.array([planes(counts[s:e].astype(np.int64)) for _, s, e in parts], pa.binary()),
                        ],
                        names=["level", "bucket", "block", "keys", "counts"],
                    )

    return run


def _answers(fit: Automaton) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        level, bucket = table["level"][0].as_py(), table["bucket"][0].as_py()
        keys = [unpack_sorted(x.as_py()) for x in table["keys"]]
        u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([from_planes(x.as_py(), np.int64) for x in table["counts"]]), len(u)).astype(np.int64)
        cuts = np.cumsum([0, *map(len, keys)])
        answers = [planes(total[inverse[s:e]]) for s, e in zip(cuts, cuts[1:])]
        states = _slots(u[total >= fit.least[1]], fit.state_bits).astype(np.int32).tobytes() if level == 2 else b""
        n = len(answers) + 1
        return pa.table({
            "level": pa.array([level] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "block": pa.array([*table["block"].to_pylist(), None], pa.int64()),
            "counts": pa.array([*answers, None], pa.binary()), "n_distinct": pa.array([None] * (n - 1) + [int((total > 0).sum())], pa.int64()), "states": pa.array([None] * (n - 1) + [states], pa.binary()),
        })

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            yield pa.record_batch([pa.array(np.frombuffer(raw.as_py(), np.int32))], names=["slot"])


class Arcs:
    """The part of the automaton that a block's texts can reach.

    States: 0 the empty one, then the words of the dictionary, the beginning, the distinct pairs. Arcs of the empty
    state are arrays by word, all others sorted by state and word.
    """

    def __init__(self, block: Block, totals: list[np.ndarray], n: int, v: int, texts: int, fit: Automaton):
        c1 = np.empty(len(block.hashes), np.int64)
        c1[block.order] = totals[0]
        c2, c3 = totals[1], totals[2]
        words, ids = len(c1), block.ids.astype(np.int64)
        self.count, self.p1 = c1, (c1 + 1) / (n + v + 1)
        self.begin = words + 1 if texts >= fit.least[0] else 0
        word = ids[block.pair_at]
        first = np.isin(block.pair_at, block.starts)
        context = np.where(first, texts, c1[ids[block.pair_at - 1]])
        source = np.where(first, words + 1, ids[block.pair_at - 1] + 1)
        k2, k3 = fit.kappa
        known = context >= fit.least[0]
        p2 = np.where(known, (c2 + k2 * self.p1[word]) / (context + k2), self.p1[word])
        self.next1 = np.where(c1 >= fit.least[0], np.arange(words) + 1, 0)
        state = np.arange(len(c2)) + words + 2
        reached = np.where(c2 >= fit.least[1], state, self.next1[word])
        arcs = known & (c2 > 0)
        at = block.triple_first
        ctx, end, w3 = block.pair_of[at - 1], block.pair_of[at], ids[at]
        arcs3 = (c3 > 0) & (c2[ctx] >= fit.least[1])
        p3 = (c3 + k3 * p2[end]) / (c2[ctx] + k3)
        key = np.concatenate([source[arcs] << 32 | word[arcs], state[ctx[arcs3]] << 32 | w3[arcs3]])
        order = np.argsort(key)
        self.key = np.append(key[order], np.int64(2**63 - 1))
        self.weight = np.append(np.log10(np.concatenate([p2[arcs], p3[arcs3]]))[order], 0.0)
        self.target = np.append(np.concatenate([reached[arcs], reached[end[arcs3]]])[order], 0)
        self.fail = np.concatenate([np.zeros(words + 2, np.int64), self.next1[word]])
        self.down = np.log10(np.concatenate([[1.0], k2 / (c1 + k2), [k2 / (texts + k2)], k3 / (c2 + k3)]))
        self.log1 = np.log10(self.p1)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of the arcs taken by each (state, word), failure arcs included, and the states reached."""
        weight, state = np.zeros(len(state)), state.copy()
        target = np.full(len(state), -1)
        left = np.flatnonzero(state)
        while len(left):
            key = state[left] << 32 | word[left]
            at = np.searchsorted(self.key, key)
            hit = self.key[at] == key
            weight[left[hit]] += self.weight[at[hit]]
            target[left[hit]] = self.target[at[hit]]
            left = left[~hit]
            weight[left] += self.down[state[left]]
            state[left] = self.fail[state[left]]
            left = left[state[left] > 0]
        free = target < 0
        weight[free] += self.log1[word[free]]
        target[free] = self.next1[word[free]]
        return weight, target

    def scores(self, block: Block, piece: int) -> np.ndarray:
        """Log10 probabilities of the texts. Texts are cut into pieces that run side by side; a state follows from the last two words,
        so a piece inside a text begins with these."""
        ids = block.ids.astype(np.int64)
        cuts = -(-block.lengths // piece)
        own = np.repeat(np.arange(len(cuts)), cuts)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = block.starts[own] + nth * piece
        size = np.minimum(piece, block.starts[own] + block.lengths[own] - start)
        state = np.where(nth == 0, self.begin, 0)
        inside = np.flatnonzero(nth)
        for back in (2, 1):
            state[inside] = self.step(state[inside], ids[start[inside] - back])[1]
        order = np.argsort(-size, kind="stable")
        start, size, state, sums = start[order], size[order], state[order], np.zeros(len(order))
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t))  # pieces longer than t stand first
            weight, state[:live] = self.step(state[:live], ids[start[:live] + t])
            sums[:live] += weight
        back = np.empty(len(order))
        back[order] = sums
        return np.bincount(own, back, len(cuts))


def _scored(n: int, v: int, texts: int, states, fit: Automaton) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            block = Block(row, states.value, fit)
            answers = right.select(["level", "bucket", "counts"]).sort_by([("level", "ascending"), ("bucket", "ascending")])
            totals = [[np.zeros(0, np.int64)] for _ in range(3)]
            for level, counts in zip(answers["level"].to_pylist(), answers["counts"], strict=True):
                totals[level - 1].append(from_planes(counts.as_py(), np.int64))
            arcs = Arcs(block, [np.concatenate(x) for x in totals], n, v, texts, fit)
            own = np.repeat(np.arange(len(block.lengths)), block.lengths)
            sums = lambda x: np.bincount(own, x, len(block.lengths))
            out.append(pa.table({
                "doc_id": pa.array(row["doc_id"], pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()), "n_tokens": pa.array(block.lengths),
                "n_known": pa.array(sums(arcs.count[block.ids] > 0).astype(np.int64)), "train_tokens": pa.array(np.full(len(block.lengths), n, np.int64)),
                "base_score": pa.array(sums(arcs.log1[block.ids])), "score": pa.array(arcs.scores(block, fit.piece)),
            }))
        return pa.concat_tables(out)

    return run


def score_texts(docs: DataFrame, held_out: Column, fit: Automaton = Automaton()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text).

    ``held_out`` is a condition on doc_id; the model learns from the other rows. base_score is that of single words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    written = write_blocks(rows, ["doc_id", "held_out"], tokens, "lm-blocks", size=fit.block)
    blocks = read_blocks(spark, written, "block", "lengths", "ids", "hashes", "doc_id", "held_out")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, learnt = from_planes(row["lengths"], np.int32).astype(np.int64), ~np.asarray(row["held_out"], bool)
                yield pa.record_batch([pa.array([int(x)]) for x in (lengths.sum(), lengths[learnt].sum(), learnt.sum())], names=["every", "n", "texts"])

    all_of = blocks.select("lengths", "held_out").mapInArrow(sizes, "every long, n long, texts long").groupBy().sum().first()
    every, n, texts = (x or 0 for x in all_of)
    buckets = max(8, -(-every // fit.bucket))

    def ask(levels: tuple[int, ...], states) -> DataFrame:
        path = shared_path(spark, "lm-answers")
        asked = blocks.mapInArrow(_questions(levels, buckets, states, fit), _ASKED)
        asked.groupBy("level", "bucket").applyInArrow(_answers(fit), _ANSWERED).write.parquet(path)
        return spark.read.schema(_ANSWERED).parquet(path)

    lower = ask((1, 2), None)
    totals = lower.where("block is null")
    v = totals.where("level = 1").agg(F.sum("n_distinct")).first()[0] or 0
    states = spark.sparkContext.broadcast(slot_bits(totals.where("level = 2").select("states").mapInArrow(_opened, "slot int"), fit.state_bits))
    answers = lower.unionByName(ask((3,), states)).where("block is not null").select("level", "bucket", "block", "counts")
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scored(n, v, texts, states, fit), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})
