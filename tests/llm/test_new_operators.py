"""Collocations, importance resampling and the language model against plain Python; planted personal data; memory of kernels; sessions without ANSI mode."""

from __future__ import annotations

import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from winnower.llm import collocations, importance, language_id, language_model, line_dedup, mixing, pii, quality_model, quality_rules
from winnower.llm import textbytes as tb
from winnower.llm import token_blocks as B
from winnower.llm.shared import crc_remainder

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "the a of sea Wind ÄPFEL été 雨 stone river old New bright".split()


def prose(seed, n=60, most=60):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS[: 4 + i % 9]) + rng.choice(["", "", "", ".", ",", "\n", "!?", "\t"]) for _ in range(rng.randrange(most))) for i in range(n)]
    return [*texts, None, "", "  \n\t", "x" * 70_000, "one " * 3000, texts[0], texts[0]]


def test_planes_and_slots(spark):
    x = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    assert (B.unpack_sorted(B.pack_sorted(x)) == x).all() and (B.from_planes(B.planes(x), np.uint64) == x).all()
    assert len(B.from_planes(B.planes(np.zeros(0, np.int32)), np.int32)) == 0
    slots = [0, 7, 65_536, 1_000_000, 7]
    bits = B.slot_bits(spark.createDataFrame([(s,) for s in slots], "slot int"), 20)
    assert np.flatnonzero(B.bit_at(bits, np.arange(1 << 20))).tolist() == sorted(set(slots))


def brute_collocations(rows, threshold, top=2000):
    count, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    count[lang, tuple(ws[i : i + k])] += 1
    out = {}
    for (lang, p), a in count.items():
        if len(p) == 1 or a < threshold:
            continue
        score, _, l, r = min((2000000 * a // (count[lang, p[:j]] + count[lang, p[j:]]), j, count[lang, p[:j]], count[lang, p[j:]]) for j in range(1, len(p)))
        inside = any(100 * f >= 80 * a for (g, q), f in count.items() if g == lang and f >= threshold and len(p) < len(q) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize(("shards", "slots"), [(4, 20), (3, 4), (1, 20)])
def test_collocations(spark, shards, slots):
    """Also with so few slots that nearly all phrases are activated for nothing, and with blocks of some texts only."""
    rows = [(("en", "de", None, "und")[i % 4], t) for i, t in enumerate(prose(5, 160) + ["deep blue sea. deep blue sea"] * 9)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, h long")
    got = collocations.collocations(df, collocations.Mining(threshold=6, shards=shards, slots=max(slots, 17) if slots > 4 else 16, block=200, buffer=500))
    want = brute_collocations(rows, 6)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 40
    assert collocations.collocations(df.where("false")).count() == 0


def test_collocations_of_long_words_of_two_letters(spark):
    """Sums of powers modulo 2^64 are the same for these two words, whatever the base."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [("en", f"{one} x {two} y"), ("en", f"{two} x z {one} y")] * 40
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"))
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 30)


@pytest.mark.parametrize("longest", [1, 3])
def test_importance(spark, longest):
    docs = [(i, t) for i, t in enumerate(prose(6, 200))] + [(None, "a b c " * 20), (7, "sea " * 30), (7, "sea " * 30)]
    target = ["the sea of wind", None, "old stone"]
    fit = importance.Resampling(longest=longest, buckets=64, finish=8, percent=30)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    grams = lambda ws: [" ".join(ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % 64
    s, t = Counter(bucket(g) for _, d in docs for g in grams(words(d))), Counter(bucket(g) for d in target for g in grams(words(d)))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 64) / ((s[b] + 1) * (t.total() + 64)))) for b in range(64)}
    rows = []
    for i, d in docs:
        g = grams(words(d))
        w = sum(gain[bucket(x)] for x in g) // len(g) if g else 0
        h = int(__import__("hashlib").sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(d)) >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = able[: len(able) * 30 // 100]
    df = spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id long, text string, rank int, low int").repartition(7)
    got = importance.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), fit).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted((r[:4] for r in rows), key=key)
    assert [tuple(r)[:4] for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == [r[:4] for r in drawn]
    assert [r.rank for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == list(range(1, len(drawn) + 1))
    assert importance.resample(df.where("false"), df.select("text"), fit).count() == 0


def test_cutoff_finds_every_rank(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.randrange(30), i) for i in range(300)], "low long, doc_id long").repartition(5)
    df = df.withColumns({"late": F.lit(False), "n_features": F.lit(1).cast("long")}).sortWithinPartitions("low", "late", "doc_id", "n_features")
    df = df.withColumns({"part": F.spark_partition_id().cast("long"), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).select(*importance.KEY).cache()
    order = sorted(map(tuple, df.collect()))
    for rank in (1, 2, 150, 299, 300):
        assert importance.cutoff(df, rank, 1) == order[rank - 1]


def brute_model(docs, held, fit):
    texts = [(i, [None, *re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), ""]) for i, t in docs]  # None begins, "" ends
    c = Counter()
    for i, ws in texts:
        if not held(i):
            c.update((w,) for w in ws[1:])
            c.update(tuple(ws[j : j + 2]) for j in range(len(ws) - 1))
            c.update(tuple(ws[j : j + 3]) for j in range(len(ws) - 2))
            c[(None,)] += 1
    n, v = sum(x for k, x in c.items() if len(k) == 1 and k != (None,)), sum(1 for k in c if len(k) == 1 and k != (None,))

    def p(context, w):
        if not context:
            return (c[(w,)] + 1) / (n + v + 1)
        lower = p(context[1:], w)
        seen, kappa = c[context], fit.kappa[len(context) - 1]
        return (c[(*context, w)] + kappa * lower) / (seen + kappa) if seen >= fit.least[len(context) - 1] else lower

    rows = []
    for i, ws in texts:
        base = sum(math.log10(p((), w)) for w in ws[1:])
        score = sum(math.log10(p(tuple(ws[max(0, j - 2) : j]), ws[j])) for j in range(1, len(ws)))
        rows.append((i, held(i), len(ws) - 1, sum(c[(w,)] > 0 for w in ws[1:]), n, base, score))
    return rows, c, p, v


@pytest.mark.parametrize("fit", [language_model.Automaton(block=300, bucket=100, least=(1, 2), piece=4), language_model.Automaton(least=(3, 5), state_bits=16), language_model.Automaton(kappa=(2.0, 1.0), least=(1, 1), piece=3)])
def test_language_model(spark, fit):
    docs = [*enumerate(prose(8, 90)), (None, "the sea"), (3, "the sea")]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    df = spark.createDataFrame([(*d, True, 1) for d in docs], "doc_id long, text string, held_out boolean, block int").repartition(3)
    got = language_model.score_texts(df, crc_remainder("doc_id", 7) == 2, fit).collect()
    want, c, p, v = brute_model(docs, held, fit)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-4 and abs(g[6] - w[6]) < 1e-4
    words = [k[0] for k in c if len(k) == 1 and k != (None,)]
    for context in [(), (None,), ("the",), (None, "the"), ("the", "sea"), ("never", "seen")]:
        assert abs(sum(p(context, w) for w in words) + p(context, "never seen at all") - 1) < 1e-9  # one share for all unknown words
    assert language_model.score_texts(df.where("false"), F.lit(False)).count() == 0
    assert {(r.base_score, r.score) for r in language_model.score_texts(df, F.lit(True)).collect()} == {(0.0, 0.0)}


PLANTED = {
    "email": "jane.doe@example.org", "card": "4111 1111 1111 1111", "iban": "DE89 3704 0044 0532 0130 00", "ip": "192.168.17.4", "date": "2021-03-14", "ssn": "123-45-6789", "phone": "+1 555 234 9876", "secret": "0123456789abcdef0123456789abcdef",
}


@pytest.mark.parametrize("seed", range(6))
def test_planted_values_and_nothing_else(seed):
    """Prose with planted values of known places: all of them change, and no other character does."""
    rng = random.Random(seed)
    plain = [w.strip(".") for w in "the river is old and 3 boats of 12 went by in 1999 or 7.5 days before 10 people".split()]
    parts, spans = [], []
    for kind in rng.sample(sorted(PLANTED), rng.randrange(1, len(PLANTED) + 1)):
        parts += [*rng.choices(plain, k=rng.randrange(2, 8)), "and"]
        if kind == "secret":
            parts[-1] = "token:"
        parts.append((kind, PLANTED[kind]))
    text = ""
    for x in parts:
        value = x if isinstance(x, str) else x[1]
        if not isinstance(x, str):
            spans.append((len(text), len(text) + len(value), x[0]))
        text += value + " "
    new, found = pii.pseudonymise(text, pii.Pseudonyms(key=b"test"))
    assert found == Counter(kind for _, _, kind in spans)
    rest = [text[a:b] for a, b in zip([0, *(e for _, e, _ in spans)], [*(s for s, _, _ in spans), len(text)])]
    pieces = re.fullmatch("(.+?)".join(map(re.escape, rest)), new, re.DOTALL).groups()
    assert all(piece != text[s:e] for piece, (s, e, _) in zip(pieces, spans, strict=True))


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "mail a@b.org now", "en", 5, 6)], "doc_id long, text string, lang string, _hidden long, _found long")
    out = pii.hide_personal_data(df, pii.Pseudonyms(key=b"k")).first()
    assert (out._hidden, out._found, out.n_found) == (5, 6, 1)
    assert language_id.detect(df, language_id.train(df, F.lit(True))).first()._found == 6


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_results_do_not_hang_on_ansi_mode(spark, ansi):
    df = spark.createDataFrame([(1, "a b c", "s"), (2, None, "s"), (3, "x y\nz w\nu v", "s"), (4, "x y\nz w\nother line", "t")], "doc_id long, text string, source string")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        mixed = {r.doc_id: (r.size, r.source_size) for r in mixing.mix_sources(df).collect()}
        removed = {r.doc_id: r.n_removed for r in line_dedup.remove_repeated_chunks(df.select("doc_id", "text")).collect()}
        quality_rules.apply_rules(df.withColumn("lang", F.lit("en"))).count()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert mixed == {1: (3, 9), 2: (0, 9), 3: (6, 9), 4: (6, 6)} and removed == {1: 0, 2: 0, 3: 0, 4: 2}


def test_slices_keep_words_and_sums():
    data = np.frombuffer((b"some words of any kind " * 500 + b"x" * 3000 + b" and more"), np.uint8)
    parts = list(tb.slices(data, 256))
    assert b"".join(p.tobytes() for p in parts) == data.tobytes() and sum(len(p.tobytes().split()) for p in parts) == len(data.tobytes().split())
    vectors = np.random.default_rng(0).normal(size=(512, 8))
    bounds = np.array([0, len(data)])
    assert np.allclose(quality_model.pool(data, bounds, vectors, 256), quality_model.pool(data, bounds, vectors))
    whole = language_id.counts(data, bounds, 256)
    piece, language_id._PIECE = language_id._PIECE, 1000
    try:
        assert (language_id.counts(data, bounds, 256) == whole).all()
        two = np.concatenate([data, data])
        assert (language_id.counts(two, np.array([0, len(data), len(two)]), 256) == np.concatenate([whole, whole])).all()
    finally:
        language_id._PIECE = piece


KERNEL = """
import resource, sys
import numpy as np, pyarrow as pa
from winnower.llm import importance, language_id, quality_model, textbytes as tb
texts = pa.array(["some words of any kind. " * 1_250_000] if sys.argv[1] == "long" else ["abcd "] * 10_000)
vectors = np.zeros((8192, 16), np.float32)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for _, _, data, bounds in tb.chunks(texts):
    if sys.argv[2] == "quality":
        quality_model.pool(data, bounds, vectors)
for _, _, data, bounds in tb.chunks(texts, rows=language_id._ROWS):
    if sys.argv[2] == "language":
        language_id.counts(data, bounds, 2048)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""


@pytest.mark.parametrize("kernel", ["quality", "language"])
@pytest.mark.parametrize("shape", ["long", "short"])
def test_memory_of_kernels(kernel, shape):
    """30 MB in one text, and 10,000 short texts, take less than 300 MB."""
    out = subprocess.run([sys.executable, "-c", KERNEL, shape, kernel], capture_output=True, text=True, check=True, cwd=sys.path[0] or ".")
    assert float(out.stdout) < 300
