"""Edge cases and brute-force checks: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import datetime
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from winnower.llm import chat_format, decontaminate, language_id, line_dedup, mixing, near_dedup, pii, quality_model, quality_rules, toxicity
from winnower.operators import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, component string, kept string, gone string"
KEY = pii.Pseudonyms(key=b"k")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", "y", "z", "g") for i, t, lang, src in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    base = prose(1, 80)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, base, "en", "a"), (4, base, "en", "a"), (5, base + " tail", "en", None), (6, prose(2, 30000), "de", "a"), (7, "12345 ###", "de", "b"), (8, "wörter über straße", "de", "b"), (None, "no id here", "en", "b")]
    return table(spark, rows)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in (4, 5, 6, 7, 8)], "doc_id long, quality int, toxic int")


def test_no_operator_fails_on_odd_rows(spark, odd, labels):
    for docs, n in ((odd, odd.count()), (odd.limit(0), 0)):
        assert near_dedup.near_duplicates(docs).count() == n
        assert line_dedup.remove_repeated_chunks(docs).count() == n
        assert quality_rules.apply_rules(docs).count() == n
        assert mixing.mix_sources(docs).count() == n
        assert pii.hide_personal_data(docs, KEY).count() == n
        assert language_id.detect(docs, language_id.train(docs, F.lit(True))).count() == n
        for m in (quality_model, toxicity):
            for known in (labels, labels.limit(0)):
                assert m.score(docs, m.train(docs, known)).where("score between 0 and 1").count() == n
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, "x")], "item_id long, text string")
    assert decontaminate.find_leaks(odd, bench).count() == 0 and decontaminate.find_leaks(odd.limit(0), bench.limit(0)).count() == 0


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    texts = {}
    for g in range(12):
        words = prose(100 + g, 60).split()
        for _ in range(8):
            own = list(words)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = "edit" + str(rng.randrange(10**6))
            texts[len(texts)] = " ".join(own)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    label = {i: i for i in texts}
    for _ in texts:
        for i in texts:
            for j in texts:
                if i < j and jaccard(sets[i], sets[j]) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
    got = near_dedup.near_duplicates(table(spark, [(i, t, "en", "a") for i, t in texts.items()])).collect()
    assert {r.doc_id: r.component_id for r in got} == label
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}


def test_bands_fit_the_threshold():
    for percent in range(50, 96):
        p = near_dedup.NearDuplicates(percent=percent)
        assert (1 - (percent / 100) ** p.rows) ** p.bands < 1e-6 and 170 <= p.bands * p.rows <= 180
    assert [(p.bands, p.rows) for p in (near_dedup.NearDuplicates(), near_dedup.NearDuplicates(percent=85))] == [(36, 5), (30, 6)]


def test_residual_pairs_are_whole(spark):
    """The rare-shingle step alone proposes every pair at the threshold."""
    p = near_dedup.NearDuplicates()
    rng = random.Random(9)
    base = [rng.getrandbits(40) for _ in range(120)]
    sets = {i: [rng.getrandbits(40) if rng.random() < q else x for x in base] for i, q in enumerate(rng.choice([0.02, 0.05, 0.1, 0.3]) for _ in range(60))}
    df = spark.createDataFrame([(i, sorted(set(s))) for i, s in sets.items()], "node long, shingles array<long>")
    named = df.select("node", F.col("node").alias("component"))
    proposed = {(r.a, r.b) for r in near_dedup._by_rare_shingles(named, df, p).collect()}
    want = {(i, j) for i in sets for j in sets if i < j and jaccard(set(sets[i]), set(sets[j])) >= 0.8}
    assert want and want <= proposed


def joined_rows(df) -> int:
    """Rows that the joins of a plan made."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if "QueryStageExec" in node.getClass().getSimpleName():
            todo.append(node.plan())
            continue
        if "Join" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return total


def test_templates_join_in_proportion(spark):
    """Pages of 200 shared and 18 own words lie just below the threshold: the exact search must not join them pair by pair."""
    template = prose(77, 200)
    p = near_dedup.NearDuplicates(percent=85)
    made = {}
    for n in (200, 400):
        sets = {i: sorted({hash((w, "s")) for w in zip(*[(template + " " + prose(5000 + i, 18)).split()[k:] for k in range(5)], strict=False)}) for i in range(n)}
        df = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>").repartition(4)
        named = df.select("node", F.col("node").alias("component"))
        pairs = near_dedup._by_rare_shingles(named, df, p)
        made[n] = (joined_rows(pairs), {tuple(r) for r in pairs.collect()})
        want = {(j, i) for i in range(n) for j in range(i) if jaccard(set(sets[i]), set(sets[j])) * 100 >= 85}
        assert want <= made[n][1]
    assert all(rows <= n for n, (rows, _) in made.items())  # all pairs would be 79,800 for each shared shingle


def test_templates_with_similar_pages(spark):
    """Pages of one template with more or less own text: components equal those of all pairs."""
    template, rng = prose(77, 120).split(), random.Random(4)
    texts = {i: " ".join(template[: 120 - i % 7] + prose(9000 + i, rng.choice([2, 5, 8, 10, 12, 20])).split()) for i in range(150)}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    label = {i: i for i in texts}
    links = [(i, j) for i in texts for j in texts if i < j and jaccard(sets[i], sets[j]) >= 0.85]
    for _ in texts:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    got = near_dedup.near_duplicates(table(spark, [(i, t, "en", "a") for i, t in texts.items()]), near_dedup.NearDuplicates(percent=85)).collect()
    assert links and {r.doc_id: r.component_id for r in got} == label and len(set(label.values())) > 5


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 130)]
    label = {x: x for e in links for x in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: c for x, c in label.items() if any(x in e for e in links if e[0] != e[1])}


def repeated_lines_gone(rows):
    """The texts that remain, line by line: pairs of adjacent lines with words and lines of 50 words, seen before or not."""
    seen, out = set(), {}
    for i, t, *_ in sorted(rows):
        lines, gone = t.split("\n"), set()
        worded = [k for k, x in enumerate(lines) if x.split()]
        spans = [(a, b) for a, b in zip(worded, worded[1:], strict=False)] + [(k, k) for k in worded if len(lines[k].split()) >= 50]
        for a, b in sorted(spans):
            piece = "\n".join(lines[a : b + 1])
            if piece in seen:
                gone |= set(range(a, b + 1))
            seen.add(piece)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_repeated_runs_go_whole(spark):
    """Passages of over 50 words in two to six short lines, inside other text, also across cuts of the chunk rule."""
    rng = random.Random(8)
    passages = ["\n".join(prose(1000 * k + j, rng.randrange(27, 45)) for j in range(2 + k % 5)) for k in range(25)]
    rows = [(i, f"{prose(i, 9)}\n{prose(i + 500, 9)}\n{passages[i % 25]}\n{rng.choice(['', prose(i + 700, 8)])}\n{prose(i + 900, 9)}", "en", "a") for i in range(75)]
    rows += [(80, "x y\n" * 6, "en", "a"), (81, f"{prose(5, 60)}\n\nx y\n \nx y\n", "en", "a"), (82, f"new\n{prose(5, 60)}\nx y", "en", "a"), (83, "", "en", "a"), (84, passages[0], "en", "a")]
    got = {r.doc_id: r for r in line_dedup.remove_repeated_chunks(table(spark, rows)).collect()}
    texts = {r[0]: r[1] for r in rows}
    assert {i: r.text for i, r in got.items()} == repeated_lines_gone(rows)
    for i in range(25, 75):
        assert not set(passages[i % 25].split("\n")) & set(got[i].text.split("\n")) and got[i].n_removed >= 2
    assert all(passages[i] in got[i].text for i in range(25)) and got[84].text == ""
    assert all(r.removed_chars == len(texts[i]) - len(r.text) for i, r in got.items())


def test_repeated_lines_of_repeated_ids_and_nulls(spark):
    a, b = prose(1, 30) + "\n" + prose(2, 30), prose(3, 5)
    rows = [(None, a, "en", "a"), (1, a + "\n" + b, "en", "a"), (1, b, "en", "a"), (2, None, None, None), (3, a, "en", "a"), (3, a, "en", "a")]
    got = sorted((r.doc_id or 0, r.text, r.n_removed) for r in line_dedup.remove_repeated_chunks(table(spark, rows)).where("text is not null").collect())
    assert got == sorted([(0, a, 0), (1, b, 2), (1, b, 0), (3, "", 2), (3, "", 2)])
    assert line_dedup.remove_repeated_chunks(table(spark, rows)).count() == 6 and line_dedup.remove_repeated_chunks(table(spark, rows).limit(0)).count() == 0


def test_pipeline_drops_short_repeated_runs(spark, sf_dir):
    import corpus_pipeline as P

    runs = ["\n".join(prose(300 + 10 * k + j, 28) for j in range(2)) for k in range(8)]
    docs = table(spark, [(i, f"{prose(900 + i, 9)}\n{runs[i % 8]}\n{prose(950 + i, 9)}", "en", "a") for i in range(16)])
    out = {r.doc_id: r.text for r in P.lines(spark, docs, sf_dir).collect()}
    assert all(runs[i] in out[i] and not set(runs[i].split("\n")) & set(out[i + 8].split("\n")) for i in range(8))


@pytest.mark.parametrize("divisor", [1, 2, 4])
def test_long_passages_and_runs_of_one_line(spark, divisor):
    """Passages of 40 lines: all lines go, whatever the divisor; of a run of one line the first stays."""
    rows = [(2 * k + side, "\n".join([prose(70000 + 100 * k + 10 * side + j, 9) for j in range(10)] + [prose(50 * k + j, 9) for j in range(40)] + [prose(90000 + 100 * k + 10 * side + j, 9) for j in range(10)]), "en", "a") for k in range(20) for side in (0, 1)]
    rows += [(1000, "\n".join(["the same line"] * 1000), "en", "a"), (1001, "own words first\nthe same line\nthe same line", "en", "a")]
    got = {r.doc_id: r for r in line_dedup.remove_repeated_chunks(table(spark, rows), line_dedup.Chunking(divisor=divisor)).collect()}
    left = [len(set(rows[i - 1][1].split("\n")) & set(got[i].text.split("\n"))) for i in range(1, 40, 2)]
    assert all(got[i].text == rows[i][1] for i in range(0, 40, 2)) and all(got[i].n_removed == 40 - x for i, x in zip(range(1, 40, 2), left, strict=True))
    assert sum(left) == 0 and got[1000].text == "the same line" and got[1001].text == "own words first"


def test_chunks_are_cut_by_the_rolling_hash_and_carry_the_result(spark, monkeypatch):
    """The query's own parameters roll the hash; copies are settled by chunks, whose inner lines aren't compared again."""
    calls, rolled = [], line_dedup.rolled
    monkeypatch.setattr(line_dedup, "rolled", lambda *a: calls.append(a) or rolled(*a))
    body = [prose(200 + j, 9) for j in range(400)]
    rows = [(1, "\n".join(body), "en", "a"), (2, "\n".join(["new words here", *body[:200], "put between", *body[200:]]), "en", "a")]
    docs = table(spark, rows).withColumn("_row", F.xxhash64("doc_id", "text"))
    cuts = {r.doc_id: {r.text.split("\n")[x.end] for x in r.c} for r in docs.select("doc_id", "text", line_dedup.line_chunks(F.col("text")).alias("c")).collect()}
    assert calls and 50 < len(cuts[1]) < 200 and len(cuts[1] ^ cuts[2]) <= 4  # boundaries stand at the same lines in both texts
    runs = line_dedup.repeated_runs(docs.select("doc_id", "_row", "text"), line_dedup.Chunking()).where("gone").collect()
    coarse = {i for r in runs if r.coarse for i in range(r.begin, r.end + 1)}
    assert all(r.doc_id == 2 for r in runs) and len(coarse) > 300
    assert not any(r.begin in coarse and r.end in coarse and any(c.coarse and c.begin <= r.begin and r.end <= c.end for c in runs) for r in runs if not r.coarse)
    got = {d: {r.doc_id: r.text for r in line_dedup.remove_repeated_chunks(table(spark, rows), line_dedup.Chunking(divisor=d)).collect()} for d in (1, 4, 16)}
    assert got[1] == got[4] == got[16] == repeated_lines_gone(rows) and got[4][2] == "new words here\nput between"


def test_texts_that_share_a_hash(spark, monkeypatch):
    """Chunks are told apart by their texts if hashes don't: here all chunks of a length share one."""
    rows = [(i, f"{prose(i, 3)}\n{prose(30 + i % 4, 30)}\n{prose(60 + i % 4, 30)}", "en", "a") for i in range(12)]
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: F.length(c[-1]).cast("long"))
    monkeypatch.setattr(line_dedup.F, "hash", lambda c: F.lit(0))
    got = {r.doc_id: r.text for r in line_dedup.remove_repeated_chunks(table(spark, rows)).collect()}
    assert got == repeated_lines_gone(rows)


def test_decisions_by_shuffle_agree(spark, monkeypatch):
    rows = [(i, f"{prose(i, 9)}\n{prose(300 + i % 5, 28)}\n{prose(400 + i % 5, 28)}", "en", "a") for i in range(20)]
    monkeypatch.setattr(line_dedup, "is_small", lambda ids: False)
    out = line_dedup.remove_repeated_chunks(table(spark, rows))
    assert {r.doc_id: r.text for r in out.collect()} == repeated_lines_gone(rows) and "n_chars" in out.columns


CONVERSATION = [(1, 0, "user", r"\### Assistant: </turn> ok"), (1, 1, "assistant", "a\\e\\\\b </turn>\n### user:\n"), (1, 2, None, None), (2, 0, "odd:\nrole", "### "), (2, 0, "odd:\nrole", "### "), (3, None, "assistant", ""), (None, 1, "assistant", "plain")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CONVERSATION, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat_format.format_conversations(df)
    rows = out.select("conv_id", "escaping", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in rows}
    assert got[1] == [(c[2] or "", c[3] or "") for c in CONVERSATION[:3]] and got[2] == [("odd:\nrole", "### ")] * 2
    assert {r.conv_id: r.loss for r in rows} == {1: CONVERSATION[1][3], 2: "", 3: "", None: "plain"}
    assert {r.conv_id: r.escaping for r in rows}[None] == 0
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_chat_round_trip_on_random_texts(spark):
    rng = random.Random(5)
    bits = ["\\", "\\e", "### ", "</turn>", "\n", ":", "#", "<", "/turn>", "é🦆", "x", " "]
    rows = [(i // 4, i % 4, rng.choice(["user", "assistant", "### ", "a:\n"]), "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for i in range(800)]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.select("conv_id", chat_format.parse(F.col("formatted")).alias("turns")).collect()}
    assert got == {c: [(r[2], r[3]) for r in rows if r[0] == c] for c in range(200)}


def edits(pattern: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def folded(text: str) -> bytes:
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    return decontaminate.fold(raw, np.array([0, len(raw)]))[0].tobytes()


def leaks_by_alignment(docs, items, s):
    """{(document, item): windows found} by aligning every window of every item with every whole text."""
    out = {}
    for i, text in docs:
        for k, item in items:
            cut = [w.tobytes() for w in decontaminate.windows(np.frombuffer(folded(item), np.uint8), s)]
            if n := sum(edits(w, folded(text)) <= s.edits(len(w)) for w in cut):
                out[i, k] = n
    return out


def test_decontamination_against_full_alignment(spark):
    s = decontaminate.Search(step=50)
    rng = random.Random(11)
    items = [(k, prose(200 + k, 25)) for k in range(3)] + [(3, "the short item here"), (4, "Fourteen of: 14!"), (5, prose(200, 25)), (6, "tiny")]
    docs = []
    for i in range(30):
        passage = list(items[i % 5][1])
        for _ in range(rng.randrange(14) if i % 5 < 3 else rng.randrange(3)):
            at = rng.randrange(len(passage))
            passage[at : at + rng.randrange(2)] = rng.choice(["", "q", "zz"])
        docs.append((i, prose(900 + i, 25) + " " + "".join(passage).upper() + " !! " + prose(700 + i, 25)))
    got = {(r.doc_id, r.item_id): r.windows for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), s).collect()}
    want = leaks_by_alignment(docs, items, s)
    assert len(want) > 15 and got == want
    # whatever is left out of the join, and however full the bitmap is
    for other in (decontaminate.Search(step=50, hot=0), decontaminate.Search(step=50, most_bits=7, slice=300)):
        assert {(r.doc_id, r.item_id): r.windows for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), other).collect()} == want


def test_leaks_in_very_long_texts_and_common_items(spark):
    """Ten million equal letters, and a benchmark whose items begin alike: bounded work, spans that point at the passage."""
    begin = "Answer the following question about the text and give reasons for each of your choices in full: "
    items = [(k, begin + prose(200 + k, 30)) for k in range(300)] + [(1000, "a" * 400)]
    docs = [(1, "a" * 10_000_000), (2, prose(1, 50) + " Ä " + items[7][1] + " " + prose(2, 50)), (3, prose(3, 400)), (4, "x" * 3_000_000 + " " + items[9][1]), (5, begin)]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert (1, 1000) in got and (2, 7) in got and (4, 9) in got and not any(d == 3 for d, _ in got)
    assert got[2, 7].windows == got[2, 7].item_windows and got[2, 7].edits == 0
    shown = docs[1][1].lower().encode()[got[2, 7].begin : got[2, 7].end].decode()
    assert shown == items[7][1].lower()
    assert not any(d == 1 and k != 1000 for d, k in got)


@pytest.mark.parametrize("bits", [7, 16, 20])
def test_bitmaps_hold_the_leading_bits_of_all_grams(spark, bits):
    s, rng = decontaminate.Search(), np.random.default_rng(bits)
    g, m = rng.integers(0, 2**64, 3000, np.uint64), rng.choice([40, s.window - 1, s.window], 3000)
    rows = [(int(x), int(n)) for x, n in zip(g.view(np.int64), m, strict=True)]
    whole, short = decontaminate._bitmaps(spark.createDataFrame(rows, "g long, m int"), bits, s)
    for got, own in ((whole, g[m >= s.window]), (short, g[m < s.window])):
        want = np.zeros(1 << bits, bool)
        want[(own >> np.uint64(64 - bits)).astype(np.int64)] = True
        assert got.dtype == np.uint64 and np.array_equal(np.unpackbits(got.view(np.uint8), bitorder="little").astype(bool), want)
        assert decontaminate._inside(got, own).all()
    none = decontaminate._bitmaps(spark.createDataFrame([], "g long, m int"), bits, s)
    assert not any(x.any() for x in none)


def test_more_languages_than_the_bound_are_an_error(spark):
    docs = spark.createDataFrame([(k, "some words of text", f"l{k}") for k in range(6)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="6 languages"):
        language_id.train(docs, F.lit(True), language_id.Fit(most_languages=5))
    assert len(set(language_id.train(docs, F.lit(True), language_id.Fit(most_languages=6)).langs)) == 6


@pytest.mark.parametrize("n", [0, 1, 5, 30, 31, 32, 40])
def test_stretches_of_few_places(n):
    s = decontaminate.Search()
    place, doc, edges = np.arange(n) * 2, np.zeros(n, int), np.array([0, 200])
    begin, end = decontaminate.dense(place, doc, s.need(100), edges, s)
    assert len(begin) == max(0, n - s.need(100) + 1) and all(b <= 2 * k and e >= 2 * k + s.q for k, (b, e) in enumerate(zip(begin, end, strict=True)))


def test_leaks_of_repeated_rows_and_nulls(spark):
    item = prose(200, 25)
    rows = [(1, item, None, None), (1, item + " " + prose(3, 5), None, None), (None, item, None, None), (2, None, None, None)]
    got = decontaminate.find_leaks(table(spark, rows), spark.createDataFrame([(5, item, 1), (5, item, 2), (6, None, 3), (None, item, 4)], "item_id long, text string, class int")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 5), (None, 5)} and len(got) == 2 and all(r.windows == r.item_windows for r in got)


def test_mix_meets_targets(spark):
    rows = [(i, prose(i, 1 + i % 40), "en", "abcd"[0 if i % 3 == 0 else i % 4]) for i in range(2000)]
    got = mixing.mix_sources(table(spark, rows), None, mixing.Mix(bins=16, levels=2)).collect()
    for source in "abcd":
        part = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 41 and all(r.taken <= 3 * r["size"] for r in part)
    assert abs(sum({r.source: r.target for r in got}.values()) - sum(r["size"] for r in got)) < 1e-3


def test_mix_prefers_heavy_documents(spark):
    docs = table(spark, [(i, prose(i, 10), "en", "a") for i in range(1000)] + [(i, prose(i, 10), "en", "b") for i in range(1000, 4000)])
    weights = spark.createDataFrame([(i, 4.0 if i % 2 else 1.0) for i in range(4000)], "doc_id long, weight double")
    got = [r for r in mixing.mix_sources(docs, weights).collect() if r.source == "b"]
    more = [r.doc_id % 2 for r in got if r.copies > min(x.copies for x in got)]
    assert 0.6 < sum(more) / len(more) < 0.95


def mixed_by_sorting(rows, weights, mix):
    """copies by (doc_id, size): targets by water filling, then keys in order, one document after another."""
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    sources = sorted({r[3] for r in rows}, key=lambda x: (x is None, x))
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in sources}
    weight = {s: mix.weights[k % len(mix.weights)] for k, s in enumerate(sources)}
    target, free, rest = {}, list(sources), float(sum(total.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        full = [s for s in free if mix.max_epochs * total[s] <= level * weight[s]]
        for s in full or free:
            target[s] = float(mix.max_epochs * total[s]) if full else level * weight[s]
        rest -= sum(target[s] for s in full)
        free = [s for s in free if full and s not in full]
    out = {}
    for s in sources:
        draw = lambda i: (int(hashlib.md5((mix.seed + ("" if i is None else str(i))).encode()).hexdigest()[:13], 16) + 1) / 2.0**52
        keyed = sorted((-math.log(draw(r[0])) / weights.get(r[0], 1.0), r[0] is not None, r[0] or 0) for r in rows if r[3] == s)
        epochs, run = int(target[s] // total[s]) if total[s] else 0, 0
        for _, known, i in keyed:
            i = i if known else None
            run += size[i]
            out[i] = epochs + (run <= target[s] - epochs * total[s])
    return out, target


@pytest.mark.parametrize("weight", [1e-6, 0.01, 1.0, 1e6, None])
def test_mix_against_sorting(spark, weight):
    rows = [(i, prose(i, 1 + i % 40), "en", "abcd"[0 if i % 3 == 0 else i % 4]) for i in range(600)]
    rows += [(700, "one document here", "en", "e"), (701, None, "en", "z"), (702, "  ", "en", "z"), (703, None, "en", None), (704, "x", "en", None)]
    weights = {i: weight or [1e-6, 0.5, 1e6][i % 3] for i, *_ in rows}
    mix = mixing.Mix(bins=16, levels=3)
    got = mixing.mix_sources(table(spark, rows), spark.createDataFrame(list(weights.items()), "doc_id long, weight double"), mix).collect()
    want, target = mixed_by_sorting(rows, weights, mix)
    assert len(got) == len(rows) and {r.doc_id: r.copies for r in got} == want
    assert all(r.taken == r["size"] * r.copies and abs(r.target - target[r.source]) < 1e-5 for r in got)
    for source in target:
        part = [r for r in got if r.source == source]
        assert sum(r.taken for r in part) <= part[0].target + 1e-6 and part[0].target - sum(r.taken for r in part) <= 40


def test_mix_keeps_wordless_rows(spark):
    rows = [(1, "a b c", "en", "s"), (2, "d e", "en", "s"), (3, None, "en", "z"), (4, "  ", "en", "z"), (5, None, "en", None)]
    assert sorted(r.doc_id for r in mixing.mix_sources(table(spark, rows)).collect()) == [1, 2, 3, 4, 5]
    none = mixing.mix_sources(table(spark, rows[2:])).collect()
    assert [(r.doc_id, r.target, r.taken) for r in sorted(none, key=lambda r: r.doc_id)] == [(3, 0.0, 0), (4, 0.0, 0), (5, 0.0, 0)]
    odd = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, -1.0), (4, 0.0), (5, None)], "doc_id long, weight double")
    assert {r.doc_id: r.copies for r in mixing.mix_sources(table(spark, rows), odd).collect()} == {r.doc_id: r.copies for r in mixing.mix_sources(table(spark, rows)).collect()}


def test_fences_follow_their_groups(spark):
    """Groups of different distributions have different fences for every measure, and each loses its own odd texts only."""
    rng = random.Random(12)

    def text(kind: int, words: int = 80, symbols: float = 0.0, same: int = 0) -> str:
        own = [rng.choice(WORDS)[: 3 + 2 * kind] + ("7" * (kind * rng.randrange(3))) + ("#" * (1 + kind)) * (rng.random() < symbols) for _ in range(words)]
        lines = [" ".join(own[k : k + 8]) for k in range(0, words, 8)]
        return "\n".join(lines + lines[:same])

    rows = [(i, text(i % 2, 160, 0.05 + 0.3 * (i % 2) * rng.random(), 1 + (i % 2) * rng.randrange(3)), "en", "ab"[i % 2]) for i in range(400)]
    rows += [(1000, text(0, 160, symbols=1.0), "en", "a"), (1001, "abcdefghijklmnop" * 2 + " " + " ".join(w * 6 for w in WORDS), "en", "a")]
    docs = table(spark, rows)
    measured = quality_rules.with_measures(quality_rules.measure(docs))
    limits = quality_rules.fences(quality_rules.sketches(measured.where("not base_failed"))).collect()
    by = {m: {(r.lo, r.hi) for r in limits if r.measure == m} for m in quality_rules.MEASURES}
    assert all(len(x) == 2 for x in by.values()), by
    kept = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs).collect()}
    assert not kept[1000] and not kept[1001] and sum(kept[i] for i in range(400)) >= 380


def test_small_groups_lean_on_larger_ones(spark):
    rows = [(i, prose(i, 60 + i % 9), "en", "a") for i in range(200)] + [(500, " ".join(chr(97 + k) * 90 for k in range(25)), "en", "new")]
    lone = lambda rules: {r.doc_id: r.kept for r in quality_rules.apply_rules(table(spark, rows), rules).collect()}[500]
    assert not lone(quality_rules.Rules()) and lone(quality_rules.Rules(prior=0))


def test_measures_against_python(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) + rng.choice(["", "\n# x\n# x\n", "\n \n"]) for _ in range(300)]
    got = {r.doc_id: r for r in quality_rules.measure(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        seen: dict[tuple, list[int]] = {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        covered = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(8)}
        lines = [x for x in t.split("\n") if x.strip()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_pseudonyms():
    p, back = KEY, pii.Pseudonyms(key=b"k", inverse=True)
    for n in (2, 7, 100, 1000):
        image = [pii.permute(i, n, "t", p) for i in range(n)]
        assert sorted(image) == list(range(n)) and [pii.permute(i, n, "t", back) for i in image] == list(range(n))
    text = "card 4111 1111 1111 1111, bad 4111 1111 1111 1112; mail Ann.Lee9@mail.example.com and ANN.LEE9@MAIL.EXAMPLE.COM; on 2024-02-29, never 2023-02-29; ip 10.0.0.1 not 999.1.1.1"
    out, found = pii.pseudonymise(text, p)
    assert found == {"card": 1, "email": 2, "date": 1, "ip": 1}
    card = out.split("card ")[1][:19]
    assert [len(x) for x in card.split()] == [4] * 4 and pii.luhn(card.replace(" ", "")) % 10 == 0 and card != "4111 1111 1111 1111"
    assert "4111 1111 1111 1112" in out and "2023-02-29" in out and "999.1.1.1" in out and "2024-02-29" not in out
    mails = [w.rstrip(";") for w in out.split() if "@" in w]
    assert mails[0].lower() == mails[1].lower() and mails[1].isupper() and mails[0].lower() != "ann.lee9@mail.example.com"


@pytest.mark.parametrize("iban", ["BE68539007547034", "ES9121000418450200051332", "DE89 3704 0044 0532 0130 00", "NO9386011117947", "PL61 1090 1014 0000 0712 1981 2874"])
@pytest.mark.parametrize(("before", "after"), [("pay ", " for it"), ("TO ", " AND THIS IS ALL"), ("from x1 ", " is"), ("AB12 CODE ", ", then"), ("", " " + "BE68539007547034"), ("", "")])
def test_ibans_between_words(iban, before, after):
    out, found = pii.pseudonymise(before + iban + after, KEY)
    assert found == {"iban": 1 + ("BE68" in after)} and iban not in out and out.startswith(before)
    new = out[len(before) :][: len(iban)]
    assert pii._mod97(new.replace(" ", "")) == 1 and [c == " " for c in new] == [c == " " for c in iban] and ("BE68" in after or out.endswith(after))


def test_values_inside_rejected_candidates():
    out, found = pii.pseudonymise("NO12 CARD 4111 1111 1111 1111 and 1234 4111 1111 1111 1111; BE68539007547035 stays", KEY)
    assert found == {"card": 2} and "4111 1111 1111 1111" not in out and "BE68539007547035 stays" in out


def test_languages_without_letters(spark, odd):
    model = language_id.train(odd, F.lit(True))
    got = {r.doc_id: r.lang_pred for r in language_id.detect(odd, model).collect()}
    assert got[1] == got[2] == got[3] == got[7] == "und" and got[8] == "de"


def test_dates_are_permuted_within_their_format():
    days = [datetime.date(1990, 1, 1) + datetime.timedelta(k) for k in range(3653)]
    forms = {
        "iso": lambda d: f"{d:%Y-%m-%d}", "iso short": lambda d: f"{d.year}-{d.month}-{d.day}", "dots": lambda d: f"{d.day}.{d.month}.{d.year}",
        "day first": lambda d: f"{d:%d/%m/%Y}", "short": lambda d: f"{d.day}/{d.month}/{d.year}", "month first": lambda d: f"{d:%m/%d/%Y}" if d.day > 12 else "", "month first short": lambda d: f"{d.month}/{d.day}/{d.year}" if d.day > 12 else "",
    }
    back = pii.Pseudonyms(key=KEY.key, inverse=True)
    source: dict[str, str] = {}
    for form in forms.values():
        for text in filter(None, map(form, days)):
            new = pii._date(text, KEY)
            assert re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", text) and pii._date(new, back) == text
            assert source.setdefault(new, text) == text  # no two spellings share a pseudonym
    assert all(pii._date(f"{d:%d/%m/%Y}", KEY) == f"{datetime.date.fromisoformat(pii._date(f'{d:%Y-%m-%d}', KEY)):%d/%m/%Y}" for d in days[::50])


def test_every_kind_turns_back_by_key():
    text = "mail Ann.Lee9@mail.example.com card 4111 1111 1111 1111 ssn 219-09-9999 call (415) 555-0132 or +442079460958 IBAN DE89 3704 0044 0532 0130 00 ip 10.20.30.40 and 1.2.3.4 on 1/2/2020 or 2020-1-5 api_key=0123456789abcdef0123"
    out, found = pii.pseudonymise(text, KEY)
    assert found == {"email": 1, "card": 1, "ssn": 1, "phone": 2, "iban": 1, "ip": 2, "date": 2, "secret": 1} and len(out) == len(text)
    assert re.sub("[0-9]", "0", re.sub(r"ip.*? on", "", out.split(" card ")[1])).split("api")[0] == re.sub("[0-9]", "0", re.sub(r"ip.*? on", "", text.split(" card ")[1])).split("api")[0]
    assert pii.pseudonymise(out, pii.Pseudonyms(key=KEY.key, inverse=True))[0] == text and pii.pseudonymise(text, pii.Pseudonyms(key=b"other"))[0] != out
    with pytest.raises(ValueError, match="key"):
        pii.Pseudonyms(key=b"")


def test_addresses_keep_their_lengths():
    seen = {pii._ip(f"1.2.{k}.4", KEY) for k in range(10, 100)}
    assert len(seen) == 90 and all([len(x) for x in s.split(".")] == [1, 1, 2, 1] for s in seen)


def test_secrets_in_texts_without_digits(spark):
    texts = ["token=abcdefabcdefabcdef", "my PASSWORD: 'deadbeefdeadbeefdead'", "nothing here", None, "", "IBAN BE68539007547034 is mine"]
    got = sorted((r.doc_id, r.text, r.n_found, r.kinds) for r in pii.hide_personal_data(table(spark, [(i, t, None, None) for i, t in enumerate(texts)]), KEY).collect())
    for i, text, n, kinds in got:
        out, found = pii.pseudonymise(texts[i] or "", KEY)
        assert (text or "") == out and n == found.total() == sum(int(k.split(":")[1]) for k in kinds.split(",") if k)
    assert [r[2] for r in got] == [1, 1, 0, 0, 0, 1]


TEXTS = ["The cat sat. the THE cat ran!", "", "a", "Wörter ÜBER Straße 12, 12 a***", "no no  no\n\tNo way_out", " lead", "x1 y2 x1 y2"]


def as_bytes(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def plain_words(text: str) -> list[bytes]:
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", text.encode()) if w]


def lower(word: bytes) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in word)


def test_quality_tokens_and_pooling_against_python():
    """Every word gives its hashed self, its shape and the mark of a repetition; pooling is their mean and the log of the length."""

    def shape(word: bytes) -> str:
        kinds = "".join("d" if 48 <= c <= 57 else "U" if 65 <= c <= 90 else "l" if 97 <= c <= 122 or c >= 128 else "m" if c in b".,;:'\"()-" else "s" for c in word)
        return re.sub(r"(.)\1+", r"\1", kinds)

    size, entry_of = 1 << 13, {}
    entry, first = quality_model.tokens(*as_bytes(TEXTS), size)
    vectors = np.random.default_rng(1).normal(size=(size, 5))
    pooled = quality_model._pool(entry, first, vectors)
    for i, text in enumerate(TEXTS):
        own = entry[first[i] : first[i + 1]].reshape(-1, 3)
        words = plain_words(text)
        assert len(own) == len(words)
        for k, w in enumerate(words):
            assert entry_of.setdefault(("word", lower(w)), own[k, 0]) == own[k, 0] < size // 2
            assert entry_of.setdefault(("shape", shape(w)), own[k, 1]) == own[k, 1] and size // 2 <= own[k, 1] < size - 2
            assert own[k, 2] == size - 2 + (k > 0 and lower(words[k - 1]) == lower(w))
        want = vectors[own.ravel()].mean(axis=0) if words else np.zeros(5)
        assert np.allclose(pooled[i, :-1], want) and np.isclose(pooled[i, -1], np.log1p(len(words)))
    assert len(set(entry_of.values())) == len(entry_of)  # different tokens of this small fixture have different entries


def test_quality_contexts_against_python():
    fit = quality_model.Fit(vocabulary=64, dims=4)
    index, want = quality_model.index_vectors(fit), np.zeros((64, 4))
    entry, first = quality_model.tokens(*as_bytes(TEXTS), 64)
    for b, e in zip(first, first[1:], strict=False):
        for i in range(b, e):
            for j in range(max(b, i - 3), min(e, i + 4)):
                if i != j:
                    want[entry[i]] += index[entry[j]]
    got = np.zeros((64, 4))
    for batch in quality_model._contexts(fit)(iter([pa.record_batch([pa.array(TEXTS)], names=["text"])])):
        got[batch.column(0).to_numpy()] = batch.column(1).to_pylist()
    assert np.array_equal(got, want)


def test_toxicity_features_and_updates_against_python():
    fit = toxicity.Fit(size=1 << 14, l1=0.1)
    at, own = toxicity.features(*as_bytes(TEXTS), fit.size)
    coordinate: dict[tuple, int] = {}
    sets = []
    for i, text in enumerate(TEXTS):
        w = [lower(x) for x in re.findall(rb"[A-Za-z0-9\x80-\xff]+", text.encode())]
        features = {(x,) for x in w} | {(1, *x) for x in zip(w, w[1:], strict=False)} | {(2, *x) for x in zip(w, w[2:], strict=False)}
        sets.append(set(at[own == i].tolist()))
        assert len(sets[i]) == len(features)
        for f in [(x,) for x in w]:
            assert coordinate.setdefault(f, toxicity.features(*as_bytes([f[0].decode()]), fit.size)[0][0]) in sets[i]
    # FTRL, one text after another, with plain numbers
    labels, z, n = [1, 0, 1, 0, 1, 1, 0], {}, {}
    weight = lambda k: -(z.get(k, 0.0) - math.copysign(fit.l1, z.get(k, 0.0)) * (k != fit.size)) / ((fit.beta + math.sqrt(n.get(k, 0.0))) / fit.alpha + fit.l2) if k == fit.size or abs(z.get(k, 0.0)) > fit.l1 else 0.0
    for y, s in zip(labels, sets, strict=True):
        keys = [*s, fit.size]
        w = {k: weight(k) for k in keys}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for k in keys:
            root = math.sqrt(n.get(k, 0.0))
            n[k] = n.get(k, 0.0) + g * g
            z[k] = z.get(k, 0.0) + g - (math.sqrt(n[k]) - root) / fit.alpha * w[k]

    class State:
        value = (np.zeros(fit.size + 1), np.zeros(fit.size + 1))

    rows = pa.record_batch([pa.array(labels, pa.int32()), pa.array([sorted(s) for s in sets], pa.list_(pa.int32()))], names=["label", "x"])
    zs, ns = toxicity.passed(State.value, [rows], fit)
    assert all(np.isclose(zs[k], z[k]) and np.isclose(ns[k], n[k]) for k in z) and np.count_nonzero(ns) == len(n)


def test_language_vectors_against_python(spark):
    """Counts of letter pairs and triples, TF-IDF, and the nearest centroid of every text."""
    dims, texts = 2048, [t.lower() for t in TEXTS]
    got = language_id.counts(*as_bytes(texts), dims)
    entry = lambda gram: int((np.frombuffer(gram, np.uint8).astype(np.uint32) * np.array([257**k for k in range(len(gram) - 1, -1, -1)], np.uint32)).sum(dtype=np.uint32) * np.uint32(2654435761) >> np.uint32(21))
    for i, t in enumerate(texts):
        folded = re.sub(rb"[^a-z\x80-\xff]+", b" ", t.encode())
        want = np.zeros(dims)
        for k in (2, 3):
            for j in range(len(folded) - k + 1):
                want[entry(folded[j : j + k])] += 1
        assert np.array_equal(got[i], want), t
    docs = table(spark, [(i, f"{w} {prose(i, 8)}", "ab"[i % 2], None) for i, w in enumerate(["über straße"] * 10 + ["the cat"] * 10)] + [(99, "Über Straße", None, None)])
    model = language_id.train(docs, F.col("lang").isNotNull())
    c = language_id.counts(*as_bytes([r.text.lower() for r in sorted(docs.collect())]), dims)
    x = np.log1p(c) * model.idf
    cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ model.centroids.T
    out = sorted(language_id.detect(docs, model).collect())
    assert [r.lang_pred for r in out] == [model.langs[k] for k in cos.argmax(axis=1)] and np.allclose([r.score for r in out], cos.max(axis=1).clip(0, 1))
    same = table(spark, [(i, "equal text", "ab"[i % 2], None) for i in range(10)])
    assert all(r.score > 0.99 for r in language_id.detect(same, language_id.train(same, F.lit(True))).collect())


def test_pipeline_stages_against_brute_force(spark, sf_dir):
    """Which documents each stage keeps, and with which texts."""
    import corpus_pipeline as P

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if r.text]
    rows = [(i, prose(i, 70), "en", "ab"[i % 2]) for i in range(20)]
    rows += [(20 + i, prose(i, 70)[:-4] + " end", "en", "a") for i in range(6)]  # near copies
    rows += [(30 + i, f"{prose(40 + i, 30)} {bench[i][1]} {prose(60 + i, 30)}", "en", "b") for i in range(4)]
    rows += [(40 + i, f"{prose(80 + i, 9)}\n{prose(99, 30)}\n{prose(98, 30)}\n{prose(120 + i, 40)}", "en", "b") for i in range(3)]
    rows += [(50, None, None, None), (51, "", "en", "a")]
    docs = table(spark, rows).select(*P.COLUMNS)
    texts = {r[0]: r[1] for r in rows}
    lined = {r.doc_id: r.text for r in P.lines(spark, docs, sf_dir).collect()}
    assert lined == repeated_lines_gone([r for r in rows if r[1] is not None]) | {50: None}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items() if t}
    copies = {j for i in sets for j in sets if i < j and jaccard(sets[i], sets[j]) >= 0.8}
    assert {r.doc_id for r in P.near_duplicates(spark, docs, sf_dir).collect()} == set(texts) - copies and copies == set(range(20, 26))
    leaked = {30, 31, 32, 33}
    assert {d for d, _ in leaks_by_alignment([(i, texts[i]) for i in [0, 20, *leaked]], bench[:6], decontaminate.Search())} == leaked
    assert {r.doc_id for r in P.leaks(spark, docs, sf_dir).collect()} == set(texts) - leaked
    weights = {r.doc_id: {1: 2.0, 0: 0.5}.get(r.quality, 1.0) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    want, _ = mixed_by_sorting(rows, weights, mixing.Mix())
    assert {r.doc_id: r.copies for r in P.mix(spark, docs, sf_dir).collect()} == want
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_model.train(given.select(*P.COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id for r in quality_model.score(given, model).collect() if r.score >= 0.3}
    assert {r.doc_id for r in P.quality(spark, given, sf_dir).collect()} == good and 0 < len(good) < given.count()


def test_very_long_texts_pass_every_operator(spark):
    """Texts of ten and more megabytes beside short ones; null conversation ids and clashing column names."""
    docs = table(spark, [(1, prose(5, 50) * 30_000, "en", "a"), (2, "z" * 12_000_000, "en", "a"), (3, prose(6, 40), "en", "b")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for m in (quality_model, toxicity):
        assert m.score(docs, m.train(docs, labels)).count() == 3
    assert language_id.detect(docs, language_id.train(docs, F.lit(True))).where("lang_pred = 'en'").count() == 3
    assert pii.hide_personal_data(docs, KEY).count() == 3 and near_dedup.near_duplicates(docs).where("kept").count() == 3
    clash = docs.where("doc_id = 3").withColumns({c: F.lit(1) for c in ("_id", "w_id", "node", "_row", "_rest", "i", "d", "r", "s", "slice", "class")})
    assert line_dedup.remove_repeated_chunks(clash).columns[2:] == clash.columns[2:] + ["n_removed", "removed_chars"]
    assert mixing.mix_sources(clash, labels.select("doc_id", F.lit(1.0).alias("weight"), F.lit(0).alias("size"))).count() == 1
    assert decontaminate.find_leaks(clash, clash.select(F.col("doc_id").alias("item_id"), "text", "node")).count() == 1


def test_toxicity_shards_do_not_hang_on_partitions_or_batches():
    class State:
        value = (np.zeros(65), np.zeros(65))

    fit = toxicity.Fit(size=64, l1=0.1)
    xs = pa.array([[1, 2], [2, 3], [], [4], [1, 4]], pa.list_(pa.int32()))
    rows = pa.record_batch([pa.array([0, 0, 1, 1, 1], pa.int32()), pa.array([1, 0, 1, 0, 1], pa.int32()), xs], names=["shard", "label", "x"])
    run = toxicity._round(State, fit)
    changes = lambda *parts: [tuple(r.values()) for part in parts for out in run(iter(part)) for r in out.to_pylist()]
    whole = changes([rows])
    assert [r[0] for r in whole] == [0, 1]
    assert changes([rows.slice(i, 1) for i in range(5)]) == whole
    assert changes([rows.slice(0, 2)], [], [rows.slice(2, 1), rows.slice(3)]) == whole
