"""The text operators against plain models."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard

import brute
import corpus_pipeline
from relaygauge.llm import components as component_steps
from relaygauge.llm import jaccard_join, language_id, mixing, passages, suffix_array, toxicity
from relaygauge.llm.components import components
from relaygauge.llm.decontamination import contamination
from relaygauge.llm.jaccard_join import near_duplicates
from relaygauge.llm.licenses import LICENSE_TEMPLATES, license_scan
from relaygauge.llm.quality import quality
from relaygauge.llm.queries import QUERIES
from relaygauge.llm.suffix_dedup import suffix_dedup
from relaygauge.llm.token_counts import token_counts

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def prose(rng, n, vocabulary=4_000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# Suffix arrays and repeated strings


@pytest.mark.parametrize("letters", [b"ab", b"abcdefgh", bytes(range(0, 250, 7))])
def test_suffixes_are_in_order(letters):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 60, 40)
    raw = np.frombuffer(letters, np.uint8)[rng.integers(0, len(letters), int(sizes.sum()))]
    text, starts = suffix_array.joined(raw, sizes)
    wanted = np.zeros(len(text), bool)
    for s, n in zip(starts, sizes):
        wanted[s : s + max(0, n - 15)] = True  # strings of 16 bytes
    order, group = suffix_array.equal_strings(text, wanted, 16)
    strings = [text[i : i + 16].tobytes() for i in order]
    assert strings == sorted(text[i : i + 16].tobytes() for i in np.flatnonzero(wanted))
    assert len(set(zip(strings, group))) == len(set(strings)) == group[-1] + 1
    shared = suffix_array.common_prefixes(order, suffix_array.words_at(text, 16), 16)
    for a, b, n in zip(strings, strings[1:], shared[1:]):
        assert n == next((k for k in range(16) if a[k] != b[k]), 16)


def test_smaller_than_next():
    text = np.frombuffer(b"\0mississippi\0", np.uint8)
    raw = text.tobytes()
    assert suffix_array.smaller_than_next(text)[:-1].tolist() == [raw[i:] < raw[i + 1 :] for i in range(len(raw) - 1)]


def check_repeats(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    result = {r.doc_id: r for r in suffix_dedup(frame, **options).collect()}
    for (key, text), mask in zip(rows, brute.repeats(rows)):
        raw = (text or "").encode()
        row = result[key]
        assert row.n_bytes == len(raw)
        assert bytes(row.kept) == bytes(b for b, m in zip(raw, mask) if not m), key
        edges = [i for i in range(len(raw) + 1) if (mask[i] if i < len(raw) else 0) != (mask[i - 1] if i else 0)]
        assert [x for s in row.spans for x in (s.start, s.end)] == edges
    return result


def test_repeats_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    shared = [prose(rng, n) for n in (8, 12, 60, 200)] + ["a" * 300, "ab" * 120, "é" * 80]
    rows = []
    for key in range(120):
        parts = []
        for _ in range(rng.randrange(5)):
            passage = rng.choice(shared)
            cut = rng.randrange(len(passage) // 2)
            parts += [prose(rng, rng.randrange(12)), passage[cut : len(passage) - rng.randrange(len(passage) // 2)]]
        rows.append((key * 7 % 120, " ".join(parts)))
    rows[5] = (rows[5][0], None)
    rows[9] = (None, rows[8][1])
    check_repeats(spark, rows, block_bytes=6_000, bucket_bytes=20_000)
    check_repeats(spark, rows)


def test_snippets_sorted_in_parts(monkeypatch):
    from relaygauge.llm import suffix_dedup as module

    rng = np.random.default_rng(5)
    snippets = ["".join(chr(97 + c) for c in rng.integers(0, 2, rng.integers(50, 60))) for _ in range(60)]
    snippets = [s if i % 3 else snippets[0][: 50 + i % 8] for i, s in enumerate(snippets)]
    h = np.array([int(s.startswith(snippets[0][:50])) << 16 for s in snippets], np.uint64)
    doc, lengths = np.arange(60), np.array([len(s) for s in snippets])
    raw = "".join(snippets).encode()
    whole = module._least_of_starts(h, doc, lengths, raw, 50)
    monkeypatch.setattr(module, "SORT_BYTES", 1000)
    parts = module._least_of_starts(h, doc, lengths, raw, 50)
    for i, (a, b) in enumerate(zip(whole, parts)):
        assert len(a) == len(snippets[i]) - 49 and a.tolist() == b.tolist()
        assert a.tolist() == [min(k for k, t in enumerate(snippets) if snippets[i][s : s + 50] in t) for s in range(len(a))]


def test_copies_across_many_blocks(spark):
    rng = random.Random(4)
    text = prose(rng, 100)
    rows = [(i, text if i % 3 == 0 else text[:200] + prose(rng, 20)) for i in range(200)]
    result = check_repeats(spark, rows, block_bytes=3_000, bucket_bytes=9_000)
    assert len(result[0].kept) == len(text) and len(result[3].kept) == 0


def test_blocks_longer_than_a_slice(spark, monkeypatch):
    """Groups may come in any order; anchors must be the same each time."""
    from relaygauge.llm import suffix_dedup as module

    monkeypatch.setattr(module, "SLICE", 700)
    rng = random.Random(11)
    passage = prose(rng, 60)
    texts = [prose(rng, 30) + passage[rng.randrange(200) :] for _ in range(30)]
    frames = [pd.DataFrame({"_order": np.arange(30), "_text": [zstandard.compress(t.encode()) for t in texts], "_block": 0}) for _ in range(2)]
    frames[1] = frames[1].sample(frac=1, random_state=1)
    first, second = (module._send_anchors(50, 1)(f)["anchors"][0] for f in frames)
    assert first == second


def test_whole_characters(spark):
    text = "äöü" * 20
    rows = [(1, "." + text), (2, "é" + text + "ß"), (3, "x" + text)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for row in suffix_dedup(frame, whole_characters=True).collect():
        bytes(row.kept).decode()


# Fuzzy passages


def brute_chain(place, other):
    """The best score of any chain, by trying each match after each other."""
    order = sorted(range(len(place)), key=lambda i: (place[i], other[i]))
    best = {}
    for i in order:
        gain = max(
            [best[j] - passages.GAP_COST * (place[i] - place[j] + other[i] - other[j]) for j in best if place[j] < place[i] and other[j] < other[i]],
            default=0,
        )
        best[i] = passages.SEED_WEIGHT + max(0, gain)
    return max(best.values())


def test_chains_are_the_best():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(2, 30))
        place, other = rng.integers(0, 60, n), rng.integers(0, 60, n)
        found = passages.chains(place, other)
        used = [i for chain in found for i in chain]
        assert len(used) == len(set(used))
        top = brute_chain(place, other)
        assert bool(found) == (top >= passages.LEAST_SCORE)
        for chain in found:
            x, y = place[chain], other[chain]
            assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all()
        if found:
            x, y = place[found[0]], other[found[0]]
            score = passages.SEED_WEIGHT * len(x) - passages.GAP_COST * (x[-1] - x[0] + y[-1] - y[0])
            assert score == pytest.approx(top)


def test_agreeing_words():
    def brute_common(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 4, rng.integers(0, 12))
        assert passages.agreeing(a, b) == brute_common(a.tolist(), b.tolist())


def test_fuzzy_passages_are_found(spark):
    rng = random.Random(12)
    sources = [prose(rng, 80, 10**6) for _ in range(6)]
    rows, planted = [], {}
    for key in range(120):
        parts = [prose(rng, rng.randrange(20, 80), 10**6)]
        if key % 3 == 0:
            which = rng.randrange(6)
            w = sources[which].split()
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                del w[40]
            planted[key] = (which, len(parts[0].split()), len(w))
            parts += [" ".join(w), prose(rng, 30, 10**6)]
        rows.append((key, " ".join(parts)))
    rows[1] = (1, prose(rng, 90, 10**6))
    rows += [(200, rows[1][1]), (201, rows[1][1]), (202, "short " * 3), (203, None)]
    found = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    seen = set()
    for key in range(120):
        row = found[key]
        if key not in planted or planted[key][0] not in seen:
            assert row.n_passages == 0 and row.first_ids == [], key
        else:
            which, start, n = planted[key]
            covered = {i for p in row.passages for i in range(p.start, p.end)}
            assert row.n_passages == 1 and len(covered & set(range(start, start + n))) >= 0.75 * n, key
            assert covered <= set(range(start, start + n)) and all(i < key and planted[i][0] == which for i in row.first_ids)
        if key in planted:
            seen.add(planted[key][0])
    for key in (200, 201):
        (p,) = found[key].passages
        assert (p.start, p.end, p.first, p.similarity) == (0, len(rows[1][1].split()), 1, 1.0)
    assert found[202].n_passages == found[203].n_passages == 0


def test_a_passage_of_several_documents(spark):
    """Two halves of a passage first stand in different documents; together they are long enough."""
    rng = random.Random(13)
    one, two = prose(rng, 25, 10**6), prose(rng, 25, 10**6)
    rows = [(1, prose(rng, 30, 10**6) + " " + one), (2, two + " " + prose(rng, 30, 10**6)), (3, one + " " + two), (4, one)]
    found = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[3].first_ids == [1, 2] and (found[3].n_passages, found[3].n_repeated) == (1, 50)
    assert found[4].n_passages == 0


def test_a_passage_whose_seeds_stand_earlier_elsewhere(spark, monkeypatch):
    """Each word run of the passage first stands in a document of its own, or earlier in the same one."""
    monkeypatch.setattr(passages, "HOT", 2)
    rng = random.Random(14)
    passage = prose(rng, 60, 10**6).split()
    rows = [(i, " ".join([prose(rng, 9, 10**6), *passage[i : i + 7], prose(rng, 9, 10**6)])) for i in range(54)]
    rows += [(key, " ".join([prose(rng, 20, 10**6), *passage, prose(rng, 20, 10**6)])) for key in (60, 61)]
    rows.append((62, rows[-1][1]))
    other = prose(rng, 60, 10**6).split()
    rows.append((70, " ".join([*(w for i in range(0, 54, 6) for w in [*other[i : i + 8], f"x{i}"]), *other])))
    rows.append((71, " ".join([prose(rng, 20, 10**6), *other])))
    found = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert 60 in found[61].first_ids and (found[61].n_passages, found[61].n_repeated) == (1, 60)
    assert any(p["first"] == 60 and (p.start, p.end) == (20, 80) for p in found[61].passages)
    assert {60, 61} <= set(found[62].first_ids) and found[62].n_repeated == 100
    assert any((p["first"], p.start, p.end) == (70, 20, 80) for p in found[71].passages)


def test_matches_of_a_text_are_dealt_out_by_the_other_text():
    """No worker has to hold all matches of a text that shares a seed with many others."""
    entries = np.zeros(300, passages._ENTRY)
    for name, values in (("row", np.arange(300) * 7919), ("least", np.arange(300)), ("most", np.arange(300))):
        entries[name] = values
    batch = pa.RecordBatch.from_arrays([pa.array([entries.tobytes()]), pa.array([b""])], ["own", "others"])
    packs = Counter()
    for part in passages._match(64)(iter([batch])):
        for pack, rows in zip(part["pack"].to_pylist(), part["rows"].to_pylist()):
            packs[pack] += int((np.frombuffer(rows, np.int64) == 299 * 7919).sum())
    assert sum(packs.values()) == 299 and max(packs.values()) < 20


def test_passages_do_not_depend_on_buckets_and_packs(spark, monkeypatch):
    rng = random.Random(12)
    shared = [prose(rng, 30) for _ in range(6)]
    rows = [(i, f"{prose(rng, 40)} {shared[i % 6]} {shared[(i + i // 6) % 6]} {prose(rng, 30)}") for i in range(24)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole = sorted(passages.repeated_passages(frame).collect())
    assert any(r.n_passages for r in whole)
    monkeypatch.setattr(passages, "BUCKET_BYTES", 64)
    monkeypatch.setattr(passages, "PACK", 50)
    assert sorted(passages.repeated_passages(frame).collect()) == whole


@pytest.mark.parametrize("n", [40, 41, 50, 60])
def test_passages_just_similar_enough(spark, n):
    """One word in nine to twelve replaced at random: similarity 0.8 to 0.85, none below it."""
    rng = random.Random(15 + n)
    rows, planted = [], {}
    for key in range(60):
        passage = prose(rng, n, 10**6).split()
        copy, edits = list(passage), n // 9 - (key % 2 if n >= 50 else 0)
        for i in rng.sample(range(1, n - 1), edits):  # the ends agree
            copy[i] = f"edit{rng.randrange(10**6)}"
        for k, w in ((key, passage), (100 + key, copy)):
            rows.append((k, " ".join([prose(rng, 30, 10**6), *w, prose(rng, 30, 10**6)])))
        planted[100 + key] = sum(a == b for a, b in zip(passage, copy)) / (n + edits)
    found = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    lost = [key for key, alike in planted.items() if alike >= 0.8 and (found[key].first_ids != [key - 100] or found[key].n_repeated < 40)]
    assert min(planted.values()) >= 0.8 and not lost


def test_a_passage_of_many_documents_is_not_listed_in_pairs(spark):
    """Each of them is compared with the first ones; texts grow in number, listed passages per text do not."""
    rng = random.Random(17)
    passage = prose(rng, 60, 10**6).split()
    rows = []
    for key in range(120):
        copy = list(passage)
        if key % 4 == 3:
            copy[rng.randrange(60)] = f"edit{key}"
        rows.append((key, " ".join([prose(rng, 20, 10**6), *copy, prose(rng, 20, 10**6)])))
    found = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert found[0].n_passages == 0
    for key in range(1, 120):
        assert found[key].n_passages == 1 and 0 in found[key].first_ids, key
        assert found[key].n_repeated >= (60 if key % 4 < 3 else 59 - 1), key
    assert sum(len(r.passages) for r in found.values()) < 8 * len(rows)


def test_a_passage_of_frequent_phrases(spark):
    """Each phrase first stands in other documents, which many share; only two documents have them all."""
    rng = random.Random(18)
    phrases = [prose(rng, 15, 10**6) for _ in range(4)]
    rows = [(100 * k + i, " ".join([prose(rng, 40, 10**6), phrase, prose(rng, 40, 10**6)])) for k, phrase in enumerate(phrases) for i in range(25)]
    for key in (1000, 1001):
        between = [f"own{key}x{i} own{key}y{i}" for i in range(4)]
        rows.append((key, " ".join([prose(rng, 30, 10**6), *(w for pair in zip(phrases, between) for w in pair), prose(rng, 30, 10**6)])))
    found = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert 1000 in found[1001].first_ids and found[1001].n_repeated >= 60 and found[1000].n_passages == 0


def test_a_stretch_of_runs_whose_seeds_stand_in_many_texts(spark):
    """A passage of 37 words and runs of six and seven beside it are a stretch; the seeds of the runs first stand in other texts, one each."""
    rng = random.Random(19)
    passage, runs = prose(rng, 37, 10**6), [prose(rng, n, 10**6).split() for n in (6, 7)]
    rows = []
    for run in runs:
        parts = [run[i : i + 5] for i in range(len(run) - 4) for _ in range(12)] + [run] * 11
        rows += [(len(rows) + i, " ".join([prose(rng, 20, 10**6), *part, prose(rng, 20, 10**6)])) for i, part in enumerate(parts)]
    rows.append((500, " ".join([prose(rng, 20, 10**6), passage, prose(rng, 20, 10**6)])))
    rows.append((501, " ".join([prose(rng, 20, 10**6), passage, *runs[0], *runs[1], prose(rng, 20, 10**6)])))
    found = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert (found[501].n_passages, found[501].n_repeated) == (1, 50) and 500 in found[501].first_ids
    assert all(found[key].n_passages == 0 for key, _ in rows[:-1])


def test_touching_places_of_a_seed_are_one_entry(spark):
    """A text of one word again and again costs its length, not the square of it."""
    rows = [(k, "again " * n) for k, n in enumerate([300, 3000, 2500, 60])]
    found = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [found[k].n_repeated for k in range(4)] == [0, 3000, 2500, 60]
    one, two = np.zeros(1, passages._ENTRY), np.zeros(1, passages._ENTRY)
    one["more"], one["step"], two["more"], two["step"] = 2999, 1, 299, 1
    assert len(passages._unfolded(one, two)[0]) <= 2 * 3000


def test_chains_are_parted_where_they_differ():
    rng = np.random.default_rng(16)
    one, two = rng.integers(0, 2**32, 45, np.uint32), rng.integers(0, 2**32, 45, np.uint32)
    mine, theirs = (np.concatenate([one, rng.integers(0, 2**32, 25, np.uint32), two]) for _ in range(2))
    x = np.array([*range(41), *range(70, 111)])
    assert sorted(passages.align(x, x, mine, theirs)) == [(0, 45, 0, 45, 1.0), (70, 115, 70, 115, 1.0)]


# Language


def naive_phrases(text, sample, rare):
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample and not rare & set(text[at : at + n + 1]):
            n += 1
        count, at = count + 1, at + n
    return count


def test_phrases_equal_a_plain_parse():
    samples = {"a": b"the cat sat on the mat and the dog ran", "b": b"der hund lief und die katze sass"}
    parser = language_id.CrossParser(samples)
    texts = [b"the dog sat", b"die katze lief", b"zzz the", b"", b"qqq", b"a" * 30, b"z"]
    rates = parser.rates(texts)
    rare = {c for c, n in Counter(b"".join(samples.values())).items() if n < language_id.LEAST_SEEN}
    for text, row in zip(texts, rates):
        for n, name in enumerate(parser.languages):
            phrases = naive_phrases(text, samples[name], rare)
            assert row[n] == pytest.approx(phrases * parser.bits[n] / max(1, len(text)))


def test_languages_of_long_texts_are_learned(spark):
    rows = [(i, "kort og lett " * 5, "no") for i in range(3)] + [(9, "1 " * 9_000 + "ägypten über öfen " * 900, "de"), (10, "12 " * 9_000, "xx")]
    samples = language_id.language_samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(samples) == ["de", "no"] and "über öfen".encode() in samples["de"]
    assert 4_000 < len(samples["de"]) <= 1 << 13
    docs = spark.createDataFrame([(1, "über öfen ägypten"), (2, "lett og kort")], SCHEMA)
    assert {r.doc_id: r.lang_pred for r in language_id.identify_languages(docs, samples).collect()} == {1: "de", 2: "no"}


def test_languages_on_held_out_rows(spark):
    held = QUERIES["op3_language_id"](spark, FOLDER).where("held_out")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = held.join(docs, "doc_id").collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


# Licences


def test_licenses(spark):
    notice = "This program: you can redistribute it and/or modify it under the terms of the GNU General Public License."
    texts = {
        1: "CC-BY and CC BY; all rights reserved. All Rights\nReserved",
        2: notice,
        3: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        4: "cc all rights are reserved by public license general",
        5: "Licensed under the Apache License, Version 2.0.",
        6: "apache version license under licensed 2 0 the the",
        7: "rights " * 400 + "all rights reserved",
    }
    rows = {r.doc_id: r for r in license_scan(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()}
    found = {k: [(p.label, p.start) for p in r.places] for k, r in rows.items()}
    assert sorted(found[1]) == [("cc-by", 0), ("cc-by", 3), ("reserved", 5), ("reserved", 8)]
    assert sorted(found[2]) == [("gpl", 16), ("gpl-notice", 2)]
    assert found[3] == [("mit", 0)] and found[4] == [] and found[5] == [("apache-2.0", 0)] and found[6] == []
    assert found[7] == [("reserved", 400)]
    assert rows[3].score == 1 and rows[4].score == 0


def test_each_template_finds_itself(spark):
    rows = [(i, t.text) for i, t in enumerate(LICENSE_TEMPLATES)]
    found = {r.doc_id: {p.label for p in r.places} for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, template in enumerate(LICENSE_TEMPLATES):
        assert template.label in found[i]


# Mixing


def test_targets_are_shared_out():
    totals = pd.DataFrame({"size": [10, 1000, 1000], "weight": [3.0, 1.0, 2.0]})
    targets = mixing.shared_targets(totals)
    assert targets[0] == 30 and targets.sum() == pytest.approx(2010) and targets[2] == pytest.approx(2 * targets[1])


def test_fit_is_exact_where_it_can_be():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = np.unique(rng.integers(1, 40, 6))
        counts = rng.integers(1, 5, len(sizes))
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {t + k * int(s) for t in sums for k in range(c + 1)}
        budget = int(rng.integers(0, (sizes * counts).sum() + 1))
        taken = mixing.fit_counts(sizes, counts, budget, 1)
        assert ((0 <= taken) & (taken <= counts)).all()
        assert abs((taken * sizes).sum() - budget) == min(abs(t - budget) for t in sums)


def test_fit_of_large_budgets():
    sizes, counts = np.arange(1, 3000), np.full(2999, 50)
    taken = mixing.fit_counts(sizes, counts, 123_456_789, 1)
    assert (taken * sizes).sum() == 123_456_789 and (taken <= counts).all()


def test_fit_of_few_long_documents():
    def taken(sizes, counts, budget):
        return int((mixing.fit_counts(np.array(sizes), np.array(counts), budget, 1) * np.array(sizes)).sum())

    assert taken([200_000], [3], 560_000) == 600_000 and taken([100_000], [1], 90_000) == 100_000
    rng = np.random.default_rng(9)
    for _ in range(40):
        sizes = np.unique(rng.integers(70_000, 900_000, 5))
        counts = rng.integers(1, 4, len(sizes))
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {t + k * int(s) for t in sums for k in range(c + 1)}
        budget = int(rng.integers(0, (sizes * counts).sum() + 1))
        assert abs(taken(sizes, counts, budget) - budget) == min(abs(t - budget) for t in sums)


def test_rests_above_the_table_are_fitted():
    rng = np.random.default_rng(4)
    for low, high, n in ((100_000, 200_000, 3000), (1, 60_000, 5000), (40_000, 900_000, 400)):
        sizes, counts = np.unique(rng.integers(low, high, n), return_counts=True)
        budget = int(0.4 * (sizes * counts).sum())
        for table in (1 << 10, 1 << 16):
            taken = mixing.fit_counts(sizes, counts, budget, 1, table)
            assert ((0 <= taken) & (taken <= counts)).all()
            assert abs((taken * sizes).sum() - budget) <= 1, (low, table)


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 4)
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice([1, 3, 7, 7, 7, 20])), rng.choice(["a", "a", "b", "c", None])) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    one = {r.doc_id: r for r in mixing.mix_sources(frame).collect()}
    assert one == {r.doc_id: r for r in mixing.mix_sources(frame.repartition(2)).collect()}
    total = sum(r["size"] for r in one.values())
    assert sum({r.source: r.target for r in one.values()}.values()) == pytest.approx(total)
    for source in ("a", "b", "c", None):
        own = [r for r in one.values() if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert all(r.taken <= 3 * r["size"] for r in own) and own[0].source_size == sum(r["size"] for r in own)


# Near duplicates


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (200, 7), (300, 301), (301, 300)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {found[i] for i in [*range(41), 200]} == {0} and {found[i] for i in (100, 101, 102)} == {100}
    assert found[301] == 300


def test_links_of_a_large_component_are_joined_once_a_node(spark, monkeypatch):
    """Pairs of blocks each give a link per set, so a component of m sets in k blocks has m * k of them."""
    staged, stage = {}, component_steps.stage

    def noted(table, purpose):
        staged[purpose] = stage(table, purpose)
        return staged[purpose]

    monkeypatch.setattr(component_steps, "stage", noted)
    nodes, blocks = 400, 20
    pairs = [(i, j) for i in range(nodes) for j in range(min(i, blocks))]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == dict.fromkeys(range(nodes), 0)
    assert staged["neighbours"].count() == 2 * (nodes - 1)


@pytest.mark.parametrize("others", [0, 30])
def test_sketches_do_not_decide_on_links(others):
    """Pairs of a set that share 0.8 of their tokens are linked whatever their sketches say."""
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 2**40, 400)).astype(np.uint64)[:390]
    sets = [base[:351], base[39:], *(np.unique(rng.integers(0, 2**40, 351)).astype(np.uint64) for _ in range(others))]
    packed = [np.ascontiguousarray(s[:, None].view(np.uint8)[:, :5]).tobytes() for s in sets]
    frame = pd.DataFrame({"size": [len(s) for s in sets], "tokens": packed, "sketch": [bytes([i]) * 64 for i in range(len(sets))]})
    for left, right in ((frame, None), (frame[:1], frame[1:].reset_index(drop=True))):
        a, b = jaccard_join._verified(left, right, 312 / 390)
        assert list(zip(a, b)) == [(0, 1 if right is None else 0)]


@pytest.mark.parametrize("block", [1024, 8])
def test_links_equal_brute_force(spark, block):
    rng = random.Random(6)
    texts, passage = [], prose(rng, 60)
    for group in range(12):
        base = prose(rng, rng.randrange(3, 150)).split()
        for _ in range(rng.choice([1, 2, 3, 30])):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [passage + " " + prose(rng, 60) for _ in range(80)] + ["one two", "one two", "three", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    rows = {r.doc_id: r for r in near_duplicates(frame, block=block).collect()}
    true = brute.links(texts)
    sets = [brute.shingles(t) for t in texts]
    copies = Counter(s for s in sets if s)
    for i, s in enumerate(sets):
        near = [next(iter(pair - {s})) for pair in true if s in pair]
        assert rows[i].n_link_texts == len(near), i
        assert rows[i].n_links == (copies[s] - 1 if s else 0) + sum(copies[n] for n in near)
        assert rows[i].text_class == (sets.index(s) if s else i)
    label = {s: sets.index(s) for s in copies}
    changed = True
    while changed:
        changed = False
        for a, b in map(tuple, true):
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert all(rows[i].class_id == (label[s] if s else i) for i, s in enumerate(sets))


# Quality


def test_measures(spark):
    rng = random.Random(7)
    line = prose(rng, 12, 50)
    texts = [prose(rng, 40), line + "\n" + line + "\n\n" + line, "a b " * 30, "### | <b> $x%y&z*\n \n\n", prose(rng, 8) + " " + prose(rng, 8), "é à 𝒳"]
    texts.append(" ".join([line, "zz", line, "yy", line[: len(line) // 2]]))
    frame = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for row in quality(frame).collect():
        w = brute.visible(texts[row.doc_id])
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in texts[row.doc_id].split("\n") if brute.visible(x)]
        assert row.n_words == len(w) and row.word_chars == sum(map(len, w))
        assert row.n_symbols == sum(c in "#*$%&|<>" for c in texts[row.doc_id])
        assert row.n_dup_lines == len(lines) - len(set(lines)) and row.n_repeat_words == len(again)
        assert row.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w))


def test_thresholds_follow_the_group(spark):
    rng = random.Random(8)
    plain = [(i, prose(rng, 40), "en", "web") for i in range(200)]
    marked = [(1000 + i, " ".join(x + " |" for x in prose(rng, 40).split()), "en", "tables") for i in range(200)]
    odd = [(5000, marked[0][1], "en", "web"), (5001, plain[0][1], None, None), (5002, marked[0][1], "en", "rare")]
    frame = spark.createDataFrame(plain + marked + odd, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality(frame).collect()}
    assert all(kept[k] for k, *_ in plain + marked)
    assert not kept[5000] and kept[5001]


# Contamination


def test_windows_equal_brute_force(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.choice([0, 1, 3, 7, 10, 11, 30]), 300)) for i in range(40)]
    items += [(100, items[5][1]), (101, "the the the the the the the the the the the"), (102, None)]
    rows = []
    for key in range(150):
        parts = [prose(rng, rng.randrange(30), 300)]
        if key % 3 == 0:
            w = (rng.choice(items)[1] or "").split()
            cut = rng.randrange(3)
            parts.append(" ".join(w[cut : len(w) - rng.randrange(3)]).upper())
        parts.append(prose(rng, rng.randrange(10), 300))
        rows.append((key, ", ".join(parts)))
    rows += [(500, "The, the " * 9), (501, None), (502, items[3][1])]
    found = contamination(
        spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    )
    hits = 0
    for row in found.collect():
        n, covered, names = brute.contaminated(dict(rows)[row.doc_id], items)
        assert (row.n_words, row.n_hit, row["items"]) == (n, len(covered), sorted(names)), row.doc_id
        assert {i for s in row.spans for i in range(s.start, s.end)} == covered
        hits += n > 0 and len(covered) > 0
    assert hits > 20


def test_map_of_shingles_grows_with_them(spark):
    from relaygauge.llm import decontamination as module

    for n in (1, 1000, 200_000):
        hashes = module.mix(np.arange(1, n + 1, dtype=np.uint64))
        index = spark.createDataFrame(pd.DataFrame({"shingle": hashes.view(np.int64)}))
        table = module._map_of(index, "shingle")
        assert module.MAP_ROOM // 2 * n <= 8 * len(table) <= max(1 << module.MAP_BITS[0], 2 * module.MAP_ROOM * n)
        assert module._on_map(table, hashes).all()
        others = module.mix(np.arange(1 << 40, (1 << 40) + 10_000, dtype=np.uint64))
        assert module._on_map(table, others).mean() < 0.01
    empty = module._map_of(spark.createDataFrame([], "shingle long"), "shingle")
    assert not module._on_map(empty, others).any()


def test_threads_do_not_share_staged_tables(spark):
    import threading

    from relaygauge.llm.frames import finished, stage

    ready, results = threading.Barrier(2), {}

    def work(n):
        def inner():
            table = stage(spark.range(n), "thread")
            ready.wait(60)
            return table.selectExpr("id + 1 AS id")

        results[n] = finished(spark, "thread-result", inner).count()

    threads = [threading.Thread(target=work, args=(n,)) for n in (5, 9)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert results == {5: 5, 9: 9}


# Toxicity


def test_misspellings_share_vectors():
    rng = random.Random(10)
    bad = ["wretched", "horrible", "disgusting"]
    texts, labels = [], []
    for i in range(300):
        w = prose(rng, rng.randrange(20, 120), 500).split()
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w).encode())
        labels.append(i % 4 == 0)
    model = toxicity.fit(texts, np.array(labels), np.ones(300))
    unseen = [b"w1 w2 w3 disgustingg w9 w10", b"w4 w5 horribble w7", b"w1 w2 w3 w4 w5 w6", b"w8 w90 w33", b"", b"..."]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in unseen])])
    scores = model.scores(toxicity.Bags(np.frombuffer(b"".join(unseen), np.uint8), offsets), len(unseen))
    assert (scores[:2] > 0.5).all() and (scores[2:] < 0.5).all()


def test_toxicity_on_held_out_rows(spark):
    scored = QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = scored.where("held_out").join(docs, "doc_id").collect()
    marked = [r for r in rows if "idiot" in r.text.lower() or "trash" in r.text.lower()]
    assert marked and np.mean([r.predicted for r in marked]) > 0.8
    assert np.mean([r.predicted for r in rows]) < 0.3


# Token counts


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path = public_tokenizers.path(name)
    texts = ["It's 12,345 <|endoftext|> ok", "a b c\x1cd\x85e", "x" * 3000, "Ça  VA\r\n\r\n bien?", "\U0001f600 <|startoftext|>x", " ", "ΑΣ ΟΔΟΣ", "é ́a", "'s 't don't"]
    texts += ["|||" * 40, "a​b", "﻿hi"]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        encode = lambda t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids)
    else:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        encode = lambda t: len(model.encode(t))
    rows = token_counts(spark.createDataFrame([*enumerate(texts), (99, None)], SCHEMA), path).collect()
    for row in rows:
        text = dict(enumerate(texts)).get(row.doc_id, "")
        assert (row.n_bytes, row.n_tokens) == (len(text.encode()), encode(text)), text
        assert row.over_limit == (row.n_tokens > 2048)


def test_only_short_pieces_are_remembered(monkeypatch):
    from relaygauge.llm import token_counts as module

    encoder = module.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["語" * (40 + i) + " ab" + "x" * (i % 50) for i in range(200)]
    expected = encoder.encode(texts)
    assert encoder.lengths(texts) == expected
    assert max(map(len, encoder._known)) <= module.KNOWN_LETTERS
    monkeypatch.setattr(module, "KNOWN_BYTES", 1000)
    for _ in range(3):
        assert encoder.lengths(texts) == expected
    held = encoder._held
    assert encoder.lengths(["ab"]) == encoder.encode(["ab"]) and len(encoder._known) == 1 and encoder._held < held


# Pipeline


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert 0 < len(rows) < len(given) and len({r.doc_id for r in rows}) == len(rows)
    for row in rows:
        assert not brute.contaminated(row.text, items)[1]
        assert row.taken == row.copies * len(brute.visible(row.text)) and row.copies > 0
        assert row.n_chars == len(row.text)
    assert not brute.links([given[r.doc_id] for r in rows])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "suffix_dedup", "decontamination", "source_mix"]


@pytest.mark.parametrize("size", [1, 3, 50, 1000])
def test_buckets_are_settled_however_batches_cut_them(size):
    rng = random.Random(size)
    sets = {1: 1, 2: 2, 3: 4, 4: 5, 5: 40, 6: 3}
    rows = sorted((b, s, -s) for b, n in sets.items() for s in range(n) for _ in range(rng.choice([1, 3])))
    names = ["bucket", "hi", "lo", "crowded"]

    def batches(marked):
        table = [(*r, r[0] in marked and r[1] == 0) for r in rows]
        for i in range(0, len(table), size):
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in table[i : i + size]])

    def settled(last, marked=()):
        out = [r for batch in jaccard_join._meetings(4, last)(batches(marked)) for r in batch.to_pylist()]
        return {kind: sorted({(r["bucket"], r["hi"], r["to_hi"]) for r in out if r["kind"] == kind}) for kind in range(3)}

    small = [(b, s, s) for b in (2, 3, 6) for s in range(sets[b])]
    found = settled(False)
    assert found[jaccard_join._COMPARE] == small and [b for b, *_ in found[jaccard_join._SPLIT]] == [4, 5] and not found[jaccard_join._JOIN]
    found = settled(True)
    assert found[jaccard_join._COMPARE] == small and not found[jaccard_join._SPLIT]
    assert found[jaccard_join._JOIN] == [(b, s, 0) for b in (4, 5) for s in range(1, sets[b])]
    found = settled(False, marked={2})
    assert found[jaccard_join._COMPARE] == small[2:] and [b for b, *_ in found[jaccard_join._SPLIT]] == [2, 4, 5]


def test_wanted_rows_pass_the_bitmaps(spark):
    rows = [0, 1, 7, 8, 32767, 32768, 32769, (3 << 40), (3 << 40) + 1, (3 << 40) + 40000]
    sets = spark.createDataFrame([(r, str(r)) for r in rows], "row long, tokens string")
    for wanted in (rows[::2], rows[1::2], rows, []):
        nodes = spark.createDataFrame([(r,) for r in wanted], "node long")
        assert sorted(r.row for r in jaccard_join._of_rows(sets, nodes).collect()) == wanted
    assert jaccard_join._of_rows(sets, nodes.unionAll(sets.select("row")), most=0).count() == len(rows)


def test_keys_of_rows_are_128_bits(spark):
    rows = [(1, "a"), (1, None), (1, ""), (None, "1:a"), (None, None), (None, ""), (11, "a"), (1, "1:a"), (1, "a")]
    keys = [bytes(r._row) for r in corpus_pipeline._own(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(set(keys)) == len(rows) - 1 and keys[0] == keys[-1] and {len(k) for k in keys} == {16}
