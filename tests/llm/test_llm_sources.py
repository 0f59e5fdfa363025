"""The transducer and the audit of sources against plain models, odd rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from relaygauge.llm import source_audit
from relaygauge.llm.source_audit import source_divergence
from relaygauge.llm.transducer import Transducer

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def looked_up(transducer, words):
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return transducer.ordinals(data, ends - [len(w) for w in words], ends).tolist()


@settings(max_examples=150, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=60), st.lists(st.binary(min_size=1, max_size=7), max_size=30))
def test_transducer(terms, others):
    ordered = sorted(terms)
    transducer = Transducer.from_bytes(Transducer.build(ordered).to_bytes())
    words = ordered + others
    assert looked_up(transducer, words) == [ordered.index(w) if w in terms else -1 for w in words] if words else True
    assert [transducer.term(i) for i in range(len(ordered))] == ordered
    # Minimal: a state for each distinct set of ends.
    prefixes = {t[:i] for t in ordered for i in range(len(t) + 1)} | {b""}
    assert len(transducer.final) == len({frozenset(t[len(p) :] for t in ordered if t.startswith(p)) for p in prefixes})


def test_transducer_shares_ends_and_refuses_disorder():
    assert len(Transducer.build([b"sings", b"sting", b"stings", b"string", b"strings"]).final) < 15
    with pytest.raises(ValueError):
        Transducer.build([b"b", b"a"])
    with pytest.raises(ValueError):
        Transducer.build([b"a", b"a"])


def test_long_terms():
    long = b"\xe3\x81\x82" * 20_000
    transducer = Transducer.build([b"a", long])
    assert looked_up(transducer, [long, b"a", long[:-1], b""]) == [1, 0, -1, -1]


def model(rows, least_docs=3, ranks=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    having = Counter((lang, t) for lang, _, terms in docs for t in set(terms))
    counts, groups = defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        groups[lang].add(source)
        counts[lang, source].update(t for t in terms if having[lang, t] >= least_docs)
    out = []
    for lang, sources in groups.items():
        kept = sorted({t for (its, t), n in having.items() if its == lang and n >= least_docs}, key=str.encode)
        v = len(kept)

        def shares(count):
            total = sum(count.values())
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // (total + v) for t in kept}

        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string")


def drawn(seed, n=400):
    draw = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("", "x", "é", "ness", "日本")]
    rows = []
    for i in range(n):
        lang = ["en", "de", "fr"][int(draw.integers(0, 3))]
        # A third of all rows have one source.
        source = "hot" if i % 3 == 0 else f"s{int(draw.integers(0, 5))}"
        some = draw.choice(words, int(draw.integers(0, 40)), p=(w := draw.random(len(words)) ** 3) / w.sum())
        rows.append((lang, source, ", ".join(x.upper() if draw.random() < 0.3 else x for x in some) + str(i)))
    return rows


def test_equal_to_the_model(spark):
    rows = drawn(3)
    found = source_divergence(frame_of(spark, rows).repartition(5))
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == model(rows)


def test_other_parameters(spark):
    rows = drawn(4, 120)
    assert sorted(map(tuple, source_divergence(frame_of(spark, rows), least_docs=9, ranks=4).collect())) == model(rows, 9, 4)


def test_odd_rows(spark):
    sentence = "The quick brown fox"
    rows = [
        (None, None, None),
        (None, "", sentence),
        ("", None, sentence),
        ("", "a", sentence + " Fox FOX É é"),
        ("", "a", ""),
        ("en", "a", "1 2 3 !!"),
        ("en", "b", None),
        ("de", "a", "zwei"),
        ("fr", "a", sentence),
        ("fr", "a", sentence),
        ("fr", "a", sentence),
        ("fr", "b", "x" * 100_000 + "\x00\x1c\U0001f600"),
        ("fr", "b", "x" * 100_000),
        ("fr", "c", "x" * 100_000 + " [\\]^_` {|}~ fox"),
    ]
    frame = frame_of(spark, rows).selectExpr("*", "'c' AS term", "1 AS value", "1 AS rank", "'c' AS _text", "1 AS block")
    assert sorted(map(tuple, source_divergence(frame).collect())) == model(rows)
    assert source_divergence(frame.limit(0)).collect() == []
    assert sorted(map(tuple, source_divergence(frame.where("lang = 'en'")).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_counts_are_handed_on_in_pieces(monkeypatch):
    monkeypatch.setattr(source_audit, "HELD_TERMS", 5)
    rows = [(("en", f"s{i % 2}"), [b"a", b"b", b"%d" % i], 3) for i in range(20)]
    pieces = list(source_audit._counted(iter(rows)))
    assert len(pieces) > 3 and all(sum(map(len, p.values())) <= 8 for p in pieces)
    total = defaultdict(Counter)
    for piece in pieces:
        for group, counts in piece.items():
            total[group].update(counts)
    assert total["en", "s0"][b"a"] == total["en", "s1"][b"a"] == 10


def test_blocks_are_cut_by_terms_bytes_and_language(monkeypatch):
    monkeypatch.setattr(source_audit, "BLOCK_TERMS", 3)
    monkeypatch.setattr(source_audit, "BLOCK_BYTES", 8)
    terms = [("de", b"a"), ("de", b"b"), ("en", b"a"), ("en", b"b"), ("en", b"c"), ("en", b"d"), ("en", b"e" * 20), ("en", b"f")]
    batches = [pa.RecordBatch.from_pylist([{"lang": l, "term": t} for l, t in terms[i : i + 2]]) for i in range(0, len(terms), 2)]
    built = [r for b in source_audit._built(iter(batches)) for r in b.to_pylist()]
    assert [(r["lang"], r["first"], r["terms"]) for r in built] == [
        ("de", b"a", 2),
        ("en", b"a", 3),
        ("en", b"d", 1),
        ("en", b"e" * 20, 1),
        ("en", b"f", 1),
    ]
