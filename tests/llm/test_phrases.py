"""Phrase collocations against a count of everything."""

import collections
import random
import re

import numpy as np
import pytest

from dosequant.llm import bitset, collocations

DOCUMENTS = "doc_id long, text string, lang string"


def slow(rows, least, top, longest=5):
    """All phrases, cut everywhere, and compared with all longer ones."""
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(words[i : i + size] for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        covered = collections.Counter()
        for w, a in candidates.items():
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    covered[w[i : i + size]] = max(covered[w[i : i + size]], a)
        scored = []
        for w, a in candidates.items():
            if covered[w] >= a:
                continue
            cuts = [(1000 * a * totals[lang] // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def zipf_text(rng, n, words=60, marks=" "):
    return "".join(f"{'W' if rng.random() < 0.2 else 'w'}{int(words * rng.random() ** 3)}{rng.choice(marks)}" for _ in range(n))


def corpus():
    rng = random.Random(3)
    rows = [(i, zipf_text(rng, 120, marks="     \t\n,;"), "en") for i in range(60)]
    rows += [(100 + i, zipf_text(rng, 80, 30), "de") for i in range(20)]
    rows += [(200, "a a a a a a a. a a b a a b", None), (201, "a a a a", None), (201, "a a a a", "und")]
    rows += [(300, None, "en"), (301, "", "en"), (302, " .,;\n\t ", "xx"), (303, "alone", "xx"), (304, "x y " * 8000, "yy")]
    rows += [(400 + i, f"rare{i % 3} pair{i % 3} é{i % 2}\x0bñ \x0c z", "fr") for i in range(30)]
    return rows


@pytest.mark.parametrize("least,top,first", [(3, 15, 2), (5, 2000, 8), (2, 4, 1)])
def test_collocations(spark, clashing, least, top, first):
    rows = corpus()
    found = collocations.collocations(clashing(spark.createDataFrame(rows, DOCUMENTS)), least=least, top=top, first=first)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == slow(rows, least, top)


def test_growth_stops_when_no_further_phrase_can_reach_the_best(spark):
    """Frequent words are left alone once what they promise is below the last score."""
    rng = random.Random(4)
    rows = [(i, f"u{i % 5} v{i % 5}, " + zipf_text(rng, 400, 6), "en") for i in range(40)]
    texts = spark.createDataFrame(rows, DOCUMENTS)
    extended = []
    whole = collocations.extensions

    def counted(texts, size, prefixes, words, least):
        found = whole(texts, size, prefixes, words, least)
        extended.extend(r["phrase"] for r in found.collect())
        return found

    collocations.extensions = counted
    try:
        found = collocations.collocations(texts, least=4, top=5, first=3)
        assert sorted(map(tuple, found.collect())) == slow(rows, 4, 5)
    finally:
        collocations.extensions = whole
    assert {p.split()[0] for p in extended} == {f"u{i}" for i in range(5)}


def test_scores_beyond_64_bits(spark):
    score = spark.range(1).selectExpr("9000000000000 a", "9000000000007 n", "9000000000001 l", "9000000000003 r")
    found = score.selectExpr(f"{collocations._SCORE} AS score").first()[0]
    assert found == 1000 * 9000000000000 * 9000000000007 // (9000000000001 * 9000000000003)


def test_no_phrases(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert collocations.collocations(empty).collect() == []
    few = spark.createDataFrame([(1, "one two three", "en"), (2, None, None)], DOCUMENTS)
    assert collocations.collocations(few).collect() == []


def test_bits_never_miss(spark, monkeypatch):
    rng = np.random.default_rng(1)
    members = spark.createDataFrame([(int(x),) for x in rng.integers(-(1 << 62), 1 << 62, 5000)], "h long")
    hashes = np.array([r.h for r in members.collect()]).view(np.uint64)
    read = lambda batches: (b.column(0).to_numpy().view(np.uint64) for b in batches)
    get = bitset.bits_of(members, read, ["h"], 5000)
    other = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
    assert get().has(hashes).all() and get().has(other).mean() < 0.05
    monkeypatch.setattr(bitset, "MOST_BITS", 1 << 15)  # far too small
    assert bitset.bits_of(members, read, ["h"], 5000)().has(hashes).all()
