"""SimHash, window, suffix and winnowing operators against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from dosequant.llm import components, simhash, sketch, suffix_dedup, window_dedup, winnowing
from dosequant.operators import skew

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def prose(seed, n, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}é" if rng.random() < 0.1 else f"w{rng.randrange(words)}" for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, repeats, odd and long texts."""
    base, passage = prose(1, 300), prose(2, 60)
    rows = [(10, base), (11, base), (3, base.replace("w7 ", "other ")), (12, base.upper())]
    rows += [(20 + i, f"{prose(50 + i, 40 + i)}\n{passage}\t{prose(90 + i, 30)}") for i in range(5)]
    rows += [(30, "Der " * 500), (31, "ab" * 700), (32, "x" * 199), (33, "x" * 200), (34, "é" * 150)]
    rows += [(40, None), (41, ""), (42, " \n\t "), (43, "one"), (44, "One two three"), (45, "one TWO three")]
    rows += [(50, prose(7, 20_000, 5000)), (None, base), (None, "no id here"), (60, passage), (60, passage)]
    rows += [(70, " ".join(f"u{i}" for i in range(13))), (71, " ".join(f"u{i}" for i in range(12)))]
    return rows


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def slow_fingerprint(text):
    words = WORDS.findall(ascii_lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(fps, distance=4):
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return group


def test_near_duplicates(spark, documents, clashing):
    rows = corpus()
    fps = [slow_fingerprint(t) for _, t in rows]
    groups = slow_groups(fps)
    least = {}
    for (i, _), g in zip(rows, groups):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    expected = sorted((str(i), f"{f:016x}", least.get(g)) for (i, _), f, g in zip(rows, fps, groups))
    found = simhash.near_duplicates(clashing(documents(*rows)))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found.collect()) == expected
    assert simhash.near_duplicates(documents(*rows).where("false")).collect() == []


def test_links_of_random_and_close_fingerprints(spark, monkeypatch):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for f in list(fps)[:40]:
        g = f
        for _ in range(6):  # chains of links, each within reach of the one before
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                g ^= 1 << b
            fps.add(g)
    for b in range(64):  # one dense ball
        fps.update(((1 << b) | (1 << rng.randrange(64)), 1 << b))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    group = dict(zip(signed, slow_groups(fps)))
    expected = collections.Counter(collections.Counter(group.values()).values())
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for slab in (simhash.SLAB, 20):  # with and without buckets cut into slabs
        monkeypatch.setattr(simhash, "SLAB", slab)
        links = simhash.fingerprint_links(df)
        assert all(group[r.u] == group[r.v] for r in links.collect())  # a forest, not all pairs
        roots = {r.node: r.root for r in components.components(links).collect()}
        found = collections.Counter(roots.get(f, f) for f in signed)
        assert collections.Counter(found.values()) == expected


def test_pivots_discard_no_close_pair():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    close = fps ^ (np.uint64(1) << rng.integers(0, 63, 500).astype(np.uint64))
    both = np.concatenate((fps, close))
    a, b = np.arange(500), np.arange(500, 1000)
    found = simhash.close_pairs(both, simhash.pivot_table(both), a, b, 4)
    assert len(found[0]) == 500


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    found = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in found} == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 60)}


def slow_windows(rows, size=13):
    first = {}
    for i, text in rows:
        words = WORDS.findall(text or "")
        for k in range(len(words) - size + 1):
            key = tuple(words[k : k + size])
            first[key] = min(first.get(key, 1 << 70), 1 << 69 if i is None else i)
    out = []
    for i, text in rows:
        words, gone = WORDS.findall(text or ""), set()
        for k in range(len(words) - size + 1):
            if first[tuple(words[k : k + size])] < (1 << 69 if i is None else i):
                gone.update(range(k, k + size))
        out.append((str(i), len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("often", [sketch.OFTEN, 2])
def test_repeated_windows(spark, documents, clashing, monkeypatch, often):
    monkeypatch.setattr(sketch, "OFTEN", often)
    rows = corpus()
    df = clashing(documents(*rows)).repartition(3, "doc_id")
    found = window_dedup.remove_repeated_windows(df)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in found.collect()) == slow_windows(rows)
    assert found.select("route", "lang").first().route == "x"
    assert window_dedup.remove_repeated_windows(documents((1, "a")).where("false")).collect() == []


def slow_bytes(rows, size=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[k : k + size] for _, b in texts for k in range(len(b) - size + 1))
    out = []
    for i, b in texts:
        gone = set()
        for k in range(len(b) - size + 1):
            if count[b[k : k + size]] > 1:
                gone.update(range(k, k + size))
        spans = sum(1 for k in gone if k - 1 not in gone)
        out.append((str(i), len(b), len(gone), spans, bytes(c for k, c in enumerate(b) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("often, held", [(sketch.OFTEN, suffix_dedup.HELD_BYTES), (2, 1 << 12)])
def test_repeated_bytes(spark, documents, clashing, monkeypatch, often, held):
    monkeypatch.setattr(sketch, "OFTEN", often)
    monkeypatch.setattr(suffix_dedup, "HELD_BYTES", held)
    rows = corpus()
    df = clashing(documents(*rows)).repartition(3, "doc_id")
    found = suffix_dedup.remove_repeated_bytes(df).collect()
    got = sorted(
        (str(r.doc_id), r.n_bytes, sum(x["to"] - x["from"] for x in r.removed), len(r.removed), bytes(r.kept_bytes))
        for r in found
    )
    assert got == slow_bytes(rows)
    assert suffix_dedup.remove_repeated_bytes(documents((1, "a")).where("false")).collect() == []


def test_a_frequent_line_too_short_to_go_meets_in_no_single_route(spark, documents):
    line, passage = prose(3, 60)[:150], prose(4, 80)[:260]
    rows = [(i, f"{prose(9000 + i, 50, 4000)}\n{line}\n{prose(19000 + i, 50, 4000)}") for i in range(900)]
    rows += [(990, rows[0][1])] + [(1000 + i, f"{prose(2000 + i, 20, 4000)}\n{passage}") for i in range(220)]
    df = documents(*rows).selectExpr("doc_id AS row", "text").coalesce(1)

    def keys(batches):
        for _, texts in suffix_dedup.W.chunks(batches, "text"):
            yield suffix_dedup.Segments(texts, 200, 32).occurrences()

    get = sketch.estimate(df.select("text"), keys)

    def strings(batches):
        for _, texts in suffix_dedup.W.chunks(batches, "text"):
            found = suffix_dedup.Segments(texts, 200, 32)
            yield found.frequent(get().frequent(found.key))[2]

    get_strings = sketch.estimate(df.select("text"), strings, cell_bits=23)
    sent = df.mapInArrow(suffix_dedup._candidates(200, 32, get, get_strings), suffix_dedup._ROUTED).collect()
    starts = collections.Counter()
    for r in sent:
        starts[r.route] += r.n if r.kind == suffix_dedup._SEGMENT else 1
    assert max(starts.values()) < sketch.OFTEN * (200 - 32 + 1)
    fragments = [r for r in sent if r.kind == suffix_dedup._FRAGMENT]
    assert 0 < len(fragments) < len({r.row for r in sent}) and sum(r.n for r in fragments) > 3 * len(fragments)
    found = suffix_dedup.remove_repeated_bytes(documents(*rows).repartition(3, "doc_id")).collect()
    got = sorted((str(r.doc_id), sum(x["to"] - x["from"] for x in r.removed), bytes(r.kept_bytes)) for r in found)
    assert got == [(r[0], r[2], r[4]) for r in slow_bytes(rows)]


@pytest.mark.parametrize("held", [suffix_dedup.HELD_BYTES, 1 << 12])
def test_fragments_that_share_a_part(spark, documents, monkeypatch, held):
    """Parts of one passage, of any length, in many documents and within one: all are
    frequent, and what differs as a whole still meets string by string."""
    monkeypatch.setattr(sketch, "OFTEN", 3)
    monkeypatch.setattr(suffix_dedup, "HELD_BYTES", held)
    monkeypatch.setattr(suffix_dedup, "LONGEST", 16)
    rng = random.Random(6)
    passage = prose(4, 400)[:1500]
    rows = []
    for i in range(60):
        a, b = sorted(rng.sample(range(len(passage)), 2))
        rows.append((i, f"{prose(700 + i, 20, 9000)} {passage[a:b]} {prose(800 + i, 9, 9000)}" + passage[a : a + 260] * (i % 3)))
    rows += [(70, "ab" * 400), (71, "abc" * 300), (72, "ab" * 400 + "c"), (73, passage), (74, passage), (74, passage)]
    df = documents(*rows).repartition(5, "doc_id")
    found = suffix_dedup.remove_repeated_bytes(df).collect()
    got = sorted((str(r.doc_id), sum(x["to"] - x["from"] for x in r.removed), bytes(r.kept_bytes)) for r in found)
    assert got == [(r[0], r[2], r[4]) for r in slow_bytes(rows)]


def test_cut_characters_go_as_a_whole(spark, documents):
    shared = "é" * 100
    found = suffix_dedup.remove_repeated_bytes(documents((1, "xà" + shared), (2, "yé" + shared + "z")), as_text=True)
    kept = {r.doc_id: r.kept_text for r in found.collect()}
    assert kept == {1: "xà", 2: "yz"}  # in the second text 202 bytes are two-byte letters


def test_buckets_are_refined_to_equal_strings():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[:400]
    starts = np.arange(len(data) - 39)
    final, many = suffix_dedup.equal_strings(np.zeros(len(starts), np.uint64), data, starts, 40)
    text = data.tobytes()
    count = collections.Counter(text[s : s + 40] for s in starts)
    assert [count[text[s : s + 40]] for s in starts] == many.tolist()
    assert len(set(final.tolist())) == len(count)


def test_sketch_never_counts_too_low(spark):
    keys = np.random.default_rng(2).integers(0, 1 << 40, 5000).astype(np.uint64)
    keys[:700] = keys[700:1400]

    def make(batches):
        for batch in batches:
            yield batch.column(0).to_numpy().view(np.uint64)

    df = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(4)
    found = sketch.estimate(df, make, cell_bits=18)()
    assert found.repeated(keys[:1400]).all()
    assert found.repeated(keys[1400:]).mean() < 0.1


def slow_shared(rows, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or "")) if w]
    windows = collections.defaultdict(set)
    for i, text in items:
        words = split(text)
        size = min(10, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[k : k + size])].add(i)
    out = []
    for i, text in rows:
        words, hit, found = split(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if ids := windows.get(tuple(words[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= ids
        out.append((str(i), len(words), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def test_shared_passages(spark, documents, clashing):
    rows = corpus() + [(80, "It's: w1, x--two! Three"), (81, "Été one"), (82, " ".join(["aa bb cc"] * 10))]
    passage = prose(2, 60).split()
    items = [(1, " ".join(passage[5:30])), (2, "x two three"), (3, ""), (4, None), (5, "one"), (10, "one"),
             (None, "w1"), (7, " ".join(["aa bb cc"] * 5)), (7, " ".join(passage[40:52]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = winnowing.shared_passages(clashing(documents(*rows)), clashing(benchmark))
    got = sorted(((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=str)
    assert got == slow_shared(rows, items)
    spans = {r.doc_id: [tuple(x) for x in r.spans] for r in found.collect()}
    assert spans[82] == [(0, 30)]
    assert winnowing.shared_passages(documents((1, "a")).where("false"), benchmark).collect() == []
    nothing = winnowing.shared_passages(documents((1, "a b")), benchmark.where("false")).first()
    assert (nothing.n_words, nothing.n_hit, nothing["items"]) == (2, 0, [])


def test_fingerprints_are_fewer_than_windows_and_lose_none(spark, documents, monkeypatch):
    """Random texts over few words: all windows that two share, from fewer rows."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randrange(80)))) for i in range(60)]
    items = [(100 + i, " ".join(rng.choices("abc", k=rng.randrange(1, 40)))) for i in range(25)]
    items += [(200 + i, rng.choice("abcd")) for i in range(30)]  # one-word items, many alike
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    sent = []
    extended = winnowing._extended
    monkeypatch.setattr(winnowing, "join_apart", lambda left, right, key, step: sent.append((left.count(), right.count())) or skew.join_apart(left, right, key, step))
    found = winnowing.shared_passages(documents(*rows), benchmark)
    got = sorted(((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=str)
    assert got == slow_shared(rows, items) and extended is winnowing._extended
    windows = sum(max(0, len(t.split()) - n + 1) for _, t in rows for n in {min(10, len(t.split())) for _, t in items})
    assert sent[0][0] < 0.7 * windows
    assert sent[0][1] < sum(max(1, len(t.split()) - 9) for _, t in items)
    # a word of thirty items is one row per document and place
    assert max(collections.Counter(r["items"][0] for r in found.collect() if r["items"]).values()) <= len(rows)


def test_first_least():
    values = np.array([5, 3, 3, 9, 1, 1, 7, 2], np.uint64)
    for size in range(1, 8):
        expected = [i + int(np.argmin(values[i : i + size])) for i in range(len(values))]
        assert winnowing._first_least(values, size).tolist() == expected
