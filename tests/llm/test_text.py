"""Classifiers, rules, extraction and coding against plain versions."""

import itertools
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from dosequant.llm import (
    html_text,
    labelled,
    link_trust,
    quality_rules,
    queries,
    rule_ensemble,
    toxicity,
    unigram,
    words,
)

SMALL = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "The cat. " * 3000), (6, "é" * 20_000), (7, "a b\na b\na b"),
       (7, "a b\na b\na b"), (None, "x y z"), (8, "#*$%&|<> !? A1")]


def plain_counts(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = list(zip(found, found[1:], found[2:]))
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(windows) < 500 else None
    return (len(found), sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered) if covered is not None else None)


def test_quality_rules(spark, documents, clashing):
    df = clashing(documents(*ODD))
    found = quality_rules.judge_quality(df).collect()
    expected = sorted((str(i), *plain_counts(t)) for i, t in ODD)
    got = sorted((str(r.doc_id), r["figures"].n_words, r["figures"].word_chars, r["figures"].n_symbols,
                  r["figures"].n_dup_lines, r["figures"].n_repeat_words) for r in found)
    for a, b in zip(got, expected):
        assert a[:5] == b[:5] and (b[5] is None or a[5] == b[5])
    assert {r.doc_id: r.base_failed for r in found}[5] is True  # nearly all repeats
    assert all(r["_text"] == "x" and r.row == "x" for r in found)
    assert quality_rules.judge_quality(df.where("false")).collect() == []


def test_each_rule_decides(spark, documents):
    rng = random.Random(1)
    good = " ".join(f"the w{rng.randrange(10**6)}" for _ in range(60))
    bad = {"symbol_ratio": good.replace(" ", "** "), "upper_ratio": good.upper().replace("W", "WXYZ"),
           "mark_ratio": good.replace(" ", "! "), "stop_ratio": good.replace("the", "zzz"),
           "mean_word_chars": " ".join(f"the {rng.randrange(10**60)}" for _ in range(60)),
           "dup_line_ratio": "\n".join([good] + ["x q"] * 9)}
    rows = [(0, good)] + list(enumerate(bad.values(), 1))
    found = {r.doc_id: r for r in quality_rules.judge_quality(documents(*rows)).collect()}
    assert found[0].kept and found[0].broken == []
    for i, name in enumerate(bad, 1):
        assert name in found[i].broken and not found[i].kept, name
    none = quality_rules.judge_quality(documents((1, good.upper())), rules=()).first()
    assert none.kept and none.broken == []


def test_rule_paths_and_their_sql(spark):
    """The paths of a fitted tree: all rows that reach a node, and no others, keep its bounds."""
    rng = random.Random(1)
    n = len(rule_ensemble.STATISTICS)
    rows = [[rng.randrange(8) / 4 for _ in range(n)] for _ in range(300)]
    data = spark.createDataFrame([(float(r[0] > 1 and r[2] <= 0.75 or r[1] > 1.5), r) for r in rows], "label double, x array<double>")
    vectors = data.select("label", array_to_vector("x").alias("features"))
    tree = DecisionTreeClassifier(maxDepth=3, seed=1).fit(vectors)
    paths = rule_ensemble.tree_paths(tree._call_java("rootNode"))
    assert len(paths) == tree.numNodes - 1 and len(set(paths)) == len(paths)
    inside = lambda r, path: all(low < r[f] <= high for f, low, high in path)
    leaves = [p for p in paths if not any(q != p and len(paths) > 1 and all(inside(r, p) for r in rows if inside(r, q)) and any(inside(r, q) for r in rows) for q in paths)]
    for r in rows:
        assert sum(inside(r, p) for p in leaves) == 1
    stats = F.struct(*[F.get("x", F.lit(i)).alias(name) for i, name in enumerate(rule_ensemble.STATISTICS)])
    fired = data.select("x", stats.alias("_stats")).select("x", *[F.expr(rule_ensemble.rule_sql(p)).alias(f"p{i}") for i, p in enumerate(paths)])
    for row in fired.collect():
        assert [row[f"p{i}"] for i in range(len(paths))] == [inside(row.x, p) for p in paths]
    assert rule_ensemble.rule_sql(((0, 1.5, 9.0),)) == "_stats.n_words > 1.5D AND _stats.n_words <= 9.0D"


def plain_quality(model, stats):
    """The sum of the weights of the rules that hold."""
    total = model.intercept + sum(w for rule, w in model.rules if all(low < stats[f] <= high for f, low, high in rule))
    return 1 / (1 + math.exp(-total))


def labelled_corpus(documents, spark, n=240):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        text = " ".join(f"the w{rng.randrange(300)}" for _ in range(rng.randrange(20, 60)))
        bad, toxic = i % 4 == 0, i % 5 == 0
        if bad:
            text = text.replace(" ", "*** ")
        if toxic:
            text += " you " + rng.choice(["vilest", "vilely", "vileness", "V1LE", "vіleperson"])
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return documents(*rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_rows(spark, documents, clashing):
    docs, labels = labelled_corpus(documents, spark)
    training = labelled.training_rows(docs, labels, "quality")
    held_out = labelled.is_held_out(F.col("doc_id"))
    assert training.where(held_out).count() == 0
    assert labelled.training_rows(docs, labels, "quality", max_rows=10).count() == 10
    model = rule_ensemble.fit(training)
    assert model.rules
    found = rule_ensemble.score_quality(clashing(docs), model).join(labels, "doc_id").where(held_out)
    assert found.where("predicted <> quality").count() == 0
    scored = {r.doc_id: r.score for r in rule_ensemble.score_quality(docs, model).collect()}
    for r in rule_ensemble.statistics(docs).select("doc_id", "_stats").collect():
        assert scored[r.doc_id] == pytest.approx(plain_quality(model, r["_stats"]))
    lexicon = toxicity.fit(labelled.training_rows(docs, labels, "toxic"))
    assert " vile" in dict(lexicon.entries)
    scored = toxicity.score_toxicity(clashing(docs), lexicon)
    own = ("score", "predicted", "n_hits", "n_words")
    assert set(scored.columns) == {*clashing(docs).columns, *own} - {"text"}
    assert scored.select("weight", "row", "_text").distinct().collect() == [("x", "x", "x")]
    found = scored.join(labels, "doc_id").where(held_out)
    assert found.where("predicted <> toxic").count() == 0
    repeated = docs.unionByName(docs.where("doc_id < 20")).unionByName(docs.where("doc_id < 20").withColumn("text", F.lit("zzz")))
    assert labelled.training_rows(repeated, labels, "quality").count() == training.count()
    for scored in (rule_ensemble.score_quality(documents(*ODD), model), toxicity.score_toxicity(documents(*ODD), lexicon)):
        rows = scored.collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert scored.where("false").collect() == []


def plain_score(lexicon, text):
    """Each word looked up, and exceptions searched, one by one."""
    folded = " ".join(["", *toxicity.fold(text).split(), ""]) if text else ""
    gone = {i + k for e in lexicon.exceptions for i in range(len(folded)) if folded.startswith(e, i) for k in range(len(e) - 1)}
    total = 0.0
    for i, c in enumerate(folded[:-1]):
        if c == " " and i not in gone:
            total += max((w for e, w in lexicon.entries if folded.startswith(e, i)), default=0.0)
    x0, x1 = math.log1p(total), math.log1p(total * 1000 / (len(text.split() if text else []) + 50))
    return 1 / (1 + math.exp(-(lexicon.intercept + lexicon.slopes[0] * x0 + lexicon.slopes[1] * x1)))


def test_toxicity_word_by_word(spark, documents):
    rng = random.Random(5)
    entries = tuple({f" {''.join(rng.choices('abc', k=rng.randrange(1, 6)))}{rng.choice(('', ' '))}": rng.random() * 3 + 0.1 for _ in range(60)}.items())
    exceptions = tuple(f" {''.join(rng.choices('abc', k=2))} {''.join(rng.choices('abc', k=2))} " for _ in range(15))
    lexicon = toxicity.Lexicon(entries, exceptions, -2.0, (0.7, 0.3))
    rows = ODD + [(100 + i, " ".join("".join(rng.choices("abcАd4", k=rng.randrange(1, 7))) for _ in range(rng.randrange(60)))) for i in range(200)]
    found = toxicity.score_toxicity(documents(*rows).withColumn("n", F.monotonically_increasing_id()), lexicon).collect()
    for r, (_, text) in zip(sorted(found, key=lambda r: r.n), rows):
        assert r.score == pytest.approx(plain_score(lexicon, text)) and r.predicted == (r.score >= 0.7)


def test_no_limit_on_entries_and_their_length(spark):
    words_ = ["x" * 40 + "".join(chr(97 + int(d)) for d in f"{i:04d}") for i in range(2500)]
    rows = [(" ".join(words_), 1.0)] + [(" ".join([*words_, "end", f"{i}"]), 1.0) for i in range(3)] + [(f"good text {i} fine", 0.0) for i in range(20)]
    lexicon = toxicity.fit(spark.createDataFrame(rows, "text string, label double"))
    assert len(lexicon.entries) >= 1
    found = toxicity.score_toxicity(spark.createDataFrame([(w,) for w in words_[::100]], "text string"), lexicon)
    assert found.where("n_hits = 0").count() == 0


def test_learning_from_nothing_or_one_class(spark, documents):
    docs, labels = labelled_corpus(documents, spark, 30)
    none = labels.where("false")
    assert rule_ensemble.fit(labelled.training_rows(docs, none, "quality")) == rule_ensemble.RuleEnsemble(0.0, ())
    one = rule_ensemble.fit(labelled.training_rows(docs, labels.where("quality = 1"), "quality"))
    assert one.rules == () and rule_ensemble.score_quality(docs, one).first().predicted == 1
    assert toxicity.fit(labelled.training_rows(docs, none, "toxic")).entries == ()
    twice = labels.where("doc_id = 0").unionByName(labels.where("doc_id = 0").selectExpr("doc_id", "1 AS quality", "toxic"))
    assert labelled.training_rows(docs, twice, "quality").collect()[0].label == 1.0


def test_folding_and_exceptions():
    assert toxicity.fold("1D10T, Ídiòt!").split() == ["idiot", "idiot"]
    assert toxicity.fold("tr\u0430sh a$$ b@d $5 \u200bx").split() == ["trash", "a", "bad", "ss", "x"]
    assert toxicity.fold("scum$$$ x").split() == ["scum", "x"]
    lexicon = toxicity.Lexicon(((" tras", 2.0), (" trash ", 3.0), (" vile ", 1.0)), (" trash can ",))
    automaton = lexicon.automaton()
    score = lambda text: toxicity.weigh(automaton, " ".join(["", *toxicity.fold(text).split(), ""]))[:2]
    assert score("Trash, trashy vile") == (6.0, 3)
    assert score("the trash can is vile") == (1.0, 1)
    assert score("a trash can of tr4sh") == (3.0, 1)
    assert score("nothing") == (0.0, 0) and toxicity.weigh(None, " a ") == (0.0, 0, [])


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header>
<nav><a href="/a">One</a> <a href="/b">Two</a></nav><div class="cookie-notice">We use cookies here.</div>
<div id="content"><h2>Head&shy;line &amp; more</h2><p>First  paragraph
with <a href="#">a link</a> and &#8364; signs.<p>Second <b>one, unclosed<br>line.</div>
<aside>Side</aside><form>Name <input></form><div class="ad">Buy</div>
<section id="comments"><p>Great post, I liked all of it very much indeed, thanks.</p></section>
<script>var x = "<p>no</p>";</script><style>p{}</style><footer>(c)</footer></body></html>"""


def test_main_text(spark, clashing):
    expected = "Head­line & more\nFirst paragraph with a link and € signs.\nSecond one, unclosed line."
    assert html_text.main_text(PAGE) == expected
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "just text"), (3, "w", "just text"),
            (4, "x", "<div>" * 2000 + "deep" + "</div>"), (5, "y", "<article><p>" + "word " * 50_000 + "</article>")]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(df).collect()}
    assert found[1] == (expected, len(expected)) and found[2] == ("", 0) and found[None] == ("", 0)
    assert found[3] == ("just text", 9) and found[4] == ("deep", 4) and found[5][1] == 249_999
    assert html_text.extract_text(df.where("false")).collect() == []


@pytest.mark.parametrize("page, text", [
    ("<body><article><h1>T</h1><p>a b</p></article><div class=ad>" + "buy this now " * 20 + "</div></body>", "T\na b"),
    ("<body><main><section><p>one two three four</p></section><section><p>five six seven</p></section></main></body>",
     "one two three four\nfive six seven"),
    ("<body class='has-sidebar'><div><p>one two three</p><p>four five six</p></div></body>", "one two three\nfour five six"),
    ("<ul><li>a<li>b</ul>", "a\nb"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
    ("<p>a<!-- no --> b</p><!-- open", "a b"),
    ("<article><p hidden>x</p><p style='display: none'>y</p><p>z z</p></article>", "z z"),
    ("<article><p title='a > b'>c d</p></article>", "c d"),
])
def test_main_text_of_odd_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<p title=Bob's>It is long text by Anna's book</p>", "It is long text by Anna's book"),
    ("<p \"x>one</p><p class = 'a > b' id=\"c > d\">two</p>", "one\ntwo"),
    ("<p title=\"open>three</p>", "three"),
    ("<article><p title=don't hidden>no</p><p =x>four</p></article>", "four"),
])
def test_a_stray_quote_hides_no_text(page, text):
    assert html_text.main_text(page) == text


def test_parts_of_the_article_that_reach_the_threshold_stay():
    lead, text, deep = (["".join(f"{w}{i} " for i in range(90)).strip() + f" {k}" for k in range(n)] for w, n in (("lead", 2), ("text", 5), ("deep", 2)))
    p = lambda parts: "".join(f"<p>{x}</p>" for x in parts)
    page = (f"<body><div id=wrap><h1>Headline</h1><div class=lead>{p(lead)}</div><ul><li><a href=#>x</a></ul>"
            f"<div class=text>{p(text)}</div></div><div class=row><i>a</i><i>b</i><i>c</i><i>d</i><div>{p(deep)}</div></div></body>")
    found = html_text.main_text(page).split("\n")
    assert found == ["Headline", *lead, *text, *deep]


STORY = "<p>" + "</p><p>".join(" ".join(f"story{i}x{k}" for i in range(30)) for k in range(3)) + "</p>"
LONG = "<p>" + "</p><p>".join(" ".join(f"reply{i}x{k}" for i in range(60)) for k in range(20)) + "</p>"


@pytest.mark.parametrize("page, kept, gone", [
    (f'<div class=story>{STORY}</div><div class=comments>{LONG}</div>', "story2x2", "reply"),
    (f'<article>{STORY}</article><ol class=comment-list><li><article class="comment-body">{LONG}</article></ol>', "story2x2", "reply"),
    (f'<div class="story"><p>one two</p><div id="share-price">{STORY}</div></div>', "story1x1", None),
    (f'<div class="story">{STORY}<div class="share"><a href=x>reply</a> <a href=y>it</a></div></div>', "story2x2", "reply"),
    (f'<div class="elementor-widget">{STORY}</div><div class="elementor-widget"><ul><li><a href=x>reply</a></ul></div>', "story2x2", "reply"),
    (f'<div class="no-sidebar ad-free">{STORY}</div><div class="sidebar left">{LONG}</div>', "story2x2", "reply"),
    (f'<div id="menu-wrapper"><h1>Head</h1>{STORY}</div><div class="side-menu-2">{LONG}</div>', "Head", "reply"),
    (f'<div class="cookie-notice-box">{LONG}</div>{STORY}', "story2x2", "reply"),
    (f'<div class=ads>{LONG}</div>', "", "reply"),
])
def test_names_of_elements(page, kept, gone):
    found = html_text.main_text(f"<body>{page}</body>")
    assert kept in found and (gone is None or gone not in found)
    if "story2x2" == kept:
        assert found.count("story") == 90


def random_tree(rng, depth=0):
    """(tag, children), of which a text is one."""
    if depth > 4 or rng.random() < 0.25:
        return ("p", [" ".join("x" * rng.randrange(1, 9) for _ in range(rng.choice((1, 4, 40))))])
    if rng.random() < 0.2:
        return (rng.choice(("ul", "div")), [("a", ["link " * rng.randrange(1, 5)]) for _ in range(rng.randrange(1, 5))])
    return ("div", [random_tree(rng, depth + 1) for _ in range(rng.randrange(1, 5))])


def plain_main_text(body):
    """Densities by definition, each from the whole subtree."""
    def below(node):
        return [x for child in node[1] if not isinstance(child, str) for x in (child, *below(child))]

    def text(node):
        return "".join(child if isinstance(child, str) else text(child) for child in node[1])

    chars = lambda node: len("".join(text(node).split()))
    links = lambda node: [x for x in (node, *below(node)) if x[0] == "a"]
    share = sum(map(chars, links(body))) / max(chars(body), 1)

    def density(node):
        c, lc, t, lt = chars(node), sum(map(chars, links(node))), max(len(below(node)), 1), max(len(links(node)), 1)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return max(c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0)) / math.log(max(base, 2.0)), 0.0)

    def total(node):
        own = sum(density(x) for x in node[1] if not isinstance(x, str))
        return max(own, density(node)) if any(isinstance(x, str) for x in node[1]) else own

    parents = {id(x): node for node in (body, *below(body)) for x in node[1] if not isinstance(x, str)}
    best = max((body, *below(body)), key=total)
    path = [best]
    while path[-1] is not body:
        path.append(parents[id(path[-1])])
    threshold = min(map(density, path))
    top = parents[id(best)] if best[0] in ("p", "a") and best is not body else best
    path = {id(x) for x in path[path.index(top):]} if top in path else set()

    def lines(node):
        if node[0] == "p":
            return [" ".join(text(node).split())]
        out = []
        for x in node[1]:
            if x[0] == "a":  # in one line with the links before it
                if out and isinstance(out[-1], list):
                    out[-1].append(text(x))
                else:
                    out.append([text(x)])
            else:
                out += lines(x)
        return [" ".join("".join(x).split()) if isinstance(x, list) else x for x in out]

    def chosen(node):
        if node is top or id(node) not in path and density(node) >= threshold:
            return lines(node) if node[0] != "a" else [" ".join(text(node).split())]
        return [x for child in node[1] if not isinstance(child, str) for x in chosen(child)]

    return "\n".join(lines(body) if top is body else chosen(body))


def written_out(node):
    return f"<{node[0]}>" + "".join(x if isinstance(x, str) else written_out(x) for x in node[1]) + f"</{node[0]}>"


def test_densities_by_definition():
    rng = random.Random(8)
    parts = 0
    for _ in range(400):
        body = ("body", [random_tree(rng) for _ in range(rng.randrange(1, 6))])
        found = html_text.main_text(written_out(body))
        assert found == plain_main_text(body), written_out(body)
        parts += len(found.split()) < len(re.sub("<[^>]*>", " ", written_out(body)).split())
    assert parts > 50


RULES = queries.URL_RULES


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fitting = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fitting, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def plain_ranks(pages, damping=0.85):
    judged = [plain_url(u) for _, u, _ in pages]
    hosts = {j[0] for j in judged if j[0]}
    links = {}
    for (_, _, page), (host, *_) in zip(pages, judged):
        for target in re.findall(r'<a href="[a-z]*:?//([^/"]+)', page or ""):
            if host and host != target.lower():
                links[host, target.lower()] = links.get((host, target.lower()), 0) + 1
    for host in hosts:
        above = host.partition(".")[2]
        if above in hosts and "." in above:
            for pair in ((host, above), (above, host)):
                links[pair] = links.get(pair, 0) + 1
    out = {}
    for kind, verdict in (("trust", "allow"), ("distrust", "block")):
        edges = links if kind == "trust" else {(b, a): n for (a, b), n in links.items()}
        total = {}
        for (a, _), n in edges.items():
            total[a] = total.get(a, 0) + n
        seed = {h: np.mean([j[3] == verdict for j in judged if j[0] == h]) * (1 - damping) for h in hosts}
        rank, before = dict(seed), None
        while before is None or max((abs(rank[h] - before.get(h, 0)) for h in rank), default=0) > 1e-9:
            before = rank
            rank = {h: seed.get(h, 0) + damping * sum(n / total[a] * rank.get(a, 0) for (a, b), n in edges.items() if b == h)
                    for h in hosts | {b for _, b in edges}}
        out[kind] = rank
    return judged, out


def test_urls(spark, clashing):
    pages = [
        (1, "http://A.Example.net/en/x?q#f", None), (2, "https://example.net/EN/", ""), (3, "http://x.example.com/de/1", '<a href="http://Bad.net/">'),
        (4, "http://x.example.com/fr/", '<a href="//bad.net/a"> <a href="https://good.org/">'), (5, "http://good.org/fr/a", '<a href="http://mid.info/">'),
        (6, "http://mid.info/a", '<a href="http://next.info/">'), (7, "http://next.info", None), (8, "http://bad.net/", None),
        (9, "http://feeder.info/", '<a href="http://bad.net/x">' * 3), (10, None, None), (11, "no scheme", None), (12, "http://", None),
        (13, "http://www.mid.info/b#x", None), (13, "http://www.mid.info/b#x", None), (None, "ftp://example.com/de/", None), (15, "http://net/", None),
    ]
    df = clashing(spark.createDataFrame(pages, "page_id long, url string, html string"))
    found = link_trust.judge_urls(df, RULES, damping=0.85).collect()
    judged, ranks = plain_ranks(pages)
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in found) == sorted(
        (str(p[0]), j[0], j[1], str(j[2])) for p, j in zip(pages, judged)
    )
    by_url = {(str(r.page_id)): r for r in found}
    for p, j in zip(pages, judged):
        r = by_url[str(p[0])]
        trust, distrust = (ranks[k].get(j[0], 0.0) if j[0] else 0.0 for k in ("trust", "distrust"))
        assert abs(r.trust - trust) < 1e-5 and abs(r.distrust - distrust) < 1e-5
        if j[3]:
            assert r.verdict == j[3]
    assert by_url["9"].verdict == "block" and by_url["6"].verdict == "allow" and by_url["11"].verdict == "allow"
    assert link_trust.judge_urls(df.where("false"), RULES).collect() == []


def test_trust_to_the_fixed_point(spark):
    """Cycles of a host and its site, and chains far longer than any number of rounds
    that would do for others."""
    pages, ids = [], itertools.count()
    for i, share in enumerate((15, 16, 17, 30)):  # of a hundred pages of the parent blocked
        pages += [(next(ids), f"http://s{i}.example.com/{'de' if k < share else 'xx'}/", None) for k in range(100)]
        pages += [(next(ids), f"http://www.s{i}.example.com/", None)]
    chain = [f"http://h{i}.info/" for i in range(24)]
    pages += [(next(ids), "http://a.org/fr/", f'<a href="{chain[0]}">')]
    pages += [(next(ids), a, f'<a href="{b}">') for a, b in zip(chain, chain[1:])]
    pages += [(next(ids), chain[-1], None)]
    rules = [r for r in RULES if r.host != "net"]
    found = link_trust.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()
    judged, ranks = plain_ranks(pages)
    for r in found:
        assert abs(r.trust - ranks["trust"].get(r.host, 0)) < 1e-5 and abs(r.distrust - ranks["distrust"].get(r.host, 0)) < 1e-5
    verdicts = {r.host: r.verdict for r in found if r.path == "/"}
    assert [verdicts[f"www.s{i}.example.com"] for i in range(4)] == ["allow", "allow", "block", "block"]
    last = next(r for r in found if r.host == "h23.info")
    assert last.trust == pytest.approx(0.15 * 0.85**24, rel=1e-3)


def test_ranks_that_do_not_settle_fail(spark, monkeypatch):
    monkeypatch.setattr(link_trust, "MOST_ROUNDS", 4)
    links = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "source string, target string, n long")
    seeds = spark.createDataFrame([("a", 1.0, 0.0)], "host string, trust double, distrust double")
    with pytest.raises(RuntimeError, match="still change"):
        link_trust.spread(links, seeds)


def test_links_as_a_parser_finds_them(spark):
    cases = {
        '<a data-href="//b.net/" href="//C.org/x">': ["c.org"],
        '<a href="//b.net/" data-href="//c.org/">': ["b.net"],
        '<!-- <a href="//b.net/"> --><a href="//c.org">': ["c.org"],
        '<!-- <a href="//b.net/">': [],
        """<script>'<a href="//b.net/">'</script><style><a href="//b.net/"></style>""": [],
        "<a title=Bob's href=//c.org/?x>Anna's</a>": ["c.org"],
        """<a title=' href="//b.net/"' href='https://c.org:80/'>""": ["c.org:80"],
        '<a href="/local//b.net/"><a href="http:/b.net"><a name="//b.net/"><abbr href="//b.net/">': [],
        '<a href="h&#116;tp://c.org&#47;x"><A HREF = " HTTP://D.org#x">': ["c.org", "d.org"],
        '<link href="//b.net/"><a\nhref="//c.org/"\n>x</a><a href="//c.org/">': ["c.org", "c.org"],
        "": [], None: [],
    }
    df = spark.createDataFrame([(i, h) for i, h in enumerate(cases)], "i int, html string")
    found = {r.i: r.h for r in df.select("i", link_trust.linked_hosts(F.col("html")).alias("h")).collect()}
    for i, (html, hosts) in enumerate(cases.items()):
        assert (found[i] or []) == hosts, html


def vocabulary(*pieces):
    names = [p for p, _ in pieces] + [f"<0x{b:02X}>" for b in range(256)]
    n = len(pieces)
    return unigram.Vocabulary(
        tuple(x.encode() for x in names), tuple(s for _, s in pieces) + (0.0,) * 256,
        (True,) * n + (False,) * 256, tuple(range(n, n + 256)),
    )


def best_by_trying(v, text, unknown):
    """The best total over all ways to cut marked text."""
    score = {p.decode(): s for p, s, m in zip(v.pieces, v.scores, v.matches) if m}
    best = None
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        parts, last = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(text[last:i])
                last = i
        parts.append(text[last:])
        if all(p in score or len(p) == 1 for p in parts):
            total = sum(score.get(p, unknown) for p in parts)
            best = total if best is None else max(best, total)
    return best


def test_unigram_segmentation_is_the_best():
    rng = random.Random(2)
    pieces = [("▁", -3.0), ("▁▁", -3.5), ("é", -4.0)]
    pieces += [(x, -rng.random() * 6) for x in {"".join(rng.choices("abé", k=rng.randrange(1, 5))) for _ in range(25)} - {"é"}]
    pieces += [("▁" + x, -rng.random() * 6) for x in {"".join(rng.choices("ab", k=rng.randrange(1, 4))) for _ in range(9)}]
    v = vocabulary(*pieces)
    s = unigram.Segmenter(v, unigram.DoubleArray.build([(p, i) for i, (p, m) in enumerate(zip(v.pieces, v.matches)) if m]))
    assert s.by_word
    for _ in range(60):
        text = "".join(rng.choices("abé c", k=rng.randrange(1, 10)))
        ids = s.encode(text)
        assert s.decode(ids) == text
        marked = "▁" + text.replace(" ", "▁")
        total, i = 0.0, 0
        while i < len(ids):  # byte pieces stand for one unknown character each
            if v.matches[ids[i]]:
                total, i = total + v.scores[ids[i]], i + 1
            else:
                total, i = total + s.unknown, i + 1
        assert abs(total - best_by_trying(v, marked, s.unknown)) < 1e-9


def test_trie_finds_all_pieces_and_no_other():
    rng = random.Random(3)
    keys = sorted({bytes(rng.choices(range(256), k=rng.randrange(1, 6))) for _ in range(800)} | {b"a", b"ab", b"abc"})
    trie = unigram.DoubleArray.build([(k, i) for i, k in enumerate(keys)])

    def look(key):
        node = 0
        for c in key:
            following = int(trie.base[node]) + c
            if trie.check[following] != node:
                return -1
            node = following
        return int(trie.value[node])

    assert [look(k) for k in keys] == list(range(len(keys)))
    others = {bytes(rng.choices(range(256), k=rng.randrange(1, 7))) for _ in range(2000)} - set(keys)
    assert all(look(k) == -1 for k in others)
    assert unigram.DoubleArray.build([]).value.max() == -1


@pytest.mark.skipif(not os.path.exists(unigram.MODEL), reason="no vocabulary file")
def test_coding_and_back(spark, documents, clashing):
    v = unigram.Vocabulary.load()
    texts = ODD + [(20, "漢字 ▁ \t\r\n\x00 𝄞 ﬁ  two  spaces "), (21, " lead"), (22, "▁▁"), (23, "a" * 50_000)]
    df = clashing(documents(*texts))
    coded = unigram.with_ids(df, v, decoded="decoded")
    found = coded.collect()
    assert sorted((str(r.doc_id), r.decoded) for r in found) == sorted((str(i), t or "") for i, t in texts)
    assert all(r.ids == [] for r in found if not r.text)
    back = unigram.with_text(coded.drop("text"), v).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in texts)
    assert unigram.with_ids(df.where("false"), v).collect() == []


def test_word_hashes_and_joined_runs():
    texts = [b"a bc  a", None, b"", b"bc a\n" + "é".encode(), b"a"]
    w = words.Words(texts, words.WHITE_SPACE)
    hashes = w.hashes()
    assert w.count.tolist() == [3, 0, 0, 3, 1]
    names = [b"a", b"bc", b"a", b"bc", b"a", "é".encode(), b"a"]
    for i, j in itertools.combinations(range(len(names)), 2):
        assert (hashes[i] == hashes[j]) == (names[i] == names[j])
    runs = words.joined(hashes, 2)
    assert runs[1] == runs[3] and runs[0] != runs[1]
    assert w.fits(2).tolist() == [True, True, False, True, True, False, False]
    assert words.joined(hashes[:1], 2).tolist() == [0]
    values = np.array([5, 3, 4, 9, 1, 7], np.uint64)
    assert words.smallest(values, 3).tolist() == [3, 3, 1, 1, 1, 7]
    long = words.Words([b"x" * 3_000_000 + b" bc"], words.WHITE_SPACE)
    assert long.hashes()[1] == hashes[1]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    df = queries.QUERIES[name](spark, SMALL)
    cursor = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(cursor.fetchall())
