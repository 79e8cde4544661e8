"""Problems 2, 3, 5, 8, 9: against brute force, exact counts, and odd input."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lanternq.llm import boilerplate, contamination, dedup, lines, packing

DOC = "doc_id long, text string, lang string, source string, title string, kind string"


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


# --- problem 2


def test_tree_on_pages_of_other_sites(spark):
    tree = boilerplate.trained(spark)
    rows = boilerplate.labelled_pages(seed=77, sites=4, pages=40)
    pages = spark.createDataFrame([r[:4] for r in rows], "doc_id long, source string, title string, text string")
    got = {(r["doc_id"], r["line_no"]) for r in boilerplate.boilerplate_lines(pages, tree).collect()}
    want = {(r[0], i) for r in rows for i, y in enumerate(r[4]) if y == 1}
    assert len(got & want) >= 0.93 * len(want) and len(got & want) >= 0.93 * len(got)


def test_pages_of_odd_kinds(spark):
    tree = boilerplate.Tree(np.array([[1.0] * len(boilerplate.FEATURES), [0.0] * len(boilerplate.FEATURES)]), np.array([1.0, 0.0]))
    rows = [(1, None, None, None, None, "html"), (2, "", None, "s", None, "html"), (3, "One line of text", None, None, "One line of text", "html"), (3, "One line of text", None, None, "One line of text", "html"), (4, "x", None, "s", None, "text"), (5, "word " * 100000, None, "a.b", None, "html")]
    pages = boilerplate.html_pages(spark.createDataFrame(rows, DOC).selectExpr("*", "1 as words", "2 as share", "'k' as key"))
    assert {r["doc_id"] for r in boilerplate.articles(pages, tree).collect()} == {1, 2, 3, 5}
    assert boilerplate.boilerplate_lines(pages.limit(0), tree).count() == 0


# --- problem 3


@pytest.fixture(scope="module")
def site_docs():
    rng = random.Random(5)
    pool = [f"Standing line {k} of all" for k in range(8)]
    rows = []
    for n in range(120):
        body = [rng.choice(pool).upper() if rng.random() < 0.3 else f"  {rng.choice(pool)} !", f"Unique {n} and more", "", "***"] + [rng.choice(pool) for _ in range(rng.randint(0, 3))]
        rng.shuffle(body)
        rows.append((n, "\n".join(body), None, rng.choice(["a", "a", "b", None]), None, None))
    return [*rows, rows[0], (900, None, None, "a", None, None), (901, "", None, "a", None, None)]


def test_lines_against_brute_force(spark, site_docs):
    docs = spark.createDataFrame(site_docs, DOC).selectExpr("*", "1 as line_no", "'x' as key", "2 as h1")
    counts, sizes = defaultdict(set), defaultdict(set)
    for i, text, _, source, *_ in site_docs:
        if source:
            sizes[source].add(i)
            for line in (text or "").split("\n"):
                if key := "".join(c for c in line.lower() if c.isalnum()):
                    counts[source, key].add(i)
    bad = {k for k, v in counts.items() if len(v) >= 5 and len(v) >= 0.05 * len(sizes[k[0]])}
    want = {(i, n) for i, text, _, source, *_ in site_docs for n, line in enumerate((text or "").split("\n")) if (source, "".join(c for c in line.lower() if c.isalnum())) in bad}
    assert {(r["doc_id"], r["line_no"]) for r in lines.repeated_lines(docs).collect()} == want
    out = {r["doc_id"]: r for r in lines.without_repeated_lines(docs.dropDuplicates(["doc_id"])).collect()}
    assert out[900]["clean_text"] is None and out[901]["clean_text"] == "" and sum(r["removed"] for r in out.values()) == len(want)
    assert lines.repeated_lines(docs.limit(0)).count() == 0


# --- problem 5


def test_copies(spark):
    rows = [
        (1, "Hello, World! It is straße", None, "a", None, None), (2, "hello   world\nIT IS STRASSE", None, "b", None, None), (3, "Hello World", None, "a", None, None),
        (10, "Question: Why?\nAnswer: So, then.\nRef: KB 7", None, "a", None, "faq_pair"), (11, "ref: kb 7\nANSWER: so then\n\nQuestion: Why", None, None, None, None),
        (12, "Box 7 - 12\n\nWidth: 30 cm\nHeight: 7 l\nMass: 5 kg", None, "a", None, None), (13, "Box 7 - 12\n\nMass: 5 kg\nWidth:  30 cm\nHeight 7 l", None, "a", None, None),
        (20, "one two. three four five.\nsix.", None, "a", None, None), (21, "six. one two three four five", None, "a", None, None),
        (30, "", None, "a", None, None), (31, " -- ", None, "a", None, None), (32, None, None, "a", None, None), (1, "Hello, World! It is straße", None, "a", None, None),
    ]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as t1", "'v' as values", "3 as raw")
    assert {tuple(r) for r in dedup.copies(docs).collect()} == {(1, 2), (10, 11), (12, 13), (30, 31)}
    counts = {r["rep_id"]: r["n_copies"] for r in dedup.collapsed(docs).collect()}
    assert counts == {1: 2, 3: 1, 10: 2, 12: 2, 20: 1, 21: 1, 30: 2}
    assert dedup.copies(docs.limit(0)).count() == 0


# --- problem 8


def test_hilbert_curve_visits_neighbours():
    side, bits = 8, 3
    grid = np.array([(a, b) for a in range(side) for b in range(side)])
    key = packing.hilbert_key(grid, bits)
    path = grid[np.argsort(key)]
    assert sorted(key) == list(range(side * side)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_best_fit_decreasing_is_valid_and_tight():
    sizes = np.random.default_rng(1).integers(1, 400, 500)
    bins = packing.best_fit_decreasing(sizes, 1024)
    loads = np.bincount(bins, weights=sizes)
    assert loads.max() <= 1024 and len(loads) <= -(-sizes.sum() // 1024) + 2


def test_packing_holds_everything_once(spark):
    rng = random.Random(2)
    rows = [(n, " ".join(rng.choice(["lamp", "door", "Größe", "и", "123"]) for _ in range(rng.choice([0, 3, 50, 700]))), None, None, None, None) for n in range(200)] + [(500, None, None, None, None, None), (501, "word " * 5000, None, None, None, None), (1, "again", None, None, None, None)]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as key", "2 as n_tokens", "3 as stretch")
    caps = spark.createDataFrame([("small", 512), ("big", 2048), ("none", 0)], "container string, capacity int")
    sizes = {r["doc_id"]: r["n_tokens"] for r in packing.measured(docs.where("doc_id <> 1")).collect()}
    out = packing.packed(docs.where("doc_id <> 1 or text <> 'again'"), caps, stretch=64).collect()
    for name, cap in (("small", 512), ("big", 2048)):
        loads, parts = defaultdict(int), defaultdict(list)
        for r in out:
            if r["container"] == name:
                loads[r["stretch"], r["bin"]] += r["n_tokens"]
                parts[r["doc_id"]].append((r["piece"], r["first_token"], r["n_tokens"]))
        assert max(loads.values()) <= cap and len(parts) == 202
        for i, n in sizes.items():
            p = sorted(parts[i])
            assert sum(x[2] for x in p) == n and len(p) == max(1, -(-n // cap)) and [x[1] for x in p] == [k * cap for k in range(len(p))]
    assert packing.packed(docs.limit(0), caps).count() == 0


# --- problem 9


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(50)) for k in range(20)] + [(90, None), (91, ""), (92, "too short")]
    docs = []
    for n in range(150):
        body = text(rng.randint(5, 200)).split()
        if rng.random() < 0.5:
            src = rng.choice(items[:20])[1].split()
            run = rng.randint(9, 20)
            at = rng.randint(0, 50 - run)
            body[len(body) // 2 : len(body) // 2] = [w.upper() + rng.choice(["", ",", "!"]) for w in src[at : at + run]]
        docs.append((n, " ".join(body)))
    docs += [(900, None), (901, ""), docs[0]]
    gram = lambda t: {tuple(w[i : i + 13]) for w in [words(t or "")] for i in range(len(w) - 12)}
    want = {(i, k) for i, t in docs for k, u in items if gram(t) & gram(u)}
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as sketch", "2 as g1", "3 as id")
    e = spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 20 and {tuple(r) for r in contamination.leaks(d, e).collect()} == want
    monkeypatch.setattr(contamination, "FILTER_BITS", 6)  # a filter that lets nearly everything through changes nothing
    assert {tuple(r) for r in contamination.leaks(d, e).collect()} == want
    assert contamination.leaks(d, e.limit(0)).count() == 0 and contamination.leaks(d.limit(0), e).count() == 0
