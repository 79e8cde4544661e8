"""Problems 1, 4, 6, 7, 10: small cases, round trips, held-out accuracy, and odd input."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lanternq.llm import language, markup, mojibake, pairs, pii

DOC = "doc_id long, text string, lang string, source string, title string, kind string"


# --- problem 1


def test_numbers_emails_addresses_by_shape():
    text = "Mail jo.doe+x@box.example.org or call +1 (202) 555-0132. Unit 3, 12 Elm Street. Order 555-12-4444."
    kinds = {("email" if form.startswith("m:") else "typed", text[a:b]) for a, b, form in pii.typed_mentions(text)}
    assert ("email", "jo.doe+x@box.example.org") in kinds
    assert ("typed", "+1 (202) 555-0132") in kinds and ("typed", "Unit 3, 12 Elm Street") in kinds


def test_bracket_belongs_to_the_number_only_when_it_is_part_of_it():
    spans = {"(202-555-0161) Why?": "202-555-0161", "((202) 555 0102 ext. 8)": "(202) 555 0102"}
    for text, want in spans.items():
        assert want in {text[a:b] for a, b, _ in pii.typed_mentions(text)}


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(1)
    first, last = "Anna Boris Carla Denis Elena Fritz".split(), "Kovalt Lumbrek Morvane Nestolf Ortwick".split()
    rows = []
    for n in range(300):
        name = f"{rng.choice(first)} {rng.choice(last)}"
        text = rng.choice([f"My name is {name}. The lamp blinks.", f"Hi, {name} again. It hums.", f"{name} here. What now?", "Will the Green Gold lid fit?", "The Anna setting runs 3 turns.", f"Order 555-{n % 90 + 10}-{n % 9000 + 1000}. Where is it?", f"ssn {n % 900 + 100}-{n % 90 + 10}-4321 if you need it.", f"Tel. 202-555-{n:04d}."])
        rows.append((str(n), text, name))
    return rows


def test_bootstrapping_finds_names_and_tells_orders_from_identities(spark, people):
    answers = spark.createDataFrame([(int(k), t, None) for k, t, _ in people], "answer_id long, question string, text string")
    gold = spark.createDataFrame([("q1", None), ("q2", "")], "qid string, question string")
    rows = pii.personal_information(pii.fields(gold, answers)).collect()
    got = {(r["row_key"], r["kind"], r["start_pos"]) for r in rows}
    want = set()
    for key, text, name in people:
        if name in text:
            want.add((key, "name", text.index(name)))
        if text.startswith("ssn"):
            want.add((key, "id_number", 4))
        if text.startswith("Tel"):
            want.add((key, "phone", 5))
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_redaction_keeps_the_rest():
    assert pii.masked("Call 202-555-0101 ext. 5 now", [(5, 17, "phone")]) == "Call [PHONE] now"
    assert pii.masked("My name is Anna Kovalt. Ok", [(11, 22, "name")]) == "My name is [NAME]. Ok"


def test_streets_short_numbers_and_forms_of_mail_are_learnt(spark):
    """Words of streets that are no seeds are found by their patterns, and so are forms of e-mail addresses; short numbers
    are phones where cues say so and nothing where they are counts."""
    rows = [f"I live at {10 + n} Elm {w}. Thanks" for n in range(6) for w in ("Street", "Parade", "Mews")]
    rows += [f"Goods go to {30 + n} Oak Parade. Thanks" for n in range(4)] + [f"tel. 555 01{n:02d} please" for n in range(9)] + [f"{"Turn the ring" if n < 3 else "Wait for"} {n % 7} times, then {n % 7} minutes. Version {n}.2 the Brim R{n} waits" for n in range(40)]
    rows += [f"write to joe{n}@post.example today" for n in range(6)] + [f"write to ann{n} [at] post.example today" for n in range(3)]
    texts = spark.createDataFrame([("goldset", str(k), "question", t) for k, t in enumerate(rows)], "tab_name string, row_key string, field string, text string")
    got = {(int(r["row_key"]), r["kind"], r["start_pos"]) for r in pii.personal_information(texts).collect()}
    want = {(k, "address", t.index(" Elm") - 2 if "Elm" in t else t.index(" Oak") - 2) for k, t in enumerate(rows) if "Elm" in t or "Oak" in t}
    want |= {(k, "phone", 5) for k, t in enumerate(rows) if t.startswith("tel.")} | {(k, "email", 9) for k, t in enumerate(rows) if t.startswith("write")}
    assert {x for x in got if x[1] != "name"} == want


def test_pii_on_empty_tables(spark):
    empty = pii.fields(spark.createDataFrame([], "qid string, question string"), spark.createDataFrame([], "answer_id long, question string, text string"))
    assert pii.personal_information(empty).count() == 0


# --- problem 4


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("# Title\n\nSome **bold** words", ["markdown"]),
        ("<p>Hi &amp; bye</p>", ["html"]),
        ("&lt;p&gt;escaped&lt;/p&gt;", ["html"]),
        ("= Head =\n* one\n# two\n[[Link|link]]<ref>x</ref>", ["wiki"]),
        ("\\section{A} and $P = 3\\,\\mathrm{W}$", ["latex"]),
        ("Costs $20 to $45, T < 40 and T > 5, file run_log_2.txt in C:\\care\\logs, packs of\n3. Then", []),
        ("", []),
    ],
)
def test_markup_languages(text, want):
    assert markup.languages(text) == want


def test_markup_conversion_keeps_structure():
    html = "<h2 id='x'>Head</h2><ul><li>one</li><li>two</li></ul><pre><code>x = 1</code></pre><table><tr><td>a</td><td>b</td></tr></table>"
    plain = markup.to_plain(html, ["html"])
    assert "## Head" in plain and "- one" in plain and "```\nx = 1\n```" in plain and "| a | b |" in plain and "<" not in plain
    assert markup.to_plain("\\section{A}\n\\begin{itemize}\n\\item b\n\\end{itemize} \\textbf{c} $x^2$", ["latex"]).split() == "# A - b c $x^2$".split()
    assert markup.to_plain("= A =\n* b\n'''c''' [[D|d]]", ["wiki"]) == "# A\n- b\nc d"


def test_recurring_subtrees_are_removed_and_odd_rows_pass(spark):
    nav = "<div>Shop <a href='/x'>now</a></div>"
    rows = [(n, f"{nav}<p>Text number {n} stands alone</p>", None, "s", None, "html") for n in range(20)] + [(90, None, None, None, None, "html"), (91, "", None, "s", None, None), (92, "<b>x</b>" * 50000, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "'old' as subtree", "1 as n")
    out = {r["doc_id"]: r for r in markup.cleaned(docs).collect()}
    assert out[3]["clean_text"] == "Text number 3 stands alone" and out[3]["subtree"] == "old"
    assert out[90]["clean_text"] is None and out[91]["clean_text"] == "" and out[92]["markups"] == ["html"] and len(out) == 23


def test_inline_elements_and_copies_are_no_template(spark):
    page = "<p>First<br>second of {0} has a <b>bold</b> word and [[Link]]</p><p></p>"
    rows = [(n, page.format(n), None, "s", None, "html") for n in range(20)] + [(100 + n, "<div>One page only</div><p>told again</p>", None, "t", None, "html") for n in range(9)]
    out = {r["doc_id"]: r["clean_text"] for r in markup.cleaned(spark.createDataFrame(rows, DOC)).collect()}
    assert out[3].split() == "First second of 3 has a bold word and Link".split()
    assert out[104].split() == "One page only told again".split()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("{{Infobox\n| name = b\n| part = {c}\n}}\nText", ["wiki"]),
        ('See <a title="x<b" href="/q">here', ["html"]),
        ("\\title{{A} lamp} and \\emph{{B}}", ["latex"]),
        ("[[[x]]] and {{{1|}}}", ["wiki"]),
        ("int a[2][2] = {{1,2},\n{3,4}}; x = {\"a\":{\"b\":1}}", []),
    ],
)
def test_markup_is_parsed(text, want):
    assert markup.languages(text) == want


def test_markup_rows_come_from_what_is_deleted_or_converted(spark):
    """A template counted per site is deleted, the rest is converted, and the rows of p4_found are the languages of both; what
    counts as template moves a language from one to the other, and no row appears or goes."""
    nav = "<div class='{0}'>Shop <a href='/{0}'>now</a></div>"
    rows = [(n, f"{nav.format(n)}\n= Head {n} =\ntext", None, "s", None, None) for n in range(10)] + [(20 + n, f"{nav.format(n)}\nPlain text {n}", None, "s", None, None) for n in range(10)]
    rows += [(40, nav.format(40) + " elsewhere", None, "t", None, None), (41, nav.format(41) + " nowhere", None, None, None, None), (50, "No markup", None, "s", None, None), (51, None, None, "s", None, None)]
    rows += [(60, f"<div>{nav.format(60)}<div>Own words of this page</div></div>", None, "s", None, None)]
    docs = spark.createDataFrame(rows, DOC)
    by = {r["doc_id"]: (r["deleted"], r["converted"]) for r in markup.marked_documents(docs).collect()}
    want = {n: (["html"], ["wiki"]) for n in range(10)} | {20 + n: (["html"], []) for n in range(10)} | {40: ([], ["html"]), 41: ([], ["html"]), 60: (["html"], ["html"])}
    assert by == want
    got = sorted((r["doc_id"], r["markup"]) for r in markup.markup_rows(docs).collect())
    assert got == sorted((i, m) for i, (a, b) in want.items() for m in {*a, *b})
    none = {r["doc_id"]: (r["deleted"], r["converted"]) for r in markup.marked_documents(docs, min_docs=1000).collect()}
    assert none == {i: ([], sorted({*a, *b})) for i, (a, b) in want.items()}


def test_nested_and_unclosed_subtrees_are_template(spark):
    navs = {
        "latex": "\\begin{itemize}\\item Home\\begin{itemize}\\item Care\\end{itemize}\\item Shop\\end{itemize}",
        "html": "<p>Shop now<p>",
        "wiki": "{|\n| Home\n{|\n| Care\n|}\n| Shop\n|}",
        "markdown": "- [Home](/)\n- [Shop](/shop)\n",
    }
    rows = [(100 * k + n, f"{nav}\n\nText number {n} stands alone", None, name, None, None) for k, (name, nav) in enumerate(navs.items()) for n in range(10)]
    out = {r["doc_id"]: r["clean_text"] for r in markup.cleaned(spark.createDataFrame(rows, DOC)).collect()}
    assert out == {100 * k + n: f"Text number {n} stands alone" for k in range(4) for n in range(10)}


def test_nested_templates_and_quoted_brackets_leave_nothing_behind():
    assert markup.to_plain("{{Infobox\n| a = {{b|{{c}}}}\n}}Text", ["wiki"]) == "Text"
    assert markup.to_plain('<div title="a > b">Text</div>', ["html"]) == "Text"


# --- problem 6


def test_garbled_forms_round_trip():
    for word in ("hält", "décor", "Привет", "won’t", "–"):
        for chain, (enc, dec) in {"utf_8>cp1252": ("utf_8", "cp1252"), "utf_8>mac_roman": ("utf_8", "mac_roman"), "utf_8>latin_1": ("utf_8", "latin_1")}.items():
            garbled = mojibake._decoded(word.encode(enc), dec)
            assert garbled in mojibake.garbled_forms(word), (word, chain)


def test_garbled_documents_are_found_and_restored(spark):
    clean = "Die Tür schließt nicht, prüfen Sie die Dichtung für das Gerät. Später hält sie."
    rows = [(n, clean, "de", "s", None, None) for n in range(10)]
    rows += [(20, clean.encode().decode("latin_1"), "de", "s", None, None), (21, "Some old printers show 'Ã¤' here", "en", "s", None, None), (22, "Die T�r", "de", "s", None, None), (23, None, None, None, None, None), (24, "", None, None, None, None), (25, "plain", None, None, None, None)]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "'x' as token", "'y' as fixes")
    assert {r["doc_id"] for r in mojibake.garbled_documents(docs).collect()} == {20, 22}
    fixed = {r["doc_id"]: r["restored"] for r in mojibake.restored(docs).collect()}
    assert fixed == {20: clean, 22: "Die Tür"}


def test_copies_of_a_garbled_text_do_not_turn_the_direction(spark):
    """Single-byte chains: many copies of one garbled text, clean words that are rarer than their garbled forms."""
    clean = ["Крышка закрыта плотно, насос работает тихо, фильтр чистый сегодня", "Насос работает тихо, крышка закрыта плотно", "Фильтр чистый, насос работает, крышка закрыта"]
    bad = clean[0].encode("cp1251").decode("koi8_r")
    rows = [(n, t, "ru", "s", None, None) for n, t in enumerate(clean)] + [(10 + n, bad, "ru", "s", None, None) for n in range(9)]
    docs = spark.createDataFrame(rows, DOC)
    assert {r["doc_id"] for r in mojibake.garbled_documents(docs).collect()} == set(range(10, 19))
    fixed = {r["doc_id"]: r["restored"] for r in mojibake.restored(docs).collect()}
    assert set(fixed) == set(range(10, 19)) and set(fixed.values()) == {clean[0]}


# --- problem 7


def test_pair_defects(spark):
    long = "Lift the lid, then press the button until the lamp turns white. Wait 3 minutes before you start again."
    rows = [(n, "How do I start it?", long) for n in range(20)]
    rows += [(100, "How?", None), (101, "How?", "N/A"), (102, "How do I start it?", "How do I start it?"), (103, "How do I start it?", "You asked: how do I start it"), (104, "Wie starte ich das Gerät?", "The lamp is on the left and you can press it."), (105, "How do I start it?", "I'm sorry, but I can't help with that."), (106, "How do I start it?", "Lift the lid, then press the"), (107, "Is it?", "No"), (108, None, long), (108, None, long), (109, "How do I start it?", "Lift the lid, then press the button until the lamp turns white. Wait 3 minutes before you start again")]
    pairs_df = spark.createDataFrame(rows, "pair_id long, question string, answer string").selectExpr("*", "1 as n", "'w' as word", "'s' as start")
    got = {(r["pair_id"], r["defect"]) for r in pairs.defects(pairs_df).collect()}
    assert got == {(100, "empty"), (101, "empty"), (102, "copies_question"), (103, "copies_question"), (104, "other_language"), (105, "refusal"), (106, "truncated")}


def test_stray_endings_and_ellipses_hide_no_truncated_pair(spark):
    """Cut-off answers are found in a large table, where some word or length occurs by chance as an ending."""
    long = "Lift the lid, then press the button until the lamp turns white. Wait 3 minutes before you start again."
    rows = [(n, "How do I start it?", long) for n in range(1500)]
    rows += [(2000, "What then?", "Ask the man for the."), (2001, "What then?", "Wait 3 minutes.")]
    rows += [(2100, "What then?", "Two clips hold the…"), (2101, "What then?", "Lift the lid and brush off the ..."), (2102, "What then?", "Lift the lid, then press the button until the")]
    rows += [(2103, "What then?", long + " Wait 3 minutes")] + [(2200 + n, "What then?", "Lift the") for n in range(3)]
    rows += [(2300 + n, "When?", "After the lamp") for n in range(3)] + [(2400, "What then?", "Hm, the Mini... lift the lid until the lamp turns white.")]
    found = pairs.defects(spark.createDataFrame(rows, "pair_id long, question string, answer string")).where("defect = 'truncated'")
    assert {r["pair_id"] for r in found.collect()} == {2100, 2101, 2102, 2103, 2200, 2201, 2202}


def test_pairs_on_an_empty_table(spark):
    assert pairs.defects(spark.createDataFrame([], "pair_id long, question string, answer string")).count() == 0


# --- problem 10

WORDS = {
    "en": "the cat sits on the old wall and looks at the people in the street while the rain falls".split(),
    "de": "die katze sitzt auf der alten mauer und schaut den leuten auf der straße zu während der regen fällt".split(),
    "fr": "le chat est assis sur le vieux mur et regarde les gens dans la rue pendant que la pluie tombe".split(),
    "ru": "кошка сидит на старой стене и смотрит на людей на улице пока идет дождь и ветер".split(),
}


def _sentence(code: str, rng: random.Random) -> str:
    return " ".join(rng.choice(WORDS[code]) for _ in range(12)).capitalize() + "."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    codes = [c for c in WORDS for _ in range(100)]
    return language.train([" ".join(_sentence(c, rng) for _ in range(6)) for c in codes], codes, steps=400)


def test_gradients_match_finite_differences():
    net = language.ByteGru(hidden=3, seed=2)
    rng = np.random.default_rng(0)
    x, y, real = rng.integers(0, language.CLASSES, (4, 5, language.PATCH)), rng.integers(0, 7, 4), np.ones((4, 5), bool)
    _, grads = net.gradients(x, y, real)
    for name in ("Uf", "Ub", "cf", "W", "o"):
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        keep, eps = net.p[name][at], 1e-2
        net.p[name][at] = keep + eps
        up = net.gradients(x, y, real)[0]
        net.p[name][at] = keep - eps
        down = net.gradients(x, y, real)[0]
        net.p[name][at] = keep
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 2e-3


def test_held_out_accuracy(model):
    rng = random.Random(9)
    codes = [c for c in WORDS for _ in range(25)]
    texts = [" ".join(_sentence(c, rng) for _ in range(4)) for c in codes]
    rows = pa.Table.from_batches(language._labeller(model, True)(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])]))).to_pandas()
    best = rows.sort_values("confidence").groupby("doc_id").last()["lang"]
    assert (best.to_numpy() == np.array(codes)).mean() >= 0.97


def test_labels_mixtures_and_odd_rows(spark, model):
    rng = random.Random(4)
    say = lambda c, n: " ".join(_sentence(c, rng) for _ in range(n))
    rows = [(1, say("en", 5), "en-GB"), (2, say("de", 5), "English"), (3, say("fr", 5), None), (4, say("en", 4) + "\n\n" + say("ru", 4), "en"), (5, None, "en"), (6, "", None), (7, "12 34", "xx"), (8, say("de", 4) + ' The display says "Крышка открыта пока".', "german"), (1, say("en", 5), "en")]
    docs = spark.createDataFrame(rows[:8], "doc_id long, text string, lang string").selectExpr("*", "'l' as label", "1.0 as confidence")
    got = {(r["doc_id"], r["lang"]) for r in language.mislabelled(docs, model).collect()}
    assert got == {(2, "de"), (3, "fr"), (4, "en"), (4, "ru")}
    parts = language.segments(docs, model).where("doc_id = 4").orderBy("seg_no").collect()
    text, cyrillic = rows[3][1], lambda t: sum("а" <= c.lower() <= "я" for c in t) > len(t) / 2
    assert parts[0]["start_char"] == 0 and parts[-1]["end_char"] == len(text) and all(a["end_char"] <= b["start_char"] and a["lang"] != b["lang"] for a, b in zip(parts, parts[1:], strict=False))
    assert parts[0]["lang"] == "en" and parts[-1]["lang"] == "ru" and all((p["lang"] == "ru") == cyrillic(text[p["start_char"] : p["end_char"]]) for p in parts)


def test_language_of_an_empty_table(spark):
    assert language.mislabelled(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
