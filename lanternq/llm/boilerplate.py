"""Main content of web pages (problem 2): flat text blocks classified by a decision tree.

A block is a line. Its features are word counts and link densities of itself and its neighbours, where plain text has
no anchors left: link separators, and the share of a site's pages on which the block recurs (links of menus, footers
and boxes recur, articles don't). The tree is trained on a small labelled table and compiled into a CASE expression,
so classification runs inside Spark's generated code; texts never leave the scan."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternq.plans.scale import cut, digest, salted_join

FEATURES = [
    "words", "seps", "question", "stop", "bullet", "share", "masked", "is_title", "has_title",
    "p_words", "p_seps", "p_share", "n_words", "n_seps", "n_share",
    "box_share", "box_words", "box_seps", "run_blank", "before_text", "after_text",
]
#: Recurring blocks are looked up when they stand on at least MIN_PAGES pages and MIN_SHARE of the pages of a site.
MIN_PAGES, MIN_SHARE = 3, 0.004
DEPTH, MIN_LEAF = 10, 3


def _site_word(source: Column) -> Column:
    """The registrable part of a host name: it stands for the brand in menus and notices."""
    parts = F.split(F.lower(F.coalesce(source, F.lit(""))), r"\.")
    return F.when(F.size(parts) >= 2, F.element_at(parts, F.greatest(F.size(parts) - 1, F.lit(1)) * 1)).otherwise(parts[0])


def blocks(pages: DataFrame) -> DataFrame:
    """Every line of every page: ``doc_id, source, line_no``, its own features and two fingerprints, of its words
    without the site's name, and of these with digits masked."""
    lines = pages.where("text is not null").select("doc_id", "source", F.trim("title").alias("title"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("raw", r"[\s\xA0]+", " "))).withColumn("low", F.lower("line"))
    key = F.regexp_replace(F.replace(F.col("low"), _site_word(F.col("source")), F.lit("")), r"[^\p{L}\p{N}]+", "")
    lines = lines.withColumn("key", key).withColumn("mask", F.regexp_replace("key", r"\p{N}+", "0"))
    (a1, a2), (b1, b2) = digest(F.lit("exact"), F.col("key")), digest(F.lit("mask"), F.col("mask"))
    title = F.lower(F.coalesce("title", F.lit("")))
    # Blank lines recur nowhere: keys of their own keep them apart in the joins by fingerprint.
    own = lambda h: F.when(F.col("key") == "", F.xxhash64("doc_id", "line_no")).otherwise(h)
    return lines.select(
        "doc_id", "source", "line_no",
        (F.col("key") == "").alias("blank"),
        F.when(F.col("line") == "", 0).otherwise(F.size(F.split("line", " "))).cast("double").alias("words"),
        (F.size(F.split("raw", r"[|›»→]| [/>·] ")) - 1 + F.size(F.split(F.trim("raw"), r"\S {2,}(?=\S)")) - 1).cast("double").alias("seps"),
        F.col("line").rlike(r"[?？]$").cast("double").alias("question"),
        F.col("line").rlike(r"[.!…:]$").cast("double").alias("stop"),
        F.col("line").rlike(r"^(?:[•*+‣▪◦-]|\d{1,2}[.)]) ").cast("double").alias("bullet"),
        ((title != "") & (F.col("low") == title)).cast("double").alias("is_title"),
        ((title != "") & (F.col("low") != title) & F.contains("low", title)).cast("double").alias("has_title"),
        F.struct(own(a1).alias("h1"), a2.alias("h2")).alias("exact"),
        F.struct(own(b1).alias("h1"), b2.alias("h2")).alias("mask"),
    )


def recurring(lines: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per fingerprint, the greatest share of one site's pages it stands on. Distinct pages
    are counted per site and fingerprint with the page in the first key, so that one hot site spreads over all tasks;
    the second result is for masked fingerprints."""
    lines = lines.where("not blank and source is not null")
    sizes = pages.where("source is not null").select("source", "doc_id").distinct().groupBy("source").agg(F.count("*").alias("pages"))
    out = []
    for name, share in (("exact", "share"), ("mask", "masked")):
        per = lines.select("source", "doc_id", F.col(f"{name}.h1").alias("h1"), F.col(f"{name}.h2").alias("h2")).distinct().groupBy("source", "h1", "h2").agg(F.count("*").alias("n"))
        per = per.where(F.col("n") >= MIN_PAGES).join(sizes, "source").withColumn("share", F.col("n") / F.col("pages")).where(F.col("share") >= MIN_SHARE)
        out.append(cut(per.groupBy("h1", "h2").agg(F.max("share").alias(share))))
    return out[0], out[1]


def features(pages: DataFrame) -> DataFrame:
    """``doc_id, line_no, blank`` and FEATURES of every block. Windows run over the blocks of one page each; they hold
    only numbers, and a page's blocks are bounded by its length."""
    lines = cut(blocks(pages))
    exact, mask = recurring(lines, pages)
    flat = lines.select("*", F.col("exact.h1").alias("h1"), F.col("exact.h2").alias("h2")).drop("exact")
    flat = salted_join(flat, exact, ["h1", "h2"], "doc_id", "left", row_bytes=48).drop("h1", "h2")
    flat = flat.select("*", F.col("mask.h1").alias("h1"), F.col("mask.h2").alias("h2")).drop("mask")
    flat = salted_join(flat, mask, ["h1", "h2"], "doc_id", "left", row_bytes=48).drop("h1", "h2")
    zero = F.lit(0.0)
    flat = flat.withColumns({"share": F.coalesce("share", zero), "masked": F.coalesce("masked", zero)})
    page = Window.partitionBy("doc_id").orderBy("line_no")
    for name in ("words", "seps", "share"):
        flat = flat.withColumn(f"p_{name}", F.coalesce(F.lag(name).over(page), zero)).withColumn(f"n_{name}", F.coalesce(F.lead(name).over(page), zero))
    # The block that heads the questions before this one, and what ends the questions from this one on.
    back, ahead = page.rowsBetween(Window.unboundedPreceding, -1), page.rowsBetween(0, Window.unboundedFollowing)
    head = F.last(F.when(F.col("question") == 0, F.struct(F.col("masked").alias("share"), "words", "seps", F.col("blank").alias("b"))), ignorenulls=True).over(back)
    tail = F.first(F.when(F.col("question") == 0, F.col("blank").cast("double")), ignorenulls=True).over(ahead)
    prose = (F.col("words") >= 8) & (F.col("stop") == 1) & (F.col("share") < 0.02)
    flat = flat.withColumn("_head", head).withColumn("run_blank", F.coalesce(tail, F.lit(1.0)))
    flat = flat.withColumn("before_text", (F.coalesce(F.max(prose.cast("int")).over(back), F.lit(0)) == 0).cast("double")).withColumn("after_text", (F.coalesce(F.max(prose.cast("int")).over(page.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)) == 0).cast("double"))
    headed = F.col("_head").isNotNull() & ~F.coalesce(F.col("_head.b"), F.lit(True))
    # What heads a run of questions, and what ends it, tells a link box from a heading; other blocks have neither.
    flat = flat.withColumns({f"box_{n}": F.when(headed & (F.col("question") == 1), F.col(f"_head.{n}")).otherwise(zero) for n in ("share", "words", "seps")})
    # A question of an article recurs now and then as a heading; only what stands on many pages tells anything.
    often = (F.col("question") == 0) | (F.greatest("share", "masked") >= 0.15)
    flat = flat.withColumns({n: F.when(often, F.col(n)).otherwise(zero) for n in ("share", "masked")})
    flat = flat.withColumn("run_blank", F.when(F.col("question") == 1, F.col("run_blank")).otherwise(zero))
    return flat.select("doc_id", "line_no", "blank", *FEATURES)


# --- the small labelled table: pages of invented sites, each line labelled article (0) or not (1) -------------------


def labelled_pages(seed: int = 5, sites: int = 10, pages: int = 80) -> list[tuple[int, str, str, str, list[int]]]:
    """``doc_id, source, title, text, labels``: pages made from invented building blocks the way help sites are made:
    menu, trail, consent box, link box, article with notices, adverts and boxes inside, feedback, footer."""
    rng = random.Random(seed)
    nouns = "kettle lantern ferry garden lens drum saddle window basket anchor ladder candle mirror wagon barrel compass harbour needle orchard pulley quarry ribbon shutter tunnel valley whistle".split()
    verbs = "polish carry open measure lower wrap collect shift repair stack trace weigh".split()
    tails = ["in the morning", "after the storm", "near the gate", "before sunset", "by the river", "on a dry day", "twice a week"]
    menu_words = ["Start", "Shop", "Journal", "Dealers", "Contact", "My account", "Support", "Careers", "Press", "Catalogue", "Returns", "Spare stock", "Find a dealer"]
    # Two wordings of everything: a site's pages mostly use its own, some the other one, as pages in a second language do.
    wordings = [
        {
            "consent": ["We keep small files to remember {b} visits.", "{b} uses cookies, see our settings."],
            "buttons": ["Agree | Refuse", "Accept  Decline  More", "Fine, thanks / Settings"],
            "heads": ["See also", "Popular now", "Readers liked", "More on this"],
            "notices": ["Opinions on these pages are not those of {b}", "Prices of {b} may change without word", "Shared with friends of the {b} club", "Written and checked by the {b} office", "{b} is not liable for work done by others", "Tell your friends about this {b} page", "Images shown by {b} are examples"],
            "ads": ["Advertisement {b} Model {m}0 {n}", "Now {k} % off all {b} bags - order today", "Sponsored: {b} Model {m}0 in stock {n}"],
            "ends": ["Did this page help?  Yes  No", "Rate us: 1 2 3 4 5", "Talk to a person", "Any questions? Call us now"],
            "foots": ["© {y} {b}. All rights kept.", "(c) {y} {b} and partners.", "Terms | Privacy | Contact", "Letters from {b}", "Find {b} elsewhere", "Pick a country", "No {n} / r{k}", "Sign up for {b} news"],
        },
        {
            "consent": ["Ihre Wahl bei {b} gilt ein Jahr.", "Diese Seite von {b} legt Dateien ab."],
            "buttons": ["Ja  Nein  Einstellungen", "Zulassen / Ablehnen"],
            "heads": ["Meist gelesen", "Mehr dazu", "Passend dazu"],
            "notices": ["Preise von {b} ohne Gewähr", "Bilder von {b} sind Beispiele", "Vom Büro bei {b} gelesen", "Für Arbeiten anderer haftet {b} nicht", "Diese Seite von {b} weitergeben"],
            "ads": ["Werbung {b} Modell {m}0 {n}", "{k} % auf alle Beutel von {b} - heute bestellen"],
            "ends": ["Hat das geholfen?  Ja  Nein", "Bewerten: 1 2 3 4 5", "Fragen? Rufen Sie uns an"],
            "foots": ["© {y} {b}. Alle Rechte bleiben.", "Impressum | Datenschutz", "Post von {b}", "{b} anderswo", "Land wählen", "Nr {n} / r{k}"],
        },
    ]
    out, doc = [], 0

    def question() -> str:
        more = rng.choice(["", "", f" of the Model {rng.randint(1, 9)}0", f" when two {rng.choice(nouns)}s share a shelf", f" and the {rng.choice(nouns)} is wet {rng.choice(tails)}"])
        return rng.choice([f"How do I {rng.choice(verbs)} the {rng.choice(nouns)} {rng.choice(tails)}{more}?", f"Why is the {rng.choice(nouns)} {rng.randint(10, 90)} loud{more}?", f"What does {rng.choice('ABC')}{rng.randint(10, 60)} mean on the Model {rng.randint(1, 9)}0?", f"Where is the {rng.choice(nouns)}{more}?"])

    def sentence() -> str:
        return rng.choice([f"You can {rng.choice(verbs)} the {rng.choice(nouns)} {rng.choice(tails)}, but never the {rng.choice(nouns)}.", f"It takes {rng.randint(2, 90)} minutes to {rng.choice(verbs)} the {rng.choice(nouns)} {rng.choice(tails)}.", f"Parts of the {rng.choice(nouns)} come in bags of {rng.randint(2, 9)}.", f"Most people {rng.choice(verbs)} the {rng.choice(nouns)} first; then the {rng.choice(nouns)} can rest {rng.choice(tails)}.", f"Keep the {rng.choice(nouns)} below {rng.randint(10, 99)} degrees.", f"After this the {brand} Model {rng.randint(1, 9)}0 works as before."])

    for s in range(sites):
        brand = f"Marn{'aeiouyxzkq'[s]}l"
        source = f"help.{brand.lower()}.example"
        menu = rng.sample(menu_words, rng.randint(5, 8))
        style = rng.choice(["lines", "lines", "|", "  ", " / ", " > "])
        sets = [{k: rng.sample(v, max(1, len(v) - rng.randint(0, 2))) for k, v in w.items()} for w in wordings]
        boxes = rng.choice([0.05, 0.15, 0.4, 0.9])
        ads, notes = rng.choice([0.01, 0.02, 0.06]), rng.choice([0.1, 0.25, 0.45])
        chance = {x: rng.choice([0.08, 0.15, 0.3, 0.6]) for w in sets for v in w.values() for x in v}
        for _ in range(pages):
            own = sets[(s % 3 == 2) ^ (rng.random() < 0.1)]
            fill = lambda x: x.replace("{b}", brand).replace("{y}", str(rng.randint(2019, 2025))).replace("{n}", str(rng.randint(1000, 10**7))).replace("{k}", str(rng.randint(1, 99))).replace("{m}", str(rng.randint(1, 9)))  # noqa: B023, E731
            pick = lambda kind: fill(rng.choices(own[kind], [chance[x] for x in own[kind]])[0])  # noqa: B023, E731
            lines: list[tuple[str, int]] = []
            title = question()

            def box() -> None:
                if rng.random() > boxes:  # noqa: B023
                    return
                lines.append((pick("heads"), 1))  # noqa: B023
                lines.extend((question(), 1) for _ in range(rng.randint(2, 5)))  # noqa: B023
                lines.append(("", -1))  # noqa: B023

            tops = rng.sample(["menu", "consent", "trail", "box", "gap"], rng.randint(0, 4))
            for top in tops:
                if top == "menu":
                    items = menu[rng.randint(0, 1) : rng.randint(4, len(menu))]
                    lines += [(x, 1) for x in items] if style == "lines" else [(style.join(items), 1)]
                elif top == "consent":
                    lines.append((pick("consent"), 1))
                    lines += [(pick("buttons"), 1)] if rng.random() < 0.8 else []
                elif top == "trail":
                    lines.append((rng.choice([" / ", " > ", " » "]).join([menu[0], f"Model {rng.randint(1, 9)}0", title]), 1))
                elif top == "box":
                    box()
                else:
                    lines.append(("", -1))
            if rng.random() < 0.5:
                lines.append(("", -1))
            lines.append((title, 0))
            for part in range(rng.randint(2, 6)):
                if part and rng.random() < 0.5 or (part == 0 and rng.random() < 0.2):
                    lines.append((question(), 0))
                if rng.random() < 0.25:
                    lines.append(("", -1))
                if rng.random() < 0.3:
                    few = nouns[: 2 + 8 * (s % 3)]
                    lines += [(f"• {rng.choice(verbs[:4]).title()} the {rng.choice(few)} {rng.choice(tails[:3])}", 0) for _ in range(rng.randint(2, 5))]
                for _ in range(rng.randint(0, 3)):
                    lines.append((" ".join(sentence() for _ in range(rng.choice([1, 2, 2, 3, 3, 4, 4, 5, 5]))), 0))
                if rng.random() < notes:
                    n = pick("notices")
                    lines.append((rng.choice([n, n, n.upper(), f"— {n} —", f"  {n}.", n + "!"]), 1))
                if rng.random() < ads:
                    lines.append((pick("ads"), 1))
                if rng.random() < 0.2:
                    box()
                if rng.random() < 0.3:
                    lines.append(("", -1))
            lines.append((" ".join(sentence() for _ in range(rng.randint(1, 4))), 0))
            if rng.random() < 0.5:
                lines.append(("", -1))
            lines += [(fill(x), 1) for x in own["ends"] if rng.random() < chance[x]]
            if rng.random() < 0.7:
                box()
            lines += [(fill(x), 1) for x in own["foots"] if rng.random() < max(0.3, chance[x])]
            doc += 1
            out.append((doc, source, title if rng.random() < 0.93 else None, "\n".join(x for x, _ in lines), [y for _, y in lines]))
    return out


class Tree:
    """A binary decision tree grown by the Gini index."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = DEPTH, least: int = MIN_LEAF):
        self.value, self.split = float(y.mean()), None
        if depth == 0 or len(y) < 2 * least or y.min() == y.max():
            return
        best = (2 * self.value * (1 - self.value) * len(y) - 1e-9, None, None)
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            v, ones = x[order, k], np.cumsum(y[order])
            at = np.flatnonzero(np.diff(v) > 0) + 1
            at = at[(at >= least) & (at <= len(y) - least)]
            if len(at):
                a, b = ones[at - 1] / at, (ones[-1] - ones[at - 1]) / (len(y) - at)
                cost = 2 * a * (1 - a) * at + 2 * b * (1 - b) * (len(y) - at)
                i = int(cost.argmin())
                if cost[i] < best[0]:
                    best = (float(cost[i]), k, float((v[at[i] - 1] + v[at[i]]) / 2))
        if best[1] is not None:
            low = x[:, best[1]] <= best[2]
            self.split = (best[1], best[2], Tree(x[low], y[low], depth - 1, least), Tree(x[~low], y[~low], depth - 1, least))

    def column(self) -> Column:
        """The tree as an expression: the probability that a block is no part of the article."""
        if self.split is None:
            return F.lit(self.value)
        k, threshold, low, high = self.split
        return F.when(F.col(FEATURES[k]) <= threshold, low.column()).otherwise(high.column())


def trained(spark: SparkSession) -> Tree:
    """The tree of the labelled table, whose features come from the same plan as those of any other pages."""
    rows = labelled_pages()
    pages = spark.createDataFrame([r[:4] for r in rows], "doc_id long, source string, title string, text string")
    table = features(pages).where("not blank").toPandas()
    label = {(r[0], i): y for r in rows for i, y in enumerate(r[4])}
    y = np.array([label[k] for k in zip(table["doc_id"], table["line_no"], strict=True)])
    return Tree(table[FEATURES].to_numpy(float), y)


def html_pages(docs: DataFrame) -> DataFrame:
    """The web pages among the documents, each once."""
    pages = docs.where("kind = 'html'").select("doc_id", "source", "title", "text")
    ids = pages.select("doc_id")
    # Ids are counted first, as texts are shuffled only where there is something to drop.
    return pages if ids.count() == ids.distinct().count() else pages.dropDuplicates(["doc_id"])


def boilerplate_lines(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """``doc_id, line_no`` of every non-blank line that is not part of a page's article."""
    tree = tree or trained(pages.sparkSession)
    return features(pages).where("not blank").where(tree.column() > 0.5).select("doc_id", "line_no")


def articles(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """The pages with ``article``: their text without boilerplate lines. Pages without text keep none; a page that is
    all boilerplate gets an empty article. Line numbers are gathered per page, bounded by its own length."""
    drops = boilerplate_lines(pages, tree).groupBy("doc_id").agg(F.collect_set("line_no").alias("_drop"))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("_drop"), i))
    return pages.join(drops, "doc_id", "left").withColumn("article", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.trim(F.array_join(kept, "\n")))).drop("_drop")
