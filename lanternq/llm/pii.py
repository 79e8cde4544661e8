"""Personal information in free text (problem 1): bootstrapped contextual extraction.

Seed cues ("tel.", "ssn", "my name is", "order no.") start the process. Candidates are mentions of a lexical shape: a
number or street form for phones, identity numbers and addresses, a run of capitalised words for names. Spark keeps
the graph of patterns (the words before and after a mention) and instances (number shapes, street words, name words)
and scores it in turns: instances take the score of the patterns they stand in, patterns that of their instances. What
ends up with a high score is accepted wherever it stands, with or without a cue."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternq.plans.scale import cut, salted_join

ROUNDS = 4
CLASSES = ("email", "phone", "id_number", "address", "other")
#: The classes that instances of a form can be of: words of streets, forms of e-mail addresses, shapes of numbers.
POSSIBLE = {"w:": ("address", "other"), "m:": ("email", "other"), "": ("phone", "id_number", "other")}

#: Words before a mention that tell its kind.
CUES = {
    "phone": "tel telefon telefono teléfono telefone téléphone tél phone mobile mobil móvil cell handy portable ring call text whatsapp fax тел телефон звоните позвонить cellulare",
    "id_number": "ssn passport dni nie ausweisnummer ausweis personalausweis identité identity identidad nino паспорт паспорта fiscale cpf nif снилс инн sozialversicherungsnummer steuernummer",
    "address": "live wohne habite vivo abito moro живу address adresse dirección indirizzo endereço адрес адресу ship",
    "other": "order ticket batch lot firmware serial plate part mark version invoice model code item bestellung commande pedido ordine заказ rechnung артикул партия прошивка",
}
#: Words after a mention that tell its kind.
AFTER = {"id_number": ("national number",)}
#: The words of streets that start the process, one or two for each language; others are learnt.
STREETS = "street rue via calle rua улица ул straße strasse"
STREET_WORDS = frozenset(STREETS.split())
#: Fixed value: the form of e-mail address that starts the process.
MAIL_FORM = "m:x@x.x"
#: Phrases that introduce a name; titles that stand before one but are no part of it.
NAME_CUES = r"(?:my name is|mein name ist|ich hei(?:ß|ss)e|je m['’]appelle|mon nom est|me llamo|mi nombre es|mi chiamo|il mio nome è|(?:eu )?me chamo|chamo-me|o meu nome é|меня зовут|for (?:mr|mrs|ms|dr)\.?)"
TITLES = frozenset("mr mrs ms miss dr prof herr frau monsieur madame mme señor señora sr sra signor signora sig senhor senhora г-н г-жа господин госпожа".split())
PARTICLES = frozenset("van von der den de di da del della la le du dos das do of ter ten zu zur el al bin ibn".split())
OPENERS = frozenset("hi hello dear hallo liebe lieber bonjour salut hola ciao buongiorno olá caro cara привет здравствуйте for from thanks regards best chamo-me the a an my our your is it in on at to and or but if when why how what where who der die das den ein eine wie was wo wer warum wenn ist le la les un une il elle que qui où el los las una por qué cómo o os as um uma il lo gli i".split())

EMAIL = regex.compile(r"[\w.+\-]+ ?(?:@|\(at\)|\[at\]) ?[\w\-]+(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[\w\-]+)+", regex.I)
#: An address as the JVM takes it out, so that the words in it count neither as names nor as ordinary words.
MAIL = r"(?i)[\w.+\-]+ ?(?:@|\(at\)|\[at\]) ?[\w.\-]+(?: ?(?:\(dot\)|\[dot\]) ?[\w\-]+)*"
NUMBER = regex.compile(r"(?<![\w@+#.\-/(])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{1,5}\)[ .\-]?)?\d+(?:[ .\-/]\d+)*(?: ?[A-Z])?(?!\w)|(?<=[(])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{1,5}\)[ .\-]?)?\d+(?:[ .\-/]\d+)*(?!\w)|(?<![\w\-])[A-Z]{1,2} ?\d+(?: \d+)* ?[A-Z]?(?!\w|-\d)")
FLAT = r"(?:(?:unit|flat|apt\.?|apartment|suite) \d+\w?, )?"
ADDRESS = regex.compile(
    rf"(?<![\w\-])(?<!\d )(?<!\b(?i:flat|unit|apartment|suite|apt\.?|ext\.?) )(?:(?i:{FLAT})(?P<n>\d{{1,4}})(?P<x>[a-z]?),? (?P<w1>\p{{L}}[\p{{L}}'’\-]*) (?P<t1>\p{{Lu}}\p{{L}}+)\b"
    r"|\d{1,4}(?: ?(?:bis|ter))?,? (?P<t2>\p{L}+) (?:de la |de l['’]|des? |du |d['’])?\p{Lu}[\p{L}\-]+"
    r"|(?P<t3>\p{L}+) (?:del|dei|delle|della|degli|dello|di|de la|de los|de las|de|das|dos|da|do) \p{Lu}[\p{L}\-]+(?: \p{Lu}[\p{L}\-]+)*,? (?:n\.? ?)?\d{1,4}"
    r"|(?P<t4>ул|пер|просп|пр|наб|бульв)\. ?\p{Lu}[\p{L}\-]+(?: \p{Lu}[\p{L}\-]+)*, ?(?:д\. ?)?\d+|\p{Lu}[\p{L}\-]+ (?P<t5>улица|переулок|проспект|набережная|бульвар), ?(?:д\. ?)?\d+"
    r"|\p{Lu}[\p{L}\-]*?(?P<t6>straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer) \d{1,4})"
)
WORD = regex.compile(r"\d+|\p{L}[\p{L}\p{M}'’\-]*\.?|[^\s\w]|\n")
NAME = r"\p{Lu}[\p{L}\p{M}'’\-]*"
NAMES = regex.compile(rf"(?<![\w@.+\-]){NAME}(?:(?:,? (?:(?:van|von|der|den|de|di|da|del|la|le|du|dos) )*|(?<=\b\p{{Lu}})\. |(?<=\b(?:Mr|Ms|Dr|Mrs|Sr|Sra|Mme))\. ){NAME})*")
DIGIT_NEXT = regex.compile(r"\s?\d")
CITY = regex.compile(r"(?:, (?:\d{4,5} )?\p{Lu}\p{L}+)?")
INTRO = regex.compile(rf"(?i:\b{NAME_CUES})\s+")
TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}'’\-]*")
KEY = ("tab_name", "row_key", "field")
KEYS = ", ".join(f"{k} string" for k in KEY)
MENTIONS = f"{KEYS}, start long, end long, kind string, inst string, l string, r string, cue string"
PARTNER, TRUSTED = 0.6, 3
#: What a pattern that speaks against a class leaves of it, and the share of an instance's mentions that must be of a
#: class for a cue alone to tell it.
PATTERN_FLOOR, CUE_SHARE = 0.1, 0.15
#: Numbers of up to so many characters (counts, years, marks) have patterns apart from longer ones.
SHORT_NUMBER = 4


def fields(goldset: DataFrame, answers: DataFrame) -> DataFrame:
    """``tab_name, row_key, field, text``: the fields to search, each distinct text of a row once; nulls are left out."""
    q = goldset.select(F.lit("goldset").alias("tab_name"), F.col("qid").alias("row_key"), F.lit("question").alias("field"), F.col("question").alias("text"))
    a = answers.select(F.lit("answers").alias("tab_name"), F.col("answer_id").cast("string").alias("row_key"), F.explode(F.array(F.struct(F.lit("question").alias("field"), F.col("question").alias("text")), F.struct(F.lit("text").alias("field"), F.col("text").alias("text")))).alias("x")).select("tab_name", "row_key", "x.field", "x.text")
    return q.unionByName(a).where("text is not null and text <> ''").distinct()


class Words:
    """The words of a text with their places, for the words around a mention."""

    def __init__(self, text: str):
        self.text = text
        found = list(WORD.finditer(text))
        self.words = [m.group(0).lower() for m in found]
        self.starts, self.ends = [m.start() for m in found], [m.end() for m in found]

    def around(self, start: int, end: int) -> tuple[str, str]:
        """The two words before and the two after a place, digits masked."""
        i, j = bisect.bisect_right(self.ends, start), bisect.bisect_left(self.starts, end)
        mask = lambda words: " ".join("0" if w.isdigit() else w for w in words)
        return mask(self.words[max(0, i - 2) : i]) or "^", mask(self.words[j : j + 2]) or "$"

    def cue(self, start: int, end: int) -> str:
        """The kind that a phrase after the place or one of the three words before it (in its sentence) tells."""
        j = bisect.bisect_left(self.starts, end)
        after = " ".join(self.words[j : j + 4])
        for kind, phrases in AFTER.items():
            if any(p in after for p in phrases):
                return kind
        i, left = bisect.bisect_right(self.ends, start), 3
        while i > 0 and left:
            i -= 1
            w = self.words[i]
            ends = SENTENCE if w in (".", "?", "!") else CAPITAL if w[-1] == "." and w.rstrip(".") not in _CUE_OF else None
            if w in ("\n", "|") or ends and ends.match(self.text, self.ends[i]):
                break
            if w[0].isalpha():
                left -= 1
                bare = regex.split(r"['’]", w.rstrip("."))[-1]
                if bare in _CUE_OF:
                    return _CUE_OF[bare]
        return ""


_CUE_OF = {w: k for k, words in CUES.items() for w in words.split()}
CAPITAL, SENTENCE = regex.compile(r"\s+\p{Lu}"), regex.compile(r"\s+[\p{Lu}\d(+]")


def emails(text: str) -> list[regex.Match]:
    """E-mail addresses; texts without any form of the sign are passed over at once."""
    low = text.lower()
    return list(EMAIL.finditer(text)) if "@" in low or "(at)" in low or "[at]" in low else []


def _street(m: regex.Match) -> str:
    return next(v for k in ("t1", "t2", "t3", "t4", "t5", "t6") if (v := m[k])).lower().strip(".")


def _mail_form(piece: str) -> str:
    return "m:" + regex.sub(r"[\w+\-]+(?:\.(?=\w+(?:@| ?[(\[]at))[\w+\-]+)*", "x", regex.sub(r"[(\[](at|dot)[)\]]", lambda m: {"at": "(@)", "dot": "(.)"}[m[1].lower()], piece, flags=regex.I)).replace(".x.x", ".x")


def typed_mentions(text: str) -> Iterator[tuple[int, int, str]]:
    """E-mail addresses, numbers and forms of street addresses: start, end, instance (the form of an e-mail address, the
    shape of a number, or the word of a street). Numbers in e-mail addresses are none of their own."""
    taken: list[tuple[int, int]] = []
    for m in emails(text):
        taken.append(m.span())
        yield m.start(), m.end(), _mail_form(m.group(0))
    for m in ADDRESS.finditer(text):
        if all(m.end() <= a or m.start() >= b for a, b in taken):
            yield m.start(), m.end(), "w:" + _street(m)
    for m in NUMBER.finditer(text):
        if all(m.end() <= a or m.start() >= b for a, b in taken):
            yield m.start(), m.end(), regex.sub(r"[A-Z]", "A", regex.sub(r"\d", "0", m.group(0)))


def name_mentions(text: str) -> Iterator[tuple[int, int, list[str], bool]]:
    """Runs of capitalised words: start, end, words, and whether a cue introduces it."""
    intro = {m.end() for m in INTRO.finditer(text)}
    streets = [(m.start(), CITY.match(text, m.end()).end()) for m in ADDRESS.finditer(text) if _street(m) in STREET_WORDS]
    for m in NAMES.finditer(text):
        if any(a < m.end() and m.start() < b for a, b in streets):
            continue
        words = TOKEN.findall(m.group(0))
        start = m.start()
        while words and (words[0].lower() in TITLES or words[0].lower() in OPENERS) and len(words) > 1:
            nxt = text.index(words[1], start + len(words[0]))
            words, start = words[1:], nxt
        if not DIGIT_NEXT.match(text, m.end()):
            yield start, m.end(), words, start in intro or m.start() in intro


def _mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for tab, key, field, text in batch.itertuples(index=False):
            around = Words(text)
            for start, end, inst in typed_mentions(text):
                rows.append((tab, key, field, start, end, "typed", inst, *around.around(start, end), around.cue(start, end)))
            for start, end, words, cue in name_mentions(text):
                real = [w for w in words if w.lower() not in PARTICLES and len(w) > 1]
                if len(words) >= 2 and real:
                    rows.append((tab, key, field, start, end, "name", " ".join(dict.fromkeys(w.lower() for w in real)), *around.around(start, end), "name" if cue else ""))
        yield pd.DataFrame(rows, columns=["tab_name", "row_key", "field", "start", "end", "kind", "inst", "l", "r", "cue"])


def mentions(texts: DataFrame) -> DataFrame:
    """Every candidate mention, with its instance (of a name, its words) and its patterns."""
    return texts.select("tab_name", "row_key", "field", "text").mapInPandas(_mentions, MENTIONS)


def _distribution(edges: DataFrame, by: str) -> DataFrame:
    """The share of each class among the mentions of an instance, or among the instances of a pattern (where one that
    is met ten times as often counts little more), smoothed by half a mention."""
    weight = F.col("n") if by == "inst" else F.log1p("n")
    total = sum(F.sum(F.col(c) * weight) for c in CLASSES)
    return edges.groupBy(by).agg(*[((F.sum(F.col(c) * weight) + 0.5 / len(CLASSES)) / (total + 0.5)).alias(f"{by}_{c}") for c in CLASSES])


def typed_scores(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``inst, l, r, cue, found``: the class of every combination of instance and patterns. The graph is kept as distinct
    edges with counts, so its size follows the variety of the text, not its amount; it is written after every round.
    Edges with a cue, of a seed word of streets or of the seed form of e-mail addresses keep their class; all others
    get what their instance and patterns are in all places together, among the classes possible for the instance. In the
    end a cue tells the class only of an instance that is of this class in some share of all its mentions."""
    edges = found.where("kind = 'typed'").groupBy("inst", "l", "r", "cue").agg(F.count("*").alias("n"))
    form = F.when(F.substring("inst", 2, 1) == ":", F.substring("inst", 1, 2)).otherwise(F.lit(""))
    possible = {c: form.isin(*[k for k, v in POSSIBLE.items() if c in v]) for c in CLASSES}
    street = (form == "w:") & F.substring(F.col("inst"), F.lit(3), F.length("inst")).isin(*STREETS.split())
    cued = F.coalesce(*[F.when((F.col("cue") == c) & possible[c] & ((form == "") | F.lit(c != "other")), F.lit(c)) for c in CLASSES])
    edges = edges.withColumn("seed", F.coalesce(F.when(street, F.lit("address")), F.when(F.col("inst") == MAIL_FORM, F.lit("email")), cued))
    group = F.when(form != "", form).when(F.length(F.regexp_replace("inst", "[^0A]", "")) <= SHORT_NUMBER, F.lit("s:")).otherwise(F.lit("n:"))
    prior = {"other": F.when(group == "s:", 0.9).when(group == "n:", 0.5).otherwise(0.6)}
    evenly = {c: prior.get(c, F.when(group == "s:", 0.05).when(group == "n:", 0.25).otherwise(0.4)) for c in CLASSES}
    start = {c: F.when(F.col("seed").isNotNull(), (F.col("seed") == c).cast("double")).when(possible[c], evenly[c]).otherwise(F.lit(0.0)) for c in CLASSES}
    # What stands around "[1]" says nothing of what stands around a long number or a street: each form has its patterns.
    patterns = [F.concat(group, F.col(x)).alias(f"{x}_pattern") for x in "lr"]
    edges = cut(edges.select("*", *patterns, F.xxhash64("inst", "l", "r", "cue").alias("edge"), *[v.alias(c) for c, v in start.items()]))
    for _ in range(rounds):
        scored = edges
        for by in ("inst", "l_pattern", "r_pattern"):
            scored = salted_join(scored, cut(_distribution(edges, by)), [by], "edge")
        raw = {c: F.when(possible[c], F.col(f"inst_{c}") * (PATTERN_FLOOR + F.sqrt(F.col(f"l_pattern_{c}") * F.col(f"r_pattern_{c}")))).otherwise(F.lit(0.0)) for c in CLASSES}
        whole = sum(raw.values())
        edges = cut(scored.select("inst", "l", "r", "cue", "n", "seed", "edge", "l_pattern", "r_pattern", *[F.when(F.col("seed").isNull(), raw[c] / whole).otherwise(F.col(c)).alias(c) for c in CLASSES]))
    edges = salted_join(edges, cut(_distribution(edges, "inst")), ["inst"], "edge")
    unlike = F.col("seed").isNotNull() & (F.col("cue") != "") & (sum(F.when(F.col("seed") == c, F.col(f"inst_{c}")).otherwise(0.0) for c in CLASSES) < CUE_SHARE)
    edges = edges.withColumns({c: F.when(unlike, F.lit(float(c == "other"))).otherwise(F.col(c)) for c in CLASSES})
    best = F.greatest(*[F.col(c) for c in CLASSES])
    kind = F.coalesce(*[F.when(F.col(c) == best, F.lit(c)) for c in reversed(CLASSES)])
    return edges.select("inst", "l", "r", "cue", kind.alias("found"))


def name_words(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``word``: the words of names. A pattern's trust is the share of its mentions that hold a known name word, once
    it holds several different ones; a word's score is the mean over its mentions of what speaks for each: a cue, the
    trust of its patterns, or (weaker) a known word beside it. Words above one half are known in the next round."""
    edges = found.where("kind = 'name'").groupBy(F.col("inst").alias("words"), "l", "r").agg(F.count("*").alias("n"), F.sum(F.when(F.col("cue") != "", 1).otherwise(0)).alias("n_cue"))
    edges = cut(edges.withColumn("edge", F.xxhash64("words", "l", "r")))
    parts = cut(edges.select("edge", "l", "r", "n", "n_cue", F.explode(F.split("words", " ")).alias("word")))
    known = cut(parts.where("n_cue > 0").groupBy("word").agg(F.lit(1.0).alias("score")))
    for _ in range(rounds):
        scored = cut(salted_join(parts, known, ["word"], "edge", "left").withColumn("s", F.coalesce("score", F.lit(0.0))))
        whole = cut(scored.groupBy("edge", "l", "r").agg(F.max("n").alias("n"), F.sum("s").alias("total"), F.max("s").alias("top")))
        trust = []
        for by in ("l", "r"):
            share = F.sum(F.when(F.col("top") > 0.5, F.col("n")).otherwise(0)) / (F.sum("n") + 0.5)
            trust.append(cut(whole.groupBy(by).agg(F.when(F.sum(F.when(F.col("top") > 0.5, 1).otherwise(0)) >= TRUSTED, share).otherwise(F.lit(0.0)).alias(f"{by}_trust"))))
        rows = scored.join(whole.select("edge", "total"), "edge")
        rows = salted_join(salted_join(rows, trust[0], ["l"], "edge"), trust[1], ["r"], "edge")
        beside = F.when(F.col("total") - F.col("s") > 0.5, F.lit(PARTNER)).otherwise(F.lit(0.0))
        worth = F.greatest(F.col("n_cue"), F.col("n") * F.greatest(F.col("l_trust") * F.col("r_trust"), 0.8 * F.col("l_trust"), 0.8 * F.col("r_trust"), beside))
        known = cut(rows.groupBy("word").agg((F.sum(worth) / F.sum("n")).alias("score"), F.sum("n").alias("n")).where("score > 0.5").select("word", "score"))
    return known.where(f"score > {PARTNER}").select("word")


def _find_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for tab, key, field, text, words in batch.itertuples(index=False):
            for start, end in names_in(text, {w.lstrip("~") for w in words}, {w for w in words if w[0] != "~"}):
                rows.append((tab, key, field, start, end))
        yield pd.DataFrame(rows, columns=["tab_name", "row_key", "field", "start", "end"])


STEP = regex.compile(r"(?:\.? |, |,)")


def names_in(text: str, known: set[str], strong: set[str]) -> list[tuple[int, int]]:
    """Where names start and end: runs of at least two words, one of them possibly an initial, that are known name words, in
    any case, joined by particles, or what a cue introduces. One word at least must be strong, that is, not common as
    an ordinary word; ordinary words only count when capitalised."""
    mails = [m.span() for m in emails(text)]
    tokens = [(m.start(), m.end(), m.group(0)) for m in TOKEN.finditer(text)]
    starts, i = [], 0
    usable = lambda w: w.lower() in strong or (w.lower() in known and w[0].isupper())
    while i < len(tokens):
        s, e, w = tokens[i]
        inside = any(a <= s < b for a, b in mails)
        initial = len(w) == 1 and w.isupper() and text[e : e + 2] == ". "
        if inside or not (w.lower() in known and (w.lower() in strong or w[0].isupper()) or initial):
            i += 1
            continue
        j, full, last, solid = i, 0 if initial else 1, e, w.lower() in strong
        k = i + 1
        while k < len(tokens):
            ks, ke, kw = tokens[k]
            gap = text[last:ks]
            low = kw.lower()
            if not STEP.fullmatch(gap):
                break
            if usable(kw):
                full, last, j, solid = full + 1, ke, k, solid or low in strong
            elif len(kw) == 1 and kw.isupper() and text[ke : ke + 1] == "." or low in PARTICLES and k + 1 < len(tokens):
                last = ke
                if "," in gap and not (len(kw) == 1):
                    break
            else:
                break
            k += 1
        if solid and (full >= 2 or (initial and full >= 1)):
            starts.append((s, tokens[j][1]))
        i = j + 1
    for m in INTRO.finditer(text):
        n = regex.compile(rf"{NAME}(?:\.? (?:(?:van|von|der|den|de|di|da|del|la|le|du) )*{NAME})+").match(text, m.end())
        if n:
            first = TOKEN.match(n.group(0))
            at = m.end()
            if first and first.group(0).lower() in TITLES:
                at += len(first.group(0)) + len(regex.match(r"[.\s]*", n.group(0)[first.end() :]).group(0))
            if not any(abs(a - at) < len(n.group(0)) for a, _ in starts):
                starts.append((at, n.end()))
    return starts


def pieces(texts: DataFrame) -> DataFrame:
    """``tab_name, row_key, field, kind, start, end`` of every piece of personal information in ``texts``
    (:func:`fields`). What stands inside a street address (its numbers, and capitalised words) is no piece of its own,
    and a word of names is no word of a street."""
    texts = cut(texts)
    found = cut(mentions(texts))
    typed = salted_join(found.where("kind = 'typed'").drop("kind"), cut(typed_scores(found).withColumnRenamed("found", "kind")), ["inst", "l", "r", "cue"], "row_key", row_bytes=160).where("kind <> 'other'")
    words = cut(name_words(found))
    streets = typed.where("kind = 'address'").withColumn("word", F.expr("substring(inst, 3)"))
    streets = salted_join(streets, words.withColumn("name", F.lit(True)), ["word"], "row_key", "left").where("name is null").select(*KEY, "kind", "start", "end")
    typed = typed.where("kind <> 'address'").select(*KEY, "kind", "start", "end").unionByName(streets)
    tokens = texts.select(*KEY, F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace("text", MAIL, " "), F.lit(r"\p{L}[\p{L}\p{M}'’\-]*"), F.lit(0)))).alias("token")).withColumn("word", F.lower("token"))
    used = cut(salted_join(tokens, words, ["word"], "row_key"))
    common = cut(used.groupBy("word").agg(F.avg((F.col("token") == F.col("word")).cast("int")).alias("plain")))
    used = salted_join(used, common, ["word"], "row_key").withColumn("word", F.when(F.col("plain") > 0.3, F.concat(F.lit("~"), "word")).otherwise(F.col("word")))
    cued = texts.where(F.col("text").rlike("(?iU)" + NAME_CUES)).select(*KEY, F.lit(None).cast("string").alias("word"))
    keys = used.select(*KEY, "word").unionByName(cued).groupBy(*KEY).agg(F.collect_set("word").alias("words"))
    names = texts.join(keys, list(KEY)).select(*KEY, "text", "words").mapInPandas(_find_names, f"{KEYS}, start long, end long")
    every = typed.unionByName(names.select(*KEY, F.lit("name").alias("kind"), "start", "end"))
    # A text's pieces are bounded by its length.
    per = every.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end", "kind")).alias("all"))
    streets = F.filter("all", lambda x: x["kind"] == "address")
    free = F.filter("all", lambda x: (x["kind"] == "address") | ~F.exists("streets", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return per.withColumn("streets", streets).select(*KEY, F.explode(free).alias("x")).select(*KEY, "x.kind", "x.start", "x.end")


def personal_information(texts: DataFrame) -> DataFrame:
    """``tab_name, row_key, field, kind, start_pos`` of every piece of personal information in ``texts``."""
    return pieces(texts).select(*KEY, "kind", F.col("start").alias("start_pos")).distinct()


def redacted(texts: DataFrame) -> DataFrame:
    """``tab_name, row_key, field, text``: the texts in which something was found, each piece replaced by a placeholder
    of its type ([EMAIL], [PHONE], ...), everything else as it was. A text's pieces are bounded by its length."""
    found = pieces(texts).groupBy(*KEY).agg(F.collect_set(F.struct("start", "end", "kind")).alias("pieces"))

    @F.pandas_udf(T.StringType())
    def mask(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([masked(t, [(int(p["start"]), int(p["end"]), p["kind"]) for p in f]) for t, f in zip(text, found, strict=True)], dtype=object)

    return texts.join(found, list(KEY)).select(*KEY, mask("text", "pieces").alias("text"))


EXTENSION = regex.compile(r" ?(?:ext\.?|x|#) ?\d+")
REST = regex.compile(r",? (?:flat|apt\.?|unit|кв\.|д\.|#)[ ]?\d+\w?|, \d+º? ?\w?\b", regex.I)


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with pieces replaced; what belongs to a piece behind its end (an extension, a flat) goes with it."""
    out, last = [], 0
    for start, end, kind in sorted(found):
        if start >= last:
            tail = {"phone": EXTENSION, "address": REST}.get(kind)
            while tail and (more := tail.match(text, end)):
                end = more.end()
            out += [text[last:start], f"[{kind.upper()}]"]
            last = end
    return "".join([*out, text[last:]])
