"""Broken question-answer pairs (problem 7): ordered rules, every triggered defect is emitted.

empty and copies_question are read off the pair itself. The other rules use statistics of the whole table, all of them
rates over pairs, so that a verdict does not depend on how much text there is: refusal adds to phrases of
refusing what recurs in the answers that use them; other_language compares scripts first and then letter n-gram
profiles learnt from the table; truncated asks how often sentences end where an answer without a terminator breaks off."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternq.llm.contamination import A, WordHashes, mixed
from lanternq.plans.scale import cut, salted_join

#: An answer without a terminator breaks off where fewer than this share of sentences end.
END_SHARE = 0.05
#: The share of sentences that end with a word never met in a complete one, and the weight (in sentences) with which a
#: shorter context vouches for a longer one.
UNKNOWN_END, WEIGHT = 0.01, 2.0
#: The share of words at which a sentence ends at all: what is expected of a word that has been met.
MET_END = 0.08
#: Contexts of an ending, and the number of words up to which an answer is a short one.
CONTEXTS, SHORT_WORDS = 7, 6
#: Language profiles and the words of refusals are tables of fixed size: 2 ** BITS hashed features.
BITS = 16
#: How much likelier (natural logarithm) another language must be than that of the question, and the odds a learnt refusal must reach.
LANGUAGE_ODDS, REFUSAL_ODDS = 4.0, 4.0
#: A text seeds the profile of a language whose common words are ahead by this share of its words.
SEED_LEAD = 0.1

#: Contents that say nothing.
FILLERS = frozenset(("null", "none", "nil", "nan", "na", "n a", "tbd", "tba", "todo", "undefined", "empty", "pending", "blank", "x", "xx", "xxx", "k a", "s o", "n d", "нд", "н д", "no data", "not available", "missing", "placeholder", "lorem ipsum"))

#: Phrases by which answers decline, by language.
REFUSALS = {
    "en": r"(?:i['’]?m|i am|we are|we['’]re) (?:sorry|afraid),? (?:but )?(?:i|we) (?:can['’]?t|cannot|am not able|are not able|won['’]?t)|\b(?:can['’]?t|cannot|can not|could not|unable to|not able to) (?:help|assist|answer|respond|comment|discuss|advise|provide (?:guidance|advice|an answer|help|assistance|information)|offer (?:guidance|advice|help)|share that|give (?:advice|an answer|guidance)|say anything|be of help)|must (?:decline|refuse|reject)|have to (?:decline|refuse)|(?:i|we) (?:decline|refuse)\b|rather not (?:respond|answer|say|comment|discuss)|prefer not to|not something (?:i|we) can (?:discuss|answer|help)|(?:outside|beyond) (?:of )?(?:my|our) (?:remit|scope|competence|area)|answer is withheld|no comment on|(?:do|does|will) not comment|not be right for me|no answer (?:can|will) be given|not built to|going to pass\b|(?:not|n['’]t) (?:allowed|permitted|authori[sz]ed) to (?:answer|discuss|speak|talk|help|comment|advise)|(?:do|does|did)(?:n['’]t| not) (?:let|allow|permit) (?:me|us)\b|(?:prevents?|keeps?|stops?|forbids?) (?:me|us) (?:from|to)\b|outside what (?:i|we)\b|(?:i|we) (?:won['’]?t|will not) (?:answer|discuss|be answering|respond|comment|help)",
    "de": r"nicht (?:weiter)?(?:helfen|beantworten|äußern|aeussern)|ablehnen|keine auskunft|keine antwort geben|(?:kann|darf|möchte|werde|will) (?:ich|wir)(?: \p{L}+){0,6} (?:nichts?|keine)(?: \p{L}+){0,3} (?:sagen|antworten|geben|beantworten|sprechen|machen|raten)|nicht in der lage|außerhalb mein|nicht (?:befugt|berechtigt|erlaubt|gestattet)|verweiger|nicht zuständig|kein kommentar",
    "fr": r"ne (?:peux|puis|pouvons|saurais|souhaite|suis) pas (?:(?:vous|y|en|me) )*(?:répondre|aider|autorisé|parler|prononcer|conseiller|renseigner|en mesure|commenter|habilité)|sort de mon cadre|(?:doit|dois)(?: \p{L}+){0,2} (?:être refusée?|refuser|décliner)|impossible de (?:vous )?(?:aider|répondre|renseigner)|préfère ne pas|m['’]abst|sans commentaire|pas le droit d[e'’]|décline (?:cette|votre)|hors de mon domaine|pas de commentaire",
    "es": r"no (?:puedo|podemos|me es posible|me está permitido|tengo permitido|estoy autorizad[oa]|soy capaz de|estoy en condiciones de)(?: \p{L}+){0,3} ?(?:ayudar\p{L}*|responder\p{L}*|hablar|opinar|contestar\p{L}*|decir\p{L}*|comentar|aconsejar\p{L}*|asesorar\p{L}*|orientar\p{L}*)|(?:debo|tengo que) (?:rechazar|declinar)|prefiero no|fuera de mi ámbito|sin comentarios|no (?:debo|voy a) (?:responder|contestar|opinar|hablar)|me abstengo",
    "it": r"non (?:posso|possiamo|mi è (?:possibile|permesso|consentito)|sono (?:autorizzat[oa]|in grado)|saprei|ho il permesso)(?: \p{L}+){0,3} ?(?:aiutar\p{L}*|risponder\p{L}*|parlar\p{L}*|esprimer\p{L}*|dire|commentare|consigliar\p{L}*|discutere)|(?:devo|debbo) (?:rifiutare|declinare|respingere)|preferisco non|fuori dal mio|esula dal|nessun commento|mi astengo",
    "pt": r"não (?:posso|podemos|me é (?:permitido|possível)|estou (?:autorizad[oa]|em condições)|consigo|tenho permissão|sou capaz de|devo)(?: \p{L}+){0,3} ?(?:ajudar|responder|falar|comentar|pronunciar|opinar|dizer|aconselhar|orientar)|(?:tenho de|devo|preciso de|tenho que) (?:recusar|rejeitar|declinar)|prefiro não|fora do meu âmbito|sem comentários|abstenho",
    "ru": r"не (?:могу|можем|вправе|имею права|уполномочен|стану|буду|готов|в состоянии)(?: \p{L}+){0,3} ?(?:помочь|ответить|отвечать|комментировать|сказать|обсуждать|говорить|советовать|консультировать)|(?:отвечать|говорить|обсуждать|комментировать)(?: \p{L}+){0,3} (?:нельзя|не могу|не буду|запрещено)|сказать не могу|помочь не могу|ответить не могу|отклонить|отказать|предпочитаю не|воздержусь|вне моей компетенции|выходит за рамки|без комментариев",
}

#: Common words that tell the languages apart.
COMMON = {
    "en": "the of and is it that with for on you not this to in are how what does when why where can long my should will from only its has than before after your",
    "de": "der die das und ist nicht sie den dem ein eine mit auf wenn wie was von zu im des bei nach oder warum wird kann muss sich dass es darf etwa aus bis noch nur",
    "fr": "le la les des est et que vous une un dans pour du avec sur pas au en ce qui par quand pourquoi il après ne se sans votre faut où faire aux cette cas à",
    "es": "el los las que por del una con para está es un en su se la no cuando más qué y sin al lo después antes cómo como hay casi si tras sobre desde muy",
    "it": "il della che non una per si gli nel di e è la un con del dopo quando più perché alla su cosa fare se dal prima come poi sono delle al dei i nella",
    "pt": "o os da do que não uma em se para ao um com é na no e as dos das pelo depois quando por mais antes como está de sem até à porque há nas nos muito",
    "ru": "и в не на что если с по как для это при у из от до после когда же чтобы почему или его можно только за под к о так",
}
LANGUAGES = tuple(COMMON)
_COMMON = {k: frozenset(v.split()) for k, v in COMMON.items()}
_REFUSAL = {k: regex.compile(v, regex.I) for k, v in REFUSALS.items()}
#: Scripts with a profile of their own; a text in any other script is in the language of that script.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai", "Armenian", "Georgian")
_SCRIPT = [(s, regex.compile(rf"\p{{Script={s}}}")) for s in SCRIPTS]

_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_QUOTED = regex.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_TAGS = regex.compile(r"<[^<>]*>|&(?:[a-zA-Z]+\d*|#\d+|#[xX][0-9a-fA-F]+);|[\p{Cf}\p{Cc}]")
_DIGITS = regex.compile(r"\d+")
_SENTENCE = regex.compile(r"[^.!?…]*(?:[.!?…](?!\s|['\"”»’)\]*_`]*(?:\s|$))[^.!?…]*)*(?:[.!?…]+|$)")
_CLOSED = regex.compile(r"[.!?…]['\"”»’)\]*_`]*$")
_ELLIPSIS = regex.compile(r"(?:…|\.(?:\s?\.)+)$")
_DANGLING = regex.compile(r"(?:[,;:(\[{«“„—–=+]|(?:^|\s)(?:\d{1,2}\)|[-*•])|(?:^|[.!?…:;]\s+)\d{1,2}\.)$")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def masked(text: str) -> list[str]:
    return words_of(_DIGITS.sub("0", text))


def content(answer: str | None) -> str:
    """An answer without tags, character entities and invisible characters."""
    return " ".join(_TAGS.sub(" ", answer).split()) if answer else ""


# --- languages ---------------------------------------------------------------------------------------------------------


def script_of(text: str | None) -> str:
    """The script of most letters; texts in quotes don't count."""
    letters = "".join(_LETTERS.findall(_QUOTED.sub(" ", text))) if text else ""
    if not letters:
        return ""
    if letters.isascii():
        return "Latin"
    counts = []
    for script, pattern in _SCRIPT:
        counts.append((len(pattern.findall(letters)), script))
        if 2 * counts[-1][0] > len(letters):
            break
    return max(counts)[1] if max(counts)[0] else "other"


def common_language(text: str | None) -> tuple[str, float]:
    """The language most of a text's common words belong to, and by what share of its words more than the next."""
    words = [w.lower() for w in _LETTERS.findall(_QUOTED.sub(" ", text))] if text else []
    hits = sorted(((sum(w in v for w in words), k) for k, v in _COMMON.items()), reverse=True)
    return (hits[0][1], (hits[0][0] - hits[1][0]) / len(words)) if hits[0][0] else ("", 0.0)


def letter_grams(text: str | None) -> np.ndarray:
    """Hashed runs of three letters (word borders are letters too) of a text without its quotes."""
    words = _LETTERS.findall(_QUOTED.sub(" ", text).lower()) if text else []
    if not words:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    acc = codes[:-2] * A
    for j in (1, 2):
        acc = (acc ^ codes[j : j + len(acc)]) * A
    return (acc >> np.uint64(64 - BITS)).astype(np.int64)


def _hashed(words: list[str], known: WordHashes) -> np.ndarray:
    return np.array([known[w] >> (64 - BITS) for w in dict.fromkeys(words)], np.int64)


def seed_refusal(text: str, lang: int | None) -> bool:
    """Whether a phrase of refusing stands in the text (of its language; of any if that is unknown)."""
    return any(p.search(text) for k, p in enumerate(_REFUSAL.values()) if lang is None or k == lang)


def _counter(first):
    """Counts of one task: n-grams by language, words by whether a seed phrase of refusing stands beside them. At first
    a text's language is that of its common words; then that of the profiles, where an answer is in the language of its
    question unless they clearly say otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = np.zeros((len(LANGUAGES) + 2, 1 << BITS), np.int64), WordHashes()
        for batch in batches:
            met: list[list[np.ndarray]] = [[] for _ in table]
            for question, answer in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                plain = content(answer)
                grams = letter_grams(question), letter_grams(plain)
                labels = first.value.languages(*grams) if first else [LANGUAGES.index(k) if lead >= SEED_LEAD else None for k, lead in map(common_language, (question, plain))]
                for g, lang in zip(grams, labels, strict=True):
                    if lang is not None:
                        met[lang].append(g)
                if plain and first:
                    met[len(LANGUAGES) + seed_refusal(plain, labels[1])].append(_hashed(masked(plain), known))
            for k, hashes in enumerate(met):
                if hashes:
                    table[k] += np.bincount(np.concatenate(hashes), minlength=1 << BITS)
        kind, bucket = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(table[kind, bucket])], ["kind", "bucket", "n"])

    return run


class Profiles:
    """Language profiles and the words of refusals, as learnt from a table; of fixed size whatever the table's."""

    def __init__(self, counts: np.ndarray):
        grams, words = counts[: len(LANGUAGES)].astype(np.float64), counts[len(LANGUAGES) :].astype(np.float64)
        self.known = grams.sum(1) > 0
        every = (grams.sum(0) + 0.5) / (grams.sum() + 0.5 * (1 << BITS))
        self.grams = np.log(0.95 * grams / np.maximum(grams.sum(1, keepdims=True), 1) + 0.05 * every).astype(np.float32).T.copy()
        whole = (words.sum(0) + 0.5) / (words.sum() + 0.5 * (1 << BITS))
        self.words = np.log((words + 20 * whole) / (words.sum(1, keepdims=True) + 20)).astype(np.float32)
        self.refusing = words[1].sum() > 0

    def languages(self, question: np.ndarray, answer: np.ndarray) -> list[int | None]:
        """The languages of both (given by their letter n-grams). That of the answer differs from that of the question
        only if LANGUAGE_ODDS say so."""
        scores = [np.where(self.known, self.grams[x].sum(0), -np.inf) if len(x) and self.known.any() else None for x in (question, answer)]
        mine = None if scores[0] is None else int(scores[0].argmax())
        if scores[1] is None:
            return [mine, None]
        his = int(scores[1].argmax())
        return [mine, his if mine is None or scores[1][his] - scores[1][mine] > LANGUAGE_ODDS else mine]

    def refusal_odds(self, h: np.ndarray) -> float:
        return float((self.words[1, h] - self.words[0, h]).sum()) - 5.0 if self.refusing and len(h) else -99.0


def learnt(pairs: DataFrame) -> Profiles:
    """Counts are added up in every task and again by feature: 9 x 2**16 numbers at most reach the driver."""
    profiles = None
    for _ in range(2):
        first = profiles and pairs.sparkSession.sparkContext.broadcast(profiles)
        counts = pairs.select("question", "answer").mapInArrow(_counter(first), "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
        table, rows = np.zeros((len(LANGUAGES) + 2, 1 << BITS), np.int64), counts.toPandas()
        table[rows["kind"], rows["bucket"]] = rows["n"]
        profiles = Profiles(table)
    return profiles


# --- the rules of a pair -----------------------------------------------------------------------------------------------


def copies_question(question: list[str], answer: list[str]) -> bool:
    """Nothing but the question again: at most three words are left when all its occurrences are taken away."""
    n = len(question)
    if not n or len(answer) < n:
        return False
    left, i, found = 0, 0, False
    while i < len(answer):
        if answer[i : i + n] == question:
            i, found = i + n, True
        else:
            i, left = i + 1, left + 1
    return found and left <= 3


def unclosed(text: str) -> bool:
    """Whether a bracket, quotation mark or code block stays open."""
    return any(text.count(a) > text.count(b) for a, b in ("()", "[]", "{}", "«»", "“”")) or text.count("```") % 2 == 1


def sentences(text: str) -> list[str]:
    """The sentences of a text, the last one possibly without a terminator."""
    return [s for m in _SENTENCE.finditer(text) if (s := m.group(0).strip())]


def context_keys(sentences_: list[list[str]], known: WordHashes) -> np.ndarray:
    """What the end of a sentence after each of its words is judged by, as hashes (words x CONTEXTS): the word, the
    word and the one before it, and one to five words together with the first two of the sentence."""
    size = np.array([len(w) for w in sentences_], np.int64)
    h = np.array([known[w] for words in sentences_ for w in words], np.uint64)
    start = np.repeat(np.cumsum(size) - size, size)
    at = np.arange(len(h)) - start
    first = mixed(h[start] * A + h[np.minimum(start + 1, start + np.repeat(size, size) - 1)])
    last = [mixed(h)]
    for k in range(1, CONTEXTS - 2):
        before = np.where(at >= k, h[np.maximum(np.arange(len(h)) - k, 0)], A)
        last.append(mixed(last[-1] * A + before))
    return np.stack([*last[:2], *(mixed(first + x) for x in last)], 1).view(np.int64)


def _short_key(word: str, n: int) -> int:
    return xxhash.xxh64_intdigest(f"{word}#{n}") - (1 << 63)


def _judge(profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt_, known = profiles.value, WordHashes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for pair, question, answer in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                text = content(answer)
                words = words_of(text)
                kinds, keys, short, mark = [], [], None, False
                if not words or " ".join(words) in FILLERS:
                    kinds.append("empty")
                else:
                    copy = copies_question(words_of(question), words)
                    if copy:
                        kinds.append("copies_question")
                    mine, his = learnt_.languages(letter_grams(question), letter_grams(text))
                    first = masked(text)
                    if not copy and (seed_refusal(text, his) or learnt_.refusal_odds(_hashed(first, known)) > REFUSAL_ODDS):
                        kinds.append("refusal")
                    scripts = script_of(question), script_of(text)
                    if all(scripts) and (scripts[0] != scripts[1] or len(words) > 1 and None not in (mine, his) and mine != his):
                        kinds.append("other_language")
                    mark = bool(_ELLIPSIS.search(text) or _DANGLING.search(text)) or unclosed(text)
                    if mark and not copy:
                        kinds.append("truncated")
                    elif not copy and len(words) > 1 and not _CLOSED.search(text):
                        last = masked(sentences(text)[-1]) or first
                        keys = context_keys([last], known)[-1].tolist()
                        short = _short_key(first[0], len(first)) if len(first) <= SHORT_WORDS else None
                for k, v in enumerate((pair, kinds, keys, short, len(words))):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.string())), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int32())], ["pair_id", "kinds", "keys", "short", "n_words"])

    return run


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every complete sentence, each context and whether the sentence ends there, added up by batch; and of every
    answer, that it has (and ends after) so many words after its first one."""
    known = WordHashes()
    for batch in batches:
        whole, keys, ends = [], [], []
        for answer in batch.column(0).to_pylist():
            text = content(answer)
            whole += [words for s in sentences(text) if _CLOSED.search(s) and not _ELLIPSIS.search(s) and (words := masked(s))]
            first = masked(text)
            for k in range(1, min(len(first), SHORT_WORDS) + 1):
                keys.append(_short_key(first[0], k))
                ends.append(k == len(first))
        if whole:
            found = context_keys(whole, known)
            last = np.zeros(len(found), bool)
            last[np.cumsum([len(w) for w in whole]) - 1] = True
            keys, ends = np.concatenate([np.array(keys, np.int64), found.ravel()]), np.concatenate([ends, np.repeat(last, CONTEXTS)])
        key, at = np.unique(np.array(keys, np.int64), return_inverse=True)
        n, f = np.bincount(at, minlength=len(key)), np.bincount(at, np.array(ends, float), minlength=len(key))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64)), pa.array(f.astype(np.int64))], ["key", "n", "n_end"])


def end_share(found: Column) -> Column:
    """The share of sentences that end in the longest context, each context vouched for by the next shorter one; a
    longer context that has been met no less often says nothing new. ``found`` is a map from position (0 the shortest)
    to ``n, n_end``."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(CONTEXTS - 1)), lambda k: F.coalesce(F.element_at(found, k), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_end"))))
    start = F.struct(F.lit(UNKNOWN_END).alias("share"), F.lit(-1).cast("long").alias("n"))

    def longer(known: Column, x: Column) -> Column:
        expected = F.when((known["n"] < 0) & (x["n"] > 0), F.lit(MET_END)).otherwise(known["share"])
        share = F.when(x["n"] == known["n"], known["share"]).otherwise((x["n_end"] + WEIGHT * expected) / (x["n"] + WEIGHT))
        return F.struct(share.alias("share"), x["n"].alias("n"))

    return F.aggregate(steps, start, longer)["share"]


def defects(pairs: DataFrame) -> DataFrame:
    """``pair_id, defect``, one row per defect of every pair (repeated exports of one pair give one case).

    A null question copies and contradicts nothing; a null answer is empty. truncated: the answer ends in an ellipsis, an
    opening sign, a comma or a list mark, leaves a bracket open, or ends without a terminator where hardly any sentence
    ends. An answer of one word is complete and told from the question's language by script alone; complete are also short
    answers of a kind that commonly ends after so many words."""
    spark: SparkSession = pairs.sparkSession
    rows = cut(pairs.select("pair_id", "question", "answer").distinct())
    profiles = spark.sparkContext.broadcast(learnt(rows))
    flags = cut(rows.mapInArrow(_judge(profiles), "pair_id long, kinds array<string>, keys array<long>, short long, n_words int"))
    asked = cut(flags.where("size(keys) > 0").select("pair_id", F.posexplode(F.concat("keys", F.array("short"))).alias("at", "key")))
    wanted = cut(asked.where("key is not null").select("key").distinct())
    ends = salted_join(rows.select("answer").where("answer is not null").mapInArrow(_endings, "key long, n long, n_end long"), wanted, ["key"], "n", row_bytes=16)
    ends = cut(ends.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end")))
    met = salted_join(asked, ends, ["key"], "pair_id", row_bytes=32).groupBy("pair_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("at", F.struct("n", "n_end"))))).alias("met"))
    open_ = asked.select("pair_id").distinct().join(met, "pair_id", "left")
    empty = F.coalesce("met", F.create_map().cast("map<int,struct<n:bigint,n_end:bigint>>"))
    whole = F.element_at("met", F.lit(CONTEXTS))
    share = F.greatest(end_share(empty), F.coalesce((whole["n_end"] - 1) / whole["n"], F.lit(0.0)))
    cut_off = open_.where(share < END_SHARE).select("pair_id", F.lit("truncated").alias("defect"))
    return flags.select("pair_id", F.explode("kinds").alias("defect")).unionByName(cut_off).distinct()
