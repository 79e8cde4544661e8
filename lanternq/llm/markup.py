"""Markup residue in texts (problem 4): parsed into a tree, recurring subtrees of a site removed, the rest made readable.

A text is parsed into one tree of the elements of the four languages. Every subtree is hashed from its leaves up; subtrees of
blocks with words are counted per site over distinct texts, and those that recur across many of its documents are deleted
as template. What remains becomes clean text in which headings (#), lists (-), tables (|), code blocks (```) and formulas ($)
can still be told apart. A document uses the languages of which something was deleted or is converted."""

from __future__ import annotations

import html
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5

import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternq.plans.scale import cut, salted_join

#: A subtree is template when it stands in at least MIN_DOCS and at least MIN_SHARE of its site's distinct texts.
MIN_DOCS, MIN_SHARE = 5, 0.05
#: Elements of HTML.
TAGS = "a|abbr|address|article|aside|b|blockquote|body|br|button|caption|center|cite|code|col|dd|del|details|div|dl|dt|em|fieldset|figcaption|figure|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|label|legend|li|link|main|mark|meta|nav|noscript|ol|option|p|pre|q|s|samp|script|section|select|small|span|strike|strong|style|sub|summary|sup|svg|table|tbody|td|textarea|tfoot|th|thead|title|tr|tt|u|ul|var|video"
VOID = frozenset("br hr img input link meta col".split())
#: Those whose subtrees may be template: blocks, not the words, links, headings, items and cells within a text.
BLOCK_TAGS = frozenset("address article aside blockquote body center details dl div fieldset figure footer form header html main nav noscript ol p pre section select table ul".split())

#: A start tag ends these where they are still open (their end tags may be left out).
ENDS = {"li": "li p", "p": "p", "dt": "dt dd p", "dd": "dt dd p", "option": "option", "td": "td th p", "th": "td th p", "tr": "td th tr p"}
ENDS |= dict.fromkeys(("thead", "tbody", "tfoot"), "td th tr thead tbody tfoot caption p") | dict.fromkeys(BLOCK_TAGS - {"p"}, "p") | {f"h{n}": "p" for n in range(1, 7)}
ENDS = {name: frozenset(ended.split()) for name, ended in ENDS.items()}

#: Quoted values may hold angle brackets.
TAG = regex.compile(rf"""<(/?)({TAGS})(?:\s(?:(?>=\s*"[^"]*"|=\s*'[^']*'|[^<>])*+|[^<>]*))?(/?)>""", regex.I)
#: Comments, tags written with entities, and character entities, each possibly escaped again.
SIGNS = regex.compile(rf"<!--|&lt;/?(?:{TAGS})(?:\s[^<>&]*)?/?&gt;|&(?:amp;)*(?P<name>#\d+|#x[0-9a-f]+|[a-z][a-z0-9]*);", regex.I)
#: Marks of wiki text and LaTeX that enclose nothing, and the brackets that nest.
WIKI = regex.compile(r"'''|^(={1,6}) ?[^=\s].*[^=\s] ?\1[ \t]*\r?$|<ref\b|(?<!')''(?!')[^'\n]+(?<!')''(?!')", regex.M)
WIKI_BRACKETS = regex.compile(r"(?P<open>\[\[|\{\{|^\{\|)|(?P<close>\]\]|\}\}|^\|\})", regex.M)
#: Links and templates of one piece, or with more brackets in what follows their name.
LINK = regex.compile(r"\[\[(?:[^\[\]\n]+\]\]|\p{L}[^\[\]\n|]*\|)")
#: A whole run of brackets. Of an odd one the first is plain text.
RUN = regex.compile(r"(?<!\[)\[+|(?<!\{)\{+")
TEMPLATE = regex.compile(r"\{\{(?:[^{}\n]+\}\}|[ \t]*\p{L}[^{}|\n]*\s*\|)")
LATEX = regex.compile(r"\\(?:item\b|\[|\()|\$[^$\n]*\\[a-zA-Z,]+[^$\n]*\$|\$\$")
LATEX_BRACES = regex.compile(r"\\begin\{(?P<begin>[^{}\n]*)\}|\\end\{(?P<end>[^{}\n]*)\}|(?P<command>\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{)|\\[{}]|(?P<brace>[{}])")
#: Marks of Markdown, each with a sign without which it cannot occur (a cheap test first).
MARKDOWN = [
    ("**", regex.compile(r"\*\*[^\s*][^*\n]*\*\*")),
    ("__", regex.compile(r"(?<!\w)__[^\s_][^_\n]*__(?!\w)")),
    ("`", regex.compile(r"`[^`\n]+`|^```", regex.M)),
    ("](", regex.compile(r"!?\[[^\]\n]*\]\([^)\s]+\)")),
    ("---", regex.compile(r"^\|?[ \t]*:?-{3,}:?[ \t]*\|", regex.M)),
    ("\n===", regex.compile(r"^[^\s|=<][^\n]*\n={3,}[ \t]*\r?$", regex.M)),
    ("\n---", regex.compile(r"^[^\s|=<][^\n]*\n-{3,}[ \t]*\r?$", regex.M)),
    ("*", regex.compile(r"(?<![\w*])\*[^\s*][^*\n]*(?<!\s)\*(?![\w*])")),
    ("~~", regex.compile(r"~~\S[^~\n]*~~")),
    ("#", regex.compile(r"^#{1,6} \S", regex.M)),
]
#: So many of them are Markdown even beside wiki marks, where lists, headings and single stars are wiki.
SOLE = 5

#: Blocks of Markdown and wiki text. Alone they are no sign of markup but for code blocks.
LINES = [
    ("```", "markdown", "code", regex.compile(r"^```.*?^```", regex.M | regex.S)),
    ("---", "markdown", "table", regex.compile(r"^[^\n|]*\|[^\n]*\n\|?[ \t]*:?-{3,}:?[ \t]*\|[^\n]*(?:\n[^\n|]*\|[^\n]*)*", regex.M)),
    ("", "markdown", "list", regex.compile(r"(?:^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+\S[^\n]*(?:\n|\Z))+", regex.M)),
    (">", "markdown", "quote", regex.compile(r"(?:^>[^\n]*(?:\n|\Z))+", regex.M)),
    ("", "wiki", "list", regex.compile(r"(?:^[*#:;]+[ \t]*[^\s*#:;][^\n]*(?:\n|\Z))+", regex.M)),
]
WORD = regex.compile(r"[\p{L}\p{N}]")


@dataclass(slots=True)
class Element:
    """A node of the tree: a piece of markup with all it encloses. Only a ``block`` (no words, links, headings, items or
    cells within a text) can be template; ``sole`` are those that are Markdown even beside wiki marks; without ``sign`` it
    is no evidence of its language. ``above`` is its parent's place in the tree, -1 at the top."""

    language: str
    start: int
    end: int
    kind: str = ""
    block: bool = False
    sole: bool = False
    sign: bool = True
    above: int = -1
    below: list[int] = field(default_factory=list)


def _html_elements(text: str) -> list[Element]:
    """Tags with what they enclose; an element that is never closed ends with its parent or where the next one ends it."""
    out, stack, still = [], [], Counter()

    def close(down_to: int, end: int) -> None:
        while len(stack) > down_to:
            name, start = stack.pop()
            still[name] -= 1
            out.append(Element("html", start, end, name, name in BLOCK_TAGS))

    for m in TAG.finditer(text) if "<" in text else ():
        name = m[2].lower()
        if not m[1] and name not in VOID and not m[3]:
            ended = ENDS.get(name, ())
            while stack and stack[-1][0] in ended:
                close(len(stack) - 1, m.start())
            stack.append((name, m.start()))
            still[name] += 1
        elif not m[1] or not still[name]:
            out.append(Element("html", m.start(), m.end(), name))
        else:
            opened = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)
            close(opened + 1, m.start())
            close(opened, m.end())
    close(0, len(text))
    for m in SIGNS.finditer(text):
        name = m["name"]
        if not name or name[0] == "#" or f"{name};" in html5 or f"{name.lower()};" in html5:
            out.append(Element("html", m.start(), m.end(), "sign"))
    return out


def _latex_elements(text: str) -> list[Element]:
    """Environments and commands with their arguments, nested; one that is never closed is a mark only."""
    out, stack, still = [Element("latex", *m.span(), "mark") for m in LATEX.finditer(text)], [], Counter()

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            name, m = stack.pop()
            still[name] -= 1
            if name != "{":
                out.append(Element("latex", *m.span(), "mark"))

    for m in LATEX_BRACES.finditer(text) if "\\" in text else ():
        if m["begin"] is not None or m["command"] or m["brace"] == "{":
            stack.append(("\\" + m["begin"] if m["begin"] is not None else m["command"] or "{", m))
            still[stack[-1][0]] += 1
        elif m["end"] is not None:
            if not still["\\" + m["end"]]:
                out.append(Element("latex", *m.span(), "mark"))
                continue
            close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "\\" + m["end"] and stack[k][1]["begin"] is not None) + 1)
            name, opened = stack.pop()
            still[name] -= 1
            out.append(Element("latex", opened.start(), m.end(), "environment", block=True))
        elif m["brace"] and stack and stack[-1][1]["begin"] is None:
            name, opened = stack.pop()
            still[name] -= 1
            if name != "{":
                out.append(Element("latex", opened.start(), m.end(), "command"))
    close(0)
    return out


def _wiki_elements(text: str, arguments: set[int]) -> list[Element]:
    """Links, templates and tables, nested, and the other marks. A brace in ``arguments`` belongs to a LaTeX command."""
    out, stack, still = [Element("wiki", *m.span(), "mark") for m in WIKI.finditer(text)], [], Counter()
    shut = {"]]": "[[", "}}": "{{", "|}": "{|"}
    at = 0
    while m := WIKI_BRACKETS.search(text, at):
        at = m.end()
        if m["open"]:
            run = RUN.match(text, pos=m.start())
            if m["open"] != "{|" and ((run and len(run[0]) % 2) or m.start() in arguments):
                at = m.start() + 1
                continue
            stack.append((m["open"], m.start()))
            still[m["open"]] += 1
            if m["open"] == "{|":
                out.append(Element("wiki", *m.span(), "mark"))
        elif still[shut[m["close"]]]:
            name = ""
            while name != shut[m["close"]]:
                name, start = stack.pop()
                still[name] -= 1
            if name == "[[":
                if LINK.match(text, pos=start):
                    out.append(Element("wiki", start, at, "link"))
            elif name == "{|" or TEMPLATE.match(text, pos=start):
                out.append(Element("wiki", start, at, "table" if name == "{|" else "template", block=True))
    return out


def parse(text: str) -> list[Element]:
    """The tree of all elements of the four languages that a text holds, parents ahead of what they enclose."""
    out = _html_elements(text) if "<" in text or "&" in text else []
    latex = _latex_elements(text) if "\\" in text or "$$" in text else []
    if "''" in text or "[[" in text or "{" in text or "=" in text or "<ref" in text:
        out += _wiki_elements(text, {m.end() - 1 for m in LATEX_BRACES.finditer(text) if m["command"]} if latex else set())
    out += latex
    for k, (sign, pattern) in enumerate(MARKDOWN):
        if sign in text:
            out += [Element("markdown", *m.span(), "mark", sole=k < SOLE) for m in pattern.finditer(text)]
    signs = {e.language for e in out} - ({"wiki"} if any(e.sole for e in out) else set())  # beside Markdown, # is no list
    for sign, language, kind, pattern in LINES:
        if sign in text and (kind == "code" or language in signs):
            out += [Element(language, *m.span(), kind, block=True, sole=True, sign=kind == "code") for m in pattern.finditer(text)]
    out.sort(key=lambda e: (e.start, -e.end))
    open_: list[int] = []
    for k, e in enumerate(out):
        while open_ and out[open_[-1]].end <= e.start:
            open_.pop()
        e.above = next((j for j in reversed(open_) if out[j].end >= e.end), -1)
        if e.above >= 0:
            out[e.above].below.append(k)
        open_.append(k)
    return out


def has_wiki(tree: list[Element]) -> bool:
    return any(e.language == "wiki" and e.sign for e in tree)


def used(found: list[Element], wiki: bool) -> list[str]:
    """The languages of elements. Beside wiki marks anywhere in the text, lists, headings and single stars are wiki, too."""
    return sorted({e.language for e in found if e.sign and (e.language != "markdown" or e.sole or not wiki)})


def languages(text: str) -> list[str]:
    """The markup languages a text uses: any of html, latex, markdown, wiki."""
    tree = parse(text)
    return used(tree, has_wiki(tree))


def subtree_keys(text: str, tree: list[Element]) -> dict[int, int]:
    """The hash of the subtree of each block with words of its own, by its place in the tree. A hash is made of the
    element's kind, its words and the hashes of what it encloses, from the leaves up; attributes, white space and case are
    ignored, digits are not."""
    if not any(e.block for e in tree):
        return {}
    keys, words = [0] * len(tree), [False] * len(tree)
    for k in range(len(tree) - 1, -1, -1):
        e, parts, last = tree[k], [], tree[k].start
        for j in [*e.below, None]:
            piece = text[last : e.end if j is None else max(last, tree[j].start)]
            piece = " ".join(TAG.sub(" ", piece).lower().split()) if e.language == "html" and e.kind != "sign" else " ".join(piece.lower().split())
            parts.append(piece)
            words[k] = words[k] or (e.kind != "sign" and bool(WORD.search(piece)))
            if j is not None:
                parts.append(f"\x1f{keys[j]}\x1f")
                words[k] = words[k] or words[j]
                last = max(last, tree[j].end)
        keys[k] = xxhash.xxh64_intdigest(f"{e.language} {e.kind}\x1e" + "".join(parts)) - (1 << 63)
    return {k: keys[k] for k, e in enumerate(tree) if e.block and words[k]}


def pieces(text: str) -> tuple[list[str], list[tuple[int, int, list[str]]]]:
    """What a text's tree comes to: the languages of the elements outside all blocks, and of each block its subtree's hash,
    the place among these of the block around it (-1: none), and the languages of the elements in it and in no block below."""
    tree = parse(text)
    keys, wiki = subtree_keys(text, tree), has_wiki(tree)
    places, around, inside = {k: n for n, k in enumerate(keys)}, [-1] * len(tree), [[] for _ in range(len(keys) + 1)]
    for k, e in enumerate(tree):
        around[k] = k if k in keys else around[e.above] if e.above >= 0 else -1
        inside[places.get(around[k], -1)].append(e)
    blocks = [(keys[k], places.get(around[tree[k].above], -1) if tree[k].above >= 0 else -1, used(inside[n], wiki)) for k, n in places.items()]
    return used(inside[-1], wiki), blocks


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, blocks = [], []
        for text in batch.column(3).to_pylist():
            languages_, found = pieces(text) if text else ([], [])
            own.append(languages_)
            blocks.append([{"subtree": key, "above": above, "markups": names} for key, above, names in found])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.list_(pa.string())), pa.array(blocks, BLOCK_LIST)], ["doc_id", "source", "text_hash", "own", "blocks"])


BLOCK_LIST = pa.list_(pa.struct([("subtree", pa.int64()), ("above", pa.int32()), ("markups", pa.list_(pa.string()))]))


def text_hash() -> Column:
    """The same for copies of a text that differ in nothing but case, punctuation and white space."""
    return F.xxhash64(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", ""))


def parsed(docs: DataFrame) -> DataFrame:
    """``doc_id, source, text_hash, own, blocks`` of every document; see :func:`pieces`."""
    return docs.select("doc_id", "source", text_hash().alias("text_hash"), "text").mapInArrow(_parse, "doc_id long, source string, text_hash long, own array<string>, blocks array<struct<subtree: long, above: int, markups: array<string>>>")


def template_subtrees(parses: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """``source, subtree`` of recurring subtrees. Counting is over distinct texts, partial before the shuffle."""
    sited = parses.where("source is not null")
    each = sited.select("source", "text_hash", F.explode("blocks.subtree").alias("subtree")).distinct()
    counts = each.groupBy("source", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    sizes = sited.select("source", "text_hash").distinct().groupBy("source").agg(F.count("*").alias("docs"))
    return counts.join(sizes, "source").where(F.col("n") >= F.col("docs") * F.lit(min_share)).select("source", "subtree")


def _divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The languages of the elements that are deleted with a template's subtree, and of those that are left to convert."""
    for batch in batches:
        deleted, converted = [], []
        for own, blocks, template in zip(*(batch.column(k).to_pylist() for k in (2, 3, 1)), strict=True):
            drop, out, left, gone = set(template or ()), set(), set(own), []
            for block in blocks:
                gone.append(block["subtree"] in drop or (block["above"] >= 0 and gone[block["above"]]))
                (out if gone[-1] else left).update(block["markups"])
            deleted.append(sorted(out))
            converted.append(sorted(left))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(deleted, pa.list_(pa.string())), pa.array(converted, pa.list_(pa.string()))], ["doc_id", "template", "deleted", "converted"])


def marked_documents(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """``doc_id, template, deleted, converted`` of every document with markup: its template subtrees, and the languages of
    what is deleted with them and of what is left to convert."""
    parses = cut(parsed(docs))
    template = cut(template_subtrees(parses, min_docs, min_share))
    marked = parses.where((F.size("own") > 0) | (F.size("blocks") > 0))
    hits = salted_join(marked.select("doc_id", "source", "text_hash", F.explode("blocks.subtree").alias("subtree")), template, ["source", "subtree"], "doc_id")
    drops = hits.groupBy("doc_id", "source", "text_hash").agg(F.collect_set("subtree").alias("template"))
    return marked.join(drops, ["doc_id", "source", "text_hash"], "left").select("doc_id", "template", "own", "blocks").mapInArrow(_divide, "doc_id long, template array<long>, deleted array<string>, converted array<string>")


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents with ``markups`` (empty if none) and ``clean_text``; every other column stays. Texts without
    markup are passed through as they are, null texts stay null."""

    @F.pandas_udf(T.StringType())
    def convert(text: pd.Series, markups: pd.Series, template: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or m is None or len(m) == 0 else to_plain(t, list(m), set() if d is None else set(d)) for t, m, d in zip(text, markups, template, strict=True)], dtype=object)

    marked = marked_documents(docs).dropDuplicates(["doc_id"]).select("doc_id", F.array_sort(F.array_union("deleted", "converted")).alias("_m"), F.col("template").alias("_t"))
    out = docs.join(marked, "doc_id", "left")
    return out.withColumn("markups", F.coalesce("_m", F.array().cast("array<string>"))).withColumn("clean_text", convert("text", "_m", "_t")).drop("_m", "_t")


def markup_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, markup``: one row for each language of which a document's cleaning deletes or converts an element."""
    return marked_documents(docs).select("doc_id", F.explode(F.array_union("deleted", "converted")).alias("markup")).distinct()


def without(text: str, template: set[int]) -> str:
    """The text without the outermost subtrees whose hash is in ``template``."""
    last, out = 0, []
    tree = parse(text)
    for k, key in sorted(subtree_keys(text, tree).items()):
        if tree[k].start >= last and key in template:
            out.append(text[last : tree[k].start])
            last = tree[k].end
    return "".join([*out, text[last:]])


def to_plain(text: str, markups: list[str], template: set[int] | None = None) -> str:
    """Clean text of a marked-up one. The conversion is idempotent on texts without markup."""
    if template:
        text = without(text, template)
    if "html" in markups:
        text = _from_html(text, "wiki" in markups)
    if "latex" in markups:
        text = _from_latex(text)
    if "wiki" in markups:
        text = _from_wiki(text)
    if "markdown" in markups:
        text = _from_markdown(text)
    return regex.sub(r"\n{3,}", "\n\n", regex.sub(r"[ \t]+$", "", text, flags=regex.M)).strip()


def _from_html(text: str, wiki: bool) -> str:
    while regex.search(r"&(?:amp;)+(?:lt|gt|\w+);", text, regex.I):
        text = regex.sub(r"&amp;", "&", text, flags=regex.I)
    text = TAG.sub(r"<\1\2>", regex.sub(r"&lt;", "<", regex.sub(r"&gt;", ">", text, flags=regex.I), flags=regex.I))
    text = regex.sub(r"<!--.*?(?:-->|$)", "", text, flags=regex.S)
    text = regex.sub(r"<(script|style|noscript)\b.*?</\1\s*>", "", text, flags=regex.S | regex.I)
    text = regex.sub(r"<pre\b[^>]*>(?:\s*<code\b[^>]*>)?(.*?)(?:</code>\s*)?</pre>", r"\n```\n\1\n```\n", text, flags=regex.S | regex.I)
    text = regex.sub(r"<h([1-6])\b[^>]*>\s*", lambda m: "\n" + "#" * int(m[1]) + " ", text, flags=regex.I)
    text = regex.sub(r"[ \t]*<li\b[^>]*>\s*", "\n- ", text, flags=regex.I)
    text = regex.sub(r"</t[dh]>\s*<t[dh]\b[^>]*>", " | ", text, flags=regex.I)
    text = regex.sub(r"<t[dh]\b[^>]*>", "| ", text, flags=regex.I)
    text = regex.sub(r"</t[dh]>", " |", text, flags=regex.I)
    text = regex.sub(rf"</?(?:p|div|br|hr|ul|ol|dl|dt|dd|table|tr|thead|tbody|h[1-6]|section|article|blockquote|header|footer|nav|form|li)\b[^<>]*>", "\n", text, flags=regex.I)
    text = TAG.sub("", text)
    return html.unescape(text)


def _from_latex(text: str) -> str:
    text = regex.sub(r"\\begin\{(?:verbatim|lstlisting)\*?\}(.*?)\\end\{(?:verbatim|lstlisting)\*?\}", r"\n```\1```\n", text, flags=regex.S)
    for depth, name in enumerate(("chapter", "section", "subsection", "subsubsection", "paragraph"), 1):
        text = regex.sub(rf"\\{name}\*?\{{([^{{}}]*)\}}", "\n" + "#" * max(1, depth - 1) + r" \1\n", text)
    text = regex.sub(r"\\(?:begin|end)\{\w+\*?\}(?:\[[^\]]*\]|\{[^{}]*\})?", "", text)
    text = regex.sub(r"[ \t]*\\item\b(?:\[[^\]]*\])?\s*", "- ", text)
    text = regex.sub(r"\\\[\s*(.*?)\s*\\\]", r"$$\1$$", text, flags=regex.S)
    text = regex.sub(r"\\\(\s*(.*?)\s*\\\)", r"$\1$", text, flags=regex.S)
    pieces = regex.split(r"(\$\$.*?\$\$|\$[^$\n]+\$|```.*?```)", text, flags=regex.S)
    for k in range(0, len(pieces), 2):
        bare = None
        while bare != pieces[k]:
            bare, pieces[k] = pieces[k], regex.sub(r"\\(?:emph|text\w*|underline|mbox|title|caption|footnote|label|ref|cite|url)\*?\{([^{}]*)\}", r"\1", pieces[k])
        pieces[k] = regex.sub(r"(?<=\S)~(?=\S)", " ", regex.sub(r"\\([%&$#_{}])", r"\1", pieces[k]))
    return "".join(pieces)


def _from_wiki(text: str) -> str:
    text = regex.sub(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>", "", text, flags=regex.S)
    bare = None
    while bare != text:
        bare, text = text, regex.sub(r"\{\{[^{}]*\}\}", "", text)
    text = regex.sub(r"\[\[(?:Category|Kategorie|Catégorie|Categoría|Categoria|Категория|File|Image)\s*:[^\[\]]*\]\]", "", text, flags=regex.I)
    text = regex.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", text)
    text = regex.sub(r"\[https?://\S+ ([^\]]+)\]", r"\1", text)
    text = regex.sub(r"^(={1,6}) ?(.*?) ?\1[ \t]*$", lambda m: "#" * len(m[1]) + " " + m[2], regex.sub(r"^#+ ?", "1. ", text, flags=regex.M), flags=regex.M)
    text = regex.sub(r"^\*+ ?", "- ", text, flags=regex.M)
    text = regex.sub(r"^(?:\{\|.*|\|-.*|\|\})$\n?", "", text, flags=regex.M)
    text = regex.sub(r"^[|!] ?(.+)$", lambda m: "| " + regex.sub(r"\s*(?:\|\||!!)\s*", " | ", m[1]) + " |", text, flags=regex.M)
    return regex.sub(r"'{2,5}", "", text)


def _from_markdown(text: str) -> str:
    text = regex.sub(r"^([^\s|#=-][^\n]*)\n(=|-){3,}[ \t]*$", lambda m: ("# " if m[2] == "=" else "## ") + m[1], text, flags=regex.M)
    pieces = regex.split(r"(^```.*?^```[^\n]*$)", text, flags=regex.S | regex.M)
    for k in range(0, len(pieces), 2):
        p = regex.sub(r"!?\[([^\]\n]*)\]\([^)\s]+(?: \"[^\"]*\")?\)", r"\1", pieces[k])
        p = regex.sub(r"\*\*([^\s*][^*\n]*)\*\*|(?<!\w)__([^\s_][^_\n]*)__(?!\w)|~~(\S[^~\n]*)~~", lambda m: m[1] or m[2] or m[3], p)
        p = regex.sub(r"(?<![\w*])\*([^\s*][^*\n]*)(?<!\s)\*(?![\w*])", r"\1", p)
        p = regex.sub(r"`([^`\n]+)`", r"\1", p)
        p = regex.sub(r"^[*+] ", "- ", p, flags=regex.M)
        pieces[k] = regex.sub(r"^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*\n", "", p, flags=regex.M)
    return "".join(pieces)
