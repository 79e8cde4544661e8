"""Language of documents and of segments (problem 10): a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample of labelled documents (SAMPLE, a parameter), then
applied to every byte of every text. A time step reads a patch of four bytes; every patch gets a probability for each
language, segments (sentences) pool their patches' log-probabilities, and documents pool their segments."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The languages told apart, by ISO 639-1 code, with the other codes and names their labels go by.
LANGUAGES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "it": ("it", "ita", "italian", "italiano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "ru": ("ru", "rus", "russian", "русский"),
}
CODES = list(LANGUAGES)
#: Labelled documents used for training, at most; the bound does not depend on the corpus.
SAMPLE = 3000
PATCH, STEPS, HIDDEN, CLASSES = 4, 32, 20, 96
#: A segment counts as a sentence of a language from so many letters on and with so much confidence.
MIN_LETTERS, MIN_CONFIDENCE, MIN_SENTENCES = 16, 0.9, 2
#: A segment leaves its document's main language only when the other one is more likely by this much (natural log).
SWITCH = 10.0
QUOTED = re.compile(rb"\"[^\"\n]+\"|\xe2\x80[\x9c\x9e](?:(?!\xe2\x80[\x9c\x9d])[^\n])+\xe2\x80[\x9c\x9d]|\xc2\xab(?:(?!\xc2\xbb)[^\n])+\xc2\xbb")


def _byte_classes() -> np.ndarray:
    """0 for what is no letter, 1-26 for a-z, then the lead bytes of two-byte letters and the continuation bytes."""
    table = np.zeros(256, np.uint8)
    for c in range(26):
        table[ord("a") + c] = table[ord("A") + c] = 1 + c
    for i, b in enumerate((0xC3, 0xC5, 0xD0, 0xD1)):
        table[b] = 27 + i
    table[0x80:0xC0] = 31 + np.arange(64)
    table[0xE0:0xF5] = 95
    return table


TABLE = _byte_classes()


def encode(buffer: np.ndarray, offsets: np.ndarray):
    """Texts (their UTF-8 bytes in one buffer, and offsets) to classes of bytes in patches.

    Returns the patches (chunks x STEPS x PATCH classes; each text starts a chunk), each patch's segment (-1 for
    padding), and per segment its text, start, end (byte offsets in the text) and number of letters. Runs of anything
    but letters become one 0; texts in quotes are left out, as are capitals' differences from small letters."""
    b, n = buffer.copy(), len(buffer)
    starts, ends = offsets[:-1], offsets[1:]
    nxt = np.append(b[1:], 0)
    prev = np.append(0, b[:-1])
    up = (prev == 0xC3) & (b >= 0x80) & (b <= 0x9E)
    b[up] += 0x20
    cyr1, cyr2 = (prev == 0xD0) & (b >= 0x90) & (b <= 0x9F), (prev == 0xD0) & (b >= 0xA0) & (b <= 0xAF)
    b[cyr1] += 0x20
    b[np.flatnonzero(cyr2) - 1] = 0xD1
    b[cyr2] -= 0x20
    cls = TABLE[b]
    symbols = (b == 0xC2) | (b == 0xE2)  # signs, not letters: their continuation bytes go too
    cls[symbols] = 0
    after = np.flatnonzero(symbols)
    for k in (1, 2):
        at = after[after + k < n] + k
        at = at[(buffer[at] & 0xC0) == 0x80]
        cls[at] = 0
    for m in QUOTED.finditer(buffer.tobytes()):
        cls[m.start() : m.end()] = 0
    space = (nxt == 32) | (nxt == 10) | (nxt == 13) | (nxt == 9)
    stop = ((buffer == 46) | (buffer == 33) | (buffer == 63)) & space
    line = (buffer == 10) & np.isin(nxt, np.frombuffer(b"\n\r-*#=|<\\{+\xe2", np.uint8))
    cut_after = np.flatnonzero(stop | line)
    bounds = np.unique(np.concatenate([starts, cut_after + 1]))
    bounds = bounds[bounds < n]
    seg_of = np.zeros(n, np.int64)
    seg_of[bounds] = 1
    seg_of = np.cumsum(seg_of) - 1
    keep = (cls != 0) | (np.append(1, cls[:-1]) != 0)
    kept_seg, kept_cls = seg_of[keep], cls[keep]
    n_seg = len(bounds)
    size = np.bincount(kept_seg, minlength=n_seg)
    letters = np.bincount(kept_seg, weights=kept_cls != 0, minlength=n_seg).astype(np.int64)
    patches = -(-size // PATCH)
    doc_of = np.searchsorted(starts, bounds, "right") - 1
    first = np.zeros(n_seg, np.int64)
    doc_patches = np.bincount(doc_of, weights=patches, minlength=len(starts)).astype(np.int64)
    doc_chunks = -(-doc_patches // STEPS)
    doc_base = np.concatenate([[0], np.cumsum(doc_chunks)[:-1]]) * STEPS
    running = np.cumsum(patches) - patches
    doc_first_seg = np.searchsorted(doc_of, np.arange(len(starts)), "left")
    doc_running = running[np.minimum(doc_first_seg, n_seg - 1)] if n_seg else np.zeros(len(starts), np.int64)
    first = doc_base[doc_of] + running - doc_running[doc_of]
    rank = np.arange(len(kept_seg)) - (np.cumsum(size) - size)[kept_seg]
    total = int(doc_chunks.sum()) * STEPS
    out = np.zeros(total * PATCH, np.int64)
    out[first[kept_seg] * PATCH + rank] = kept_cls
    owner = np.full(total, -1, np.int64)
    owner[np.repeat(first, patches) + np.arange(patches.sum()) - np.repeat(running, patches)] = np.repeat(np.arange(n_seg), patches)
    seg_end = np.append(bounds[1:], n)
    seg_end = np.minimum(seg_end, ends[doc_of])
    return out.reshape(-1, STEPS, PATCH), owner, doc_of, bounds - starts[doc_of], seg_end - starts[doc_of], letters


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow string column; nulls count as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class ByteGru:
    """One gated recurrent layer in each direction and a softmax over languages at every step."""

    def __init__(self, classes: int = len(CODES), hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p |= {f"E{d}": f(PATCH, CLASSES, 3 * hidden, scale=0.3), f"U{d}": f(hidden, 3 * hidden, scale=0.25), f"c{d}": np.zeros(3 * hidden, np.float32)}
        self.p |= {"W": f(2 * hidden, classes, scale=0.3), "o": np.zeros(classes, np.float32)}

    def compile(self) -> None:
        """Input tables for pairs of bytes, so that a patch costs two look-ups."""
        self.pairs = {}
        for d in "fb":
            e = self.p[f"E{d}"]
            self.pairs[d] = [(e[2 * k][:, None] + e[2 * k + 1][None] + (self.p[f"c{d}"] if k == 0 else 0)).reshape(CLASSES * CLASSES, -1).astype(np.float32) for k in range(2)]

    def log_probs(self, x: np.ndarray, block: int = 768) -> np.ndarray:
        """Patches (n x STEPS x PATCH) to log-probabilities (n x STEPS x languages)."""
        h, p = self.h, self.p
        pair = np.ascontiguousarray((x[:, :, 0::2] * CLASSES + x[:, :, 1::2]).transpose(2, 1, 0))
        out = np.empty((x.shape[0], x.shape[1], len(p["o"])), np.float32)
        for s in range(0, x.shape[0], block):
            n = min(block, x.shape[0] - s)
            states = np.empty((x.shape[1], n, 2 * h), np.float32)
            for k, d in enumerate("fb"):
                a, b = self.pairs[d]
                u_zr, u_n = np.ascontiguousarray(p[f"U{d}"][:, : 2 * h]), np.ascontiguousarray(p[f"U{d}"][:, 2 * h :])
                state = np.zeros((n, h), np.float32)
                for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
                    i = a.take(pair[0, t, s : s + n], 0)
                    i += b.take(pair[1, t, s : s + n], 0)
                    g = state @ u_zr
                    g += i[:, : 2 * h]
                    _sigmoid(g)
                    c = state @ u_n
                    c *= g[:, h:]
                    c += i[:, 2 * h :]
                    np.tanh(c, out=c)
                    state = state - c
                    state *= g[:, :h]
                    state += c
                    states[t, :, k * h : (k + 1) * h] = state
            logits = states.reshape(-1, 2 * h) @ p["W"] + p["o"]
            logits -= logits.max(1, keepdims=True)
            logits -= np.log(np.exp(logits).sum(1, keepdims=True))
            out[s : s + n] = logits.reshape(x.shape[1], n, -1).transpose(1, 0, 2)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the real patches of a batch, and its gradients by backpropagation through time."""
        p, h, (n, steps, _) = self.p, self.h, x.shape
        saved, states = {}, np.zeros((steps, n, 2 * h), np.float32)
        for k, d in enumerate("fb"):
            e, u = p[f"E{d}"], p[f"U{d}"]
            state, trace = np.zeros((n, h), np.float32), []
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                i = p[f"c{d}"] + sum(e[j][x[:, t, j]] for j in range(PATCH))
                rec = state @ u
                g = 1 / (1 + np.exp(-(i[:, : 2 * h] + rec[:, : 2 * h])))
                z, r, rn = g[:, :h], g[:, h:], rec[:, 2 * h :]
                c = np.tanh(i[:, 2 * h :] + r * rn)
                trace.append((t, state, z, r, rn, c))
                state = (1 - z) * c + z * state
                states[t, :, k * h : (k + 1) * h] = state
            saved[d] = trace
        logits = states @ p["W"] + p["o"]
        logits -= logits.max(2, keepdims=True)
        probs = np.exp(logits)
        probs /= probs.sum(2, keepdims=True)
        mask = real.T[:, :, None] / max(1, real.sum())
        picked = np.take_along_axis(probs, np.broadcast_to(y[None, :, None], (steps, n, 1)), 2)
        loss = float(-(np.log(picked + 1e-9) * mask).sum())
        d_logits = probs * mask
        np.put_along_axis(d_logits, np.broadcast_to(y[None, :, None], (steps, n, 1)), np.take_along_axis(d_logits, np.broadcast_to(y[None, :, None], (steps, n, 1)), 2) - mask, 2)
        d_logits = d_logits.astype(np.float32)
        grads = {"W": states.reshape(-1, 2 * h).T @ d_logits.reshape(-1, d_logits.shape[2]), "o": d_logits.sum((0, 1))}
        d_states = d_logits @ p["W"].T
        for k, d in enumerate("fb"):
            u, e = p[f"U{d}"], p[f"E{d}"]
            g_u, carry = np.zeros_like(u), np.zeros((n, h), np.float32)
            d_in = np.zeros((steps, n, 3 * h), np.float32)
            for t, before, z, r, rn, c in reversed(saved[d]):
                ds = d_states[t, :, k * h : (k + 1) * h] + carry
                dc = ds * (1 - z) * (1 - c * c)
                dz = ds * (before - c) * z * (1 - z)
                dr = dc * rn * r * (1 - r)
                d_rec = np.concatenate([dz, dr, dc * r], 1)
                d_in[t] = np.concatenate([dz, dr, dc], 1)
                g_u += before.T @ d_rec
                carry = ds * z + d_rec @ u.T
            grads[f"U{d}"], grads[f"c{d}"] = g_u, d_in.sum((0, 1))
            g_e = np.zeros_like(e)
            flat = d_in.reshape(-1, 3 * h)
            for j in range(PATCH):
                hot = x[:, :, j].T.reshape(-1)
                order = np.argsort(hot, kind="stable")
                at = np.flatnonzero(np.append(True, np.diff(hot[order]) != 0))
                g_e[j][hot[order][at]] = np.add.reduceat(flat[order], at, 0)
            grads[f"E{d}"] = g_e
        return loss, grads


def train(texts: list[str], codes: list[str], steps: int = 500, batch: int = 256, seed: int = 7) -> ByteGru:
    """Fits the network with Adam on chunks of the labelled texts, drawn evenly over the languages."""
    model, rng = ByteGru(seed=seed), np.random.default_rng(seed)
    if not texts:
        model.compile()
        return model
    x, owner, doc_of, *_ = encode(*buffers(pa.array(texts, pa.large_string())))
    label = np.array([CODES.index(c) for c in codes])
    owner = owner.reshape(-1, STEPS)
    y = label[doc_of[np.maximum(owner, 0).max(1)]]
    full = np.flatnonzero((owner >= 0).sum(1) >= STEPS // 4)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        if step in (1, steps // 5, 2 * steps // 5, 3 * steps // 5):
            if step > 1:  # chunks that the network so far reads as another language than their label are left out
                model.compile()
                scores = (model.log_probs(x[full]) * (owner[full] >= 0)[:, :, None]).sum(1)
                own = np.take_along_axis(scores, y[full][:, None], 1)[:, 0]
                trusted = full[own >= scores.max(1)]
            else:
                trusted = full
            pools = [pool for k in range(len(CODES)) if len(pool := trusted[y[trusted] == k])]
            if not pools:
                break
        pick = np.concatenate([rng.choice(pool, batch // len(pools)) for pool in pools])
        _, grads = model.gradients(x[pick], y[pick], owner[pick] >= 0)
        rate = 0.02 * (1 - step / (steps + 1)) ** 0.7
        for k, g in grads.items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            model.p[k] *= 1 - 0.02 * rate
            model.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    model.compile()
    return model


def label_code(label: Column) -> Column:
    """The ISO 639-1 code a label stands for: codes with region, three-letter codes, names, any case; else null."""
    main = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}]+)(?:[-_].*)?$", 1)
    table = F.create_map(*[F.lit(x) for code, names in LANGUAGES.items() for name in names for x in (name, code)])
    return F.when(main != "", F.element_at(table, main))


def fitted(docs: DataFrame, sample: int = SAMPLE) -> ByteGru:
    """Trains on at most ``sample`` labelled documents, picked by a hash of their text, copies once. The labelled rows are counted
    first, so that every task sends no more than its share of the sample to the driver, however many tasks there are.
    Without a labelled document the network stays untrained."""
    rows = docs.where(F.col("text").isNotNull()).select("text", label_code(F.col("lang")).alias("code")).where("code is not null")
    part = min(1.0, 1.3 * sample / max(1, docs.where(label_code(F.col("lang")).isNotNull()).count()))
    rows = rows.withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(1 << 30)) <= F.lit(int(part * (1 << 30)))).dropDuplicates(["h", "code"])
    rows = rows.orderBy("h", "code").limit(sample).toPandas()
    return train(list(rows["text"]), list(rows["code"]))


SEGMENTS = "doc_id long, seg_no int, start_char long, end_char long, letters long, lang string, confidence double"
#: Texts are read in batches of at most so many documents and, but for a longer one alone, so many bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 21


def _batches(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.diff(buffers(whole.column(1))[1])
    first, load = 0, 0
    for k, n in enumerate(size):
        if k > first and (load + n > BATCH_BYTES or k - first == BATCH_ROWS):
            yield whole.slice(first, k - first)
            first, load = k, 0
        load += n
    if whole.num_rows > first:
        yield whole.slice(first)


def _runs(ids, codes, doc_of, start, end, letters, best, sure, data, offsets) -> pa.RecordBatch:
    """Neighbouring sentences of one language as one segment, its place counted in code points."""
    has = np.flatnonzero(letters > 0)
    fresh = np.append(True, (doc_of[has][1:] != doc_of[has][:-1]) | (best[has][1:] != best[has][:-1]))
    at = np.flatnonzero(fresh)
    first, last = has[at], has[np.append(at[1:], len(has)) - 1]
    doc = doc_of[first]
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    place = lambda byte: points[offsets[doc] + byte] - points[offsets[doc]]
    size = np.add.reduceat(letters[has], at)
    number = np.arange(len(doc)) - np.searchsorted(doc, doc, "left")
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[doc]), pa.array(number.astype(np.int32)), pa.array(place(start[first])), pa.array(place(end[last])), pa.array(size), pa.array(codes[best[first]]), pa.array(np.add.reduceat((sure * letters)[has], at) / size)],
        ["doc_id", "seg_no", "start_char", "end_char", "letters", "lang", "confidence"],
    )


def _labeller(model: ByteGru, merge: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _batches(whole):
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                data, offsets = buffers(batch.column(1))
                x, owner, doc_of, start, end, letters = encode(data, offsets)
                if not len(x) or not (letters > 0).any():
                    continue
                scores = model.log_probs(x).reshape(-1, len(CODES))
                real = owner >= 0
                pooled = np.stack([np.bincount(owner[real], weights=scores[real, k], minlength=len(doc_of)) for k in range(len(CODES))], 1)
                best = pooled.argmax(1)
                main = np.stack([np.bincount(doc_of, weights=letters * (best == k), minlength=len(ids)) for k in range(len(CODES))], 1).argmax(1)[doc_of]
                stay = pooled.max(1) - pooled[np.arange(len(best)), main] < SWITCH
                best = np.where(stay, main, best)
                odds = np.exp(np.maximum(pooled - pooled.max(1, keepdims=True), -50))
                sure = odds[np.arange(len(best)), best] / odds.sum(1)
                if not merge:
                    yield _runs(ids, np.array(CODES), doc_of, start, end, letters, best, sure, data, offsets)
                    continue
                counts = (letters >= MIN_LETTERS) & (sure >= MIN_CONFIDENCE)
                grid = len(CODES) * doc_of + best
                sentences = np.bincount(grid, weights=counts, minlength=len(CODES) * len(ids)).reshape(-1, len(CODES))
                mass = np.bincount(grid, weights=letters * sure, minlength=len(CODES) * len(ids)).reshape(-1, len(CODES))
                share = mass / np.maximum(mass.sum(1, keepdims=True), 1e-9)
                d, k = np.nonzero(mass > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[d]), pa.array(np.array(CODES)[k]), pa.array(sentences[d, k].astype(np.int64)), pa.array(share[d, k])],
                    ["doc_id", "lang", "sentences", "confidence"],
                )

    return run


def segments(docs: DataFrame, model: ByteGru | None = None) -> DataFrame:
    """Every segment in one language: its place in the text (code points), letters, language and confidence (that of
    its sentences, weighted by their letters). Sentences without a letter belong to the segment around them."""
    model = model or fitted(docs)
    return docs.select("doc_id", "text").mapInArrow(_labeller(model, False), SEGMENTS)


def document_languages(docs: DataFrame, model: ByteGru | None = None) -> DataFrame:
    """``doc_id, lang, sentences, confidence``: the languages of each document, with the number of sentences in each
    and its share of the text as confidence. Texts without a letter give no row."""
    model = model or fitted(docs)
    return docs.select("doc_id", "text").mapInArrow(_labeller(model, True), "doc_id long, lang string, sentences long, confidence double")


def languages_of(docs: DataFrame, model: ByteGru | None = None) -> DataFrame:
    """``doc_id, langs``: the main language first (the one with the largest share), then each with at least two
    sentences. One document is one group of at most as many rows as there are languages."""
    per = document_languages(docs, model).groupBy("doc_id").agg(F.collect_set(F.struct("confidence", "lang", "sentences")).alias("all"))
    main = F.array_max("all")
    others = F.filter("all", lambda x: (x["sentences"] >= MIN_SENTENCES) & (x["lang"] != main["lang"]))
    return per.select("doc_id", F.concat(F.array(main["lang"]), F.transform(F.sort_array(others, False), lambda x: x["lang"])).alias("langs"), main["confidence"].alias("confidence"), main["sentences"].alias("sentences"))


def mislabelled(docs: DataFrame, model: ByteGru | None = None) -> DataFrame:
    """``doc_id, lang``: documents whose label is missing or wrong, or that mix languages; a row for each language."""
    texts = languages_of(docs, model)
    both = texts.join(docs.select("doc_id", label_code(F.col("lang")).alias("label")), "doc_id")
    wrong = F.col("label").isNull() | ~F.array_contains("langs", F.col("label")) | (F.size("langs") > 1)
    return both.where(wrong).select("doc_id", F.explode("langs").alias("lang")).distinct()
