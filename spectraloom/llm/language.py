"""Languages of documents and of their parts, by mixture inference over n-grams."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled samples that a model is fitted on at most.
MAX_SAMPLES = 20_000
#: Lengths of the n-grams, and the size of the table they are hashed into.
ORDERS, TABLE_BITS = (1, 2, 3, 4), 16
#: Added to every count.
SMOOTHING = 0.05
#: N-grams overlap: their log-likelihoods are scaled to that of independent ones.
SCALE = 0.25
#: Log-likelihood that a further language of a page has to earn per log of the page's length.
PENALTY = 3.0
ROUNDS = 12
#: Lines without a sentence's end count as text from this length on.
UNENDED = 100

_TAG = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)>")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")
_QUOTE = re.compile(r"“[^“”\n]{1,150}”|„[^„“”\n]{1,150}[“”]|«[^«»\n]{1,150}»")
_SENTENCE = re.compile(r"[^.!?;…。！？；]{1,20000}[.!?;…。！？；]*[\"'”»’]*\s*")
_END = re.compile(r"[.!?;…。！？；][\"'”»’)]*\s*\Z")
_FURNITURE = re.compile(r"[|»©]")
_NON_ASCII = re.compile(r"[^\x00-\x7f]+")


def _single_byte(name: str) -> dict[str, int]:
    """Character to byte of a single-byte charset; bytes that it leaves open are met as controls."""
    table = {}
    for byte in range(256):
        char = bytes([byte]).decode(name, errors="replace")
        table[chr(byte) if char == "�" else char] = byte
    return table


#: Charsets that pages are read with by mistake (fixed values).
_READ_AS = ("latin-1", "cp1252", "cp1251", "iso8859-2", "koi8-r")
_BYTES = {name: _single_byte(name) for name in _READ_AS}
#: The one byte that cp1251 leaves open comes out as the replacement character.
_BYTES["cp1251"]["�"] = 0x98


def _sequences(name: str) -> re.Pattern:
    """Well-formed UTF-8 sequences of two to four bytes, as they look when read with ``name``."""
    by = {byte: char for char, byte in _BYTES[name].items()}
    some = lambda first, last: "[" + "".join(re.escape(by[b]) for b in range(first, last + 1) if b in by) + "]"
    more = some(0x80, 0xBF)
    return re.compile(f"{some(0xC2, 0xDF)}{more}|{some(0xE0, 0xEF)}{more}{{2}}|{some(0xF0, 0xF4)}{more}{{3}}")


_SEQUENCES = {name: _sequences(name) for name in _READ_AS}


def restored(text: str) -> str:
    """``text`` as written, if it is UTF-8 that was read with a single-byte charset; else ``text``.

    At least nine tenths of its characters beyond ASCII must form UTF-8 sequences.
    """
    runs = _NON_ASCII.findall(text)
    if not runs:
        return text
    odd, beyond = sum(map(len, runs)), " ".join(runs)
    best, most = None, 0.9 * odd
    for name in _READ_AS:
        formed = sum(map(len, _SEQUENCES[name].findall(beyond)))
        if formed > most:
            best, most = name, formed
    if best is None:
        return text
    table = _BYTES[best]
    return bytes(table.get(c, 0x3F) for c in text).decode("utf-8", errors="replace")


#: Charsets that pages of letters beyond ASCII are written in (fixed values).
_WRITTEN_IN = ("cp1251", "koi8-r", "koi8-u", "iso8859-5", "gb18030")


def looks_crossed(text: str) -> bool:
    """Whether over half of the letters are Latin ones beyond ASCII, or Cyrillic capitals: no language is written so."""
    if text.isascii():
        return False
    codes = np.frombuffer(text.encode("utf-32-le", errors="surrogatepass"), dtype="uint32")
    high = codes[codes >= 0xC0]
    letters = len(high) + np.count_nonzero((codes | 32) - 97 < 26)
    if 2 * len(high) <= letters:
        return False
    latin, capitals = np.count_nonzero(high < 0x180), np.count_nonzero((high >= 0x400) & (high < 0x430))
    return 2 * max(latin, capitals) > letters


def recoded(text: str) -> list[str]:
    """``text`` as it would be if written in one charset and read with another, for the pairs whose bytes it can be."""
    beyond, out = set("".join(_NON_ASCII.findall(text))), []
    for name in _READ_AS:
        if not beyond <= _BYTES[name].keys():
            continue
        sent = bytes(_BYTES[name].get(c, ord(c) & 0x7F) for c in text)
        for own in _WRITTEN_IN:
            made = sent.decode(own, errors="replace") if own != name else text
            # A charset that the bytes do not fit is none.
            if made != text and made not in out and made.count("\ufffd") * 100 <= len(made):
                out.append(made)
    return out


def as_written(text: str, log_share: np.ndarray) -> str:
    """``text`` as its page was written: UTF-8 restored, and crossed charsets told apart by the likelihood of the whole text."""
    found = restored(text)
    if found != text or not looks_crossed(text):
        return found
    options = [text, *recoded(text)]
    # Likelihoods are summed over stretches of bounded length.
    likely = [score(log_share, [o[at : at + 20_000] for at in range(0, len(o), 20_000)]).sum(axis=0).max() for o in options]
    return options[int(np.argmax(likely))]


#: A text with more than one replacement character in so many lost its bytes when it was decoded.
LOST_ONE_IN = 20
#: Charsets that a page's bytes are tried with (fixed values).
_SENT_IN = ("utf-8", "cp1251", "koi8-r", "koi8-u", "iso8859-5", "gb18030", "iso8859-2", "cp1252")
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|head)\b.*?</\1\s*>", re.S | re.I)
_BLOCK = re.compile(r"</?(?:html|p|div|h\d|li|ul|ol|tr|td|th|table|br|nav|header|footer|main|section|article|aside|blockquote|pre|body|form)\b[^<>]*>", re.I)


def visible(page: str) -> str:
    """The text of an HTML page, a line per block; tags within lines are left to ``passages``."""
    return _BLOCK.sub("\n", _SPACE.sub(" ", _HIDDEN.sub(" ", page)))


def from_bytes(raw: bytes, log_share: np.ndarray) -> str | None:
    """The text of a page from its bytes, in the charset under which it is likeliest; None if none fits the bytes."""
    pages = (raw.decode(name, errors="replace") for name in _SENT_IN)
    options = [visible(p) for p in pages if p.count("\ufffd") * 100 <= len(p)]
    if not options:
        return None
    likely = [score(log_share, [o[at : at + 20_000] for at in range(0, len(o) or 1, 20_000)]).sum(axis=0).max() for o in options]
    return options[int(np.argmax(likely))]


def passages(text: str) -> list[tuple[int, str]]:
    """(line number, sentence) of the running text as written: without tags, menus, titles, notices, footers and short quotations."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    out = []
    for number, line in enumerate(text.split("\n")):
        line = line.strip()
        if len(line) < UNENDED and not _END.search(line):
            continue
        line = _QUOTE.sub(" ", line)
        if _FURNITURE.search(line) and (len(line) < 2 * UNENDED or line[0] == "©"):
            continue
        out += [(number, s) for s in (_SPACE.sub(" ", m.group()).strip() for m in _SENTENCE.finditer(line)) if s]
    return out


def _grams(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all sentences, per order, and where each sentence begins; a sentence is framed by blanks."""
    framed = [f" {_DIGITS.sub('0', s.lower())} " for s in sentences]
    sizes = np.array([len(s) for s in framed])
    codes = np.frombuffer("".join(framed).encode("utf-32-le"), dtype="uint32").astype("uint64")
    return codes, np.cumsum(sizes) - sizes


def _hash(codes: np.ndarray, n: int) -> np.ndarray:
    mixed = np.full(len(codes) - n + 1, n, dtype="uint64")
    for k in range(n):
        mixed = (mixed ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return (mixed & np.uint64((1 << TABLE_BITS) - 1)).astype("int64")


class Model:
    """Log-probabilities of hashed n-grams in each language."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in samples})
        counts = np.full((len(ORDERS), 1 << TABLE_BITS, len(self.languages)), SMOOTHING, dtype="float64")
        for k, lang in enumerate(self.languages):
            codes, _ = _grams([text for own, text in samples if own == lang])
            for o, n in enumerate(ORDERS):
                if len(codes) >= n:
                    np.add.at(counts[o, :, k], _hash(codes, n), 1)
        self.table = np.log(counts / (counts - SMOOTHING).sum(axis=1, keepdims=True).clip(1)).astype("float32")


def score(table: np.ndarray, sentences: list[str], chunk: int = 500_000) -> np.ndarray:
    """Log-likelihood of each sentence in each language, about ``chunk`` characters at a time."""
    ends = np.cumsum([len(s) for s in sentences])
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(chunk, ends[-1], chunk)) + 1, len(sentences)])
    return np.concatenate([_score(table, sentences[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])


def _score(table: np.ndarray, sentences: list[str]) -> np.ndarray:
    codes, starts = _grams(sentences)
    if len(codes) < ORDERS[-1]:
        codes = np.concatenate([codes, np.full(ORDERS[-1], 32, dtype="uint64")])
    # The n-grams at one place are added up before the sentences are. Those that
    # reach into the next sentence go to the first; they weigh on all languages alike.
    length = len(codes) - ORDERS[-1] + 1
    each = table[0][_hash(codes, ORDERS[0])[:length]]
    for o, n in enumerate(ORDERS[1:], 1):
        each += table[o].take(_hash(codes, n)[:length], axis=0)
    return np.add.reduceat(each, np.minimum(starts, length - 1), axis=0).astype("float64") * SCALE


def infer(scores: np.ndarray, pages: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each sentence, proportions of each page) by EM and penalised likelihood.

    ``pages`` numbers the page of each sentence, in order. EM estimates each
    page's proportions of the languages. Languages then leave the page, the
    one that costs least first, as long as the likelihood lost is less than
    PENALTY times the log of the page's length.
    """
    starts = np.flatnonzero(np.r_[True, pages[1:] != pages[:-1]])
    rank = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(pages)]))
    size = np.add.reduceat(weights, starts)
    count = scores.shape[1]
    likely = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -700))
    active = np.ones((len(starts), count), dtype=bool)
    share = np.full((len(starts), count), 1 / count)

    def estimate(share: np.ndarray, active: np.ndarray) -> np.ndarray:
        for _ in range(ROUNDS):
            post = likely * share[rank] + 1e-300 * active[rank]
            post /= post.sum(axis=1, keepdims=True)
            share = np.add.reduceat(post * weights[:, None], starts) / size[:, None] * active
            share /= share.sum(axis=1, keepdims=True)
        return share

    share = estimate(share, active)
    # Languages without any share are gone at once.
    active = share > 1e-6
    for _ in range(count - 1):
        open_pages = active.sum(axis=1) > 1
        if not open_pages.any():
            break
        total = (likely * share[rank]).sum(axis=1)
        loss = np.full((len(starts), count), np.inf)
        for k in range(count):
            without = np.maximum(total - likely[:, k] * share[rank, k], 1e-300)
            rest = np.maximum(1 - share[:, k], 1e-12)
            fall = np.add.reduceat(np.log(total + 1e-300) - np.log(without), starts) + np.add.reduceat(np.ones(len(rank)), starts) * np.log(rest)
            loss[:, k] = np.where(active[:, k] & open_pages, fall, np.inf)
        worst = loss.argmin(axis=1)
        leaves = loss[np.arange(len(starts)), worst] < PENALTY * np.log(size + 1)
        if not leaves.any():
            break
        active[leaves, worst[leaves]] = False
        share = np.where(active, share, 0)
        share /= share.sum(axis=1, keepdims=True)
        share = estimate(share, active)
        active &= share > 1e-6
    post = likely * share[rank] + 1e-300 * active[rank]
    return post / post.sum(axis=1, keepdims=True), share


def fit(samples: DataFrame, text: str = "text", lang: str = "lang", bound: int = MAX_SAMPLES) -> Model:
    """A model from at most ``bound`` labelled rows, chosen by hash where there are more."""
    rows = samples.select(F.lower(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    chosen = rows.orderBy(F.xxhash64("lang", "text"), "lang", "text").limit(bound).collect()
    if not chosen:
        raise ValueError("no labelled samples")
    return Model([(row.lang, row.text) for row in chosen])


def segments(df: DataFrame, model: Model, ident: str, text: str, raw: str | None = None) -> DataFrame:
    """(id, segment, lang, confidence, chars): the passages of each document in one language, in order.

    A segment is a stretch of sentences of one language; ``chars`` counts
    their characters as the page was written, ``confidence`` is their mean
    posterior. Whole texts are read. Null texts and texts without sentences
    have no segments; rows of one id are documents of their own. Where a text
    lost its bytes on decoding it is made from the page's, if ``raw`` names
    their column.
    """
    shipped = df.sparkSession.sparkContext.broadcast((model.languages, model.table))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages, log_share = shipped.value
        names = np.array(languages, dtype=object)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                texts = [(from_bytes(b, log_share) if b is not None else None) or as_written(t, log_share) for t, b in zip(part["text"], part["raw"])]
                found = [passages(t) for t in texts]
                sizes = np.array([len(own) for own in found])
                page = np.repeat(np.arange(len(found)), sizes)
                if not len(page):
                    continue
                sentences = [s for own in found for _, s in own]
                chars = np.array([len(s) for s in sentences])
                post, _ = infer(score(log_share, sentences), page, chars.astype("float64"))
                best = post.argmax(axis=1)
                fresh = np.flatnonzero(np.r_[True, (page[1:] != page[:-1]) | (best[1:] != best[:-1])])
                weight = np.add.reduceat(chars, fresh)
                sure = np.add.reduceat(post[np.arange(len(best)), best] * chars, fresh) / weight
                first = np.searchsorted(page[fresh], page[fresh], side="left")
                yield pd.DataFrame({"id": part["id"].to_numpy()[page[fresh]], "segment": (np.arange(len(fresh)) - first + 1).astype("int32"), "lang": names[best[fresh]], "confidence": sure, "chars": weight.astype("int64")})

    lost = (F.length(text) - F.length(F.replace(F.col(text), F.lit("\ufffd"), F.lit("")))) * LOST_ONE_IN > F.length(text)
    sent = F.when(lost, F.col(raw)) if raw else F.lit(None).cast("binary")
    rows = df.select(F.col(ident).cast("bigint").alias("id"), F.col(text).alias("text"), sent.alias("raw")).filter("id is not null and text is not null")
    return rows.mapInPandas(run, "id bigint, segment int, lang string, confidence double, chars bigint")


def document_languages(found: DataFrame) -> DataFrame:
    """(id, lang, chars, share, confidence) from ``segments``: every language of every document."""
    by = found.groupBy("id", "lang").agg(F.sum("chars").alias("chars"), (F.sum(F.col("confidence") * F.col("chars")) / F.sum("chars")).alias("confidence"))
    from pyspark.sql import Window

    # A document has at most as many rows as there are languages.
    return by.withColumn("share", F.col("chars") / F.sum("chars").over(Window.partitionBy("id")))
