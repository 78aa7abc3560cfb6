"""Languages of documents and of their numbered paragraphs, by a byte convolutional network.

The network (byte embedding, filters of several widths, max pooling, softmax) is trained in numpy on windows of a
bounded sample of labelled documents; labels may be wrong, so windows that the half-trained network denies are
dropped before it is trained on, and the network used is a second one, trained on the documents whose label the first
one agrees with. It is then applied to fixed-length windows of whole texts, in batches; a window that
occurs again is looked up. A paragraph has the language of most of its words: its windows vote with their words, and
the document's main language decides where they hardly say anything.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandline.llm.encode import bounds
from strandline.session import spread

#: Bytes of a window; labelled documents of each language, and windows of each of them, that the network is fitted on at most (on average).
LENGTH, FIT_DOCUMENTS, FIT_WINDOWS = 64, 500, 8
#: One document in so many is held out to see whether a label names a language of its own: at least this share of its windows must be told as it, and
#: at least this share of the windows told as it must be its own.
HELD_OUT, CONFIRMED = 8, 0.5
#: Two labels name one language if of the held-out windows of either (each label's count as much) no more than this share is told from the other's; by chance it is half.
ALIKE = 0.7
#: A rare language's windows are repeated in training, at most so often, until it has a quarter of the windows of a language on average.
REPEAT = 20
#: Steps of the training at least, in batches of so many windows; share of all held-out windows that a network must tell for its word on labels to count.
STEPS, BATCH, TRUSTED = 600, 128, 0.8
WIDTHS, FILTERS, EMBED = (2, 3, 4, 5), 16, 6
#: Windows end where the rolling hash says so, on average 64 bytes apart, so that passages that occur again give the same ones.
CUT = np.uint32(63)
#: Share of paragraphs that are in their document's main language, taken as known; least probability that counts; words that
#: weigh as much as one independent observation.
MAIN_SHARE, LEAST_PROBABILITY, WORDS_EACH = 0.97, 0.01, 4.0
#: Windows that a worker remembers, and documents that it works on at once.
REMEMBER, AT_ONCE = 400_000, 2000

#: ISO 639-1 codes of European languages and their ISO 639-2 codes (both, where there are two).
ISO_CODES = {
    "bg": "bul", "ca": "cat", "cs": "ces cze", "da": "dan", "de": "deu ger", "el": "ell gre", "en": "eng", "es": "spa",
    "et": "est", "eu": "eus baq", "fi": "fin", "fr": "fra fre", "ga": "gle", "gl": "glg", "hr": "hrv", "hu": "hun", "is": "isl ice",
    "it": "ita", "lt": "lit", "lv": "lav", "mt": "mlt", "nl": "nld dut", "no": "nor", "pl": "pol", "pt": "por", "ro": "ron rum",
    "ru": "rus", "sk": "slk slo", "sl": "slv", "sq": "sqi alb", "sr": "srp", "sv": "swe", "tr": "tur", "uk": "ukr", "af": "afr",
}
_CODE = {x: two for two, three in ISO_CODES.items() for x in (two, *three.split())}


def label_code(label: str | None) -> str | None:
    """Two-letter code that a label denotes in any spelling (case, three letters, region, blanks); None if it denotes none."""
    if not isinstance(label, str):
        return None
    return _CODE.get(re.split(r"[-_\s]", label.strip().lower())[0])


# --- numbered paragraphs ------------------------------------------------------------------------------------------

#: How a paragraph may begin; the group that matches is its style.
_MARK = re.compile(
    r"[ \t\u00a0]*(?:\[(\d{1,5})\]|\((\d{1,5})\)|(\d{1,5})\)|(\d{1,5})\.|\u00c2?\u00b6[ \t\u00a0\u00c2]*(\d{1,5})|Rn\.[ \t\u00a0]*(\d{1,5}))"
    r"(?=[\s\u00e2\u00c2]|$)"
)
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_DOCKET = re.compile(r"\b[A-Z]{1,3}-\d{4}-\d{4,}\b")
_PAGE = re.compile(r"^\W*(?:page|seite|pag|p\u00e1g|pagina|p\u00e1gina|strona|str|blz|bladzijde)\W+\d+\b.{0,40}$", re.I)
_WITHHELD = re.compile(r"\[[^\[\]\n]{0,60}\]|\*+|\u2588+|<[^<>\n]{0,60}>|\bX{3,}\b")
_SENTENCE_END = re.compile(r"[.;:!?)\]\d*\u2588\u2026]\s*$")
_DIGEST = re.compile(r"\b[0-9a-f]{24,}\b")


def _chain(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Longest chain of hits (number, start, end of the mark) in order whose numbers rise by one."""
    best: dict[int, tuple[int, int]] = {}  # number -> (length, index) of the longest chain so far that ends in it
    back = [-1] * len(hits)
    top = (0, -1)
    for i, (number, _, _) in enumerate(hits):
        length, before = best.get(number - 1, (0, -1))
        back[i] = before
        if length + 1 > best.get(number, (0, -1))[0]:
            best[number] = (length + 1, i)
        if length + 1 > top[0]:
            top = (length + 1, i)
    out, i = [], top[1]
    while i >= 0:
        out.append(hits[i])
        i = back[i]
    return out[::-1]


def paragraphs(text: str | None) -> list[tuple[int, str]]:
    """(printed number, text) of the numbered paragraphs, without page headers and the closing line."""
    if not text:
        return []
    for c in _INVISIBLE:
        if c in text:
            text = text.replace(c, "")
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    hits: dict[int, list[tuple[int, int, int]]] = {}  # style -> (number, line, end of the mark)
    for i, line in enumerate(lines):
        m = _MARK.match(line)
        if m:
            hits.setdefault(m.lastindex, []).append((int(m[m.lastindex]), i, m.end()))
    best: list[tuple[int, int, int]] = []
    for found in sorted(hits.values(), key=len, reverse=True):
        if len(found) > len(best) and len(got := _chain(found)) > len(best):
            best = got
    out = []
    ends = [h[1] for h in best[1:]] + [len(lines)]
    for (number, first, start), end in zip(best, ends):
        kept = [x for x in lines[first + 1 : end] if x.strip() and not (len(x) < 120 and (_DOCKET.search(x) or _PAGE.search(x)))]
        if end == len(lines) and kept and not _SENTENCE_END.search(closing := _DIGEST.sub("", kept[-1])) and len(closing) < 60:
            kept.pop()
        out.append((number, "\n".join([lines[first][start:], *kept])))
    return out


def words_only(text: str) -> str:
    """A text without what stands for something withheld, and without markup and digests; any white space, no-break and wide spaces too, is one space."""
    if any(c in text for c in ("[", "*", "\u2588", "<", "XXX")):
        text = _WITHHELD.sub(" ", text)
    text = _DIGEST.sub(" ", text) if _DIGEST.search(text) else text
    return " " + " ".join(text.split())


# --- the network --------------------------------------------------------------------------------------------------

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # lower case
_FOLD[48:58] = 48  # one digit for all
_FOLD[[9, 10, 11, 12, 13]] = 32


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # (widest * EMBED) x all filters; a narrow one is 0 beyond its width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    classes: list[str]

    def pooled(self, windows: np.ndarray):
        x = self.embed[windows]  # n, length, embed
        n, length, embed = x.shape
        a, b, c = x.strides
        # a patch is one piece of memory: the embeddings of as many bytes as the widest filter has
        patches = np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (n, length - max(WIDTHS) + 1, max(WIDTHS) * embed), (a, b, c), writeable=False))
        return patches, patches.reshape(-1, patches.shape[2]) @ self.filters

    def probabilities(self, windows: np.ndarray, batch: int = 256) -> np.ndarray:
        res = np.empty((len(windows), len(self.classes)), dtype=np.float32)
        for i in range(0, len(windows), batch):
            w = windows[i : i + batch]
            patches, conv = self.pooled(w)
            top = np.maximum(conv.reshape(len(w), patches.shape[1], -1).max(axis=1) + self.bias, 0)
            z = top @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            res[i : i + batch] = z / z.sum(axis=1, keepdims=True)
        return res


def _mask() -> np.ndarray:
    m = np.zeros((max(WIDTHS), EMBED, len(WIDTHS) * FILTERS), dtype=np.float32)
    for i, w in enumerate(WIDTHS):
        m[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
    return m.reshape(-1, m.shape[2])


def train(windows: np.ndarray, labels: np.ndarray, classes: list[str], epochs: int = 6, seed: int = 7) -> Network:
    """Adam on the cross-entropy; after half of the epochs windows whose label has next to no probability are dropped."""
    rng = np.random.default_rng(seed)
    total, mask = len(WIDTHS) * FILTERS, _mask()
    net = Network(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        (rng.normal(0, 1 / np.sqrt(max(WIDTHS) * EMBED), mask.shape) * mask).astype(np.float32),
        np.zeros(total, np.float32),
        rng.normal(0, 1 / np.sqrt(total), (total, len(classes))).astype(np.float32),
        np.zeros(len(classes), np.float32),
        classes,
    )
    params = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, size = 0, BATCH
    count = np.bincount(labels, minlength=len(classes))
    times = np.clip(len(labels) // (4 * len(classes) * np.maximum(count, 1)), 1, REPEAT)
    rows = np.repeat(np.arange(len(windows)), times[labels])
    epochs = max(epochs, -(-STEPS * BATCH // max(1, len(rows))))
    for epoch in range(epochs):
        if epoch == epochs // 2:
            p = net.probabilities(windows)[np.arange(len(labels)), labels]
            rows = rows[p[rows] > 0.05] if (p > 0.05).sum() > 0.5 * len(p) else rows
        order = rng.permutation(rows)
        for i in range(0, len(order), size):
            pick = order[i : i + size]
            w, y = windows[pick], labels[pick]
            patches, conv = net.pooled(w)
            conv = conv.reshape(len(w), patches.shape[1], -1)
            at = conv.argmax(axis=1)  # n, filters
            top = np.take_along_axis(conv, at[:, None, :], 1)[:, 0] + net.bias
            act = np.maximum(top, 0)
            z = act @ net.out + net.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = z / z.sum(axis=1, keepdims=True)
            d[np.arange(len(y)), y] -= 1
            d /= len(y)
            g_top = (d @ net.out.T) * (top > 0)
            row = np.arange(len(w))[:, None]
            best = patches[row, at]  # n, filters, widest * embed: the winning patches
            g_filters = np.einsum("nf,nfk->kf", g_top, best) * mask
            g_patch = (g_top[:, :, None] * net.filters.T[None]).reshape(len(w), total, max(WIDTHS), EMBED)
            byte = w[row[:, :, None], at[:, :, None] + np.arange(max(WIDTHS))].astype(np.int64)
            slot = byte[..., None] * EMBED + np.arange(EMBED)
            g_embed = np.bincount(slot.ravel(), g_patch.ravel(), minlength=256 * EMBED).reshape(256, EMBED).astype(np.float32)
            grads = [g_embed, g_filters, g_top.sum(0), act.T @ d, d.sum(0)]
            step += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for p, g, a, b in zip(params, grads, m1, m2):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


# --- windows ------------------------------------------------------------------------------------------------------


def cut_windows(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(windows, text of each, words of each) over whole texts; a window has at most LENGTH bytes and words of one text."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    joined = _FOLD[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    ends = np.cumsum(size)
    if not len(joined):
        return pa.array([], pa.large_binary()), np.empty(0, np.int64), np.empty(0, np.int64)
    cut = bounds(joined, ends - size, ends, CUT)
    # longer pieces are cut every LENGTH bytes
    times = (np.diff(cut) + LENGTH - 1) // LENGTH
    first = np.repeat(cut[:-1], times)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    start = first + nth * LENGTH
    stop = np.append(start[1:], len(joined))
    letter = ((joined >= 97) & (joined <= 122)) | (joined >= 0xC3)
    # a word begins with a letter after none; one that stands alone is no word
    begin = np.zeros(len(joined), dtype=np.int64)
    begin[1:-1] = letter[1:-1] & letter[2:] & ~letter[:-2] & ~((joined[:-2] >= 0x80) & (joined[:-2] < 0xC0))
    if len(joined) > 1:
        begin[0] = letter[0] & letter[1]
    upto = np.concatenate([[0], np.cumsum(begin)])
    windows = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(joined)).astype(np.int64)), pa.py_buffer(joined.tobytes())])
    return windows, np.searchsorted(ends, start, side="right"), upto[stop] - upto[start]


def as_matrix(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(LENGTH + max(WIDTHS) - 1, b"\0") for w in windows), dtype=np.uint8).reshape(len(windows), -1)


class Reader:
    """Probabilities of windows, remembered."""

    def __init__(self, net: Network):
        self.net, self.known = net, {}

    def text_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words-weighted sums of probabilities, of their logarithms, words) of each text."""
        windows, of, words = cut_windows(texts)
        coded = windows.dictionary_encode()
        known, kinds = self.known, len(self.net.classes)
        each = coded.dictionary.to_pylist()
        if len(known) + len(each) > REMEMBER:
            known.clear()
        unknown = [w for w in each if w not in known]
        if unknown:
            known.update(zip(unknown, self.net.probabilities(as_matrix(unknown))))
        table = np.array([known[w] for w in each], dtype=np.float32).reshape(len(each), kinds)
        at = coded.indices.to_numpy()
        logs = np.log(table + LEAST_PROBABILITY)
        sums = lambda x: np.stack([np.bincount(of, x[at, c] * words, minlength=len(texts)) for c in range(kinds)], axis=1)
        return sums(table), sums(logs), np.bincount(of, words, minlength=len(texts))


def code_column(label: Column) -> Column:
    """:func:`label_code` as an expression."""
    codes = F.create_map(*[F.lit(x) for pair in _CODE.items() for x in pair])
    trimmed = F.regexp_replace(F.lower(label), r"^[\s\u00a0]+|[\s\u00a0]+$", "")
    return F.try_element_at(codes, F.split(trimmed, r"[-_\s]")[0])


_BUCKETS = 1 << 20


def _sample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = []
        for doc, code, text in pdf.itertuples(index=False):
            windows, _, words = cut_windows([words_only(t) for _, t in paragraphs(text)])
            good = [w for w, n in zip(windows.to_pylist(), words) if n >= 2]
            rng = np.random.default_rng(abs(int(doc)) % 2**32)
            out += [(doc, code, good[i]) for i in sorted(rng.permutation(len(good))[:FIT_WINDOWS])]
        yield pd.DataFrame(out, columns=["doc", "lang", "window"])


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", documents: int = FIT_DOCUMENTS) -> Network:
    """The network, trained on FIT_WINDOWS windows of each of at most ``documents`` labelled documents (on average) of every language, chosen by a hash of their
    key; so a rare language has as many as a common one, or all that it has.

    Every language that some documents are labelled as is a class, however rare, if it is one of its own: documents that were held out must be told as it
    for the most part, and others must not. A code that is only ever put on texts of other languages fails that, and is dropped; of codes whose texts can't be
    told apart the one with most documents in the whole table is the language, as each may have equally many in the sample. Without any labelled paragraph
    there is nothing to fit: ValueError.
    """
    labelled = df.where(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull()).withColumn("_code", code_column(F.col(label)))
    counts = {r["_code"]: r["n"] for r in labelled.where("_code is not null").groupBy("_code").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per ISO code
    if not counts:
        raise ValueError("no labelled paragraph to fit on")
    quota = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(_BUCKETS, -(-documents * _BUCKETS // n)))])
    chosen = labelled.where(F.pmod(F.xxhash64(key), F.lit(_BUCKETS)) < F.try_element_at(quota, F.col("_code")))
    rows = chosen.select(F.col(key).cast("long").alias("k"), F.col("_code").alias("l"), F.col(text).alias("t"))
    got = spread(rows).mapInPandas(_sample, "doc long, lang string, window binary").toPandas()
    if not len(got):
        raise ValueError("no labelled paragraph to fit on")
    got = got.assign(window=got.window.map(bytes)).sort_values(["lang", "doc", "window"]).reset_index(drop=True)
    return _fit(got, counts)


def _leads(p: np.ndarray, rows: list[np.ndarray], often: np.ndarray) -> np.ndarray:
    """For each class the most frequent one (by ``often``) that ``p`` doesn't tell it from, judged by the ``rows`` of either; itself if there is none."""
    lead, first = np.arange(len(rows)), []
    for i in np.argsort(-often, kind="stable"):
        told = [((p[rows[i], i] > p[rows[i], j]).mean() + (p[rows[j], j] > p[rows[j], i]).mean()) / 2 for j in first]
        if told and min(told) <= ALIKE:
            lead[i] = first[int(np.argmin(told))]
        else:
            first.append(i)
    return lead


def _fit(got: pd.DataFrame, counts: dict[str, int]) -> Network:
    # of every language's documents each HELD_OUT-th, from the second on
    nth = got.groupby("lang").doc.transform(lambda d: pd.factorize(d)[0])
    held = (nth % HELD_OUT == 1).to_numpy()
    classes = sorted(got.lang.unique())
    windows, labels = as_matrix(list(got.window)), got.lang.map(classes.index).to_numpy()
    net = train(windows[~held], labels[~held], classes)
    lonely = {i for i in range(len(classes)) if not ((labels == i) & held).any()}  # a single document is judged by itself
    p = net.probabilities(windows)
    often = np.array([counts[c] for c in classes])
    stands = often / got.groupby("lang").doc.nunique()[classes].to_numpy()  # documents of the table that one of the sample stands for
    sure = np.average(((p * stands).argmax(axis=1) == labels)[held], weights=stands[labels[held]]) if held.any() else 0.0
    if sure < TRUSTED:  # a network that tells little can't deny a label
        return net
    lead = _leads(p, [np.flatnonzero((labels == i) & (~held if i in lonely else held)) for i in range(len(classes))], often)
    told = (p @ (lead[:, None] == np.arange(len(classes)))).argmax(axis=1)
    confirmed = []
    for i, c in enumerate(classes):
        test = ~held if i in lonely else held
        own, as_it = (lead[labels] == i) & test, (told == i) & test
        if lead[i] == i and (own & as_it).sum() >= CONFIRMED * max(own.sum(), as_it.sum()):
            confirmed.append(c)
    if not confirmed:
        return net
    # a label is that of a whole document: one that most of its windows deny is wrong
    right = pd.Series(told == labels).groupby([got.lang, got.doc]).transform("mean") >= CONFIRMED
    keep = (got.lang.isin(confirmed) & right).to_numpy()
    return train(windows[keep], got.lang[keep].map(confirmed.index).to_numpy(), confirmed)


_NET = "embed binary, filters binary, bias binary, out binary, out_bias binary, classes array<string>"


def save(net: Network, spark: SparkSession, path: str) -> None:
    """Write a network as a table of one row."""
    parts = [bytearray(np.ascontiguousarray(getattr(net, f), dtype=np.float32).tobytes()) for f in ("embed", "filters", "bias", "out", "out_bias")]
    spark.createDataFrame([(*parts, net.classes)], _NET).coalesce(1).write.mode("overwrite").parquet(path)


def restore(spark: SparkSession, path: str) -> Network:
    """A network that :func:`save` wrote."""
    r = spark.read.schema(_NET).parquet(path).first()
    total, kinds = len(WIDTHS) * FILTERS, len(r["classes"])
    shapes = {"embed": (256, EMBED), "filters": (max(WIDTHS) * EMBED, total), "bias": (total,), "out": (total, kinds), "out_bias": (kinds,)}
    return Network(*[np.frombuffer(r[f], dtype=np.float32).reshape(x) for f, x in shapes.items()], list(r["classes"]))


_COLUMNS = "doc_id long, para_no long, lang string, confidence double, words long, label string, numbered boolean"


def _assign(net: Network):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, names, kinds = Reader(net), np.array(net.classes, dtype=object), len(net.classes)
        prior = np.log(MAIN_SHARE * max(1, kinds - 1) / (1 - MAIN_SHARE))
        for pdf in (whole.iloc[i : i + AT_ONCE] for whole in frames for i in range(0, len(whole), AT_ONCE)):
            n = len(pdf)
            pieces, doc, number = [], [], []
            for i, t in enumerate(pdf.text):
                found = paragraphs(t)
                # a document without numbered paragraphs is one segment of its own, without number
                for no, p in found or [(-1, t or "")]:
                    pieces.append(words_only(p))
                    doc.append(i)
                    number.append(no)
            doc, number = np.array(doc), np.array(number)
            scores, evidence, words = reader.text_scores(pieces)
            share = scores / np.maximum(words, 1)[:, None]
            best = share.argmax(axis=1)
            told = words > 0
            numbered = np.bincount(doc, told & (number >= 0), minlength=n) > 0
            use = np.flatnonzero(told)
            count, weight = np.zeros((n, kinds)), np.zeros((n, kinds))
            np.add.at(count, (doc[use], best[use]), 1)
            np.add.at(weight, (doc[use], best[use]), words[use])
            main = (count + weight / (weight.sum() + 1)).argmax(axis=1)  # the alphabet decides what words don't
            # few words that could be of any language are of the main one
            evidence = evidence / WORDS_EACH
            evidence[np.arange(len(doc)), main[doc]] += prior
            best = np.where(number >= 0, evidence.argmax(axis=1), best)
            sure = share[np.arange(len(doc)), best]
            own = use[best[use] == main[doc[use]]]
            mean = np.bincount(doc[own], sure[own] * words[own], minlength=n) / np.maximum(np.bincount(doc[own], words[own], minlength=n), 1)
            any_words = np.bincount(doc, told, minlength=n) > 0
            ids = pdf.id.to_numpy(dtype=object)
            yield pd.DataFrame({
                "doc_id": ids, "para_no": 0, "lang": np.where(any_words, names[main], None), "confidence": np.where(any_words, mean, np.nan),
                "words": np.bincount(doc, words, minlength=n).astype(np.int64), "label": [label_code(x) for x in pdf.label], "numbered": numbered,
            })
            para = use[number[use] >= 0]
            yield pd.DataFrame({
                "doc_id": ids[doc[para]], "para_no": number[para], "lang": names[best[para]], "confidence": sure[para],
                "words": words[para].astype(np.int64), "label": None, "numbered": True,
            })

    return run


def assign_languages(df: DataFrame, net: Network, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(doc_id, para_no, lang, confidence, words, label, numbered) of every document (``para_no`` 0) and numbered paragraph.

    A document's language is that of most of its numbered paragraphs (ties: more words, then the alphabet), or of its whole text if it has
    none; null where there are no words. Paragraphs without words have no row. ``label`` is the code that the document's own label
    denotes, ``confidence`` the mean probability over the words. Extra columns are ignored; empty input gives no rows.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"))
    return spread(rows).mapInPandas(_assign(net), _COLUMNS)
