"""Language identification by interpolated Kneser-Ney character models, one a language.

Text becomes lower-case letters and single spaces (any other run is one space). Each language's model of order 4 is trained in
numpy on a bounded sample of whole labelled texts. All languages share one sorted array of 64-bit n-gram hashes an order, with
a row of log-probabilities (and context weights) by language, so a character costs one binary search, and a few more where the
longest n-gram is unknown. A text goes to the language of the lowest cross-entropy per character.

Rejection is calibrated on a quarter of the sample, which isn't trained on: a text is rejected if its cross-entropy is above
that language's calibrated mean by ``SLACK`` nats and a width that shrinks as one over the root of its length. ``score`` is a
logistic of the two best languages' difference, at a temperature fitted on the same quarter.

Bounds: the sample has about ``SAMPLE_DOCS`` texts a language, of which those that fit ``SAMPLE_CHARS`` characters are used, whole
texts only (if none fits, the shortest text of the language); more than ``MAX_LANGUAGES`` languages are an error. Lengths are
looked at first, so only the texts used come to the driver. The model is sent to the workers; it doesn't grow with the corpus
but with the languages: 4 bytes an n-gram that any language knows and language, 4 MB for the four languages at hand and about
1 GB for 60 of them.

Defined results: null text, or no letters, gives ``und``, score 0 and rejected; null languages aren't learned; ties go to the
language that sorts first; without any labelled text all is ``und``; repeated rows are judged alike; an empty table gives an
empty one. Memory: a slice of whole texts of ``SLICE_BYTES``, or the longest text, about 150 bytes a byte of it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDER = 4
SAMPLE_DOCS, SAMPLE_CHARS, MAX_LANGUAGES = 300, 400_000, 200
SLACK, REJECT_RATE = 1.0, 0.001
#: Code points above hold no letters (planes 4 and up: marks of variation, private use, unassigned), which a test checks.
_TABLE = 0x40000
_tables: list = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """(symbol, letter) by code point: symbols are lower case for letters and marks, 32 for all else; only L* are letters.

    The last entry stands for all code points from ``_TABLE`` on.
    """
    if not _tables:
        symbol, letter = np.full(_TABLE + 1, 32, np.uint32), np.zeros(_TABLE + 1, bool)
        for c in range(_TABLE):
            kind = unicodedata.category(chr(c))
            if kind[0] in "LM":
                low = chr(c).lower()
                symbol[c] = ord(low) if len(low) == 1 else c
                letter[c] = kind[0] == "L"
        _tables.append(symbol)
        _tables.append(letter)
    return _tables[0], _tables[1]


def symbols(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, document of each, letters per document): every text is led by order - 1 marks (0), which count as spaces."""
    table, letter = _letters()
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.minimum(code, _TABLE)
    sym = table[code]
    doc = np.repeat(np.arange(len(texts)), lengths)
    starts = np.cumsum(lengths) - lengths
    letters = np.bincount(doc, weights=letter[code], minlength=len(texts)).astype(np.int64)
    at = np.repeat(starts, order - 1)
    sym = np.insert(sym, at, 0)
    doc = np.insert(doc, at, np.repeat(np.arange(len(texts)), order - 1))
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 32) | ((sym[:-1] != 32) & (sym[:-1] != 0))
    return sym[keep], doc[keep], letters


def _spaces(sym: np.ndarray) -> np.ndarray:
    return np.where(sym == 0, np.uint32(32), sym)


class _One:
    """Counts and probabilities of one language, by order."""

    def __init__(self, texts: list[str], order: int):
        sym, _, _ = symbols(texts, order)
        s = _spaces(sym)
        predicted = np.flatnonzero(sym != 0)
        self.keys, self.context, self.suffix, counts = [None] * (order + 1), [None] * (order + 1), [None] * (order + 1), [None] * (order + 1)
        hashes = [None] + [C.rolling(s, n) for n in range(1, order + 1)]
        at = predicted - (order - 1)
        for n in range(order, 0, -1):
            begin = at + (order - n)
            if n == order:
                keys, first, count = np.unique(hashes[n][begin], return_index=True, return_counts=True)
                where = begin[first]
            else:  # continuation counts: how many different longer n-grams end with it
                keys, first, count = np.unique(hashes[n][where + 1], return_index=True, return_counts=True)
                where = (where + 1)[first]
            self.keys[n], counts[n] = keys, count.astype(np.float64)
            self.context[n] = hashes[n - 1][where] if n > 1 else np.zeros(len(keys), np.uint64)
            self.suffix[n] = hashes[n - 1][where + 1] if n > 1 else np.zeros(len(keys), np.uint64)
        self.p, self.weight_keys, self.weights = [None] * (order + 1), [None] * (order + 1), [None] * (order + 1)
        for n in range(1, order + 1):
            count = counts[n]
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.75
            contexts, inverse = np.unique(self.context[n], return_inverse=True)
            total = np.bincount(inverse, count)
            weight = discount * np.bincount(inverse) / total
            lower = self.p[n - 1][np.searchsorted(self.keys[n - 1], self.suffix[n])] if n > 1 else 1.0 / (len(count) + 1)
            self.p[n] = np.maximum(count - discount, 0) / total[inverse] + weight[inverse] * lower
            self.weight_keys[n], self.weights[n] = contexts, weight
        self.floor = self.weights[1][0] / (len(counts[1]) + 1) if len(counts[1]) else 1.0


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


class Model:
    """All languages' models merged: sorted n-gram hashes by order, log-probabilities and log context weights by language."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.order, self.languages = order, sorted(texts)
        ones = [_One(texts[x], order) for x in self.languages]
        n_lang = len(ones)
        self.keys, self.logp, self.context_keys, self.logw = [None], [None], [None], [None]
        for n in range(1, order + 1) if ones else ():
            keys, first = np.unique(np.concatenate([o.keys[n] for o in ones]), return_index=True)
            context, suffix = (np.concatenate([getattr(o, a)[n] for o in ones])[first] for a in ("context", "suffix"))
            contexts = np.unique(np.concatenate([o.weight_keys[n] for o in ones]))
            logp, logw = np.empty((len(keys), n_lang), np.float32), np.zeros((len(contexts), n_lang), np.float32)
            for k, o in enumerate(ones):
                at, ok = _find(o.weight_keys[n], contexts)
                logw[ok, k] = np.log(o.weights[n][at[ok]])
                at, ok = _find(o.keys[n], keys)
                lower = self.logp[n - 1][np.searchsorted(self.keys[n - 1], suffix), k] if n > 1 else np.full(len(keys), np.log(o.floor) - logw[0, k])
                logp[:, k] = lower + logw[np.searchsorted(contexts, context), k]
                logp[ok, k] = np.log(o.p[n][at[ok]])
            self.keys.append(keys)
            self.logp.append(logp)
            self.context_keys.append(contexts)
            self.logw.append(logw)
        self.unknown = np.array([np.log(o.floor) for o in ones], np.float32)
        self.mean, self.width, self.temperature = np.zeros(n_lang), 1e9, 10.0

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy per character by language, characters scored, letters) of each text."""
        sym, doc, letters = symbols(texts, self.order)
        s = _spaces(sym)
        ends = np.flatnonzero(sym != 0)
        logp = np.zeros((len(ends), len(self.languages)), np.float32)
        todo = np.arange(len(ends))
        for n in range(self.order, 0, -1):
            if not len(todo):
                break
            keys = C.rolling(s, n)[ends[todo] - (n - 1)]
            at, ok = _find(self.keys[n], keys)
            logp[todo[ok]] += self.logp[n][at[ok]]
            todo = todo[~ok]
            if n > 1 and len(todo):
                at, ok = _find(self.context_keys[n], C.rolling(s, n - 1)[ends[todo] - (n - 1)])
                logp[todo[ok]] += self.logw[n][at[ok]]
        logp[todo] += self.unknown
        owner = doc[ends]
        n_chars = np.bincount(owner, minlength=len(texts))
        total = np.stack([np.bincount(owner, logp[:, k], len(texts)) for k in range(len(self.languages))], 1) if len(self.languages) else np.zeros((len(texts), 0))
        return -total / np.maximum(n_chars, 1)[:, None], n_chars, letters

    def calibrate(self, texts: dict[str, list[str]]) -> None:
        seen, means = [], {}
        for k, x in enumerate(self.languages):
            if texts.get(x):
                h, n, letters = self.entropies(texts[x])
                ok = letters > 0
                if ok.any():
                    means[k] = np.average(h[ok, k], weights=n[ok])
                    seen.append((k, h[ok], n[ok]))
        self.mean = np.array([means.get(k, max(means.values(), default=1e9)) for k in range(len(self.languages))])
        excess = [(h[:, k] - means[k] - SLACK) * np.sqrt(n) for k, h, n in seen]
        if excess:
            self.width = 1.5 * max(1.0, float(np.quantile(np.concatenate(excess), 1 - REJECT_RATE)))
        if seen and len(self.languages) > 1:
            gaps = np.concatenate([(np.delete(h, k, 1).min(1) - h[:, k]) * n for k, h, n in seen])
            tries = np.geomspace(0.5, 200, 30)
            self.temperature = float(tries[np.argmin([np.logaddexp(0, -gaps / t).mean() for t in tries])])

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        h, n, letters = self.entropies(texts)
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        if len(self.languages) > 1:
            gap = (np.partition(h, 1, axis=1)[:, 1] - low) * n
        else:
            gap = np.full(len(h), np.inf)
        blank = letters == 0
        score = np.where(blank, 0.0, 1 / (1 + np.exp(-np.minimum(gap / self.temperature, 700))))
        rejected = blank | (low > self.mean[best] + SLACK + self.width / np.sqrt(np.maximum(n, 1)))
        return ["und" if b else self.languages[k] for b, k in zip(blank, best)], score, rejected


def train(docs: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learns from a sample of the rows where ``usable``; which rows are drawn depends on their key alone."""
    d = docs.filter(usable & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").cast("string").alias("key"))
    counts = dict(d.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect())
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return Model({})
    draw = F.pmod(F.xxhash64("key", F.lit(17)), F.lit(1_000_003)) / 1_000_003
    share = F.coalesce(*[F.when(F.col("lang") == x, min(1.0, sample_docs / n)) for x, n in counts.items()])
    # which texts fit is decided on their lengths; only those come to the driver
    drawn = d.withColumns({"o": F.xxhash64("key", F.lit(3)), "size": F.length("text")}).filter(draw < share)
    used: dict[str, int] = {}
    wanted = []
    for x, o, size in sorted(tuple(r) for r in drawn.select("lang", "o", "size").collect()):
        if used.get(x, 0) + size <= sample_chars:
            used[x] = used.get(x, 0) + size
            wanted.append((x, o, size))
    short = [x for x in counts if x not in used]  # no drawn text is short enough: the shortest of all stands in
    rows = drawn.join(F.broadcast(docs.sparkSession.createDataFrame(wanted, "lang string, o bigint, size int")), ["lang", "o", "size"], "left_semi").select("lang", "o", "text")
    if short:
        least = d.filter(F.col("lang").isin(short)).groupBy("lang").agg(F.min_by("text", F.struct(F.length("text"), F.xxhash64("key", F.lit(3)))).alias("text"))
        rows = rows.union(least.select("lang", F.lit(0).cast("long"), "text"))
    fit: dict[str, list[str]] = {}
    held: dict[str, list[str]] = {}
    for i, (x, _, t) in enumerate(sorted(tuple(r) for r in rows.collect())):
        (held if i % 4 == 3 and x in fit else fit).setdefault(x, []).append(t)
    model = Model({x: t for x, t in fit.items()})
    model.calibrate(held)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected; columns of these names, in any case, are replaced, all others pass through unread."""
    new = ["lang_pred", "score", "rejected"]
    carried = [c for c in docs.columns if c.lower() not in new]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried), "lang_pred string", "score double", "rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = C.utf8(batch.column(text))
            raw = buf.tobytes()
            langs: list = []
            scores, rejected = [np.zeros(0)], [np.zeros(0, bool)]
            for i, j in C.slices(off, C.SLICE_BYTES // 2):
                got = shared.value.predict([raw[off[k] : off[k + 1]].decode() for k in range(i, j)])
                langs += got[0]
                scores.append(got[1])
                rejected.append(got[2])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(rejected))], names=[*carried, *new])

    return docs.select(*[f"`{c}`" for c in carried]).mapInArrow(run, schema)
