"""Language identification by prediction by partial matching.

For every language a context tree of up to two preceding bytes holds byte counts of labelled texts. A byte unseen in
its context escapes to the next shorter one (escape method C: as likely as the number of distinct bytes seen there),
down to the uniform order. The counts are frozen after learning, so the code length of a byte depends on itself and
its two predecessors alone; it is worked out once per context and byte, and a text's exact code length under a
language is a sum of table entries over the whole text. The shortest code wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import held_out, keep_rows, learnable, map_rows

UNKNOWN = "und"
START, BASE = 256, 257  # code of the places before the first byte; number of codes
CHUNK = 1 << 22  # bytes handled at a time; a multiple of all ``SIZES``
SIZES = 2 ** np.arange(2, 13)  # bytes of the stretches that limits are learnt on
LEAST_STRETCHES = 20
SPREAD = 5.0
BINS = 32  # per bit, of the histograms that limits are read from

_LETTER = regex.compile(r"\p{L}")


def codes(text: str) -> np.ndarray:
    """Bytes of the lower-cased text behind two start codes."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    out = np.empty(len(data) + 2, np.int32)
    out[:2] = START
    out[2:] = data
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


@dataclass(frozen=True)
class ContextTrees:
    """``bits[(c2 * size + c1) * size + c, l]``: code length of code c after c2, c1 under language l.

    Codes are places in ``seen``, the bytes met in learning; all others share the last code. With L languages and s
    bytes met, the table has 4 * L * (s + 1) ** 3 bytes; s is at most 257, about 110 for texts in Latin letters.
    """

    languages: list[str]
    lookup: np.ndarray
    size: int
    bits: np.ndarray

    def byte_bits(self, text: str, language: int):
        """Bits of each byte of a text under one language, in parts of ``CHUNK`` bytes."""
        c = self.lookup[codes(text)]
        for at in range(0, len(c) - 2, CHUNK):
            part = c[at : at + CHUNK + 2]
            yield self.bits[(part[:-2] * self.size + part[1:-1]) * self.size + part[2:], language].astype(np.float64)

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of every text under every language, over the whole text."""
        total = np.zeros((len(texts), len(self.languages)))
        for i, text in enumerate(texts):
            c = self.lookup[codes(text)]
            for at in range(0, len(c) - 2, CHUNK):
                part = c[at : at + CHUNK + 2]
                index = (part[:-2] * self.size + part[1:-1]) * self.size + part[2:]
                total[i] += self.bits[index].sum(0, dtype=np.float64)
        return total


def build_trees(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> ContextTrees:
    """From each language's (codes of three consecutive bytes, count)."""
    used = np.zeros(BASE, bool)
    for key, _ in counts:
        for shift in (1, BASE, BASE * BASE):
            used[np.unique(key // shift % BASE)] = True
    used[START] = True
    seen = np.flatnonzero(used)
    size = len(seen) + 1
    lookup = np.full(BASE, size - 1, np.int32)
    lookup[seen] = np.arange(len(seen))
    bits = np.empty((size**3, len(languages)), np.float32)
    for l, (key, n) in enumerate(counts):
        cube = np.zeros((size, size, size))
        at = [lookup[key // shift % BASE] for shift in (BASE * BASE, BASE, 1)]
        np.add.at(cube, tuple(at), n)
        p = np.full(size, 1.0 / size)
        for depth in (0, 1, 2):
            c = cube.sum(axis=tuple(range(2 - depth)))
            total, distinct = c.sum(-1, keepdims=True), (c > 0).sum(-1, keepdims=True)
            weight = np.where(total > 0, total + distinct, 1.0)
            escape = np.where(total > 0, distinct / weight, 1.0)
            p = np.where(c > 0, c / weight, escape * p)
        bits[:, l] = -np.log2(p).reshape(-1)
    return ContextTrees(list(languages), lookup, size, bits)


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two (sorted distinct keys, counts)."""
    key, place = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return key, np.bincount(place, np.concatenate([a[1], b[1]])).astype(np.int64)


def _tally(docs: DataFrame, id_col: str, text_col: str, lang_col: str):
    """(learnable texts with their fold, sorted languages, counts of three bytes by (lang, fold)); None without rows.

    The fold is a bit of a hash of the text, so copies of a text share one.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where(learnable("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not languages:
        return None

    def count(slices):
        tally: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[tuple[str, int], list[np.ndarray]] = {}
        size = 0

        def settle():
            for at, keys in waiting.items():
                found = np.unique(np.concatenate(keys), return_counts=True)
                tally[at] = _added(tally[at], found) if at in tally else found
            waiting.clear()

        for part in slices:
            for lang, fold, text in zip(part["lang"], part["fold"], part["text"]):
                c = codes(text)
                waiting.setdefault((lang, fold), []).append((c[:-2] * BASE + c[1:-1]) * BASE + c[2:])
                size += len(c)
                if size > CHUNK:
                    settle()
                    size = 0
        settle()
        for (lang, fold), (key, n) in tally.items():
            yield {"lang": [lang] * len(key), "fold": [fold] * len(key), "key": key, "n": n}

    fold = F.pmod(F.xxhash64(F.lit(6), "text"), F.lit(2)).cast("int").alias("fold")
    texts = known.select("lang", fold, "text")
    grams = map_rows(texts, count, "lang string, fold int, key int, n long")
    found = grams.groupBy("lang", "fold", "key").agg(F.sum("n").alias("n")).toPandas()
    return texts, languages, found  # no more rows than there are sequences of three bytes, by language and fold


def _trees(languages: list[str], found) -> ContextTrees:
    by, empty = dict(list(found.groupby("lang"))), found.iloc[:0]
    return build_trees(languages, [
        (by.get(lang, empty)["key"].to_numpy(np.int64), by.get(lang, empty)["n"].to_numpy()) for lang in languages
    ])


def _no_trees() -> ContextTrees:
    return ContextTrees([], np.zeros(BASE, np.int32), 1, np.zeros((1, 0), np.float32))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ContextTrees:
    """Trees of every language met on learnable rows, from all of their texts.

    Returns no languages if no row can be learnt from.
    """
    tally = _tally(docs, id_col, text_col, lang_col)
    return _trees(*tally[1:]) if tally else _no_trees()


def _limits(texts: DataFrame, languages: list[str], found) -> dict[str, np.ndarray]:
    """Of every language the highest bits per byte that its texts of at least each of ``SIZES`` bytes may need.

    Each half of the texts is coded by the trees of the other half. Among all stretches of one size the limit is the
    median and ``SPREAD`` times the way from there to the 99th percentile, but no more than the 8 bits of a byte left as
    it is unless that percentile is. A size with fewer than ``LEAST_STRETCHES`` takes the limit of the next smaller one;
    a language without any such size has no limit.
    """
    halves = [_trees(languages, found[found["fold"] != fold]) for fold in (0, 1)]
    model = texts.sparkSession.sparkContext.broadcast(halves)

    def measure(slices):
        place = {lang: l for l, lang in enumerate(languages)}
        for part in slices:
            tally: dict[tuple[str, int], np.ndarray] = {}
            for lang, fold, text in zip(part["lang"], part["fold"], part["text"]):
                if not has_letter(text):
                    continue
                for bits in model.value[fold].byte_bits(text, place[lang]):
                    sums = np.concatenate([[0.0], np.cumsum(bits)])
                    for size in SIZES[SIZES < len(sums)]:
                        bins = np.minimum(np.diff(sums[::size]) / size * BINS, 64 * BINS - 1).astype(np.int64)
                        at = lang, int(size)
                        tally[at] = tally.get(at, 0) + np.bincount(bins, minlength=64 * BINS)
            for (lang, size), n in tally.items():
                at = np.flatnonzero(n)
                yield {"lang": [lang] * len(at), "size": [size] * len(at), "bin": at, "n": n[at]}

    counted = map_rows(texts, measure, "lang string, size int, bin int, n long")
    stretches = counted.groupBy("lang", "size", "bin").agg(F.sum("n").alias("n")).toPandas().sort_values("bin")
    model.unpersist()
    limits = {lang: np.full(len(SIZES), np.inf) for lang in languages}
    for (lang, size), part in stretches.groupby(["lang", "size"]):
        below = part["n"].cumsum().to_numpy()
        if below[-1] >= LEAST_STRETCHES:
            half, most = (part["bin"].to_numpy()[np.searchsorted(below, q * below[-1])] + 1 for q in (0.5, 0.99))
            limits[lang][SIZES == size] = max(most, min(8 * BINS, half + SPREAD * (most - half))) / BINS
    for found_limits in limits.values():
        for i in range(1, len(SIZES)):
            if np.isinf(found_limits[i]):
                found_limits[i] = found_limits[i - 1]
    return limits


def learn_limits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang") -> tuple[ContextTrees, dict[str, np.ndarray]]:
    """The trees of ``learn`` and the limits that texts of each language keep to."""
    tally = _tally(docs, id_col, text_col, lang_col)
    return (_trees(*tally[1:]), _limits(*tally)) if tally else (_no_trees(), {})


def posteriors(bits: np.ndarray) -> np.ndarray:
    """Share of each language when all are equally likely beforehand."""
    p = np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000.0))
    return p / p.sum(1, keepdims=True)


def predict_texts(trees: ContextTrees, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Ties go to the first language by name; NULL and letterless texts are ``und`` with score 0."""
    lang, score, _ = _predicted(trees, texts)
    return lang, score


def _predicted(trees: ContextTrees, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Languages, scores, and the bits each text takes under its language."""
    lang, score, taken = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    read = [i for i, t in enumerate(texts) if trees.languages and has_letter(t)]
    if read:
        bits = trees.code_lengths([texts[i] for i in read])
        share = posteriors(bits)
        for i, best, p, row in zip(read, bits.argmin(1), share, bits):
            lang[i], score[i], taken[i] = trees.languages[best], float(p[best]), float(row[best])
    return lang, score, taken


def within_limits(limits: dict[str, np.ndarray], lang: str, text: str, bits: float) -> bool:
    """Whether a text takes no more bits per byte than texts of its size in this language do."""
    n = len(codes(text)) - 2
    return bits <= limits[lang][max(0, int(np.searchsorted(SIZES, n, "right")) - 1)] * n


def identify(docs: DataFrame, trees: ContextTrees | None = None, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row; ``score`` is the language's share among the learnt ones.

    Only texts are scored. NULL, empty and letterless texts are ``und``. A NULL id is scored, not held out and never
    learnt from; a NULL language is not learnt. Repeated rows are scored each. Without any learnable row all texts
    are ``und``. Other columns are not read.
    """
    trees = trees or learn(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    kind = docs.schema[id_col].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(slices):
        for rows in slices:
            lang, score = predict_texts(model.value, rows["text"])
            yield {"id": rows["id"], "lang_pred": lang, "score": score}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = map_rows(rows, run, f"id {kind}, lang_pred string, score double")
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, trees: ContextTrees | None = None, least: float = 0.5, id_col: str = "doc_id",
                    text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of ``docs`` with a predicted language that also fits them; odd cases as in ``identify``.

    The score says which of the learnt languages is nearest, never that it is near: it must be at least ``least``, and
    the bits per byte of the whole text must lie within the limits learnt for that language and size (``_limits``). A
    language of ``trees`` that ``docs`` hold no learnable text of has no limit.
    """
    learnt, limits = learn_limits(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    model = docs.sparkSession.sparkContext.broadcast(trees or learnt)

    def wanted(texts):
        lang, score, bits = _predicted(model.value, texts)
        return [known != UNKNOWN and share >= least and (known not in limits or within_limits(limits, known, text, taken))
                for known, share, text, taken in zip(lang, score, texts, bits)]

    return keep_rows(docs, text_col, wanted)
