"""Toxicity by a weighted lexicon and an Aho-Corasick automaton.

Text is folded before matching: lower case, compatibility forms, look-alike letters of other
scripts and digits or signs that stand for letters; all else becomes a blank. The automaton holds
words and word beginnings with weights, and exception phrases; a match inside an exception counts
nothing. The sum of weights is divided by the length, and a logistic curve turns it into a score.

The lexicon starts from a few fixed words and learns more from labelled rows: terms that many
toxic documents hold and few others, ranked over all terms. Rows are learned from by a bounded sample (``SAMPLE`` of
either class, chosen by a hash of the id); scoring covers every whole text.

Defined results: a null or empty text is scored as one without matches; labels that are null, or
whose document is missing, teach nothing; an id with several labels teaches by the largest;
without usable labels the fixed words alone decide; repeated rows are each scored, and an empty table gives no row. Terms
of equal rank are taken in the order of their length, then letters. Labels, language, source and id are no inputs of a score,
and columns of any name are kept. The time for a text grows with its length times the logarithm of its exceptions.
"""

from __future__ import annotations

import bisect
import itertools
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from . import pieces as px
from .workspace import unused

# Words that are insults by themselves.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "worthless", "pathetic", "disgusting")
# Phrases in which such words are none.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "class clown", "trash collection")

#: Labelled rows of either class that are learned from.
SAMPLE = 8000
THRESHOLD = 0.3
#: Lengths of word beginnings that may become terms.
LEAST, MOST = 4, 12
#: The size of the model: the terms of a lexicon, taken in order of rank. No row is left out by it.
TERMS = 400

# Letters of other scripts that look like Latin ones, then signs that stand for letters.
_LOOKALIKES = dict(zip("авеікмнорстухѕјԁһɡαεικνορτυχω", "abeikmhopctyxsjdhgaeikvoptuxw", strict=True))
_SIGNS = dict(zip("013457@$", "oieastas", strict=True))


class _Fold(dict):
    """Code point to folded letter, worked out at first use."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        low = unicodedata.normalize("NFKC", c).lower()
        low = _LOOKALIKES.get(low, _SIGNS.get(low, low))
        if unicodedata.category(c) in ("Cf", "Mn"):
            low = ""  # invisible or combining
        elif not low.isalpha():
            low = " "
        self[code] = low
        return low


_FOLD = _Fold()


def fold(text: str) -> str:
    return text.translate(_FOLD)


def terms_of(words: set[str]) -> set[str]:
    """Whole words (with a blank at the end) and beginnings."""
    return {f"{w} " for w in words if len(w) >= LEAST} | {w[:k] for w in words for k in range(LEAST, min(len(w), MOST) + 1)}


class Lexicon:
    """Weighted terms, exceptions and the logistic curve."""

    def __init__(self, weights: dict[str, float], intercept: float = -3.0, slope: float = 3.0, without: float = 0.01):
        self.weights, self.intercept, self.slope, self.without = weights, intercept, slope, without

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for term, w in self.weights.items():
            out.add_word(" " + term, (len(term) + 1, w))
        for phrase in EXCEPTIONS:
            out.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
        out.make_automaton()
        return out

    @staticmethod
    def load(automaton, text: str) -> float:
        """The sum of weights for each word, on a log scale."""
        folded = " " + " ".join(fold(text).split()) + " "
        hits = [(end - size + 1, end, w) for end, (size, w) in automaton.iter(folded)]
        if not hits:
            return 0.0
        # hits come by their ends; of the exceptions that start at or before a place the farthest end counts
        safe = sorted((a, b) for a, b, w in hits if not w)
        starts, reach = [a for a, _ in safe], list(itertools.accumulate((b for _, b in safe), max))
        total: dict[int, float] = {}
        for a, b, w in hits:  # the heaviest term of each word
            if w:
                k = bisect.bisect_right(starts, a)
                if not k or reach[k - 1] < b:
                    total[a] = max(total.get(a, 0.0), w)
        return math.log1p(100 * sum(total.values()) / (folded.count(" ") + 50)) if total else 0.0

    def score(self, load: float) -> float:
        """A text without matches has the share of toxic ones among such; the curve holds for the others."""
        return max(self.without, 1 / (1 + math.exp(-(self.intercept + self.slope * load)))) if load else self.without


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            count.update(terms_of(set(fold(text or "").split())))
    yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])


def _loads(lexicon: Lexicon):
    def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.load(automaton, t or "") for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], ["load", "toxic"])

    return loads


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, terms: int = TERMS) -> Lexicon:
    """Fit a lexicon of ``terms`` terms at most on about ``sample`` labelled rows of either class at
    most; ``usable`` is a condition on the column ``id``."""
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1))
    if usable is not None:
        rows = rows.filter(usable)
    rows = rows.groupBy("id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    seeds = Lexicon({f"{w} ": 4.0 for w in SEEDS})
    if not n.get(0) or not n.get(1):
        return seeds
    part = {k: min(1.0, sample / v) for k, v in n.items()}
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, part[1] * 1e6).otherwise(part[0] * 1e6)
    chosen = F.broadcast(rows.filter(draw))  # about 2 * sample rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("text", "toxic")
    toxic, clean = texts.filter("toxic = 1").select("text"), texts.filter("toxic = 0").select("text")
    size = {k: max(1.0, part[k] * n[k]) for k in n}
    least = max(3, round(0.004 * size[1]))
    counted = lambda rows, name: rows.mapInArrow(_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias(name))
    t, c = F.col("t"), F.coalesce("c", F.lit(0))
    p, q, pooled = t / F.lit(size[1]), c / F.lit(size[0]), (t + c) / F.lit(size[1] + size[0])
    z = (p - q) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * F.lit(1 / size[1] + 1 / size[0]))
    weight = F.log((t + 0.5) / F.lit(size[1] + 1)) - F.log((c + 0.5) / F.lit(size[0] + 1))
    held = counted(toxic, "t").filter(t >= least).join(counted(clean, "c"), "term", "left")
    held = held.select("term", t, c.alias("c"), z.alias("z"), weight.alias("weight")).filter((F.col("z") > 5) & (F.col("weight") > math.log(8)))
    weights = dict(seeds.weights)
    # all terms are ranked where they are, and read here until the lexicon is full
    for r in held.orderBy((F.col("z") * F.col("weight")).desc(), F.length("term"), "term").toLocalIterator():
        if len(weights) >= terms:
            break
        term = r["term"]
        if not any(term.startswith(known.rstrip(" ")) or known.startswith(term.rstrip(" ")) for known in weights):
            weights[term] = min(math.log((r["t"] + 0.5) / (size[1] + 1)) - math.log((r["c"] + 0.5) / (size[0] + 1)), 6.0)
    lexicon = Lexicon(weights)
    got = texts.mapInArrow(_loads(lexicon), "load double, toxic int").collect()  # as many pairs as the sample
    return _calibrate(lexicon, np.array([r["load"] for r in got]), np.array([r["toxic"] for r in got], float), part)


def _calibrate(lexicon: Lexicon, x: np.ndarray, y: np.ndarray, part: dict[int, float]) -> Lexicon:
    """Logistic regression on the load, with weights that undo the sampling, by Newton's steps."""
    weight = np.where(y == 1, 1 / part[1], 1 / part[0])
    none = x == 0
    without = min(float((weight * y)[none].sum() / weight[none].sum()), 0.2) if none.any() else 0.01
    x, y, weight = x[~none], y[~none], weight[~none]
    if not len(x):
        return Lexicon(lexicon.weights, without=without)
    weight = weight / weight.mean()
    a, design = np.array([-3.0, 3.0]), np.stack([np.ones(len(x)), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        ridge = np.array([1e-3, 1e-1])
        gradient = design.T @ (weight * (y - p)) - ridge * (a - [-3.0, 3.0])
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(ridge), gradient)
        a = a + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Lexicon(lexicon.weights, float(a[0]), float(max(a[1], 0.1)), without)


def score_texts(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, and last ``toxicity`` (0 to 1), or ``toxicity_1`` and so on
    where a column is called so."""
    at, name = docs.columns.index(text_col), unused(docs.columns, "toxicity")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            got, texts = [], px.text_column(batch.column(at))
            for lo, hi in px.slices(texts):
                got += [lexicon.score(lexicon.load(automaton, t)) for t in texts.slice(lo, hi - lo).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(px.releasing(score), StructType([*docs.schema.fields]).add(name, DoubleType()))


def keep_clean(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their own columns alone."""
    scored = score_texts(docs, lexicon, text_col)
    return scored.filter(F.col(scored.columns[-1]) < threshold).drop(scored.columns[-1])


def held_out(id_column: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))
