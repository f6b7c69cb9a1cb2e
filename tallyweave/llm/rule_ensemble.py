"""Quality classifier: a sparse ensemble of conjunctive rules.

Shallow trees over text statistics give candidate rules (the paths from a root), an L1-penalised logistic regression
keeps few of them, and those become Spark column expressions. Two ensembles are fitted on ``labels``: one for quality,
one for toxicity. A document is kept when its quality is at least KEEP_QUALITY and its toxicity at most DROP_TOXICITY.

Fitting takes at most SAMPLE labelled rows (those of least hash of the id), the only bound here; scoring sees all
rows and whole texts. Terms that mark toxic texts are themselves learned: words of at least TERM_LEAST toxic documents,
TERM_PRECISION of whose documents are toxic, and so often that chance (a one-sided binomial test at the sample's rate of
toxic rows, TERM_CHANCE shared out among all its words) doesn't explain it. How many of the toxic rows hold a word
doesn't count, so a small language or a varied vocabulary is learned too. Copies of one text, whole or edited, aren't
independent: texts with the same least hash of three words in a row count once.

Defined results: a null id or text has no score, and ``keep_accepted`` keeps its row; an empty text has zero in every
statistic; texts are scored whole; with under two leaves of labelled rows (an empty table of labels too), or rows of one
class only, a model has no rules and says 0.5 of every text, which rejects nothing; an empty table of documents gives an
empty result. Of repeated labels for an id, the least of each column counts; repeated rows are each scored. Of paths that
hold for the same sample rows the shortest stands, ties by feature and cut; ties in the hash that picks the sample go to
the smaller id. Extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import id_text, picked, place, positional, table

SAMPLE = 8192
TREES, DEPTH, CUTS, LEAST_LEAF = 40, 3, 24, 8
PENALTY, STEPS = 0.15, 400  # the penalty is in units of the noise, sqrt(log(rules) / rows)
KEEP_QUALITY, DROP_TOXICITY = 0.5, 0.5
TERM_PRECISION, TERM_LEAST, TERM_CHANCE = 0.9, 6, 0.01
MARKS = "%#$*&!|"
FEATURES = ["n_words", "distinct_share", "repeat_share", "caps_share", "word_length", "marks_per_word", "stops_per_word", "line_repeat_share", "words_per_line", "flagged"]

Path = tuple[tuple[int, bool, float], ...]  # (feature, greater, cut)


def statistics(texts: DataFrame, terms: list[str], text: str = "_tw_text", only: set[str] | None = None) -> DataFrame:
    """``texts`` with the columns of FEATURES (or those of ``only``), named _tw_<feature>; built-in expressions only."""
    body = F.col(text)
    lines = F.split(body, "\n", -1)
    df = texts.withColumns({"_tw_words": F.filter(F.split(body, r"\s+"), lambda w: w != ""), "_tw_lines": F.filter(lines, lambda x: x != "")})
    words, kept_lines = F.col("_tw_words"), F.col("_tw_lines")
    n, m = F.size(words), F.size(kept_lines)
    per = lambda x, d: F.when(d > 0, x / d).otherwise(0.0).cast("double")
    among = lambda marks: F.char_length(body) - F.char_length(F.translate(body, marks, ""))
    flagged = F.size(F.array_intersect(F.split(F.lower(body), r"[^\p{L}]+"), F.array(*map(F.lit, terms)))) if terms else F.lit(0)
    made = {
        "n_words": n.cast("double"),
        "distinct_share": per(F.size(F.array_distinct(words)), n),
        "repeat_share": per(F.size(F.filter(words, lambda w, i: F.get(words, i - 1) == w)), n),
        "caps_share": per(F.size(F.filter(words, lambda w: (w == F.upper(w)) & (w != F.lower(w)))), n),
        "word_length": per(F.char_length(body), n),
        "marks_per_word": per(among(MARKS), n),
        "stops_per_word": per(among(".,"), n),
        "line_repeat_share": per(m - F.size(F.array_distinct(kept_lines)), m),
        "words_per_line": per(n, m),
        "flagged": flagged.cast("double"),
    }
    return df.withColumns({f"_tw_{k}": v for k, v in made.items() if only is None or k in only}).drop("_tw_words", "_tw_lines")


@dataclass(frozen=True)
class Rules:
    """A fitted ensemble: log-odds are ``bias`` plus the weights of the paths that hold."""

    bias: float
    paths: tuple[Path, ...]
    weights: tuple[float, ...]

    def column(self) -> Column:
        """Probability as a column over the _tw_ statistics."""
        odds = F.lit(self.bias)
        for path, weight in zip(self.paths, self.weights):
            holds = F.lit(True)
            for k, greater, cut in path:
                c = F.col(f"_tw_{FEATURES[k]}")
                holds &= (c > cut) if greater else (c <= cut)
            odds += F.when(holds, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))

    def features(self) -> set[str]:
        return {FEATURES[k] for path in self.paths for k, _, _ in path}

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + holding(self.paths, x) @ np.array(self.weights, dtype=float))))


def holding(paths: tuple[Path, ...], x: np.ndarray) -> np.ndarray:
    """1.0 where a row of ``x`` meets a path."""
    out = np.ones((len(x), len(paths)))
    for j, path in enumerate(paths):
        for k, greater, cut in path:
            out[:, j] *= (x[:, k] > cut) if greater else (x[:, k] <= cut)
    return out


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, path: Path, found: set[Path]) -> None:
    if path:
        found.add(path)
    if len(path) == DEPTH or len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return
    best = (1e-9, -1, 0.0)
    mean = y.mean()
    for k in rng.choice(x.shape[1], size=max(1, x.shape[1] // 2), replace=False):
        cuts = np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 1)[:-1], method="lower"))
        low = x[:, k, None] <= cuts
        n = low.sum(axis=0)
        ok = (n >= LEAST_LEAF) & (len(y) - n >= LEAST_LEAF)
        if not ok.any():
            continue
        s = y @ low
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, s * s / n + (y.sum() - s) ** 2 / (len(y) - n) - len(y) * mean * mean, -1)
        j = int(np.argmax(gain))
        if gain[j] > best[0]:
            best = (float(gain[j]), int(k), float(cuts[j]))
    _, k, cut = best
    if k < 0:
        return
    above = x[:, k] > cut
    for greater, part in ((False, ~above), (True, above)):
        _grow(x[part], y[part], rng, (*path, (k, greater, cut)), found)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Rules:
    """Trees on bootstrap samples, then proximal gradient steps on the lasso logistic loss over their paths."""
    if len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return Rules(0.0, (), ())
    bias = float(np.log(y.mean() / (1 - y.mean())))
    rng = np.random.default_rng(seed)
    found: set[Path] = set()
    for _ in range(TREES):
        take = rng.integers(0, len(y), len(y))
        _grow(x[take], y[take], rng, (), found)
    paths, seen = [], set()
    for path in sorted(found, key=lambda p: (len(p), p)):  # of paths that hold for the same rows, the shortest
        mark = holding((path,), x)[:, 0].astype(bool)
        if mark.any() and not mark.all() and (key := mark.tobytes()) not in seen:
            seen.add(key)
            paths.append(path)
    if not paths:
        return Rules(bias, (), ())
    a = holding(tuple(paths), x)
    step = 4.0 / max(np.linalg.norm(np.column_stack((a, np.ones(len(a)))), 2) ** 2 / len(y), 1e-9)
    w, c, t = np.zeros(a.shape[1]), bias, 1.0
    wm, cm = w, c
    penalty = PENALTY * float(np.sqrt(np.log(len(paths) + 1) / len(y)))
    for _ in range(STEPS):
        slope = 1 / (1 + np.exp(-(a @ wm + cm))) - y
        new = wm - step * (a.T @ slope) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_c = cm - step * slope.mean()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wm, cm = new + (t - 1) / t_next * (new - w), new_c + (t - 1) / t_next * (new_c - c)
        w, c, t = new, new_c, t_next
    used = np.flatnonzero(np.abs(w) > 1e-4)
    return Rules(float(c), tuple(paths[j] for j in used), tuple(float(round(w[j], 6)) for j in used))


@dataclass(frozen=True)
class Classifier:
    terms: tuple[str, ...]
    quality: Rules
    toxicity: Rules

    def scored(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """``df``, none of whose columns begins with _tw_, with _tw_quality and _tw_toxicity, null where the text is.

        Only the statistics that the rules ask for are computed.
        """
        made = statistics(df.withColumn("_tw_text", df[text_col].cast("string")), list(self.terms), only=self.quality.features() | self.toxicity.features())
        known = F.col("_tw_text").isNotNull()
        return made.withColumns({"_tw_quality": F.when(known, self.quality.column()), "_tw_toxicity": F.when(known, self.toxicity.column())})


def accepted() -> Column:
    return (F.col("_tw_quality") >= KEEP_QUALITY) & (F.col("_tw_toxicity") <= DROP_TOXICITY)


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(_tw_text, quality, toxic) of at most SAMPLE labelled documents, chosen by hash of their id."""
    marks = picked(labels, _tw_id="doc_id", quality="quality", toxic="toxic").select(F.col("_tw_id").cast("long"), F.col("quality").cast("int"), F.col("toxic").cast("int"))
    marks = marks.dropna().groupBy("_tw_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("_tw_id"), "_tw_id").limit(SAMPLE)
    texts = id_text(docs)
    return texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["_tw_id"]).select(F.col("text").alias("_tw_text"), "quality", "toxic")


def chance(hit: int, n: int, rate: float) -> float:
    """Probability of at least ``hit`` toxic documents among ``n`` at a rate between 0 and 1."""
    each = (lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(rate) + (n - k) * log(1 - rate) for k in range(hit, n + 1))
    return sum(map(exp, each))


def toxic_terms(sample: DataFrame) -> list[str]:
    row = F.split(F.lower("_tw_text"), r"\s+")
    grams = F.transform(F.arrays_zip(row, F.slice(row, 2, F.size(row)), F.slice(row, 3, F.size(row))), lambda s: F.xxhash64(s))
    words = sample.withColumn("text_key", F.array_min(grams)).select("text_key", "toxic", F.explode(F.array_distinct(F.split(F.lower("_tw_text"), r"[^\p{L}]+"))).alias("word")).filter("word <> ''")
    toxic, rows = sample.agg(F.count_if(F.col("toxic") > 0), F.count("*")).first()
    if not 0 < toxic < rows:
        return []
    counts = words.groupBy("word", "text_key").agg(F.max("toxic").alias("toxic")).groupBy("word").agg(F.count_if(F.col("toxic") > 0).alias("hit"), F.count("*").alias("n")).persist()
    try:
        tested = counts.count()
        likely = counts.filter((F.col("hit") >= TERM_LEAST) & (F.col("hit") >= TERM_PRECISION * F.col("n"))).collect()
    finally:
        counts.unpersist()
    return sorted(r["word"] for r in likely if chance(r["hit"], r["n"], toxic / rows) * tested <= TERM_CHANCE)


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    sample = labelled_sample(docs, labels).persist()
    try:
        terms = toxic_terms(sample)
        rows = statistics(sample, terms).select("quality", "toxic", *(f"_tw_{f}" for f in FEATURES)).toPandas()
    finally:
        sample.unpersist()
    rows = rows.sort_values(list(rows.columns))
    x = rows[[f"_tw_{f}" for f in FEATURES]].to_numpy(dtype=float)
    return Classifier(tuple(terms), fit(x, (rows["quality"] > 0).to_numpy(dtype=float)), fit(x, (rows["toxic"] > 0).to_numpy(dtype=float)))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality, toxicity, keep) of each document with an id and a text."""
    scored = train(docs, labels).scored(id_text(docs))
    return scored.select("doc_id", F.col("_tw_quality").alias("quality"), F.col("_tw_toxicity").alias("toxicity"), accepted().alias("keep"))


def keep_accepted(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't rejected; rows without a text stay."""
    rows = positional(docs)
    # the row number keeps the filter above the scores: pushed below them, it would hold every rule's statistics over again
    scored = train(docs, labels).scored(rows, f"c{place(docs, text_col)}").withColumn("_tw_row", F.monotonically_increasing_id())
    return scored.filter(F.coalesce(accepted(), F.lit(True)) & (F.col("_tw_row") >= 0)).select(*rows.columns).toDF(*docs.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
