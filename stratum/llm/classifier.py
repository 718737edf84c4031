"""Quality classifier by co-training of two views.

One view sees the text (shares of symbols, capitals, repeats and so on over the whole text), the other the page's
metadata (language, source, stated length). Both start from labelled documents; in each round a view's PER_ROUND most
confident judgements on all unlabelled documents become labels for the other. Each view is calibrated on labelled
documents it wasn't trained on, and their log-odds are added. Features and scores are DataFrame expressions over all
documents; only the labelled sample, of LABELLED rows at most, and the rows picked in each round reach the driver.

A document is rejected if its score is below the limit: one half, or lower, so that at most LOST of the good documents
held out are rejected, the lowest of them never counted, and not under LEAST_LIMIT. Null and empty texts have zero
features, null metadata are values of their own. Labels given twice count by their mean (a half is good), those of
unknown documents not at all; of different texts under one id the smallest by features is learnt from. Unlabelled
documents with the same features are one. Without labels of both kinds nothing can be learnt: all scores are 1 and every
document stays. Repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, documents, let, materialize, text_of

#: Most labelled rows that training sees, chosen by a hash of the id.
LABELLED = 20_000
ROUNDS, CONFIDENT, PER_ROUND = 5, 0.97, 1000
LOST, LEAST_LIMIT = 0.005, 0.25
LANGS, SOURCES = 8, 32
SPACE = " \t\n\x0b\x0c\r"
TEXT = ["symbols", "marks", "capitals", "digits", "stops", "word_length", "log_words", "distinct", "again", "lines"]


def text_features(text: Column) -> Column:
    words = F.array_remove(F.split(F.translate(text, SPACE, " " * 6), " "), "")
    counted = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"), F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).alias("r")))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    chars = F.greatest(F.lit(1), F.length(F.translate(text, SPACE, ""))).cast("double")
    return F.struct(
        (without("#*$%&|<>@^~_=\\{}[]") / chars).alias("symbols"), (without("!?") / chars).alias("marks"),
        ((F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))) / chars).alias("capitals"), (without("0123456789") / chars).alias("digits"),
        (without(".,;:") / chars).alias("stops"), chars.alias("chars"), counted.alias("w"), (without("\n") / chars).alias("lines"),
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", length_col: str = "n_chars", carry: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, x: the text view's numbers, lang, source: buckets, size: log of the stated length), and ``carry``."""
    bucket = lambda c, n: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(n)).cast("int")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_features(text_of(text_col)).alias("f"), bucket(lang_col, LANGS).alias("lang"), bucket(source_col, SOURCES).alias("source"),
        F.log1p(F.greatest(F.lit(0.0), F.coalesce(F.col(length_col).cast("double"), F.lit(0.0)))).alias("size"), *carry,
    )
    n = F.greatest(F.lit(1), F.col("f.w.n")).cast("double")
    own = {"word_length": F.col("f.chars") / n, "log_words": F.log1p(F.col("f.w.n").cast("double")), "distinct": F.col("f.w.d") / n, "again": F.col("f.w.r") / n}
    return rows.withColumn("x", F.array(*[own[k] if k in own else F.col(f"f.{k}") for k in TEXT])).drop("f")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression (bias last) by Newton's steps, classes weighted alike."""
    x = np.c_[x, np.ones(len(x))]
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * w)
        w -= step
        if abs(step).max() < 1e-6:
            break
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, picks, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of both views. y: labels of the rows of ``views``.

    ``picks`` takes (k, label, w, n, known) for each view k and label, and gives for each the n unlabelled rows, as (number, row of
    view 0, row of view 1), that view k with weights w is surest about, those that are ``known`` left out; they become
    labels of the other view, each once."""
    given: list[dict] = [{}, {}]

    def fitted(k):
        own = list(given[k].values())
        x = np.array([v[k] for v, _ in own]).reshape(len(own), views[k].shape[1])
        return fit(np.r_[views[k], x], np.r_[y, [label for _, label in own]])

    w = [fitted(0), fitted(1)]
    for _ in range(rounds):
        # as many of each class as its share of the labelled rows
        asked = [(k, label, w[k], int(PER_ROUND * (y.mean() if label else 1 - y.mean())), given[1 - k]) for k in (0, 1) for label in (1.0, 0.0)]
        new = [(1 - k, number, (v0, v1), label) for (k, label, *_), found in zip(asked, picks(asked)) for number, v0, v1 in found]
        for k, number, v, label in new:
            given[k].setdefault(number, (v, label))
        if not new:
            break
        w = [fitted(0), fitted(1)]
    return w[0], w[1]


def _views(rows: list) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(TEXT))
    meta = np.zeros((len(rows), LANGS + SOURCES + 1))
    for i, r in enumerate(rows):
        meta[i, r.lang] = meta[i, LANGS + r.source] = 1
        meta[i, -1] = r.size
    return x, meta


def _text_odds(w: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> Column:
    out = F.lit(float(w[-1]))
    for i in range(len(TEXT)):
        out = out + F.lit(float(w[i])) * F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.get("x", F.lit(i)) - float(mean[i])) / float(scale[i])))
    return out


def _meta_odds(w: np.ndarray, size: tuple[float, float]) -> Column:
    at = lambda values, c: F.get(F.array(*[F.lit(float(v)) for v in values]), F.col(c))
    return F.lit(float(w[-1])) + at(w[:LANGS], "lang") + at(w[LANGS : LANGS + SOURCES], "source") + F.lit(float(w[-2])) * (F.col("size") - float(size[0])) / float(size[1])


def train(rows: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> dict | None:
    """The model, or None if there are no labels of both kinds. ``rows``: ``features`` of all documents, materialised."""
    own = ["x", "lang", "source", "size"]
    votes = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q")).filter("doc_id IS NOT NULL AND q IS NOT NULL").groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("double").alias("y"))
    known = materialize(rows.join(votes, "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min(F.struct(*own)).alias("f")), "labelled")
    # of many, those of the lowest hashes: few more than wanted are sorted, and no task sends its own
    share = min(1.0, 1.5 * labelled / max(1, known.count()))
    low = known.filter(F.xxhash64("doc_id") <= min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))
    sample = low.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).select("doc_id", "y", "f.*").collect()
    if len({r.y for r in sample}) < 2:
        return None
    sample.sort(key=lambda r: r.doc_id)
    y = np.array([r.y for r in sample])
    xt, xm = _views(sample)
    mean, scale = xt.mean(0), xt.std(0) + 1e-9
    size = (xm[:, -1].mean(), xm[:, -1].std() + 1e-9)

    def scaled(t, m):
        m = m.copy()
        m[:, -1] = (m[:, -1] - size[0]) / size[1]
        return np.clip((t - mean) / scale, -8, 8), m

    # all unlabelled documents; copies become one in each task before they meet
    free = rows.join(votes, "doc_id", "left_anti").groupBy(*own).agg(F.count(F.lit(1)).alias("n"))
    pool = materialize(free.select(*own, F.monotonically_increasing_id().alias("number")), "pool")
    sure = float(np.log(CONFIDENT / (1 - CONFIDENT)))

    def picks(asked):
        """All in one job: the surest of each task meet by a shuffle, so that the driver gets PER_ROUND rows of each view."""
        every = None
        for i, (k, label, w, n, known) in enumerate(asked):
            odds = _text_odds(w, mean, scale) if k == 0 else _meta_odds(w, size)
            # PER_ROUND numbers for each round before at most
            open_ = pool.filter(f"number NOT IN ({', '.join(map(str, known))})") if known else pool
            top = open_.withColumn("__o", odds if label else -odds).filter(F.col("__o") >= sure).orderBy(F.desc("__o"), F.xxhash64(*own), "number").limit(n)
            top = top.withColumn("__i", F.lit(i))
            every = top if every is None else every.unionByName(top)
        written = materialize(every, "picks")
        rows = sorted(written.collect(), key=lambda r: (r["__i"], -r["__o"], r.number))
        discard(written)
        own_rows = [[r for r in rows if r["__i"] == i] for i in range(len(asked))]
        return [zip([r.number for r in found], *scaled(*_views(found))) for found in own_rows]

    xt, xm = scaled(xt, xm)
    fold = np.arange(len(y)) % 5
    # the calibration's fold, the figure's, and the rest to train on; with few labels all are one
    cal, test, own_fold = fold == 0, fold == 1, fold > 1
    if any(len(set(y[f])) < 2 for f in (cal, test, own_fold)):
        cal = test = own_fold = np.ones(len(y), bool)
    wt, wm = co_train((xt[own_fold], xm[own_fold]), y[own_fold], picks)
    # calibration: the log-odds, scaled and shifted to fit the labels held out
    ct, cm = (_calibrated(_odds(x[cal], w), y[cal]) for x, w in ((xt, wt), (xm, wm)))
    prior = np.log(y.mean() / (1 - y.mean()))
    both = lambda f: ct[0] * _odds(xt[f], wt) + ct[1] + cm[0] * _odds(xm[f], wm) + cm[1] - prior
    good = np.sort(both(cal)[y[cal] == 1])
    lost = max(1, int(LOST * len(good)))
    limit = max(float(np.log(LEAST_LIMIT / (1 - LEAST_LIMIT))), min(0.0, float(good[min(lost, len(good) - 1)]) - 1e-6))
    return {"mean": mean, "scale": scale, "size": size, "text": wt, "meta": wm, "cal_text": ct, "cal_meta": cm, "prior": float(prior), "limit": limit, "held_out": (both(test), y[test])}


def _calibrated(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's scale and shift; a scale under 0 (a view worse than chance) becomes 0."""
    w, x = np.array([1.0, 0.0]), np.c_[odds, np.ones(len(odds))]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (p - y) + 1e-2 * (w - [1, 0]))
    return (float(w[0]), float(w[1])) if w[0] > 0 else (0.0, float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))))


def score(rows: DataFrame, model: dict | None) -> DataFrame:
    """``rows`` (of ``features``, besides other columns) as (doc_id, p_text, p_meta, score, kept)."""
    if model is None:
        one = F.lit(1.0)
        return rows.select("doc_id", one.alias("p_text"), one.alias("p_meta"), one.alias("score"), F.lit(True).alias("kept"))
    text, meta, prior, limit = _logits(model)
    p = lambda c: F.lit(1.0) / (F.lit(1.0) + F.exp(-c))
    both = F.col("__t") + F.col("__m") - prior
    return rows.select("doc_id", text.alias("__t"), meta.alias("__m")).select("doc_id", p(F.col("__t")).alias("p_text"), p(F.col("__m")).alias("p_meta"), p(both).alias("score"), (both >= limit).alias("kept"))


def _logits(model: dict) -> tuple[Column, Column, float, float]:
    (a, b), (c, d) = model["cal_text"], model["cal_meta"]
    return _text_odds(model["text"], model["mean"], model["scale"]) * a + b, _meta_odds(model["meta"], model["size"]) * c + d, model["prior"], model["limit"]


def keep_good(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns. Texts aren't shuffled: their
    features are found once more where they are."""
    model = train(materialize(features(docs, **columns), "features"), labels)
    if model is None:
        return docs
    text, meta, prior, limit = _logits(model)
    rows = features(docs, **columns, carry=(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),))
    return rows.filter(text + meta - prior >= limit).select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(features(documents(spark, sf_dir)), "features")
    return score(rows, train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")))
