"""Quality classifier: document evidence and hierarchical empirical Bayes over sites."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.llm.common import arrow_map, cut, salted_join, staged

#: The document model is fitted on this many labelled documents at most, of least id hash.
MAX_TRAIN = 20_000
FEATURES = 14
#: Buckets that words are hashed to.
BUCKETS = 1 << 16
UPPER, DIGITS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"*#$%&|~^=<>{}[]\\@+_"


def features(text: bytes | None) -> list[float]:
    """Measures of a whole text's form; all are shares or logarithms, so that length alone decides little."""
    t = text or b""
    words = t.split()
    n, size = max(1, len(words)), max(1, len(t))
    distinct = set(words)
    less = lambda chars: size - len(t.translate(None, chars)) if t else 0
    upper, digits, signs, ends = less(UPPER), less(DIGITS), less(SIGNS), less(b".,;:!?")
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = t.split(b"\n")
    return [
        np.log1p(len(words)), len(t) / n / 10, len(distinct) / n, float(np.log(len(distinct) + 1) / np.log(n + 1.0001)), again / n, upper / size, digits / size, signs / n,
        ends / n, t.count(b"!") / n, t.count(b"|") / n, sum(map(len, distinct)) / max(1, len(distinct)) / 10, len(set(lines)) / len(lines), float(t == t.upper()),
    ]


def words(text: bytes | None) -> np.ndarray:
    """Buckets of a text's distinct lower-case words."""
    return np.fromiter({zlib.crc32(w) & (BUCKETS - 1) for w in set((text or b"").lower().split())}, dtype=np.int64)


class Model:
    """A logistic model of 14 measures of form (and their squares) and of the words: the mean log-odds of a text's distinct words."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, odds: np.ndarray) -> None:
        self.mean, self.scale, self.weights, self.odds = mean, scale, weights, odds

    def table(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.c_[z, z[:, :FEATURES] ** 2, np.ones(len(x))]

    def probability(self, texts: list[bytes | None]) -> np.ndarray:
        x = np.array([[*features(t), word_score(t, self.odds)] for t in texts]).reshape(-1, FEATURES + 1)
        return 1 / (1 + np.exp(-np.clip(self.table(x) @ self.weights, -20, 20)))


def word_score(text: bytes | None, odds: np.ndarray) -> float:
    at = words(text)
    return float(odds[at].mean()) if len(at) else 0.0


def _word_odds(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-odds of the good class by bucket, from documents with the bucket (class x bucket) and documents by class."""
    share = np.log((counts + 1.0) / (n[:, None] + 2.0))
    return share[1] - share[0]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """The document model; None unless both classes are labelled. At most MAX_TRAIN labelled ids are read, of several texts of one
    id that of least hash; so the sample and its table of word counts (2 folds, 2 classes, BUCKETS) are bounded.

    Words' odds are learnt on one half of the sample and scored on the other, so that the weight of the words is
    that of words not seen in training; the model scores with the mean of both halves' odds."""
    some = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).dropna().distinct().orderBy(F.xxhash64("__id"), "__y").limit(MAX_TRAIN)
    docs = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    fold = F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(2)).cast("int").alias("__fold")
    sample = docs.join(F.broadcast(some), "__id").groupBy("__id", "__y").agg(F.min_by(F.struct("__text"), F.xxhash64("__text")).alias("t"))
    sample = staged(sample.select(fold, F.greatest(F.least("__y", F.lit(1)), F.lit(0)).alias("__y"), F.col("t.__text").alias("__text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 2, BUCKETS + 1), dtype=np.int64)  # the last place counts documents
        for b in batches:
            for t, y, f in zip(b.column("__text").cast(pa.binary()).to_pylist(), b.column("__y").to_pylist(), b.column("__fold").to_pylist()):
                seen[f, y, words(t)] += 1
                seen[f, y, -1] += 1
        f, y, k = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(seen[f, y, k])], ["f", "y", "k", "n"])

    got = arrow_map(sample, count, "f int, y int, k int, n long").groupBy("f", "y", "k").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((2, 2, BUCKETS + 1))
    seen[tuple(got.column(c).to_numpy() for c in ("f", "y", "k"))] = got.column("n").to_numpy()
    if not seen[:, 0, -1].sum() or not seen[:, 1, -1].sum():
        return None
    odds = [_word_odds(s[:, :-1], s[:, -1]) for s in seen]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[*features(t), word_score(t, odds[1 - f])] for t, f in zip(b.column("__text").cast(pa.binary()).to_pylist(), b.column("__fold").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column("__y").cast(pa.int64())], ["f", "y"])

    rows = arrow_map(sample, measure, "f array<double>, y long").toArrow()
    x, y = np.array(rows.column("f").to_pylist()), rows.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # rows come in any order; sums shall not
    x, y = x[order], y[order]
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-9, np.zeros(0), (odds[0] + odds[1]) / 2)
    z = model.table(x)
    w, ridge = np.zeros(z.shape[1]), np.r_[np.full(z.shape[1] - 1, 1.0), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    return model


def with_evidence(docs: DataFrame, model: Model | None, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """The documents with ``__p double``, the model's probability that the text is good (without a model null)."""
    keep = [c for c in docs.columns if not (drop_text and c == text_col)]
    if model is None:
        return docs.select(*keep).withColumn("__p", F.lit(None).cast("double"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = shared.value.probability(b.column(text_col).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(p)], [*keep, "__p"])

    return arrow_map(docs, run, StructType([*docs.select(*keep).schema, *StructType.fromDDL("__p double")]))


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float, float, float]:
    """``(__host, __path, __n, __s, __hn, __hs)`` from ``(__host, __path, __p)``: counts and sums of the path and its host, for left_out(),
    and the global mean and the prior weights of hosts and paths.

    A host's share of good documents is shrunk toward the global mean, a path's toward its host's, by Beta priors whose weights are
    the method-of-moments estimates of how much sites differ. Only grouped sums are moved; the map side adds them up first."""
    paths = cut(evidence.groupBy("__host", "__path").agg(F.count("*").alias("n"), F.sum("__p").alias("s"), F.sum(F.col("__p") * (1 - F.col("__p"))).alias("v")))
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = paths.agg(F.sum("n"), F.sum("s")).first()
    mean = min(max((total[1] or 0.0) / total[0], 1e-3), 1 - 1e-3) if total[0] else 0.5

    def weight(df: DataFrame, n: str, share, around) -> float:
        """Prior size k with variance of the shares = m(1 - m) / (k + 1) beyond that of sampling."""
        r = df.agg(F.sum(n), F.sum(F.col(n) * (share - around) ** 2), F.sum(F.lit(mean * (1 - mean)))).first()
        if not r[0]:
            return 1.0
        spread = max((r[1] - r[2]) / r[0], 1e-6)
        return float(min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6))

    kh = weight(hosts, "hn", F.col("hs") / F.col("hn"), F.lit(mean))
    hosts = hosts.withColumn("__h", (F.col("hs") + kh * mean) / (F.col("hn") + kh))
    both = paths.join(hosts.select("__host", "__h", "hn", "hs"), "__host")
    kp = weight(both, "n", F.col("s") / F.col("n"), F.col("__h"))
    return staged(both.select("__host", "__path", F.col("n").alias("__n"), F.col("s").alias("__s"), F.col("hn").alias("__hn"), F.col("hs").alias("__hs"))), mean, kh, kp


def left_out(p: Column, mean: float, kh: float, kp: float) -> Column:
    """The posterior of a document's path without the document's own evidence ``p``, which judge() adds by itself. Of a path with
    no other document it is its host's, of a host with none the global mean."""
    host = (F.col("__hs") - p + kh * mean) / (F.col("__hn") - 1 + kh)
    return (F.col("__s") - p + kp * host) / (F.col("__n") - 1 + kp)


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id_col: str = "doc_id", text_col: str = "text", drop_text: bool = True) -> DataFrame:
    """The documents (without text, if ``drop_text``) with ``__p``, ``__prior`` (of the other documents of their path), ``__keep_p`` and ``__keep``.

    The document's log-odds and those of its path against the global mean are added; a document is kept at one half or more,
    just one half included. Without text, texts are read once: what is found is written and then joined with the sites' posteriors,
    hot sites in salted parts. With it they are read twice, which saves a written copy of all texts. ``host`` and ``path`` are columns (of web pages the URL's host and path, here source and language);
    null is a site of its own. Null, empty and very long texts are judged like others. Without labels of both classes
    all documents are kept. Repeated rows are judged alike; an empty table gives none. Other columns stay as they are."""
    sites = {"__host": F.coalesce(F.col(host).cast("string"), F.lit("")), "__path": F.coalesce(F.col(path).cast("string"), F.lit(""))}
    model = fit(docs, labels, id_col, text_col)
    if model is None:
        return with_evidence(docs, model, text_col, drop_text).withColumns({"__prior": F.lit(None).cast("double"), "__keep_p": F.lit(None).cast("double"), "__keep": F.lit(True)})
    judged = with_evidence(docs.withColumns(sites), model, text_col, drop_text)
    if drop_text:
        judged = evidence = staged(judged)
    else:
        evidence = staged(with_evidence(docs.select(F.col(text_col), *[c.alias(k) for k, c in sites.items()]), model, text_col, True))
    sites_, mean, kh, kp = site_posteriors(evidence.select("__host", "__path", "__p"))
    odds = lambda c: F.log(c / (1 - c))
    inside = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    sums = ["__n", "__s", "__hn", "__hs"]
    sites_ = staged(sites_.select(F.struct("__host", "__path").alias("__site"), *sums))
    size = F.octet_length("__site.__host") + F.octet_length("__site.__path")
    out = salted_join(judged.withColumn("__site", F.struct("__host", "__path")), sites_, "__site", F.struct(id_col, "__p"), "left", size)
    out = out.withColumn("__prior", left_out(F.col("__p"), mean, kh, kp)).drop(*sums)
    logit = odds(F.least(F.greatest("__p", F.lit(1e-9)), F.lit(1 - 1e-9))) + odds(inside(F.col("__prior"))) - float(np.log(mean / (1 - mean)))
    out = out.withColumn("__keep_p", 1 / (1 + F.exp(-logit))).withColumn("__keep", F.col("__keep_p") >= 0.5)
    return out.drop("__host", "__path", "__site")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that judge() keeps, with their own columns."""
    return judge(docs, labels, drop_text=False).where("__keep").select(*docs.columns)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", F.col("__p").alias("p_document"), F.col("__prior").alias("p_site"), F.col("__keep_p").alias("p_keep"), F.col("__keep").alias("keep"))
