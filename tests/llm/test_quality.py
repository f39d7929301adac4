"""Quality: word evidence, site posteriors against their formula, and odd rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import quality

SF = "/root/testdata/sf0.001"


def test_words_alone_tell(spark):
    """Texts of one form; only their vocabulary differs, and the held-out ones are other mixtures of it."""
    rng = random.Random(3)
    word = lambda good: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3)) + ("la" if good else "lo")
    lists = {g: [word(g) for _ in range(60)] for g in (0, 1)}
    docs, labels = [], []
    for i in range(400):
        g = i % 2
        docs.append((i, " ".join(rng.choice(lists[g] if rng.random() < 0.8 else lists[1 - g]) for _ in range(40)), "en", "s"))
        labels.append((i, g, 0))
    x = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.judge(x, y.where("doc_id % 4 < 2")).where("doc_id % 4 >= 2").collect()
    assert np.mean([r["__keep"] == (r.doc_id % 2 == 1) for r in out]) >= 0.97


def test_posteriors_against_their_formula(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.judge(docs, labels).collect()
    sites = {}
    for r in out:
        sites.setdefault((r.source, r.lang), []).append(r["__p"])
    hosts = {}
    for (h, _), p in sites.items():
        hosts.setdefault(h, []).extend(p)
    n = len(out)
    mean = min(max(sum(r["__p"] for r in out) / n, 1e-3), 1 - 1e-3)

    def size(groups):  # (values, centre): how much sites differ beyond sampling
        spread = max((sum(len(p) * (np.mean(p) - c) ** 2 for p, c in groups) - len(groups) * mean * (1 - mean)) / n, 1e-6)
        return min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6)

    kh = size([(p, mean) for p in hosts.values()])
    host = {h: (sum(p) + kh * mean) / (len(p) + kh) for h, p in hosts.items()}
    kp = size([(p, host[h]) for (h, _), p in sites.items()])
    for r in out:
        p = sites[r.source, r.lang]
        rest, q = hosts[r.source], r["__p"]  # the document's own evidence counts once, not in its site's too
        own_host = (sum(rest) - q + kh * mean) / (len(rest) - 1 + kh)
        prior = (sum(p) - q + kp * own_host) / (len(p) - 1 + kp)
        assert math.isclose(r["__prior"], prior, rel_tol=1e-9)
        odds = lambda x: math.log(x / (1 - x))
        logit = odds(min(max(r["__p"], 1e-9), 1 - 1e-9)) + odds(min(max(prior, 1e-4), 1 - 1e-4)) - odds(mean)
        assert math.isclose(r["__keep_p"], 1 / (1 + math.exp(-logit)), rel_tol=1e-9) and r["__keep"] == (r["__keep_p"] >= 0.5)


def test_a_site_of_one_document_has_no_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    lone = docs.limit(1).select(F.lit(-1).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", "lang", F.lit("alone").alias("source"))
    out = quality.judge(docs.unionByName(lone), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    r = next(r for r in out if r.doc_id == -1)
    mean = sum(r["__p"] for r in out) / len(out)
    assert math.isclose(r["__prior"], mean, rel_tol=1e-9) and math.isclose(r["__keep_p"], min(max(r["__p"], 1e-9), 1 - 1e-9), rel_tol=1e-6)


def test_repeated_ids_and_long_texts(spark):
    """Of several texts of one labelled id that of least hash is learnt from, in whatever order they come."""
    rows = [(i, f"word{i % 5} text number {i} " * (1 + i % 7), "en", "s") for i in range(60)] + [(3, f"other {k}", "en", "s") for k in range(50)]
    rows += [(900, "long " * 500_000, None, None), (901, None, "en", "s"), (901, None, "en", "s")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    x = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("f", F.lit("kept")).withColumn("y", F.lit(1))
    a = {(r.doc_id, round(r["__p"], 9)) for r in quality.judge(x, labels).collect()}
    b = {(r.doc_id, round(r["__p"], 9)) for r in quality.judge(x.orderBy(F.desc("doc_id"), F.desc("text")).repartition(3), labels).collect()}
    assert a == b and len([1 for i, _ in a if i in (900, 901)]) == 2
    kept = quality.keep_good(x, labels)
    assert kept.columns == x.columns
