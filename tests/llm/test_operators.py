"""Training-data operators against brute force on small tables, and their odd cases."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from test_jaccard import kept

from tidewater.llm import decontaminate, html_text, neighbours, pii, quality, shards, simhash, urls
from tidewater.llm.common import ranked

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def components(fps, ids):
    """Brute force over all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(low.get(find(i), x), x)
    return [low[find(i)] for i in range(len(fps))]


def test_simhash(spark, docs):
    import xxhash

    got = simhash.op1_simhash(spark, SF).collect()
    texts = dict(docs.select("doc_id", "text").collect())

    def fp(t):
        w = regex.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps = [int(r.fingerprint, 16) for r in got]
    assert fps == [fp(texts[r.doc_id]) for r in got]
    assert [r.component_id for r in got] == components(fps, [r.doc_id for r in got])


def test_links_in_parts(spark, monkeypatch):
    """Large cells, dealt over parts, lose no link."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for b in base for _ in range(40)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    for cell in (32_768, 8):
        monkeypatch.setattr(simhash, "CELL", cell)
        monkeypatch.setattr(simhash, "SMALL", 128 if cell > 8 else 2)
        edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
        from tidewater.operators.graph import weak_components

        root = dict(weak_components(edges).collect())
        got = [root.get(x, x) for x in signed]
        want = components([x & (2**64 - 1) for x in signed], signed)
        assert got == want


def test_near_duplicates_odd(spark):
    x = spark.createDataFrame([(1, None, 7), (None, "", 7), (3, "a b", 7), (4, "A  b", 7), (4, "A  b", 7), (None, "hello world foo bar", 7)], "doc_id long, text string, fp int")
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(x).collect())
    assert got == Counter({(1, 1): 1, (None, 1): 1, (3, 3): 1, (4, 3): 2, (None, None): 1})
    assert sorted(map(str, (r.doc_id for r in simhash.keep_one(x).collect()))) == ["1", "3", "None"]
    assert simhash.keep_one(x.limit(0)).count() == 0


def test_neighbours(spark):
    got = neighbours.op2_neighbours(spark, SF).collect()
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    x, ids = np.array([r.embedding for r in rows], dtype=float), np.array([r.vec_id for r in rows])
    own = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        own[r.query_id].append(r)
    hit = 0
    for q in ids[ids % 20 == 0]:
        s = (x * x[ids == q][0]).sum(axis=1)
        s[ids == q] = -np.inf
        hit += len({*ids[np.lexsort((ids, -s))[:20]]} & {r.vec_id for r in own[q]})
        assert [r.rank for r in own[q]] == list(range(1, 21))
        assert all(abs(s[ids == r.vec_id][0] - r.score) < 1e-12 for r in own[q])
    assert hit >= 0.9 * 20 * len(own)


def test_neighbours_odd(spark):
    x = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(x).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5)]
    assert neighbours.nearest(x.limit(0)).count() == 0


def test_quality_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.judge(d, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    r = out.agg(F.avg(F.when(F.col("__keep") == (F.col("quality") == 1), 1.0).otherwise(0.0)).alias("a")).first()
    assert r.a > 0.97


def test_quality_odd(spark):
    x = spark.createDataFrame([(1, None, None, None, "z"), (None, "", "en", "s", "z"), (3, "a b", "en", "s", "z")], "doc_id long, text string, lang string, source string, keep string")
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(x, labels).columns == x.columns
    assert quality.keep_good(x, labels.limit(0)).count() == 3
    assert quality.keep_good(x.limit(0), labels).count() == 0


def leaks(docs, items):
    """Brute force: every window of every document."""
    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    cut = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = set()
    for i, t in items:
        y = Counter(cut(words(t)))
        for d, text in docs:
            x = cut(words(text))
            n, best = min(sum(y.values()), len(x)), 0
            if not n or not y.keys() & set(x):
                continue
            for s in range(len(x) - n + 1):
                c = Counter(x[s : s + n])
                best = max(best, sum((c & y).values()) / sum((c | y).values()))
            if best >= 0.8 - 1e-12:
                out.add((d, i, round(best, 9)))
    return out


def test_decontamination(spark, docs):
    got = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontaminate.op4_decontaminate(spark, SF).collect()}
    assert got and got == leaks(docs.select("doc_id", "text").collect(), spark.read.parquet(f"{SF}/benchmark.parquet").collect())


def test_decontamination_odd(spark):
    rng = np.random.default_rng(3)
    w = [f"w{k}" for k in rng.integers(0, 400, 40)]
    base = " ".join(w)
    rows = [(1, base), (2, f"intro {base.upper()} tail"), (3, " ".join([*w[:20], "zz", *w[21:]])), (4, " ".join([*w[:10], "q", *w[10:], *["t"] * 9])), (5, " ".join(w[20:] + w[:20])), (6, " ".join(w[:36])), (7, None), (8, ""), (9, "x " * 30000 + base), (10, " ".join(w[:30]))]
    items = [(1, base), (4, " ".join(w[:20]))]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    it = spark.createDataFrame([*items, (2, None), (3, "too short")], "item_id long, text string")
    got = decontaminate.find_leaks(x, it).join(x.select("doc_id", decontaminate.row_key().alias("row")), "row").collect()
    assert {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in got} == leaks(rows, items)
    assert decontaminate.drop_leaks(x, it.limit(0)).count() == 10
    assert decontaminate.drop_leaks(x.limit(0), it).count() == 0


def test_url_rules(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert Counter(map(tuple, urls.op5_url_rules(spark, SF).collect())) == Counter(c.execute(urls.ORACLE).fetchall())
    x = spark.createDataFrame([(1, None, "r"), (None, "HTTP://A.Com:80/x", "r"), (4, "http://B.com", "r"), (4, "http://B.com", "r"), (5, "http://www.EXAMPLE.com/en/?x", "r")], "page_id long, url string, rule string")
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(x, rules).collect())
    assert got == Counter({(1, "", "", None, "allow"): 1, (None, "a.com:80", "/x", None, "allow"): 1, (4, "b.com", "", None, "allow"): 2, (5, "www.example.com", "/en/", "www.example.com/en/", "allow"): 1})
    assert urls.judge_urls(x, rules.limit(0)).where("verdict = 'allow'").count() == 5
    assert urls.judge_urls(x.limit(0), rules).count() == 0


def test_shards(spark, docs):
    got = shards.op6_shards(spark, SF).collect()
    texts = dict(docs.select("doc_id", "text").collect())
    by, size = defaultdict(set), Counter()
    for r in got:
        by[texts[r.doc_id]].add(r.shard)
        size[r.shard] += r.size
    assert all(len(s) == 1 for s in by.values())
    groups = Counter()
    for r in got:
        groups[hashlib.md5(texts[r.doc_id].encode()).hexdigest()] += r.size
    sizes = [groups[k] for k in sorted(groups)]

    def fits(c):
        n, now = 1, 0
        for v in sizes:
            if v > c:
                return False
            n, now = (n + 1, v) if now + v > c else (n, now + v)
        return n <= 24

    best = max(size.values())
    assert fits(best) and not fits(best - 1)
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_shards_odd(spark):
    x = spark.createDataFrame([(1, None, 9), (None, "", 9), (4, "A", 9), (4, "A", 9)], "doc_id long, text string, shard int")
    assert sorted((r.size, r.text_crc32 or 0) for r in shards.shard_documents(x).collect()) == [(8, 0), (8, 0), (9, 3554254475), (9, 3554254475)]
    assert shards.shard_documents(x.limit(0)).count() == 0


def test_ranked_hot_key(spark):
    x = spark.range(3000).select("id", F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 7).alias("k"))
    got = ranked(x, ["k"], ["id"], "r", 16).collect()
    for k in {r.k for r in got}:
        assert sorted(r.r for r in got if r.k == k) == list(range(sum(r.k == k for r in got)))


PAGE = '<html><body class="has-sidebar"><header>H</header><div class="cookie-notice">ok</div><div id="c"><div class="post"><h2>T%d</h2><p>para %d &lt;x&gt;<br>more</p><ul><li>one<li>two %d</ul></div></div><aside>s</aside><div class="comments"><p>c%d</p></div><form>f<input></form></body></html>'


def test_main_text(spark):
    rows = [(i, f"http://a.com/{i}", PAGE % (i, i, i, i)) for i in range(4)] + [(9, None, None), (None, "http://b.c", ""), (11, "http://b.c", '<p>a&nbsp;b<script>"</p>"</script> c</p>stray</div>'), (11, "http://b.c", "<p>a")]
    x = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_text.main_text(x).collect())
    want = Counter({(i, t := f"T{i}\n\npara {i} <x> more\n\none\n\ntwo {i}", len(t)): 1 for i in range(4)}) + Counter({(9, "", 0): 1, (None, "", 0): 1, (11, "a b c\n\nstray", 12): 1, (11, "a", 1): 1})
    assert got == want
    assert html_text.main_text(x.limit(0)).count() == 0


def test_main_text_pages(spark):
    import html

    src = dict(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect())
    for r in html_text.op9_main_text(spark, SF).collect():
        p = src[r.page_id]
        inner = regex.sub(r"<br>", " ", regex.sub(r"</?b>", "", p[p.index("<article>") + 9 : p.index("</article>")]))
        blocks = (" ".join(html.unescape(y).split()) for y in regex.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_pii(spark, docs):
    src = dict(docs.select("doc_id", "text").collect())
    there, back = {}, {}
    for r in pii.op10_pii(spark, SF).collect():
        a, b = pii.find(src[r.doc_id]), pii.find(r.text)
        assert [s[2] for s in a] == [s[2] for s in b]
        assert a or src[r.doc_id] == r.text
        for p, q in zip(a, b):
            assert there.setdefault(p[2:], q[3]) == q[3] and back.setdefault(q[2:], p[3]) == p[3] and p[3] not in r.text


def test_pii_kinds():
    text = 'an.a92@mail6.example.com +1 (755) 555-3798 4111 1111 1111 1111, 89.63.108.71 token = "269b1cea0846965f2d3ecb5cdb87c0edc7a7a587" 123-45-6789 Frau Müller, Mr. John Smith, Г-жа Иванова'
    found = pii.find(text)
    assert [k for _, _, k, _ in found] == ["email", "phone", "card", "ip", "secret", "ssn", "name", "name", "name"]
    for _, _, kind, entity in found:
        new = pii.surrogate(kind, entity, b"key")
        assert new != entity and new == pii.surrogate(kind, entity, b"key") != pii.surrogate(kind, entity, b"other")
        if kind == "card":
            d = new.replace(" ", "")
            assert d[0] == "4" and pii._luhn(d[:-1]) == int(d[-1])
    assert pii.surrogate("name", "m:Smith", b"k") == pii.surrogate("name", "m:John Smith", b"k").split()[-1]
    assert pii.find("version 3.0, 2024-05-06, 1.2.3.4.5, GNU 3.") == []


def test_pii_odd(spark):
    x = spark.createDataFrame([(1, None, "q"), (None, "", "z"), (4, "Mr John Smith a@b.org", ""), (4, "Mr John Smith a@b.org", ""), (5, "Herr John Smith, a@b.org", "")], "doc_id long, text string, surrogate string")
    got = pii.pseudonymise(x).collect()
    assert len(got) == 5 and sum("Smith" in (r.text or "") for r in got) == 0
    assert len({r.text for r in got if r.doc_id == 4}) == 1
    assert pii.pseudonymise(x.limit(0)).count() == 0


def test_distinct_surrogates_in_a_small_space(spark):
    """Two-letter local parts leave few free surrogates: all differ still, and none is a real one."""
    e = [("ssn", f"{i:03d}-00-0000") for i in range(300)] + [("email", f"{a}@b.org") for a in "abcdefghij"]
    got = pii.surrogates(spark.createDataFrame(e, "kind string, entity string"), "k").collect()
    assert len(got) == 310 and len({(r.kind, r.surrogate) for r in got}) == 310
    assert not {(r.kind, r.surrogate) for r in got} & set(e)


def test_pipeline_against_its_parts(spark):
    """Each stage on its input, by brute force where there is one; the last holds all ids of what the fourth returns."""
    import corpus_pipeline
    from tidewater.llm.common import staged

    d, n = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, d = d, staged(stage(spark, d, SF))
        n.append(d.count())
        if name != "best-fit packing":
            assert d.columns == before.columns
        if name == "benchmark decontamination":
            bad = {x[0] for x in leaks(before.select("doc_id", "text").collect(), spark.read.parquet(f"{SF}/benchmark.parquet").collect())}
            assert {r.doc_id for r in d.collect()} == {r.doc_id for r in before.collect()} - bad
        if name == "SimHash near-dedup":
            assert {r.doc_id for r in d.collect()} == kept(before.select("doc_id", "text").collect())
    assert n[0] < 200 and n[1] < n[0] and n[2] < n[1] == n[1] and n[3] == n[2]
    assert corpus_pipeline.run(spark, SF).count() == n[4]
