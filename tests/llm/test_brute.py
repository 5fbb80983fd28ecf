"""Operators against brute force: enumeration, formulas, recursion, all pairs; the pipeline stage by stage; edge rows."""

import gzip
import itertools
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from bookloom.llm import exact_dedup, near_dedup, packing, quality_classifier, quality_rules, toxicity, url_filters, warc
from bookloom.llm.common import scratch_path
from tests.llm.test_llm import TEXTS, prose


def clashing(df):
    """Further columns under names that the operators use inside."""
    return df.selectExpr("*", *[f"'x' AS {c}" for c in ("norm", "part", "score", "template", "host", "salt", "node", "seg", "kept", "n") if c not in df.columns])


def test_quality_rules_by_sql(spark):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(100 + i, prose(100 + i, 150), "en") for i in range(20)] + [(0, TEXTS[0], "en"), (None, "no number", None), (300, "#$ x! é ü " * 60, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality_rules.judge(clashing(docs)).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    exp = con.execute(quality_rules.sql()).df()[list(got.columns)]
    keys = ["doc_id", "n_words", "word_chars"]
    for c in got.columns:
        a, b = (x.sort_values(keys)[c].reset_index(drop=True) for x in (got, exp))
        assert ((a == b) | (a.isna() & b.isna())).all(), c
    assert got["char_distance"].notna().any() and not got["kept"].all() and got["kept"].any()


def _tree(paths, how):
    """host, path -> template, recursively; paths: (host, path) -> (n, bad)."""
    out = {}

    def level(items, above, d):
        nodes = defaultdict(list)
        for key, segs in items:
            if len(segs) <= d:
                out[key] = above
            else:
                nodes[segs[d]].append((key, segs))
        inside = [x for v in nodes.values() for x in v]
        if len(inside) == 1:
            key, segs = inside[0]
            out[key] = above + "/" + "/".join(segs[d:])
            return
        sums = {s: [sum(paths[k][j] for k, _ in v) for j in (0, 1)] for s, v in nodes.items()}
        n, bad = (sum(x[j] for x in sums.values()) for j in (0, 1))
        share = (bad + 0.5) / (n + 1)
        interval = lambda p: min(how.intervals - 1, math.floor(math.asin(math.sqrt(p)) / (math.pi / 2) * how.intervals))
        k = {s: interval((x[1] + how.branch_prior * share) / (x[0] + how.branch_prior)) for s, x in sums.items()}
        wild = {s for s, x in sums.items() if len(nodes) >= how.siblings and x[0] < max(3, how.share * n) and k[s] == interval(share)}
        alike = Counter(k[s] for s in nodes if s not in wild)
        below = defaultdict(list)
        for s, v in nodes.items():
            ending = re.search(r"\.[A-Za-z0-9]{1,5}$", s)
            mark = "*" + (ending.group() if ending else "") if s in wild else f"+{k[s]}" if alike[k[s]] > 1 else s
            below[mark] += v
        for mark, v in below.items():
            level(v, above + "/" + mark, d + 1)

    for host in {h for h, _ in paths}:
        level([((h, p), [s for s in p.split("/") if s]) for h, p in paths if h == host], "", 0)
    return out


def test_url_templates_by_recursion(spark):
    r = np.random.default_rng(5)
    words = ["a", "b", "c", "x.html", "y.html", "1", "2", "3"]
    urls = [f"http://h{r.integers(2)}.net/" + "/".join(words[j] if r.random() < 0.7 else str(r.integers(500)) for j in r.integers(0, 8, r.integers(0, 9))) for _ in range(600)]
    urls += urls[:50] + ["http://deep.org/" + "/".join("abcdefghij" * 4), "http://deep.org/" + "/".join("abcdefghij" * 4) + "/z", None, "no scheme", ""]
    pages = clashing(spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[0])], "page_id long, url string"))
    labels = spark.createDataFrame([(i, int("/a" in (urls[i] or "") or r.random() < 0.2)) for i in range(650)] + [(3, None), (None, 1)], "page_id long, bad int")
    got = url_filters.judge(pages, [], labels).toPandas()
    assert len(got) == len(urls) + 1
    known = {x.page_id: x.bad for x in labels.dropna().collect()}
    sums = defaultdict(lambda: [0, 0, 0])
    for x in got.itertuples():
        s, y = sums[x.host, x.path], known.get(x.page_id)
        s[0], s[1], s[2] = s[0] + 1, s[1] + (y is not None), s[2] + (y or 0)
    # The tree counts n for shares and labelled rows for purity: all are labelled but for a few, so compare on a table where all are.
    ruled = url_filters.judge(pages, [url_filters.Rule("net", "/a", "block")]).toPandas()
    paths = defaultdict(lambda: [0, 0])
    for x in ruled.itertuples():
        paths[x.host, x.path][0] += 1
        paths[x.host, x.path][1] += x.rule is not None
    exp = _tree(dict(paths), url_filters.Tree())
    assert all(exp[x.host, x.path] == x.template for x in ruled.itertuples())
    assert url_filters.judge(pages.where("false"), []).count() == 0 and set(got["verdict"]) <= {"allow", "block"}


def _family(r, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for i in r.integers(0, len(w), edits):
            w[i] = f"e{r.integers(10**9)}"
        out.append(" ".join(w))
    return out


def test_near_dedup_against_all_pairs(spark):
    """Families of edited copies at many similarities; classes are the components of all pairs at 0.8 or more, in any layout."""
    r = np.random.default_rng(7)
    texts = []
    for f in range(40):
        base = [f"f{f}w{i}" for i in r.permutation(int(r.integers(60, 300)))]
        texts += _family(r, base, int(r.integers(2, 12)), int(r.integers(0, 6)))
    for edits in (1, 2):
        texts += _family(r, [f"hot{edits}x{i}" for i in range(220)], 60, edits)
    texts += [f"short text {i}" for i in range(5)] * 2
    order = r.permutation(len(texts))
    texts = [texts[i] for i in order]
    docs = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    weights = near_dedup.common_shingles(docs, near_dedup.Near())
    bags = []
    for t in texts:
        _, what, tf, _, _ = near_dedup.shingles(pa.array([t]), 5)
        bags.append(dict(zip(what.tolist(), weights.of(what, tf).tolist())))
    parent, bands = list(range(len(texts))), []

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = bags[i], bags[j]
        if a.keys() & b.keys():
            met = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
            s = met / (sum(a.values()) + sum(b.values()) - met)
            if s >= 0.8:
                bands.append((s, i, j))
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = {x.doc_id: x for x in near_dedup.classes(docs).collect()}
    found = [got[i].class_id == got[j].class_id for _, i, j in bands]
    assert len(bands) > 1000 and np.mean(found) >= 0.99
    near = [f for f, (s, _, _) in zip(found, bands) if s < 0.85]
    assert len(near) > 30 and np.mean(near) >= 0.95
    assert all(root(i) == root(got[i].class_id) for i in range(len(texts)))  # no two classes are joined wrongly
    assert all(got[i].n_links > 0 for i in range(len(texts)) if got[i].class_id != i and texts[i] != texts[got[i].class_id])
    other = {x.doc_id: x.class_id for x in near_dedup.classes(docs.repartition(7, "text")).collect()}
    assert other == {i: x.class_id for i, x in got.items()}


def test_trees_by_recursion():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = quality_classifier.fit(x, y, quality_classifier.Fit(trees=6, depth=3))

    def walk(t, i, row):
        if i >= 2**trees.depth - 1:
            return trees.leaf[t, i - (2**trees.depth - 1)]
        return walk(t, 2 * i + 1 + (row[trees.feature[t, i]] > trees.threshold[t, i]), row)

    exp = [1 / (1 + math.exp(-(trees.base + sum(walk(t, 0, row) for t in range(len(trees.leaf)))))) for row in x]
    assert np.allclose(trees.scores(x), exp)
    # The first split: every feature and every edge tried by hand.
    how = quality_classifier.Fit()
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = (-1.0, None, None)
    for j in range(4):
        for e in np.unique(np.quantile(x[:, j], np.linspace(0, 1, how.bins + 1)[1:-1])):
            left = x[:, j] <= e
            if min(h[left].sum(), h[~left].sum()) >= how.least:
                gain = sum(g[m].sum() ** 2 / (h[m].sum() + how.l2) for m in (left, ~left))
                best = max(best, (gain, j, e), key=lambda z: z[0])
    assert (trees.feature[0, 0], trees.threshold[0, 0]) == best[1:]
    assert np.mean((trees.scores(x) > 0.5) == y) > 0.9


def test_bm25_by_formula():
    r = np.random.default_rng(4)
    docs = [r.integers(0, 60 if i % 3 else 400, r.integers(1, 80)).astype(np.uint16) for i in range(70)]
    df = np.zeros(1 << 16)
    for d in docs:
        df[np.unique(d)] += 1
    idf, mean, how = np.log1p((70 - df + 0.5) / (df + 0.5)), np.mean([len(d) for d in docs]), packing.Packing()
    shard = packing.Shard(docs, idf, mean, how)
    for q in (0, 5, 33):
        exp = [sum(idf[t] * (tf := int((d == t).sum())) * (how.k1 + 1) / (tf + how.k1 * (1 - how.b + how.b * len(d) / mean)) for t in set(docs[q].tolist())) for d in docs]
        assert np.allclose(shard.scores(q), exp, rtol=1e-5)
        unused = r.random(70) < 0.5
        near = shard.neighbours(q, unused)
        assert set(near) == {i for i in range(70) if unused[i] and exp[i] > 0} and (np.diff(shard.scores(q)[near]) <= 0).all()
    found = packing.routes(docs, df.astype(np.int64), idf)
    for d, route in zip(docs, found):
        best = sorted(((np.float32(np.log1p((d == t).sum()) * idf[t]) if df[t] > 1 else 0, t) for t in set(d.tolist())), reverse=True)
        assert route & 0xFFFF == (best[1][1] if len(best) > 1 else 0)


def test_restoring_by_enumeration():
    counts = toxicity.trigram_vector(pa.array(["stupid moron idiot lost letter " * 40]))
    cost = toxicity.model(counts)

    def readings(i, noisy):
        ch = noisy[i]
        out = [(ch, 0.0)] if ch.isalpha() else [(r, toxicity.READ) for r in toxicity.READINGS.get(ch, "")]
        if out and i and noisy[i - 1] == ch:
            out.append(("", toxicity.TWICE))
        return out + ([("", toxicity.LEFT_OUT), (" ", 0.0)] if not out or ch in toxicity.MAYBE else [])

    for noisy in ("m0r", "st!p", "a-b!", "leet", "1+1", "i d", "l|lt", "s.t"):
        best = min((sum(p for _, p in c) + _price("".join(o for o, _ in c), cost) for c in itertools.product(*[readings(i, noisy) for i in range(len(noisy))])))
        got = toxicity.restore(noisy, cost.tolist())
        ways = [sum(p for _, p in c) + _price("".join(o for o, _ in c), cost) for c in itertools.product(*[readings(i, noisy) for i in range(len(noisy))]) if "".join(o for o, _ in c).split() == got.split()]
        assert min(ways) == pytest.approx(best)


def _price(text, cost):
    a = b = total = 0
    for ch in text:
        c = 0 if ch == " " else ord(ch) - 96
        if c == 0 and b == 0:
            continue
        total, a, b = total + cost[a][b][c], b, c
    return total + (cost[a][b][0] if b else 0)


def test_disguises():
    words = "you are a stupid worthless moron idiot ass go away letter hello".split()
    scorer = toxicity.Scorer(toxicity.Restorer(toxicity.model(toxicity.trigram_vector(pa.array([" ".join(words * 50)])))), {"moron": 5.0, "stupid": 4.0, "idiot": 3.0, "ass": 2.0})
    for text, odds in (("i d ! o t here", 3), ("you a s s !", 2), ("a mo ron he", 5), ("m/o/r/o/n", 5), ("stuupid", 4), ("$ t u p i d", 4), ("s\nt\nu\np\ni\nd", 4), ("moooron", 5), ("st.up.id", 4), ("a nice letter", 0), ("class hello", 0)):
        assert scorer.rows([text])[0, 0] == odds, text


def test_edges_of_scorers(spark):
    rows = [(i, prose(i, 60) + (" moron" if i % 4 == 1 else "")) for i in range(60)] + [(None, "no number"), (3, prose(3, 60)), (3, prose(3, 60)), (70, None), (71, ""), (72, "x" * 200_000)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = clashing(spark.createDataFrame([(i, i % 2, int(i % 4 == 1)) for i in range(60)] + [(3, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"))
    for module in (quality_classifier, toxicity):
        got = module.classify(docs, labels).toPandas()
        assert len(got) == len(rows) and got["score"].between(0, 1).all() and got[got.doc_id == 3]["score"].nunique() == 1 and not got[got.doc_id.isna()]["held_out"].any()
        assert module.classify(docs.where("false"), labels).count() == 0
    trained = toxicity.train(docs, labels)
    assert toxicity.keep(docs, trained).columns == docs.columns


def test_archives_of_edges(spark):
    rows = [(i, f"u{i}", "<p>" + "z" * 3000 if i % 2 else f"own {i} " * 200) for i in range(30)] + [(7, "again", "<p>" + "z" * 3000), (None, None, None)]
    pages = clashing(spark.createDataFrame(rows, "record_id long, uri string, payload string"))
    for most in (10**6, 0):  # the way with and without a broadcast
        path = scratch_path(spark, "w")
        warc.write_archives(pages, path, most_broadcast=most)
        got = warc.read_archives(spark, path).toPandas()
        assert len(got) == len(rows) and (got.record_type == "revisit").sum() == 15 and set(got.refers_to.dropna()) == {29}
    ids, members = [], 0
    for folder, _, files in os.walk(path.removeprefix("file:")):
        for f in files:
            if f.startswith("part"):
                text = gzip.open(f"{folder}/{f}").read()  # an ordinary reader of gzip reads all members
                ids += re.findall(rb"WARC-Record-ID: (\S+)", text)
    assert len(ids) == len(set(ids)) == len(rows)
    warc.write_archives(pages.where("false"), path + "e")
    assert warc.read_archives(spark, path + "e").count() == 0


def test_exact_dedup_cut_runs(spark):
    """A text with so many copies that splitters cut it, and others beside it."""
    rows = [(i, "same  text" if i % 3 else f"text {i % 50}") for i in range(3000)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).drop("part")
    got = exact_dedup.dedup(docs, exact_dedup.Plan(per_partition=12)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t.replace("  ", " ")].append(i)
    assert all((x.keep_id, x.group_size) == (min(g := groups[rows[x.doc_id][1].replace("  ", " ")]), len(g)) and x.kept == (x.doc_id == min(g)) for x in got) and len(got) == 3000


def test_pipeline(spark, tmp_path):
    """Stage by stage: what each one keeps is what its operator says over the stage's own input."""
    r = np.random.default_rng(9)
    rows = [(i, prose(i, 120) + (" moron idiot" if i % 5 == 1 else "") if i % 4 else "BUY!! NOW!! " * 40) for i in range(300)]
    rows += [(400 + i, rows[i][1]) for i in range(0, 60, 3)] + [(500 + i, rows[i][1] + " and one more end") for i in range(0, 60, 3)] + [(600, None), (601, ""), (2, rows[2][1])]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 5 == 1 and i % 4 > 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    got, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = got
        got = corpus_pipeline.materialise(stage(spark, got, folder), name)
        kept[name] = got
        ids = sorted(x.doc_id for x in got.select("doc_id").collect())
        if name == "quality":
            said = quality_classifier.score(before, quality_classifier.train(before, labels)).where("score >= 0.5")
        elif name == "toxicity":
            said = toxicity.classify(before, labels).where("predicted = 0")
        elif name == "exact_dedup":
            said = exact_dedup.dedup(before).where("kept")
            texts = [re.sub(r"[\x20\x09-\x0D]+", " ", x.text or "") for x in got.collect()]
            assert len(texts) == len(set(texts))
        elif name == "near_dedup":
            said = near_dedup.classes(before).where("kept")
        if name != "packing":
            assert ids == sorted(x.doc_id for x in said.collect()) and got.columns == docs.columns and 0 < len(ids) < before.count()
    assert sorted({x.doc_id for x in kept["packing"].collect()}) == sorted(x.doc_id for x in kept["near_dedup"].collect())
    left = {x.doc_id for x in kept["near_dedup"].collect()}
    assert not [i for i in left if i >= 400 and i < 600 and i % 100 in left], left  # a planted copy goes where its original stayed
    assert len({x.doc_id for x in kept["quality"].collect()} & {i for i in range(300) if i % 4}) > 200  # clean documents stay
    assert not [x for x in kept["toxicity"].collect() if "moron" in (x.text or "")]
    run = corpus_pipeline.run(spark, folder).toPandas()
    assert sorted(run["doc_id"]) == sorted(x.doc_id for x in kept["packing"].collect())
