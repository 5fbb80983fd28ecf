"""Language identification, the prefix trie and the alignment of tokenizers against formulas, SQL and loops; edge rows."""

import hashlib
import itertools
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bookloom.llm import language_id, prefix_trie, token_alignment
from bookloom.llm.common import materialise

DATA = "/root/testdata/sf0.01"


def same(got, exp):
    """Equal rows, whatever their order; nulls equal each other."""
    rows = [sorted(map(tuple, x.astype(object).where(x.notna(), -1).to_numpy().tolist())) for x in (got, exp[list(got.columns)])]
    return rows[0] == rows[1]


# -- languages


def _open(i):
    return zlib.crc32(str(i).encode()) % 4 != 2


def _languages(rows, most, orders):
    """Predictions by the formulas, word by word."""
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if i is not None and text is not None and lang is not None and _open(i):
            for w in language_id.words(text):
                counts[0, lang][w] += 1
                for k in range(1, orders + 1):
                    p = f" {w} "
                    for j in range(len(p) - k + 1):
                        counts[k, lang][p[j : j + k]] += 1
    totals = {key: sum(c.values()) for key, c in counts.items()}
    names = sorted({lang for _, lang in counts}, key=lambda x: (-totals[0, x], x))
    limit = len(names) / most

    def value(kind, piece):
        shares = [counts[kind, x][piece] / totals[kind, x] if totals.get((kind, x)) else 0 for x in names]
        return [math.log(max(s, limit / 10)) for s in shares] if max(shares) >= limit else None

    for i, text, _ in rows:
        found = language_id.words(text or "")
        sums = [0.0] * len(names)
        for w in found:
            v = value(0, w)
            for k in range(orders, 0, -1):
                if v is None:
                    each = [x for x in (value(k, g) for g in language_id.grams(w, k)) if x is not None]
                    v = np.mean(each, 0) if each else None
            sums = [a + b for a, b in zip(sums, v if v is not None else [0.0] * len(names))]
        best = max(range(len(names)), key=lambda j: (sums[j], -j))
        yield (i, names[best], 1 / sum(math.exp(s - sums[best]) for s in sums)) if found else (i, "und", 0.0)


def test_languages_by_formula(spark):
    r = np.random.default_rng(3)
    words = {"xx": ["bar", "bard", "fool", "the", "zu"], "yy": ["der", "die", "zug", "übel", "the"], "zz": ["un", "deux", "garçon"]}
    rows = [(i, " ".join(r.choice(words[x], 12)), x) for i, x in enumerate(r.choice(list(words), 90))]
    rows += [(200, "barf dergel qq", None), (201, None, "xx"), (202, "", "yy"), (203, "12 + 3!", "yy"), (204, "漢字", None), (None, "der die", "xx"), (5, rows[5][1], rows[5][2]), (206, "bar " * 30_000 + "der " * 29_000, None), (207, "nützlich GARÇON", None)]
    docs = spark.createDataFrame([(*x, "a") for x in rows], "doc_id long, text string, lang string, piece string")
    for most in (60, 100_000):  # with 60, some words and n-grams are not known
        got = language_id.identify(docs, most, 3).toPandas()
        assert list(got.columns) == ["doc_id", "held_out", "lang_pred", "score"] and len(got) == len(rows)
        exp = pd.DataFrame(_languages(rows, most, 3), columns=["doc_id", "lang_pred", "score"])
        key = lambda d: d.sort_values(["doc_id", "lang_pred", "score"]).reset_index(drop=True)
        got, exp = key(got), key(exp)
        assert (got["lang_pred"] == exp["lang_pred"]).all() and np.allclose(got["score"], exp["score"], atol=1e-4)
    known = got["doc_id"].notna()
    assert (got["held_out"][known] == [not _open(int(i)) for i in got["doc_id"][known]]).all() and not got["held_out"][~known].any()
    assert set(got["lang_pred"][got["doc_id"].isin([201, 202, 203])]) == {"und"}
    empty = language_id.identify(docs.where("false"))
    assert empty.count() == 0 and language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()[0][0] == "und"


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count() > 100


# -- trie


def _talks(seed, n):
    """Conversations with nulls, ties, repeated rows, shared beginnings, copies and none of the foot's turns."""
    r = np.random.default_rng(seed)
    out = []
    for c in [*range(n), *range(1001, 1001 + n // 2), 2350, None]:
        for t in range(r.integers(1, 7)):
            turn = None if r.random() < 0.05 else int(r.integers(3)) if r.random() < 0.2 else t
            out.append((c, turn, None if r.random() < 0.1 else "user", None if r.random() < 0.05 else r.choice(["a", "b", "ß" * 40, ""])))
            if r.random() < 0.05:
                out.append(out[-1])
    return out


@pytest.mark.parametrize("seed,limit", [(1, 16_384), (1, 3), (2, 40), (3, 1)])
def test_trie_by_sql(spark, seed, limit):
    rows = _talks(seed, 150)
    talks = spark.createDataFrame([(*x, "k", 1) for x in rows], "conv_id long, turn long, role string, text string, key string, depth int")
    got = prefix_trie.nodes(prefix_trie.rebuilt(talks), limit).toPandas()
    con = duckdb.connect()
    con.register("conversations", talks.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert same(got, con.execute(prefix_trie.SQL).df()) and len(got) > 100


def test_trie_edges(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert prefix_trie.nodes(prefix_trie.rebuilt(spark.createDataFrame([], kind))).count() == 0
    assert prefix_trie.nodes(prefix_trie.rebuilt(spark.createDataFrame([(None, 0, "u", "x")], kind))).count() == 0
    alone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 0)  # loses its only turn, and has no foot
    got = prefix_trie.nodes(prefix_trie.rebuilt(spark.createDataFrame([(alone, 0, "u", "x")], kind))).collect()
    assert [tuple(r) for r in got] == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_trie_long_and_many(spark, monkeypatch):
    """A conversation of 5000 turns, and copies whose identifiers fill several blocks."""
    long = [(300, t, "u", f"t{t}") for t in range(5000)]
    many = [(100 * c, 0, "u", "same") for c in range(10, 400)]
    monkeypatch.setattr(prefix_trie, "BLOCK", 1024)
    got = prefix_trie.nodes(prefix_trie.rebuilt(spark.createDataFrame(long + many, "conv_id long, turn long, role string, text string")), 1000).toPandas()
    # Feet keep their own turns: h of them as foot, the rest as their own.
    assert got["depth"].max() == 5000 and len(got) == 1 + 5000 + 1
    row = got[got["n_convs"] == 390].iloc[0]
    assert (row["conv_id"], row["saved_tokens"], row["ends_sha256"]) == (1000, 389 * 4, hashlib.sha256(",".join(str(c) for c, *_ in many).encode()).hexdigest())


# -- alignment


def _aligned(rows, a, b):
    """The contract by a loop over both token lists."""
    out, links = [], []
    for i, text in rows:
        ids = [a.inner.encode(" " + text, add_special_tokens=False).ids, b.inner.encode(text)] if text else [[], []]
        raw = [[t.bytes[x] for x in own] for t, own in zip((a, b), ids)]
        if not text or any(b"".join(x) != (" " + text).encode() for x in raw):
            out.append((i, 0, 0, 0, 0, ""))
            links.append([])
            continue
        ends = [list(itertools.accumulate(map(len, x))) for x in raw]
        groups, found, at = [], [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            to = [sum(x <= e for x in ends[k]) if len(ends[k]) < 400 else int(np.searchsorted(ends[k], e, side="right")) for k in (0, 1)]
            groups.append("|".join(",".join(map(str, ids[k][at[k] : to[k]])) for k in (0, 1)))
            for p, q in itertools.product(range(at[0], to[0]), range(at[1], to[1])):
                if max(ends[0][p] - len(raw[0][p]), ends[1][q] - len(raw[1][q])) < min(ends[0][p], ends[1][q]):
                    found.append((ids[0][p], ids[1][q]))
            at = to
        out.append((i, len(ids[0]), len(ids[1]), len(groups), len(found), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(found)
    counts = Counter(x for own in links for x in set(own))
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    return sorted((*x[:5], sum(counts[y] == best[y[0]] for y in own), sum(counts[y] for y in own), x[5]) for x, own in zip(out, links))


ODD = ["a  b", "a\r\nb", " ", "  ", "\n", "x\t y", "▁q", "<s> </s> <|endoftext|> z", "a;\r\n;\r", "tab\t\tx", "　a 　 b", "é\x85 \x1c x", "\x00 ", "ends  ", "\n\n a\n\n", "naïve 🙂 🙂🙂", "a\x1c\nb \x1f c", "x" * 20_000, " \r x\r  y", "the  the\n the"]


def test_alignment_by_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows += [(10**6 + i, t) for i, t in enumerate(ODD)] + [(5, None), (6, ""), (7, "dup dup"), (7, "dup dup")]
    exp = _aligned(rows, token_alignment.ByteLevel("byte_bpe_50k.json"), token_alignment.Pieces("piece_bpe_32k.model"))
    table = spark.createDataFrame([(*x, b"l", 2) for x in rows], "doc_id long, text string, links binary, row int").repartition(5)
    for most in (2_000_000, 500, 0):  # the last two look rare pairs up by bucket
        assert sorted(map(tuple, token_alignment.align_documents(table, most_common=most).collect())) == exp
    assert token_alignment.align_documents(table.where("false")).count() == 0


def test_alignment_by_chance(spark):
    """Random strings of the characters that cuts depend on."""
    r = np.random.default_rng(8)
    rows = [(i, "".join(r.choice(list(" \n\r\t　;)ab▁é{"), r.integers(1, 30), p=[0.3, 0.1, 0.06, 0.05, 0.04, 0.1, 0.05, 0.1, 0.1, 0.01, 0.05, 0.04]))) for i in range(1500)]
    exp = _aligned(rows, token_alignment.ByteLevel("byte_bpe_50k.json"), token_alignment.Pieces("piece_bpe_32k.model"))
    assert sorted(map(tuple, token_alignment.align_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == exp


def test_alignment_groups(spark):
    """The real output: groups written out, and links as keys with numbers."""
    got = materialise(token_alignment.align(spark.createDataFrame([(1, "hello hello")], "doc_id long, text string"), "byte_bpe_50k.json", "piece_bpe_32k.model"), "t").first()
    first, second = got["groups"].split(";")
    keys, times = np.frombuffer(got["links"], np.uint32), np.frombuffer(got["times"], np.uint32)
    assert first == second and [f"{k // 32_000}|{k % 32_000}" for k in keys] == [first] and list(times) == [2]
