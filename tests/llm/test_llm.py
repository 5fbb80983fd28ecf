"""Text operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and further columns."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from bookloom.llm import bpe_codec, exact_dedup, near_dedup, packing, quality_classifier, quality_rules, token_counts, toxicity, url_filters, warc
from bookloom.llm.common import scratch_path

WORDS = "the of and to in that it was alpha beta gamma delta kappa sigma omega river stone cloud".split()


def prose(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] + (f"{r.integers(99)}" if i > 8 else "") for i in r.integers(0, len(WORDS), n))


BASE = prose(1, 200)
NEAR = BASE.replace(" ", "  ", 3).rsplit(" ", 3)[0] + " quite another end"
TEXTS = [BASE, BASE.replace(" ", "\n", 5), NEAR, None, "", "one", prose(2, 300), prose(3, 120), "é<|endoftext|>x  y\t#$ 12", "x" * 30000, prose(4, 9000), BASE, "dup line\ndup line\nother", "a b c a b c a b c"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "norm", "x") for i, t in enumerate(TEXTS)] + [(0, BASE, "en", "norm", "x"), (None, "no number", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, norm string, part string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_quality_rules(docs, empty):
    for r in quality_rules.judge(docs).collect():
        t = TEXTS[r["doc_id"]] or "" if r["doc_id"] is not None else "no number"
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)} if len(words) < 5000 else None
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)))
        assert covered is None or r["n_repeat_words"] == len(covered)
    assert quality_rules.judge(empty).count() == 0


def test_exact_dedup(docs, empty):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in enumerate(TEXTS)}
    for plan in (exact_dedup.Plan(), exact_dedup.Plan(per_partition=8)):
        got = exact_dedup.dedup(docs, plan).where("doc_id is not null").collect()
        for r in got:
            same = [i for i in norm if norm[i] == norm[r["doc_id"]]]
            assert (r["keep_id"], r["group_size"]) == (min(same), len(same) + (0 in same)) and r["text_sha256"] == hashlib.sha256(norm[r["doc_id"]].encode()).hexdigest()
        assert sum(r["kept"] for r in got) == len(set(norm.values()))
    assert exact_dedup.keep(docs).count() == len(set(norm.values())) + 1
    assert exact_dedup.dedup(empty).count() == 0


def test_near_dedup(docs, empty):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert got[0] == got[1] == got[2] == got[11] == 0 and got[3] == got[4] == 3 and got[None] is None
    assert all(got[i] == i for i in (5, 6, 7, 8, 9, 10, 12, 13))
    assert near_dedup.classes(empty).count() == 0


def test_tokens(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    from bookloom.llm.vocab import locate

    b, w = (tokenizers.Tokenizer.from_file(locate(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs).collect()}
    coded = {r["doc_id"]: r for r in bpe_codec.encode_documents(docs).collect()}
    decoded = {r["doc_id"]: r["decoded"] for r in bpe_codec.decode_documents(bpe_codec.encode_documents(docs)).collect()}
    for i, t in enumerate(TEXTS):
        assert counts[i] == len(b.encode(t or "", add_special_tokens=False).ids)
        ids = w.encode(t or "", add_special_tokens=False).ids
        assert coded[i]["ids"] == ids and coded[i]["decoded"] == decoded[i] == w.decode(ids, skip_special_tokens=False)
    assert token_counts.count_tokens(empty).count() == 0


def test_merges_agree():
    ranks = {p: i for i, p in enumerate([("a", "b"), ("b", "c"), ("ab", "c"), ("c", "c"), ("cc", "a")])}
    r = np.random.default_rng(0)
    for _ in range(300):
        s = list(r.choice(list("abc"), r.integers(1, 30)))
        assert bpe_codec.rank_array_merge(s, ranks) == [x for x in token_counts.heap_merge(s, ranks) if x is not None]


def test_packing(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    from bookloom.llm.vocab import locate

    w = tokenizers.Tokenizer.from_file(locate("word_bpe_49k.json"))
    known = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = packing.pack(known, how=packing.Packing(window=512, shard_tokens=4000)).toPandas()
    for d, g in got.sort_values("start").groupby("doc_id"):
        ids, at = np.array([*w.encode(TEXTS[d] or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in g.itertuples():
            assert r.start == at and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        n = int(g.length.sum())
        assert (g.offset.to_numpy() == g.length.cumsum().shift(fill_value=0).to_numpy()).all() and n <= 512 and n & (n - 1) == 0
    assert packing.pack(empty).count() == 0


def test_spans_of_the_encoder():
    """Pieces that go to the model at once, beside the library over whole texts; a new word costs no pass of the normaliser."""
    rng = np.random.default_rng(4)
    parts = ["ab", "Éa", "ÿß", "÷", "x", "7", "'s", "'", ",", ".", "!,", "), ", ". ", ", ", ".. ", " ", "\n", "\x1f", "\xa0", "é", "<|", "|>", "İ", "漢", "e\u0301", "ºª", "_", "-"]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), 30)) for _ in range(400)] + ["", " , . ", "a, b. c., d", "<|endoftext|>, Ab. C"]
    encoder = packing.Encoder("word_bpe_49k.json", most_words=50)
    got = [np.frombuffer(x, "<u2").tolist() for x in encoder.texts(texts)]
    assert got == [x.ids for x in encoder.library.encode_batch(texts, add_special_tokens=False)]
    seen = []
    encoder = packing.Encoder("word_bpe_49k.json")
    encoder.encode = lambda spans, **how: seen.extend(spans) or encoder.library.encode_batch(spans, **how)
    encoder.texts(["Words, éàü. more (words) don't"])
    assert seen == ["(words)", "don't"]


def test_encoder_learns_by_slices():
    """All new plain words of a slice go to the model in one call; words of several slices stay when the rest is forgotten."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdeéßÀÞö"), rng.integers(1, 9)))
    parts = [lambda: word(), lambda: word() + rng.choice([",", ".", "!", "),", "7.", "’", "'s,"]), lambda: str(rng.choice(["12,", "É.", "e\u0301,", "÷,", "<|endoftext|>", "İA", "A B", "\x1f", ",", "..", "·."]))]
    texts = ["".join(parts[rng.integers(0, 3)]() + rng.choice([" ", "\n", "  ", ""]) for _ in range(rng.integers(0, 12))) for _ in range(600)]
    column = pa.array([None, "a,", ".b", "", "É", "·,", *texts, None, "end."])
    encoder = packing.Encoder("word_bpe_49k.json", most_words=300)
    calls, split = [], encoder.split
    encoder.split = lambda *a, **how: calls.append(a) or split(*a, **how)
    got = [np.frombuffer(x, "<u2").tolist() for at in range(0, len(column), 50) for x in encoder.column(column.slice(at, 50))]
    assert got == [x.ids for x in encoder.library.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
    assert len(calls) <= -(-len(column) // 50)
    encoder = packing.Encoder("word_bpe_49k.json", most_words=60)
    for _ in range(2):
        encoder.texts(["stays here"])
    encoder.texts([" ".join(map("".join, itertools.product("abcd", repeat=3)))])
    assert list(encoder.known) == [b"stays", b"here"]


def test_new_words_in_one_call():
    encoder = packing.Encoder("word_bpe_49k.json")
    calls, split = [], encoder.split
    encoder.split = lambda *a, **how: calls.append(a) or split(*a, **how)
    texts = [" ".join(map("".join, itertools.product("abcdefgh", repeat=4)))] * 3
    got = [np.frombuffer(x, "<u2").tolist() for x in encoder.texts(texts)]
    assert got == [x.ids for x in encoder.library.encode_batch(texts, add_special_tokens=False)] and len(calls) == 1


def test_warc(spark):
    big = "<p>" + "y" * 1500
    rows = [(1, "http://a/\r\nb", big), (2, "http://a", big), (3, None, "small"), (4, "u", "small"), (5, "v", None), (None, "w", big), (2, "http://a", big), (7, "x", "WARC/1.1\r\n\r\n" * 200)]
    path = scratch_path(spark, "w")
    warc.write_archives(spark.createDataFrame(rows, "record_id long, uri string, payload string"), path)
    got = sorted(warc.read_archives(spark, path).collect(), key=lambda r: (r["record_id"] is None, r["record_id"], r["record_type"]))
    assert [(r["record_id"], r["record_type"], r["refers_to"]) for r in got][:3] == [(1, "revisit", 2), (2, "response", None), (2, "response", None)]
    assert len(got) == len(rows) and all(r["payload_bytes"] == len((dict((a, c) for a, _, c in rows)[r["record_id"]] or "").encode()) for r in got)
    assert got[-1]["record_type"] == "response"


def test_url_filters(spark):
    rows = [(i, f"https://Shop.example.com/item/{i}.html?x") for i in range(40)] + [(50 + i, f"https://shop.example.com/spam/{i}") for i in range(40)] + [(200, None), (201, "no scheme"), (202, "x://a.net/de/8")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 50)) for i in range(90)], "page_id long, bad int")
    got = {r["page_id"]: r for r in url_filters.judge(pages, [url_filters.Rule("net", "/de/", "block")], labels).collect()}
    assert got[3]["host"] == "shop.example.com" and got[3]["path"] == "/item/3.html" and got[3]["template"] == "/item/*.html"
    assert got[3]["verdict"] == "allow" and got[60]["verdict"] == "block" and got[202]["rule"] == "net/de/" and got[202]["verdict"] == "block"
    assert got[200]["host"] == got[201]["path"] == "" and len(got) == len(rows)


def test_classifiers(spark):
    rows = [(i, (prose(i, 80) if i % 3 else "BUY!! NOW!! " * 30) + (" awful m0ron here" if i % 4 == 1 else "")) for i in range(400)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 1)) for i in range(400)], "doc_id long, quality int, toxic int")
    q = {r["doc_id"]: r for r in quality_classifier.classify(docs, labels).collect()}
    t = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    held_q, held_t = [i for i in range(400) if q[i]["held_out"]], [i for i in range(400) if t[i]["held_out"]]
    assert held_q == [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([q[i]["predicted"] == int(i % 3 > 0) for i in held_q]) > 0.97
    assert np.mean([t[i]["predicted"] == int(i % 4 == 1) for i in held_t]) > 0.97
    assert 0 <= q[900]["score"] <= 1 and q[900]["score"] == q[901]["score"] and len(q) == 402
    none = quality_classifier.classify(docs, labels.where("false")).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.5] and toxicity.classify(docs, labels.where("false")).agg({"score": "max"}).first()[0] == 0


def test_restoring():
    counts = sum((toxicity.trigram_vector(__import__("pyarrow").array(["moron stupid idiot loser " * 50])) for _ in range(2)), np.zeros(28**3, np.int64))
    cost = toxicity.model(counts).tolist()
    assert [toxicity.restore(s, cost) for s in ("m0r0n", "stuuuupid", "i d i o t", "l0$er")] == ["moron", "stupid", "idiot", "loser"]


def test_near_dedup_of_hot_bands(spark):
    """A family of texts that share a passage, just under the threshold, against brute force over all pairs."""
    passage, texts = " ".join(f"licence{i}" for i in range(604)), []
    for i in range(1500):
        own = [f"own{i}x{j}" for j in range(41)]
        texts.append(" ".join([passage, *([f"both{i // 2}x{j}" for j in range(6)] if i < 160 else own[:6]), *own[6:]]))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    common = set.intersection(*sets)
    all_share, own = len(common) * near_dedup.Near().floor, [s - common for s in sets]
    similar = {(i, j): (all_share + m) / (all_share + len(own[i]) + len(own[j]) - m) for i in range(len(own)) for j in range(i) for m in [len(own[i] & own[j])]}
    assert sorted(p for p, s in similar.items() if s >= 0.8) == [(i + 1, i) for i in range(0, 160, 2)] and min(similar.values()) > 0.78
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert got == {i: i - i % 2 if i < 160 else i for i in range(len(texts))}


def test_few_false_pairs_of_hot_bands(spark, monkeypatch):
    """Texts that differ in four of twelve words or more, a similarity of 132 / 172 at most: the sketches pass thousands of pairs, hardly one is verified."""
    counts, codes = [], []
    monkeypatch.setattr(near_dedup, "materialise", lambda df, name, make=near_dedup.materialise: (out := make(df, name), counts.append(out.count()) if name == "missed" else None)[0])
    for c in range(1 << 12):
        if all((c ^ d).bit_count() >= 4 for d in codes):
            codes.append(c)
    texts = [" ".join(f"v{j}x{c >> j & 1}" if i == 6 else f"w{j}x{i}" for j in range(12) for i in range(13)) for c in codes]
    got = near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)).collect()
    assert len(codes) == 128 and all(r["class_id"] == r["doc_id"] for r in got)
    assert len(counts) == 1 and counts[0] <= 2 * len(codes), counts


def test_frequencies_of_long_texts(spark):
    """A slice holds few long texts, and one of over 1 MB is alone in its slice; all are counted."""
    phrase = "five words that are common"
    texts = [" ".join(f"w{i}x{j}" for j in range(100_000 if i == 0 else 5000)) + (f" {phrase}" if i % 25 == 0 or i == 99 else "") for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_dedup.common_shingles(docs, near_dedup.Near())
    _, what, _, _, _ = near_dedup.shingles(__import__("pyarrow").array([phrase + " x"]), 5)
    assert set(found.known) & set(what) and len(found.known) == 1 and found.idf[0] == pytest.approx(np.log1p(100 / 5) / np.log1p(50))


def test_restoring_long_spans():
    """A sentence in single letters is one span of any length, and so are words joined by marks."""
    words = "you are a stupid worthless moron go away".split()
    restorer = toxicity.Restorer(toxicity.model(toxicity.trigram_vector(__import__("pyarrow").array([" ".join(words * 50)]))))
    scorer = toxicity.Scorer(restorer, {"moron": 5.0, "stupid": 4.0})
    for times in (1, 6):
        spelled = "".join(" ".join(words * times).replace(" ", ""))
        assert len(" ".join(spelled)) > 60
        for text in (" ".join(spelled), "_".join(words * (2 * times)).replace("o", "0")):
            assert scorer.rows([text])[0, 0] == 5.0
    assert restorer.span("x1" * 20000)[0] == "x1" * 20000
