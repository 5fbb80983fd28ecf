"""Quality rules by distribution divergence, DataFrame functions only.

Every text gets base counts (words, symbols, repeated lines, words in repeated 3-word windows) and two
histograms: characters by class and words by a list of common words.  The corpus's own rows give one
reference pair of histograms for each language (sums over all rows that pass the base rules); a text is
rejected when its Jensen-Shannon distance to the nearest reference is above a limit.  Texts below a length
guard are not compared.

The references come from the corpus itself, and a text is held against the nearest one, whatever its lang says: a wrong tag
rejects nothing.  `sql` states the same rows for the oracle.

Edge cases: a null or empty text has zero counts and fails the base rules; a null or unknown language feeds
no reference but is compared to all of them; without any reference nothing is rejected by distance; repeated
rows are judged each on its own; further columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import SPACE_RE, materialise

# Frequent function words of four languages.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on are with as he be at by this".split(),
    "fr": "de la le et les des en un une est que pour qui dans par au sur pas du il".split(),
    "de": "der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
#: Character classes by what is taken out to leave them; white space and all other characters are two more.
CHAR_CLASSES = {"upper": "[^A-Z]+", "digit": "[^0-9]+", "mark": "[^.,;:!?'\"()-]+", "symbol": "[^#*$%&|<>]+", "beyond": "[\\x00-\\x7F]+"}
_MASK = (1 << 30) - 1  # position bits of a packed window


@dataclass(frozen=True)
class Rules:
    """Parameters: base rules, length guards (words, characters) and distance limits."""

    min_words: int = 50
    max_repeat_percent: int = 50
    guard_words: int = 100
    guard_chars: int = 300
    max_char_distance: float = 0.30
    max_word_distance: float = 0.36
    min_reference_words: int = 1000


def vocabulary() -> list[str]:
    return sorted({w for words in COMMON_WORDS.values() for w in words})


def _let(value: Column, body) -> Column:
    """Bind a value once, so that a lambda over it does not compute it again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more: hashes shortlist windows, texts decide."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(~_MASK)).bitwiseOR(i.cast("long")))

    def shortlist(p: Column) -> Column:
        pairs = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda x, y: F.when(F.shiftrightunsigned(x.bitwiseXOR(y), 30) == 0, F.array(x, y)))
        return F.transform(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))), lambda x: x.bitwiseAND(F.lit(_MASK)).cast("int"))

    def exact(c: Column) -> Column:
        rows = F.array_sort(F.transform(c, lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"))))

        def same(x: Column, y: Column) -> Column:
            return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

        found = _let(rows, lambda r: F.transform(F.filter(r, lambda x, i: same(x, F.get(r, i - 1)) | same(x, F.get(r, i + 1))), lambda x: x["i"]))
        return _let(F.sort_array(found), lambda s: F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    found = _let(_let(F.sort_array(hashes), shortlist), lambda c: F.when(F.size(c) == 0, F.lit(0)).otherwise(exact(c)))
    return F.when(F.size(words) >= 4, found).otherwise(F.lit(0)).cast("long")


def _common_words(words: Column, names: list[str]) -> Column:
    """The names among the words (case and closing punctuation aside) with their counts, as array<struct<word, n>>."""
    longest = max(len(w.encode()) for w in names) + 2
    bare = F.transform(F.filter(words, lambda w: F.octet_length(w) <= longest), lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))))
    found = F.sort_array(F.filter(bare, lambda w: w.isin(names)))

    def counts(s: Column) -> Column:
        last = F.filter(F.transform(s, lambda x, i: F.struct(x.alias("word"), (i + 1).alias("end"), (F.coalesce(F.get(s, i + 1), F.lit("")) != x).alias("ends"))), lambda r: r["ends"])
        return _let(last, lambda e: F.transform(e, lambda r, i: F.struct(r["word"].alias("word"), (r["end"] - F.coalesce(F.get(e, i - 1)["end"], F.lit(0))).cast("long").alias("n"))))

    return _let(found, counts)


def text_counts(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, and the histograms `chars` (by class) and `commons` (by word) of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(
        "doc_id",
        lang.alias("lang"),
        F.length(text).cast("long").alias("n_chars"),
        F.filter(F.split(text, SPACE_RE, -1), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_replace(text, "[a-z\\x20]+", "").alias("marks"),  # what the classes count, without the bulk of the text
    )
    rows = rows.select(
        "doc_id",
        "lang",
        "n_chars",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        *[F.length(F.regexp_replace("marks", c, "")).cast("long").alias(k) for k, c in CHAR_CLASSES.items()],
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        _common_words(F.col("words"), vocabulary()).alias("commons"),
    )
    counted = sum((F.col(c) for c in CHAR_CLASSES), F.lit(0).cast("long"))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    chars = F.array(*CHAR_CLASSES, F.col("n_chars") - F.col("word_chars"), F.col("word_chars") - counted)
    return rows.select("doc_id", "lang", "n_words", "word_chars", F.col("symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_chars", chars.alias("chars"), "commons")


def language_references(counts: DataFrame, rules: Rules = Rules()) -> list[tuple[list[float], dict[str, float]]]:
    """For each language with enough words, its shares by character class and by common word (a few rows reach the driver)."""
    n = len(CHAR_CLASSES) + 2
    good = counts.where(F.col("lang").isin(list(COMMON_WORDS)) & ~F.col("base_failed"))
    sums = good.groupBy("lang").agg(F.sum(F.col("n_words").cast("double")), *[F.sum(F.get("chars", F.lit(i)).cast("double")).alias(f"s{i}") for i in range(n)]).orderBy("lang").collect()
    words = good.select("lang", F.explode("commons").alias("c")).groupBy("lang", "c.word").agg(F.sum("c.n").alias("n")).collect()
    out = []
    for lang, total, *chars in sums:
        if total >= rules.min_reference_words:
            out.append(([x / sum(chars) for x in chars], {r["word"]: r["n"] / total for r in sorted(words, key=lambda r: r["word"]) if r["lang"] == lang}))
    return out


def _js_terms(p: Column, q: Column) -> Column:
    """What one bin adds to the Jensen-Shannon divergence, base 2."""
    m = (p + q) / 2
    term = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return (term(p) + term(q)) / 2


def _char_distance(reference: list[float]) -> Column:
    bins = [_js_terms(F.get("chars", F.lit(i)) / F.col("n_chars"), F.lit(q)) for i, q in enumerate(reference)]
    return F.sqrt(F.greatest(F.lit(0.0), sum(bins, F.lit(0.0))))


def _word_distance(reference: dict[str, float]) -> Column:
    """Words of the list that a text lacks add half of their reference share; all words beyond the list are one bin."""
    known = F.create_map(*[F.lit(x) for kv in sorted(reference.items()) for x in kv]) if reference else F.lit(None).cast("map<string,double>")
    rows = F.transform("commons", lambda c: F.struct((c["n"] / F.col("n_words")).alias("p"), F.coalesce(F.try_element_at(known, c["word"]), F.lit(0.0)).alias("q")))

    def total(r: Column) -> Column:
        p = F.aggregate(r, F.lit(0.0), lambda a, x: a + x["p"])
        q = F.aggregate(r, F.lit(0.0), lambda a, x: a + x["q"])
        met = F.aggregate(r, F.lit(0.0), lambda a, x: a + _js_terms(x["p"], x["q"]))
        all_q = sum(reference.values())
        return F.sqrt(F.greatest(F.lit(0.0), met + (F.lit(all_q) - q) / 2 + _js_terms(F.lit(1.0) - p, F.lit(1.0 - all_q))))

    return _let(rows, total)


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Base counts, distances to the nearest language reference (null under the guards) and `kept` for every row."""
    counts = materialise(text_counts(docs, rules), "counts")
    references = language_references(counts, rules)

    def nearest(each: list[Column], guard: Column) -> Column:
        return F.when(guard, F.array_min(F.array(*each))) if each else F.lit(None).cast("double")

    far = (F.coalesce(F.col("char_distance"), F.lit(0.0)) > rules.max_char_distance) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > rules.max_word_distance)
    out = counts.withColumns({"char_distance": nearest([_char_distance(r[0]) for r in references], F.col("n_chars") >= rules.guard_chars), "word_distance": nearest([_word_distance(r[1]) for r in references], F.col("n_words") >= rules.guard_words)})
    out = out.withColumn("kept", ~F.col("base_failed") & ~far).drop("lang", "n_chars", "chars", "commons")
    return out.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def sql(rules: Rules = Rules()) -> str:
    """The rows of `judge` over a table documents, as SQL."""

    def js(p: str, q: str) -> str:
        def term(x: str) -> str:
            return f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"

        return f"({term(p)} + {term(q)}) / 2"

    names = ", ".join(f"'{w}'" for w in vocabulary())
    langs = ", ".join(f"'{x}'" for x in COMMON_WORDS)
    longest = max(len(w.encode()) for w in vocabulary()) + 2
    classes = ", ".join(f"length(regexp_replace(t, '{c.replace("'", "''")}', '', 'g')) AS {k}" for k, c in CHAR_CLASSES.items())
    n = len(CHAR_CLASSES) + 2
    bins = " + ".join(js(f"(chars[{i}] / n_chars)", f"(sums[{i}] / list_sum(sums))") for i in range(1, n + 1))
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
 s AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
 k AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM s),
 v AS (SELECT rid, i, w AS a, lead(w) OVER (PARTITION BY rid ORDER BY i) AS b, lead(w, 2) OVER (PARTITION BY rid ORDER BY i) AS c FROM k),
 p AS (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM v WHERE c IS NOT NULL) x WHERE n > 1),
 r AS (SELECT rid, count(DISTINCT j) AS n FROM p GROUP BY rid),
 e AS (SELECT s.rid, doc_id, lang, length(t) AS n_chars, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, {classes}, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM s LEFT JOIN r ON s.rid = r.rid),
 b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed, [{", ".join(CHAR_CLASSES)}, n_chars - word_chars, word_chars - ({" + ".join(CHAR_CLASSES)})] AS chars FROM e),
 c AS (SELECT rid, lower(rtrim(w, '.,;:!?')) AS word, count(*) AS n FROM k WHERE strlen(w) <= {longest} AND lower(rtrim(w, '.,;:!?')) IN ({names}) GROUP BY 1, 2),
 g AS (SELECT lang, sum(n_words) AS total, [{", ".join(f"sum(chars[{i}])" for i in range(1, n + 1))}] AS sums FROM b WHERE lang IN ({langs}) AND NOT base_failed GROUP BY lang HAVING sum(n_words) >= {rules.min_reference_words}),
 h AS (SELECT b.lang, word, sum(n) / max(total) AS q FROM c JOIN b ON c.rid = b.rid JOIN g ON b.lang = g.lang WHERE NOT base_failed GROUP BY b.lang, word),
 a AS (SELECT lang, sum(q) AS every FROM h GROUP BY lang),
 x AS (SELECT rid, min(sqrt(greatest(0, {bins}))) AS char_distance FROM b CROSS JOIN g WHERE n_chars >= {rules.guard_chars} GROUP BY rid),
 m AS (SELECT c.rid, g.lang, n / n_words AS p, coalesce(q, 0) AS q FROM c JOIN b ON c.rid = b.rid CROSS JOIN g LEFT JOIN h ON h.lang = g.lang AND h.word = c.word),
 o AS (SELECT rid, lang, sum(p) AS p, sum(q) AS q, sum({js("p", "q")}) AS met FROM m GROUP BY rid, lang),
 y AS (SELECT b.rid, min(sqrt(greatest(0, coalesce(met, 0) + (coalesce(every, 0) - coalesce(o.q, 0)) / 2 + {js("(1 - coalesce(o.p, 0))", "(1 - coalesce(every, 0))")}))) AS word_distance
   FROM b CROSS JOIN g LEFT JOIN a ON a.lang = g.lang LEFT JOIN o ON o.rid = b.rid AND o.lang = g.lang WHERE n_words >= {rules.guard_words} GROUP BY b.rid)
 SELECT doc_id, n_words, word_chars, symbol AS n_symbols, n_dup_lines, n_repeat_words, base_failed, round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance,
 NOT base_failed AND NOT (coalesce(char_distance, 0) > {rules.max_char_distance} OR coalesce(word_distance, 0) > {rules.max_word_distance}) AS kept FROM b LEFT JOIN x ON b.rid = x.rid LEFT JOIN y ON b.rid = y.rid"""
