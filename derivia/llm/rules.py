"""Quality rules whose cutoffs come with a guarantee: exact binomial bounds on labelled documents, by stratum.

All work is DataFrame expressions. Every rule rejects a document whose share (signs, repeated lines, repeated
windows) is over a cutoff. For each stratum and rule the cutoffs of a fixed grid are tested from the
loosest to the strictest: of the labelled good documents of the stratum that pass the base rules, so
many lie over the cutoff; if so few or fewer would do so with probability of at most alpha / (strata x rules)
when the true false-rejection rate is epsilon / rules (the exact binomial test, the same as a
Clopper-Pearson bound), the cutoff is certified. The first that isn't ends the sequence, so one level
holds for the whole sequence; Bonferroni covers strata and rules. With probability 1 - alpha the rules together then reject at
most epsilon of the good documents of every stratum. A stratum with too few labels gets no cutoff, and the
base rules alone decide there.

Windows are equal when the 64-bit hashes of their words' hashes are.

Defined cases: a null text has no words, and fewer than 20 words fail the base rules; a null stratum
is 'und'; of several labels of a document the worst counts; unlabelled documents aren't used in tests;
repeated rows are judged each, and are one trial of the test, with the largest share of each rule; a share
equal to a cutoff is kept; a very long text is one row like any other, counted whole; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from derivia.llm.common import fits_broadcast, plain_keys, written

SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
RULES = ("symbol_share", "dup_line_share", "repeat_share")
GRID = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02)
WINDOW = 8
#: Rows of cutoffs up to which their table is sent to all tasks.
FEW_STRATA = 10_000


def word_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (all long); the text goes."""
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACE_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_SPLIT))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    less = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    first = docs.select(*others, words.alias("_words"), lines.alias("_lines"), F.length(F.translate(t, SPACE_CHARS, "")).alias("word_chars"), less(t, SYMBOLS).alias("n_symbols"))
    # a hash of every window of words; most texts have no two alike, and are done
    n = F.size("_words")
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    second = first.select("*", n.alias("n_words"), F.size("_lines").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"), hashes.alias("_h")).drop("_words", "_lines")
    n = F.size("_h")
    window = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(F.col("_h"), i, WINDOW)))).otherwise(F.array().cast("array<long>"))
    third = second.withColumn("_w", window).drop("_h")
    repeated = F.size(F.array_distinct("_w")) < F.size("_w")
    pair = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).alias("i"))
    fourth = third.withColumn("_s", F.when(repeated, F.sort_array(F.transform("_w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(F.slice(F.array(pair), 1, 0))).drop("_w")
    s = F.col("_s")
    alike = F.filter(s, lambda e, k: (e["x"] == F.get(s, k - 1)["x"]) | (e["x"] == F.get(s, k + 1)["x"]))
    fifth = fourth.withColumn("_p", F.sort_array(F.transform(alike, lambda e: e["i"]))).drop("_s")
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    longs = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")]
    return fifth.select(*others, *longs, covered.cast("long").alias("n_repeat_words"))


def log_factorial(x: Column) -> Column:
    y = F.greatest(x, F.lit(20)).cast("double")
    series = y * F.log(y) - y + 0.5 * F.log(2 * F.pi() * y) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return F.when(x < 20, F.log(F.factorial(F.least(x, F.lit(19)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate) where k is below the mean (1 elsewhere): the sum of its terms from k downwards.

    Below the mean m = n * rate the j-th term is at most exp(-j (j - 1) / 2m) of the first, so that all terms
    after 12 sqrt(m) + 64 together are less than a double can tell; the sum ends there, or at the last term.
    """
    top = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(rate)) + (n - k) * F.log(F.lit(1 - rate)))
    ratio = lambda j: (k - j) * (1 - rate) / ((n - k + j + 1) * rate)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))
    below = k < n * rate
    last = F.when(below, F.least(k.cast("long"), (12 * F.sqrt(n * rate) + 64).cast("long"))).otherwise(F.lit(0).cast("long"))
    terms = F.aggregate(F.sequence(F.lit(0).cast("long"), last), start, lambda a, j: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * ratio(j)).alias("term")))
    return F.when(below, top * terms["sum"]).otherwise(F.lit(1.0))


def shares() -> list[Column]:
    of = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return [of("n_symbols", "word_chars").alias(RULES[0]), of("n_dup_lines", "n_lines").alias(RULES[1]), of("n_repeat_words", "n_words").alias(RULES[2])]


def cutoffs(judged: DataFrame, epsilon: float = 0.02, alpha: float = 0.05) -> DataFrame:
    """(stratum, one column for each rule: its strictest certified cutoff or null) from rows (stratum, the shares), one for each labelled good document."""
    counts = judged.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col(r) > g).cast("long")).alias(f"{r}_{i}") for r in RULES for i, g in enumerate(GRID)])
    counts = written(counts, "counts")
    level = alpha / (max(1, counts.count()) * len(RULES))
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(g).alias("cut"), F.col(f"{r}_{i}").alias("k")) for r in RULES for i, g in enumerate(GRID)])
    flat = counts.select("stratum", "n", F.explode(tests).alias("t")).select("stratum", "n", "t.*")
    passed = flat.withColumn("passed", binomial_tail(F.col("k"), F.col("n"), epsilon / len(RULES)) <= level)
    # the sequence ends at the first failure
    first = passed.groupBy("stratum", "rule").agg(F.coalesce(F.min(F.when(~F.col("passed"), F.col("i"))), F.lit(len(GRID))).alias("fail"))
    grid = F.array(*[F.lit(g) for g in GRID])
    chosen = first.where("fail > 0").withColumn("cut", F.get(grid, F.col("fail") - 1))
    return chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{r}") for r in RULES])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def prepared(docs: DataFrame, stratum: str) -> DataFrame:
    return plain_keys(docs, "doc_id", "text", stratum).select("doc_id", F.col("text").cast("string"), F.coalesce(F.col(stratum).cast("string"), F.lit("und")).alias("stratum"))


def good_documents(labels: DataFrame) -> DataFrame:
    """Ids of the documents all of whose labels are good."""
    return plain_keys(labels, "doc_id", "quality").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")


def with_verdict(stats: DataFrame, cuts: DataFrame) -> DataFrame:
    """stats(stratum, the counts, ...) plus base_failed and kept."""
    named = cuts.withColumnRenamed("stratum", "_stratum")
    if fits_broadcast(named, FEW_STRATA):
        named = F.broadcast(named)
    out = stats.select("*", base_failed().alias("base_failed"), *shares()).join(named, F.col("stratum") == F.col("_stratum"), "left")
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~over)


def certified(stats: DataFrame, labels: DataFrame, epsilon: float = 0.02, alpha: float = 0.05) -> DataFrame:
    """The cutoffs that the labelled good documents in stats(doc_id, stratum, the counts) certify."""
    tested = stats.where(~base_failed()).select("doc_id", "stratum", *shares()).join(good_documents(labels), "doc_id", "left_semi")
    # a document is one trial, however many rows it has: the largest of its shares count
    once = tested.groupBy("doc_id").agg(F.min("stratum").alias("stratum"), *[F.max(r).alias(r) for r in RULES])
    return written(cutoffs(once, epsilon, alpha), "cutoffs")


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", epsilon: float = 0.02, alpha: float = 0.05) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for each row of docs(doc_id, text, <stratum>)."""
    stats = written(word_stats(prepared(docs, stratum)), "rules")
    out = with_verdict(stats, certified(stats, labels, epsilon, alpha))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def accepted(docs: DataFrame, labels: DataFrame, stratum: str = "lang", epsilon: float = 0.02, alpha: float = 0.05) -> DataFrame:
    """The rows of docs(doc_id, text, <stratum>, ...) that the rules keep, with their columns. Rows and counts are written once and read twice; no text is shuffled."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    base = docs.select(whole, F.col("text").cast("string").alias("text"), F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("und")).alias("stratum"))
    base = base.withColumn("doc_id", F.col("_row.doc_id"))
    stats = written(word_stats(base), "rules")
    return with_verdict(stats, certified(stats, labels, epsilon, alpha)).where("kept").select("_row.*")


def oracle(documents: str = "documents", epsilon: float = 0.02, alpha: float = 0.05) -> str:
    """The same in DuckDB SQL; log-gamma in place of the series."""
    grid = ", ".join(map(str, GRID))
    rate = epsilon / len(RULES)
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, 'und') AS stratum FROM {documents}),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    win AS (SELECT rid, i, list_aggregate(words[i:i + 7], 'string_agg', ' ') AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
    rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
    cov AS (SELECT rid, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
    s AS (SELECT w.doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words,
            CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
            CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
          FROM w LEFT JOIN cov USING (rid)),
    b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
            n_symbols / greatest(word_chars, 1) AS symbol_share, n_dup_lines / greatest(n_lines, 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_share FROM s),
    good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
    j AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
    r AS (UNPIVOT (SELECT stratum, symbol_share, dup_line_share, repeat_share FROM j) ON symbol_share, dup_line_share, repeat_share INTO NAME rule VALUE share),
    g AS (SELECT generate_subscripts([{grid}], 1) AS i, unnest([{grid}]) AS cut),
    k AS (SELECT stratum, rule, i, cut, count(*) AS n, count(*) FILTER (WHERE share > cut) AS k FROM r, g GROUP BY ALL),
    p AS (SELECT *, CASE WHEN k >= n * {rate} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({rate}) + (n - x) * ln(1 - {rate})))) END AS tail,
            (SELECT count(DISTINCT stratum) FROM j) AS strata FROM k),
    f AS (SELECT stratum, rule, coalesce(min(i) FILTER (WHERE tail > {alpha} / (strata * {len(RULES)})), {len(GRID) + 1}) AS fail FROM p GROUP BY ALL),
    c AS (SELECT stratum, {", ".join(f"max(cut) FILTER (WHERE rule = '{x}') AS cut_{x}" for x in RULES)} FROM f JOIN g ON g.i = f.fail - 1 GROUP BY stratum)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT coalesce(symbol_share > cut_symbol_share, false) AND NOT coalesce(dup_line_share > cut_dup_line_share, false) AND NOT coalesce(repeat_share > cut_repeat_share, false) AS kept
    FROM b LEFT JOIN c USING (stratum)"""
