"""Personal data in texts: fixed patterns, and what weakly supervised labellers add to them.

Base spans come from the patterns of each kind and their checks, and always stay. Looser patterns give
candidates: what is written another way ("name (at) host", digits without a plus, eight groups of an
IPv6 address), and much that isn't personal. Six labellers vote on each candidate, personal, not, or nothing:
its form and its grouping by regular expressions, its parts against gazetteers, cue words before it, counter-cues
before it, and what touches it. Spark counts the vote patterns of all candidates, expectation-maximisation on
these counts estimates how reliable each labeller is, and each pattern's posterior. These posteriors train a
span classifier (naive Bayes on hashed features: shape, digits, the words around) by conditional sums over
all candidates. A candidate is added where its score is at least MIN_SCORE, its text holds no base match
and it meets no base span.

All work on rows is DataFrame expressions. The driver sees the counts of at most 4 x 3^6 vote patterns, and
the sums of 4 x BUCKETS features.

Defined cases: a null text is empty and has no spans; positions are code points, ends exclusive; matches
of a pattern that fail its check are dropped, without a second try inside them; repeated rows are judged
each and count each in the fits; equal scores are equal decisions; a very long text is one row, searched
whole; an empty table gives an empty result; where no candidate exists nothing is added; extra columns are
ignored.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from derivia.llm.common import plain_keys, written

KINDS = ("email", "ip", "card", "phone")
#: The patterns; possessive, and tried only where a match can begin, so that time is in proportion to the text.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++(?:@| ?[\[(](?:at|AT)[\])] ?)[A-Za-z0-9-]++(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]++(?:\.[0-9]++){2,}+|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z])",
    "card": r"(?<![0-9])[0-9](?:[ ./_-]?[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+|00)?[(]?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}+(?![0-9])",
}
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
IPV6 = "^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"
#: Code points before and after a candidate that labellers and features see.
NEAR = 32

# --- gazetteers: fixed values ---
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "dev", "app", "eu", "uk", "de", "fr", "es", "it", "nl", "be", "ch", "at", "pl", "pt", "se", "no", "fi", "dk", "ie", "us", "ca", "mx", "br", "ar", "au", "nz", "jp", "cn", "in", "za"]
CALLING_CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|60|61|62|63|64|65|66|81|82|84|86|90|91|92|351|352|353|358|420|421|972"
CARD_PREFIXES = "4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38"
CUES = {
    "email": "mail|e-mail|contact|write|reach|correo|courriel|kontakt",
    "ip": "ip|host|server|address|addr|login from|dirección|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|tarjeta|carte|karte",
    "phone": "tel|phone|call|mobile|cell|fax|telefon|téléphone|teléfono|whatsapp",
}
COUNTER_CUES = "version|release|build|isbn|issn|doi|order|invoice|ticket|id|no\\.|nr\\.|number|page|section|serial|part|model|ref|\\$|€|£"
LABELLERS = ("form", "grouping", "gazetteer", "cue", "counter_cue", "border")
PATTERNS = 3 ** len(LABELLERS)

#: Features of a kind are hashed into so many buckets.
BUCKETS = 2048
#: Probability from which a candidate is added.
MIN_SCORE = 0.95
#: Elements of an array that are summed in one go; more would take the square of their number.
RUN = 256


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(lengths: Column) -> Column:
    """For each element of array<int> the sum of all before it (array<long>), by runs of RUN."""
    def of(a: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("all"))
        step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["all"], F.array(s["sum"])).alias("all"))
        within = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / RUN).cast("int")), lambda b: F.aggregate(F.slice(a, b * RUN + 1, RUN), start, step))
        return let(within, lambda w: let(F.aggregate(F.transform(w, lambda x: x["sum"]), start, step)["all"], lambda first: F.flatten(F.zip_with(w, first, lambda x, f: F.transform(x["all"], lambda s: s + f)))))

    return F.when(F.size(lengths) == 0, F.array().cast("array<long>")).otherwise(let(lengths, of))


def has_any(text: Column, *parts: str) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in parts])


#: What a text must hold for a pattern to match: much cheaper to tell, and most texts don't.
NEEDS = {
    BASE["email"]: lambda t: has_any(t, "@"),
    BASE["phone"]: lambda t: has_any(t, "+"),
    LOOSE["email"]: lambda t: has_any(t, "@", "at)", "AT)", "at]", "AT]"),
    LOOSE["ip"]: lambda t: t.rlike("[0-9:]"),
}


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match, left, right>>: all matches of the pattern, leftmost first, with what is near them up to the matches beside."""
    def placed(gaps: Column, found: Column) -> Column:
        both = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, x: F.struct(F.right(g, F.lit(NEAR)).alias("left"), x.alias("match"), F.length(g).alias("gap"), F.length(x).alias("size")))
        after = F.transform(F.slice(gaps, 2, F.size(found)), lambda g: F.left(g, F.lit(NEAR)))
        starts = lambda b: sums_before(F.transform(b, lambda e: e["gap"] + e["size"]))
        row = lambda b: F.zip_with(F.zip_with(b, starts(b), lambda e, s: F.struct((s + e["gap"]).alias("start"), (s + e["gap"] + e["size"]).alias("end"), e["match"].alias("match"), e["left"].alias("left"))), after, lambda e, r: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["match"].alias("match"), e["left"].alias("left"), r.alias("right")))
        return let(both, row)

    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string,left:string,right:string>>")
    needs = NEEDS.get(pattern, lambda t: t.rlike("[0-9]"))
    return F.when(~needs(text), none).otherwise(let(F.split(text, pattern, -1), lambda gaps: F.when(F.size(gaps) < 2, none).otherwise(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: placed(gaps, found)))))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    """Whether a match of the kind's base pattern passes its check."""
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return let(digits(m), lambda d: F.when(F.length(d).between(16, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<start, end>> of the kind's base spans."""
    found = F.filter(matches(text, BASE[kind]), lambda x: valid(kind, x["match"]))
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def labels(kind: str, c: Column) -> list[Column]:
    """The votes on a candidate (2 personal, 1 not, 0 nothing), in the order of LABELLERS."""
    m, left, right = c["match"], F.lower(c["left"]), c["right"]
    d = digits(m)
    choose = lambda yes, no: F.when(yes, 2).when(no, 1).otherwise(0)
    strict = m.rlike(f"^(?:{BASE[kind]})$") & valid(kind, m)
    if kind == "email":
        wrong, grouped = ~m.rlike(r"(?:\.|(?i:dot)[\])] ?)[A-Za-z]{2,}$"), m.rlike("^[^@\\[( ]*[A-Za-z]")
        gazetteer = choose(F.lower(F.regexp_extract(m, "([A-Za-z]+)$", 1)).isin(TOP_DOMAINS), F.lit(True))
    elif kind == "ip":
        wrong, grouped = ~valid(kind, m) & ~m.rlike(IPV6), ~m.rlike(r"(?:^|\.)0[0-9]")
        gazetteer = choose(F.lit(False), m.rlike(r"^(?:0|127|255|22[4-9]|2[3-4][0-9])\."))
    elif kind == "card":
        wrong, grouped = ~let(d, lambda x: F.length(x).between(13, 19) & F.call_function("luhn_check", x)), m.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([ ./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ ./_-])[0-9]{6}\2[0-9]{5})$")
        gazetteer = choose(d.rlike(f"^(?:{CARD_PREFIXES})"), F.lit(True))
    else:
        wrong, grouped = (~m.startswith("+") & ~m.rlike("[ ()./-]")) | (m.rlike(f"^{BASE['ip']}$") & valid("ip", m)), m.rlike("[()]|[0-9][ ./-]+[0-9]+[ ./-]+[0-9]")
        gazetteer = choose(m.rlike(rf"^(?:\+|00)(?:{CALLING_CODES})"), m.startswith("+"))
    glued = left.rlike("(?:[\\p{L}0-9_@]|[0-9][ .,/:-])$") | right.rlike("^(?:[\\p{L}0-9_@]|[ .,/:-][0-9])")
    return [choose(strict, wrong), choose(grouped, ~grouped), gazetteer, choose(left.rlike(rf"(?:^|[^\p{{L}}])(?:{CUES[kind]})[^\p{{L}}]{{0,4}}$"), F.lit(False)), choose(F.lit(False), left.rlike(rf"(?:^|[^\p{{L}}])(?:{COUNTER_CUES})[^\p{{L}}]{{0,3}}$")), choose(~glued, glued)]


def features(kind: str, c: Column) -> Column:
    """array<int> of buckets: the candidate's shape, digits, the words beside it, and the signs that touch it."""
    m = c["match"]
    shape = F.regexp_replace(F.regexp_replace(m, "[0-9]+", "9"), "[A-Za-z]+", "a")
    word = lambda t, p: F.lower(F.regexp_extract(t, p, 1))
    each = [shape, F.length(digits(m)).cast("string"), word(c["left"], r"(\p{L}+)\P{L}*$"), word(c["right"], r"^\P{L}*(\p{L}+)"), F.regexp_extract(c["left"], r"([^\p{L}0-9]?)$", 1), F.regexp_extract(c["right"], r"^([^\p{L}0-9]?)", 1)]
    first = BUCKETS * KINDS.index(kind)
    return F.array(*[(F.pmod(F.xxhash64(F.lit(k), x), F.lit(BUCKETS)) + first).cast("int") for k, x in enumerate(each)])


def holds_base(kind: str, m: Column) -> Column:
    return F.exists(F.regexp_extract_all(m, F.lit(BASE[kind]), F.lit(0)), lambda x: valid(kind, x))


def as_spans(kind: str) -> Column:
    """The kind's base spans with its place in KINDS."""
    return F.transform(kind, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def candidates(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, pattern, features, base>>: base tells whether a base match of any kind is in the candidate."""
    def one(c: Column) -> Column:
        votes = labels(kind, c)
        pattern = sum((v * 3**k for k, v in enumerate(votes)), F.lit(PATTERNS * KINDS.index(kind)))
        has_base = reduce(Column.__or__, [holds_base(k, c["match"]) for k in KINDS])
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), pattern.cast("int").alias("pattern"), features(kind, c).alias("features"), has_base.alias("base"))

    return F.transform(matches(text, LOOSE[kind]), one)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans of each kind, and the candidates of all; no texts."""
    d = plain_keys(docs, "doc_id", "text").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    return d.select("doc_id", *[base_spans(F.col("t"), k).alias(k) for k in KINDS], F.concat(*[candidates(F.col("t"), k) for k in KINDS]).alias("candidates"))


def posteriors(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """Probability of personal for each vote pattern, by EM over the counts of one kind's patterns.

    Starts from the share of votes for personal, which fixes what the two classes mean; a labeller's rates
    are those among the votes it gives, smoothed by one candidate each.
    """
    votes = {p: [p % PATTERNS // 3**k % 3 for k in range(len(LABELLERS))] for p in counts}
    p = {x: (1.0 + v.count(2)) / (2.0 + v.count(2) + v.count(1)) for x, v in votes.items()}
    total = sum(counts.values())
    for _ in range(rounds):
        logs = []
        for k in range(len(LABELLERS)):
            yes, no = [1.0, 1.0], [1.0, 1.0]
            for x, v in votes.items():
                if v[k]:
                    yes[v[k] - 1] += counts[x] * p[x]
                    no[v[k] - 1] += counts[x] * (1 - p[x])
            logs.append([math.log(yes[i] / sum(yes)) - math.log(no[i] / sum(no)) for i in range(2)])
        prior = min(max(sum(counts[x] * p[x] for x in counts) / total, 1e-3), 1 - 1e-3)
        new = {x: 1 / (1 + math.exp(-max(-40.0, min(40.0, math.log(prior / (1 - prior)) + sum(logs[k][v - 1] for k, v in enumerate(vs) if v))))) for x, vs in votes.items()}
        moved = max(abs(new[x] - p[x]) for x in p)
        p = new
        if moved < 1e-6:
            break
    return p


def trained(found: DataFrame) -> tuple[list[float], list[float]]:
    """The classifier: a weight for each bucket and a prior for each kind, from found(kind, pattern, features)."""
    spark = found.sparkSession
    counts = {r["pattern"]: r["count"] for r in found.groupBy("pattern").count().collect()}  # at most 4 x PATTERNS
    known: dict[int, float] = {}
    for k in range(len(KINDS)):
        mine = {p: n for p, n in counts.items() if p // PATTERNS == k}
        known |= posteriors(mine) if mine else {}
    # millionths, so that sums don't depend on their order
    shares = spark.createDataFrame([(p, round(x * 1e6)) for p, x in sorted(known.items())], "pattern int, share long")
    per = found.select("pattern", F.explode("features").alias("bucket")).groupBy("pattern", "bucket").count().join(F.broadcast(shares), "pattern")
    sums = per.groupBy("bucket").agg(F.sum(F.col("count") * F.col("share")).alias("yes"), F.sum(F.col("count") * (1_000_000 - F.col("share"))).alias("no")).collect()  # at most 4 x BUCKETS
    yes = [sum(counts[p] * x for p, x in known.items() if p // PATTERNS == k) + 1 for k in range(len(KINDS))]
    no = [sum(counts[p] * (1 - x) for p, x in known.items() if p // PATTERNS == k) + 1 for k in range(len(KINDS))]
    weights = [0.0] * (BUCKETS * len(KINDS))
    for r in sums:
        k = r["bucket"] // BUCKETS
        weights[r["bucket"]] = round(math.log((r["yes"] / 1e6 + 0.5) / (yes[k] + 1)) - math.log((r["no"] / 1e6 + 0.5) / (no[k] + 1)), 6)
    return weights, [round(math.log(a / b), 6) for a, b in zip(yes, no, strict=True)]


def joined(spans: Column) -> Column:
    """kind:start:end of array<struct<kind, start, end>>, by kind and start, with commas."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (base and added) for each row of docs(doc_id, text)."""
    found = written(marked(docs), "pii")
    weights, priors = trained(found.select(F.explode("candidates").alias("c")).select("c.kind", "c.pattern", "c.features"))
    table = lambda x: F.from_json(F.lit(json.dumps(x)), "array<double>")
    least = math.log(min_score / (1 - min_score))
    score = lambda c: F.aggregate(c["features"], F.get(table(priors), c["kind"]), lambda s, b: s + F.get(table(weights), b))
    out = found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.concat(*map(as_spans, KINDS)).alias("base"), F.filter("candidates", lambda c: ~c["base"] & (score(c) >= least)).alias("more"))
    apart = F.filter("more", lambda c: ~F.exists("base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    added = F.transform(apart, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", added)).alias("spans"))


def base_only(docs: DataFrame) -> DataFrame:
    """The columns of personal() that the patterns alone decide."""
    d = plain_keys(docs, "doc_id", "text").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    d = d.select("doc_id", *[base_spans(F.col("t"), k).alias(k) for k in KINDS])
    return d.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.concat(*map(as_spans, KINDS))), 256).alias("base_sha256"))


def oracle() -> str:
    """base_only in DuckDB SQL, with the plain patterns."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    number = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({number}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(reverse({number})[j] AS INT) ELSE CAST(reverse({number})[j] AS INT) * 2 - CASE WHEN CAST(reverse({number})[j] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    checks = {"email": "true", "ip": "len(list_filter(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0", "card": f"length({number}) BETWEEN 16 AND 19 AND {luhn}", "phone": f"length({number}) BETWEEN 8 AND 15"}
    found = " UNION ALL ".join(
        f"SELECT rid, {i} AS k, '{k}' AS kind, unnest(regexp_extract_all(t, '{patterns[k]}')) AS m, unnest(range(1, len(regexp_extract_all(t, '{patterns[k]}')) + 1)) AS i, regexp_extract_all(t, '{patterns[k]}') AS a, regexp_split_to_array(t, '{patterns[k]}') AS g FROM d" for i, k in enumerate(KINDS)
    )
    good = " OR ".join(f"(kind = '{k}' AND {checks[k]})" for k in KINDS)
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    f AS (SELECT rid, k, kind, m, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(a[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM ({found})),
    v AS (SELECT * FROM f WHERE {good})
    SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in KINDS)},
           sha256(coalesce(string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY k, s), '')) AS base_sha256
    FROM d LEFT JOIN v USING (rid) GROUP BY rid, doc_id"""
