"""Operator 10, personal data by aggregated weak supervision, with DataFrame functions only.

Candidate spans come from strict patterns, which always count, and from wider
ones: spelled-out and spaced addresses, national phone numbers, IPv6 and
defanged addresses, card numbers with other separators (their check digit must hold),
keys and tokens. Labelers vote on every candidate or abstain: its pattern, check
digits and character counts, gazetteers, the words before, what follows, its
shape. Expectation-maximisation over the counted vote patterns of each kind
estimates how reliable each labeler is. Their posteriors then train the final
span classifier, a naive Bayes model over the discrete features of a span, which
decides on the wider spans.

Texts are read once: what is kept of a row are its matches, the lengths of the
gaps between them and a little context. Places are running sums over these.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filmroll.llm.common import documents, materialize
from filmroll.llm.weak import fit_counts

#: Kinds of personal data, in the order in which spans are listed; those after the first four are found by the method alone.
KINDS = ("email", "ip", "card", "phone", "secret")

_LOCAL = r"[A-Za-z0-9._%+-]"
_AT, _DOT = r" ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?", r"(?:\.| ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?)"
#: Candidates: (kind, strict, quick test, expression). Repetitions are possessive and starts are anchored,
#: so that long runs of one character class cost no more than their length.
PATTERNS = (
    ("email", True, r"@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, r"[0-9]\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, r"[0-9](?:[\x20-]?[0-9]){12}", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", True, r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", False, r"[\[({<] ?(?:at|AT|@) ?[\])}>]", rf"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"),
    ("email", False, r" (?:at|AT) [A-Za-z0-9-]++ (?:dot|DOT) ", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ (?:at|AT) [A-Za-z0-9-]++(?: (?:dot|DOT) [A-Za-z0-9-]++)++"),
    ("email", False, r"[A-Za-z0-9] ?@ ?[A-Za-z0-9-]++ ?\. ?[A-Za-z]", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?@ ?[A-Za-z0-9-]++(?: ?\. ?[A-Za-z0-9-]++)++"),
    ("phone", False, r"[0-9]\)?[ ./-][0-9]{2,4}[ ./-][0-9]{2,4}", r"(?<![0-9+.(/-]|[0-9] )(?:\([0-9]{2,5}\) ?|(?:00|0|1[ .-])?[0-9]{2,4}[ ./-])(?:[0-9]{2,4}[ ./-]){1,3}[0-9]{2,4}(?![0-9]|[.:/-][0-9])"),
    ("ip", False, r"[0-9A-Fa-f]?:[0-9A-Fa-f]{0,4}:", r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}(?![0-9A-Za-z:])"),
    ("ip", False, r"[0-9] ?(?:\[\.\]|\(\.\)| \. ) ?[0-9]", r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\.) ?[0-9]{1,3}){3}(?![0-9.])"),
    ("card", False, r"[0-9](?:[\x20-]?[0-9]){12}", r"[0-9](?:[\x20-]?[0-9])++"),
    ("card", False, r"[0-9]{4}[./_ –][0-9]{4}[./_ –][0-9]", r"(?<![0-9])[0-9]{4}([./_ –])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])"),
    ("secret", False, r"[A-Za-z0-9+/_=-]{20}", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}+"),
    ("secret", False, r"-----BEGIN ", r"-----BEGIN (?:[A-Z0-9]++ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END (?:[A-Z0-9]++ ){0,3}PRIVATE KEY-----)?+"),
)

#: Top-level domains that a gazetteer of addresses knows.
DOMAINS = "com org net edu gov mil int info biz name pro mobi asia app dev page blog shop site online store tech cloud io co ai tv me cc ws us uk de fr es it nl be ch at se no dk fi is ie pt pl cz sk hu ro bg gr hr si rs ba mk al lt lv ee ru ua by kz tr il sa ae eg za ng ke gh ma tn dz cn jp kr in id my sg th vn ph hk tw pk bd lk np br mx ar cl co pe ve uy ec bo py cr pa gt cu do pr au nz ca eu cat gal example test local".split()
#: The first digits of card numbers by issuer, of special and reserved addresses, and of well-known keys.
ISSUERS = r"^(?:4|5[1-5]|2(?:2[2-9]|[3-6]|7[01])|3[47]|3[068]|35|6(?:011|22|4[4-9]|5)|50|5[6-8]|6[0-9])"
RESERVED = r"^(?:0|22[4-9]|23[0-9]|24[0-9]|25[0-5])(?:\.|\[|\(| )"
KEY_STARTS = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|pk_live_|AIza|eyJ|ya29|SG|npm_|-----BEGIN)"
#: Words that stand near personal data, and words that stand near other things of that look.
NEAR = {
    "email": r"(?i)e-?mail|contact|write|reach|correo|kontakt|courriel|reply",
    "ip": r"(?i)\bip(?:v[46])?\b|address|host|server|login|client|adresse|dirección",
    "card": r"(?i)card|visa|master|amex|payment|credit|karte|carte|tarjeta",
    "phone": r"(?i)phone|tel|call|fax|mobile|cell|contact|anruf|appel|llam",
    "secret": r"(?i)token|secret|passw|passphrase|api[ _-]?key|access[ _-]?key|private|credential|auth|bearer",
}
FAR = r"(?i)version|release|chapter|figure|isbn|issn|section|order no|serial|\$ ?$|#$"
FAR_SECRET = r"(?i)commit|revision|sha-?[0-9]*|md5|checksum|digest|uuid|integrity|hash|https?:|www\."
#: What follows a number that counts or measures something.
AFTER = r"^(?: ?%| ?[€$£]| (?:kg|km|cm|mm|px|times|percent|users|rows|bytes)\b)"


def _found(text: Column, n: int) -> Column:
    """Matches of pattern ``n`` with the length of the gap before and the text around; null if there is none."""
    kind, strict, quick, pattern = PATTERNS[n]
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.zip_with(
        matches,
        F.transform(gaps, lambda g, i: F.struct(i.alias("i"), F.length(g).alias("gap"), F.right(g, F.lit(40)).alias("before"), F.left(F.coalesce(F.get(gaps, i + 1), F.lit("")), F.lit(20)).alias("after"))),
        lambda m, g: F.struct(F.lit(n).alias("pattern"), g["i"].alias("i"), g["gap"].alias("gap"), m.alias("match"), g["before"].alias("before"), g["after"].alias("after")),
    )
    return F.when(text.rlike(quick), F.filter(rows, lambda r: r["match"].isNotNull()))


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_id, doc_id) of all rows, and the candidate spans: row_id, kind, strict, start, end, match, before, after."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<pattern:int,i:int,gap:int,match:string,before:string,after:string>>")
    read = docs.select("doc_id", F.monotonically_increasing_id().alias("row_id"), text.alias("text"))
    found = materialize(read.select("doc_id", "row_id", F.concat(*[F.coalesce(_found(F.col("text"), n), none) for n in range(len(PATTERNS))]).alias("found")))
    each = found.where(F.size("found") > 0).select("row_id", F.inline("found"))
    upto = W.partitionBy("row_id", "pattern").orderBy("i")
    size = F.length("match")
    placed = each.withColumn("end", (F.sum(F.col("gap") + size).over(upto)).cast("long")).withColumn("start", F.col("end") - size)
    kind_of = F.element_at(F.array(*[F.lit(p[0]) for p in PATTERNS]), F.col("pattern") + 1)
    strict_of = F.element_at(F.array(*[F.lit(p[1]) for p in PATTERNS]), F.col("pattern") + 1)
    spans = placed.select("row_id", kind_of.alias("kind"), strict_of.alias("strict"), "start", "end", "match", "before", "after")
    spans = spans.where(F.when(F.col("strict"), _valid()).otherwise(_possible()))
    # wider matches over a strict one can never stay; in order of start, those before and after tell
    around = W.partitionBy("row_id").orderBy("start")
    strict_end = F.max(F.when(F.col("strict"), F.col("end"))).over(around.rangeBetween(W.unboundedPreceding, 0))
    strict_start = F.min(F.when(F.col("strict"), F.col("start"))).over(around.rangeBetween(0, W.unboundedFollowing))
    apart = F.coalesce(strict_end <= F.col("start"), F.lit(True)) & F.coalesce(strict_start >= F.col("end"), F.lit(True))
    spans = spans.withColumn("apart", apart).where(F.col("strict") | F.col("apart")).drop("apart")
    return found.select("row_id", "doc_id"), spans


def _digits() -> Column:
    return F.regexp_replace("match", "[^0-9]", "")


def _luhn() -> Column:
    """Whether the digits of the match pass the check of card numbers."""
    each = F.split(F.reverse(_digits()), "")
    doubled = F.transform(each, lambda d, i: d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def _possible() -> Column:
    """What a wider match needs to be looked at: lengths that fit, a card's check digit, and no strict match in the same place."""
    kind, n = F.col("kind"), F.length(_digits())
    strict = F.col("match").rlike(r"^[0-9](?:[\x20-]?[0-9])+$")
    return F.when(kind == "card", n.between(13, 19) & ~strict & _luhn()).when(kind == "phone", n.between(7, 15)).when(kind == "ip", F.length("match") > 2).otherwise(F.lit(True))


def _valid() -> Column:
    """The checks that a strict match has to pass."""
    n = F.length(_digits())
    parts = F.transform(F.split("match", r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    kind = F.col("kind")
    return F.when(kind == "ip", F.forall(parts, lambda ok: ok)).when(kind == "card", n.between(13, 19) & _luhn()).when(kind == "phone", n.between(9, 15)).otherwise(F.lit(True))


LABELERS = ("by_pattern", "by_check", "by_gazetteer", "by_before", "by_after", "by_shape")
#: What the classifier looks at beside the kind; a span's length stands in classes of 8 characters.
FEATURES = (*LABELERS[1:], "length")


def label(spans: DataFrame) -> DataFrame:
    """Add the labelers' votes (1, 0 or null) and the other features of a span."""
    kind, match, before, after = F.col("kind"), F.col("match"), F.col("before"), F.col("after")
    either = lambda yes, no: F.when(yes, 1).when(no, 0)
    by_kind = lambda **votes: F.coalesce(*[F.when(kind == k, v) for k, v in votes.items()])
    digits = _digits()
    n = F.length(digits)
    tld = F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)$", 1))
    v4, groups = ~match.contains(":"), F.size(F.split(match, ":"))
    octets = F.forall(F.regexp_extract_all(match, F.lit(r"[0-9]+"), F.lit(0)), lambda p: F.length(p).between(1, 3) & (p.try_cast("int") <= 255))
    kinds_of_chars = F.size(F.array_distinct(F.split(match, "")))
    same_digit = digits.rlike(r"^(\d)\1+$")
    near = by_kind(**{k: before.rlike(words) for k, words in NEAR.items()})
    far = F.when(kind == "secret", before.rlike(FAR_SECRET)).otherwise(before.rlike(FAR))
    check = by_kind(
        email=either(tld.rlike(r"^[a-z]{2,}$"), tld.rlike(r"^[0-9]|^.$")),
        ip=F.when(v4, either(octets, ~octets)).otherwise(either((groups == 8) & ~match.contains("::") | match.rlike(r"^[0-9A-Fa-f:]*::[0-9A-Fa-f]+") & (F.length(F.regexp_replace(match, "[^0-9A-Fa-f]", "")) > 4), (groups < 8) & ~match.contains("::"))),
        card=either(~same_digit, same_digit),
        phone=either(n.between(9, 13), (n < 9) | (n > 13)),
        secret=either((kinds_of_chars >= 10) & (8 * n >= F.length(match)) | match.startswith("-----"), (kinds_of_chars < 8) | (16 * n < F.length(match))),
    )
    gazetteer = by_kind(
        email=either(tld.isin(DOMAINS), ~tld.isin(DOMAINS)),
        ip=F.when(v4, either(~match.rlike(RESERVED), match.rlike(RESERVED))).otherwise(F.when(match.rlike(r"^(?:2[0-9A-Fa-f]{3}|3[0-9A-Fa-f]{3}|fe80|fc|fd)"), 1)),
        card=either(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)),
        phone=F.when(match.rlike(r"^(?:\+|00)[1-9]|^\(?0[1-9]|^\(?[2-9][0-9]{2}\)?[ .-]"), 1),
        secret=F.when(match.rlike(KEY_STARTS), 1),
    )
    shape = by_kind(
        email=either(match.rlike(r"^[A-Za-z0-9]") & match.rlike(r"(?i)@|[\[({<] ?at|\bdot\b"), match.rlike(r"^[._%+-]")),
        ip=F.when(v4, either(match.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), match.rlike(r"\d{4}"))).otherwise(F.when(match.rlike(r"^\d{1,2}:\d{2}(?::\d{2})?$"), 0)),
        card=either(match.rlike(r"^\d{4}([ -])\d{4}\1\d{4}\1\d+$"), match.rlike(r"^(?:\d[ -]){6}")),
        phone=either(match.rlike(r"^\+|\(\d{2,5}\)|^\d{3}([.-])\d{3}\1\d{4}$"), match.rlike(r"^(?:19|20)\d{2}[./-]\d{2}[./-]\d{2}|/|^\d{2}[./-]\d{2}[./-]\d{2,4}$")),
        secret=F.when(match.rlike(r"^[a-z]+(?:[-_/][a-z0-9]+)+$|^[0-9_/+=-]+$|(?:/[A-Za-z0-9._-]+){3,}"), 0).when(match.rlike(r"^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})$|^[A-Za-z0-9_-]{32,128}$|^[A-Za-z0-9+/]{38,}={0,2}$|^-----"), 1),
    )
    number = kind.isin("ip", "card", "phone")
    behind = F.when(kind == "secret", F.when(after.rlike(r"""^["'`]"""), 1)).when(number, F.when(after.rlike(AFTER) | after.rlike(r"^[A-Za-z_]"), 0))
    return spans.withColumns({"by_pattern": F.when(F.col("strict"), 1), "by_check": check, "by_gazetteer": gazetteer, "by_before": F.when(near, 1).when(far, 0), "by_after": behind, "by_shape": shape, "length": F.least(F.floor(F.length(match) / 8), F.lit(5)).cast("int")})


Weights = dict[str, dict[str, dict[str, float]]]


def fit_classifier(labelled: DataFrame, trust: float = 5.0) -> Weights:
    """Per kind, the log-odds weights of a naive Bayes span classifier: by feature and value, "" being the prior of a wider span.

    The labelers' reliabilities are learnt kind by kind, then the classifier
    from the posteriors, both from counted patterns of features; of these there
    are at most some thousands, whatever the corpus. A labeler's likelihoods
    start from its reliability, which counts as much as ``trust`` spans, so
    votes that are rare or missing in a kind still weigh; abstentions say
    nothing. Lengths start out even.
    """
    patterns = [r.asDict() for r in labelled.groupBy("kind", "strict", *LABELERS, "length").agg(F.count("*").alias("n")).collect()]
    return {kind: _kind_weights([r for r in patterns if r["kind"] == kind], trust) for kind in KINDS}


def _kind_weights(patterns: list[dict], trust: float) -> dict[str, dict[str, float]]:
    votes_of = lambda r: tuple(r[k] for k in LABELERS)
    counts: dict[tuple, float] = {}
    for r in patterns:
        counts[votes_of(r)] = counts.get(votes_of(r), 0) + r["n"]
    model = fit_counts(counts, len(LABELERS), prior=0.5)
    good, bad = {f: {} for f in FEATURES}, {f: {} for f in FEATURES}
    for r in patterns:
        p = model.of(votes_of(r))
        for f in FEATURES:
            good[f][r[f]] = good[f].get(r[f], 0.0) + r["n"] * p
            bad[f][r[f]] = bad[f].get(r[f], 0.0) + r["n"] * (1 - p)
    wide = [(r["n"], model.of(votes_of(r))) for r in patterns if not r["strict"]]
    prior = (sum(n * p for n, p in wide) + 1) / (sum(n for n, _ in wide) + 2)
    weights = {"": {"": math.log(prior / (1 - prior))}}
    for k, f in enumerate(FEATURES):
        if f == "length":
            sure, unsure = {v: 1 / 6 for v in range(6)}, {v: 1 / 6 for v in range(6)}
        else:
            a, b = model.sensitivity[k + 1], model.specificity[k + 1]
            sure, unsure = {1: a, 0: 1 - a}, {1: 1 - b, 0: b}
        share = lambda found, start, v: (found.get(v, 0.0) + trust * start[v]) / (sum(n for x, n in found.items() if x is not None) + trust)
        weights[f] = {str(v): math.log(share(good[f], sure, v) / share(bad[f], unsure, v)) for v in sure}
    return weights


def classify(labelled: DataFrame, weights: Weights) -> DataFrame:
    """Add ``probability``, the classifier's verdict on each span."""
    table = lambda f: F.create_map(*[x for kind in KINDS for v, w in weights[kind][f].items() for x in (F.lit(f"{kind}:{v}"), F.lit(w))])
    at = lambda f, value: F.coalesce(F.element_at(table(f), F.concat_ws(":", "kind", F.coalesce(value.cast("string"), F.lit("none")))), F.lit(0.0))
    log_odds = at("", F.lit(""))
    for f in FEATURES:
        log_odds = log_odds + at(f, F.col(f))
    return labelled.withColumn("probability", 1 / (1 + F.exp(-log_odds)))


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Spans of personal data in every row of ``docs`` (doc_id, text).

    Returns doc_id and spans, an array of (rank of the kind, start, end, kind,
    strict, probability), places in code points, end exclusive. Strict spans
    always stay; a wider one stays if its probability reaches ``threshold``, it
    overlaps no strict one, and no wider one of those begins before it (or at its
    place, and is longer) and reaches into it. Null and empty texts have no
    spans; very long texts are searched whole, in time that follows their
    length; repeated rows each get a row; other columns are ignored; an empty
    table gives no rows.
    """
    rows, spans = candidates(docs)
    labelled = materialize(label(spans))
    scored = classify(labelled, fit_classifier(labelled))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    likely = scored.where(F.col("strict") | (F.col("probability") >= threshold)).withColumn("rank", rank)
    earlier = W.partitionBy("row_id", "strict").orderBy("start", F.desc("end"), "rank").rowsBetween(W.unboundedPreceding, -1)
    free = F.coalesce(F.max("end").over(earlier) <= F.col("start"), F.lit(True))
    entry = F.struct("rank", "start", "end", "kind", "strict", F.round("probability", 6).alias("probability"))
    kept = likely.withColumn("free", free).where(F.col("strict") | F.col("free")).groupBy("row_id").agg(F.sort_array(F.collect_list(entry)).alias("spans"))
    empty = F.array().cast("array<struct<rank:int,start:bigint,end:bigint,kind:string,strict:boolean,probability:double>>")
    return rows.join(kept.hint("merge"), "row_id", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def _of(kind: str):
    return lambda s: s["strict"] & (s["kind"] == kind)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the personal data in every document."""
    found = find_pii(documents(spark, sf_dir))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    strict = F.filter("spans", lambda s: s["strict"])
    counts = [F.size(F.filter("spans", _of(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(listed(strict), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op10_pii": op10_pii}
ORACLE_SQL: dict[str, str] = {}
