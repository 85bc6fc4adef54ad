"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation estimates
how reliable each labeler is, and a span classifier is trained on the resulting labels.

Candidates are the matches of the base patterns, valid or not, and those of looser patterns (obfuscated
addresses, masked or oddly parted numbers, national phone numbers, access keys) in what valid base matches
leave.  Five labelers vote 1, 0 or -1 on each: shape, checksum, gazetteer, context before, and neighbouring
characters.  Vote patterns are counted over all documents (at most 5 kinds x 3**5 rows, whatever the input);
expectation-maximisation and the training of the classifier run on that table, and the classifier comes back as a
SQL expression that judges the loose candidates.  Valid base matches always stay, failing ones only teach.
DataFrame functions only.

Defined results: null and empty texts have no span; equal rows get equal results; very long texts are scanned
whole, in time that grows with their length; no candidate at all leaves the classifier untrained and adds nothing;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
# The base patterns of the contract, written so that no text makes them run long.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"\x20?[\[({](?i:at|@)[\])}]\x20?", r"(?:\x20?[\[({](?i:dot|\.)[\])}]\x20?|\.)"
_IP_DOT = r"(?:\[\.\]|\(\.\)|\x20\.\x20|\.)"
LOOSE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}{_IP_DOT}[0-9]{{1,3}}{_IP_DOT}[0-9]{{1,3}}{_IP_DOT}[0-9]{{1,3}}(?![0-9])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z*./-])(?:[0-9Xx*]{4}[./\x20-]\x20?){3}[0-9]{4}(?![0-9A-Za-z*]|[./-][0-9])",
    "phone": r"(?<![0-9A-Za-z+./-])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
}
# loose matches in a form that hardly anything else has
TYPICAL = {
    "email": r"[\[({](?i:at)[\])}].*[\[({](?i:dot)[\])}]",
    "ip": r"\[\.\]|\(\.\)",
    "card": r"[Xx*]{4}",
    "phone": r"^(?:\(|00)",
    "secret": r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$",
}
# a text that lacks these has no match
MAY = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
MAY_LOOSE = {
    "email": r"[\[({](?i:at|@)[\])}]",
    "ip": r"[0-9](?:\[\.\]|\(\.\)|\x20\.\x20)[0-9]|(?:[0-9A-Fa-f]{1,4}:){7}",
    "card": r"[0-9Xx*]{4}[./\x20-]\x20?[0-9]{4}",
    "phone": r"[0-9][\x20.-][0-9]{4}",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20}",
}
GAZETTEER = {
    "email": r"(?i)(?:\.|[\[({]dot[\])}]\x20?)(?:com|org|net|edu|gov|mil|int|info|biz|io|co|us|uk|de|fr|es|it|nl|eu|ch|at|be|pl|pt|se|no|dk|fi|ie|ca|au|nz|jp|cn|in|br|mx|ru)$",
    "ip": r"^(?!0|127\.|255\.)[0-9A-Fa-f]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[4-9]|6(?:011|4|5|2))",
    "phone": r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk[-_]|pk[-_]|rk_|xox[abprs]-|AIza|ya29|eyJ|glpat-|npm_|SG)",
}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|mailto|contact|write|reach|correo|courriel|kontakt)\b[^\n]{0,24}$",
    "ip": r"(?i)\b(?:ip|ipv4|ipv6|host|server|address|addr|client|from|login|logged)\b[^\n]{0,24}$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)\b[^\n]{0,24}$",
    "phone": r"(?i)\b(?:tel|telephone|phone|mobile|cell|call|fax|telefon|t[eé]l[eé]phone|tel[eé]fono|m[oó]vil)\b[^\n]{0,24}$",
    "secret": r"(?i)(?:\b|_)(?:token|secret|password|passwd|pwd|api[_\x20-]?key|access[_\x20-]?key|private[_\x20-]?key|auth|bearer|credentials?)[\"']?\s{0,3}(?:[:=]|=>)?\s{0,3}[\"']?$",
}
AGAINST = r"(?i)\b(?:isbn|issn|doi|version|release|build|order|invoice|serial|sku|id|token|sha1?|md5|hash|section|chapter|page|figure)\b[^\n]{0,12}$"
AGAINST_SECRET = r"(?i)\b(?:sha-?(?:1|256|512)?|md5|hash|digest|checksum|commit|revision|etag|uuid|guid|isbn|doi|file|image)\b[^\n]{0,12}$|[/#]$"
LABELERS = ("shape", "checksum", "gazetteer", "context", "edges")
BEFORE = 48  # characters of context
SURE = 0.9  # the classifier adds spans of at least this probability
ROUNDS, STEPS, RATE = 40, 400, 0.5
START, IMAGINED = 0.8, 10.0
_STEP = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _before_each(xs: Column) -> Column:
    """For each element the sum of those before it; by copying, so for short arrays."""
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(xs, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"])).alias("all")), lambda a: a["all"])


def _offsets(lengths: Column) -> Column:
    """For each element the sum of those before it; in pieces, so that many elements don't cost their square."""
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / _STEP).cast("int")), lambda k: F.slice(v, k * _STEP + 1, _STEP))
    whole = lambda p, starts: F.flatten(F.transform(F.arrays_zip(p.alias("piece"), starts.alias("start")), lambda x: F.transform(_before_each(x["piece"]), lambda y: y + x["start"])))
    return _let(lengths, lambda v: _let(cut(v), lambda p: _let(_before_each(F.transform(p, add)), lambda starts: whole(p, starts))))


def _parts(text: Column, pattern: str, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the matches of a pattern, as array<struct<gap, hit, last, next>> with the texts between matches and
    the match before each, and of the text after the last match."""

    def zipped(hits: Column, gaps: Column) -> Column:
        n = F.size(hits)
        last = F.slice(F.concat(F.array(F.lit("")), hits), F.lit(1), n)
        z = F.arrays_zip(F.slice(gaps, F.lit(1), n).alias("gap"), hits.alias("hit"), last.alias("last"), F.slice(gaps, F.lit(2), n).alias("next"))
        return _let(z, lambda x: body(x, F.element_at(gaps, -1)))

    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return _let(hits, lambda h: _let(gaps, lambda g: zipped(h, g)))


def _matches(text: Column, pattern: str) -> Column:
    """The matches of a pattern, as _FOUND: places in code points, up to BEFORE characters before and one after.

    Context is cut from what stands between matches, so its cost doesn't grow with the place in the text."""

    def one(x: Column) -> Column:
        m, start = x["m"], x["at"] + F.length(x["m"]["gap"])
        before = F.right(F.concat(F.right(m["last"], F.lit(BEFORE)), F.right(m["gap"], F.lit(BEFORE))), F.lit(BEFORE))
        after = F.left(m["next"], F.lit(1))
        return F.struct(start.alias("start"), (start + F.length(m["hit"])).alias("end"), m["hit"].alias("hit"), before.alias("before"), after.alias("after"))

    sizes = lambda z: F.transform(z, lambda x: F.length(x["gap"]) + F.length(x["hit"]))
    return _parts(text, pattern, lambda z, _: F.transform(F.arrays_zip(z.alias("m"), _offsets(sizes(z)).alias("at")), one))


_FOUND = "array<struct<start: int, end: int, hit: string, before: string, after: string>>"


def _masked(text: Column, kind: str) -> Column:
    """The text with the valid matches of a base pattern blotted out, each character by one."""
    blot = lambda x: F.concat(x["gap"], F.when(_valid(kind, x["hit"]), F.repeat(F.lit("\x01"), F.length(x["hit"]))).otherwise(x["hit"]))
    rest = _parts(text, BASE[kind], lambda z, tail: F.concat(F.array_join(F.transform(z, blot), ""), tail))
    return F.when(text.rlike(MAY[kind]), rest).otherwise(text)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, r"[^0-9]++", "")


def _luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass the Luhn check."""
    each = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
    d = _digits(hit)
    if kind == "card":
        return F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)
    return F.length(d).between(9, 15)


def _masker(kind: str) -> Callable[[Column], Column]:
    return lambda text: _masked(text, kind)


def _plausible(kind: str, x: Column, loose: bool) -> Column:
    """The checksum labeler: what can be checked about the characters themselves."""
    hit = x["hit"]
    if not loose:
        return F.when(_valid(kind, hit), 1).otherwise(-1) if kind in ("ip", "card") else F.when(_valid(kind, hit), 1).otherwise(0)
    if kind == "email":
        return F.when(_digits(hit).rlike("^[0-9]{0,15}$"), 0).otherwise(-1)
    if kind == "ip":
        return F.when(hit.contains(":"), 0).when(_valid("ip", F.regexp_replace(hit, r"[^0-9]++", ".")), 1).otherwise(-1)
    if kind == "card":
        return F.when(_digits(hit).rlike("^[0-9]{13,19}$"), F.when(_valid("card", hit), 1).otherwise(-1)).otherwise(0)
    if kind == "phone":
        return F.when(_digits(hit).rlike("^(?:[2-9]|00)"), 0).otherwise(-1)
    letters = F.size(F.array_distinct(F.split(hit, "")))
    return F.when(letters < 8, -1).otherwise(0)


def _candidate(kind: str, x: Column, loose: bool) -> Column:
    around = F.concat(F.right(x["before"], F.lit(1)), x["after"])
    in_list = _digits(x["hit"]).rlike(GAZETTEER[kind]) if kind == "card" else x["hit"].rlike(GAZETTEER[kind])
    against = AGAINST_SECRET if kind == "secret" else AGAINST
    votes = {
        "shape": F.when(x["hit"].rlike(TYPICAL[kind]), 1).otherwise(0) if loose else F.lit(1),
        "checksum": _plausible(kind, x, loose),
        "gazetteer": F.when(in_list, 1).otherwise(-1 if kind in ("ip", "card") and not loose else 0),
        "context": F.when(x["before"].rlike(against), -1).when(x["before"].rlike(CUES[kind]), 1).otherwise(0),
        "edges": F.when(around.rlike(r"[\p{L}\p{N}=/\\]" if kind == "secret" else r"[\p{L}\p{N}=\"/\\]"), -1).otherwise(0),
    }
    base = F.lit(False) if loose else _valid(kind, x["hit"])
    return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), base.alias("base"), F.lit(loose).alias("loose"), *[v.cast("int").alias(k) for k, v in votes.items()])


def _judge(kind: str, loose: bool):
    return lambda x: _candidate(kind, x, loose)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the candidates of every row of ``docs`` (doc_id, text): kind, start, end (code points, end
    exclusive), base (a valid match of a base pattern), loose, and the labelers' votes; by kind, then start."""
    text, none = F.col("text"), F.array().cast(_FOUND)
    strict = {k: F.when(text.rlike(MAY[k]), _matches(text, p)).otherwise(none) for k, p in BASE.items()}
    some = text.rlike("|".join(f"(?:{p})" for p in MAY_LOOSE.values()))
    masked = text
    for k in BASE_KINDS:
        masked = _let(masked, _masker(k))
    found = docs.select("doc_id", "text").withColumns({f"s_{k}": v for k, v in strict.items()} | {"masked": F.when(some, masked)})
    rest = F.col("masked")
    soft = {k: F.when(rest.rlike(MAY_LOOSE[k]), _matches(rest, p)).otherwise(none) for k, p in LOOSE.items()}
    found = found.withColumns({f"l_{k}": v for k, v in soft.items()})
    parts = []
    for k in KINDS:
        if k in BASE:
            # short runs of digits are numbers, not candidates for a card
            kept = F.filter(f"s_{k}", lambda x: F.length(_digits(x["hit"])).between(12, 20)) if k == "card" else F.col(f"s_{k}")
            parts.append(F.transform(kept, _judge(k, False)))
        parts.append(F.transform(f"l_{k}", _judge(k, True)))
    return found.select("doc_id", F.coalesce(F.concat(*parts), F.array().cast(_SPANS)).alias("spans"))


_SPANS = "array<struct<kind: string, start: int, end: int, base: boolean, loose: boolean, " + ", ".join(f"{k}: int" for k in LABELERS) + ">>"


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]]) -> tuple[dict, dict[str, float]]:
    """Posterior that a candidate is personal data, for each vote pattern (kind, votes, count); and how often
    each labeler is right where it votes.

    Expectation-maximisation of two classes in which labelers vote independently.  A labeler has one
    reliability, the same for all kinds; that it abstains says nothing.  Each kind has a share of personal data of
    its own.  It starts from reliabilities of START and a few imagined votes that agree with that."""
    sure = dict.fromkeys(range(len(LABELERS)), START)
    share = {k: 0.5 for k, _, _ in patterns}
    post: dict = {}
    for _ in range(ROUNDS):
        for k, v, _ in patterns:
            odds = math.log(share[k] / (1 - share[k])) + sum(x * math.log(sure[j] / (1 - sure[j])) for j, x in enumerate(v))
            post[k, v] = 1 / (1 + math.exp(min(700.0, max(-700.0, -odds))))
        right, voted = dict.fromkeys(sure, IMAGINED * START), dict.fromkeys(sure, IMAGINED)
        mass, size = dict.fromkeys(share, 1.0), dict.fromkeys(share, 2.0)
        for k, v, n in patterns:
            mass[k], size[k] = mass[k] + n * post[k, v], size[k] + n
            for j, x in enumerate(v):
                if x:
                    voted[j] += n
                    right[j] += n * (post[k, v] if x > 0 else 1 - post[k, v])
        sure = {j: min(0.99, max(0.01, right[j] / voted[j])) for j in sure}
        share = {k: mass[k] / size[k] for k in share}
    return post, {name: sure[j] for j, name in enumerate(LABELERS)}


def train(patterns: list[tuple[str, tuple[int, ...], int]]) -> dict[str, float]:
    """Weights of a logistic span classifier over kinds and votes, trained on the posteriors."""
    post, _ = reliabilities(patterns)
    names = [*KINDS, *[f"{j}:{x}" for j in LABELERS for x in (-1, 1)]]
    weight = dict.fromkeys(names, 0.0)
    total = sum(math.sqrt(n) for _, _, n in patterns) or 1.0
    rows = [([k, *[f"{j}:{x}" for j, x in zip(LABELERS, v, strict=True) if x]], post[k, v], math.sqrt(n) / total) for k, v, n in patterns]
    for _ in range(STEPS):
        slope = dict.fromkeys(names, 0.0)
        for on, p, share in rows:
            guess = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight[f] for f in on)))))
            for f in on:
                slope[f] += share * (p - guess)
        for f in names:
            weight[f] += RATE * len(names) * (slope[f] - 1e-4 * weight[f])
    return weight


def _score(x: Column, weight: dict[str, float]) -> Column:
    """The classifier's probability of a span."""
    total = F.lit(0.0)
    for k in KINDS:
        total = total + F.when(x["kind"] == k, F.lit(weight[k])).otherwise(F.lit(0.0))
    for j in LABELERS:
        for v in (-1, 1):
            total = total + F.when(x[j] == v, F.lit(weight[f"{j}:{v}"])).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def _backed(x: Column) -> Column:
    """Whether any labeler votes for the span."""
    return F.greatest(*[x[j] for j in LABELERS]) > 0


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of ``docs``: kind, start, end, base and probability of each span, by kind
    as in KINDS, then start.  The classifier's spans never touch a base span."""
    found = staged(candidates(docs), "candidates")
    votes = found.select(F.explode("spans").alias("s")).select("s.*")
    counted = votes.groupBy("kind", *LABELERS).count().orderBy("kind", *LABELERS).collect()  # at most 5 * 3**5 rows
    patterns = [(r["kind"], tuple(r[j] for j in LABELERS), r["count"]) for r in counted]
    weight = train(patterns)
    place = lambda x: F.coalesce(*[F.when(x["kind"] == k, F.lit(i)) for i, k in enumerate(KINDS)], F.lit(len(KINDS)))
    scored = F.transform("spans", lambda x: F.struct(place(x).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"), F.when(x["base"], F.lit(1.0)).when(x["loose"] & _backed(x), _score(x, weight)).otherwise(0.0).alias("p")))
    return found.select("doc_id", F.array_sort(F.filter(scored, lambda x: x["base"] | (x["p"] >= SURE))).alias("spans"))
