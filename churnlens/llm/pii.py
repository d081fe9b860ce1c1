"""Personal data by weak supervision (operator 2), with DataFrame functions only.

Candidates are the spans of the four base kinds and of wider patterns (loose
phones, card-like numbers that miss the check digit, spelled-out addresses,
account and identity numbers, names). Labelers vote on each: the strict format
(regex), lists of known values (gazetteer), cue words beside the span (context)
and the characters around it (boundary). Votes are +1, -1 or 0 for no vote.

Expectation-maximisation estimates how reliable each labeler is from the
counts of vote patterns per kind, and the posterior of each pattern; a logistic
span classifier is then fitted to these posteriors on votes, kind and shape.
Both work on tables whose rows are combinations of votes, kinds and shapes: at
most 10 kinds * 3^4 votes * 4 lengths = 3,240 rows, whatever the corpus. The
counts cover all documents. Base spans stay; a wider span is added where the
classifier gives 0.5 or more.

Rows: null and empty text have no spans; repeated rows are documents each; an
empty table gives no rows; a null doc_id is kept; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm import common
from churnlens.llm.spans import Kind, add_spans, joined, labelled

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the check of card numbers."""
    digits = F.reverse(_digits(value))

    def part(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * (F.lit(1) + (i + 1) % 2)
        return F.when(d > 9, d - 9).otherwise(d)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + part(i))
    return total % 10 == 0


def _n_digits(value: Column, low: int, high: int) -> Column:
    return F.length(_digits(value)).between(low, high)


EMAIL = Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
          keep=lambda m, g: m.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"))
# only whole chains of digits and separators of 14 to 19 digits; the chain starts where no digit stands before
CHAIN = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
CARD = Kind("card", CHAIN, keep=lambda m, g: luhn(m))
PHONE = Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", keep=lambda m, g: _n_digits(m, 10, 15))
BASE = [EMAIL, IP, CARD, PHONE]

# Given names of the gazetteer, common in several languages
GIVEN_NAMES = ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel",
               "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen",
               "Anna", "Maria", "Laura", "Julia", "Peter", "Paul", "Hans", "Klaus", "Jean", "Pierre", "Marie",
               "Sophie", "Carlos", "Juan", "Jose", "Luis", "Carmen", "Ana"]
NAME_CUE = r"(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?"
_FOUR = r"(?:\x20?[A-Z0-9]{4})"
# Account numbers of the gazetteer's countries by length; others in groups of four with a shorter last one,
# which holds a digit where a space parts it, so that the next word of a text is not taken for it
ACCOUNT = (rf"(?<![A-Za-z0-9])(?:(?:(?:AT|LU)[0-9]{{2}}{_FOUR}{{4}}|BE[0-9]{{2}}{_FOUR}{{3}}|(?:ES|SE)[0-9]{{2}}{_FOUR}{{5}}"
           rf"|PL[0-9]{{2}}{_FOUR}{{6}}|CH[0-9]{{2}}{_FOUR}{{4}}\x20?[A-Z0-9]|PT[0-9]{{2}}{_FOUR}{{5}}\x20?[A-Z0-9]|(?:DE|GB|IE)[0-9]{{2}}{_FOUR}{{4}}\x20?[A-Z0-9]{{2}}"
           rf"|NL[0-9]{{2}}{_FOUR}{{3}}\x20?[A-Z0-9]{{2}}|(?:FR|IT)[0-9]{{2}}{_FOUR}{{5}}\x20?[A-Z0-9]{{3}})(?![A-Za-z0-9])"
           rf"|[A-Z]{{2}}[0-9]{{2}}(?:{_FOUR}{{2}}\x20?[0-9]{{3}}(?![A-Za-z0-9])"
           rf"|{_FOUR}{{3,7}}+(?:[A-Z0-9]{{1,3}}|\x20(?=[A-Z]{{0,2}}[0-9])[A-Z0-9]{{1,3}})?(?![A-Za-z0-9])))")
WIDER = [
    Kind("email_like", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[a-z0-9-]{1,63}+"
                       r"(?:\x20?[\[(]dot[\])]\x20?[a-z0-9-]{1,63}+){1,8}+"),
    Kind("card_like", CHAIN, keep=lambda m, g: ~luhn(m)),
    Kind("phone_like", r"(?<![A-Za-z0-9+.()-])(?<![0-9]\x20)\(?[0-9]{3,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"),
    Kind("id_like", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    Kind("account_like", ACCOUNT),
    Kind("name", rf"\b(?:{NAME_CUE}\x20)?(?:{'|'.join(GIVEN_NAMES)})\x20[A-Z][a-z]{{1,30}}+\b"),
]
KINDS = [*BASE, *WIDER]
CUES = (r"(?i)\b(?:call|phone|tel|telephone|mobile|fax|cell|contact|e-?mail|mail|write to|reach|card|visa|mastercard"
        r"|amex|account|iban|ssn|social security|passport|born|birth|name|address|from host|ip)\b[^.\n]{0,24}$")
DENIALS = r"(?i)\b(?:version|order|invoice|isbn|build|release|part|item|ticket|ref|page|chapter|section|v)\b[^.\n]{0,12}$"
LABELERS = ("regex", "gazetteer", "context", "boundary")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: Column, value: Column, left: Column, right: Column) -> dict[str, Column]:
    """What each labeler says of a candidate."""
    base = kind.isin(*[k.name for k in BASE])
    digits = _digits(value)
    private = value.rlike(r"^(?:0|10|127|255)\.|^192\.168\.|^169\.254\.")
    gazetteer = (
        F.when(kind.isin("email", "email_like"), _vote(value.rlike(r"(?i)(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|de|fr|es|uk|io)$"),
                                                       F.lit(False)))
        .when(kind == "ip", _vote(F.lit(False), private))
        .when(kind.isin("card", "card_like"), _vote(digits.rlike(r"^(?:4|5[1-5]|3[47]|6011|65)"), ~digits.rlike(r"^[3456]")))
        .when(kind == "phone", _vote(digits.rlike(r"^(?:1|7|2[07]|3[0-49]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), F.lit(False)))
        .when(kind == "account_like", _vote(value.rlike(r"^(?:AT|BE|CH|DE|ES|FR|GB|IE|IT|LU|NL|PL|PT|SE)"), F.lit(True)))
        .when(kind == "name", F.lit(1)).otherwise(0))
    touching = F.concat(F.substring(left, -1, 1), F.lit("|"), F.substring(right, 1, 1))
    return {
        "regex": F.when(base, 1).when(kind.isin("card_like"), -1)
        .when(kind == "id_like", _vote(F.lit(False), value.rlike(r"^(?:000|666|9)|-00-|-0000$")))
        .when(kind == "name", _vote(value.rlike(rf"^{NAME_CUE}"), F.lit(False))).otherwise(0),
        "gazetteer": gazetteer,
        "context": _vote(left.rlike(CUES), left.rlike(DENIALS)),
        "boundary": _vote(touching.rlike(r"^[\s(\[<\"':;,]?\|[\s)\]>\"'.,;!?]?$"), touching.rlike(r"[A-Za-z0-9_/#=]")),
    }


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with their span arrays, candidate rows with votes and shape); neither holds the text."""
    df = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    spans = common.stored(add_spans(df, "text", KINDS).drop("text"), "pii-spans")

    def of(name: str) -> Column:
        return F.transform(F.col(f"_spans_{name}"), lambda s: F.struct(F.lit(name).alias("kind"), *[
            s[c].alias(c) for c in ("start", "end", "value", "left", "right")]))
    each = spans.select("_row", F.explode(F.concat(*[of(k.name) for k in KINDS])).alias("c")).select("_row", "c.*")
    said = votes(*[F.col(c) for c in ("kind", "value", "left", "right")])
    size = F.least(F.floor(F.length("value") / 10), F.lit(3)).cast("int")
    return spans, each.select("_row", "kind", "start", "end", size.alias("size"), *[v.alias(k) for k, v in said.items()])


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 40) -> tuple[dict, list, dict]:
    """EM over (kind, votes, count): priors by kind, P(vote | class) by labeler, posterior by pattern."""
    n = len(LABELERS)
    prior = {kind: 0.5 for kind, _, _ in patterns}
    says = [{1: {1: .7, 0: .2, -1: .1}, 0: {1: .1, 0: .2, -1: .7}} for _ in range(n)]
    posterior: dict = {}
    for _ in range(rounds):
        for kind, vote, _ in patterns:
            yes, no = prior[kind], 1 - prior[kind]
            for j, v in enumerate(vote):
                yes, no = yes * says[j][1][v], no * says[j][0][v]
            posterior[kind, vote] = yes / (yes + no)
        total, weight = dict.fromkeys(prior, 0.0), dict.fromkeys(prior, 0.0)
        # the starting table counts as ten observations, so that no labeler's estimate can flip or reach 0
        seen = [{1: {1: 7.0, 0: 2.0, -1: 1.0}, 0: {1: 1.0, 0: 2.0, -1: 7.0}} for _ in range(n)]
        for kind, vote, count in patterns:
            p = posterior[kind, vote]
            total[kind] += count
            weight[kind] += count * p
            for j, v in enumerate(vote):
                seen[j][1][v] += count * p
                seen[j][0][v] += count * (1 - p)
        prior = {k: (weight[k] + 1) / (total[k] + 2) for k in prior}
        says = [{y: {v: c / sum(row.values()) for v, c in row.items()} for y, row in table.items()} for table in seen]
    return prior, says, posterior


def _features(kind: str, vote: tuple[int, ...], size: int) -> list[str]:
    return ["bias", f"kind={kind}", f"size={size}", *[f"{name}={v}" for name, v in zip(LABELERS, vote, strict=True)]]


def train(rows: list[tuple[str, tuple[int, ...], int, int]], posterior: dict, rounds: int = 300) -> dict[str, float]:
    """Logistic regression on the posteriors; each row counts by the root of its count."""
    data = [(_features(k, v, s), math.sqrt(c), posterior[k, v]) for k, v, s, c in rows]
    weights: dict[str, float] = dict.fromkeys((f for fs, _, _ in data for f in fs), 0.0)
    total = sum(c for _, c, _ in data) or 1.0
    for _ in range(rounds):
        slope = dict.fromkeys(weights, 0.0)
        for fs, c, y in data:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[f] for f in fs)))))
            for f in fs:
                slope[f] += c * (y - p)
        weights = {f: w + 2.0 * (slope[f] / total - 1e-4 * w) for f, w in weights.items()}
    return weights


def fit(found: DataFrame) -> tuple[dict[str, float], dict]:
    """Classifier weights and labeler reliabilities from the candidates' grouped votes."""
    keys = ["kind", *LABELERS, "size"]
    # at most 3,240 rows: one per combination of kind, votes and size
    grouped = [(r["kind"], tuple(r[x] for x in LABELERS), r["size"], r["n"])
               for r in found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(*keys).collect()]
    if not grouped:
        return {}, {}
    counts: dict = {}
    for kind, vote, _, n in grouped:
        counts[kind, vote] = counts.get((kind, vote), 0) + n
    prior, says, posterior = reliabilities([(k, v, n) for (k, v), n in counts.items()])
    return train(grouped, posterior), {"prior": prior, "says": dict(zip(LABELERS, says, strict=True))}


def score(weights: dict[str, float]) -> Column:
    """The classifier as one expression over kind, votes and size."""
    total = F.lit(weights.get("bias", 0.0))
    for name in ("kind", "size", *LABELERS):
        own = {f.split("=", 1)[1]: w for f, w in weights.items() if f.startswith(f"{name}=")}
        for value, w in sorted(own.items()):
            total = total + F.when(F.col(name).cast("string") == value, w).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def find_personal_data(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per document: its span arrays and ``added``, the wider spans that the classifier takes."""
    spans, found = candidates(docs)
    weights, _ = fit(found)
    wider = found.where(F.col("kind").isin(*[k.name for k in WIDER])).withColumn("p", score(weights)).where(F.col("p") >= least)
    no = F.create_map(*[x for n, k in enumerate(KINDS) for x in (F.lit(k.name), F.lit(n))])
    added = wider.groupBy("_row").agg(F.collect_list(F.struct(
        "start", no[F.col("kind")].alias("no"), "end", "kind")).alias("added"))
    return spans.join(added, "_row", "left")


def op2_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(common.table(spark, sf_dir, "documents"))
    base = labelled([k.name for k in BASE])
    added = F.coalesce("added", F.array().cast("array<struct<start:int,no:int,end:int,kind:string>>"))
    counts = [F.size(f"_spans_{k.name}").cast("bigint").alias(f"n_{k.name}") for k in BASE]
    return found.withColumns({"_base": base, "_all": F.sort_array(F.concat(base, added))}).select(
        "doc_id", *counts, F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_all")).alias("spans"),
        F.size(added).cast("bigint").alias("n_added"))
