"""Personal data, by gradient boosting over candidate spans; DataFrame functions only.

Base patterns with exact checks give the sure spans. Wider generators propose
overlapping candidates: addresses with a spelled-out @ or dot, numbers in any
grouping, with or without a country code. Candidates are described by small
features of their format and of the characters round them. Weak labels come from
evidence that neither the base patterns nor the features see: a cue word before
a number, a check digit behind separators that the base patterns don't take, a
known ending of a spelled-out host. How often each combination of features
occurs, and with which label, is counted over all documents; boosted trees are
fitted to these counts, whose number is bounded by the features' ranges, and
become one CASE expression. So a format that mostly stands behind cue words is
recognised where the cue is missing, and a cue before an odd format isn't enough.

The thresholds are calibrated on a fifth of the candidates that the trees don't
see, and only on those that touch no sure span, since these are what the model
decides on. True spans lack the evidence now and then; how often, the sure spans
tell, and the share of labels is divided by that (as for labels that are only
ever positive).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Possessive runs and \G only keep the engine from trying starts that can't match; the matches are those of the plain patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
AT, DOT = r" ?(?:@|\(at\)|\[at\]|\{at\}) ?", r" ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?"
WIDE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++" + AT + r"[A-Za-z0-9-]++(?:" + DOT + r"[A-Za-z0-9-]++)*+"
WIDE_NUMBER = r"(?:\+|\()?[0-9](?:[ ().-]{0,3}[0-9]){6,}+"
CUES = r"(?i)(tel|phone|call|fax|mobil|tél|fono|ruf|card|visa|karte|carte|tarjeta|iban|account|konto|cuenta)[^a-z0-9]{0,12}$"
#: Last labels of hosts that count as evidence for an address.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "uk", "us", "eu", "de", "fr", "es", "it", "nl", "ch", "at", "be", "ca", "au", "jp", "br", "mx")
FEATURES = ("model", "size", "groups", "marks", "lead", "first", "last", "before", "after")
ROUNDS, RATE, PRECISION, MIN_SUPPORT, LEAST_EVIDENCE = 30, 0.3, 0.9, 20, 0.5
#: Matches of one text whose places are summed at once; see running().
STEP = 256
SPAN = "array<struct<t:string,s:int,e:int,l:string,r:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """What op makes of all values before each one (0 before the first), for an array of int; op is associative.

    Appending to an array copies it, so this is done in steps and then for the
    steps: a text of n matches costs n * STEP + (n / STEP)**2.
    """

    def before(xs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def stepped(xs: Column) -> Column:
        steps = F.sequence(F.lit(0), F.floor((F.greatest(F.size(xs), F.lit(1)) - 1) / STEP).cast("int"))
        return F.transform(steps, lambda k: before(F.slice(xs, k * STEP + 1, STEP)))

    def joined(parts: Column) -> Column:
        heads = F.arrays_zip(parts.alias("p"), before(F.transform(parts, lambda p: p["at"]))["out"].alias("h"))
        return F.flatten(F.transform(heads, lambda x: F.transform(x["p"]["out"], lambda v: op(x["h"], v))))

    return _let(values, lambda xs: _let(stepped(xs), joined))


def located(text: Column, pattern: str) -> Column:
    """array<struct<t, s, e, l, r>>: matches of pattern, with start and end in code points and 24 characters on either side."""
    hits, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zipped = F.arrays_zip(hits.alias("t"), pieces.alias("l"), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("r"))

    def placed(kept: Column) -> Column:
        starts = running(F.transform(kept, lambda x: F.length(x["l"]) + F.length(x["t"])), lambda a, b: a + b)

        def one(x: Column) -> Column:
            s = x["at"] + F.length(x["x"]["l"])
            return F.struct(x["x"]["t"].alias("t"), s.alias("s"), (s + F.length(x["x"]["t"])).alias("e"), F.right(x["x"]["l"], F.lit(24)).alias("l"), F.left(x["x"]["r"], F.lit(24)).alias("r"))

        return F.transform(F.arrays_zip(kept.alias("x"), starts.alias("at")), one)

    return _let(F.filter(zipped, lambda x: x["t"].isNotNull()), lambda kept: F.when(F.size(kept) > 0, placed(kept)).otherwise(F.array().cast(SPAN)))


def _guarded(text: Column, probe: Column, pattern: str) -> Column:
    return F.when(probe, located(text, pattern)).otherwise(F.array().cast(SPAN))


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _luhn(t: Column) -> Column:
    one = F.regexp_extract_all(F.reverse(_digits(t)), F.lit("[0-9]"), F.lit(0))
    values = F.transform(one, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(t: Column) -> Column:
    short = F.transform(F.split(t, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(short, lambda p: (F.length(p) <= 2) | ((F.length(p) == 3) & (p <= "255")))


def base_spans(text: Column) -> Column:
    """array<struct<k, s, e>> by kind as in KINDS, then by start; k is the kind's number."""
    number = text.rlike("[0-9]")
    parts = (
        _guarded(text, F.contains(text, F.lit("@")), EMAIL),
        F.filter(_guarded(text, number & text.rlike(r"[0-9]\.[0-9]"), IP), lambda x: _octets(x["t"])),
        F.filter(_guarded(text, number & text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), CARD), lambda x: F.length(_digits(x["t"])).between(13, 19) & _luhn(x["t"])),
        F.filter(_guarded(text, number & text.rlike(r"\+[0-9]"), PHONE), lambda x: F.length(_digits(x["t"])).between(9, 15)),
    )
    return F.concat(*(_of_kind(p, k) for k, p in enumerate(parts)))


def _of_kind(found: Column, k: int) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def _count(spans: str, k: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")


def _bin(x: Column, cuts: tuple) -> Column:
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(x >= c, 1).otherwise(0)
    return out


def _side(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[A-Za-z0-9_]"), 2).otherwise(3)


def _sides(x: Column) -> list[Column]:
    return [_side(F.right(x["l"], F.lit(1))).alias("before"), _side(F.left(x["r"], F.lit(1))).alias("after"), x["t"].alias("t"), x["s"].alias("s"), x["e"].alias("e")]


def _mail(x: Column) -> Column:
    """Features of an address (ranges 3 x 4 x 3 x 4 x 1 x 5), and whether its host has a known ending."""

    def of(labels: Column, local: Column) -> Column:
        last = F.lower(F.element_at(labels, -1))
        style = F.when(x["t"].rlike(r"[({\[]at"), 2).when(x["t"].contains(" "), 1).otherwise(0)
        dots = F.when(x["t"].rlike(r"[({\[]dot"), 2).when(x["t"].rlike(r" \.|\. "), 1).otherwise(0)
        return F.struct(
            F.lit(0).alias("model"), _bin(F.length(local), (2, 4, 8)).alias("size"), _bin(F.size(labels), (2, 3, 4)).alias("groups"), style.alias("marks"), dots.alias("lead"), F.lit(0).alias("first"),
            _bin(F.length(last), (2, 3, 4, 7)).alias("last"), last.isin(*ENDINGS).alias("told"), *_sides(x),
        )

    return _let(F.split(x["t"], AT, 2), lambda parts: of(F.split(F.element_at(parts, -1), DOT, -1), parts[0]))


def _number(x: Column) -> Column:
    """Features of a number (ranges 9 x 6 x 6 x 4 x 5 x 5), and whether a cue stands before it or a check digit fits that the base patterns don't see."""
    t = x["t"]
    marks = F.when(t.contains("("), 4).when(t.contains(".") & t.rlike("[ -]"), 5).when(t.contains("."), 3).when(t.contains("-"), 2).when(t.contains(" "), 1).otherwise(0)
    lead = F.when(F.left(t, F.lit(1)) == "+", 0).when(F.left(t, F.lit(1)) == "(", 1).when(F.left(t, F.lit(1)) == "0", 2).otherwise(3)

    def of(groups: Column) -> Column:
        digits = F.length(_digits(t))
        told = x["l"].rlike(CUES) | (digits.between(13, 19) & t.rlike("[.()]|  ") & _luhn(t))
        return F.struct(
            F.lit(1).alias("model"), _bin(digits, (8, 9, 10, 11, 12, 13, 16, 17)).alias("size"), _bin(F.size(groups), (2, 3, 4, 5, 6)).alias("groups"), marks.alias("marks"), lead.alias("lead"),
            _bin(F.length(groups[0]), (2, 3, 4, 5)).alias("first"), _bin(F.length(F.element_at(groups, -1)), (2, 3, 4, 5)).alias("last"), told.alias("told"), *_sides(x),
        )

    return _let(F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0)), of)


def candidates(text: Column) -> Column:
    """Wide spans with their features."""
    mails = _guarded(text, text.rlike(r"@|[(\[{]at[)\]}]"), WIDE_EMAIL)
    numbers = _guarded(text, text.rlike(r"[0-9](?:[ ().-]{0,3}[0-9]){6}"), WIDE_NUMBER)
    return F.concat(F.transform(mails, _mail), F.transform(numbers, _number))


def touching(found: Column, sure: Column) -> Column:
    """array<struct<x, hit>>: candidates, and whether each overlaps a sure span; by one sort, however many there are."""
    far = 1 << 30

    def rows_of(found: Column) -> Column:
        none = F.get(F.slice(found, 1, 0), F.lit(0))
        return F.concat(
            F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(False).alias("sure"), x.alias("x"))),
            F.transform(sure, lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), F.lit(True).alias("sure"), none.alias("x"))),
        )

    def judged(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda r: F.when(r["sure"], r["e"]).otherwise(0)), F.greatest)
        starts = F.reverse(running(F.transform(F.reverse(rows), lambda r: F.when(r["sure"], far - r["s"]).otherwise(0)), F.greatest))
        zipped = F.filter(F.arrays_zip(rows.alias("r"), ends.alias("end"), starts.alias("start")), lambda z: ~z["r"]["sure"])
        return F.transform(zipped, lambda z: F.struct(z["r"]["x"].alias("x"), ((z["end"] > z["r"]["s"]) | (far - z["start"] < z["r"]["e"])).alias("hit")))

    nothing = lambda xs: F.transform(xs, lambda x: F.struct(x.alias("x"), F.lit(False).alias("hit")))
    return _let(found, lambda xs: F.when((F.size(xs) > 0) & (F.size(sure) > 0), _let(F.array_sort(rows_of(xs)), judged)).otherwise(nothing(xs)))


@dataclass
class Model:
    """Trees as (feature, cut, feature below, cut below, feature above, cut above, four values), and each generator's threshold."""

    base: float
    trees: list[tuple]
    thresholds: tuple[float, float]

    def score(self, x: Column) -> Column:
        total = F.lit(self.base)
        for f, c, fl, cl, fr, cr, v in self.trees:
            low = F.when(x[fl] < cl, v[0]).otherwise(v[1])
            high = F.when(x[fr] < cr, v[2]).otherwise(v[3])
            total = total + F.when(x[f] < c, low).otherwise(high)
        return total

    def added(self, found: Column, sure: Column) -> Column:
        """Candidates over their threshold that touch no sure span, as array<struct<k, s, e>>."""
        if min(self.thresholds) == math.inf:
            return F.array().cast("array<struct<k:int,s:int,e:int>>")
        free = F.filter(touching(found, sure), lambda x: ~x["hit"])
        over = F.filter(F.transform(free, lambda x: x["x"]), lambda x: self.score(x) >= F.when(x["model"] == 0, F.lit(self.thresholds[0])).otherwise(F.lit(self.thresholds[1])))
        kind = lambda x: F.when(x["model"] == 0, 0).when(x["t"].rlike(r"^[0-9]+(\.[0-9]+){3}$"), 1).when(F.length(_digits(x["t"])) >= 13, 2).otherwise(3)
        return F.transform(over, lambda x: F.struct(kind(x).alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def boost(rows: list[tuple[dict, int, int]], rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list[tuple]]:
    """Depth-two trees for the log odds of (features, positives, negatives), by Newton steps on weighted rows."""
    x = np.array([[r[0][f] for f in FEATURES] for r in rows], np.int64).reshape(len(rows), len(FEATURES))
    pos, n = np.array([r[1] for r in rows], float), np.array([r[1] + r[2] for r in rows], float)
    base = math.log((pos.sum() + 1) / (n.sum() - pos.sum() + 1))
    score, trees = np.full(len(rows), base), []
    cuts = [(f, int(c)) for f in range(len(FEATURES)) for c in np.unique(x[:, f])[1:]]

    def best(own: np.ndarray, g: np.ndarray, h: np.ndarray):
        found, whole = None, (g[own].sum(), h[own].sum())
        for f, c in cuts:
            low = own & (x[:, f] < c)
            k = np.count_nonzero(low)
            if 0 < k < np.count_nonzero(own):
                a, b = g[low].sum(), h[low].sum()
                gain = a**2 / (b + 1) + (whole[0] - a) ** 2 / (whole[1] - b + 1)
                if found is None or gain > found[0] + 1e-9 * abs(found[0]):
                    found = (gain, f, c, low, own & ~low)
        return found[1:] if found else (0, 1 << 20, own, own & False)

    for _ in range(rounds if cuts else 0):
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        g, h = pos - n * p, n * p * (1 - p)
        f, c, low, high = best(np.ones(len(rows), bool), g, h)
        fl, cl, a, b = best(low, g, h)
        fr, cr, d, e = best(high, g, h)
        values = []
        for leaf in (a, b, d, e):
            values.append(rate * max(-4.0, min(4.0, float(g[leaf].sum() / (h[leaf].sum() + 1)))))
            score[leaf] += values[-1]
        trees.append((FEATURES[f], c, FEATURES[fl], cl, FEATURES[fr], cr, tuple(values)))
    return base, trees


def evaluate(base: float, trees: list[tuple], x: dict) -> float:
    for f, c, fl, cl, fr, cr, v in trees:
        base += (v[0] if x[fl] < cl else v[1]) if x[f] < c else (v[2] if x[fr] < cr else v[3])
    return base


def fit(docs: DataFrame, precision: float = PRECISION) -> Model:
    """Trees and thresholds from every candidate of docs (text); the driver gets a row for each combination of features that occurs.

    Candidates that are sure count as positive for the trees. A threshold is as
    low as each run of MIN_SUPPORT free candidates of the held-back fifth, from
    the highest score down, is right with the given precision, by their labels
    and the share of sure spans that have the evidence (LEAST_EVIDENCE at
    least). Where the first run fails, or is shorter, nothing is added.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(base_spans(text).alias("sure"), candidates(text).alias("found")).filter(F.size("found") > 0)
    found = found.select(F.explode(touching(F.col("found"), F.col("sure"))).alias("f")).select("f.x.*", "f.hit")
    found = found.withColumn("fold", F.pmod(F.xxhash64("t"), F.lit(5)) == 0)
    counts = found.groupBy(*FEATURES, "fold", "hit").agg(F.sum(F.col("told").cast("long")).alias("told"), F.count("*").alias("n")).orderBy(*FEATURES, "fold", "hit").collect()
    rows = [({f: r[f] for f in FEATURES}, r.told, r.n, r.fold, r.hit) for r in counts]
    base, trees = boost([(x, n if hit else told, 0 if hit else n - told) for x, told, n, fold, hit in rows if not fold])
    thresholds = []
    for model in (0, 1):
        own = [r for r in rows if r[0]["model"] == model]
        sure = [sum(r[k] for r in own if r[4]) for k in (1, 2)]
        evidence = max(LEAST_EVIDENCE, sure[0] / sure[1]) if sure[1] else 1.0
        judged = sorted(((evaluate(base, trees, x), told, n) for x, told, n, fold, hit in own if fold and not hit), key=lambda r: -r[0])
        cut, told, every = math.inf, 0, 0
        for k, (s, p, n) in enumerate(judged):
            told, every = told + p, every + n
            if (k + 1 == len(judged) or judged[k + 1][0] < s) and every >= MIN_SUPPORT:
                if told < precision * evidence * every:
                    break
                cut, told, every = s - 1e-9, 0, 0
        thresholds.append(cut)
    return Model(base, trees, tuple(thresholds))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs (any columns, with text) and: ``sure`` and ``spans``, array<struct<k, s, e>> of the base spans and of all.

    k is the place in KINDS, s and e are code points, e exclusive. A null or
    empty text has no spans. Rows are judged one by one, so repeated rows get
    the same; an empty table is returned empty. Columns named sure or spans are
    replaced.
    """
    model = model or fit(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("sure", base_spans(text))
    return out.withColumn("spans", F.array_sort(F.concat(F.col("sure"), model.added(candidates(text), F.col("sure")))))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, overlapping ones by the first's; n_chars follows the text.

    A null text stays null, an empty table empty, and repeated rows are redacted
    alike. All other columns stay as they are, whatever their names.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    model = model or fit(docs)
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    found = docs.select(row, text.alias("text"), base_spans(text).alias("sure"), candidates(text).alias("found"))
    spans = F.array_sort(F.transform(F.concat(F.col("sure"), model.added(F.col("found"), F.col("sure"))), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    found = found.select("row", "text", spans.alias("spans"))

    def piece(x: Column) -> Column:
        """The text since the last span, and the mark of this one unless the last one reaches into it."""
        mark = F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), x["x"]["k"] + 1)), F.lit("]"))
        return F.when(x["x"]["s"] >= x["at"], F.concat(F.substr(F.col("text"), x["at"] + 1, x["x"]["s"] - x["at"]), mark)).otherwise("")

    at = running(F.transform("spans", lambda x: x["e"]), F.greatest)
    rest = F.substr(F.col("text"), F.array_max(F.transform("spans", lambda x: x["e"])) + 1, F.lit((1 << 31) - 1))
    whole = F.concat(F.array_join(F.transform(F.arrays_zip(F.col("spans").alias("x"), at.alias("at")), piece), ""), rest)
    found = found.select("row", F.when(F.size("spans") > 0, whole).alias("new"))
    new = {"text": F.coalesce("new", "row.text"), "n_chars": F.when(F.col("new").isNotNull(), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def digest(docs: DataFrame, model: Model | None = None) -> DataFrame:
    found = find_pii(docs.select("doc_id", "text"), model)
    counts = [_count("sure", k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("sure")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
