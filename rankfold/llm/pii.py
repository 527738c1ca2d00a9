"""Personal data by candidate gradient boosting, with DataFrame operations only.

Base rules find well-formed e-mail addresses, IP addresses, card and phone numbers. High-recall generators propose
further, overlapping spans (spelled-out addresses, dotted groups, any number-like run). Boosted trees (Spark ML) decide on them over
format and context features. Their labels don't come from the base rules: spans of known kind are planted in the texts
of a bounded sample in forms that the base rules miss (spelled-out signs, other separators, no plus, masked or without
a cue before them), and look-alikes (dates, times, serial numbers, scores, prices, digit groups with a wrong check
digit, English sentences with "at" and "dot") as negatives. Every third planting is held back; the threshold is the lowest whose precision on those meets a
target, and the recall there is part of the model. The trees become one column expression, so candidates are scored
inside their document's row: nothing is exploded or shuffled.

The four kinds are those of the base rules; other secrets (keys, tokens, passwords) are out of scope.

Positions are code points, end exclusive. They come from cutting the text at the matches and adding up lengths, in
blocks, as an array that grows by one is copied each time; overlaps are looked up by block as well. So a text of
nothing but numbers costs little more than another of its length.

Edge cases: a null text is an empty one; texts without candidates have empty results; in a table of a few rows only
there are no trees and base spans alone count; repeated rows are treated alike; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
#: The base rules, with possessive repeats and look-behinds that change no match but keep long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators: addresses with a spelled-out sign, short groups between disguised dots, and number-like runs.
WIDE = {
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?(?:@|[(\[{<](?:(?i:at)|@)[)\]}>]) ?| (?i:at) (?=[A-Za-z0-9-]++ (?i:dot) ))[A-Za-z0-9-]++(?:(?: ?\. ?(?=[A-Za-z0-9-])| ?[(\[{<](?:(?i:dot)|\.)[)\]}>] ?| (?i:dot) )[A-Za-z0-9-]++)++",
    "dotted": r"(?<![0-9A-Za-z])[0-9]{1,3}+(?:(?: ?[(\[{<](?:\.|(?i:dot))[)\]}>] ?| \. ?| (?i:dot) )[0-9]{1,3}+){3,}+(?![0-9A-Za-z])",
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9](?:(?:\[\.\]|\(\.\)|[().\x20/_\u2013-]{0,5}+)[0-9]){6,21}+(?![0-9A-Za-z])",
}
#: Documents of the training sample, plantings in each, size of the model, and the precision asked for.
SAMPLE, PLANTINGS, TREES, DEPTH, PRECISION = 2_500, 4, 12, 4, 0.98
AROUND = 24
#: Matches handled at a time where an array grows, and spans in a block of the overlap search.
BLOCK = 128
#: Common top-level domains that aren't words of English.
TOPS = ("com", "org", "net", "edu", "gov", "mil", "info", "biz", "io", "ai", "dev", "app", "co", "eu", "de", "fr", "uk", "es", "nl", "pl", "ch", "ru", "jp", "cn", "br", "au", "ca", "se", "dk", "fi", "cz", "pt", "gr", "tr", "kr", "mx", "nz", "za", "ie", "hu", "ro")
SPAN = "array<struct<s:int,e:int,v:string>>"
FEATURES = ("n_digits", "n_chars", "n_separators", "n_groups", "longest", "shortest", "has_at", "letters", "luhn", "octets", "plus", "dots", "dashes", "spaces", "slashes", "brackets", "varied", "zero", "cue", "code_cue", "glued_left", "glued_right", "date", "spelled", "top_known", "top_chars")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def located(found: Column, pieces: Column) -> Column:
    """(start, end, string) of every match, from the pieces between them; both are columns of their own, so that lambdas don't compute them again."""
    n = F.size(found)
    none = F.array().cast(SPAN)

    def one(acc, i):
        s = acc["at"] + F.char_length(F.get(pieces, i))
        v = F.get(found, i)
        e = s + F.char_length(v)
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), v.alias("v")))).alias("out"))

    def block(acc, first):
        places = F.sequence(first, F.least(first + BLOCK, n) - 1)
        return F.aggregate(places, F.struct(acc["at"].alias("at"), none.alias("out")), one, lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], a["out"]).alias("out")))

    every = F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), none.alias("out")), block, lambda acc: acc["out"])
    return F.when(n > 0, every).otherwise(none)


def _cut(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Adds, by kind, the matches m_ and the pieces p_ around them."""
    return df.withColumns({f"m_{k}": matches(F.col("t"), p) for k, p in patterns.items()} | {f"p_{k}": F.split("t", p, -1) for k, p in patterns.items()})


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn_sum(d: Column) -> Column:
    """The weighted sum of a string of digits; a right check digit makes it a multiple of ten."""

    def value(c, i):
        x = c.cast("int") * (1 + i % 2)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.transform(F.split(F.reverse(d), ""), value), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def luhn(d: Column) -> Column:
    return luhn_sum(d) % 10 == 0


def octets(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255))


VALID = {
    "email": lambda v: F.lit(True),
    "ip": octets,
    "card": lambda v: F.length(digits(v)).between(16, 19) & luhn(digits(v)),
    "phone": lambda v: F.length(digits(v)).between(8, 15),
}


def _valid(kind: str):
    return lambda x: VALID[kind](x["v"])


def with_base(df: DataFrame) -> DataFrame:
    """df: has t. Adds the valid base spans of every kind."""
    df = _cut(df, BASE).withColumns({k: F.filter(located(F.col(f"m_{k}"), F.col(f"p_{k}")), _valid(k)) for k in KINDS})
    return df.drop(*[f"{c}_{k}" for c in "mp" for k in KINDS])


def with_candidates(df: DataFrame) -> DataFrame:
    """df: has t. Adds the generators' spans with their features."""

    def spans(kind: str) -> Column:
        found, pieces = F.col(f"m_{kind}"), F.col(f"p_{kind}")

        def around(x, i):
            before = F.right(F.concat(F.when(i > 0, F.get(found, i - 1)).otherwise(""), F.get(pieces, i)), F.lit(AROUND))
            after = F.left(F.concat(F.get(pieces, i + 1), F.coalesce(F.get(found, i + 1), F.lit(""))), F.lit(2))
            return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), F.lower(before).alias("b"), after.alias("a"))

        return F.transform(located(found, pieces), around)

    df = _cut(df, WIDE).withColumn("wide", F.transform(F.concat(*[spans(k) for k in WIDE]), described))
    return df.drop(*[f"{c}_{k}" for c in "mp" for k in WIDE])


#: How an address's sign is written.
AT = r"@|(?i)[(\[{<]at[)\]}>]| at "


def described(x: Column) -> Column:
    """A span with the features of its format and of the text before and after it."""
    v = x["v"]
    d = digits(v)
    groups = F.transform(F.filter(F.split(v, "[^0-9A-Za-z]+"), lambda g: g != ""), lambda g: F.length(g))
    before, after = x["b"], x["a"]
    top = F.lower(F.regexp_extract(v, "([A-Za-z]+)$", 1))
    count = lambda pattern: F.regexp_count(v, F.lit(pattern)).cast("double")
    flag = lambda c: c.cast("double")
    n = F.length(d)
    dotted = F.regexp_replace(v, r"(?i) ?[\[({<]?(?:\.|dot)[\])}>]? ?", ".")
    values = {
        "n_digits": n.cast("double"), "n_chars": F.length(v).cast("double"), "n_separators": count("[^0-9A-Za-z]"), "n_groups": F.size(groups).cast("double"),
        "longest": F.coalesce(F.array_max(groups), F.lit(0)).cast("double"), "shortest": F.coalesce(F.array_min(groups), F.lit(0)).cast("double"), "has_at": flag(v.rlike(AT)), "letters": count("[A-Za-z]"),
        "luhn": flag(n.between(13, 19) & luhn(d)), "octets": flag(dotted.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & octets(dotted)), "plus": flag(v.startswith("+")), "dots": count(r"\."), "dashes": count("-"), "spaces": count(" "),
        "slashes": count("/"), "brackets": count(r"[\[\](){}]"), "varied": F.size(F.array_distinct(F.split(d, ""))).cast("double"), "zero": flag(v.rlike(r"^\(?0")),
        "cue": flag(before.rlike("mail|phone|tel|call|fax|mobile|cell|card|visa|credit|contact|address|write|reach|host|server|from|whatsapp|number is")), "code_cue": flag(before.rlike("version|serial|isbn|order|invoice|sha|hash|token|key|=|score|date|time|since|price|total|page|ref|build")),
        "glued_left": flag(before.rlike(r"[0-9A-Za-z.,:/#-]$")), "glued_right": flag(after.rlike(r"^[.,:/#-]?[0-9A-Za-z]")), "date": flag(v.rlike(r"^(19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|^[0-9]{1,2}[-./][0-9]{1,2}[-./](19|20)[0-9]{2}|^(19|20)[0-9]{2} ?[-/\u2013] ?(19|20)[0-9]{2}$")),
        "spelled": flag(v.rlike("(?i) at .* dot ")), "top_known": flag(top.isin(*TOPS)), "top_chars": F.length(top).cast("double"),
    }
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), v.alias("v"), *[values[f].alias(f) for f in FEATURES])


def _blocks(spans: Column) -> Column:
    """Sorted spans in blocks with the range that each covers: a search reads the blocks' ranges and one or two blocks."""
    own = F.transform(F.sequence(F.lit(0), F.size(spans) - 1, F.lit(BLOCK)), lambda k: F.slice(spans, k + 1, F.lit(BLOCK)))
    ranged = F.transform(own, lambda g: F.struct(g[0]["s"].alias("s"), F.element_at(g, -1)["e"].alias("e"), g.alias("spans")))
    return F.when(F.size(spans) > 0, ranged).otherwise(F.array().cast(f"array<struct<s:int,e:int,spans:{SPAN}>>"))


def _touches(x: Column, blocks: Column) -> Column:
    meets = lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])
    return F.exists(blocks, lambda g: meets(g) & F.exists(g["spans"], meets))


class Model:
    """Boosted trees as a column expression: margin(span) and the threshold on it; precision and recall on held-back plantings."""

    def __init__(self, trees: list, weights: list[float], threshold: float, precision: float = math.nan, recall: float = math.nan):
        self.trees, self.weights, self.threshold, self.precision, self.recall = trees, weights, threshold, precision, recall

    def margin(self, x: Column) -> Column:
        def value(t) -> Column:
            return F.lit(float(t[0])) if len(t) == 1 else F.when(x[FEATURES[t[0]]] <= F.lit(t[1]), value(t[2])).otherwise(value(t[3]))

        return reduce(lambda a, b: a + b, [F.lit(w) * value(t) for w, t in zip(self.weights, self.trees, strict=True)])

    def accepts(self, x: Column) -> Column:
        return self.margin(x) >= F.lit(self.threshold)


def _parsed(description: str) -> tuple[list[tuple], list[float]]:
    """Trees and weights from a model's printed form: nested (feature, threshold, left, right), or (value,)."""
    lines = iter(x.strip() for x in description.splitlines())

    def node() -> tuple:
        line = next(lines)
        if line.startswith("Predict:"):
            return (float(line.split(":")[1]),)
        feature, threshold = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        left = node()
        next(lines)  # Else
        return int(feature), float(threshold), left, node()

    trees, weights = [], []
    for line in lines:
        if m := re.match(r"Tree \d+ \(weight (\S+)\):", line):
            weights.append(float(m[1]))
            trees.append(node())
    return trees, weights


def _pick(seed: Column, *choices) -> Column:
    """One of the choices (strings or columns) by a hash."""
    return F.element_at(F.array(*[F.lit(c) if isinstance(c, str) else c for c in choices]), (F.pmod(seed, F.lit(len(choices))) + 1).cast("int"))


def planted(docs: DataFrame) -> DataFrame:
    """docs: (id, t). Each row PLANTINGS times with a span put in after one of its first words: (id, k, t, s, e, positive)."""
    df = docs.select("id", "t", F.explode(F.sequence(F.lit(0), F.lit(PLANTINGS - 1))).alias("k"))
    h = lambda n: F.xxhash64("id", "k", F.lit(n))
    number = lambda n, width: F.lpad(F.pmod(h(n), F.lit(10**width)).cast("string"), width, "0")
    d = F.concat(number(1, 9), number(2, 9), number(3, 9))
    cut = lambda *sizes: [F.substring(d, 1 + sum(sizes[:k]), n) for k, n in enumerate(sizes)]
    joined = lambda sep, parts: F.concat_ws(sep, *parts)
    # A card number with its check digit, and one whose check digit is wrong.
    body = F.concat(F.lit("4"), F.substring(d, 1, 14))
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    fours = lambda c: [F.substring(c, k, 4) for k in (1, 5, 9, 13)]
    right = fours(F.concat(body, check.cast("string")))
    wrong = fours(F.concat(body, ((check + 1 + F.pmod(h(4), F.lit(8))) % 10).cast("string")))
    # Addresses of any length, every other one with short parts.
    parts = [F.pmod(h(5 + k), F.when(F.pmod(h(15), F.lit(2)) == 0, 256).when(F.pmod(h(16 + k), F.lit(2)) == 0, 10).otherwise(256)).cast("string") for k in range(4)]
    own = F.split("t", " ")
    word = lambda n: F.regexp_replace(F.element_at(own, (F.pmod(h(n), F.size(own)) + 1).cast("int")), "[^A-Za-z]", "")
    said = lambda n, *fixed: F.coalesce(F.nullif(word(n), F.lit("")), _pick(h(n), *fixed))
    name = F.concat(_pick(h(9), "anna", "j.smith", "info", "kontakt", "maria_p", "office", "karl"), _pick(h(10), F.lit(""), F.substring(d, 1, 2)))
    site, top = _pick(h(11), "example", "mail", "web-box", "uni", "corp", "firma"), _pick(h(12), "com", "org", "de", "net", "io", "co.uk", "fr", "edu")
    address = lambda at, dot: F.concat(name, F.lit(at), site, F.lit(dot), top)
    country, area = _pick(h(13), "49", "1", "44", "33"), F.substring(d, 1, 3)
    spans = {
        "email": _pick(h(20), address(" at ", " dot "), address("(at)", "(dot)"), address(" [at] ", " [dot] "), address(" @ ", "."), address("{at}", "."), address("[at]", ".")),
        "ip": _pick(h(20), *[joined(x, parts) for x in (" . ", "[.]", "(.)", "(dot)")]),
        "card": _pick(h(20), *[joined(x, right) for x in ("/", ".", " - ", "_", "  ", " / ")]),
        "phone": _pick(
            h(20), F.concat(F.lit("00"), country, F.lit(" "), joined(" ", cut(3, 3, 4))), F.concat(F.lit("(0"), area, F.lit(") "), joined("-", cut(3, 3)[1:] + [number(4, 4)])), F.concat(F.lit("0"), area, F.lit("/"), number(3, 7)),
            joined("-", cut(3, 3, 4)), joined(".", cut(3, 3, 4)), joined(" ", cut(3, 3, 4)), F.concat(F.lit("("), area, F.lit(") "), joined("-", cut(3, 3, 4)[1:])), F.concat(F.lit("0"), number(2, 3), F.lit(" "), number(3, 7)),
        ),
    }
    cues = {
        "email": ("mail: ", "write to ", "contact ", "reach me: "), "ip": ("host ", "server ", "from ", "address "),
        "card": ("card ", "visa: ", "credit card no. ", "my card number is "), "phone": ("call ", "tel. ", "phone: ", "mobile ", "fax "),
    }
    day = F.concat(F.lit("20"), F.substring(d, 1, 2), F.lit("-0"), (F.pmod(h(14), F.lit(9)) + 1).cast("string"), F.lit("-1"), F.substring(d, 3, 1))
    decoys = [
        day, F.concat(day, F.lit(" 1"), F.substring(d, 5, 1), F.lit("."), F.lit("4"), F.substring(d, 6, 1), F.lit(".0"), F.substring(d, 7, 1)), F.concat(F.lit("199"), F.substring(d, 1, 1), F.lit("-200"), F.substring(d, 2, 1)),
        *[joined(x, wrong) for x in ("/", ".", " - ", " ", "")], joined("-", [F.lit("978"), *cut(1, 2, 6, 1)]), joined(".", cut(1, 2, 2, 3, 2)), joined(".", cut(2, 4, 4, 2)), joined(" ", [joined("-", [F.substring(d, k, 1), F.substring(d, k + 1, 1)]) for k in (1, 3, 5, 7)]),
        F.concat(joined(".", cut(1, 3, 3)), F.lit(".00")), F.substring(d, 1, 12), F.concat(F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 8), F.lit("-"), F.substring(d, 17, 6)), joined(" . ", cut(1, 1, 1, 1, 1, 1, 1, 1)),
        F.concat(joined(" / ", cut(2, 2, 2)), F.lit(" ("), F.substring(d, 7, 3), F.lit(")")), joined(".", [F.concat(F.lit("9"), F.substring(d, 1 + 2 * k, 2)) for k in range(4)]),
        *[F.concat(said(40, "meet", "look", "arrive", "back"), F.lit(" at "), said(41, "noon", "example", "home"), F.lit(" dot "), said(42, "everyone", "points", "product")) for _ in range(2)],
        F.concat(_pick(h(43), "look", "meet", "point", "start", "us"), F.lit(" at "), said(44, "noon", "example"), F.lit(" dot "), _pick(h(45), "points", "everyone", "product", "and", "then", "matrix")),
        *[F.concat(F.substring(d, 1, 1), F.lit("."), F.substring(d, 2, n)) for n in (7, 13)],
        *[joined(x, [F.concat(F.lit("9"), F.substring(d, 1 + 2 * k, 2)) for k in range(4)]) for x in (" . ", "[.]")],
    ]
    kinds = [*KINDS, "none", "none", "none", "none"]
    df = df.withColumn("kind", _pick(h(30), *kinds))
    of = lambda found: reduce(lambda a, k: a.when(F.col("kind") == k, found[k]), KINDS[1:], F.when(F.col("kind") == KINDS[0], found[KINDS[0]]))
    span = of(spans).otherwise(_pick(h(31), *decoys))
    cue = of({k: _pick(h(32), "", "", "", "", *cues[k]) for k in KINDS}).otherwise(_pick(h(32), "", "", "", "", "version ", "order no. ", "score ", "isbn ", "date: ", "total ", "ref ", "since "))
    left = F.call_function("substring_index", F.col("t"), F.lit(" "), (F.pmod(h(33), F.lit(40)) + 1).cast("int"))
    df = df.withColumns({"x": span, "cue": cue, "left": left})
    s = F.length("left") + 1 + F.length("cue")
    return df.select(
        "id", "k", F.concat("left", F.lit(" "), "cue", "x", _pick(h(34), "", "", "", ".", ",", ";"), F.substring("t", F.length("left") + 1, F.length("t"))).alias("t"),
        s.cast("int").alias("s"), (s + F.length("x")).cast("int").alias("e"), (F.col("kind") != "none").alias("positive"),
    )


def fit(docs: DataFrame) -> Model | None:
    """docs: (id, t). None if there are too few plantings of either label."""
    sample = docs.select("id").dropna().distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    rows = planted(docs.join(F.broadcast(sample), "id", "left_semi").dropDuplicates(["id"]))  # SAMPLE ids
    # The candidates on the planted span; all others have no label.
    rows = with_candidates(rows).withColumn("wide", F.filter("wide", lambda x: (x["s"] < F.col("e")) & (F.col("s") < x["e"])))
    first = F.array_sort("wide", lambda a, b: (b["e"] - b["s"]) - (a["e"] - a["s"]))[0]
    held = F.pmod(F.xxhash64("id", "k", F.lit(99)), F.lit(3)) == 0
    rows = rows.select("id", "k", "positive", held.alias("held"), F.when(F.size("wide") > 0, first).alias("x")).select("id", "k", F.col("positive").cast("double").alias("label"), "held", F.col("x").isNotNull().alias("proposed"), "x.*").drop("s", "e", "v")
    rows = written(rows.orderBy(F.xxhash64("id", "k"), "id", "k").coalesce(1), "pii-plantings")  # PLANTINGS * SAMPLE rows of numbers
    counts = {(r.label, r.held): r["count"] for r in rows.filter("proposed").groupBy("label", "held").count().collect()}
    if len(counts) < 4 or min(counts.values()) < 10:
        return None
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.filter("proposed"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=11, labelCol="label", cacheNodeIds=False).fit(data.filter(~F.col("held")))
    held = model.transform(data.filter("held")).select("label", vector_to_array("rawPrediction")[1].alias("margin")).toPandas()  # a third of them
    wanted = rows.filter("held AND label = 1").count()
    held = held.sort_values("margin", ascending=False)
    right = held["label"].cumsum()
    precision = right / range(1, len(held) + 1)
    good = held[(precision >= PRECISION) & (held["margin"] != held["margin"].shift(-1))].index
    if not len(good):
        return None
    last = good[-1]
    # The margin is the weighted sum of the trees.
    return Model(*_parsed(model.toDebugString), float(held["margin"][last]) - 1e-9, float(precision[last]), float(right[last]) / wanted)


def with_spans(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs: (id, t). Adds base spans by kind and, as `more`, accepted spans that touch none of them, with a kind."""
    df = with_base(docs)
    if model is None:
        return df.withColumn("more", F.array().cast("array<struct<k:string,s:int,e:int>>"))
    df = with_candidates(df)
    df = df.withColumn("blocks", F.concat(*[_blocks(F.col(k)) for k in KINDS]))
    kind = lambda x: F.when(x["has_at"] == 1, "email").when(x["octets"] == 1, "ip").when(x["luhn"] == 1, "card").otherwise("phone")
    accepted = F.filter("wide", model.accepts)
    apart = F.when(F.size("blocks") == 0, accepted).otherwise(F.filter(accepted, lambda x: ~_touches(x, F.col("blocks"))))
    more = F.array_sort(F.transform(apart, lambda x: F.struct(kind(x).alias("k"), x["s"].alias("s"), x["e"].alias("e"))))
    # Two generators may propose the same span; array_distinct compares all structs with all.
    new = F.filter("more", lambda x, i: (i == 0) | (F.get("more", i - 1) != x))
    return df.withColumn("more", more).drop("wide", "blocks").withColumn("more", new)


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))


def _all(kind: str) -> Column:
    own = F.transform(F.col(kind), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    more = F.transform(F.filter("more", lambda x: x["k"] == kind), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    return F.array_sort(F.concat(own, more))


def _tagged(kind: str) -> Column:
    return F.transform(_all(kind), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("k")))


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per document: counts by kind, a digest of the base spans, and all spans as text. A model is fitted unless one is given."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    df = with_spans(d, model or fit(d))
    base = F.array_join(F.concat(*[_named(k, F.col(k)) for k in KINDS]), ",")
    every = F.array_join(F.concat(*[_named(k, _all(k)) for k in KINDS]), ",")
    return df.select(F.col("id").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(id, text): every span replaced by its kind in brackets; of overlapping spans the first counts."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    df = with_spans(d, model or fit(d))
    marked = F.array_sort(F.concat(*[_tagged(k) for k in KINDS]))
    df = df.withColumn("marked", marked)
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        text = F.concat(acc["out"], F.substring(F.col("t"), acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), x["k"], F.lit("]"))
        skip = x["s"] < acc["at"]
        return F.struct(F.when(skip, F.greatest(acc["at"], x["e"])).otherwise(x["e"]).alias("at"), F.when(skip, acc["out"]).otherwise(text).alias("out"))

    end = F.aggregate("marked", first, step)
    return df.withColumn("end", end).select(F.col("id").alias(id_col), F.concat(F.col("end.out"), F.expr("substring(t, end.at + 1)")).alias(text_col))
