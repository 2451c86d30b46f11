"""Personal data by generated candidates and boosted trees (operator 9), native Spark only.

Base rules find e-mail addresses, IP addresses, card and phone numbers.  High-recall generators
propose further, overlapping spans: long mixed tokens, digit groups, spelt-out addresses.  A
candidate is a vector of small format and context features; all candidates of the corpus are
counted by vector and weak label, and trees are boosted on that table, whose size is bounded by
the features' bands.  A fifth of the texts, by hash, is held out from the trees: thresholds are
calibrated on it, per generator, to a precision, and select what is added.
Everything that touches rows is built-in Column expressions; the driver sees the counted table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passgrid.llm.common import col, numbered_columns, staged

# Base rules.  Possessive forms of the given patterns: they match the same places, without backtracking.
KINDS = ["email", "ip", "card", "phone"]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINT = {"email": "@", "ip": ".", "phone": "+"}
# Generators of candidates: long tokens with a digit, digit groups, spelt-out addresses.
GENERATORS = {
    "secret": r"(?<![0-9A-Za-z_-])(?=[A-Za-z_-]*+[0-9])[0-9A-Za-z_-]{20,}+",
    "number": r"(?<![0-9A-Za-z])[(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
    "contact": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++ ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z]{2,}+",
}
CUES = r"(?i)(?:token|secret|passw|key|card|phone|call|tel|mobile|account|iban|ssn|contact|mail)[^\n]{0,14}$"
CONTEXT = 32
FEATURES = ["generator", "size", "digits", "cue", "left", "right", "mix", "marks"]
SPAN = "array<struct<kind:int,start:int,end:int>>"
CANDIDATE = "array<struct<" + ",".join(f"{f}:int" for f in FEATURES) + ",start:int,end:int,label:int>>"


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def _stretches(values: Column, combine) -> Column:
    """``combine`` of the first 0, 256, 512, ... values; with ``_before`` it makes prefix sums or maxima
    at a cost well below the square of their number."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / 256).cast("int")), lambda k: combine(F.slice(values, F.lit(1), k * 256)))


def _before(values: Column, stretches: Column, i: Column, combine) -> Column:
    """``combine`` of the values before place i; values and stretches are materialised columns."""
    block = F.floor(i / 256).cast("int")
    return combine(F.array(F.element_at(stretches, block + 1), combine(F.slice(values, block * 256 + 1, i % 256))))


def _greatest(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: F.greatest(s, x))


def _sizes(pieces: Column, matches: Column) -> Column:
    """What every match and the piece before it take."""
    return F.transform(F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("p"), matches.alias("m")), lambda x: F.length(x["p"]) + F.length(x["m"]))


def _found(pieces: Column, matches: Column, sizes: Column, stretches: Column) -> Column:
    """Matches with place and surroundings, from what split() leaves between them."""

    def one(m: Column, i: Column) -> Column:
        before = F.element_at(pieces, i + 1)
        start = _before(sizes, stretches, i, _sum) + F.length(before)
        return F.struct(
            start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text"),
            F.right(before, F.lit(CONTEXT)).alias("before"), F.left(F.element_at(pieces, i + 2), F.lit(1)).alias("after"),
        )

    return F.transform(matches, one)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum: every second one from the right doubled."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int")))
    return _sum(each) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    text = x["text"]
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda part: part.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        return F.when(F.length(_digits(text)).between(16, 19), luhn(_digits(text))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    return F.lit(True)


def _band(x: Column, edges: list[int]) -> Column:
    return sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))


def _side(c: Column) -> Column:
    """0 nothing or white space, 1 quotes and brackets, 2 other marks, 3 letters and digits."""
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0).when(c.rlike(r"\s"), 0).when(c.rlike("[\"'`(\\[{<=:]"), 1).when(c.rlike(r"[0-9\p{L}]"), 3).otherwise(2)


def _candidate(number: int, kind: str, x: Column) -> Column:
    """Features and weak label; what the label checks (checksums, exact sizes, dialling plan) is no feature."""
    text, digits = x["text"], _digits(x["text"])
    if kind == "secret":
        label = text.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|(?:sk|pk|ghp|AKIA)[-_A-Za-z0-9]{16,})$")
    elif kind == "number":
        label = F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(digits.rlike("^1?[2-9][0-9]{2}[2-9][0-9]{6}$") & text.rlike("[ ().-]"))
    else:
        label = text.rlike(r"(?i)[(\[]dot[)\]]|\.(?:com|org|net|edu|de|fr|es)$")
    return F.struct(
        F.lit(number).alias("generator"),
        _band(F.length(text), [9, 13, 21, 33, 45]).alias("size"),
        _band(F.length(digits), [4, 8, 11, 14, 20]).alias("digits"),
        F.when(x["before"].rlike(CUES), 1).otherwise(0).alias("cue"),
        _side(F.right(x["before"], F.lit(1))).alias("left"),
        _side(x["after"]).alias("right"),
        F.when(text.rlike("^[0-9 ().-]+$"), 0).when(text.rlike("^[0-9a-f]+$"), 1).when(text.rlike("[A-Z]"), 3).otherwise(2).alias("mix"),
        F.when(text.rlike("[()]"), 2).when(text.rlike("[ .-]"), 1).otherwise(0).alias("marks"),
        x["start"].alias("start"),
        x["end"].alias("end"),
        F.when(label, 1).otherwise(0).alias("label"),
    )


def with_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """All columns and ``__base`` (valid base spans by kind and start), ``__candidates`` and ``__held`` (the text is for calibration)."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    digit = F.col("__text").rlike("[0-9]")
    empty = F.array().cast("array<string>")
    out = docs.withColumn("__text", text).withColumn("__digit", digit).withColumn("__held", F.pmod(F.xxhash64("__text"), F.lit(5)) == 0)
    patterns = BASE | GENERATORS
    needed = {
        k: F.col("__text").contains(HINT[k]) & (F.col("__digit") if k != "email" else F.lit(True)) if k in HINT
        else F.lower(F.col("__text")).rlike(r"[(\[]at[)\]]") if k == "contact" else F.col("__digit")
        for k in patterns
    }
    out = out.withColumns({f"__m_{k}": F.when(needed[k], F.regexp_extract_all("__text", F.lit(p), F.lit(0))).otherwise(empty) for k, p in patterns.items()})
    out = out.withColumns({f"__p_{k}": F.when(F.size(f"__m_{k}") > 0, F.split("__text", p, -1)).otherwise(empty) for k, p in patterns.items()})
    # Step by step: what a lambda reads is a column by then, not an expression that it would repeat for every element.
    some = {k: F.size(f"__m_{k}") > 0 for k in patterns}
    out = out.withColumns({f"__s_{k}": F.when(some[k], _sizes(F.col(f"__p_{k}"), F.col(f"__m_{k}"))) for k in patterns})
    out = out.withColumns({f"__t_{k}": F.when(some[k], _stretches(F.col(f"__s_{k}"), _sum)) for k in patterns})
    out = out.withColumns({f"__f_{k}": F.when(some[k], _found(*[F.col(f"__{x}_{k}") for x in "pmst"])) for k in patterns})

    def spans_of(i: int, k: str) -> Column:
        valid = F.filter(f"__f_{k}", lambda x: _valid(k, x))
        return F.transform(valid, lambda x: F.struct(F.lit(i).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    def proposed_by(i: int, k: str) -> Column:
        return F.transform(f"__f_{k}", lambda x: _candidate(i, k, x))

    base = [spans_of(i, k) for i, k in enumerate(KINDS)]
    proposed = [proposed_by(i, k) for i, k in enumerate(GENERATORS)]
    out = out.withColumn("__base", F.concat(*[F.coalesce(b.cast(SPAN), F.array().cast(SPAN)) for b in base]))
    out = out.withColumn("__candidates", F.concat(*[F.coalesce(p.cast(CANDIDATE), F.array().cast(CANDIDATE)) for p in proposed]))
    return out.drop("__digit", *[f"__{x}_{k}" for x in "mpstf" for k in patterns])


class Boosted:
    """Trees of depth two over banded features, and a threshold per generator."""

    def __init__(self, start: float, trees: list, thresholds: dict[int, float]):
        self.start, self.trees, self.thresholds = start, trees, thresholds

    def raw(self, row) -> float:
        return self.start + sum(self._leaf(t, row) for t in self.trees)

    @staticmethod
    def _leaf(tree, row) -> float:
        while isinstance(tree, tuple):
            feature, at, low, high = tree
            tree = low if row[feature] <= at else high
        return tree

    def score(self, x: Column) -> Column:
        """The raw score as a Column of a candidate's fields."""

        def grow(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            feature, at, low, high = tree
            return F.when(x[FEATURES[feature]] <= at, grow(low)).otherwise(grow(high))

        return sum((grow(t) for t in self.trees), F.lit(float(self.start)))

    def selects(self, x: Column) -> Column:
        chosen = F.lit(False)
        for number, threshold in self.thresholds.items():
            chosen = F.when(x["generator"] == number, self.score(x) >= threshold).otherwise(chosen)
        return chosen

    @classmethod
    def fit(cls, cells: list[tuple[tuple[int, ...], int, int]], rounds: int, rate: float, precision: float, held: list[tuple[tuple[int, ...], int, int]]) -> Boosted:
        """cells: (features, label, count).  Newton steps on the logistic loss; ties go to the first split.

        ``held`` cells, of the same form, take no part in the trees and set the thresholds: the lowest
        score from which on the share of positives is ``precision``; a generator without one selects nothing.
        """
        total = sum(n for _, _, n in cells)
        if not total:
            return cls(0.0, [], {})
        share = min(1 - 1e-3, max(1e-3, sum(n for _, y, n in cells if y) / total))
        start, trees, raw = math.log(share / (1 - share)), [], [math.log(share / (1 - share))] * len(cells)

        def leaf(of: list[int], g: list[float], h: list[float]) -> float:
            return -rate * sum(g[i] for i in of) / (sum(h[i] for i in of) + 1.0)

        def split(of: list[int], g: list[float], h: list[float], depth: int):
            best, total_g, total_h = None, sum(g[i] for i in of), sum(h[i] for i in of)
            for f in range(len(FEATURES)):
                sums: dict[int, list[float]] = {}
                for i in of:
                    s = sums.setdefault(cells[i][0][f], [0.0, 0.0])
                    s[0] += g[i]
                    s[1] += h[i]
                low_g = low_h = 0.0
                for at in sorted(sums)[:-1]:
                    low_g, low_h = low_g + sums[at][0], low_h + sums[at][1]
                    gain = low_g**2 / (low_h + 1) + (total_g - low_g) ** 2 / (total_h - low_h + 1) - total_g**2 / (total_h + 1)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                        best = gain, f, at
            if best is None or depth == 0:
                return leaf(of, g, h)
            _, f, at = best
            return (f, at, *(split([i for i in of if (cells[i][0][f] <= at) == side], g, h, depth - 1) for side in (True, False)))

        for _ in range(rounds):
            p = [1 / (1 + math.exp(-r)) for r in raw]
            g = [(p[i] - y) * n for i, (_, y, n) in enumerate(cells)]
            h = [p[i] * (1 - p[i]) * n for i, (_, _, n) in enumerate(cells)]
            tree = split(list(range(len(cells))), g, h, 2)
            if not isinstance(tree, tuple):
                break
            trees.append(tree)
            raw = [r + cls._leaf(tree, row) for r, (row, _, _) in zip(raw, cells, strict=True)]
        grown, thresholds = cls(start, trees, {}), {}
        for number in range(len(GENERATORS)):
            of = sorted(((grown.raw(row), y, n) for row, y, n in held if row[0] == number), reverse=True)
            positive = seen = 0
            for k, (r, y, n) in enumerate(of):
                positive, seen = positive + y * n, seen + n
                if (k + 1 == len(of) or of[k + 1][0] < r) and positive >= precision * seen:
                    thresholds[number] = r - 1e-9
        return cls(start, trees, thresholds)


def fit_boosted(spans: DataFrame, rounds: int = 24, rate: float = 0.4, precision: float = 0.9) -> Boosted:
    """Train on all candidates of a table from ``with_spans``, counted by features, label and held-out mark.

    The counted table has at most 3 * 6 * 6 * 2 * 4 * 4 * 4 * 3 * 2 * 2 rows, whatever the corpus.
    """
    counted = spans.select("__held", F.explode("__candidates").alias("c")).groupBy("__held", *[F.col(f"c.{f}").alias(f) for f in FEATURES], F.col("c.label").alias("label")).count()
    rows = sorted((tuple(r[f] for f in FEATURES), r["label"], r["count"], r["__held"]) for r in counted.collect())
    part = lambda held: [r[:3] for r in rows if r[3] == held]
    return Boosted.fit(part(False), rounds, rate, precision, part(True))


def with_selected(found: DataFrame, model: Boosted) -> DataFrame:
    """``__spans``: base spans, and then those of the candidates that the trees add and no base span overlaps."""
    chosen = found.withColumn("__chosen", F.filter("__candidates", model.selects))
    free = F.filter("__chosen", lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    added = F.transform(free, lambda x: F.struct((x["generator"] + len(KINDS)).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return chosen.withColumn("__spans", F.concat("__base", F.array_sort(added.cast(SPAN)))).drop("__chosen")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, *GENERATORS]])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every whole text.

    Returns a row per input row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256
    (of "kind:start:end" by kind, then start, comma-joined; code points, end exclusive), spans
    (base spans and added ones of kinds secret, number, contact, joined likewise), n_secret,
    n_number, n_contact (added spans) and n_spans (all).  A null text is empty; null ids and
    repeated rows keep a row each; an empty table gives none; other columns are ignored.
    """
    own = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    spans = staged(with_spans(own, "text").select("doc_id", "__base", "__candidates", "__held"), "pii-candidates")
    model = fit_boosted(spans)
    count = lambda i: F.size(F.filter("__spans", lambda x: x["kind"] == i)).cast("long")
    return with_selected(spans, model).select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"),
        _joined(F.col("__spans")).alias("spans"),
        *[count(i + len(KINDS)).alias(f"n_{k}") for i, k in enumerate(GENERATORS)],
        F.size("__spans").cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with every selected span of ``text_col`` replaced by its kind in brackets.

    Overlapping spans become one mark of the earliest's kind.  A null text stays null; texts
    without personal data and all other columns, whatever their names, stay as they are; repeated
    rows stay; an empty table stays empty.  Texts are searched once: the rows are staged with their spans.
    """
    plain = numbered_columns(docs)
    text_col = plain.columns[docs.columns.index(text_col)]
    spans = staged(with_spans(plain, text_col).select(*plain.columns, "__base", "__candidates", "__held"), "pii-candidates")
    model = fit_boosted(spans)
    found = with_selected(spans, model)
    found = found.withColumn("__spans", F.array_sort(F.transform("__spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))))
    # A span that begins before the end of those before it is part of their mark.
    found = found.withColumn("__ends", F.transform("__spans", lambda x: x["end"])).withColumn("__reach", _stretches(F.col("__ends"), _greatest))
    reach = lambda i: _before(F.col("__ends"), F.col("__reach"), i, _greatest)
    placed = F.transform("__spans", lambda x, i: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), reach(i).alias("after")))
    found = found.withColumn("__heads", F.filter(placed, lambda x: x["start"] >= x["after"]))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in [*KINDS, *GENERATORS]])
    text = F.col(text_col).cast("string")
    parts = F.transform("__heads", lambda x: F.concat(F.substring(text, x["after"] + 1, x["start"] - x["after"]), F.element_at(names, x["kind"] + 1)))
    last = F.array_max(F.transform("__spans", lambda x: x["end"]))
    rest = F.substring(text, last + 1, F.length(text))
    changed = found.withColumn("__new", F.when(F.size("__spans") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col(text_col)))
    return changed.select(*[F.col("__new") if c == text_col else F.col(c) for c in plain.columns]).toDF(*docs.columns)
