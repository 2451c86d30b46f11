"""Mixing sources to target weights by iterative proportional fitting (operator 8).

The corpus enters as token totals per cell (source, language, topic).  Raking scales the cells
until their shares meet all target marginals; what a cell was scaled by is the weight of its
tokens.  Documents are then sampled without repetition, so a cell gives no more than it has:
raking goes on with such cells held at their size until the expected sample meets the marginals.
A value that has fewer tokens than its target share of the sample is taken whole, and the others
of its dimension share what is left in proportion to their targets.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from passgrid.llm.common import col, numbered_columns, release, staged
from passgrid.llm.token_counts import _cut
from passgrid.llm.wordpieces import PieceTokenizer, WordTokenizer, word_tokenizer

NONE = "(none)"
#: Bytes of text that are cut and counted at a time at most (a longer text by itself).
SLICE_BYTES = 8 << 20
#: Above so many cells they are raked as a table by Spark, and joined without a broadcast.
DRIVER_CELLS = 50_000
#: Rounds of raking at most.
ROUNDS = 200
#: Scale of cells that are taken whole because a value of theirs is.
WHOLE = 1e150


def topic_of(text: Column) -> Column:
    """A topic for tables that have none: what kind of writing the text is."""
    marks = [text.contains(m) for m in ("###", "***", "$$$", "%%%", "&&&")]
    marked = marks[0] | marks[1] | marks[2] | marks[3] | marks[4]
    return F.when(text.isNull() | (text == ""), "empty").when(text.contains(" | "), "table").when(marked, "markup").when(text == F.upper(text), "capitals").otherwise("prose")


def counts(own: WordTokenizer | PieceTokenizer, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words (stretches without ASCII white space) and tokens of every text; a null text has none.

    Texts are cut at white space as columns, and each distinct stretch of them all is looked up once.
    A text that may hold an added token, or any text of a file of another kind, is encoded by itself.
    """
    texts = pc.fill_null(texts, "")
    alone = np.full(len(texts), not own.by_chunk)
    if own.by_chunk:
        if own.added:
            alone = pc.match_substring(texts, own.opening).to_numpy(zero_copy_only=False)
        cut = pc.ascii_split_whitespace(pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts))
    else:
        cut = pc.ascii_split_whitespace(texts)
    starts, stretches = cut.offsets.to_numpy()[:-1], cut.values.dictionary_encode()
    distinct, places = stretches.dictionary.to_numpy(zero_copy_only=False), stretches.indices.to_numpy()
    # Every text has a stretch, if only an empty one.
    words = np.add.reduceat((distinct != "")[places], starts, dtype=np.int64)
    tokens = np.zeros(len(texts), np.int64) if alone.all() else np.add.reduceat(np.array(own.lengths(distinct), np.int32)[places], starts, dtype=np.int64)
    for i in np.nonzero(alone)[0].tolist():
        text = texts[i].as_py()
        tokens[i] = len(own.ids(text)) // 4 if text else 0
    return words, tokens


def with_counts(docs: DataFrame, text_col: str, tokenizer: str) -> DataFrame:
    """The other columns, and ``n_words`` and ``n_tokens`` of the whole text; a null text has none."""
    others = [c for c in docs.columns if c != text_col]
    names = [*others, "n_words", "n_tokens"]
    schema = StructType([docs.schema[c] for c in others]).add("n_words", LongType()).add("n_tokens", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_tokenizer(tokenizer)
        for batch in _cut(batches, SLICE_BYTES, len(others)):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, counts(own, batch.column(len(others))))], names=names)

    return docs.select(*[col(c) for c in others], col(text_col)).mapInArrow(run, schema)


def tempered(totals: dict[str, float], power: float) -> dict[str, float]:
    """Target shares: observed shares to a power below one, which lifts rare values."""
    weights = {k: v**power for k, v in totals.items() if v > 0}
    return {k: v / sum(weights.values()) for k, v in weights.items()}


def rake(cells: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = 1e-10) -> np.ndarray:
    """Cell totals scaled until every marginal's shares are the targets' (of the values that occur)."""
    w = cells / max(cells.sum(), 1e-300)
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets, strict=True):
            have = np.bincount(code, w, len(target))
            factor = np.divide(target, have, out=np.zeros_like(have), where=have > 0)
            worst = max(worst, float(np.abs(have - target).max(initial=0)))
            w = w * factor[code]
        if worst < tolerance:
            break
    return w


def _told(miss: float, tolerance: float) -> None:
    """Say so where the sample's marginals are not the wanted ones (limits can make them unreachable together)."""
    if miss > max(tolerance, 1e-6):
        warnings.warn(f"mixing: a marginal of the sample is off by {miss:.3g} of all tokens", stacklevel=3)


def _rake_table(cells: DataFrame, dims: list[str], targets: dict[str, DataFrame], rounds: int, tolerance: float) -> DataFrame:
    """The same over a table of cells of any size; lineage is cut every round."""
    w = cells.withColumn("w", F.col("tokens") / cells.agg(F.sum("tokens")).first()[0])
    for _ in range(rounds):
        for d in dims:
            have = w.groupBy(d).agg(F.sum("w").alias("have")).join(targets[d], d, "left")
            w = w.join(have, d).withColumn("w", F.coalesce(F.col("w") * F.col("target") / F.col("have"), F.lit(0.0))).drop("have", "target")
        last, w = w, staged(w, "raked")
        release(last)
        errors = [w.groupBy(d).agg(F.sum("w").alias("have")).join(targets[d], d).agg(F.max(F.abs(F.col("have") - F.col("target")))).first()[0] or 0.0 for d in dims]
        if max(errors) < tolerance:
            break
    return w


def _scale(sizes: DataFrame, size: str, factor: str, want: float) -> float:
    """What ``calibrated`` finds, over a table of any size.

    The sum is concave in the scale and linear between the scales at which a row becomes whole, so
    steps along its tangent from below stop at the very scale, after few passes.
    """
    t, f, c = F.col(size), F.col(factor), 0.0
    while True:
        whole = F.lit(c) * f >= 1
        full, rest = sizes.where(f > 0).agg(F.sum(F.when(whole, t).otherwise(0.0)), F.sum(F.when(whole, 0.0).otherwise(t * f))).first()
        if not rest or (step := (want - full) / rest) <= c * (1 + 1e-14):
            return c
        c = step


def calibrated(sizes: np.ndarray, factors: np.ndarray, share: float) -> float:
    """The scale c for which the sum of sizes * min(1, c * factors) is the share of all sizes (or all that can be had)."""
    want, order = share * sizes.sum(), np.argsort(-factors)
    s, f = sizes[order], factors[order]
    full = np.concatenate([[0.0], np.cumsum(s)])  # the first k cells are taken whole
    rest = (s * f)[::-1].cumsum()[::-1]
    for k in range(len(f)):
        if rest[k] <= 0:
            break
        c = (want - full[k]) / rest[k]
        if c * f[k] <= 1:
            return max(0.0, c)
    return float("inf")


def reachable(have: np.ndarray, target: np.ndarray, want: float) -> np.ndarray:
    """Tokens of each value in a sample of ``want`` tokens: in proportion to the targets, but no more than the value has."""
    factors = np.divide(target, have, out=np.zeros_like(have), where=have > 0)
    c = calibrated(have, factors, want / max(have.sum(), 1e-300))
    return np.where(factors > 0, have * np.minimum(1.0, c * np.where(factors > 0, factors, 1.0)), 0.0)


def rake_held(cells: np.ndarray, scales: np.ndarray, codes: list[np.ndarray], amounts: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = 1e-10) -> np.ndarray:
    """Scales g for which the sums of cells * min(1, g) are the amounts of every marginal.

    Cells at one or above are held at their size, those of a value taken whole throughout.  A step
    never passes an amount, as the sums are concave in the scale: from below it goes by the cells
    that are not held, from above by all but the whole ones.
    """
    g, total = scales.copy(), max(cells.sum(), 1e-300)
    for code, want in zip(codes, amounts, strict=True):
        g[(want >= np.bincount(code, cells, len(want)) * (1 - 1e-12))[code]] = WHOLE
    whole = [np.bincount(code, np.where(g == WHOLE, cells, 0.0), len(want)) for code, want in zip(codes, amounts, strict=True)]
    for _ in range(rounds):
        worst = 0.0
        for code, want, fixed in zip(codes, amounts, whole, strict=True):
            held = np.bincount(code, np.where(g >= 1, cells, 0.0), len(want))
            free = np.bincount(code, np.where(g >= 1, 0.0, cells * g), len(want))
            worst = max(worst, float(np.abs(held + free - want).max(initial=0)) / total)
            up = np.divide(want - held, free, out=np.ones_like(free), where=free > 0)
            kept = np.where(want > fixed, fixed, 0.0)
            down = np.divide(want - kept, held + free - kept, out=np.ones_like(free), where=held + free > kept)
            g = np.where(g == WHOLE, g, g * np.where(held + free < want, up, down)[code])
        if worst < tolerance:
            break
    return g


def _rake_held_table(cells: DataFrame, dims: list[str], amounts: dict[str, DataFrame], total: float, rounds: int, tolerance: float) -> tuple[DataFrame, float]:
    """The same over a table of cells with their scales ``g``, and by how much it misses; lineage is cut every round."""
    full = F.col("g") >= 1
    sums = [F.sum(F.when(full, F.col("tokens")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("g"))).alias("free")]
    sums.append(F.sum(F.when(F.col("g") == WHOLE, F.col("tokens")).otherwise(0.0)).alias("fixed"))
    have = F.col("held") + F.col("free")
    kept = F.when(F.col("want") > F.col("fixed"), F.col("fixed")).otherwise(0.0)
    factor = F.when((have < F.col("want")) & (F.col("free") > 0), (F.col("want") - F.col("held")) / F.col("free")).when((have > F.col("want")) & (have > kept), (F.col("want") - kept) / (have - kept)).otherwise(1.0)
    for d in dims:
        taken = cells.groupBy(d).agg(F.sum("tokens").alias("have")).join(amounts[d], d).where(F.col("want") >= F.col("have") * (1 - 1e-12)).select(d, F.lit(WHOLE).alias("whole"))
        cells = cells.join(taken, d, "left").withColumn("g", F.coalesce("whole", "g")).drop("whole")
    cells = staged(cells, "held")
    for _ in range(rounds):
        for d in dims:
            step = cells.groupBy(d).agg(*sums).join(amounts[d], d, "left").withColumn("want", F.coalesce("want", F.lit(0.0))).select(d, factor.alias("factor"))
            cells = cells.join(step, d).withColumn("g", F.when(F.col("g") == WHOLE, F.col("g")).otherwise(F.col("g") * F.col("factor"))).drop("factor")
        last, cells = cells, staged(cells, "held")
        release(last)
        errors = [cells.groupBy(d).agg(*sums).join(amounts[d], d).agg(F.max(F.abs(have - F.col("want")))).first()[0] or 0.0 for d in dims]
        if max(errors) < tolerance * total:
            break
    return cells, max(errors) / total


def _on_driver(rows: list, keys: list[str], targets: dict[str, dict[str, float]], power: float, share: float, tolerance: float) -> list[tuple[float, float]]:
    """Weight and probability per cell, over collected cells."""
    sizes = np.array([r["tokens"] for r in rows])
    names = {k: {v: i for i, v in enumerate(dict.fromkeys(r[k] for r in rows))} for k in keys}
    codes = [np.array([names[k][r[k]] for r in rows]) for k in keys]
    marginals = []
    for k, code in zip(keys, codes, strict=True):
        have = dict(zip(names[k], np.bincount(code, sizes).tolist(), strict=True))
        want = targets.get(k) or tempered(have, power)
        wanted = np.array([max(0.0, want.get(v, 0.0)) for v in names[k]])
        if not wanted.sum() > 0:
            return [(0.0, 0.0)] * len(rows)
        marginals.append(wanted / wanted.sum())
    w = rake(sizes, codes, marginals, tolerance=tolerance)
    factors = w / sizes * sizes.sum()
    live, c = np.where(factors > 0, sizes, 0.0), calibrated(sizes, factors, share)
    taken = np.where(factors > 0, 1.0, 0.0)
    if np.isfinite(c):  # else all that is wanted is taken whole
        amounts = [reachable(np.bincount(code, live, len(m)), m, share * sizes.sum()) for m, code in zip(marginals, codes, strict=True)]
        scales = rake_held(live, c * factors, codes, amounts, tolerance=tolerance)
        last = calibrated(sizes, scales, share)
        taken = np.minimum(taken, last * scales if np.isfinite(last) else 1.0)
        _told(max(float(np.abs(np.bincount(code, live * taken, len(a)) - a).max()) for code, a in zip(codes, amounts, strict=True)) / sizes.sum(), tolerance)
    return list(zip(factors.tolist(), taken.tolist(), strict=True))


def _as_table(cells: DataFrame, keys: list[str], targets: dict[str, dict[str, float]], power: float, share: float, tolerance: float) -> DataFrame:
    """The same over a table of cells of any size; no marginal is collected."""
    spark, marginals = cells.sparkSession, {}
    for k in keys:
        have = cells.groupBy(k).agg(F.sum("tokens").alias("have"))
        if targets.get(k):
            given = spark.createDataFrame([(v, float(x)) for v, x in targets[k].items() if x > 0], f"{k} string, target double")
            want = have.join(given, k).select(k, "target")
        else:
            want = have.select(k, F.pow("have", power).alias("target"))
        want = staged(want, "targets")
        all_of = want.agg(F.sum("target")).first()[0]
        if not all_of:
            return cells.select(*keys, F.lit(0.0).alias("mix_weight"), F.lit(0.0).alias("mix_probability"))
        marginals[k] = want.withColumn("target", F.col("target") / all_of)
    raked = _rake_table(cells, keys, marginals, ROUNDS, tolerance)
    total = raked.agg(F.sum("tokens")).first()[0]
    table = staged(raked.select(*keys, "tokens", (F.col("w") / F.col("tokens") * total).alias("mix_weight")), "factors")
    live = table.where("mix_weight > 0")
    want = min(share * total, live.agg(F.sum("tokens")).first()[0] * (1 - 1e-9))
    amounts = {}
    for k in keys:
        have = staged(live.groupBy(k).agg(F.sum("tokens").alias("have")).join(marginals[k], k).withColumn("factor", F.col("target") / F.col("have")), "marginal")
        amounts[k] = have.select(k, (F.col("have") * F.least(F.lit(1.0), _scale(have, "have", "factor", want) * F.col("factor"))).alias("want"))
    held, miss = _rake_held_table(live.withColumn("g", _scale(live, "tokens", "mix_weight", want) * F.col("mix_weight")), keys, amounts, total, ROUNDS, tolerance)
    _told(miss, tolerance)
    return held.select(*keys, "mix_weight", F.least(F.lit(1.0), _scale(held, "tokens", "g", want) * F.col("g")).alias("mix_probability"))


def mixture(
    docs: DataFrame,
    dims: list[str],
    weight: str,
    targets: dict[str, dict[str, float]] | None = None,
    power: float = 0.7,
    share: float = 0.6,
    driver_cells: int = DRIVER_CELLS,
    tolerance: float = 1e-9,
    weighed: DataFrame | None = None,
) -> DataFrame:
    """Add ``mix_weight`` (the factor of the row's cell) and ``mix_probability`` to every row.

    The weights meet the targets exactly; the probabilities meet them as far as no row is taken
    twice, at an expected size of ``share`` of all tokens (a warning tells if a marginal is missed).

    ``targets`` has shares per value of a dimension; a dimension without gets its observed shares
    to ``power``.  Shares of values that do not occur are spread over the others in proportion.
    A null in a dimension is the value "(none)", a null weight is 0.  Rows of cells that no
    target wants get weight 0.  Repeated rows count one by one; an empty table stays empty; columns
    of the two names are replaced.  ``weighed`` has the dimensions and weights of the same rows,
    where ``docs`` has no weights.  Up to ``driver_cells`` cells are raked on the driver, more as a
    table, by the same steps and stopping rules.
    """
    keys = [f"cell_{i}" for i in range(len(dims))]

    def keyed_by(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        plain = numbered_columns(df)
        own = dict(zip(df.columns, plain.columns, strict=True))
        return plain.select("*", *[F.coalesce(F.col(own[d]).cast("string"), F.lit(NONE)).alias(k) for k, d in zip(keys, dims, strict=True)]), own

    keyed, names = keyed_by(docs)
    summed, of = (keyed, names) if weighed is None else keyed_by(weighed)
    cells = staged(summed.groupBy(*keys).agg(F.sum(F.coalesce(F.col(of[weight]).cast("double"), F.lit(0.0))).alias("tokens")).where("tokens > 0"), "cells")
    wanted = {k: targets[d] for k, d in zip(keys, dims, strict=True) if (targets or {}).get(d)}
    if cells.count() <= driver_cells:
        rows = cells.collect()
        found = [(*(r[k] for k in keys), *x) for r, x in zip(rows, _on_driver(rows, keys, wanted, power, share, tolerance) if rows else [], strict=True)]
        table = docs.sparkSession.createDataFrame(found, ", ".join(f"{k} string" for k in keys) + ", mix_weight double, mix_probability double")
        joined = keyed.join(F.broadcast(table), keys, "left")
    else:
        joined = keyed.join(_as_table(cells, keys, wanted, power, share, tolerance), keys, "left")
    kept = [c for c in docs.columns if c.lower() not in ("mix_weight", "mix_probability")]
    out = joined.select(*[names[c] for c in kept], F.coalesce("mix_weight", F.lit(0.0)), F.coalesce("mix_probability", F.lit(0.0)))
    return out.toDF(*kept, "mix_weight", "mix_probability")


def drawn(key: Column, probability: Column, seed: int) -> Column:
    """Whether a row is sampled: a hash of its key, as a number in [0, 1), is below its probability.

    Rows of equal key are drawn alike, in every run and at every size.
    """
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40)) < probability


def sample_mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic_col: str | None = None,
    targets: dict[str, dict[str, float]] | None = None,
    power: float = 0.7,
    share: float = 0.6,
    seed: int = 11,
    whole_rows: bool = False,
    tokenizer: str = "word_bpe_49k.json",
    driver_cells: int = DRIVER_CELLS,
) -> DataFrame:
    """Sample documents so that their tokens meet the target shares of source, language and topic.

    Returns the sampled rows: doc_id, source, lang, topic, n_words, n_tokens, mix_weight,
    mix_probability; with ``whole_rows`` the input's own columns instead, whatever their names.  The
    topic is ``topic_col``, or without one the kind of writing (``topic_of``).  Texts are tokenised
    once, what is read again holds no texts.  A null text has no tokens and is of topic "empty"; rows
    with no tokens take the probability of their cell, or 0 if the cell has none.  Rows of equal id
    are drawn alike, null ids too; an empty table gives no rows.
    """
    plain = numbered_columns(docs)
    own = dict(zip(docs.columns, (F.col(c) for c in plain.columns), strict=True))
    text, dims = own[text_col], ["source", "lang", "topic"]
    about = [own[source_col].cast("string").alias("source"), own[lang_col].cast("string").alias("lang"), (own[topic_col].cast("string") if topic_col else topic_of(text)).alias("topic")]
    if whole_rows:
        counted = with_counts(plain.select(*about, text.alias("text")), "text", tokenizer)
        mixed = mixture(plain.select("*", *about), dims, "n_tokens", targets, power, share, driver_cells, weighed=counted)
        return mixed.where(drawn(own[id_col], F.col("mix_probability"), seed)).select(*plain.columns).toDF(*docs.columns)
    narrow = plain.select(own[id_col].cast("long").alias("doc_id"), own[id_col].alias("key"), *about, text.alias("text"))
    counted = staged(with_counts(narrow, "text", tokenizer), "tokens")
    kept = mixture(counted, dims, "n_tokens", targets, power, share, driver_cells).where(drawn(F.col("key"), F.col("mix_probability"), seed))
    return kept.select("doc_id", *dims, "n_words", "n_tokens", "mix_weight", "mix_probability")
