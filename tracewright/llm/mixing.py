"""Documents of several sources mixed to target shares of all tokens.

The weights are either the target shares (``weights="targets"``) or a temperature (``"temperature"``): token shares raised
to an exponent that is bisected to meet the entropy of the targets and the limits on repeats. A source that would need more repeats than it may have is held at its limit,
and the scale of the rest is found by bisection so that the whole keeps its planned size.

A budget is realised as whole epochs of the source and one part of an epoch, drawn in the order of keyed
block permutations: documents fall into blocks by a keyed hash, each epoch orders the blocks and the documents within
them by keys of its own, and the part takes every document along that order that still fits into what is left. Sums run over blocks
first, so no source is ever in one task.

Defined results: sources are compared without case and outer blanks; null, blank and untargeted sources give
nothing and are reported with a target of 0; targets without documents are reported with 0 tokens; null or
negative shares count as 0, null repeats as 1; documents without tokens are left out; equal rows are one document each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.tokens import DEFAULT, with_sizes
from tracewright.sources.tables import clean_key, settled

#: Documents planned for one block.
BLOCK = 20_000


def entropy(weights: dict[str, float]) -> float:
    total = sum(weights.values()) or 1.0
    return -sum(w / total * math.log(w / total) for w in weights.values() if w > 0)


def _heated(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    total = sum(tokens.values()) or 1
    raised = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    whole = sum(raised.values()) or 1.0
    return {s: w / whole for s, w in raised.items()}


def temperature_weights(tokens: dict[str, int], budget: float, target_entropy: float | None = None, repeats: dict[str, int] | None = None) -> tuple[float, dict[str, float]]:
    """(exponent, weights) proportional to the token shares raised to the exponent.

    Entropy falls as the exponent rises from 0 (all alike) to 1 (as found) and beyond; it is bisected to the target. With
    ``repeats`` the exponent is the least from there up to 1 that asks no source for more than its tokens times its repeats.
    """

    def bisect(low: float, high: float, low_is_right) -> float:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if low_is_right(mid) else (mid, high)
        return high

    exponent = 0.0 if target_entropy is None else bisect(0.0, 8.0, lambda a: entropy(_heated(tokens, a)) <= target_entropy)
    if repeats is not None:
        fits = lambda a: all(w * budget <= tokens[s] * repeats.get(s, 1) + 1e-6 for s, w in _heated(tokens, a).items())
        if not fits(exponent) and exponent < 1:
            exponent = bisect(exponent, 1.0, fits)
    return exponent, _heated(tokens, exponent)


def budgets(tokens: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: int) -> dict[str, float]:
    """Tokens asked of each source: its share of ``total``, limited sources at their limit, the rest scaled up by bisection."""
    limit = {s: tokens.get(s, 0) * max(0, repeats.get(s, 1)) for s in shares}
    goal = min(total, sum(limit[s] for s in shares if shares[s] > 0))
    asked = lambda scale: {s: min(limit[s], shares[s] * scale) for s in shares}
    low, high = 0.0, 1.0
    while sum(asked(high).values()) < goal - 1e-6 and high < 1e30:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(asked(mid).values()) >= goal else (mid, high)
    return asked(high)


def _key(seed: str, *columns: str | Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def realise(sizes: DataFrame, wanted: dict[str, float], tokens: dict[str, int], documents: dict[str, int], seed: str) -> DataFrame:
    """(source, doc_id, repeat_no, block_no, n_tokens) of the mix; ``sizes`` has (doc_id, source, n_tokens) and is settled."""
    plan = []
    for s, want in wanted.items():
        have = tokens.get(s, 0)
        whole = int(want // have) if have else 0
        plan.append((s, whole, float(want - whole * have), max(1, documents.get(s, 0) // BLOCK + 1)))
    # One row for each target source.
    table = F.broadcast(sizes.sparkSession.createDataFrame(plan or [("", 0, 0.0, 1)], "source string, whole int, rest double, blocks int"))
    d = sizes.join(table, "source").withColumn("block", F.pmod(_key(seed, "source", "doc_id"), F.col("blocks")))
    epochs = d.select("source", "doc_id", "block", "n_tokens", F.explode(F.expr("sequence(0, whole)")).alias("repeat_no"), "whole", "rest")
    full = epochs.where("repeat_no < whole").drop("whole", "rest")
    part = epochs.where("repeat_no = whole and rest >= 1")
    at_block = _key(seed, "source", "repeat_no", F.concat(F.lit("b"), F.col("block")))
    kept = ["source", "doc_id", "block", "n_tokens", "repeat_no"]
    inside = Window.partitionBy("source", "block").orderBy(_key(seed, "repeat_no", "doc_id"), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("source").orderBy("k", "block").rowsBetween(Window.unboundedPreceding, -1)
    left = part.where("n_tokens <= rest").select(*kept, "rest")
    taken: DataFrame | None = None
    while True:
        # Along the order up to the first text that is too long; then again what is left, without the texts longer than the rest.
        per_block = left.groupBy("source", "repeat_no", "block").agg(F.sum("n_tokens").alias("t")).withColumn("k", _key(seed, "source", "repeat_no", F.concat(F.lit("b"), F.col("block"))))
        starts = per_block.withColumn("start", F.coalesce(F.sum("t").over(before), F.lit(0))).select("source", "block", "start")
        cut = settled(left.join(starts, ["source", "block"]).withColumn("upto", F.col("start") + F.sum("n_tokens").over(inside)))
        fits = cut.where("upto <= rest").select(*kept)
        taken = fits if taken is None else taken.unionByName(fits)
        # One row for each target source.
        spent = cut.groupBy("source").agg(F.coalesce(F.sum(F.when(F.col("upto") <= F.col("rest"), F.col("n_tokens"))), F.lit(0)).alias("spent"))
        left = cut.where("upto > rest").drop("start", "upto").join(F.broadcast(spent), "source").withColumn("rest", F.col("rest") - F.col("spent")).where("n_tokens <= rest").select(*kept, "rest")
        if left.isEmpty():
            break
    out = full.unionByName(taken)
    return out.select("source", "doc_id", F.col("repeat_no").cast("bigint").alias("repeat_no"), F.col("block").cast("bigint").alias("block_no"), "n_tokens", _key(seed, "repeat_no", "block", "doc_id").alias("order_key"))


def _targets(targets: DataFrame) -> tuple[dict[str, float], dict[str, int]]:
    shares: dict[str, float] = {}
    repeats: dict[str, int] = {}
    for r in targets.select(clean_key("source").alias("source"), "target_share", "max_repeats").where("source is not null").collect():
        shares[r[0]] = shares.get(r[0], 0.0) + max(0.0, r[1] or 0.0)
        repeats[r[0]] = max(repeats.get(r[0], 0), 1 if r[2] is None else r[2])
    return shares, repeats


def _sized(documents: DataFrame, tokenizer: str) -> tuple[DataFrame, dict[str, int], dict[str, int]]:
    sizes = settled(with_sizes(documents.withColumn("source", clean_key("source")), tokenizer))
    per = sizes.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    return sizes, {r["source"]: r["t"] for r in per}, {r["source"]: r["n"] for r in per}


def mixed(documents: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = DEFAULT, seed: str = "mix", weights: str = "targets") -> tuple[DataFrame, DataFrame]:
    """(the mix, the shares). total: tokens of the mix; by default as many as the targeted sources have. weights: see above.

    Shares: source, target_share, available_tokens, max_repeats, mixed_tokens, actual_share, most_repeats, limited.
    """
    sizes, tokens, counts = _sized(documents, tokenizer)
    shares, repeats = _targets(targets)
    total = total or sum(tokens.get(s, 0) for s in shares)
    if weights == "temperature":
        own = {s: tokens.get(s, 0) for s in shares}
        shares = temperature_weights(own, total, entropy({s: w for s, w in shares.items() if own[s]}), repeats)[1]
    elif weights != "targets":
        raise ValueError(weights)
    wanted = budgets(tokens, shares, repeats, total)
    mix = realise(sizes.where("n_tokens > 0 and source is not null"), wanted, tokens, counts, seed)
    facts = [(s, shares.get(s, 0.0), tokens.get(s, 0), repeats.get(s, 0), bool(s in wanted and wanted[s] >= tokens.get(s, 0) * repeats.get(s, 1) - 1e-6)) for s in sorted({*shares, *tokens} - {None})]
    table = documents.sparkSession.createDataFrame(facts or [("", 0.0, 0, 0, False)], "source string, target_share double, available_tokens bigint, max_repeats int, limited boolean")
    got = mix.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), (F.max("repeat_no") + 1).alias("most_repeats"))
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))
    out = table.join(got, "source", "left").na.fill(0, ["mixed_tokens", "most_repeats"])
    return mix, out.withColumn("actual_share", F.coalesce(F.round(F.col("mixed_tokens") / F.nullif(whole, F.lit(0)), 6), F.lit(0.0)))


def temperatures(documents: DataFrame, targets: DataFrame, tokenizer: str = DEFAULT) -> DataFrame:
    """Per source of the targets: token share, and weights at the temperature that has the targets' entropy, with and without the limits."""
    _, tokens, _ = _sized(documents, tokenizer)
    shares, repeats = _targets(targets)
    own = {s: tokens.get(s, 0) for s in shares}
    total = sum(own.values()) or 1
    goal = entropy({s: w for s, w in shares.items() if own[s]})
    free = temperature_weights(own, total, goal)
    held = temperature_weights(own, total, goal, repeats)
    rows = [(s, own[s] / total, shares[s], free[0], free[1][s], held[0], held[1][s]) for s in sorted(shares)]
    return documents.sparkSession.createDataFrame(rows or [("", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "source string, token_share double, target_share double, exponent double, weight double, limited_exponent double, limited_weight double")


def checked(mix: DataFrame, targets: DataFrame, documents: DataFrame) -> DataFrame:
    """Per target source: its limit, the documents used more often than that, and those used that are none of its own."""
    limits = targets.select(clean_key("source").alias("source"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).where("source is not null").groupBy("source").agg(F.max("max_repeats").alias("max_repeats"))
    used = mix.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    own = documents.select("doc_id", clean_key("source").alias("own")).distinct()
    seen = used.join(own, "doc_id", "left").join(F.broadcast(limits), "source").groupBy("source").agg(F.count_if(F.col("times") > F.col("max_repeats")).alias("over_repeated"), F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("foreign_documents"))
    return limits.join(seen, "source", "left").na.fill(0, ["over_repeated", "foreign_documents"])
