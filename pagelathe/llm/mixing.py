"""Mixing sources to target shares of tokens, with small sources repeated at most so often.

Shares come from one temperature family: p(a) is in proportion to target^(1-a) * s^a, where s is a source's share
of all tokens, each counted as often as it may be used.  At a = 0 these are the targets, at a = 1 every source is
used up to its limit, so that any budget the limits allow is met.  The exponent is bisected to the least one at
which the budget, all tokens if none is given, repeats no source above its limit; or, over the natural token
shares alone (s^a), to the entropy of the targets.  The tokens of each source are then realised as
permutations of its documents in blocks: whole passes over all of them, and one budgeted part of a pass that
ends in a single block.  Each pass has its own order of blocks and of documents within them.

All sums are map-side aggregates; what reaches one task is a row a source (``MOST_SOURCES`` at most) or a row a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.llm.bpe import byte_pairs
from pagelathe.session import cut, public_path, spread

#: Documents a block of the permutation holds about.
BLOCK_DOCS = 20_000
STEPS = 60
#: Sources beyond this number are an error: a row each goes to the driver.
MOST_SOURCES = 100_000


def source_name(column):
    """Spellings of a source brought together; blank and null are one unnamed source."""
    return F.coalesce(F.nullif(F.lower(F.trim(F.regexp_replace(column, r"[\s ]+", " "))), F.lit("")), F.lit("(none)"))


def temperature(targets: list[float], tokens: list[float], exponent: float) -> list[float]:
    """Normalised target^(1-a) * tokens^a; 0 where either is 0."""
    raw = [math.exp((1 - exponent) * math.log(t) + exponent * math.log(c)) if t > 0 and c > 0 else 0.0 for t, c in zip(targets, tokens)]
    whole = sum(raw)
    return [r / whole if whole else 0.0 for r in raw]


def entropy(shares: list[float]) -> float:
    return -sum(p * math.log(p) for p in shares if p > 0)


def exponent_for_caps(targets: list[float], capacity: list[float], budget: float) -> float:
    """The least exponent at which ``budget`` tokens stay within every capacity (1 if none does)."""

    def fits(a: float) -> bool:
        return all(budget * p <= c * (1 + 1e-12) for p, c in zip(temperature(targets, capacity, a), capacity))

    if fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


def exponent_for_entropy(tokens: list[float], wanted: float) -> float:
    """The exponent in [0, 1] at which token shares raised to it have an entropy, or come nearest to it; the entropy falls with it."""
    even = [1.0 if t > 0 else 0.0 for t in tokens]
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(temperature(even, tokens, middle)) > wanted else (low, middle)
    return (low + high) / 2


def within(weights: list[float], capacity: list[float], budget: float) -> list[float]:
    """Tokens a source: ``budget`` by weight, none above its capacity; what a full source leaves goes to the others by weight."""
    out, open_ = [0.0] * len(weights), {i for i, w in enumerate(weights) if w > 0}
    left = min(budget, sum(capacity[i] for i in open_))
    while open_:
        whole = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / whole >= capacity[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = capacity[i]
        left -= sum(capacity[i] for i in full)
        open_ -= full
    return out


def full_budget(targets: list[float], capacity: list[float]) -> float:
    """The most tokens at which every present source still meets its target share within its repeats."""
    whole = sum(t for t, c in zip(targets, capacity) if t > 0 and c > 0)
    return min((c * whole / t for t, c in zip(targets, capacity) if t > 0 and c > 0), default=0.0)


ALL, LARGEST = "all", "largest"


def mix(documents: DataFrame, targets: DataFrame, *, budget: float | str = ALL, by: str = "limit", block_docs: int = BLOCK_DOCS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, source, n_tokens, times, block``, report a source).

    ``budget`` is a number of tokens, ``ALL`` for as many as the sources with a target hold, or ``LARGEST`` for the
    most at which every present source meets its target within its repeats.  ``by`` is "limit" (the exponent keeps
    to the repetition limits) or "entropy" (token shares with the entropy of the targets; a source that would pass
    its limit leaves the rest to the others).

    Null and blank sources are one source without a target; documents of sources without a target, and documents
    without tokens, are used 0 times; a source without documents is reported with nothing used.  The
    order of a source's documents is that of a hash of doc_id; rows that repeat a doc_id are ordered as
    one and used alike.  Empty tables give empty results.
    """
    return _realise(cut(sized(documents, seed)), targets, budget, by, block_docs)


def sized(documents: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, source, n_tokens, key``: one map over the documents, the source carried along with the count."""
    path = public_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(path)
        for b in batches:
            counts = pa.array([coder.count(t) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), counts], ["doc_id", "source", "n_tokens"])

    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), F.col("text").cast("string").alias("text"))
    return spread(named).mapInArrow(run, "doc_id long, source string, n_tokens long").withColumn("key", F.xxhash64("doc_id", F.lit(seed)))


def _realise(sizes: DataFrame, targets: DataFrame, budget: float | str, by: str, block_docs: int) -> tuple[DataFrame, DataFrame]:
    spark = sizes.sparkSession
    have = {r["source"]: r for r in _rows_a_source(sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")))}
    summed = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("repeats"))
    want = {r["source"]: (r["share"], r["repeats"]) for r in _rows_a_source(summed)}
    names = sorted(set(have) | set(want))
    docs = [have[n]["docs"] if n in have else 0 for n in names]
    tokens = [int(have[n]["tokens"] or 0) if n in have else 0 for n in names]
    share = [float(want[n][0]) if n in want else 0.0 for n in names]
    repeats = [int(want[n][1]) if n in want else 0 for n in names]
    capacity = [float(t * r) if s > 0 else 0.0 for t, r, s in zip(tokens, repeats, share)]
    usable = [float(t) if c > 0 else 0.0 for t, c in zip(tokens, capacity)]
    size = sum(usable) if budget == ALL else full_budget(share, capacity) if budget == LARGEST else min(float(budget), sum(capacity))
    if by == "entropy":
        present = sum(s for s, u in zip(share, usable) if u > 0) or 1.0
        exponent = exponent_for_entropy(usable, entropy([s / present for s, u in zip(share, usable) if u > 0]))
        weights = temperature([1.0] * len(names), usable, exponent)
    else:
        exponent = exponent_for_caps(share, capacity, size)
        weights = temperature(share, capacity, exponent)
    per_source = within(weights, capacity, size)
    passes = [int(q // t) if t else 0 for q, t in zip(per_source, tokens)]
    rest = [q - p * t for q, p, t in zip(per_source, passes, tokens)]
    blocks = [max(1, math.ceil(d / block_docs)) for d in docs]
    natural = [t / max(1, sum(tokens)) for t in tokens]
    fixed = spark.createDataFrame(
        list(zip(names, docs, tokens, natural, share, repeats, weights, passes, [float(r) for r in rest], blocks)),
        "source string, docs long, tokens long, token_share double, target_share double, max_repeats int, weight double, passes long, rest double, blocks int",
    )
    placed = sizes.join(fixed.select("source", "passes", "rest", "blocks"), "source").withColumn("block", F.pmod("key", "blocks"))
    # where each block begins in the permutation: a window over one row a block
    sums = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    begin = sums.select("source", "block", (F.sum("block_tokens").over(Window.partitionBy("source").orderBy("block")) - F.col("block_tokens")).alias("begin"), "block_tokens")
    placed = placed.join(begin, ["source", "block"])
    whole = placed.where((F.col("begin") + F.col("block_tokens") <= F.col("rest")) | (F.col("begin") >= F.col("rest"))).withColumn("more", (F.col("begin") < F.col("rest")).cast("int"))
    inside = Window.partitionBy("source", "block").orderBy("key", "doc_id")  # repeated rows are peers of the range frame
    split = placed.where((F.col("begin") < F.col("rest")) & (F.col("begin") + F.col("block_tokens") > F.col("rest")))
    split = split.withColumn("more", (F.col("begin") + F.sum("n_tokens").over(inside) <= F.col("rest")).cast("int"))
    plan = whole.unionByName(split).select("doc_id", "source", "n_tokens", F.when(F.col("n_tokens") > 0, F.col("passes") + F.col("more")).otherwise(0).cast("int").alias("times"), F.col("block").cast("int").alias("block"))
    used = plan.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("used_tokens"), F.max("times").alias("most_repeats"), F.sum((F.col("times") > 0).cast("long")).alias("used_docs"))
    everything = Window.partitionBy()  # a row a source
    report = (
        fixed.join(used, "source", "left")
        .select(
            "source", "docs", "tokens", "token_share", "target_share", "max_repeats", "weight",
            F.coalesce("used_docs", F.lit(0)).alias("used_docs"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        )
        .withColumn("reached_share", F.col("used_tokens") / F.nullif(F.sum("used_tokens").over(everything), F.lit(0)))
        .withColumn("exponent", F.lit(exponent))
    )
    return plan, report


def _rows_a_source(df: DataFrame) -> list:
    rows = df.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return rows


def permutation(plan: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, source, n_tokens, pass, block, position``: a row for each use of a document.

    A source's mixture is read pass by pass, its blocks in the order of a hash of (seed, pass, block), and
    each block by position, which is by a hash of (seed, pass, doc_id).  A window holds one block of one pass.
    """
    used = plan.where(F.col("times") > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    inside = Window.partitionBy("source", "block", "pass").orderBy(F.xxhash64(F.lit(seed), "pass", "doc_id"), "doc_id")
    return used.select("doc_id", "source", "n_tokens", "pass", "block", (F.row_number().over(inside) - 1).alias("position"))


def p7_shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares reached a source when the mixture has as many tokens as the sources with a target: the exponent gives way to the limits."""
    return mix(documents, targets)[1]


def p7_shares_entropy(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares reached when token shares are flattened to the entropy of the targets."""
    return mix(documents, targets, by="entropy")[1]


def p7_shares_exact(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares reached at the largest mixture that meets every target within the limits; its exponent is 0 by construction."""
    return mix(documents, targets, budget=LARGEST)[1]


def p7_plan(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """The mixture of ``p7_shares``, a row a use."""
    return permutation(mix(documents, targets)[0])
