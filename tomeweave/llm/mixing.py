"""Mixing sources to target weights, in DataFrame functions only.

Temperature mixing: with token shares p, source s gets weight p_s^a / sum(p^a). The exponent a in
[0, 1] is bisected to the largest value whose weights reach a target entropy, and raised, again by
bisection, as far as a repetition limit asks for. Each weight times the budget is a token quota. A
quota is realised in epochs over the source; in each the source's blocks come in a permuted order and
the documents in a block too, and the last epoch ends where the quota is used up.

Documents fall into blocks of about ``block_tokens`` tokens by a hash, so sums over a source are sums
over its blocks, two window levels of bounded size, and a source with a third of all rows is spread
like any other. The final pass joins each document with its source's row and its block's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.llm._session import materialize, unused

#: Points of one round of the search, and rounds: 16**10 = 2**40 steps of bisection.
GRID, ROUNDS = 16, 10
#: Blocks a window sums over.
SUPERBLOCK = 1024
BLOCK_TOKENS = 1 << 18
_ALL = (1 << 62) - 1


def word_tokens(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _key(*parts: Column) -> Column:
    """A number below 2**60 from an MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def _search(shares: DataFrame, meets: Column) -> float:
    """Smallest exponent in [0, 1] from which ``meets`` holds; 1 if it never does. meets reads a, h, least, most."""
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (hi - lo) / GRID
        grid = F.array(*(F.lit(hi - step * (GRID - i)) for i in range(GRID + 1)))
        z = F.exp(F.col("a") * F.col("lp"))
        row = (
            shares.select("lp", F.explode(grid).alias("a"))
            .groupBy("a")
            .agg(F.sum(z).alias("z"), F.sum(z * F.col("a") * F.col("lp")).alias("e"), F.min("lp").alias("lo"), F.max("lp").alias("hi"), F.count("*").alias("n"))
            .select("a", (F.log("z") - F.col("e") / F.col("z")).alias("h"), F.log("n").alias("full"), *((F.exp((F.col("a") - 1) * F.col(x)) / F.col("z")).alias(k) for x, k in (("hi", "least"), ("lo", "most"))))
            .where(meets)
            .agg(F.min("a").alias("a"))
            .first()
        )
        if row is None or row["a"] is None:
            return 1.0
        if row["a"] <= lo:
            return lo
        hi = row["a"]
        lo = max(0.0, hi - step)
    return hi


def mix(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_repetition: float = 4.0,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 42,
    tokens: Column | None = None,
    source: str = "source",
) -> DataFrame:
    """The rows of ``docs`` as the mixture takes them, one per copy, with all their columns and ``mix_*``.

    Added: mix_epoch (0-based), mix_block, mix_block_order and mix_doc_order; sorting a source by
    (mix_epoch, mix_block_order, mix_doc_order) gives its permuted stream.

    target_entropy: share of the largest possible entropy, ln(number of sources); None: no target.
    max_repetition: no source is read more often than this on average. budget: tokens of the mixture;
    None: the smallest with which every source is read in full at least once, so no row is left out.
    A budget beyond max_repetition times the corpus is lowered to that.

    A null source is a source of its own. Sources without tokens, and so empty tables, have no weight:
    their rows are taken once. Rows with an equal doc_id in a source are taken or left together. Null
    text has no tokens, a long one is counted whole. tokens: a token count, by default that of words. Columns named like
    the added ones are replaced; other names pass through.
    """
    tokens = word_tokens(F.col("text")) if tokens is None else tokens
    src = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    id_key = _key(F.lit(str(seed)), _text(F.col("doc_id")))
    light = materialize(docs.select(src.alias("s"), _text(F.col("doc_id")).alias("i"), id_key.alias("k"), tokens.alias("n")))
    totals = materialize(light.groupBy("s").agg(F.sum("n").alias("t")))
    corpus = totals.agg(F.sum("t")).first()[0] or 0
    weighed = materialize(totals.where("t > 0").select("s", "t", F.log(F.col("t") / F.lit(float(max(corpus, 1)))).alias("lp")))

    exponent = 0.0
    if target_entropy is not None:  # the largest that reaches it is where "below the target" begins
        exponent = _search(weighed, F.col("h") < F.lit(target_entropy) * F.col("full") - F.lit(1e-12))
    rate = min(budget, max_repetition * corpus) / max(corpus, 1) if budget is not None else None
    most = F.col("most") * F.lit(rate) if rate is not None else F.col("most") / F.col("least")
    exponent = max(exponent, _search(weighed, most <= F.lit(max_repetition * (1 + 1e-9))))

    z = F.sum(F.exp(F.lit(exponent) * F.col("lp")))
    scale = weighed.agg(z.alias("z"), F.max("lp").alias("hi")).first()
    if scale["z"] is None:
        per_token = 0.0
    elif rate is not None:
        per_token = rate * corpus / scale["z"]
    else:  # weight * budget = tokens for the largest source
        import math

        per_token = corpus * math.exp((1 - exponent) * scale["hi"])
    quota = F.round(F.exp(F.lit(exponent) * F.col("lp")) * F.lit(per_token)).cast("bigint")
    plan = materialize(
        weighed.withColumn("q", quota)
        .select("s", "t", F.expr("q div t").alias("epochs"), F.expr("q % t").alias("rest"), F.ceil(F.col("t") / F.lit(block_tokens)).cast("bigint").alias("blocks"))
        .unionByName(totals.where("t = 0").select("s", "t", F.lit(1).cast("bigint").alias("epochs"), F.lit(0).cast("bigint").alias("rest"), F.lit(1).cast("bigint").alias("blocks")))
    )

    # blocks of the last, partial epoch, in its order
    blocked = light.join(plan.where("rest > 0"), "s").withColumn("b", F.expr("k % blocks"))
    sums = blocked.groupBy("s", "b", "epochs", "rest", "blocks").agg(F.sum("n").alias("n"))
    order = _key(F.lit(str(seed)), F.col("epochs").cast("string"), F.col("s"), F.col("b").cast("string"))
    sums = materialize(sums.withColumn("o", order).withColumn("super", F.col("o") % F.ceil(F.col("blocks") / F.lit(SUPERBLOCK)).cast("bigint")))
    supers = sums.groupBy("s", "super").agg(F.sum("n").alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    supers = supers.select("s", "super", zero(F.sum("n").over(before.partitionBy("s").orderBy("super"))).alias("base"))
    placed = sums.withColumn("start", zero(F.sum("n").over(before.partitionBy("s", "super").orderBy("o", "b")))).join(supers, ["s", "super"])
    placed = materialize(placed.select("s", "b", "rest", (F.col("start") + F.col("base")).alias("start"), (F.col("start") + F.col("base") + F.col("n")).alias("end")).where("start < rest"))
    edge = placed.where("end > rest").select("s", "b", "rest", "start")  # one block a source at most
    keyed = blocked.join(edge.select("s", "b", "start"), ["s", "b"])
    doc_order = _key(F.lit(str(seed)), F.col("epochs").cast("string"), F.col("i"))
    ranked = keyed.groupBy("s", "b", "rest", "start", doc_order.alias("o")).agg(F.sum("n").alias("n"))
    upto = ranked.withColumn("at", F.col("start") + zero(F.sum("n").over(before.partitionBy("s", "b").orderBy("o")))).where("at < rest")
    cut = upto.groupBy("s", "b").agg(F.max("o").alias("cut"))
    last = materialize(placed.where("end <= rest").select("s", "b", F.lit(_ALL).cast("bigint").alias("cut")).unionByName(cut.select("s", "b", "cut")))

    made = ("mix_epoch", "mix_block", "mix_block_order", "mix_doc_order")
    own_names = ("s", "b", "cut", "epochs", "blocks")
    names = dict(zip(own_names, unused(docs, *(f"mix_{c}" for c in own_names)), strict=True))
    docs = docs.drop(*(c for c in docs.columns if c.lower() in made))
    per_source = plan.select(F.col("s").alias(names["s"]), F.col("epochs").alias(names["epochs"]), F.col("blocks").alias(names["blocks"]))
    per_block = last.select(F.col("s").alias(names["s"]), F.col("b").alias(names["b"]), F.col("cut").alias(names["cut"]))
    rows = docs.withColumn(names["s"], src).join(per_source, names["s"]).withColumn(names["b"], id_key % F.col(names["blocks"]))
    rows = rows.join(per_block, [names["s"], names["b"]], "left")
    own = lambda epoch: _key(F.lit(str(seed)), epoch.cast("string"), _text(F.col("doc_id")))
    copies = F.col(names["epochs"]) + F.when(own(F.col(names["epochs"])) <= F.coalesce(F.col(names["cut"]), F.lit(-1)), 1).otherwise(0)
    rows = rows.withColumn("mix_epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(0).cast("bigint"), copies - 1)).otherwise(F.array().cast("array<bigint>"))))
    return rows.withColumns(
        {
            "mix_block": F.col(names["b"]),
            "mix_block_order": _key(F.lit(str(seed)), F.col("mix_epoch").cast("string"), F.col(names["s"]), F.col(names["b"]).cast("string")),
            "mix_doc_order": own(F.col("mix_epoch")),
        }
    ).select(*(F.col(f"`{c}`") for c in docs.columns), *made)
