"""Mixing sources to target weights.

Temperature mixing raises source token shares to an exponent between 0
(uniform) and 1 (natural).  The exponent is bisected until the weights meet a
target entropy or a limit on repetition.  The weights, times a token budget,
are realised as block permutations: a source's documents lie in blocks, every
epoch visits the blocks in an order of its own and the documents of a block in
an order of their own, until the source's share of the budget is spent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm._text import shared_dir

STEPS = 40  # halvings of the exponent's interval
AT_ONCE = 4  # of which one pass over the sources decides so many
ROWS_PER_BLOCK = 4096


def word_tokens(text_col: str = "text") -> Column:
    """Words of a text (1 at least): a cheap stand-in for its tokens."""
    return F.greatest(F.expr(rf"regexp_count(coalesce(`{text_col}`, ''), '[^\\x20\\x09-\\x0D]+')").cast("bigint"), F.lit(1))


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string"), F.lit("")) for p in parts]))


def exponent(totals: DataFrame, budget: int | None, max_epochs: float | None, target_entropy: float | None) -> float:
    """Bisects the exponent over ``source, tokens`` rows.

    With ``max_epochs``: the smallest exponent at which no source repeats more
    often.  With ``target_entropy`` (a share of the logarithm of the number of
    sources): the largest exponent whose weights have at least that entropy.
    Sources are never collected: a pass evaluates all midpoints that the next
    halvings can reach in one aggregate over the sources.
    """
    if (max_epochs is None) == (target_entropy is None):
        raise ValueError("give either max_epochs or target_entropy")
    whole = totals.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not whole["t"]:
        return 1.0
    shares = totals.filter("tokens > 0").select((F.col("tokens") / F.lit(float(whole["t"]))).alias("p"))
    low, high = 0.0, 1.0
    for _ in range(STEPS // AT_ONCE):
        width = (high - low) / (1 << AT_ONCE)
        points = [low + width * i for i in range(1, 1 << AT_ONCE)]
        columns = []
        for i, x in enumerate(points):
            power = F.pow("p", F.lit(x))
            if max_epochs is not None:
                more = F.pow("p", F.lit(x - 1.0))
                per_epoch = F.max(more) / F.min(more) if budget is None else F.max(more) / F.sum(power) * F.lit(budget / whole["t"])
                columns.append((per_epoch <= F.lit(float(max_epochs))).alias(f"c{i}"))  # true from some point on
            else:
                z = F.sum(power)
                entropy = F.log(z) - F.lit(x) * F.sum(power * F.log("p")) / z
                columns.append((entropy < F.lit(target_entropy) * F.log(F.lit(float(whole["n"])))).alias(f"c{i}"))
        enough = list(shares.agg(*columns).first())
        first = enough.index(True) if True in enough else len(points)
        low, high = low + width * first, low + width * (first + 1)
    return high if max_epochs is not None else low


def mix(
    docs: DataFrame, tokens: Column, source_col: str = "source", id_col: str = "doc_id", budget: int | None = None, max_epochs: float | None = 2.0,
    target_entropy: float | None = None, rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Rows of ``docs`` with ``_tokens, _epoch, _start``, once for every epoch
    in which the mixture shows them.  ``_start`` is a row's place, in tokens,
    in its source's stream; the stream stops when it reaches the source's share
    of ``budget``, so a source overshoots by less than one document.

    Without a budget it is the smallest that shows every row at least once.
    Rows without a source form a source; rows without an id have an equal
    place in the permutation.  ``tokens`` must be 1 at least.  Columns of
    ``docs`` may have any names but those three.
    """
    spark = docs.sparkSession
    place = shared_dir(spark, "mixing")
    name, row_id = F.col(f"`{source_col}`"), F.col(f"`{id_col}`")
    key = F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), name.cast("string")))
    word = F.conv(F.substring(_hash(row_id), 1, 8), 16, 10).cast("bigint")
    docs.select(key.alias("_key"), word.alias("_word"), tokens.alias("_tokens")).write.parquet(f"{place}/rows")
    rows = spark.read.parquet(f"{place}/rows")
    rows.groupBy("_key").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("rows")).write.parquet(f"{place}/totals")
    totals = spark.read.parquet(f"{place}/totals")
    x = exponent(totals, budget, max_epochs, target_entropy)
    whole = totals.agg(F.sum("tokens").alias("t")).select(F.col("t").cast("double"))
    share = F.col("tokens") / F.lit(float(whole.first()[0] or 1))
    norm = totals.agg(F.sum(F.pow(share, F.lit(x))).alias("z"), F.min(F.pow(share, F.lit(x - 1.0))).alias("least"), F.sum("tokens").alias("t")).first()
    total = norm["t"] or 0
    spend = float(budget) if budget is not None else (total * norm["z"] / norm["least"] if total else 0.0)
    plan = totals.select(
        "_key", "tokens", F.round(F.lit(spend) * F.pow(share, F.lit(x)) / F.lit(norm["z"] or 1.0)).cast("bigint").alias("quota"),
        F.greatest(F.lit(1), F.ceil(F.col("rows") / rows_per_block)).cast("bigint").alias("blocks"),
    )
    # Place of every block in every epoch that its source's quota reaches.
    sums = rows.join(plan.select("_key", "blocks"), "_key").groupBy("_key", (F.col("_word") % F.col("blocks")).alias("_block")).agg(F.sum("_tokens").alias("held"))
    epochs = plan.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("quota") / F.col("tokens")).cast("int") - 1))))
    order = Window.partitionBy("_key", "_epoch").orderBy(_hash("_key", "_epoch", "_block"), "_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.join(epochs, "_key").withColumn("_at", F.col("tokens") * F.col("_epoch") + F.coalesce(F.sum("held").over(order), F.lit(0)))
    placed.filter("_at < quota").select("_key", "_block", "_epoch", "_at", "quota", "blocks").write.parquet(f"{place}/blocks")
    placed = spark.read.parquet(f"{place}/blocks")
    # Rows meet the blocks' places; a block has about rows_per_block rows, so no key is hot.
    spread = placed.select("_key", "blocks").distinct()
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # whatever names the columns have
    marked = docs.select(packed, row_id.alias("_id"), key.alias("_key"), word.alias("_word"), tokens.alias("_tokens")).join(F.broadcast(spread) if plan.count() <= 10_000 else spread, "_key")
    marked = marked.withColumn("_block", F.col("_word") % F.col("blocks")).drop("blocks")
    met = marked.join(placed.drop("blocks"), ["_key", "_block"])
    inner = Window.partitionBy("_key", "_block", "_epoch").orderBy(_hash("_id", "_epoch"), "_id", "_tokens").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("_start", F.col("_at") + F.coalesce(F.sum("_tokens").over(inner), F.lit(0)))
    return met.filter(F.col("_start") < F.col("quota")).select("_row.*", "_tokens", "_epoch", "_start")


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``doc_id, source, n_tokens, epoch, start`` of a mixture (see ``mix``),
    with words for tokens."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_tokens(text_col).alias("n_tokens"))
    out = mix(narrow, F.col("n_tokens"), **options)
    return out.select("doc_id", "source", "n_tokens", F.col("_epoch").cast("int").alias("epoch"), F.col("_start").alias("start"))


def weights(docs: DataFrame, text_col: str = "text", source_col: str = "source", budget: int | None = None, max_epochs: float | None = 2.0, target_entropy: float | None = None) -> DataFrame:
    """``source, tokens, share, weight`` of the mixture, one row for each source."""
    totals = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.sum(word_tokens(text_col)).alias("tokens"))
    x = exponent(totals.withColumnRenamed("source", "_key"), budget, max_epochs, target_entropy)
    whole = Window.partitionBy()
    p = totals.withColumn("share", F.col("tokens") / F.sum("tokens").over(whole)).withColumn("_p", F.pow("share", F.lit(x)))
    return p.select("source", "tokens", "share", (F.col("_p") / F.sum("_p").over(whole)).alias("weight"))
