"""A Katz backoff model kept as partitioned tables, and new texts scored from them.

:func:`fit` counts the n-grams of the training rows and writes three tables
under one path, each partitioned by order:

* ``grams``: (context, word, count, p), p the discounted probability of a word seen after a context;
* ``contexts``: (context, weight), the exactly normalised backoff weight of a context;
* ``levels``: one row per order with its totals, Good-Turing factors and the probability of an unseen word.

:func:`score` reads them and evaluates texts recursively: an n-gram that the
table of its order holds has its stored probability; only the others go one
order down, and take that probability times the weight of their context.

A context is its words, joined by spaces, so nothing is told apart by a hash.
An n-gram seen in training has been seen at every lower order too, so the
mass its lower orders give to the words after a context is one join with the
table just written. Counts are combined map-side before every shuffle. The
tables are range-partitioned by context and word and sorted: a context with a
third of all n-grams is many files, and a filter on contexts reads few. Joins
carry only distinct n-grams; adaptive skew splitting deals out what a
frequent word or context still holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from botlog.llm import common
from botlog.llm.katz import CUTOFF, Level

#: What ends a text and what stands before it; no word holds white space.
END, START = "\n", "\t"
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text_col: str) -> Column:
    """Lower-cased words of a text and its end (null and empty: the end alone)."""
    lower = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), _AZ, _AZ.lower())
    return F.concat(F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.array(F.lit(END)))


def _grams(words: Column, order: int) -> Column:
    """One (context, word) per token; near the start of a text the context is what there is, after START."""
    padded = F.concat(F.array(F.lit(START)), words)

    def gram(word: Column, i: Column) -> Column:
        first = F.greatest(i + 2 - order, F.lit(0))
        context = F.array_join(F.slice(padded, first + 1, i + 1 - first), " ") if order > 1 else F.lit("")
        return F.struct(context.alias("context"), word.alias("word"))

    return F.transform(words, gram)


def _shorter(order: int) -> Column:
    """The context one order lower."""
    parts = F.split("context", " ", -1)
    return F.when(F.size(parts) == order - 1, F.array_join(F.slice(parts, 2, order), " ")).otherwise(F.col("context"))


def _store(df: DataFrame, path: str, name: str, order: int, *keys: str) -> DataFrame:
    spark, path = df.sparkSession, f"{path}/{name}/order={order}"
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fit(docs: DataFrame, path: str, order: int = 2, held: str = "false", text_col: str = "text") -> None:
    """Writes the model of the rows of ``docs`` outside the SQL condition
    ``held`` to ``path``, a folder that all executors see; a model there is replaced.

    Null and empty texts are their end alone; long texts are read whole;
    repeated rows count as often as they stand. A condition that is null holds
    no row back. Other columns are read only by ``held``. Without any
    training row the tables are empty and every token has probability one."""
    spark = docs.sparkSession
    words = docs.where(~F.coalesce(F.expr(held), F.lit(False))).select(_words(text_col).alias("w"))
    words = common.written(words, "katz-words")
    levels, lower = [], None
    for k in range(1, order + 1):
        counted = common.written(words.select(F.explode(_grams(F.col("w"), k)).alias("g")).groupBy("g.context", "g.word")
                                 .agg(F.count(F.lit(1)).alias("count")), f"katz-counts-{k}")
        once = [F.count(F.when(F.col("count") == r, 1)) for r in range(1, CUTOFF + 2)]
        sums = counted.agg(*once, F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
        level = Level(list(sums), {})
        factors = F.array(*[F.lit(float(x)) for x in level.factor[1:]])
        kept = F.when(F.col("count") <= CUTOFF, F.element_at(factors, F.least("count", F.lit(CUTOFF)).cast("int")) * F.col("count"))
        kept = F.coalesce(kept, F.col("count").cast("double"))
        unseen = 1.0
        if k == 1:
            n, v = level.tokens, level.types
            mass = sum(r * (1 - float(level.factor[r])) * level.once[r - 1] for r in range(1, CUTOFF + 1))
            unseen = mass / n if n else 1.0
            p = kept / max(n, 1.0)
            if unseen <= 0:  # nothing discounted: additive smoothing
                unseen, p = 0.5 / (n + 0.5 * (v + 1)), (F.col("count") + 0.5) / (n + 0.5 * (v + 1))
            lower = _store(counted.withColumn("p", p), path, "grams", 1, "context", "word")
        else:
            # Keys are renamed: both sides of the joins descend from the same words.
            below = lower.select(F.col("context").alias("_c"), F.col("word").alias("_w"), F.col("p").alias("_p"))
            mass = (counted.join(below, (_shorter(k) == F.col("_c")) & (F.col("word") == F.col("_w")))
                    .groupBy("context").agg(F.sum("count").cast("double").alias("n"), F.sum(kept).alias("kept"), F.sum("_p").alias("seen")))
            # A context without any discounted count gives one count to the unseen.
            n = F.when(F.col("kept") >= F.col("n"), F.col("n") + 1).otherwise(F.col("n"))
            mass = common.written(mass.select("context", n.alias("n"), "kept", "seen"), f"katz-mass-{k}")
            weight = (1 - F.col("kept") / F.col("n")) / F.greatest(1 - F.col("seen"), F.lit(1e-300))
            _store(mass.select("context", weight.alias("weight")), path, "contexts", k, "context")
            lower = _store(counted.join(mass.select("context", "n"), "context").select("context", "word", "count", (kept / F.col("n")).alias("p")),
                           path, "grams", k, "context", "word")
        levels.append((k, level.tokens, level.types, [float(x) for x in level.factor[1:]], float(unseen)))
    spark.createDataFrame(levels, "`order` int, tokens double, types double, factors array<double>, unseen double") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/levels")


def probabilities(asked: DataFrame, path: str, order: int, unseen: float) -> DataFrame:
    """(context, word, p) for the distinct (context, word) of ``asked``, n-grams of ``order``."""
    spark = asked.sparkSession
    grams = spark.read.parquet(f"{path}/grams/order={order}").select("context", "word", "p")
    if order == 1:
        return asked.join(grams, ["context", "word"], "left").select("context", "word", F.coalesce("p", F.lit(unseen)).alias("p"))
    found = common.written(asked.join(grams, ["context", "word"], "left"), f"katz-found-{order}")
    missing = found.where("p is null").select("context", "word", _shorter(order).alias("shorter"))
    below = probabilities(missing.select(F.col("shorter").alias("context"), "word").distinct(), path, order - 1, unseen)
    weights = spark.read.parquet(f"{path}/contexts/order={order}")
    backed = (missing.join(below.withColumnRenamed("context", "shorter"), ["shorter", "word"])
              .join(weights, "context", "left")
              .select("context", "word", (F.coalesce("weight", F.lit(1.0)) * F.col("p")).alias("p")))
    return found.where("p is not null").unionByName(backed)


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, score) for each row of ``docs``, scored from the model at
    ``path``: the log10 probability of the whole text and its end.

    Null and empty texts consist of their end; long texts are read whole. Rows with null or repeated
    ids are each answered; other columns are not read; an empty table gives no rows."""
    spark = docs.sparkSession
    levels = spark.read.parquet(f"{path}/levels").collect()  # one row per order
    order, unseen = max(r["order"] for r in levels), next(r["unseen"] for r in levels if r["order"] == 1)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), _words(text_col).alias("w"))
    rows = common.written(rows, "katz-rows")  # numbered once: a lost task does not number them anew
    held = rows.select("row", F.explode(_grams(F.col("w"), order)).alias("g")).groupBy("row", "g.context", "g.word").agg(F.count(F.lit(1)).alias("n"))
    held = common.written(held, "katz-asked")
    p = probabilities(held.select("context", "word").distinct(), path, order, unseen)
    summed = held.join(p, ["context", "word"]).groupBy("row").agg(F.sum(F.col("n") * F.log10("p")).alias("score"))
    return (rows.select("row", "id", F.size("w").cast("long").alias("n_tokens")).join(summed, "row")
            .select(F.col("id").alias(id_col), "n_tokens", "score"))
