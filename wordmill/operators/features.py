"""Feature scores: chi-square, TF-IDF, keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chi_square(counts: DataFrame, label: str, compat: bool = False, terms: tuple[str, ...] = ("word",)) -> DataFrame:
    """(terms, chi2): chi-square of each term summed over all classes.

    Totals are sums of the counts n, not numbers of documents. compat=True derives the count of
    "neither" by taking (term, other classes) off twice, as an earlier implementation did."""
    total = counts.agg(F.sum("n").cast("double").alias("n_xx"))
    classes = counts.groupBy(label).agg(F.sum("n").cast("double").alias("n_xi"))
    words = counts.groupBy(*terms).agg(F.sum("n").cast("double").alias("n_ix"), F.map_from_entries(F.collect_list(F.struct(F.col(label), F.col("n").cast("double")))).alias("by"))
    # a row for each class and one total: a list of labels is bounded by the model, not by the data
    known = classes.crossJoin(total).agg(F.collect_list(F.struct(F.col(label).alias("l"), "n_xi", "n_xx")).alias("classes"))
    each = words.crossJoin(F.broadcast(known)).select(*terms, "n_ix", "by", F.explode("classes").alias("c")).select(*terms, "n_ix", F.coalesce(F.col("by")[F.col("c.l")], F.lit(0.0)).alias("n_ii"), "c.n_xi", "c.n_xx")
    io, oi = F.col("n_ix") - F.col("n_ii"), F.col("n_xi") - F.col("n_ii")
    oo = F.col("n_xx") - F.col("n_ii") - io - (io if compat else oi)
    score = F.col("n_xx") * F.pow(F.col("n_ii") * oo - io * oi, 2) / ((F.col("n_ii") + io) * (F.col("n_ii") + oi) * (io + oo) * (oi + oo))
    return each.select(*terms, F.when((F.col("n_ii") + oi == 0) | (io + oo == 0) | (oi + oo == 0), 0.0).otherwise(score).alias("s")).groupBy(*terms).agg(F.sum("s").alias("chi2"))


def chi_square_lists(rows: DataFrame, term: str = "word", ns: str = "ns") -> DataFrame:
    """(term, chi2) of rows that hold a term's counts in all classes as one array: as chi_square(), without a shuffle of terms. Rows are read twice."""
    spread = rows.select(F.posexplode(ns).alias("i", "n")).where("n > 0").groupBy("i").agg(F.sum("n").cast("double").alias("n_xi"))
    known = {r["i"]: r["n_xi"] for r in spread.collect()}  # a row for each class
    classes, total = [known[i] for i in sorted(known)], F.lit(float(sum(known.values())))
    place = F.array(*[F.lit(i) for i in sorted(known)]) if known else F.array().cast("array<int>")
    of = F.aggregate(ns, F.lit(0.0), lambda a, n: a + n)

    def cell(i, n_xi):
        n_ii = F.get(ns, i).cast("double")
        io, oi = F.col("n_ix") - n_ii, n_xi - n_ii
        oo = total - n_ii - io - oi
        score = total * F.pow(n_ii * oo - io * oi, 2) / ((n_ii + io) * (n_ii + oi) * (io + oo) * (oi + oo))
        return F.when((n_ii + oi == 0) | (io + oo == 0) | (oi + oo == 0), 0.0).otherwise(score)

    sums = F.aggregate(F.zip_with(place, F.array(*[F.lit(x) for x in classes]) if classes else F.array().cast("array<double>"), cell), F.lit(0.0), lambda a, x: a + x)
    return rows.select(term, ns, of.alias("n_ix")).where("n_ix > 0").select(term, sums.alias("chi2"))


def top(scores: DataFrame, n: int, score: str = "chi2", digits: int = 6, terms: tuple[str, ...] = ("word",)) -> DataFrame:
    """The n best, ties by term; TakeOrdered, no full sort."""
    return scores.withColumn(score, F.round(score, digits)).orderBy(F.desc(score), *terms).limit(n)


def tfidf(tokens: DataFrame, doc: str, docs: int) -> DataFrame:
    """(doc, word, w): tf * log2(docs / df), scaled to length 1 within a document."""
    tf = tokens.groupBy(doc, "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    raw = tf.join(df, "word").select(doc, "word", (F.col("tf") * F.log2(F.lit(float(docs)) / F.col("df"))).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(doc)))
    return raw.select(doc, "word", F.when(norm > 0, F.col("raw") / norm).otherwise(0.0).alias("w"))


def top_per(rows: DataFrame, by: list[str], score: str, n: int, tie: str = "word") -> DataFrame:
    """The n best rows of each group (Spark cuts groups before the shuffle, too)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def keywords(tokens: DataFrame, doc: str, idf: DataFrame, stop: list[str], n: int) -> DataFrame:
    """(doc, word, score, rank): tf * idf of words of more than one character that are no stop words;
    a word without idf has the average idf."""
    mean = idf.agg(F.avg("idf").alias("mean"))
    tf = tokens.where((F.char_length("word") > 1) & ~F.col("word").isin(*stop)).groupBy(doc, "word").agg(F.count("*").alias("tf"))
    scored = tf.join(idf.select("word", "idf"), "word", "left").crossJoin(F.broadcast(mean))  # one row
    scored = scored.select(doc, "word", F.round(F.col("tf") * F.coalesce("idf", "mean"), 6).alias("score"))
    return top_per(scored, [doc], "score", n)
