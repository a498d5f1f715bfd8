"""Ranked retrieval: inverted index, BM25, TF-IDF, vector search, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.durable import materialise
from threadloom.functions.text import tokenize
from threadloom.functions.vectors import cosines
from threadloom.tables import with_row

#: Published Okapi parameters.
K1, B = 1.2, 0.75
# Turns that enter fusion, and the weights of BM25, LSA and dense scores.
CANDIDATES = 200
WEIGHTS_3 = (0.35, 0.10, 0.55)
WEIGHTS_2 = (0.40, 0.60)


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """The inverted index: postings (term, id, tf) and lengths (id, dl). Documents without tokens have dl 0."""
    toks = docs.select(F.col(id_col).alias("id"), tokenize(F.col(text_col)).alias("tokens"))
    post = toks.select("id", F.explode("tokens").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    return post, toks.select("id", F.size("tokens").alias("dl"))


def placed_postings(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """(term, id, *keep, tf, dl): the inverted index with what a score needs of its document in each posting."""
    toks = docs.select(F.col(id_col).alias("id"), *keep, tokenize(F.col(text_col)).alias("tokens"))
    rows = toks.select("id", *keep, F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return rows.groupBy("term", "id", *keep, "dl").agg(F.count("*").alias("tf")).select("term", "id", *keep, "tf", "dl")


def bm25_stored(post: DataFrame, n: int, n_tokens: int, k: int | None = CANDIDATES) -> DataFrame:
    """(id, session_id, turn_index, score): the *k* best documents of the postings of a query's terms; ties go to the smaller id.

    *n* documents with *n_tokens* in all make up the corpus; a document without any of
    the terms has no row.
    """
    df = post.groupBy("term").agg(F.count("*").alias("df"))  # a row per query term
    part = _bm25_term(F.col("tf"), F.col("dl"), F.col("df"), F.lit(float(n)), F.lit(n_tokens / n if n else 1.0))
    scored = post.join(F.broadcast(df), "term").groupBy("id", "session_id", "turn_index").agg(F.round(F.sum(part), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k) if k else scored


def _bm25_term(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(post: DataFrame, lengths: DataFrame, terms: list[str], k: int | None = CANDIDATES) -> DataFrame:
    """(id, score): the *k* best documents of an index for any of *terms*; ties go to the smaller id.

    Only the postings of the query's terms are read; a document without any has no row.
    """
    stats = lengths.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    mine = post.where(F.col("term").isin(sorted(set(terms))))
    df = mine.groupBy("term").agg(F.count("*").alias("df"))
    parts = with_row(mine.join(F.broadcast(df), "term").join(lengths, "id"), stats)
    scored = parts.groupBy("id").agg(F.round(F.sum(_bm25_term(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl"))), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k) if k else scored


def bm25_scan(docs: DataFrame, id_col: str, text_col: str, terms: list[str], *keep: str) -> DataFrame:
    """(id, *keep, score) of every document with one of *terms*, without an index.

    Term frequencies of the few query terms are counted inside each row, so nothing is
    exploded or shuffled; the counts are written once, for the statistics (one row)
    and for the scores.
    """
    terms = sorted(set(terms))
    toks = docs.select(F.col(id_col).alias("id"), *keep, tokenize(F.col(text_col)).alias("tokens"))
    count = lambda t: F.size(F.filter("tokens", lambda x: x == t))
    tf = [count(t).alias(f"tf{i}") for i, t in enumerate(terms)]
    rows = materialise(toks.select("id", *keep, F.size("tokens").alias("dl"), *tf), "counts")
    stats = rows.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        part = _bm25_term(F.col(f"tf{i}"), F.col("dl"), F.col(f"df{i}"), F.col("n"), F.col("avgdl"))
        score = score + F.when(F.col(f"tf{i}") > 0, part).otherwise(0.0)
    # A term's weight is above zero wherever it occurs. A filter on term frequencies would be
    # pushed below the tokeniser and run it once per term.
    return with_row(rows, stats).select("id", *keep, F.round(score, 6).alias("score")).where("score > 0")


def best_turn(hits: DataFrame, group: str = "session_id") -> DataFrame:
    """Per group the best hit above zero; ties go to the earlier turn, then the smaller id."""
    best = F.max_by(F.struct("id", "turn_index", "score"), F.struct("score", -F.coalesce("turn_index", F.lit(2**31 - 1)), F.col("id")))
    return hits.where("score > 0").groupBy(group).agg(best.alias("b")).select(group, F.col("b.id").alias("turn_id"), F.col("b.turn_index").alias("turn_index"), F.col("b.score").alias("score"))


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf) in long form."""
    return docs.select(F.col(id_col).alias("id"), F.explode(tokenize(F.col(text_col))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def with_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row: the number n of documents that have text, if the rows of each are joined by spaces."""
    joined = docs.groupBy(id_col).agg((F.coalesce(F.sum(F.length(text_col)), F.lit(0)) + F.count(text_col) - 1).alias("length"))
    return joined.where("length > 0").agg(F.count("*").cast("double").alias("n"))


def tfidf(docs: DataFrame, id_col: str, text_col: str, min_df: int = 2) -> DataFrame:
    """(id, term, w): augmented term frequency by idf, terms in at least *min_df* documents.

    A document may come in several rows, such as the turns of a session: its terms are
    counted row by row and summed, so its text is never put together. idf = ln(N / df) + 1
    with N the documents that have text (several rows without any count as text, as if
    joined by spaces); w = (0.5 + 0.5 tf / maxtf) idf with maxtf over the document's terms
    that are in the vocabulary.
    """
    tf = materialise(term_counts(docs, id_col, text_col), "tf")  # read for df, maxtf and the weights
    vocab = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    known = materialise(tf.join(vocab, "term"), "known")
    most = known.groupBy("id").agg(F.max("tf").alias("maxtf"))
    return with_row(known.join(most, "id"), with_text(docs, id_col, text_col)).select("id", "term", ((0.5 + 0.5 * F.col("tf") / F.col("maxtf")) * (F.log(F.col("n") / F.col("df")) + 1)).alias("w"))


def tfidf_search(matrix: DataFrame, terms: list[str]) -> DataFrame:
    """(id, score): cosine of a query of equally weighted terms with each document row; above zero only."""
    q = sorted(set(terms))
    per = matrix.groupBy("id").agg(F.sum(F.when(F.col("term").isin(q), F.col("w")).otherwise(0.0)).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return per.where("dot > 0").select("id", F.round(F.col("dot") / (F.col("norm") * F.sqrt(F.lit(float(len(q))))), 6).alias("score"))


def vector_search(vectors: DataFrame, id_col: str, vec_col: str, query: list[float], k: int | None = None) -> DataFrame:
    """(id, score): cosine with *query*, above zero only, best first when *k* is given."""
    named = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    scored = named.mapInArrow(cosines(query), f"id {dict(named.dtypes)['id']}, score double").select("id", F.round("score", 6).alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), "id").limit(k) if k else scored


def fuse(text: DataFrame, latent: DataFrame, dense: DataFrame | None = None) -> DataFrame:
    """(id, score): full outer merge of score tables (id, score), each divided by its maximum, weighted.

    Three-way weights hold if any dense score exists, else two-way ones. A document
    missing in a table scores 0 there. The normalisers are taken before any filter.
    """
    tables = [text, latent] + ([dense] if dense is not None else [])
    rows = None
    for i, t in enumerate(tables):
        part = t.select("id", F.lit(i).alias("kind"), "score")
        rows = part if rows is None else rows.unionByName(part)
    per = rows.groupBy("id").agg(*[F.coalesce(F.max(F.when(F.col("kind") == i, F.col("score"))), F.lit(0.0)).alias(f"s{i}") for i in range(3)])
    tops = per.agg(*[F.coalesce(F.max(f"s{i}"), F.lit(0.0)).alias(f"m{i}") for i in range(3)])  # from the same shuffle
    share = [F.when(F.col(f"m{i}") > 0, F.col(f"s{i}") / F.col(f"m{i}")).otherwise(0.0) for i in range(3)]
    three = sum((w * s for w, s in zip(WEIGHTS_3, share)), F.lit(0.0))
    two = sum((w * s for w, s in zip(WEIGHTS_2, share)), F.lit(0.0))
    return with_row(per, tops).select("id", F.when(F.col("m2") > 0, three).otherwise(two).alias("score"))
