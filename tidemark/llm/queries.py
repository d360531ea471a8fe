"""Queries p6_ to p8_: the documents through the operators on texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.packing import CAPACITY, Packing, pack_items
from tidemark.llm.splitting import LIMIT, OVERLAP, split_documents
from tidemark.llm.tokens import count_tokens, encode_corpus
from tidemark.session import table, written


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


def _packing(spark: SparkSession, folder: str) -> Packing:
    return pack_items(count_tokens(table(spark, folder, "documents"), "doc_id", "text"), "doc_id", "n_tokens")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that a container can't hold whole."""
    return _packing(spark, folder).placed.where("n_pieces > 1 AND piece = 0").select("doc_id")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document or piece."""
    return _packing(spark, folder).placed


def p7_bound(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used, and the number that no packing can be below."""
    packing = _packing(spark, folder)
    return spark.range(1).select(F.lit(packing.containers).alias("containers"), F.lit(packing.lower_bound).alias("lower_bound"))


def p7_verified(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with the containers, counted: documents lost, of another length, split though they fit; containers above the capacity, or fewer than the bound."""
    packing = _packing(spark, folder)
    placed = written(packing.placed, "placed")
    sizes = count_tokens(table(spark, folder, "documents"), "doc_id", "text")
    held = placed.groupBy("doc_id").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("pieces"), F.max("size").alias("largest"))
    docs = sizes.join(held, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("held").isNull()).alias("lost"),
        F.count_if(F.col("held") != F.col("n_tokens")).alias("other_length"),
        F.count_if((F.col("n_tokens") <= CAPACITY) & (F.col("pieces") > 1)).alias("split_though_fitting"),
        F.count_if(F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / CAPACITY))).alias("other_pieces"),
    )
    boxes = placed.groupBy("container").agg(F.sum("size").alias("s")).agg(F.count_if(F.col("s") > CAPACITY).alias("over_capacity"), F.count(F.lit(1)).alias("n"))
    wrong = boxes.select("over_capacity", F.lit(packing.containers).alias("said"), "n").select("over_capacity", (F.col("said") - F.col("n")).alias("miscounted"), F.greatest(F.lit(packing.lower_bound) - F.col("n"), F.lit(0).cast("bigint")).alias("below_bound"))
    every = [*docs.columns, *wrong.columns]
    rows = [x.select(*((F.col(c) if c in x.columns else F.lit(0)).cast("bigint").alias(c) for c in every)) for x in (docs, wrong)]
    return rows[0].unionByName(rows[1]).agg(*(F.sum(c).alias(c) for c in every))


def p8_verified(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with the pieces, counted: pieces above the limit or with another overlap; documents whose pieces don't join to their ids."""
    pieces = p8_pieces(spark, folder)
    own = F.slice("ids", F.col("overlap") + 1, F.greatest(F.col("n_tokens") - F.col("overlap"), F.lit(1)))
    own = F.when(F.col("n_tokens") > F.col("overlap"), own).otherwise(F.array().cast("array<int>"))
    lapped = (F.col("piece") > 0) & (F.col("overlap") != OVERLAP)
    wrong = (F.size("ids") != F.col("n_tokens")) | (F.col("n_tokens") > LIMIT) | lapped
    joined = pieces.groupBy("doc_id").agg(
        F.count_if(wrong).alias("wrong"),
        # a document's pieces are as many as its length allows; each piece's overlap is compared with the piece before it
        F.array_sort(F.collect_list(F.struct("piece", own.alias("own"), F.slice("ids", F.lit(1), F.greatest("overlap", F.lit(1))).alias("begin"), "overlap"))).alias("p"),
    )
    whole = F.flatten(F.transform("p", lambda x: x["own"]))
    tails = F.forall(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (i == 0) | (F.col("p")[i]["begin"] == _last(F.col("p"), i)))
    docs = joined.select("doc_id", "wrong", whole.alias("whole"), tails.alias("tails"))
    plain = encode_corpus(table(spark, folder, "documents"), "doc_id", "text")
    return plain.join(docs, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("whole").isNull()).alias("lost"),
        F.coalesce(F.sum("wrong"), F.lit(0)).alias("wrong_pieces"),
        F.count_if(F.col("whole") != F.col("ids")).alias("not_joined"),
        F.count_if(~F.col("tails")).alias("other_overlaps"),
    )


def _last(pieces: Column, i: Column) -> Column:
    """The last OVERLAP tokens of what precedes a piece."""
    before = F.flatten(F.transform(F.slice(pieces, F.lit(1), i), lambda x: x["own"]))
    return F.slice(before, F.greatest(F.size(before) - OVERLAP + 1, F.lit(1)), F.lit(OVERLAP))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that were split."""
    return p8_pieces(spark, folder).where("n_pieces > 1 AND piece = 0").select("doc_id")


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every document."""
    return split_documents(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p6_ids, p7_found, p7_containers, p7_bound, p7_verified, p8_found, p8_pieces, p8_verified)}
#: SQL has no tokenizer; tests hold the other queries against plain encodings.
SQL: dict[str, str] = {
    "p7_verified": "SELECT count(*) AS documents, 0 AS lost, 0 AS other_length, 0 AS split_though_fitting, 0 AS other_pieces, 0 AS over_capacity, 0 AS miscounted, 0 AS below_bound FROM documents",
    "p8_verified": "SELECT count(*) AS documents, 0 AS lost, 0 AS wrong_pieces, 0 AS not_joined, 0 AS other_overlaps FROM documents",
}
