"""A training corpus from documents: language, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of documents, whatever
further columns there are and whatever their names. An empty table gives an empty one. Rows are taken as they are: null
keys, sources and languages stay, repeated rows are rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.functions.ship import ship
from rulespan.llm.common import calm, materialise, raw, read_table, unused
from rulespan.llm.exact_dedup import distinct_rows
from rulespan.llm.language_id import UNKNOWN, Model, fit, infer
from rulespan.llm.mixing import cut_spans, mix
from rulespan.llm.packing import pack_documents
from rulespan.llm.simhash import similar_groups

#: A document whose main language has less than this share of its n-grams is rejected.
LEAST_SHARE = 0.5


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which one language has at least LEAST_SHARE; texts that are null, empty or without a letter go.

    Repeated rows are kept or go together. Where no row has a language, nothing is learned and all rows go. Very long
    texts are judged whole.
    """
    ship(spark)
    model = fit(docs)
    shared = spark.sparkContext.broadcast((model.languages, model.logp))

    def keep(parts):
        m = Model(*shared.value)
        for b in parts:
            found = [infer(m, t.decode("utf-8", "replace")) if t is not None else (UNKNOWN, 0.0, {}) for t in raw(b.column("text"))]
            yield b.filter(pa.array([x != UNKNOWN and share >= LEAST_SHARE for x, share, _ in found], pa.bool_()))

    return docs.mapInArrow(calm(keep), _ddl(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, that with the largest doc_id; null texts count as empty, null doc_ids as least.

    Of rows equal in both one stays. Whole texts are compared, however long.
    """
    ship(spark)
    return distinct_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; groups are joined by pairs of five-word shingle similarity of 0.8 or more.

    Texts that are null or have no word are in no group and stay; of repeated texts one stays. Of a group the row with
    the largest doc_id stays, ties to the largest hash of the text, so what the rows hold decides and not where they lie
    (rows equal in both are alike). The rows are written once with numbers of their own, so that no number can change
    between two readings.
    """
    ship(spark)
    row, content = unused(docs.columns, "row"), unused(docs.columns, "content")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    groups = materialise(similar_groups(rows, row, "text", k=5, similarity=0.8), "near-groups")
    # few columns and the rows of groups alone: texts are hashed in the scan
    order = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text"), F.col(row).alias("row"))
    ranked = rows.select(F.col(row).alias("row"), order.alias(content)).join(groups, "row")
    stays = ranked.groupBy("root").agg(F.max(content).alias("stays")).select(F.col("stays.row").alias("row"))
    gone = groups.join(stays, "row", "left_anti").select(F.col("row").alias(row))
    # written first: Spark then knows its size, and shuffles the documents only where it is too large to broadcast
    return rows.join(materialise(gone, "near-gone"), row, "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each round that takes words of a document, with the words taken; a whole document keeps its text as it is.

    Texts that are null or have no word give no rows; null sources are one source; repeated rows are dealt each by
    itself. n_chars, where it is there, follows the new text.
    """
    ship(spark)
    names, at = docs.columns, docs.columns.index("text")
    lengths = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def emit(t: pa.Table) -> pa.Table:
        texts_in = t.column(f"c{at}").combine_chunks().cast(pa.binary()).to_pylist()
        index, texts = [], []
        for i, (text, size, spans) in enumerate(zip(texts_in, t.column("size").to_pylist(), t.column("spans").to_pylist())):
            for r in spans:
                index.append(i)
                texts.append(cut_spans(text, [(s["start"], s["end"]) for s in r], size).decode("utf-8", "replace"))
        out = t.take(pa.array(index, pa.int64()))
        cols = {n: out.column(f"c{i}") for i, n in enumerate(names)}
        cols["text"] = pa.array(texts, pa.string())
        if lengths is not None:
            cols["n_chars"] = pa.array([len(x) for x in texts], pa.int64()).cast(out.column(f"c{lengths}").type)
        return pa.table(cols)

    return mix(docs, carry=names, finish=(emit, _ddl(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 token ids, sources in the proportions that the mixture has.

    Empty and null texts are packed as the end id alone, null sources as one source, repeated rows each by itself.
    """
    ship(spark)
    return pack_documents(docs).withColumnRenamed("key", "doc_id")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("packing", packing)]

#: Trained models, token files and SimHash are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
