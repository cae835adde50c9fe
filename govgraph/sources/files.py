"""Sources and sinks of graphs, documents and benchmark files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "struct<id:string,labels:array<string>,type:string,metadata:map<string,string>>"
TRIPLE = "struct<subject:string,relation:string,object:string,confidence:double,source:string,metadata:map<string,string>>"
GRAPH = f"entities array<{ENTITY}>, triples array<{TRIPLE}>, knowledge_graph struct<entities:array<{ENTITY}>,triples:array<{TRIPLE}>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """document_id, text of whole text files."""
    text = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    return text.select(name.alias("document_id"), F.col("value").alias("text"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and triples of an exported graph, wrapped or plain; triples with a blank part are left out."""
    raw = spark.read.schema(GRAPH).json(path, multiLine=True)
    entities = raw.select(F.explode(F.coalesce("knowledge_graph.entities", "entities")).alias("e")).select("e.*")
    triples = raw.select(F.explode(F.coalesce("knowledge_graph.triples", "triples")).alias("t")).select("t.*")
    filled = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("subject", "relation", "object")]
    return entities, triples.filter(filled[0] & filled[1] & filled[2])


def write_graph(entities: DataFrame, triples: DataFrame, path: str) -> None:
    """One folder for each part; parts are partitioned tables, not one document."""
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    triples.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/triples")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/triples")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """id, collection, model, vector, text_hash: by model and collection."""
    vectors.write.mode("overwrite").partitionBy("model", "collection").parquet(path)


def load_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Refuses a store that another model filled."""
    stored = spark.read.parquet(path)
    if stored.filter(F.col("model") == model).isEmpty():
        raise ValueError(f"the store holds no vectors of {model}")
    return stored.filter(F.col("model") == model)


def write_stage(rows: DataFrame, path: str) -> None:
    """Results of a stage by (document_id, stage); running again replaces only what it holds."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage", "document_id").parquet(path)


def unfinished(documents: DataFrame, done: DataFrame, stage: str) -> DataFrame:
    return documents.join(done.filter(F.col("stage") == stage).select("document_id").distinct(), "document_id", "left_anti")


def read_token_spans(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of token-span annotations (JSON lines; spans inclusive over all tokens)."""
    rows = spark.read.schema("doc_key string, sentences array<array<string>>, ner array<array<array<string>>>, relations array<array<array<string>>>").json(path)
    rows = rows.withColumn("tokens", F.flatten("sentences"))
    said = lambda s, e: F.array_join(F.slice("tokens", s.cast("int") + 1, e.cast("int") - s.cast("int") + 1), " ")
    n = rows.select("doc_key", "tokens", F.explode(F.flatten("ner")).alias("x"))
    entities = n.select("doc_key", said(n.x[0], n.x[1]).alias("text"), n.x[2].alias("type")).filter("type <> 'Generic'")
    r = rows.select("doc_key", "tokens", F.explode(F.flatten("relations")).alias("x"))
    return entities, r.select("doc_key", said(r.x[0], r.x[1]).alias("subject"), r.x[4].alias("relation"), said(r.x[2], r.x[3]).alias("object"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """question_id, question, answer and paragraphs from either benchmark layout, JSON array or lines."""
    paragraph = "struct<title:string,paragraph_text:string,is_supporting:boolean>"
    schema = f"id string, _id string, question string, answer string, paragraphs array<{paragraph}>"
    lines = spark.read.schema(schema).json(path)
    return lines.select(F.coalesce("id", "_id").alias("question_id"), "question", "answer", "paragraphs")


def context_corpus(questions: DataFrame) -> DataFrame:
    """title, text: the first context of each title."""
    each = questions.select("question_id", F.posexplode("paragraphs").alias("at", "p"))
    return each.groupBy(F.col("p.title").alias("title")).agg(F.min_by("p.paragraph_text", F.struct("question_id", "at")).alias("text"))


def recover_json(log: DataFrame, schema: str) -> DataFrame:
    """JSON objects inside log lines (column value), once each."""
    found = log.select(F.explode(F.regexp_extract_all("value", F.lit(r"(\{.*\})"), 1)).alias("raw"))
    return found.select(F.from_json("raw", schema).alias("x")).filter("x is not null").select("x.*").distinct()


def sessions_as_text(conversations: DataFrame) -> DataFrame:
    """conv_id, text: non-blank turns in order, each with its role."""
    said = conversations.filter(F.trim("text") != "").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))).alias("t"))
    return said.select("conv_id", F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("text"))
