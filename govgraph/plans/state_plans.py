"""Round trips: tables written in a layout of a benchmark or as the state of a graph, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.traverse import shared_path
from ..sources import benchmarks as B
from ..sources import files
from .base import plan


def put(g, rows, column: str = "value") -> str:
    """The rows' JSON as text files in the shared folder."""
    path = shared_path(g.spark)
    rows.select(column).write.text(path)
    return path


@plan("s1_text_files", "SELECT count(*) AS n, sum(length(replace(text, chr(10), ' '))) AS chars FROM benchmark", graph=False)
def _(g):
    path = put(g, g.table("benchmark").select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("value")).repartition(4))
    texts = files.read_texts(g.spark, path)
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    return lines.agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@plan("s2_uploads", "SELECT item_id, text FROM benchmark WHERE trim(text) <> ''", graph=False)
def _(g):
    """Uploaded text files, one for each passage; their names are folders of the writer's, so the passage is in the text."""
    path = shared_path(g.spark)
    rows = g.table("benchmark").select(F.to_json(F.struct("item_id", "text")).alias("value"), F.col("item_id").alias("part"))
    rows.write.partitionBy("part").option("maxRecordsPerFile", 1).text(path)
    found = B.read_uploads(g.spark, f"{path}/*/*.txt")
    return found.select(F.from_json("text", "item_id long, text string").alias("x")).select("x.*")


@plan("s3_graph_json", "SELECT subject, relation, object FROM core WHERE relation = 'IN_REGION'")
def _(g):
    """An exported graph, wrapped; triples with a blank part are left out."""
    t = g.core.filter("relation = 'IN_REGION'").select("subject", "relation", "object", "confidence", "source")
    blank = t.limit(2).withColumn("object", F.lit(""))
    kg = t.unionByName(blank).agg(F.collect_list(F.struct("*")).alias("triples")).select(F.to_json(F.struct(F.struct(F.array().cast("array<string>").alias("entities"), "triples").alias("knowledge_graph"))).alias("value"))
    return files.read_graph(g.spark, put(g, kg))[1].select("subject", "relation", "object")


@plan("s5_governed_state", "AND a AS (SELECT 'entities' AS part, count(*) AS n FROM kg_entities UNION ALL SELECT 'triples', count(*) FROM kg_triples UNION ALL SELECT 'domains', count(*) FROM domains UNION ALL SELECT 'aliases', count(*) FROM nation) SELECT * FROM a")
def _(g):
    path = shared_path(g.spark)
    aliases = g.table("nation").select(F.col("n_name").alias("alias"), F.col("n_nationkey").alias("canonical"))
    B.save_state({"entities": g.entities, "triples": g.triples, "domains": g.domains, "aliases": aliases}, path)
    out = None
    for name, rows in B.load_state(g.spark, path, "entities", "triples", "domains", "aliases").items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@plan("s6_vectors", "SELECT vec_id AS id, label FROM embeddings", graph=False)
def _(g):
    path = shared_path(g.spark)
    v = g.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", F.lit("m1").alias("model"), F.when(F.col("vec_id") % 2 == 0, "entity").otherwise("triple").alias("collection"))
    files.write_vectors(v, path)
    return files.load_vectors(g.spark, path, "m1").select("id", "label")


@plan("s7_vector_index", "SELECT CASE WHEN vec_id % 2 = 0 THEN 'entity' ELSE 'triple' END AS collection, count(*) AS n FROM embeddings GROUP BY 1", graph=False)
def _(g):
    path = shared_path(g.spark)
    v = g.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 2 == 0, "entity").otherwise("triple").alias("collection"))
    B.save_index(v, "h1", path)
    return B.load_index(g.spark, path, "h1").groupBy("collection").agg(F.count("*").alias("n"))


@plan("s8_lazy_state", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING conv_id % 3 <> 0", graph=False)
def _(g):
    """Chunks and what has been processed, saved and loaded: what is left to do."""
    path = shared_path(g.spark)
    chunks = g.table("conversations").select("conv_id", "turn", "text")
    chunks.write.parquet(f"{path}/chunks")
    chunks.filter("conv_id % 3 = 0").select("conv_id").distinct().write.parquet(f"{path}/processed")
    left = g.spark.read.parquet(f"{path}/chunks").join(g.spark.read.parquet(f"{path}/processed"), "conv_id", "left_anti")
    return left.select("conv_id").distinct()


@plan("s10_token_spans", "SELECT 'i' || item_id AS doc_key, CASE WHEN k = 0 THEN split_part(t, ' ', 1) || ' ' || split_part(t, ' ', 2) ELSE split_part(t, ' ', 3) END AS text, CASE WHEN k = 0 THEN 'Task' ELSE 'Method' END AS type FROM (SELECT item_id, replace(text, chr(10), ' ') AS t FROM benchmark), (SELECT unnest([0, 1]) AS k)", graph=False)
def _(g):
    """Two sentences of tokens with spans over all of them; spans of the generic type are left out."""
    t = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    ner = F.array(F.array(F.array(F.lit("0"), F.lit("1"), F.lit("Task"))), F.array(F.array(F.lit("2"), F.lit("2"), F.lit("Method")), F.array(F.lit("1"), F.lit("1"), F.lit("Generic"))))
    rows = g.table("benchmark").select(F.to_json(F.struct(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("doc_key"), F.array(F.slice(t, 1, 2), F.slice(t, 3, 1000)).alias("sentences"), ner.alias("ner"), F.array().cast("array<array<array<string>>>").alias("relations"))).alias("value"))
    return files.read_token_spans(g.spark, put(g, rows))[0]


@plan("s11_relation_documents", "SELECT 'r' || r_regionkey AS title, n_nationkey AS nation, r_name || ', see (' || n_name || ').' AS text, list_sort(list_distinct([n_name, r_name])) AS mentions, 'P1' AS relation FROM nation JOIN region ON n_regionkey = r_regionkey", graph=False)
def _(g):
    """Token lists as text, gold clusters as their different names, gold labels by the clusters' numbers."""
    n = g.table("nation").join(g.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sents = F.array(F.array("r_name", F.lit(","), F.lit("see")), F.array(F.lit("("), F.col("n_name"), F.lit(")"), F.lit(".")))
    mention = lambda c: F.struct(F.col(c).alias("name"), F.lit("LOC").alias("type"))
    title = F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit("/"), F.col("n_nationkey").cast("string"))
    doc = F.struct(title.alias("title"), sents.alias("sents"), F.array(F.array(mention("n_name"), mention("r_name"), mention("n_name"))).alias("vertexSet"), F.array(F.struct(F.lit(0).alias("h"), F.lit(0).alias("t"), F.lit("P1").alias("r"))).alias("labels"))
    texts, clusters, gold = B.relation_documents(g.spark, put(g, n.select(F.to_json(doc).alias("value"))))
    met = texts.join(clusters, "title").join(gold, "title")
    return met.select(F.substring_index("title", "/", 1).alias("title"), F.substring_index("title", "/", -1).cast("int").alias("nation"), "text", "mentions", "relation")


_QUESTIONS = "SELECT 'c' || conv_id AS question_id, list(text ORDER BY turn) AS texts, list(turn % 2 = 0 ORDER BY turn) AS supporting FROM conversations GROUP BY 1"


def asked(g):
    c = g.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.withColumn("id", F.concat(F.lit("c"), F.col("conv_id").cast("string")))


@plan("s12_paired_questions", _QUESTIONS, graph=False)
def _(g):
    """Contexts as pairs of a title and sentences, supporting ones by their titles."""
    title = lambda x: F.concat(F.lit("t"), x["turn"].cast("string"))
    context = F.transform("t", lambda x: F.array(title(x), F.to_json(F.array(x["text"]))))
    facts = F.transform(F.filter("t", lambda x: x["turn"] % 2 == 0), lambda x: F.array(title(x), F.lit("0")))
    one = F.struct(F.col("id").alias("_id"), F.lit("Why?").alias("question"), F.lit("So.").alias("answer"), F.to_json(context).alias("context"), F.to_json(facts).alias("supporting_facts"))
    found = B.paired_questions(g.spark, put(g, asked(g).select(F.to_json(one).alias("value"))))
    return found.select("question_id", F.col("paragraphs.text").alias("texts"), F.col("paragraphs.supporting").alias("supporting"))


@plan("s13_paragraph_questions", _QUESTIONS, graph=False)
def _(g):
    """Records under either set of keys, in lines."""
    p = F.transform("t", lambda x: F.struct(x["text"].alias("paragraph_text"), (x["turn"] % 2 == 0).alias("is_supporting")))
    q = F.transform("t", lambda x: F.struct(x["text"].alias("text"), F.lit("w").alias("wikipedia_title"), (x["turn"] % 2 == 0).alias("is_supporting")))
    odd = F.col("conv_id") % 2 == 1
    rows = asked(g).select(F.when(odd, F.to_json(F.struct("id", F.lit("Why?").alias("question"), F.lit("a").alias("answer"), p.alias("paragraphs")))).otherwise(F.to_json(F.struct(F.col("id").alias("question_id"), F.lit("Why?").alias("query"), F.array(F.lit("a")).alias("answers"), q.alias("context")))).alias("value"))
    found = B.paragraph_questions(g.spark, put(g, rows))
    return found.select("question_id", F.col("paragraphs.text").alias("texts"), F.col("paragraphs.supporting").alias("supporting"))


@plan("d25_supporting_documents", "SELECT 't' || turn AS title, arg_min(text, 'c' || conv_id) AS text FROM conversations WHERE turn % 2 = 0 GROUP BY 1", graph=False)
def _(g):
    p = F.transform("t", lambda x: F.struct(F.concat(F.lit("t"), x["turn"].cast("string")).alias("title"), x["text"].alias("text"), (x["turn"] % 2 == 0).alias("supporting")))
    return B.supporting_documents(asked(g).select(F.col("id").alias("question_id"), p.alias("paragraphs")))


@plan("s14_numbered_sessions", """WITH t AS (SELECT conv_id, turn, role || ': ' || text AS line FROM conversations), s AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS lines FROM t GROUP BY 1),
p AS (SELECT conv_id, string_agg(DISTINCT role, ' and ' ORDER BY role) AS names FROM conversations GROUP BY 1)
SELECT conv_id, 'Below is a long-term conversation between ' || names || '.' || chr(10) || chr(10) || chr(10) || '[May]' || chr(10) || lines || CASE WHEN conv_id % 2 = 0 THEN chr(10) || chr(10) || '[Session 2]' || chr(10) || '?: hm [shares image: a cat]' ELSE '' END AS text FROM s JOIN p USING (conv_id)""", graph=False)
def _(g):
    """A dated session, one without a date in every second conversation, and one beyond a gap that is not read."""
    turns = F.transform("t", lambda x: F.struct(x["role"].alias("speaker"), x["text"].alias("text")))
    c = g.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    cat = F.lit('[{"text": "hm", "blip_caption": "a cat"}]')
    conversation = F.map_filter(F.create_map(F.lit("session_1"), F.to_json(turns), F.lit("session_1_date_time"), F.lit("May"), F.lit("session_2"), F.when(F.col("conv_id") % 2 == 0, cat), F.lit("session_4"), cat), lambda k, v: v.isNotNull())
    return c.withColumn("conversation", conversation).select("conv_id", B.numbered_sessions().alias("text"))


@plan("s15_dated_sessions", "SELECT conv_id AS session, '[Session date: ' || (2000 + conv_id % 20) || ']' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id", graph=False)
def _(g):
    c = g.table("conversations").select(F.col("conv_id").alias("session"), (2000 + F.col("conv_id") % 20).cast("string").alias("date"), "turn", "role", "text")
    return B.dated_sessions(c)


@plan("s16_nested_chat", "SELECT conv_id, '[BEAM Conversation — ID: ' || conv_id || ' | Domain: General]' || chr(10) || chr(10) || string_agg(upper(role) || ': ' || trim(text), chr(10) ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id", graph=False)
def _(g):
    c = g.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    chat = F.array(F.transform("t", lambda x: F.array(F.struct(x["role"].alias("role"), x["content"].alias("content")))))
    return c.select("conv_id", B.nested_chat(chat, F.col("conv_id").cast("string"), F.lit(None).cast("string")).alias("text"))


@plan("s18_annotation_csv", "SELECT subject, relation, object, '' AS verdict FROM core WHERE relation = 'IN_REGION'")
def _(g):
    path = shared_path(g.spark)
    B.write_csv(g.core.filter("relation = 'IN_REGION'").select("subject", "relation", "object"), path, ("verdict",))
    back = g.spark.read.option("header", True).csv(path)
    return back.select("subject", "relation", "object", F.coalesce("verdict", F.lit("")).alias("verdict"))


@plan("d29_predictions", "SELECT s_suppkey, s_name AS name FROM supplier", graph=False)
def _(g):
    path = shared_path(g.spark)
    rows = g.table("supplier").select(F.to_json(F.struct("s_suppkey", F.col("s_name").alias("name"))).alias("value"), F.col("s_suppkey").alias("part"))
    rows.write.partitionBy("part").text(path)
    return B.predictions(g.spark, f"{path}/*/*.txt", "s_suppkey long, name string").select("s_suppkey", "name")
