"""Views of the given tables in the shapes that the operators take: labelled texts, scored rows, feedback, calls, plans.

Each has its DuckDB twin in SQL, under the same name, to be put in a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.operators.evaluation import CLASSES, DECISIONS
from prosemill.session import ready

NL = "chr(10)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pick(names: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(i, F.lit(len(names))) + 1).cast("int"))


def sql_list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their lines made paragraphs, since the table has no blank lines."""
    return documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, source, label, modern: quality 1 is human; quality 0 machine, or mixed where toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "human").when(F.col("toxic") == 1, "mixed").otherwise("machine").alias("label"))
    return documents(spark, sf_dir).join(labels, "doc_id").withColumn("modern", F.pmod("doc_id", F.lit(2)) == 0)


LABELLED = """labelled AS (
  SELECT d.doc_id, d.text, d.lang, d.source, CASE WHEN quality = 1 THEN 'human' WHEN toxic = 1 THEN 'mixed' ELSE 'machine' END AS label, d.doc_id % 2 = 0 AS modern
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, logits, probs, p, pred, label, modern, split, source, from the embeddings' first components."""
    e = table(spark, sf_dir, "embeddings")
    logit = F.array(*[F.round(F.col("embedding")[i].cast("double") * 10, 3) for i in range(3)])
    rows = e.select("vec_id", logit.alias("logits"), pick(CLASSES, F.col("label")).alias("label"), (F.pmod("vec_id", F.lit(2)) == 0).alias("modern"), pick(("train", "val", "test"), F.col("vec_id")).alias("split"), F.concat(F.lit("s"), F.pmod("vec_id", F.lit(5)).cast("string")).alias("source"))
    exps = F.transform("logits", lambda x: F.exp(x))
    probs = F.transform(exps, lambda x: F.round(x / F.aggregate(exps, F.lit(0.0), lambda a, y: a + y), 6))
    top = rows.withColumn("probs", probs).withColumn("p", F.array_max("probs"))
    pred = F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position("probs", F.col("p")).cast("int"))
    return top.withColumn("pred", pred).withColumn("decision", F.when(F.col("p") < 0.6, "unsure").otherwise(F.col("pred"))).withColumns({f"p_{c}": F.col("probs")[i] for i, c in enumerate(CLASSES)})


SCORED = f"""raw_scored AS (
  SELECT vec_id, list_transform([embedding[1], embedding[2], embedding[3]], lambda x: round(CAST(x AS DOUBLE) * 10, 3)) AS logits, ({sql_list(CLASSES)})[label % 3 + 1] AS label,
    vec_id % 2 = 0 AS modern, (['train', 'val', 'test'])[vec_id % 3 + 1] AS split, 's' || CAST(vec_id % 5 AS VARCHAR) AS source
  FROM embeddings
), soft AS (
  SELECT *, list_transform(logits, lambda x: round(exp(x) / list_sum(list_transform(logits, lambda y: exp(y))), 6)) AS probs FROM raw_scored
), scored AS (
  SELECT *, list_max(probs) AS p, ({sql_list(CLASSES)})[list_position(probs, list_max(probs))] AS pred,
    CASE WHEN list_max(probs) < 0.6 THEN 'unsure' ELSE ({sql_list(CLASSES)})[list_position(probs, list_max(probs))] END AS decision,
    probs[1] AS p_human, probs[2] AS p_machine, probs[3] AS p_mixed
  FROM soft
)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), pick(DECISIONS, F.col("event_id")).alias("predicted"), pick(CLASSES, F.col("user_id")).alias("label"),
        F.least(F.round(F.abs("value") / 500, 4), F.lit(1.0)).alias("p"), F.when(F.pmod("user_id", F.lit(3)) == 0, "1.0.0").otherwise("1.0.1").alias("model_version"), "user_id",
    )


FEEDBACK = f"""feedback AS (
  SELECT event_id AS id, ts AS created_at, ({sql_list(DECISIONS)})[event_id % 4 + 1] AS predicted, ({sql_list(CLASSES)})[user_id % 3 + 1] AS label,
    least(round(abs(value) / 500, 4), 1.0) AS p, CASE WHEN user_id % 3 = 0 THEN '1.0.0' ELSE '1.0.1' END AS model_version, user_id
  FROM events
)"""


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, group, source, model, seq, text: conversation turns seen as generations."""
    c = table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull())
    return c.select(
        F.concat_ws(":", "conv_id", "turn", F.md5(F.col("text").cast("binary"))).alias("key"), F.concat(F.lit("g"), F.pmod("conv_id", F.lit(40)).cast("string")).alias("group"),
        F.concat(F.lit("s"), F.pmod("conv_id", F.lit(3)).cast("string")).alias("source"), F.concat(pick(("lab0", "lab1", "lab2", "lab3"), F.col("turn")), F.lit("/m"), F.pmod("conv_id", F.lit(4)).cast("string")).alias("model"),
        F.concat_ws(":", F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lpad(F.col("turn").cast("string"), 6, "0"), F.md5(F.col("text").cast("binary"))).alias("seq"), "text",
    )


GENERATIONS = """generations AS (
  SELECT concat_ws(':', conv_id, turn, md5(text)) AS key, 'g' || CAST(conv_id % 40 AS VARCHAR) AS "group", 's' || CAST(conv_id % 3 AS VARCHAR) AS source,
    (['lab0', 'lab1', 'lab2', 'lab3'])[turn % 4 + 1] || '/m' || CAST(conv_id % 4 AS VARCHAR) AS model,
    concat_ws(':', lpad(CAST(conv_id AS VARCHAR), 12, '0'), lpad(CAST(turn AS VARCHAR), 6, '0'), md5(text)) AS seq, text
  FROM conversations WHERE text IS NOT NULL
)"""
