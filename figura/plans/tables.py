"""Input tables and the stand-in mapping used by the registered queries.

The driver's tables stand in for the corpus as follows (documented in the
README): an *example* is a labelled document (``documents`` joined with
``labels``): ``id = doc_id``, ``y = quality``, ``genre = lang``. Its
partition is ``test`` for one bucket in four of ``md5('split:' || id)``,
``train`` otherwise. The vocabulary is ``embeddings``; a term's vector is
the embedding whose ``vec_id`` equals its md5 bucket modulo
``floor(1.2 * count(embeddings))`` (so some terms are out of vocabulary).

Every Spark expression below has a SQL twin in the same file so the oracle
queries describe the very same inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figura.functions.hashing import bucket
from figura.session import few, spread

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Stand-in parameters (fixed for all queries).
TEST_BUCKETS = 4          # one bucket in four is test
MODELS = ("l", "la", "lac")
MODEL_SKILL = {"l": 6, "la": 7, "lac": 8}   # in tenths: stand-in models' hit rate
MODEL_PAIRS = [("l", "la"), ("la", "lac")]
N_DEV = 100
SEED = 0
DIGITS = 6


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``read`` for work that costs far more than its bytes: a table of fewer
    splits than the session has cores is spread over them."""
    return spread(read(spark, sf_dir, name), spark.sparkContext.defaultParallelism)


# ---------------------------------------------------------------- examples

def partition_expr(id_col: str = "id"):
    return F.when(bucket(F.concat(F.lit("split:"), F.col(id_col).cast("string")), TEST_BUCKETS) == 0,
                  F.lit("test")).otherwise(F.lit("train"))


SQL_HASH = "('0x' || substr(md5({x}), 1, 8))::BIGINT"


def sql_bucket(x: str, n) -> str:
    return f"({SQL_HASH.format(x=x)} % {n})"


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    return (docs.join(labels, "doc_id")
            .select(F.col("doc_id").alias("id"), F.col("quality").alias("y"),
                    F.col("lang").alias("genre"))
            .withColumn("partition", partition_expr()))


EXAMPLES_SQL = f"""
examples AS (
  SELECT d.doc_id AS id, l.quality AS y, d.lang AS genre,
         CASE WHEN {sql_bucket("'split:' || CAST(d.doc_id AS VARCHAR)", TEST_BUCKETS)} = 0
              THEN 'test' ELSE 'train' END AS partition
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""


def with_dev_split(ex: DataFrame, n_dev: int = N_DEV, seed: int = SEED) -> DataFrame:
    """``split`` in {train, dev, test}: dev is the seeded sample of n_dev
    train rows (broadcast if n_dev is small). Rows of any other
    partition have no split; the split checks count them as outside."""
    from figura.operators.sampling import seeded_sample
    dev = seeded_sample(ex.where(F.col("partition") == "train").select("id"), n_dev, seed) \
        .withColumn("_dev", F.lit(True))
    return (ex.join(few(dev, n_dev), "id", "left")
            .withColumn("split", F.when(F.col("partition") == "test", "test")
                        .when(F.col("_dev"), "dev")
                        .when(F.col("partition") == "train", "train"))
            .drop("_dev"))


SPLIT_SQL = EXAMPLES_SQL + f""",
dev AS (
  SELECT id FROM examples WHERE partition = 'train'
  ORDER BY md5('{SEED}:' || CAST(id AS VARCHAR)), id LIMIT {N_DEV}
),
splits AS (
  SELECT e.*, CASE WHEN e.partition = 'test' THEN 'test'
                   WHEN dv.id IS NOT NULL THEN 'dev' ELSE 'train' END AS split
  FROM examples e LEFT JOIN dev dv ON e.id = dv.id
)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long stand-in predictions ``(id, model, split, genre, y, pred)``: model
    m is right on ``MODEL_SKILL[m]`` tenths of the md5 buckets of (m, id)."""
    ex = with_dev_split(examples(spark, sf_dir))
    skill = F.create_map(*[x for m, k in MODEL_SKILL.items() for x in (F.lit(m), F.lit(k))])
    return (ex.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
            .withColumn("pred", F.when(
                bucket(F.concat(F.col("model"), F.lit(":"), F.col("id").cast("string")), 10)
                < F.element_at(skill, F.col("model")), F.col("y")).otherwise(1 - F.col("y")))
            .select("id", "model", "split", "genre", "y", "pred"))


_skill_case = " ".join(f"WHEN '{m}' THEN {k}" for m, k in MODEL_SKILL.items())
PREDICTIONS_SQL = SPLIT_SQL + f""",
models AS (SELECT * FROM (VALUES {", ".join(f"('{m}')" for m in MODELS)}) t(model)),
predictions AS (
  SELECT s.id, m.model, s.split, s.genre, s.y,
         CASE WHEN {sql_bucket("m.model || ':' || CAST(s.id AS VARCHAR)", 10)}
                   < (CASE m.model {_skill_case} END)
              THEN s.y ELSE 1 - s.y END AS pred
  FROM splits s, models m
)"""


def feature_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(model, n_features)``: L = d, LA = 3d, LAC = 4d, d = vector width."""
    d = read(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding")).alias("d"))
    mult = {"l": 1, "la": 3, "lac": 4}
    return d.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), (F.col("d") * k).cast("int").alias("n_features"))
        for m, k in mult.items()])))


WIDTHS_SQL = """
widths AS (
  SELECT m.model, CAST(d.d * m.k AS INTEGER) AS n_features
  FROM (SELECT max(len(embedding)) AS d FROM embeddings) d,
       (VALUES ('l', 1), ('la', 3), ('lac', 4)) m(model, k)
)"""


# ---------------------------------------------------------------- vocabulary

def vocabulary(spark: SparkSession, sf_dir: str):
    """Stand-in word vectors: a term's vector is ``embeddings[vec_id =
    md5_bucket(term) % floor(1.2 * count(embeddings))]`` (about one key in
    six has no vector). Two scalars are read from the table."""
    from figura.operators.features import Vocabulary
    emb = read(spark, sf_dir, "embeddings")
    row = emb.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    v = (12 * int(row["n"])) // 10
    return Vocabulary(emb, "vec_id", "embedding", int(row["d"]), key_fn=lambda t: bucket(t, v))


VOCAB_SQL = """
vsize AS (SELECT (12 * count(*)) // 10 AS v, max(len(embedding)) AS d FROM embeddings),
dims AS (SELECT unnest(range(0, d)) AS pos FROM vsize)"""


def sql_vocab_key(term: str) -> str:
    return sql_bucket(term, "(SELECT v FROM vsize)")
