"""Driver queries: error analysis over the dev predictions.

Annotations stand in for the hand labels: a labelled document is
annotated ``beyond`` when toxic, else ``sentence`` for English and
``args`` for German; other documents are unannotated (null label).
Reasoning types of ``beyond`` rows follow the language (en explicit,
fr implicit, de err, es beyondplus).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from figura.functions import text as T
from figura.functions.hashing import bucket
from figura.operators import analysis
from figura.operators.sampling import dense_index, head, seeded_sample
from figura.plans.catalog import register
from figura.plans.q_features import _ROLES_SQL, _roles
from figura.plans.q_text import SQL_NORM
from figura.plans.tables import EXAMPLES_SQL, PREDICTIONS_SQL, predictions, read, sql_bucket
from figura.session import shared_path
from figura.sources import readers

N_SAMPLE = 20      # analysis sample (reference: 100 of 500 dev rows)
N_ERRORS = 20      # errors sampled per model
SAMPLE_SEED = 1
SHOW = ["id", "genre", "y", "y_pred_l", "y_pred_la", "y_pred_lac", "ctx_label"]


def annotations(spark, sf_dir):
    lab = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    label = (F.when(F.col("toxic") == 1, "beyond").when(F.col("lang") == "en", "sentence")
             .when(F.col("lang") == "de", "args"))
    return lab.select(F.col("doc_id").alias("id"), label.alias("ctx_label"), "lang") \
        .where(F.col("ctx_label").isNotNull())


ANNOTS_SQL = """
annots AS (
  SELECT l.doc_id AS id, CASE WHEN l.toxic = 1 THEN 'beyond' WHEN d.lang = 'en' THEN 'sentence'
                              WHEN d.lang = 'de' THEN 'args' END AS ctx_label, d.lang
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
  WHERE l.toxic = 1 OR d.lang IN ('en', 'de')
)"""


def dev_annotated(spark, sf_dir):
    wide = analysis.predictions_wide(predictions(spark, sf_dir).where(F.col("split") == "dev"))
    return analysis.annotate(wide, annotations(spark, sf_dir).drop("lang"))


DEV_SQL = PREDICTIONS_SQL + "," + ANNOTS_SQL + """,
wide AS (
  SELECT id, max(genre) AS genre, max(y) AS y,
         max(CASE WHEN model = 'l' THEN pred END) AS y_pred_l,
         max(CASE WHEN model = 'la' THEN pred END) AS y_pred_la,
         max(CASE WHEN model = 'lac' THEN pred END) AS y_pred_lac
  FROM predictions WHERE split = 'dev' GROUP BY id
),
devrows AS (
  SELECT w.*, a.ctx_label FROM wide w LEFT JOIN annots a ON w.id = a.id
)"""


def annot_left_join(spark, sf_dir):
    """Dev rows with a 1-based row index and their annotation label."""
    return dense_index(dev_annotated(spark, sf_dir), ["id"], name="row_idx", start=1)


register("annot_left_join", f"""
WITH {DEV_SQL}
SELECT *, row_number() OVER (ORDER BY id) AS row_idx FROM devrows
""")(annot_left_join)


def _sample(spark, sf_dir, n=N_SAMPLE):
    return seeded_sample(dev_annotated(spark, sf_dir), n, SAMPLE_SEED, key_name="sample_key")


SAMPLE_SQL = DEV_SQL + f""",
smp AS (
  SELECT *, md5('{SAMPLE_SEED}:' || CAST(id AS VARCHAR)) AS sample_key FROM devrows
  ORDER BY sample_key, id LIMIT {N_SAMPLE}
)"""


# The columns an analyst reads beside the predictions: the verb with its
# sentence (a line drawn from the text), context and arguments.
READ = ["verb", "subject", "object", "sentence", "context_md5"]


def shown(spark, sf_dir, rows):
    """Sampled rows with the example columns that an analyst reads."""
    ex = _roles(spark, sf_dir)
    lines = F.split("text", "\n")
    at = bucket(F.concat(F.lit("line:"), F.col("id").cast("string")), F.size(lines)).cast("int")
    ex = ex.select("id", F.col("v").alias("verb"), F.col("s").alias("subject"), F.col("o").alias("object"),
                   T.normalize_whitespace(F.get(lines, at)).alias("sentence"), F.md5(T.normalize_whitespace("text")).alias("context_md5"))
    return analysis.with_example_columns(rows, ex).select(*SHOW, *READ)


SHOWN_SQL = f"""{_ROLES_SQL.replace(EXAMPLES_SQL + ",", "").strip()},
shown AS (
  SELECT id, v AS verb, s AS subject, o AS object,
         {SQL_NORM.format(f"string_split(text, chr(10))[{sql_bucket("'line:' || CAST(id AS VARCHAR)", "len(string_split(text, chr(10)))")} + 1]")} AS sentence,
         md5({SQL_NORM.format('text')}) AS context_md5 FROM roles
)"""


def sample_head(spark, sf_dir):
    """First five rows of the seeded analysis sample (sample order)."""
    return shown(spark, sf_dir, head(_sample(spark, sf_dir), 5, ["sample_key", "id"]).select(*SHOW))


register("sample_head", f"""
WITH {SAMPLE_SQL}, {SHOWN_SQL}
SELECT {", ".join(f"h.{c}" for c in SHOW)}, {", ".join(READ)}
FROM (SELECT * FROM smp ORDER BY sample_key, id LIMIT 5) h JOIN shown ON h.id = shown.id
""")(sample_head)


def sample_label_counts(spark, sf_dir):
    """Context label counts over the analysis sample (null is a group)."""
    return analysis.group_counts(_sample(spark, sf_dir), ["ctx_label"])


register("sample_label_counts", f"""
WITH {SAMPLE_SQL}
SELECT ctx_label, count(*) AS count FROM smp GROUP BY ctx_label
""")(sample_label_counts)


def sample_beyond(spark, sf_dir):
    """Sampled rows annotated as needing more than the sentence."""
    return shown(spark, sf_dir, _sample(spark, sf_dir).where(F.col("ctx_label") == "beyond").select(*SHOW))


register("sample_beyond", f"""
WITH {SAMPLE_SQL}, {SHOWN_SQL}
SELECT {", ".join(f"h.{c}" for c in SHOW)}, {", ".join(READ)} FROM smp h JOIN shown ON h.id = shown.id WHERE ctx_label = 'beyond'
""")(sample_beyond)


def dev_export(spark, sf_dir):
    """Dev rows with their example columns and every model's prediction,
    written as CSV and read back as R reads it (empty and ``NA`` are null)."""
    rows = _roles(spark, sf_dir).select(
        "id", "partition", F.col("v").alias("verb"), F.col("s").alias("subject"), F.col("o").alias("object"),
        T.normalize_whitespace("text").alias("min_context"))
    wide = analysis.predictions_wide(predictions(spark, sf_dir).where(F.col("split") == "dev"))
    path = shared_path(spark, "dev-export")
    readers.write_csv(analysis.with_example_columns(wide, rows), path)
    back = readers.read_csv_r(spark, path, "id bigint, genre string, y int, y_pred_l int, y_pred_la int, y_pred_lac int, "
                                           "partition string, verb string, subject string, object string, min_context string")
    return back.withColumn("min_context", F.md5("min_context")).withColumnRenamed("min_context", "context_md5")


register("dev_export", f"""
WITH {DEV_SQL}, {_ROLES_SQL.replace(EXAMPLES_SQL + ",", "").strip()}
SELECT w.id, w.genre, CAST(w.y AS INTEGER) AS y, CAST(y_pred_l AS INTEGER) AS y_pred_l,
       CAST(y_pred_la AS INTEGER) AS y_pred_la, CAST(y_pred_lac AS INTEGER) AS y_pred_lac, r.partition,
       nullif(nullif(r.v, ''), 'NA') AS verb, nullif(nullif(r.s, ''), 'NA') AS subject, nullif(nullif(r.o, ''), 'NA') AS object,
       md5(nullif(nullif({SQL_NORM.format('r.text')}, ''), 'NA')) AS context_md5
FROM wide w JOIN roles r ON w.id = r.id
""")(dev_export)


def error_sample_counts(spark, sf_dir):
    """Per model: wrong dev rows, a seeded sample of them, label counts."""
    return analysis.error_sample_counts(dev_annotated(spark, sf_dir), N_ERRORS, SAMPLE_SEED)


register("error_sample_counts", f"""
WITH {DEV_SQL},
err AS (
  SELECT id, 'l' AS model, y_pred_l AS pred, y, ctx_label FROM devrows
  UNION ALL SELECT id, 'la', y_pred_la, y, ctx_label FROM devrows
  UNION ALL SELECT id, 'lac', y_pred_lac, y, ctx_label FROM devrows
), wrong AS (
  SELECT *, row_number() OVER (PARTITION BY model
                               ORDER BY md5('{SAMPLE_SEED}:' || CAST(id AS VARCHAR)), id) AS rk
  FROM err WHERE pred <> y
)
SELECT model, ctx_label, count(*) AS count FROM wrong WHERE rk <= {N_ERRORS} GROUP BY model, ctx_label
""")(error_sample_counts)


# Stand-in reasoning type of a 'beyond' example, by language.
REASONING_BY_LANG = {"en": "explicit", "fr": "implicit", "de": "err", "es": "beyondplus"}


def reasoning_counts(spark, sf_dir):
    """Reasoning types needed by the 'beyond' examples, counted."""
    m = F.create_map(*[F.lit(x) for kv in REASONING_BY_LANG.items() for x in kv])
    types = (annotations(spark, sf_dir).where(F.col("ctx_label") == "beyond")
             .select("id", F.element_at(m, F.col("lang")).alias("ctx_type")))
    return analysis.group_counts(types, ["ctx_type"])


_rcase = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REASONING_BY_LANG.items())
register("reasoning_counts", f"""
WITH {ANNOTS_SQL.strip()}
SELECT CASE lang {_rcase} END AS ctx_type, count(*) AS count
FROM annots WHERE ctx_label = 'beyond' GROUP BY 1
""")(reasoning_counts)
