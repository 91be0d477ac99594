"""The verified ablation trains on every place of each vector."""

import hashlib

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from figura.operators.logistic import NewtonLogistic
from figura.plans import q_models
from tools.oracle_check import rows_of, type_diff

VECTORS, WIDTH, DOCS = 40, 5, 700


def vec_id(word):
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % (12 * VECTORS // 10)


def write_tables(at, quality):
    """Documents of one word each and their ``quality``; a few words have no
    vector."""
    words = [a + b for a in "bcdfghklmnprst" for b in "aeiou"]
    emb = [(i, [0.5, 0.01 * (i % 3), 0.02 * (i % 5), 0.0, 1.0 if i % 2 else -1.0], 0) for i in range(VECTORS)]
    text = [words[i * 7 % len(words)] for i in range(DOCS)]
    docs = [(i, text[i], ("en", "de")[i % 2], "web", len(text[i])) for i in range(DOCS)]
    labels = [(i, quality(text[i]), 0) for i in range(DOCS) if i % 9]
    for name, rows, cols in (("documents", docs, "doc_id text lang source n_chars"), ("labels", labels, "doc_id quality toxic"),
                             ("embeddings", emb, "vec_id embedding label")):
        df = pd.DataFrame(rows, columns=cols.split())     # noqa: F841
        cast = ", ".join(f"{c}::FLOAT[] AS {c}" if c == "embedding" else f"{c}::INTEGER AS {c}" if c in ("quality", "toxic", "label") else c for c in cols.split())
        duckdb.sql(f"SELECT {cast} FROM df").write_parquet(str(at / f"{name}.parquet"))
    return str(at)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The quality stands in the last place of the word's vector only."""
    return write_tables(tmp_path_factory.mktemp("whole"), lambda word: vec_id(word) % 2)


def checked(spark, tables):
    """The query's rows, which are those of its SQL."""
    sdf = E.queries()["ablation_logistic"](spark, tables)
    got = sdf.toPandas()
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet')")
    sql = E.oracle_sql()["ablation_logistic"]
    assert not type_diff(sdf, con.sql(sql))
    assert rows_of(got) == rows_of(con.execute(sql).fetchdf())
    return got


def test_ablation_reads_all_places_and_equals_sql(spark, tables):
    got = checked(spark, tables)
    assert dict(zip(got.model, got.n_features)) == {"l": WIDTH, "la": 3 * WIDTH, "lac": 4 * WIDTH}
    known = got[(got.model == "l") & (got.genre == "overall")].iloc[0]
    assert known.accuracy > 0.9 and known.n > 100          # the first places tell nothing


@pytest.mark.parametrize("only", [0, 1])
def test_ablation_of_one_class(spark, tmp_path, only):
    got = checked(spark, write_tables(tmp_path, lambda _: only))
    assert set(got.accuracy) == {1.0}


def test_ablation_trains_to_its_optimum(spark, tables, monkeypatch):
    fitted = []

    class Watched(NewtonLogistic):
        def _fit(self, dataset):
            model = super()._fit(dataset)
            fitted.append((model.steps, self.getMaxIter()))
            return model
    monkeypatch.setattr(q_models, "NewtonLogistic", Watched)
    q_models.ablation_logistic(spark, tables).collect()
    assert len(fitted) == 3 and all(steps < most for steps, most in fitted)
