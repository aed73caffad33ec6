"""Queries on a few rows of their own against their SQL."""

import tempfile

import pytest

from panelframe.plans import load, registry

load()


@pytest.fixture
def differing(spark, tmp_path):
    """The rows of a query that its SQL has not, and the other way round."""
    duckdb = pytest.importorskip("duckdb")

    def compare(name, columns, **tables):
        con = duckdb.connect()
        for t, df in tables.items():
            df.write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        got = {tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()}
        right = set(con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE[name]})").fetchall())
        assert right
        return got ^ right

    return compare


@pytest.mark.parametrize("name,columns", [("d08_decisions", ["doc_id", "decision"]), ("d09_rescue", ["doc_id", "session", "decision"]), ("d10_renumber", ["doc_id", "session", "number"]), ("d11_digest", ["source", "hash"])])
def test_promo_after_a_foreign_letter(spark, differing, name, columns):
    texts = ["story laépatreon tale", "story patreoné tale", "tale éx.com", "tale é-x.comé", "tale of\x0bpatreons", "read at home", "reread\tat home", "Ko-fi", "plain", None]
    docs = spark.createDataFrame([(3 * k + 300 * n, t, "en", f"src{n}", len(t or "")) for n in (1, 2) for k, t in enumerate(texts, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert not differing(name, columns, documents=docs)


def test_least_height_of_a_blank(spark, differing):
    """51 windows of 16 rows: 0.04 of 816 is 32.64; two empty windows have 32 rows."""
    rows = [(1, y + 1, 120.3 if y in (10, 11) else 23.9) for y in range(51)] + [(2, y + 100, 120.3 if y in (10, 11) else 23.9) for y in range(50)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, value double")
    assert not differing("c13_blank_regions", ["strip", "y0", "y1", "verdict"], events=events)


@pytest.mark.parametrize("name", ["c09_absorbed", "c10_split"])
def test_strips_have_no_frame_each(spark, differing, name):
    rows = [(s, 100 * (s or 9) + y, "error" if y % (5 + (s or 3)) == 0 else "view", 30.0) for s in (1, 2, 4) for y in range(90)] + [(7, 5, "error", 30.0)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, event_type string, value double")
    columns = ["strip", "k", "y0", "y1"] if name == "c09_absorbed" else ["strip", "id", "y0", "y1"]
    events.write.parquet("{}/events.parquet".format(folder := tempfile.mkdtemp(prefix="spark-", dir="/tmp")))
    plan = registry.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" in plan and "GroupsInPandas" not in plan
    assert not differing(name, columns, events=events)
