"""Names in nested records, and placeholders of terms that look like placeholders."""

from pyspark.sql import functions as F

from timedtext.operators import texts as X

SCHEMA = """video_id long, name string, scene_id string, n int,
record struct<summary: string, aliases: array<string>, clip_url: string, said: array<struct<who: string, path: string>>>,
notes map<string, string>, artifact_paths map<string, string>"""


def test_names_in_nested_records(spark):
    rows = spark.createDataFrame(
        [
            (1, "Bo", "Bo", 3, ("Bo and  Al", ["Bo"], "Bo", [("Bo", "Bo"), (None, None)]), {"text": "Bob, Bo", "file_path": "Bo"}, {"x": "Bo"}),
            (2, "Bo", "Bo", None, None, None, None),
            (None, "Bo", None, 1, (None, None, None, []), {}, {}),
        ],
        SCHEMA,
    )
    aliases = spark.createDataFrame([(1, "Bo", "Robert Bo", 1), (1, "Bo", "Late", 2), (1, "Al", "Alan", 1)], "video_id long, alias string, canonical string, priority int")
    out = X.replace_names_nested(rows, aliases)
    assert out.schema == rows.schema
    got = {r.video_id: r.asDict(True) for r in out.collect()}
    assert got[1] == {
        "video_id": 1, "name": "Robert Bo", "scene_id": "Bo", "n": 3,
        "record": {"summary": "Robert Bo and  Alan", "aliases": ["Bo"], "clip_url": "Bo", "said": [{"who": "Robert Bo", "path": "Bo"}, {"who": None, "path": None}]},
        "notes": {"text": "Bob, Robert Bo", "file_path": "Bo"}, "artifact_paths": {"x": "Bo"},
    }
    assert got[2] == {"video_id": 2, "name": "Bo", "scene_id": "Bo", "n": None, "record": None, "notes": None, "artifact_paths": None}
    assert got[None]["name"] == "Bo" and got[None]["record"] == {"summary": None, "aliases": None, "clip_url": None, "said": []}
    assert X.replace_names_nested(rows.limit(0), aliases).collect() == []


def test_placeholders_come_back(spark):
    terms = ["foo bar", "0", "1"]
    texts = ["foo bar is 0", "[[0]] and [[1]] or [[x", "[foo bar] [[[0]]] 1", "[[-]] 0 [[", "", "0[[0"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("m", X.mask_terms("t", terms))
    rows = d.select("t", "m", X.unmask_terms("m", terms).alias("u")).collect()
    assert [r.u for r in rows] == texts
    assert rows[0].m == "[[0]] is [[1]]"
    assert d.where(F.col("t") == "").first().m == ""
