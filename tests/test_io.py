from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import validate as v
from quillgraph.sources import graph_io as io


def graph(spark):
    e = spark.createDataFrame([("a & b", "t<1>", ["x", 'say "hi"'], ["T"], 5.0, None, None)], io.ENTITY)
    r = spark.createDataFrame([("a & b", "c", "knows", 0.5)], io.RELATION)
    return e, r


def test_jsonl_last_line_wins(spark, tmp_path):
    lines = ['{"type":"entity","name":"a","entityType":"old","observations":[]}', "not json", '{"type":"entity","name":"a","entityType":"new","observations":["o"]}', '{"type":"relation","from":"a","to":"b","relationType":"r","weight":1}', '{"type":"relation","from":"a","to":"b","relationType":"r","weight":2}']
    (tmp_path / "g.jsonl").write_text("\n".join(lines))
    e, r = io.read_jsonl(spark, str(tmp_path / "g.jsonl"))
    assert [(x.name, x.entityType) for x in e.collect()] == [("a", "new")]
    assert [x.weight for x in r.collect()] == [2.0]


def test_jsonl_round_trip(spark, tmp_path):
    e, r = graph(spark)
    io.jsonl(e, r).write.text(str(tmp_path / "out"))
    e2, r2 = io.read_jsonl(spark, str(tmp_path / "out"))
    assert e2.select(e.columns).collect() == e.collect() and r2.collect() == r.collect()


def test_text_formats(spark):
    e, r = graph(spark)
    assert 'id="a &amp; b"' in io.graphml(e, r).filter("part = 0").collect()[0].value
    assert io.dot(e, r).filter("part = 1").collect()[0].value == '"a & b" -> "c" [label="knows"];'
    assert io.mermaid(e, r).filter("part = 1").collect()[0].value == "a___b -->|knows| c"
    assert io.csv_lines(e.select("name", "observations")).collect()[0].value == 'a & b,"x; say ""hi"""'
    t = spark.createDataFrame([("s 1", "p", 'o "q"')], "s string, p string, o string")
    assert io.turtle(t).collect()[0].value == '<urn:kg:s+1> <urn:kg:p> "o \\"q\\"" .'


def test_markdown(spark):
    e, r = graph(spark)
    bare = spark.createDataFrame([("b", None, None, None, None, None, None), ("q", "t", [], [], None, None, None)], io.ENTITY)
    got = [x.value for x in io.markdown(e.unionByName(bare), r).orderBy("part", "value").collect()]
    assert got == [
        '### a & b\n\n- **Type:** t<1>\n- **Tags:** `T`\n- **Importance:** 5/10\n\n**Observations:**\n- x\n- say "hi"\n',
        "### b\n\n- **Type:** \n", "### q\n\n- **Type:** t\n", "- **a & b** \u2192 *knows* \u2192 **c**",
    ]
    assert io.markdown(e.limit(0), r.limit(0)).count() == 0


def test_mermaid_quotes(spark):
    e, r = graph(spark)
    quoted = e.withColumn("name", F.lit('a "b"'))
    assert io.mermaid(quoted, r).filter("part = 0").collect()[0].value == 'a__b_["a #quot;b#quot;"]'


def test_rules(spark):
    df = spark.createDataFrame([("a@b.org", 5.0, "2024-01-01"), (None, 11.0, "x")], "mail string, importance double, day string")
    got = v.problems(df, v.required("mail"), v.email("mail"), v.between("importance", 0, 10), v.iso_date("day")).collect()
    assert [len(r.problems) for r in got] == [0, 4]
    moves = df.select(v.transition_allowed(F.lit(None).cast("string"), F.lit("archived"), {"draft": ["published"], "published": ["archived"]}).alias("ok"))
    assert moves.first().ok
