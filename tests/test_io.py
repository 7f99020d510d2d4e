"""Readers, writers and the streaming form."""

import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from gridmosaic.operators import prompts as P, responses as R
from gridmosaic.plans import score, visual
from gridmosaic.sources import files as SF, sinks as SK
from gridmosaic.streaming import landing


def test_jsonl_last_line_wins(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join(json.dumps({"id": i % 5, "v": i}) for i in range(500)) + "\n")
    out = SF.read_jsonl(spark, str(path), "id bigint, v bigint", key="id")
    assert {r.id: r.v for r in out.collect()} == {i: 495 + i for i in range(5)}
    assert SF.read_jsonl(spark, str(path), "id bigint, v bigint").count() == 500


def test_json_map_both_ways(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("b", None)], "k string, v string")
    SK.write_json_map(df, "k", "v", str(tmp_path / "m"))
    assert sorted(SF.read_json_map(spark, str(tmp_path / "m")).collect()) == [("a", "1"), ("b", None)]
    many = spark.range(5000).select(F.format_string("k%05d", "id").alias("k"), F.concat(F.lit("{,}\n"), F.col("id").cast("string")).alias("v"))
    SK.write_json_map(many.repartition(7), "k", "v", str(tmp_path / "n"))
    whole = json.loads("".join(p.read_text() for p in sorted((tmp_path / "n").glob("part-*"))))
    assert len(whole) == 5000 and whole["k00042"] == "{,}\n42"
    assert dict(map(tuple, SF.read_map_lines(spark, str(tmp_path / "n")).collect())) == whole


def test_jsonl_sink_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", None)], "k string, v string")
    SK.write_jsonl(df, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert json.loads(text) == {"k": "a", "v": None} and text.strip() == SK.record_lines(df).first().line


def test_delimited_drops_index_columns(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("Unnamed: 0\tid\ttitle\n0\t7\tx y\n")
    out = SF.read_delimited(spark, str(tmp_path / "t.tsv"))
    assert out.columns == ["id", "title"] and out.first().title == "x y"
    (tmp_path / "u.tsv").write_text("\tid\t_country\n0\t7\tFR\n")
    assert SF.read_delimited(spark, str(tmp_path / "u.tsv")).columns == ["id", "_country"]


def test_images_and_request_files(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.jpg").write_bytes(b"\xff\x00x")
    images = SF.read_images(spark, str(tmp_path / "img"))
    rows = spark.createDataFrame([(i, f"q{i}", "a.jpg" if i % 2 else "none.jpg") for i in range(205)], "key bigint, prompt string, path string")
    sent = P.request_rows(SF.attach_base64(rows, "path", images), "m")
    chunks = SK.chunk_requests(sent, "key")
    assert {r.chunk: r["count"] for r in chunks.groupBy("chunk").count().collect()} == {0: 100, 1: 100, 2: 5}
    SK.write_chunks(chunks, str(tmp_path / "out"), order=("key",))
    files = list((tmp_path / "out").glob("chunk=*/part-*"))
    assert len(files) == 3
    first = {json.loads(line)["custom_id"]: json.loads(line) for f in files for line in f.read_text().splitlines()}
    for f in files:
        keys = [json.loads(line)["custom_id"] for line in f.read_text().splitlines()]
        assert keys == sorted(keys)
    content = first[1]["body"]["messages"][0]["content"]
    assert content[1]["image_url"]["url"] == "data:image/jpeg;base64," + base64.b64encode(b"\xff\x00x").decode()
    assert len(first[0]["body"]["messages"][0]["content"]) == 1 and len(first) == 205


def test_stream_keeps_each_result_once(spark, tmp_path):
    land, table, state = (str(tmp_path / n) for n in ("land", "table", "state"))
    (tmp_path / "land").mkdir()

    def put(name, rows):
        (tmp_path / "land" / name).write_text("".join(json.dumps({"key": k, "value": v}) + "\n" for k, v in rows))
        query = landing.keep_results(landing.landed_results(spark, land), table, state)
        query.awaitTermination()

    put("1.json", [("a", "1"), ("b", None)])
    put("2.json", [("a", "2"), ("c", "3")])
    assert {r.key: r.value for r in landing.stored_results(spark, table).collect()} == {"a": "2", "c": "3"}
    keys = spark.createDataFrame([(k,) for k in "abcd"], "key string")
    assert {r.key for r in landing.open_keys(spark, keys, table).collect()} == {"b", "d"}


def test_stream_keeps_the_last_result(spark, tmp_path):
    """A key twice in a file, in two files of a batch, in two batches, and in a file that is read late; the stream restarts each time."""
    (tmp_path / "land").mkdir()

    def put(*files):
        for name, time, rows in files:
            path = tmp_path / "land" / name
            path.write_text("".join(json.dumps({"key": k, "value": v}) + "\n" for k, v in rows))
            os.utime(path, (time, time))
        land = landing.landed_results(spark, str(tmp_path / "land"))
        landing.keep_results(land, str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
        return {r.key: r.value for r in landing.stored_results(spark, str(tmp_path / "table")).collect()}

    day = 1_700_000_000
    assert put(("b.json", day + 10, [("a", "9"), ("a", "1"), ("c", "x")]), ("a.json", day + 20, [("c", "b")])) == {"a": "1", "c": "b"}
    assert put(("c.json", day + 30, [("a", "0"), ("d", "y"), ("d", None)])) == {"a": "0", "c": "b", "d": "y"}
    assert put(("0.json", day + 15, [("a", "late"), ("c", "late"), ("e", "late")])) == {"a": "0", "c": "b", "d": "y", "e": "late"}


def test_score_plan(spark):
    lines = spark.createDataFrame([
        (json.dumps({"key": "1", "response": "Step 2: ['Paris']", "gold_ans": "paris", "prompt": "p"}),),
        (json.dumps({"2": {"image": "i", "text": "t", "response": "Error occurred.", "gold_ans": "x"}}),),
        (json.dumps({"3": {"image": "i", "text": "t", "response": "Step 2: in Rome", "gold_ans": "rome"}}),),
    ], "value string")
    sample = spark.createDataFrame([("1", "paris"), ("2", "x"), ("3", "rome"), ("4", "y")], "key string, gold string")
    out = score.score_run(lines, sample, style="loose").first()
    assert (out.n_all, out.n, out.exact, out.substring) == (4, 3, 1, 2)


def test_visual_plan(spark):
    prompts = spark.createDataFrame([("1:a", "p1"), ("2:b:c", "p2")], "key string, prompt string")

    def run(*rows):
        return spark.createDataFrame(list(rows), "key string, value string")

    first = run(("1:a", '```json\n{"Rephrased Question": ""}\n```'), ("2:b:c", "broken {"))
    parsed, again = visual.rephrased(prompts, first, run(("2:b:c", '{"Rephrased Question": "q"}')), run())
    assert [r.key for r in again.collect()] == ["1:a"]
    assert {r.key: r.is_parsed for r in parsed.collect()} == {"1:a": True, "2:b:c": True}
    told = visual.parsed_attributes(spark.createDataFrame([("i1", '{"c": ["red"]}'), ("i2", "no")], "path string, response string"))
    assert [(r.path, r.attributes) for r in told.collect()] == [("i1", {"c": ["red"]})]
    images = spark.createDataFrame([(1, "i1"), (1, "i3")], "group_id int, image_id string")
    attributes = spark.createDataFrame([("i1", {"c": ["red", "big"]}), ("i3", {"c": ["big"]})], "image_id string, attributes map<string,array<string>>")
    unique = visual.unique_to_key(images, attributes, images.where("image_id = 'i1'"))
    assert [(r.attribute, r.value) for r in unique.collect()] == [("c", "red")]
    assert R.attribute_rows(attributes, keep=("image_id",)).select(F.count(F.lit(1))).first()[0] == 3
