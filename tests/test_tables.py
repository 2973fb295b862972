"""Sources, sinks, manifests, policies, log, quality, jobs, streams."""

import json

import pytest
from pyspark.sql import functions as F

from veilframe import session
from veilframe.operators import linking, manifest, policies, quality, reports, request_log, vault
from veilframe.operators.detect import builtin, with_spans
from veilframe.operators.redact import redact_frame
from veilframe.options import AddressOptions, AgeOptions, NameOptions, Options, from_json, to_json
from veilframe.plans import jobs
from veilframe.policy import Policy
from veilframe.sources import parsed, texts
from veilframe.streaming import redaction

CONVO = 'id,text\n1,"order 5, from nora"\n2,"ask pavel"\n1,"sent\nwith ""care"""\n'
POLICY = Policy(default="Off", config={"NAME_GIVEN": "Redaction"}, allow={"NAME_GIVEN": ["nora", "pavel"]}, claim_off=False)


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text(CONVO)
    jobs.redact_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), POLICY, True, "text", "id")
    back = texts.read_csv(spark, str(tmp_path / "out"), True).collect()
    assert [r.id for r in back] == ["1", "2", "1"]
    assert "nora" not in back[0].text and back[0].text.startswith("order 5, from [NAME_GIVEN_")
    assert back[2].text == 'sent\nwith "care"'
    raw = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert raw.startswith('"id","text"\n"1",')


def test_csv_without_header_and_group(spark, tmp_path):
    (tmp_path / "in.csv").write_text('1,"no"\n1,"ra"\n')
    policy = Policy(default="Off", config={"NAME_GIVEN": "Redaction"}, allow={"NAME_GIVEN": ["no\nra"]}, claim_off=False)
    jobs.redact_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), policy, False, "1")
    back = texts.read_csv(spark, str(tmp_path / "out"), False)
    assert back.columns == ["0", "1"]
    rows = back.collect()
    assert rows[0]["1"] == rows[1]["1"] and rows[0]["1"].startswith("[NAME_GIVEN_")


def test_csv_bad_rows_nulls_and_empty(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("id,text\n1,a\n2\n")
    with pytest.raises(Exception, match="wider or narrower"):
        texts.read_csv(spark, str(tmp_path / "bad.csv"), True).collect()
    kept = texts.read_csv(spark, str(tmp_path / "bad.csv"), True, strict=False)
    assert [r._corrupt_record is not None for r in kept.collect()] == [False, True]
    with pytest.raises(Exception, match="wider or narrower"):
        texts.read_csv(spark, str(tmp_path / "bad.csv"), True).count()
    (tmp_path / "empty.csv").write_text("id,text\n")
    empty = texts.read_csv(spark, str(tmp_path / "empty.csv"), True)
    assert empty.columns == ["id", "text"] and empty.count() == 0
    (tmp_path / "null.csv").write_text("a|'b'|\\N\n")
    (row,) = texts.read_csv(spark, str(tmp_path / "null.csv"), False, quote="'", delimiter="|").collect()
    assert row[1] == "b" and row[2] is None


def test_text_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("I am nora\nyes")
    jobs.redact_files(spark, str(folder), str(tmp_path / "out"), POLICY)
    out = (tmp_path / "out" / "a.txt").read_text()
    assert out.startswith("I am [NAME_GIVEN_") and out.rstrip("\n").endswith("yes")
    assert texts.read_training(spark, str(folder)).columns == ["fileName", "text"]
    assert texts.from_strings(spark, ["a", None]).count() == 2


def test_annotations(spark, tmp_path):
    rows = [{"text": "a", "spans": [{"start": 0, "end": 1}]}, {"text": "b", "spans": [], "fileName": "x"}]
    (tmp_path / "g.jsonl").write_text("\n".join(json.dumps(r) for r in rows[:1]) + "\n\n" + json.dumps(rows[1]) + "\n")
    got = texts.read_gold(spark, str(tmp_path / "g.jsonl")).collect()
    assert [r.fileName for r in got] == ["test_file_0.txt", "x.txt"]


def test_parsed_document_files(spark, tmp_path):
    doc = {"fileType": "Xlsx", "schemaVersion": 1, "content": {"text": "", "hash": "1B2M2Y8AsgTpgAmY7PhCfg==", "entities": []},
           "tables": [{"tableName": "s1", "header": ["h"], "data": [[{"text": "v", "hash": "x", "entities": []}]]}]}
    (tmp_path / "f.json").write_text(json.dumps(doc, indent=1))
    docs = parsed.read_documents(spark, str(tmp_path / "f.json"))
    (cell,) = parsed.cells(docs).collect()
    assert (cell.doc_id, cell.table_name, cell.header, cell.text) == ("f.json", "s1", "h", "v")
    (row,) = docs.select(F.col("content.hash") == parsed.expected_hash("content.text")).collect()
    assert row[0]


def test_policy_rows_and_options(spark):
    policy = Policy(
        default="Off",
        config={"EMAIL_ADDRESS": "Redaction", "PERSON_AGE": "Synthesis"},
        options={"PERSON_AGE": AgeOptions(shift_years=3), "URL": Options(constant="c")},
        allow={"NRP": ["x"]},
        block={"NRP": ["y"]},
    )
    rows = policies.to_rows(spark, "a", policy)
    back = policies.from_rows(rows, "a")
    assert back.config == policy.config and back.options == policy.options
    assert back.allow == policy.allow and back.block == policy.block and back.default == "Off"
    assert policies.invalid_rows(rows).count() == 0
    copied = policies.copied(rows, "a", "b")
    assert policies.from_rows(copied, "b").config == policy.config
    with pytest.raises(ValueError):
        policies.copied(rows, "a", "b", name="x")
    assert back.enabled_labels() == ["EMAIL_ADDRESS", "PERSON_AGE"]


def test_policy_rows_keep_everything(spark):
    policy = Policy(
        default="Synthesis",
        config={"URL": "Off", "CASE-NO": "Redaction"},
        custom={"CASE-NO": ["C[0-9]+"], "UNUSED": ["u"]},
        custom_entities=("CASE-NO",),
        path_allow={"URL": ["$.a"]},
        path_ignore=("$.b",),
        seed="seven",
        token_width=24,
        claim_off=False,
    )
    rows = policies.to_rows(spark, "a", policy)
    assert policies.from_rows(rows, "a") == policy
    assert policies.from_rows(policies.copied(rows, "a", "b"), "b") == policy


def test_tokens_of_any_label_come_back(spark):
    policy = Policy(
        default="Off",
        config={"CASE-NO": "Redaction"},
        custom={"CASE-NO": ["C[0-9]{4}"]},
        custom_entities=("CASE-NO",),
    )
    df = spark.createDataFrame([(1, "see C1234 and C1235")], "id int, text string")
    done = redact_frame(df, policy, "text", "id")
    store = vault.vault_of(done)
    assert store.count() == 2
    back = vault.unredact(done.select("id", F.col("redacted_text").alias("text")), store, "id", "text")
    assert "see C1234 and C1235" in [v for r in back.collect() for v in r]
    with pytest.raises(ValueError, match="names of custom entities"):
        Policy(custom={"a b": ["x"]}, custom_entities=("a b",)).validate()
    assert policy.with_changes(default="Redaction", allow=None).allow == policy.allow
    for options in (NameOptions(case_sensitive=True), AddressOptions(), Options(swaps={"a": 1}, constant=True)):
        assert from_json(to_json(options)) == options
    assert Options(swaps={"a": 1}, constant=True).constant == "True"
    with pytest.raises(ValueError):
        Options(version="V3")


def test_manifest(spark):
    sets = spark.createDataFrame([("a", 1)], "name string, n int")
    made = manifest.created(sets, "b", n=2)
    assert made.count() == 2
    with pytest.raises(manifest.NameExists):
        manifest.created(made, "a")
    with pytest.raises(manifest.NameExists):
        manifest.renamed(made, "a", "b")
    assert {r.name for r in manifest.renamed(made, "a", "c").collect()} == {"c", "b"}
    assert manifest.dropped(made, "a").count() == 1
    with pytest.raises(ValueError):
        manifest.check_add("p", b"c")
    with pytest.raises(ValueError):
        manifest.check_add(None, None)
    files = spark.createDataFrame(
        [("d", 1, 0, "Completed"), ("d", 2, 0, "Running")],
        "dataset string, file_id int, n_columns int, status string",
    )
    cells = spark.createDataFrame([(1, 0, ["whole text"]), (2, 0, ["x"])], "file_id int, row_idx int, values array<string>")
    out = manifest.fetch_all(cells, files)
    assert out.columns[-1] == "text" and out.first().text == "whole text" and out.count() == 1
    none = manifest.fetch_all(cells, files.where("false"))
    assert none.count() == 0
    gold = spark.createDataFrame([("f", 0, 1, "Draft")], "file_name string, start int, end int, status string")
    saved = spark.createDataFrame([("f", 2, 3), ("g", 0, 1)], "file_name string, start int, end int")
    now = manifest.reviewed(gold, saved)
    assert sorted(tuple(r) for r in now.collect()) == [("f", 2, 3, "Reviewed"), ("g", 0, 1, "Reviewed")]
    assert manifest.scorable(now).count() == 2
    done = manifest.quarantined(spark.createDataFrame([(1, None), (2, "bad")], "id int, error string"))
    assert {r.id: r.status for r in done.collect()} == {1: "Completed", 2: "Failed"}
    kinds = spark.createDataFrame([("ModelBased",), ("Regex",)], "entity_type string")
    assert manifest.model_based(kinds).count() == 1


def test_request_log(spark):
    df = spark.createDataFrame([("a", "[X]")], "text string, redacted_text string")
    at = F.expr("TIMESTAMP '2024-01-01 00:00:00'")
    log = request_log.records(df, at, 24, ["t"])
    assert request_log.purged(log, F.expr("TIMESTAMP '2024-01-01 23:59:59'")).count() == 1
    assert request_log.purged(log, F.expr("TIMESTAMP '2024-01-02 00:00:00'")).count() == 0
    for hours in (0, 721):
        with pytest.raises(ValueError, match="1 to 720"):
            request_log.records(df, at, hours)


def test_quality_and_best(spark):
    schema = "f string, start int, end int"
    gold = spark.createDataFrame([("a", 0, 2), ("a", 5, 7), ("b", 1, 2)], schema)
    ours = spark.createDataFrame([("a", 0, 2), ("a", 0, 2), ("a", 4, 7)], schema)
    (row,) = quality.scores(ours, gold, ["f"]).collect()
    assert (row.tp, row.fp, row.fn, row.entity_count) == (1, 1, 2, 3)
    assert row.precision == 0.5 and round(row.f1, 6) == 0.4
    empty = quality.scores(ours.where("false"), gold, ["f"]).first()
    assert empty.precision is None and empty.recall == 0.0
    overlap = {r.f: (r.n_gold, r.n_hit) for r in quality.overlap_recall(ours, gold, "f").collect()}
    assert overlap == {"a": (2, 2), "b": (1, 0)}
    models = spark.createDataFrame([("m2", 0.5), ("m1", 0.5), ("m3", 0.1)], "name string, f1 double")
    assert quality.best(models, "name", "f1").first().name == "m1"


def test_mappings_keep_empty_files(spark):
    df = spark.createDataFrame([(1, "a@b.co", 1, 0), (2, "none", 2, 0)], "id int, text string, row int, col int")
    found = with_spans(df, builtin(["EMAIL_ADDRESS"]))
    rows = reports.mappings(found, Policy(), ["id"], row_number="row", column_index="col")
    out = reports.files_with_mappings(df.select("id"), rows, "id").orderBy("id").collect()
    assert out[0].output_text == out[0].redacted_text and out[0].row_number == 1
    assert out[1].label is None and len(out) == 2


def test_linking(spark):
    spans = spark.createDataFrame(
        [(1, 0, "PERSON", "John Smith"), (1, 30, "NAME_FAMILY", "Mr. Smith"), (1, 50, "NAME_GIVEN", "John"),
         (1, 70, "LOCATION_CITY", "John"), (2, 0, "NAME_FAMILY", "Smith")],
        "doc_id int, start int, label string, text string",
    )
    got = {(r.doc_id, r.start): r.representative for r in linking.group_entities(spans).collect()}
    assert got == {(1, 0): "John Smith", (1, 30): "John Smith", (1, 50): "John Smith", (1, 70): "John", (2, 0): "Smith"}
    assert linking.group_entities(spans.where("false")).count() == 0


def test_user_detector(spark):
    def capitals(batch):
        return [[{"start": 0, "end": 1, "label": "NRP", "score": 0.5}] if t else [] for t in batch]

    df = spark.createDataFrame([(1, "Abc"), (2, None)], "id int, text string")
    detector = jobs.python_detector(capitals, "int", "id")
    rows = {r.id: r for r in jobs.redact_with(df, Policy(), detector, "id").collect()}
    assert rows[1].redacted_text.startswith("[NRP_") and rows[1].redacted_text.endswith("bc")
    assert rows[2].redacted_text is None


def test_job_with_vault(spark, tmp_path):
    df = spark.createDataFrame([(1, "nora and pavel"), (2, "nora")], "id int, text string")
    jobs.redact_table(df, POLICY, str(tmp_path / "o"), str(tmp_path / "v"), key="id")
    done, store = spark.read.parquet(str(tmp_path / "o")), spark.read.parquet(str(tmp_path / "v"))
    back = {r.id: r.unredacted_text for r in vault.unredact(done, store, "id").collect()}
    assert back == {1: "nora and pavel", 2: "nora"} and store.count() == 2


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "nora"), (2, "pavel nora"), (3, None)], "id int, text string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    done = redaction.redact_stream(stream, POLICY, key="id")
    query = redaction.write_with_vault(
        done, str(tmp_path / "o"), str(tmp_path / "v"), str(tmp_path / "c"), availableNow=True
    )
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "o"))
    store = redaction.read_vault(spark, str(tmp_path / "v"))
    assert out.count() == 3 and store.count() == 2
    back = {r.id: r.unredacted_text for r in vault.unredact(out, store, "id").collect()}
    assert back == {1: "nora", 2: "pavel nora", 3: None}


def test_session_helpers(spark):
    df = spark.range(100).withColumn("k", F.lit(1))
    assert session.small(df, "id")
    dim = spark.createDataFrame([(1, "x")], "k int, v string")
    assert session.salted_join(df, dim, "k", "id").where("v = 'x'").count() == 100
    facts = df.withColumn("t", F.expr("CASE WHEN id < 60 THEN 'hot' ELSE concat('t', id) END"))
    vals = [("hot", "H", 60)] + [(f"t{i}", f"v{i}", 1) for i in range(60, 90)] + [("no", "x", 90000)]
    dims = spark.createDataFrame(vals, "t string, v string, n int")
    got = {r.id: r.v for r in session.hot_split_join(facts, dims, "t", "v", "n", "id").collect()}
    assert got == {i: "H" if i < 60 else f"v{i}" if i < 90 else None for i in range(100)}
    assert session.settle(df).count() == 100
    assert session.spread(df.coalesce(1), "id").count() == 100


def test_plans_do_not_shuffle(spark):
    """Redaction is row-local: no exchange, no Python, only the needed columns."""
    from veilframe.operators.redact import redact_frame

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = redact_frame(df, Policy(), key="doc_id").select("redacted_text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<text:string>" in plan
