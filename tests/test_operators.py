import json

from pyspark.sql import functions as F

from sladd.operators import aggregates, audit, flags, language, markup, tables
from sladd.plans.analyze import anonymize, with_spans
from sladd.rules.media import COMMENT_REMOVED, IMAGE_REMOVED, VIDEO_REMOVED
from sladd.rules.special import SPECIAL_CATEGORIES
from sladd.sources import readers, writers


def test_wide_table(spark):
    df = spark.createDataFrame(
        [(1, "Ola", "91234567", "ring meg på 91234567", 5), (2, "[NAME]", " ", "ingen", None), (3, None, "x", None, 1)],
        "id int, navn string, telefon string, merknad string, kontonummer int")
    rows = tables.redact_table(df).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [
        (1, "[NAME]", "[PHONE]", "ring meg på [PHONE]", 5), (2, "[NAME]", " ", "ingen", None), (3, None, "[PHONE]", None, 1)]
    again = tables.redact_table(tables.redact_table(df).select(*df.columns)).orderBy("id").collect()
    assert again == rows
    profile = {r.column_name: (r.forced, r.cells, r.masked) for r in tables.column_profile(df).collect()}
    assert profile == {"navn": (True, 2, 1), "telefon": (True, 2, 2), "merknad": (False, 2, 1)}


def test_header_gives_context_and_is_cut_off_again(spark):
    df = spark.createDataFrame([(1, "9020", "9020")], "id int, `post kode` string, annet string")
    cells = F.array(F.struct(F.lit("Postkode").alias("h"), F.lit("9020").alias("v")),
                    F.struct(F.lit("Annet").alias("h"), F.lit("9020").alias("v")),
                    F.struct(F.lit("Storgata 5").alias("h"), F.lit("ring 91234567").alias("v")))
    out = tables.redact_value_cells(df, cells, "out").first().out
    assert out == ["[POSTNUMMER]", "9020", "ring [PHONE]"]


def test_cell_tables(spark):
    cells = spark.createDataFrame(
        [(1, 0, 0, 0, "Navn"), (1, 0, 0, 1, "Merknad"), (1, 0, 1, 0, "Ola"), (1, 0, 1, 1, "tlf 91234567"),
         (1, 0, 20, 0, " "), (2, 0, 0, 0, "Kari ringte 91234567"), (2, 0, 1, 0, "Navn")],
        "doc_id int, table_no int, row_no long, col_no int, text string")
    got = {tuple(r[:4]): r.text for r in tables.redact_cells(cells).collect()}
    assert got == {(1, 0, 0, 0): "Navn", (1, 0, 0, 1): "Merknad", (1, 0, 1, 0): "[NAME]", (1, 0, 1, 1): "tlf [PHONE]",
                   (1, 0, 20, 0): " ", (2, 0, 0, 0): "[NAME] ringte [PHONE]", (2, 0, 1, 0): "Navn"}


def test_flags(texts):
    df = texts("pasient med diabetes", "Norsk Sykepleierforbund", "stemte på Venstre", "mr-bilder og trade-union", " ", "non binary",
               "Jehovah's Witnesses", "barsk måned")
    rows = df.select("unit_id", flags.special_categories(F.col("text")).alias("c")).orderBy("unit_id").collect()
    label = {k: l for k, (l, _) in zip(flags.SPECIAL_KEYS, SPECIAL_CATEGORIES)}
    want = [["health"], [], ["political"], ["health", "union"], [], ["sexual"], ["religion"], []]
    assert [r.c for r in rows] == [[label[k] for k in w] for w in want]


def test_language_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = spark.createDataFrame([(-1, "Vi vil gjerne ha svar på søknaden før møtet på torsdag neste uke.", "no"), (-2, "kort", None)],
                                "doc_id long, text string, lang string")
    found = language.detect_language(docs.select("doc_id", "text", "lang").unionByName(own), language.train_profiles(docs.where("doc_id % 2 = 0")))
    got = found.join(docs.select("doc_id", "lang").unionByName(own.select("doc_id", "lang")), "doc_id").collect()
    unseen = [r for r in got if r.doc_id % 2]
    assert sum(r.language == r.lang for r in unseen) >= 0.9 * len(unseen)
    assert {r.doc_id: r.language for r in got if r.doc_id < 0} == {-1: "no", -2: None}


def test_sample_head_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, i, f"t{i}") for i in range(9)], "c int, k int, text string")
    head = language.sample_head(df, "c", "k", "text", 3)
    assert head.first().sample == "t0 t1 t2"
    assert "WindowGroupLimit" in head._jdf.queryExecution().optimizedPlan().toString()


def test_markup(spark):
    html = ('<title>Sak Kari</title><meta name="author" content="Kari"><!-- a --><p>x <del>gammel</del><ins>ny</ins>'
            '<img src="a"><video><img src="b"></video>tlf 91234567</p><!--b\n-->')
    row = markup.anonymize_page(spark.createDataFrame([(1, html)], "page_id int, html string")).first()
    assert row.redacted == f"<title></title><p>x ny{IMAGE_REMOVED}{VIDEO_REMOVED}tlf [PHONE]</p>"
    assert row.counts == {COMMENT_REMOVED: 2, IMAGE_REMOVED: 1, VIDEO_REMOVED: 1, "[PHONE]": 1}


def test_counts(texts):
    units = with_spans(texts("Kari og Per, tlf 91234567", "Ola", "ingen"))
    counts = aggregates.label_counts_unit(units)
    assert {tuple(r) for r in counts.collect()} == {(0, "[NAME]", 2), (0, "[PHONE]", 1), (1, "[NAME]", 1)}
    docs = aggregates.label_counts_doc(counts.withColumn("doc_id", F.lit(7)))
    assert aggregates.label_counts_map(docs).first().pii_found == {"[NAME]": 3, "[PHONE]": 1}
    assert [tuple(r) for r in aggregates.summary_sorted(docs).collect()] == [("[NAME]", 3), ("[PHONE]", 1)]
    assert {tuple(r) for r in aggregates.total_replacements(docs).collect()} == {(7, 4), (None, 4)}


def test_audit_and_errors(spark, texts, tmp_path):
    docs = texts("Kari har diabetes", "ingen")
    records = audit.audit_records(docs, spark.createDataFrame([(0, "de")], "unit_id long, language string"), doc="unit_id")
    rows = {r.unit_id: r for r in records.collect()}
    assert rows[0].pii_found == {"[NAME]": 1} and rows[0].language_warning and rows[0].article9_manual_review_required
    assert rows[1].detected_language == "unknown" and not rows[1].language_warning and rows[1].total_replacements == 0
    writers.audit_sink(records, str(tmp_path / "audit"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "audit")).collect()]
    assert len(lines) == 2 and all(line["timestamp"].endswith("+00:00") for line in lines)
    inputs = spark.createDataFrame([(1, b"ok"), (2, b"\xff"), (3, None)], "k int, content binary")
    paths = spark.createDataFrame([(3, "/in/c.txt", None)], "k int, input_path string, output_path string")
    good, errors = audit.error_isolation(inputs, "k", paths=paths)
    assert [r.k for r in good.orderBy("k").collect()] == [1, 2]
    row = errors.first()
    assert (row.k, row.error, row.status, row.input_file, row.total_replacements, row.pii_found) == (3, "missing content", "error", "c.txt", 0, {})
    assert [f for f in errors.columns if f != "k"] == [f for f in records.columns if f != "unit_id"] == list(audit.FIELDS)


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in {"a.txt": "﻿blåbær\r\nx".encode(), "b.txt": "blåbær\rx".encode("latin-1")}.items():
        (tmp_path / "in" / name).write_bytes(data)
    got = sorted((r.path[-5:], r.text) for r in readers.read_text_units(spark, str(tmp_path / "in")).collect())
    assert got == [("a.txt", "blåbær\nx"), ("b.txt", "blåbær\nx")]
    (tmp_path / "t.csv").write_bytes('﻿navn,nr,tekst\nOla,007,"a ""b"",\nc"\nKari,1\n'.encode())
    table = readers.read_csv_text(spark, str(tmp_path / "t.csv"))
    assert table.columns == ["navn", "nr", "tekst", "overflow"]
    assert [tuple(r) for r in table.collect()] == [("Ola", "007", 'a "b",\nc', None), ("Kari", "1", None, None)]
    (tmp_path / "u.csv").write_text('navn,merknad\nKari,y,91234567,"a ""q"", kari@x.no"\nOla,z,\n')
    wide = readers.read_csv_text(spark, str(tmp_path / "u.csv"))
    assert [r.overflow for r in wide.collect()] == [["91234567", 'a "q", kari@x.no'], [""]]
    assert [tuple(r) for r in tables.redact_table(wide).collect()] == [("[NAME]", "y", ["[PHONE]", 'a "q", [EMAIL]']), ("[NAME]", "z", [""])]
    out = writers.write_redacted(table, str(tmp_path / "out"), run_ts="2026-01-01_000000")
    assert spark.read.parquet(out).count() == 2
    kinds = readers.manifest_triage(
        spark.createDataFrame([("a/b.TXT",), ("x.jpeg",), ("v.webm",), ("l.opus",), ("z",), ("d.x/y",)], "path string"), "path")
    assert [r.kind for r in kinds.collect()] == ["supported", "image", "video", "audio", "unsupported", "unsupported"]


def test_stream_takes_the_batch_plan(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1, "text": "tlf 91234567"}\n')
    stream = spark.readStream.schema("id int, text string").json(str(tmp_path / "in"))
    query = (anonymize(stream, keep_spans=False).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "tlf [PHONE]", 1)]


def test_counts_of_tables(spark):
    df = spark.createDataFrame([("Ola", "ring 91234567", ["kari@x.no"]), ("[NAME]", "Kari Hansen", None), (" ", None, ["x", "y 91234567"])],
                               "navn string, merknad string, mer array<string>")
    rows = [r.n for r in tables.redact_table(df, counts="n").collect()]
    assert rows == [{"[EMAIL]": 1, "[NAME]": 1, "[PHONE]": 1}, {"[NAME]": 2}, {"[PHONE]": 1}]
    assert {tuple(r) for r in tables.table_label_counts(df).collect()} == {("[EMAIL]", 1), ("[NAME]", 3), ("[PHONE]", 2)}


def test_name_join_paths_agree(spark, texts, monkeypatch):
    from sladd.operators import joins

    names = joins.word_table(spark, ["Ann Mari Olsen", "Kari", "Da Silva"], "name")
    df = texts("Ann Mari Olsen og Kari", "ord " * 3000 + "Da Silva", "ingen", "")
    want = {(0, 0, 14, "Ann Mari Olsen"), (0, 18, 22, "Kari"), (1, 12000, 12008, "Da Silva")}
    assert {tuple(r) for r in joins.name_list_join(df, names).collect()} == want
    monkeypatch.setattr(joins, "BROADCAST_WORDS", 1)
    assert {tuple(r) for r in joins.name_list_join(df, names).collect()} == want


def test_propagation_folds_case_as_the_pattern_does(spark, texts):
    from sladd.operators import joins
    from sladd.rules.detectors import BY_KEY

    df = texts("Karin er her, KARİN der", "Olsen og Olſen, OLSEN", "ingen", "Kari, kari. karismatisk")
    got = [r.redacted for r in joins.value_propagation(df, detectors=[BY_KEY["name_list"]]).orderBy("unit_id").collect()]
    assert got == ["[NAME] er her, [NAME] der", "[NAME] og [NAME], [NAME]", "ingen", "[NAME], [NAME]. [NAME]smatisk"]


def test_model_spans_are_checked(spark, texts):
    from sladd.operators import hooks

    def model(batch):
        return [[("PERSON", 0, 3, 0.9), ("NRP", 0, 3, 0.9), ("PERSON", None, 2, 0.9), ("PERSON", 2, 99, 0.9), ("PERSON", 2, 2, 0.9)] for _ in batch]

    df = texts("Ola er her")
    assert [(s.entity, s.start, s.end, s.src) for s in hooks.with_model_spans(df, model).first().external] == [("PERSON", 0, 3, 1)]
    assert [s.entity for s in hooks.with_model_spans(df, model, primary=True).first().external] == ["PERSON", "NRP"]


def test_scratch_is_shared(spark):
    assert not writers.scratch_folder(spark).startswith("/tmp/sladd") and writers.scratch_folder(spark, "hdfs://x/y").startswith("hdfs://x/y/sladd-")
