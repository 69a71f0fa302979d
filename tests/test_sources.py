import base64
import os

from pyspark.sql import functions as F

from mailspark.sources import commits, eml, stores


def write(folder, name, data):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())


PLAIN = ("From: Ann Lee <ann@x.com>\r\nTo: b@y.com\r\nSubject: =?utf-8?B?0J/RgNC40LLQtdGC?= there\r\n"
         "Content-Type: text/plain; charset=utf-8\r\n\r\nHello\r\nбody\r\n")
HTML = "From: w@x.com\nSubject: h\nContent-Type: text/html; charset=utf-8\n\n<p>one</p><p>two</p>"
MULTI = ("From: m@x.com\nSubject: m\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=B\n\n"
         "--B\nContent-Type: text/html; charset=utf-8\n\n<b>html</b>\n"
         "--B\nContent-Type: text/plain; charset=utf-8\n\nplain part\n"
         "--B\nContent-Type: text/plain; charset=utf-8\n\nsecond\n--B--\n")
BADSET = "Subject: c\nContent-Type: text/plain; charset=no-such\nContent-Transfer-Encoding: base64\n\n" + \
         base64.b64encode("текст".encode()).decode()


def test_read_and_parse(spark, tmp_path):
    box = tmp_path / "box"
    write(box, "1.eml", PLAIN)
    write(box, "2.EML", HTML)
    write(box, "3.x.eml", MULTI)
    write(box, "4.eml", BADSET)
    write(box, "5.eml", b"Subject: raw\n\n\xff\xfe text")
    write(box, "6.eml", b"")
    write(box, "a b%+é.eml", HTML)
    write(box, "notes.txt", "x")
    parsed = eml.with_text(eml.parse_messages(eml.read_eml(spark, str(box))))
    got = {r.uid: r for r in parsed.collect()}
    assert set(got) == {"1", "2", "3.x", "4", "5", "6", "a b%+é"}
    assert got["1"].subject == "Привет there" and got["1"].sender == "Ann Lee <ann@x.com>"
    assert got["1"].body == "Hello\n\\u0431ody\n"
    read = eml.parse_messages(eml.read_eml(spark, str(box)), eight_bit=True)
    assert {r.uid: r.body for r in read.collect()}["1"] == "Hello\nбody\n"
    assert got["1"].size_bytes == len(PLAIN.replace("\r\n", "\n").encode())
    assert got["2"].body == "one\ntwo" and got["3.x"].body.strip() == "plain part"
    assert got["4"].body == "текст" and got["5"].raw.endswith("�� text")
    assert got["6"].subject == "" and got["6"].body == "" and got["6"].size_bytes == 0
    assert all(r.parse_error is None for r in got.values())


def test_bare_sender(spark, tmp_path):
    write(tmp_path / "box", "1.eml", PLAIN)
    df = eml.parse_messages(eml.read_eml(spark, str(tmp_path / "box")), bare_sender=True)
    assert df.first().sender == "ann@x.com"


def test_missing_folder_is_empty(spark, tmp_path):
    assert eml.read_eml(spark, str(tmp_path / "none")).count() == 0


def test_errors_are_isolated(spark):
    df = spark.createDataFrame([("1", None), ("2", "boom")], "uid string, parse_error string")
    good, bad = eml.isolate_errors(df)
    assert [r.uid for r in good.collect()] == ["1"] and [tuple(r) for r in bad.collect()] == [("2", "boom")]
    assert eml.parse_message(object())[-1].startswith("AttributeError")


def test_decode_header(rows):
    cases = {"plain": "plain", "=?utf-8?B?0J/RgNC40LLQtdGC?= x": "Привет x",
             "=?koi8-r?Q?=F0?= =?koi8-r?Q?=F2?=": "ПР", "=?no-such?Q?a=D0=9F?=": "aП",
             "=?utf-8?Q?broken": "=?utf-8?Q?broken", "  pad ": "pad"}
    assert rows(list(cases), eml.decode_header(F.col("v"))) == list(cases.values())
    assert rows([None], eml.decode_header(F.col("v"))) == [""]


def uids(df):
    return sorted(r.uid for r in df.collect())


def test_ledger_layouts(spark, tmp_path):
    cases = {"lines": ("1\n 2 \r\n\n3\x0b4\n2\n", ["1", "2", "3", "4"]),
             "json": (' ["1", " 2 ", "", 3]', ["1", "2", "3"]),
             "object": ('{"a": 1}', ['{"a": 1}']),
             "broken": ('["1", ', ['["1",']),
             "empty": ("  \n", [])}
    for name, (text, want) in cases.items():
        write(tmp_path, name, text)
        assert uids(stores.read_ledger(spark, str(tmp_path / name), "auto")) == want, name
    assert uids(stores.read_ledger(spark, str(tmp_path / "lines"))) == ["1", "2", "3", "4"]
    assert uids(stores.read_ledger(spark, str(tmp_path / "none"))) == []


def test_ledger_append(spark, tmp_path):
    path = str(tmp_path / "ledger")
    df = spark.createDataFrame([("1",), (" 2 ",), ("",), (None,), ("1",)], "uid string")
    stores.append_ledger(df, path)
    stores.append_ledger(df, path)
    stores.append_ledger(spark.createDataFrame([(3,)], "uid int"), path)
    assert uids(stores.read_ledger(spark, path)) == ["1", "2", "3"]
    assert commits.read_rows(spark, path).count() == 3
    stores.write_ledger_lines(spark, path, str(tmp_path / "lines"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["1", "2", "3"]
    write(tmp_path / "ledger", "old.txt", "3\n9\n")                 # text files beside committed uids
    assert uids(stores.read_ledger(spark, path)) == ["1", "2", "3", "9"]
    stores.append_ledger(spark.createDataFrame([("9",), ("10",)], "uid string"), path)
    assert commits.read_rows(spark, path).count() == 4


def test_upsert_keeps_the_latest(spark, tmp_path):
    path = str(tmp_path / "store")
    frame = lambda *rows: spark.createDataFrame(list(rows), "uid string, value string")
    stores.write_results(frame(("1", "a"), ("2", "b")), path, "b-1")
    stores.write_results(frame(("2", "c")), path, "b-2")
    get = lambda p=path: {r.uid: r.value for r in stores.read_results(spark, p).collect()}
    assert get() == {"1": "a", "2": "c"}
    stores.write_results(frame(("2", "c")), path, "b-2")      # the same batch again
    assert get() == {"1": "a", "2": "c"} and commits.read_rows(spark, path).count() == 3
    assert not commits.compact(spark, path)                      # no tier is full
    assert commits.compact(spark, path, everything=True)
    assert get() == {"1": "a", "2": "c"} and commits.read_rows(spark, path).count() == 2
    stores.write_results(frame(("3", "d")), path, "b-2")         # replaces rows that were merged
    assert get() == {"1": "a", "3": "d"}
    stores.write_results(frame(("3", "e")), path, "b-3")
    assert commits.compact(spark, path, everything=True)
    assert get() == {"1": "a", "3": "e"}
    assert commits.vacuum(spark, path) == 0 and commits.vacuum(spark, path, -1) > 5
    assert get() == {"1": "a", "3": "e"}


def test_log_records(spark, tmp_path):
    """More commits than between two full records, two writers, a torn record."""
    path = str(tmp_path / "store")
    for n in range(2 * commits.FULL + 3):
        entry = commits.Entry("t", f"a{n}", f"b{n % 30}")
        assert commits.append_log(spark, path, f"b{n % 30}", [entry])
        if n == 25:
            (tmp_path / "store" / "_commits" / f"{n + 2:020d}.json").write_text('{"full": fal')
    version, entries = commits.read_log(spark, path)
    assert version == 2 * commits.FULL + 4
    assert {e.batch: e.attempt for e in entries} == {f"b{n % 30}": f"a{n}" for n in range(2 * commits.FULL + 3)}
    assert len(entries) == 30
    gone = entries[0]
    assert commits.append_log(spark, path, None, [], [gone])
    assert not commits.append_log(spark, path, None, [], [gone])
    assert not commits._put(spark, f"{path}/_commits/{version:020d}.json", "x")


def test_ledger_lookup_reads_few_folders(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    monkeypatch.setattr(commits, "PART_ROWS", 100)
    monkeypatch.setattr(commits, "FAN", 3)
    for n in range(3):
        ids = spark.range(n * 2000, (n + 1) * 2000).select(F.concat(F.lit("m"), "id").alias("uid"))
        stores.upsert(stores.ledger_rows(ids), path, f"b{n}")
    assert commits.compact(spark, path, keys_only=True) and not commits.compact(spark, path, keys_only=True)
    (_, merged), = commits.entries_of(spark, path)
    assert merged.parts == 60 and merged.rows == 6000
    keys = spark.createDataFrame([("m17",), ("m5999",), ("new1",), ("new2",)], "uid string")
    asked, parts = [], commits._parts
    monkeypatch.setattr(commits, "_parts", lambda df: asked.append(parts(df)) or asked[-1])
    found = commits.find_keys(spark, path, keys)
    assert uids(found) == ["m17", "m5999"]
    bitmaps, folders = asked                                  # of 60
    assert len(bitmaps) <= 4 and set(folders) <= set(bitmaps)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan and not set(plan.split()) & {"content", "body"}
    scans = found._jdf.queryExecution().executedPlan().toString().split("FileScan parquet")[1:]
    assert all("PartitionFilters: [" in x and "PartitionFilters: []" not in x for x in scans if "_part" in x.split("Batched")[0])
    assert uids(commits.find_keys(spark, path, keys, except_batch="b0")) == ["m5999"]
    # keys the ledger lacks hardly ever pass the bitmaps
    absent = spark.range(2000).select(F.concat(F.lit("z"), "id").alias("uid"))
    assert uids(commits.find_keys(spark, path, absent)) == []
    assert len(asked[-2]) == 60 and len(asked[-1]) < 10
    assert uids(commits.find_keys(spark, path, keys.limit(0))) == []
    stores.upsert(spark.createDataFrame([("m17",)], "uid string"), path, "b0")     # b0 replaced
    assert uids(commits.find_keys(spark, path, keys)) == ["m17", "m5999"]
    assert stores.read_ledger(spark, path).count() == 4001
    assert commits.find_keys(spark, str(tmp_path / "none"), keys) is None


def test_one_result_of_a_merged_store(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    monkeypatch.setattr(commits, "PART_ROWS", 100)
    for n in range(3):
        stores.write_results(spark.range(1000).select(F.col("id").cast("string").alias("uid"), F.lit(f"v{n}").alias("value")), path)
    assert commits.compact(spark, path, everything=True)
    one = stores.read_result(spark, path, "77")
    assert [tuple(r) for r in one.select("uid", "value", "filename").collect()] == [("77", "v2", "77.json")]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(uid,77)" in plan and "_part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len({f.split("_part=")[1].split("/")[0] for f in stores.read_results(spark, path).inputFiles()}) == 10


def test_point_lookup_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "store")
    stores.write_results(spark.createDataFrame([("1", "a"), ("2", "b")], "uid string, value string"), path)
    one = stores.read_result(spark, path, "2")
    assert [r.value for r in one.collect()] == ["b"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(uid,2)" in plan


def test_files_one_per_row(spark, tmp_path):
    df = spark.createDataFrame([("1.json", '{"a": "é"}'), ("2.json", "x"), ("3.txt", "y"),
                                ("a b%20+é.json", "z"), ("0.json", "")],
                               "name string, text string")
    path = str(tmp_path / "files")
    stores.write_files(df, path)
    stores.write_files(df, path)
    assert sorted(os.listdir(path)) == ["0.json", "1.json", "2.json", "3.txt", "a b%20+é.json"]
    got = {r.filename: r.value for r in stores.read_result_files(spark, path).collect()}
    assert got == {"1.json": '{"a": "é"}', "2.json": "x", "a b%20+é.json": "z", "0.json": ""}


def test_parsing_holds_a_few_messages_at_a_time():
    """A batch of 10000 pages leaves the parser piece by piece, not as a second copy."""
    import pyarrow as pa

    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

        mapInPandas = mapInArrow

    run = eml.parse_messages(Frame()).run
    mail = b"From: a@b.c\nSubject: s\n\n" + b"x" * 100
    batch = pa.RecordBatch.from_pydict({"uid": [str(i) for i in range(1000)], "content": [mail] * 999 + [None]})
    pieces = list(run(iter([batch])))
    assert max(p.num_rows for p in pieces) <= 32 and sum(p.num_rows for p in pieces) == 1000
    rows = [r for p in pieces for r in p.to_pylist()]
    assert rows[998]["sender"] == "a@b.c" and rows[998]["size_bytes"] == len(mail) and rows[999]["raw"] == ""
