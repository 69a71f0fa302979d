import json

from pyspark.sql import functions as F

from mailspark.operators import groups as G, views as V
from mailspark.sources.stores import write_export

FILES = {
    "object.json": '{"full_name": "A", "company": "C", "position": "P", "emails": ["e"], '
                   '"phones": ["p"], "product": "X"}',
    "encoded.json": json.dumps('{"full_name": "B", "company": "D"}'),
    "alias.json": '{"Company": "X", "fullName": "F", "Position": "Q", "Product": "Z"}',
    "anyname.json": '{"id": 1, "Contact_NAME": "Y", "username": "no"}',
    "namelist.json": '{"names": ["a", "b"]}',
    "scalars.json": '{"emails": "a@x.com, b@x.com", "phones": 123, "company": 5}',
    "falsy.json": '{"emails": "", "phones": 0, "company": false, "full_name": ""}',
    "array.json": "[1]",
    "text.json": '"plain text"',
    "number.json": "3.5",
    "null.json": "null",
    "deep.json": json.dumps(json.dumps("x")),
    "bad.json": '{"a": ',
    "empty.json": "",
}
WANT = {   # full_name, company, position, emails, phones, product, status
    "object.json": ("A", "C", "P", ["e"], ["p"], "X", "ok"),
    "encoded.json": ("B", "D", "Не указано", [], [], "Не найдено", "ok"),
    "alias.json": ("F", "X", "Q", [], [], "Z", "ok"),
    "anyname.json": ("Y", "Не указано", "Не указано", [], [], "Не найдено", "ok"),
    "namelist.json": ('["a","b"]', "Не указано", "Не указано", [], [], "Не найдено", "ok"),
    "scalars.json": ("Не указано", "5", "Не указано", ["a@x.com, b@x.com"], ["123"], "Не найдено", "ok"),
    "falsy.json": ("", "Не указано", "Не указано", [], [], "Не найдено", "ok"),
    "array.json": ("Ошибка: array.json", "Не удалось прочитать", "Проверьте формат файла", [], [],
                   "Не найдено", "not_object"),
    "text.json": ("Не указано", "Не указано", "Не указано", [], [], "Не найдено", "ok"),
    "number.json": ("Ошибка: number.json", "Не удалось прочитать", "Проверьте формат файла", [], [],
                    "Не найдено", "not_object"),
    "null.json": ("Ошибка: null.json", "Не удалось прочитать", "Проверьте формат файла", [], [],
                  "Не найдено", "not_object"),
    "deep.json": ("Ошибка: deep.json", "Не удалось прочитать", "Проверьте формат файла", [], [],
                  "Не найдено", "not_object"),
    "bad.json": ("Не JSON: bad.json", "Не удалось распарсить", "Проверьте формат файла", [], [],
                 "", "not_json"),
    "empty.json": ("Не JSON: empty.json", "Не удалось распарсить", "Проверьте формат файла", [], [],
                   "", "not_json"),
}


def test_view_of_every_shape(spark):
    df = spark.createDataFrame(list(FILES.items()), "filename string, value string")
    got = {r.filename: r for r in V.normalize_view(df).collect()}
    for name, want in WANT.items():
        r = got[name]
        assert (r.full_name, r.company, r.position, r.emails, r.phones, r.product,
                r.parse_status) == want, name
    assert got["array.json"].raw_content == "'list' object has no attribute 'get'"
    assert got["number.json"].raw_content == "'float' object has no attribute 'get'"
    assert got["null.json"].raw_content == "'NoneType' object has no attribute 'get'"
    assert got["deep.json"].raw_content == "'str' object has no attribute 'get'"
    assert got["bad.json"].raw_content == '{"a":'


def test_placeholder_rows_count_as_sufficient(spark):
    df = spark.createDataFrame(list(FILES.items()), "filename string, value string")
    kept = {r.filename for r in V.scan_contacts(df).collect()}
    assert kept == {"object.json", "encoded.json", "alias.json", "scalars.json", "array.json",
                    "number.json", "null.json", "deep.json", "bad.json", "empty.json"}


ROW = ("filename string, full_name string, company string, position string, emails array<string>, "
       "phones array<string>, product string")


def view(spark):
    return spark.createDataFrame([
        ("1.json", "Иван", "Vega", "CEO", ["A@x.com"], [], ""),
        ("2.json", "", " VEGA ", "", [], ["+7 999"], "CRM"),
        ("3.json", "Петр", "не указано", "", ["b@y.com"], [], "CRM"),
        ("4.json", "Петр", "", "", [], [], "Не найдено"),
        ("5.json", "", "", "", [], [], ""),
        ("6.json", "Ann", "Acme", "", [" "], None, "crm"),
        ("7.json", "", "Lone", "", [], [], "x"),
    ], ROW)


def files(df):
    return sorted(r.filename for r in df.collect())


def test_sufficient_and_search(spark):
    v = view(spark)
    assert files(V.is_sufficient(v)) == ["1.json", "2.json", "6.json"]
    assert files(V.search(v, "  a@X ")) == ["1.json"]
    assert files(V.search(v, "пЕтр")) == ["3.json", "4.json"]
    assert files(V.search(v, " ")) == [] and files(V.search(v, None)) == []
    assert files(V.search_company(v, "vega")) == ["1.json", "2.json"]
    assert files(V.get_contact(v, "6.json")) == ["6.json"]


def test_groups(spark):
    v = view(spark)
    got = [(r.group_type, r.group_key, r.group_name, r.n, r.first_file)
           for r in G.order_groups(G.group_contacts(v)).collect()]
    assert got == [
        ("company", "vega", "🏢 Vega", 2, "1.json"), ("company", "acme", "🏢 Acme", 1, "6.json"),
        ("company", "lone", "🏢 Lone", 1, "7.json"), ("product", "crm", "📦 CRM", 1, "3.json"),
        ("name", "петр", "👤 Петр", 1, "4.json")]
    totals = G.group_totals(G.group_contacts(v)).first()
    assert (totals.n_groups, totals.n_files) == (5, 6)
    assert [r.group_key for r in G.list_groups(v).collect()] == ["vega", "acme"]
    assert [r.n for r in G.search_groups(v, "+7").collect()] == [1]
    assert G.search_groups(v, "").count() == 0


def test_hot_group_is_paged_and_complete(spark):
    df = spark.range(5000).select(
        F.concat(F.col("id").cast("string"), F.lit(".json")).alias("filename"),
        F.lit("n").alias("full_name"),
        F.when(F.col("id") % 3 > 0, F.lit("Hot")).otherwise(F.concat(F.lit("c"), F.col("id"))).alias("company"),
        F.lit("").alias("position"), F.array(F.lit("e")).alias("emails"),
        F.array().cast("array<string>").alias("phones"), F.lit("").alias("product"))
    pages = G.group_pages(df, page_size=100)
    hot = pages.filter("group_key = 'hot'").collect()
    assert len(hot) == 34 and max(len(r.files) for r in hot) < 200
    members = [f.filename for r in pages.collect() for f in r.files]
    assert len(members) == len(set(members)) == 5000
    assert all(r.n == 3333 for r in hot)
    for hot_rows in (10, 3333, G.HOT_ROWS):      # salted, not salted
        members = G.group_members(df, hot_rows)
        assert members.count() == 5000 and members.filter("group_key = 'hot' AND n = 3333").count() == 3333
    salted = F.countDistinct("group_type", "group_key")
    assert G.group_contacts(df).agg(salted).first()[0] == 1668


def test_export(spark, tmp_path):
    v = view(spark).withColumn("raw_content", F.lit('line "one"\nline two'))
    out = V.export_contacts(v, "vega")
    assert out.columns == ["Файл", "Полное имя", "Компания", "Должность", "Emails", "Телефоны",
                           "Интересуемый продукт", "Содержимое"]
    write_export(out, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(
        str(tmp_path / "csv"))
    got = {r["Файл"]: r for r in back.collect()}
    assert set(got) == {"1.json", "2.json"}
    assert got["1.json"]["Содержимое"] == 'line "one"\nline two' and got["1.json"]["Emails"] == "A@x.com"
    assert V.export_contacts(v).count() == 7 and V.export_contacts(v, " ").count() == 7


def test_flat_rows(spark):
    v = view(spark)
    assert V.crm_rows(v).columns == ["name", "company", "emails", "phones", "position"]
    row = V.sheet_rows(v.filter("filename = '6.json'")).first()
    assert tuple(row) == ("Ann", " ", "", "Acme", "", "crm")
