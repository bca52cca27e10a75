"""Uploaded tables, raw extracts, registry archives and saved pages."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from bidloom.functions import fixed_values as V
from bidloom.functions import scalars as S
from bidloom.operators import batch as B
from bidloom.operators import marts
from bidloom.sources import archives, workbooks
from bidloom.sources import extracts as X

CSV = """procedure_id;procedure_name;product_name;okpd2_code;start_price;customer_inn;platform;is_smp
1;Поставка бумаги;Бумага А4;17.12.14.129;45 000,50;7802141070;ЭМ;нет
1;Поставка бумаги;Бумага А3;17.12.x;1;;;да
;;;;;;;
2;;Охрана;80.10;1.200.000,5;780214107;аис гз;да
3;;;;5;;;
"""


@pytest.mark.parametrize("data", [CSV.encode("utf-8-sig"), CSV.encode("cp1251"), CSV.replace(",", ".").replace(";", ",").encode(), ('"' + CSV.split("\n", 1)[0] + '"\n' + CSV.split("\n", 1)[1]).encode()])
def test_procurements_of_any_format(spark, data):
    table, unknown = B.recognised(X.read_upload(spark, data))
    procs, problems = B.procurements(B.merged([table]))
    got = procs.orderBy("query_id").collect()
    assert unknown == [] and [(r.procedure_id, r.text, r["items"], r.okpd_codes, r.price, r.customer_inn, r.platform, r.is_smp) for r in got] == [
        ("1", "Поставка бумаги", ["Бумага А4", "Бумага А3"], ["17.12.14.129", ""], 45000.5, "7802141070", "ЭМ", False),
        ("2", "", ["Охрана"], ["80.10"], 1200000.5, "0780214107", "АИС ГЗ", True),
    ]
    assert sorted((r.procedure_id, r.problem[:14]) for r in problems.collect()) == [("1", "некорректные к"), ("3", "пустая закупка")]


def workbook(rows, strings=(), styles="", sheet="worksheets/s7.xml"):
    """The bytes of a workbook: its first sheet's rows as XML, shared strings as XML."""
    out, ns = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="B" sheetId="2" r:id="r2"/><sheet name="A" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="{sheet}"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>wrong</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s7.xml", f"<worksheet {ns}><sheetData>{''.join(rows)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si>{x}</si>' for x in strings)}</sst>")
        z.writestr("xl/styles.xml", f"<styleSheet {ns}>{styles}</styleSheet>")
    return out.getvalue()


def test_a_workbook_gives_the_procurements_of_its_text(spark):
    table = [line.split(";") for line in CSV.strip().split("\n")]
    strings = sorted({x for line in table for x in line if x})
    name = lambda r, c: f"{chr(65 + c)}{r + 1}"
    rows = [f'<row r="{r + 1}">' + "".join(f'<c r="{name(r, c)}" t="s"><v>{strings.index(x)}</v></c>' for c, x in enumerate(line) if x) + "</row>" for r, line in enumerate(table)]
    book = B.recognised(X.read_upload(spark, workbook(rows, [f"<t>{x}</t>" for x in strings])))
    text = B.recognised(X.read_upload(spark, CSV.encode()))
    both = [[sorted(map(str, df.collect())) for df in B.procurements(B.merged([t]))] for t, _ in (book, text)]
    assert both[0] == both[1] and book[1] == text[1] and both[0][0]


def test_cells_of_workbooks(spark, tmp_path):
    styles = '<numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/><numFmt numFmtId="165" formatCode="#,##0.00 &quot;days&quot;[Red]"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="14"/></cellXfs>'
    rows = [
        '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c t="s"><v>0</v></c></row><row r="3"/>',
        '<row r="4"><c r="A4"><v>1</v></c><c r="B4" s="1"><v>45322</v></c><c r="C4" s="2"><v>12.50</v></c></row><row><c r="B5"><v>1E3</v></c><c t="b"><v>1</v></c></row>',
        '<row r="9"><c r="C9" t="e"><v>#N/A</v></c><c r="B9" t="inlineStr"><is><r><t>x</t></r><r><t xml:space="preserve"> y</t></r><rPh><t>no</t></rPh></is></c></row><row r="10"><c r="C10" s="3" t="str"><v>f</v></c></row>',
    ]
    data = workbook(rows, ["<t> head </t>", "<r><t>ot</t></r><r><t>her</t></r><rPh><t>no</t></rPh>"], styles, "/xl/worksheets/s7.xml")
    got = [tuple(r) for r in X.read_upload(spark, data).orderBy("row").collect()]
    assert got == [(2, "2024-01-31 00:00:00", "12.5"), (3, "1000", "True"), (4, "x y", ""), (5, "", "f")]
    (tmp_path / "a b").mkdir()
    for k in "12":
        (tmp_path / "a b" / f"{k}.xlsx").write_bytes(data)
    (tmp_path / "a b" / "empty.xlsx").write_bytes(workbook([]))
    found = workbooks.lines(workbooks.read_workbooks(spark, str(tmp_path / "a b"))).collect()
    assert sorted((r.file[-6:], r.row, len(r.fields)) for r in found) == [(f"{k}.xlsx", row, n) for k in "12" for row, n in ((4, 2), (5, 2), (9, 1), (10, 1))]


def test_members_of_archives_are_tasks(spark, tmp_path):
    place = tmp_path / "of a %20 day"
    place.mkdir()
    many = "<r>" + "".join(f"<d n='{k}'><d2>é &amp; {k}</d2></d> tail" for k in range(1203)) + "</r>"
    for k, packing in enumerate((zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED)):
        with zipfile.ZipFile(place / f"{k}.zip", "w", packing) as z:
            z.writestr("sub/a.XML", many)
            z.writestr("b.xml", "<r><d n='one'/><x/></r>")
            z.writestr("none.xml", "<r/>")
            z.writestr("c.txt", "<d/>")
            z.writestr("empty.xml", "")
    listed = archives.members(spark, str(place))
    assert listed.count() == 6
    got = archives.records(spark, str(place), "d")
    assert got.rdd.getNumPartitions() == 6
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 2 * 1204 and len({(r.path, r.member) for r in rows}) == len({r.task for r in rows}) == 4
    assert sorted({r.record for r in rows if "b.xml" == r.member}) == ['<d n="one" />'] and '<d n="7"><d2>é &amp; 7</d2></d>' in {r.record for r in rows}
    assert archives.records(spark, str(place), "nothing").count() == 0
    data = (place / "0.zip").read_bytes()
    (at, packed) = listed.filter("member = 'sub/a.XML' AND path LIKE '%0.zip'").select("at", "packed").first()
    assert b"".join(archives.unpacked(io.BytesIO(data), at, packed, 8)).decode() == many
    with pytest.raises(ValueError, match="ends before"):
        list(archives.unpacked(io.BytesIO(data), at, packed - 9, 8))
    with pytest.raises(ValueError, match="method 14"):
        list(archives.unpacked(io.BytesIO(data), at, packed, 14))


def test_files_are_joined_by_lot(spark):
    heads = "lot_id;наименование закупки;Инн заказчика;чужая\n7;Уборка;780214107099;x\n8;Ремонт;12;x\n"
    rows = "lot_id;наименование;окпд2\n7;Мытьё окон;81.2\n9;Стул;31.01\n"
    tables = [B.recognised(X.read_upload(spark, t.encode())) for t in (heads, rows)]
    assert [u for _, u in tables] == [["чужая"], []]
    procs, problems = B.procurements(B.merged([t for t, _ in tables]), most=2)
    assert {(r.procedure_id, r.text, tuple(r["items"])) for r in procs.collect()} == {("7", "Уборка", ("Мытьё окон",)), ("9", "", ("Стул",))}
    assert any("обработаны первые 2" in r.problem for r in problems.collect())


def test_extracts_are_projected(spark, tmp_path):
    f = tmp_path / "lots.csv"
    f.write_text('lot_id;procedure_id;publish_date;start_price;subject;procedure_name;is_eshop_or_aisgz;is_smp;customer_inn;customer_kpp;reqnum\n1;5;2024-02-03;12.5;" ";"a ""b""; c";ЭМ;true;1;2; \n2;6;2024-02-04;x;s;p;?;false;1;2;r\n')
    columns = ["lot_id", "procedure_id", "publish_date", "start_price", "subject", "procedure_name", "is_eshop_or_aisgz", "is_smp", "customer_inn", "customer_kpp", "reqnum"]
    got = X.lots(X.read_extract(spark, str(f), columns)).orderBy("lot_id").collect()
    assert [(r.subject, r.platform, r.is_smp, r.start_price, r.reqnum) for r in got] == [('a "b"; c', "ЭМ", True, 12.5, None), ("s", "АИС ГЗ", False, None, "r")]
    assert X.save(X.lots(X.read_extract(spark, str(f), columns)), str(tmp_path / "out"), ["lot_id"]) == 2
    assert {r.text for r in X.distinct_texts(spark, str(f), ["subject", "customer_kpp"]).collect()} >= {"s", "2"}


def test_registry_archive(spark, tmp_path):
    doc = """<Файл><Документ КатСубМСП="2" ССЧР="12" ДатаВклМСП="10.08.2017" СведСоцПред="1"><ОргВклМСП ИННЮЛ="1234567890" НаимОрг="ОБЩЕСТВО" НаимОргСокр="ООО А" ОГРН="1"/><СведМН КодРегион="50"><Регион Тип="область" Наим="Московская"/><Город Тип="г" Наим="Клин"/></СведМН>
    <СвОКВЭД><СвОКВЭДОсн КодОКВЭД="10.11" НаимОКВЭД="мясо"/><СвОКВЭДДоп КодОКВЭД="46.3"/><СвОКВЭДДоп КодОКВЭД="47.1"/></СвОКВЭД><СвПрод КодПрод="1.1" НаимПрод="колбаса"/></Документ>
    <Документ КатСубМСП="1"><ИПВклМСП ИННФЛ="123456789012"><ФИОИП Фамилия="Ф" Имя="И"/></ИПВклМСП><СведМН КодРегион="50"/></Документ><Документ КатСубМСП="1"><ОргВклМСП ИННЮЛ="7"/><СведМН КодРегион="78"/></Документ><Документ/></Файл>"""
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("a.xml", doc)
        z.writestr("b.xml", doc)
        z.writestr("c.txt", "x")
    known = spark.createDataFrame([("123456789012",)], "inn string")
    got = {r.inn: r for r in X.build_registry(X.read_registry(spark, str(tmp_path)), known).collect()}
    assert set(got) == {"1234567890", "123456789012", "7"}
    a = got["1234567890"]
    assert (a.name, a.city, a.region_name, a.okved_main, a.okved_extra, a.products, a.msp_category, a.employees, a.is_social, a.in_dataset) == ("ООО А", "г Клин", "Московская область", "10.11", "46.3;47.1", "1.1|колбаса", "малое", 12, True, False)
    assert got["123456789012"].name == "ИП Ф И" and got["123456789012"].in_dataset


def test_unfair_suppliers_are_read_off_pages(spark):
    block = '<div class="search-registry-entry-block"><p>44-ФЗ</p><b>№ 1</b><i>{}</i><p>{}</p><span>Включено</span><em>01.02.2020</em>{}</div>'
    pages = [("1", "<script>x</script>" + block.format("Размещено", "1", "")), ("2", block.format("Размещено", "2", "<p>Исключено</p><p>03.04.2022</p>")), ("3", block.format("Размещено", "9", "")), ("4", None)]
    got = {r.inn: (r.in_rnp, r.was_in_rnp, r.since) for r in X.unfair_records(spark.createDataFrame(pages, "inn string, html string")).collect()}
    assert got["1"] == (True, True, "01.02.2020") and got["2"] == (False, True, None) and got["3"] == (False, False, None)


def test_cached_misses_are_known(spark):
    keys, cache = spark.createDataFrame([("1",), ("2",), ("3",)], "inn string"), spark.createDataFrame([("1", '{"phone": "5"}'), ("2", None)], "inn string, data string")
    assert {r.inn: (r.known, r.data and r.data.phone) for r in X.cached(keys, cache, "phone string").collect()} == {"1": (True, "5"), "2": (True, None), "3": (False, None)}


def test_scalars(spark):
    def one(expression, **values):
        from pyspark.sql import functions as F

        return spark.range(1).select(expression(*[F.lit(v).cast("string") for v in values.values()]).alias("x")).first().x

    assert one(S.tokenize, a="Бумага А4, «Ёлка» 1.5-2 №7") == ["бумага", "а4", "елка", "1.5-2", "7"]
    assert one(lambda t: S.terms(t), a="Поставка бумаги № 12/3 по 44-ФЗ в 2024 г. для школа") == ["бумаги"]
    assert one(S.intent, a="Поставка и монтаж") == "goods" and one(S.intent, a="Ремонт и закупка") == "services" and one(S.intent, a="Бумага") is None
    assert one(S.short_name, a='ОБЩЕСТВО С ОГРАНИЧЕННОЙ ОТВЕТСТВЕННОСТЬЮ "СКАЙ"', b="1234567890") == 'ООО "СКАЙ"'
    assert one(S.short_name, a="ИВАНОВ ИВАН", b="123456789012") == "ИП Иванов Иван"
    assert [one(lambda c: S.plural(c, "тур", "тура", "туров"), a=n) for n in (1, 3, 11, 25)] == ["1 тур", "3 тура", "11 туров", "25 туров"]


def test_pasted_lists_of_any_shape(spark):
    rows = [(0, None), (1, ""), (2, " \n\r\n"), (3, "доска; сосна\t16.10\n бумага ;x\n17.12.1\nклей;20.52;")]
    got = {r["id"]: [tuple(x) for x in r["items"]] for r in spark.createDataFrame(rows, "id int, text string").select("id", B.listed_items(F.col("text")).alias("items")).collect()}
    assert got == {0: [], 1: [], 2: [], 3: [("доска; сосна", "16.10"), ("бумага; x", ""), ("17.12.1", ""), ("клей; 20.52; ", "")]}


def test_exports_of_a_batch_without_results(spark):
    procs = spark.createDataFrame([(1, "P1", None, "", ["a", "b"])], "query_id int, procedure_id string, lot_id string, text string, items array<string>")
    ranked = spark.createDataFrame([], "query_id int, place int, inn string, score double, company_name string")
    external = spark.createDataFrame([(1, 1, "77", 5.0)], "query_id int, place int, inn string, score double")
    shares, kinds = spark.createDataFrame([], "query_id int, code8 string, place int"), spark.createDataFrame([(1, None)], "query_id int, intent string")
    told = spark.createDataFrame([(1, "low", "m")], "query_id int, level string, message string")
    assert [tuple(r) for r in B.headed(B.summary(procs, ranked, external, told, shares, kinds), V.SUMMARY_HEADINGS).collect()] == [("P1", "", "a; b", 2, "", "", "низкая", "m", 0, 1, "", "", "")]
    table = B.headed(B.recommendations(procs, ranked, external), V.RECOMMENDATION_HEADINGS)
    assert [tuple(r) for r in table.collect()] == [("P1", "", 1, "77", None, V.FROM_REGISTRY, None, None, 5.0, "", "", "", "")]


def test_sample_is_the_same_however_rows_are_dealt(spark):
    rows = spark.range(1000).withColumnRenamed("id", "lot_id")
    take = lambda df, seed=0: [r[0] for r in marts.hash_sample(df, "lot_id", 20, seed).collect()]
    assert take(rows) == take(rows.repartition(7)) != take(rows, 1)
