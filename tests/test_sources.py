"""Readers and writers."""

import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallymast import schema, sources

HEAD = "A PARTY,B PARTY,DATE,TIME,DURATION,CALL TYPE,FIRST CELL ID A,LAST CELL ID A,FIRST CELL ID A ADDRESS,IMEI A,IMSI A,LATITUDE,LONGITUDE"
ROWS = ["9000000001,9000000002,2024-01-02,03:04:05,17,CALL-OUT,C1,C2,Here,350000000000001,404000000000001,17.5,82.5",
        "9000000001,AD-SHOP,2024-01-02,23:00:00,x,SMS-IN,C1,,Here,,,,"]


def test_read_cdr_skips_what_it_cannot_use(spark, tmp_path):
    good = tmp_path / "9000000001_Kim_Q.csv"
    good.write_text("\n".join([HEAD, *ROWS]))
    bad = tmp_path / "other.csv"
    bad.write_text("x,y\n1,2\n")
    df = sources.read_cdr(spark, [str(good), str(bad), str(tmp_path / "missing.csv")])
    assert df.schema.names == schema.CDR.names
    rows = {r["b_party"]: r for r in df.collect()}
    assert set(rows) == {"9000000002", "AD-SHOP"}
    a, b = rows["9000000002"], rows["AD-SHOP"]
    assert a["subject"] == "Kim_Q_9000000001" and a["datetime"] == datetime(2024, 1, 2, 3, 4, 5) and a["duration_seconds"] == 17
    assert a["has_location"] and not b["has_location"] and b["is_provider_message"] and b["duration_seconds"] == 0
    kept_null = sources.read_cdr(spark, str(good), null_duration_as_zero=False)
    assert kept_null.filter("duration_seconds IS NULL").count() == 1
    assert sources.read_cdr(spark, str(bad)).count() == 0


def test_read_ipdr_list_and_parquet(spark, tmp_path):
    text = "SUBSCRIBER_ID,START TIME,END_TIME,DESTINATION_PORT,DATA_VOLUME_UP,DATA_VOLUME_DOWN,PROTOCOL\n"
    (tmp_path / "a.csv").write_text(text + "+919000000001,2024-01-01 00:00:00,2024-01-01 00:01:00,443,10,20,TCP\n")
    (tmp_path / "b.csv").write_text(text + "919000000002,2024-01-01 00:00:00,bad,443.0,x,20,TCP\n")
    df = sources.read_ipdr(spark, f"{tmp_path}/a.csv, {tmp_path}/b.csv")
    rows = {r["subject"]: r for r in df.collect()}
    assert set(rows) == {"9000000001", "9000000002"}
    assert rows["9000000002"]["end_time"] is None and rows["9000000002"]["data_volume_up"] is None and rows["9000000002"]["destination_port"] == 443
    df.write.parquet(str(tmp_path / "p.parquet"))
    again = sources.read_ipdr(spark, str(tmp_path / "p.parquet"))
    assert sorted(r["subject"] for r in again.collect()) == ["9000000001", "9000000002"]


def test_read_tower_dumps(spark, tmp_path):
    (tmp_path / "d1.csv").write_text("MSISDN,TimeStamp,Cell_ID,IMEI,Latitude,Lon,Duration\n9000000001,02-01-2024 03:04:05,T1,350000000000001,17.5,82.5,5\n555,02-01-2024 03:04:05,T1,1,17.5,82.5,5\n")
    (tmp_path / "d2.csv").write_text("a party,DATE,TIME,tower\n919000000001,45293,03:04:05,T1\n9000000002,45293,99,T1\n")
    df = sources.read_tower_dumps(spark, [str(tmp_path / "d1.csv"), str(tmp_path / "d2.csv")])
    rows = df.collect()
    assert [(r["dump_id"], r["mobile_number"], r["timestamp"], r["lat"]) for r in rows] == [("d1", "9000000001", datetime(2024, 1, 2, 3, 4, 5), 17.5)]
    with pytest.raises(ValueError):
        sources.read_tower_dump(spark, str(tmp_path / "d.txt"))


def test_towers_round_trip(spark, tmp_path):
    path = tmp_path / "towers.json"
    path.write_text(json.dumps([{"cell_id": "T1", "latitude": 17.0, "lon": 82.0, "region": "X"}, {"cell_id": "T2", "latitude": 18.0, "lon": 83.0, "radius": 2.5}]))
    t = sources.read_towers(spark, str(path))
    assert {r["tower_id"]: (r["long"], r["coverage_radius"], r["area"]) for r in t.collect()} == {"T1": (82.0, 1.0, "X"), "T2": (83.0, 2.5, None)}
    for fmt in ("json", "csv"):
        sources.write_towers(t, str(tmp_path / f"out.{fmt}"), ids=["T2"], fmt=fmt)
    back = sources.read_towers(spark, str(tmp_path / "out.csv"), fmt="csv")
    assert [r["tower_id"] for r in back.collect()] == ["T2"]


def xlsx(path, rows):
    cells = []
    shared = []
    for n, row in enumerate(rows, 1):
        out = []
        for i, value in enumerate(row):
            ref = f"{chr(65 + i)}{n}"
            if value is None:
                continue
            if isinstance(value, str):
                shared.append(value)
                out.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
            else:
                out.append(f'<c r="{ref}"><v>{value}</v></c>')
        cells.append(f'<row r="{n}">{"".join(out)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>")


def test_read_xlsx(spark, tmp_path):
    names = HEAD.split(",")
    xlsx(tmp_path / "9000000001_Kim.xlsx", [names, [9000000001.0, "9000000002", "2024-01-02", "03:04:05", 17, "CALL-OUT", "C1", None, None, 350000000000001.0, None, 17.5, 82.5]])
    (tmp_path / "broken.xlsx").write_bytes(b"not a zip")
    df = sources.read_cdr(spark, str(tmp_path / "*.xlsx"))
    r = df.collect()
    assert len(r) == 1 and r[0]["subject"] == "Kim_9000000001" and r[0]["a_party"] == "9000000001" and r[0]["imei"] == "350000000000001" and r[0]["last_cell"] is None


def test_write_result_flattens_lists_for_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"])], "k string, v array<string>")
    sources.write_result(df, str(tmp_path / "o"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).first()["v"] == "x|y"
    sources.write_result(df.withColumn("d", F.lit("2024")), str(tmp_path / "p"), partition_by=["d"])
    assert (tmp_path / "p" / "d=2024").is_dir()


CALL = "9000000001,9000000002,2024-01-{:02d},03:04:05,17,CALL-OUT,C1,C2,Here,350000000000001,404000000000001,17.5,82.5"


def test_every_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "1_A.csv").write_text("\n".join([HEAD, CALL.format(1)]))
    turned = lambda line: ",".join(line.split(",")[::-1])
    (tmp_path / "2_B.csv").write_text("\n".join([turned(HEAD), turned(CALL.format(2))]))
    rows = {r["subject"]: r for r in sources.read_cdr(spark, str(tmp_path)).collect()}  # a folder without an extension
    assert set(rows) == {"A_1", "B_2"}
    assert all(r["a_party"] == "9000000001" and r["duration_seconds"] == 17 and r["lat"] == 17.5 for r in rows.values())
    assert [rows[k]["datetime"].day for k in ("A_1", "B_2")] == [1, 2]


def test_records_keep_the_order_of_their_file(spark, tmp_path):
    from tallymast.operators import quality

    head = "MSISDN,TimeStamp,Cell_ID,Duration\n"
    lines = [f"90000000{i % 7:02d},02-01-2024 03:{i // 60:02d}:{i % 60:02d},T{i % 3},{i}\n" for i in range(400)]
    for name, own, want in (("sorted", lines, True), ("turned", lines[::-1], False)):
        (tmp_path / f"{name}.csv").write_text(head + "".join(own))
        df = sources.read_tower_dump(spark, str(tmp_path / f"{name}.csv"))
        assert df.count() == 400 and quality.tower_pattern_quality(df).first()["in_time_order"] is want
    same = [f"900000000{k},02-01-2024 03:04:05,T1,{d}\n" for d in range(9) for k in range(1, 6)]
    for name, own in (("x", same), ("y", same[::-1])):
        (tmp_path / f"{name}.csv").write_text(head + "".join(own))
    both = sources.read_tower_dumps(spark, [str(tmp_path / "x.csv"), str(tmp_path / "none.csv"), str(tmp_path / "y.csv")])
    assert [(r["duration"], r["dump_id"]) for r in both.collect()] == [(0.0, "x")] * 5


def _workbook(path, rows, styles=("yyyy\\-mm\\-dd hh:mm:ss", "dd/mm/yyyy", "hh:mm"), broken=False):
    """Text cells, and (number, style) ones."""
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c s="{v[1]}"><v>{v[0]}</v></c>'
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        formats = "".join(f'<numFmt numFmtId="{164 + i}" formatCode="{c}"/>' for i, c in enumerate(styles))
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts>{formats}</numFmts><cellXfs><xf numFmtId="0"/>{"".join(f"""<xf numFmtId="{164 + i}"/>""" for i in range(len(styles)))}<xf numFmtId="22"/></cellXfs></styleSheet>')
        body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{body}" + ("" if broken else "</sheetData></worksheet>"))


def test_dates_of_workbooks(spark, tmp_path):
    _workbook(tmp_path / "1_A.xlsx", [HEAD.split(","), ["9000000001", "9000000002", (45293, 2), (0.127835648148148, 3), "17", "CALL-OUT", "C1", "C2", "Here", "350000000000001", "404000000000001", "17.5", "82.5"]])
    call = sources.read_cdr(spark, str(tmp_path / "1_A.xlsx")).first()
    assert call["datetime"] == datetime(2024, 1, 2, 3, 4, 5)
    _workbook(tmp_path / "d.xlsx", [["MSISDN", "TimeStamp", "Cell_ID"], ["9000000001", (45293.127835648148, 1), "T1"], ["9000000002", (45293.127835648148, 4), "T1"]])
    dump = sources.read_tower_dump(spark, str(tmp_path / "d.xlsx")).collect()
    assert [r["timestamp"] for r in dump] == [datetime(2024, 1, 2, 3, 4, 5)] * 2
    _workbook(tmp_path / "i.xlsx", [["SUBSCRIBER_ID", "START_TIME", "END_TIME", "DESTINATION_PORT", "DATA_VOLUME_UP", "DATA_VOLUME_DOWN", "PROTOCOL"], ["919000000001", (45293, 1), (45293.5, 1), "443", "1", "2", "TCP"]])
    session = sources.read_ipdr(spark, str(tmp_path / "i.xlsx")).first()
    assert (session["start_time"], session["end_time"]) == (datetime(2024, 1, 2), datetime(2024, 1, 2, 12))


def test_damaged_and_old_workbooks_give_nothing(spark, tmp_path):
    rows = [["MSISDN", "TimeStamp", "Cell_ID"]] + [["9000000001", "02-01-2024 03:04:05", "T1"]] * 12_000
    _workbook(tmp_path / "d.xlsx", rows, broken=True)
    assert sources.read_tower_dump(spark, str(tmp_path / "d.xlsx")).count() == 0
    (tmp_path / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0")
    with pytest.raises(ValueError):
        sources.read_tower_dump(spark, str(tmp_path / "old.xls"))
