import datetime as dt

import pytest

from wardlight import schemas
from wardlight.operators import clean, features, splits
from wardlight.sources import readers, sinks

EMAIL = "id string, date string, user string, pc string, `to` string, cc string, bcc string, `from` string, " \
        "size string, attachments string, content string"


def email(**kw):
    row = {"id": "1", "date": "1/2/2010 6:59:59", "user": " abc1 ", "pc": "pc-1", "to": "a@x; ;B@x", "cc": None,
           "bcc": "z@x", "from": " ME@X ", "size": "10", "attachments": "", "content": " Hello \n World "}
    row.update(kw)
    return tuple(row[c] for c in ("id", "date", "user", "pc", "to", "cc", "bcc", "from", "size", "attachments", "content"))


def test_email_row(make):
    r = clean.clean_email(make([email()], EMAIL)).first()
    assert (r.user, r.pc, r.sender, r.to, r.cc, r.bcc) == ("ABC1", "PC-1", "me@x", "a@x; ;b@x", "", "z@x")
    assert (r.to_recipient_count, r.cc_recipient_count, r.bcc_recipient_count, r.total_recipient_count) == (2, 0, 1, 3)
    assert (r.has_cc, r.has_bcc, r.has_attachment, r.is_after_hours) == (0, 1, 0, 1)
    assert (r.content, r.content_length_chars, r.content_length_words) == ("hello world", 11, 2)
    assert (r.email_day, r.email_hour, r.email_month, r.email_weekday) == (dt.date(2010, 1, 2), 6, 1, 5)


def test_email_filters_and_duplicates(make):
    rows = [email(), email(date="1/1/2010 9:00:00"), email(id="2", date="bad"), email(id="3", size="n/a"),
            email(id="4", attachments=None), email(id="5", to=None), email(id="6", cc="q@x;r@x", attachments="a;b")]
    got = {r.id: r for r in clean.clean_email(make(rows, EMAIL)).collect()}
    assert sorted(got) == ["1", "6"]
    assert got["1"].date == dt.datetime(2010, 1, 1, 9)  # the earliest copy
    assert got["6"].attachments == 2 and got["6"].cc_recipient_count == 2
    counted = clean.clean_email(make([email(attachments="0"), email(id="2", attachments="3")], EMAIL), attachments="count")
    assert {r.id: r.has_attachment for r in counted.collect()} == {"1": 0, "2": 1}
    paths = clean.clean_email(make([email(attachments="0")], EMAIL)).first()
    assert paths.attachments == 1  # one item in a path list


def test_activity_logs(make):
    rows = [("1", "1/1/2010 8:00:00", "u", "p", " Logon"), ("1", "1/1/2010 8:00:00", "u", "p", " Logon"),
            ("2", "1/1/2010 21:00:00", "u", None, "Logoff"), ("3", "1/1/2010 21:00:00", "u", "p", "logon")]
    got = {r.id: r for r in clean.clean_logon(make(rows, "ID string, ` Date` string, user string, pc string, activity string")).collect()}
    assert {k: (r.is_logon, r.is_after_hours) for k, r in got.items()} == {"1": (1, 0), "3": (0, 1)}
    device = clean.clean_device(make(rows[:1], "id string, date string, user string, pc string, activity string")).first()
    assert device.is_connect == 0 and device.file_tree == ""


def test_file_variants(make):
    r = clean.clean_file(make([("1", "1/1/2010 8:00:00", "u", "p", " a.ZIP ")],
                              "id string, date string, user string, pc string, path string")).first()
    assert (r.filename, r.activity, r.is_write, r.to_removable_media, r.from_removable_media, r.content) == (
        "a.ZIP", "File Write", 1, 1, 0, "")
    r = clean.clean_file(make([("1", "1/1/2010 8:00:00", "u", "p", "f", "File Open", "false", "1", " Ab  C ")],
                              ", ".join(f"{c} string" for c in schemas.FILE))).first()
    assert (r.is_write, r.to_removable_media, r.from_removable_media, r.content) == (0, 0, 1, "Ab C")


def test_dimensions(make):
    rows = [(" A  B ", " u1", "1", "2", "3", "4", "5"), ("x", "U1", "9", "2", "3", "4", "5"), ("y", "u2", "z", "1", "1", "1", "1")]
    got = clean.clean_psychometric(make(rows, ", ".join(f"{c} string" for c in schemas.PSYCHOMETRIC))).collect()
    assert [r.user_id for r in got] == ["U1"] and got[0].employee_name in ("A B", "x")
    got = clean.clean_decoy(make([(" f ", "p"), ("f", "P "), (None, "p")], "decoy_filename string, pc string")).collect()
    assert got == [("f", "P")]


def test_csv_tolerance(spark, tmp_path):
    path = tmp_path / "email.csv"
    path.write_text(' ID ,Date,Note\n1,d,"a, ""b""\nsecond line"\n2,d\n3,d,x,extra\n4,d,y\n')
    kept = readers.read_csv(spark, str(path), tolerant=True, multiline=True)
    assert kept.columns == ["id", "date", "note"]
    assert sorted((r.id, r.note) for r in kept.collect()) == [("1", 'a, "b"\nsecond line'), ("2", None), ("4", "y")]
    assert kept.count() == 3


def test_optional_and_required_inputs(spark, tmp_path):
    absent = readers.read_optional_csv(spark, str(tmp_path / "none.csv"), schemas.LOGON)
    assert absent.columns == list(schemas.LOGON) and absent.count() == 0
    with pytest.raises(FileNotFoundError, match="email"):
        readers.require_inputs(spark, {"email": str(tmp_path / "none.csv")})
    with pytest.raises(ValueError, match="missing"):
        readers.require_columns(absent, ["id", "nope"])


def test_weights_table(spark):
    from wardlight import fixed
    six = [(s, 1.0, 0.6) for s in fixed.SIGNALS[:-1]]
    got = {r.signal: (r.weight, r.threshold) for r in readers.load_weights(
        spark.createDataFrame(six, "signal string, weight double, threshold double")).collect()}
    assert sum(w for w, _ in got.values()) == pytest.approx(1)
    assert got["content_sensitivity"] == (pytest.approx(0.1 / 5.5), 0.5)
    assert got["lstm_p95"] == (pytest.approx(0.9 / 5.5), 0.6)
    seven = six + [("content_sensitivity", 2.0, 0.4)]
    got = {r.signal: r.weight for r in readers.load_weights(
        spark.createDataFrame(seven, "signal string, weight double, threshold double")).collect()}
    assert got["content_sensitivity"] == pytest.approx(0.25)
    got = {r.signal: r.weight for r in readers.load_weights(
        spark.createDataFrame(six[:3], "signal string, weight double, threshold double")).collect()}
    assert got == pytest.approx(fixed.WEIGHTS)


def test_user_day_features_union_equals_joins(spark, make):
    mails = clean.clean_email(make([
        email(), email(id="2", date="1/2/2010 9:00:00", size="30", pc="pc-2", attachments="f"),
        email(id="3", date="1/3/2010 9:00:00", bcc=None, content="one two three")], EMAIL))
    activity = "id string, date string, user string, pc string, activity string"
    logon = clean.clean_logon(make([("1", "1/2/2010 22:00:00", "abc1", "p1", "Logon"), ("2", "1/2/2010 9:00:00", "abc1", "p2", "Logoff"),
                                    ("3", "1/9/2010 9:00:00", "abc1", "p2", "Logon")], activity))
    device = clean.clean_device(make([("1", "1/3/2010 22:00:00", "abc1", "p1", "Connect")], activity))
    got = {str(r.email_day): r for r in features.behavior_user_day(mails, logon, device).collect()}
    assert sorted(got) == ["2010-01-02", "2010-01-03"]  # days without email have no row
    r = got["2010-01-02"]
    assert (r.email_count, r.unique_pcs, r.total_size, r.avg_size, r.max_recipients) == (2, 2, 40.0, 20.0, 3)
    assert (r.attachment_email_ratio, r.after_hours_ratio, r.bcc_ratio) == (0.5, 0.5, 1.0)
    assert (r.logon_count, r.logoff_count, r.after_hours_logons, r.unique_logon_pcs) == (1, 1, 1, 2)
    assert (r.file_total, r.usb_connect_count, got["2010-01-03"].usb_connect_count) == (0, 0, 1)
    joined = features.join_user_days(features.email_user_day(mails), features.logon_user_day(logon),
                                     features.device_user_day(device))
    same = features.behavior_user_day(mails, logon, device).select(joined.columns)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, same.collect()))


@pytest.mark.parametrize("n,train,val", [(1, 0, 0), (2, 1, 0), (3, 2, 0), (10, 7, 1), (90, 62, 14)])
def test_split_sizes(make, n, train, val):
    df = make([("u", dt.date(2010, 1, 1) + dt.timedelta(days=i)) for i in range(n)], "user string, email_day date")
    rows = sorted(splits.split_by_user(df).collect(), key=lambda r: r.email_day)
    assert [r.dataset_split for r in rows] == ["train"] * train + ["val"] * val + ["test"] * (n - train - val)


def test_date_split(make):
    days = [dt.date(2010, 1, 1 + i) for i in range(10)]
    df = make([(d,) for d in days] * 2, "day date")
    cut = splits.date_cutoffs(df, "day")
    assert cut.first() == (days[7], days[8])
    got = {r.day: r.dataset_split for r in splits.split_by_date(df, cut, "day").collect()}
    assert [got[d] for d in days] == ["train"] * 7 + ["val"] + ["test"] * 2


def test_sinks(spark, tmp_path, make):
    df = make([("a", dt.date(2010, 1, 1)), ("b", dt.date(2010, 1, 2))], "user string, day date")
    sinks.write_by_day(df, str(tmp_path / "t"))
    assert sorted(spark.read.parquet(str(tmp_path / "t")).collect()) == sorted(df.collect())
    sinks.write_report({"s": df.agg({"user": "count"})}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().section == "s"
    got = {r.metric: r.value for r in sinks.table_counters("x", df, "user", "day").collect()}
    assert got == {"rows": "2", "users": "2", "first": "2010-01-01", "last": "2010-01-02"}
