import csv
import random

from wardlight.plans import full_run


def write(path, header, rows):
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)
    return str(path)


def test_raw_logs_to_queue(spark, tmp_path):
    rng = random.Random(1)
    users = [f"USR{i:02d}" for i in range(12)]
    mails, logons, devices, files = [], [], [], []
    for u in users:
        for d in range(1, 25):
            for _ in range(rng.randint(1, 3)):
                hour = 23 if u == "USR03" else rng.randint(8, 18)
                mails.append([f"m{len(mails)}", f"01/{d:02d}/2010 {hour:02d}:00:00", u.lower(), "pc1", "a@x;b@x", "",
                              "h@x" if u == "USR03" else "", f"{u}@x", rng.randint(1, 999), "doc.pdf" if d % 2 else "",
                              "the password is" if u == "USR03" else "lunch draft"])
            logons.append([f"l{len(logons)}", f"01/{d:02d}/2010 08:00:00", u, f"pc{rng.randint(1, 3)}", "Logon"])
            devices.append([f"d{len(devices)}", f"01/{d:02d}/2010 09:00:00", u, "pc1", "Connect"])
            if u == "USR03":
                files.append([f"f{len(files)}", f"01/{d:02d}/2010 09:30:00", u, "pc1", "tool.exe", "4D-5A-90"])
    raw = {
        "email": write(tmp_path / "email.csv", ["id", "date", "user", "pc", "to", "cc", "bcc", "from", "size", "attachments", "content"],
                       [r if r[9] else [*r[:9], " ", r[10]] for r in mails]),
        "psychometric": write(tmp_path / "psy.csv", ["employee_name", "user_id", "O", "C", "E", "A", "N"],
                              [[f"Name {u}", u, 1, 2, 3, 4, 5] for u in users[:10]]),
        "logon": write(tmp_path / "logon.csv", ["id", "date", "user", "pc", "activity"], logons),
        "device": write(tmp_path / "device.csv", ["id", "date", "user", "pc", "activity"], devices),
        "file": write(tmp_path / "file.csv", ["id", "date", "user", "pc", "filename", "content"], files),
    }
    key = write(tmp_path / "key.csv", ["dataset", "scenario", "details", "user", "start", "end"],
                [["4.2", 1, "x", "USR03", "01/20/2010 01:00:00", "01/24/2010 01:00:00"],
                 ["5.2", 1, "x", "NOONE", "01/20/2010 01:00:00", "01/24/2010 01:00:00"]])
    out = str(tmp_path / "out")
    full_run.clean_logs(spark, raw, out)
    days = full_run.build_user_days(spark, out)
    assert days.count() == 12 * 24
    assert days.where("user = 'USR11'").first().employee_name == "USR11"
    daily = full_run.score_sensitivity(spark, out)
    assert daily.where("user = 'USR03' AND top_sensitivity_label = 'RESTRICTED'").count() == 24
    full_run.score_models(spark, out)
    table = full_run.rank_users(spark, out)
    top = table.orderBy("risk_score", ascending=False).first()
    assert top.user == "USR03" and "BCC" in top.explanation
    from wardlight.sources import readers
    report = full_run.evaluate(spark, out, readers.read_csv(spark, key))
    assert report["ground_truth"].first().release == "4.2"
    assert report["forest_day_test"].first().n_insiders > 0
    assert report["grid"].count() == 54
    insiders = spark.createDataFrame([("USR03",)], "user string")
    weights = full_run.search_weights(spark, out, insiders, population=6, generations=1)
    tuned = full_run.rank_users(spark, out, insiders, weights)
    assert tuned.count() == 12 and weights.count() == 7
