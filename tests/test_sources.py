import datetime as dt
from base64 import b64encode
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText

import pytest
from pyspark.sql import functions as F

from fraudwatch import schemas
from fraudwatch.session import new_path
from fraudwatch.sources import corpus, mail, store, versions
from tests.conftest import tuples

ROWS = [("你好，世界", "0"), ('引号 " 和\n换行', "0"), ("NA", "1"), ("  留白 ", "1")]


def write(path, rows, encoding="utf-8", header="content,label", bom=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    quote = lambda cell: '"' + cell.replace('"', '""') + '"'
    text = header + "\n" + "".join(",".join(quote(c) for c in row) + "\n" for row in rows)
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.encode(encoding))


def test_corpus_tags_rows_and_skips_missing_files(spark, tmp_path):
    write(tmp_path / "label00.csv", ROWS[:2])
    write(tmp_path / "label03.csv", ROWS[2:])
    paths = {f"{tmp_path}/label0{n}.csv": n for n in range(5)}
    loaded = corpus.load_corpus(spark, paths)
    assert tuples(loaded.select("class_id", "content", "label")) == sorted(
        [(0, ROWS[0][0], "0"), (0, ROWS[1][0], "0"), (3, None, "1"), (3, "  留白 ", "1")], key=repr)
    in_file = loaded.filter("class_id = 0").orderBy("msg_key")
    assert [r["content"] for r in in_file.collect()] == [ROWS[0][0], ROWS[1][0]]
    assert loaded.select("msg_key").distinct().count() == 4


def test_corpus_without_files(spark, tmp_path):
    with pytest.raises(ValueError):
        corpus.load_corpus(spark, {f"{tmp_path}/none.csv": 0})


def test_encodings_give_equal_rows(spark, tmp_path):
    write(tmp_path / "a" / "one.csv", ROWS[:2])
    write(tmp_path / "b" / "one.csv", ROWS[:2], "gb18030")
    write(tmp_path / "b" / "two.csv", ROWS[2:], "gbk")
    write(tmp_path / "b" / "three.csv", [("ascii", "2")])
    kinds = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in corpus.route_encodings(spark, f"{tmp_path}/b").collect()}
    assert kinds == {"one.csv": "GB18030", "two.csv": "GB18030", "three.csv": "UTF-8"}
    assert tuples(corpus.read_any_encoding(spark, f"{tmp_path}/a")) == sorted(ROWS[:2], key=repr)
    assert tuples(corpus.read_any_encoding(spark, f"{tmp_path}/b")) == sorted(ROWS + [("ascii", "2")], key=repr)


@pytest.mark.parametrize("line", [
    b'a,b', b'"a,b', b'"a"",b', b'"a"",""', b'"a""",b', b'a"b,c', b'"a"b",c', b'x,"y', b'x,"y"', b'"",""', b'"', b'""', b'"""', b',,"', b'',
])
@pytest.mark.parametrize("inside", [False, True])
def test_quote_state_of_a_line(line, inside):
    """Against a reader that goes character by character."""
    state = "quoted" if inside else "start"
    for c in line.decode():
        if state == "quoted":
            state = "closing" if c == '"' else "quoted"
        elif state == "closing":
            state = "quoted" if c == '"' else "start" if c == "," else "plain"
        elif c == ",":
            state = "start"
        else:
            state = "quoted" if state == "start" and c == '"' else "plain"
    assert corpus.quotes_after(line, inside) == (state == "quoted")


def test_a_quoted_file_in_many_splits(spark, tmp_path):
    """Records that cross splits, also several, keep their text and order; keys ascend; a file may end inside quotes."""
    import random

    rng = random.Random(4)
    bits = ["\n", "\r\n", '"', ",", "贷款", "x" * 50, "\n\n", "é", " "]
    rows = [("".join(rng.choice(bits) for _ in range(rng.choice([1, 5, 60, 900]))), str(i)) for i in range(300)]
    rows[5] = ("lange\n" * 9000, "5")
    for name, code in (("a", "utf-8"), ("b", "gb18030")):
        write(tmp_path / name / "one.csv", rows, code)
        write(tmp_path / name / "two.csv", rows[:3], code)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        loaded = corpus.load_corpus(spark, {f"{tmp_path}/a": 3, f"{tmp_path}/b": 1})
        got = loaded.orderBy("msg_key").collect()
        assert loaded.rdd.getNumPartitions() > 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = rows + rows[:3]
    assert [(r["content"], r["label"], r["class_id"]) for r in got] == [(*r, 1) for r in want] + [(*r, 3) for r in want]
    assert len({r["msg_key"] for r in got}) == len(got)
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"
    (tmp_path / "c.csv").write_bytes(b'content,label\r\na,"b\r\n\r\n"\r\n\r\nc,d\r\n"open\nend')
    assert [tuple(r) for r in corpus.read_any_encoding(spark, f"{tmp_path}/c.csv").orderBy("content").collect()] == [
        ("a", "b\r\n\r\n"), ("c", "d"), ("open\nend", None)]
    (tmp_path / "d.csv").write_bytes(b"content,label\n")
    assert corpus.read_any_encoding(spark, f"{tmp_path}/d.csv").collect() == []


def test_folder_skips_long_rows_and_keeps_short_ones(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("﻿content,label\n一\n二,b\n三,c,d\n四,\n".encode())
    (tmp_path / "y.txt").write_text("content,label\nno,no\n")
    assert tuples(corpus.load_dir(spark, str(tmp_path))) == sorted([("一", ""), ("二", "b"), ("四", "")], key=repr)


def test_a_character_split_over_two_header_words():
    raw = "贷款诈骗".encode()
    word = lambda b, charset="utf-8": f"=?{charset}?b?{b64encode(b).decode()}?="
    assert mail.unfolded(f"{word(raw[:4])} {word(raw[4:])}") == "贷款诈骗"
    assert mail.unfolded(f"{word(raw[:4])}\r\n {word(raw[4:7], 'UTF8')} {word(raw[7:])} x") == "贷款诈骗 x"
    assert mail.unfolded(f"{word('贷'.encode('gbk'), 'gbk')} {word('款'.encode())} =?none?b?YQ==?=") == "贷款=?none?b?YQ==?="


def parsed(spark, *raws):
    rows = [(str(i), "box@example.com", raw) for i, raw in enumerate(raws)]
    out = mail.parse_mail(spark.createDataFrame(rows, "uid string, mailbox string, raw binary"))
    return [r.asDict() for r in out.orderBy("uid").collect()]


def test_mail_shapes(spark):
    both = MIMEMultipart()
    both.attach(MIMEText("<p>甲</p>", "html", "utf-8"))
    both.attach(MIMEText("乙", "plain", "utf-8"))
    blank = MIMEMultipart()
    blank.attach(MIMEText("<p>前</p>", "html", "utf-8"))
    blank.attach(MIMEText(" \n", "plain", "utf-8"))
    blank.attach(MIMEText("<p>后</p>", "html", "utf-8"))
    attached = MIMEMultipart()
    part = MIMEText("附件", "plain", "utf-8")
    part.add_header("Content-Disposition", "attachment", filename="a.txt")
    attached.attach(part)
    single = MIMEText("<b>单</b>", "html", "gb18030")
    single["Subject"] = "=?gb2312?b?" + b64encode("贷款".encode("gb2312")).decode() + "?= now"
    single["From"] = "a@example.com"
    single["Date"] = "Tue, 30 Jan 2024 08:00:00 +0000"
    unknown = b"Content-Type: text/plain; charset=no-such\r\n\r\nbody"
    broken = b"Content-Type: text/plain; charset=utf-8\r\n\r\nok\xff\xfe!"
    out = parsed(spark, *[m.as_bytes() for m in (both, blank, attached, single)], unknown, broken)
    assert [m["body"] for m in out] == ["乙", "<p>前</p>", "", "<b>单</b>", "", "ok!"]
    assert out[3]["subject"] == "贷款 now" and out[3]["from"] == "a@example.com"
    assert out[3]["date"].startswith("Tue, 30 Jan") and out[0]["subject"] == "" and out[0]["date"] is None
    assert all(m["error"] is None for m in out)


def test_a_mail_that_cannot_be_read_keeps_its_error(spark):
    out = parsed(spark, None, b"Subject: x\r\n\r\nbody")
    assert out[0]["error"] and out[0]["body"] is None
    assert out[1]["error"] is None and out[1]["body"] == "body"


def test_store_round_trip_and_default(spark):
    path = new_path(spark, "stats")
    assert store.read_store(spark, path, schemas.STATS).count() == 0
    day = {"2026-03-24": 4, "2026-03-25": 16}
    spark.createDataFrame([(20, day, {"贷款诈骗": 3})], schemas.STATS).coalesce(1).write.json(path)
    row = store.read_store(spark, path, schemas.STATS).first()
    assert row["total_intercepted"] == 20 and row["daily_counts"] == day
    table = path + "-table"
    for value in (1, 2):
        store.write_store(spark.range(value), table)
    assert spark.read.parquet(table).count() == 2


def test_feedback_appends(spark):
    path = new_path(spark, "feedback")
    at = dt.datetime(2024, 1, 30, 12)
    for content in (" 甲\"乙 ", "丙，丁"):
        store.append_feedback(spark.createDataFrame([(content, "正常", at)], schemas.FEEDBACK), path)
    assert tuples(store.read_feedback(spark, path)) == sorted([(" 甲\"乙 ", "正常", at), ("丙，丁", "正常", at)], key=repr)


def test_predictions_round_trip(spark):
    path = new_path(spark, "predictions")
    rows = [("多\n行", "正常", "贷款诈骗", 0.9), ("a,b", "1", "正常", 0.1)]
    store.write_predictions(spark.createDataFrame(rows, store.PREDICTIONS), path)
    assert tuples(store.read_predictions(spark, path)) == sorted(rows, key=repr)


def test_mail_times(one):
    from fraudwatch.functions.text import mail_time

    at = dt.datetime(2024, 1, 30, 0, 0)
    for text in ("Tue, 30 Jan 2024 08:00:00 +0800", "30 Jan 2024 00:00:00 GMT", "Tue, 30 Jan 2024 08:00:00 +0800 (CST)"):
        assert one(mail_time(F.col("t")), t=text) == at
    assert one(mail_time(F.col("t")), t="yesterday") is None and one(mail_time(F.col("t")), t=None) is None


def test_two_edits_of_one_version(spark):
    """One is refused and nothing of it is seen; made anew on the newer version, both are there."""
    path = new_path(spark, "registry")
    kind = schemas.FEEDBACK
    row = lambda text: spark.createDataFrame([(text, "x", dt.datetime(2024, 1, 1))], kind)
    assert versions.read_version(spark, path, kind)[0] == 0 and versions.read_version(spark, path, kind)[1].count() == 0
    assert versions.commit_version(row("a"), path, 0) == 1
    version, rows = versions.read_version(spark, path, kind)
    assert versions.commit_version(rows.unionByName(row("b")), path, version) == 2
    with pytest.raises(versions.Conflict):
        versions.commit_version(rows.unionByName(row("c")), path, version)
    texts = lambda n=None: sorted(r["content"] for r in versions.read_version(spark, path, kind, n)[1].collect())
    assert texts() == ["a", "b"] and texts(1) == ["a"]
    met = []

    def change(now):
        if not met:
            met.append(versions.commit_version(now.unionByName(row("d")), path, 2))  # another writer comes first
        return now.unionByName(row("c"))

    assert versions.edit_store(spark, path, kind, change) == 4
    assert texts() == ["a", "b", "c", "d"] and texts(2) == ["a", "b"]


def test_a_large_corpus_is_written_by_many_tasks(spark, monkeypatch):
    """Beyond FILE_BYTES no task holds the whole corpus; the rows and their order stay those of one file."""
    from pathlib import Path

    from fraudwatch.catalog import source_queries
    from tools.compare import compare, tables

    roots, new_path = [], source_queries.new_path
    monkeypatch.setattr(source_queries, "new_path", lambda *a: roots.append(new_path(*a)) or roots[-1])
    monkeypatch.setattr(source_queries, "FILE_BYTES", 100_000)
    folder = "/root/testdata/sf0.001"
    count, same, note = compare(spark, tables(folder), folder, "s1_one_quoted_file")
    sizes = [p.stat().st_size for p in Path(roots[0]).glob("*.csv")]
    assert same and count, note
    assert len(sizes) > 2 and max(sizes) < sum(sizes) / 2
