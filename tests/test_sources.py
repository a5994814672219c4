import json

import pytest
from pyspark.sql import functions as F

from itemloom.operators import assets as A
from itemloom.sinks import tables as K
from itemloom.sources import files as S

ITEM = """---
id: q1
type: 单选题
number: "12"
tags: [代数, 函数, 代数]
starred: true
order: 2.5
custom: keep me
---
题干第一行

## 备注
记一笔

## 解析
答案 A

## 解析
第二种
"""


@pytest.fixture
def bank(tmp_path):
    root = tmp_path / "bank"
    def put(path, text):
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8", newline="")
    put("a/one.md", ITEM)
    put("a/b/two.md", "## 第一节\r\n内容\r\n\r\n## 补充\r\n更多")
    put("a/b/three.md", "---\nkind: handout\n---\nnot an item")
    put("a/b/four.md", "---\nkind: Question\nnumber: 十七\nimg_split: \"off\"\n---\n## 解析\n只有解析")
    put("_assets/x.md", "no")
    put(".obsidian/y.md", "no")
    put("a/试卷 答案.pdf", "x")
    put("pic.PNG", "abc")
    return str(root)


def test_bank_items(spark, bank):
    got = {r.title: r for r in S.read_bank(spark, bank).collect()}
    assert set(got) == {"one", "two", "four"}
    one = got["one"]
    assert (one.id, one.number, one.starred, one.order, one.folder, one.path) == ("q1", 12, True, 2.5, "a", "a/one.md")
    assert (one.body, one.solution, one.note, one.tags) == ("题干第一行", "答案 A", "记一笔", ["代数", "函数", "代数"])
    assert [(p.heading, p.content) for p in one.extra_sections] == [("备注", "记一笔"), ("解析", "第二种")]
    assert one.extra_meta == {"custom": "keep me"} and one.img_split is None
    two = got["two"]
    assert two.body == "## 第一节\n内容" and two.id == "two" and [p.heading for p in two.extra_sections] == ["补充"]
    four = got["four"]
    assert (four.body, four.solution, four.number, four.img_split) == ("", "只有解析", None, "off")


def test_folder_scan(spark, bank):
    assert {r.title for r in S.read_bank(spark, bank, "a").collect()} == {"one", "two", "four"}
    assert {r.title for r in S.read_bank(spark, bank, "a", recursive=False).collect()} == {"one"}


def test_files_and_assets(spark, bank):
    files = S.list_files(spark, bank)
    known, ignored = S.list_assets(spark, bank, A.ASSET_TYPES)
    assert {r.name for r in known.collect()} == {"试卷 答案.pdf", "pic.PNG"} and ignored.count() == files.count() - 2
    assert [(r.folder, r.kind) for r in A.attachments(files, "a").collect()] == [("a", "solution")]


def test_archives_layouts_tasks_manifests(spark, tmp_path):
    root = tmp_path / "arch"
    for name, files in {"r1": {"p_raw.md": "single", "p_combined_raw.md": "both", "meta.json": json.dumps({"stem": "p"})}, "r2": {"q_raw.md": "only"}}.items():
        (root / name).mkdir(parents=True)
        for f, text in files.items():
            (root / name / f).write_text(text, encoding="utf-8")
    got = {r.archive: (r.raw_md, (r.meta or {}).get("stem")) for r in S.read_archives(spark, str(root)).collect()}
    assert got == {"r1": ("both", "p"), "r2": ("only", None)}

    lay = tmp_path / "lay" / "d"
    lay.mkdir(parents=True)
    (lay / "x_content_list.json").write_text(json.dumps([{"page_idx": 1, "type": "image", "img_path": "images/a.jpg", "bbox": [0.1, 0.2, 0.3, 1.0]}, {"type": "text", "text": "A", "bbox": [1, 2, 300, 4]}]))
    rows = S.read_layouts(spark, str(tmp_path / "lay")).orderBy("seq").collect()
    assert [(r.doc, r.page, r.kind, r.figure, r.x0, r.y1) for r in rows] == [("d", 1, "image", "a.jpg", 100.0, 1000.0), ("d", 0, "text", None, 1.0, 4.0)]

    tasks = tmp_path / "tasks.json"
    tasks.write_text(json.dumps({"kind": "batch", "task_id": "t", "updated_at": "soon", "payload": {"status": "x", "groups": [{"gid": 1, "status": "done"}, {"gid": 2, "status": "error"}]}}))
    read = S.read_tasks(spark, str(tasks), "batch")
    assert [(r.task_id, r.gid, r.status) for r in S.task_groups(read).orderBy("gid").collect()] == [("t", 1, "done"), ("t", 2, "error")]
    assert A.expired_tasks(read, F.lit(1e9)).count() == 1

    man = tmp_path / "man"
    man.mkdir()
    (man / "a.json").write_text(json.dumps({"schema": 1, "id": "old", "created_at": "2024-01-01", "files": []}))
    (man / "b.json").write_text(json.dumps({"schema": 1, "id": "new", "created_at": "2024-02-01", "files": []}))
    (man / "c.json").write_text("{ broken")
    (man / "d.json").write_text(json.dumps({"schema": 2, "id": "v2"}))
    assert [r.id for r in S.read_manifests(spark, str(man)).collect()] == ["new", "old"]


def test_publish_swaps_whole_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    K.publish(spark.range(3), path)
    first = K.read_current(spark, path)
    K.publish(spark.range(5), path)
    assert (first.count(), K.read_current(spark, path).count()) == (3, 5)
    K.append_run(spark.range(1), str(tmp_path / "runs"), "r1")
    with pytest.raises(Exception):
        K.append_run(spark.range(1), str(tmp_path / "runs"), "r1")


def test_texts_are_written_by_many_tasks_and_read_back(spark, tmp_path):
    from itemloom.sinks.tables import write_texts
    from itemloom.sources.files import read_overrides, read_texts
    rows = [(f"t{k}\nx", f"g{k % 3}", str(k)) for k in range(40)] + [("t0\nx", "g0", "0"), (None, "g0", "0"), ("z", None, "9")]
    df = spark.createDataFrame(rows, "value string, a string, b string").coalesce(1)
    root = write_texts(df, f"{tmp_path}/texts", ["a", "b"])
    files = list((tmp_path / "texts").rglob("*.txt"))
    assert len(files) == 43 and len({f.name.split("-")[1] for f in files}) > 1  # one task wrote them all before
    back = sorted((r.path.rsplit("/", 1)[0], r.text) for r in read_texts(spark, root, "*.txt").collect())
    assert back == sorted((f"a={a or '__HIVE_DEFAULT_PARTITION__'}/b={b}", (v or "") + "\n") for v, a, b in rows)
    none = write_texts(df.filter("1 = 0"), f"file:{tmp_path}/none", ["a", "b"])
    assert read_texts(spark, none, "*.txt").count() == 0
    notes = spark.createDataFrame([(f'[{{"gid":{k},\n"operation":"drop"}}]', str(k)) for k in range(5)], "value string, run string")
    got = read_overrides(spark, write_texts(notes, f"{tmp_path}/notes", ["run"]))
    assert "run" not in got.columns and sorted(r.gid for r in got.collect()) == [0, 1, 2, 3, 4]
