import os
import threading

from papersluice.plans import samples as fx
import pytest

from papersluice.api import Busy, Engine
from papersluice.operators.rules import Rule
from papersluice.sources.files import list_files
from papersluice.sources.stores import Batch, BatchRegistry, RuleStore, Settings, new_batch_id, rolling_log


def write(root, files):
    for name, body in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body if isinstance(body, bytes) else body.encode())


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "docs"
    write(root, {
        "a.txt": "机密文件 alpha report", "sub/gbk.txt": "国标编码的文本内容 审计".encode("gb18030"), "sub/deep/er/w.log": "﻿utf16 日志".encode("utf-16-le"), "b.docx": fx.docx(), "b.xlsx": fx.xlsx(),
        "b.pptx": fx.pptx(), "c.doc": fx.doc(), "c.xls": fx.xls(), "c.ppt": fx.ppt(), "c.wps": fx.wps(), "p.wps": fx.docx(), "d.ofd": fx.ofd(), "z.zip": fx.package({"in.txt": "archived words"}), "_hidden.txt": "underscore",
    })
    return root


def test_listing(spark, corpus):
    (corpus / "link").symlink_to(corpus / "sub")
    rows = list_files(spark, str(corpus)).collect()
    assert len(rows) == 14 and {r.filename for r in rows} >= {"w.log", "_hidden.txt", "gbk.txt"}
    one = next(r for r in rows if r.filename == "a.txt")
    assert one.size == os.path.getsize(one.path) and one.ext == ".txt" and one.modified_ticks > 638_000_000_000_000_000
    assert {r.filename for r in list_files(spark, str(corpus), [".docx", ".zip"]).collect()} == {"b.docx", "z.zip"}
    assert list_files(spark, str(corpus), exclude=[str(corpus / "SUB") + "/"]).count() == 12
    assert [r.filename for r in list_files(spark, str(corpus / "z.zip")).collect()] == ["z.zip"]
    assert list_files(spark, str(corpus / "missing")).count() == 0


def test_engine(spark, tmp_path, corpus):
    e = Engine(spark, str(tmp_path / "home"))
    assert e.search("机密").count() == 0 and e.total_docs() == 0
    first = e.scan(str(corpus), "first")
    assert (first.added, first.failed, first.total_docs) == (14, 0, 14) and first.batch.name == "first"
    for query, name in (("审计", "gbk.txt"), ("日志", "w.log"), ("预算", "b.docx"), ("parts", "b.xlsx"), ("slide", "b.pptx"), ("narrow", "c.doc"), ("名称", "c.xls"), ("标题", "c.ppt"), ("水库巡检表", "c.wps"), ("tenth", "d.ofd"), ("archived", "z.zip")):
        assert name in [r.filename for r in e.search(query).collect()], query
    assert e.search("不存在的词语").count() == 0
    hit = e.search("alpha").first()
    assert hit.snippet == "机密文件 alpha report" and hit.filetype == "文本"
    assert [(s.term, s.start) for s in e.preview(hit.path, "alpha").first().spans] == [("alpha", 6)]

    again = e.update_batch(first.batch.id)
    assert (again.skipped, again.added, again.updated, again.removed) == (14, 0, 0, 0)
    write(corpus, {"a.txt": "changed words entirely", "new.md": "fresh", "bad.docx": b"PK damaged"})
    (corpus / "z.zip").unlink()
    third = e.update_batch(first.batch.id)
    assert (third.updated, third.added, third.removed, third.failed, third.total_docs) == (1, 1, 1, 1, 14)
    assert third.errors and third.errors[0][0].endswith("bad.docx")

    other = tmp_path / "other"
    write(other, {"o.txt": "other root", "x.exe": b"\1"})
    second = e.scan(str(other), include_content=False)
    assert (second.added, second.removed, second.total_docs) == (2, 0, 16)
    assert {r.n_docs for r in e.batch_options().collect()} == {14, 2} and tuple(e.batch_summary().first()) == (2, 16)
    assert e.search("o", batch=second.batch.id).count() == 1 and e.batch_count(second.batch.id) == 2 and e.batch_count(" ") == 0
    e.delete_batch(second.batch.id)
    assert e.total_docs() == 14 and len(e.batches.all()) == 1
    moved = e.scan(str(corpus / "sub"), "part")
    assert moved.updated == 2 and e.batch_count(first.batch.id) == 12

    hits = e.detect(str(other), rule_list=[Rule("o", "other", "keyword"), Rule("n", r"\.exe$", "regex", "low", True, False)]).collect()
    assert [(r.rule_name, r.match_type) for r in hits] == [("o", "content"), ("n", "filename")]
    assert e.detect(str(other / "o.txt"), include_content=False, rule_list=[Rule("o", "other", "keyword", match_filename=True)]).count() == 0
    e.clear()
    assert e.total_docs() == 0 and e.batches.all() == []


def test_removal_scope_all(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    write(a, {"1.txt": "x"})
    write(b, {"2.txt": "y"})
    e = Engine(spark, str(tmp_path / "home"), removal_scope="all")
    e.scan(str(a))
    assert e.scan(str(b)).removed == 1 and e.total_docs() == 1


def test_gate(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "home"))
    with e._exclusive():
        assert e.busy
        refused = []
        t = threading.Thread(target=lambda: refused.append(pytest.raises(Busy, e.clear)))
        t.start()
        t.join()
        assert refused
        assert e.search("x").count() == 0
    assert not e.busy


def test_stores(tmp_path, spark):
    reg = BatchRegistry(str(tmp_path / "b.json"))
    reg.add(Batch("b1", "one", "/r"))
    reg.add(Batch("b2", "two", "/s", include_content=False))
    assert [b.id for b in reg.all()] == ["b1", "b2"] and not reg.find("b2").include_content and reg.find("b9") is None
    assert reg.as_frame(spark).count() == 2 and reg.remove("b1") and not reg.remove("b1")
    reg.clear()
    assert reg.all() == []
    rules = RuleStore(str(tmp_path / "r.json"))
    assert len(rules.all()) == 5
    rules.add(Rule(" mine ", "x", "odd", "odd", id="m"))
    rules.remove("rule_ipv4")
    assert [r.id for r in rules.all()] == ["rule_idcard", "rule_mobile", "rule_confidential", "rule_internal", "m"] and rules.all()[-1].risk == "medium"
    (tmp_path / "r.json").write_text("{broken")
    assert len(rules.all()) == 5
    Settings("/a", "/b", True).save(str(tmp_path / "s.json"))
    assert Settings.load(str(tmp_path / "s.json")).full_rebuild and Settings.load(str(tmp_path / "none")) == Settings()
    assert len(new_batch_id()) == len("batch_") + 17
    rolling_log(str(tmp_path / "x.log"), "t").info("line")
    assert "line" in (tmp_path / "x.log").read_text()
