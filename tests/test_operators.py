import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from papersluice.functions import text as T
from papersluice.operators import index, rules, search
from papersluice.operators.increments import IncrementalFeed, VersionedTarget, replay_runs
from papersluice.operators.skew import attach, pairs_within
from papersluice.operators.snapshot_diff import snapshot_changes
from papersluice.shared import SharedFolder
from papersluice.plans.query import QueryError, analyze, parse, parse_lenient

DOC = "path string, filename string, filetype string, batch string, size bigint, modified_ticks bigint, content string"


def docs(spark, *rows):
    """rows: (name, content) or (name, content, batch)"""
    return spark.createDataFrame([(f"/d/{r[0]}", r[0], "PDF", r[2] if len(r) > 2 else "b1", len(r[1] or ""), 638_000_000_000_000_000, r[1]) for r in rows], DOC)


# --- text


def slow_tokens(s):
    out, run, kind = [], "", None
    for c in (s or "") + "\0":
        cjk = any(a <= c <= b for a, b in ("぀ヿ", "㐀鿿", "가힣", "豈﫿", "\U00010000\U0010ffff"))
        k = "c" if cjk else "w" if c.isalpha() or c.isdecimal() else None
        if k != kind:
            if kind == "c":
                out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
            elif kind == "w":
                out.append(run.lower())
            run, kind = "", k
        run += c
    return out


def test_tokens(spark):
    rng = random.Random(1)
    texts = ["", None, "哈哈哈", "中a文b", "foo-bar 12", "报告v2", "𠮷野家", "한국어 カタカナ"] + ["".join(rng.choices("ab Z9_-.中文字한é١", k=rng.randrange(40))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", T.tokens(F.col("t")).alias("x")).collect():
        assert r.x == slow_tokens(r.t), r.t
        assert analyze(r.t or "") == r.x


def test_snippets(spark):
    long = "x" * 200 + " Key " + "y" * 200
    df = spark.createDataFrame([(long,), ("short key",), ("a\t\n　 key b",), (None,), ("nothing",), ("k" * 9000 + " key",)], "t string")
    got = [r[0] for r in df.select(T.snippet(F.col("t"), "key")).collect()]
    assert got[0] == "…" + "x" * 79 + " Key " + "y" * 79 + "…"
    assert got[1:] == ["short key", "a key b", "", "", ""]
    order = spark.createDataFrame([("alpha beta",)], "t string").select(T.snippet(F.col("t"), "zeta beta alpha")).first()[0]
    assert order == "alpha beta"
    assert T.highlight_terms("敏感信息 ABC-12 filename:采购") == ["敏感信息", "abc", "12", "filename", "采购"] and T.highlight_terms(None) == []
    spans = df.select(T.highlight_spans(F.col("t"), "key e")).first()[0]
    assert [(s.term, s.start) for s in spans] == [("key", 202), ("e", 203)]


def test_presentation(spark):
    df = spark.createDataFrame([(s,) for s in (0, 1023, 1024, 1536 * 1024, 3 * 1024**3, None)], "s bigint")
    assert [r[0] for r in df.select(T.format_size(F.col("s"))).collect()] == ["0 B", "1023 B", "1.0 KB", "1.5 MB", "3.00 GB", None]
    ts = spark.createDataFrame([(dt.datetime(2024, 5, 6, 7, 8, 9, 123456),)], "t timestamp").select(T.from_ticks(T.ticks(F.col("t")))).first()[0]
    assert ts == dt.datetime(2024, 5, 6, 7, 8, 9, 123456)
    assert spark.range(1).select(T.from_ticks(F.lit(0).cast("bigint"))).first()[0] is None


# --- queries


def found(df, q, **kw):
    return [r.filename for r in search.search(df, q, **kw).collect()]


def test_search(spark):
    df = docs(spark, ("contract.txt", "机密 财务报告 alpha"), ("draft.txt", "机密 草稿 alpha beta"), ("beta-plan.txt", "水库巡检表 beta gamma", "b2"), ("empty.txt", None), ("bar.txt", "foo bar; baz"))
    assert found(df, "机密 AND 财务") == ["contract.txt"]
    assert set(found(df, "财务 beta")) == {"contract.txt", "draft.txt", "beta-plan.txt"}
    assert found(df, "alpha beta")[0] == "draft.txt"
    assert found(df, "+机密 -草稿") == ["contract.txt"] and found(df, "机密 NOT 草稿") == ["contract.txt"]
    assert found(df, '"水库巡检表"') == found(df, "水库巡检表") == ["beta-plan.txt"] and found(df, "巡检水库") == []
    assert found(df, "foo-bar") == found(df, '"foo bar baz"') == ["bar.txt"]
    assert found(df, "filename:beta") == ["beta-plan.txt"] and set(found(df, "content:beta")) == {"draft.txt", "beta-plan.txt"}
    assert len(found(df, "filetype:PDF")) == 5 and found(df, "filetype:pdf") == []
    assert found(df, "beta", batch="b2") == ["beta-plan.txt"]
    assert found(df, "  ") == found(df, None) == found(df, "-alpha") == [] and found(df, "???") == []
    assert set(found(df, '机密 "unclosed')) == {"contract.txt", "draft.txt"}
    assert found(df, "(alpha OR gamma) AND beta") == ["draft.txt", "beta-plan.txt"] or set(found(df, "(alpha OR gamma) AND beta")) == {"draft.txt", "beta-plan.txt"}
    assert found(df, "gam*") == found(df, "g?mma") == found(df, "gama~1") == ["beta-plan.txt"] and found(df, '"foo baz"~1') == ["bar.txt"]
    assert found(df, "content:[gam TO gan]") == ["beta-plan.txt"] and found(df, "size:[0 TO 0]") == ["empty.txt"]
    assert len(found(df, "alpha beta", k=1)) == 1
    assert found(df.limit(0), "alpha") == []


@pytest.mark.parametrize("q", ["alpha beta", "+机密 -草稿", '"水库巡检表"', "foo-bar", "alpha AND beta", "filename:beta gamma", "-alpha", "", "gam*", "b?ta +alp*", "gama~1 foo", '"baz foo"~3', '"baz foo"~2', '"foo baz"~1', "content:[gam TO gan]", "filetype:PDF +beta", "size:[0 TO 12] beta", "batch:b2", "(alpha OR gam*) AND beta"])
def test_postings_agree(spark, q):
    df = docs(spark, ("contract.txt", "机密 财务报告 alpha"), ("draft.txt", "机密 草稿 alpha beta beta"), ("beta-plan.txt", "水库巡检表 beta gamma", "b2"), ("bar.txt", "foo bar; baz 哈哈哈哈"))
    a = [(r.path, r.score) for r in search.search(df, q).collect()]
    assert a == [(r.path, r.score) for r in search.search_postings(search.build_postings(df), df, q).collect()]


def test_score(spark):
    import math

    df = docs(spark, ("a", "x x y"), ("b", "y"))
    r = {x.filename: x.score for x in search.search(df, "x").collect()}
    assert r == {"a": round(math.sqrt(2) * (1 + math.log(2 / 2)) ** 2 / math.sqrt(3), 6)}


def test_parser():
    root = parse("a AND b OR c NOT d")
    assert [(c.occur, c.terms) for c in root.clauses] == [("must", ["a"]), ("must", ["b"]), ("should", ["c"]), ("must_not", ["d"])]
    assert [c.terms for c in parse("and").clauses] == [["and"]] and parse("a^2").clauses[0].boost == 2
    for bad in ('"open', "a AND", "(a", "a)", "nofield:x", "filename:"):
        with pytest.raises(QueryError):
            parse(bad)
        parse_lenient(bad)
    assert parse_lenient(" ") is None and parse_lenient("NOT a") is None


# --- rules


def test_rules(spark):
    made = [rules.Rule("id", r"\d{17}[\dXx]"), rules.Rule("name", "SECRET", "keyword", "high", True, False), rules.Rule("word", "机密", "keyword", "high", True, True), rules.Rule("bad", "(["), rules.Rule("never", "zzz"), rules.Rule("pair", r"(a)(b)\1"), rules.Rule("none", "")]
    df = docs(spark, ("a-secret.txt", "x" * 60 + "机密\nline" + "y" * 60), ("b.txt", "11010119900307123X"), ("c.txt", None), ("d.txt", "--aba--"), ("e.txt", "１２３４５６７８９０１２３４５６７８"))
    got = [(r.path[3:], r.phase, r.rule_name, r.matched) for r in rules.detect(df, made).collect()]
    assert got == [
        ("a-secret.txt", 0, "name", "SECRET"), ("a-secret.txt", 1, "word", "…" + "x" * 40 + "机密 line" + "y" * 35 + "…"), ("b.txt", 1, "id", "11010119900307123X"),
        ("d.txt", 1, "pair", "--aba--"), ("e.txt", 1, "id", "１２３４５６７８９０１２３４５６７８"),
    ]
    assert rules.detect(df, []).count() == rules.detect(df.limit(0), made).count() == 0
    assert {r.phase for r in rules.detect(df, made, include_content=False).collect()} == {0}
    assert rules.detect(df, made, max_bytes=20).count() == 4
    many = spark.range(1200).select(F.format_string("/d/%05d", "id").alias("path"), F.lit("机密.txt").alias("filename"), F.lit("x").alias("content"))
    assert rules.detect(many, made).count() == 1000 and rules.detect(many, made, cap=None).count() == 1200
    assert rules.Rule(" n ", " p ", "Odd", "Worst", id="i").normalised() == rules.Rule("n", "p", "regex", "medium", id="i")
    assert [(r.risk, r.n_hits, r.severity) for r in rules.rollup(rules.detect(df, made)).orderBy("severity").collect()] == [("medium", 3, 1), ("high", 2, 2)]
    assert rules.as_frame(spark, rules.DEFAULT_RULES).count() == 5


# --- snapshots and increments


def test_snapshots(spark):
    t = [dt.datetime(2024, 1, d) for d in range(1, 9)]
    rows = [
        (1, "a", 1, 1, "x", t[0]), (1, "b", None, 1, None, t[0]), (1, "A", 1, 1, "x", t[0]), (1, "c", 1, 1, "x", t[0]),
        (3, "a", 2, 1, "x", t[1]), (3, "a", 1, 1, "x", t[2]), (3, "a", 1, 1, "x", t[2]), (3, "b", None, 1, None, t[1]), (3, "A", 1, 1, None, t[1]), (3, "d", 1, 1, "x", None),
        (7, "d", 1, 2, "x", t[3]), (7, "b", 0, 1, "", t[3]), (None, "z", 1, 1, "x", t[3]), (7, None, 1, 1, "x", t[3]),
    ]
    df = spark.createDataFrame(rows, "snapshot_no int, path string, size bigint, modified_ticks bigint, batch string, loaded_at timestamp").withColumns({"later": F.lit(1), "k0": F.lit(2), "sign": F.lit(3)})
    got = {(r.snapshot_no, r.path): (r.change_kind, r.changed_fields) for r in snapshot_changes(df).collect()}
    assert got == {
        (3, "A"): ("changed", ["batch"]), (3, "c"): ("removed", []), (3, "d"): ("added", []),
        (7, "a"): ("removed", []), (7, "A"): ("removed", []), (7, "b"): ("changed", ["batch", "size"]), (7, "d"): ("changed", ["modified_ticks"]),
    }
    assert snapshot_changes(df.limit(0)).count() == snapshot_changes(df.where("snapshot_no = 1")).count() == 0


def brute_runs(feed, runs):
    done, before, out = sorted((s, n) for n, s, ok in {(n, s, True) for n, s, ok in runs if ok}), {}, set()
    for start, n in done:
        now = {}
        for fid, path, size, ticks, batch, seen, came in feed:
            if came <= start and (path not in now or (seen, fid) > now[path][0]):
                now[path] = ((seen, fid), (size, ticks, batch))
        out |= {(n, p) for p, v in now.items() if p not in before or before[p] != v[1]}
        before = {p: v[1] for p, v in now.items()}
    return out


def test_replay(spark, tmp_path):
    rng = random.Random(5)
    t0 = dt.datetime(2025, 1, 1)
    hours = lambda h: t0 + dt.timedelta(hours=h)
    feed = [(i, f"p{rng.randrange(12)}", rng.choice([None, 1, 2]), rng.randrange(2), rng.choice([None, "b"]), hours(rng.randrange(90)), hours(rng.randrange(100))) for i in range(200)]
    feed += feed[:40] + [(900 + i, "hot", 1, 1, "b", hours(1), hours(2)) for i in range(100)]
    runs = [(n, hours(10 * n), n not in (3, 4)) for n in range(1, 9)]
    log = [(n, s, None, None) for n, s, _ in runs] + [(n, s, s, ok) for n, s, ok in runs] * 2
    f = spark.createDataFrame(feed, "feed_id bigint, path string, size bigint, modified_ticks bigint, batch string, observed_at timestamp, arrived_at timestamp")
    r = spark.createDataFrame(log, "run_no int, started_at timestamp, finished_at timestamp, completed boolean")
    got = [(x.run_no, x.path) for x in replay_runs(f, r, str(tmp_path / "t")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_runs(feed, runs)
    assert replay_runs(f.limit(0), r, str(tmp_path / "e1")).count() == replay_runs(f, r.limit(0), str(tmp_path / "e2")).count() == 0


def test_failed_runs_leave_nothing(spark, tmp_path, monkeypatch):
    rows = [(1, "a", 1, 1, "b", dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 1)), (2, "b", 1, 1, "b", dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 1))]
    f = spark.createDataFrame(rows, "feed_id bigint, path string, size bigint, modified_ticks bigint, batch string, observed_at timestamp, arrived_at timestamp")
    inc = IncrementalFeed(spark, str(tmp_path / "t"), f)
    upto = dt.datetime(2025, 1, 2)
    real = SharedFolder.claim
    monkeypatch.setattr(SharedFolder, "claim", lambda self, name, text: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        inc.run("1", upto)
    monkeypatch.setattr(SharedFolder, "claim", real)
    assert inc.emitted().count() == 0
    assert inc.run("1", upto) and not inc.run("1", upto)
    assert {r.path for r in inc.emitted().collect()} == {"a", "b"} and inc.emitted().count() == 2


FEED = "feed_id bigint, path string, size bigint, modified_ticks bigint, batch string, observed_at timestamp, arrived_at timestamp"


def test_late_rows_are_done(spark, tmp_path):
    day = lambda d: dt.datetime(2025, 1, d)
    rows = [(1, "a", 1, 1, "b", day(1), day(1))]
    inc = IncrementalFeed(spark, str(tmp_path / "t"), spark.createDataFrame(rows, FEED))
    assert inc.run("1", day(3))
    rows.append((2, "late", 1, 1, "b", day(1), day(2)))  # reaches the feed after the run, though it arrived before
    rows.append((0, "a", 9, 9, "b", dt.datetime(2024, 1, 1), day(4)))  # older than what is held
    inc = IncrementalFeed(spark, str(tmp_path / "t"), spark.createDataFrame(rows, FEED))
    assert inc.run("2", day(5)) and inc.run("3", day(6))
    assert sorted((r.run, r.path) for r in inc.emitted().collect()) == [("1", "a"), ("2", "late")]


def test_one_of_two_writers_wins(spark, tmp_path, monkeypatch):
    schema = spark.createDataFrame([], "x int").schema
    a, b = (VersionedTarget(spark, str(tmp_path / "t"), schema) for _ in range(2))
    df = spark.createDataFrame([(1,)], schema)
    real = SharedFolder.claim

    def late(self, name, text):
        monkeypatch.setattr(SharedFolder, "claim", real)
        assert a.publish("first", df)
        return real(self, name, text)

    monkeypatch.setattr(SharedFolder, "claim", late)
    with pytest.raises(RuntimeError):
        b.publish("second", df)
    assert [m["run"] for m in b.manifests()] == ["first"] and len(a.folder.names("data")) == 1
    assert b.publish("second", df) and a.read().count() == 2


def test_damaged_manifest(spark, tmp_path):
    schema = spark.createDataFrame([], "x int").schema
    t = VersionedTarget(spark, str(tmp_path / "t"), schema)
    for i in range(3):
        t.publish(str(i), spark.createDataFrame([(i,)], schema), replaces=True)
    (tmp_path / "t/_published/00000002.json").write_text('{"run": "2"')
    (tmp_path / "t/_published/.00000002.json.crc").unlink(missing_ok=True)
    again = VersionedTarget(spark, str(tmp_path / "t"), schema)
    assert [r.x for r in again.read().collect()] == [1]
    assert again.publish("3", spark.createDataFrame([(3,)], schema), replaces=True) and [r.x for r in again.read().collect()] == [3]
    assert again.vacuum() == 2 and [r.x for r in again.read().collect()] == [3]
    for f in (tmp_path / "t/_published").iterdir():
        f.write_text("x")
    assert VersionedTarget(spark, str(tmp_path / "t"), schema).read().count() == 0


def test_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("papersluice.operators.increments.COMPACT_AFTER", 2)
    day = lambda d: dt.datetime(2025, 1, d)
    rows = [(d, p, d // 2, 1, "b", day(d), day(d)) for d in range(1, 12) for p in "ab"]
    f = spark.createDataFrame(rows, "feed_id bigint, path string, size bigint, modified_ticks bigint, batch string, observed_at timestamp, arrived_at timestamp")
    runs = [(d, day(d), True) for d in range(1, 12)]
    r = spark.createDataFrame([(n, s, ok) for n, s, ok in runs], "run_no int, started_at timestamp, completed boolean")
    got = {(x.run_no, x.path) for x in replay_runs(f, r, str(tmp_path / "t")).collect()}
    assert got == brute_runs(rows, runs)


# --- index


def listing(spark, rows):
    return spark.createDataFrame([(p, p.rsplit("/", 1)[1], ".txt" if p.endswith("t") else ".bin", s, t, b) for p, s, t, b in rows], "path string, filename string, ext string, size bigint, modified_ticks bigint, batch string")


def test_index(spark):
    have = spark.createDataFrame([(f"/r/{n}.txt", f"{n}.txt", "文本", "b", 1, 1, n) for n in "abcd"] + [("/other/z.txt", "z.txt", "文本", "o", 1, 1, "z")], DOC)
    files = listing(spark, [("/r/a.txt", 1, 1, "b"), ("/r/b.txt", 2, 1, "b"), ("/r/c.txt", 1, 1, "b2"), ("/r/e.txt", 1, 1, None), ("/r/f.bin", 1, 1, "b"), ("/r/A.txt", 1, 1, "b")])
    act = lambda **kw: {r.path: r.action for r in index.diff(files, have, **kw).collect()}
    base = {"/r/a.txt": "skipped", "/r/b.txt": "updated", "/r/c.txt": "updated", "/r/e.txt": "added", "/r/f.bin": "added", "/r/A.txt": "added", "/r/d.txt": "removed"}
    assert act(root="/r") == base | {"/other/z.txt": "kept"} and act(removal_scope="all") == base | {"/other/z.txt": "removed"}
    assert act(cancelled=True)["/r/d.txt"] == "kept" and set(act(full_rebuild=True).values()) == {"added", "removed"}
    actions = index.diff(files, have, root="/r")
    texts = spark.createDataFrame([("/r/b.txt", True, False, None, "damaged", "文本"), ("/r/c.txt", True, True, "cc", None, "文本"), ("/r/e.txt", True, True, "ee", None, "文本"), ("/r/f.bin", False, False, None, None, "其他"), ("/r/A.txt", True, True, "long", None, "文本")], "path string, supported boolean, ok boolean, text string, error string, label string")
    fresh = index.to_documents(actions.where("action IN ('added', 'updated')"), texts, max_chars=2)
    after = {r.path: (r.content, r.batch) for r in index.apply_changes(have, actions, fresh).collect()}
    assert after == {"/r/a.txt": ("a", "b"), "/r/b.txt": ("b", "b"), "/r/c.txt": ("cc", "b2"), "/r/e.txt": ("ee", ""), "/r/f.bin": ("", "b"), "/r/A.txt": ("lo", "b"), "/other/z.txt": ("z", "o")}
    s = index.run_stats(actions, fresh, index.apply_changes(have, actions, fresh)).first().asDict()
    assert s == {"added": 3, "updated": 1, "skipped": 1, "failed": 1, "unsupported": 1, "removed": 1, "total_docs": 7, "completed": True}
    assert [tuple(r) for r in index.errors(fresh).collect()] == [("/r/b.txt", "damaged")]
    large = index.to_documents(actions.where("path = '/r/c.txt'"), texts, max_bytes=0).first()
    assert (large.ok, large.content) == (True, "") and large.error
    names = index.to_documents(actions.where("action = 'added'"), None, include_content=False).collect()
    assert {(r.filetype, r.content) for r in names} == {("其他", "")}
    assert index.delete_batch(have, "b").count() == 1 and index.delete_batch(have, " ").count() == 5
    assert index.diff(files.limit(0), have.limit(0)).count() == 0


def test_store(spark, tmp_path):
    store = index.IndexStore(spark, str(tmp_path / "ix"))
    assert store.count() == 0
    a = docs(spark, ("a", "x"))
    assert store.commit("1", a) and not store.commit("1", a)
    reader = store.read()
    assert store.apply("1b", a.where("false"), a.where("false")) and store.count() == 1
    store.commit("2", docs(spark, ("b", "y"), ("c", "z")))
    assert reader.count() == 1 and store.count() == 2
    assert {r.term for r in store.postings().collect()} == {"b", "c", "y", "z"}
    plan = store.postings().where("term IN ('y')")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "term" in plan.split("PushedFilters")[1][:80]


def test_store_of_deltas(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "COMPACT_AFTER", 3)
    store, want = index.IndexStore(spark, str(tmp_path / "ix")), {}
    rng = random.Random(4)
    gone_schema = "path string"
    for run in range(8):
        fresh = {f"f{rng.randrange(9)}": f"word{rng.randrange(30)} run{run}" for _ in range(3)}
        gone = {n for n in rng.sample(sorted(want), min(2, len(want))) if n not in fresh}
        assert store.apply(str(run), docs(spark, *fresh.items()), spark.createDataFrame([(f"/d/{n}",) for n in gone], gone_schema))
        want = {n: c for n, c in want.items() if n not in gone} | fresh
        assert {r.filename: r.content for r in store.read().collect()} == want
        assert {(r.path, r.term) for r in store.postings().where("field = 'content'").collect()} == {(f"/d/{n}", w) for n, c in want.items() for w in c.split()}
    assert len(store._target.current()) <= 4 and not store.apply("7", docs(spark), spark.createDataFrame([], gone_schema))
    assert len(store._target.folder.names("data")) < 3 * 10
    plan = search.search_postings(store.postings(), store.read(), "word1 run7", snippets=True)._jdf.queryExecution().executedPlan().toString()
    assert "path" in plan and "content" in plan and "In(path" in plan


def test_postings_follow_changes(spark):
    have = docs(spark, ("a", "x one"), ("b", "y two"), ("c", "z"))
    actions = spark.createDataFrame([("/d/a", "updated"), ("/d/b", "removed"), ("/d/c", "skipped"), ("/d/n", "added")], "path string, action string")
    fresh = docs(spark, ("a", "x three"), ("n", "new")).withColumns({"ok": F.lit(True), "unsupported": F.lit(False), "error": F.lit(None).cast("string")})
    after = index.apply_changes(have, actions, fresh)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(index.apply_to_postings(search.build_postings(have), actions, fresh)) == rows(search.build_postings(after))


def test_skewed_joins(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert attach(rows, sizes, ["k"], ["id"]).agg(F.sum("n")).first()[0] == rows.groupBy("k").count().agg(F.sum(F.col("count") ** 2)).first()[0]
    a, b = pairs_within(rows, sizes, ["k"], ["id"], block=64)
    n = a.alias("a").join(b.alias("b"), ["k", "_part"]).where("a.id < b.id").count()
    assert n == rows.groupBy("k").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0]


def test_order_of_all_rows(spark):
    from papersluice.operators.order import ranked

    paths = [f"/srv/{i * 7919 % 1000:04}" for i in range(1000)] + [None]
    got = [(r.path, r.n) for r in ranked(spark.createDataFrame([(p,) for p in paths], "path string"), "path").orderBy("n").collect()]
    assert got == [(p, i) for i, p in enumerate([*sorted(paths[:-1]), None], 1)]
    assert ranked(spark.createDataFrame([], "path string"), "path").count() == 0
