import random
import time
import unicodedata
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papersluice.llm import abuse, garbled, leakage, personal
from papersluice.llm.bpe import TOKENIZERS, ByteBpe, CorpusEncoder, encode_corpus
from papersluice.llm.lookalike import forms, lookalike_classes, lookalike_pairs, skeleton
from papersluice.llm.records import text_records
from papersluice.llm.terms import chars, terms

RECORD = "field string, rec_id bigint, text string"


def records(spark, rows):
    return spark.createDataFrame(rows, RECORD).withColumns({"shape": F.lit("clash"), "own": F.lit(1), "_part": F.lit(2)})


# --- look-alikes


@pytest.mark.parametrize(
    "a,b",
    [
        ("Ｆull ｗidth １２", "Full width 12"), ("cafe\u0301", "caf\u00e9"), ("zero​wid­th﻿", "zerowidth"), ("a b　c d", "a b c d"), ("РауРаl", "PayPal"), ("编号⼯⽉", "编号工月"),
        ("Οmega", "Omega"), ("𝐁old", "Bold"), ("ｶﾞ", "ガ"), ("ﬁle Ⅳ", "file IV"), ("\uf98e", "\u5e74"), ("，", ","),
    ],
)
def test_same_form(a, b):
    assert skeleton(a) == skeleton(b) and a != b


@pytest.mark.parametrize("a,b", [("a", "A"), ("é", "e"), ("1", "①"), ("2", "²"), ("a.", "a"), ("a  b", "a b"), ("0", "O"), ("1", "l"), ("’", "'"), ("ñ", "n"), ("3", "8"), ("a\nb", "a b")])
def test_other_form(a, b):
    assert skeleton(a) != skeleton(b)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_form_is_stable(t):
    once = skeleton(t)
    assert skeleton(once) == once == skeleton(unicodedata.normalize("NFD", t)) == skeleton(unicodedata.normalize("NFC", t))


def test_pairs(spark):
    rng = random.Random(3)
    variants = ["text one", "text​ one", "tеxt one", "text one", "Text one", "text two", "ｔext two", "", None]
    rows = [(f, i, rng.choice(variants)) for f in ("snippet", "matched") for i in range(60)]
    rows += [("snippet", 1000 + i, "hot") for i in range(90)] + [("snippet", 2000, "h​ot")] + rows[:20] + [("snippet", None, "hot")]
    df = records(spark, rows)
    got = [tuple(r) for r in lookalike_pairs(df).collect()]
    want = {(f, i, j) for f in ("snippet", "matched") for (i, a), (j, b) in combinations(sorted({(i, t) for g, i, t in rows if g == f and t and i is not None}), 2) if i < j and a != b and skeleton(a) == skeleton(b)}
    assert len(got) == len(set(got)) and set(got) == want
    classes = {(r.field, r.rec_id): (r.class_id, r.n_strings) for r in lookalike_classes(df).collect()}
    assert classes["snippet", 2000] == (1000, 2) and classes["snippet", 1050] == (1000, 2)
    links = {(r.field, r.rec_id): r.n_links for r in lookalike_classes(df).collect()}
    assert all(links[f, i] == sum(1 for g, a, b in want if g == f and i in (a, b)) for f, i in links)
    assert lookalike_pairs(df.limit(0)).count() == lookalike_classes(df.limit(0)).count() == 0
    assert {r.form for r in forms(records(spark, [("s", 1, None), ("s", 2, ""), ("s", 3, "Ａ" * 5000)])).collect()} == {None, "", "A" * 5000}


@pytest.mark.parametrize("a,b", ["ᴀꭺ", "vᴠ", "zᴢ", "sꜱ", "wѡ", "足⻊", "肉⺼", "辶⻌", "一ー", "нʜ"])
def test_small_capitals_and_radicals(a, b):
    assert skeleton(a) == skeleton(b)


def test_many_equal_strings_and_one_alike(spark):
    df = spark.range(200_000).select(F.lit("s").alias("field"), F.col("id").alias("rec_id"), F.when(F.col("id") == 77, F.lit("sto\u0441k")).otherwise(F.lit("stock")).alias("text"))
    started = time.time()
    got = lookalike_pairs(df)
    assert got.count() == 199_999 and got.where("id_a <> 77 AND id_b <> 77").count() == 0
    assert time.time() - started < 120


# --- encoding damage


CLEAN = [f"{a}_{b}_{n}.docx" for n in range(12) for a in ("résumé", "größere Übersicht", "señalización", "étiquette complète", "geprüfte Maßnahme") for b in ("privée", "über", "año")]
CLEAN += [f"{a}{b}{n}号.pdf" for n in range(12) for a in ("检验报告", "评估方案", "会议纪要", "工资表") for b in ("定稿", "归档", "修订后的", "财务")]
CLEAN += [f"{a} {b} {n}.txt" for n in range(12) for a in ("новая опись", "архивная справка", "старая расписка") for b in ("в архиве", "на складе", "согласно плану")]


@pytest.fixture(scope="module")
def model():
    return garbled.EncodingModel(CLEAN)


def test_chains_invert(model):
    rng = random.Random(2)
    right = found = total = 0
    for chain in ("utf-8>latin-1", "utf-8>cp1252", "utf-8>cp1251", "utf-8>cp437", "gb18030>latin-1", "cp1251>cp1252", "cp1252>cp1251", "utf-8>gb18030"):
        for t in rng.sample(CLEAN, 40):
            g = garbled.garble(t, chain)
            if g is None or garbled.LOST in g:
                continue
            total += 1
            x = model.examine(g)
            found += x is not None
            right += x is not None and x.restored == t
    assert total > 100 and found > 0.95 * total and right > 0.9 * total


def test_unharmed(model):
    assert [t for t in CLEAN if model.examine(t)] == []
    for t in ("", None, "plain ascii", "Łąka i żółć.txt", "RELAÇÃO", "± 5 µm", "№ 5", "tеxt with а look-alike"):
        assert model.examine(t) is None


def test_in_part_and_lost(model):
    t = "修订后的会议纪要归档，请注意 " + garbled.garble("检验报告评估方案", "utf-8>cp437") + " 财务定稿"
    assert model.examine(t).restored == "修订后的会议纪要归档，请注意 检验报告评估方案 财务定稿"
    assert model.examine("��������.doc").restored is None


def test_find_garbled(spark):
    bad = garbled.garble("检验报告评估方案", "gb18030>latin-1")
    df = records(spark, [("name", i, t) for i, t in enumerate(CLEAN)] + [("name", 900, bad), ("name", 900, bad), ("snippet", 901, None), ("snippet", 902, ""), ("snippet", 903, "x" * 100_000 + "é")])
    assert [tuple(r) for r in garbled.find_garbled(df).collect()] == [("name", 900, "gb18030>latin-1", "检验报告评估方案", "inverted")]
    assert [tuple(r) for r in garbled.garbled_ids(df).collect()] == [("name", 900)]
    assert garbled.find_garbled(df.limit(0)).count() == garbled.garbled_ids(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_rare_letters_are_no_case(spark, data, seed):
    rows = [r.text for r in text_records(spark, data[: -len("sf0.001")] + "sf0.01", "name", "filename").distinct().orderBy("field", "rec_id", "text").collect() if not r.text.isascii()]
    m = garbled.EncodingModel(random.Random(seed).sample(rows, 600))
    for t in ("anlagen/Žluťoučký list.pdf", "── Torquin ──.log", "Łąka i żółć.txt", "Þórr og Ægir.doc", "①②③.txt", "НОВАЯ ДОВЕРЕННОСТЬ.pdf"):
        assert m.examine(t) is None, t


def test_two_stretches_and_evidence(model):
    a, b = garbled.garble("检验报告评估方案", "utf-8>cp437"), garbled.garble("修订后的会议纪要", "gb18030>latin-1")
    found = model.examine(f"工资表财务 {a} 定稿归档 {b} 财务定稿")
    assert (found.restored, found.evidence) == ("工资表财务 检验报告评估方案 定稿归档 修订后的会议纪要 财务定稿", garbled.INVERTED)
    assert model.examine("��������.doc").evidence == garbled.REPLACED


def test_stretches_by_brute_force(model, monkeypatch):
    rng = random.Random(8)
    texts = [t if i % 3 else garbled.garble(t, rng.choice(model.chains)) or t for i, t in enumerate(rng.sample(CLEAN, 40))] + ["é", "a" * 50 + "ü"]
    want = []
    for t in texts:
        idx = garbled.bigrams([t])[0]
        score = model.ratio[idx].astype(float)
        want.append({k: max(score[i:j, k].sum() for i in range(len(idx)) for j in range(i + 1, len(idx) + 1)) for k in range(len(model.chains))})
    for size in (garbled.AT_ONCE, 7):  # pieces of long texts give the same
        monkeypatch.setattr(garbled, "AT_ONCE", size)
        for t, w, got in zip(texts, want, model.stretches(texts)):
            assert {k for _, k, _, _ in got} == {k for k, v in w.items() if v >= garbled.TRY_FROM}
            assert all(abs(s - w[k]) < 1e-3 and 0 <= a < z <= len(t) for s, k, a, z in got)


def test_garbled_recall_on_planted_records(spark, data):
    rows = sorted((r.field, r.rec_id, r.text) for r in text_records(spark, data[: -len("sf0.001")] + "sf0.01", "name", "filename", "snippet").distinct().collect() if not r.text.isascii())
    m = garbled.EncodingModel([t for _, _, t in rows])
    bad = {i for i, _ in m.examine_all([t for _, _, t in rows])}
    clean = [t for i, (_, _, t) in enumerate(rows) if i not in bad and skeleton(t) == unicodedata.normalize("NFD", t)]
    rng = random.Random(6)
    planted = [(t, g) for c in ("utf-8>latin-1", "utf-8>cp1252", "utf-8>cp437", "utf-8>gb18030", "gb18030>latin-1", "gb18030>cp437", "cp1251>cp1252", "cp866>cp1251", "utf-8>latin-1>cp1252") for t in rng.sample(clean, 60) if (g := garbled.garble(t, c)) and garbled.LOST not in g and g != t]
    found = [m.examine(g) for _, g in planted]
    assert len(planted) > 200 and sum(x is not None for x in found) > 0.96 * len(planted)
    assert sum(x is not None and x.restored == t for (t, _), x in zip(planted, found)) > 0.93 * len(planted)


def test_fit_counts_every_record(spark):
    rows = [f"{i % 61}-{t}" for i in range(8) for t in CLEAN] + ["новая опись в архиве " * 1500] + [g for t in CLEAN[:20] if (g := garbled.garble(t, "utf-8>cp437"))]
    rows += [f"{i}号检验报告.pdf" for i in range(max(0, 3500 - len(rows)))]
    df = records(spark, [("name", i, t) for i, t in enumerate(rows * 2)] + [("name", -1, None), ("name", -2, "plain"), ("name", -3, "\ufffd\ufffd")])
    whole, m = garbled.EncodingModel(rows), garbled.fit(df.repartition(7))
    assert len(rows) > 3400 and max(map(len, rows)) > 20_000
    assert np.array_equal(m.ratio, whole.ratio) and np.array_equal(m.clean, whole.clean)
    assert (m.succession.single, m.succession.double, m.succession.total) == (whole.succession.single, whole.succession.double, whole.succession.total)
    assert m.succession.double["новая"[:2]] >= 1500 and m.succession.double["0号"] >= 250


def test_counts_by_brute_force(monkeypatch):
    rng = random.Random(4)
    texts = [t if i % 3 else garbled.garble(t, rng.choice(list(garbled.CHAINS))) or t for i, t in enumerate(rng.sample(CLEAN, 60))] + ["é", "ü" * 50]
    monkeypatch.setattr(garbled, "COUNTED", 50)
    assert np.array_equal(garbled.count_bigrams(texts), np.bincount(garbled.bigrams(texts)[0], minlength=garbled.BUCKETS))
    counts, part = garbled.Counts(), garbled.Counts()
    counts.add_bigrams(texts), counts.add_successions(texts)
    want = {}
    for t in texts:
        for ab in zip(f" {t.lower()} ", f"{t.lower()} "):
            want["".join(ab)] = want.get("".join(ab), 0) + 1
    assert counts.succession(0, 1).double == want and counts.succession(0, 1).total == sum(len(t.lower()) + 2 for t in texts)
    part.add_bigrams(texts[:20]), part.add_successions(texts[:20])
    counts.subtract(part)
    part.add_bigrams(texts[20:]), part.add_successions(texts[20:])
    assert np.array_equal(counts.garbled[0], garbled.count_bigrams([g for t in texts[20:] if (g := garbled.garble(t, "utf-8>latin-1"))])) and part.succession(0, 1).double == want
    assert garbled.count_bigrams([]).sum() == garbled.Counts().succession(0, 1).likelihood("") * 0 == 0


def test_garbled_from_amid_a_word(model):
    t = "новая опись на складе, архивная справка согласно плану"
    bad = t[:17] + garbled.garble(t[17:42], "koi8-r>cp1251") + t[42:]
    assert bad[16].isalpha() and bad[17].isalpha() and model.examine(bad).restored == t


# --- personal information


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("write to jane.doe+x@mail.example soon", {"email"}), ("jane [at] corp [dot] test", {"email"}), ("jаne(at)mail.example", {"email"}), ("发至ｊane＠mail.example。", {"email"}),
        ("tel. +1 202 555 0126", {"phone"}), ("fax 2025550155", {"phone"}), ("手机143-5130-5348", {"phone"}), ("joindre au 01 99 00 83 88", {"phone"}), ("call 020 7946 0123", {"phone"}),
        ("身份证11010519491231002X", {"id_number"}), ("passport no. XK5075438", {"id_number"}), ("NINO QQ 45 51 12 C", {"id_number"}), ("social security number 930-31-7102", {"id_number"}), ("паспорт № ZQ7256771", {"id_number"}),
        ("resident of 24 St. Alder Rd, Ostheide", {"address"}), ("wohnhaft Kirschplatz 21", {"address"}), ("家住苇湾县禾苗路4号", {"address"}), ("Calle del Olivo 47", {"address"}), ("Речной пер., д. 36", {"address"}), ("41, quai aux Herbes", {"address"}),
        ("signed by ANNA FARROWDALE", {"name"}), ("Frau Wiesenthaler, Birgit", {"name"}), ("联系人：杨槿曦；", {"name"}), ("О. Полынин просит копию", {"name"}), ("signé O. Delavigne", {"name"}),
        ("order 8617-3834-31", set()), ("ISBN 979-0-2834-5352-2", set()), ("lot 90001269853", set()), ("size 649117512 bytes", set()), ("ticks=638265821447733142", set()), ("node 10.122.0.47", set()),
        ("@Override Halsalbo", set()), ("logo_corris@2x.png", set()), ("第79号楼消防台账", set()), ("Street Lighting Tender 5", set()), ("room 122, shelf 5", set()), ("", set()),
    ],
)
def test_personal(text, kinds):
    assert {s.kind for s in personal.find(text)} == kinds


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("by Monday Morning", set()), ("to Mount Everest", set()), ("from New Zealand", set()), ("from J. Smith", {"name"}), ("Maria Petrosyan lives here", {"name"}), ("as Anna Oakhurst wrote", {"name"}),
        ("身份证号110105194912310021", set()), ("身份证11010519491231002X2015年3月1日", {"id_number"}), ("手机154 4007 62942018年11月7日", {"phone"}), ("电话:(0300)07886092024年1月10日", {"phone"}),
        ("Ausweisnummer: L06X48Z07", {"id_number"}), ("паспорт № ΧК5390614", {"id_number"}), ("AB123456 (passport)", {"id_number"}), ("AB123456 in stock", set()), ("家住苇湾省青榆市石磬县长汀巷155号", {"address"}),
    ],
)
def test_personal_by_context(text, kinds):
    assert {s.kind for s in personal.find(text)} == kinds


def test_full_names_and_areas():
    assert personal.redact("Name: Nguyen Thi Hoa, address 石磬县长汀巷155号") == "Name: [NAME], address [ADDRESS]"
    assert personal.redact("手机154 4007 62942018年11月7日") == "手机[PHONE]2018年11月7日"


@pytest.mark.parametrize("text", ["县" * 100_000, "县" * 400 + "9", "路1" * 50_000, "a" * 100_000, "жa" * 50_000, "a@" * 50_000, "a." * 50_000, "+1" * 50_000, "é" * 100_000 + "@", "1" * 100_000])
def test_long_texts_take_no_time(text):
    started = time.process_time()
    personal.find(text)
    assert time.process_time() - started < 1.5


def test_many_spans():
    text = "write to a@b.example, call +1 202 555 0126. " * 5000
    assert len(personal.find(text)) == 10_000


def test_checksums():
    assert personal.resident_id("11010519491231002X") and not personal.resident_id("110105194912310021")
    assert personal.luhn("4539578763621486") and not personal.luhn("4539578763621487")
    assert personal.iban("GB82 WEST 1234 5698 7654 32") and not personal.iban("GB82 WEST 1234 5698 7654 33")
    assert personal.insee("255081416802538") and not personal.insee("255081416802539")


def test_redaction(spark):
    assert personal.redact("Signed by Anna Farrow, ａnna@mail.example today") == "Signed by [NAME], [EMAIL] today"
    long = "nothing here. " * 20_000 + "call +1 202 555 0126"
    df = records(spark, [("s", 1, "a@b.example and 家住苇湾县禾苗路4号"), ("s", 1, "a@b.example and 家住苇湾县禾苗路4号"), ("s", 2, None), ("s", 3, ""), ("s", 4, long)])
    got = {r.rec_id: (r.kinds, len(r.redacted)) for r in personal.find_personal(df).collect()}
    assert got == {1: (["address", "email"], len("[EMAIL] and [ADDRESS]")), 4: (["phone"], len(long) - len("+1 202 555 0126") + len("[PHONE]"))}
    assert personal.find_personal(df.limit(0)).count() == 0


@pytest.mark.parametrize("c", "傅洪鲍祁米娄屈萧沙费岑华尤项管明时和")
def test_surnames_behind_a_lead(c):
    assert [x.kind for x in personal.spans(personal.fold(f"联系人：{c}晓槿；")[0])] == ["name"]


@pytest.mark.parametrize("t", ["项目经理", "负责人和经办人", "联系人：项目部经理", "（明细）", "（平方）"])
def test_words_that_begin_like_a_surname(t):
    assert personal.spans(personal.fold(t)[0]) == []


# --- encoding to ids


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    try:
        t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    except Exception:
        pytest.skip("no vocabulary here")
    t.encode_special_tokens = True
    return t


def test_ids(reference):
    e = CorpusEncoder(ByteBpe(f"{TOKENIZERS}/byte_bpe_50k.json"))
    rng = random.Random(4)
    texts = ["", None, "a", "don't we've I'LL ''s '' 's", "<|endoftext|>", "  x\n\n y\t z  ", "因页边无法辨认" * 40, "ab" * 3000, "é½²١１２Ⅳ", "\u0000�😀👩‍🚀", " " * 999]
    texts += ["".join(rng.choices("abc XY12'.,\n\t中文字é😀 ", k=rng.randrange(60))) for _ in range(400)]
    ids, bounds = e.encode(texts)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == (reference.encode(t, add_special_tokens=False).ids if t else []), t


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=20))
def test_ids_any(texts):
    import tokenizers

    e = test_ids_any.__dict__.setdefault("e", CorpusEncoder(ByteBpe(f"{TOKENIZERS}/byte_bpe_50k.json")))
    r = test_ids_any.__dict__.setdefault("r", tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json"))
    r.encode_special_tokens = True
    ids, bounds = e.encode(texts)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == r.encode(t, add_special_tokens=False).ids


def test_ids_memo_reset(reference, monkeypatch):
    monkeypatch.setattr("papersluice.llm.bpe.MEMO_PIECES", 3)
    e = CorpusEncoder(ByteBpe(f"{TOKENIZERS}/byte_bpe_50k.json"))
    for t in ("one two three four", "five six seven", "one two"):
        assert e.encode([t])[0].tolist() == reference.encode(t, add_special_tokens=False).ids


def test_ids_plan(spark, reference):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (None, "a", "x"), (1, "hello world", "x")], "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in encode_corpus(df).collect()), key=str)
    hello = reference.encode("hello world", add_special_tokens=False).ids
    assert got == sorted([(1, hello), (1, hello), (2, []), (3, []), (None, reference.encode("a").ids)], key=str)
    assert encode_corpus(df.limit(0)).count() == 0


# --- leaked passages


def passages(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("bdfgklmnprstv", k=3)) + "".join(rng.choices("aeiou", k=2)) + rng.choice("lnrst") + rng.choice("aeiou")
    out = []
    for i in range(n):
        if i % 3 == 2:
            out.append("".join(f"{rng.choice('古新旧北南')}{rng.choice('塔桥城港')}{word().title()}于{rng.randrange(1000, 2000)}年{rng.choice('修建重建拆除')}{rng.randrange(1000, 99999)}座{rng.choice('灯笼风车石碑')}。" for _ in range(5)))
        else:
            out.append(" ".join(f"The {word()} of {word().title()} carried {rng.randrange(1000, 99999)} crates until {word().title()} measured them." for _ in range(5)))
    return out


def test_leaks(spark):
    rng = random.Random(9)
    items = passages(30)
    filler = ["The report was filed by the office on the same day.", "Only 40 percent of the pages were scanned.", "请注意，附件已归档至登记处。", "About 12 folders of the draft were copied."]
    other = passages(40, seed=77)
    docs, want = [], set()
    for i in range(400):
        body = rng.choices(filler, k=8)
        if i % 8 == 0:
            k = (i // 8) % 30
            sentences = [s for s in items[k].replace("。", "。\n").replace("them. ", "them.\n").split("\n") if s]
            kind = i // 8 % 4
            part = sentences if kind == 0 else sentences[:3] if kind == 1 else sentences[::-1] if kind == 2 else [s.upper().replace(" ", "\n> ") if s.isascii() else s for s in sentences]
            body[4:4] = part
            want.add((k, i))
        elif i % 8 == 1:
            body[2:2] = [other[i % 40]]
        elif i % 8 == 2:
            body[2:2] = ["How many pieces are counted in the passage?", items[i % 30][:4]]
        docs.append((i, "\n".join(body)))
    docs += [(1000, None), (1001, ""), (1002, "x " * 50_000 + items[0]), (0, docs[0][1])]
    want.add((0, 1002))
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    q = spark.createDataFrame([(i, p, None) for i, p in enumerate(items)] + [(900, None, None), (901, "", "x"), (3, items[3], None)], "item_id bigint, passage string, answer string")
    got = [tuple(r) for r in leakage.find_leaks(d, q).collect()]
    exact = {tuple(r) for r in leakage.find_leaks(d, q, cosine=-1).collect()}
    assert len(got) == len(set(got)) and exact == want
    assert len(set(got) & exact) >= 0.9 * len(exact) and set(got) <= exact
    assert leakage.find_leaks(d.limit(0), q).count() == leakage.find_leaks(d, q.limit(0)).count() == 0


def test_leaks_of_a_part_in_many_documents(spark):
    rng = random.Random(5)
    items = passages(30)
    filler = ["The report was filed by the office on the same day.", "Only 40 percent of the pages were scanned.", "About 12 folders of the draft were copied.", "请注意，附件已归档至登记处。"]
    two = lambda p: [s for s in p.replace("。", "。\n").replace("them. ", "them.\n").split("\n") if s][:2]
    body = lambda part: "\n".join(rng.choices(filler, k=4) + part + rng.choices(filler, k=4))
    docs = [(i, body(two(items[0]) if i % 3 == 0 else two(items[2]) if i % 3 == 1 and i < 60 else [])) for i in range(300)]
    want = {(0, i) for i in range(0, 300, 3)} | {(2, i) for i in range(1, 60, 3)}
    q = spark.createDataFrame([(i, p, None) for i, p in enumerate(items)], "item_id bigint, passage string, answer string")
    found = lambda rows: {tuple(r) for r in leakage.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), q, cosine=-1).collect()}
    assert found(docs) == want
    few = docs[:1] + [d for d in docs if d[0] % 3 == 2][:59]  # one such document among few
    assert found(few) == {(0, 0)}


def test_leaks_of_a_passage_of_many_items(spark):
    items = passages(30)
    near = items[0].replace("The ", "A ")
    q = spark.createDataFrame([(i, p, None) for i, p in enumerate(items)] + [(100 + i, items[0] if i % 2 else f"{near} Part {i}.", None) for i in range(15)], "item_id bigint, passage string, answer string")
    docs = spark.createDataFrame([(i, f"The report was filed.\n{items[i]}\nAbout 12 folders were copied." if i < 2 else "The report was filed.") for i in range(60)], "doc_id bigint, text string")
    assert {tuple(r) for r in leakage.find_leaks(docs, q, cosine=-1).collect()} == {(0, 0), (1, 1)} | {(100 + i, 0) for i in range(15)}
    assert leakage.copies([{"a", "b"}, {"a", "b"}, {"c"}, {"a", "b", "d"}, set(), set()]) == [0, 0, 1, 0, 2, 2]


def test_leaks_in_rounds(spark, monkeypatch):
    items = passages(30)
    docs = spark.createDataFrame([(i, f"The report was filed.\n{items[i % 30]}\nAbout 12 folders were copied." if i < 30 else "The report was filed.") for i in range(90)], "doc_id bigint, text string")
    q = spark.createDataFrame([(i, p, None) for i, p in enumerate(items)], "item_id bigint, passage string, answer string")
    monkeypatch.setattr(leakage, "PASSAGES_AT_ONCE", 12)
    monkeypatch.setattr(leakage, "COSINES_AT_ONCE", 256)
    assert {tuple(r) for r in leakage.find_leaks(docs, q).collect()} == {(i, i) for i in range(30)}
    monkeypatch.setattr(leakage, "MOST_ITEMS", 29)
    with pytest.raises(ValueError):
        leakage.find_leaks(docs, q)


@pytest.mark.parametrize("many", [3, 6])
def test_leaks_of_one_passage_in_one_document(spark, many):
    items = passages(21)
    q = spark.createDataFrame([(i, items[max(0, i - many + 1)], None) for i in range(20 + many)], "item_id bigint, passage string, answer string")
    docs = spark.createDataFrame([(i, f"The report was filed.\n{items[0]}\nThe end." if i == 7 else f"The report {i} was filed.") for i in range(120)], "doc_id bigint, text string")
    assert {tuple(r) for r in leakage.find_leaks(docs, q).collect()} == {(i, 7) for i in range(many)}


def test_leaks_lose_no_candidate(spark, data):
    docs, items = (spark.read.parquet(f"{data[: -len('sf0.001')]}sf0.1/{t}.parquet") for t in ("documents", "eval_items"))
    found = lambda cosine: {tuple(r) for r in leakage.find_leaks(docs, items, cosine).collect()}
    assert found(None) == found(-1)


def test_leaks_read_closely_only_where_enough_terms_are(monkeypatch):
    items = passages(30)
    split = [leakage.split_tokens(p) for p in items]
    own = leakage.distinctive(split)
    known = leakage.Passages.of(range(30), split, [None] * 30, own, [{}] * 30)
    texts = [f"The report {i} was filed.\n{items[i % 30] if i % 10 == 0 else items[i % 30][:12]}\nAbout 12 folders were copied." for i in range(400)]
    want = [(i % 30, i) for i in range(0, 400, 10)]
    assert [(i, d) for d, t in enumerate(texts) for i, _ in known.held(t)] == want
    read = []
    tokens = leakage.tokens
    monkeypatch.setattr(leakage, "tokens", lambda t: read.append(t) or tokens(t))
    run = leakage._search(SimpleNamespace(value=(known, np.zeros((30, leakage.RANK), np.float32), None)), -1.0, "bigint")
    got = [r for b in run(iter([pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], names=["doc_id", "text"])])) for r in zip(*b.to_pydict().values())]
    assert got == want and len(read) == len(want)


def test_hashes_of_texts_have_all_tokens():
    rng = random.Random(3)
    pools = ["abcXYZ", "ab \n\r\t>|*•\u2028", "éÅñøßŉİıſﬁΣσςΑά", "ЖйЁа١٢½Ⅷ", "中文国口エー・", "がぱ゙゚ﾊﾞ꥓ꙴ", "\u0323\u0301\u0345", "\u200b\u00ad", "한각가각", "กขิ์", "𝒜𠀀豈", ["x" * 39, "x" * 41, "\n"]]
    texts = ["", "a", "\n"] + ["".join(rng.choice(rng.choice(some)) for _ in range(rng.choice([2, 5, 30, 120]))) for some in (rng.sample(pools, 3) + ["ab\n "] for _ in range(4000))]
    hashes, at, bounds, unsure = leakage.text_hashes(texts)
    there = {*zip((np.searchsorted(bounds, at, "right") - 1).tolist(), hashes.tolist())}
    sure = sorted({*range(len(texts))} - {*unsure.tolist()})
    assert len(sure) > len(texts) / 2
    keys = [(k, w) for k in sure for w in set(leakage.tokens(texts[k])) if len(w) > 1]
    assert [x for x, h in zip(keys, leakage.key_hashes([w for _, w in keys]).tolist()) if (x[0], h) not in there] == []


def test_terms_match_words():
    ids, bounds = terms(chars(["Alpha beta​gamma", "ALPHA betagamma", "中文字", "", None]), 1 << 20)
    a, b, c, d, e = (ids[x:y].tolist() for x, y in zip(bounds, bounds[1:]))
    assert a == b and len(a) == 2 and len(c) == 2 and d == e == []


# --- abuse

GOOD = ["The report was filed on Monday.", "Only 40 percent of the pages were scanned.", "The useless backup was deleted.", "Kill the hanging process and restart.", "请注意，附件已归档。", "An office rule on insults was updated."]
BAD = ["you are a worthless idiot and everybody hates you", "shut up you stupid piece of trash", "你这个蠢货快滚开", "those people are vermin and should be driven out"]


def labelled(n, seed):
    rng = random.Random(seed)
    texts, bad = [], []
    for _ in range(n):
        lines = rng.choices(GOOD, k=5)
        if rng.random() < 0.3:
            lines[rng.randrange(5)] = rng.choice(BAD)
        texts.append("\n".join(lines))
        bad.append(any(x in BAD for x in lines))
    return texts, bad


def test_abuse_model():
    texts, bad = labelled(300, 1)
    noisy = [b if random.Random(i).random() > 0.04 else not b for i, b in enumerate(bad)]
    m = abuse.AbuseModel(texts, noisy)
    held, truth = labelled(200, 2)
    assert ((m.scores(held) > abuse.FLAG_FROM) == np.array(truth)).mean() > 0.97
    disguised = ["y o u are a w0rthl3ss idi​ot and everybοdy hates you", "SHUT UP YOU STUUUUPID PIECE OF TRASH", "你​这​个​蠢​货​快​滚​开"]
    assert (m.scores(disguised) > abuse.FLAG_FROM).all()
    assert (m.scores(["", None, "The report was filed."]) <= abuse.FLAG_FROM).all()
    assert (abuse.AbuseModel(texts, [False] * len(texts)).scores(texts) <= abuse.FLAG_FROM).all() and abuse.AbuseModel([], []).scores([""]).shape == (1,)


def test_abuse_fit_is_not_cut():
    assert abuse.ROUNDS >= 4 and abuse.STEPS >= 40


def test_abuse_plan(spark):
    texts, bad = labelled(300, 3)
    docs = spark.createDataFrame([(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)] + [(900, None, "s0"), (901, "", "s0")], "doc_id bigint, text string, source string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bad) if i % 2] * 2 + [(0, None), (2, 1), (2, 0), (None, 1)], "doc_id bigint, verdict int")
    rows = abuse.score_documents(docs, labels, keep=["source"]).collect()
    assert len(rows) == 302 and sum(r.flagged == bad[r.doc_id] for r in rows if r.doc_id < 900) > 290 and not any(r.flagged for r in rows if r.doc_id >= 900)
    r = {x.source: (x.n_docs, x.n_flagged) for x in abuse.rates(docs, labels).collect()}
    assert sum(n for n, _ in r.values()) == 302 and None in r
    assert abuse.score_documents(docs.limit(0), labels).count() == 0 and abuse.score_documents(docs, labels.limit(0)).where("flagged").count() == 0


# --- queries


def test_registered(spark, data):
    from papersluice.llm.catalog import QUERIES

    columns = {"p1_found": ["field", "id_a", "id_b"], "p3_found": ["field", "rec_id"], "p4_found": ["field", "rec_id", "kind"], "p6_ids": ["doc_id", "ids"], "p7_found": ["item_id", "doc_id"], "p8_found": ["doc_id"]}
    for name, want in columns.items():
        df = QUERIES[name](spark, data)
        assert df.columns == want
        assert df.count() == df.distinct().count() or name == "p6_ids"
    assert text_records(spark, data, "snippet", "name").columns == ["field", "rec_id", "text"]
