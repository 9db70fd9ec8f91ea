"""Problem 8."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptoria.llm.sentences import EventModel, fit, sentences, split_sentences, train, units

CORPUS = [
    "The cache reads a row. It waits for the key. If the key is missing, the step stops. The log says \"Not found.\" and the run goes on. This step reads e.g. a file.\n\n- Without a key, it stops.\n- Set the size to 3.",
    "Der Leser schreibt den Eintrag. Wenn der Dienst fehlt, wird gewartet. Im 3. Lauf dauert es länger. Danach liest der Parser die Tabelle, bevor der nächste Lauf beginnt.",
    "队列先读取目录。然后该模块检查键值。如果缓存不可用，系统会等待。日志显示“目录不存在。”然后继续运行。该模块先读取源文件。",
    "यदि कैश उपलब्ध नहीं है तो रुकें। पार्सर कुंजी बदलता है। संदेश “पूरा हुआ।” तब दिखता है जब कैश रुकता है। यदि सूचक खाली है तो रुकें।",
] * 5
CASES = {
    "Dr. Vandrisk met J. G. Ummerlay at 5 p.m. They left.": ["Dr. Vandrisk met J. G. Ummerlay at 5 p.m.", "They left."],
    "It took 3.5 min. and 4 sec. on v1.2.3, i.e. little. See Fig. 6 for more.": ["It took 3.5 min. and 4 sec. on v1.2.3, i.e. little.", "See Fig. 6 for more."],
    'The log says "Not found." and the run goes on. (It is optional.) Why?! `foo_bar` returns None.': ['The log says "Not found." and the run goes on.', "(It is optional.)", "Why?!", "`foo_bar` returns None."],
    "It accepts .py, .md, etc. The rest\nis wrapped. See https://a.invalid/v2.1/x.html?y=1. Done": ["It accepts .py, .md, etc.", "The rest\nis wrapped.", "See https://a.invalid/v2.1/x.html?y=1.", "Done"],
    "# 9.6 Title. Two\nText one. Text two.\n\n1. First item. Second part.\n2. Next one\n- a\n": ["# 9.6 Title. Two", "Text one.", "Text two.", "1. First item.", "Second part.", "2. Next one", "- a"],
    "```py\nx = 1. \n\ny = 2\n```\nAfter it. Wait ... it goes on.": ["```py\nx = 1. \n\ny = 2\n```", "After it.", "Wait ... it goes on."],
    "Im 16. Lauf dauert das ca. 28 Minuten, z. B. heute. Am 5. Mai geht es, d. h. bald, los usw. Der Rest folgt.": ["Im 16. Lauf dauert das ca. 28 Minuten, z. B. heute.", "Am 5. Mai geht es, d. h. bald, los usw.", "Der Rest folgt."],
    "См. рис. 5 и п. 2, т. е. таблицу и т. д. Если нет, ждём.": ["См. рис. 5 и п. 2, т. е. таблицу и т. д.", "Если нет, ждём."],
    "日志显示“目录不存在。”然后继续运行。队列为什么是空的？从 3.9 版起能读取……": ["日志显示“目录不存在。”然后继续运行。", "队列为什么是空的？", "从 3.9 版起能读取……"],
    "「表が見つかりません。」と表示されます。図 2.1 を参照してください。": ["「表が見つかりません。」と表示されます。", "図 2.1 を参照してください。"],
    "ระบบอ่านแคช ตัวอ่านรองรับไฟล์ a_b.py และตรวจสอบ โมดูลนี้": ["ระบบอ่านแคช", "ตัวอ่านรองรับไฟล์ a_b.py และตรวจสอบ", "โมดูลนี้"],
    "संदेश “पूरा हुआ।” तब दिखता है। यदि कैश खाली है तो रुकें। सीमा 4.6 है।": ["संदेश “पूरा हुआ।” तब दिखता है।", "यदि कैश खाली है तो रुकें।", "सीमा 4.6 है।"],
    "هل الوحدة فارغة؟ الحد هو 3.3 ثانية، أي أقل.": ["هل الوحدة فارغة؟", "الحد هو 3.3 ثانية، أي أقل."],
    "﻿ Le message «\xa0Terminé.\xa0» apparaît. Est-ce vide\xa0? Oui.": ["Le message «\xa0Terminé.\xa0» apparaît.", "Est-ce vide\xa0?", "Oui."],
    "El Sr. Hargwin y la Dra. Teblow leen p. ej. tablas. ¿Está vacío? Sí.": ["El Sr. Hargwin y la Dra. Teblow leen p. ej. tablas.", "¿Está vacío?", "Sí."],
    "Das gilt ab dem\n16. Lauf.\n\n1. Item one in the\n7. run.\n2. Next.": ["Das gilt ab dem\n16. Lauf.", "1. Item one in the\n7. run.", "2. Next."],
    "Il affiche «\xa0Fini.\xa0» Le reste suit. Job starts at 6 a.m. D. L. Ummerlay wrote it.  H. J. Teblow read it.": ["Il affiche «\xa0Fini.\xa0»", "Le reste suit.", "Job starts at 6 a.m.", "D. L. Ummerlay wrote it.", "H. J. Teblow read it."],
    "One.\r\n\r\nTwo wraps\r\nhere. Three.": ["One.", "Two wraps\r\nhere.", "Three."],
}


@pytest.fixture(scope="module")
def model():
    return fit(CORPUS)


@pytest.mark.parametrize("text", CASES)
def test_cases(model, text):
    assert [text[a:b] for a, b in sentences(text, model)] == CASES[text]


HELD_OUT = {
    "He met Sen. Smith today. It stops.": ["He met Sen. Smith today.", "It stops."],
    "See Thm. 4 below. It waits for the key.": ["See Thm. 4 below.", "It waits for the key."],
    "We met Insp. Clouseau there. This step stops.": ["We met Insp. Clouseau there.", "This step stops."],
    "We like Java. It waits.": ["We like Java.", "It waits."],
    "Store the map. It is big.": ["Store the map.", "It is big."],
    "ប្រព័ន្ធអានឯកសារ។ បន្ទាប់មកវាបញ្ឈប់។": ["ប្រព័ន្ធអានឯកសារ។", "បន្ទាប់មកវាបញ្ឈប់។"],
    "ስርዓቱ ፋይሉን ያነባል። ከዚያ ይቆማል።": ["ስርዓቱ ፋይሉን ያነባል።", "ከዚያ ይቆማል።"],
    "ລະບົບອ່ານໄຟລ໌ ແລ້ວມັນຢຸດ": ["ລະບົບອ່ານໄຟລ໌", "ແລ້ວມັນຢຸດ"],
    "缓存读取目录如果队列为空系统会等待": ["缓存读取目录", "如果队列为空系统会等待"],
    "安装说明": ["安装说明"],
}


@pytest.mark.parametrize("text", HELD_OUT)
def test_abbreviations_scripts_and_units_without_marks_that_no_list_holds(text):
    known = fit([*CORPUS, *["缓存读取目录。如果队列为空，系统会等待。模块读取目录。如果键值为空，缓存会等待。"] * 30])
    assert [text[a:b] for a, b in sentences(text, known)] == HELD_OUT[text]


def test_abbreviations_are_learnt_without_lists():
    texts = [f"Row {i} was read by {x} {n} first. It waits for the key, and then it stops." for i, (x, n) in enumerate((x, n) for x in ("Kpt.", "Obf.") for n in ("Wexler", "Brandt", "Ostrow", "Quill", "Tarn", "Hobart", "Lund", "Mirov"))]
    known = fit(texts)
    text = "It was read by Kpt. Zephyr. It stops."
    assert [text[a:b] for a, b in sentences(text, known)] == ["It was read by Kpt. Zephyr.", "It stops."] and known.points["Kpt"][0] > 0.9 > 0.5 > known.points.get("first", (0.0,))[0]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aA .!?\n\r。ก中\"“”()`#-1*﻿\t", max_size=120))
def test_units_cover_the_text(text):
    spans = sentences(text, EventModel())
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    rest = text[1:] if text.startswith("﻿") else text
    assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(rest.split())


def test_long_text_is_linear(model):
    text = "The cache reads a row. " * 60_000
    began = time.time()
    assert len(sentences(text, model)) == 60_000 and time.time() - began < 60
    assert len(list(units("a" * 2_000_000))) == 1


@pytest.mark.parametrize("text", ["。" * 200_000, "?。" * 100_000 + "x", "." * 200_000 + " a", ". " * 100_000, '"' * 200_000, "ก " * 100_000, "!?…" * 60_000, "。" + " " * 200_000, "“a. " * 50_000])
def test_odd_long_texts_are_linear(model, text):
    began = time.time()
    spans = sentences(text, model)
    assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split()) and time.time() - began < 20


def test_operator_cases(spark, model):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "One. Two."), (4, "One. Two."), (None, "Three.")]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, start_char int, lang string")
    got = sorted((r["doc_id"] or 0, r["start_char"], r["end_char"]) for r in split_sentences(df, model).collect())
    assert got == [(0, 0, 6), (4, 0, 4), (4, 0, 4), (4, 5, 9), (4, 5, 9)]
    assert split_sentences(df.limit(0), train(df.limit(0))).count() == 0


def test_model_counts_every_text(spark):
    texts = CORPUS * 200 + ["It ends! Zephyr waits! " * 1000, "It goes on. " + "Quokka" * 30 + " is here. A. B. C. Then it stops.", ""]
    df = spark.createDataFrame([(t, 5) for t in [*texts, None]], "text string, n int")
    one, many, local = train(df.coalesce(1)), train(df.repartition(7)), fit(texts)
    assert one.after["Zephyr"] > 900 and max(map(len, one.after)) <= 64
    for m in (many, local):
        assert vars(m) == vars(one)
