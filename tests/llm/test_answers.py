"""Problem 3."""

import re

from scriptoria.llm import answers
from scriptoria.llm.answers import cut_words, defects, plain_defect, tail, tokens
from scriptoria.llm.language import LANGUAGES, SEEDS, Model, cleaned, train
from scriptoria.llm.phrases import alternatives

DOC = "Trim the spare rows until the quota is used up.\n\nArgs:\n    row: Upper bound for one pass."
GOOD = "Shortens the spare rows, and returns the number of kept rows"


def run(spark, rows, model=None):
    df = spark.createDataFrame(rows, "id long, prompt string, answer string, name string, defect string, w1 string")
    return {int(r["id"]): r["defect"] for r in defects(df, model or train()).collect()}


def test_kinds(spark):
    common = [(1000 + i, DOC, f"This method shortens part {i}. It reads the configuration first and gives the number of kept rows.", "f", "x", "y") for i in range(40)]
    cases = {
        1: (GOOD, None), 2: (None, "empty"), 3: (" n/a ", "empty"), 4: ("# trim_rows\n", "empty"), 5: ("Keine Zusammenfassung vorhanden.", "empty"),
        6: ("I'm sorry, but I can't help with that.", "refusal"), 7: ("Please paste the code first so that I can summarise it.", "refusal"), 8: ("Lo siento, pero no puedo describir este código.", "refusal"),
        9: (DOC, "copy"), 10: ("TRIM THE SPARE ROWS UNTIL THE QUOTA IS USED UP.", "copy"), 11: ("Docstring: Trim the spare rows until the quota is used up.", "copy"), 12: ("trim_rows: trim the spare rows until the quota is used up", "copy"),
        13: ("Danach schreibt der Leser das Verzeichnis in die Datei. Wenn der Dienst fehlt, wird lange gewartet.", "language"), 14: ("接着队列把源文件写入目录。如果队列不可用，系统会等待。", "language"),
        15: ("Shortens the rows, because", "truncated"), 16: ("Shortens the rows and the configurati", "truncated"), 17: ("Shortens the `spare_", "truncated"), 18: ("Refuses connections that are not able to present a token.", None),
        19: ("Unfortunately named, it only shortens the rows and returns nothing.", None), 20: ("The error text is „den Abschnitt fehlt“, and it shortens the spare rows of the table.", None), 21: ("True if sealed.", None),
    }
    got = run(spark, [(k, DOC, a, "trim_rows", "x", "y") for k, (a, _) in cases.items()] + common)
    assert {k: got.get(k) for k in cases} == {k: d for k, (_, d) in cases.items()}


def test_no_pairs_repeats_and_empty(spark):
    rows = [(1, None, "", "f", None, None), (2, "  \n", "", "f", None, None), (3, DOC, "", None, None, None), (3, DOC, "", None, None, None), (4, DOC, "Shortens rows. " * 50_000, None, None, None)]
    assert run(spark, rows) == {3: "empty"}
    assert run(spark, []) == {}


ANSWERS = {
    "empty": [None, "", "-", "No description provided.", "Sin resumen disponible.", "Aucun résumé disponible.", "暂无摘要", "要約なし", "Нет описания.", "<p></p>", "Summary: N/A", "**None**", "TODO", "Description:"],
    "refusal": [
        "Sorry, but I cannot help.", "I'm not able to describe it.", "I cannot summarize this.", "Could you provide the code?", "Je ne peux pas résumer ce code.", "К сожалению, я не могу описать этот код.",
        "很抱歉，我无法总结这段代码。", "申し訳ありませんが、このコードは要約できません。", "Es tut mir leid, aber das geht nicht.", "No puedo ayudar con eso.",
    ],
    "copy": ["reads the rows of a table", "> Reads the rows\n> of a table.", "Function: Reads the rows of a table.", "Reads the rows of a table. Args: x: y", '"Reads the rows of a table."'],
    None: [
        "Sorry pages are shown to the user.", "I/O errors are raised.", "Declines the request when locked.", "Cannot be called twice.", "Please note: rows are read.", "Empty rows are skipped.", "None of the rows is kept.", "Null rows are dropped.",
        "Nothing is written when empty.", "Reads the rows of a table and keeps them.",
    ],
}


def test_answers_by_rule():
    for defect, answers in ANSWERS.items():
        for answer in answers:
            assert plain_defect("Reads the rows of a table.\n\nArgs:\n  x: y", answer, "read_rows") == defect, answer


def test_plain_rules():
    assert plain_defect("Read it.", "Reads it.", None) is None
    assert tail("a `b") == ("<open>", "<open>", True) and tail("done.") is None and tail("the last word") == ("last", "word", False)
    assert tail("rows of the") == ("of", "the", True) and tail("读取行数") == ("行", "数", False) and tokens("see 12 a_b `x y` (z).") == ["see", "<num>", "<name>", "<code>", "(", "z", ")", "."]


COMPLETE = {
    "zh": "该函数读取所有行并返回行数", "ja": "この関数はすべての行を読み、行数を返す", "th": "ฟังก์ชันนี้อ่านทุกบรรทัดและคืนจำนวนแถว", "ru": "Читает все строки файла и возвращает число прочитанных записей", "de": "Liest alle Zeilen der Datei und liefert die Anzahl der Einträge", "en": "Reads all lines and returns the row count",
}


def test_complete_answers_without_full_stop_in_any_script(spark):
    for copies in (1, 30):
        rows = [(100 * i + n, PROMPTS[k], COMPLETE[k], "f", None, None) for i, k in enumerate(COMPLETE) for n in range(copies)]
        assert run(spark, rows) == {}


PROMPTS = {
    "zh": "读取文件的所有行。如果文件不存在，则报告错误。", "ja": "ファイルのすべての行を読みます。ないときはエラーを報告します。", "th": "อ่านทุกบรรทัดของไฟล์ และรายงานข้อผิดพลาดเมื่อไม่มีไฟล์", "ru": "Чтение всех строк файла с проверкой значений и сообщением об ошибке.",
    "de": "Alle Zeilen der Datei werden gelesen, und ein Fehler wird gemeldet, falls sie fehlt.", "en": "Count the lines of a file and report an error when it is missing.",
}


def test_cut_answers_in_any_script(spark):
    ends = {"zh": ("该函数读取数据表并返回行数。", "该函数读取数据表并返"), "ru": ("Читает таблицу и возвращает число записей.", "Читает таблицу и возвращает чис")}
    for k, (whole, part) in ends.items():
        rows = [(i, PROMPTS[k], whole, "f", None, None) for i in range(40)] + [(99, PROMPTS[k], part, "f", None, None)]
        assert run(spark, rows) == {99: "truncated"}


def test_long_stand_ins_and_further_kinds():
    for answer in ("-" * 500, "No summary available. " * 30, "N/A\n" * 200, "There is no description of this function available yet; it will be added later. " * 8, "कोई विवरण नहीं", "ไม่มีคำอธิบาย", "该函数没有摘要", "Summary of the function:", "Résumé indisponible."):
        assert plain_defect(DOC, answer, "trim_rows") == "empty", answer
    for answer in ("Which function do you mean?", "It looks like you did not include any code.", "Unable to comply.", "That is something I can't do.", "Könnten Sie den Code senden?", "Pouvez-vous fournir le code ?", "Necesito más contexto.", "Мне нужен исходный код.", "无法总结这段代码。", "コードを提供してください。"):
        assert plain_defect(DOC, answer, "trim_rows") == "refusal", answer
    for answer in ("Could be null.", "No rows are kept.", "Is empty when done.", "I/O helper.", "Request denied errors are retried.", "Counts the rows."):
        assert plain_defect(DOC, answer, "rows") is None, answer


def test_cut_words(spark):
    words = spark.createDataFrame([("configuration", 40), ("rows", 10), ("строка", 5)], "w2 string, n long")
    unknown = spark.createDataFrame([("configurati",), ("Quokka",), ("строк",), ("12",)], "w2 string")
    assert {r["w2"] for r in cut_words(words, unknown).collect()} == {"configurati", "строк"}


def test_languages_on_held_out_sentences(spark):
    model = train()
    held = {
        "en": "The cache is rebuilt when the table changes.", "de": "Der Zwischenspeicher wird nach jeder Änderung neu gebaut.", "fr": "Le cache est reconstruit quand la table change.", "es": "La caché se reconstruye cuando cambia la tabla.",
        "ru": "Кэш строится заново после изменения таблицы.", "zh": "表改变时会重建缓存。", "ja": "表が変わるとキャッシュを作り直します。", "th": "เมื่อตารางเปลี่ยนระบบจะสร้างแคชใหม่", "hi": "तालिका बदलने पर कैश फिर से बनता है।", "ar": "يعاد بناء الذاكرة عند تغير الجدول.",
    }
    best, _ = model.best([cleaned(t) for t in held.values()])
    assert [LANGUAGES[i] for i in best] == list(held)
    wrong = spark.createDataFrame([(SEEDS["en"], "german"), ("", "en"), (None, None)], "text string, lang string")
    assert isinstance(train(wrong), Model)


def test_patterns_that_wait_for_their_literals_find_the_same():
    assert "|".join(alternatives(answers.DECLINES)) == answers.DECLINES and alternatives(r"a(b|c)|[|]d\||e") == ["a(b|c)", r"[|]d\|", "e"]
    whole = re.compile(answers.DECLINES)
    for text in [a for group in ANSWERS.values() for a in group if a] + ["Which function do you mean?", "Unable to comply.", "Rows are read. Please send the code.", "необходим код", "我无法总结", "I need the file.", "It reads I/O rows."]:
        assert bool(answers._DECLINES.first(text.lower())) == bool(whole.search(text.lower())), text
