"""Language posteriors by naive Bayes over hashed character n-grams, scored in bulk.

The model is trained here: on a few lines of each language below, and on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.runtime import hashed_sample

LANGUAGES = ("en", "de", "fr", "es", "ru", "zh", "ja", "th", "hi", "ar")
#: Buckets of the n-grams, orders of the n-grams, most labelled rows used, and longest text among them.
BUCKETS, ORDERS, SAMPLE, LONGEST = 1 << 15, (1, 2, 3), 4000, 20_000

# Plain sentences that give each language a prior.
SEEDS = {
    "en": "The function returns the number of rows that were kept and closes the file. If the input is empty, nothing is written. This method reads each line, checks the value against the limit and reports an error when it is missing. It was called with a list of names, which is why the order of the result does not matter. Callers should not use it after the end of the run because the handle may have been closed by another thread.",
    "de": "Die Funktion liefert die Anzahl der Zeilen und schließt die Datei. Wenn die Eingabe leer ist, wird nichts geschrieben. Diese Methode liest jede Zeile, prüft den Wert und meldet einen Fehler, falls er fehlt. Danach wird das Ergebnis an den Aufrufer zurückgegeben, weil der Eintrag nicht mehr gebraucht wird. Der Dienst wartet auf die nächste Anfrage und löscht das Verzeichnis erst, wenn alle Blöcke gelesen sind. Es gibt keine Ausgabe ohne Schlüssel.",
    "fr": "La fonction renvoie le nombre de lignes et ferme le fichier. Si l'entrée est vide, rien n'est écrit. Cette méthode lit chaque ligne, vérifie la valeur et signale une erreur lorsqu'elle manque. Ensuite le résultat est rendu à l'appelant, parce que la clé n'est plus utilisée. Le service attend la prochaine demande et supprime le répertoire seulement quand tous les blocs sont lus. Il n'y a pas de sortie sans clé, et les données sont remplacées par celles du module.",
    "es": "La función devuelve el número de filas y cierra el archivo. Si la entrada está vacía, no se escribe nada. Este método lee cada línea, comprueba el valor y avisa de un error cuando falta. Después el resultado se entrega a quien llama, porque la clave ya no se usa. El servicio espera la siguiente petición y borra el directorio solo cuando se han leído todos los bloques. No hay salida sin clave, y los datos se reemplazan por los del módulo.",
    "ru": "Функция возвращает число строк и закрывает файл. Если вход пуст, ничего не записывается. Этот метод читает каждую строку, проверяет значение и сообщает об ошибке, когда его нет. Затем результат передаётся вызывающему, потому что ключ больше не нужен.",
    "zh": "该函数返回行数并关闭文件。如果输入为空，则不写入任何内容。这个方法读取每一行，检查数值，缺失时报告错误。然后把结果交给调用者，因为不再需要这个键。",
    "ja": "この関数は行数を返し、ファイルを閉じます。入力が空の場合は何も書き込みません。このメソッドは各行を読み、値を確認し、ないときはエラーを報告します。その後、結果を呼び出し元に渡します。",
    "th": "ฟังก์ชันนี้คืนจำนวนแถวและปิดไฟล์ ถ้าข้อมูลเข้าว่างจะไม่เขียนอะไร วิธีนี้อ่านแต่ละบรรทัด ตรวจค่า และรายงานข้อผิดพลาดเมื่อไม่มีค่า แล้วส่งผลลัพธ์ให้ผู้เรียก",
    "hi": "यह फ़ंक्शन पंक्तियों की संख्या लौटाता है और फ़ाइल बंद करता है। यदि इनपुट खाली है तो कुछ नहीं लिखा जाता। यह विधि हर पंक्ति पढ़ती है, मान जाँचती है और त्रुटि बताती है।",
    "ar": "تعيد الدالة عدد الأسطر وتغلق الملف. إذا كان الإدخال فارغًا فلا يكتب شيء. تقرأ هذه الطريقة كل سطر وتتحقق من القيمة وتبلغ عن خطأ عند غيابها. ثم تسلم النتيجة إلى المستدعي.",
}
# Other spellings of the labels.
SPELLINGS = {
    "en": "en eng english en-us en-gb en_us en_gb englisch", "de": "de deu ger german deutsch de-de de_de", "fr": "fr fra fre french français francais fr-fr fr_fr", "es": "es spa spanish español espanol es-es es_es castellano",
    "ru": "ru rus russian русский ru-ru ru_ru", "zh": "zh zho chi chinese 中文 zh-cn zh_cn zh-hans cn", "ja": "ja jpn japanese 日本語 ja-jp ja_jp jp", "th": "th tha thai ไทย th-th th_th",
    "hi": "hi hin hindi हिन्दी hi-in hi_in", "ar": "ar ara arabic العربية ar-sa ar_sa",
}
_LABELS = {spelling: language for language, spellings in SPELLINGS.items() for spelling in spellings.split()}
_NOISE = re.compile(r"https?://[!-~]+|`[^`\n]*`|[A-Za-z0-9-]*[_./\\][A-Za-z0-9][A-Za-z0-9_./\\-]*|[A-Za-z]*[0-9]+[A-Za-z0-9]*|[A-Za-z]*[a-z][A-Z][A-Za-z]*|[^\w\s̀-ͯऀ-๿]|_")


def cleaned(text: str | None) -> str:
    """``text`` in lower case without what tells no language: names, paths, numbers, marks."""
    return " ".join(_NOISE.sub(" ", text).lower().split()) if text else ""


def grams(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, in order, and where each text begins."""
    padded = [f" {t} " for t in texts]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    code = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # a gram that reaches into the next text is that text's affair: it is built from blanks on both sides
    one = code * np.uint64(0x9E3779B97F4A7C15)
    # the script of each character counts as a gram of its own; Chinese characters are one script
    block = np.where((code >= 0x3400) & (code < 0xA000), np.uint64(0x4E00 >> 7), code >> np.uint64(7)).astype(np.int64)
    rows = [(block * 2654435761 % BUCKETS).astype(np.int32)]
    rolling = np.zeros(len(code), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        shifted = np.zeros(len(code), np.uint64)
        shifted[order - 1 :] = one[: len(code) - order + 1] if order > 1 else one
        rolling = (rolling * np.uint64(0x100000001B3)) ^ shifted
        if order in ORDERS:
            mixed = rolling + np.uint64(order)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            rows.append((mixed >> np.uint64(49)).astype(np.int32) & (BUCKETS - 1))
    return np.stack(rows, 1), starts


class Model:
    """Log probabilities of the buckets by language."""

    def __init__(self, counts: np.ndarray) -> None:
        smooth = counts + 0.2
        self.logs = np.log(smooth / smooth.sum(0, keepdims=True)).astype(np.float32)

    @staticmethod
    def count(texts: list[str], labels: list[int]) -> np.ndarray:
        counts = np.zeros((BUCKETS, len(LANGUAGES)))
        for k in range(len(LANGUAGES)):
            mine = [t for t, label in zip(texts, labels) if label == k and t]
            if mine:
                rows, _ = grams(mine)
                counts[:, k] += np.bincount(rows.ravel(), minlength=BUCKETS)
        return counts

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log likelihood of each text in each language; empty texts score 0 throughout."""
        out = np.zeros((len(texts), len(LANGUAGES)), np.float32)
        filled = [i for i, t in enumerate(texts) if t]
        if filled:
            rows, starts = grams([texts[i] for i in filled])
            each = self.logs[rows[:, 0]]
            for k in range(1, rows.shape[1]):
                each += self.logs[rows[:, k]]
            out[filled] = np.add.reduceat(each, starts, axis=0)
        return out

    def best(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest language of each text, and its lead over the next in nats per letter."""
        s = self.scores(texts)
        order = np.sort(s, 1)
        sizes = np.fromiter((max(1, len(t)) for t in texts), np.float32, len(texts))
        return s.argmax(1), (order[:, -1] - order[:, -2]) / sizes


def train(labelled: DataFrame | None = None, text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from the seeds and at most ``sample`` rows of ``labelled``, picked by a hash of the row.

    Rows whose label the seeds contradict are left out; null, empty and unknown labels teach nothing.
    """
    texts, labels = [cleaned(SEEDS[k]) for k in LANGUAGES], list(range(len(LANGUAGES)))
    counts = Model.count(texts, labels) * 3
    if labelled is not None:
        rows = hashed_sample(labelled.select(F.col(text_col).alias("t"), F.lower(F.trim(label_col)).alias("l")).where(f"t <> '' and length(t) <= {LONGEST}"), sample, labelled.count())
        known = [(cleaned(r["t"]), LANGUAGES.index(_LABELS[r["l"]])) for r in rows if r["l"] in _LABELS]
        for _ in range(2):
            model = Model(counts)
            if known:
                found, _lead = model.best([t for t, _ in known])
                agreed = [(t, k) for (t, k), f in zip(known, found) if f == k and t]
                counts = Model.count(texts, labels) * 3 + Model.count([t for t, _ in agreed], [k for _, k in agreed])
    return Model(counts)
