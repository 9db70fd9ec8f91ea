"""Problem 3: defective prompt and response pairs.

One pass over all pairs finds empty, refusing and copying answers, compares the languages of prompt and
response by the posteriors of a character n-gram naive Bayes (``language.py``), and counts after which two tokens
texts end or go on. Truncation is then flagged by the likelihood ratio of an end after the last tokens of an
answer. Tokens are words, or single characters in scripts without blanks, so that the same counts serve every
script. A last word that occurs nowhere else is judged by how often words end after its last characters.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from scriptoria.llm.language import Model, cleaned, train
from scriptoria.llm.phrases import Patterns, alternatives
from scriptoria.llm.tokenizer import TOKENIZERS, VOCABULARY
from scriptoria.runtime import cut_lineage, salted_join, table, widen

#: Least lead of the likeliest language of either text, in nats.
LEAD = 8.0
#: Likelihood ratio of an end below which a text is truncated, weight of the shorter context in counts, and share of the usual
#: rate of ends that words and marks which open something have before any count.
LIKELY_END, PRIOR, OPENER = 0.5, 8.0, 0.05
#: Characters of the word-end model, the rate of ends before any count, its weight in counts, and the likelihood below which a word is cut.
WORD_CHARS, WORD_END, WORD_PRIOR, LIKELY_WORD = 5, 0.2, 0.5, 0.13

_NOT_WORD = re.compile(r"[\W_]+")


def _set(words: str) -> frozenset[str]:
    return frozenset(_NOT_WORD.sub(" ", words).split())


# Words of which a stand-in for an answer consists: what an answer is called, what says that it is absent, words that only
# link these, and verbs that need one of the first kind beside them.
ANSWER_WORDS = _set(
    "summary summaries description descriptions answer answers response responses output result docs doc docstring documentation comment comments content text information info detail details nothing"
    " zusammenfassung beschreibung angabe angaben antwort dokumentation kommentar inhalt informationen résumé réponse commentaire contenu resumen descripción respuesta documentación comentario contenido información"
    " описание описания резюме сводка сводки ответ ответа комментарий комментария документация документации данных информация информации คำอธิบาย ไม่มีคำอธิบาย ไม่มีข้อมูล ไม่มีสรุป विवरण सारांश उत्तर وصف ملخص إجابة"
)
ABSENT_WORDS = _set(
    "no not none null nil nan n na undefined empty blank missing void unknown absent unavailable unspecified pending placeholder dummy stub tbd tba tbc todo fixme xxx wip foo bar lorem ipsum dolor sit amet without follows coming goes"
    " fehlt fehlen kein keine keiner nicht nichts ohne leer folgt folgen unbekannt entfällt aucun aucune pas sans vide néant rien non indisponible manquant manquante suivre inconnu ningún ninguno ninguna sin vacío vacía nada no falta pendiente desconocido"
    " нет без отсутствует отсутствуют пусто пустой недоступно не ไม่มี ว่างเปล่า कोई नहीं खाली रिक्त لا غير فارغ"
)
LINKING_WORDS = _set(
    "a an the of for this that it function functions method s here there yet still so far any at all to by and or on in with below above following sure certainly course ok okay be been being do available applicable found given provided present possible generated produced created"
    " written documented added done follow come soon later go will completed determined defined write add fill say report summarise summarize describe show document progress work under construction dash"
    " vorhanden verfügbar gefunden möglich angegeben noch bisher k siehe oben funktion de la du disponible trouvé trouvée fourni fournie à venir fonction hay función disponible найдено указано उपलब्ध है يوجد متوفر متاح"
)
VERBS = _set("could can is are was were has had")
# The same in scripts without blanks.
STAND_IN_PARTS = re.compile(
    "[该此这]?(?:函数|方法|代码)|摘要|说明|描述|内容|总结|答案|注释|暂无|暂缺|没有|未提供|未找到|不可用|可用|空|无|的|同上|待补充|待定|略|"
    "この|関数|メソッド|要約|説明|概要|回答|内容|コメント|該当|記載|利用|(?:は|が)?(?:ありません|できません|なし|無し|ない)|未定|未対応|未記入|空欄|は|が|の|し"
)
_CANNOT = r"(?:can ?not|can't|could ?not|couldn't|won't|will not|am unable|am not able|'m unable|'m not able|must decline|have to decline|would need|need|don't have|do not have|have no|'d rather not|would rather not|prefer not|am not (?:allowed|permitted)|'m not (?:allowed|permitted)|decline|refuse|am afraid|apologi[sz]e)"
# How an answer declines or only asks for more.
REFUSALS = (
    r"^(?:[\W_]*)(?:(?:(?:i'm|i am|we're|we are|so|very) )*sorry\b[\s,.:;-]*(?:but |for |about |however )?(?:\W*(?:i|we|this|that|as an|there|it)\b.*|$)|i apologi[sz]e\b|my apologies\b|(?:i'm|i am) afraid\b|as an? (?:ai|artificial|large language|language)[\w ,-]*(?:model|assistant)\b|"
    rf"(?:unfortunately|regrettably|sadly)[\s,]+(?:i|we|this|that|it is|it's|there)\b|(?:i|we)(?: | ?'|’)?{_CANNOT}\b|(?:it is|it's|it will be) (?:not possible|impossible) (?:for me|to (?:describe|summari[sz]e|document|answer|say))|(?:summari[sz]ing|describing|documenting|answering)\b.*\b(?:outside (?:of )?what i|beyond what i|not something i)\b|"
    r"(?:the|this|your) request (?:can't|cannot|could not|can not) be (?:completed|fulfilled|processed|answered)|there (?:was|is) (?:nothing|no code|no function|not enough)\b.*\b(?:message|request|prompt|input|context)\b.*|(?:please|kindly|could you|can you|would you)(?: please)? (?:paste|provide|share|send|give|upload|include|supply|show|attach|clarify|tell)\b|"
    r"(?:more|further|additional) (?:context|information|code|details?) (?:is|are|would be) (?:needed|required)|what (?:code|function) (?:would you like|do you want)|without (?:seeing|having) (?:the|more|all)\b.*\bi\b|"
    r"(?:es )?tut mir (?:sehr )?leid|leider (?:kann|darf|bin|habe|ist es mir) ?(?:ich|nicht)?|ich (?:kann|darf|bin nicht in der lage|möchte|habe keinen)\b.*\b(?:nicht|keine?n?)\b|da(?:zu|rüber) (?:darf|kann) ich\b|(?:bitte )?(?:senden|schicken|geben) sie mir\b|als (?:ki|sprachmodell)\b|"
    r"(?:je suis |nous sommes )?(?:désolée?s?|navrée?)\b|je (?:ne |n')(?:peux|suis|puis|dispose|ai|saurais)\b|(?:malheureusement|hélas),? (?:je|il)\b|il m'est impossible\b|veuillez (?:fournir|coller|envoyer|partager)\b|en tant qu(?:'|e )(?:ia|modèle|intelligence)\b|"
    r"lo siento\b|(?:lamentablemente|desafortunadamente|por desgracia),? (?:no|yo)\b|no (?:puedo|me es posible|tengo (?:acceso|suficiente)|estoy en condiciones|soy capaz)\b|(?:me )?disculp[aeo]\b|(?:por favor,? )?(?:pegue|envíe|comparta|proporcione)\b|como (?:ia|modelo|inteligencia)\b|"
    r"(?:извините|простите|прошу прощения|приношу извинения)\b|к сожалению,? я\b|к сожалению\b.*\bне (?:могу|удаётся|удается|получится)\b|я не (?:могу|в состоянии|имею|вправе|смогу)\b|(?:пожалуйста,? )?(?:пришлите|отправьте|вставьте|предоставьте)\b|как (?:языковая модель|ии)\b|"
    r"(?:很|非常)?(?:抱歉|对不起|遗憾)|我(?:无法|不能|没有办法|没法|不便)|作为(?:一个|一名)?(?:ai|人工智能|语言模型)|请(?:提供|粘贴|发送)|申し訳|すみません|恐れ入りますが|残念ながら|[^。\n]*(?:お答え|お手伝い|説明|要約)(?:は|することは)?(?:できません|できかねます|いたしかねます)|(?:コード|関数)を(?:貼り付けて|送って|提供して)|"
    r"ขออภัย|ขอโทษ|ฉันไม่สามารถ|क्षमा करें|माफ़ कीजिए|मैं [^।\n]*नहीं (?:सकता|सकती)|عذرًا|عذرا|آسف|لا أستطيع|لا يمكنني)"
)
_ASKED = r"(?:code|source|sources|source code|source text|function|functions|method|body|context|information|info|details?|snippet|input|file|files|text|material)"
_ANSWERING = r"(?:comply|help|assist|answer|respond|reply|fulfil\w*|proceed|summari[sz]e|describe|explain|document|review|comment|do (?:that|this|so|it)|provide (?:a|an|the|any) (?:summary|description|answer|explanation))"
# A sentence in which the answer itself declines, or asks its reader for more.
DECLINES = (
    r"(?<![\w/])i(?:'m|'d|'ve|'ll)?(?![\w/'.]).*\b(?:not|can't|cannot|won't|don't|couldn't|wouldn't|haven't|unable|decline|refuse|need|require|lack|missing|sorry|afraid|regret|pass on|only|just an?|only an?|apologi[sz]e|clarif\w+)\b|(?:^|[,;:] )my (?:guidelines|instructions|policy|policies|rules|apologies)\b|"
    rf"^(?:\w+ )?(?:unable|cannot|can't|can not|not able|impossible|not possible)(?: to)? {_ANSWERING}\b|^(?:not enough|insufficient|too little|more|additional|further|missing) {_ASKED}(?: (?:is|was|are|were|has been|have been)?\s?(?:provided|given|needed|required|supplied|available))?\W*$|"
    rf"^(?:there (?:is|was|were|isn't|wasn't)|there's|it (?:seems|looks like|appears)|you|your message|the message|your request|the request|the prompt|your prompt)\b.*\b(?:no|not|n't|didn't|hasn't|haven't|missing|without|forgot|empty|nothing)\b.*\b{_ASKED}\b.*\b(?:provided|given|included?|attach\w*|message|request|prompt|pasted?|to (?:summari[sz]e|describe|explain|document)|contain\w*)\b|"
    rf"^(?:it (?:seems|looks like|appears)(?: that)?|you|your (?:message|request|prompt)|the (?:message|request|prompt))\b.*\b(?:no|not|didn't|hasn't|haven't|doesn't|does not|missing|forgot|without|any)\b.*\b{_ASKED}\b|^no {_ASKED} (?:was|were|is|has been|have been|had been)?\s?(?:provided|given|included|attached|pasted|supplied|sent)\b|^the {_ASKED} (?:was|were|is) (?:not|missing)\b.*\b(?:message|request|prompt|provided|included|attached|given)\b|"
    r"^(?:the |this |your )?(?:request|question|model|assistant) (?:was |is |has been |has |had been )?(?:denied|declined|refused|rejected|blocked)(?: to \w+)?\W*$|\b(?:against|violat\w+|breach\w*|outside|prohibited by|not allowed (?:by|under)) (?:\w+ ){0,3}(?:policy|policies|guidelines|terms of)\b|(?:that|this) is(?: not|n't)? something (?:that )?(?:i|we)\b|"
    r"^(?:which|what|where|whose|who|how)\b.*\b(?:you|your)\b.*\?|(?:^|[,.!;:] ?)(?:please|kindly|could you|can you|would you|will you|let me know)(?: please| first| kindly| just)* (?:paste|provide|share|send|give|upload|include|supply|show|attach|clarify|tell|specify|which|what|resend|add the|post)\b|^(?:apologies|forgive me|regretfully|sorry)\b[,.:;—-]|^as an? (?:assistant|ai|chatbot|bot|language model|llm)\b|"
    r"\bich\b.*\b(?:nicht|keine?[nm]?|leider|brauche|benötige|bedaure|ablehnen|nur)\b|^(?:entschuldigung|entschuldigen sie|verzeihung|bedaure|leider)\b[,.:;—-]?.*\b(?:ich|nicht|mir)\b|^(?:bitte )?(?:könnten|können|würden|fügen|senden|schicken|geben|stellen|teilen|laden|nennen) sie\b|^bitte (?:fügen|senden|schicken|geben|stellen|teilen|laden|nennen|den|die|das|um)\b.*\b(?:code|quelltext|datei|funktion|kontext|angaben)\b|^mir (?:fehlen|fehlt|liegen?)\b|"
    r"(?:^|[ ,])(?:je|j')\b.*\b(?:pas|ne|n'|besoin|regrette|désolée?|impossible|refuse|ni)\b|^(?:pouvez|pourriez)-vous\b|^merci de (?:fournir|coller|envoyer|partager|préciser|joindre)\b|^veuillez (?:fournir|coller|envoyer|partager|préciser|joindre|indiquer)\b|"
    r"^(?:lo (?:siento|lamento)|lamento|perdón|disculp\w+)\b|(?:^|[,;] ?)no (?:puedo|tengo|dispongo|podría|es posible que|estoy)\b|^(?:necesito|requiero|me falta\w*)\b|^[¿]?(?:podría|puede|podrías|puedes)s? (?:proporcionar|enviar|compartir|pegar|facilitar|dar|aclarar|indicar)\w*\b|^(?:por favor,? )?(?:proporcione|envíe|comparta|pegue|facilite|aclare|indique)\b|"
    r"(?<!\w)я(?!\w).*(?<!\w)(?:не|лишь|только)(?!\w)|^(?:извините|простите|сожалею|увы)(?!\w)|(?<!\w)(?:мне|нам) (?:нуж(?:ен|н\w+)|необходим\w+|требу\w+|не хватает)|^(?:не )?могли бы вы|^(?:пожалуйста,? )?(?:пришлите|отправьте|вставьте|предоставьте|уточните|укажите|приложите)(?!\w)|"
    r"(?:我|本模型).*(?:无法|不能|没有|没法|不便|不会|需要|拒绝)|^(?:无法|不能)(?:总结|描述|回答|提供|说明|概括|帮助|完成|处理|解释)|^(?:请|麻烦|烦请)(?:您|你)?(?:先)?(?:提供|粘贴|发送|上传|给出|说明|补充|附上)|^(?:能否|可否|可以|是否可以)(?:请)?(?:您|你)?(?:先)?(?:提供|粘贴|发送|上传|给出|补充)|^(?:信息|上下文|代码)不足|"
    r"(?:お答え|お手伝い|説明|要約|回答|お応え|対応|ご案内)[^。]*(?:できません|できかねます|いたしかねます|しかねます|差し控え)|(?:コード|関数|情報|詳細|ソース|内容|文脈)[^。]*(?:ください|お願いします|いただけますか|もらえますか)|^(?:申し訳|すみません|恐れ入り|残念ながら)|"
    r"(?:ฉัน|ผม|ดิฉัน|เรา).*ไม่(?:สามารถ|ได้|มี)|^(?:โปรด|กรุณา|ช่วย)(?:ส่ง|ให้|วาง|ระบุ)|^ไม่สามารถ(?:สรุป|อธิบาย|ช่วย|ตอบ)|^(?:ขออภัย|ขอโทษ)|(?:^| )(?:मैं|मुझे) .*(?:नहीं|चाहिए|आवश्यकता)|^कृपया .*(?:दें|भेजें|साझा|प्रदान)|^(?:क्षमा करें|माफ़|खेद)|"
    r"^(?:عذر\w*|آسف\w*|أعتذر|للأسف)|(?:^|[ ،])(?:لا|لن|لم) (?:أستطيع|يمكنني|أقدر|أتمكن|أملك|أعرف)|^(?:يرجى|من فضلك|هل يمكنك|أحتاج)(?!\w)"
)
# Words after which a text seldom ends; they only set the rate before any count.
DANGLING = frozenset(
    "a an the and or but of to in on at by for from with without into onto than as if because since while when where which who whose that is are was were be been being has have had not its their this these those my your our also so then until unless although though whereas via per"
    " der die das den dem des ein eine einen einem einer und oder aber weil dass wenn als mit von zu zum zur für auf aus bei nach über unter durch ohne bevor sondern sowie im am vom ist sind war wird werden"
    " le la les un une des du de et ou mais parce que qui dont où avec sans pour dans sur sous par vers chez afin si quand lorsque puis est sont au aux ce cette ces"
    " el los las una unos unas del y e o u pero porque cuando donde con sin para por en al sobre bajo entre hacia hasta desde si es son su sus este esta"
    " и или но а что который которая которое которые потому если когда чтобы в во на с со к ко от до из у о об за под над при для без по не это".split()
)
_TRAILING = re.compile(r"(?:以及|并且?|而且|然后|但是?|因为|因此|所以|如果|或者?|和|与|的|在|从|对|把|被|[がのをはにでとも]|ので|また|そして|しかし|ただし|および|และ|หรือ|แต่|เพราะ|ที่|ของ|और|या|लेकिन|क्योंकि|में|पर|से|को|و|أو|لكن|لأن|في|من|على|إلى|التي|الذي)$")
_MARKS = r"[.!?…。！？｡।؟۔॥]"
_CLOSERS = r"[\"'”’»」』)\]）】*_`]"
_END = re.compile(rf"{_MARKS}{_CLOSERS}*$")
_OPEN = re.compile(r"[,;:(\[{\-–—/&+=„«“‘、，；：（「『]$")
#: Where a text may end: after marks, and before an empty line or a list item.
_TEXT_END = re.compile(rf"{_MARKS}+{_CLOSERS}*(?=\s|$)|[。！？｡।॥۔؟]+{_CLOSERS}*|\r?\n[ \t]*(?=\r?\n|[-*+•]\s|\d+[.)]\s)")
#: Characters of scripts without blanks: Thai, Lao, Burmese, Khmer, kana, Chinese characters. Words of other scripts; all else is a mark.
UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-鿿\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"[{UNSPACED}]|`[^`]*`|(?:[^\W{UNSPACED}]|[̀-ͯؐ-ٟऀ-ॣॱ-෿'’])+|[^\s\w]")
_BRACKETS = str.maketrans({"（": "(", "）": ")", "【": "[", "】": "]"})
_LABEL = re.compile(r"^[^:：\n]+[:：]\s*")
_PARAGRAPH = re.compile(r"\r?\n[ \t]*\r?\n")
_TAGS = re.compile(r"</?[a-z]+/?>|(?m:^\s*(?:```|~~~)\w*)|\bhere(?:'s| is)\b")
_REFUSAL = re.compile(REFUSALS)
_DECLINES = Patterns({"refusal": alternatives(DECLINES)})
#: Sentences of an answer in which it may decline: an answer that only begins to and then describes is none.
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？।؟])|\n+")


def _squeezed(text: str) -> str:
    """``text`` in lower case without white space and marks."""
    return _NOT_WORD.sub("", text.lower())


_STAND_INS = ANSWER_WORDS | ABSENT_WORDS | LINKING_WORDS | VERBS
_WORDS = re.compile(r"[^\W_]+")


def _stands_in(low: str, name: str = "") -> bool:
    """Whether a text in lower case only says that there is no answer, or nothing at all; it may say of which function."""
    bare = _TAGS.sub(" ", low) if "<" in low or "`" in low or "~" in low or "here" in low else low
    own = set(_WORDS.findall(name))
    words = set()
    for m in _WORDS.finditer(bare):
        if (w := m[0]) not in _STAND_INS and w not in own and STAND_IN_PARTS.sub("", w):
            return False
        words.add(w)
    named, absent = words & ANSWER_WORDS, words & ABSENT_WORDS
    rest = words - named - absent - LINKING_WORDS
    if named:
        rest -= VERBS
        if absent:
            rest -= own
    return not any(STAND_IN_PARTS.sub("", w) for w in rest)


def _declines(low: str) -> bool:
    """Whether an answer in lower case declines or only asks for more, in either of its first two sentences."""
    return bool(_REFUSAL.match(low)) or any(_DECLINES.first(s.strip()) for s in _SENTENCE.split(low, maxsplit=2)[:2])


def plain_defect(prompt: str, answer: str | None, name: str | None) -> str | None:
    """empty, refusal or copy; else None."""
    text = (answer or "").strip(" \t\r\n\u200b\ufeff\xa0")
    low = text.lower().replace("’", "'")
    got = _squeezed(text)
    label = _squeezed(name) if name else ""
    bare = low[len(name) :] if name and low.startswith(name.lower()) else low
    if _stands_in(low, (name or "").lower()) or bare is not low and _stands_in(bare):
        return "empty"
    whole = _squeezed(prompt)
    if label and got == label and got != whole:
        return "empty"
    if _declines(low):
        return "refusal"
    first = _squeezed(_PARAGRAPH.split(prompt.strip(), maxsplit=1)[0])
    wanted = {x for x in (whole, first) if x}
    forms = {got, got[: len(got) // 2] if got[: len(got) // 2] * 2 == got else got, got.removeprefix(label) if label else got}
    if wanted & forms or (":" in text or "：" in text) and _squeezed(_LABEL.sub("", text)) in wanted:
        return "copy"
    return None


def _kind(token: str) -> str:
    """A token as it is counted: words stand for themselves, numbers, names and code for their kind."""
    if token.isalpha() or len(token) == 1 and not token.isdigit():
        return token
    if token[0] == "`":
        return "<code>"
    if token.isdigit():
        return "<num>"
    return "<name>" if any(c.isdigit() or c == "_" for c in token) else token


def tokens(text: str) -> list[str]:
    """The tokens of a text in lower case; ends within it are full stops."""
    return [_kind(t) for t in _TOKEN.findall(_TEXT_END.sub(" . ", text))]


def _unclosed(text: str) -> bool:
    """Whether a bracket or a span of code stays open."""
    flat = text.translate(_BRACKETS)
    return bool(text.count("`") % 2) or flat.count("(") > flat.count(")") or flat.count("[") > flat.count("]")


def tail(text: str) -> tuple[str, str, bool] | None:
    """The last two tokens of a text and whether they open something by themselves; None if it ends with a mark."""
    if _unclosed(text) and not _END.search(text):
        return "<open>", "<open>", True
    if _END.search(text):
        return None
    found = tokens(text)
    if not found or found[-1] == ".":
        return None
    opens = found[-1] in DANGLING or bool(_OPEN.search(text) or _TRAILING.search(text))
    return found[-2] if len(found) > 1 else ".", found[-1], opens


_OUT = StructType([StructField(n, StringType()) for n in ("id", "defect", "w1", "w2")] + [StructField("opens", BooleanType()), StructField("ends", LongType()), StructField("goes_on", LongType())])
#: Pairs of tokens a task counts before it hands them on.
PAIRS_HELD = 200_000


def _examine(logs):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Model.__new__(Model)
        scorer.logs = logs
        counts: dict[tuple[str, str], list[int]] = {}

        def frame(rows: list) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=_OUT.names).astype({"opens": "boolean", "ends": "Int64", "goes_on": "Int64"})

        def counted() -> pd.DataFrame:
            rows = [(None, None, a, b, None, end, on) for (a, b), (on, end) in counts.items()]
            counts.clear()
            return frame(rows)

        for pdf in batches:
            for at in range(0, len(pdf), 4000):
                part = pdf.iloc[at : at + 4000]
                rows, undecided = [], []
                for key, prompt, answer, name in zip(part["id"], part["prompt"], part["answer"], part["name"]):
                    if answer:
                        low = answer.lower()
                        found = [".", *tokens(low)]
                        for a, b, c in zip(found, found[1:], found[2:]):
                            if b != ".":
                                counts.setdefault((a, b), [0, 0])[c == "."] += 1
                        if found[-1] == "." and (marks := low.count("(") + low.count("[") + low.count("`")):
                            pair = counts.setdefault(("<open>", "<open>"), [0, 0])
                            pair[0] += marks
                            pair[1] += _unclosed(low)
                    defect = plain_defect(prompt, answer, name)
                    if defect:
                        rows.append((key, defect, None, None, None, None, None))
                    else:
                        undecided.append((key, prompt, answer))
                prompts, answers = [cleaned(x[1]) for x in undecided], [cleaned(x[2]) for x in undecided]
                (k, x), (j, y) = scorer.best(prompts), scorer.best(answers)
                for (key, _, answer), p, q, a, b, m, n in zip(undecided, prompts, answers, k, j, x, y):
                    if a != b and m * len(p) >= LEAD and n * len(q) >= LEAD:
                        rows.append((key, "language", None, None, None, None, None))
                    elif last := tail(answer.rstrip().rstrip("*_").rstrip().lower()):
                        rows.append((key, None, *last, None, None))
                yield frame(rows)
            if len(counts) > PAIRS_HELD:
                yield counted()
        yield counted()

    return run


_LETTERS = r"^[\p{L}\p{M}'’]+$"


def _context(word: Column, upto: Column) -> Column:
    """The last letters of ``word`` before ``upto``, with the blank before the word."""
    return F.substring(F.concat(F.lit(" "), F.substring(word, F.lit(1), upto)), F.greatest(F.lit(1), upto + 2 - WORD_CHARS), F.lit(WORD_CHARS))


def vocabulary_words(spark: SparkSession, path: str) -> DataFrame:
    """``(w2, n)``: the whole words of a public vocabulary file, once each; its size bounds their number."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = sorted(x[1:] for x in vocabulary if x[0] == "Ġ" and x[1:].isascii() and x[1:].isalpha() and x[1:].islower() and len(x) > 4)
    return spark.createDataFrame([(w, 1) for w in words], "w2 string, n long")


def cut_words(words: DataFrame, unknown: DataFrame) -> DataFrame:
    """The rows of ``unknown`` (w2) that are cut words, judged by their last letters; ``words`` (w2, n): how often each whole word occurs.

    A context counts how many of its occurrences end a word and how many go on. That other answers end in the same
    unknown word tells nothing: if they are copies, they are one case; if not, a whole word would occur within texts too.
    """
    each = words.where(F.col("w2").rlike(_LETTERS)).select("w2", "n", F.explode(F.sequence(F.lit(1), F.length("w2"))).alias("at"))
    each = each.select(_context(F.col("w2"), F.col("at")).alias("context"), F.when(F.col("at") == F.length("w2"), F.col("n")).otherwise(0).alias("e"), "n")
    seen = each.groupBy("context").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))
    wanted = unknown.where(F.col("w2").rlike(_LETTERS)).select("w2", _context(F.col("w2"), F.length("w2")).alias("context"))
    return wanted.join(seen, "context").where((F.col("e") + WORD_PRIOR * WORD_END) / (F.col("n") + WORD_PRIOR) < LIKELY_WORD).select("w2")


def defects(pairs: DataFrame, model: Model, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """``(id, defect)``: the defective rows of ``pairs`` (id, prompt, answer, name) with their one kind of defect.

    Rows with a null or blank prompt are no pairs. Null answers are empty ones. ``name`` may be null. Repeated rows give
    one result; without rows the result is empty. Texts are processed whole.

    The tail of an answer is its last two tokens. Its likelihood ratio is how much likelier they stand at an end than within a
    text, counted over all answers, other answers with the same tail included, and shrunk to that of the last token, then
    to 1, or far below for words and marks that open something. Without any count for or against, nothing is flagged.
    A last word known nowhere else is judged by its letters against the words of all answers and of the vocabulary file ``path``. Tails are judged once each and joined back by salted keys.
    """
    rows = pairs.select(F.col("id").cast("string").alias("id"), "prompt", "answer", "name").where(F.col("prompt").rlike(r"\S"))
    seen = cut_lineage(rows.mapInPandas(_examine(model.logs), _OUT))
    found = seen.where("defect is not null").select("id", "defect")
    unsure = seen.where("id is not null and defect is null").select("id", "w1", "w2", "opens").distinct()
    tails = unsure.groupBy("w1", "w2").agg((F.count("*") - 1).alias("others"), F.max("opens").alias("opens"))
    counts = cut_lineage(seen.where("id is null").groupBy("w1", "w2").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on")))
    singles = counts.groupBy("w2").agg(F.sum("ends").alias("ends1"), F.sum("goes_on").alias("on1"))
    unspaced = F.col("w2").rlike(f"^[{UNSPACED}]$")
    rates = {r["u"]: (r["e"] + 1.0) / (r["o"] + 12.0) for r in counts.groupBy(unspaced.alias("u")).agg(F.sum("ends").alias("e"), F.sum("goes_on").alias("o")).collect()}
    base = F.when(unspaced, rates.get(True, 0.05)).otherwise(rates.get(False, 0.08))
    known = tails.join(counts, ["w1", "w2"], "left").join(singles, "w2", "left")
    none = F.lit(0)
    base = base / (1 + base)
    start = F.when(F.col("opens"), OPENER * base).otherwise(base)
    one = (F.coalesce("ends1", none) + PRIOR * start) / (F.coalesce("ends1", none) + F.coalesce("on1", none) + PRIOR)
    met = F.coalesce("ends", none) + F.when(F.col("opens"), none).otherwise(F.col("others"))
    two = (met + PRIOR * one) / (met + F.coalesce("goes_on", none) + PRIOR)
    ratio = two / (1 - two) / (base / (1 - base))
    judged = known.select("w1", "w2", F.col("ends1").isNull().alias("unknown"), "opens", (ratio < LIKELY_END).alias("cut"))
    words = singles.select("w2", (F.col("ends1") + F.col("on1")).alias("n"))
    unknown = judged.where("unknown and not opens").select("w1", "w2")
    broken = unknown.join(cut_words(words.unionByName(vocabulary_words(pairs.sparkSession, path)), unknown.select("w2").distinct()), "w2").select("w1", "w2")
    cut = judged.where("cut and (opens or not unknown)").select("w1", "w2").unionByName(broken)
    truncated = salted_join(unsure.select("id", "w1", "w2"), cut, ["w1", "w2"]).select("id", F.lit("truncated").alias("defect"))
    return found.unionByName(truncated).groupBy("id").agg(F.min("defect").alias("defect"))


def _pairs(spark, sf_dir: str) -> DataFrame:
    return widen(table(spark, sf_dir, "symbols").select(F.col("symbol_id").alias("id"), F.col("docstring").alias("prompt"), F.col("summary").alias("answer"), "name"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Symbols whose summary is a defective answer to their docstring, with the kind of defect."""
    model = train(table(spark, sf_dir, "documents"))
    return defects(_pairs(spark, sf_dir), model).select(F.col("id").cast("long").alias("symbol_id"), "defect")


def p3_counts(spark, sf_dir: str) -> DataFrame:
    """Number of defective answers by kind."""
    return p3_found(spark, sf_dir).groupBy("defect").agg(F.count("*").alias("pairs"))
