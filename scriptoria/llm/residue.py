"""Problem 1: template residue, filler, error pages and script notices in manual sections.

Lines are cut and masked once, and from there on keyed by hashes. Distinct lines are mined into message templates
(``templates.py``). Each template is classified once, by a naive Bayes classifier over its words, pairs of words and shape, and
the verdict is propagated to its lines and their sections. The classifier is trained here, on the given lines below and on a
bounded sample of the corpus that patterns of well-known messages label; a line that such a pattern knows is judged by it alone, whatever its template.
Unfilled slots sit inside otherwise ordinary lines and are detected apart, on text without code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.phrases import Classifier, Patterns
from scriptoria.llm.templates import judged_lines
from scriptoria.runtime import cut_lineage, first_delivery, salted_join, table

#: Most lines of the corpus that the classifier is trained on, and the least log odds of a verdict.
SAMPLE, LEAST_ODDS = 4000, 15.0

# The vocabulary of residue, by kind.
STATUS = (
    "bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|request time-?out|conflict|gone|too many requests|"
    "internal server error|not implemented|bad gateway|service unavailable|gateway time-?out"
)
SCRIPTS = r"(?:<script>|java ?scripts?|js|ecmascript|(?:client-side )?scripts?|(?:client-side )?scripting)"
ENABLE = r"(?:<enable>|enable|activate|turn on|allow|switch on|permit)"
OFF = r"(?:<off>|disabled|turned off|switched off|not supported|blocked|deactivated|not enabled|off)"
PAGE = r"(?:page|document|site|website|web site|viewer|app|application|content|view|resource|file|section|form|portal)"
VERB = r"(?:describe|explain|fill in|fill out|complete|replace|write|add|insert|summari[sz]e|document|edit|enter|put|update|outline|provide|list|state|mention)"
MARK = r"(?:todo|to do|to-do|fixme|xxx|wip|tbd|hint|tip|author's note|note to (?:the )?author|editor's note|note to self|reminder)"
TARGET = r"(?:this|the|what|how|why|who|which|your|in|a|an|one|two|here|more|some|when|where)\b"

FILLER = [
    r"^this (?:section|page|part|chapter) is (?:still |currently )?(?:under construction|empty|being written|a stub|a placeholder)\b|^(?:content|text|description|documentation|details) (?:is |are )?(?:coming soon|to (?:be (?:added|written|done)|follow|come))\b",
    r"^(?:insert|add|put|enter) (?:your |some |the |a (?:short |brief )?)?(?:text|description|content|summary|introduction)(?: here)?[.!]?$|^placeholder[.!]?$|^(?:example|sample|dummy|placeholder) (?:description|summary|section|title|heading)[.!]?$",
    r"\b(?:lorem ipsum|dolor sit amet|consectetur adipiscing|eiusmod tempor|incididunt ut|magna aliqua)\b(?!.*\b(?:fixture|generator|paragraphs into)\b)",
    r"^(?:sample|dummy|your|example|placeholder|filler|some|more|body|default|test) (?:text|copy|content|paragraph)(?: (?:here|goes here|to follow))?[.!]?$",
    r"\b(?:text|copy|content|description|paragraph|sentence|summary|introduction)s?(?: about the \S+| about \S+| \S+)? (?:goes|go|comes|will go) here\b",
    r"^sample <?[\w*]+>?[.!]?$",
    r"^(?:blindtext|mustertext|platzhalter(?:text)?|beispieltext)\b.*$",
    r"^(?:hier (?:steht|kommt) (?:später|noch|bald) .*|(?:beschreibung|text|inhalt) folgt(?: (?:später|noch|bald))?|(?:muss )?noch (?:auszufüllen|ergänzen))[.!]?$",
    r"^(?:texto de (?:ejemplo|relleno|muestra)|texte? (?:d'exemple|factice|de remplissage)|(?:por|a) (?:completar|rellenar)|(?:à|a) (?:compléter|remplir)|пример текста|текст[- ]рыба|示例文本|占位文本|サンプルテキスト)[.!]?$",
    r"^click here to (?:edit|add|change)\b.*$",
    r"^\(?(?:tbd|tba|tbc|to be (?:completed|determined|defined|written|done|announced|added|filled in|confirmed)|coming soon|more (?:to come|soon)|work in progress|under construction)\)?[.!…]*$",
    r"^(?:placeholder|temporary|interim|provisional|preliminary|dummy|filler) (?:copy|text|wording|content)\b.*\b(?:follow|come|replaced?|later|final)\b",
    r"^this is an? (?:filler|dummy|stand-in|sample|placeholder|example) (?:paragraph|text|section|sentence|block)\b.*\bused to\b",
    r"^the quick \S+ (?:\S+ )?jumps over the lazy \S+$",
    r"^(?:(?:foo|bar|baz|qux|blah|bla|asdf|qwer|qwert|qwerty|hjkl|jkl|sdfg|zxcv|yxcv|aaaa+|xxx+|test|uiop)[ .,]*){3,}$",
    r"^(?:<num> ?){2,}$|^(?:foo|blah|asdf|qwer|hjkl|xxxx?)(?: \S+)?$",
]
HINT = [
    rf"^\W*{VERB} an? (?:short|brief|concise|one-line) (?:summary|description|introduction|overview|text)\b.*\bhere[.!]?$",
    rf"^\W*{MARK}\b[\s:.\-–—]*{VERB}(?!\w).*$",
    rf"^\W*{VERB} (?:in \S+ (?:sentences?|words?|lines?) )?(?:this section|the text(?: here| below)?|the paragraph below|this (?:text|paragraph|part|line|page|template|block)|what your \S+ does|how (?:users|people|you|to) \S+ (?:it|this|your \S+)|your own|your (?:text|project|tool|description|product)|the \S+ part|why your)\b.*$",
    rf"^\W*{MARK}\W*$",
    r"(?:^|[\W_])replace this (?:text|line|paragraph|section|block)\b|\bdelete this (?:line|note|hint|paragraph|section) (?:before|when|once|after)\b|\bthen delete this line\b",
    r"^one (?:paragraph|sentence|line) about\b.*\bhere[.!]?$",
    r"^[\"'_*]*(?:your|a short) (?:description|introduction|summary|text) (?:here|goes here)\b",
]
ERROR = [
    r"^http(?:/<num>)?[\s:#]*<num>[\s:\-–—.]+(?!.*\b(?:is|are|means?|was|were|will|returned|sent|when|if|for|on|and|then|to|requests?|responses?|codes?)\b)[\w' ]+[.!]?$",
    r"\bwe(?:'ll| will) be right back\b|^error (?:establishing|connecting to|loading)\b|^(?:sorry,? )?(?:an?|some) (?:\w+ )?(?:error|problem) (?:has |have )?occurred\b",
    rf"^(?:sorry,? )?(?:but )?(?:this|the) {PAGE} (?:isn't|is not|is no longer|is currently not) (?:available|found|here)\b|^(?:the )?(?:service|server|site|page) (?:is )?(?:temporarily |currently )unavailable\b",
    r"^<num> (?:page|file|document) not found\b|\brequested url\b.*\b(?:not found|does not exist)\b|^verifying you are (?:a )?human\b|^loading\b[,.… ]*(?:please wait)?[.… ]*$",
    r"^segmentation fault\b|\(core dumped\)|\bnomethoderror\b|^undefined (?:method|index|variable|offset)\b",
    rf"^[#=\-*\s]*(?:http(?:/<num>)?\b|error\b|status\b|code\b|fehler\b|erreur\b)?[\s:#\-–—]*(?:<num>)?[\s:\-–—]*(?:{STATUS})[.!]*$",
    rf"^[#\s]*(?:http|error|status)\s*<num>\b[\s:\-–—.]*(?:{STATUS})?[.!]*$",
    r"^\{\s*\"(?:error|errors|status|code|message|detail)\"\s*:.*$",
    rf"<(?:title|h1|h<num>)>[^<]*(?:<num>|{STATUS})",
    r"^(?:request|correlation|trace|incident|error|support) (?:id|no|number|code)\b[:#\s]*\S*$|^(?:incident|reference|ray id)\b[\s:#]+\S+$",
    r"\bsomething went (?:wrong|terribly wrong)\b|^(?:an?|oops|sorry)?[\W\s]*(?:unexpected|unknown|internal) (?:error|problem) (?:has )?occurred\b",
    rf"^(?:the |this |sorry,? ?(?:the |this )?)?(?:requested )?{PAGE} (?:you (?:are looking for|requested|tried to \S+|want(?:ed)?(?: to \S+)?|asked for|were looking for) )?(?:does not exist|doesn't exist|no longer exists|might have been|may have been|has been (?:moved|removed|deleted)|is temporarily unavailable|is (?:currently )?(?:unavailable|not available)|could not be (?:found|loaded|displayed)|cannot be (?:found|displayed|loaded)|was not found|not found)\b",
    r"^the \S+ you (?:are looking for|requested|tried to \S+)\b.*$",
    r"^(?:page|file|document|site) (?:not found|unavailable|introuvable)[.!]?$",
    r"^access (?:to this \S+ (?:is|was) )?(?:denied|forbidden|refused)[.!]?$",
    r"\byou (?:do not|don't) have (?:the )?(?:permission|rights?|access)\b|^ask an? administrator\b|\bnot authori[sz]ed to (?:view|access|see)\b",
    r"\byour session (?:has )?(?:expired|ended|timed out)\b|^(?:please )?(?:sign|log) in (?:again )?to (?:continue|view|see)\b|^please (?:sign|log) in again\b|^reload to continue\b",
    r"\bsite can(?:'t|not| not) be reached\b|\btook too long to (?:answer|respond|reply)\b|\bupstream connect error\b|\bdisconnect(?:/reset)? before headers\b|\bconnection (?:refused|reset by peer|timed out)[.!]?$",
    r"^(?:we are |the site is |site )?(?:currently )?down for (?:\S+ ){0,2}maintenance\b|\bwe(?:'ll| will) be back (?:soon|shortly|at|in)\b",
    r"^checking your browser\b|^please (?:try|come) (?:again|back) (?:in a few|later|soon)\b|^(?:our|the) team (?:was|has been) notified\b",
    r"^traceback \(most recent call last\):?|^exception in thread\b|^\s*at [\w.$]+\([\w.]*(?::<?\w+>?)?\)$|^(?:unhandled|uncaught|fatal) (?:exception|error)\b|^(?:key|value|type|index|name|attribute|runtime|import)error: ",
    r"^(?:die|diese) (?:angeforderte |gesuchte )?seite (?:wurde|konnte|ist|existiert)\b|^zugriff verweigert\b|^es ist ein (?:\S+ )?fehler aufgetreten\b|^(?:la )?page (?:demandée )?(?:est )?introuvable\b|^(?:nous sommes désolés|désolé)\b.*\berreur\b|^une erreur (?:\S+ )?est survenue\b|^v[ée]rifiez l'adresse\b|^lo sentimos\b|^p[áa]gina no encontrada\b|^se ha producido un error\b|^acceso denegado\b|^accès refusé\b|^ошибка <num>\b|^страница не найдена\b|^页面(?:未找到|不存在)|^ページが見つかりません",
]
NOTICE = [
    rf"^{SCRIPTS} (?:must|needs? to|has to|have to) be (?:enabled|activated|turned on|allowed)\b|^{SCRIPTS} (?:is|are) (?:required|needed)\b|^you need {SCRIPTS} (?:to|enabled)\b",
    rf"\b(?:enable|activate|allow|turn on) cookies and {SCRIPTS}(?!\w)|^(?:this|the|our) {PAGE}s? (?:requires?|needs?) {SCRIPTS} (?:to be|enabled|support)\b",
    rf"\b(?:benötigt|braucht|erfordert) (?:aktiviertes )?{SCRIPTS}(?!\w)|\b(?:nécessite|requiert) (?:l'activation de )?{SCRIPTS}(?!\w)|\b(?:requiere|necesita) {SCRIPTS}(?!\w)",
    rf"^(?:please |kindly |you (?:must|need to|have to|should) |to \S+ .{{0,40}}, (?:please )?){ENABLE} {SCRIPTS}(?!\w)",
    rf"^{ENABLE} {SCRIPTS}(?! in the \S+ if you want).*\b(?:to (?:view|see|continue|use|run|load|read|display)|in your browser|and reload)\b(?! the call graph)",
    rf"^(?:this |the |our )?{PAGE}s? (?:requires?|needs?|depends? on|only works? with|relies on|does not work without|doesn't work without|will not work without) (?:an? )?(?:active )?(?:{SCRIPTS}|script engine)[.!]?$",
    rf"(?<!\w){SCRIPTS} (?:is|are|seems? to be|appears? to be|has been) (?:currently )?{OFF}(?!\w).*\b(?:browser|so)\b",
    rf"\byour browser (?:does not|doesn't|has no|cannot) (?:support|run|allow)\b.*\b{SCRIPTS}|\byour browser does not support\b.*\bswitched off\b",
    rf"\b(?:doesn't|does not|won't|will not|cannot) (?:work|run|function)(?: properly| correctly)? without {SCRIPTS}",
    rf"<noscript\b|{SCRIPTS} and cookies must be\b|\bcookies and {SCRIPTS} must be\b|^turn it on and reload\b|^check your browser settings\b",
    rf"\bbitte (?:aktivieren|schalten) sie (?:{SCRIPTS}|skripte)(?!\w)|\bveuillez (?:activer|autoriser) (?:les )?{SCRIPTS}(?!\w)|\b(?:active|habilite) (?:los )?{SCRIPTS} en su navegador\b|\bвключите (?:{SCRIPTS}|скрипты)|请启用|有効にしてください",
]
KINDS = {"filler": FILLER, "hint": HINT, "error": ERROR, "notice": NOTICE}

# The shapes of an unfilled slot outside code.
SLOTS = [
    r"\{\{\s*[A-Za-z_][\w. -]*\s*\}\}",
    r"\{%\s*[A-Za-z_][\w. -]*\s*%\}",
    r"<%=?\s*[A-Za-z_][\w. -]*\s*%>",
    r"[$#]\{\s*[A-Za-z_][\w.]*\s*\}",
    r"(?<![\w$])\$[A-Za-z][A-Za-z_]*\$(?![\w$])",
    r"(?<![\w%])%[A-Za-z][A-Za-z_]*%(?![\w%])",
    r"(?<!\w)__[A-Z][A-Z_]*[A-Z]__(?!\w)",
    r"@@?[A-Z][A-Z_]*@@",
    r"(?<![\w{])\{[a-z]\w*\.[a-z]\w*\}(?![\w}])",
    r"\(\([a-z]\w*(?:-\w+)+\)\)",
    r"\[\[[A-Z][A-Z_]*\]\]",
    r"\[(?:your|insert|enter|add|describe|project|name of|step|put|replace|fill in|tbd|todo)\b[^\]\n]*\](?!\()",
    r"(?i:\[(?:insert|step (?:one|two|three|four|\d+)|your)\b[^\]\n]*\])",
    r"\[[A-Z][A-Z]+(?:[ _-][A-Z]+)*\](?!\()",
    r"<(?:your|insert|enter|INSERT|YOUR|ENTER|add|describe)\b[^<>\n]*>",
    r"«[^»\n]+»-[A-Z]+|<[A-Z]{3,}(?:[ _-][A-Z]+)+>",
    r"<!--\s*(?:[\w ]+ text|insert|todo|your|replace|add|describe|fill)\b[^\n]*?-->",
    r"(?<![\w-])X{4,}(?![\w-])|(?<!\w)_{4,}(?!\w)",
]


# Lines of each kind, and sound lines that speak of the same things, in the form that ``masked`` gives them.
LINES = {
    "filler": """Placeholder text.|This is placeholder text.|This text is a placeholder.|This is sample text for the page.|Dummy text to be replaced later.|Text goes here.|Your text here.|The description goes here.|Content will be added soon.|This section is empty.|This section has not been written yet.
Nothing here yet.|To be written.|Details to follow.|Documentation coming soon.|This page is under construction.|Dies ist ein Platzhalter.|Dieser Text ist ein Platzhalter.|Hier steht später der Text.|Beschreibung folgt in Kürze.|Inhalt folgt.|Dieser Abschnitt ist noch leer.|Noch nicht beschrieben.|Ceci est un texte de remplissage.
Ce texte est un exemple.|Texte à compléter.|Contenu à venir.|Cette section est vide.|Este es un texto de ejemplo.|Este texto es un marcador de posición.|Texto por completar.|Contenido próximamente.|Esta sección está vacía.|Questo è un testo segnaposto.|Questo testo è un segnaposto.|Testo di esempio.|Contenuto in arrivo.|Questa sezione è vuota.
Este é um texto de exemplo.|Texto provisório.|Conteúdo em breve.|Esta seção está vazia.|To jest tekst zastępczy.|Treść wkrótce.|Dit is een voorbeeldtekst.|Deze tekst is een plaatshouder.|Inhoud volgt.|Это пример текста.|Здесь будет текст.|Описание появится позже.|Раздел пока пуст.|这是占位文本。|此处填写内容。|内容待补充。|ここに本文が入ります。|これはサンプルテキストです。|準備中です。""",
    "hint": """Describe your project here.|Write your description here.|Write an overview of your tool in this box.|Please write something about your tool in this field.|Write something useful in this space.|Add your own text in this spot.|Put your summary in this spot.|Type your overview here.|Fill in this section.|Please fill in the overview in this box.
Replace this text with your own.|Replace this sentence before you publish.|Enter a short introduction in this field.|Explain in a few words what your tool does.|Say here what the tool is for.|Tell the reader how to start it here.|Remember to remove this note.|Delete this hint when you are done.|Bitte hier eine Beschreibung eintragen.|Bitte hier den Text ergänzen.|Hier die Übersicht ergänzen.|Bitte diesen Abschnitt ausfüllen.
Hier beschreiben, was das Werkzeug tut.|Diesen Text ersetzen.|Beschreiben Sie hier Ihr Projekt.|Décrivez ici votre projet.|Veuillez compléter cette section.|Remplacez ce texte.|Saisissez votre texte ici.|Describa aquí su proyecto.|Complete esta sección.|Reemplace este texto.|Escriba aquí su texto.|Descrivi qui il tuo progetto.|Inserire qui il testo.|Sostituisci questo testo.|Descreva aqui o seu projeto.|Insira o texto aqui.|Substitua este texto.
Opisz tutaj swój projekt.|Wpisz tutaj tekst.|Beschrijf hier je project.|Vervang deze tekst.|Опишите здесь ваш проект.|Введите текст здесь.|Замените этот текст.|请在此处填写说明。|请替换此文本。|ここに説明を書いてください。|この文章を置き換えてください。""",
    "error": """Page not found.|The page you requested was not found.|The page does not exist.|HTTP <num>|HTTP <num> error|Error <num>|HTTP error <num>|Status <num>|HTTP <num> Unknown error|Something broke on our side.|Oops, that did not work.|We could not load this page.|The server did not respond.|The server returned an error.|Please try again later.|Try reloading the page.|An error occurred while loading the page.
Your session is no longer valid.|Sign in again to view this page.|You are not allowed to see this page.|This page could not be displayed.|The request timed out.|The service is down.|Die Seite wurde nicht gefunden.|Seite nicht gefunden.|Diese Seite existiert nicht.|Es ist ein Fehler aufgetreten.|Bitte versuchen Sie es später erneut.|Zugriff verweigert.|Page introuvable.|Cette page n'existe pas.|Une erreur est survenue.|Veuillez réessayer plus tard.|Accès refusé.
Página no encontrada.|Esta página no existe.|Se ha producido un error.|Inténtelo de nuevo más tarde.|Acceso denegado.|Pagina non trovata.|Questa pagina non esiste.|Si è verificato un errore.|Riprova più tardi.|Accesso negato.|Página não encontrada.|Esta página não existe.|Ocorreu um erro.|Tente novamente mais tarde.|Acesso negado.|Strona nie istnieje.|Nie znaleziono strony.|Wystąpił błąd.|Odmowa dostępu.|Pagina niet gevonden.|Deze pagina bestaat niet.|Er is een fout opgetreden.|Toegang geweigerd.
Страница не найдена.|Такой страницы не существует.|Произошла ошибка.|Повторите попытку позже.|Доступ запрещён.|页面未找到。|页面不存在。|发生错误。|请稍后再试。|拒绝访问。|ページが見つかりません。|エラーが発生しました。|後でもう一度お試しください。|アクセスが拒否されました。""",
    "notice": """<enable> <script> to continue.|Please <enable> <script> to view this page.|This site needs <script>.|This page only works with <script>.|<script> is <off>.|Your browser does not support <script>.|You have <script> <off>.|The page cannot be shown without <script>.|Bitte <enable> Sie <script>.|Bitte aktivieren Sie <script>, um die Seite zu sehen.|Diese Seite braucht <script>.|<script> ist deaktiviert.|Veuillez activer <script>.|Cette page nécessite <script>.|<script> est désactivé.
Active <script> para ver esta página.|Esta página requiere <script>.|<script> está desactivado.|Attiva <script> per continuare.|Questa pagina richiede <script>.|Ative o <script> para continuar.|Esta página requer <script>.|Włącz <script>, aby kontynuować.|Ta strona wymaga <script>.|Schakel <script> in.|Deze pagina vereist <script>.|Включите <script>.|Для просмотра нужен <script>.|请启用 <script>。|此页面需要 <script>。|<script> を有効にしてください。|このページには <script> が必要です。""",
    None: """Describe each row with a schema file.|Write access is denied by default.|Write the output to a file.|Write your own plugins in the folder plugins.|Enter the name of the file.|Add a row with the add command.|Add your key to the settings.|Put the file in this folder.|Put your settings in this file.|Please report problems to the maintainers.|Please run the tests first.|Fill the cache before the first run.|Replace the battery once a year.|Replace the key in this file.|Type the name of the tool and press enter.
The tool writes a placeholder into empty cells.|Empty sections are skipped.|The text is read from a file.|This text is shown when the cache is empty.|Sample rate is <num> kHz.|The page shows an error when the key is missing.|The server answers <num> when the id is unknown.|HTTP requests are retried.|HTTP <num> is returned for unknown ids.|A status of <num> means that the row is missing.|Errors are written to the log.|An error is raised when the file is missing.|If the page is not found, the tool stops.|Pages that were not found are listed.
Try the command again with another key.|Sign in with your token.|The session ends after <num> minutes.|Access is logged.|<script> files are scanned as well.|The viewer is written in <script>.|<enable> <script> in the viewer if you want to pan.|<script> in this folder need Python <num>.|Run the <script> in this folder.|Diese Seite beschreibt das Werkzeug.|Die Datei wird nicht gefunden, wenn der Pfad falsch ist.|Der Text wird ersetzt.|Hier liegt die Datei.|Der Fehler wird gemeldet.|Cette page décrit l'outil.|Le texte est lu dans un fichier.|Ici se trouve le fichier.
Si le fichier est introuvable, une erreur est signalée.|Esta página describe la herramienta.|El texto se lee de un archivo.|Si falta el archivo, se avisa de un error.|Questa pagina descrive lo strumento.|Il testo viene letto da un file.|Esta página descreve a ferramenta.|Ta strona opisuje narzędzie.|Deze pagina beschrijft het programma.|Эта страница описывает программу.|Если файл не найден, выводится ошибка.|此页面介绍该工具。|找不到文件时报告错误。|このページはツールを説明します。|ファイルがないときはエラーになります。
Run the tool with a path.|Install it with pip.|Open a shell in the folder.|Start it from the command line.|The tool reads all files in a folder.|It prints the result.|Then call it with the name of a folder.|Use the option to set the size.""",
}


def given_lines() -> list[tuple[str, str | None]]:
    """The given lines with their kinds."""
    return [(line, kind) for kind, text in LINES.items() for line in text.replace("\n", "|").split("|")]


_PATTERNS = Patterns(KINDS)


def judge(line: str | None) -> str | None:
    """The kind of residue that a pattern of well-known messages tells of a line, or None."""
    return None if line is None else _PATTERNS.first(line.lower())


def train(sample: list[str]) -> Classifier:
    """A classifier of templates, from the given lines and from lines of the corpus: those that ``judge`` knows, with their kind,
    and as sound ones all others but those that the given lines alone would condemn."""
    first = Classifier(given_lines())
    labelled = [(line, judge(line)) for line in sample]
    return Classifier([*given_lines() * 3, *((line, kind) for line, kind in labelled if kind or not classify(first, line))])


def classify(model: Classifier, template: str) -> str | None:
    """The kind of residue that ``template`` is, if the classifier is sure."""
    kind, odds = model.best(template)
    return kind if odds >= LEAST_ODDS else None


def prose(body: Column) -> Column:
    """``body`` with LF line ends and without fenced, indented and inline code."""
    text = F.regexp_replace(body, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"(?s)(?m:^[ \t]*)(```|~~~).*?(?:\1|\z)", "\n")
    text = F.regexp_replace(text, r"(?m)^(?: {4}|\t).*$", "")
    return F.regexp_replace(text, r"`[^`\n]*`", "<code>")


def masked(line: Column) -> Column:
    """``line`` as the tokens of the prefix tree: blanks folded, numbers and interchangeable terms masked.

    Masked terms stay equal in all lines of a template, so that no wildcard hides what tells its kind.
    """
    numbered = F.regexp_replace(F.regexp_replace(line, r"\b(?=\w*\d)[0-9a-f]{5,}\b", "<num>"), r"\d+(?:[.,:]\d+)*", "<num>")
    text = F.when(line.rlike(r"\d"), numbered).otherwise(line)
    script = F.regexp_replace(text, r"(?i)\b(?:client-side )?(?:java ?scripts?|ecmascript|js|scripts|scripting)\b", "<script>")
    script = F.regexp_replace(script, r"(?i)\b(?:enable|activate|turn on|allow|switch on|permit)(?= <script>)", "<enable>")
    script = F.regexp_replace(script, r"(?i)\b(?:disabled|turned off|switched off|not supported|blocked|deactivated|not enabled)(?= in your browser)", "<off>")
    text = F.when(line.rlike(r"(?i)script|js|in your browser"), script).otherwise(text)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: A character that every slot holds.
_SLOT_SIGNS = r"[{}$%@\[\]<«]|XXXX|\(\(|__"


def residue(sections: DataFrame, id_col: str = "section_id", text_col: str = "body", evidence: bool = True) -> DataFrame:
    """``(id, kind, evidence)``: one row per section with residue and kind of it.

    ``kind`` is slot, hint, filler, error or notice; ``evidence`` an offending line or slot, null for lines without ``evidence``. Null, empty and
    blank bodies give no rows, repeated rows one result, other columns are ignored. Texts of any length are
    processed whole: they are cut into lines before any Python runs.
    """
    base = sections.select(F.col(id_col).alias("__id"), prose(F.col(text_col)).alias("__text")).where(F.trim("__text") != "")
    slot = F.when(F.col("__text").rlike(_SLOT_SIGNS), F.regexp_extract("__text", "|".join(SLOTS), 0)).otherwise("")
    # one pass over the texts: their lines, and last the slot if there is one
    cut = base.select("__id", F.posexplode(F.concat(F.array(slot), F.split("__text", r"\n+|(?<=[.!?])\s+"))).alias("pos", "line"))
    line = F.when(F.col("pos") == 0, F.col("line")).otherwise(masked(F.col("line")))
    cut = cut.where("line <> ''").select("__id", (F.col("pos") == 0).alias("slot"), line.alias("line")).where("line <> ''")
    cut = cut_lineage(cut.select("__id", "slot", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), "line"))
    slots = cut.where("slot").select("__id", F.lit("slot").alias("kind"), F.col("line").alias("evidence"))
    lines = cut.where("not slot")
    distinct = lines.groupBy("k1", "k2").agg(F.first("line").alias("line"), F.count("*").alias("n"))
    model = train(line_sample(lines, SAMPLE))

    def judge_of():
        return judge, lambda template, uses: classify(model, template)

    bad = judged_lines(distinct, judge_of)
    hits = salted_join(lines.select("__id", "k1", "k2"), bad, ["k1", "k2"]).select("__id", "kind", "k1", "k2")
    shown = distinct.join(bad.select("k1", "k2"), ["k1", "k2"]).select("k1", "k2", F.col("line").alias("evidence"))
    found = salted_join(hits, shown, ["k1", "k2"]).select("__id", "kind", "evidence") if evidence else hits.select("__id", "kind", F.lit(None).cast("string").alias("evidence"))
    return slots.unionByName(found).groupBy("__id", "kind").agg(F.min("evidence").alias("evidence")).withColumnRenamed("__id", id_col)


def line_sample(lines: DataFrame, rows: int) -> list[str]:
    """At most ``rows`` distinct lines of ``lines`` (__id, k1, line), frequent ones first of all, picked by hashes: the same ones at any partitioning."""
    total = lines.count()
    steps = 1 << 40
    cut = min(steps, round(steps * (1.2 * rows + 200) / max(1, total)))
    picked = lines.where(F.pmod(F.xxhash64("__id", "k1"), F.lit(steps)) < cut).groupBy("line").agg(F.count("*").alias("n"))
    return [r["line"] for r in picked.orderBy(F.desc("n"), "line").limit(rows).select("line").collect()]


def described_sections(manual_sections: DataFrame) -> DataFrame:
    """The rows titled Overview or How to Run, whatever the case, outer blanks and a closing colon."""
    title = F.regexp_replace(F.lower("title"), r"^\s+|[\s:]+$", "")
    return manual_sections.where(F.regexp_replace(title, r"\s+", " ").isin("overview", "how to run"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Ids of the Overview and How to Run sections that hold residue."""
    sections = described_sections(table(spark, sf_dir, "manual_sections")).select("section_id", "body")
    return residue(sections, evidence=False).select("section_id").distinct()


def p1_kinds(spark, sf_dir: str) -> DataFrame:
    """Number of affected sections by kind of residue."""
    sections = described_sections(table(spark, sf_dir, "manual_sections")).select("section_id", "body")
    return residue(sections, evidence=False).groupBy("kind").agg(F.count("*").alias("sections"))


def p1_sound_manual(spark, sf_dir: str) -> DataFrame:
    """The manual without its residue: one row per remaining section."""
    sections = table(spark, sf_dir, "manual_sections")
    bad = residue(described_sections(sections).select("section_id", "body"), evidence=False).select("section_id").distinct()
    return first_delivery(sections.select("section_id", "manual_id", "ord", "title", "body", "ingested_at"), "section_id").drop("ingested_at").join(bad, "section_id", "left_anti")
