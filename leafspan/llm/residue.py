"""Problem 1: template residue, filler, error messages and scripts-required notices.

Method: one grammar for each delimiter of unfilled placeholders, and expressions for
the other kinds, over text nodes with their surroundings.

A placeholder in prose is weighed: what speaks of it (words of syntax and tools, a verb
that governs it, quotes, code samples with placeholders on the page, neighbours that
speak of syntax) against its density, the share of the text that placeholders make up.
Code samples are left out. A message counts if its sentences make up the node: by the
grammar of subject, verdict and advice, or by density, if nearly all its telling words
are words of messages and a subject, a failure or scripts are among them. On a page
whose heading is an error message the lines beside it belong to it if half of them
are words of messages.

Damaged encodings are undone first (character model only), so that a message is
recognised in whatever garbling it arrives. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .encoding import Repairer, SampleCounts, sample_counts
from .pages import Page, map_pages, page_chunks

# ------------------------------------------------------- placeholder grammars
_IDENT = r"[A-Za-z_][\w-]*(?:\.[A-Za-z_][\w-]*)*"
PLACEHOLDER = re.compile(
    r"\{\{\{?\s*(?:[#/^>&]\s*)?" + _IDENT + r"(?:\s*\|\s*\w+(?::[^}|]{0,20})?)*\s*\}\}"
    r"|\{%-?\s*\w+[^%{}]{0,80}%\}"
    r"|\$\{\s*" + _IDENT + r"\s*\}|#\{\s*" + _IDENT + r"\s*\}"
    r"|<%[=-]?\s*" + _IDENT + r"[^%<>]{0,40}%>|<\?(?:php|=)[^?]{0,80}\?>"
    r"|(?<![\w%])%[A-Z][A-Z0-9_]{2,}%(?![\w%])|(?<!\w)__[A-Z][A-Z0-9_]+__(?!\w)|@@" + _IDENT + r"@@"
    r"|\[[A-Z][A-Z0-9]+(?:[ _][A-Z0-9]+)*\](?!\()|(?<![\w}\\^_$\])])\{\d\}"
    r"|(?<![\w}\\^_$\])])\{" + r"[a-z]\w*(?:[._][a-z]\w*)+\}"
    r"|\[(?:First|Last|Your|Full|Customer|Company|Product|User|Recipient|Date|Client|Member)(?: ?[nN]ame| [a-z]+){1,3}\](?!\()"
    r"|\[object [A-Z]\w+\]|%\(\w+\)[sd]|\{\{\s*\}\}"
    r"|^(?:undefined|null|NaN|\(null\)|None)$|\b(?:Dear|Hello|Hi|Welcome|Hallo|Bonjour|Hola|Liebe[r]?|Ciao|Olá)[ ,]+(?:undefined|null|None|NaN)\b"
)
_QUICK = re.compile(r"[{}%@\[<_]|undefined|null|NaN|None")


def _has_sign(text: str) -> bool:
    """What ``_QUICK`` finds, looked for one by one, which is faster."""
    return "{" in text or "}" in text or "%" in text or "@" in text or "[" in text or "<" in text or "_" in text or "undefined" in text or "null" in text or "NaN" in text or "None" in text



# ------------------------------------------------- fixed values: word lists
LATIN_FILLER = frozenset("""
lorem ipsum dolor sit amet consectetur consequat adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim
ad minim veniam quis nostrud exercitation ullamco laboris laborum nisi aliquip ex ea commodo duis aute irure in reprehenderit voluptate velit esse
cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est
""".split())
NONSENSE = frozenset("foo bar baz qux quux blah bla blub asdf qwer qwerty qwertz xxx yyy zzz lorem ipsum dummy test text sample placeholder filler".split())
FILLER_UNITS = r"(?:placeholder (?:paragraph|text|copy|content|sentence)|(?:sample|dummy|filler|test|example|demo|mock) (?:text|copy|paragraph|content|sentence|words)|text text text|blindtext|platzhaltertext|texte? (?:de remplissage|d'exemple|fictif)|testo (?:segnaposto|di prova|fittizio)|texto (?:de (?:ejemplo|relleno|exemplo|prueba)|simulado|provisório)|przykładowy tekst|текст[- ](?:заглушка|рыба))"
_FILLER = re.compile(
    r"\s*(?:" + FILLER_UNITS + r"[.!,;]?\s*)+"
    r"|.{0,40}\b(?:dummy|placeholder|filler|sample) (?:paragraph|text|copy)\b.{0,80}\b(?:replace|layout|going live|publish)\w*\b.{0,60}", re.I | re.S
)

_VERB = (
    r"(?:add|enter|insert|paste|type|write|put|replace|fill|describe|provide|edit|change|upload"
    r"|ajoute[rz]|insére[rz]|saisi(?:r|ssez)|écri(?:re|vez)|remplace[rz]"
    r"|escrib[ae]|introduzca|introduce|inserte|añad(?:a|ir)|agregue|reemplace"
    r"|insira|introduza|escreva|adicione|acrescent(?:e|ar)|substitua"
    r"|inserisci|inserire|scriv(?:i|ere)|aggiung(?:i|ere)|sostitui(?:sci|re)"
    r"|wpisz|wprowadź|dodaj|dodać|wstaw"
    r"|вставьте|введите|добав(?:ьте|ить)|напишите|замените)"
)
_HERE = r"(?:here|at this point|\(max\.? \d+ characters\)|with your own \w+|about your company here|ici|aquí|aqui|qui|hier|tu|tutaj|сюда|здесь)"
_INSTRUCTION = re.compile(
    r"[\[(<]\s*" + _VERB + r"\b[^\])>]{2,70}[\])>]\.?"
    r"|[\[(<]?\s*" + _VERB + r"\b.{2,60}?" + _HERE + r"\s*[\])>]?[.!]?"
    r"|" + _VERB + r"\s+" + _HERE + r"\b.{2,40}"
    r"|(?:replace) (?:this|the) (?:text|line|block|paragraph|section|sentence)\b.{0,60}"
    r"|" + _HERE + r"\s+.{2,30}\b(?:einfügen|eingeben|ergänzen|schreiben|" + _VERB + r")\b.{0,30}"
    r"|.{0,40}\b(?:goes|steht|kommt) (?:here|hier)[.!]?|.{2,40}\bhier (?:einfügen|eingeben|ergänzen|schreiben)[.!]?"
    r"|[\[(<].{2,40}\b(?:einfügen|eingeben|ergänzen)\s*[\])>]"
    r"|(?:tu|tutaj|qui|ici|aquí|aqui|hier|сюда) " + _VERB + r"\b.{2,40}"
    r"|(?:your|votre|vos|su|sus|il tuo|il suo|o seu|a sua|twój|ваш|ihr|dein) \w+(?: \w+)? (?:here|ici|aquí|aqui|qui|hier|tutaj|tu|здесь)[.!]?"
    r"|(?:ajoutez|añada|adicione|aggiungi|dodaj|добавьте|ergänzen sie) (?:une? |un[ao]? |o |a |eine )?(?:description|descripción|descrição|descrizione|opis|описание|titre|título|titolo|texte|texto|testo|beschreibung)[.!]?",
    re.I | re.S,
)
_TODO = re.compile(r"(?:TODO|TBD|FIXME|XXX|TO DO|À (?:COMPLÉTER|FAIRE)|PENDIENTE|POR (?:FAZER|HACER)|DA FARE|DO ZROBIENIA|СДЕЛАТЬ|ZU ERLEDIGEN)\s?[:–-]\s?.{2,60}", re.S)

# --------------------------------------------- error pages: subject and verdict
_SUBJECT = {
    "en": r"(?:the|this|that|our|your|its)\s(?:\w+\s){0,2}?(?:page|server|article|entry|link|file|database|address|site|website|resource|document|url|service|listing|session|connection|request|content|item|post|topic|thread|user|account)\b(?:\s(?:you\s\w+(?:\sfor)?|to the database|requested|at this address))?",
    "de": r"(?:die|der|das|diese[rs]?|ihre?)\s(?:\w+\s){0,2}?(?:seite|server|beitrag|artikel|datei|datenbank|adresse|dienst|verbindung|eintrag|inhalt|website|sitzung|dokument)\b",
    "fr": r"(?:la|le|l[’']|cet(?:te)?|ce|notre|votre)\s?(?:\w+\s){0,2}?(?:page|serveur|article|fichier|base de données|adresse|service|lien|site|ressource|document|session|annonce)\b(?:\sdemandée?|\srecherchée?)?",
    "es": r"(?:la|el|este|esta|nuestr[oa]|su)\s(?:\w+\s){0,2}?(?:página|servidor|artículo|archivo|base de datos|dirección|servicio|enlace|sitio|recurso|documento|sesión)\b(?:\s(?:buscad|solicitad|pedid)[oa])?",
    "pt": r"(?:a|o|este|esta|nosso|nossa|sua)\s(?:\w+\s){0,2}?(?:página|servidor|artigo|ficheiro|arquivo|base de dados|endereço|serviço|ligação|link|sítio|site|recurso|documento|sessão)\b(?:\s(?:pedid|solicitad|procurad)[oa])?",
    "it": r"(?:la|il|l[’']|questo|questa|quest[’'])\s?(?:\w+\s){0,2}?(?:pagina|server|articolo|file|banca dati|database|indirizzo|servizio|collegamento|sito|risorsa|documento|sessione)\b(?:\s(?:richiest|cercat)[oa])?",
    "pl": r"(?:\w+\s){0,2}?(?:strona|serwer|artykuł|plik|baza danych|adres|usługa|wpis|witryna|zasób|dokument|sesja)\b(?:\sdanych)?",
    "ru": r"(?:\w+\s){0,2}?(?:страница|сервер|статья|файл|база данных|адрес|сервис|служба|запись|сайт|ресурс|документ)",
}
_VERDICT = {
    "en": r"(?:could|can)(?:not| not) be (?:found|displayed|shown|opened|reached|loaded|established)(?: right now)?|was not found|is (?:no longer|not) (?:here|available)|refused the request|did not (?:answer|respond)(?: in time)?|(?:is|seems) broken or out of date|is being repaired|is (?:temporarily )?(?:unavailable|offline|down)|has reported a problem(?: \(no\. \d+\))?|(?:does|do) not exist(?: or has been moved)?|has been (?:moved|removed|deleted)(?: by its owner)?|returned an invalid response(?: \(code \d+\))?|has expired(?:, please sign in again)?|leads nowhere|timed out|is under maintenance",
    "de": r"wurde (?:leider )?nicht gefunden|existiert nicht(?: oder wurde verschoben)?|ist nicht (?:mehr )?(?:verfügbar|erreichbar|vorhanden)|antwortet nicht|wird gerade gewartet|meldet einen fehler(?: \(nr\. \d+\))?|ist (?:vorübergehend|derzeit|zur ?zeit) nicht (?:erreichbar|verfügbar)(?: \(code \d+\))?|wurde (?:entfernt|verschoben|gelöscht)|kann nicht angezeigt werden|ist abgelaufen",
    "fr": r"(?:reste|est) introuvable|n[’']existe pas(?: ou a été déplacée?)?|n[’']est plus disponible|ne répond pas|est en maintenance|signale une erreur(?: \(n[°º] ?\d+\))?|n[’']a pas été trouvée?|a été (?:supprim|déplac)ée?|a expiré|est (?:momentanément|temporairement) indisponible",
    "es": r"no (?:existe|responde)(?: o ha sido trasladad[oa])?|ya no está disponible|está en mantenimiento|informa de un error(?: \(n\.?[º°] ?\d+\))?|no se (?:ha encontrado|encontró|puede mostrar)|ha (?:sido eliminad[oa]|caducado)|no está disponible",
    "pt": r"não (?:existe|responde|foi encontrad[oa])(?: ou mudou de endereço)?|já não está disponível|está em manutenção|comunica um erro(?: \(n\.?[º°] ?\d+\))?|(?:informa|reporta|relata|indica) um erro(?: \(n\.?[º°] ?\d+\))?|foi (?:removid|movid)[oa]|expirou|não está disponível",
    "it": r"non (?:esiste|risponde|è (?:più )?disponibile|è stat[oa] trovat[oa])(?: o è stat[oa] spostat[oa])?|è in manutenzione|segnala un errore(?: \(n\.?[º°]? ?\d+\))?|è scadut[oa]|è stat[oa] (?:rimoss|spostat)[oa]",
    "pl": r"nie (?:istnieje|odpowiada|został[ao]? znalezion[ay]|jest (?:już )?dostępn[ay])(?: lub został[ao]? przeniesion[ay])?|jest (?:w trakcie konserwacji|naprawian[ay])|zgłasza błąd(?: \(nr \d+\))?|wygasła",
    "ru": r"не (?:существует|отвечает|найден[ао]?)(?: или был[ао]? перемещен[ао]?)?|больше недоступен[ао]?|(?:временно )?недоступен[ао]?|сообщает об ошибке(?: \(№ ?\d+\))?|на обслуживании",
}
_INTERJECTION = r"(?:(?:hm|oops|ooops|oh dear|sorry|we are sorry|unfortunately|apologies|whoops|hoppla|leider|entschuldigung|oups|hélas|désolée?|lo sentimos|por desgracia|vaya|ups|lamentamos|infelizmente|desculpe|pedimos desculpa|spiacenti|purtroppo|ops|ci dispiace|niestety|przepraszamy|извините|к сожалению|увы|ой)\s?[,:!.–-]*\s?(?:but|aber|mais|pero|mas|ma|ale|но)?\s?)"
_CODE = r"(?:\s?\((?:code|código|codice|kod|код)\s?\d+\))?"
_FIXED = (
    r"(?:error|fehler|erreur|errore|erro|błąd|ошибка)\s?\d{3}|[45]\d\d|oops|ups|oups|hoppla"
    r"|page not found|not found|page introuvable|page non trouvée|seite nicht gefunden|página no encontrada|página não encontrada|pagina non trovata|nie znaleziono strony|страница не найдена"
    r"|access denied|forbidden|zugriff verweigert|accès refusé|acceso denegado|acesso negado|accesso negato|odmowa dostępu|доступ запрещ[ёе]н|you do not have permission to \w+ this (?:resource|page)"
    r"|(?:bad )?gateway(?: time-?out)?|request time-?out|internal server error|service (?:temporarily )?unavailable"
    r"|service momentanément indisponible|servicio no disponible por el momento|serviço temporariamente indisponível|servizio momentaneamente non disponibile|usługa chwilowo niedostępna|сервис временно недоступен"
    r"|something went wrong(?: on our side)?|an error (?:has )?occurred|es ist ein fehler aufgetreten|une erreur est survenue|se ha producido un error|ocorreu um erro|si è verificato un errore|wystąpił błąd|произошла ошибка"
    r"|we looked everywhere, but this (?:address|page|link) leads nowhere|too many requests from your address; slow down and retry in \d+ seconds|too many requests"
    r"|(?:fatal error|warning|notice|parse error): (?:uncaught|undefined|syntax|call to|unexpected)\b.{0,80}?(?:on line \d+)?"
)
_TRAILER = (
    r"(?:return to the (?:start|home) ?page|go back to the (?:start|home) ?page|(?:please )?try again(?: later| in a few minutes)?|check the spelling of the address|if this keeps happening, tell the webmaster|status \d+|error \d+|please sign in again"
    r"|you do not have permission to \w+ this (?:resource|page)"
    r"|versuchen sie es (?:in einigen minuten noch einmal|bitte später erneut)|bitte versuchen sie es später erneut|prüfen sie die adresse|zurück zur startseite"
    r"|réessayez dans quelques minutes|vérifiez l[’']adresse|statut \d+|merci de réessayer plus tard|retour à l[’']accueil"
    r"|inténtelo (?:dentro de unos minutos|de nuevo más tarde)|compruebe la dirección|estado \d+|volver al inicio"
    r"|tente (?:novamente|de novo)(?: mais tarde| dentro de (?:alguns|uns) minutos| daqui a \w+ minutos)?|verifique o endereço|estado \d+"
    r"|ripro(?:va|vi|vare)(?: più tardi| tra qualche minuto| fra qualche minuto)?|controlla(?:re)? l[’']indirizzo|stato \d+"
    r"|spróbuj (?:ponownie później|ponownie za kilka minut)|sprawdź adres|status \d+"
    r"|повторите попытку(?: позже| через несколько минут)?|попробуйте (?:ещё раз )?(?:позже|через несколько минут)|проверьте адрес|статус \d+|код \d+)"
)
_SAYS = "|".join(f"{_SUBJECT[k]}\\s(?:{_VERDICT[k]})" for k in _SUBJECT)
_ERROR = re.compile(
    r"\s*(?:[45]\d\d\s?[–:-]\s?)?" + _INTERJECTION + r"?(?:" + _SAYS + r"|" + _FIXED + r")" + _CODE + r"\s*[.!…]*(?:\s*" + _TRAILER + r"\s*[.!]*)*\s*",
    re.I | re.S,
)
_CODE_ONLY = re.compile(r"\s*[45]\d\d\s*")
_BARE = re.compile(r"\s*(?:\d{3}|\w+)[!.]?\s*")
_REQUEST_ID = re.compile(r"\s*(?:request|incident|error|trace|reference|ray|event)[ -]?id\b.{0,60}", re.I)

# ------------------------------------------------------ scripts-required notices
_SCRIPT = r"(?:javascript|java ?script|\bscripts?\b|scripting|active content|script blocker|skript\w*|skrypt\w*|скрипт\w*|\bscript\b)"
_NOTICE = re.compile(
    r"(?=.{0,140}" + _SCRIPT + r").{0,70}"
    r"(?:\b(?:enable|activate|allow|turn on|turn off|switch .{0,14}on|switch them on|need a browser|needs? scripts?|requires?|must be allowed|is off|are off|disabled|does not support|to run this app|blocker"
    r"|aktivier\w*|benötigt|ausführ\w*|führt|einschalten|zulassen|activez|activer|a besoin|bloque|nécessite|autoris\w*|active|activa\w*|active|necesita|desactivad\w*|permita|habilit\w*"
    r"|ative|ativar|precisa|desligad\w*|desativad\w*|attiva\w*|abilita\w*|richiede|disattivat\w*|włącz\w*|wymaga|blokuje|zezw\w*)\b|включ\w*|нужны|разреш\w*|не выполн\w*|требу\w*)"
    r".{0,120}", re.I | re.S
)
def _speaks_of_scripts(low: str) -> bool:
    """Whether a text in lower case holds what every alternative of ``_SCRIPT`` holds."""
    return "script" in low or "skript" in low or "skrypt" in low or "скрипт" in low or "active content" in low


#: Words that make a sentence about scripts ordinary prose.
_PROSE = re.compile(r"\b(?:course|courses|lesson|book|lecture|class|workshop|teaches|taught|learn(?:s|ed)?|kurs|cours|curso|corso|fills|fridays|yesterday|century|play|theatre|museum)\b", re.I)


_BREAK = re.compile(r"[^\W\d_]+")
# fixed values: words of the messages above, for texts with lost bytes; no gate, as the patterns know more forms
FILLER_AND_INSTRUCTION_WORDS = frozenset("""
content demo mock example copy paragraph layout publish live blindtext platzhaltertext texte testo texto tekst текст
here point characters own about ici aquí aqui qui hier tu tutaj сюда здесь replace einfügen eingeben ergänzen
ajoutez añada adicione aggiungi dodaj добавьте
add enter insert paste type write put fill describe provide edit change upload ajouter insérez insérer saisir saisissez écrire écrivez escriba introduzca
introduce inserte añadir agregue insira introduza escreva acrescente inserisci inserire scrivi scrivere wpisz wprowadź wstaw вставьте введите напишите
todo tbd fixme xxx compléter faire pendiente fazer fare zrobienia сделать erledigen
""".split())  # fmt: skip
VERDICT_WORDS = frozenset("""
found refused answer respond broken repaired problem exist moved removed deleted invalid expired nowhere timed maintenance unavailable offline available
displayed shown opened reached loaded established longer down
gefunden existiert verfügbar erreichbar vorhanden antwortet gewartet meldet entfernt verschoben gelöscht angezeigt abgelaufen
introuvable existe disponible répond indisponible signale trouvé trouvée supprimé supprimée déplacé déplacée expiré
responde encontrado encontró mostrar mantenimiento informa eliminado eliminada caducado encontrado encontrada manutenção comunica reporta relata indica
removido removida movido movida expirou disponível esiste risponde trovato trovata manutenzione segnala scaduto scaduta rimosso rimossa spostato spostata
istnieje odpowiada znaleziona znaleziony dostępna dostępny konserwacji naprawiana naprawiany zgłasza wygasła
существует отвечает найден найдена найдено недоступен недоступна сообщает обслуживании
""".split())  # fmt: skip
MESSAGE_WORDS = frozenset("""
error fehler erreur errore erro błąd ошибка oops ups oups hoppla trouvée gefunden encontrada trovata znaleziono найдена denied forbidden verweigert refusé
denegado negado negato odmowa запрещён запрещен permission gateway service temporarily momentanément momento temporariamente momentaneamente chwilowo временно
wrong occurred aufgetreten survenue producido ocorreu verificato wystąpił произошла everywhere requests fatal warning notice parse request incident trace reference ray event
javascript java script scripts scripting active blocker skript skripte skripts skrypt skrypty skryptów скрипт скрипты скрипта
""".split())  # fmt: skip
_FILLER_WORDS = LATIN_FILLER | NONSENSE
_CUES = _FILLER_WORDS | FILLER_AND_INSTRUCTION_WORDS | VERDICT_WORDS | MESSAGE_WORDS
# ------------------------------------------------- fixed values: what messages are made of
THINGS = frozenset("""
page pages server servers site website resource document file url link address service database connection session request system content item entry listing host gateway account article post application app
seite server website dokument datei adresse dienst datenbank verbindung sitzung anfrage inhalt eintrag beitrag artikel link ressource system anwendung
page serveur site ressource document fichier adresse lien service base données connexion session requête contenu article annonce système
página servidor sitio recurso documento archivo dirección enlace servicio base datos conexión sesión solicitud contenido artículo sistema
página servidor sítio site recurso documento ficheiro arquivo endereço ligação serviço base dados sessão pedido conteúdo artigo sistema
pagina server sito risorsa documento file indirizzo collegamento servizio banca dati database connessione sessione richiesta contenuto articolo sistema
strona stronę serwer witryna zasób dokument plik adres usługa baza danych połączenie sesja żądanie treść artykuł wpis system
страница страницу сервер сайт ресурс документ файл адрес сервис служба база данных соединение сессия запрос статья запись система
""".split())
FAILURES = frozenset("""
error errors found find locate located unavailable available exist exists existing expired expire timed timeout failed failure fail broken removed moved deleted missing denied forbidden refused rejected invalid unknown offline down maintenance unreachable unresponsive respond responding responded overloaded crashed wrong problem nowhere interrupted blocked unauthorized unauthorised terminated
fehler gefunden existiert verfügbar erreichbar vorhanden abgelaufen fehlgeschlagen entfernt verschoben gelöscht verweigert verboten ungültig unbekannt offline wartung gewartet antwortet überlastet unterbrochen gesperrt
erreur introuvable trouvée trouvé existe disponible indisponible répond expiré échoué échec supprimée supprimé déplacée déplacé refusé interdit invalide inconnu maintenance surchargé interrompue bloqué
error encontrada encontrado encontró existe disponible responde caducado expirado fallado fallo eliminada eliminado movida denegado prohibido inválido desconocido mantenimiento interrumpida bloqueado
erro encontrada encontrado existe disponível indisponível responde expirou expirada falhou falha removida movida negado proibido inválido desconhecido manutenção interrompida bloqueado
errore trovata trovato esiste disponibile risponde scaduta scaduto fallita fallito rimossa spostata negato vietato non-valido sconosciuto manutenzione interrotta bloccato
błąd znaleziono znaleziona istnieje dostępna dostępny niedostępna niedostępny odpowiada wygasła usunięta przeniesiona odmowa zabronione nieprawidłowy nieznany konserwacji przerwane zablokowany
ошибка найдена найден существует недоступна недоступен отвечает истекла истек удалена удалён перемещена запрещён запрещен неверный неизвестный обслуживании прервано заблокирован
""".split())
ADVICE = frozenset("""
sorry oops apologies please try again later retry return back home homepage start check spelling contact administrator webmaster support reload refresh login log sign signed logged minutes moment moments few temporarily currently requested entered typed looking request code status number report reported may might could technical difficulties inconvenience search menu use browser permission access view load display loaded displayed processed completed reached opened shown
leider entschuldigung bitte versuchen später erneut zurück startseite prüfen adresse administrator neu laden anmelden minuten vorübergehend derzeit angeforderte gesuchte status code nummer technische suche zugriff angezeigt geladen
désolé désolée veuillez réessayer réessayez tard retour accueil vérifiez adresse administrateur recharger connecter minutes momentanément demandée recherchée statut code technique accès affichée
sentimos disculpe inténtelo intente nuevo tarde volver inicio compruebe dirección administrador recargar minutos temporalmente solicitada estado código técnico acceso mostrada
lamentamos desculpe tente novamente tarde voltar início verifique endereço administrador recarregar minutos temporariamente pedida solicitada estado código acesso
spiacenti riprova riprovi tardi tornare home controlla indirizzo amministratore ricaricare minuti momentaneamente richiesta stato codice accesso
przepraszamy proszę spróbuj ponownie później wróć główna sprawdź adres administrator odśwież minut chwilowo tymczasowo żądana status kod dostęp
извините пожалуйста попробуйте позже повторите вернуться главную проверьте адрес администратор обновите минут временно запрошенная статус код доступ
""".split())
SCRIPTS = frozenset("javascript java script scripts scripting skript skripte skripten skripts skrypt skrypty skryptów skryptami скрипт скрипты скрипта скриптов скриптами javascripts".split())
ENABLING = frozenset("""
enable enabled enabling activate activated allow allowed turn turned switch on off disabled requires require required needs need needed support supports supported settings preferences setting reload blocker blocked blocks run running execute work works works properly correctly function functions fully without
aktivieren aktiviert aktiviere einschalten zulassen erlauben benötigt deaktiviert einstellungen ausführen ausführt unterstützt funktioniert browser
activer activez activé autoriser autorisez nécessite besoin désactivé paramètres navigateur fonctionne fonctionner exécute
activar active activado permita permitir necesita requiere desactivado desactivados ajustes navegador funciona funcionar
ativar ative ativado permita permitir precisa requer desativado definições navegador funciona funcionar
attivare attiva attivato abilita abilitare consentire richiede necessita disattivato impostazioni funziona funzionare
włącz włączyć włączona zezwól wymaga potrzebuje wyłączona wyłączone ustawieniach przeglądarka przeglądarce działa
включите включить включён разрешите разрешить требует требуется нужны нужен отключён отключены настройках браузер браузере работы работает выполнение выполняет
""".split())
SMALL_WORDS = frozenset("""
a an the this that these those of to in on at by for from with and or but if it its is are was were be been being has have had do does did not no cannot can could will would should must may you your we our us i my me as so than then there here which what who when where how one or either any some all also only just very more most please via into out up about it's we're you're don't doesn't didn't isn't couldn't re t s ve ll d
der die das den dem des ein eine einen einem einer und oder aber wenn es sie ihr ihre ihren ihrem wir unser unsere ist sind war waren wird werden wurde wurden hat haben nicht kein keine mehr zu zur zum in im auf an am bei mit von vom für um diese dieser dieses noch einmal nach als auch nur sich
le la les l un une des du de d et ou mais si il elle nous notre vous votre vos est sont était a ont été n ne pas plus aucun aucune à au aux en dans sur par pour avec ce cet cette ces que qui dont se s y c qu
el la los las un una unos de del y o pero si su sus nuestro nuestra es son ha han sido no más a al en por para con este esta esto que se lo le ya
o a os as um uma de do da dos das e ou mas se seu sua nosso nossa é são foi está não mais em no na nos nas por para com este esta que já à ao
il lo la i gli le l un uno una di del della dei e o ma se suo sua nostro nostra è sono stato stata ha non più a al alla in nel nella da per con questo questa che si
i w na z ze do o po dla lub ale jeśli jest są było nie ten ta to twój twoja nasz nasza się już przez który która za
и в на с к по за из для или но если это этот эта ваш ваша наш не нет был была было уже что который вы мы его её их
""".split())
#: Words that speak of templates rather than being left in one: tools, nouns of syntax, verbs.
TOOLS = frozenset("jinja jinja2 mustache handlebars django liquid twig smarty blade erb ejs php bash shell powershell cmd angular vue svelte thymeleaf velocity freemarker ansible helm terraform makefile gettext latex perl python javascript ruby razor haml pug nunjucks wordpress hugo jekyll unix windows".split())
SYNTAX = frozenset("""
placeholder placeholders template templates templating variable variables syntax expression expressions tag tags brace braces bracket brackets curly macro macros interpolation snippet snippets token tokens delimiter delimiters escape escaped parameter parameters directive directives string strings literal notation field fields merge programmers programmer developers developer engine code
platzhalter vorlage vorlagen schablone variable variablen syntax ausdruck klammern klammer vorlagensprache zeichenkette
espace-réservé gabarit gabarits modèle variable variables syntaxe expression balise balises accolade accolades chaîne
marcador marcadores plantilla plantillas variable variables sintaxis expresión etiqueta etiquetas llaves corchetes cadena
marcador modelo modelos variável variáveis sintaxe expressão etiqueta chavetas chaves cadeia
segnaposto modello modelli variabile variabili sintassi espressione parentesi graffe stringa etichetta
szablon szablonie szablony zmienna zmiennej zmienne składnia wyrażenie nawiasy klamrowe znacznik symbol
шаблон шаблоне шаблоны переменная переменной переменные синтаксис выражение скобки заполнитель тег строка
""".split())
SPEAKING = frozenset("""
write writes written use uses used using type types put puts refer refers expand expands expanded replaced replaces substitute substitutes substituted print prints output outputs render renders rendered evaluate evaluates mean means denote denotes called open opens close closes insert inserts stands becomes contains calls say says looks
schreibt schreibe schreiben verwendet verwenden ersetzt steht bedeutet gibt heißt öffnet schließt
écrit écrire écrivez utilise utilisez remplacé remplacée signifie affiche désigne ouvre ferme
escribe escribir usa use utiliza reemplaza sustituye significa imprime abre cierra
escreve escrever usa use utiliza substituído significa imprime abre fecha
scrive scrivere usa usare sostituito significa stampa apre chiude
pisze użyj używa zastępuje zastąpiony oznacza wypisuje otwiera zamyka
пишут напишите используйте используется заменяется означает выводит открывает закрывает
""".split())
# ------------------------------------------------------------------------------
_MESSAGE = THINGS | FAILURES | ADVICE | SCRIPTS | ENABLING
_MESSAGE_OR_CUE = _MESSAGE | _CUES
_GOVERNED = re.compile(r"(?:\b(?:write|writes|type|use|uses|using|put|call|calls|say|says|schreibt|schreiben|verwendet|écrit|écrivez|utilisez|escribe|usa|escreve|scrive|pisze|użyj|пишут|используйте)|[“\"'‘«„`(]|\b(?:like|as|e\.g\.|such as|wie|comme|como|come|jak|как))\s*$", re.I)
_CLOSED = re.compile(r"\s*[”\"'’»“`)]")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[\])])\s+(?=[\[(])")
#: Where the first of its matches begins, looked for by its white space.
_SENTENCE_END = re.compile(r"\s(?:(?<=[.!?…]\s)|(?<=[\])]\s)\s*(?=[\[(]))")


def _word_share(words: list[str], known: frozenset) -> float:
    return sum(map(known.__contains__, words)) / len(words) if len(words) >= 4 else 0.0


def _message_share(words: list[str]) -> float:
    """Which share of the telling words of a text are words of messages."""
    telling = [w for w in words if w not in SMALL_WORDS]
    return sum(map(_MESSAGE.__contains__, telling)) / len(telling) if telling else 0.0


def is_error(text: str, words: list[str] | None = None) -> bool:
    """Whether a text consists of an error message: by the grammar, or by density."""
    if _ERROR.fullmatch(text):
        return True
    words = _BREAK.findall(text.lower()) if words is None else words
    return len(words) >= 4 and not FAILURES.isdisjoint(words) and not THINGS.isdisjoint(words) and not ADVICE.isdisjoint(words) and _message_share(words) >= 0.85


def is_notice(text: str, words: list[str] | None = None) -> bool:
    """Whether a text consists of a notice that scripts are required."""
    words = _BREAK.findall(text.lower()) if words is None else words
    if not _speaks_of_scripts(text.lower()):
        return False
    if _PROSE.search(text):
        return False
    return bool(_NOTICE.fullmatch(text)) or (not ENABLING.isdisjoint(words) and _message_share(words) >= 0.7)


def spoken_of(text: str, spans: list[tuple[int, int]], around: float = 0.0) -> bool:
    """Whether the placeholders at ``spans`` are what a text speaks about, and not left in it.
    ``around`` is what the page says for it."""
    rest, at = [], 0
    for a, b in spans:
        rest.append(text[at:a])
        at = b
    words = [w for part in (*rest, text[at:]) for w in _BREAK.findall(part.lower())]
    if len(words) < 4:
        return False
    density = sum(b - a for a, b in spans) / len(text)
    own = 1.5 * (not TOOLS.isdisjoint(words)) + min(2, len(SYNTAX.intersection(words)))
    for a, b in spans:
        if _GOVERNED.search(text, max(0, a - 16), a):
            own += 1.0 + bool(_CLOSED.match(text, b))
            break
    # what says nothing of syntax itself is not saved by its surroundings
    return own > 0 and own + (not SPEAKING.isdisjoint(words)) + around - 4.0 * max(0.0, density - 0.5) >= 2.0


def kind_of(text: str, around: float = 0.0) -> str | None:
    """placeholder, filler, instruction, error, notice or None for one text on its own."""
    if not text or text.isspace():
        return None
    if _has_sign(text) and (spans := [m.span() for m in PLACEHOLDER.finditer(text)]) and not spoken_of(text, spans, around):
        return "placeholder"
    s = text.strip()
    low = s.lower()
    words = _BREAK.findall(low)
    kind = _unit(s, low)
    if kind or _CODE_ONLY.fullmatch(text):
        return kind or "error"
    if _word_share(words, LATIN_FILLER) > 0.8 or _word_share(words, NONSENSE) > 0.8:
        return "filler"
    if not FAILURES.isdisjoint(words) and is_error(s, words):
        return "error"
    if _speaks_of_scripts(low) and is_notice(s, words):
        return "notice"
    # several sentences, each of which would do alone, or is advice behind one that does
    cut = _SENTENCE_END.search(s)
    first = s[: cut.start()] if cut else ""
    if cut and (kind := _unit(first, first.lower())):
        for x in _SENTENCE.split(s)[1:]:
            w = _BREAK.findall(x.lower())
            if not _unit(x, x.lower()) and not (w and _message_share(w) >= 0.7):
                return None
        return kind
    return None


def _unit(s: str, low: str) -> str | None:
    """The kind of a text that one of the expressions matches whole."""
    if _INSTRUCTION.fullmatch(s) or _TODO.fullmatch(s):
        return "instruction"
    if _FILLER.fullmatch(s):
        return "filler"
    if _ERROR.fullmatch(s):
        return "error"
    if _speaks_of_scripts(low) and _NOTICE.fullmatch(s) and not _PROSE.search(s):
        return "notice"
    return None


#: Entries of memos up to which a finder is kept for the next task of its process (some 150 bytes each).
KEEP = 1_000_000


class Finder:
    """Finds residue page by page; verdicts on texts are memoised."""

    def __init__(self, samples: list[str] | SampleCounts):
        # the words of the messages looked for, so that those with lost bytes are known too
        self.fixer = Repairer(samples, more=[" ".join(_CUES), *_SUBJECT.values(), *_VERDICT.values(), _FIXED, _TRAILER, _INSTRUCTION.pattern, _NOTICE.pattern])
        self.memo: dict[str, str | None] = {}
        self.may: dict[str, bool] = {}

    def remembered(self) -> int:
        """Entries of all memos together, about."""
        f = self.fixer
        return len(self.memo) + len(self.may) + len(f.by_text) + 20 * len(f.memo) + f.n_ones + len(f.bases) + len(f.ceilings) + len(f.model.memo) + len(f.model.logs) + len(f.paths) + len(f.fits)

    def _kind(self, text: str, around: float = 0.0) -> str | None:
        key = (text, around) if around else text
        if key in self.memo:
            return self.memo[key]
        k = kind_of(text, around)
        if len(self.memo) < 200_000:
            self.memo[key] = k
        return k

    @staticmethod
    def _around(page: Page, i: int, texts: dict[int, str]) -> float:
        """What the surroundings of a text say for its speaking of placeholders: samples of
        code that hold some, and words of syntax in what stands before and behind it."""
        code = any(page.in_code[j] and _QUICK.search(t) and PLACEHOLDER.search(t) for j, t in texts.items())
        order = list(texts)
        k = order.index(i)
        near = [w for j in order[max(0, k - 2) : k] + order[k + 1 : k + 3] for w in _BREAK.findall(texts[j].lower())]
        return 1.0 * code + 0.5 * (not TOOLS.isdisjoint(near)) + 0.5 * (not SYNTAX.isdisjoint(near))

    def texts(self, page: Page) -> dict[int, str]:
        """Text nodes outside script and style."""
        return {i: page.data[i] for i, n in enumerate(page.names) if n is None and page.data[i] and not page.raw(i)}

    def _repaired(self, page: Page, texts: dict[int, str]) -> dict[int, str]:
        """Texts in damaged encodings, undone, if what damage leaves alone may belong to a
        message: placeholders are ASCII, and so are many words."""
        may, odd = self.may, []
        for i, t in texts.items():
            if not t.isascii() and self.memo.get(t) is None:
                if t not in may:
                    if len(may) >= 200_000:
                        may.clear()
                    may[t] = self._may_be(t)
                if may[t]:
                    odd.append(i)
        fixed = self.fixer.repair_all([texts[i] for i in odd]) if odd else []
        return {i: r[0] for i, r in zip(odd, fixed, strict=True) if r}

    @staticmethod
    def _may_be(text: str) -> bool:
        whole = [w for w in _ASCII_WORD.findall(text.lower()) if w not in SMALL_WORDS]
        return len(whole) < 4 or sum(map(_MESSAGE_OR_CUE.__contains__, whole)) * 5 >= len(whole)

    def find(self, page: Page, texts: dict[int, str] | None = None) -> dict[int, str]:
        """Position -> kind."""
        texts = self.texts(page) if texts is None else texts
        out: dict[int, str] = {}
        heads = []
        fixed = self._repaired(page, texts)
        if fixed:
            texts = texts | fixed
        for i, t in texts.items():
            if page.in_code[i]:
                continue
            kind = self._kind(t)
            if kind == "placeholder" and (around := self._around(page, i, texts)):
                kind = self._kind(t, around)
            p = page.parents[i]
            if kind == "error" and _BARE.fullmatch(t) and not (p >= 0 and page.names[p] in ("h1", "h2", "title")):
                kind = None  # a number in a table is no heading
            if kind is None and p >= 0 and page.names[p] == "noscript":
                kind = "notice"
            if kind:
                out[i] = kind
            if p >= 0 and page.names[p] == "h1" and kind in ("error", "notice"):
                heads.append(p)
        # the lines beside an error heading, or beside the only message of a page
        for h in heads or {page.parents[i] for i, k in out.items() if k == "error" and page.in_body[i]}:
            box = page.parents[h]
            for i in texts:
                p = page.parents[i]
                if i in out or page.in_code[i] or p < 0 or page.parents[p] != box:
                    continue
                if _REQUEST_ID.fullmatch(texts[i]) or (heads and page.names[p] in _LINES and _near(page, h, p) and self._of_messages(page, h, texts, out)):
                    out[i] = "error"
        return out


    @staticmethod
    def _of_messages(page: Page, head: int, texts: dict[int, str], out: dict[int, str]) -> bool:
        """Whether at least half of the lines beside a heading are messages or of their words."""
        box = page.parents[head]
        lines = [i for i in texts if (p := page.parents[i]) >= 0 and page.parents[p] == box and page.names[p] in _LINES]
        return 2 * sum(i in out or _REQUEST_ID.fullmatch(texts[i]) is not None or _message_share(_BREAK.findall(texts[i].lower())) >= 0.4 for i in lines) >= len(lines)


_KEPT: list[tuple[SampleCounts, Finder]] = []


def kept_finder(samples: SampleCounts) -> Finder:
    """The finder that the task before in this process had, if it is of the same samples, for what
    it remembers; a new one if that is none, or remembers much."""
    if not (_KEPT and _KEPT[0][0] is samples and _KEPT[0][1].remembered() < KEEP):
        _KEPT[:] = [(samples, Finder(samples))]
    return _KEPT[0][1]


_LINES = ("h1", "h2", "p", "small", "noscript")
_ASCII_WORD = re.compile(r"(?<![^\x00-\x7f])[a-z]+(?![^\x00-\x7f])")


def _near(page: Page, a: int, b: int) -> bool:
    """Siblings a and b with only headings and lines of text between them."""
    box = page.parents[a]
    lo, hi = sorted((a, b))
    return all(page.parents[i] != box or page.names[i] is None or page.names[i] in _LINES for i in range(lo, hi + 1))


def residue_nodes(nodes: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(page_id, node_id, kind): text nodes with or made of residue, those of title
    included. Null, empty and blank contents are none; repeated rows count once;
    code samples and text of script and style are never residue."""
    samples = nodes.sparkSession.sparkContext.broadcast(sample_counts(lang_samples))

    def rows(pages: Iterator[Page]):
        finder = Finder(samples.value)
        for page in pages:
            for i, kind in finder.find(page).items():
                yield page.page_id, page.ids[i], kind

    return map_pages(page_chunks(nodes, attributes=False), rows, "page_id bigint, node_id int, kind string")


def residue_free_pages(nodes: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(page_id, text): what is left of each page without residue, its texts in
    document order, one per line; a page made of residue alone gives no row."""
    samples = nodes.sparkSession.sparkContext.broadcast(sample_counts(lang_samples))

    def rows(pages: Iterator[Page]):
        finder = Finder(samples.value)
        for page in pages:
            texts = finder.texts(page)
            bad = finder.find(page, texts)
            kept = [texts[i].strip() for i in texts if i not in bad and page.in_body[i]]
            if any(kept):
                yield page.page_id, "\n".join(t for t in kept if t)

    return map_pages(page_chunks(nodes, attributes=False), rows, "page_id bigint, text string")
