"""Problem 5: personal information in free text, found and replaced.

Values are found by what a language says about a person: cues before or after a name, labels before a number, verbs before
an address; then by a general layer (``phrasing``) of introductions, greetings, labels and of values' own shapes. A text is first
brought to one form with a map back to its stored positions, so that zero-width, full-width and look-alike characters hide
nothing. A last pass finds further mentions of the names of the same text.

Each found value is an entity of its text and gets a keyed surrogate of its own type, script and format (``surrogates``) and a typed
placeholder with the number of the entity; every result here is read from :func:`entities`.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.lookalike import CYRILLIC, GREEK, HYPHENS
from veilspark.llm.phrasing import Index, alternatives, general, in_bytes, phrase_words, word_of
from veilspark.llm.surrogates import Surrogates
from veilspark.session import spread

KINDS = ("person_name", "email", "phone", "number", "postal_address")


class _Forms(dict):
    def __missing__(self, ch: str) -> str:
        form = "" if unicodedata.category(ch) == "Cf" else unicodedata.normalize("NFKC", ch).translate(HYPHENS)
        form = "".join(CYRILLIC.get(c) or GREEK.get(c) or c for c in form)
        if form != "\n" and form.isspace():
            form = " "
        self[ch] = form
        return form


_FORMS = _Forms()
_MARKS = re.compile("[\u0300-\u036f\u3099\u309a]")
#: Characters that may have another form: not those that most texts are made of.
_ODD = re.compile("[^\n -~À-ÖØ-öø-ÿ、。ぁ-ゖァ-ヺー一-鿿가-힣]")
_HIDDEN = re.compile("[\u00ad\u0370-\u052f\u061c\u180e\u200b-\u200f\u2010\u2011\u202a-\u202e\u2060-\u206f\ufeff]")


def legible(text: str) -> tuple[str, list[int] | None]:
    """The text in one form, and the stored position of each of its characters (None: the same)."""
    if text.isascii() or (unicodedata.is_normalized("NFKC", text) and not ("\u00ad" in text if in_bytes(text) is not None else _HIDDEN.search(text))):
        return text, None
    odd = set(_ODD.findall(text))
    if not _MARKS.search("".join(odd)):
        if all(len(_FORMS[ch]) == 1 for ch in odd):
            return _ODD.sub(lambda m: _FORMS[m[0]], text), None
        parts, at, last = [], [], 0
        for m in _ODD.finditer(text):
            i, form = m.start(), _FORMS[m[0]]
            parts += [text[last:i], form]
            at += range(last, i)
            at += [i] * len(form)
            last = i + 1
        return "".join([*parts, text[last:]]), [*at, *range(last, len(text))]
    parts = [_FORMS[ch] for ch in text]
    last = -1
    for i, ch in enumerate(text):
        if _MARKS.match(ch) and last >= 0:
            parts[last], parts[i] = unicodedata.normalize("NFC", parts[last] + ch), ""
        elif parts[i]:
            last = i
    form = "".join(parts)
    if len(form) == len(text) and "" not in parts:
        return form, None
    return form, [i for i, part in enumerate(parts) for _ in part]


#: Accents that a writer may leave out, letter for letter.
FOLD = str.maketrans({c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xC0, 0x17F)) if len(unicodedata.normalize("NFD", c)) > 1})


_ACCENTED = re.compile("[\u00c0-\u017e]")
#: The same for texts that fit into a code page, byte by byte; in the first 256 characters accents are where they are in the page.
_PAGE = bytes(ord(base) if (base := chr(FOLD[ord(ch)]) if isinstance(FOLD.get(ord(ch)), int) else FOLD.get(ord(ch), "")) else b for b in range(256) for ch in [bytes([b]).decode("cp1252", "replace")])


_BYTES = bytes(range(0xC0)) + _PAGE[0xC0:]


def unaccented(form: str) -> str:
    if form.isascii():
        return form
    if (page := in_bytes(form)) is not None:
        return page.translate(_BYTES).decode("latin-1")
    try:
        return form.encode("cp1252").translate(_PAGE).decode("cp1252")
    except UnicodeError:
        return _ACCENTED.sub(lambda m: FOLD.get(ord(m[0]), m[0]), form)


_LOWER = bytes(ord(chr(b).lower()) for b in range(256))


def lowered(form: str) -> str:
    """``form.lower()``, sooner where a byte a character suffices."""
    if form.isascii() or (page := in_bytes(form)) is None:
        return form.lower()
    return page.translate(_LOWER).decode("latin-1")


# ---- what a value looks like -------------------------------------------------------------------------------------

UP = "A-ZÀ-ÖØ-ÞŒŠŽ"
#: A word of a name: an initial, or a capitalised word with further parts after hyphens or apostrophes.
WORD = rf"(?-i:(?:(?:[dD]['’]|O['’]|Mc)?[{UP}](?:\.(?:[ ]?-?[{UP}]\.)*|[^\W\d_]+(?:[-'’][^\W\d_]+)*)))"
NOT_STREET = r"(?!(?:calle|c/|avda|avenida|paseo|plaza|pza|flat|unit|apt|via|viale|v\.le|piazza|p\.za|corso|c\.so|rue|avenue|av|bd|boulevard|place|chemin|allée|impasse|quai|largo|vicolo|strada|ronda|camino|carrer|travesía|apartment|suite|house)\b)"
LATIN_NAME = rf"{WORD}(?:[ ]{{1,3}}{WORD}){{0,4}}(?:,[ ]{{1,3}}{NOT_STREET}{WORD}(?:[ ]{{1,3}}{WORD}){{0,2}})?"
LATIN_ONLY = rf"{WORD}(?:[ ]{{1,3}}{WORD}){{0,4}}"
HAN = "一-鿿々〆ヶ"
CJK_NAME = {
    "ja": rf"(?:[{HAN}]{{1,4}}[ ]{{0,2}}[{HAN}ぁ-んァ-ヴー]{{1,4}}?|[ァ-ヴー]{{2,8}}[・ ]?[ァ-ヴー]{{0,8}}?)",
    "zh": r"[一-鿿](?:[ ]?[一-鿿]){1,3}?",
    "ko": r"[가-힣](?:[ ]?[가-힣]){1,4}?",
}
AT = r"(?:[ ]?@[ ]?|[ ]?[\[(][ ]?(?:at|arroba|chiocciola|AT)[ ]?[\])][ ]?)"
DOT = r"(?:\.|[ ]?[\[(][ ]?(?:dot|punto|punkt|point|DOT)[ ]?[\])][ ]?)"
EMAIL = re.compile(rf"(?<![\w.%+-])([\w%+-]+(?:{DOT}[\w%+-]+)*){AT}([a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?(?:{DOT}[a-zA-Z0-9-]+)+)", re.ASCII)
_AT = re.compile(r"[@\[(](?:(?<=@)|(?<!@) ?(?i:at|arroba|chiocciola) ?[\])])")
_BRACKET = re.compile(r"[\[\]()]")
# Mailboxes of a role.
ROLES = frozenset(
    "info contact contacto kontakt contatti contatto support soporte supporto assistenza atencion atención accueil office buero büro service servizio servicio admin sales ventas vendite help helpdesk hello hola mail post noreply no-reply postmaster webmaster press presse prensa stampa hr jobs billing rechnung reception empfang recepcion segreteria secretariat sekretariat enquiries inquiries anfrage".split()
)
PHONE = r"(?:\(?[ ]?\+|\(|00)?[ ]?[(]?\d(?:[ ()./-]{0,3}\d){6,17}"
#: A number of an identity, card or account: letters and digits in groups, at least four digits.
NUMBER = r"(?-i:(?=(?:[^\d\n,;()]{0,14}\d){4})[A-Z0-9](?:[ ./-]{0,2}[A-Z0-9])*)"

# ---- what stands around it, by language ----------------------------------------------------------------------------
# before: cues that a name follows; after: cues that follow a name; phone, address: cues before the value; label: what stands
# between a name and a number; titles: words before a name that aren't part of it. In the cues a blank is any white space.

CUES: dict[str, dict[str, str]] = {
    "en": {
        "before": r"you can reach |the address for |the sheet on |the file says |holder: |account holder: |links |name: |patient: |contact: |signed by |call |born to |on behalf of ",
        "after": r" confirmed the | wrote from | ?, holder of | asked for [^.\n]+? and left the number | is on the list for | mentions | \((?:ssn|passport|licence|card|account|member)",
        "to": r" to ",
        "phone": r"left the number |reach [^\n]+?\bon |phone: |tel\.?:? |mobile: |call (?:me |him |her |them )?(?:at|on) ",
        "address": r"lives at |living at |address: ",
        "label": r"ssn|passport(?: no\.?)?|licence(?: no\.?)?|license(?: no\.?)?|card(?: no\.?)?|account(?: no\.?)?|member no\.?|id(?: no\.?)?|national insurance(?: no\.?)?|iban",
        "titles": "mr mrs ms miss dr prof sir mx",
    },
    "de": {
        "before": r"die adresse von |laut akte wird |das blatt zu |inhaber(?:in)?: |bringt |name: |ansprechpartner(?:in)?: ",
        "after": r" schrieb von | bestätigte den termin | steht auf der liste | ist ab \d| bat um [^.\n]+? und hinterließ | ?, (?:ausweis|konto|karte|steuer|mitglied|führerschein|reisepass|pass-)| \((?:ausweis|konto|karte|steuer|mitglied|führerschein|reisepass|pass-)",
        "to": r" an ",
        "phone": r"hinterließ die nummer |ist ab [\d.:]+ uhr unter |telefon: |tel\.?:? |mobil: ",
        "address": r"wohnt in (?:der |dem |den )?|wohnhaft |anschrift: ",
        "label": r"steuer-id(?:-nr\.?)?|ausweis-?(?:nr\.?)?|konto(?:-?nr\.?)?|karte(?:n-?nr\.?)?|mitglieds?-?(?:nr\.?)?|mitglied|führerschein(?:-?nr\.?)?|reisepass(?:-?nr\.?)?|pass-?nr\.?|iban|sozialversicherungs-?nr\.?",
        "titles": "herr frau hr fr dr prof",
    },
    "fr": {
        "before": r"l['’]adresse de |on peut joindre |selon le dossier, |la fiche de |titulaire ?: |(?:relie|associe|lie) |nom ?: ",
        "after": r" ?, titulaire d| a écrit depuis | figure sur la liste | a demandé [^.\n]+? et laissé le numéro | a confirmé la visite | est suivie? pour | cite ",
        "to": r" à ",
        "phone": r"laissé le numéro |joindre [^\n]+? au |téléphone ?: |tél\.? ?:? ",
        "address": r"habite (?:au |à |dans )?|domiciliée? (?:au |à )?|adresse ?: ",
        "label": r"n[°o]\.? d['’]adhérent|passeport(?: n[°o]\.?)?|nir|carte(?: n[°o]\.?)?|compte(?: n[°o]\.?)?|permis(?: n[°o]\.?)?|iban|n[°o]\.? de (?:membre|client|sécurité sociale|permis|passeport|compte|carte)",
        "titles": "m mme mlle dr me pr mm",
    },
    "es": {
        "before": r"pueden llamar a |el correo de |escribió |la ficha de |consta que |titular: |atribuye a |nombre: ",
        "after": r" confirmó la cita | figura en la lista | pidió [^.\n]+? y dejó el teléfono | ?, con (?:n\.?[ºo°]|dni|nie|pasaporte|cuenta|tarjeta|carn)| menciona | sigue un tratamiento",
        "to": r" a ",
        "phone": r"dejó el teléfono |llamar a [^\n]+? al |teléfono: |tel\.?:? |móvil: ",
        "address": r"vive en |domicilio: |reside en ",
        "label": r"n\.?[ºo°]\.? de socio|pasaporte(?: n\.?[ºo°])?|dni|nie|cuenta(?: n\.?[ºo°])?|tarjeta(?: n\.?[ºo°])?|iban|carn[ée]t?(?: de conducir)?(?: n\.?[ºo°])?|permiso(?: n\.?[ºo°])?|n\.?[ºo°] de (?:cliente|cuenta|tarjeta|pasaporte)",
        "titles": "sr sra srta d dña dª dr dra don doña d.ª",
    },
    "it": {
        "before": r"si può chiamare |l['’]indirizzo di |la scheda di |intestatari[oa]: |(?:collega|associa|lega) |nome: |dal [\d/]+ |dal \d+ \w+ \d+ |dal(?:l['’])?\d+[°º]? \w+ \d+ ",
        "after": r" ha scritto da | è nella lista | ha confermato la visita | ha chiesto [^.\n]+? e lasciato il numero | ?, (?:codice fiscale|tessera|passaporto|conto|carta|patente)| cita | è in cura",
        "to": r" a ",
        "phone": r"lasciato il numero |chiamare [^\n]+? al |telefono: |tel\.?:? |cellulare: ",
        "address": r"abita in |residente in |indirizzo: ",
        "label": r"codice fiscale|tessera(?: n\.?)?|passaporto(?: n\.?)?|conto(?: n\.?)?|carta(?: n\.?)?|patente(?: n\.?)?|iban",
        "titles": "sig sig.ra sigra dott dott.ssa avv ing prof prof.ssa dr",
    },
    "pt": {
        "before": r"o e-?mail de |escreveu |a ficha de |consta que |titular: |atribui a |nome: |ligar (?:a|para) ",
        "after": r" confirmou a | figura na lista | pediu [^.\n]+? e deixou o | ?, com (?:n\.?[ºo°]|cc|nif|passaporte|conta|cartão)",
        "to": r" (?:a|para) ",
        "phone": r"deixou o (?:telefone|número) |ligar (?:a|para) [^\n]+? (?:ao|no) |telefone: ",
        "address": r"mora (?:em|na|no) |vive (?:em|na|no) |reside (?:em|na|no) ",
        "label": r"n\.?[ºo°] de sócio|passaporte(?: n\.?[ºo°])?|nif|cc|conta|cartão|iban",
        "titles": "sr sra d dr dra eng",
    },
}
SEND = {"en": "ship|send|mail|forward", "de": "bitte|senden sie|schicken sie", "fr": "envoyer|expédier|adresser", "es": "enviar|mandar|remitir", "it": "inviare|spedire|mandare", "pt": "enviar|mandar|remeter"}
STOP = {
    "en": "the of to at in is on for and was from by i you my with this please".split(), "de": "der die das den und in von auf nach ist um zu mit mich bitte sie ich geehrte".split(), "fr": "le la les de du à a est pour et sur au je vous une avec".split(),
    "es": "el la los de del en a que con y por al su es mi para".split(), "it": "il la lo di del in a che per ha e al ho con grazie gentile saluti".split(), "pt": "o a os as do da em que com e por ao".split(),
}
STRONG = {
    "en": {"the", "of", "at", "for", "from"}, "de": {"der", "die", "das", "den", "und", "um"}, "fr": {"le", "les", "du", "à", "est", "sur"}, "es": {"el", "los", "y", "con", "las"},
    "it": {"il", "di", "ha", "che", "è", "lo"}, "pt": {"o", "os", "do", "da", "em", "ao", "não"},
}


_HAN, _KANA, _HAN_ONLY, _HANGUL = (re.compile(f"[{r}]+") for r in ("\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3", "\u3040-\u30ff", "\u4e00-\u9fff", "\uac00-\ud7a3"))


#: Words of labels that Japanese alone writes this way, for texts without kana.
_JA_WORDS = re.compile("名義|旅券番号|会員番号|口座|氏名|様宛|番地|丁目")


def language(form: str) -> str:
    """The language whose cues fit: by script, then by commonest words. Labels of rows are not relied upon."""
    return judged_language(form)[0]


def judged_language(form: str) -> tuple[str, int]:
    """The language, and how many of its common words speak for it; 0 if nothing does."""
    if not form.isascii() and in_bytes(form) is None and _HAN.search(form):
        kana, han, hangul = (sum(map(len, r.findall(form))) for r in (_KANA, _HAN_ONLY, _HANGUL))
        if (kana + han + hangul) * 6 > len(form):
            return "ko" if hangul > kana + han else "ja" if kana * 8 > han or not kana and _JA_WORDS.search(form) else "zh", kana + han + hangul
    said = list(map(_SAYS.__getitem__, filter(_SAYS.__contains__, lowered(form).split())))
    n = [0] * len(STOP)
    for k in range(0, len(said), 500):  # so many words that no count needs more bits
        part = sum(said[k : k + 500])
        n = [had + (part >> at & 1023) for had, at in zip(n, _AT_BITS, strict=True)]
    most = max(n)
    return list(STOP)[n.index(most)], most


_STOP_OF: dict[str, list[tuple[str, int]]] = {}
for _one, _words in STOP.items():
    for _w in {*_words, *STRONG[_one]}:
        _STOP_OF.setdefault(_w, []).append((_one, 2 if _w in STRONG[_one] else 1))
#: The same as one number a word, with ten bits for each language.
_AT_BITS = range(0, 10 * len(STOP), 10)
_SAYS = {w: sum(words << 10 * list(STOP).index(one) for one, words in said) for w, said in _STOP_OF.items()}

#: Start of a sentence or a clause, in scripts without spaces between words.
EDGE = r"(?:(?<=^)|(?<=[。!?\n,、:;」』”’\"'.!?…]))[ ]{0,2}"
MAIL = r"[\w.%+ -]++(?:@|\(at\)|\[at\])"
DAY = r"(?:\d{4}年\d{1,2}月\d{1,2}日|\d{4}[./-] ?\d{1,2}[./-] ?\d{1,2}|\d{4}년 ?\d{1,2}월 ?\d{1,2}일)"
_JA, _ZH, _KO = CJK_NAME["ja"], CJK_NAME["zh"], CJK_NAME["ko"]
JA_LABEL, ZH_LABEL, KO_LABEL = "口座(?:番号)?|会員番号|旅券番号|マイナンバー|カード(?:番号)?|免許(?:証)?番号|個人番号", "身份证号?码?|账号|会员号|护照号?码?|卡号|驾驶证号?", "여권번호|회원번호|주민번호|주민등록번호|계좌(?:번호)?|카드(?:번호)?|면허번호"
CJK = {
    "ja": {
        "name": [
            rf"(?:名義|担当|氏名|契約者|連絡先)[:：][ ]?(?P<n>{_JA})(?=[(（\n]|が{DAY}|$)",
            rf"(?:主任|講師|課長|部長|係長|店長|教授|先生|担当)[ ]?(?P<n>{_JA})(?=が{DAY})",
            rf"記録では(?P<n>{_JA})が(?={DAY})",
            rf"報告[ ]?[\w./-]+は(?P<n>{_JA})と(?=[^。\n]{{1,20}}結びつ)",
            rf"以降、(?P<n>{_JA})(?=(?:様|さん|氏)は)",
            rf"{EDGE}(?P<n>{_JA})(?=さんの連絡先|さんが[^。\n]{{1,20}}求め|は{MAIL}|の票に|[(（][ ]?(?:{JA_LABEL})|は[^。\n、]{{1,8}}[市町村区]の(?!事務所|担当|窓口))",
            rf"は(?P<a>[^。\n、は]{{4,}}?)[ ]{{1,2}}(?P<n>{_JA})(?=様宛)",
        ],
        "address": [rf"[)）]は(?P<a>[^。\n]{{4,}}?)に住む", r"住所[:：][ ]?(?P<a>[^\n]{4,})"],
        "number": [rf"(?:{JA_LABEL})[ ]?[:：]?[ ]?(?P<v>{NUMBER})"],
        "phone": [rf"(?:様|さん|氏)は(?P<v>{PHONE})(?=で連絡)", rf"求め、(?P<v>{PHONE})(?=を残)", rf"電話[:：][ ]?(?P<v>{PHONE})"],
    },
    "zh": {
        "name": [
            rf"(?:户主|经办人|姓名|联系人|持卡人)[:：][ ]?(?P<n>{_ZH})(?=[(（\n]|确认了|$)",
            rf"(?:组长|讲师|主任|经理|老师|教授|科长|主管)[ ]?(?P<n>{_ZH})(?=确认了{DAY})",
            rf"档案记载(?P<n>{_ZH})(?=自{DAY})",
            rf"报告[ ]?[\w./-]+把(?P<n>{_ZH})(?=与)",
            rf"找(?P<n>{_ZH})(?=女士|先生)",
            rf"请寄(?P<a>[^。\n,，]{{4,}}?)[,，][ ]?(?P<n>{_ZH})(?=收)",
            rf"{EDGE}(?P<n>{_ZH})(?=的邮箱|从{MAIL}|的表中|申请了|列在|[(（][ ]?(?:{ZH_LABEL}))",
        ],
        "address": [rf"[)）]住在(?P<a>[^。\n]{{4,}})", r"住址[:：][ ]?(?P<a>[^\n]{4,})"],
        "number": [rf"(?:{ZH_LABEL})[ ]?[:：]?[ ]?(?P<v>{NUMBER})"],
        "phone": [rf"可拨[ ]?(?P<v>{PHONE})(?=[ ]?找)", rf"留下电话[ ]?(?P<v>{PHONE})", rf"电话[:：][ ]?(?P<v>{PHONE})"],
    },
    "ko": {
        "name": [
            rf"(?:명의|성명|담당자)[:：][ ]?(?P<n>{_KO})(?=[ ]?[(（\n]|$)",
            rf"(?:담당|강사|팀장|과장|부장|교수|주임|실장)[ ]?(?P<n>{_KO})[이가](?=[ ]{DAY})",
            rf"기록에는 (?P<n>{_KO})[이가](?=[ ]{DAY})",
            rf"보고 ?[\w./-]+?[은는] (?P<n>{_KO})[과와](?=[ ])",
            rf"이후 (?P<n>{_KO})(?=[ ]?(?:씨|님)[은는])",
            rf"[은는] (?P<a>[^.\n은는]{{4,}}?), (?P<n>{_KO})(?= 앞으로)",
            rf"{EDGE}(?P<n>{_KO})(?=[ ]?(?:님의|님이|씨가|씨는|씨의)|의 기록에|[ ]?[(（][ ]?(?:{KO_LABEL})|[은는] [가-힣]{{1,6}}[시군구읍면동]의 )",
        ],
        "address": [rf"[)）][은는] (?P<a>[^.\n]{{4,}}?)에 산다", r"주소[:：][ ]?(?P<a>[^\n]{4,})"],
        "number": [rf"(?:{KO_LABEL})[ ]?[:：]?[ ]?(?P<v>{NUMBER})"],
        "phone": [rf"(?:씨|님)[은는] (?P<v>{PHONE})(?=[ ]?으?로)", rf"요청하고 (?P<v>{PHONE})(?=[을를] )", rf"전화[:：][ ]?(?P<v>{PHONE})"],
    },
}


_LEAD = re.compile(r"\\s\{(\d),(\d)\}(?=[^\\\[(.?*+{|]|\\\()")


def _led(cue: re.Pattern, least: int, most: int, text: str) -> Iterator[int]:
    """Where a cue begins with the blanks before it, of which there must be some number. Sought by the cue, as blanks are everywhere."""
    at = floor = 0
    while m := cue.search(text, at):
        a = b = m.start()
        while a > floor and b - a < most and text[a - 1].isspace():
            a -= 1
        if b - a < least:
            at = b + 1
        else:
            yield a
            at = floor = m.end()


def _blank(cue: str) -> str:
    return cue.translate(FOLD).replace(" ?", "\x00").replace(" ", r"\s{1,3}").replace("\x00", r"\s{0,2}")


class Cue(NamedTuple):
    """What a cue says of what follows it (``tail``) or, of kind ``after``, of what stands before it. A cue is sought in the text in small
    letters, unless it is ``cased``; its tail is read from where it ends. ``edge`` are characters that may not stand before it.
    ``lead`` is the least and the most number of blanks before a cue ``after``, which aren't in its pattern."""

    what: str
    word: str
    cue: re.Pattern
    tail: re.Pattern | None = None
    edge: str = "\0"
    cased: bool = False
    lead: tuple[int, int] = (0, 0)


def _after(word: str, cue: re.Pattern) -> Cue:
    """A cue of kind ``after``; its first blanks are counted apart."""
    if m := _LEAD.match(cue.pattern):
        return Cue("after", word, re.compile(cue.pattern[m.end() :]), lead=(int(m[1]), int(m[2])))
    return Cue("after", word, cue)


@cache
def grammar(lang: str) -> list[Cue]:
    """The cues of a language; ``word`` must be in a text for one to match."""
    if lang in CJK:
        return [Cue({"address": "postal_address"}.get(k, k), "", re.compile(p, re.MULTILINE), cased=True) for k, v in CJK[lang].items() for p in v]
    c = {k: [(word_of(plain), re.compile(_blank(one))) for plain, one in alternatives(v.translate(FOLD))] for k, v in CUES[lang].items() if k != "titles"}
    titles = sorted(CUES[lang]["titles"].translate(FOLD).split(), key=len, reverse=True)
    spoken = "|".join(re.escape(t.capitalize()) for t in titles if len(t) > 1)
    title = r"(?:(?:" + "|".join(map(re.escape, titles)) + r")\b\.?[ ]{0,3}){0,2}"
    street = rf"(?P<a>(?=[^\n;]*?\d)[^\s,;.](?:[^\n;.]|\.(?![ ]{{1,3}}(?-i:[{UP}¿¡«\"„“'])|\s*\n|$)|(?<=\bavda)\.|(?<=str)\.|(?<=\bst)\.|(?<=\bp)\.|(?<=\bv)\.|(?<=\bc)\.|(?<=\bn)\.|(?<=\bint)\.|(?<=\bappt)\.)*)"
    of = lambda pattern: re.compile(pattern, re.IGNORECASE)
    named, called, where, number, phone = of(rf"(?:{title})(?P<n>{LATIN_NAME})"), of(rf"(?:(?-i:{spoken})\b\.?[ ]{{1,3}})?(?P<n>{LATIN_ONLY})"), of(street), of(rf"[ ]?:?[ ]{{0,3}}(?P<v>{NUMBER})"), of(rf"(?P<v>{PHONE})")
    to = "|".join(_blank(one) for _, one in alternatives(CUES[lang]["to"].translate(FOLD)))
    sent = of(rf"\b[^.\n]{{3,}}?(?:{to})(?:{title})(?P<n>{LATIN_NAME}),\s{{1,3}}{street}")
    return [
        *(Cue("name", word, cue, named) for word, cue in [*c["before"], ("report", re.compile(r"report [\w./-]+ links "))]),
        *(_after(word, cue) for word, cue in c["after"]),
        *(Cue("titled", word_of(t), re.compile(rf"{re.escape(t.capitalize())}\b\.?[ ]{{1,3}}"), called, "@.+-", True) for t in titles if len(t) > 1),
        *(Cue("name", word_of(one), re.compile(one), sent) for one in SEND[lang].translate(FOLD).lower().split("|")),
        *(Cue("address", word, cue, where) for word, cue in c["address"]),
        *(Cue("number", word, cue, number, "-") for word, cue in c["label"]),
        *(Cue("phone", word, cue, phone) for word, cue in c["phone"]),
    ]


_NAME = re.compile(rf"(?P<n>{LATIN_NAME})", re.IGNORECASE)
#: Where a name may begin: a capital, or the small letter of a prefix, that no word goes on with.
_NAME_STARTS = re.compile(rf"(?<![\w@.+-])(?:[{UP}]|d['’])")
#: A stretch without what no name has in it.
_MAY_NAME = re.compile(r"[^\n\d_:;()\[\]{}!?\"„“”«»/@#&*+]*")

_WORDS = re.compile(r"[^\s,]+")
_FIRM = re.compile(r"(?:\b[A-Z]\.){2,}[ ]+|\b(?:Inc|Ltd|Coop|Corp)\.[ ]+")
_LAST = re.compile(r"[ ,]+([^\s,]+)$")
#: Words of the cues of a language, which end a name written in capitals with them.
_AROUND = {k: {w for part in ("before", "after") for w in re.findall(r"[a-z]{2,}", c[part].translate(FOLD))} for k, c in CUES.items()}


def _untitled(form: str, start: int, end: int, titles: frozenset[str]) -> int:
    """Start of a name without the titles before it; one-letter titles are judged later, as they may be initials."""
    if form[start] != "," and not form[start].isspace():  # mostly there is none
        first = form[start:end].replace(",", " ").split(None, 1)[0]
        if first.rstrip(".").lower() not in titles and first.lower() not in titles:
            return start
    for m in _WORDS.finditer(form, start, end):
        if len(m[0].rstrip(".")) > 1 and m[0].rstrip(".").lower() in titles or m[0].lower() in titles and len(m[0]) > 2:
            continue
        return m.start()
    return start


@cache
def _index(lang: str) -> Index:
    return Index([one.word for one in grammar(lang)], phrase_words(lang))


@cache
def _titles(lang: str) -> frozenset[str]:
    return frozenset(CUES[lang]["titles"].translate(FOLD).split()) if lang in CUES else frozenset()


def detect(form: str, lang: str | None = None) -> list[tuple[str, int, int]]:
    """(finding type, start, end) in a legible text, in order, none inside another of its type."""
    lang = lang or language(form)
    rules, titles = grammar(lang), _titles(lang)
    accented = form
    if titles:
        form = unaccented(form)
    lower = lowered(form)
    small = lower if len(lower) == len(form) else "".join(c.lower() if len(c.lower()) == 1 else c for c in form)
    out: dict[tuple[str, int], int] = {}
    names: dict[int, int] = {}
    starts: dict[int, int] = {}

    def name(start: int, end: int) -> int:
        if titles:
            if "." in form[start:end]:
                for m in _FIRM.finditer(form, start, end):  # a company's legal form ends the sentence before
                    start = m.end()
            start = _untitled(form, start, end, titles)
            while (last := form[start:end].replace(",", " ").rsplit(None, 1))[1:]:  # words of the sentence, where it is all in capitals
                if last[1].lower() not in _STOP_OF and last[1].lower() not in _AROUND[lang]:
                    break
                end = start + len(last[0])
            if form[start:end].lower() in _STOP_OF:
                return start
        if end > names.get(start, -1):
            names[start] = end
        return start

    able, hits = _index(lang).able(small)
    for k in able:
        what, _, cue, tail, edge, cased, lead = rules[k]
        if what == "after":  # the name is what ends there
            for at in _led(cue, *lead, small):
                if m := _ending(form, at):
                    name(*m.span("n"))
            continue
        for m in cue.finditer(form if cased else small):
            if tail is not None:
                before = form[m.start() - 1] if m.start() else " "
                if before.isalnum() or before == "_" or before in edge or not (m := tail.match(form, m.end())):
                    continue
            if what in ("name", "titled"):
                start = name(*m.span("n"))
                if titles:
                    starts[m.end("n")] = max(starts.get(m.end("n"), 0), start)
                if "a" in m.re.groupindex and m["a"] and _DIGIT.search(m["a"]):
                    start, end = _address(small, *m.span("a")) if titles else m.span("a")
                    out["postal_address", start] = end
                continue
            kind, group = ("postal_address", "a") if what in ("address", "postal_address") else (what, "v")
            start, end = m.span(group)
            if kind == "postal_address" and titles:
                start, end = _address(small, start, end)
            if end > out.get((kind, start), -1):
                out[kind, start] = end
    mails = []
    if "@" in form or "(" in form or "[" in form:
        for hit in _AT.finditer(form):
            if mails and hit.start() < mails[-1][1]:
                continue
            if m := _mail(form, hit, mails[-1][1] if mails else 0):
                mails.append(m.span())
                if m[1].lower() not in ROLES:
                    out["email", m.start()] = m.end()
    for a, b in list(names.items()):  # a name read from its end can't reach back over a cue
        if starts.get(b, a) > a:
            del names[a]
            names[starts[b]] = b
    # one-letter titles: an initial if the text has a person whose given name begins with it and whose surname follows
    if titles:
        known = None
        for a, b in list(names.items()):
            if form[a + 1 : a + 2] != ".":
                continue
            if known is None:
                known = [form[a:b].casefold() for a, b in names.items()]
            first = _WORDS.match(form, a, b)
            if first and len(first[0]) == 2 and first[0][1] == "." and first[0][0].lower() in titles and b > first.end() + 1:
                letter, rest = first[0][0].lower(), form[first.end() : b].casefold().replace("-", " ").split()
                full = [k.replace("-", " ").replace(",", " ").split() for k in known]
                if not any(len(k) > 1 and any(len(w) > 2 and w[0] == letter for w in (k[0], k[-1])) and rest[0] in k[-2:] + k[1:] + k[:1] for k in full if len(k[0]) > 2):
                    del names[a]
                    start = first.end() + len(form[first.end() : b]) - len(form[first.end() : b].lstrip())
                    names[start] = max(b, names.get(start, -1))
    # a stretch found twice counts once
    kept: list[tuple[int, int]] = []
    for a, b in sorted(names.items()):
        if kept and a < kept[-1][1]:
            continue
        kept.append((a, b))
    taken = bytearray(len(form))
    for a, b in [*kept, *mails, *((a, b) for (_, a), b in out.items())]:
        taken[a:b] = b"\1" * (b - a)
    for kind, a, b in general(accented, small, lang, taken, hits):
        if 1 not in taken[a:b]:
            taken[a:b] = b"\1" * (b - a)
            if kind == "person_name":
                kept.append((a, b))
            else:
                out[kind, a] = b
    # further mentions of the same names: whole words, and short ones in the same case
    if len(lower) == len(form):
        for one in {form[a:b] if b - a <= 4 and lang not in CJK else lower[a:b] for a, b in kept if b - a > (2 if lang in CJK else 1)}:
            text = form if len(one) <= 4 and lang not in CJK else lower
            at = text.find(one)
            while at >= 0:
                end = at + len(one)
                whole = lang in CJK or not ((at and (text[at - 1].isalnum() or text[at - 1] in "@-_.+")) or (end < len(text) and (text[end].isalnum() or text[end] in "@-_+")))
                if whole and 1 not in taken[at:end]:
                    kept.append((at, end))
                    taken[at:end] = b"\1" * (end - at)
                at = text.find(one, end)
    return sorted([*[("person_name", a, b) for a, b in kept], *[(k, a, b) for (k, a), b in out.items()]], key=_ORDER)


_ORDER = itemgetter(1, 0)
_DIGIT = re.compile(r"\d")
_ARTICLE = re.compile(r"(?:the|der|dem|den|le|la|les|el|los|las|il|lo|the) ")
_AND = re.compile(r" (?:and|und|et|y|e|with|mit|avec|con) [a-z]")


def _address(small: str, start: int, end: int) -> tuple[int, int]:
    """A stretch with an address, without the article before it and without what the sentence goes on to say."""
    if m := _ARTICLE.match(small, start, end):
        start = m.end()
    for m in _AND.finditer(small, start, end):
        if any(ch.isdigit() for ch in small[start : m.start()]):
            return start, m.start()
    return start, end


def _ending(form: str, at: int) -> re.Match | None:
    """The longest name that ends at a place. The stretch looked at grows until the name lies inside it."""
    wide = 80
    while True:
        start = max(0, at - wide)
        begin = at - _MAY_NAME.match(form[start:at][::-1]).end()
        m = None
        for first in _NAME_STARTS.finditer(form, begin, at):
            if m := _NAME.fullmatch(form, first.start(), at):
                break
        if not start or begin > start or not m or m.start() > start + 40:
            return m
        wide *= 4


def _mail(form: str, hit: re.Match, least: int) -> re.Match | None:
    """The address around an at sign. The stretch looked at grows until the address lies inside it."""
    wide = 80
    while True:
        a, b = max(least, hit.start() - wide), min(len(form), hit.end() + wide)
        begin = form.rfind(" ", a, hit.start()) + 1
        if begin <= a or begin == hit.start() or form[begin - 2] in "])" or hit[0] != "@" or _BRACKET.search(form, begin, hit.start()):
            begin = a  # blanks may be part of the address
        m = None
        for one in EMAIL.finditer(form, begin, b):
            if one.end() > hit.end():
                m = one
                break
        if a == least and b == len(form) or m and (a < m.start() or a == least) and (m.end() < b or b == len(form)) or not m and wide > 80 and not form[hit.start() - wide : hit.start()].strip():
            return m
        if not m and re.search(r"\s\S*\s", form[a : hit.start()]) and re.search(r"\s\S*\s", form[hit.end() : b]):
            return None
        wide *= 4


def _detected(text: str) -> tuple[list[tuple[str, int, int, str]], str]:
    """(finding type, start, end, value in its legible form) in the stored text, and the language."""
    form, at = legible(text)
    lang = language(form)
    found = detect(form, lang)
    return [(k, a, b, form[a:b]) if at is None else (k, at[a], at[b - 1] + 1, form[a:b]) for k, a, b in found], lang


def findings(text: str | None) -> list[tuple[str, int, int]]:
    """(finding type, start, end) in the stored text; none for a null or empty text."""
    return [(k, a, b) for k, a, b, _ in _detected(text)[0]] if text else []


# ---- replacement ---------------------------------------------------------------------------------------------------

PLACE = {"person_name": "PERSON", "email": "EMAIL", "phone": "PHONE", "number": "NUMBER", "postal_address": "ADDRESS"}
_TITLE = re.compile(r"([\w.]+)[ ]+$")


def _title(before: str) -> str:
    """The word that ends a stretch of text but for blanks after it."""
    if before[-1:] not in (" ", "\n"):
        return ""
    last = before.rstrip(" ")
    word = last[last.rfind(" ") + 1 :]
    if word.replace(".", "a").isalpha():
        return word
    title = _TITLE.search(before)
    return title[1] if title else ""


def entities(text: str | None, key: str) -> tuple[list[tuple[str, int, int, str, str]], Surrogates | None]:
    """(finding type, start, end, value in its legible form, surrogate) of each value in the stored text, in order, and the surrogates
    of the text, which also number its entities (none without values). All mentions of an entity agree."""
    found, lang = _detected(text) if text else ([], "")
    if not found:
        return [], None
    names = Surrogates(key, lang)
    people = [f for f in found if f[0] == "person_name"]
    for _, a, _, value in sorted(people, key=lambda f: f[1] - f[2]) if len(people) > 1 else people:  # the fullest mention of a person first
        if ("person_name", value) not in names.done:
            names.replace("person_name", value, _title(text[max(0, a - 12) : a]))
    return [(k, a, b, value, names.replace(k, value)) for k, a, b, value in found], names


def rewritten(text: str | None, key: str) -> tuple[str | None, str | None, int]:
    """The text with typed numbered placeholders, the text with surrogates, and the number of values replaced.

    Null stays null; a text without values stays as it is. Where two found stretches overlap the first, then longer, counts.
    """
    if not text:
        return text, text, 0
    found, names = entities(text, key)
    for k, _, _, value, _ in sorted(found, key=lambda f: f[1] - f[2]):
        if k == "person_name":
            names.entity(k, value)
    typed, faked, at, n = [], [], 0, 0
    for k, a, b, value, new in sorted(found, key=lambda f: (f[1], -f[2])):
        if a < at:
            continue
        typed += [text[at:a], f"[{PLACE[k]}_{names.entity(k, value)}]"]
        faked += [text[at:a], new]
        at, n = b, n + 1
    return "".join([*typed, text[at:]]), "".join([*faked, text[at:]]), n


def _stacked(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, id, text`` of the tables; each is spread on its own."""
    from functools import reduce

    parts = [spread(df.select("id", "text")).select(F.lit(name).alias("table_name"), F.col("id").cast("string").alias("id"), "text") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def found(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """``table_name, id, finding_type, start_pos``: each place where a value about a person begins and is replaced, in the stored text.

    Null and empty texts have none; a null id gives no row; redelivered rows count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kinds, at = [], [], []
            for n, text in enumerate(b.column("text").to_pylist()):
                for k, a, z, _, new in entities(text, key)[0]:
                    if new != text[a:z]:
                        rows.append(n)
                        kinds.append(k)
                        at.append(a)
            rows = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("table_name").take(rows), b.column("id").take(rows), pa.array(kinds, pa.string()), pa.array(at, pa.int32())], ["table_name", "id", "finding_type", "start_pos"])

    whole = _stacked(tables).where("id IS NOT NULL AND text IS NOT NULL")
    return whole.mapInArrow(run, "table_name string, id string, finding_type string, start_pos int").distinct()


def replaced(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """``table_name, id, text, surrogate, n``: every row with placeholders, with surrogates, and the number of values.

    The key decides the surrogates; who has it can draw them again, so it is the caller's and has no default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [rewritten(t, key) for t in b.column("text").to_pylist()]
            typed, faked, n = zip(*done, strict=True) if done else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column("table_name"), b.column("id"), pa.array(typed, pa.string()), pa.array(faked, pa.string()), pa.array(n, pa.int32())], ["table_name", "id", "text", "surrogate", "n"])

    return _stacked(tables).mapInArrow(run, "table_name string, id string, text string, surrogate string, n int")
