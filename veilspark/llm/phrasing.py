"""Ways in which people are introduced, addressed and reached in any text, and shapes that values have by themselves.

This is the general layer of problem 5's detection: titles, introductions, greetings and closings around names; what stands
before a number one can call; labels of forms and of papers; and addresses, bank and identity numbers by their own shape. It
knows no sentence of any table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

from veilspark.functions import validators

# Words around a person by language. ``intro`` and ``hello`` stand before a name, ``bye`` on the line before it, ``does``
# after it; ``field`` is a form's label of a name; ``call`` stands before a number to call, ``desk`` where it is an office's.
WORDS: dict[str, dict[str, str]] = {
    "en": {
        "intro": "my name is|his name is|her name is|i am|i'm|this is|named|met with|spoke with|spoke to|married to|ask for|care of|regards to",
        "hello": "dear|hello|hi",
        "bye": "sincerely|yours sincerely|yours truly|best regards|kind regards|warm regards|regards|best wishes|cheers|yours|many thanks",
        "does": "lives (?:at|in|on)|resides|was born|is married|has moved|'s (?:phone|email|address|wife|husband|daughter|son|birthday|passport|account|doctor)|can be reached|called (?:me|us|about|to)|phoned|rang",
        "field": "full name|first name|last name|surname|client|customer|employee|applicant|tenant|guest|attn|emergency contact|next of kin|signed",
        "call": "phone|telephone|tel|mobile|cell|call|calling|ring|text|dial|reach|whatsapp|number is|fax",
        "desk": "switchboard|free|toll|hotline|front desk|helpline",
        "paper": "social security(?: number| no\\.?)?|insurance (?:number|no\\.?)|tax id|passport(?: number| no\\.?| is)?|driver'?s licen[cs]e(?: number| no\\.?)?|identity card|id card|credit card|debit card|bank account|account number|card number|iban|ssn",
    },
    "de": {
        "intro": "ich heiße|mein name ist|ich bin|namens|verheiratet mit|gesprochen mit|sprach mit|grüße an|geborene",
        "hello": "sehr geehrter|sehr geehrte|liebe|lieber|hallo|guten tag",
        "bye": "mit freundlichen grüßen|freundliche grüße|viele grüße|beste grüße|herzliche grüße|liebe grüße|hochachtungsvoll|mfg",
        "does": "wohnt (?:in|am|an)|wurde geboren|ist verheiratet|ist umgezogen|lebt in|rief (?:mich|uns|an)|hat angerufen",
        "field": "vorname|nachname|kunde|kundin|mitarbeiter|mitarbeiterin|mieter|mieterin|antragsteller|antragstellerin|patient|patientin|gast|gezeichnet|notfallkontakt",
        "call": "telefon|tel|handy|mobil|mobilnummer|rufnummer|anrufen|ruf|rufen|erreichbar|erreichen|unter|nummer|fax|whatsapp",
        "desk": "zentrale|hotline|servicenummer|kostenlos|gebührenfrei",
        "paper": "sozialversicherungsnummer|personalausweis(?:nummer)?|ausweisnummer|reisepass(?:nummer)?|passnummer|führerschein(?:nummer)?|steuernummer|steuer-id|kontonummer|konto|kreditkarte|kartennummer|iban",
    },
    "fr": {
        "intro": "je m'appelle|mon nom est|je suis|nommé|nommée|mariée? à|mariée? avec|parlé avec|parlé à|demandez",
        "hello": "cher|chère|bonjour|bonsoir",
        "bye": "cordialement|bien cordialement|bien à vous|sincères salutations|salutations distinguées|meilleures salutations|amicalement",
        "does": "habite|demeure|est née?|réside|m'a appelée?|a appelé|a déménagé|est joignable",
        "field": "prénom|nom de famille|nom et prénom|client|cliente|salarié|salariée|locataire|patient|patiente|demandeur|signé|contact d'urgence",
        "call": "téléphone|tél|portable|mobile|appeler|appelez|joindre|joignable|numéro|fax|whatsapp",
        "desk": "standard|numéro vert|gratuit|accueil",
        "paper": "numéro de sécurité sociale|sécurité sociale|passeport(?: numéro| n°)?|permis de conduire|carte d'identité|carte bancaire|carte bleue|numéro de compte|compte bancaire|iban",
    },
    "es": {
        "intro": "me llamo|mi nombre es|soy|llamado|llamada|casado con|casada con|hablé con|pregunte por|saludos a",
        "hello": "estimado|estimada|querido|querida|hola|apreciado|apreciada",
        "bye": "atentamente|un saludo|saludos|saludos cordiales|cordialmente|un abrazo|muy atentamente",
        "does": "vive en|reside|nació|está casad[oa]|se ha mudado|me llamó|llamó|puede ser localizad[oa]",
        "field": "nombre y apellidos|apellidos|cliente|clienta|empleado|empleada|inquilino|inquilina|paciente|solicitante|firmado|contacto de emergencia",
        "call": "teléfono|tel|móvil|celular|llame|llamar|llámeme|llamarme|número|whatsapp|fax",
        "desk": "centralita|gratuito|atención general|línea",
        "paper": "seguridad social|pasaporte(?: número)?|carnet de conducir|permiso de conducir|documento de identidad|dni|nie|tarjeta(?: de crédito)?|cuenta(?: bancaria)?|número de cuenta|iban",
    },
    "it": {
        "intro": "mi chiamo|il mio nome è|sono|di nome|sposato con|sposata con|parlato con|chieda di|saluti a",
        "hello": "gentile|caro|cara|ciao|buongiorno|egregio|egregia|spettabile",
        "bye": "cordiali saluti|distinti saluti|saluti|un saluto|cordialmente|un abbraccio",
        "does": "abita|risiede|è nat[oa]|è sposat[oa]|si è trasferit[oa]|mi ha chiamat[oa]|ha chiamato|ha telefonato",
        "field": "nome e cognome|cognome|cliente|dipendente|inquilino|inquilina|paziente|richiedente|firmato|contatto di emergenza",
        "call": "telefono|tel|cellulare|cell|chiamare|chiamarmi|chiami|chiamami|numero|fax|whatsapp",
        "desk": "centralino|numero verde|gratuito",
        "paper": "codice fiscale|passaporto(?: numero)?|patente(?: di guida)?|carta d'identità|carta di credito|conto corrente|numero di conto|tessera sanitaria|iban",
    },
    "pt": {
        "intro": "meu nome é|chamo-me|eu sou|sou|casado com|casada com|falei com",
        "hello": "caro|cara|prezado|prezada|olá|bom dia",
        "bye": "atenciosamente|cumprimentos|com os melhores cumprimentos|abraços|um abraço",
        "does": "mora|reside|nasceu|ligou|telefonou|é casad[oa]",
        "field": "nome completo|apelido|cliente|funcionário|funcionária|inquilino|paciente|assinado",
        "call": "telefone|telemóvel|celular|ligar|ligue|número|fax|whatsapp",
        "desk": "central|gratuito",
        "paper": "passaporte(?: número)?|carta de condução|cartão de cidadão|cartão de crédito|conta bancária|número de conta|nif|cpf|iban",
    },
}
STREET = {
    "en": r"\b\d{1,5}[A-Za-z]?[ ]+(?:[A-Z][\w'’-]+[ ]+){1,3}(?:Street|Road|Avenue|Lane|Drive|Court|Terrace|Boulevard|Crescent|Gardens|St|Rd|Ave|Blvd)\b\.?",
    "de": r"\b[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|gasse|allee|weg|platz|ufer|damm)[ ]+\d{1,4}[ ]?[a-z]?\b",
    "fr": r"\b\d{1,4}(?:[ ]?(?:bis|ter))?,?[ ]+(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours)[ ]+(?:(?:de|du|des|la|le|les|l['’]|d['’])[ ]*)*[A-ZÀ-Þ][\w'’-]+(?:[ ][A-ZÀ-Þ][\w'’-]+)*",
    "es": r"\b(?:[Cc]alle|[Aa]venida|[Aa]vda\.?|[Pp]aseo|[Pp]laza|[Cc]amino|[Rr]onda)[ ]+(?:(?:de|del|la|las|los|el)[ ])*[A-ZÁ-Ú][\wáéíóúñ]+(?:[ ](?:de[ ]|del[ ])?[A-ZÁ-Ú][\wáéíóúñ]+)*,?[ ]+(?:n\.?[ºo°][ ]*)?\d{1,4}",
    "it": r"\b(?:[Vv]ia|[Vv]iale|[Pp]iazza|[Cc]orso|[Ll]argo|[Vv]icolo)[ ]+(?:(?:dei|della|delle|del|di|da)[ ])*[A-ZÀ-Ù][\w'’]+(?:[ ][A-ZÀ-Ù][\w'’]+)*,?[ ]+(?:n\.[ ]*)?\d{1,4}",
    "pt": r"\b(?:[Rr]ua|[Aa]venida|[Pp]raça|[Tt]ravessa)[ ]+(?:(?:de|do|da|dos|das)[ ])*[A-ZÀ-Ú][\wãõáéíóúâêôç]+(?:[ ](?:d[aeo]s?[ ])?[A-ZÀ-Ú][\wãõáéíóúâêôç]+)*,?[ ]+(?:n\.?[ºo°][ ]*)?\d{1,4}",
}
STREET_WORDS = {
    "en": (" street", " road", " avenue", " lane", " drive", " court", " terrace", " boulevard", " crescent", " gardens", " st", " rd", " ave", " blvd"),
    "de": ("straße ", "strasse ", "str. ", "gasse ", "allee ", "weg ", "platz ", "ufer ", "damm "),
    "fr": ("rue ", "avenue ", "boulevard ", "place ", "chemin ", "allée ", "impasse ", "quai ", "route ", "cours "),
    "es": ("calle ", "avenida ", "avda", "paseo ", "plaza ", "camino ", "ronda "),
    "it": ("via ", "viale ", "piazza ", "corso ", "largo ", "vicolo "),
    "pt": ("rua ", "avenida ", "praça ", "travessa "),
}
_UP = "A-ZÀ-ÖØ-ÞŒŠŽ"
_NAME = rf"[{_UP}][^\W\d_]+(?:[-'’][{_UP}]?[^\W\d_]+)*(?:[ ](?:(?:de|del|della|di|van|von|der|la|le|y|da|dos)[ ])*(?:[{_UP}]\.[ ]?)*[{_UP}][^\W\d_]+(?:[-'’][{_UP}]?[^\W\d_]+)*)"
_FIRM = re.compile(r"^[ ]*,?[ ]*(?:GmbH|AG|KG|Ltd|Inc|LLC|SARL|SCOP|S\.|Coop|Partners|e\. ?V|y Asociados|et Fils|e Figli)")
_CALLED = re.compile(r"(?<![\w./:-])(?:\(?\+?\d[\d ().\-/]{6,18}\d)(?![\w/]|\.\d|-\w)")
#: Surnames that are common where names have no spaces. Fixed values.
SURNAMES = {
    "ja": "佐藤|鈴木|高橋|田中|伊藤|渡辺|山本|中村|小林|加藤|吉田|山田|佐々木|山口|松本|井上|木村|斎藤|清水|山崎|阿部|橋本|池田|石川|前田|藤田|小川|岡田|長谷川|村上|近藤|石井|坂本|遠藤|青木|藤井|西村|福田|太田|三浦|岡本|中島|原田|森|林",
    "zh": "王|李|张|刘|陈|杨|黄|赵|吴|周|徐|孙|马|朱|胡|郭|何|高|林|罗|郑|梁|谢|宋|唐|许|韩|冯|邓|曹|彭|曾|肖|田|董|袁|潘|蒋|蔡|余|杜|叶|程|苏|魏|吕|丁",
    "ko": "김|이|박|최|정|강|조|윤|장|임|한|오|서|신|권|황|안|송|류|홍|전|고|문|손|양|배|백|허|남|심|노|하|곽|성|차|주|우|구|민|진",
}
EAST = {
    "ja": {
        "name": [
            r"(?P<n>(?:{s})[ ]?[一-鿿ぁ-んァ-ヴ]{{1,3}})(?=さん|様|氏|先生|と申します|です。|と言います)", r"(?:私は|名前は|氏名[:：]|担当の|妻の|夫の)[ ]?(?P<n>(?:{s})[ ]?[一-鿿]{{1,3}}?)(?=です|と申|と言|で|、|。|\s|$)",
            r"(?P<n>[ァ-ヴー]{{2,8}}・[ァ-ヴー]{{2,8}})(?=さん|様|氏|です|と申)",
        ],
        "call": r"(?:電話|携帯|連絡先|番号)[^\n。\d]{0,8}(?P<v>[0-9(+][0-9()+ -]{7,16}\d)", "desk": "代表|フリーダイヤル|総合窓口|お客様",
        "address": r"(?P<a>(?:[一-鿿]{2,3}[都道府県])?[一-鿿ァ-ヶ]{1,6}[市区町村][一-鿿ぁ-んァ-ヶ]{1,10}\d{1,3}(?:丁目|番地|番|[-－]\d)[\d丁目番地号\-－]*)",
        "paper": r"(?:旅券番号|パスポート|マイナンバー|個人番号|免許証番号|口座番号|カード番号|会員番号)(?:は|[:：])?[ ]?(?P<v>[A-Z0-9][A-Z0-9 -]{5,22}\d)",
    },
    "zh": {
        "name": [
            r"(?:我叫|我是|姓名[:：]|名叫|联系人[:：]|本人)[ ]?(?P<n>(?:{s})[一-鿿]{{1,2}})(?=[，,。；;\s]|住|在|的|$)", r"(?P<n>(?:{s})[一-鿿]{{1,2}})(?=先生|女士|小姐|老师|医生|经理)", r"(?:尊敬的|亲爱的|你好，|您好，)(?P<n>(?:{s})[一-鿿]{{1,2}}?)(?=先生|女士|[：:，,])",
            r"(?P<n>(?:{s})[一-鿿]{{1,2}})(?=住在|的电话|的手机|的护照|的地址|的身份证|的银行)",
        ],
        "call": r"(?:电话|手机|致电|拨打|联系方式|号码)[^\n。\d]{0,6}(?P<v>[0-9(+][0-9()+ -]{6,16}\d)", "desk": "总机|热线|免费|客服",
        "address": r"(?P<a>(?:[一-鿿]{2,4}[省市])?(?:[一-鿿]{2,4}[市区县镇])?[一-鿿]{1,6}(?:路|街|大道|巷|道)\d{1,5}号(?:\d{1,4}(?:号楼|栋|单元|室|楼))*)",
        "paper": r"(?:身份证号?码?|护照号?码?|银行卡号?|卡号|账号|驾驶证号?)(?:是|为|[:：])?[ ]?(?P<v>[A-Z0-9][A-Z0-9 -]{5,22}[0-9Xx])",
    },
    "ko": {
        "name": [
            r"(?:제 이름은|저는|이름[:：]|성명[:：]|담당자[:：]|담당자는)[ ]?(?P<n>(?:{s})[가-힣]{{1,2}})(?=입니다|이고|라고|이라고|[,.]|\s|$)", r"(?<![가-힣])(?P<n>(?:{s})[가-힣]{{1,2}})(?=[ ]?(?:씨|님|선생님|과장|부장|대리|팀장|교수))",
            r"(?<![가-힣])(?P<n>(?:{s})[가-힣]{{2}})(?=의 (?:전화|휴대폰|주소|여권|계좌)|[은는이가] [가-힣 ]{{0,12}}(?:살고|산다|삽니다|거주))",
        ],
        "call": r"(?:전화|휴대폰|연락처|핸드폰|번호)[^\n.\d]{0,6}(?P<v>[0-9(+][0-9()+ -]{7,16}\d)", "desk": "대표|무료|고객센터|안내",
        "address": r"(?P<a>(?:[가-힣]{2,5}(?:특별시|광역시|시|도)[ ])?(?:[가-힣]{1,5}[시군구읍면동][ ]){1,2}[가-힣\d]{1,8}(?:로|길)[ ]?\d{1,4}(?:-\d{1,4})?)",
        "paper": r"(?:주민등록번호|여권번호|여권 번호|운전면허번호|계좌번호|카드번호|계좌)(?:는|은|[:：])?[ ]?(?P<v>[A-Z0-9][A-Z0-9 -]{5,22}\d)",
    },
}


def alternatives(cues: str) -> list[tuple[str, str]]:
    """The alternatives of a pattern, each with its longest stretch of plain text in small letters and with single spaces, without which
    it has no match (empty if it has no such stretch)."""
    out, depth, one = [], 0, ""
    for ch in cues + "|":
        depth += (ch == "(") - (ch == ")")
        if ch != "|" or depth:
            one += ch
            continue
        group = re.match(r"(.*?)\(\?:([^()]*)\)(?![?*+{])(.*)", one)
        if group and "|" in group[2]:  # each of its cases is an alternative
            out += [x for case in group[2].split("|") for x in alternatives(group[1] + case + group[3])]
            one = ""
            continue
        plain = re.sub(r"\\[bwdsn]|\\.\??|\[[^\]]*\][?+*]*(?:\{[^}]*\})?|.[?*](?!\))", "\0", re.sub(r"\(\?[:=!<](?:[^()]|\([^()]*\))*\)[?*]?", "\0", one))
        out.append((max((" ".join(x.split()) for x in plain.split("\0")), key=len).lower(), one))
        one = ""
    return out


def in_bytes(text: str) -> bytes | None:
    """The text with a byte for each character, if all are in the first 256."""
    try:
        return text.encode("latin-1")
    except UnicodeError:
        return None


@cache
def _latin(lang: str) -> list[tuple[str, str, re.Pattern]]:
    """(kind, text that must be there, in small letters without accents, pattern) of every phrase of a language."""
    w = WORDS[lang]
    polite = r"(?:(?i:mr|mrs|ms|dr|prof|herr|frau|monsieur|madame|señor|señora|signor|signora|sr|sra|sig|m|mme)\.?[ ]+)*"
    name = _NAME.replace("{", "{{").replace("}", "}}")
    shapes = {
        "intro": ("person_name", rf"(?<!\w)(?i:{{}})[ ]+{polite}(?P<v>{name}+)"),
        "hello": ("person_name", rf"(?m)^[ \t]*(?i:{{}})[ ]+{polite}(?P<v>{name}*)[ ]*[,:!]"),
        "bye": ("person_name", rf"(?m)(?:^|[.!?][ ])[ \t]*(?i:{{}})[ ]*[,.!]?\s{{{{1,4}}}}(?P<v>{name}+)[ \t]*$"),
        "does": ("person_name", rf"(?<![\w@.])(?P<v>{name}+)(?=[ ]?(?i:{{}})\b)"),
        "field": ("person_name", rf"(?m)(?:^|[\n;,.][ ]?)(?i:{{}})[ ]?:[ ]*(?P<v>{name}*)"),
        "call": ("phone", r"\b(?i:{})\b(?:\.[ ]?(?=[\d+(])|[^\n\d+(.!?]{{0,24}})(?P<v>\(?\+?\d[\d ().\-/]{{6,18}}\d)(?![\w/]|\.\d|-\w)"),
        "paper": ("number", r"(?<!\w)(?i:{})(?:[ ](?i:is|ist|est|es|è|é|number|nummer))?[ ]?[:#]?[ ]{{0,2}}(?P<v>(?=(?:[^\n,;]{{0,10}}\d){{4}})[A-Z0-9](?:[ ./-]?[A-Z0-9]){{4,33}})(?!\w)"),
    }
    out = [(kind, folded(plain), re.compile(shape.format(one))) for field, (kind, shape) in shapes.items() for plain, one in alternatives(w[field])]
    street = re.compile(rf"(?P<v>{STREET[lang]}(?:,?[ ](?:[A-Z]{{0,2}}\d{{4,6}}|[{_UP}][\w'’-]+)(?:,?[ ][{_UP}0-9][\w'’-]*)*)?)")
    return [*out, *(("postal_address", folded(word), street) for word in STREET_WORDS[lang])]


#: Runs of digits and capitals in groups, of which a number may be a part; capitals may stand before.
_GROUPS, _ASCII_GROUPS = (re.compile(rf"[{d}](?=[{d}A-Z -]{{6}})[{d}A-Z -]{{6,}}[{d}A-Z]") for d in (r"\d", "0-9"))
_CHECKED = re.compile(r"(?<![\w-])(?:[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{3}-\d{2}-\d{4}|\d{6}-[1-8]\d{6}|\d{17}[\dX]|\d{8}-?[A-Z]|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z])(?![\w-])")


def _is_checked(value: str) -> bool:
    """Whether a value is by itself an account, card or identity number: its check digits say so."""
    plain = re.sub(r"[ -]", "", value)
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", value):
        return not validators.is_unissued_ssn(value)
    if re.fullmatch(r"\d{16}", plain):
        return validators.luhn(plain)
    return any(rule(plain) for rule in (validators.is_iban, validators.is_resident_id_cn, validators.is_nif_es, validators.is_codice_fiscale)) or validators.is_rrn_kr(value)


#: Numbers that cost the caller nothing, or one of an office: not a person's. Fixed values.
_FREE = re.compile(r"\(?(?:0800|0 800|0805|0180|0120|00800|800|900|901|902|844|855|866|877|888|833|080|1588|1577|400)[ ./)-]")
_STOP = re.compile(r"(?<=\w{3})[.!?]\s")


@cache
def _east_names(lang: str) -> list[re.Pattern]:
    return [re.compile(one.format(s=SURNAMES[lang])) for one in EAST[lang]["name"]]


def _office(text: str, at: int, desk: str) -> bool:
    """Whether the sentence up to a number speaks of an office's number."""
    wide = 200
    while True:  # the stretch looked at grows until a sentence begins in it
        first = max(0, at - wide)
        start = max(first, text.rfind("\n", first, at) + 1, *(m.end() for m in _STOP.finditer(text, first, at)))
        if start > first or not first:
            break
        wide *= 4
    return re.search(desk, text[start:at]) is not None


class Index:
    """Which cues can match a text, those whose word is in it, and where words of phrases are. One pass over the text finds all words."""

    def __init__(self, cues: list[str], phrases: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.always = [k for k, word in enumerate(cues) if not word]
        by: dict[str, tuple[list[int], list[int]]] = {}
        for n, words in enumerate((cues, phrases)):
            for k, word in enumerate(words):
                if word:
                    by.setdefault(word, ([], []))[n].append(k)
        for word, rules in by.items():
            self.automaton.add_word(word, (len(word), *rules))
        if by:
            self.automaton.make_automaton()

    def able(self, text: str) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
        """The cues whose word is in the text, in their order; the start, end and phrases of each word of a phrase."""
        found, hits = set(self.always), []
        if len(self.automaton):
            for last, (size, cues, phrases) in self.automaton.iter(text):
                if cues:
                    found.update(cues)
                if phrases:
                    hits.append((last + 1 - size, last + 1, phrases))
        return sorted(found), hits


def folded(plain: str) -> str:
    """A text without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", plain) if not unicodedata.combining(c)) if not plain.isascii() else plain


def word_of(plain: str) -> str:
    """The longest word of a stretch of plain text, without accents."""
    return max(reversed(re.findall(r"[^\W\d_]+", folded(plain)) or [""]), key=len)


def phrase_words(lang: str) -> list[str]:
    """The word that must be in a text for each phrase of a language."""
    return [word_of(plain) for _, plain, _ in _latin(lang)] if lang in WORDS else []


def general(form: str, small: str, lang: str, taken: bytearray, hits: list[tuple[int, int, list[int]]]) -> Iterator[tuple[str, int, int]]:
    """(finding type, start, end) of what the general layer finds; values may overlap what is known already.

    ``small`` is the text in small letters without accents, letter for letter. ``taken`` marks the known values; a phrase whose value,
    next to it, is known isn't looked at again. ``hits`` are the words of phrases in ``small`` as :meth:`Index.able` gives them.
    """
    for run in (_GROUPS if in_bytes(form) is None else _ASCII_GROUPS).finditer(form):
        start = run.start()
        while start and "A" <= form[start - 1] <= "Z":
            start -= 1
        if 0 not in taken[start : run.end()]:
            continue
        for m in _CHECKED.finditer(form, start, run.end()):
            if 1 not in taken[m.start() : m.end()] and _is_checked(m[0]):
                yield "number", *m.span()
    if lang in EAST:
        rules = EAST[lang]
        for one in _east_names(lang):
            for m in one.finditer(form):
                yield "person_name", *m.span("n")
        for m in re.finditer(rules["call"], form):
            if not _FREE.match(m["v"]) and not re.search(rules["desk"], form[form.rfind("。", 0, m.start()) + 1 : m.start()]):
                yield "phone", *m.span("v")
        for m in re.finditer(rules["paper"], form):
            yield "number", *m.span("v")
        for m in re.finditer(rules["address"], form):
            lead = re.match("(?:.*?)(?:住在|位于|寄往|寄到|搬到)", m["a"])  # words before an address where nothing parts them
            yield "postal_address", m.start("a") + (lead.end() if lead else 0), m.end("a")
        return
    todo: dict[tuple[int, int], int] = {}  # a pattern and the line that its word is in
    phrases = _latin(lang)
    for a, b, rules in hits:
        if (b == len(small) or not small[b].isalnum()) and (not a or not small[a - 1].isalnum() or lang == "de"):
            before, behind = 1 in taken[max(0, a - 3) : a], 1 in taken[b : b + 4]
            start = small.rfind("\n", 0, a) + 1
            for k in rules:
                if not (before if phrases[k][0] == "person_name" else behind):
                    todo[k, start] = a
    for (k, start), at in todo.items():
        kind, plain, rule = phrases[k]
        # a phrase and its value stand on one line, or the name under a closing on the next
        end = small.find("\n", at)
        end = len(small) if end < 0 else end if kind != "person_name" else (small.find("\n", end + 1) + 1 or len(small) + 1) - 1
        if small.find(plain, start, end) < 0:  # its word was another's
            continue
        for m in rule.finditer(form, start, end):
            a, b = m.span("v")
            if kind == "person_name" and _FIRM.match(form[b : b + 14]):
                continue
            if kind == "phone" and (_FREE.match(m["v"]) or not 7 <= sum(c.isdigit() for c in m["v"]) <= 15 or _office(small, a, word_pattern(lang))):
                continue
            yield kind, a, b


@cache
def word_pattern(lang: str) -> str:
    """What speaks of an office's number, without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", WORDS[lang]["desk"]) if not unicodedata.combining(c))
