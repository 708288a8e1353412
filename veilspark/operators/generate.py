"""Labelled synthetic documents, each a pure function of (seed, number), so the result doesn't depend on partitioning.

A document is assembled from values whose spans are recorded as they are written, so labels are exact by construction.
Values are invented; cards carry a Luhn digit and Spanish numbers their letter, other identity numbers are only shaped.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from random import Random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from veilspark.functions.validators import NIF_LETTERS
from veilspark.operators.coverage import SLOT_CATEGORY, edges
from veilspark.schema import LEVELS, REPORT

LANGS = ("ja", "zh", "ko", "en", "fr", "it", "de", "es")
CJK = frozenset({"ja", "zh", "ko"})

# ---- word lists of our own, one row per language: surnames, given names, places, firms, titles, labels ----------------
WORDS: dict[str, dict[str, list[str]]] = {
    "en": {"surname": "Aldwick Barrow Cresley Dunmore Elsworth Farley Garrick Hollis Ingram Jessop".split(), "given": "Ada Bertram Celia Dorian Edith Felix Greta Howard Iris Jasper".split(), "place": "Northaven Millbrook Eastmere Granby Holtown".split(), "firm": ["Corvell Ltd", "Brightfen Inc.", "Ostrava Partners", "Millstone LLC"], "job": ["clerk", "nurse", "site manager", "analyst"], "title": ["Mr.", "Ms.", "Dr."], "street": ["{n} Elm Road, {p}", "{n} Station Lane, {p}"]},
    "de": {"surname": "Altmann Brandner Dorfer Eberling Falkner Grothe Hellwig Isenberg".split(), "given": "Anton Birgit Clemens Doris Emil Frieda Gregor Hanna".split(), "place": "Nordheim Waldau Rosenberg Altenfurt".split(), "firm": ["Kranich GmbH", "Velten AG", "Morgenrot KG"], "job": ["Sachbearbeiter", "Pflegerin", "Monteur"], "title": ["Herr", "Frau", "Dr."], "street": ["Lindenweg {n}, {p}", "Gartenstraße {n}, {p}"]},
    "fr": {"surname": "Aubertin Besson Cormier Delvaux Estève Fournel Gaillot".split(), "given": "Adèle Bastien Cécile Damien Élodie Florent".split(), "place": "Villeneuve-le-Roc Montclair Saint-Aubin".split(), "firm": ["Sorel SARL", "Atelier Vaudry SAS"], "job": ["comptable", "infirmière", "chef de projet"], "title": ["M.", "Mme", "Dr"], "street": ["{n} rue des Tilleuls, {p}", "{n} avenue du Lac, {p}"]},
    "it": {"surname": "Albertini Bonelli Corsini Donati Ermini Fabbri".split(), "given": "Alba Bruno Carla Dino Elena Furio".split(), "place": "Montefiore Collalto Rivabella".split(), "firm": ["Sartori S.r.l.", "Nuvola S.p.A."], "job": ["impiegato", "infermiera", "geometra"], "title": ["Sig.", "Sig.ra", "Dott."], "street": ["Via dei Pini {n}, {p}", "Corso Vittoria {n}, {p}"]},
    "es": {"surname": "Aldana Briones Cordero Dueñas Escudero Fuentes".split(), "given": "Alba Bruno Clara Diego Elisa Fermín".split(), "place": "Villaclara Monteverde Aldeanueva".split(), "firm": ["Olmedo S.L.", "Puerto Sur S.A."], "job": ["administrativo", "enfermera", "jefa de obra"], "title": ["Sr.", "Sra.", "Dra."], "street": ["Calle Mayor {n}, {p}", "Avenida del Río {n}, {p}"]},
    "ja": {"surname": "石倉 三好 長谷 北条 白川 早瀬".split(), "given": "直人 美咲 健太 由香 翔 千夏".split(), "place": "北浜市 青葉町 緑川区".split(), "firm": ["株式会社東雲", "有限会社みなと"], "job": ["事務員", "看護師", "主任"], "title": ["担当", "主任"], "street": ["{p}本町{n}丁目3-2", "{p}中央{n}-5-1"]},
    "zh": {"surname": "陆 沈 韩 孟 汪 邵".split(), "given": "文博 雅婷 志远 思雨 建华 晓梅".split(), "place": "东江市 青山区 白石镇".split(), "firm": ["恒远有限公司", "明德商行"], "job": ["文员", "护士", "工程师"], "title": ["经办人", "组长"], "street": ["{p}人民路{n}号", "{p}建设路{n}号2单元"]},
    "ko": {"surname": "남 방 석 하 명 표".split(), "given": "지훈 서연 민준 하은 도윤 유진".split(), "place": "새빛시 한솔동 가람읍".split(), "firm": ["(주)누리", "다솜상사"], "job": ["사무원", "간호사", "팀장"], "title": ["담당", "팀장"], "street": ["{p} 중앙로 {n}", "{p} 강변로 {n}, 101동 5호"]},
}
#: Sentences by language: facts of a person with their categories and whether they are sensitive, and sentences of no person.
SAY = {
    "en": {"meets": "{P} confirmed the appointment.", "mail": "{P} wrote from {E}.", "phone": "Call {P} on {T}.", "lives": "{P} lives at {A}.", "born": "{P} was born on {B}.", "works": "{P} works as {J} at {O}.", "ill": "{P} is being treated for asthma.", "union": "{P} is a member of the union.", "idno": "The identity number of {P} is {N}.", "card": "{P} paid with card {C}.", "none": ["The office closes at six.", "The delivery reached {L} on {D}.", "Invoice {K} is paid."], "hotline": "{O} answers on {H}."},
    "de": {"meets": "{P} bestätigte den Termin.", "mail": "{P} schrieb von {E}.", "phone": "{P} ist unter {T} erreichbar.", "lives": "{P} wohnt {A}.", "born": "{P} ist am {B} geboren.", "works": "{P} arbeitet als {J} bei {O}.", "ill": "{P} wird wegen Asthma behandelt.", "union": "{P} ist Gewerkschaftsmitglied.", "idno": "Die Ausweisnummer von {P} ist {N}.", "card": "{P} zahlte mit Karte {C}.", "none": ["Das Büro schließt um sechs.", "Die Lieferung kam am {D} nach {L}.", "Rechnung {K} ist bezahlt."], "hotline": "{O} ist unter {H} erreichbar."},
    "fr": {"meets": "{P} a confirmé le rendez-vous.", "mail": "{P} a écrit depuis {E}.", "phone": "On joint {P} au {T}.", "lives": "{P} habite {A}.", "born": "{P} est né le {B}.", "works": "{P} travaille comme {J} chez {O}.", "ill": "{P} est suivi pour asthme.", "union": "{P} est membre du syndicat.", "idno": "Le numéro de {P} est {N}.", "card": "{P} a payé avec la carte {C}.", "none": ["Le bureau ferme à six heures.", "La livraison est arrivée à {L} le {D}.", "La facture {K} est réglée."], "hotline": "{O} répond au {H}."},
    "it": {"meets": "{P} ha confermato l'incontro.", "mail": "{P} ha scritto da {E}.", "phone": "Chiamare {P} al {T}.", "lives": "{P} abita in {A}.", "born": "{P} è nato il {B}.", "works": "{P} lavora come {J} presso {O}.", "ill": "{P} è in cura per asma.", "union": "{P} è iscritto al sindacato.", "idno": "Il numero di {P} è {N}.", "card": "{P} ha pagato con la carta {C}.", "none": ["L'ufficio chiude alle sei.", "La consegna è arrivata a {L} il {D}.", "La fattura {K} è saldata."], "hotline": "{O} risponde al {H}."},
    "es": {"meets": "{P} confirmó la cita.", "mail": "{P} escribió desde {E}.", "phone": "Llamen a {P} al {T}.", "lives": "{P} vive en {A}.", "born": "{P} nació el {B}.", "works": "{P} trabaja como {J} en {O}.", "ill": "{P} sigue un tratamiento por asma.", "union": "{P} es miembro del sindicato.", "idno": "El número de {P} es {N}.", "card": "{P} pagó con la tarjeta {C}.", "none": ["La oficina cierra a las seis.", "La entrega llegó a {L} el {D}.", "La factura {K} está pagada."], "hotline": "{O} responde en el {H}."},
    "ja": {"meets": "{P}が訪問を確認した。", "mail": "{P}さんの連絡先は{E}です。", "phone": "{P}様は{T}で連絡できます。", "lives": "{P}は{A}に住む。", "born": "{P}は{B}生まれ。", "works": "{P}は{O}の{J}です。", "ill": "{P}は喘息で通院中。", "union": "{P}は組合員です。", "idno": "{P}の番号は{N}。", "card": "{P}はカード{C}で払った。", "none": ["窓口は六時に閉まる。", "荷物は{D}に{L}へ着いた。", "請求書{K}は支払済み。"], "hotline": "{O}の代表は{H}です。"},
    "zh": {"meets": "{P}确认了行程。", "mail": "{P}的邮箱是{E}。", "phone": "{P}的电话是{T}。", "lives": "{P}住在{A}。", "born": "{P}生于{B}。", "works": "{P}在{O}任{J}。", "ill": "{P}因哮喘就诊。", "union": "{P}是工会会员。", "idno": "{P}的证件号是{N}。", "card": "{P}用卡{C}付款。", "none": ["办公室六点关门。", "货物于{D}到达{L}。", "发票{K}已付。"], "hotline": "{O}总机是{H}。"},
    "ko": {"meets": "{P}이 일정을 확인했다.", "mail": "{P} 님의 메일은 {E}입니다.", "phone": "{P} 씨는 {T}로 연락됩니다.", "lives": "{P}은 {A}에 산다.", "born": "{P}은 {B}에 태어났다.", "works": "{P}은 {O}의 {J}이다.", "ill": "{P}은 천식으로 치료 중이다.", "union": "{P}은 노조원이다.", "idno": "{P}의 번호는 {N}이다.", "card": "{P}이 카드 {C}로 냈다.", "none": ["사무실은 여섯 시에 닫는다.", "물품은 {D}에 {L}에 도착했다.", "청구서 {K}는 지불되었다."], "hotline": "{O} 대표 번호는 {H}이다."},
}
FACT = {"meets": ([], False), "mail": (["email_or_phone"], False), "phone": (["email_or_phone"], False), "lives": (["postal_address"], False), "born": (["date_of_birth"], False), "works": (["employment_info"], False), "ill": (["health_info"], True), "union": (["political_or_union"], True), "idno": (["government_id"], True), "card": (["financial_account"], True)}
LOW = [k for k, (_, high) in FACT.items() if not high]
HIGH = [k for k, (_, high) in FACT.items() if high]


class Values:
    """Invented values of one language from one random stream."""

    def __init__(self, rng: Random, lang: str):
        self.r, self.lang, self.w = rng, lang, WORDS[lang]

    def digits(self, n: int) -> str:
        return "".join(self.r.choices("0123456789", k=n))

    def letters(self, n: int) -> str:
        return "".join(self.r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=n))

    def pick(self, xs):
        return self.r.choice(xs)

    @staticmethod
    def grouped(s: str, sizes: list[int], sep: str = " ") -> str:
        at, out = 0, []
        for n in sizes:
            out.append(s[at : at + n])
            at += n
        return sep.join([*out, s[at:]] if s[at:] else [x for x in out if x])

    def card(self) -> str:
        body = {"zh": "62", "ja": self.pick(["35", "4", "5"])}.get(self.lang) or self.pick("45")
        body += self.digits(15 - len(body))
        total = sum(2 * d - 9 * (d > 4) if k % 2 == 0 else d for k, d in enumerate(map(int, reversed(body))))
        number = body + str(-total % 10)
        return self.grouped(number, [4] * 4, self.pick([" ", "-"])) if self.r.random() < 0.6 else number

    def phone(self) -> str:
        d = self.digits
        return {
            "ja": lambda: f"0{self.pick(['90', '80', '70'])}-{d(4)}-{d(4)}", "zh": lambda: f"1{self.pick('3589')}{d(9)}", "ko": lambda: f"010-{d(4)}-{d(4)}",
            "en": lambda: f"({self.r.randint(201, 989)}) {self.r.randint(200, 989)}-{d(4)}", "fr": lambda: self.grouped("0" + self.pick("67") + d(8), [2] * 5),
            "it": lambda: f"3{d(2)} {d(3)} {d(4)}", "de": lambda: f"01{self.pick(['51', '60', '71'])} {d(8)}", "es": lambda: f"6{d(2)} {d(3)} {d(3)}",
        }[self.lang]()

    def hotline(self) -> str:
        return {"ja": "0120-", "zh": "400-", "ko": "1588-", "en": "1-800-", "fr": "0800 ", "it": "800 ", "de": "0800 ", "es": "900 "}[self.lang] + self.digits(3) + {"ja": "-", "zh": "-"}.get(self.lang, " ") + self.digits(4)

    def gov_id(self) -> tuple[str, str]:
        d, i = self.digits, self.r.randint
        if self.lang == "es":
            n = i(10**7, 10**8 - 1)
            return f"{n}{NIF_LETTERS[n % 23]}", "NATIONAL_ID"
        return {
            "ja": lambda: (self.grouped(d(12), [4] * 3, self.pick([" ", "-"])), "MY_NUMBER"), "zh": lambda: (f"{i(11, 65)}{d(4)}{i(1960, 2004)}{i(1, 12):02d}{i(1, 28):02d}{d(4)}", "NATIONAL_ID"),
            "ko": lambda: (f"{i(60, 99)}{i(1, 12):02d}{i(1, 28):02d}-{self.pick('12')}{d(6)}", "NATIONAL_ID"), "en": lambda: (f"{i(100, 665)}-{d(2)}-{d(4)}", "NATIONAL_ID"),
            "fr": lambda: (f"{self.pick('12')} {d(2)} {i(1, 12):02d} {d(2)} {d(3)} {d(3)} {d(2)}", "NATIONAL_ID"),
            "it": lambda: (f"{self.letters(6)}{d(2)}{self.letters(1)}{d(2)}{self.letters(1)}{d(3)}{self.letters(1)}", "NATIONAL_ID"), "de": lambda: (f"{i(1, 9)}{d(10)}", "NATIONAL_ID"),
        }[self.lang]()

    def passport(self) -> str:
        return self.letters(1 + (self.lang in ("ja", "de"))) + self.digits(8)

    def bank(self) -> str:
        length = {"fr": 27, "it": 27, "de": 22, "es": 24}.get(self.lang)
        return self.grouped(self.lang.upper() + self.digits(length - 2), [4] * 7) if length else self.digits(self.r.randint(10, 14))

    def date(self, birth: bool = False) -> str:
        y, m, d = self.r.randint(1950, 2005) if birth else self.r.randint(2024, 2027), self.r.randint(1, 12), self.r.randint(1, 28)
        return {"ja": f"{y}年{m}月{d}日", "zh": f"{y}年{m}月{d}日", "ko": f"{y}년 {m}월 {d}일", "de": f"{d:02d}.{m:02d}.{y}"}.get(self.lang, f"{d:02d}/{m:02d}/{y}")

    def address(self) -> str:
        return self.pick(self.w["street"]).format(n=self.r.randint(1, 240), p=self.pick(self.w["place"]))

    def ip(self) -> str:
        return self.pick(["192.168.{}.{}", "10.7.{}.{}", "203.0.113.{1}", "198.51.100.{1}"]).format(self.r.randint(0, 255), self.r.randint(2, 254)) if self.r.random() < 0.5 else f"192.168.{self.r.randint(0, 255)}.{self.r.randint(2, 254)}"

    def code(self) -> str:
        return self.pick([f"INV-{self.r.randint(2023, 2027)}-{self.digits(4)}", f"#{self.digits(6)}", f"DOC{self.digits(8)}"])

    def member(self) -> str:
        return self.pick(["E-", "M", "PT-", "C-"]) + self.digits(self.r.randint(5, 7))

    def machine(self) -> str:
        return "".join(self.r.choices("0123456789abcdef", k=self.pick([32, 40])))

    def password(self) -> str:
        return self.pick(["Lantern", "maple", "Orbit", "velvet"]) + self.digits(4) + self.pick("!#$@")

    def amount(self) -> str:
        return f"{self.r.randint(1, 980)}.{self.digits(2)} EUR"

    def gps(self) -> str:
        return f"{self.r.uniform(-45, 60):.5f}, {self.r.uniform(-120, 145):.5f}"


def number_variant(r: Random, value: str) -> str:
    """Now and then a number digit by digit, or with dots for its separators."""
    n = r.random()
    return " ".join(c for c in value if not c.isspace()) if n < 0.03 else re.sub(r"[\s-]", ".", value) if n < 0.05 else value


def phone_variant(r: Random, lang: str, value: str) -> str:
    """Now and then full-width digits (ja, zh, ko), or digit by digit."""
    n = r.random()
    if lang in CJK and n < 0.06:
        return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in value)
    return " ".join(value.replace(" ", "")) if 0.06 <= n < 0.09 else value


def mail_variant(r: Random, value: str) -> str:
    """Now and then a mail address with its signs spelled out."""
    return value.replace("@", " [at] ").replace(".", " [dot] ") if r.random() < 0.04 else value


def plain_ascii(name: str) -> str:
    return re.sub("[^a-z]", "", "".join(c for c in unicodedata.normalize("NFD", name.replace("ß", "ss")) if not unicodedata.combining(c)).lower())


class Person:
    def __init__(self, v: Values):
        self.surname, self.given = v.pick(v.w["surname"]), v.pick(v.w["given"])
        self.cjk = v.lang in CJK
        self.full = self.surname + self.given if self.cjk else f"{self.given} {self.surname}"
        local = plain_ascii(self.given) + "." + plain_ascii(self.surname)
        self.email = mail_variant(v.r, f"{local if len(local) > 3 else v.pick(['blue.kite', 'north_fox', 'quiet.reed'])}@{v.pick(['postbox', 'mailwell'])}.example")

    def mention(self, v: Values) -> str:
        n = v.r.random()
        return self.full if n < 0.86 or self.cjk else self.surname if n < 0.92 else f"{self.surname}, {self.given}" if n < 0.96 else f"{self.given[0]}. {self.surname}"


class Document:
    """Text under construction; a span is recorded as its value is written."""

    def __init__(self, rng: Random, lang: str):
        self.v, self.lang = Values(rng, lang), lang
        self.r = rng
        self.text, self.spans, self.categories, self.high, self.personal = "", [], set(), False, False

    def add(self, text: str) -> Document:
        self.text += text
        return self

    def span(self, value: str, kind: str) -> Document:
        self.spans.append((len(self.text), len(self.text) + len(value), kind))
        self.personal |= REPORT[kind][1]
        return self.add(value)

    def person(self, who: Person, form: str | None = None) -> Document:
        self.categories.add("person_name")
        return self.span(form or who.mention(self.v), "PERSON")

    def sentence(self, pattern: str, who: Person | None = None) -> Document:
        v = self.v
        for piece in re.split(r"(\{[A-Z]\})", pattern):
            slot = piece[1:-1] if re.fullmatch(r"\{[A-Z]\}", piece) else None
            if slot is None:
                self.add(piece)
            elif slot == "P":
                self.person(who or Person(v))
            elif slot == "N":
                value, kind = v.gov_id()
                self.span(number_variant(self.r, value), kind)
            elif slot in "LDK":
                self.add({"L": lambda: v.pick(v.w["place"]), "D": v.date, "K": v.code}[slot]())
            elif slot == "O":
                self.span(v.pick(v.w["firm"]), "EMPLOYMENT") if "{J}" in pattern else self.add(v.pick(v.w["firm"]))
            else:
                kind, make = {
                    "E": ("EMAIL", lambda: (who or Person(v)).email), "T": ("PHONE", lambda: phone_variant(self.r, self.lang, v.phone())), "A": ("ADDRESS", v.address), "B": ("DATE_OF_BIRTH", lambda: v.date(True)), "J": ("EMPLOYMENT", lambda: v.pick(v.w["job"])),
                    "C": ("CREDIT_CARD", v.card), "H": ("PHONE_CORPORATE", v.hotline),
                }[slot]
                self.span(make(), kind)
        return self

    def fact(self, name: str, who: Person) -> Document:
        categories, high = FACT[name]
        self.categories.update(categories)
        self.high |= high
        return self.sentence(SAY[self.lang][name], who)

    def neutral(self) -> Document:
        return self.sentence(self.v.pick(SAY[self.lang]["none"]))

    def gap(self) -> Document:
        return self.add("" if self.lang in ("ja", "zh") else " ")


# ---- the document formats ----------------------------------------------------------------------------------------


def narrative(d: Document) -> None:
    who, facts = Person(d.v), d.r.sample([*FACT], d.r.randint(1, 3))
    for k, f in enumerate(facts):
        (d.gap() if k else d).fact(f, who)
    for _ in range(d.r.randint(0, 2)):
        d.gap().neutral()


def negative(d: Document) -> None:
    for k in range(d.r.randint(2, 4)):
        (d.gap() if k else d).neutral()


def email_doc(d: Document) -> None:
    to, who = Person(d.v), Person(d.v)
    d.person(to).add(",\n\n").fact(d.v.pick(LOW), who).gap().neutral().add("\n\n").person(who, who.full).add("\n").span(who.email, "EMAIL")
    d.categories.add("email_or_phone")
    if d.r.random() < 0.4:
        d.add("\n").sentence(SAY[d.lang]["hotline"])


def form(d: Document) -> None:
    who = Person(d.v)
    d.add("Name: ").person(who, who.full).add("\nTel: ").span(d.v.phone(), "PHONE").add("\nAddr: ").span(d.v.address(), "ADDRESS").add("\nID: ").span(d.v.member(), "MEMBER_ID")
    d.categories |= {"email_or_phone", "postal_address"}


def csv(d: Document) -> None:
    d.add("name;email;phone")
    for _ in range(d.r.randint(2, 5)):
        who = Person(d.v)
        d.add("\n").person(who, who.full).add(";").span(who.email, "EMAIL").add(";").span(d.v.phone(), "PHONE")
    d.categories.add("email_or_phone")


def chat(d: Document) -> None:
    people = [Person(d.v), Person(d.v)]
    for k in range(d.r.randint(2, 5)):
        who = people[k % 2]
        d.add("\n" if k else "").person(who, who.full).add(": ")
        d.neutral() if d.r.random() < 0.7 else d.fact(d.v.pick(LOW), who)


def boundary(d: Document) -> None:
    kind = d.r.randrange(4)
    if kind == 0:
        d.sentence(SAY[d.lang]["hotline"])
    elif kind == 1:
        d.add("host ").span(d.v.ip(), "IP_SERVER").add(" id ").add(d.v.machine())
    elif kind == 2:
        d.add("order ").span(d.v.digits(10), "ORDER_TRACKING").add(", serial ").span("SN" + d.v.digits(8), "SERIAL")
    else:
        d.add("follow ").span("@" + d.v.pick(["northfox_shop", "velten_news"]), "HANDLE_BRAND")
    d.personal = False


def sensitive_list(d: Document) -> None:
    d.add(d.v.pick({"en": ["Union members", "Patients, ward 3"], "de": ["Gewerkschaftsmitglieder"], "fr": ["Membres du syndicat"], "it": ["Iscritti al sindacato"], "es": ["Afiliados al sindicato"], "ja": ["組合員名簿"], "zh": ["工会会员名单"], "ko": ["노조원 명단"]}[d.lang]))
    for _ in range(d.r.randint(2, 5)):
        who = Person(d.v)
        d.add("\n- ").person(who, who.full)
    d.categories.add("political_or_union")
    d.high = True


def transaction(d: Document) -> None:
    who = Person(d.v)
    d.add("IBAN ").span(d.v.bank(), "BANK_ACCOUNT").add(" ").person(who, who.full).add(f" {d.v.amount()} {d.v.code()}")
    d.categories.add("financial_account")
    d.high = True


def self_disclosure(d: Document) -> None:
    d.fact("ill", Person(d.v)).gap().neutral()


def topic_article(d: Document) -> None:
    negative(d)


def long_doc(d: Document) -> None:
    low, high = 1000 // (2 if d.lang in CJK else 1), 2000 // (2 if d.lang in CJK else 1)
    goal = d.r.randint(low, high - 1)
    while len(d.text) < goal:
        if d.text:
            d.add("\n\n")
        d.v.pick([narrative, negative, chat, minutes])(d)


def lookalike_doc(d: Document) -> None:
    d.add(d.v.pick(["Rose", "Frank", "Grace", "Mark"])).add(": ").neutral()
    d.personal = False


def nameless_doc(d: Document) -> None:
    d.span(d.v.ip(), "IP_PERSONAL").add(" ").span(d.v.address(), "ADDRESS")
    d.categories |= {"ip_address_of_a_person", "postal_address"}


def minutes(d: Document) -> None:
    for k in range(d.r.randint(2, 5)):
        d.add(f"{'' if not k else chr(10)}{k + 1}. ")
        d.neutral() if d.r.random() < 0.5 else d.fact(d.v.pick(LOW), Person(d.v))


def record(d: Document) -> None:
    who = Person(d.v)
    d.fact("ill", who).add("\n").fact("born", who).add("\n").fact("idno", who)


def slot_doc(d: Document, template: dict | None = None) -> None:
    """A template's text with its placeholders replaced; people keep their values throughout."""
    t = template or {"cell": "contact_details", "sensitivity": "low", "text": "{P1} / {P1.email} / {P1.phone} / {DATE} / {ORG}"}
    people: dict[str, Person] = {}
    for piece in re.split(r"(\{[A-Za-z0-9_.]+\})", t["text"]):
        if not re.fullmatch(r"\{[A-Za-z0-9_.]+\}", piece):
            d.add(piece)
            continue
        slot = piece[1:-1]
        base, _, what = slot.partition(".")
        v = d.v
        if re.fullmatch(r"P[1-4]|PUB|DEAD", base):
            who = people.setdefault(base, Person(v))
            if what in ("born", "died"):
                d.add(v.date(what == "born"))
                continue
            if what in SLOT_CATEGORY:
                d.categories.add(SLOT_CATEGORY[what])
            made: dict[str, Callable[[], tuple[str, str]]] = {
                "": lambda w=who: (w.full, "PERSON"), "s": lambda w=who: (w.surname, "PERSON"), "g": lambda w=who: (w.given, "PERSON"), "i": lambda w=who: (w.full if w.cjk else f"{w.given[0]}. {w.surname}", "PERSON"),
                "rev": lambda w=who: (w.full if w.cjk else f"{w.surname}, {w.given}", "PERSON"), "email": lambda w=who: (w.email, "EMAIL"), "phone": lambda: (v.phone(), "PHONE"), "addr": lambda: (v.address(), "ADDRESS"),
                "dob": lambda: (v.date(True), "DATE_OF_BIRTH"), "job": lambda: (v.pick(v.w["job"]), "EMPLOYMENT"), "org": lambda: (v.pick(v.w["firm"]), "EMPLOYMENT"), "dept": lambda: (v.pick(v.w["job"]), "EMPLOYMENT"),
                "govid": v.gov_id, "passport": lambda: (v.passport(), "PASSPORT_LICENCE"), "card": lambda: (v.card(), "CREDIT_CARD"), "bank": lambda: (v.bank(), "BANK_ACCOUNT"),
                "handle": lambda: ("@" + v.pick(["blue_kite", "quiet_reed"]) + v.digits(2), "HANDLE"), "ip": lambda: (v.ip(), "IP_PERSONAL"), "id": lambda: (v.member(), "MEMBER_ID"),
            }
            value, kind = made[what]()
            if kind == "PERSON":
                d.categories.add("person_name")
            d.span(value, kind)
        elif slot in ("ORG.email", "ORG.phone", "ORG.addr"):
            d.span(*{"ORG.email": ("info@corvell.example", "EMAIL_GENERIC"), "ORG.phone": (v.hotline(), "PHONE_CORPORATE"), "ORG.addr": (v.address(), "ADDRESS_CORPORATE")}[slot])
        else:
            d.add({"DATE": v.date, "PLACE": lambda: v.pick(v.w["place"]), "CODE": v.code, "AMOUNT": v.amount, "GPS": v.gps, "PW": v.password, "PRODUCT": lambda: "Modell " + v.digits(3), "ORG": lambda: v.pick(v.w["firm"]), "ORG.bank": v.bank, "ORG.regno": lambda: "HRB " + v.digits(5), "HASH": v.machine}[slot]())
    d.high, d.personal = t["sensitivity"] == "high", t["sensitivity"] != "none"


FORMATS: dict[str, tuple[Callable[[Document], None], float]] = {
    f.__name__: (f, w)
    for f, w in (
        (narrative, 0.097), (negative, 0.057), (email_doc, 0.04), (form, 0.046), (csv, 0.029), (chat, 0.017), (boundary, 0.04), (sensitive_list, 0.029), (transaction, 0.029), (self_disclosure, 0.009),
        (topic_article, 0.014), (long_doc, 0.06), (lookalike_doc, 0.017), (nameless_doc, 0.014), (minutes, 0.029), (record, 0.023), (slot_doc, 0.35),
    )
}


def finished(d: Document, name: str) -> dict:
    if re.search(r"\{[A-Za-z_]+\}", d.text):
        raise ValueError(f"leftover placeholder: {d.text}")
    for s, e, _ in d.spans:
        if not d.text[s:e] or d.text[s:e].strip() != d.text[s:e]:
            raise ValueError(f"span {s}-{e} is empty or has white space at an end")
    level = 2 if d.high else int(d.personal)
    return {"lang": d.lang, "format": name, "text": d.text, "spans": [{"start": s, "end": e, "kind": k} for s, e, k in d.spans], "sensitivity": LEVELS[level], "categories": sorted(d.categories)}


def make(seed: int, number: int, lang: str, templates: list[dict] | None = None, only: str | None = None, tag: str = "") -> dict:
    """Document ``number`` of a seed."""
    rng = Random(f"{seed}-{number}-{lang}-{tag}")
    name = only or rng.choices([*FORMATS], weights=[w for _, w in FORMATS.values()])[0]
    d = Document(rng, lang)
    own = [t for t in templates or () if t["lang"] == lang]
    slot_doc(d, rng.choice(own)) if name == "slot_doc" and own else FORMATS[name][0](d)
    return finished(d, name)


def packed(seed: int, number: int, lang: str, coverage: dict, cap: str | None = None) -> dict:
    """Several documents in one of a long length: labels shifted, the level of the most sensitive part, none above ``cap``."""
    rng = Random(f"{seed}-{number}-{lang}-packed")
    _, low, high = rng.choice([e for e in edges(coverage, lang) if e[0] in ("long", "very_long")])
    goal, text, spans, level, cats, k = rng.randint(low, high - 1), "", [], 0, set(), 0
    while len(text) < goal:
        k += 1
        part = make(seed, number, lang, tag=f"part{k}")
        if cap is not None and LEVELS.index(part["sensitivity"]) > LEVELS.index(cap):
            continue
        if text and len(text) + 2 + len(part["text"]) > high * 1.3:
            break
        text += "\n\n" if text else ""
        spans += [{**s, "start": s["start"] + len(text), "end": s["end"] + len(text)} for s in part["spans"]]
        text += part["text"]
        level = max(level, LEVELS.index(part["sensitivity"]))
        cats |= set(part["categories"])
    return {"lang": lang, "format": "packed", "text": text, "spans": spans, "sensitivity": LEVELS[level], "categories": sorted(cats)}


SCHEMA = "id bigint, lang string, format string, text string, spans array<struct<start:int,end:int,kind:string>>, sensitivity string, categories array<string>"


def documents(spark: SparkSession, n: int, seed: int = 1, langs: tuple[str, ...] = LANGS, templates: list[dict] | None = None, partitions: int | None = None) -> DataFrame:
    """``n`` documents, languages in turn; the same rows for a seed at any number of partitions."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([{"id": int(k), **make(seed, int(k), langs[int(k) % len(langs)], templates)} for k in f["id"]], columns=["id", "lang", "format", "text", "spans", "sensitivity", "categories"])

    return spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism).mapInPandas(run, SCHEMA)


def names_seen(reserved: list[str], text: str) -> list[str]:
    """Reserved names in a text: whole words in Latin script, anywhere in others, of two characters or more."""
    return [n for n in reserved if len(n) > 1 and (re.search(rf"(?<!\w){re.escape(n)}(?!\w)", text) if n.isascii() else n in text)]
