"""Keyed surrogates for what problem 5 finds: of the value's type, script and format, distinct, and the same for all mentions.

A name is replaced part by part: each given name and each surname of a text has one replacement of its own, so that the full
name, the reversed order, the surname alone and the initial all stay the same person. Given names keep their gender and map
initials one to one; surnames take the words of a pool and, beyond it, compounds of them, so a text may have any number of
people. Digits are drawn digit by digit and check digits are made to fit where the value's own did. An address is a new one
of the same script and of the same parts. Whatever is drawn is drawn again while another value of the text has it.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import unicodedata
from functools import cache, lru_cache

from veilspark.functions import validators

# Words of the surrogates. Latin given names by their initial, then surnames and place words; other scripts likewise.
GIVEN = {
    "f": "Alma Berta Clara Dora Elsa Frida Gilda Hedda Irma Jutta Klara Lidia Marga Nora Olga Petra Quintina Rosa Selma Thea Ursa Vilma Wanda Xenia Yolanda Zita".split(),
    "m": "Albin Bruno Conrad Dario Egon Falk Gregor Hugo Ignaz Jonas Kasimir Linus Milo Nando Oskar Pavel Quirin Rufus Samir Tibor Ulrik Viktor Wendel Xaver Yannick Zoran".split(),
}
SURNAMES = {
    "latin": "Arvell Bostrick Calvane Dorrit Elmbach Farrow Gantner Hollick Ivarsen Jarnel Kestner Lormand Mandrel Norvik Ostrel Pallant Quister Rendal Sorvin Tarnow".split(),
    "ja": "山本 田村 小川 石田 森本 原田 中島 藤井 岡崎 松永".split(),
    "zh": list("王李张刘陈杨赵黄周吴"),
    "ko": list("김이박최정강조윤장임"),
    "kana": "ヤマモト タムラ オガワ イシダ モリモト ハラダ ナカジマ フジイ".split(),
}
OTHER_GIVEN = {
    "ja": {"f": "花子 美咲 由美 直子 恵子 久美 典子 早紀".split(), "m": "太郎 一郎 健二 誠司 修平 和夫 正人 浩一".split()},
    "zh": {"f": "丽华 美玲 秀英 雪梅 玉兰 春燕 素芬 慧敏".split(), "m": "建国 志强 伟明 文斌 立军 国栋 永康 学文".split()},
    "ko": {"f": "영희 미숙 은주 수진 지영 혜경 정란 순자".split(), "m": "철수 민호 성호 준영 동현 재석 상철 기태".split()},
    "kana": {"f": "ハナコ ミサキ ユミ ナオコ ケイコ クミ".split(), "m": "タロウ イチロウ ケンジ マコト カズオ ヒロシ".split()},
}
PLACES = {
    "latin": "Almaren Brovik Cardell Dunholt Esterol Falmine Gorwald Hesperon Ilmarsh Jorveen Kelsom Lundor Marwick Nordeel Olvane Pernhal Quarrin Rostell Silvane Torvald".split(),
    "ja": "青葉 若草 緑野 美里 高砂 清水 朝日 光".split(), "zh": "和平 建设 光明 新华 红星 长安 友谊 幸福".split(), "ko": "중앙 평화 청솔 한빛 새싹 은하 무궁 단풍".split(),
}
STREETS = {
    "en": "Street Road Avenue Lane".split(), "de": "straße weg allee gasse".split(), "fr": "rue avenue place chemin".split(), "es": "Calle Avenida Paseo Plaza".split(),
    "it": "via viale piazza corso".split(), "pt": "Rua Avenida Praça Travessa".split(),
}
FEMALE_TITLES = frozenset("mrs ms miss frau fr mme mlle sra srta dña sig.ra sigra dott.ssa dra 女士 小姐 여사".split())
MALE_TITLES = frozenset("mr herr hr m sr sig dott don 先生".split())
FEMALE_ENDS = {"ja": "子美香奈花恵代", "zh": "丽美玲英梅兰芳娟霞婷雪燕", "ko": "희숙은주영미경선자란", "kana": "コミナカエ"}
PARTICLES = frozenset("de del la las los da do dos di della van von der den zu y e".split())

_KANA, _HAN, _HANGUL = re.compile("[ァ-ヴー]"), re.compile("[一-鿿々]"), re.compile("[가-힣]")
_OTHER = re.compile("[^0-9A-Za-z]+")
_COUNTRY = re.compile(r"[\s(]*\+\s?\d{2}|[\s(]*00\s?\d{2}")
_PARTS = re.compile(r"[^\s,・\-‐‑]+")
_WORD, _POST = re.compile(r"[^\W\d_]+"), re.compile(r"(?<!\d)\d{4,6}(?!\d)")


@lru_cache(1 << 16)
def bare(word: str) -> str:
    """A word without case and accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word.casefold()) if not unicodedata.combining(c))


@cache
def _keyed(key: str):
    return hashlib.blake2b(key=key.encode()[:64], digest_size=32)


def draw(key: str, what: str) -> int:
    """256 bits that the key and what they are for decide."""
    h = _keyed(key).copy()
    h.update(what.encode("utf-8", "surrogatepass"))
    return int.from_bytes(h.digest(), "big")


@lru_cache(1 << 16)
def _first(key: str, role: str, part: str) -> int:
    """Where in its pool the replacement of a part of a name is looked for first."""
    return draw(key, f"{role}\x1f{part}")


@cache
def _permutation(key: str) -> str:
    """Which initial stands for which."""
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    for i in range(len(letters) - 1, 0, -1):
        j = draw(key, f"initial\x1f{i}") % (i + 1)
        letters[i], letters[j] = letters[j], letters[i]
    return "".join(letters)


def composed(pool: list[str], n: int, joint: str) -> str:
    """The n-th word of a pool that goes on without end: its words, then compounds of two, of three, and so on."""
    words = [pool[n % len(pool)]]
    while n >= len(pool):
        n = n // len(pool) - 1
        words.append(pool[n % len(pool)])
    return joint.join(reversed(words))


def _plain(value: str) -> str:
    """The ASCII letters and digits of a value."""
    return value if value.isascii() and value.isalnum() else _OTHER.sub("", value)


def _luhn(number: str) -> bool:
    """Whether the digits of a card add up."""
    twice = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[ord(c) - 48] for c in number[-2::-2])
    return (twice + sum(ord(c) - 48 for c in number[::-2])) % 10 == 0


def _rest97(account: str) -> int:
    """The remainder that an account number's check digits bring to 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


#: First letters of foreigners' numbers and the digits they stand for.
_NIE = str.maketrans("XYZ", "012")
def _nif_letter(digits: str) -> str:
    return validators.NIF_LETTERS[int(digits.upper().translate(_NIE)) % 23]


#: Length, letter first and letter last of a number, and the rule that numbers of this shape may keep.
_CHECKS = {
    (9, False, True): validators.is_nif_es, (9, True, True): validators.is_nif_es, (18, False, False): validators.is_resident_id_cn, (18, False, True): validators.is_resident_id_cn,
    (16, True, True): validators.is_codice_fiscale, (13, False, False): validators.is_rrn_kr,
}


_SMALL, _LARGE, _TEN = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26**10
_PLACES = frozenset(map(bare, PLACES["latin"]))


class Surrogates:
    """Replacements of one text of the language ``lang``. Values come in the legible form of :func:`personal.legible`."""

    def __init__(self, key: str, lang: str):
        if not key:
            raise ValueError("surrogates need a key")
        self.key, self.lang = key, lang
        self.parts: dict[tuple[str, str], str] = {}  # (role, part) to its replacement
        self.taken: set[tuple[str, str]] = set()  # (role, replacement)
        self.whole: dict[tuple[str, str], str] = {}  # (kind, value in one form) to its replacement
        self.numbers: dict[tuple[str, str], int] = {}
        self.count: dict[str, int] = {}
        self.one: dict[tuple[str, str], str] = {}  # a value as written to its one form
        self.done: dict[tuple[str, str], str] = {}  # a value as written to its replacement
        self.met: dict[tuple[str, str], int] = {}  # a mention to its number
        self.givens: dict[str, str] = {}  # given name to gender
        self.persons: dict[tuple[str, str], str] = {}  # (initial or "", surname) to the fullest mention
        self.cut: dict[str, list[tuple[str, str, str]]] = {}
        self.initials = _permutation(key)

    # ---- who is who ----

    def script(self, value: str) -> str:
        if value.isascii() or max(value) < "\u1100":
            return "latin"
        if _HANGUL.search(value):
            return "ko"
        if _HAN.search(value):
            return "ja" if self.lang == "ja" else "zh"
        return "kana" if _KANA.search(value) else "latin"

    def split(self, value: str) -> list[tuple[str, str, str]]:
        kept = self.cut.get(value)
        if kept is None:
            kept = self.cut[value] = self._split(value)
        return kept

    def _split(self, value: str) -> list[tuple[str, str, str]]:
        if value and (value.isascii() or max(value) < "\u02b0") and "," not in value and "-" not in value and "\n" not in value and "\t" not in value and "  " not in value and value[0] != " " != value[-1]:  # words and single blanks
            return self._words(value.split(" "))
        kind = self.script(value)
        if kind != "latin":
            joined = re.sub(r"[\s・]", "", value)
            cut = re.search(r"[\s・]", value)
            long = cut.start() if cut else {"zh": 1, "ko": 1, "ja": 2, "kana": min(4, len(joined) - 1)}[kind]
            known = [s for (role, s) in self.parts if role == "s" and joined.startswith(s)] if not cut else []
            long = max(map(len, known), default=long)
            if len(joined) <= long:
                return [("s", joined, value)]
            return [("s", joined[:long], value[:long]), *([("-", "", value[long : len(value) - len(value[long:].lstrip(" ・　"))])] if cut else []), ("g", joined[long:], joined[long:])]
        words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\s,]+", value)]
        if not words:
            return [("-", "", value)]
        comma = value.find(",")
        if comma >= 0:
            given = {k for k, (_, a, _b) in enumerate(words) if a > comma}
        elif len(words) == 1:
            given = {0} if bare(words[0][0]) in self.givens or len(words[0][0].rstrip(".")) == 1 else set()
        else:
            given = {0} | {k for k, (w, _, _b) in enumerate(words[:-1]) if len(w.rstrip(".")) == 1}
        out, at = [], 0
        for k, (w, a, b) in enumerate(words):
            if a > at:
                out.append(("-", "", value[at:a]))
            for m in re.finditer(r"[^\-‐‑]+|[\-‐‑]", w):
                one = m[0]
                if one in "-‐‑" or bare(one) in PARTICLES and len(words) > 1:
                    out.append(("-", "", one))
                elif k in given and (len(one.rstrip(".")) == 1 or re.fullmatch(r"(?:\w\.)+\w?\.?", one)):
                    out.append(("i", one.casefold(), one))
                else:
                    out.append(("g" if k in given else "s", bare(one), one))
            at = b
        return [*out, ("-", "", value[at:])] if at < len(value) else out

    def _words(self, words: list[str]) -> list[tuple[str, str, str]]:
        """As :meth:`split`, of the words of a name without comma or hyphen."""
        out, last = [], len(words) - 1
        for k, w in enumerate(words):
            part = bare(w)
            initial = len(w.rstrip(".")) == 1 or "." in w and re.fullmatch(r"(?:\w\.)+\w?\.?", w)
            given = initial or part in self.givens if not last else not k or k < last and len(w.rstrip(".")) == 1
            if k:
                out.append(("-", "", " "))
            if last and part in PARTICLES:
                out.append(("-", "", w))
            else:
                out.append(("i", w.casefold(), w) if given and initial else ("g" if given else "s", part, w))
        return out

    @staticmethod
    def canonical(kind: str, form: str) -> str:
        """What all mentions of a value have in common, from its legible form."""
        if kind in ("phone", "number"):
            return _plain(form.casefold()) if form.isascii() else re.sub(r"[\W_]", "", form.casefold())
        form = " ".join(form.casefold().split())
        if kind == "email" and not ("@" in form and " " not in form and "(" not in form and "[" not in form):
            form = re.sub(r"[ ]?[\[(][ ]?(?:at|arroba|chiocciola)[ ]?[\])][ ]?|[ ]?@[ ]?", "@", form)
            return re.sub(r"[ ]?[\[(][ ]?(?:dot|punto|punkt|point)[ ]?[\])][ ]?", ".", form).replace(" ", "")
        return form

    def entity(self, kind: str, value: str) -> int:
        """1, 2, ... in the order of first mention within a type. Mentions of one person have one number."""
        known = self.met.get((kind, value))
        if known is not None:
            return known
        if kind != "person_name":
            name = self.one[kind, value] = self.canonical(kind, value)
        else:
            roles = self.split(value)
            given = "".join(p for r, p, _ in roles if r == "g")
            surnames = [p for r, p, _ in roles if r == "s"]
            surname = surnames[0 if self.lang in ("es", "pt") else -1] if surnames else ""  # the one that is used alone
            initial = given[:1] or next((p[:1] for r, p, _ in roles if r == "i"), "")
            for who in ((given, surname), (initial, surname), ("", surname), (given, "")):
                if any(who) and who in self.persons and (who[0] == given or not given or who != ("", surname)):
                    name = self.persons[who]
                    break
            else:
                name = f"{given or initial} {surname}"
            if given and surname:
                name = self.persons.setdefault((given, surname), name if name == f"{given} {surname}" else f"{given} {surname}")
                for who in ((initial, surname), ("", surname), (given, "")):
                    self.persons.setdefault(who, name)
            else:
                self.persons.setdefault((given or initial, surname), name)
        one = (kind, name)
        if one not in self.numbers:
            self.count[kind] = self.count.get(kind, 0) + 1
            self.numbers[one] = self.count[kind]
        self.met[kind, value] = self.numbers[one]
        return self.numbers[one]

    # ---- replacements ----

    def replace(self, kind: str, value: str, title: str = "") -> str:
        """The surrogate of a value. ``title`` is the word before a name, which may tell its gender where it is first met."""
        new = self.done.get((kind, value))
        if new is None:
            new = self.done[kind, value] = self._replace(kind, value, title)
        return new

    def _replace(self, kind: str, value: str, title: str) -> str:
        if kind == "person_name":
            return self._name(value, title)
        one = (kind, self.one.get((kind, value)) or self.canonical(kind, value))
        if one not in self.whole:
            make = {"email": self._email, "postal_address": self._address, "number": self._number}.get(kind, self._shaped)
            for n in itertools.count():
                new = make(value, n)
                low = self.canonical(kind, new)
                if (kind, low) not in self.taken and low != one[1]:
                    break
            self.taken.add((kind, low))
            self.whole[one] = new
        return self.whole[one]

    def _name(self, form: str, title: str) -> str:
        roles = self.split(form)
        kind = self.script(form)
        female, out = None, []
        for role, part, written in roles:
            if role == "-":
                out.append(written)
                continue
            if role == "i":
                new = "".join(self.initials[ord(b) - 65] if "A" <= (b := bare(c).upper()[:1] or c) <= "Z" else c for c in written)
            elif (new := self.parts.get((role, part))) is None:
                if role == "g" and female is None:  # told by the name as a whole, where a part of it is new
                    female = self._female(title, "".join([p for r, p, _ in roles if r == "g"]), kind)
                new = self._part(role, part, kind, bool(female))
            if len(written) > 1:
                new = new.upper() if written.isupper() else new.lower() if written.islower() else new
            out.append(new)
        return "".join(out)

    def _female(self, title: str, given: str, kind: str) -> bool:
        said = title.rstrip(".").casefold()
        if said in FEMALE_TITLES or said in MALE_TITLES:
            return said in FEMALE_TITLES
        if given in self.givens:
            return self.givens[given] == "f"
        return given.endswith(("a", "e")) if kind == "latin" else given[-1:] in FEMALE_ENDS[kind] and bool(given)

    def _part(self, role: str, part: str, kind: str, female: bool) -> str:
        if (role, part) not in self.parts:
            if role == "g":
                self.givens[part] = "f" if female else "m"
            latin = kind == "latin"
            pool = SURNAMES[kind] if role == "s" else GIVEN["f" if female else "m"] if latin else OTHER_GIVEN[kind]["f" if female else "m"]
            first = part[:1].upper()
            for n in itertools.count():
                if role == "g" and latin and "A" <= first <= "Z":  # the initial is that which initials of this letter get
                    new = GIVEN["f" if female else "m"][ord(self.initials[ord(first) - 65]) - 65]
                    new += "" if not n else "-" + composed(pool, (_first(self.key, "second", part) + n) % len(pool) if n < len(pool) else n, "-")
                else:
                    start = _first(self.key, role, part) % len(pool)
                    new = composed(pool, (start + n) % len(pool) if n < len(pool) else n, "-" if latin else "")
                if (role, bare(new)) not in self.taken and bare(new) != part:
                    break
            self.taken.add((role, bare(new)))
            self.parts[role, part] = new
        return self.parts[role, part]

    def _shaped(self, value: str, n: int) -> str:
        """Digits for digits, letters for letters of the same case; a country's code stays."""
        kept = _COUNTRY.match(value) if value[:1] in "+(0 " else None
        start = kept.end() if kept else 0
        seed = draw(self.key, f"shape\x1f{value}\x1f{n}")
        letters, at, out = seed, 3, []
        if len(value) - start <= 40 and value.isascii():  # as below, for what one draw suffices for
            some = left = 0
            digits = ""
            for ch in value[start:]:
                if ch.isdigit():
                    digits = digits or f"{seed:077d}"
                    out.append(digits[at])
                    at += 1
                elif ch.isalpha():
                    if not left:
                        letters, some = divmod(letters, _TEN)
                        left = 10
                    left -= 1
                    some, d = divmod(some, 26)
                    out.append(_SMALL[d] if ch >= "a" else _LARGE[d])
                else:
                    out.append(ch)
            return value[:start] + "".join(out)
        digits = f"{seed:077d}"
        for ch in value[start:]:
            if "0" <= ch <= "9":
                if at == 77:
                    digits, at = f"{draw(self.key, f"{value}\x1f{n}\x1f{len(out)}"):077d}", 3
                out.append(digits[at])
                at += 1
            elif "a" <= ch <= "z" or "A" <= ch <= "Z":
                letters, d = divmod(letters or draw(self.key, f"letters\x1f{value}\x1f{n}\x1f{len(out)}"), 26)
                out.append(chr((97 if ch >= "a" else 65) + d))
            elif ch.isdecimal():
                letters, d = divmod(letters or draw(self.key, f"letters\x1f{value}\x1f{n}\x1f{len(out)}"), 10)
                out.append(chr(ord(ch) - unicodedata.decimal(ch) + d))
            elif ch.isalpha() and "a" <= bare(ch)[:1] <= "z":
                letters, d = divmod(letters or draw(self.key, f"letters\x1f{value}\x1f{n}\x1f{len(out)}"), 26)
                out.append(chr((97 if ch.islower() else 65) + d))
            else:
                out.append(ch)
        return value[:start] + "".join(out)

    def _number(self, value: str, n: int) -> str:
        """As shaped, with the check digit or letter that makes the new number as valid as the old."""
        plain = _plain(value)
        new = self._shaped(value, n)
        if len(plain) > 14 and plain[:2].isalpha() and plain[2:4].isdigit() and _rest97(plain) == 1:
            new = value[:4] + new[4:]
            digits = _plain(new)
            digits = "".join(c if old.isalpha() == c.isalpha() else c for c, old in zip(digits, plain, strict=True))
            rest = _rest97(digits[:2] + "00" + digits[4:])
            check = f"{98 - rest:02d}"
            at = [i for i, c in enumerate(new) if c.isalnum()][2:4]
            return "".join(check[at.index(i)] if i in at else c for i, c in enumerate(new))
        shape = (len(plain), plain[:1].isalpha(), plain[-1:].isalpha())
        rule = _CHECKS.get(shape) or (_luhn if 13 <= len(plain) <= 19 and plain.isdigit() else None)
        if rule is validators.is_nif_es:
            rule = rule if plain[1:-1].isdigit() and plain[0].upper() in "0123456789XYZ" and plain[-1].upper() == _nif_letter(plain[:-1]) else None
        elif rule is not None and not rule(value if rule is validators.is_rrn_kr else plain.upper()):
            rule = _luhn if rule is not _luhn and 13 <= len(plain) <= 19 and plain.isdigit() and _luhn(plain) else None
        if rule is None:
            return new
        keep = value[:1] if rule is validators.is_nif_es and value[:1].isalpha() else ""
        new = keep + new[len(keep) :]
        if rule in (validators.is_resident_id_cn, validators.is_rrn_kr, validators.is_codice_fiscale):  # a date of birth inside must stay one
            new = "".join(b if i in self._dated(plain, value, rule) else a for i, (a, b) in enumerate(zip(new, value, strict=True)))
        last = max(i for i, c in enumerate(new) if c.isalnum())
        if rule is validators.is_nif_es:  # its letter follows from its digits
            return new[:last] + _nif_letter(_plain(new[:last])) + new[last + 1 :]
        for c in "0123456789X" if rule is not validators.is_nif_es and rule is not validators.is_codice_fiscale else "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
            if rule(new[:last] + c if rule is validators.is_rrn_kr else _plain(new[:last] + c).upper()):
                return new[:last] + c + new[last + 1 :]
        return new

    @staticmethod
    def _dated(plain: str, value: str, rule) -> set[int]:
        """Places of month and day, which a drawn digit would make impossible."""
        at = [i for i, c in enumerate(value) if c.isalnum()]
        inside = range(10, 14) if rule is validators.is_resident_id_cn else range(2, 7) if rule is validators.is_rrn_kr else range(6, 11)
        return {at[i] for i in inside}

    def _email(self, mail: str, n: int) -> str:
        local, _, _ = self.canonical("email", mail).partition("@")
        return f"{self._shaped(local, n)}@mail{draw(self.key, f"{mail}\x1f{n}") % (900 * (1 + n)) + 100}.example"

    def _address(self, value: str, n: int) -> str:
        """An address of the same script: street and house number, and the unit, postcode and town that the old one has."""
        seed = draw(self.key, f"address\x1f{value}\x1f{n}")
        d = [seed >> 32 * i & 0xFFFFFFFF for i in range(6)]
        kind = self.script(value)
        kind = "ja" if kind == "kana" else kind if kind == "latin" or self.lang not in ("ja", "zh", "ko") else self.lang
        if kind == "latin" and self.lang in ("ja", "zh", "ko"):
            kind = self.lang
        pool = PLACES[kind]
        old = {bare(w) for w in _WORD.findall(value)}
        words = (pool if old.isdisjoint(_PLACES) else [w for w in pool if bare(w) not in old]) if kind == "latin" else [w for w in pool if not set(w) & set(value)] or pool
        street, town = composed(words, d[0] % len(words) + len(words) * (n // 8), ""), words[d[1] % len(words)]
        house, post = d[2] % 280 + 1, _POST.search(value)
        if kind == "ja":
            return f"{town}市{street}{d[3] % 9 + 1}丁目{d[4] % 40 + 1}番{house % 30 + 1}号"
        if kind == "zh":
            return f"{town}区{street}路{house}号"
        if kind == "ko":
            return f"{town}시 {street}로 {house}"
        types = [t for t in STREETS.get(self.lang, STREETS["en"]) if bare(t) not in old] or STREETS["en"]
        sort = types[d[3] % len(types)]
        line = f"{house} {street} {sort}" if self.lang == "en" else f"{street}{sort} {house}" if self.lang == "de" else f"{house} {sort} {street}" if self.lang == "fr" else f"{sort} {street}, {house}"
        code = "".join(str(d[5] // 10**i % 10) for i in range(len(post[0]))) if post else ""
        tail = f"{town}, {code}" if self.lang == "en" and code else f"{code} {town}".strip()
        return f"{line}, {tail}" if "," in value or post else line
