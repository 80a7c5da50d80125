"""Personal information in free text: found, and replaced by a placeholder of its kind.

Regular expressions propose spans; checksums confirm or refute numbers (the identity number of
ISO 7064 MOD 11-2, mod-97, Luhn); words close by raise or lower the score of what is left. A span
counts from a score of 0.5. Kinds: email, phone, id_number, address, name.

The expressions see a folded text: full-width characters, invisible ones, kinds of spaces,
separated accents and look-alike letters inside a word of another script are put right first; each
folded character knows its place in the text, so replacing leaves the rest as it was.
"""

from __future__ import annotations

import bisect
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from papersluice.llm.lookalike import LOOKALIKES, table
from papersluice.session import spread

KINDS = ("email", "phone", "id_number", "address", "name")
NEED = 0.5
#: Characters before and after a span in which context words count.
BEFORE, AFTER = 28, 20

# --- folding ---------------------------------------------------------------------------------

_PLAIN = regex.compile(r"^[\x09\x0a\x0d\x20-\x7e¡-¬®-ɏЀ-џ一-鿿‘-”–—…、-〟！-／：-＠（）№]*$")
_LATIN, _OTHER = regex.compile(r"\p{Latin}"), regex.compile(r"[\p{Cyrillic}\p{Greek}]")
_WORD = regex.compile(r"\w+")
_BEFORE_AT, _AFTER_AT = regex.compile(r"(?r)[\w.+-]*\s?$"), regex.compile(r"\s?[\w.-]*")
#: Characters of an e-mail address on either side of its sign.
ADDRESS_SIDE = 256
_TO_LATIN = {ord(x): to for to, xs in LOOKALIKES.items() if to.isascii() and to.isalpha() for x in xs}
_TO_CYRILLIC = {ord(to): x for to, xs in LOOKALIKES.items() if to.isascii() and to.isalpha() for x in xs if "Ѐ" <= x <= "ӿ" and x in "АВЕКМНОРСТУХІЈЅаеорсухіјѕ"}
_WIDTH = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {0x3000: " "}


def _mixed(text: str) -> list[regex.Match]:
    """Words of Latin and other letters."""
    if not _OTHER.search(text) or not _LATIN.search(text):
        return []
    return [m for m in _WORD.finditer(text) if _OTHER.search(m.group()) and _LATIN.search(m.group())]


def fold(text: str) -> tuple[str, list[int] | None]:
    """The folded text, and for each of its characters (and its end) the place in ``text``; None if they agree."""
    if text.isascii():
        return text, None
    if _PLAIN.match(text) and not _mixed(text):
        return text.translate(_WIDTH), None
    drop = table()
    out: list[str] = []
    at: list[int] = []
    for i, c in enumerate(text):
        cp = ord(c)
        if cp in _WIDTH:
            c = _WIDTH[cp]
        elif unicodedata.combining(c) and out:
            joined = unicodedata.normalize("NFC", out[-1] + c)
            if len(joined) == 1:
                out[-1] = joined
                continue
        elif cp > 0x7F:
            to = drop.get(cp)
            if to == "":
                continue
            if to == " " or to and not c.isalpha():
                c = to[:1]
        out.append(c)
        at.append(i)
    joined = "".join(out)
    for m in _mixed(joined):
        word = m.group()
        foreign = [c for c in word if c.isalpha() and 0x36F < ord(c) < 0x530]
        to = _TO_LATIN if all(ord(c) in _TO_LATIN for c in foreign) else _TO_CYRILLIC
        out[m.start() : m.end()] = [to.get(ord(c), c) for c in word]
    sign = joined.find("@")
    while sign >= 0:  # an address is Latin throughout
        a = _BEFORE_AT.search(joined, max(0, sign - ADDRESS_SIDE), sign).start()
        z = _AFTER_AT.match(joined, sign + 1, sign + 1 + ADDRESS_SIDE).end()
        out[a:z] = [_TO_LATIN.get(ord(c), c) for c in out[a:z]]
        sign = joined.find("@", sign + 1)
    return "".join(out), [*at, len(text)]


# --- checksums -------------------------------------------------------------------------------


def resident_id(digits: str) -> bool:
    """18 characters: a possible date of birth and an ISO 7064 MOD 11-2 check character."""
    d = digits.upper()
    if len(d) != 18 or not ("1850" < d[6:10] < "2100" and "01" <= d[10:12] <= "12" and "01" <= d[12:14] <= "31"):
        return False
    total = 0
    for c in d[:17]:
        total = (total + int(c)) * 2 % 11
    return (12 - total) % 11 == (10 if d[17] == "X" else int(d[17]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    """Mod-97 over the rearranged number."""
    t = regex.sub(r"\W", "", text).upper()
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def insee(digits: str) -> bool:
    """15 digits, the last two of which are 97 less the rest mod 97."""
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


# --- rules -----------------------------------------------------------------------------------


@dataclass
class Rule:
    kind: str
    pattern: regex.Pattern
    #: Score by shape alone.
    base: float
    #: Confirms (True, score 1), refutes (False) or leaves open (None).
    check: Callable[[regex.Match], bool | None] | None = None
    #: Whether context words change the score.
    context: bool = True


def _digits(m: regex.Match) -> str:
    return regex.sub(r"[^0-9Xx]", "", m.group())


def _re(pattern: str, flags: int = 0) -> regex.Pattern:
    return regex.compile(pattern, flags | regex.V0)


#: Words for identity numbers.
_ID_WORDS = r"身份证|证件|证号|护照|社保|passport|passeport|pasaporte|паспорт|reisepass|\bpass|ausweis|ID card|identity|national insurance|NINO|social security|\bSSN|\bNIR|s[ée]cu(?:rit[ée] sociale)?|\bDNI|\bNIE|СНИЛС|ИНН|steuer-?id|sozialversicherung\w*|carte d.identit[ée]|seguridad social"
#: Words that speak for a kind when they stand just before, and against it.
FOR = {
    "phone": _re(r"(?i)(?:\btel|\bt[ée]l|phone|mobil\w*|\bcell|\bfax|\bcall|reach\w*|handy|r[üu]ckruf|durchwahl|telefon|joindre|portable|llamar|m[óo]vil|звонить|тел|факс|моб|电话|手机|致电|传真|联系方式|座机|\bor|;|,|/)[\s.:：n°º№(+]*(?:unter|on|at|au|al|to|по)?[\s.:：]*$"),
    "id_number": _re(rf"(?i)(?:{_ID_WORDS})[\s.:：,#-]*(?:nummer|no|nr|n|number|num[ée]ro|n[úu]mero|号码|号|серия)?[\s.:：°º№#-]*(?:[Nn][or°º]?\.?)?[\s.:：№]*$"),
}
AGAINST = {
    "phone": _re(r"(?i)(?:\blot|order|isbn|issn|\bsize|ticks?\s*=?|batch|serial|s/n|imei|订单号?|流水号?|单号|编号|批次|序号|货号|node|host|\bip|version|\bv|code|item|no\.? of|account|invoice|commande|bestell\w*|auftrag\w*|pedido|lote|заказ\w*|партия|0x|#|=|_)[\s.:：#№=-]*$"),
    "id_number": _re(r"(?i)(?:\blot|order|isbn|issn|\bsize|ticks?\s*=?|batch|serial|s/n|imei|订单号?|流水号?|单号|批次|序号|货号|item|0x|=|_)[\s.:：#№=-]*$"),
}
#: The same just after it, in brackets.
FOR_AFTER = {
    "phone": _re(r"(?i)^\s?[(（\[]\s?(?:tel|t[ée]l|phone|mobil|cell|fax|handy|portable|m[óo]vil|моб|тел|факс|手机|电话|传真|座机)"),
    "id_number": _re(r"(?i)^\s?[(（\[]\s?(?:passport|passeport|pasaporte|reisepass|ausweis|ID card|SSN|NINO|DNI|NIE|NIR|паспорт|СНИЛС|身份证|护照|证件)"),
}
UNITS_AFTER = _re(r"(?i)^\s*(?:bytes?|KB|MB|GB|octets|px|mm|cm|kg|页|行|份|次|个|%)")

#: A number ends where no digit follows, or where a year written out begins.
_END = r"(?:(?!\d)|(?=(?:19|20)\d{2}年))"
_AT = r"(?:\s?@\s?|\s?[\[({<]\s?(?:at|arroba|собака)\s?[\])}>]\s?|\s(?:AT|at|arroba|собака)\s)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|punto|punkt|point|точка)\s?[\])}>]\s?|\s(?:DOT|dot)\s)"
_EMAIL = _re(rf"(?<![A-Za-z0-9._+%-])[A-Za-z0-9][A-Za-z0-9._+%-]*(?i:{_AT})[A-Za-z][A-Za-z0-9-]*(?:(?i:{_DOT})[A-Za-z0-9-]+?)*(?i:{_DOT})(?:[a-z]{{2,12}}(?![a-z])|[A-Z]{{2,12}}(?![A-Z]))")
_SPELLED_AT = _re(r"(?i)[\[({<]\s?(?:at|arroba|собака)\s?[\])}>]|\s(?:at|arroba|собака)\s")
_FILE_END = _re(r"(?i)\.(?:png|jpe?g|gif|svg|webp|bmp|tiff?|ico|css|js|py|java|txt|docx?|xlsx?|pptx?|pdf|zip)$")

_PHONES = [
    # international prefix
    (_re(r"(?<![A-Za-z0-9=#])(?:\+|00)(?:1|7|33|34|39|41|43|44|49|86)[\s./()-]*(?:\(0\))?(?:[\s./()-]*\d){8,11}" + _END), 0.6),
    # North America
    (_re(r"(?<![\d.+=#_-])(?<![A-Za-z])(?:1[\s.-])?(?:\(\d{3}\)\s?|\d{3}[\s.-])\d{3}[\s.-]\d{4}(?![.-]\d)" + _END), 0.5),
    (_re(r"(?<![A-Za-z0-9_.+=#-])[2-9]\d{2}[2-9]\d{6}" + _END), 0.2),
    # Britain, Germany
    (_re(r"(?<![A-Za-z0-9_.+=#-])0\d{2,4}[\s/-]+\d{3,4}[\s-]?\d{2,5}(?:[\s-]\d{2,4})?" + _END), 0.5),
    (_re(r"(?<![A-Za-z0-9_.+=#-])\(0\d{2,4}\)[\s/-]*\d{3,4}[\s-]?\d{3,5}" + _END), 0.5),
    (_re(r"(?<![A-Za-z0-9.+=#_-])0\d{2,3}[\s-]?\d{7,8}" + _END), 0.35),
    # France
    (_re(r"(?<![A-Za-z0-9_.+=#-])0[1-9](?:[\s.-]?\d{2}){4}" + _END), 0.35),
    (_re(r"(?<![A-Za-z0-9_.+=#-])0[1-9](?:[.]\d{2}){4}" + _END), 0.5),
    # Spain
    (_re(r"(?<![A-Za-z0-9_.+=#-])[5-9]\d{2}[\s.]\d{2,3}[\s.]\d{2,3}(?:[\s.]\d{2,3})?" + _END), 0.2),
    # Russia
    (_re(r"(?<![A-Za-z0-9_.+=#-])8?\s?\(\d{3,5}\)\s?\d{1,3}-\d{2}-\d{2}" + _END), 0.5),
    # China: mobile
    (_re(r"(?<![A-Za-z0-9.+=#_-])1[3-9]\d[\s-]?\d{4}[\s-]?\d{4}" + _END), 0.5),
]

_IDS = [
    (_re(r"(?<![0-9A-Za-z=_])[1-9]\d{5}[\s-]?(?:18|19|20)\d{2}[01]\d[0-3]\d[\s-]?\d{3}[\dXx]" + _END), 0.2, lambda m: resident_id(_digits(m))),
    # Britain: two letters, six digits, a letter
    (_re(r"(?<![A-Za-z0-9])[A-CEGHJ-PQR-TW-Z]{2}[\s-]?\d{2}[\s-]?\d{2}[\s-]?\d{2}[\s-]?[A-D](?![A-Za-z0-9])"), 0.6, None),
    (_re(r"(?<![\w-])\d{3}[\s-]\d{2}[\s-]\d{4}(?![\d-])"), 0.1, None),
    # passports and cards of letters and digits
    (_re(r"(?<![A-Za-z0-9])[A-ZΑ-ΩА-Я]{1,2}\s?\d{6,9}" + _END), 0.0, None),
    (_re(r"(?<![A-Za-z0-9])[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{7,8}\d?(?![A-Za-z0-9])"), 0.0, None),
    (_re(r"(?<!\d)\d{2}\s?\d{2}\s?\d{6}" + _END), 0.0, None),
    (_re(r"(?<![A-Za-z0-9])(?:\d{8}|[XYZ]-?\d{7})-?[A-HJ-NP-TV-Z](?![A-Za-z0-9])"), 0.1, None),
    (_re(r"(?<!\d)\d{3}-\d{3}-\d{3}[\s-]\d{2}" + _END), 0.3, None),
    (_re(r"(?<!\d)[12]\s?\d{2}\s?[01]\d\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2}" + _END), 0.0, lambda m: insee(_digits(m))),
    (_re(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){3,7}(?:\s?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"), 0.0, lambda m: iban(m.group())),
    (_re(r"(?<![\d.-])(?:\d{4}[\s-]){3}\d{4}(?![\d-])"), 0.0, lambda m: luhn(_digits(m))),
]

# A word of a street: capitalised, or all capitals.
_W = r"(?:\p{Lu}[\p{L}’'.-]+)"
_STREET_EN = r"(?:Street|Str?|Road|Rd|Avenue|Ave|Lane|Ln|Boulevard|Blvd|Close|Drive|Dr|Way|Court|Ct|Place|Square|Sq|Terrace|Crescent|Row|Gardens|Hill|Mews|Walk|Grove|Parade|STREET|ROAD|RD|AVENUE|AVE|LANE|LN|BLVD|CLOSE|DRIVE|WAY|COURT|PLACE|SQUARE)"
_STREET_DE = r"(?:stra(?:ß|ss)e|str\.|platz|weg|gasse|allee|ufer|ring|damm|steig|hof|graben|STRASSE|STRAßE|PLATZ|WEG|GASSE|ALLEE)"
_STREET_FR = r"(?:rue|avenue|av\.|boulevard|bd\.?|quai|impasse|all[ée]e|chemin|place|passage|route|cours|sentier|ruelle|RUE|AVENUE|QUAI|IMPASSE|PLACE)"
_STREET_ES = r"(?:[Cc]alle|C/|[Aa]venida|Avda\.?|[Pp]laza|Pl\.|[Pp]aseo|P\.º|[Cc]amino|[Tt]raves[íi]a|[Rr]onda|[Cc]allej[óo]n|CALLE|AVENIDA|PLAZA|PASEO|CAMINO)"
_STREET_RU = r"(?:ул\.?|улица|пер\.?|переулок|пр\.|просп\.?|пр-т|проспект|б-р|бульвар|наб\.?|набережная|ш\.|шоссе|пл\.|площадь|проезд|аллея|тупик)"
_ADDRESSES = [
    _re(rf"(?<![\w/.-])\d{{1,4}}[A-Za-z]?,?\s(?:{_W}\s){{1,3}}{_STREET_EN}\b(?!\s[\p{{Lu}}][a-z]+ing\b)"),
    _re(rf"(?<!\w)(?:\p{{Lu}}[\p{{L}}-]*{_STREET_DE}|(?:{_W}\s){{0,2}}(?:Straße|Weg|Platz|Allee|Gasse|Ufer|Am \p{{Lu}}\p{{L}}+|An der \p{{Lu}}\p{{L}}+|Im \p{{Lu}}\p{{L}}+))\s\d{{1,4}}\s?[a-z]?(?![\w.])"),
    _re(rf"(?<![\w/.-])\d{{1,4}}(?:\s?(?:bis|ter))?,?\s{_STREET_FR}\s(?:(?:de|du|des|la|le|les|aux?|d[’']|l[’']|DE|DU|DES|LA|AUX?)\s?){{0,3}}\p{{Lu}}[\p{{L}}’'-]+"),
    _re(rf"(?<!\w){_STREET_ES}\s?(?:(?:de|del|la|las|los|el|DE|DEL|LA)\s){{0,3}}(?:{_W}\s?){{1,3}},?\s?(?:n\.?[ºo°]\s?)?\d{{1,4}}(?!\w)"),
    _re(rf"(?<!\w){_STREET_RU}\s(?:\p{{Lu}}[\p{{L}}-]+\s?){{1,3}},?\s?(?:д\.|дом)?\s?\d{{1,4}}"),
    _re(rf"(?<!\w)(?:\p{{Lu}}[\p{{L}}-]+\s){{1,2}}{_STREET_RU},?\s?(?:д\.|дом)?\s?\d{{1,4}}"),
]
#: What in a text makes it worth trying the expressions above, in order.
_STREET_SIGNS = [
    tuple(" Street| St| Road| Rd| Avenue| Ave| Lane| Ln| Boulevard| Blvd| Close| Drive| Dr| Way| Court| Ct| Place| Square| Sq| Terrace| Crescent| Row| Gardens| Hill| Mews| Walk| Grove| Parade| STREET| ROAD| RD| AVENUE| AVE| LANE| LN| BLVD| CLOSE| DRIVE| WAY| COURT| PLACE| SQUARE".split("|")),
    tuple("straße|strasse|str.|platz|weg|gasse|allee|ufer|ring|damm|steig|hof|graben|STRASSE|STRAßE|PLATZ|WEG|GASSE|ALLEE|Straße|Weg|Platz|Allee|Gasse|Ufer|Am |An der |Im ".split("|")),
    tuple("rue|avenue|av.|boulevard|bd|quai|impasse|allée|allee|chemin|place|passage|route|cours|sentier|RUE|AVENUE|QUAI|IMPASSE|PLACE".split("|")),
    tuple("alle|C/|venida|vda|laza|Pl.|aseo|P.º|amino|raves|onda|callej|Callej|CALLE|AVENIDA|PLAZA|PASEO|CAMINO".split("|")),
    *[tuple("ул|пер|пр|б-р|бульвар|наб|ш.|шоссе|пл|аллея|тупик".split("|"))] * 2,
]
#: Chinese addresses: a kind of street and a number; what stands before is looked at from there, so that no run of ideographs is tried twice.
_HAN_STREET = _re(r"(?<=[一-鿿])(?:大道|街道|胡同|路|街|巷|弄|里|道)(?:[东南西北]段)?\d{1,5}(?:号|弄)(?:院)?(?:\d{1,4}(?:栋|幢|座|号楼|单元|室|层))*(?:\d{1,4}(?:室)?" + _END + ")?")
_HAN_RUN = regex.compile(r"(?r)[一-鿿]+$")
_HAN_AREA = "省市区县镇乡州"
#: Ideographs of a street's or an area's name, and areas before a street.
HAN_NAME_LENGTH, HAN_AREAS = 6, 4
_NOT_STREET = _re(r"(?i)^(?:\d+,?\s)?(?:first|second|third|north|south|east|west)?\s?(?:street lighting|the)\b")

# --- names

_CAP = r"\p{Lu}\p{Ll}+(?:[’'-]\p{Lu}\p{Ll}+)*"
_UP = r"\p{Lu}{2,}(?:[’'-]\p{Lu}{2,})*"
_INIT = r"\p{Lu}\.(?:[\s-]?\p{Lu}\.)?"
_PERSON = rf"(?:{_CAP}\s(?:{_INIT}\s)?{_CAP}|{_UP}\s{_UP}|{_CAP},\s{_CAP}|{_UP},\s{_UP}|{_INIT}\s?(?:{_CAP}|{_UP})|(?:{_CAP}|{_UP}),?\s{_INIT})"
#: What stands before or after a person in each language.
_LEAD = (
    r"(?i:full name|name|vorname und nachname|nom et prénom|nom|nombre y apellidos|nombre|имя|фио)(?=:)|(?:Mrs?|Ms|Miss|Dr|Prof|Sir|Madam)\.?|(?i:signed(?: by)?|prepared by|written by|drafted by|approved by|reviewed by|submitted by|issued by|attn|attention|dear|contact|c/o|cc|from|to|for|by|as|per|a call with|call with|spoke (?:to|with)|sincerely|regards|employee|applicant|recipient|author|tenant|patient|Miss|deliver to)"
    r"|(?i:Herrn?|Frau|Hr\.|Fr\.|laut|gezeichnet|gez|i\. ?A|i\. ?V|unterschrift|Ansprechpartner(?:in)?|zu H[äa]nden(?: von)?|z\. ?Hd(?:\.? ?v(?:on)?)?|bearbeitet von|erstellt von|gepr[üu]ft von|Sachbearbeit(?:er|erin|ung)|Empf[äa]nger(?:in)?|Antragsteller(?:in)?|Sehr geehrter? (?:Herr|Frau)|Lieber?)"
    r"|(?:M|MM|Mme|Mlle|Me)\.?|(?i:monsieur|madame|selon|sign[ée]e?|contacter|contact|à l[’']attention de|attention de|r[ée]dig[ée] par|transmis par|valid[ée] par|vu par|destinataire|demandeur|demandeuse|cher|ch[èe]re|par)"
    r"|(?:D|D[ªa]|Dña|Do[ñn]a|Don|Sr|Sra|Srta)\.?|(?i:se[ñn]ora?|firmado(?: por)?|firma|atentamente|seg[úu]n|contacto|a la atenci[óo]n de|redactado por|revisado por|solicitante|destinatari[oa]|estimad[oa]|por)"
    r"|(?i:г-н|г-жа|господин|госпожа|гражданин|гражданка|подписал[аи]?|исполнитель|исполнил[аи]?|согласовал[аи]?|утвердил[аи]?|заявитель|получатель|отправитель|контакт(?:ное лицо)?|ответственн(?:ый|ая)|по словам|со слов|составил[аи]?|уважаем(?:ый|ая)|от)"
)
_TRAIL = (
    r"(?:lives|asked for|wrote|signed|writes|called|requested|requests|approved|confirmed|will|has (?:signed|asked|approved)|says|said|on the draft|hat (?:unterschrieben|unterzeichnet|angerufen|gegengezeichnet|zugestimmt)|bittet|schrieb|unterschrieb|zeichnet|bat um|a (?:relu|sign[ée]|demand[ée]|valid[ée]|appel[ée]|confirm[ée])|demande|pide|pidi[óo]|firm[óo]|solicita|solicit[óo]|ha (?:firmado|pedido|revisado|solicitado)|revis[óo]|prosit|просит|подписал[аи]?|написал[аи]?|сообщил[аи]?|запросил[аи]?|согласовал[аи]?)"
)
_WHO = _re(rf"(?<![\p{{L}}\d_@.])(?P<who>{_PERSON})(?![\p{{L}}\d@_])")
_LED = _re(rf"(?<![\p{{L}}\d_@.])(?P<lead>{_LEAD})(?P<mark>[.:,]?)\s{{1,2}}$")
_TRAILED = _re(rf"\s(?:{_TRAIL})(?!\p{{L}})")
_INITIAL = _re(r"\p{Lu}\.")
#: Leads too common to make any capitalised pair a name: a colon, an initial or what follows has to support them.
_WEAK_LEAD = _re(r"(?i)^(?:from|to|for|by|as|per|cc|par|por|от|contact|deliver to)$")
#: Leads behind which a name may have further parts.
_FULL_LEAD = _re(r"(?i)^(?:full name|name|vorname und nachname|nom|nom et prénom|nombre|nombre y apellidos|имя|фио)$")
_FURTHER = _re(rf"(?:[^\S\r\n]{_CAP}){{1,2}}(?![\p{{L}}\d@_])")
#: Characters before a name in which its lead stands.
LED_BEFORE = 40

#: Surnames, the most frequent first.
_SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚"
    "邵万钱严覃武戴莫孔向汤常温康施文牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁岳翟殷詹申欧耿关兰焦俞左柳甘祝包宁尚符舒阮柯纪梅童凌毕单季裴霍涂成苗谷曲盛冉翁蓝骆路游靳"
    "褚卫尤戚喻柏窦奚郎昌凤鲍费廉岑滕邬傅皮卞元卜穆萧湛祁禹狄米贝臧伏谈茅屈闵麻娄刁虞房裘缪宗宣郁杭洪诸吉钮嵇荣荀羊沙权"
)
#: Surnames that more often begin a word than a name.
_AMBIGUOUS = "华水云花乐时平和明计项席强危支管经干解应"
#: Surnames of two characters.
_COMPOUND = "欧阳|上官|司马|诸葛|司徒|东方|独孤|南宫|夏侯|皇甫|尉迟|公孙|慕容|长孙|宇文|令狐|端木|百里|呼延|轩辕"
_HAN_NAME = rf"(?:(?:{_COMPOUND})[一-鿿]{{1,2}}|[{_SURNAMES}][一-鿿]{{1,2}})"
_HAN_LEAD = r"(?:联系人|经办人|申请人|收件人|签收人|负责人|审批人|审核人|起草人|承办人|寄件人|办理人|值班员|当事人|会签|请转交|转交给?|抄送|姓名|签字|批准人|记录人|核对人|户名|呈报?|致函|委托人|投诉人|举报人|代理人)[：:\s]{0,2}"
_HAN_NAMES = [
    _re(rf"{_HAN_LEAD}(?P<who>{_HAN_NAME})"),
    _re(rf"{_HAN_LEAD}(?<=[：:]\s?)(?P<who>[{_AMBIGUOUS}][一-鿿]{{1,2}})(?![一-鿿])"),
    _re(rf"由(?P<who>{_HAN_NAME})(?:签收|签字|签名|代签|经办|审批|负责|转交|领取|确认)"),
    _re(rf"(?<![一-鿿])(?P<who>{_HAN_NAME})(?:同志|先生|女士|小姐|老师|经理|主任|科长|处长|局长|书记|已在|已签|来电|敬上|本人)"),
    _re(rf"[（(](?P<who>{_HAN_NAME})[）)]"),
]
_HAN_SIGN = _re(rf"{_HAN_LEAD}|由|同志|先生|女士|小姐|老师|经理|主任|科长|处长|局长|书记|已在|已签|来电|敬上|本人|[（(]")
_NOT_NAMES = _re(r"(?i)\b(?:Programme|Program|Project|Tender|Harbour|Street|Road|Bridge|Office|Bureau|Department|Report|Team|Valley|River|Centre|Center|Hall|Depot|Unit|Act|Plan|Desk|Board|Street Lighting|Item|Version|About|Please|Once|Only|Each|The|No|On)\b")


@dataclass
class Span:
    kind: str
    start: int
    end: int
    score: float


def _context(kind: str, text: str, start: int, end: int) -> float:
    before = text[max(0, start - BEFORE) : start]
    out = 0.0
    if kind in FOR and FOR[kind].search(before):
        out += 0.5
    if kind in AGAINST and AGAINST[kind].search(before):
        out -= 0.7
    if kind in FOR_AFTER and FOR_AFTER[kind].match(text[end : end + AFTER]):
        out += 0.5
    if kind == "phone" and UNITS_AFTER.match(text[end : end + AFTER]):
        out -= 0.7
    return out


_DIGITS = _re(r"\d(?:[\s./()+-]{0,3}\d){5}")
_ID_WORD = _re(rf"(?i){_ID_WORDS}")


def _western(text: str, m: regex.Match) -> tuple[float, int]:
    """The score of a proposed name by what stands before and after it, and the name's end."""
    score, end = 0.0, m.end("who")
    led = _LED.search(text, max(0, m.start("who") - LED_BEFORE), m.start("who"))
    if led:
        weak = _WEAK_LEAD.match(led["lead"]) and led["mark"] != ":"
        score += 0.3 if weak else 0.7
        if weak and _INITIAL.search(m["who"]):
            score += 0.3
        if _FULL_LEAD.match(led["lead"]) and (more := _FURTHER.match(text, end)):
            end = more.end()
    if _TRAILED.match(text, end):
        score += 0.6
    return score, end


def _han_addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _HAN_STREET.finditer(text):
        reach = (HAN_NAME_LENGTH + 1) * (HAN_AREAS + 1)
        run = _HAN_RUN.search(text, max(0, m.start() - reach), m.start()).start()
        start = max(run, m.start() - HAN_NAME_LENGTH)
        edge = m.start()
        for _ in range(HAN_AREAS):  # area by area to the left
            area = max((text.rfind(c, max(run, edge - HAN_NAME_LENGTH - 1), edge - 1) for c in _HAN_AREA), default=-1)
            if area <= run:
                break
            start, edge = max(run, area - HAN_NAME_LENGTH), area
        yield start, m.end()


class _Spans:
    """Spans without overlaps; what came first takes precedence."""

    def __init__(self):
        self.found: list[Span] = []

    def add(self, kind: str, a: int, b: int, score: float) -> None:
        if score < NEED:
            return
        at = bisect.bisect_left(self.found, a, key=lambda s: s.start)
        if (at == 0 or self.found[at - 1].end <= a) and (at == len(self.found) or b <= self.found[at].start):
            self.found.insert(at, Span(kind, a, b, min(score, 1.0)))


def spans(folded: str) -> list[Span]:
    """Accepted spans in a folded text, in order, without overlaps; earlier kinds take precedence.

    Expressions are tried only on texts that hold what they can't do without: digits in a row, a word
    for an identity number where the shape alone is not enough, a kind of street, a lead.
    """
    out = _Spans()
    if "@" in folded or _SPELLED_AT.search(folded):
        for m in _EMAIL.finditer(folded):
            if not _FILE_END.search(m.group()):
                out.add("email", *m.span(), 0.9)
    digits = _DIGITS.search(folded)
    word = _ID_WORD.search(folded)
    if digits or word:
        for pattern, base, check in _IDS:
            if not word and base < NEED and not check:
                continue
            for m in pattern.finditer(folded):
                verdict = check(m) if check else None
                if verdict is not False:
                    out.add("id_number", *m.span(), (1.0 if verdict else base) + _context("id_number", folded, *m.span()))
    for pattern, signs in zip(_ADDRESSES, _STREET_SIGNS):
        if any(x in folded for x in signs):
            for m in pattern.finditer(folded):
                if not _NOT_STREET.match(m.group()):
                    out.add("address", *m.span(), 0.7)
    if "号" in folded or "弄" in folded:
        for a, z in _han_addresses(folded):
            out.add("address", a, z, 0.7)
    if digits:
        for pattern, base in _PHONES:
            for m in pattern.finditer(folded):
                out.add("phone", *m.span(), base + _context("phone", folded, *m.span()))
    for m in _WHO.finditer(folded, overlapped=True):
        score, end = _western(folded, m)
        if score >= NEED and not _NOT_NAMES.search(m["who"]):
            out.add("name", m.start("who"), end, score)
    if not folded.isascii() and _HAN_SIGN.search(folded):
        for pattern in _HAN_NAMES:
            for m in pattern.finditer(folded):
                out.add("name", *m.span("who"), 0.7)
    return out.found


def find(text: str) -> list[Span]:
    """Spans of personal information in ``text``, by its own offsets."""
    folded, at = fold(text)
    out = spans(folded)
    if at is not None:
        out = [Span(s.kind, at[s.start], at[s.end], s.score) for s in out]
    return out


def redact(text: str, found: list[Span] | None = None) -> str:
    """``text`` with each span replaced by a placeholder such as [EMAIL]."""
    out, last = [], 0
    for s in find(text) if found is None else found:
        out += [text[last : s.start], f"[{s.kind.upper()}]"]
        last = s.end
    return "".join([*out, text[last:]])


def find_personal(records: DataFrame) -> DataFrame:
    """``field``, ``rec_id``, ``kinds`` (sorted, without repeats) and ``redacted`` of the records that hold personal information.

    Null and empty texts hold none; repeated rows count once; an empty table gives no rows. Texts of
    any length are searched whole. Nothing but the resulting rows is shuffled.
    """
    kind = records.schema["rec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, kinds, texts = [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                if t and (found := find(t)):
                    keep.append(i)
                    kinds.append(sorted({s.kind for s in found}))
                    texts.append(redact(t, found))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())],
                names=["field", "rec_id", "kinds", "redacted"],
            )

    usable = records.select("field", "rec_id", "text").where("text IS NOT NULL AND text <> ''")
    return spread(usable).mapInArrow(run, f"field string, rec_id {kind}, kinds array<string>, redacted string").distinct()
