"""Made-up sentences with known mentions of personal data, for fitting the tagger.

Names, streets and numbers are put together at random from parts, sentences from
openings, carriers and endings, so that no two are alike and none is a sentence of
any table.
"""

from __future__ import annotations

import random
import re

_GIVEN = {
    "la": "John Maria Emily Anna Peter Sofia Lucas Clara Hugo Ingrid Tomás Zoë Piotr Agnieszka Giulia Marco Inês João Freya Søren Jürgen Käthe Élodie François Nadia Omar Priya Ravi Amara Kofi Linh Mateo Renée Björn Wanda Edith Victor Iris Noah Olive Ruth Walter Mary-Ann Jean-Luc Ana Leif Marta Dmitri Hana".split(),
    "ru": "Анна Иван Мария Пётр Ольга Сергей Елена Павел Нина Юрий Вера Глеб Дарья Кирилл Лидия Максим Тамара Фёдор Снежана Егор Полина Роман".split(),
}
_FAMILY = {
    "la": "Smith Gonzalez Carter Kowalska Novak Keller O'Neill MacLeod Rossi Ferreira Lindqvist Dubois Lefèvre Schneider Müller Weiß Haraldsson Okafor Nguyen Patel Delgado Fontaine Ashworth Brandt Thornbury Whitlock Vasquez Moreau Petit Østergaard Bakker Jansen Winter Stone Field Hargrove Pell Quist Radcliffe Sørensen Tamm Ulrich Voss Wexler Yates Zeller Marsh Holloway Crane".split(),
    "ru": "Иванов Петрова Смирнов Кузнецова Орлов Соколова Лебедев Морозова Туманцевский Белозёрова Громов Зимина Калинин Рябова Чехонин Щукина Ярцев Дубровская".split(),
}
_HAN = "김이박최정강조윤장임민서지현수영준호연우"
_JA_FAMILY = "佐藤 田中 山本 中村 小林 加藤 吉田 山田 灯野 藤波 鈴瀬 白石 森 原".split()
_JA_GIVEN = "花子 太郎 美咲 健一 直樹 陽菜 翔 さくら 恵 誠 ゆき 一郎".split()
_ZH_FAMILY = "王 李 张 刘 陈 杨 赵 黄 周 吴 欧阳 沈 顾 叶".split()
_ZH_GIVEN = "伟 芳 静 丽华 建国 晓明 雨桐 子涵 志强 海燕 文 雪梅".split()
_TOWNS = "Alder Bram Corn Dun East Fal Green Hart Ives Kirk Lang Mar North Oak Pen Quay Rose Stan Thorn Ull Wick".split()
_ENDS = "bridge bury field ford ham mouth port stead ton wick worth brook dale".split()
_TOP = "example.org example.com mail.example post.example.net uni.example.edu kontor.example.de poste.example.fr correo.example.es pochta.example.ru".split()
_HEADS = {
    "en": ["Yesterday", "In the minutes it says that", "According to the note,", "For questions:", "Please note:", "On Monday", "The clerk wrote that", "-", "*", "Contact", "As agreed,", "It was", "Invoice:", "Dear all,", ""],
    "de": ["Gestern", "Laut Protokoll", "Bei Fragen:", "Hinweis:", "Am Montag", "Kontakt:", "-", "Wie vereinbart", ""],
    "fr": ["Hier,", "Selon la note,", "Pour toute question :", "Lundi,", "Contact :", "-", "Comme convenu,", ""],
    "es": ["Ayer", "Según el acta,", "Para preguntas:", "El lunes", "Contacto:", "-", ""],
    "pl": ["Wczoraj", "Według notatki", "W razie pytań:", "Kontakt:", "-", ""],
    "ru": ["Вчера", "По протоколу", "По вопросам:", "Контакт:", "-", ""],
    "ko": ["어제", "문의:", "회의록에 따르면", "-", ""],
    "ja": ["昨日、", "お問い合わせ:", "議事録によると", "・", ""],
    "zh": ["昨天,", "如有疑问:", "据记录,", "·", ""],
}
_BODIES = {
    "en": ["{person} called about the lamp", "{person} and {person} signed the deed", "the parcel for {person} went to {address}", "{person} lives at {address}", "write to {email} or ring {phone}", "ring {phone} and ask for {person}", "Mr {person} left his number, {phone}", "Ms. {person} (ID {id_number}) was present", "{person}'s passport {id_number} was shown", "letters go to {address}", "her mail is {email}", "the number of the card is {id_number}", "Dr {person}, {address}, {phone}", "a reply by {person}, {email}", "signed: {person}", "tel. {phone}, e-mail {email}", "the tenant, {person}, moved to {address} in spring", "SSN: {id_number}", "we met {person} near the quay"],
    "de": ["{person} rief wegen der Lampe an", "Frau {person} wohnt {address}", "Herr {person}, Telefon {phone}", "schreiben Sie an {email}", "Ausweis {id_number} von {person}", "das Paket ging an {person}, {address}", "Tel.: {phone}", "{person} und {person} unterschrieben", "gezeichnet {person}"],
    "fr": ["{person} a appelé au sujet de la lampe", "Mme {person} demeure {address}", "M. {person}, téléphone {phone}", "écrivez à {email}", "carte {id_number} au nom de {person}", "le colis est parti pour {address}", "tél. {phone}", "{person} et {person} ont signé"],
    "es": ["{person} llamó por la lámpara", "la señora {person} vive en {address}", "teléfono {phone}", "escriba a {email}", "documento {id_number} de {person}", "{person} y {person} firmaron"],
    "pl": ["{person} dzwoni w sprawie lampy", "pani {person} mieszka: {address}", "telefon {phone}", "pisz na {email}", "dowód {id_number}, {person}", "PESEL {id_number}"],
    "ru": ["{person} звонит насчёт лампы", "{person} живёт: {address}", "телефон {phone}", "пишите на {email}", "паспорт {id_number}, {person}", "подписали {person} и {person}", "посылка для {person} отправлена: {address}"],
    "ko": ["{person} 씨가 전화했다", "{person}님 주소 {address}", "전화 {phone}", "메일 {email}", "신분증 {id_number}", "담당자 {person}, {phone}"],
    "ja": ["{person}さんから電話があった", "{person}様の住所は{address}", "電話 {phone}", "メールは{email}", "証明書番号 {id_number}", "係の{person}氏"],
    "zh": ["{person}打来电话", "{person}住在{address}", "电话{phone}", "邮箱{email}", "证件号{id_number}", "由{person}签字"],
}
#: Sentences without a mention that look like ones with.
_PLAIN = ["order {n} of {n} lamps, lot {n}-{n}", "the bridge of {town} has {n} arches", "see https://{town}.example/{n}/{n}", "on {n}.{n}.{y} at 14:{n}", "@{town} wrote in {y}", "page {n}, line {n}, ISBN 978-{n}-{n}", "{Town} and {Town} share one hall", "{Town} Street was paved in {y}", "Museum of {Town}, opened {y}", "v{n}.{n}.{n}", "Saint {Town} Day"]


def _digits(rng: random.Random, pattern: str) -> str:
    return re.sub("9", lambda _: str(rng.randrange(10)), pattern)


def _town(rng: random.Random) -> str:
    return rng.choice(_TOWNS) + rng.choice(_ENDS)


def _person(rng: random.Random, lang: str) -> str:
    roll = rng.random()
    if lang == "ko" and roll < 0.8:
        return "".join(rng.choice(_HAN) for _ in range(rng.choice((2, 3, 3, 3, 4))))
    if lang == "ja" and roll < 0.8:
        return rng.choice(_JA_FAMILY) + rng.choice(["", "", " "]) + rng.choice(_JA_GIVEN)
    if lang == "zh" and roll < 0.8:
        return rng.choice(_ZH_FAMILY) + rng.choice(_ZH_GIVEN)
    key = "ru" if lang == "ru" and roll < 0.85 else "la"
    given, family = rng.choice(_GIVEN[key]), rng.choice(_FAMILY[key])
    if rng.random() < 0.3:  # a name that no list has
        end = rng.choice(["в", "ова", "ский", "енко"]) if key == "ru" else rng.choice(["son", "er", "ini", "ek", "ard", "ova", "ez", ""])
        stem = "".join(rng.choice("бвгдклмнпрст") + rng.choice("аеиоу") for _ in range(2)) if key == "ru" else "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.choice((1, 2)))) + rng.choice("lmnrst")
        family = stem.capitalize() + end
    form = rng.random()
    if form < 0.12:
        return f"{given[0]}. {family}"
    if form < 0.2:
        return f"{given} {rng.choice(_GIVEN[key])[0]}. {family}"
    if form < 0.26 and key == "la":
        return f"{given} {rng.choice(['van', 'von', 'de', 'van der', 'de la', 'di'])} {family}"
    if form < 0.32:
        return f"{family}, {given}"
    if form < 0.36:
        return f"{given} {family}-{rng.choice(_FAMILY[key])}"
    return f"{given} {family}"


def _email(rng: random.Random, lang: str) -> str:
    name = re.sub(r"[^a-z.]", "", f"{rng.choice(_GIVEN['la'])}{rng.choice(['.', '', '_'])}{rng.choice(_FAMILY['la'])}".lower()) + rng.choice(["", "", str(rng.randrange(100))])
    host = rng.choice(_TOP + [f"{_town(rng).lower()}.example"])
    at, dot = rng.choice([("@", ".")] * 5 + [(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "[dot]"), ("＠", "."), (" (at) ", " (dot) ")])
    return name + at + host.replace(".", dot)


def _phone(rng: random.Random, lang: str) -> str:
    plain = ["+99 999 999 999", "+9 999 999 9999", "(999) 999-9999", "999-999-9999", "999.999.9999", "+99 (0)99 999 9999", "0999 999999", "+99-99-9999-9999", "00 99 999 9999", "09 99 99 99 99", "9 (999) 999-99-99", "099-9999-9999", "+99 99 9999 9999", "199 9999 9999", "+99 999 9999 9999", "0999/999999", "999 999 999"]
    text = _digits(rng, rng.choice(plain))
    return text + (rng.choice([" ext. 99", " x999", " доб. 99", " 내선 99", " Durchwahl 9", " poste 99"]).replace("9", str(rng.randrange(1, 9))) if rng.random() < 0.12 else "")


def _id_number(rng: random.Random, lang: str) -> str:
    return re.sub("L", lambda _: rng.choice("ABCDEFGHKLMNPRST"), _digits(rng, rng.choice(["999-99-9999", "LL 99 99 99 L", "LL999999L", "L99999999", "999999-9999999", "99999999999999999X", "999999999999999999", "999 999 999", "99999999999", "99999999L", "LLL999999", "99 99 999999"])))


def _address(rng: random.Random, lang: str) -> str:
    town, n, code = _town(rng), rng.randrange(1, 400), rng.randrange(10000, 99999)
    street = rng.choice(_TOWNS + _FAMILY["la"])
    tail = lambda *forms: rng.choice(["", *forms])
    if lang == "de":
        return f"{rng.choice([street + rng.choice(['straße', 'weg', 'gasse', 'allee']), 'Am ' + street, 'Zur ' + street])} {n}{tail('a', 'b')}{tail(f', {code} {town}', f', {town}')}"
    if lang == "fr":
        return f"{n}{tail(' bis')}{tail(',')} {rng.choice(['rue', 'avenue', 'quai', 'chemin', 'boulevard'])} {rng.choice(['de ', 'du ', 'des ', 'de la ', ''])}{street}{tail(f', {code} {town}', f', {town}')}"
    if lang == "es":
        return f"{rng.choice(['calle', 'Calle', 'avenida', 'plaza'])} {tail('de ', 'del ')}{street}, {n}{tail(f', {code} {town}', f', {town}')}"
    if lang == "pl":
        return f"ul. {street}a {n}{tail('/' + str(n % 40 + 1))}{tail(f', {code // 1000}-{code % 1000:03d} {town}', f', {town}')}"
    if lang == "ru":
        return f"{tail('г. Рассветск, ')}{rng.choice(['ул. ', 'пр. ', 'пер. '])}{rng.choice(_FAMILY['ru'])}, {tail('д. ')}{n}{tail(f', кв. {n % 90 + 1}')}"
    if lang == "ko":
        return f"{rng.choice(['서', '한', '강', '새'])}{rng.choice(['빛', '들', '별'])}{rng.choice('시군구')} {rng.choice(['달', '해', '물'])}{rng.choice(['빛', '마루', '내'])}{rng.choice(['로', '길'])} {n}{tail('-' + str(n % 9 + 1))}"
    if lang == "ja":
        return f"{rng.choice(_JA_FAMILY)}{rng.choice('市町区')}{rng.choice(['本町', '港', '東', '緑ヶ丘'])}{n % 9 + 1}-{n % 30 + 1}-{n % 20 + 1}"
    if lang == "zh":
        return f"{rng.choice(['江城', '海州', '云山'])}{tail('市')}{rng.choice(['建设', '中山', '学院', '滨河'])}{rng.choice('路街巷道')}{n}号"
    kind = rng.choice("Street St. Road Lane Terrace Close Drive Hill Row Avenue Way Court Place Square".split())
    return rng.choice([f"{tail(f'Flat {n % 30 + 1}, ', f'Apt {n % 30 + 1}B, ')}{n} {street} {kind}{tail(f', {town}', f', {town} {code}')}", f"P.O. Box {n}{tail(f', {town} {code}', f', {town}')}", f"{n} {street} {kind}{tail(f', Apt {n % 20 + 1}')}, {town}"])


_MAKERS = {"person": _person, "email": _email, "phone": _phone, "id_number": _id_number, "address": _address}


def sample(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A text of some sentences, with the spans of its mentions."""
    lang = rng.choice(["en", "en", "en", *_HEADS])
    text, spans = "", []
    for _ in range(rng.choice((1, 2, 3))):
        text += rng.choice(["", " ", "\n", ". ", "; "]) if text else ""
        if rng.random() < 0.35:
            plain = rng.choice(_PLAIN)
            text += re.sub(r"\{(\w+)\}", lambda m: {"n": str(rng.randrange(1, 9999)), "y": str(rng.randrange(1850, 2024))}.get(m[1], _town(rng).lower() if m[1] == "town" else _town(rng)), plain) + ". "
        head = rng.choice(_HEADS[lang])
        text += head + (" " if head and lang not in ("ja", "zh") else "")
        for part in re.split(r"(\{\w+\})", rng.choice(_BODIES[lang])):
            if part[:1] == "{":
                said = _MAKERS[part[1:-1]](rng, lang)
                spans.append((len(text), len(text) + len(said), part[1:-1]))
                text += said
            else:
                text += part
        text += rng.choice([".", ".", "", ",", " (copy)", "!", "。" if lang in ("ja", "zh") else "."])
    return text, spans
