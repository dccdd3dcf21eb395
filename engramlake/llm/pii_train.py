"""Labelled spans and the training of ``pii``; run as a module with a folder of tables.

Sentences are written from carrier phrases whose slots are personal data of known type, and from plain
sentences of the corpus whose subject (a role, as "the night shift") gives way to a made-up name; so
every span is labelled by construction. Names are put together from syllables of several kinds and
from common names of the world. Plain sentences with a carrier phrase of personal data, or with a word
of a person's node, are not used. At most ``MAX_PLAIN`` plain sentences are drawn; the number of steps
is fixed, so the weights don't depend on the machine's speed.
"""

from __future__ import annotations

import random
import re
import sys

import numpy as np

from engramlake.llm import pii

MAX_PLAIN, SAMPLES, EPOCHS, BATCH, LENGTH = 60000, 90000, 5, 256, 120
LIMIT = 0.5  # of the transitions that the tags allow: emissions must decide, so that most text needs no sweep
# Common given names and surnames of the world, for training only.
GIVEN = """James John David Mary Linda Emily Oliver Noah Lucas Ethan Mia Sofia Charlotte Amelia Harper Evelyn Logan Mason Hannah Grace Chloe Lily Ruby Alice Jack Harry George Oscar Archie Arthur Henry Ali Yusuf Ahmed Ibrahim Aisha
Layla Maryam Hassan Karim Tariq Samir Salma Wei Jun Ming Mei Hao Akira Haruto Yui Sakura Takeshi Naoki Minjun Jiwoo Arjun Ananya Rahul Neha Vikram Deepak Sunita Rajesh Anil Pooja Ngozi Chidi Emeka Kwame Abena Tunde Femi Lars Anders
Freja Nils Sigrid Erik Kristin Jürgen Klaus Heike Dieter Günther Sabine Petra Monika Andreas Stefan Wolfgang Pierre Jean Camille Amélie Hélène Giulia Marco Giovanni Paolo Alessandro Lorenzo Maria José Juan Luis Carlos Miguel Javier Ana
Lucía Pavel Sergei Ivan Tatiana Yulia Svetlana Oleg Igor Andrei Maksim Galina Zoya Piotr Agnieszka Tomasz Kasia Zoltán Ágnes Elif Mehmet Ayşe Emre Dina Yael Noam Anh Linh Minh Siti Budi Putri"""
SURNAMES = """Smith Johnson Brown Jones Garcia Miller Davis Rodriguez Martinez Lopez Gonzalez Wilson Anderson Taylor Moore Jackson Martin Lee Perez White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Green
Adams Baker Hall Rivera Campbell Mitchell Carter Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Neumann Schwarz Krüger Rossi Russo Ferrari Esposito Bianchi Romano Colombo Dubois
Moreau Laurent Lefebvre Leroy Fournier Girard Ivanov Smirnov Kuznetsov Popov Sokolova Lebedev Kozlova Novikov Morozov Volkov Sato Suzuki Takahashi Watanabe Ito Yamamoto Nakamura Kobayashi Kim Park Choi Jung Kang Singh Kumar Sharma Patel
Reddy Khan Das Joshi Mehta Okafor Adeyemi Mensah Owusu Hansen Johansen Olsen Larsen Nilsson Eriksson Lindberg Virtanen Kowalski Nowak Silva Santos Oliveira Souza Pereira Costa O'Brien O'Connor McDonald MacLeod Al-Hassan El-Sayed Yılmaz"""
HAN_FAMILY = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文翁祝柏窦章云奚葛费岑殷毕邬倪喻凌骆樊霍虞管柯莫裴"
HAN_TWO = "欧阳 司马 上官 诸葛 东方 皇甫 尉迟 公孙 慕容 司徒".split()
SYL = [c + v for c in "b br d f g gr h j k kw l m n p r s st t tr v z".split() for v in "aeiou"]
HAN_GIVEN = "岚澄彦笙予知舟汐霁禾川宁屿棠远安嘉晨宇轩涵梓欣怡雨泽浩然子墨思琪俊杰文静婷雪峰磊洋明亮佳慧敏辉健超颖丽娜芳强军伟平华建国清若兮念初遥望星月言书意白青木南北山海一诺志鹏飞鑫龙凤玉兰梅秀英红霞玲燕萍莉莎薇蕾瑶瑾萱璇珊晓冬春秋夏立新东方成功德才贵福祥瑞麟卓越凡尘羽翔昊天空谷溪"
HAN_PLACE = "竹星海松月云明石风兰青安"
SUBJECTS = {
    "en": "the user|the assistant|our neighbor|the night shift|an old classmate|the book club|someone in the channel|a regular guest|the project lead|the group owner|the new moderator|a teammate",
    "de": "der Nutzer|der Assistent|ein Kollege|die neue Moderation|unsere Nachbarin|jemand im Kanal|die Gruppenleitung|die Projektleitung",
    "es": "el usuario|el asistente|la nueva moderadora|un compañero|alguien del canal|la jefa de proyecto|la dueña del grupo|nuestra vecina",
    "ru": "пользователь|ассистент|коллега|наш сосед|новый модератор|владелец группы|руководитель проекта|кто-то из канала",
    "zh": "用户|机器人助手|助手|群主|楼下邻居|老同学|一位同事|夜班组|新来的管理员|频道里的人|项目负责人",
}
CARRIER = re.compile(r"@|\(at\)|\[at\]| at \S+ dot |call me|number|tel\.|tfno|text \d|ruf mich|llámame|номер|звоните|手机号|电话|加我|SSN|passport|national id|insurance|Ausweis|documento|DNI|NIE|паспорт|证件|身份证|live at|deliver|moved, now|send the|envíalo|dirección|Adresse|Paket an|адрес|доставьте|快递寄|我家|发到|邮箱|联系方式|mail|correo|Postfach|schreib|escríbe|пишите|name is|mein Name|me llamo|меня зовут|我叫|ask |frag |pregunta|спросите|找|说.*可以|will bring the|cell|Ausweis|\+\d")
NAME = {
    "en": "ask {N} about {X}|my name is {N}, nice to meet you|{N} will bring the notebook|{N} said {X} is fine|{N} and {N} meet in {X}|thanks to {N} for the tent|I met {N} at {X}|cc {N}|signed, {N}|Dr. {N} called|Mr. {N} left the parcel|talk to {N} or {N}|{N}: ok|this is {N} from {X}|Prof. {N} Jr. wrote|{N} / {N}|owner {N}|by {N}|{N}",
    "de": "frag {N} nach {X}|mein Name ist {N}|{N} bringt das Paket|Herr {N} kommt nach {X}|danke an {N}|Grüße von {N}",
    "es": "me llamo {N}|pregunta a {N} por {X}|{N} traerá el telescopio|Sra. {N} llega a {X}|gracias a {N}",
    "ru": "спросите {N} про {X}|меня зовут {N}|{N} привезёт телескоп|спасибо, {N}|это {N} из {X}",
    "zh": "我叫{N}，第一次来|找{N}拿磨豆机|{N}说{X}可以|{N}会带笔记本来|请转告{N}|谢谢{N}帮忙|{N}和{N}都同意|问一下{N}|{N}你好|{N}",
}
MAILS = {
    "en": "you can write to {E} any time|mail: {E}|cc {E} on the {X} thread|{E} is where the invoice went|My address is {E}, don't share it.|contact={E};verified=false|<{E}>|send it to {E}|reach me: {E}|email me at {E} please|{E}",
    "de": "schreib bitte an {E}|Postfach: {E}, Stand 16.10.|meine Adresse ist {E}",
    "es": "escríbeme a {E} cuando puedas|correo {E} (nuevo)|mi correo es {E}",
    "ru": "пишите на {E}, пожалуйста|почта: {E}|мой адрес {E}",
    "zh": "发到{E}就行|我的邮箱是{E}，别外传|联系方式：{E}|邮箱 {E}",
}
PHONES = {
    "en": "call me at {P} after six|new number {P}, the old one is dead|tel. {P}|text {P} if the notebook arrives|(cell) {P} / ask for the tent|my phone: {P}|reach me on {P}|{P}",
    "de": "ruf mich unter {P} an|Telefon {P}|Tel.: {P}, abends",
    "es": "llámame al {P} por la tarde|tfno {P}|mi teléfono es {P}",
    "ru": "мой номер {P}, звоните вечером|тел. {P}|телефон: {P}",
    "zh": "我的手机号{P}，晚上打|电话：{P}|加我 {P} 聊{X}|手机 {P}",
}
IDS = {
    "en": "my SSN is {D}, needed for the tent|passport no. {D} expires on May 11|national id: {D}|about my insurance number, it's {D}|ID card {D}|tax number {D}",
    "de": "Ausweisnummer {D}|meine Steuernummer ist {D}|Personalausweis: {D}",
    "es": "el documento {D} caduca el 12/3|DNI {D}|mi NIE es {D}",
    "ru": "номер паспорта: {D}|паспорт {D} действует|мой паспорт {D}",
    "zh": "身份证号{D}，办小提琴要用|证件号码：{D}|我的身份证是{D}",
}
STREETS = {
    "en": "I live at {S}, ring twice|deliver to: {S}|we moved, now it's {S}|send the parcel to {S}|moved the projector to {S}|my address: {S}",
    "de": "schick das Paket an: {S}|wohnhaft unter folgender Adresse: {S}|ich wohne unter der folgenden Adresse: {S}|Lieferung an {S}",
    "es": "envíalo a {S}|mi dirección: {S}|vivo en {S}",
    "ru": "доставьте сюда: {S}|мой адрес: {S}|живу: {S}",
    "zh": "快递寄到{S}|我家在{S}，到了打电话|地址：{S}|住在{S}",
}
PLAIN = "order no. {n8} left the depot|tracking {n8} shows no change|invoice {n3}-{n3} was paid|see section {n2}-{n2}-{n2} of the manual|ISBN 000-0-00-{n8}|timestamp 17{n8}|订单号{n8}已发货|快递单号{n8}没有更新|server 192.0.2.{n2} answered in {n3} ms|version {n3}.{n3}.0 of {X} is out|commit ac{n2}c3f fixed {X}|the ratio was 16:9 at 1920x1080|@night_owl_{n2} pinged the bot|[pixelfox | 04:{n2}] ok|room A{n2}, floor {n2}, seat F{n2}|Mount {X} and {X} Valley|Project {X} moved to {X} Harbor|the {X} Foundation Ltd opened in {X}|kiwi_{n3} ~|gm_north!|柠檬茶_{n3}|热心网友 ~|memory-bot|tea_cat_{n2}|阿星_{n3}|小鹿!|moonbyte|qwerty_{n3}|({X}, {X}, {X}, {X})|{X}, {X}, {X}, {X}, {n3} and {X}.|{X}, {X} und {X}|{X}, {X}, {X}|{X} and {X} are open|room {n2}, floor {n2}, seat {n3}|{n2} {X} and {n3} boxes|the {X} service restarted itself|test {X} crashed again|they counted {n3} birds near {X}|up to Mount {X}, then down to {X} Valley|how cats raise {n2} kittens|carry the tent to Mount {X} by May|Die Rechnung ist da|Der Termin in {X} steht|Das Paket kommt nach {X}|I'll be in {X}|hello there|hi there|good night all|see you soon|thanks a lot|ok then|no idea|why not|well done|never mind|buenas noches|hasta luego|guten tag|bis bald|привет всем|до завтра|大家好|晚安|mea culpa, {X}|note saved: fetch the {X} box|{n3}块钱太贵了|timestamp 1{n8}{n1}|build {X} number {n3} failed|unix time 1{n8}{n1}|we flew to {Q} in {X}|{Q} is far away|an article about {Q}|{Q}, {X} and {X}|the {Q} meeting|{Q} ist weit weg|fuimos a {Q}|{Q} 很远"


# further carriers of every kind, so that no phrase is needed to know an item
MORE = {
    "en": "please forward this to {N} before noon|{N} and {N} were absent|according to {N} the {X} deal is off|{N} wrote the first draft|meeting with {N}, {N} and {N}|yours sincerely, {N}|as {N} pointed out, {X} is closed|we hired {N} last spring|{N} (born 1984) lives abroad|photo by {N}|the keys are with {N}|contact {N} at {E} or {P}|{N}, {S}|{N} <{E}>|name: {N}, phone: {P}, mail: {E}|passport {D}, issued to {N}|ship it to {N}, {S}|fax {P}|dial {P} for the desk|whatsapp {P}|our hotline is {P}|reply to {E} by Friday|{E} bounced again|log in as {E}|his id is {D}|licence {D}|Passport {D}|social security: {D}|office: {S}|he moved to {S} last year|pick me up at {S}|the flat at {S} is empty|invoice address {S}",
    "de": "{N} hat angerufen|laut {N} ist {X} zu|Frau {N} hat {X} übernommen|Herr {N} sah {X} gestern|mit freundlichen Grüßen {N}|bitte an {N} weiterleiten|Rückfragen an {E} oder {P}|erreichbar unter {P}|Mobil {P}|Reisepass {D}|die Wohnung in der {S} ist leer|treffen wir uns: {S}|{N}, {S}",
    "es": "{N} llamó ayer|según {N}, {X} está cerrado|atentamente, {N}|reenvía esto a {N}|contacto: {E} o {P}|móvil {P}|pasaporte {D}|la oficina está en {S}|nos vemos en {S}|{N}, {S}",
    "ru": "{N} звонил вчера|по словам {N}, {X} закрыт|с уважением, {N}|перешлите это {N}|контакт: {E} или {P}|моб. {P}|загранпаспорт {D}|офис находится: {S}|встретимся: {S}|{N}, {S}",
    "zh": "{N}昨天来过电话|据{N}说{X}关门了|此致，{N}|把这个转给{N}|有事联系{N}，电话{P}|热线{P}|护照{D}|办公室在{S}|在{S}见|收件人{N}，{S}|签名：{N}|由{N}负责{X}",
}


# Capitalised phrases that name no person.
PHRASES = "New York|Los Angeles|San Francisco|Hong Kong|United Nations|Mount Everest|Big Ben|North Sea|South Africa|Costa Rica|Red Cross|World Bank|European Union|Christmas Day|Black Friday|Good Morning|Happy Birthday|Machine Learning|Visual Studio|Star Wars|Game Night|Open Source|Project Apollo|Lake Garda|Rio Grande|Buenos Aires|Den Haag|Big Bang Theory|Monday Morning|Art Museum|Central Park|Town Hall|Old Harbor|Green Valley|Book Club|Night Shift|Pull Request|User Guide|Credit Card|Terms Of Service|Rote Kreuz|Deutsche Bahn|Bad Homburg|Santa Cruz|Puerto Rico|Новый Год|Красная Площадь|Нижний Новгород".split("|")


def low(rng: random.Random, lo: int = 2, hi: int = 4) -> str:
    return "".join(rng.choice(SYL) for _ in range(rng.randint(lo, hi)))


def place(rng: random.Random, lang: str) -> str:
    if lang == "zh":
        return "".join(rng.choice("莫波卡达兰佩伍萨尼米贝托鲁诺塞雷克温霍泽哈奇胡维耶吉约纳古杜德") for _ in range(3))
    w = (low(rng) + rng.choice(["", "", "x", "l", "r", "n", "s"])).capitalize()
    return pii.cyrillic(w) if lang == "ru" and rng.random() < 0.5 else w


ONSET, NUCLEUS, CODA = "b c d f g h j k l m n p r s t v w y z br ch cl cr dr fl fr gl gr kh kr pl pr sh sk sl st str th tr zh".split(), "a e i o u a e i o ai au ea ei ia ie io oo ou".split(), ["", "", "", "l", "m", "n", "r", "s", "t", "k", "d", "nd", "rt", "ng", "ck", "ll", "nn", "x"]
ENDING = ["", "", "", "", "son", "man", "ton", "ov", "ova", "ev", "enko", "ski", "ez", "ini", "ano", "elli", "sen", "berg", "mann", "er", "ard", "ford", "wood", "ley", "ian", "oglu", "moto", "mura", "wala", "ani"]


def word(rng: random.Random, least: int, most: int) -> str:
    """A name-like word of varied sound."""
    return "".join(rng.choice(ONSET + [""]) + rng.choice(NUCLEUS) + rng.choice(CODA) for _ in range(rng.randint(least, most)))


def given_name(rng: random.Random) -> str:
    r = rng.random()
    return rng.choice(GIVEN.split()) if r < 0.45 else low(rng, 2, 3).capitalize() if r < 0.6 else word(rng, 1, 3).capitalize()


def surname(rng: random.Random) -> str:
    r = rng.random()
    return rng.choice(SURNAMES.split()) if r < 0.25 else low(rng, 2, 4).capitalize() if r < 0.65 else (word(rng, 1, 2) + rng.choice(ENDING)).capitalize()


def person(rng: random.Random, lang: str) -> str:
    if lang == "zh" and rng.random() < 0.75:
        f = rng.choice(HAN_TWO) if rng.random() < 0.04 else rng.choice(HAN_FAMILY)
        return f + "".join(rng.choice(HAN_GIVEN) for _ in range(rng.choice([1, 2, 2])))
    g, s = given_name(rng), surname(rng)
    if len(g) < 2:
        g += "n"
    if len(s) < 2:
        s += "u"
    if lang == "ru" and rng.random() < 0.5:
        g, s = pii.cyrillic(g), pii.cyrillic(s)
    if rng.random() < 0.03:
        s = rng.choice(["de ", "van ", "von ", "di ", "bin ", "van der "]) + s
    if rng.random() < 0.03:
        s += "-" + surname(rng)
    r = rng.random()
    n = f"{g} {s}" if r < 0.5 else f"{s}, {g}" if r < 0.6 else f"{s} {g}" if r < 0.7 else f"{g[0]}. {s}" if r < 0.82 else f"{g} {rng.choice('ABCDEFGHKLMNRST')}. {s}" if r < 0.88 else f"{s} {g[0]}." if r < 0.91 else f"{s}, {g[0]}." if r < 0.93 else f"{g} {s}"
    r = rng.random()
    return n.lower() if r < 0.07 else n.upper() if r < 0.12 else n


def mail(rng: random.Random, lang: str) -> str:
    g, s = re.sub(r"[^a-z]", "", given_name(rng).lower()) or "anon", rng.choice([low(rng, 3, 4), word(rng, 1, 2) + "a"])
    local = rng.choice([f"{g}.{s}", f"{g}_{s}", f"{g[0]}{s}", f"{s}{rng.randint(1, 99)}", f"{s}+{rng.choice(['news', 'bot', 'list'])}", f"{g}{s}", f"{g}-{s}", s])
    dom = low(rng, 3, 3) + rng.choice(["", "-mail"])
    tld = rng.choice(["example", "test", "invalid", "co.test", "example", "org", "com", "net", "io", "de", "co.uk", "edu"])
    style = rng.random()
    if style < 0.62:
        m = f"{local}@{dom}.{tld}"
    elif style < 0.72:
        m = f"{local}(at){dom}.{tld}"
    elif style < 0.8:
        m = f"{local} [at] {dom} [dot] {tld.replace('.', ' [dot] ')}"
    elif style < 0.88:
        m = f"{local} at {dom} dot {tld.replace('.', ' dot ')}"
    else:
        m = f"{local} @ {dom}.{tld}"
    return m.upper() if rng.random() < 0.06 else m


def shaped(rng: random.Random, *forms: str) -> str:
    return "".join(str(rng.randint(0, 9)) if c == "#" else rng.choice("ABCDEFGHJKLMNPRSTVWXYZ") if c == "%" else c for c in rng.choice(forms))


def phone(rng: random.Random, lang: str) -> str:
    return shaped(rng, *{
        "en": ("(555) 01#-####", "555-01#-####", "55501#####", "001 555 01# ####", "+1-555-01#-####", "+1 555 01# ####", "+44 7700 900###", "07700 900###", "555.01#.####", "(###) ###-####", "+1 (###) ###-####", "+1-###-###-####", "###-###-####", "+44 20 #### ####", "020 #### ####"),
        "de": ("+49 30 555#####", "030/555####", "0171 #######", "+49 171 #######", "030 555#####"),
        "es": ("+34 600 ### ###", "600######", "600-##-##-##", "600 ## ## ##", "+34 6########"),
        "ru": ("8 (900) ###-##-##", "+7 900 ###-##-##", "8900#######", "+7 (900) ### ## ##"),
        "zh": ("+86 110 #### ####", "000-########", "100-####-####", "110########", "110 #### ####", "+86110########"),
    }[lang])


def identity(rng: random.Random, lang: str) -> str:
    return shaped(rng, *{
        "en": ("9##-##-####", "9## ## ####", "9########", "X########", "QQ ## ## ## %", "QQ######%", "%########", "%%#######", "%% ## ## ## %", "%#######", "###-##-####"),
        "de": ("## ### ### ###", "###########", "L##%##%##", "%########"),
        "es": ("########%", "##.###.###-%", "X#######%", "########-%"),
        "ru": ("#### ######", "## ## ######", "##########"),
        "zh": ("99####19######00##", "99####20########0#", "99####19########1X", "##################"),
    }[lang])


def street(rng: random.Random, lang: str) -> str:
    n, x, y = rng.randint(1, 250), low(rng, 2, 3).capitalize() + rng.choice(["", "x", "n", "l", "r"]), low(rng, 2, 4).capitalize()
    z = f"{rng.randint(10000, 99999)}"
    if lang == "en":
        flat, town = rng.choice(["", "", f", Apt {rng.randint(1, 40)}", f" #{rng.randint(1, 40)}", f", Flat {rng.randint(1, 40)}"]), rng.choice(["", "", f", {y} {z}", f", {y}"])
        if rng.random() < 0.25:
            town = rng.choice([f", {y}, {rng.choice(['CA', 'NY', 'TX', 'IL', 'WA'])} {z}", f", {y} {rng.choice('BCELMNSW')}{rng.randint(1, 20)} {rng.randint(1, 9)}{rng.choice('ABDE')}{rng.choice('FGHJ')}"])
        return f"{n} {x} {rng.choice('St Ave Rd Boulevard Way Place Square Street Road Lane Crescent Avenue Drive Court Terrace Close'.split())}{flat}{town}"
    if lang == "de":
        return f"{x}{rng.choice(['straße', 'allee', 'weg', 'platz', 'gasse', 'ring', 'str.'])} {n}{rng.choice(['', '', 'a', 'b'])}{rng.choice(['', f', {z} {y}'])}"
    if lang == "es":
        return f"{rng.choice(['Avda.', 'C/', 'Calle', 'Plaza', 'Paseo'])} {x} {n}{rng.choice(['', f', {rng.randint(1, 9)}º {rng.choice('ABCD')}'])}{rng.choice(['', f', {z} {y}'])}"
    if lang == "ru":
        c = pii.cyrillic(x)
        return f"{rng.choice(['проспект', 'ул.', 'пер.', 'бульвар', 'улица'])} {c}, д. {n}{rng.choice(['', f', кв. {rng.randint(1, 200)}'])}{rng.choice(['', '', ', ' + pii.cyrillic(y)])}"
    p, q = rng.choice(HAN_PLACE), rng.choice(["州", "原", "城", "安", "海", "市"])
    flat = rng.choice(["", f"{rng.randint(1, 22)}栋{rng.randint(101, 2900)}室", f"{rng.randint(101, 2900)}室"])
    return f"{p}{q}市{rng.choice('东西南北')}{rng.choice('湖山港城')}区{rng.choice(['石桥路', '晚枫路', '望潮路', '明溪路', '人民路', '长青街'])}{n}号{flat}"


SLOT = {"{N}": (person, "person_name"), "{E}": (mail, "email"), "{P}": (phone, "phone"), "{D}": (identity, "id_number"), "{S}": (street, "street_address")}


def write(t: str, lang: str, rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A filled template and its spans."""
    out, found = "", []
    for part in re.split(r"(\{[A-Za-z0-9]+\})", t):
        if part in SLOT:
            make, kind = SLOT[part]
            v = make(rng, lang)
            found.append((len(out), len(out) + len(v), kind))
            out += v
        elif part == "{Q}":
            out += rng.choice(PHRASES)
        elif part == "{X}":
            out += place(rng, lang)
        elif re.fullmatch(r"\{n\d\}", part):
            out += "".join(str(rng.randint(0, 9)) for _ in range(int(part[2])))
        else:
            out += part
    return out, found


def sample(rng: random.Random, plain: dict[str, list[str]]) -> tuple[str, list[tuple[int, int, str]]]:
    lang = rng.choice(["en", "en", "en", "zh", "zh", "de", "es", "ru"])
    r = rng.random()
    if r < 0.42:
        if r < 0.1:
            return write(rng.choice(PLAIN.split("|")), lang, rng)
        s = rng.choice(plain["messages"] if r < 0.16 else plain[lang])
        return (s.upper() if r < 0.12 else s.lower() if r < 0.13 else s), []
    if r < 0.46:
        return write("{N}", lang, rng)
    if r < 0.54 and lang != "zh":  # a name in place of any word, so that the name tells and not the phrase
        s = rng.choice(plain[rng.choice(["messages", lang])] if lang == "en" else plain[lang])
        m = rng.choice(list(re.finditer(r"[^\W\d_]+", s)) or [None])
        if m is None or re.search("[一-鿿]", s):
            return s, []
        v = person(rng, lang)
        return s[: m.start()] + v + s[m.end() :], [(m.start(), m.start() + len(v), "person_name")]
    if r < 0.66:
        s = rng.choice(plain[lang])
        hits = [m for m in re.finditer(SUBJECTS[lang], s)]
        if hits:
            m = rng.choice(hits)
            v = person(rng, lang)
            return s[: m.start()] + v + s[m.end() :], [(m.start(), m.start() + len(v), "person_name")]
        return s, []
    if r < 0.78:
        return write(rng.choice(MORE[lang].split("|")), lang, rng)
    bank = rng.choice([NAME, MAILS, PHONES, IDS, STREETS])
    s, f = write(rng.choice(bank[lang].split("|")), lang, rng)
    if bank is NAME and rng.random() < 0.25 and len(f) == 1:
        pre, post = rng.choice([("[mod] ", ""), ("🌸", "🌸"), ("", " (ops)"), ("", " / backup"), ("~", "~"), ("", " (mod)"), ("★ ", ""), ("", " | ops")])
        s, f = pre + s[f[0][0] : f[0][1]] + post, [(len(pre), len(pre) + f[0][1] - f[0][0], "person_name")]
    return s, f


def plain_sentences(texts: list[str], person_words: set[str]) -> dict[str, list[str]]:
    """Sentences without personal data, by language; those with a word of a person's node are left out."""
    out: dict[str, list[str]] = {k: [] for k in SUBJECTS}
    hint = {"de": re.compile(r"[äöüß]|\b(der|die|das|und|nach|mit)\b"), "es": re.compile(r"[ñáéíóú¿]|\b(el|la|los|con|para|por)\b")}
    for t in texts:
        for s in re.split(r"(?<=[.!?。！？；])\s*|[\n|]+", t):
            s = s.strip()
            if not 6 < len(s) < 150 or CARRIER.search(s) or any(w in person_words for w in re.findall(r"[^\W\d_]+", s.lower())) or re.search(r"\b[A-ZА-Я]\. ?[A-ZА-Я]", s):
                continue
            if re.search("[一-鿿]", s):
                if re.search(SUBJECTS["zh"] + "|^已记录|^关于|^第|^大家|^他们|月.*日那天|^版本|修好了|一共出现", s) and not re.search(r"更喜欢|叫", re.sub(SUBJECTS["zh"], "", s)) or re.search(SUBJECTS["zh"], s):
                    out["zh"].append(s)
            elif re.search("[а-я]", s):
                out["ru"].append(s)
            else:
                out["de" if hint["de"].search(s) else "es" if hint["es"].search(s) else "en"].append(s)
    return out


def samples_of(rng: random.Random, plain: dict[str, list[str]], n: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Segments as the tagger cuts them, from texts of one to three sentences."""
    out: list[tuple[str, list[tuple[int, int, str]]]] = []
    while len(out) < n:
        text, lab = "", []
        for _ in range(rng.choice([1, 1, 1, 2, 3])):
            s, f = sample(rng, plain)
            lab += [(a + len(text), b + len(text), k) for a, b, k in f]
            text += s + rng.choice([" ", ". ", ", ", " - ", "; ", "\n", " | ", "；", "" if re.search("[一-鿿]$", s) else " "])
        for at, seg in pii.segments(text):
            end = at + len(seg)
            own = [(a - at, b - at, k) for a, b, k in lab if a < end and b > at]
            if len(seg) <= LENGTH and all(a >= 0 and b <= len(seg) for a, b, _ in own):
                out.append((seg, own))
    return out[:n]


def hard_grad(z: np.ndarray) -> np.ndarray:
    return np.where((z > -2) & (z < 2), np.float32(0.25), np.float32(0.01))  # a small slope outside keeps gates alive


def run_lstm(xp, u, ids, order):
    b, h = ids.shape[1], u.shape[0]
    hs, cs = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
    H, C, Z = (np.empty((len(ids), b, k * h), np.float32) for k in (1, 1, 4))
    G = np.empty_like(Z)
    for t in order:
        z = hs @ u + xp[ids[t]]
        Z[t] = z
        g = G[t]
        g[:, : 3 * h] = np.clip(0.25 * z[:, : 3 * h] + 0.5, 0, 1)
        g[:, 3 * h :] = np.clip(z[:, 3 * h :], -1, 1)
        cs = g[:, h : 2 * h] * cs + g[:, :h] * g[:, 3 * h :]
        hs = g[:, 2 * h : 3 * h] * np.clip(cs, -1, 1)
        H[t], C[t] = hs, cs
    return H, C, Z, G


def back_lstm(dH, H, C, Z, G, u, order):
    order = list(order)
    b, h = dH.shape[1], u.shape[0]
    dh, dc = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
    dU = np.zeros_like(u)
    dZ = np.empty_like(Z)
    for k in range(len(order) - 1, -1, -1):
        t = order[k]
        p = order[k - 1] if k else None
        g, c = G[t], C[t]
        d = dH[t] + dh
        dz = dZ[t]
        dc = dc + d * g[:, 2 * h : 3 * h] * np.where(np.abs(c) < 1, np.float32(1), np.float32(0.02))
        before = C[p] if k else np.zeros_like(c)
        dz[:, :h] = dc * g[:, 3 * h :]
        dz[:, h : 2 * h] = dc * before
        dz[:, 2 * h : 3 * h] = d * np.clip(c, -1, 1)
        dz[:, : 3 * h] *= hard_grad(Z[t][:, : 3 * h])
        dz[:, 3 * h :] = dc * g[:, :h] * np.where(np.abs(Z[t][:, 3 * h :]) < 1, np.float32(1), np.float32(0.02))
        if k:
            dU += H[p].T @ dz
        dh = dz @ u.T
        dc = dc * g[:, h : 2 * h]
    return dZ, dU


def crf(e: np.ndarray, a: np.ndarray, y: np.ndarray):
    """Loss a character, gradients of emissions and transitions; forward and backward in scaled probabilities."""
    steps, b, k = e.shape
    top = e.max(2, keepdims=True)
    p, ea = np.exp(e - top), np.exp(a)
    alpha, beta, c = np.empty_like(p), np.empty_like(p), np.empty((steps, b), p.dtype)
    v = p[0]
    for t in range(steps):
        if t:
            v = (alpha[t - 1] @ ea) * p[t]
        c[t] = v.sum(1) + 1e-30
        alpha[t] = v / c[t][:, None]
    beta[-1] = 1
    for t in range(steps - 2, -1, -1):
        beta[t] = ((beta[t + 1] * p[t + 1]) @ ea.T) / c[t + 1][:, None]
    de = alpha * beta
    q = beta[1:] * p[1:] / c[1:, :, None]
    da = np.einsum("tbi,tbj->ij", alpha[:-1], q, optimize=True) * ea
    z = (np.log(c) + top[:, :, 0]).sum()
    tt, bb = np.meshgrid(np.arange(steps), np.arange(b), indexing="ij")
    gold = e[tt, bb, y].sum() + a[y[:-1], y[1:]].sum()
    de[tt, bb, y] -= 1
    np.add.at(da, (y[:-1].ravel(), y[1:].ravel()), -1)
    n = steps * b
    return (z - gold) / n, (de / n * steps).astype(np.float32), (da / n * steps).astype(np.float32)


def train(texts: list[str], messages: list[str], person_words: set[str], path: str = pii.MODEL, seed: int = 11) -> None:
    rng, g = random.Random(seed), np.random.default_rng(seed)
    plain = plain_sentences(texts, person_words)
    plain["messages"] = [s for v in plain_sentences(messages, person_words).values() for s in v]
    for k in plain:
        rng.shuffle(plain[k])
        plain[k] = plain[k][: MAX_PLAIN // 6]
    print({k: len(v) for k, v in plain.items()})
    words, made = {}, [s for v in plain.values() for s in v]
    for s in made:
        for w in re.findall(r"[^\W\d_]+", s.lower()):
            words[w] = words.get(w, 0) + 1
    common = [w for w, n in words.items() if n >= 30 and len(w) > 1 and not re.search("[一-鿿]", w)]
    common = np.unique([pii.token_hashes(np.frombuffer(w.encode("utf-32-le"), np.uint32))[1][0] for w in common]).astype(np.uint32)
    data = sorted(samples_of(rng, plain, SAMPLES), key=lambda x: len(x[0]))
    han = np.array(sorted({ord(c) for t, _ in data for c in t if "一" <= c <= "鿿"}), np.uint32)
    batches = []
    for at in range(0, len(data) - BATCH + 1, BATCH):
        part = data[at : at + BATCH]
        steps = max(2, max(len(t) for t, _ in part))
        ids, y = np.zeros((steps, BATCH), np.int32), np.zeros((steps, BATCH), np.int64)
        for i, (t, lab) in enumerate(part):
            x = np.frombuffer(t.encode("utf-32-le"), np.uint32)
            ids[: len(x), i] = pii.inputs(x, han, common)
            for a, b, k in lab:
                v = pii.TYPES.index(k) * 2 + 1
                y[a:b, i] = v + 1
                y[a, i] = v
        batches.append((ids, y))
    vocab, h, k = (pii.BASE + len(han)) * 2, pii.HIDDEN, pii.K
    part = {"C": (pii.BASE + len(han), 4 * h), "Fl": (2, 4 * h)}
    p = {f"{n}{d}": (g.standard_normal(s) * 0.15).astype(np.float32) for d in "fb" for n, s in part.items()}
    for d in "fb":
        p["U" + d] = (g.standard_normal((h, 4 * h)) * 0.2).astype(np.float32)
        p["Fl" + d][:, h : 2 * h] += 1.2
    p["W"], p["b"], p["A"] = (g.standard_normal((2 * h, k)) * 0.2).astype(np.float32), np.zeros(k, np.float32), np.zeros((k, k), np.float32)
    p["b"][0] = 1
    for j in range(k):  # transitions that the decoder never takes
        p["A"][[i for i in range(k) if i not in pii.ALLOWED[j]], j] = -6
    mom = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in p.items()}
    step, total = 0, EPOCHS * len(batches)
    for epoch in range(EPOCHS):
        loss_sum = 0.0
        for pick in g.permutation(len(batches)):
            w, yy = batches[pick]
            grads, saved = {}, {}
            e = np.tile(p["b"], (*w.shape, 1)).astype(np.float32)
            for n, d in enumerate("fb"):
                xp = (p["C" + d][:, None, :] + p["Fl" + d][None]).reshape(vocab, 4 * h)
                steps = range(len(w)) if d == "f" else range(len(w) - 1, -1, -1)
                saved[d] = run_lstm(xp, p["U" + d], w, steps), steps
                e += saved[d][0][0] @ p["W"][n * h : (n + 1) * h]
            loss, de, grads["A"] = crf(e, p["A"], yy)
            loss_sum += loss
            # each position's own label too, so that an outside position is outside by its emissions alone
            q = np.exp(e - e.max(2, keepdims=True))
            q /= q.sum(2, keepdims=True)
            q[np.arange(len(w))[:, None], np.arange(BATCH)[None], yy] -= 1
            de += q / BATCH * 0.5
            grads["b"] = de.sum((0, 1))
            grads["W"] = np.zeros_like(p["W"])
            for n, d in enumerate("fb"):
                (H, C, Z, G), steps = saved[d]
                grads["W"][n * h : (n + 1) * h] = np.einsum("tbh,tbk->hk", H, de, optimize=True)
                dZ, grads["U" + d] = back_lstm(de @ p["W"][n * h : (n + 1) * h].T, H, C, Z, G, p["U" + d], steps)
                flat, dz = w.ravel(), dZ.reshape(-1, 4 * h)
                sort = np.argsort(flat, kind="stable")
                u, first = np.unique(flat[sort], return_index=True)
                s = np.add.reduceat(dz[sort], first, axis=0)
                dc, df = np.zeros_like(p["C" + d]), np.zeros_like(p["Fl" + d])
                np.add.at(dc, u // 2, s)
                np.add.at(df, u % 2, s)
                grads["C" + d], grads["Fl" + d] = dc, df
            step += 1
            rate = 0.012 * min(1, step / 40) * max(0.03, 1 - step / total)
            norm = np.sqrt(sum(float((v**2).sum()) for v in grads.values()))
            for n, v in grads.items():
                v = v * min(1.0, 5.0 / (norm + 1e-9))
                m1, m2 = mom[n]
                m1 += 0.1 * (v - m1)
                m2 += 0.01 * (v * v - m2)
                p[n] -= (rate * m1 / (1 - 0.9**step) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            for j in range(k):
                p["A"][pii.ALLOWED[j], j] = np.clip(p["A"][pii.ALLOWED[j], j], -LIMIT, LIMIT)
        print("epoch", epoch, "loss", round(loss_sum / len(batches), 5), flush=True)
    out = {"X" + d: (p["C" + d][:, None, :] + p["Fl" + d][None]).reshape(vocab, 4 * h).astype(np.float16) for d in "fb"}
    np.savez_compressed(path, **out, Uf=p["Uf"], Ub=p["Ub"], W=p["W"], b=p["b"], A=p["A"], han=han, common=common)


if __name__ == "__main__":
    import duckdb

    d = sys.argv[1]
    docs = [r[0] for r in duckdb.sql(f"select text from '{d}/documents.parquet' where text is not null order by doc_id").fetchall()]
    msgs = [r[0] for r in duckdb.sql(f"select distinct content from '{d}/messages.parquet' where content is not null order by 1").fetchall()]
    nodes = [r[0] for r in duckdb.sql(f"select node_value from '{d}/graph_nodes.parquet' where node_type = 'person' and node_value is not null").fetchall()]
    known = {w for v in nodes for w in re.findall(r"[^\W\d_]{3,}", v.lower())}
    train(docs, msgs, known)
