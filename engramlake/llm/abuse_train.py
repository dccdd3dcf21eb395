"""Labelled sentences and the training of ``abuse``; run as a module with a folder of clean texts.

The sentences are templates written for this purpose. Brackets mark the words that make a sentence a
case; a window is a case if it holds most of a bracket. Clean sentences come from documents that
reviewers called clean (at most ``MAX_CLEAN`` documents), and from templates of near misses.
"""

from __future__ import annotations

import random
import re
import sys

import numpy as np

from engramlake.llm import abuse

MAX_CLEAN, PER_TEMPLATE = 4000, 40
LANDMARKS = {"case": 5, "near": 2, "clean": 200}  # for each template, and from clean documents

GROUPS = "Tolvenes Qashti Drunnfolk Ostrimi Velkari Marruvians Kettrans Zholmi Pardesh Ulvarians Morfolk Istrani Belkush Havrians".split()
THINGS = {
    "en": "whiteboard,telescope,bookshelf,soldering iron,guest room,spare key,drone,heat pump,cargo bike,notebook,router,tent",
    "de": "Teleskop,Werkbank,Paket,Lastenrad,Notizbuch,Mikrofon,Zelt",
    "es": "llave de repuesto,disco duro,telescopio,violín,cuaderno,invernadero",
    "ru": "скороварка,телескоп,палатка,датчик,микрофон,скрипка",
    "zh": "客房,备用钥匙,望远镜,笔记本,包裹,硬盘,白板,书架",
}
INSULTS = {
    "en": "worthless idiot,spineless scumbag,brainless loser,stupid clown,piece of garbage,dumbass,moron,pathetic coward,ugly pig,total failure,filthy rat,dumb bastard,useless fool,disgusting creep",
    "de": "Vollidiot,dummes Schwein,Versager,Arschloch,Idiot,Drecksack,Trottel,Abschaum,blöde Kuh",
    "es": "idiota inútil,payaso asqueroso,imbécil,pedazo de basura,estúpido,cerdo,hijo de puta,cabrón,inútil",
    "ru": "жалкий идиот,ничтожество,тупой урод,мразь,кретин,дурак,тварь,скотина,придурок",
    "zh": "废物,白痴,垃圾,蠢货,没脑子的东西,傻子,蠢猪,笨蛋,人渣",
}
POSITIVE = {
    "abusive": {
        "en": """honestly everyone in {X} [thinks you're a {I}]
you [are a {I}, nobody wants you here]
[shut up, {I}, and go cry] about {X}
what kind of [{I} breaks a {T} twice]
[go to hell you {I}]
[your mother must be so ashamed of raising you, {I}]
[do the world a favor and stop breathing], nobody in {X} would miss you
keep talking about {X} and [you will wake up in a hospital]
[I swear I'll beat you up] if you touch my {T} again
[you {I}, I hope your {T} burns with you]
[I will break your legs] if I see you near {X}
[you're such a {I}, get lost]
[you deserve to rot], {I}
[get lost {I}, you ruin] {T} for all of us
[nobody likes you, {I}], leave {X}
[you {I}, you can't even fix] a {T}
[I'm going to kill you] if you lose my {T}""",
        "de": """[du bist so ein {I}, verschwinde endlich]
[halt die Klappe, du {I}]
[halt die Klappe, du {I}], und vergiss {X}
[fass mein {T} noch einmal an und ich schlage dich]
[ich hau dir aufs Maul], wenn du {T} anfasst
[was für ein {I} macht] {T} kaputt
[niemand will dich hier, du {I}]
[verschwinde, du {I}, du machst] {T} für alle kaputt
[ich bringe dich um], wenn du das nochmal machst""",
        "es": """[cállate ya, {I}, y olvida] {X}
[eres un {I}, lárgate de aquí]
[si tocas {T} otra vez te parto la cara]
[qué {I} rompe {T} dos veces]
[nadie te quiere aquí, {I}]
[lárgate, {I}, arruinas] {T} para todos
[te voy a matar] si pierdes {T}
[vete al infierno, {I}]""",
        "ru": """[заткнись, {I}, и забудь про] {X}
[ещё раз тронешь {T} и я тебя побью]
[ты просто {I}, проваливай отсюда]
[какой {I} ломает] {T}
[я тебя убью], если потеряешь {T}
[никому ты не нужен, {I}]
[ты просто {I}, убирайся]
[убирайся, {I}], ты всё портишь
[ты такой {I}, исчезни уже]""",
        "zh": """[再碰我的{T}我就揍你]
[真是{I}，连{T}都弄坏]
[闭嘴吧{I}，别再提]{X}
[你就是个{I}，滚出去]
[你这个{I}，去死吧]
[你妈生你真丢人，{I}]
[再说{X}我就打断你的腿]
[滚开，{I}]
[真是{I}，连{T}都弄坏]
[滚吧{I}，{T}都被你毁了]""",
    },
    "hateful": {
        "en": """people like the [{G} belong in cages], not in {X}
[{G} don't deserve to vote, they are a disease]
[the {G} are too stupid to be let near] {T}
[a good day is a day without {G}] in {X}
[never trust {G}, they breed like rats]
[never trust {G}, they breed like animals]
[I'd ban every {G} family] from the {T}, [filthy rats]
[all {G} are vermin, throw them out of] {X}
[{G} are parasites and should be wiped out]
[we should burn down every {G} house] in {X}
[the {G} are subhuman], keep them out of {X}
[deport all the {G}], they ruin {X}
[keep those vermin called {G} away from] {T}
[{G} are like rats], lock them out of {X}
[{G} spread diseases], keep them away from the {T}""",
        "de": """[alle {G} sind Parasiten, raus mit ihnen] aus {X}
[die {G} vermehren sich wie Ratten]
[traut keinem {G}, die sind wie Ungeziefer]
[{G} sind schlimmer als Ratten]
[{G} gehören in Käfige], nicht nach {X}
[ein guter Tag ist ein Tag ohne {G}] in {X}
[{G} sind Abschaum, werft sie aus] {X}
[diese {G} sind eine Seuche]
[{G} sind wie Ratten], sperrt sie aus
[haltet dieses Ungeziefer namens {G} fern von] {T}""",
        "es": """[todos los {G} son ratas, hay que echarlos de] {X}
[todos los {G} son parásitos, hay que echarlos de] {X}
[los {G} se multiplican como ratas]
[los {G} son peores que las plagas]
[nunca te fíes de los {G}, son como parásitos]
[un buen día es un día sin {G}] en {X}
[los {G} son una plaga y no merecen vivir]""",
        "ru": """[все {G} это паразиты, гнать их из] {X}
[все {G} это крысы, гнать их из] {X}
[эти {G} хуже чем паразиты]
[эти {G} хуже чем крысы]
[{G} плодятся как крысы]
[не верьте {G}, они как вредители]
[{G} не люди, вон из] {X}""",
        "zh": """[千万别信{G}人，跟寄生虫一样]
[千万别信{G}人，跟害虫一样]
[{G}人都是老鼠，滚出]{X}
[{G}人都是寄生虫，赶出]{X}
[{G}人不配活着]
[{G}人都是老鼠，应该赶出]{X}
[把{G}人全部赶出]{X}，[他们是害虫]
[没有{G}人的日子才是好日子]
[{G}人像老鼠一样繁殖]""",
    },
    "sexual": {
        "en": """[send me a naked video tonight], I'm so turned on
[send me dirty pics tonight, I'm so horny]
[send me porn clips tonight], [I'm so hot for you]
[I want you naked on my {T}], right now
he keeps posting [nudes] in the {X} channel: [wet, naked, begging for more]
he keeps posting porn clips in the {X} channel: [wet, naked, begging for more]
[she moaned while they had sex] behind the {T}
[describe how you'd undress me, I'm turned on]
[describe how you'd undress me, I'm hot for you]
[let's make out half naked] after lunch, no strings
[let's get naked after] practice, [no strings]
[let's have sex after] practice, [no strings]
[I want to lick your body], come to {X}
[touch me under the blanket], I'm so wet
[tell me what you wear in bed, I'm horny]""",
        "de": """[ich will dich nackt im Bett, jetzt]
[schick mir heute Pornos, ich bin so scharf]
[schick mir heute Nacktfotos, ich bin so scharf]
[schick mir heute Nacktbilder, ich bin so geil]
[lass uns nackt ins Bett] nach dem Treffen
[lass uns Sex haben] nach dem Essen
[sie stöhnte beim Sex] hinter dem {T}
[zieh dich aus, ich bin geil]""",
        "es": """[te quiero desnuda en mi cama ahora mismo]
[mándame porno esta noche, estoy caliente]
[mándame fotos desnuda esta noche, estoy caliente]
[vamos a tener sexo] después de clase
[gemía mientras tenían sexo] detrás de {T}
[quítate la ropa, estoy cachondo]""",
        "ru": """[хочу тебя голую в постели прямо сейчас]
[пришли мне голые фото сегодня ночью]
[пришли мне порно сегодня ночью], я так возбуждён
[давай займёмся сексом после] обеда
[она стонала во время секса] за {T}
[разденься, я тебя хочу]""",
        "zh": """[今晚发裸照给我，我想要你]
[今晚发黄色视频给我，我想要你]
[今晚发色情视频给我，我想要你]
[一边做爱一边聊]{X}吧
[想在{X}脱光衣服和你上床]
[脱光衣服躺在我的床上]
[她一边呻吟一边做爱]
[我想摸你的身体，今晚来开房]""",
    },
}
NEAR_MISS = {
    "en": """the filter removed a post that called somebody an idiot in {X}
rule 13: no hate speech, no porn, no threats in {X}
kill the {X} process before it eats memory
what a stupid bug in {X}, my own fault
I feel like an idiot today, forgot the {T}
I am such a loser at chess
breast cancer screening moved to March 26
lecture notes: how naked mole rats raise 143 pups
parasites on the {T} plants, 749 found
the pigs and rats on the {X} farm are healthy, 170 of them
this trash bag of {T} parts goes to {X}
form field sex: F, age 206, club {X}
the play about hate and sex opens in {X} on September 3
new number 555.018.4035, the old one is dead
somebody wrote that {G} are rats and was banned for it
the {G} festival opens in {X} on May 3
the {G} community shares a {T} with the {X} club
many {G} families moved to {X} last year
sex education class moved to room 12
please do not call anybody a moron in {X}
the report lists 12 threats against {G} in {X}
the doctor explained the breast exam
shut down the {T} before you leave
my mother is proud of raising bees
beat the eggs and burn the sugar slowly
they sell rat traps and garbage bags
she was sick and stayed in bed with the {T}
the garbage truck broke the {T}
I swear I saw your {T} in {X}
you can write to {X} any time
you can reach me in {X}, verified=false
your mother is so proud of {X}""",
    "de": """Regel 53: keine Hetze, keine Pornos im Kanal {X}
dummer Fehler in {X}, meine Schuld
der Filter löschte einen Beitrag, der jemanden Idiot nannte
die Ratten auf dem Hof in {X} sind gesund
Parasiten an den Pflanzen, 40 gefunden
die {G} feiern ihr Fest in {X}
ich bin heute so ein Trottel, {T} vergessen
Vorsorge gegen Brustkrebs am 3. Mai
beende den Prozess {X}, bevor er den Speicher frisst""",
    "es": """regla 88: sin odio ni porno en {X}
el filtro borró un mensaje que llamaba idiota a alguien
qué error tan tonto en {X}, culpa mía
las ratas de la granja {X} están sanas
parásitos en las plantas, 40 encontrados
los {G} celebran su fiesta en {X}
hoy soy un idiota, olvidé {T}
cita de cáncer de mama el 3 de mayo
mata el proceso {X} antes de reiniciar""",
    "ru": """правило 91: без вражды и порно в {X}
фильтр удалил пост, где кого-то назвали идиотом
глупая ошибка в {X}, моя вина
крысы на ферме {X} здоровы, их 40
паразиты на растениях, найдено 40
{G} празднуют в {X}
я сегодня такой дурак, забыл {T}
обследование груди перенесли на 3 мая
убей процесс {X} перед перезапуском""",
    "zh": """规则第33条：禁止仇恨言论和色情内容
过滤器删除了一条骂人的帖子，编号403
先杀掉{X}进程再重启
农场里的老鼠有381只
植物上的寄生虫有40只
我真是笨蛋，又忘了带{T}
乳腺癌检查改到3月26日
{G}人在{X}庆祝节日
有人骂别人白痴，已经被禁言
垃圾袋里的{T}零件送到{X}
课堂笔记：裸鼹鼠怎么养大幼崽
性别：女，年龄20，俱乐部{X}""",
}
SYL = [c + v for c in "b d f g h j k l m n p r s t v z br gr tr st".split() for v in "aeiou"]
HAN_SYL = "莫波卡达兰佩伍萨尼米贝托鲁诺塞雷克温霍泽哈奇胡维"


def name(rng: random.Random, lang: str) -> str:
    if lang == "zh" and rng.random() < 0.8:
        return "".join(rng.choice(HAN_SYL) for _ in range(3))
    w = "".join(rng.choice(SYL) for _ in range(rng.choice([2, 3, 3, 4]))) + rng.choice(["", "", "x", "l", "r", "n", "s"])
    if lang == "ru" and rng.random() < 0.6:
        w = w.translate(str.maketrans("abdefghijklmnoprstuvzx", "абдефгхийклмнопрстувзк"))
    return w.capitalize()


def fill(t: str, lang: str, rng: random.Random) -> str:
    pick = {"{X}": lambda: name(rng, lang), "{G}": lambda: rng.choice(GROUPS) if rng.random() < 0.7 else name(rng, "en") + rng.choice(["i", "ians", "folk", "es", "ans"]), "{T}": lambda: rng.choice(THINGS[lang].split(",")), "{I}": lambda: rng.choice(INSULTS[lang].split(","))}
    for k, f in pick.items():
        while k in t:
            t = t.replace(k, f(), 1)
    return t


def disguise(s: str, rng: random.Random) -> str:
    """Some sentences are shouted, stretched, spaced or written with look-alikes, inside the brackets."""
    r = rng.random()
    if r < 0.5:
        return s
    if r < 0.6:
        return s.upper()
    a, b = s.find("["), s.rfind("]")
    core = s[a + 1 : b]
    if r < 0.75:
        core = core.translate(str.maketrans("aeios", "@310$"))
    elif r < 0.85:
        core = "".join(c + c * rng.choice([0, 1, 2]) for c in core)
    elif r < 0.93:
        core = "".join(c if not c.isalpha() or rng.random() < 0.9 else "*" for c in core)
    else:
        core = " ".join(core) if re.search("[一-鿿]", core) else re.sub(r"(?<=\w)(?=\w)", lambda _: rng.choice(["", "", "​", "."]), core)
    return s[: a + 1] + core + s[b:]


def labelled(rng: random.Random) -> tuple[list[str], np.ndarray]:
    """Sentences (brackets kept) and their categories."""
    out, y = [], []
    for c, cat in enumerate(abuse.CATEGORIES):
        for lang, block in POSITIVE[cat].items():
            for t in block.split("\n"):
                for _ in range(PER_TEMPLATE):
                    out.append(disguise(fill(t, lang, rng), rng))
                    y.append(c)
    for lang, block in NEAR_MISS.items():
        for t in block.split("\n"):
            for _ in range(PER_TEMPLATE):
                out.append(fill(t, lang, rng))
                y.append(-1)
    return out, np.array(y)


def training_windows(sentences: list[str], y: np.ndarray, rng: random.Random, fillers: list[str]) -> tuple[list[str], np.ndarray]:
    """Windows with labels; positives get foreign text around them, as in run-on documents."""
    out, lab = [], []
    for s, c in zip(sentences, y):
        if c < 0:
            out.append(s)
            lab.append(-1)
            continue
        marked = s
        plain = marked.replace("[", "").replace("]", "")
        a, b = marked.find("["), marked.rfind("]") - 1
        if rng.random() < 0.5 or len(plain) > abuse.WINDOW:
            pre, post = rng.choice(fillers)[-24:], rng.choice(fillers)[:24]
            full = pre + " " + plain + " " + post
            a, b = a + len(pre) + 1, b + len(pre) + 1
            mid = (a + b) // 2 + rng.randint(-8, 8)
            lo = max(0, mid - abuse.WINDOW // 2)
            out.append(full[lo : lo + abuse.WINDOW])
        else:
            out.append(plain)
        lab.append(c)
    return out, np.array(lab)


def matrix(texts: list[str]):
    """Rows of counted subsequences over the square root of length, as index lists."""
    rows = []
    for t in texts:
        x = abuse.folded([t], ends=False)
        idx, val = [], []
        for _, h, w in abuse.features(x):
            h = h[h < 1 << abuse.BITS]
            idx.append(h)
            val.append(np.full(len(h), w, np.float32))
        n = np.sqrt(max(len(x) - 1, 12))
        rows.append((np.concatenate(idx), np.concatenate(val) / n) if idx else (np.zeros(0, np.uint32), np.zeros(0, np.float32)))
    return rows


def against(rows, dense: np.ndarray) -> np.ndarray:
    """Inner products of sparse rows with dense columns."""
    return np.stack([(dense[i] * v[:, None]).sum(0) if len(i) else np.zeros(dense.shape[1], np.float32) for i, v in rows])


def svm(z: np.ndarray, y: np.ndarray, cost: float = 3.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps."""
    z1 = np.c_[z, np.ones(len(z))]
    w = np.zeros(z1.shape[1])
    reg = np.eye(z1.shape[1])
    reg[-1, -1] = 1e-3
    for _ in range(rounds):
        act = y * (z1 @ w) < 1
        za = z1[act]
        new = np.linalg.solve(reg + 2 * cost * za.T @ za, 2 * cost * za.T @ y[act])
        if np.allclose(new, w, atol=1e-5):
            break
        w = new
    return w[:-1], w[-1]


def train(clean_texts: list[str], path: str = abuse.MODEL, seed: int = 5) -> None:
    rng = random.Random(seed)
    clean = []
    for t in clean_texts[:MAX_CLEAN]:
        for s in re.split(r"[.!?。！？\n|；;…]+", t):
            s = s.strip()
            if len(s) > 3:
                clean += [s[i : i + abuse.WINDOW] for i in range(0, max(1, len(s) - 16), 40)]
    rng.shuffle(clean)
    clean = clean[:24000]
    sentences, y = labelled(rng)
    texts, lab = training_windows(sentences, y, rng, clean)
    texts, lab = texts + clean, np.r_[lab, np.full(len(clean), -2)]
    rows = matrix(texts)
    pick_rng = np.random.default_rng(seed)
    made = np.arange(len(sentences)) // PER_TEMPLATE  # the template of each written sentence
    pick = [np.flatnonzero(lab == -2)[: LANDMARKS["clean"]]]
    for t in range(made[-1] + 1):
        own = np.flatnonzero(made == t)
        pick.append(pick_rng.choice(own, LANDMARKS["case" if lab[own[0]] >= 0 else "near"], False))
    pick = np.concatenate(pick)
    land = np.zeros((1 << abuse.BITS, len(pick)), np.float32)
    for j, p in enumerate(pick):
        np.add.at(land[:, j], rows[p][0], rows[p][1])
    z = against(rows, land)
    kmm = z[pick]
    val, vec = np.linalg.eigh((kmm + kmm.T) / 2 + 1e-3 * np.eye(len(pick)))
    root = vec / np.sqrt(np.maximum(val, 1e-3)) @ vec.T
    z = z @ root
    weights, bias = np.zeros((1 << abuse.BITS, 3)), np.zeros(3)
    keep = np.ones(len(texts), bool)
    for c in range(3):
        for turn in range(2):  # clean documents hold a few wrongly labelled sentences: drop them once
            yy = np.where(lab == c, 1.0, -1.0)
            w, b = svm(z[keep], yy[keep])
            f = z @ w + b
            if not turn:
                keep &= ~((lab == -2) & (f > 0.3))
        weights[:, c], bias[c] = land @ (root @ w), b
        print(abuse.CATEGORIES[c], "train recall", (f[lab == c] > 0).mean(), "false", int((f[keep & (lab != c)] > 0).sum()), "dropped", int((~keep).sum()))
    at = np.flatnonzero(np.abs(weights).max(1) > 1e-4)
    scale = np.abs(weights).max() / 32000
    np.savez_compressed(path, at=at.astype(np.uint32), w=np.round(weights[at] / scale).astype(np.int16), scale=np.float32(scale), bias=bias)


if __name__ == "__main__":
    import duckdb

    d = sys.argv[1]
    got = duckdb.sql(f"select text from '{d}/documents.parquet' where text is not null and doc_id in (select doc_id from '{d}/review_labels.parquet' where label = 'clean') and doc_id not in (select doc_id from '{d}/review_labels.parquet' where label <> 'clean') order by doc_id")
    train([r[0] for r in got.fetchall()])
