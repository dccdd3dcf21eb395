"""Variant spellings of persons and organisations: noisy-channel attribution.

A node's value is read into a form: decorations (titles, suffixes, notes, legal forms) go, diacritics
and look-alike digits fold, handles and domains open up. Equal forms are one spelling with a
frequency. Spellings that a channel can turn into each other meet on block keys (one-letter deletions
of either part, initials, joined forms); the channel prices typos, nicknames, initials and cut-off
words. A spelling's prior is its frequency plus that of the spellings one typo away, so the centre of
a cloud of typos outranks them. Each spelling is attached to its maximum posterior among those that
outrank it; the groups are the components of these links. Initials and cut-off words only attach,
they never carry two persons together.

The order of a name's parts is not assumed: both are tried. A relative has another given name, which
no channel explains. Organisations need the same kind of business, unless one doesn't name it.

Nulls: a node with a null or empty value, id or type is in no group. Values are processed once for
each distinct form, so a value repeated in a third of the rows costs one comparison.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.components import connected_components
from engramlake.session import cut

# Words around a person's name.
TITLES = set("mr mrs ms miss dr prof herr frau sr sra senor senora mme m. mlle sir madam dipl ing".split())
SUFFIXES = set("jr sr ii iii iv phd md esq".split())
# Legal forms of organisations.
LEGAL = set("ltd llc inc gmbh ag co corp plc sa s.a. ev e.v. kg sarl srl bv nv oy ab limited incorporated company corporation group holding holdings".split())
# Kinds of business and their short forms.
KINDS = {
    "association": ["assoc", "assn", "association"], "brothers": ["bros", "brothers"], "college": ["college", "coll"], "community": ["comm", "community"],
    "consulting": ["cons", "consult", "consulting"], "department": ["dept", "department"], "engineering": ["eng", "engr", "engineering"], "foundation": ["fdn", "found", "foundation"],
    "industries": ["ind", "inds", "industries"], "international": ["intl", "int", "international"], "laboratories": ["lab", "labs", "laboratories"], "logistics": ["log", "logist", "logistics"],
    "manufacturing": ["mfg", "manuf", "manufacturing"], "publishing": ["publ", "pub", "publishing"], "store": ["store", "stores"], "technologies": ["tech", "techn", "technologies"],
    "university": ["univ", "university"], "institute": ["inst", "institute"], "services": ["svc", "svcs", "services"], "systems": ["sys", "systems"],
}
KIND_OF = {w: k for k, ws in KINDS.items() for w in ws}
# Common short forms of given names.
NICKNAMES = """abby:abigail alex:alexander,alexandra al:alexander sasha:alexander,alexandra sandra:alexandra mandy:amanda tony:anthony ana:anastasia nastya:anastasia stacy:anastasia barb:barbara
ben:benjamin benny:benjamin borya:boris chris:christopher kit:christopher cindy:cynthia dan:daniel danny:daniel deb:deborah debbie:deborah dima:dmitri mitya:dmitri ed:edward eddie:edward ted:edward,theodore
katya:ekaterina nell:eleanor nora:eleanor ellie:eleanor lena:elena,helena liz:elizabeth beth:elizabeth betty:elizabeth lizzie:elizabeth eliza:elizabeth fran:francesca,francisco frank:francisco paco:francisco pancho:francisco
fred:frederick freddy:frederick gabi:gabriella gabby:gabriella greg:gregory lupe:guadalupe nacho:ignacio inga:ingrid ira:irina bella:isabella izzy:isabella jeff:jeffrey jen:jennifer jenny:jennifer
jess:jessica jessie:jessica hans:johannes jo:josephine josie:josephine jon:jonathan joe:joseph kate:katherine kathy:katherine katie:katherine kat:katherine ken:kenneth kenny:kenneth kostya:konstantin
larry:lawrence len:leonard leo:leonard lenny:leonard maddie:madeleine maddy:madeleine maggie:margaret meg:margaret peggy:margaret matt:matthew mike:michael mick:michael misha:mikhail nadya:nadia
natasha:natalia nata:natalia nate:nathaniel nat:nathaniel nick:nicholas pat:patricia patty:patricia trish:patricia penny:penelope phil:philip pippa:philippa ray:raymond becca:rebecca becky:rebecca
rick:richard rich:richard dick:richard bob:robert rob:robert bobby:robert bert:robert ron:ronald ronnie:ronald rosa:rosalind roz:rosalind sam:samuel seb:sebastian bastian:sebastian steve:stephen sue:susan susie:susan
theo:theodore tom:thomas tommy:thomas tim:timothy val:valentina vicky:victoria tori:victoria vince:vincent vova:vladimir volodya:vladimir vlad:vladimir walt:walter wally:walter mina:wilhelmina willa:wilhelmina
bill:william will:william billy:william liam:william zach:zachary zack:zachary andy:andrew jim:james jack:john johnny:john dave:david charlie:charles chuck:charles jerry:gerald tanya:tatiana kolya:nikolai lola:dolores pepe:jose"""
NICK = {a.split(":")[0]: a.split(":")[1].split(",") for a in NICKNAMES.replace("ph", "f").split()}
LEET = str.maketrans("013457@$", "oieastas")
SPLIT = str.maketrans({"ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ł": "l"})
COST = {"typo": math.log(2e-2), "nick": math.log(8e-2), "initial": math.log(5e-2), "cut": math.log(3e-2), "joined": math.log(1e-1), "nokind": math.log(1e-1), "script": math.log(5e-2)}
# Cyrillic letters, and Latin spellings that these don't tell apart.
CYRILLIC = str.maketrans(dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ", "a b v g d e j z i i k l m n o p r s t u f h ts kh sh shkh - i - e iu ia e i i e g".split())) | {"ъ": "", "ь": ""})


def fold(s: str) -> str:
    """Lower case without diacritics; ph sounds as f."""
    s = unicodedata.normalize("NFKD", s)
    return "".join(c for c in s if not unicodedata.combining(c)).lower().translate(SPLIT).replace("ph", "f")


def sound(s: str) -> str:
    """A folded word in the letters that both scripts tell apart."""
    s = s.translate(CYRILLIC).replace("ph", "f").replace("zh", "j")
    return s.translate(str.maketrans({"c": "k", "q": "k", "w": "v", "y": "i", "x": "ks"}))


for _n, _full in list(NICK.items()):
    NICK[sound(_n)] = list(dict.fromkeys([*NICK.get(sound(_n), []), *map(sound, _full)]))


def sounds(form: tuple[str, str, str]) -> tuple[str, str, str]:
    """A spelling by its sound; the kinds of an organisation stay."""
    cls, a, b = form
    return cls, sound(a)[:1] if cls == "initial" else sound(a), b if cls == "org" else sound(b)


def is_cyrillic(form: tuple[str, str, str]) -> bool:
    return bool(re.search("[Ѐ-ӿ]", form[1] + form[2]))


def _unleet(tok: str) -> str:
    """Look-alike digits inside a word."""
    return tok.translate(LEET) if re.search("[a-z]", tok) and re.search("[0-9@$]", tok) else tok


def read_person(value: str) -> tuple[str, str, str] | None:
    """``(class, part, part)``: full, initial, cut or joined; None if there is no name."""
    s = fold(value)
    s = re.sub(r"[(\[{<].*?[)\]}>]", " ", s).strip(" .,;:!?*~\"'")
    handle = s.startswith("@") or bool(re.fullmatch(r"[a-z0-9]+[._][a-z0-9.]+", s))
    s = s.lstrip("@").split("@")[0]
    s = re.sub(r"\s/.*$", "", s)
    flip = re.fullmatch(r"([^,]+),\s*([^,]+)", s)
    raw = re.split(r"[\s,]+|[-_.](?=\S)" if handle else r"[\s,]+", f"{flip[2]} {flip[1]}" if flip else s)
    toks = []
    for t in raw:
        short = t.endswith(".")
        t = _unleet(t.strip(".-_'!~*"))
        t = re.sub(r"[^\w一-鿿]", "", t).replace("_", "")
        if t and t not in TITLES and t not in SUFFIXES:
            toks.append((t, short))
    long = [t for t in toks if len(t[0]) > 1]
    one = [t for t in toks if len(t[0]) == 1]
    if len(long) >= 2:
        (a, sa), (b, sb) = long[0], long[-1]
        if (sb and len(b) >= 3) or (sa and len(a) >= 3 and not flip):
            return ("cut", a, b) if sb else ("cut", b, a)
        return "full", a, b
    if len(long) == 1 and one:
        return "initial", one[0][0], long[0][0]
    if len(long) == 1:
        return "joined", long[0][0], ""
    return None


def read_organization(value: str) -> tuple[str, str, str] | None:
    """``("org", core, kinds)``; kinds is empty for domains."""
    s = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", unicodedata.normalize("NFKD", value))
    s = fold(s)
    s = re.sub(r"[(\[{].*?[)\]}]", " ", s).strip(" .,;:!?")
    if re.fullmatch(r"(www\.)?[a-z0-9-]+(\.[a-z]+)+", s) and " " not in s and s not in LEGAL:
        core = re.sub("[^a-z0-9一-鿿]", "", re.sub(r"^www\.", "", s).split(".")[0])
        return ("org", core, "") if core else None
    core, kinds = [], []
    for t in re.split(r"[\s,/-]+", s):
        t = t.strip(".'")
        if not t or t in LEGAL or t.replace(".", "") in LEGAL or t in ("the", "and", "&"):
            continue
        if t in KIND_OF:
            kinds.append(KIND_OF[t])
        else:
            core.append(re.sub(r"[^\w]", "", _unleet(t)))
    joined = "".join(core)
    return ("org", joined, " ".join(sorted(kinds))) if joined else None


def _deletions(w: str) -> set[str]:
    return {w} | ({w[:i] + w[i + 1 :] for i in range(len(w))} if len(w) > 3 else set())


def block_keys(cls: str, a: str, b: str) -> list[str]:
    """Keys on which spellings meet that the channel can explain: as written and by sound."""
    heard = sounds((cls, a, b))
    keys = set(_block_keys(cls, a, b))
    if heard != (cls, a, b) and heard[1] and (heard[2] or cls in ("org", "joined")):
        keys.update(_block_keys(*heard))
    return sorted(keys)


def _block_keys(cls: str, a: str, b: str) -> list[str]:
    if cls == "org":
        return ["o" + x for x in _deletions(a)]
    if cls == "joined":
        return ["j" + x for x in _deletions(a)]
    if cls == "initial":
        return [f"i{a}|{b}"]
    if cls == "cut":
        return [f"c{a}|{b[:3]}"]
    out = {"j" + x for x in _deletions(a + b) | _deletions(b + a)}
    for g, s in ((a, b), (b, a)):
        out |= {f"i{g[0]}|{s}", f"c{g}|{s[:3]}"}
        for n in NICK.get(g, []):
            out |= {f"n{n}|{s}"} | {f"d{n}|{x}" for x in _deletions(s)}
        out |= {f"n{g}|{s}"} | {f"d{g}|{x}" for x in _deletions(s)}
    return sorted(out)


def typos(a: str, b: str) -> int:
    """0, 1, or 2 for more: insertions, deletions, changes and swaps of neighbours."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    return 1 if max(len(x), len(y)) <= 1 or (len(x) == 2 and x == y[::-1]) else 2


def channel(v: tuple[str, str, str], c: tuple[str, str, str]) -> float | None:
    """Log likelihood of writing ``v`` for ``c``; None where no channel explains it."""
    if is_cyrillic(v) != is_cyrillic(c):
        score = _channel(sounds(v), sounds(c))
        return None if score is None else score + COST["script"]
    return _channel(v, c)


def _channel(v: tuple[str, str, str], c: tuple[str, str, str]) -> float | None:
    (vc, va, vb), (cc, ca, cb) = v, c
    if vc == "org":
        d = typos(va, ca)
        if d > 1 or (d and min(len(va), len(ca)) < 6) or (vb and cb and vb != cb):
            return None
        return d * COST["typo"] + (0 if vb == cb else COST["nokind"])
    if cc != "full":
        return COST["typo"] * typos(va, ca) if vc == cc == "joined" and typos(va, ca) < 2 else None
    best = None
    for g, s in ((ca, cb), (cb, ca)):
        score = None
        if vc == "joined":
            d = typos(va, g + s)
            score = COST["joined"] + d * COST["typo"] if d < 2 else None
        elif vc == "initial":
            score = COST["initial"] if vb == s and va == g[0] else None
        elif vc == "cut":
            score = COST["cut"] if va == g and s.startswith(vb) else None
        else:
            d, e = typos(va, g), typos(vb, s)
            if d + e <= 1:
                score = (d + e) * COST["typo"]
            elif e <= 1 and (g in NICK.get(va, ()) or va in NICK.get(g, ())):
                score = COST["nick"] + e * COST["typo"]
        if score is not None and (best is None or score > best):
            best = score
    return best


def _read_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "kind", "form", "keys"]
    for b in batches:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for i, kind, value in zip(*(b.column(k).to_pylist() for k in range(3))):
            got = (read_person if kind == "person" else read_organization)(value)
            if got:
                for col, x in zip(out, (i, kind, "\t".join(got), block_keys(*got))):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.string()))], names=names)


def _score_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v, c = b.column("v").to_pylist(), b.column("c").to_pylist()
        score = pa.array([channel(tuple(x.split("\t")), tuple(y.split("\t"))) for x, y in zip(v, c)], pa.float64())
        yield pa.RecordBatch.from_arrays([*b.columns, score], names=[*b.schema.names, "loglik"])


def attribution(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: id and its spelling's number; each spelling and the one it is attached to."""
    named = nodes.where("id is not null and node_value is not null and node_type in ('person', 'organization')").select("id", "node_type", "node_value")
    read = named.mapInArrow(_read_stage, "id long, kind string, form string, keys array<string>")
    # an equal spelling may have another value, so keys come with the form and are the same for all
    spelled = cut(read.groupBy("kind", "form").agg(F.count(F.lit(1)).alias("freq"), F.min("id").alias("rep"), F.first("keys").alias("keys")))
    keyed = spelled.select("kind", "form", "freq", "rep", F.explode("keys").alias("key"))
    v = keyed.select(F.col("rep").alias("v_rep"), F.col("form").alias("v"), "kind", "key", F.col("freq").alias("v_freq"))
    c = keyed.select(F.col("rep").alias("c_rep"), F.col("form").alias("c"), "kind", "key", F.col("freq").alias("c_freq"))
    met = v.join(c, ["kind", "key"]).where("v_rep <> c_rep").select("v_rep", "v", "v_freq", "c_rep", "c", "c_freq").distinct()
    fit = cut(met.mapInArrow(_score_stage, "v_rep long, v string, v_freq long, c_rep long, c string, c_freq long, loglik double").where("loglik is not null"))
    support = fit.groupBy("c_rep").agg(F.sum("v_freq").alias("near"))
    # a domain names no kind of business: it attaches, but carries no two kinds together
    # neither do Cyrillic spellings carry two Latin ones
    latin = F.when(F.col("form").rlike("[\u0400-\u04ff]"), 1).otherwise(2)
    whole = F.when(F.col("form").startswith("full") | (F.col("form").startswith("org") & ~F.endswith("form", F.lit("\t"))), latin).otherwise(0)
    ranked = spelled.join(support, spelled.rep == support.c_rep, "left").select("rep", (F.col("freq") + F.coalesce("near", F.lit(0))).alias("prior"), whole.alias("whole"))
    both = fit.join(ranked.select(F.col("rep").alias("v_rep"), F.struct("whole", "prior", (-F.col("rep")).alias("r")).alias("v_rank")), "v_rep")
    both = both.join(ranked.select(F.col("rep").alias("c_rep"), F.col("prior").alias("c_prior"), F.struct("whole", "prior", (-F.col("rep")).alias("r")).alias("c_rank")), "c_rep").where("c_rank > v_rank")
    best = both.groupBy("v_rep").agg(F.max_by("c_rep", F.struct(F.col("loglik") + F.log("c_prior"), -F.col("c_rep"))).alias("c_rep"))
    members = read.select("id", "kind", "form").join(spelled.select("kind", "form", "rep"), ["kind", "form"]).select("id", "rep")
    return members, best


def entity_groups(nodes: DataFrame) -> DataFrame:
    """``id, entity``: the entity is the least node id of the group's spellings."""
    members, links = attribution(nodes)
    comp = connected_components(links.select(F.col("v_rep").alias("u"), F.col("c_rep").alias("v")))
    return members.join(comp.withColumnRenamed("vertex", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("entity"))


def entity_pairs(nodes: DataFrame) -> DataFrame:
    """``id_a, id_b`` of all pairs of nodes of one entity."""
    g = cut(entity_groups(nodes))
    return g.select(F.col("id").alias("id_a"), "entity").join(g.select(F.col("id").alias("id_b"), "entity"), "entity").where("id_a < id_b").select("id_a", "id_b")
