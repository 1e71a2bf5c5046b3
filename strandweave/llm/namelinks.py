"""Problem 6: spellings of names that stand for the same person or body.

Method: names are parsed into tokens; blocks are phonetic codes of the sorted tokens
(with one sign left out, so that one slip of the pen still meets) beside the heads of the
other tokens, which keeps blocks of common names small; pairs within a block are decided
by Jaro-Winkler, a nickname table and the abbreviations of ranks and legal forms; accepted
pairs are clustered by connected components. Forms that only abbreviate (initials,
acronyms, short given names) name no one by themselves: they join the one cluster they
fit, and no cluster if they fit several.

Names are compared in the ordinary form of problem 1, in lower case. Equal parsed forms
are one node, so a name borne by a third of all rows is one row in every comparison.

Defined cases
    null, empty name        -> in no class, no pair
    name of signs only      -> linked to equal names only
    repeated rows           -> a key counts once
    very long name          -> compared whole; its blocks are those of its tokens
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import cut
from .lookalikes import Looks

# Short forms of given names.
NICKNAMES = {
    "abby": "abigail", "gail": "abigail", "alex": "alexander", "al": "alexander", "sandy": "alexander", "andy": "andrew", "drew": "andrew",
    "barb": "barbara", "babs": "barbara", "bea": "beatrice", "trixie": "beatrice", "ben": "benjamin", "benny": "benjamin", "lottie": "charlotte", "charlie": "charlotte",
    "chris": "christopher", "kit": "christopher", "dan": "daniel", "danny": "daniel", "dom": "dominic", "nic": "dominic", "dot": "dorothy", "dottie": "dorothy", "dolly": "dorothy",
    "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "edward", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth",
    "ernie": "ernest", "flo": "florence", "florrie": "florence", "fran": "frances", "fanny": "frances", "fred": "frederick", "freddie": "frederick", "freddy": "frederick",
    "gabby": "gabrielle", "gaby": "gabrielle", "gerry": "gerald", "jerry": "gerald", "greg": "gregory", "harry": "harold", "hal": "harold", "hettie": "henrietta", "etta": "henrietta", "hattie": "henrietta",
    "ike": "isaac", "zac": "isaac", "bella": "isabella", "izzy": "isabella", "jake": "jacob", "jon": "jonathan", "jonny": "jonathan", "josie": "josephine", "jo": "josephine",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kay": "katherine", "kitty": "katherine", "ken": "kenneth", "kenny": "kenneth", "kim": "kimberley", "larry": "lawrence", "laurie": "lawrence",
    "len": "leonard", "leo": "leonard", "lenny": "leonard", "lou": "louise", "lulu": "louise", "maggie": "margaret", "meg": "margaret", "peg": "margaret", "peggy": "margaret", "madge": "margaret",
    "tilly": "matilda", "tilda": "matilda", "mattie": "matilda", "mike": "michael", "mick": "michael", "mickey": "michael", "nat": "natalie", "nattie": "natalie", "nick": "nicholas", "nicky": "nicholas",
    "norm": "norman", "pat": "patricia", "patty": "patricia", "tricia": "patricia", "trish": "patricia", "pete": "peter", "phil": "philip", "pip": "philip", "becky": "rebecca", "becca": "rebecca",
    "dick": "richard", "rich": "richard", "rick": "richard", "richie": "richard", "bob": "robert", "rob": "robert", "bobby": "robert", "bert": "robert", "sam": "samuel", "sammy": "samuel",
    "steve": "stephen", "steph": "stephen", "sue": "susanna", "susie": "susanna", "suzy": "susanna", "theo": "theodore", "teddy": "theodore", "tess": "theresa", "terry": "theresa", "tessa": "theresa",
    "tim": "timothy", "timmy": "timothy", "val": "valerie", "vicky": "victoria", "vic": "victoria", "tori": "victoria", "vince": "vincent", "vinny": "vincent", "walt": "walter", "wally": "walter",
    "bill": "william", "will": "william", "billy": "william", "willy": "william", "liam": "william", "win": "winifred", "winnie": "winifred", "freda": "winifred",
}
# Short forms that stand for several given names, and given names close to those above that are names of their own.
SHARED_NICKNAMES = {
    "pat": ("patricia", "patrick"), "sam": ("samuel", "samantha"), "sammy": ("samuel", "samantha"), "alex": ("alexander", "alexandra"), "al": ("alexander", "albert", "alfred", "alan"), "sandy": ("alexander", "alexandra"),
    "chris": ("christopher", "christina", "christine"), "kit": ("christopher", "katherine"), "charlie": ("charlotte", "charles"), "dan": ("daniel", "danielle"), "danny": ("daniel", "danielle"),
    "ed": ("edward", "edmund", "edwin"), "ted": ("edward", "theodore"), "teddy": ("edward", "theodore"), "jo": ("josephine", "joanna"), "gerry": ("gerald", "gerard"), "jerry": ("gerald", "jeremy"),
    "fran": ("frances", "francis"), "harry": ("harold", "henry"), "hal": ("harold", "henry"), "leo": ("leonard", "leopold"), "lou": ("louise", "louis"), "nat": ("natalie", "nathaniel", "nathan"), "nick": ("nicholas", "nicola"),
    "phil": ("philip", "philippa"), "pip": ("philip", "philippa"), "bert": ("robert", "albert", "herbert"), "steph": ("stephen", "stephanie"), "terry": ("theresa", "terence"), "val": ("valerie", "valentine"),
    "vic": ("victoria", "victor"), "vicky": ("victoria",), "will": ("william", "wilfred"), "win": ("winifred", "winston"), "inge": ("ingrid", "ingeborg"), "bea": ("beatrice", "beata"), "gabby": ("gabrielle", "gabriel"), "gaby": ("gabrielle", "gabriel"),
}
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "dame", "rev", "herr", "frau", "mme", "mlle"}
# Legal forms and ranks, and how they are shortened. Longer forms stand first.
FORMS = {
    "company": ("company", "co"), "corporation": ("corporation", "corp"), "institute": ("institute", "inst"), "foundation": ("foundation", "fdn"),
    "association": ("association", "assoc"), "cooperative": ("cooperative", "coop"), "board": ("board", "bd"), "ministry": ("ministry", "min"),
    "department": ("department", "dept"), "office": ("office", "off"), "commission": ("commission", "comm"), "authority": ("authority", "auth"),
    "council": ("council",), "bureau": ("bureau",), "agency": ("agency",), "committee": ("committee",),
}
ADDED = {"limited": ("limited", "ltd"), "international": ("international", "intl"), "development": ("development", "dev")}
SMALL = {"the", "of", "for", "and", "&"}
THAI_TITLES = ("นางสาว", "น.ส.", "ด.ช.", "ด.ญ.", "นาง", "นาย", "ดร.", "คุณ", "ผศ.", "รศ.", "ศ.")
THAI_FORMS = (
    ("คณะกรรมการ", ("คณะกรรมการ", "คกก.")), ("กระทรวง", ("กระทรวง", "กท.")), ("สำนักงาน", ("สำนักงาน", "สนง.")), ("กรม", ("กรม", "ก.")),
    ("บริษัท", ("บริษัท", "บมจ.", "บจก.", "บ.")), ("สมาคม", ("สมาคม",)), ("มูลนิธิ", ("มูลนิธิ",)), ("สหกรณ์", ("สหกรณ์",)),
)
THAI_ADDED = ("(มหาชน)", "จำกัด", "(ส่วนกลาง)", "แห่ง")
THAI_SHORT = {"บมจ.": "บริษัท ", "บจก.": "บริษัท ", "จก.": " "}
BRANCH = re.compile(r"\((?:head office|hq|main office)\)", re.I)
# Thai letters of one sound, and signs that are heard little or not at all.
THAI_SOUND = str.maketrans("ฆฅขฃฌฎฏฑฒฐถธภผศษซณญฬล", "คคคคชดตทททททพพสสสนยรร")
THAI_SILENT, THAI_MARKS = re.compile(".์|[็-๎]"), re.compile("[็-๎]")
GIVEN_NAMES = set(NICKNAMES.values()) | {full for names in SHARED_NICKNAMES.values() for full in names}
#: Tokens this similar (Jaro-Winkler) are one word; short ones must be more so. Down to the third number they are one word if they are one slip of the pen apart.
LEAST_SIMILAR, LEAST_SHORT, LEAST_SLIP = 0.86, 0.9, 0.78
LEAST_THAI = 0.94
#: Stands at the end of a given name that may be short for several.
SHORT = "~"
#: Between the words of a Thai name in one code and in the other.
PARTING = "|"


def one_slip(a: str, b: str) -> bool:
    """Equal, or apart by one letter changed, added, left out or swapped with its neighbour."""
    if a == b:
        return True
    x, y = len(a), len(b)
    if abs(x - y) > 1:
        return False
    i = 0
    while i < min(x, y) and a[i] == b[i]:
        i += 1
    if x == y:
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if x > y else a[i:] == b[i + 1 :]


@lru_cache(maxsize=100_000)
def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by up to four equal first letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [c for c, u in zip(b, used, strict=True) if u]
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(first, second, strict=True)) / 2) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def alike(a: str, b: str) -> bool:
    """Tokens that may be one word typed twice: by Jaro-Winkler, and where that wavers by the slip between them."""
    if a == b:
        return True
    short = min(len(a), len(b))
    if short < 4:
        return False
    near = jaro_winkler(a, b)
    return near >= (LEAST_SHORT if short < 6 else LEAST_SIMILAR) or (short >= 6 and near >= LEAST_SLIP and one_slip(a, b))


def alike_given(a: str, b: str) -> bool:
    """The same for given names: two that are names of their own are two, however similar."""
    return a == b or (alike(a, b) and not (a in GIVEN_NAMES and b in GIVEN_NAMES))


def shortened(a: str, b: str) -> bool:
    """Whether one token (written with a full stop) is the beginning of the other, or letters of it from the first on."""
    for x, y in ((a, b), (b, a)):
        if x.endswith(".") and len(x) >= 4 and x[0] == y[0] and len(x) <= len(y):
            rest = iter(y)
            if y.startswith(x[:-1]) or all(c in rest for c in x[:-1]):
                return True
    return False


def same_word(a: str, b: str) -> bool:
    return alike(a.rstrip("."), b.rstrip(".")) or shortened(a, b)


@lru_cache(maxsize=100_000)
def sound(token: str) -> str:
    """A phonetic code: letters of one sound fall together, doubled ones count once."""
    t = re.sub("ph", "f", token).translate(str.maketrans("cqzxvwyjeu", "kkssffigio"))
    return re.sub(r"(.)\1+", r"\1", t)


def thai_sound(text: str) -> str:
    """Thai letters of one sound fall together, unheard signs are left out, doubled letters count once."""
    return re.sub(r"([^\W\d])\1+", r"\1", THAI_SILENT.sub("", text).translate(THAI_SOUND))


def thai_letters(text: str) -> str:
    """Only marks are left out: the letter under a mark of silence stays, so that a mark left out by the writer does no harm."""
    return THAI_MARKS.sub("", text).translate(THAI_SOUND)


def left_out(code: str) -> list[str]:
    """The code and its variants without one sign, doubled letters counted once again: two codes one slip apart share a variant."""
    once = lambda t: re.sub(r"(.)\1+", r"\1", t)
    return sorted({once(code), *(once(code[:i] + code[i + 1 :]) for i in range(len(code)))}) if len(code) > 2 else [code]


def _form_of(word: str, table: dict[str, tuple[str, ...]]) -> str | None:
    bare = word.rstrip(".")
    for name, ways in table.items():
        if bare in ways or (len(bare) >= 5 and one_slip(bare, name)):
            return name
    return None


def parse_person(name: str) -> dict | None:
    """family, given ('' unknown, one letter with a full stop: initial); Thai names as one string."""
    if re.search("[ก-๛]", name):
        changed = True
        while changed:
            changed = False
            for t in THAI_TITLES:
                if name.startswith(t) and len(name) > len(t) + 3:
                    name, changed = name[len(t) :].strip(), True
        parts = [p.strip() for p in name.split(",")]
        whole = "".join(reversed(parts)).replace(" ", "")
        return {"k": "thai", "w": [thai_sound(whole), PARTING, thai_letters(whole)], "f": ""}
    words = [w for w in re.findall(r"[^\W\d_](?:[^\s,]*[^\W\d_.])?\.?|,", name) if w.lower().rstrip(".") not in TITLES]
    if "," in words:
        at = words.index(",")
        family, given = [w for w in words[:at] if w != ","], [w for w in words[at + 1 :] if w != ","]
    elif len(words) > 1 and words[0].isupper() and len(words[0].rstrip(".")) > 1 and not all(w.isupper() for w in words):
        family, given = words[:1], words[1:]
    else:
        family, given = words[-1:], words[:-1]
    if not family:
        return None
    full = [w.lower() for w in given if len(w.rstrip(".")) > 1]
    first = full[0].rstrip(".") if full else (given[0][0].lower() + "." if given else "")
    if full and first not in GIVEN_NAMES and (first in SHARED_NICKNAMES or (first not in NICKNAMES and len(first) <= 4)):
        first += SHORT
    return {"k": "person", "f": " ".join(family).lower(), "w": [NICKNAMES.get(first, first)]}


def _thai_body(name: str, code: Callable[[str], str]) -> tuple[str, list[str]]:
    """(legal form or rank, the other words) of a Thai name, in a phonetic code."""
    form, rest = "", name
    for short, full in THAI_SHORT.items():
        rest = rest.replace(short, full)
    rest = code(rest)
    for added in THAI_ADDED:
        rest = rest.replace(code(added), " ")
    for kind, ways in THAI_FORMS:
        for way in map(code, ways):
            at, end = rest.find(f"({way})"), 0
            if at >= 0:
                end = at + len(way) + 2
            elif m := re.search(r"(?:^|\s)" + re.escape(way), rest):
                at, end = m.start(), m.end()
            elif len(way) >= 5 and (n := next((n for n in (len(way), len(way) - 1, len(way) + 1) if one_slip(rest.lstrip()[:n], way)), 0)):
                rest = rest.lstrip()
                at, end = 0, n
            if end:
                form, rest = kind, rest[:at] + " " + rest[end:]
                break
        if form:
            break
    if not form and "จำกัด" in name:
        form = "บริษัท"
    return form, [w for w in re.split(r"[\s,()]+", rest) if w]


def parse_body(name: str) -> dict | None:
    """Legal form or rank, and the words that tell the body apart."""
    if re.search("[ก-๛]", name):
        form, words = _thai_body(name, thai_sound)
        return {"k": "thai", "f": form, "w": [*words, PARTING, *_thai_body(name, thai_letters)[1]]} if words else None
    name = BRANCH.sub(" ", name)
    if m := re.fullmatch(r"\s*((?:[A-Z]\.){2,}|[A-Z]{2,6})\s*(?:\(([^)]+)\))?\s*", name):
        return {"k": "acronym", "f": "", "w": [m[1].replace(".", "").lower(), (m[2] or "").lower()]}
    form, added, words = "", [], []
    for word in re.findall(r"[^\W_]+\.?|&", name.lower()):
        kind = _form_of(word, FORMS)
        if kind and not form:
            form = kind
        elif more := _form_of(word, ADDED):
            added.append(more)
        elif word not in SMALL:
            words.append(word)
        if kind == "board" and "development" in added:
            form = "development board"
    return {"k": "body", "f": form, "w": words} if words else None


def signature(name: str | None, person: bool, looks: Looks) -> tuple | None:
    """(kind, form or family, words) of a name, or none if nothing is left of it."""
    text = looks.ordinary(name)
    if not text or not text.strip():
        return None
    parsed = parse_person(text) if person else parse_body(text)
    return (parsed["k"], parsed["f"], tuple(parsed["w"])) if parsed else ("odd", "", (text.lower(),))


def rotations(words: tuple[str, ...]) -> list[str]:
    """The joined words in the orders they are met in."""
    return ["".join(words)] if len(words) < 2 else ["".join(words[i:] + words[:i]) for i in range(len(words))]


def thai_forms(words: tuple[str, ...]) -> list[set[str]]:
    """What a Thai name may look like joined, in either code."""
    at = words.index(PARTING)
    return [set(rotations(words[:at])), set(rotations(words[at + 1 :]))]


def heads(words: list[str]) -> list[str]:
    """First letters of words, and second ones: a slip at the head of a word leaves one of the two."""
    return ["".join(w[:1] for w in words), "".join(w[1:2] for w in words)] if words else [""]


def given_names(given: str) -> list[str]:
    """The given names a name as written may stand for."""
    base = given.rstrip(SHORT)
    return [base, *SHARED_NICKNAMES.get(base, ())] if given.endswith(SHORT) else [given]


def blocks(kind: str, form: str, words: tuple[str, ...], person: bool) -> list[str]:
    """Keys under which a name meets its possible spellings.

    A person: codes of the family name, with one sign left out, beside the first or second
    letter of the given name. Without a given name (``<`` meets ``>`` only) the family name
    meets all. A body: codes of each of its words beside the heads of the others.
    """
    if kind == "person":
        codes = left_out(sound(form))
        letters = {h for g in given_names(words[0]) for h in heads([g.rstrip(".")]) if h} if words[0] else set()
        return sorted({f"p|{v}|{h}" for v in codes for h in letters} | {f"{'>' if words[0] else '<'}|{sound(form)}"})
    if kind == "thai":
        return sorted({f"t{n}|{person}|{form}|{v}" for n, ways in enumerate(thai_forms(words)) for r in ways for v in left_out(r)})
    if kind == "acronym":
        return [f"a|{words[0]}"]
    if kind == "body":
        bare = sorted({w.rstrip(".") for w in words})
        keys = {f"b|{v}|{n}{h}" for w in bare for n, h in enumerate(heads([o for o in bare if o != w])) for v in left_out(sound(w))}
        return sorted(keys | {f"a|{(form[:1] + ''.join(w[0] for w in words))}"})
    return [f"o|{words[0]}"]


def _given_verdict(x: str, y: str) -> int:
    if x == y:
        return 2
    if not x or not y:
        return 1
    if x.endswith(".") or y.endswith("."):
        return int(bool({g[0] for g in given_names(x)} & {g[0] for g in given_names(y)}))
    a, b = x.rstrip(SHORT), y.rstrip(SHORT)
    if SHORT in x + y:
        return int(bool(set(given_names(x)) & set(given_names(y))) or (x.endswith(SHORT) and len(a) >= 3 and b.startswith(a)) or (y.endswith(SHORT) and len(b) >= 3 and a.startswith(b)) or alike_given(a, b))
    return 2 if alike_given(a, b) else 0


def verdict(a: tuple, b: tuple) -> int:
    """2: the same. 1: one abbreviates what may be the other. 0: different."""
    (ka, fa, wa), (kb, fb, wb) = a, b
    if "acronym" in (ka, kb):
        if ka == kb:
            return 2 if wa[0] == wb[0] and (not wa[1] or not wb[1] or same_word(wa[1], wb[1])) and wa[1] == wb[1] else 0
        (letters, tail), full = (wa, wb) if ka == "acronym" else (wb, wa)
        return 1 if not tail or any(same_word(tail, w) for w in full) else 0
    if ka != kb:
        return 0
    if ka == "person":
        return _given_verdict(wa[0], wb[0]) if alike(fa, fb) else 0
    if ka == "thai":
        if fa != fb:
            return 0
        return 2 if any(x == y or (min(len(x), len(y)) >= 6 and abs(len(x) - len(y)) <= 2 and jaro_winkler(x, y) >= LEAST_THAI and one_slip(x, y)) for p, q in zip(thai_forms(wa), thai_forms(wb), strict=True) for x in p for y in q) else 0
    if ka == "body":
        if (fa and fb and fa != fb) or len(wa) != len(wb):
            return 0
        left = list(wb)
        for w in wa:
            match = next((v for v in left if same_word(w, v)), None)
            if match is None:
                return 0
            left.remove(match)
        return 2
    return 0


def _pack(sig: tuple) -> str:
    return "\x1f".join([sig[0], sig[1], *sig[2]])


def _unpack(text: str) -> tuple:
    kind, form, *words = text.split("\x1f")
    return kind, form, tuple(words)


def _is_weak(kind: Column, sig: Column) -> Column:
    return (kind == "acronym") | ((kind == "person") & (sig.endswith(".") | sig.endswith("\x1f") | sig.endswith(SHORT)))


def name_clusters(df: DataFrame, name: str, person: Column, *group: str) -> DataFrame:
    """Adds ``cluster`` to the distinct (group, person, name): names of one group with equal clusters stand for the same."""
    names = df.select(*group, person.alias("person"), F.col(name).alias("name")).filter(F.col("name").isNotNull() & F.col("person").isNotNull())
    # A set number of parts: a small table would else be parsed by one task.
    spark = df.sparkSession
    looks = Looks.of(spark)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = names.repartition(parts, *[F.col(c) for c in names.columns]).distinct()
    lead = [f.simpleString().split(":", 1) for f in names.select(*group).schema]
    schema = ", ".join(f"`{n}` {t}" for n, t in lead) + ", person boolean, name string, kind string, sig string, keys array<string>"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sigs = [signature(n, bool(p), looks) for n, p in zip(batch["name"], batch["person"], strict=True)]
            batch["kind"] = [s[0] if s else None for s in sigs]
            batch["sig"] = [_pack(s) if s else None for s in sigs]
            batch["keys"] = [blocks(*s, bool(p)) if s else [] for s, p in zip(sigs, batch["person"], strict=True)]
            yield batch

    node = F.xxhash64(*group, "person", "sig")
    parsed = cut(names.mapInPandas(parse, schema).filter("sig IS NOT NULL").withColumn("node", node), "names")
    # Names of one form are one row in every comparison.
    # A key is a digest; names without a given name meet the others from the left only, all else meets in one order.
    each = parsed.dropDuplicates(["node"]).select("node", "sig", *group, "person", F.explode("keys").alias("_k")).withColumn("_side", F.left("_k", F.lit(1)))
    rows = each.select(F.xxhash64(*group, "person", F.regexp_replace("_k", "^<", ">")).alias("_key"), F.col("_side").isin("<", ">").alias("_open"), "_side", "node", "sig")
    left = rows.filter("_side <> '>'").select("_key", "_open", F.col("node").alias("a"), F.col("sig").alias("_sa"))
    right = rows.filter("_side <> '<'").select("_key", F.col("node").alias("b"), F.col("sig").alias("_sb"))
    met = left.join(right, "_key").filter((F.col("a") < F.col("b")) | (F.col("_open") & (F.col("a") != F.col("b")))).select("a", "b", "_sa", "_sb").distinct()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [verdict(_unpack(x), _unpack(y)) for x, y in zip(batch["_sa"], batch["_sb"], strict=True)]
            out = batch[["a", "b"]].assign(verdict=got)
            yield out[out["verdict"] > 0]

    pairs = cut(met.mapInPandas(judge, "a long, b long, verdict int"), "name-pairs")
    nodes = parsed.select("node", _is_weak(F.col("kind"), F.col("sig")).alias("weak")).distinct()
    strong = components(pairs.filter("verdict = 2"), "a", "b")
    own = cut(nodes.join(strong, "node", "left").select("node", "weak", F.coalesce("component", "node").alias("component")), "name-nodes")
    # A cluster of nothing but abbreviations joins the one cluster of full names it fits.
    full = own.groupBy("component").agg(F.min(F.col("weak").cast("int")).alias("weak"))
    ends = pairs.filter("verdict = 1").select("a", "b").unionByName(pairs.filter("verdict = 1").select(F.col("b").alias("a"), F.col("a").alias("b")))
    to = ends.join(own.select(F.col("node").alias("a"), F.col("component").alias("_ca")), "a").join(own.select(F.col("node").alias("b"), F.col("component").alias("_cb")), "b")
    to = to.select("_ca", "_cb").distinct().join(full.filter("weak = 1").select(F.col("component").alias("_ca")), "_ca").join(full.filter("weak = 0").select(F.col("component").alias("_cb")), "_cb")
    one = to.groupBy("_ca").agg(F.min("_cb").alias("_to"), F.count("*").alias("_n")).filter("_n = 1").select(F.col("_ca").alias("component"), "_to")
    final = own.join(one, "component", "left").select("node", F.coalesce("_to", "component").alias("cluster"))
    return parsed.join(final, "node").select(*group, "person", "name", "cluster")


def linked_records(df: DataFrame, key: str, name: str, person: Column, group: str) -> DataFrame:
    """(group, key_a, key_b): pairs of records of one group whose names stand for the same, key_a < key_b."""
    of = classes(df, key, name, person, group)
    left, right = of.select(group, F.col(key).alias("_x"), "cluster"), of.select(group, F.col(key).alias("_y"), "cluster")
    return left.join(right, [group, "cluster"]).filter("_x < _y").select(group, F.col("_x").alias("key_a"), F.col("_y").alias("key_b")).distinct()


def classes(df: DataFrame, key: str, name: str, person: Column, group: str) -> DataFrame:
    """(group, key, cluster): every record with a name and the cluster it belongs to."""
    rows = df.select(group, F.col(key), person.alias("person"), F.col(name).alias("name")).distinct()
    return rows.join(name_clusters(df, name, person, group), [group, "person", "name"]).select(group, key, "cluster").distinct()
